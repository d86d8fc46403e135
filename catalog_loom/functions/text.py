"""Cleaning and key expressions. Each takes and returns a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that stand for others in wrongly decoded pages; U+0085 becomes three dots.
MOJIBAKE_FROM = "\u0084\u0093\u0092\u0096–—"
MOJIBAKE_TO = "\"\"'---"
# Order numbers that only name a medium.
MEDIUM_ONLY = ("CD.", "CD", "MC.", "MC")
SHORTEST_ORDER_NUMBER = 5
# Fixed value: names among the genres that aren't genres.
UNWANTED_GENRES = ("Award-Verdächtig!",)
# Two letters for an umlaut, in the order in which they are replaced.
DIGRAPHS = (("Ae", "Ä"), ("Oe", "Ö"), ("Ue", "Ü"), ("ae", "ä"), ("oe", "ö"), ("ue", "ü"))
# Windows-1252 for the bytes 80 to 9F that it defines, in order; five are undefined.
CP1252_BYTES = "\u0080\u0082\u0083\u0084\u0085\u0086\u0087\u0088\u0089\u008a\u008b\u008c\u008e\u0091\u0092\u0093\u0094\u0095\u0096\u0097\u0098\u0099\u009a\u009b\u009c\u009e\u009f"
CP1252_CHARS = "".join(c.encode("latin-1").decode("cp1252") for c in CP1252_BYTES)
CP1252_UNDEFINED = "[\u008d\u008f\u0090\u009d]"


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def collapse_whitespace(x: Column) -> Column:
    """Any Unicode white space, and the controls U+001C to U+001F, as one space; no white space at the ends; empty is null."""
    return F.nullif(F.trim(F.regexp_replace(x, r"(?U)[\s\x1c-\x1f]+", " ")), F.lit(""))


def fix_mojibake(x: Column) -> Column:
    return F.replace(F.translate(x, MOJIBAKE_FROM, MOJIBAKE_TO), F.lit("\u0085"), F.lit("..."))


def clean_text(x: Column) -> Column:
    """Mojibake first: U+0085 also counts as white space."""
    return collapse_whitespace(fix_mojibake(x))


def clean_order_number(x: Column) -> Column:
    cleaned = clean_text(x)
    return F.when(~F.upper(cleaned).isin(*MEDIUM_ONLY) & (F.length(cleaned) >= SHORTEST_ORDER_NUMBER), cleaned)


def clean_genres(x: Column, unwanted: tuple[str, ...] = UNWANTED_GENRES) -> Column:
    """Cleaned names in the order of their first place, without nulls and unwanted ones."""
    cleaned = F.filter(F.transform(x, clean_text), lambda g: g.isNotNull() & (~g.isin(*unwanted) if unwanted else F.lit(True)))
    return F.array_distinct(cleaned)


def clean_credits(x: Column) -> Column:
    """Structs of role and speaker, both cleaned; those that lack either go, repeated ones stay."""
    cleaned = F.transform(x, lambda c: F.struct(clean_text(c["role"]).alias("role"), clean_text(c["speaker"]).alias("speaker")))
    return F.filter(cleaned, lambda c: c["role"].isNotNull() & c["speaker"].isNotNull())


def series_name(x: Column) -> Column:
    return F.regexp_replace(x, "^Serien: ", "")


def umlauts(x: Column) -> Column:
    for two, one in DIGRAPHS:
        x = F.replace(x, F.lit(two), F.lit(one))
    return x


def comparison_key(x: Column) -> Column:
    return F.lower(umlauts(x))


def folded_name(x: Column) -> Column:
    """The other way: umlauts and sharp s as two letters, lower case, trimmed."""
    low = F.lower(x)
    for one, two in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        low = F.replace(low, F.lit(one), F.lit(two))
    return F.trim(low)


def release_date(x: Column) -> Column:
    """Day, month and year with dots; null if it isn't such a date."""
    return F.try_to_date(x, "d.M.yyyy")


def staged_label(x: Column) -> Column:
    return F.nullif(blank_to_null(x), F.lit("?"))


def series_key(x: Column) -> Column:
    """Lower case, trimmed, each run of white space one space."""
    return F.lower(F.regexp_replace(F.trim(x), r"\s+", " "))


def text_key(*parts: Column) -> Column:
    """Parts with colons between; a null part is empty."""
    out = [F.coalesce(parts[0].cast("string"), F.lit(""))]
    for p in parts[1:]:
        out += [F.lit(":"), F.coalesce(p.cast("string"), F.lit(""))]
    return F.concat(*out)


def decode_page(content: Column) -> Column:
    """Bytes of a Windows-1252 page, with the byte 81 (alone, or after a u umlaut) standing for a u umlaut."""
    raw = F.decode(content, "ISO-8859-1")
    return F.translate(F.replace(F.replace(raw, F.lit("ü\u0081"), F.lit("ü")), F.lit("\u0081"), F.lit("ü")), CP1252_BYTES, CP1252_CHARS)


def encode_page(html: Column) -> Column:
    """Bytes of a page in Windows-1252, of characters that it has."""
    return F.encode(F.translate(html, CP1252_CHARS, CP1252_BYTES), "ISO-8859-1")


def undecodable(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1").rlike(CP1252_UNDEFINED)


def page_file_name(url: Column) -> Column:
    """A slug of at most 80 characters and the first ten hex digits of the address's SHA-1."""
    slug = F.lower(F.regexp_replace(F.regexp_replace(url, "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""))
    return F.concat(F.substring(slug, 1, 80), F.lit("_"), F.substring(F.sha1(url), 1, 10), F.lit(".html"))


def number_after(x: Column, pattern: str) -> Column:
    return F.regexp_extract(x, pattern, 1).try_cast("bigint")


def episode_code(url: Column) -> Column:
    return number_after(url, r"code=(\d+)")


def page_code(file_name: Column) -> Column:
    return number_after(file_name, r"_code_(\d+)_")


def series_code(html: Column) -> Column:
    """The number in the first link to a series: what follows its first serie= up to an ampersand; null if that is no number."""
    href = F.regexp_extract(html, r"""(?is)<a\s[^>]*?\bhref\s*=\s*["']?([^"'>]*hsp_serie\.asp\?serie=[^"'>]*)""", 1)
    value = F.regexp_extract(href, "serie=([^&]*)", 1)
    return F.when(value.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(value).try_cast("bigint"))
