"""Records from list and detail pages.

Only reading the markup is Python (one pass over each page, linear in its length, inside mapInArrow); matching, cleaning and
keys are DataFrame expressions. A page that can't be read gives a parse_error and stops no other page; so does an address
that can't be resolved, which is null then.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_loom.functions.text import clean_credits, clean_genres, clean_order_number, clean_text, episode_code, page_code, page_file_name, series_code, series_name
from catalog_loom.functions.unicode import source_key
from catalog_loom.operators.order import numbered
from catalog_loom.operators.dedup import canonical_credits, first_in_page, keep_first
from catalog_loom.sources import store
from catalog_loom.sources.files import written, written_at

# How the pages mark what is read from them.
SERIES_LINK, DETAIL_LINK, LABEL_LINK, COVER_PART = "hsp_serie.asp?serie=", "hsp_anzeige.asp?code=", "hsp_serienanzeige.asp?verlag=", "bilder/bilder/"
DETAIL_BACKGROUND = "img/backgrounds/BG_hsp_dynamisch.gif"
CELLS = {("75%", "left", "top"): "path", ("35%", "justify", "top"): "text", ("35%", "left", "top"): "credits"}
HEADERS = ("Serie", "Nr", "Titel", "Verlag", "Bestellen")
CREDIT_HEADERS = ("Rolle", "Sprecher/in")
NO_PREVIOUS = "keine folge davor"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

KEPT = {"a", "img", "span", "table", "td", "tr"}
HIDDEN = ("script", "style")
#: Tags that read alike under any rules: lower-case names, values in double quotes without references; and elements whose
#: content may not be markup.
PLAIN_TAG = r'/?[a-z][a-z0-9]*(?: [a-z]+="[^"<>&]*")*'
#: A row of cells that hold text only, a link that does, or any other plain tag.
PLAIN = re.compile(rf'<(?:tr>((?:<td>[^<]*</td>)+)</tr|a href="([^"<>&]*)">([^<]*)</a|({PLAIN_TAG}))>')
PLAIN_ATTRIBUTE = re.compile(r' ([a-z]+)="([^"]*)"')
RAW = {*HIDDEN, "iframe", "listing", "noembed", "noframes", "noscript", "plaintext", "textarea", "title", "xmp"}
#: Addresses that a base's folder is put before as it is.
PLAIN_ADDRESS = re.compile(r"(?:[A-Za-z0-9_]+/)*[A-Za-z0-9_]+(?:\.[A-Za-z0-9_]+)*(?:\?[A-Za-z0-9_=]+)?")
DESCRIPTION = "Beschreibung:"
MOST_CELLS = 5  # one more than a row of credits has
#: A page's texts taken together may be so many times as long as the page; only cells nested in one another reach that.
TIMES_OF_TEXT = 100

CREDITS = pa.list_(pa.struct([("role", pa.string()), ("speaker", pa.string())]))
LIST_ROWS = pa.schema([("page", pa.string()), ("pos", pa.int32()), ("parse_error", pa.string()), ("series_name", pa.string()), ("number_text", pa.string()), ("title", pa.string()), ("url", pa.string())])
LIST_DDL = "page string, pos int, parse_error string, series_name string, number_text string, title string, url string"
DETAIL = pa.schema([
    ("page", pa.string()), ("parse_error", pa.string()), ("title", pa.string()), ("series_name", pa.string()), ("number_text", pa.string()), ("label", pa.string()), ("description", pa.string()),
    ("text", pa.string()), ("cover_url", pa.string()), ("speakers", CREDITS), ("genres", pa.list_(pa.string())), ("links", pa.list_(pa.string())), ("path_text", pa.string()),
])
DETAIL_DDL = (
    "page string, parse_error string, title string, series_name string, number_text string, label string, description string, text string, cover_url string, "
    "speakers array<struct<role:string,speaker:string>>, genres array<string>, links array<string>, path_text string"
)


@functools.lru_cache(4096)
def plain_tag(raw: str) -> tuple[bool, str, dict[str, str]] | None:
    """Whether a plain tag closes an element, its name and its attributes; null if it is to be read by HTMLParser."""
    name, _, rest = raw.partition(" ")
    closes = name[0] == "/"
    name = name.removeprefix("/")
    return None if name in RAW or (closes and rest) else (closes, name, dict(PLAIN_ATTRIBUTE.findall(" " + rest)) if rest else {})


class Page(HTMLParser):
    """The parts of a page that records are made of, gathered in one pass: an element of a KEPT tag is a number, its place among
    them in document order; what lies in it are the elements from the next one to last, and the strings from start to end.
    Cells and rows that aren't closed end where the next one of their table begins. A row gets its first MOST_CELLS cells, at
    any depth, while the page is read: outer rows hold all that inner ones do, so those not yet full are the innermost, and
    no cell is looked at by a full one."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tags: list[str] = []
        self.attrs: list[dict[str, str]] = []
        self.last: list[int] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.strings: list[str] = []
        self.of: dict[str, list[int]] = {tag: [] for tag in KEPT}
        self.cells: dict[int, list[int]] = {}
        self.links: dict[str, list[int]] = {SERIES_LINK: [], DETAIL_LINK: [], LABEL_LINK: []}
        self._open: list[tuple[str, int]] = [("", -1)]
        self._count: defaultdict[str, int] = defaultdict(int)
        self._rows: list[int] = []
        self._scopes = [[0, 0, 0]]  # of each open table: its depth, and those of its open cell and row (0: none)
        if not self._split(html):
            self.feed(html)
            self.close()
        self._leave(1)
        self.upto = list(accumulate(map(len, self.strings), initial=0))
        self._left = TIMES_OF_TEXT * (self.upto[-1] + 1000)

    def _split(self, html: str) -> bool:
        """Read a page whose tags are all plain; false, and nothing read, for another."""
        parts = PLAIN.split(html)
        if "<" in "".join(parts[::5]):
            return False
        tags = [raw and plain_tag(raw) for raw in parts[4::5]]
        if any(tag is None and raw is not None for tag, raw in zip(tags, parts[4::5], strict=True)):
            return False
        if parts[0].strip():
            self.handle_data(unescape(parts[0]))
        opened, count, scopes, strings, rows, cells_of = self._open, self._count, self._scopes, self.strings, self._rows, self.cells
        names, owns, last, start, end, of = self.tags, self.attrs, self.last, self.start, self.end, self.of
        place, said = 0, len(strings)
        for row, href, shown, read, text in zip(parts[1::5], parts[2::5], parts[3::5], tags, parts[5::5], strict=True):
            if row is not None:
                self._row(row[4:-5].split("</td><td>"))
                place, said = len(names), len(strings)
            elif href is not None:
                names.append("a")
                of["a"].append(place)
                owns.append({"href": href})
                start.append(said)
                if shown and (shown := (unescape(shown) if "&" in shown else shown).strip()):
                    strings.append(shown)
                    said += 1
                end.append(said)
                for part, places in self.links.items():
                    if part in href:
                        places.append(place)
                place += 1
                last.append(place)
            elif (closes := read[0]) or (tag := read[1]) != "td" or scopes[-1][1]:
                tag = read[1]
                if not closes:
                    self._begin(tag, read[2])
                    place = len(names)
                elif opened[-1][0] == tag:  # what _leave does for the element opened last
                    at = opened.pop()[1]
                    count[tag] -= 1
                    if at >= 0:
                        last[at], end[at] = place, said
                        if tag == "td":
                            if scopes[-1][1] == len(opened):
                                scopes[-1][1] = 0
                        elif tag == "tr":
                            rows.pop()
                            if scopes[-1][2] == len(opened):
                                scopes[-1][2] = 0
                        elif tag == "table":
                            scopes.pop()
                elif count[tag]:
                    self.handle_endtag(tag)
            else:  # what _begin does for a cell where none is open
                names.append(tag)
                of["td"].append(place)
                owns.append(read[2])
                last.append(place + 1)
                start.append(said)
                end.append(said)
                for outer in reversed(rows):
                    cells = cells_of[outer]
                    if len(cells) == MOST_CELLS:
                        break
                    cells.append(place)
                scopes[-1][1] = len(opened)
                opened.append((tag, place))
                count[tag] += 1
                place += 1
            if text and (text := (unescape(text) if "&" in text else text).strip()):
                strings.append(text)
                said += 1
        return True

    def _row(self, texts: list[str]) -> None:
        """A row of cells with these texts, all closed."""
        _, cell, row = self._scopes[-1]
        if cell or row:  # these end before the row
            self._leave(min(filter(None, (cell, row))))
        place, said = len(self.tags), len(self.strings)
        cells = range(place + 1, place + 1 + len(texts))
        self.tags.extend(["tr", *["td"] * len(texts)])
        self.attrs.extend([{}] * (len(texts) + 1))
        self.of["tr"].append(place)
        self.of["td"].extend(cells)
        self.last.append(cells.stop)
        self.last.extend(range(place + 2, cells.stop + 1))
        self.start.append(said)
        self.end.append(said)
        for text in texts:
            self.start.append(said)
            if text and (text := (unescape(text) if "&" in text else text).strip()):
                self.strings.append(text)
                said += 1
            self.end.append(said)
        self.end[place] = said
        self.cells[place] = list(cells[:MOST_CELLS])
        # A cell goes to the outer rows too, from the innermost one that isn't full after those within it were.
        for n, cell in enumerate(cells):
            if n >= MOST_CELLS:
                break
            for outer in reversed(self._rows):
                if len(self.cells[outer]) == MOST_CELLS:
                    break
                self.cells[outer].append(cell)

    def _leave(self, depth: int) -> None:
        """Close the open elements from depth on."""
        for tag, place in self._open[depth:]:
            self._count[tag] -= 1
            if place >= 0:
                self.last[place], self.end[place] = len(self.tags), len(self.strings)
                if tag == "tr":
                    self._rows.pop()
        del self._open[depth:]
        while len(self._scopes) > 1 and self._scopes[-1][0] >= depth:
            self._scopes.pop()
        scope = self._scopes[-1]
        scope[1:] = (d if d < depth else 0 for d in scope[1:])

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._begin(tag, {k: v or "" for k, v in attrs})

    def _begin(self, tag: str, attrs: dict[str, str]) -> None:
        place = -1
        if tag in KEPT:
            if tag == "td" or tag == "tr":
                _, cell, row = self._scopes[-1]
                if tag == "tr" and row:
                    cell = min(cell, row) or row
                if cell:
                    self._leave(cell)
            place = len(self.tags)
            self.tags.append(tag)
            self.of[tag].append(place)
            self.attrs.append(attrs)
            self.last.append(place + 1)
            self.start.append(len(self.strings))
            self.end.append(len(self.strings))
            if tag == "td":
                for row in reversed(self._rows):
                    cells = self.cells[row]
                    if len(cells) == MOST_CELLS:
                        break
                    cells.append(place)
            elif tag == "a":
                href = attrs.get("href", "")
                for part, places in self.links.items():
                    if part in href:
                        places.append(place)
        if tag in VOID:
            return
        depth = len(self._open)
        self._open.append((tag, place))
        self._count[tag] += 1
        if tag == "table":
            self._scopes.append([depth, 0, 0])
        elif tag == "td":
            self._scopes[-1][1] = depth
        elif tag == "tr":
            self._scopes[-1][2] = depth
            self._rows.append(place)
            self.cells[place] = []

    def handle_endtag(self, tag: str) -> None:
        if self._count[tag]:
            depth = len(self._open) - 1
            while self._open[depth][0] != tag:
                depth -= 1
            self._leave(depth)

    def handle_data(self, data: str) -> None:
        if self._open[-1][0] not in HIDDEN and (text := data.strip()):
            self.strings.append(text)

    def inside(self, where: int | None, tag: str, **having: str) -> Iterator[int]:
        """Elements below where (None: of the page) with the tag and, for each attribute, the given text in it."""
        places = self.of[tag]
        low, high = (0, len(places)) if where is None else (bisect_right(places, where), bisect_left(places, self.last[where]))
        for e in places[low:high] if high - low < len(places) else places:
            if not having or all(v in self.attrs[e].get(k, "") for k, v in having.items()):
                yield e

    def first(self, where: int | None, tag: str, **having: str) -> int | None:
        return next(self.inside(where, tag, **having), None)

    def link(self, where: int, part: str) -> int | None:
        """The first link of a kind below where."""
        places = self.links[part]
        at = bisect_right(places, where)
        return places[at] if at < len(places) and places[at] < self.last[where] else None

    def text(self, where: int | None, between: str = "") -> str | None:
        if where is None:
            return None
        self._left -= self.upto[self.end[where]] - self.upto[self.start[where]]
        if self._left < 0:
            raise ValueError(f"nested cells repeat the text of the page more than {TIMES_OF_TEXT} times")
        return between.join(self.strings[self.start[where] : self.end[where]])

    def words(self, where: int) -> str:
        return " ".join(self.text(where, " ").split())

    def begins(self, where: int, word: str) -> bool:
        """Whether word is the first one of the text of an element."""
        return self.start[where] < self.end[where] and self.strings[self.start[where]].split(maxsplit=1)[0] == word


def list_rows(page: Page) -> Iterator[tuple[str, str, str, str | None]]:
    """Series, number text, title and address of each row of a list page."""
    for cells in page.cells.values():
        series = page.link(cells[0], SERIES_LINK) if len(cells) >= 3 else None
        if series is None:
            continue
        link = page.link(cells[2], DETAIL_LINK)
        title = page.text(cells[2] if link is None else link)
        if title and title not in HEADERS:
            yield page.text(series), page.text(cells[1]).strip(), title, None if link is None else page.attrs[link]["href"]


def description(page: Page, cell: int) -> str | None:
    """The first text that follows the heading of the description."""
    named = [i for i in range(page.start[cell], page.end[cell]) if DESCRIPTION in page.strings[i]]
    for heading in page.inside(cell, "span"):
        at = bisect_left(named, page.start[heading])
        if at < len(named) and named[at] < page.end[heading] and "t4_bold" in page.attrs[heading].get("class", "").split():
            spans = page.of["span"]
            for body in range(bisect_right(spans, heading), len(spans)):
                if "t5" in page.attrs[spans[body]].get("class", "").split():
                    return page.words(spans[body]) or None
            return None
    return None


def credits(page: Page, cell: int) -> Iterator[dict[str, str]]:
    for row in page.inside(cell, "tr"):
        cells = page.cells[row]
        if len(cells) == 4:
            role, speaker = page.text(cells[1], " "), page.text(cells[3], " ")
            if role and speaker and role != CREDIT_HEADERS[0] and speaker != CREDIT_HEADERS[1]:
                yield {"role": role, "speaker": speaker}


def detail(page: Page) -> dict:
    cells: dict[str, int] = {}
    table = page.first(None, "table", background=DETAIL_BACKGROUND)
    for td in page.inside(table, "td") if table is not None else ():
        if (own := page.attrs[td]) and (name := CELLS.get((own.get("width"), own.get("align"), own.get("valign")))):
            cells[name] = td
    out: dict = {}
    if (path := cells.get("path")) is not None:
        links = list(page.inside(path, "a", href=DETAIL_LINK))
        out |= {"series_name": page.text(page.link(path, SERIES_LINK)), "label": page.text(page.link(path, LABEL_LINK))}
        out |= {"links": [page.attrs[a]["href"] for a in links], "path_text": page.words(path).lower()}
        if len(links) >= 2:
            out |= {"number_text": page.text(links[0]), "title": page.text(links[1])}
    if (text := cells.get("text")) is not None:
        out |= {"text": page.text(text, " "), "description": description(page, text)}
    if (credit := cells.get("credits")) is not None:
        out["speakers"] = list(credits(page, credit))
    cover = page.first(None, "img", src=COVER_PART)
    named = (page.words(td) for td in page.inside(None, "td") if page.begins(td, "-"))
    return out | {"cover_url": None if cover is None else page.attrs[cover]["src"], "genres": [g for n in named if n.startswith("- ") and (g := n[2:].strip())]}


@functools.lru_cache(16)
def folder_of(base_url: str) -> str:
    """What urljoin puts before a name."""
    return urljoin(base_url, "x")[:-1]


def address(base_url: str, href: str | None) -> tuple[str | None, str | None]:
    """The absolute address, or null and why there is none."""
    try:
        if href is not None and PLAIN_ADDRESS.fullmatch(href):
            return folder_of(base_url) + href, None
        return (None, None) if href is None else (urljoin(base_url, href), None)
    except ValueError as e:
        return None, f"address {href}: {e}"


def taken(html: str | None, read: Callable[[Page], object]) -> tuple[object, str | None]:
    """What read makes of a page, or nothing and the error."""
    try:
        return read(Page(html or "")), None
    except (ValueError, AssertionError) as e:
        return None, f"{type(e).__name__}: {e}"


def number(text: str):
    return F.when(F.col(text).rlike("^[0-9]+$"), F.col(text).try_cast("bigint"))


def _listed(pages: DataFrame, base_url: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, html in zip(batch["page"].to_pylist(), batch["html"].to_pylist(), strict=True):
                found, error = taken(html, lambda p: list(list_rows(p)))
                if error:
                    rows.append((page, -1, error, None, None, None, None))
                for pos, (*names, href) in enumerate(found or ()):
                    url, error = address(base_url, href)
                    rows.append((page, pos, error, *names, url))
            columns = list(zip(*rows, strict=True)) or [()] * len(LIST_ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, LIST_ROWS, strict=True)], schema=LIST_ROWS)

    return pages.select("page", "html").mapInArrow(run, LIST_DDL)


def parse_list_pages(pages: DataFrame, base_url: str) -> DataFrame:
    """pages(page, html) to one row for each new title of a page: page, pos, series_name, episode_number, title, url,
    has_detail_page, parse_error (why a link has no address)."""
    rows = first_in_page(_listed(pages, base_url).where("title is not null"), "page", "title", "pos")
    return rows.select(
        "page", "pos", series_name(F.col("series_name")).alias("series_name"), number("number_text").alias("episode_number"), "title", "url",
        F.col("url").isNotNull().alias("has_detail_page"), "parse_error",
    )


def unread_list_pages(pages: DataFrame, base_url: str) -> DataFrame:
    """page, parse_error of the list pages that can't be read."""
    return _listed(pages, base_url).where("pos < 0").select("page", "parse_error")


def parse_detail_pages(pages: DataFrame, base_url: str) -> DataFrame:
    """pages(page, html) to nested records with a parse_error; the page's texts are taken apart by expressions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, html in zip(batch["page"].to_pylist(), batch["html"].to_pylist(), strict=True):
                found, error = taken(html, detail)
                row = {"speakers": [], "genres": [], "links": []} | (found or {})
                addresses = [address(base_url, x) for x in row["links"]]
                cover, cover_error = address(base_url, row.get("cover_url"))
                error = error or next(filter(None, [*(e for _, e in addresses), cover_error]), None)
                rows.append(row | {"page": page, "links": [url for url, _ in addresses], "cover_url": cover, "parse_error": error})
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in DETAIL], schema=DETAIL)

    text = F.col("text")
    found = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    minutes = found(r"Dauer:\s*([\d\.,]+)\s*Minuten")
    duration = F.replace(minutes, F.lit(","), F.lit(".")).try_cast("double")
    error = F.coalesce("parse_error", F.when(minutes.isNotNull() & duration.isNull(), F.concat(F.lit("bad duration "), minutes)))
    many = F.size("links") >= 3
    return pages.select("page", "html").mapInArrow(run, DETAIL_DDL).select(
        "page", error.alias("parse_error"), "title", "series_name", number("number_text").alias("episode_number"), "description", duration.alias("duration_minutes"),
        found(r"(\d{2}\.\d{2}\.\d{4})").alias("release_date"), "label", "cover_url", "speakers", found(r"Bestellnummer:\s*(?:CD:\s*)?([^\s]+)").alias("order_number"), "genres",
        F.when(many & ~F.contains("path_text", F.lit(NO_PREVIOUS)), F.get("links", F.lit(2))).alias("previous_episode_url"), F.when(many, F.get("links", F.size("links") - 1)).alias("next_episode_url"),
        F.get("links", F.lit(0)).alias("source_url"),
    )


def records_of_folder(pages: DataFrame, base_url: str, when_read: Callable[[], None] = lambda: None) -> DataFrame:
    """The records of pages(page, html), each with source_file, the name of its page, and place, its number in the order of
    names from 1 on. The records are written before they are sorted by range: finding the ranges reads the rows once more, and
    the pages would be read twice. when_read is called when no page is needed any more."""
    records = parse_detail_pages(pages, base_url).withColumnRenamed("page", "source_file")
    parsed, folder = written_at(records, "parsed", "zstd")
    when_read()
    found = numbered(parsed, "source_file")
    store.delete(pages.sparkSession, folder)
    return found


def detail_targets(rows: DataFrame) -> DataFrame:
    """The pending detail page of each code; a later series page wins."""
    codes = rows.where("url is not null").withColumn("episode_code", episode_code(F.col("url"))).where("episode_code is not null")
    return codes.groupBy("episode_code").agg(F.max_by("page", F.struct("page", "pos")).alias("page")).withColumn("status", F.lit("pending"))


def match_details(rows: DataFrame, details: DataFrame) -> DataFrame:
    """List rows with their detail record by file name, and the outcome. What is joined are records, not pages."""
    usable = details.withColumn("ok", F.col("parse_error").isNull() & F.col("title").isNotNull() & F.col("series_name").isNotNull())
    columns = ["description", "duration_minutes", "release_date", "label", "cover_url", "speakers", "order_number", "genres", "previous_episode_url", "next_episode_url", "source_url"]
    d = usable.select(F.col("page").alias("file_name"), "ok", F.col("parse_error").alias("d_parse_error"), *[F.col(c).alias(f"d_{c}") for c in ["title", "series_name", "episode_number", *columns]])
    joined = rows.withColumn("file_name", page_file_name(F.col("url"))).join(d, "file_name", "left")
    outcome = F.when(F.col("url").isNull(), "stub_without_link").when(F.col("ok").isNull(), "stub_missing_html").when(~F.col("ok"), "stub_parse_error").otherwise("with_detail")
    good = outcome == "with_detail"
    own = [F.when(good, F.col(f"d_{c}")).otherwise(F.col(c)).alias(c) for c in ("title", "series_name", "episode_number")]
    kinds = {"speakers": F.array().cast("array<struct<role:string,speaker:string>>"), "genres": F.array().cast("array<string>")}
    rest = [F.col("url").alias(c) if c == "source_url" else F.when(good, F.col(f"d_{c}")).otherwise(kinds.get(c, F.lit(None))).alias(c) for c in columns]
    return joined.select("page", "pos", outcome.alias("outcome"), F.coalesce("d_parse_error", "parse_error").alias("parse_error"), *own, *rest)


def cleaned(records: DataFrame) -> DataFrame:
    """Records with cleaned texts, credits and genres; numbers stay as they are."""
    texts = ("title", "series_name", "description", "release_date", "label", "cover_url", "previous_episode_url", "next_episode_url", "source_url")
    special: dict[str, Callable[[Column], Column]] = {"order_number": clean_order_number, "speakers": clean_credits, "genres": clean_genres}
    kinds = special | dict.fromkeys(texts, clean_text)
    return records.select(*[kinds[c](F.col(c)).alias(c) if c in kinds else F.col(c) for c in records.columns])


def build_records(list_pages: DataFrame, detail_pages: DataFrame, base_url: str, when_read: Callable[[], None] = lambda: None) -> tuple[DataFrame, DataFrame]:
    """From pages(page, html) to the records to be published and, before duplicates go, every list row with its outcome.
    Details are parsed before they are matched, so that records are moved and not pages; of records with one key the first
    in the order of pages and rows stays; spellings of speakers and roles are unified over all that stay. Each step is written,
    and what it was made of deleted, so that disk follows from the largest step and not from their sum; when_read is called
    when no page is needed any more."""
    spark = list_pages.sparkSession
    rows, rows_at = written_at(parse_list_pages(list_pages, base_url), "rows", "zstd")
    details, details_at = written_at(cleaned(parse_detail_pages(detail_pages, base_url)), "details", "zstd")
    when_read()
    matched = written(match_details(rows, details), "matched", "zstd")
    for folder in (rows_at, details_at):
        store.delete(spark, folder)
    keyed = matched.withColumn("source_key", source_key(F.col("source_url"), F.col("series_name"), F.col("episode_number"), F.col("title")))
    kept = written(keep_first(keyed, ["source_key"], ["page", "pos"]), "kept", "zstd")
    records = canonical_credits(kept, "source_key", ["page", "pos"])
    return records, matched


def outcome_stats(matched: DataFrame) -> DataFrame:
    return matched.groupBy("outcome").agg(F.count("*").alias("n"), F.count("parse_error").alias("errors"))


def broken_pages(pages: DataFrame) -> DataFrame:
    """kind, code of the pages with U+FFFD: a series id as file stem, or a code in the name; other names are left out."""
    bad = pages.where(F.contains("html", F.lit("�")))
    stem = F.regexp_extract("page", r"^(\d+)\.html$", 1).try_cast("bigint")
    rows = bad.select(F.when(stem.isNotNull(), F.struct(F.lit("series").alias("kind"), stem.alias("code"))).when(page_code(F.col("page")).isNotNull(), F.struct(F.lit("episode").alias("kind"), page_code(F.col("page")).alias("code"))).alias("x"))
    return rows.where("x is not null").select("x.kind", "x.code").distinct()


def page_series(pages: DataFrame) -> DataFrame:
    return pages.select("page", series_code(F.col("html")).alias("series_id"))
