"""What Spark has no expression for: Unicode normal forms and case folding, column by column."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def identity_part(x: pd.Series) -> pd.Series:
    """NFKC, one space for white space, case folded; null is empty."""
    return x.fillna("").map(lambda v: " ".join(unicodedata.normalize("NFKC", v).split()).casefold())


@F.pandas_udf(StringType())
def ascii_base(x: pd.Series) -> pd.Series:
    """NFKD without what isn't ASCII; null stays null."""
    return x.map(lambda v: unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode(), na_action="ignore")


def search_text(x: Column) -> Column:
    """ASCII letters and digits in lower case, words divided by one space; null is empty."""
    return F.trim(F.regexp_replace(F.lower(ascii_base(F.coalesce(x, F.lit("")))), "[^a-z0-9]+", " "))


def source_key(url: Column, series: Column, number: Column, title: Column, prefix: str = "cat") -> Column:
    """By the code in the address, else by its SHA-256; without an address by that of series, number and title."""
    code = F.regexp_extract(url, r"[?&]code=(\d+)", 1)
    parts = F.concat_ws("\u001f", identity_part(series), identity_part(number.cast("string")), identity_part(title))
    return (
        F.when(code != "", F.concat(F.lit(f"{prefix}:episode:"), code))
        .when(F.coalesce(url, F.lit("")) != "", F.concat(F.lit(f"{prefix}:episode-url:"), F.sha2(url, 256)))
        .otherwise(F.concat(F.lit(f"{prefix}:stub:"), F.sha2(parts, 256)))
    )
