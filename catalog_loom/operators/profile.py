"""Exploratory profiles, each from one pass where that is possible."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog_loom.functions.text import folded_name, release_date
from catalog_loom.operators.order import order_statistics


def flatten(records: DataFrame) -> DataFrame:
    """Scalars and the lengths of the arrays."""
    scalars = [c for c, t in records.dtypes if not t.startswith("array")]
    n = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0))
    return records.select(*scalars, F.when(F.col("speakers").isNull(), 0).otherwise(n("speakers")).alias("n_speakers"), F.when(F.col("genres").isNull(), 0).otherwise(n("genres")).alias("n_genres"))


def missing(rows: DataFrame) -> DataFrame:
    """column_name, missing, percent (one decimal) of each column, from one aggregate."""
    counts = rows.agg(F.count("*").alias("__rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in rows.columns])
    long = counts.unpivot(["__rows"], rows.columns, "column_name", "missing")
    return long.select("column_name", "missing", F.round(100 * F.col("missing") / F.col("__rows"), 1).alias("percent"))


def value_counts(rows: DataFrame, column: str, most: int | None = None) -> DataFrame:
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts if most is None else counts.orderBy(F.desc("n"), "value").limit(most)


def singletons(rows: DataFrame, column: str) -> DataFrame:
    return value_counts(rows, column).agg(F.count("*").alias("values"), F.count_if(F.col("n") == 1).alias("singletons"))


def date_quality(rows: DataFrame, column: str) -> DataFrame:
    date = release_date(F.col(column))
    given = F.col(column).isNotNull()
    return rows.agg(F.count_if(~given).alias("missing"), F.count_if(given & date.isNull()).alias("failed"), F.count_if(date.isNotNull()).alias("parsed"))


def duration_summary(rows: DataFrame, column: str = "duration_minutes") -> DataFrame:
    """Moments and exact quartiles; these are looked up first, by ranges of values."""
    c = F.col(column)
    found = order_statistics(rows, column, (0.25, 0.5, 0.75))
    quartiles = [F.lit(q).cast("double").alias(n) for q, n in zip(found, ("q1", "median", "q3"), strict=True)]
    return rows.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("least"), *quartiles, F.max(c).alias("most"))


def duration_outliers(rows: DataFrame, low: float = 5, high: float = 180) -> DataFrame:
    return rows.where((F.col("duration_minutes") < low) | (F.col("duration_minutes") > high))


def spelling_variants(rows: DataFrame, column: str) -> DataFrame:
    """key, spelling, n of names that are written in several ways."""
    counts = value_counts(rows, column).withColumn("key", folded_name(F.col("value")))
    several = counts.groupBy("key").agg(F.count("*").alias("variants")).where("variants > 1")
    return counts.join(several.select("key"), "key").select("key", F.col("value").alias("spelling"), "n")


def whitespace_problems(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.col(column).rlike(r"^\s|\s$|\s{2,}"))


def quality_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("records"), *[F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in ("release_date", "description", "duration_minutes", "episode_number")],
                    F.count_if(F.col("n_speakers") == 0).alias("no_speakers"), F.count_if(F.col("n_genres") == 0).alias("no_genres"))
