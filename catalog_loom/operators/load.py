"""Dimensions, facts and links from nested records; the work ledger; checks of a load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog_loom.functions.text import release_date
from catalog_loom.operators.order import numbered


def series_dimension(records: DataFrame, order: list[str], prefer_known: bool = True) -> DataFrame:
    """name, label: the first known label of each series in record order, or that of its first record."""
    place = F.struct(F.col("label").isNull(), *order) if prefer_known else F.struct(*order)
    return records.where("series_name is not null").groupBy(F.col("series_name").alias("name")).agg(F.min_by("label", place).alias("label"))


def names_of(values: DataFrame, column: str) -> DataFrame:
    return values.where(F.col(column).isNotNull()).select(F.col(column).alias("name")).distinct()


def with_ids(names: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Ids from 1 in the order of names; names of known(id, name) keep theirs and new ones follow the largest."""
    last = 0
    new = names.select("name")
    if known is not None:
        last = known.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        new = new.join(known, "name", "left_anti")
    found = numbered(new, "name", name="id", start=last + 1).select("id", "name")
    return found if known is None else known.select("id", "name").unionByName(found)


def dimensions(rows: DataFrame, columns: list[str]) -> dict[str, DataFrame]:
    """id, name of the values of each column, ids from 1 in the order of names: all are found in one scan and numbered in one
    sort."""
    pairs = F.array(*[F.struct(F.lit(i).alias("kind"), F.col(c).cast("string").alias("name")) for i, c in enumerate(columns)])
    found = numbered(rows.select(F.explode(pairs).alias("p")).select("p.*").where("name is not null").distinct(), "kind", "name")
    starts = {r["kind"]: r["start"] for r in found.groupBy("kind").agg(F.min("place").alias("start")).collect()}  # a row for each column
    return {c: found.where(F.col("kind") == i).select((F.col("place") - starts.get(i, 0) + 1).alias("id"), "name") for i, c in enumerate(columns)}


def episode_rows(records: DataFrame, series: DataFrame) -> DataFrame:
    """Records with the id of their series and a parsed date."""
    ids = series.select(F.col("id").alias("series_id"), F.col("name").alias("series_name"))
    return records.join(ids, "series_name", "left").withColumn("release_date", release_date(F.col("release_date")))


def without_series(episodes: DataFrame) -> DataFrame:
    return episodes.where("series_id is null")


def link_rows(pairs: DataFrame, episodes: DataFrame, dimensions: dict[str, DataFrame]) -> DataFrame:
    """episode_id and the id of each named column; pairs hold source_key and names."""
    rows = pairs.join(episodes.select(F.col("id").alias("episode_id"), "source_key"), "source_key")
    for column, names in dimensions.items():
        rows = rows.join(names.select(F.col("id").alias(f"{column}_id"), F.col("name").alias(column)), column)
    return rows.select("episode_id", *[f"{c}_id" for c in dimensions]).distinct()


def manifest(counts: dict[str, DataFrame]) -> DataFrame:
    """table_name, row_count of each table, counted in one job."""
    rows = None
    for name, df in counts.items():
        one = df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def mismatches(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Tables whose counts differ or that only one side has."""
    a = expected.select("table_name", F.col("row_count").alias("expected"))
    b = actual.select("table_name", F.col("row_count").alias("actual"))
    return a.join(b, "table_name", "full").where(~F.col("expected").eqNullSafe(F.col("actual")))


def assert_empty(tables: dict[str, DataFrame]) -> None:
    found = [name for name, df in tables.items() if not df.isEmpty()]
    if found:
        raise ValueError(f"destination is not empty: {', '.join(found)}")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """incoming, and what existing has besides its keys. Of incoming rows that repeat a key one stays, the greatest."""
    rest = [c for c in incoming.columns if c not in keys]
    if not rest:
        return incoming.unionByName(existing.select(incoming.columns)).distinct()
    incoming = incoming.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("row")).select(*keys, "row.*").select(incoming.columns)
    return incoming.unionByName(existing.join(incoming.select(*keys), keys, "left_anti").select(incoming.columns))


def seed_targets(spark: SparkSession, n: int, source: str) -> DataFrame:
    return spark.range(1, n + 1).select(F.lit(source).alias("source"), F.col("id").alias("external_id"), F.lit("pending").alias("status"), F.lit(0).cast("bigint").alias("attempts"))


def insert_missing(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """existing rows win: seeding twice changes nothing."""
    return existing.unionByName(incoming.join(existing.select(*keys), keys, "left_anti").select(existing.columns))


def pending(targets: DataFrame, limit: int | None = None) -> DataFrame:
    rows = targets.where(F.col("status").isin("pending", "error"))
    return rows if limit is None else rows.orderBy("external_id").limit(limit)


def apply_outcomes(targets: DataFrame, outcomes: DataFrame, order: str) -> DataFrame:
    """The ledger after the last outcome of each target: an error message makes the status error; attempts grow by one."""
    last = outcomes.groupBy("external_id").agg(F.max_by(F.struct("status", "error_message"), F.col(order)).alias("o"))
    rows = targets.join(last, "external_id", "left")
    status = F.when(F.col("o").isNull(), F.col("status")).when(F.col("o.error_message").isNotNull(), "error").otherwise(F.col("o.status"))
    return rows.select("external_id", status.alias("status"), (F.col("attempts") + F.when(F.col("o").isNull(), 0).otherwise(1)).alias("attempts"), F.col("o.error_message").alias("error_message"))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("status").agg(F.count("*").alias("n"))
