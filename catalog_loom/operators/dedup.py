"""Keeping first records and unifying spellings over the whole set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog_loom.functions.text import comparison_key, umlauts
from catalog_loom.sources.files import written


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order, as an aggregate: a key with very many rows is reduced before the
    shuffle. Null keys are equal to each other."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return first.select(*[F.col(c) if c in keys else F.col(f"row.{c}").alias(c) for c in rows.columns])


def keep_first_where_known(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """As keep_first, but all rows with a null key stay; they don't meet in one group."""
    return keep_first(rows.where(F.col(key).isNotNull()), [key], order).unionByName(rows.where(F.col(key).isNull()))


def keep_first_stubs(rows: DataFrame, url: str, keys: list[str], order: list[str]) -> DataFrame:
    """Only rows without an address are reduced to one for each key."""
    return rows.where(F.col(url).isNotNull()).unionByName(keep_first(rows.where(F.col(url).isNull()), keys, order))


def spellings(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Each exact spelling with its count, first place and comparison key."""
    found = rows.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("spelling"))
    counted = found.agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first_seen"))
    return counted.withColumn("key", comparison_key(F.col("spelling")))


def most_used(rows: DataFrame) -> DataFrame:
    """key and the most frequent spelling, of equal ones the first seen."""
    return rows.groupBy("key").agg(F.min_by("spelling", F.struct(-F.col("n"), "first_seen")).alias("canonical"))


def speaker_spellings(rows: DataFrame, name: str, order: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """spelling, canonical: spellings with two letters for an umlaut become the most frequent spelling with umlauts, if
    there is one that is not in keep."""
    found = spellings(rows, name, order)
    plain = umlauts(F.col("spelling")) != F.col("spelling")
    best = most_used(found.where(~plain)).where(~F.col("canonical").isin(*keep) if keep else F.lit(True))
    return found.where(plain).join(best, "key").select("spelling", "canonical")


def role_spellings(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """spelling, canonical: all spellings of a key become the most frequent one."""
    found = spellings(rows, name, order)
    return found.join(most_used(found), "key").where("spelling <> canonical").select("spelling", "canonical")


def apply_spellings(rows: DataFrame, name: str, spelling_map: DataFrame) -> DataFrame:
    joined = rows.join(spelling_map.select(F.col("spelling").alias(name), "canonical"), name, "left")
    return joined.withColumn(name, F.coalesce("canonical", name)).select(rows.columns)


def canonical_credits(records: DataFrame, key: str, order: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """records with the roles and speakers of their credits (array of structs) in one spelling each. The spellings and the new
    credits are written first, so that their shuffles don't lie beside that of the records."""
    nth = "credit_place"
    exploded = records.select(key, *order, F.posexplode("speakers").alias(nth, "credit")).select(key, *order, nth, "credit.role", "credit.speaker")
    place = [*order, nth]
    done = apply_spellings(exploded, "speaker", written(speaker_spellings(exploded, "speaker", place, keep), "speaker_spellings"))
    done = apply_spellings(done, "role", written(role_spellings(exploded, "role", place), "role_spellings"))
    again = done.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(nth, "role", "speaker"))).alias("credits"))
    again = again.withColumn("credits", F.transform("credits", lambda c: F.struct(c["role"].alias("role"), c["speaker"].alias("speaker"))))
    empty = F.array().cast("array<struct<role:string,speaker:string>>")
    return records.join(written(again, "credits", "zstd"), key, "left").withColumn("speakers", F.coalesce("credits", empty)).select(records.columns)


def distinct_links(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys).distinct()


def first_in_page(rows: DataFrame, page: str, title: str, pos: str) -> DataFrame:
    """List rows whose title has not been on the page before."""
    return keep_first(rows, [page, title], [pos])
