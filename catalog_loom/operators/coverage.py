"""How much of each series an external catalog has, and covers taken from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalog_loom.functions.unicode import search_text

EPISODE_NUMBER = r"(?i)\b(?:folge|episode)\s*(\d{1,3})\b"
RESULT_LIMIT = 200


def candidates(results: DataFrame, probes: DataFrame) -> DataFrame:
    """Results whose artist is an alias of the probe or whose title holds the series' name, all normalized.
    results(probe_key, pos, collection_id, artist_name, collection_name, release_date); probes(probe_key, series_name, aliases)."""
    p = probes.select("probe_key", search_text(F.col("series_name")).alias("wanted"), F.transform("aliases", lambda a: F.lower(a)).alias("raw_aliases"), "aliases")
    names = probes.select("probe_key", F.explode("aliases").alias("alias")).select("probe_key", search_text(F.col("alias")).alias("alias")).groupBy("probe_key").agg(F.collect_set("alias").alias("known"))
    p = p.join(names, "probe_key", "left").select("probe_key", "wanted", F.coalesce("known", F.array().cast("array<string>")).alias("known"))
    rows = results.withColumn("artist", search_text(F.col("artist_name"))).withColumn("title", search_text(F.col("collection_name"))).join(p, "probe_key")
    return rows.where(F.array_contains("known", F.col("artist")) | ((F.col("wanted") != "") & F.contains("title", "wanted"))).drop("wanted", "known", "artist")


def last_of_each(rows: DataFrame) -> DataFrame:
    """The last row of each collection; rows without an id go."""
    known = rows.where("collection_id is not null and collection_id <> ''")
    rest = [c for c in known.columns if c not in ("probe_key", "collection_id")]
    return known.groupBy("probe_key", "collection_id").agg(F.max_by(F.struct(*rest), "pos").alias("r")).select("probe_key", "collection_id", "r.*")


def probe_report(results: DataFrame, found: DataFrame) -> DataFrame:
    number = F.regexp_extract("collection_name", EPISODE_NUMBER, 1)
    year = F.when(F.substring("release_date", 1, 4).rlike("^[0-9]{4}$"), F.substring("release_date", 1, 4).cast("int"))
    rows = found.withColumn("number", F.when(number != "", number.cast("int"))).withColumn("year", year)
    counts = rows.groupBy("probe_key").agg(F.count("*").alias("candidates"), F.count("number").alias("numbered"), F.countDistinct("number").alias("distinct_numbers"), F.min("year").alias("earliest_year"), F.max("year").alias("latest_year"))
    same = rows.groupBy("probe_key", "title").agg(F.count("*").alias("n")).where("n > 1").groupBy("probe_key").agg(F.count("*").alias("duplicate_titles"))
    returned = results.groupBy("probe_key").agg(F.count("*").alias("returned"))
    out = returned.join(counts, "probe_key", "left").join(same, "probe_key", "left").na.fill(0, ["candidates", "numbered", "distinct_numbers", "duplicate_titles"])
    return out.withColumn("limit_reached", F.col("returned") >= RESULT_LIMIT)


def examples(found: DataFrame, most: int = 5) -> DataFrame:
    """The first candidates of each probe by id as text."""
    rank = F.row_number().over(Window.partitionBy("probe_key").orderBy(F.col("collection_id").cast("string")))
    return found.withColumn("nth", rank).where(F.col("nth") <= most).select("probe_key", "nth", "collection_id", "collection_name")


def summary(report: DataFrame) -> DataFrame:
    return report.agg(*[F.sum(c).alias(c) for c in ("returned", "candidates", "numbered", "distinct_numbers", "duplicate_titles")], F.count("*").alias("probes"), F.count_if("limit_reached").alias("probes_at_limit"))


def content_hash(report: DataFrame) -> DataFrame:
    """One SHA-256 of all rows, whatever their order. A row is its columns by name, divided by |, null as nothing. Row
    hashes are joined in their order within the 4,096 groups of their first three digits, and so are the groups' hashes."""
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(report.columns)])
    joined = F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h")
    groups = report.select(F.sha2(row, 256).alias("h")).groupBy(F.substring("h", 1, 3)).agg(joined).select("h")
    return groups.agg(joined.alias("content_hash"))


def fill_covers(records: DataFrame, found: DataFrame, least: int = 80) -> DataFrame:
    """records(id, title, series_name, cover_url) with an outcome; those without a cover take that of the best candidate
    (episode_id, pos, release_id, score, cover_url) of at least the given score, of equal ones the first."""
    best = found.where(F.col("score") >= least).groupBy(F.col("episode_id").alias("id")).agg(F.min_by("cover_url", F.struct(-F.col("score"), "pos", "release_id")).alias("new_cover"))
    rows = records.join(best, "id", "left")
    skip = F.col("cover_url").isNotNull() | F.col("title").isNull() | F.col("series_name").isNull()
    outcome = F.when(skip, "skipped").when(F.col("new_cover").isNotNull(), "found").otherwise("not_found")
    return rows.select("id", F.when(skip, F.col("cover_url")).otherwise(F.col("new_cover")).alias("cover_url"), outcome.alias("outcome"))


def cover_stats(filled: DataFrame) -> DataFrame:
    n = lambda o: F.count_if(F.col("outcome") == o)
    return filled.agg(F.count_if(F.col("outcome") != "skipped").alias("checked"), n("found").alias("found"), n("not_found").alias("not_found"), n("skipped").alias("skipped"))
