"""Catalog queries for browsing: series, speakers, episodes, facets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL = ["production_line_order", "category_order", "production_line_key", "production_line_label", "category_key", "category_label", "episode_count"]


def series_with_counts(series: DataFrame, episodes: DataFrame) -> DataFrame:
    counts = episodes.groupBy(F.col("series_id").alias("id")).agg(F.count("id").alias("episode_count"))
    return series.select("id", "name", "label").join(counts, "id", "left").withColumn("episode_count", F.coalesce("episode_count", F.lit(0)))


def episodes_by_speaker(links: DataFrame, episodes: DataFrame, series: DataFrame, roles: DataFrame, speaker_id: int) -> DataFrame:
    e = episodes.select(F.col("id").alias("episode_id"), "title", "series_id", "episode_number", "release_date", "duration_minutes", "cover_url")
    rows = links.where(F.col("speaker_id") == speaker_id).join(e, "episode_id")
    rows = rows.join(series.select(F.col("id").alias("series_id"), F.col("name").alias("series_name")), "series_id").join(roles.select(F.col("id").alias("role_id"), F.col("name").alias("role_name")), "role_id")
    return rows.select("episode_id", "title", "series_name", "series_id", "episode_number", "release_date", "duration_minutes", "cover_url", "role_name").orderBy("series_name", F.asc_nulls_last("episode_number"), "episode_id", "role_name")


def speaker_page(rows: DataFrame) -> DataFrame:
    """The rows of a speaker grouped by series, each with its episodes in order."""
    item = F.struct(F.col("episode_number").isNull().alias("unknown"), "episode_number", "episode_id", "role_name", "title")
    return rows.groupBy("series_id", "series_name").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(item)).alias("items"))


def episodes_per_year(episodes: DataFrame) -> DataFrame:
    return episodes.where("release_date is not null").groupBy(F.year("release_date").alias("year")).agg(F.count("*").alias("episode_count"))


def top_genres(links: DataFrame, genres: DataFrame, limit: int = 10) -> DataFrame:
    counts = links.groupBy("genre_id").agg(F.count("*").alias("n"))
    named = counts.join(genres.select(F.col("id").alias("genre_id"), F.col("name").alias("genre_name")), "genre_id")
    return named.groupBy("genre_name").agg(F.sum("n").alias("episode_count")).orderBy(F.desc("episode_count"), "genre_name").limit(limit)


def top_series_labels(series: DataFrame, limit: int = 10) -> DataFrame:
    rows = series.where("label is not null and label <> '?'").groupBy(F.col("label").alias("label_name")).agg(F.count("*").alias("series_count"))
    return rows.orderBy(F.desc("series_count"), "label_name").limit(limit)


def series_overview(counts: DataFrame) -> DataFrame:
    """Each series with its total and an ordered array of its cells (at most lines times categories)."""
    return counts.groupBy(F.col("series_id").alias("id")).agg(
        F.max("series_name").alias("name"), F.max("label_name").alias("label"), F.sum("episode_count").alias("episode_count"), F.array_sort(F.collect_list(F.struct(*CELL))).alias("category_counts"))


def series_facets(counts: DataFrame, series_id: int) -> DataFrame:
    return counts.where(F.col("series_id") == series_id).select(CELL).orderBy("production_line_order", "category_order")


def series_categories(counts: DataFrame, series_id: int) -> DataFrame:
    rows = counts.where(F.col("series_id") == series_id).groupBy("category_key", "category_label", "category_order")
    return rows.agg(F.sum("episode_count").alias("episode_count")).orderBy("category_order")


def series_episodes(catalog: DataFrame, series_id: int, category: str | None = None, line: str | None = None, by_line: bool = False) -> DataFrame:
    rows = catalog.where(F.col("series_id") == series_id)
    if category is not None:
        rows = rows.where(F.col("category_key") == category)
    if line is not None:
        rows = rows.where(F.col("production_line_key") == line)
    order = ["production_line_order"] * by_line + ["category_order", F.asc_nulls_last("episode_number"), F.asc_nulls_last("release_date"), "episode_id"]
    return rows.orderBy(*order).select(
        F.col("episode_id").alias("id"), F.col("episode_title").alias("title"), "episode_number", "description", "release_date", "duration_minutes", "cover_url", "category_key", "category_label", "variant_category", "edition_markers")


def facet_totals(counts: DataFrame, series_id: int) -> DataFrame:
    """Totals by line, by category and in all, as grouping sets of one aggregate."""
    sets = [["production_line_key"], ["category_key"], []]
    mine = counts.where(F.col("series_id") == series_id).groupingSets(sets, "production_line_key", "category_key")
    return mine.agg(F.sum("episode_count").alias("episode_count"))


def default_facets(counts: DataFrame) -> DataFrame:
    """Of each series the first line by order, and the category shown first: regular if it has any, else all."""
    return counts.groupBy("series_id").agg(
        F.min_by("production_line_key", F.struct("production_line_order", "production_line_key")).alias("production_line_key"),
        F.when(F.bool_or(F.col("category_key") == "regular"), "regular").otherwise("all").alias("category_key"))


def search_series(overview: DataFrame, text: str) -> DataFrame:
    return overview.where(F.contains(F.lower("name"), F.lit(text.lower())))


def episode_documents(facts: DataFrame, credits: DataFrame, genres: DataFrame) -> DataFrame:
    """Every episode with its credits and genres as ordered arrays."""
    c = credits.groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct("speaker_name", "role_name"))).alias("credits"))
    g = genres.groupBy("episode_id").agg(F.array_sort(F.collect_list("genre_name")).alias("genres"))
    rows = facts.select("episode_id", "episode_title", "series_name", "label_name").join(c, "episode_id", "left").join(g, "episode_id", "left")
    none = F.array().cast("array<struct<speaker_name:string,role_name:string>>")
    return rows.withColumn("credits", F.coalesce("credits", none)).withColumn("genres", F.coalesce("genres", F.array().cast("array<string>")))
