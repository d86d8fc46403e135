"""Staging, episode facts and the aggregates over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_loom.functions.text import blank_to_null, series_key, staged_label, text_key

# Upper ends of the duration buckets in minutes, and their labels.
DURATION_ENDS = (15, 30, 45, 60, 90)
DURATION_LABELS = ("<15", "15–29", "30–44", "45–59", "60–89", "90+")
PART_ROWS = 250_000  # of what is dealt out to tasks that keep all their rows


def stage_series(series: DataFrame) -> DataFrame:
    """The join key collapses white space, as its documentation says."""
    return series.select(
        F.col("id").cast("bigint").alias("series_id"), blank_to_null(F.col("name")).alias("series_name"),
        staged_label(F.col("label")).alias("label_name"), series_key(F.col("name")).alias("normalized_series_name"),
    )


def stage_episodes(episodes: DataFrame) -> DataFrame:
    texts = {n: blank_to_null(F.col(n)) for n in ("source_key", "description", "cover_url", "order_number", "source_url")}
    return episodes.select(
        F.col("id").cast("bigint").alias("episode_id"), F.col("series_id").cast("bigint").alias("series_id"), texts["source_key"].alias("source_key"),
        F.col("episode_number").cast("bigint").alias("episode_number"), blank_to_null(F.col("title")).alias("episode_title"), texts["description"].alias("description"),
        F.col("duration_minutes").cast("double").alias("duration_minutes"), F.col("release_date").cast("date").alias("release_date"),
        F.year(F.col("release_date").cast("date")).alias("release_year"), texts["cover_url"].alias("cover_url"), texts["order_number"].alias("order_number"), texts["source_url"].alias("source_url"),
    )


def stage_names(names: DataFrame, kind: str) -> DataFrame:
    """Genres, roles and speakers."""
    return names.select(F.col("id").cast("bigint").alias(f"{kind}_id"), blank_to_null(F.col("name")).alias(f"{kind}_name"))


def stage_links(links: DataFrame) -> DataFrame:
    return links.select(*[F.col(c).cast("bigint").alias(c) for c in links.columns])


def episode_facts(episodes: DataFrame, series: DataFrame, franchises: DataFrame) -> DataFrame:
    """Staged episodes with their series, label and franchise. Spark broadcasts the two small tables if they are small."""
    joined = episodes.join(series, "series_id", "left").join(franchises, "normalized_series_name", "left")
    return joined.select(
        "episode_id", "source_key", "series_id", "series_name", "label_name", F.coalesce("franchise_name", "series_name").alias("franchise_name"),
        "episode_number", "episode_title", "description", "release_date", "release_year", "duration_minutes", "cover_url", "order_number", "source_url",
    )


def episode_genres(facts: DataFrame, links: DataFrame, genres: DataFrame) -> DataFrame:
    rows = links.join(facts.select("episode_id", "release_year"), "episode_id").join(genres, "genre_id")
    return rows.select("episode_id", "release_year", "genre_id", "genre_name", text_key(F.col("episode_id"), F.col("genre_id")).alias("episode_genre_key"))


def speaker_credits(facts: DataFrame, links: DataFrame, speakers: DataFrame, roles: DataFrame) -> DataFrame:
    rows = links.join(facts.select("episode_id", "release_year"), "episode_id").join(speakers, "speaker_id").join(roles, "role_id")
    key = text_key(F.col("episode_id"), F.col("speaker_id"), F.col("role_id"))
    return rows.select("episode_id", "release_year", "speaker_id", "speaker_name", "role_id", "role_name", key.alias("credit_key"))


def tasks_of(rows: DataFrame, most: int = PART_ROWS) -> int:
    """As many tasks as keep each near most rows."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // most))


def dealt(rows: DataFrame, *keys: str, most: int = PART_ROWS) -> DataFrame:
    """rows dealt by keys to tasks_of them, so that what a task holds doesn't grow with the table."""
    return rows.repartition(tasks_of(rows, most), *keys)


def in_years(rows: DataFrame, start: int | None, end: int | None, column: str = "release_year") -> DataFrame:
    """Only given bounds make a condition, so unknown years pass only without bounds."""
    if start is not None:
        rows = rows.where(F.col(column) >= start)
    if end is not None:
        rows = rows.where(F.col(column) <= end)
    return rows


def clamped(limit: int | None, usual: int, most: int) -> int:
    return max(1, min(usual if limit is None else limit, most))


def per_year(facts: DataFrame) -> DataFrame:
    return facts.where("release_year is not null").groupBy(F.col("release_year").alias("year")).agg(F.count("*").alias("episode_count"))


def genre_trends(genres: DataFrame) -> DataFrame:
    """Distinct first, so that each (year, genre, episode) is shuffled once and then only counted."""
    once = genres.where("release_year is not null").select("release_year", "genre_name", "episode_id").distinct()
    counted = once.groupBy(F.col("release_year").alias("year"), "genre_name").agg(F.count("*").alias("episode_count"))
    return counted.withColumn("year_genre_key", text_key(F.col("year"), F.col("genre_name")))


def genre_totals(genres: DataFrame) -> DataFrame:
    return genres.select("genre_name", "episode_id").distinct().groupBy("genre_name").agg(F.count("*").alias("episode_count"))


def by_group(facts: DataFrame, group: str) -> DataFrame:
    """Series and episodes of each label or franchise: per (group, series) first, then the sums of these."""
    inner = facts.groupBy(group, "series_id").agg(F.count("*").alias("n"))
    return inner.groupBy(group).agg(F.count("series_id").alias("series_count"), F.sum("n").alias("episode_count"))


def labels(facts: DataFrame) -> DataFrame:
    return by_group(facts.where("label_name is not null"), "label_name")


def franchises(facts: DataFrame) -> DataFrame:
    return by_group(facts, "franchise_name")


def speakers(credits: DataFrame) -> DataFrame:
    """Distinct episodes and roles of each speaker from two small aggregates instead of one that copies all rows."""
    keys = ["speaker_id", "speaker_name"]
    by_episode = credits.groupBy(*keys, "episode_id").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.count("*").alias("episode_count"), F.sum("n").alias("credit_count"))
    by_role = credits.select("speaker_id", "role_id").distinct().groupBy("speaker_id").agg(F.count("*").alias("role_count"))
    return by_episode.join(by_role, "speaker_id").select("speaker_id", "speaker_name", "episode_count", "role_count", "credit_count")


def duration_bucket(minutes: Column) -> tuple[Column, Column]:
    label, order = F.lit(DURATION_LABELS[-1]), F.lit(len(DURATION_LABELS))
    for i in reversed(range(len(DURATION_ENDS))):
        label = F.when(minutes < DURATION_ENDS[i], DURATION_LABELS[i]).otherwise(label)
        order = F.when(minutes < DURATION_ENDS[i], i + 1).otherwise(order)
    return label, order


def duration_distribution(facts: DataFrame) -> DataFrame:
    label, order = duration_bucket(F.col("duration_minutes"))
    rows = facts.where("duration_minutes is not null").select(label.alias("duration_bucket"), order.alias("bucket_order"))
    return rows.groupBy("duration_bucket", "bucket_order").agg(F.count("*").alias("episode_count"))


def kpis(facts: DataFrame) -> DataFrame:
    """Counts per (series, label, franchise) first: the distinct counts then run over that small table."""
    inner = facts.groupBy("series_id", "label_name", "franchise_name").agg(
        F.count("*").alias("n"), F.count_if(F.col("release_year").isNull()).alias("no_year"), F.count_if(F.col("duration_minutes").isNull()).alias("no_duration"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return inner.agg(
        total("n").alias("episode_count"), F.countDistinct("series_id").alias("series_count"), F.countDistinct("label_name").alias("label_count"),
        F.countDistinct("franchise_name").alias("franchise_count"), total("no_year").alias("episodes_without_year"), total("no_duration").alias("episodes_without_duration"))


def top_genre_trends(genres: DataFrame, start: int | None = None, end: int | None = None, limit: int | None = None) -> DataFrame:
    """An episode has one year, so a genre's episodes are the sum over years: one small table gives both totals and trends."""
    yearly = genre_trends(in_years(genres, start, end)).drop("year_genre_key")
    totals = yearly.groupBy("genre_name").agg(F.sum("episode_count").alias("n"))
    top = totals.orderBy(F.desc("n"), "genre_name").limit(clamped(limit, 5, 20)).select("genre_name")
    return yearly.join(F.broadcast(top), "genre_name", "left_semi").select("year", "genre_name", "episode_count")  # at most 20 rows


def top_labels(facts: DataFrame, start: int | None = None, end: int | None = None, limit: int | None = None) -> DataFrame:
    return labels(in_years(facts, start, end)).orderBy(F.desc("episode_count"), "label_name").limit(clamped(limit, 10, 50))


def top_franchises(facts: DataFrame, start: int | None = None, end: int | None = None, limit: int | None = None) -> DataFrame:
    return franchises(in_years(facts, start, end)).orderBy(F.desc("episode_count"), F.asc_nulls_last("franchise_name")).limit(clamped(limit, 10, 50))


def top_speakers(credits: DataFrame, start: int | None = None, end: int | None = None, limit: int | None = None) -> DataFrame:
    rows = speakers(in_years(credits, start, end)).orderBy(F.desc("episode_count"), F.asc_nulls_last("speaker_name"), "speaker_id").limit(clamped(limit, 10, 50))
    return rows.drop("speaker_id")


def genre_chart(facts: DataFrame, genres: DataFrame, names: list[str], start: int | None = None, end: int | None = None) -> DataFrame:
    """A row for each year with episodes and a column for each of the given genres, 0 where there is none."""
    yearly = genre_trends(in_years(genres, start, end)).where(F.col("genre_name").isin(names))
    wide = yearly.groupBy("year").pivot("genre_name", names).agg(F.sum("episode_count"))
    years = per_year(in_years(facts, start, end)).select("year")
    return years.join(wide, "year", "full").na.fill(0, names)
