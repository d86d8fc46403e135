"""Checks. Each returns rows of (check_name, violations), or the violating rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counted(name: str, rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check_name"), "violations")


def together(*checks: DataFrame) -> DataFrame:
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def holds(rows: DataFrame, **conditions: Column) -> DataFrame:
    """All row conditions in one pass; a null condition is a violation."""
    counts = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()])
    return counts.select(F.stack(F.lit(len(conditions)), *[x for n in conditions for x in (F.lit(n), F.col(n))]).alias("check_name", "violations"))


def not_null(rows: DataFrame, *columns: str) -> DataFrame:
    return holds(rows, **{f"not_null_{c}": F.col(c).isNotNull() for c in columns})


def unique(rows: DataFrame, column: str) -> DataFrame:
    return counted(f"unique_{column}", rows.where(F.col(column).isNotNull()).groupBy(column).count().where("count > 1"))


def relationship(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    keys = parent.select(F.col(parent_key).alias(key)).distinct()
    return counted(f"relationship_{key}", child.where(F.col(key).isNotNull()).join(keys, key, "left_anti"))


def accepted(rows: DataFrame, column: str, values: list) -> DataFrame:
    return holds(rows, **{f"accepted_{column}": F.col(column).isNull() | F.col(column).isin(values)})


def same_count(name: str, a: DataFrame, b: DataFrame) -> DataFrame:
    n = a.agg(F.count("*").alias("n")).crossJoin(b.agg(F.count("*").alias("m")))  # one row each
    return n.select(F.lit(name).alias("check_name"), F.abs(F.col("n") - F.col("m")).alias("violations"))


def complete(name: str, a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has."""
    return counted(name, a.join(b, key, "left_anti").select(key).unionByName(b.join(a, key, "left_anti").select(key)))


def same_rows(name: str, a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose value differs or that one side lacks."""
    both = a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), keys, "full")
    return counted(name, both.where(~F.col("a").eqNullSafe(F.col("b"))))


def kpis_match(name: str, kpis: DataFrame, facts: DataFrame) -> DataFrame:
    """1 if the row of indicators has another number of episodes or series than the facts."""
    counts = facts.agg(F.count("*").alias("n"), F.countDistinct("series_id").alias("m"))
    differs = (F.col("episode_count") != F.col("n")) | (F.col("series_count") != F.col("m"))
    return kpis.crossJoin(counts).select(F.lit(name).alias("check_name"), F.when(differs, 1).otherwise(0).cast("long").alias("violations"))  # one row each


def same_groups(name: str, a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of distinct keys that only one side has; null keys never match."""
    both = a.select(*keys, F.lit(1).alias("in_a")).join(b.select(*keys, F.lit(1).alias("in_b")), keys, "full")
    return counted(name, both.where("in_a is null or in_b is null"))


def is_stub() -> Column:
    """A record that only has what its list row had."""
    nothing = F.lit(True)
    for c in ("description", "duration_minutes", "release_date", "label", "cover_url"):
        nothing = nothing & F.col(c).isNull()
    return nothing & (F.size(F.coalesce("speakers", F.array().cast("array<struct<role:string,speaker:string>>"))) == 0) & (F.size(F.coalesce("genres", F.array().cast("array<string>"))) == 0)


def record_stats(records: DataFrame) -> DataFrame:
    """records, stubs, and distinct speakers, roles and genres."""
    counts = records.agg(F.count("*").alias("records"), F.count_if(is_stub()).alias("stubs"))
    credits = records.select(F.explode("speakers").alias("c")).agg(F.countDistinct("c.speaker").alias("speakers"), F.countDistinct("c.role").alias("roles"))
    genres = records.select(F.explode("genres").alias("g")).agg(F.countDistinct("g").alias("genres"))
    return counts.crossJoin(credits).crossJoin(genres)  # one row each


def check_records(records: DataFrame) -> DataFrame:
    """What must hold before records are published: some rows, arrays present, no U+FFFD anywhere, keys and addresses unique."""
    broken = F.contains(F.to_json(F.struct(*records.columns)), F.lit("�"))
    rows = holds(records, arrays_present=F.col("speakers").isNotNull() & F.col("genres").isNotNull(), no_replacement_character=~broken, key_present=F.coalesce(F.col("source_key"), F.lit("")) != "")
    empty = records.agg(F.when(F.count("*") == 0, 1).otherwise(0).cast("long").alias("violations")).select(F.lit("not_empty").alias("check_name"), "violations")
    return together(rows, empty, unique(records, "source_key"), unique(records, "source_url"))


def check_load(records: DataFrame, date: Column) -> DataFrame:
    return holds(records, title_and_series=F.col("title").isNotNull() & F.col("series_name").isNotNull(), date_valid=F.col("release_date").isNull() | date.isNotNull(),
                 credits_complete=F.forall("speakers", lambda c: c["role"].isNotNull() & c["speaker"].isNotNull()))


def bad_dates(records: DataFrame, date: Column, most: int = 5) -> DataFrame:
    """The first invalid dates, as a report."""
    return records.where(F.col("release_date").isNotNull() & date.isNull()).select("release_date").orderBy("release_date").limit(most)


def check_candidates(found: DataFrame) -> DataFrame:
    return together(holds(found, id_present=F.coalesce(F.trim("candidate_id"), F.lit("")) != "", score_in_range=F.col("confidence_score").between(0, 100)), unique(found, "candidate_id"))


def check_links(found: DataFrame, classified: DataFrame, refs: DataFrame) -> DataFrame:
    """Links stay inside series and line; unresolved ones have no target; other productions aren't the same recording;
    scores fit their class."""
    place = lambda rows, side: rows.select(F.col("episode_id").alias(f"{side}_episode_id"), F.col("series_id").alias(f"{side}_series"), F.col("production_line_key").alias(f"{side}_line"))
    both = found.where("target_episode_id is not null").join(place(classified, "source"), "source_episode_id").join(place(refs, "target"), "target_episode_id")
    outside = counted("links_in_series", both.where("source_series <> target_series or source_line <> target_line"))
    score = F.col("confidence_score")
    fits = F.when(F.col("confidence_class") == "high", score >= 90).when(F.col("confidence_class") == "medium", score.between(70, 89)).when(F.col("confidence_class") == "low", score < 70)
    productions = F.col("variant_category").isin("film_adaptation", "live_production", "other_production")
    rows = holds(
        found,
        unresolved_without_target=(F.col("proposed_relationship") == "unresolved") == F.col("target_episode_id").isNull(),
        productions_not_same_recording=~(productions & (F.col("proposed_relationship") == "same_recording")),
        score_fits_class=score.between(0, 100) & fits,
    )
    return together(outside, rows)


def durations_not_negative(facts: DataFrame) -> DataFrame:
    return holds(facts, durations_not_negative=F.col("duration_minutes").isNull() | (F.col("duration_minutes") >= 0))


def _filled(column: str) -> Column:
    return F.nullif(column, F.lit(""))


def _overriding(reviews: DataFrame) -> DataFrame:
    """Accepted reviews that name a category or markers."""
    return reviews.where("review_decision = 'accept'").where(_filled("reviewed_category").isNotNull() | _filled("reviewed_markers").isNotNull())


def consistent_reviews(reviews: DataFrame) -> DataFrame:
    """source_keys with different accepted categories or markers."""
    counts = [F.countDistinct(_filled(f"reviewed_{c}")).alias(c) for c in ("category", "markers")]
    return counted("reviews_consistent", _overriding(reviews).groupBy("source_key").agg(*counts).where("category > 1 or markers > 1"))


def applied_reviews(reviews: DataFrame, classified: DataFrame) -> DataFrame:
    """Overrides without a classification, or whose classification isn't marked as reviewed or has another category or
    other markers."""
    wanted = _overriding(reviews).groupBy("source_key").agg(*[F.max(_filled(f"reviewed_{c}")).alias(c) for c in ("category", "markers")])
    have = classified.select("source_key", "classification_source", "variant_category", "edition_markers")
    wrong = "classification_source is null or classification_source <> 'reviewed' or category <> variant_category or markers <> edition_markers"
    return counted("reviews_applied", wanted.join(have, "source_key", "left").where(wrong))


# Spot checks of single series and titles.


def only_numbers(rows: DataFrame, series: str, category: str, first: int, last: int) -> DataFrame:
    """Episodes of a series that have the category but a number outside first to last, and one more violation if they
    aren't as many as the numbers."""
    mine = rows.where((F.col("series_name") == series) & (F.col("category_key") == category))
    counts = mine.agg(F.count_if(~F.col("episode_number").between(first, last)).alias("outside"), F.count("*").alias("n"))
    extra = F.when(F.col("n") != last - first + 1, 1).otherwise(0)
    return counts.select(F.lit("only_numbers").alias("check_name"), (F.col("outside") + extra).cast("long").alias("violations"))


def links_of_title(name: str, found: DataFrame, classified: DataFrame, pattern: str, relationship: str, wanted: tuple[int, int, int]) -> DataFrame:
    """1 if the first episode (by id) whose lower-case title is like pattern has another number of links of the relationship, or
    another least or largest target number, than wanted."""
    chosen = classified.where(F.lower("episode_title").like(pattern)).agg(F.min("episode_id").alias("source_episode_id"))
    links = found.where(F.col("proposed_relationship") == relationship).join(chosen, "source_episode_id", "left_semi")
    counts = links.agg(F.count("*").alias("n"), F.min("target_episode_number").alias("low"), F.max("target_episode_number").alias("high"))
    right = (F.col("n") == wanted[0]) & (F.col("low") == wanted[1]) & (F.col("high") == wanted[2])
    return counts.select(F.lit(name).alias("check_name"), F.when(right, 0).otherwise(1).cast("long").alias("violations"))


def parts_are_no_collections(classified: DataFrame, series: str, part_numbers: str) -> DataFrame:
    """Episodes of a series whose title names a part and which still count as a collection, without a marker that says so."""
    marked = F.contains("edition_markers", F.lit("container")) | F.contains("edition_markers", F.lit("compilation"))
    bad = (F.col("series_name") == series) & F.lower("episode_title").rlike(part_numbers) & F.col("variant_category").isin("box_set", "compilation") & ~marked
    return counted("parts_are_no_collections", classified.where(bad))


def lines_applied(rows: DataFrame, lines: DataFrame, series: str, default: str, line: str) -> DataFrame:
    """Episodes of a series whose production line is neither the mapped one nor else the default, and one more violation
    if the line doesn't have as many episodes as are mapped."""
    mine = rows.where(F.col("series_name") == series)
    mapped = lines.select("source_key", F.col("production_line_key").alias("mapped"))
    counts = mine.join(mapped, "source_key", "left").agg(F.count_if(F.coalesce("mapped", F.lit(default)) != F.col("production_line_key")).alias("wrong"), F.count_if(F.col("production_line_key") == line).alias("n"))
    counts = counts.crossJoin(lines.agg(F.count("*").alias("m")))  # one row each
    return counts.select(F.lit("lines_applied").alias("check_name"), (F.col("wrong") + F.when(F.col("n") != F.col("m"), 1).otherwise(0)).cast("long").alias("violations"))


def by_status(checks: DataFrame) -> DataFrame:
    return checks.groupBy(F.when(F.col("violations") == 0, "pass").otherwise("fail").alias("status")).agg(F.count("*").alias("n"))
