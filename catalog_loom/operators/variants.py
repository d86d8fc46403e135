"""Which episodes are box sets, reissues, live or other versions, and which reference episodes they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_loom.functions.text import text_key
from catalog_loom.operators.order import numbered

# What marks a lower-case title.
MARKERS = {
    "fanbox": "(fanbox|einsteigerbox)",
    "container": "(steelbook|sammelbox|hörspielbox|hörspiel-box|jubiläumsbox|komplettbox|sammleredition|in einer box|collector.?s box)",
    "compilation": "(doppelfolge|sammelfolge|gesamtausgabe)",
    "format_reissue": "(lp[ -]?edition|vinyl|neuauflage|reissue|remastered)",
    "live": "(^|[^a-zäöüß])(live|live-dvd|live &|live and)([^a-zäöüß]|$)|usb-stick",
    "film": "(hörspiel zum film|original-hörspiel zum kinofilm|kinofilm|filmfassung)",
    "special": "(adventskalender|special|top secret edition|sonderfolge)",
    "audiobook": "(hörbuch|audiobook|lesung|liest:?)",
    "other_production": "(radio show|soundtrack|originalmusik|alexa-skill|welt der hörspiele)",
}
PART_NUMBERS = r"(teil\s*)?[0-9]+\s*/\s*[0-9]+"
RANGE = r"folgen?\s*0*([0-9]+)\s*(?:-|–|bis|und)\s*0*([0-9]+)"
# What is removed from a title, in this order, before titles are compared.
TITLE_NOISE = (
    (r"(die drei\s*\?\?\?|special\s+[0-9]{4}\s*[-:]?)", " "),
    (r"\([^)]*(lp[ -]?edition|vinyl|hörspiel zum film|kinofilm|live|dvd|special)[^)]*\)", " "),
    (r"(?s)\s*[-–]\s*(live|lp[ -]?edition|special).*$", " "),
    (r"^\s*(und\s+)?", ""),
    ("[^a-z0-9äöüß]+", ""),
)
COMPONENT_NOISE = ((r"(^\s*(doppelfolge|sammelfolge|steelbook\s*[0-9]+)\s*:\s*|die drei\s*\?\?\?)", " "), (r"(^\s*und\s+|[^a-z0-9äöüß]+)", ""))
# The special default line of one series; categories of the catalog with label and order.
LINE_DEFAULTS = {"John Sinclair": ("edition_2000", "Edition 2000")}
MAIN_LINE = ("main", "Hauptserie")
CATEGORIES = {
    "regular": ("Reguläre Folgen", 10), "special": ("Specials", 20), "dialect": ("Dialektfolgen", 30), "audiobook": ("Hörbücher & Lesungen", 40), "live": ("Live-Produktionen", 50),
    "film": ("Filmhörspiele", 60), "reissue": ("Neuauflagen & Formate", 70), "collection": ("Boxen & Sammlungen", 80), "other": ("Andere Produktionen", 90), "unknown": ("Unklar", 100),
}
OF_VARIANT = {"regular_episode": "regular", "format_reissue": "reissue", "box_set": "collection", "compilation": "collection", "live_production": "live", "film_adaptation": "film", "special": "special", "other_production": "other"}
LARGEST_NUMBER = 999
PLACE = ["series_id", "production_line_key"]
OVERRIDE = ["reviewed_category", "reviewed_markers", "reviewed"]
REFERENCE = ["series_name", "production_line_label", "production_line_order", "episode_id", "source_key", "episode_title", "description", "comparison_title", "release_date", "duration_minutes", "order_number", "cast_count", "cast_fingerprint"]
# What links and candidates are made of: of references, and of features.
TARGET = ["episode_id", "source_key", "episode_title", "description", "comparison_title", "duration_minutes", "cast_fingerprint"]
LINKED = [*PLACE, *TARGET, "episode_number", "release_date", "cast_count", "base_category", "edition_markers", "range_start", "range_end"]
SOURCE = [*PLACE, *TARGET, "episode_number", "variant_category", "edition_markers", "range_start", "range_end"]
# What references and categories follow from, and what the catalog shows of a classification.
KIND = [*PLACE, "production_line_label", "production_line_order", "episode_id", "episode_number", "release_date", "cast_count", "base_category", "edition_markers", "comparison_title"]
SHOWN = ["variant_category", "production_line_key", "production_line_label", "production_line_order", "machine_category", "classification_source", "edition_markers"]


def first_of(*choices: tuple[Column, object], otherwise: object) -> Column:
    out = F.when(*choices[0])
    for condition, value in choices[1:]:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


def has_marker(markers: str, name: str) -> Column:
    return F.array_contains(F.split(F.coalesce(F.col(markers), F.lit("")), ","), name)


def without(x: Column, noise: tuple[tuple[str, str], ...]) -> Column:
    for pattern, to in noise:
        x = F.regexp_replace(x, pattern, to)
    return x


def casts(credits: DataFrame) -> DataFrame:
    """Number of speakers and a fingerprint of the (speaker, role) pairs of each episode. Speakers are counted in the pairs: a
    distinct count beside them would shuffle all credits once more."""
    pairs = credits.groupBy("episode_id").agg(F.sort_array(F.collect_list(F.struct("speaker_id", "role_id"))).alias("pairs"))
    text = F.array_join(F.transform("pairs", lambda p: text_key(p["speaker_id"], p["role_id"])), ",")
    return pairs.select("episode_id", F.size(F.array_compact(F.array_distinct("pairs.speaker_id"))).alias("cast_count"), F.md5(text).alias("cast_fingerprint"))


def known_casts(links: DataFrame, speakers: DataFrame, roles: DataFrame) -> DataFrame:
    """Whether each episode has a credit of a known speaker, as a cast_count of 1 or 0, for what doesn't need the casts themselves.
    Links may repeat, nothing of an episode is collected, and links of one task become a row for each episode before the shuffle."""
    credits = links.join(speakers.select("speaker_id"), "speaker_id").join(roles.select("role_id"), "role_id")
    return credits.groupBy("episode_id").agg(F.max(F.col("speaker_id").isNotNull().cast("int")).alias("cast_count"))


def reviewed_dialects(reviews: DataFrame) -> DataFrame:
    accepted = reviews.where("review_decision = 'accept'")
    return accepted.groupBy("source_key").agg(F.bool_or(has_marker("reviewed_markers", "dialect")).alias("is_dialect"))


def notes(reviews: DataFrame) -> DataFrame:
    """What accepted reviews say of a source_key: whether it is a dialect, and the override; reviewed is null without one."""
    texts = {c: F.nullif(c, F.lit("")) for c in OVERRIDE[:2]}
    given = F.nullif(F.bool_or(texts["reviewed_category"].isNotNull() | texts["reviewed_markers"].isNotNull()), F.lit(False))
    accepted = reviews.where("review_decision = 'accept'").groupBy("source_key")
    return accepted.agg(F.bool_or(has_marker("reviewed_markers", "dialect")).alias("is_dialect"), *[F.max(t).alias(c) for c, t in texts.items()], given.alias("reviewed"))


def features(facts: DataFrame, credits: DataFrame, reviews: DataFrame, lines: DataFrame) -> DataFrame:
    return noted_features(facts, casts(credits), reviews, lines).drop(*OVERRIDE)


def kind_features(facts: DataFrame, known: DataFrame, reviews: DataFrame, lines: DataFrame) -> DataFrame:
    """What the categories follow from: of the features, neither texts nor fingerprints nor the size of a cast, but whether it has
    any, as known_casts gives it."""
    return noted_features(facts, known, reviews, lines).select(*KIND, *OVERRIDE)


def noted_features(facts: DataFrame, cast: DataFrame, reviews: DataFrame, lines: DataFrame) -> DataFrame:
    """Features with the overrides of the reviews, which have the key of the dialects: one join serves both."""
    mapped = lines.select("source_key", *[F.col(f"production_line_{c}").alias(f"mapped_{c}") for c in ("key", "label", "order")])
    if "cast_fingerprint" not in cast.columns:
        cast = cast.withColumn("cast_fingerprint", F.lit(None).cast("string"))
    rows = facts.join(cast, "episode_id", "left").join(notes(reviews), "source_key", "left").join(mapped, "source_key", "left")
    low = F.lower("episode_title")
    flag = {name: low.rlike(pattern) for name, pattern in MARKERS.items()}
    flag["dialect"] = F.coalesce("is_dialect", F.lit(False))
    flag["multi_title"] = low.contains("/") & ~low.rlike(PART_NUMBERS)
    rows = rows.select("*", *[f.alias(f"m_{n}") for n, f in flag.items()])
    m = {n: F.col(f"m_{n}") for n in flag}
    base = first_of(
        (m["fanbox"] | m["container"], "box_set"), (m["compilation"] | m["multi_title"], "compilation"), (m["format_reissue"], "format_reissue"), (m["live"], "live_production"),
        (m["film"], "film_adaptation"), (m["dialect"] | m["special"], "special"), (m["audiobook"] | m["other_production"], "other_production"),
        (F.col("episode_number").between(1, LARGEST_NUMBER), "regular_candidate"), otherwise="unknown")
    shown = {**m, "special": m["special"] | m["dialect"]}
    markers = F.concat_ws(",", *[F.when(shown[n], n) for n in ("fanbox", "container", "compilation", "format_reissue", "live", "film", "special", "audiobook", "dialect", "other_production", "multi_title")])
    default = [first_of(*[(F.col("series_name") == s, v[i]) for s, v in LINE_DEFAULTS.items()], otherwise=MAIN_LINE[i]) for i in (0, 1)]
    # Few titles name a range: an empty extract is slow to cast.
    bound = lambda i: F.when(low.rlike(RANGE), F.regexp_extract(low, RANGE, i)).try_cast("int")
    return rows.select(
        "series_id", "series_name", "franchise_name", F.coalesce("mapped_key", default[0]).alias("production_line_key"), F.coalesce("mapped_label", default[1]).alias("production_line_label"),
        F.coalesce("mapped_order", F.lit(10)).alias("production_line_order"), "episode_id", "source_key", "episode_number", "episode_title", "description", "duration_minutes", "release_date",
        "order_number", F.coalesce("cast_count", F.lit(0)).alias("cast_count"), "cast_fingerprint", base.alias("base_category"), bound(1).alias("range_start"), bound(2).alias("range_end"),
        markers.alias("edition_markers"), without(low, TITLE_NOISE).alias("comparison_title"), m["multi_title"].alias("has_title_separator"),
        *OVERRIDE,
    )


def references(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The first regular candidate of each (series, line, number): dated ones first, by date, then those with a cast, then
    the smallest id. As an aggregate, so that a number that very many episodes share is reduced before the shuffle."""
    found = rows.where((F.col("base_category") == "regular_candidate") & (F.col("episode_number") > 0) & (F.col("comparison_title") != ""))
    order = F.struct(F.col("release_date").isNull(), "release_date", F.col("cast_count") <= 0, "episode_id")
    best = found.groupBy(*PLACE, "episode_number").agg(F.min_by(F.struct(*(keep or REFERENCE)), order).alias("best"))
    key = text_key(F.col("series_id"), F.col("production_line_key"), F.col("episode_number"))
    return best.select(key.alias("series_episode_number_key"), *PLACE, "episode_number", "best.*")


def overrides(reviews: DataFrame) -> DataFrame:
    """Category and markers of accepted reviews by source_key; source_keys with neither have no row."""
    texts = reviews.where("review_decision = 'accept'").select("source_key", F.nullif("reviewed_category", F.lit("")).alias("c"), F.nullif("reviewed_markers", F.lit("")).alias("m"))
    return texts.where("c is not null or m is not null").groupBy("source_key").agg(F.max("c").alias("reviewed_category"), F.max("m").alias("reviewed_markers"), F.lit(True).alias("reviewed"))


def classifications(rows: DataFrame, refs: DataFrame, reviews: DataFrame) -> DataFrame:
    return classified(rows.join(overrides(reviews), "source_key", "left"), refs)


def classified(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """Classifications of features that have their overrides."""
    joined = kinds(rows, refs)
    return joined.select(
        "series_id", "series_name", "franchise_name", "production_line_key", "production_line_label", "production_line_order", "episode_id", "source_key", "episode_number", "episode_title",
        "description", "duration_minutes", "release_date", "order_number", "cast_count", "cast_fingerprint", "variant_category", "machine_category", "classification_source", "range_start", "range_end",
        "edition_markers", "comparison_title",
    )


def link_sources(classified: DataFrame) -> DataFrame:
    """What links and candidates start from: every episode that isn't a regular one, without what they don't show."""
    return classified.where("variant_category <> 'regular_episode'").select(*SOURCE)


def kinds(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """rows with their categories, source of classification and markers."""
    chosen = refs.select("episode_id", F.lit(True).alias("is_reference"))
    joined = rows.join(chosen, "episode_id", "left")
    machine = first_of((F.col("is_reference"), "regular_episode"), (F.col("base_category") == "regular_candidate", "unknown"), otherwise=F.col("base_category"))
    return joined.withColumn("machine_category", machine).withColumns({
        "variant_category": F.coalesce("reviewed_category", "machine_category"), "classification_source": F.when(F.col("reviewed"), "reviewed").otherwise("machine"),
        "edition_markers": F.coalesce("reviewed_markers", "edition_markers")})


def _links(pairs: DataFrame, relationship: str, score: Column, reasons: list[Column]) -> DataFrame:
    return pairs.select(
        F.col("episode_id").alias("source_episode_id"), F.col("t_episode_id").alias("target_episode_id"), F.lit(relationship).alias("proposed_relationship"),
        score.cast("int").alias("confidence_score"), F.filter(F.array(*reasons), lambda r: r.isNotNull()).alias("match_reasons"))


def _targets(refs: DataFrame) -> DataFrame:
    return refs.select(*PLACE, *[F.col(c).alias(f"t_{c}") for c in ("episode_id", "episode_number", "comparison_title", "description", "cast_fingerprint", "duration_minutes")])


def _same(column: str) -> Column:
    return F.coalesce(F.col(column) == F.col(f"t_{column}"), F.lit(False))


def range_links(classified: DataFrame, refs: DataFrame) -> DataFrame:
    """Box sets and compilations that name a range contain the references of its numbers. Numbers of references are 1 to
    LARGEST_NUMBER, so the range is written out within these: the join has three equal keys and no range condition."""
    low, high = F.greatest("range_start", F.lit(1)), F.least("range_end", F.lit(LARGEST_NUMBER))
    known = F.col("range_start").isNotNull() & F.col("range_end").isNotNull()  # greatest and least would skip nulls
    sets = classified.where(F.col("variant_category").isin("box_set", "compilation") & known & (low <= high))
    sets = sets.select("episode_id", *PLACE, F.explode(F.sequence(low.cast("bigint"), high.cast("bigint"))).alias("t_episode_number"))
    return _links(sets.join(_targets(refs), [*PLACE, "t_episode_number"]), "contains", F.lit(100), [F.lit("explicit_episode_range")])


def format_links(classified: DataFrame, refs: DataFrame) -> DataFrame:
    source = classified.where("variant_category = 'format_reissue'").withColumn("t_episode_number", F.col("episode_number"))
    pairs = source.join(_targets(refs), [*PLACE, "t_episode_number"])
    near = F.coalesce(F.abs(F.col("duration_minutes") - F.col("t_duration_minutes")) <= 5, F.lit(False))
    title, text, cast = _same("comparison_title"), _same("description"), _same("cast_fingerprint")
    score = first_of((title, 100), (text | cast, 95), (near, 90), otherwise=80)
    reasons = [F.lit("same_episode_number"), F.lit("format_marker"), F.when(title, "exact_normalized_title"), F.when(text, "exact_description"), F.when(cast, "same_cast_fingerprint"), F.when(near, "duration_within_five_minutes")]
    return _links(pairs, "same_recording", score, reasons)


def story_links(classified: DataFrame, refs: DataFrame) -> DataFrame:
    kinds = ("live_production", "film_adaptation", "other_production", "special")
    source = classified.where(F.col("variant_category").isin(*kinds) & (F.col("comparison_title") != "")).withColumn("t_comparison_title", F.col("comparison_title"))
    pairs = source.join(_targets(refs), [*PLACE, "t_comparison_title"]).where("episode_id <> t_episode_id")
    text, cast = _same("description"), _same("cast_fingerprint")
    reasons = [F.lit("exact_normalized_title"), F.lit("different_production_marker"), F.when(text, "exact_description"), F.when(cast, "same_cast_fingerprint")]
    return _links(pairs, "same_story_different_production", F.when(text | cast, 95).otherwise(90), reasons)


def component_links(classified: DataFrame, refs: DataFrame) -> DataFrame:
    """A compilation contains the references that its title names between slashes."""
    part = without(F.lower("part"), COMPONENT_NOISE)
    parts = classified.where("variant_category = 'compilation'").select("episode_id", *PLACE, F.explode(F.split("episode_title", r"\s*/\s*")).alias("part"))
    parts = parts.withColumn("t_comparison_title", part).where("t_comparison_title <> ''").drop("part")
    return _links(parts.join(_targets(refs), [*PLACE, "t_comparison_title"]), "contains", F.lit(90), [F.lit("exact_normalized_component_title")])


def best_links(*kinds: DataFrame) -> DataFrame:
    """Of equal source, target and relationship: the highest score, then the first reasons as text."""
    rows = kinds[0]
    for k in kinds[1:]:
        rows = rows.unionByName(k)
    keys = ["source_episode_id", "target_episode_id", "proposed_relationship"]
    order = F.struct(-F.col("confidence_score"), F.to_json("match_reasons"))
    best = rows.groupBy(*keys).agg(F.min_by(F.struct("confidence_score", "match_reasons"), order).alias("best"))
    return best.select(*keys, "best.*")


CANDIDATE = ["candidate_id", "source_episode_id", "source_key", "source_title", "variant_category", "target_episode_id", "target_source_key", "target_title", "target_episode_number",
             "proposed_relationship", "confidence_score", "confidence_class", "match_reasons", "edition_markers", "range_start", "range_end"]


def resolved(links: DataFrame, classified: DataFrame, refs: DataFrame) -> DataFrame:
    source = classified.select(F.col("episode_id").alias("source_episode_id"), "source_key", F.col("episode_title").alias("source_title"), "variant_category", "edition_markers", "range_start", "range_end")
    target = refs.select(F.col("episode_id").alias("target_episode_id"), F.col("source_key").alias("target_source_key"), F.col("episode_title").alias("target_title"), F.col("episode_number").alias("target_episode_number"))
    level = first_of((F.col("confidence_score") >= 90, "high"), (F.col("confidence_score") >= 70, "medium"), otherwise="low")
    ident = F.md5(F.concat_ws(":", "source_key", "target_source_key", "proposed_relationship"))
    return links.join(source, "source_episode_id").join(target, "target_episode_id").withColumn("candidate_id", ident).withColumn("confidence_class", level).select(CANDIDATE)


def unresolved(found: DataFrame, classified: DataFrame) -> DataFrame:
    open_rows = classified.where("variant_category <> 'regular_episode'").join(found.select(F.col("source_episode_id").alias("episode_id")), "episode_id", "left_anti")
    nothing = {"target_episode_id": "bigint", "target_source_key": "string", "target_title": "string", "target_episode_number": "bigint"}
    return open_rows.select(
        F.md5(F.concat_ws(":", "source_key", F.lit("none"), F.lit("unresolved"))).alias("candidate_id"), F.col("episode_id").alias("source_episode_id"), "source_key",
        F.col("episode_title").alias("source_title"), "variant_category", *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()], F.lit("unresolved").alias("proposed_relationship"),
        F.lit(0).alias("confidence_score"), F.lit("low").alias("confidence_class"), F.array(F.lit("no_deterministic_target")).alias("match_reasons"), "edition_markers", "range_start", "range_end").select(CANDIDATE)


def candidates(links: DataFrame, classified: DataFrame, refs: DataFrame) -> DataFrame:
    """Resolved and open candidates; links are those of best_links."""
    return resolved(links, classified, refs).unionByName(unresolved(links, classified))


def catalog(facts: DataFrame, classified: DataFrame) -> DataFrame:
    """Facts with their category. Every fact has one classification."""
    rows = facts.join(classified.select("episode_id", *SHOWN), "episode_id")
    by_variant = first_of(*[(F.col("variant_category") == v, c) for v, c in OF_VARIANT.items()], otherwise="unknown")
    key = first_of((has_marker("edition_markers", "dialect"), "dialect"), (has_marker("edition_markers", "audiobook"), "audiobook"), otherwise=by_variant)
    rows = rows.withColumn("category_key", key)
    for i, name in enumerate(("category_label", "category_order")):
        rows = rows.withColumn(name, first_of(*[(F.col("category_key") == c, v[i]) for c, v in CATEGORIES.items()], otherwise=CATEGORIES["unknown"][i]))
    return rows


def category_counts(rows: DataFrame) -> DataFrame:
    keys = ["series_id", "series_name", "franchise_name", "production_line_key", "production_line_label", "production_line_order", "category_key", "category_label", "category_order"]
    counts = rows.groupBy(*keys).agg(F.max("label_name").alias("label_name"), F.count("*").alias("episode_count"))
    return counts.withColumn("series_category_key", text_key(F.col("series_id"), F.col("production_line_key"), F.col("category_key")))


def review_export(found: DataFrame, classified: DataFrame, series: str) -> DataFrame:
    """The candidates of one series as the reviewers get them, with the place of each row in their order."""
    mine = classified.where(F.col("series_name") == series).select(F.col("episode_id").alias("source_episode_id"))
    rank = first_of((F.col("confidence_class") == "high", 1), (F.col("confidence_class") == "medium", 2), otherwise=3)
    order = [rank, F.col("variant_category"), F.col("source_key"), F.col("target_episode_number").asc_nulls_last(), F.col("candidate_id")]
    rows = found.join(mine, "source_episode_id", "left_semi").withColumn("match_reasons", F.to_json("match_reasons"))
    return numbered(rows, *order).withColumn("review_decision", F.lit("")).withColumn("review_note", F.lit(""))


def review_stats(found: DataFrame) -> DataFrame:
    """Candidates by category, relationship and class, all of them, and those unresolved, from one aggregate."""
    cells = found.groupBy("variant_category", "proposed_relationship", "confidence_class").agg(F.count("*").alias("n"))
    cell = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    parts = [cell("category", F.col("variant_category")), cell("relationship", F.col("proposed_relationship")), cell("confidence", F.col("confidence_class")), cell("records", F.lit("all")),
             F.when(F.col("proposed_relationship") == "unresolved", cell("unresolved", F.lit("all")))]
    rows = cells.select(F.explode(F.array_compact(F.array(*parts))).alias("cell"), "n").groupBy("cell.kind", "cell.value").agg(F.sum("n").alias("records"))
    return rows
