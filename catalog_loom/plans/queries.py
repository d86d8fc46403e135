"""The registered queries: each operator over frames derived from the base tables, with its DuckDB statement."""

from __future__ import annotations

import functools
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from catalog_loom.functions import text as tx
from catalog_loom.functions import unicode as un
from catalog_loom.operators import browse, coverage, dedup, extract, load, marts, profile, quality, retrieval, search, variants
from catalog_loom.plans.oracle import BUCKETS, MEDIUM, full, umlauts
from catalog_loom.sources import files, store
from catalog_loom.sources.keyed import KeyedTable
from catalog_loom.sources.projections import base, projection

BASE_URL = "https://x.test/"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Frames:
    """The catalog's frames, each built when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def fx(self, name: str) -> DataFrame:
        return self._once(f"fx_{name}", lambda: projection(self.spark, self.sf_dir, f"fx_{name}"))

    def base(self, name: str) -> DataFrame:
        return base(self.spark, self.sf_dir, name)

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    @property
    def facts(self) -> DataFrame:
        return self._once("facts", lambda: marts.episode_facts(marts.stage_episodes(self.fx("episodes")), marts.stage_series(self.fx("series")), self.fx("franchises")))

    @property
    def genres(self) -> DataFrame:
        return self._once("genres", lambda: marts.episode_genres(self.facts, marts.stage_links(self.fx("episode_genres")), marts.stage_names(self.fx("genres"), "genre")))

    def _credits(self, links: DataFrame) -> DataFrame:
        return marts.speaker_credits(self.facts, marts.stage_links(links), marts.stage_names(self.fx("speakers"), "speaker"), marts.stage_names(self.fx("roles"), "role"))

    @property
    def credits(self) -> DataFrame:
        return self._once("credits", lambda: self._credits(self.fx("episode_speakers")))

    @property
    def cast_links(self) -> DataFrame:
        """Links of episodes, speakers and roles, in which some may be repeated."""
        return self.base("lineitem").select(F.col("l_orderkey").alias("episode_id"), F.col("l_suppkey").alias("speaker_id"), F.col("l_partkey").alias("role_id"))

    @property
    def cast_credits(self) -> DataFrame:
        """The rows of credits, of links dealt by episode first: one shuffle serves to drop repeated ones and to join the facts."""
        links = self.cast_links
        return self._once("cast_credits", lambda: self._credits(marts.dealt(links, "episode_id").distinct()))

    # What several later frames are made of is written once and read again.

    def _written(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        return self._once(name, lambda: files.written(make(), name))

    @property
    def noted(self) -> DataFrame:
        return self._written("features", lambda: variants.noted_features(self.facts, self.cast_sizes, self.fx("reviews"), self.fx("lines")))

    @property
    def features(self) -> DataFrame:
        return self._once("features_alone", lambda: self.noted.drop(*variants.OVERRIDE))

    @property
    def refs(self) -> DataFrame:
        return self._written("refs", lambda: variants.references(self.features))

    @property
    def classified(self) -> DataFrame:
        return self._written("classified", lambda: variants.classified(self.noted, self.refs))

    @property
    def kinds(self) -> DataFrame:
        """What the catalog shows of the classifications, made without texts and fingerprints unless those are there anyway."""
        if "classified" in self._made:
            return self.classified
        known = variants.known_casts(marts.stage_links(self.cast_links), marts.stage_names(self.fx("speakers"), "speaker"), marts.stage_names(self.fx("roles"), "role"))
        rows = self._written("kind_features", lambda: variants.kind_features(self.facts, known, self.fx("reviews"), self.fx("lines")))
        return self._written("kinds", lambda: variants.kinds(rows, variants.references(rows, ["episode_id"])).select("episode_id", *variants.SHOWN))

    @property
    def cast_sizes(self) -> DataFrame:
        """Casts of all episodes that have links, those of the facts among them."""
        links = marts.stage_links(marts.dealt(self.cast_links, "episode_id").distinct())
        known = links.join(marts.stage_names(self.fx("speakers"), "speaker"), "speaker_id").join(marts.stage_names(self.fx("roles"), "role"), "role_id")
        return variants.casts(known)

    @property
    def linked(self) -> tuple[DataFrame, DataFrame]:
        """What links start from and lead to, without what they don't show, unless the whole classifications are there anyway."""
        if "classified" in self._made:
            return variants.link_sources(self.classified), self.refs
        rows = self._written("link_features", lambda: variants.noted_features(self.facts, self.cast_sizes, self.fx("reviews"), self.fx("lines")).select(*variants.LINKED, *variants.OVERRIDE))
        refs = self._written("link_refs", lambda: variants.references(rows, variants.TARGET))
        return self._written("link_sources", lambda: variants.link_sources(variants.kinds(rows, refs))), refs

    @property
    def links(self) -> DataFrame:
        kinds = (variants.range_links, variants.format_links, variants.story_links, variants.component_links)
        sources, refs = self.linked
        return self._written("links", lambda: variants.best_links(*[k(sources, refs) for k in kinds]))

    @property
    def candidates(self) -> DataFrame:
        return self._once("candidates", lambda: variants.candidates(self.links, *self.linked))

    @property
    def catalog(self) -> DataFrame:
        return self._once("catalog", lambda: variants.catalog(self.facts, self.kinds))

    @property
    def counts(self) -> DataFrame:
        return self._once("counts", lambda: variants.category_counts(self.catalog))

    @property
    def records(self) -> DataFrame:
        """Records with duplicates, in the order of ord."""
        r = self.fx("records_dup")
        return self._once("records", lambda: r.withColumn("source_key", un.source_key(F.col("source_url"), F.col("series_name"), F.col("episode_number"), F.col("title"))))

    @property
    def nested(self) -> DataFrame:
        """Nested records: an episode with its credits and genres as arrays."""
        return self._once("nested", lambda: self.nested_in_series.drop("sname"))

    @property
    def nested_in_series(self) -> DataFrame:
        """nested with sname, the name of the series, null where there is no such series. Links are dealt by episode as numbers and
        get their texts there, genres and episodes to as many tasks; episodes get what they need of the series first. So
        arrays of texts aren't moved once they are made."""
        def make() -> DataFrame:
            lines = self.base("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
            tasks = marts.tasks_of(lines)
            c = projection(self.spark, self.sf_dir, "fx_credits_raw", lineitem=lines.repartition(tasks, "l_orderkey")).groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "role", "speaker"))).alias("c"))
            c = c.select("id", F.transform("c", lambda x: F.struct(x["role"].alias("role"), x["speaker"].alias("speaker"))).alias("speakers"))
            g = self.fx("episode_genres").join(self.fx("genres").select(F.col("id").alias("genre_id"), "name"), "genre_id").repartition(tasks, "episode_id").groupBy(F.col("episode_id").alias("id")).agg(F.array_sort(F.collect_list("name")).alias("genres"))
            series = self.fx("series").select(F.col("id").alias("series_id"), tx.blank_to_null(F.col("label")).alias("label"), F.trim("name").alias("sname"))
            return self.fx("episodes").join(series, "series_id", "left").join(c, "id", "left").join(g, "id", "left").withColumn("speakers", F.coalesce("speakers", F.array().cast("array<struct<role:string,speaker:string>>"))).withColumn("genres", F.coalesce("genres", F.array().cast("array<string>")))
        return self._once("nested_in_series", make)

    @property
    def probes(self) -> DataFrame:
        ids = self.fx("probe_ids").select(F.col("probe").cast("string").alias("id")).distinct()
        return ids.select(F.concat(F.lit("p"), "id").alias("probe_key"), F.concat(F.lit("Serie "), "id").alias("series_name")).withColumn("aliases", F.array("series_name"))

    @property
    def found(self) -> DataFrame:
        return self._once("found", lambda: coverage.last_of_each(coverage.candidates(self.fx("api"), self.probes)))

    def of_series(self, series_id: int) -> Frames:
        """The frames of one series alone. References, categories and counts of a series follow from its own episodes, so
        all episodes are looked at once and those of other series not classified."""
        mine = Frames(self.spark, self.sf_dir)
        mine._made["facts"] = self.facts.where(F.col("series_id") == series_id)
        return mine

    def folder(self) -> str:
        """A new folder for what a query writes and reads again; it goes with the scratch block that the query runs in."""
        found = files.shared_folder(self.spark)
        store.staged(self.spark, found)
        return found


def register(name: str, sql: str | None, build: Callable[[Frames], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(Frames(spark, sf_dir))
    if sql is not None:
        SQL[name] = full(sql)


def run(spark: SparkSession, sf_dir: str, name: str, sink: Callable[[DataFrame], None]) -> None:
    """Run a query and give its rows to sink; what it wrote in between is deleted then."""
    with store.scratch():
        sink(QUERIES[name](spark, sf_dir))


# Marts.
FACTS = "SELECT * FROM facts"
register(
    "qry3_genre_trends",
    (
        "SELECT year, genre_name, episode_count FROM yg WHERE year BETWEEN 1994 AND 1999 AND genre_name IN (SELECT genre_name FROM yg"
        " WHERE year BETWEEN 1994 AND 1999 GROUP BY 1 ORDER BY sum(episode_count) DESC, 1 LIMIT 5)"
    ),
    lambda f: marts.top_genre_trends(f.genres, 1994, 1999, 5),
)
register("cln16_17_18_staged_series", "SELECT series_id, series_name, label_name, nk AS normalized_series_name FROM st_series", lambda f: marts.stage_series(f.fx("series")))
register("cln16_19_staged_episodes", "SELECT * FROM st_episodes", lambda f: marts.stage_episodes(f.fx("episodes")))
register("mrt1_episode_facts", FACTS, lambda f: f.facts)
register("mrt2_episode_genres", "SELECT * FROM egen", lambda f: f.genres)
register("mrt3_speaker_credits", "SELECT * FROM cred", lambda f: f.credits)
register("mrt4_per_year", "SELECT release_year AS year, count(*) AS episode_count FROM facts WHERE release_year IS NOT NULL GROUP BY 1", lambda f: marts.per_year(f.facts))
register("mrt5_genre_trends", "SELECT *, year || ':' || genre_name AS year_genre_key FROM yg", lambda f: marts.genre_trends(f.genres))
register("mrt6_genre_totals", "SELECT genre_name, count(DISTINCT episode_id) AS episode_count FROM egen GROUP BY 1", lambda f: marts.genre_totals(f.genres))
register(
    "mrt7_labels",
    "SELECT label_name, count(DISTINCT series_id) AS series_count, count(*) AS episode_count FROM facts WHERE label_name IS NOT NULL GROUP BY 1",
    lambda f: marts.labels(f.facts),
)
register(
    "mrt8_speakers",
    (
        "SELECT speaker_id, speaker_name, count(DISTINCT episode_id) AS episode_count, count(DISTINCT role_id) AS role_count, count(*) AS credit_count"
        " FROM cred GROUP BY ALL"
    ),
    lambda f: marts.speakers(f.cast_credits),
)
register(
    "mrt9_durations",
    f"SELECT {BUCKETS}, count(*) AS episode_count FROM facts WHERE duration_minutes IS NOT NULL GROUP BY ALL",
    lambda f: marts.duration_distribution(f.facts),
)
register(
    "mrt10_franchises",
    "SELECT franchise_name, count(DISTINCT series_id) AS series_count, count(*) AS episode_count FROM facts GROUP BY 1",
    lambda f: marts.franchises(f.facts),
)
KPIS = "SELECT count(*) AS episode_count, count(DISTINCT series_id) AS series_count, count(DISTINCT label_name) AS label_count, count(DISTINCT franchise_name) AS franchise_count, count(*) FILTER (release_year IS NULL) AS episodes_without_year, count(*) FILTER (duration_minutes IS NULL) AS episodes_without_duration FROM facts"
register("mrt11_kpis", KPIS, lambda f: marts.kpis(f.facts))
register("mrt12_catalog", "SELECT * FROM cat", lambda f: f.catalog)
register("mrt13_category_counts", "SELECT * FROM ccnt", lambda f: f.counts)

# Variants.
register("res1_casts", "SELECT * FROM casts", lambda f: variants.casts(f.cast_credits))
register("res2_reviewed_dialects", "SELECT source_key, d AS is_dialect FROM dial", lambda f: variants.reviewed_dialects(f.fx("reviews")))
FEATURES = "series_id, series_name, franchise_name, production_line_key, production_line_label, production_line_order, episode_id, source_key, episode_number, episode_title, description, duration_minutes, release_date, order_number, cast_count, cast_fingerprint"
register(
    "res3_8_features",
    f"SELECT {FEATURES}, base_category, range_start, range_end, edition_markers, comparison_title, m_multi AS has_title_separator FROM feat",
    lambda f: f.features.withColumn("has_title_separator", F.coalesce("has_title_separator", F.lit(False))),
)
register("res9_references", f"SELECT series_episode_number_key, {FEATURES.replace(' franchise_name,', '')}, comparison_title FROM refs", lambda f: f.refs)
register(
    "res10_classifications",
    f"SELECT {FEATURES}, variant_category, machine_category, classification_source, range_start, range_end, edition_markers, comparison_title FROM cls",
    lambda f: f.classified,
)
LINK = "a AS source_episode_id, b AS target_episode_id, rel AS proposed_relationship, score AS confidence_score, why AS match_reasons"
for _n, _name, _make in (("res11a", "range", variants.range_links), ("res11b", "format", variants.format_links), ("res11c", "story", variants.story_links), ("res11d", "comp", variants.component_links)):
    register(f"{_n}_{_name}_links", f"SELECT {LINK} FROM lk_{_name}", lambda f, make=_make: make(f.classified, f.refs).withColumn("match_reasons", F.to_json("match_reasons")))
register("res11ef_best_links", f"SELECT {LINK} FROM lk_best", lambda f: f.links.withColumn("match_reasons", F.to_json("match_reasons")))
register("res11gh_candidates", "SELECT * FROM cand", lambda f: f.candidates.withColumn("match_reasons", F.to_json("match_reasons")))
register(
    "res12_review_export",
    (
        "SELECT c.*, row_number() OVER (ORDER BY CASE confidence_class WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, variant_category, source_key,"
        " target_episode_number NULLS LAST, candidate_id) AS place, '' AS review_decision, '' AS review_note FROM cand c"
        " WHERE source_episode_id IN (SELECT episode_id FROM cls WHERE series_name = 'Serie  3')"
    ),
    lambda f: variants.review_export(f.candidates, f.classified, "Serie  3").withColumn("place", F.col("place").cast("bigint")),
)
register(
    "res13_review_stats",
    (
        "SELECT 'category' AS kind, variant_category AS value, count(*) AS records FROM cand GROUP BY ALL"
        " UNION ALL SELECT 'relationship', proposed_relationship, count(*) FROM cand GROUP BY ALL UNION ALL SELECT 'confidence', confidence_class, count(*)"
        " FROM cand GROUP BY ALL UNION ALL SELECT 'records', 'all', count(*) FROM cand UNION ALL SELECT 'unresolved', 'all', count(*) FROM cand"
        " WHERE proposed_relationship = 'unresolved'"
    ),
    lambda f: variants.review_stats(f.candidates),
)

# Analytics and browsing.
register("qry1_kpis", f"{KPIS} WHERE release_year BETWEEN 1993 AND 1997", lambda f: marts.kpis(marts.in_years(f.facts, 1993, 1997)))
register(
    "qry2_per_year",
    "SELECT release_year AS year, count(*) AS episode_count FROM facts WHERE release_year >= 1996 GROUP BY 1",
    lambda f: marts.per_year(marts.in_years(f.facts, 1996, None)),
)
register(
    "qry4_top_labels",
    (
        "SELECT label_name, count(DISTINCT series_id) AS series_count, count(*) AS episode_count FROM facts"
        " WHERE label_name IS NOT NULL AND release_year <= 1997 GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10"
    ),
    lambda f: marts.top_labels(f.facts, None, 1997),
)
register(
    "qry5_top_speakers",
    (
        "SELECT speaker_name, episode_count, role_count, credit_count"
        " FROM (SELECT speaker_id, speaker_name, count(DISTINCT episode_id) AS episode_count, count(DISTINCT role_id) AS role_count, count(*) AS credit_count"
        " FROM cred WHERE release_year >= 1994 GROUP BY ALL) ORDER BY episode_count DESC, speaker_name, speaker_id LIMIT 10"
    ),
    lambda f: marts.top_speakers(f.cast_credits, 1994),
)
register(
    "qry6_durations",
    f"SELECT {BUCKETS}, count(*) AS episode_count FROM facts WHERE duration_minutes IS NOT NULL AND release_year BETWEEN 1994 AND 1996 GROUP BY ALL",
    lambda f: marts.duration_distribution(marts.in_years(f.facts, 1994, 1996)),
)
register(
    "qry7_top_franchises",
    (
        "SELECT franchise_name, count(DISTINCT series_id) AS series_count, count(*) AS episode_count FROM facts GROUP BY 1"
        " ORDER BY 3 DESC, 1 NULLS LAST LIMIT 10"
    ),
    lambda f: marts.top_franchises(f.facts),
)
register(
    "qry8_genre_chart",
    (
        'SELECT y.year, coalesce(max(episode_count) FILTER (genre_name = \'Brand#1\'), 0) AS "Brand#1",'
        ' coalesce(max(episode_count) FILTER (genre_name = \'Brand#2\'), 0) AS "Brand#2" FROM (SELECT DISTINCT release_year AS year FROM facts'
        " WHERE release_year IS NOT NULL) y LEFT JOIN yg ON yg.year = y.year GROUP BY 1"
    ),
    lambda f: marts.genre_chart(f.facts, f.genres, ["Brand#1", "Brand#2"]),
)
register(
    "qry9_series_counts",
    "SELECT s.id, s.name, s.label, count(e.id) AS episode_count FROM fx_series s LEFT JOIN fx_episodes e ON e.series_id = s.id GROUP BY ALL",
    lambda f: browse.series_with_counts(f.fx("series"), f.fx("episodes")),
)
BY_SPEAKER = "SELECT e.id AS episode_id, e.title, s.name AS series_name, s.id AS series_id, e.episode_number, e.release_date, e.duration_minutes, e.cover_url, r.name AS role_name FROM fx_episode_speakers l JOIN fx_episodes e ON e.id = l.episode_id JOIN fx_series s ON s.id = e.series_id JOIN fx_roles r ON r.id = l.role_id WHERE l.speaker_id = 7"
register("qry10_by_speaker", BY_SPEAKER, lambda f: browse.episodes_by_speaker(f.fx("episode_speakers"), f.fx("episodes"), f.fx("series"), f.fx("roles"), 7))
register(
    "qry11_speaker_page",
    f"SELECT series_id, series_name, count(*) AS n, string_agg(episode_id || '/' || role_name, ',' ORDER BY episode_number NULLS LAST, episode_id, role_name) AS items FROM ({BY_SPEAKER}) GROUP BY ALL",
    lambda f: browse.speaker_page(browse.episodes_by_speaker(f.fx("episode_speakers"), f.fx("episodes"), f.fx("series"), f.fx("roles"), 7)).withColumn("items", F.array_join(F.transform("items", lambda i: F.concat(i["episode_id"].cast("string"), F.lit("/"), i["role_name"])), ",")),
)
register(
    "qry12_years",
    "SELECT year(release_date) AS year, count(*) AS episode_count FROM fx_episodes WHERE release_date IS NOT NULL GROUP BY 1",
    lambda f: browse.episodes_per_year(f.fx("episodes")),
)
register(
    "qry12_genres",
    (
        "SELECT g.name AS genre_name, count(*) AS episode_count FROM fx_episode_genres l JOIN fx_genres g ON g.id = l.genre_id GROUP BY 1"
        " ORDER BY 2 DESC, 1 LIMIT 10"
    ),
    lambda f: browse.top_genres(f.fx("episode_genres"), f.fx("genres")),
)
register(
    "qry12_labels",
    "SELECT label AS label_name, count(*) AS series_count FROM fx_series WHERE label IS NOT NULL AND label <> '?' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    lambda f: browse.top_series_labels(f.fx("series")),
)
OVERVIEW = "SELECT series_id AS id, max(series_name) AS name, max(label_name) AS label, CAST(sum(episode_count) AS BIGINT) AS episode_count, string_agg(production_line_key || '/' || category_key || '/' || episode_count, ',' ORDER BY production_line_order, category_order) AS category_counts FROM ccnt GROUP BY 1"
cells = lambda df: df.withColumn("category_counts", F.array_join(F.transform("category_counts", lambda c: F.concat_ws("/", c["production_line_key"], c["category_key"], c["episode_count"].cast("string"))), ","))
register("qry13_overview", OVERVIEW, lambda f: cells(browse.series_overview(f.counts)))
register(
    "qry14_facets",
    (
        "SELECT production_line_order, category_order, production_line_key, production_line_label, category_key, category_label, episode_count FROM ccnt"
        " WHERE series_id = 3"
    ),
    lambda f: browse.series_facets(f.of_series(3).counts, 3),
)
register(
    "qry15_categories",
    "SELECT category_key, category_label, category_order, CAST(sum(episode_count) AS BIGINT) AS episode_count FROM ccnt WHERE series_id = 3 GROUP BY ALL",
    lambda f: browse.series_categories(f.of_series(3).counts, 3),
)
EPISODE = "episode_id AS id, episode_title AS title, episode_number, description, release_date, duration_minutes, cover_url, category_key, category_label, variant_category, edition_markers"
register("qry16_series_episodes", f"SELECT {EPISODE} FROM cat WHERE series_id = 3", lambda f: browse.series_episodes(f.of_series(3).catalog, 3))
register(
    "qry16_line_episodes",
    f"SELECT {EPISODE} FROM cat WHERE series_id = 3 AND category_key = 'regular' AND production_line_key = 'line_b'",
    lambda f: browse.series_episodes(f.of_series(3).catalog, 3, "regular", "line_b", by_line=True),
)
register(
    "qry17_facet_totals",
    (
        "SELECT production_line_key, category_key, CAST(sum(episode_count) AS BIGINT) AS episode_count FROM ccnt WHERE series_id = 3"
        " GROUP BY GROUPING SETS ((production_line_key), (category_key), ())"
    ),
    lambda f: browse.facet_totals(f.of_series(3).counts, 3),
)
register(
    "qry17_defaults",
    (
        "SELECT series_id, arg_min(production_line_key, production_line_order) AS production_line_key,"
        " CASE WHEN bool_or(category_key = 'regular') THEN 'regular' ELSE 'all' END AS category_key FROM ccnt GROUP BY 1"
    ),
    lambda f: browse.default_facets(f.counts),
)


def _searched(f: Frames) -> DataFrame:
    """Series whose name contains a text, by an index of trigrams."""
    overview, folder = files.written(browse.series_overview(f.counts), "overview"), f.folder()
    search.build(overview.select("id", "name"), folder)
    return cells(search.containing(overview, folder, "E  1"))


register("qry18_search", f"SELECT * FROM ({OVERVIEW}) WHERE contains(lower(name), 'e  1')", _searched)
DOCS = "SELECT f.episode_id, f.episode_title, f.series_name, f.label_name, coalesce(c.c, '') AS credits, coalesce(g.g, '') AS genres FROM facts f LEFT JOIN (SELECT episode_id, string_agg(speaker_name || '=' || role_name, ';' ORDER BY speaker_name, role_name) AS c FROM cred GROUP BY 1) c ON c.episode_id = f.episode_id LEFT JOIN (SELECT episode_id, string_agg(genre_name, ';' ORDER BY genre_name) AS g FROM egen GROUP BY 1) g ON g.episode_id = f.episode_id"
register(
    "qry19_documents",
    DOCS,
    lambda f: browse.episode_documents(f.facts, f.credits, f.genres).withColumn("credits", F.array_join(F.transform("credits", lambda c: F.concat(c["speaker_name"], F.lit("="), c["role_name"])), ";")).withColumn("genres", F.array_join("genres", ";")),
)

# Cleaning.
register("cln1_2_3_clean_text", "SELECT doc_id, cleaned FROM cln", lambda f: f.fx("text").select("doc_id", tx.clean_text(F.col("raw_text")).alias("cleaned")))
register(
    "cln4_order_numbers",
    f"SELECT id, CASE WHEN upper(order_number) NOT IN ({MEDIUM}) AND length(order_number) >= 5 THEN order_number END AS order_number FROM fx_episodes",
    lambda f: f.fx("episodes").select("id", tx.clean_order_number(F.col("order_number")).alias("order_number")),
)
register(
    "cln5_genres",
    (
        "SELECT episode_id, string_agg(name, ',' ORDER BY name) AS genres FROM fx_episode_genres JOIN fx_genres ON id = genre_id WHERE name <> 'Brand#3'"
        " GROUP BY 1"
    ),
    lambda f: f.fx("episode_genres").join(f.fx("genres"), F.col("id") == F.col("genre_id")).groupBy("episode_id").agg(F.array_sort(F.collect_list(F.concat(F.lit(" "), "name", F.lit(" ")))).alias("g")).select("episode_id", F.array_join(tx.clean_genres(F.concat("g", "g"), ("Brand#3",)), ",").alias("genres")).where("genres <> ''"),
)
register(
    "cln6_7_credits",
    "SELECT l_orderkey AS id, string_agg(role || '=' || speaker, ';' ORDER BY l_linenumber, l_partkey, l_suppkey) AS credits FROM fx_credits_raw GROUP BY 1",
    lambda f: f.nested.where(F.size("speakers") > 0).select("id", F.array_join(F.transform(tx.clean_credits(F.transform("speakers", lambda c: F.struct(F.concat(F.lit(" "), c["role"], F.lit(" ")).alias("role"), c["speaker"].alias("speaker")))), lambda c: F.concat(c["role"], F.lit("="), c["speaker"])), ";").alias("credits")),
)
register("cln8_series_prefix", "SELECT id, name FROM fx_series", lambda f: f.fx("series").select("id", tx.series_name(F.concat(F.lit("Serien: "), "name")).alias("name")))
register(
    "cln9_10_keys",
    f"SELECT DISTINCT speaker, {umlauts('speaker')} AS umlauts, lower({umlauts('speaker')}) AS key FROM fx_credits_raw",
    lambda f: f.fx("credits_raw").select("speaker", tx.umlauts(F.col("speaker")).alias("umlauts"), tx.comparison_key(F.col("speaker")).alias("key")).distinct(),
)
register(
    "cln11_folded",
    "SELECT DISTINCT role, trim(replace(replace(replace(replace(lower(role), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')) AS folded FROM fx_credits_raw",
    lambda f: f.fx("credits_raw").select("role", tx.folded_name(F.col("role")).alias("folded")).distinct(),
)
register("cln12_13_source_keys", "SELECT ord, source_key FROM rk0", lambda f: f.records.select("ord", "source_key"))
register(
    "cln14_search_text",
    "SELECT doc_id, trim(regexp_replace(lower(strip_accents(url)), '[^a-z0-9]+', ' ', 'g')) AS words FROM (SELECT page_id AS doc_id, url FROM pages)",
    lambda f: f.base("pages").select(F.col("page_id").alias("doc_id"), un.search_text(F.col("url")).alias("words")),
)
register(
    "cln15_dates",
    "SELECT id, CAST(release_date AS DATE) AS release_date FROM fx_episodes",
    lambda f: f.fx("episodes").select("id", tx.release_date(F.date_format("release_date", "dd.MM.yyyy")).alias("release_date")),
)

# Duplicates and spellings.
register(
    "ded1_first_by_key",
    "SELECT source_key, series_name, episode_number, title, ord FROM rk0 QUALIFY row_number() OVER (PARTITION BY source_key ORDER BY ord) = 1",
    lambda f: dedup.keep_first(f.records.select("source_key", "series_name", "episode_number", "title", "ord"), ["source_key"], ["ord"]),
)
register(
    "ded2_first_by_url",
    (
        "SELECT ord, source_url FROM (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY ord) AS n FROM fx_records_dup)"
        " WHERE n = 1 OR source_url IS NULL"
    ),
    lambda f: dedup.keep_first_where_known(f.fx("records_dup").select("ord", "source_url"), "source_url", ["ord"]),
)
register(
    "ded3_first_stubs",
    (
        "SELECT ord, source_url FROM (SELECT *, row_number() OVER (PARTITION BY source_url IS NULL, series_name, episode_number, title ORDER BY ord) AS n"
        " FROM fx_records_dup) WHERE n = 1 OR source_url IS NOT NULL"
    ),
    lambda f: dedup.keep_first_stubs(f.fx("records_dup").select("ord", "source_url", "series_name", "episode_number", "title"), "source_url", ["series_name", "episode_number", "title"], ["ord"]).select("ord", "source_url"),
)
ORD = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
register("ded4_speaker_spellings", "SELECT * FROM smap", lambda f: dedup.speaker_spellings(f.fx("credits_raw"), "speaker", ORD))
register("ded5_role_spellings", "SELECT * FROM rmap", lambda f: dedup.role_spellings(f.fx("credits_raw"), "role", ORD))
register(
    "ded6_unified_credits",
    (
        "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(s.canonical, speaker) AS speaker, coalesce(r.canonical, role) AS role FROM cr LEFT"
        " JOIN smap s ON s.spelling = speaker LEFT JOIN rmap r ON r.spelling = role"
    ),
    lambda f: dedup.apply_spellings(dedup.apply_spellings(f.fx("credits_raw"), "speaker", dedup.speaker_spellings(f.fx("credits_raw"), "speaker", ORD)), "role", dedup.role_spellings(f.fx("credits_raw"), "role", ORD)),
)
register(
    "ded7_distinct_links",
    "SELECT DISTINCT l_orderkey, speaker, role FROM fx_credits_raw",
    lambda f: dedup.distinct_links(f.fx("credits_raw"), ["l_orderkey", "speaker", "role"]),
)

# Loading.
register(
    "dim1_series",
    "SELECT series_name AS name, arg_min(label, ord) FILTER (label IS NOT NULL) AS label FROM fx_records_dup GROUP BY 1",
    lambda f: load.series_dimension(f.fx("records_dup"), ["ord"]),
)
register(
    "dim1b_series_first",
    "SELECT series_name AS name, label FROM fx_records_dup QUALIFY row_number() OVER (PARTITION BY series_name ORDER BY ord) = 1",
    lambda f: load.series_dimension(f.fx("records_dup"), ["ord"], prefer_known=False),
)
register(
    "dim2_3_speaker_ids",
    "SELECT row_number() OVER (ORDER BY name) AS id, name FROM (SELECT DISTINCT speaker AS name FROM fx_credits_raw)",
    lambda f: load.with_ids(load.names_of(f.fx("credits_raw"), "speaker")),
)
register(
    "dim4_episode_rows",
    (
        "SELECT ord, s.id AS series_id FROM fx_records_dup r JOIN (SELECT row_number() OVER (ORDER BY series_name) AS id, series_name"
        " FROM (SELECT DISTINCT series_name FROM fx_records_dup)) s ON s.series_name = r.series_name"
    ),
    lambda f: load.episode_rows(f.fx("records_dup").withColumn("release_date", F.lit("01.02.2020")), load.with_ids(f.fx("records_dup").select(F.col("series_name").alias("name")).distinct())).select("ord", "series_id"),
)
register(
    "dim5_link_rows",
    (
        "SELECT DISTINCT l_orderkey AS episode_id, s.id AS speaker_id, r.id AS role_id FROM fx_credits_raw c"
        " JOIN (SELECT row_number() OVER (ORDER BY name) AS id, name FROM (SELECT DISTINCT speaker AS name FROM fx_credits_raw)) s ON s.name = speaker"
        " JOIN (SELECT row_number() OVER (ORDER BY name) AS id, name FROM (SELECT DISTINCT role AS name FROM fx_credits_raw)) r ON r.name = role"
    ),
    lambda f: load.link_rows(f.fx("credits_raw").select(F.concat(F.lit("cat:episode:"), F.col("l_orderkey").cast("string")).alias("source_key"), "speaker", "role"), f.fx("episodes"), load.dimensions(f.fx("credits_raw"), ["speaker", "role"])),
)
TABLES = ("series", "episodes", "speakers", "roles", "genres", "episode_speakers", "episode_genres")
register(
    "dim6_manifest",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM fx_{t}" for t in TABLES),
    lambda f: load.manifest({t: f.fx(t) for t in TABLES}),
)
register(
    "dim7_mismatches",
    "SELECT 'genres' AS table_name, count(*) AS expected, count(*) - 1 AS actual FROM fx_genres UNION ALL SELECT 'series', count(*), NULL FROM fx_series",
    lambda f: load.mismatches(load.manifest({t: f.fx(t) for t in ("genres", "roles", "series")}), load.manifest({"genres": f.fx("genres").where("id <> 1"), "roles": f.fx("roles")})),
)
register(
    "dim8_seed",
    (
        "SELECT external_id, status, attempts FROM fx_targets UNION ALL SELECT i, 'pending', 0 FROM range(1, (SELECT count(*) FROM events) + 1) t(i)"
        " WHERE i NOT IN (SELECT external_id FROM fx_targets)"
    ),
    lambda f: load.insert_missing(f.fx("targets"), load.seed_targets(f.spark, f.base("events").count(), "site"), ["external_id"]),
)
register("dim9_pending", "SELECT * FROM fx_targets ORDER BY external_id LIMIT 20", lambda f: load.pending(f.fx("targets"), 20))
LEDGER = "SELECT t.external_id, CASE WHEN o.external_id IS NULL THEN t.status WHEN o.error_message IS NOT NULL THEN 'error' ELSE o.status END AS status, t.attempts + CASE WHEN o.external_id IS NULL THEN 0 ELSE 1 END AS attempts, o.error_message FROM fx_targets t LEFT JOIN (SELECT external_id, status, error_message FROM fx_outcomes QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY event_id DESC) = 1) o ON o.external_id = t.external_id"
register("dim10_outcomes", LEDGER, lambda f: load.apply_outcomes(f.fx("targets"), f.fx("outcomes"), "event_id"))
register("dim11_outcome_counts", "SELECT status, count(*) AS n FROM fx_outcomes GROUP BY 1", lambda f: load.outcome_counts(f.fx("outcomes")))


def _upserted(f: Frames) -> DataFrame:
    """Roles in a keyed table, of which a change writes the buckets that it touches."""
    table = KeyedTable(f.spark, f.folder(), StructType.fromDDL("id bigint, name string"), ["id"], 16)
    table.upsert(f.fx("roles").select("id", "name"))
    table.upsert(f.fx("roles").where("id % 3 = 0").select("id", F.upper("name").alias("name")))
    return table.read()


register("snk3_upsert", "SELECT id, name FROM fx_roles WHERE id % 3 <> 0 UNION ALL SELECT id, upper(name) FROM fx_roles WHERE id % 3 = 0", _upserted)

# Checks over own outputs, and over broken copies.
OK = lambda *names: " UNION ALL ".join(f"SELECT '{n}' AS check_name, 0 AS violations" for n in names)
register(
    "val1_records",
    (
        "SELECT 'arrays_present' AS check_name, 0 AS violations UNION ALL SELECT 'no_replacement_character', 0 UNION ALL SELECT 'key_present', count(*)"
        " FROM fx_episodes WHERE id % 50 = 0 UNION ALL SELECT 'not_empty', 0 UNION ALL SELECT 'unique_source_key', CASE WHEN count(*) > 1 THEN 1 ELSE 0 END"
        " FROM fx_episodes WHERE id % 50 = 0 UNION ALL SELECT 'unique_source_url', 0"
    ),
    lambda f: quality.check_records(f.nested.withColumn("source_key", F.when(F.col("id") % 50 == 0, "").otherwise(F.col("source_key")))),
)
STUB = "description IS NULL AND duration_minutes IS NULL AND release_date IS NULL AND nullif(trim(s.label), '') IS NULL AND e.id % 4 = 0"
NAMED = "(SELECT c.* FROM fx_credits_raw c WHERE l_orderkey % 4 <> 0)"
register(
    "val2_record_stats",
    f"""SELECT (SELECT count(*) FROM fx_episodes) AS records, (SELECT count(*) FROM fx_episodes e JOIN fx_series s ON s.id = e.series_id WHERE {STUB}) AS stubs,
      (SELECT count(DISTINCT speaker) FROM {NAMED}) AS speakers, (SELECT count(DISTINCT role) FROM {NAMED}) AS roles, (SELECT count(DISTINCT genre_id) FROM fx_episode_genres WHERE episode_id % 4 <> 0) AS genres""",
    lambda f: quality.record_stats(f.nested.withColumns({c: F.when(F.col("id") % 4 != 0, F.col(c)).otherwise(F.array().cast(f.nested.schema[c].dataType)) for c in ("speakers", "genres")})),
)
register(
    "val3_preflight",
    (
        "SELECT 'title_and_series' AS check_name, count(*) AS violations FROM fx_episodes WHERE id % 7 = 0 UNION ALL SELECT 'date_valid', count(*)"
        " FROM fx_episodes WHERE id % 11 = 0 UNION ALL SELECT 'credits_complete', 0"
    ),
    lambda f: quality.check_load(f.nested.withColumn("series_name", F.when(F.col("id") % 7 != 0, "s")).withColumn("release_date", F.when(F.col("id") % 11 == 0, "31.02.2020").otherwise("01.02.2020")), tx.release_date(F.col("release_date"))),
)
register("val4_candidates", OK("id_present", "score_in_range", "unique_candidate_id"), lambda f: quality.check_candidates(f.candidates))
register(
    "val5_not_null_unique",
    (
        "SELECT 'not_null_title' AS check_name, 0 AS violations UNION ALL SELECT 'not_null_episode_number', count(*) FROM fx_episodes"
        " WHERE episode_number IS NULL UNION ALL SELECT 'unique_source_url', 0 UNION ALL SELECT 'unique_title', count(*) FROM (SELECT title FROM fx_episodes"
        " GROUP BY 1 HAVING count(*) > 1)"
    ),
    lambda f: quality.together(quality.not_null(f.fx("episodes"), "title", "episode_number"), quality.unique(f.fx("episodes"), "source_url"), quality.unique(f.fx("episodes"), "title")),
)
register(
    "val6_relationships",
    (
        "SELECT 'relationship_episode_id' AS check_name, 0 AS violations UNION ALL SELECT 'relationship_genre_id', count(*) FROM fx_episode_genres"
        " WHERE genre_id = 5"
    ),
    lambda f: quality.together(quality.relationship(f.fx("episode_speakers"), "episode_id", f.fx("episodes"), "id"), quality.relationship(f.fx("episode_genres"), "genre_id", f.fx("genres").where("id <> 5"), "id")),
)
register(
    "val7_accepted",
    "SELECT 'accepted_review_decision' AS check_name, count(*) AS violations FROM fx_reviews WHERE review_decision = 'reject'",
    lambda f: quality.accepted(f.fx("reviews"), "review_decision", ["accept"]),
)
register(
    "val8_9_counts",
    f"{OK('episode_count', 'kpis')} UNION ALL SELECT 'kpis_of_some', 1",
    lambda f: quality.together(
        quality.same_count("episode_count", f.fx("episodes"), f.facts), quality.kpis_match("kpis", marts.kpis(f.facts), f.facts),
        quality.kpis_match("kpis_of_some", marts.kpis(f.facts.where("series_id <> 3")), f.facts)),
)
register(
    "val10_complete",
    (
        "SELECT 'catalog_complete' AS check_name, 0 AS violations UNION ALL SELECT 'genres_complete', count(*) FROM facts"
        " WHERE episode_id NOT IN (SELECT episode_id FROM egen)"
    ),
    lambda f: quality.together(quality.complete("catalog_complete", f.facts.select("episode_id"), f.catalog.select("episode_id"), "episode_id"), quality.complete("genres_complete", f.facts.select("episode_id"), f.genres.select("episode_id").distinct(), "episode_id")),
)
CELL = ["series_id", "production_line_key", "category_key", "episode_count"]
cells_of = lambda df: df.groupBy(*CELL[:3]).agg(F.count("*").alias("episode_count"))
register(
    "val11_counts_match",
    f"{OK('category_counts')} UNION ALL SELECT 'counts_of_some', 2 * count(*) FILTER (category_key = 'regular' AND episode_count > 1) + count(*) FILTER (category_key = 'regular' AND episode_count = 1) FROM ccnt",
    lambda f: quality.together(
        quality.same_groups("category_counts", cells_of(f.catalog), f.counts, CELL),
        quality.same_groups("counts_of_some", cells_of(f.catalog), f.counts.withColumn("episode_count", F.col("episode_count") - (F.col("category_key") == "regular").cast("int")).where("episode_count > 0"), CELL)),
)
register(
    "val12_reviews",
    f"""{OK('reviews_consistent', 'reviews_applied')}
      UNION ALL SELECT 'reviews_consistent', count(*) FROM over UNION ALL SELECT 'reviews_applied', count(*) FROM over WHERE CAST(split_part(source_key, ':', 3) AS BIGINT) % 2 = 0""",
    lambda f: quality.together(
        quality.consistent_reviews(f.fx("reviews")), quality.applied_reviews(f.fx("reviews"), f.classified),
        quality.consistent_reviews(f.fx("reviews").unionByName(f.fx("reviews").withColumns({"reviewed_category": F.lit("box_set"), "reviewed_markers": F.concat("reviewed_markers", F.lit("x"))}).where("reviewed_category <> '' or reviewed_markers <> ''"))),
        quality.applied_reviews(f.fx("reviews"), f.classified.withColumn("classification_source", F.when(F.col("episode_id") % 2 == 0, "machine").otherwise(F.col("classification_source"))))),
)
register(
    "val13_links",
    f"""{OK('links_in_series', 'unresolved_without_target', 'productions_not_same_recording', 'score_fits_class', 'durations_not_negative')}
      UNION ALL SELECT 'links_in_series', count(*) FROM cand WHERE target_episode_id IS NOT NULL
      UNION ALL SELECT 'unresolved_without_target', count(*) FROM cand WHERE proposed_relationship = 'unresolved'
      UNION ALL SELECT 'productions_not_same_recording', count(*) FROM cand WHERE variant_category IN ('film_adaptation', 'live_production', 'other_production')
      UNION ALL SELECT 'score_fits_class', count(*) FROM cand
      UNION ALL SELECT 'durations_not_negative', count(*) FROM facts WHERE duration_minutes > 0 AND episode_id % 3 = 0""",
    lambda f: _checked_links(f),
)


def _checked_links(f: Frames) -> DataFrame:
    """The checks of links and durations, on what is there and on wrong rows. Candidates are read four times, so what is checked is written once."""
    sources, refs = f.linked
    found = files.written(f.candidates.select("source_episode_id", "target_episode_id", "variant_category", "proposed_relationship", "confidence_score", "confidence_class"), "candidates")
    negative = F.when(F.col("episode_id") % 3 == 0, -F.col("duration_minutes")).otherwise(F.col("duration_minutes"))
    return quality.together(
        quality.check_links(found, sources, refs), quality.durations_not_negative(f.facts),
        quality.check_links(
            found.withColumns({"proposed_relationship": F.lit("same_recording"), "confidence_score": F.lit(101)}),
            sources.withColumn("series_id", -F.col("series_id")), refs.withColumn("series_id", F.col("series_id") + 1)),
        quality.durations_not_negative(f.facts.withColumn("duration_minutes", negative)))


# The spot checks, on series, titles and lines that the derived tables have; three hold and the others don't.
SPOT = """
SELECT 'only_numbers' AS check_name, CAST(count(*) FILTER (NOT episode_number BETWEEN 1 AND 8) + CASE WHEN count(*) <> 8 THEN 1 ELSE 0 END AS BIGINT) AS violations FROM cat WHERE series_name = 'Serie  3' AND category_key = 'regular'
UNION ALL SELECT 'range_links', CASE WHEN n = 3 AND low = 1 AND high = 3 THEN 0 ELSE 1 END FROM (SELECT count(*) AS n, min(target_episode_number) AS low, max(target_episode_number) AS high FROM cand
  WHERE proposed_relationship = 'contains' AND source_episode_id = (SELECT min(episode_id) FROM cls WHERE lower(episode_title) LIKE 'fanbox (folgen 01-%03)'))
UNION ALL SELECT 'edition_link', CASE WHEN n = 1 AND low = 2 AND high = 2 THEN 0 ELSE 1 END FROM (SELECT count(*) AS n, min(target_episode_number) AS low, max(target_episode_number) AS high FROM cand
  WHERE proposed_relationship = 'same_recording' AND source_episode_id = (SELECT min(episode_id) FROM cls WHERE lower(episode_title) LIKE 'und der schatz 2 (lp-edition)'))
UNION ALL SELECT 'parts_are_no_collections', count(*) FROM cls WHERE series_name = 'Serie  3' AND regexp_matches(lower(episode_title), '(teil\\s*)?[0-9]+\\s*/\\s*[0-9]+') AND variant_category IN ('box_set', 'compilation')
  AND NOT contains(edition_markers, 'container') AND NOT contains(edition_markers, 'compilation')
UNION ALL SELECT 'lines_applied', (SELECT count(*) FROM cat LEFT JOIN fx_lines m USING (source_key) WHERE series_name = 'Serie  7' AND coalesce(m.production_line_key, 'main') <> cat.production_line_key)
  + CASE WHEN (SELECT count(*) FROM cat WHERE series_name = 'Serie  7' AND production_line_key = 'line_b') <> (SELECT count(*) FROM fx_lines WHERE source_key IN (SELECT source_key FROM facts WHERE series_name = 'Serie  7')) THEN 1 ELSE 0 END
"""


def _spot_checks(f: Frames) -> DataFrame:
    mine = f.fx("lines").join(f.facts.where("series_name = 'Serie  7'").select("source_key"), "source_key", "left_semi")
    classified = f.classified  # the catalog is made of it then
    return quality.together(
        quality.only_numbers(f.catalog, "Serie  3", "regular", 1, 8),
        quality.links_of_title("range_links", f.candidates, classified, "fanbox (folgen 01-%03)", "contains", (3, 1, 3)),
        quality.links_of_title("edition_link", f.candidates, classified, "und der schatz 2 (lp-edition)", "same_recording", (1, 2, 2)),
        quality.parts_are_no_collections(classified, "Serie  3", variants.PART_NUMBERS),
        quality.lines_applied(f.catalog, mine, "Serie  7", "main", "line_b"),
    )


register("val14_spot_checks", SPOT, _spot_checks)
register(
    "val15_by_status",
    "SELECT 'pass' AS status, 1 AS n UNION ALL SELECT 'fail', 1",
    lambda f: quality.by_status(quality.not_null(f.fx("episodes"), "title", "episode_number")),
)

# Retrieval.
register(
    "vec1_to_embed",
    "SELECT id FROM fx_episodes WHERE description IS NOT NULL AND id % 3 = 0",
    lambda f: retrieval.to_embed(f.fx("episodes").withColumn("embedding", F.when(F.col("id") % 3 != 0, F.array(F.lit(1.0))))).select("id"),
)
TEXTS = "SELECT f.episode_id, concat_ws(' | ', CASE WHEN f.episode_title <> '' THEN 'Titel: ' || f.episode_title END, 'Serie: ' || f.series_name, CASE WHEN f.description <> '' THEN 'Beschreibung: ' || f.description END, 'Genre: ' || g.g, 'Sprecher: ' || c.c) AS text FROM facts f LEFT JOIN (SELECT episode_id, string_agg(genre_name, ', ' ORDER BY genre_name) AS g FROM egen GROUP BY 1) g ON g.episode_id = f.episode_id LEFT JOIN (SELECT episode_id, string_agg(DISTINCT speaker_name, ', ' ORDER BY speaker_name) AS c FROM cred GROUP BY 1) c ON c.episode_id = f.episode_id"
register(
    "vec2_3_texts",
    TEXTS,
    lambda f: retrieval.embedding_text(browse.episode_documents(f.facts, f.credits, f.genres).join(f.facts.select("episode_id", "description"), "episode_id").select("episode_id", F.col("episode_title").alias("title"), "series_name", "description", "genres", F.transform("credits", lambda c: c["speaker_name"]).alias("speakers"))),
)
register(
    "vec4_write_back",
    "SELECT vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN label ELSE 1 END AS first_value FROM embeddings",
    lambda f: retrieval.write_back(f.base("embeddings").select(F.col("vec_id").alias("id"), F.array(F.lit(1.0).cast("float")).alias("embedding")), f.base("embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("episode_id"), F.array(F.col("label").cast("float")).alias("embedding"))).select("id", F.element_at("embedding", 1).cast("int").alias("first_value")),
)



def _refusing(*endings: str) -> Callable[[list[str]], list[list[float]]]:
    """A stand-in for the model: a call with a text of such an ending fails."""

    def call(texts: list[str]) -> list[list[float]]:
        if any(t.endswith(endings) for t in texts):
            raise OSError("refused")
        return [[float(len(t))] for t in texts]

    return call


def _ledger(f: Frames) -> DataFrame:
    """Texts are embedded twice; what failed at first is tried again, and only that."""
    texts = f.fx("episodes").select(F.col("id").alias("episode_id"), F.concat(F.lit("Text "), F.col("id").cast("string")).alias("text"))
    ledger = KeyedTable(f.spark, f.folder(), StructType.fromDDL(retrieval.ATTEMPTS), ["episode_id"], 16)
    retrieval.embed_into(ledger, texts, _refusing("7"))
    retrieval.embed_into(ledger, texts, _refusing("77"))
    return ledger.read().select("episode_id", F.element_at("embedding", 1).cast("int").alias("first_value"), "error", "attempt")


register(
    "vec4_ledger",
    (
        "SELECT id AS episode_id, CASE WHEN id % 100 <> 77 THEN length('Text ' || id) END AS first_value,"
        " CASE WHEN id % 100 = 77 THEN 'OSError: refused' END AS error, CASE WHEN id % 10 = 7 THEN 2 ELSE 1 END AS attempt FROM fx_episodes"
    ),
    _ledger,
)

def _query_vector(f: Frames) -> list[float]:
    return list(f.base("embeddings").where("vec_id = 0").select("embedding").first()[0])


SIMILAR = "SELECT e.vec_id AS id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"
register(
    "vec5_nearest",
    f"{SIMILAR} ORDER BY similarity DESC, 1 LIMIT 10",
    lambda f: retrieval.nearest(f.base("embeddings").select(F.col("vec_id").alias("id"), "embedding"), _query_vector(f)).withColumn("similarity", F.round("similarity", 6)),
)
register(
    "vec5_nearest_filtered",
    f"{SIMILAR} WHERE e.label = 3 ORDER BY similarity DESC, 1 LIMIT 10",
    lambda f: retrieval.nearest(f.base("embeddings").select(F.col("vec_id").alias("id"), "embedding"), _query_vector(f), 10, f.base("embeddings").where("label = 3").select(F.col("vec_id").alias("id"))).withColumn("similarity", F.round("similarity", 6)),
)
register(
    "vec6_nearest_of_each",
    (
        "SELECT query_id, id, similarity, rank"
        " FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])),"
        " 6) AS similarity, row_number() OVER (PARTITION BY q.vec_id"
        " ORDER BY list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, e.vec_id) AS rank FROM embeddings e"
        " JOIN embeddings q ON q.vec_id % 50 = 7) WHERE rank <= 10"
    ),
    lambda f: retrieval.nearest_of_each(f.base("embeddings").select(F.col("vec_id").alias("id"), "embedding"), f.base("embeddings").where("vec_id % 50 = 7").select(F.col("vec_id").alias("query_id"), "embedding")).withColumn("similarity", F.round("similarity", 6)),
)
NEAREST = """SELECT q.vec_id AS query_id, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 12) DESC, e.vec_id) AS place
  FROM embeddings e JOIN embeddings q ON q.vec_id % 50 = 7"""
HIT = "concat_ws(chr(10), concat_ws(' | ', '**' || episode_title || '**', 'Serie: ' || series_name, 'Folge ' || episode_number, '(' || release_year || ')'), description)"


def _contexts(f: Frames) -> DataFrame:
    vectors = f.base("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    near = retrieval.nearest_of_each(vectors, f.base("embeddings").where("vec_id % 50 = 7").select(F.col("vec_id").alias("query_id"), "embedding"))
    hits = near.select("query_id", F.col("id").alias("episode_id"), F.col("rank").alias("place")).join(f.facts, "episode_id")
    return retrieval.context(retrieval.hit_context(hits))


register(
    "vec7_context",
    f"SELECT query_id, string_agg({HIT}, chr(10) || chr(10) ORDER BY place) AS context FROM ({NEAREST}) n JOIN facts ON episode_id = n.id WHERE place <= 10 GROUP BY 1",
    _contexts,
)

# Coverage.
register("cov1_candidates", "SELECT probe_key, pos, collection_id FROM api1", lambda f: coverage.candidates(f.fx("api"), f.probes).select("probe_key", "pos", "collection_id"))
register("cov2_last", "SELECT probe_key, collection_id, pos FROM api2", lambda f: f.found.select("probe_key", "collection_id", "pos"))
register("cov3_report", "SELECT * FROM report", lambda f: coverage.probe_report(f.fx("api"), f.found))
register(
    "cov4_examples",
    (
        "SELECT probe_key, CAST(n AS INTEGER) AS nth, collection_id, collection_name FROM (SELECT *, row_number() OVER (PARTITION BY probe_key"
        " ORDER BY collection_id) AS n FROM api2) WHERE n <= 5"
    ),
    lambda f: coverage.examples(f.found),
)
register(
    "cov5_summary",
    "SELECT " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("returned", "candidates", "numbered", "distinct_numbers", "duplicate_titles")) + ", count(*) AS probes, count(*) FILTER (limit_reached) AS probes_at_limit FROM report",
    lambda f: coverage.summary(coverage.probe_report(f.fx("api"), f.found)),
)
ROWS = "concat_ws('|', coalesce(CAST(candidates AS VARCHAR), ''), coalesce(CAST(distinct_numbers AS VARCHAR), ''), coalesce(CAST(duplicate_titles AS VARCHAR), ''), coalesce(CAST(earliest_year AS VARCHAR), ''), coalesce(CAST(latest_year AS VARCHAR), ''), coalesce(CAST(limit_reached AS VARCHAR), ''), coalesce(CAST(numbered AS VARCHAR), ''), probe_key, CAST(returned AS VARCHAR))"
register(
    "cov5_hash",
    f"SELECT sha256(string_agg(h, '' ORDER BY h)) AS content_hash FROM (SELECT sha256(string_agg(h, '' ORDER BY h)) AS h FROM (SELECT sha256({ROWS}) AS h FROM report) GROUP BY left(h, 3))",
    lambda f: coverage.content_hash(coverage.probe_report(f.fx("api"), f.found)),
)
COVERS = "SELECT e.id, c.cover_url, CASE WHEN s.series_name IS NULL THEN 'skipped' WHEN c.cover_url IS NULL THEN 'not_found' ELSE 'found' END AS outcome FROM fx_episodes e LEFT JOIN st_series s ON s.series_id = e.series_id LEFT JOIN (SELECT * FROM fx_cover_candidates WHERE score >= 80 QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY score DESC, pos, release_id) = 1) c ON c.episode_id = e.id"
covered = lambda f: coverage.fill_covers(f.fx("episodes").join(marts.stage_series(f.fx("series")).select("series_id", "series_name"), "series_id", "left"), f.fx("cover_candidates"))
register("cov6_covers", COVERS, covered)
register(
    "cov6_stats",
    f"SELECT count(*) FILTER (outcome <> 'skipped') AS checked, count(*) FILTER (outcome = 'found') AS found, count(*) FILTER (outcome = 'not_found') AS not_found, count(*) FILTER (outcome = 'skipped') AS skipped FROM ({COVERS})",
    lambda f: coverage.cover_stats(covered(f)),
)

# Profiles.
register(
    "eda1_flatten",
    (
        "SELECT e.id, e.title, CAST(coalesce(c.n, 0) AS INTEGER) AS n_speakers, CAST(coalesce(g.n, 0) AS INTEGER) AS n_genres FROM fx_episodes e LEFT"
        " JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) c ON c.l_orderkey = e.id LEFT JOIN (SELECT episode_id, count(*) AS n"
        " FROM fx_episode_genres GROUP BY 1) g ON g.episode_id = e.id"
    ),
    lambda f: profile.flatten(f.nested.select("id", "title", "speakers", "genres")),
)
register(
    "eda2_missing",
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS missing, round(100 * count(*) FILTER ({c} IS NULL) / count(*), 1) AS percent FROM fx_episodes" for c in ("title", "description", "duration_minutes", "release_date", "episode_number")),
    lambda f: profile.missing(f.fx("episodes").select("title", "description", "duration_minutes", "release_date", "episode_number")),
)
register(
    "eda3_top_series",
    "SELECT series_name AS value, count(*) AS n FROM facts WHERE series_name IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    lambda f: profile.value_counts(f.facts, "series_name", 20),
)
register("eda3_roles", "SELECT role AS value, count(*) AS n FROM fx_credits_raw GROUP BY 1", lambda f: profile.value_counts(f.fx("credits_raw"), "role"))
register(
    "eda3_singletons",
    "SELECT count(*) AS \"values\", count(*) FILTER (n = 1) AS singletons FROM (SELECT title, count(*) AS n FROM fx_episodes GROUP BY 1)",
    lambda f: profile.singletons(f.fx("episodes"), "title"),
)
register(
    "eda4_dates",
    (
        "SELECT count(*) FILTER (id % 17 = 0) AS missing, count(*) FILTER (id % 17 <> 0 AND id % 5 = 0) AS failed,"
        " count(*) FILTER (id % 17 <> 0 AND id % 5 <> 0) AS parsed FROM fx_episodes"
    ),
    lambda f: profile.date_quality(f.fx("episodes").select(F.when(F.col("id") % 5 == 0, F.date_format("release_date", "yyyy-MM-dd")).otherwise(F.date_format("release_date", "dd.MM.yyyy")).alias("d")), "d"),
)
register(
    "eda5_durations",
    (
        "SELECT count(duration_minutes) AS n, round(avg(duration_minutes), 6) AS mean, round(stddev_samp(duration_minutes), 6) AS std,"
        " min(duration_minutes) AS least, quantile_cont(duration_minutes, 0.25) AS q1, quantile_cont(duration_minutes, 0.5) AS median,"
        " quantile_cont(duration_minutes, 0.75) AS q3, max(duration_minutes) AS most FROM fx_episodes"
    ),
    lambda f: profile.duration_summary(f.fx("episodes")).withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6)),
)
register(
    "eda5_outliers",
    "SELECT id, duration_minutes FROM fx_episodes WHERE duration_minutes < 5 OR duration_minutes > 180",
    lambda f: profile.duration_outliers(f.fx("episodes")).select("id", "duration_minutes"),
)
register(
    "eda6_variants",
    "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY key) AS k FROM (SELECT trim(replace(replace(replace(replace(lower(role), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')) AS key, role AS spelling, count(*) AS n FROM fx_credits_raw GROUP BY ALL)) WHERE k > 1".replace("SELECT * FROM (SELECT *, count", "SELECT key, spelling, n FROM (SELECT *, count"),
    lambda f: profile.spelling_variants(f.fx("credits_raw"), "role"),
)
register(
    "eda7_whitespace",
    r"SELECT id, name FROM fx_series WHERE regexp_matches(name, '^\s|\s$|\s{2,}')",
    lambda f: profile.whitespace_problems(f.fx("series"), "name").select("id", "name"),
)
register(
    "eda8_quality",
    (
        "SELECT count(*) AS records, count(*) FILTER (release_date IS NULL) AS no_release_date, count(*) FILTER (description IS NULL) AS no_description,"
        " count(*) FILTER (duration_minutes IS NULL) AS no_duration_minutes, count(*) FILTER (episode_number IS NULL) AS no_episode_number,"
        " count(*) FILTER (id NOT IN (SELECT l_orderkey FROM lineitem)) AS no_speakers, count(*) FILTER (id NOT IN (SELECT episode_id"
        " FROM fx_episode_genres)) AS no_genres FROM fx_episodes"
    ),
    lambda f: profile.quality_summary(profile.flatten(f.nested)),
)

# Pages: made from the catalog, read back, and compared with the catalog.


def _list_pages(f: Frames) -> DataFrame:
    e = f.fx("episodes").join(f.fx("series").select(F.col("id").alias("series_id"), F.trim("name").alias("sname")), "series_id")
    linked = F.concat(F.lit('<a href="hsp_anzeige.asp?code='), F.col("id").cast("string"), F.lit('">'), "title", F.lit("</a>"))
    cell = F.when(F.col("id") % 10 == 0, F.col("title")).otherwise(linked)
    row = F.concat(F.lit('<tr><td><a href="hsp_serie.asp?serie='), F.col("series_id").cast("string"), F.lit('">Serien: '), "sname", F.lit("</a></td><td>"), F.coalesce(F.col("episode_number").cast("string"), F.lit("-")), F.lit("</td><td>"), cell, F.lit("</td></tr>"))
    rows = F.array_sort(F.collect_list(F.struct("id", row.alias("row"))))
    return e.groupBy("series_id").agg(rows.alias("rows")).select(F.concat(F.lit("page_"), F.lpad(F.col("series_id").cast("string"), 9, "0")).alias("page"), F.concat(F.lit("<table>"), F.array_join(F.transform("rows", lambda r: r["row"]), "\n"), F.lit("</table>")).alias("html"))


def _detail_pages(f: Frames) -> DataFrame:
    e = f.nested_in_series.where("sname is not null and trim(title) <> ''")
    text = lambda x: F.lit(x) if isinstance(x, str) else F.coalesce(x.cast("string"), F.lit("-"))
    link = lambda code, shown: F.concat(F.lit('<a href="hsp_anzeige.asp?code='), code.cast("string"), F.lit('">'), text(shown), F.lit("</a>"))
    opt = lambda before, value, after: F.coalesce(F.concat(F.lit(before), value.cast("string"), F.lit(after)), F.lit(""))
    credit = F.array_join(F.transform("speakers", lambda c: F.concat(F.lit("<tr><td></td><td>"), c["role"], F.lit("</td><td></td><td>"), c["speaker"], F.lit("</td></tr>"))), "")
    genre = F.array_join(F.transform("genres", lambda g: F.concat(F.lit("<tr><td>- "), g, F.lit("</td></tr>"))), "")
    code = F.col("id")
    around = F.concat(F.when(code % 12 == 0, F.lit("<b>Keine Folge davor</b>")).otherwise(F.lit("")), link(code - 1, "zurück"), link(code + 1, "weiter"))
    html = F.concat(
        F.when(code % 2 == 0, F.concat(F.lit('<img src="bilder/bilder/'), code.cast("string"), F.lit('.jpg">'))).otherwise(F.lit("")),
        F.lit(f'<table background="{extract.DETAIL_BACKGROUND}"><tr><td width="75%" align="left" valign="top"><a href="hsp_serie.asp?serie='), F.col("series_id").cast("string"), F.lit('">'), "sname", F.lit("</a>"),
        link(code, F.col("episode_number")), link(code, F.col("title")), around, opt('<a href="hsp_serienanzeige.asp?verlag=1">', F.col("label"), "</a>"), F.lit("</td>"),
        F.lit('<td width="35%" align="justify" valign="top">'), opt('<span class="t4_bold">Beschreibung:</span><span class="t5">', F.col("description"), "</span>"), opt(" Dauer: ", F.col("duration_minutes"), " Minuten "),
        opt(" vom ", F.date_format("release_date", "dd.MM.yyyy"), " "), F.lit(" Bestellnummer: "), "order_number", F.lit('</td><td width="35%" align="left" valign="top"><table>'), credit, F.lit("</table></td></tr></table><table>"), genre, F.lit("</table>"))
    name = tx.page_file_name(F.concat(F.lit(BASE_URL + "hsp_anzeige.asp?code="), F.col("id").cast("string")))
    return e.select("id", name.alias("page"), html.alias("html"))


LISTED = "SELECT page, series_name, episode_number, title, url FROM listed"
register("ext1_list_pages", LISTED, lambda f: extract.parse_list_pages(_list_pages(f), BASE_URL).select("page", "series_name", "episode_number", "title", "url"))
FROM_PAGE = """nullif(trim(s.label), '') AS label, CASE WHEN e.id % 2 = 0 THEN 'https://x.test/bilder/bilder/' || e.id || '.jpg' END AS cover_url,
  CASE WHEN e.id % 12 <> 0 THEN 'https://x.test/hsp_anzeige.asp?code=' || (e.id - 1) END AS previous_episode_url, 'https://x.test/hsp_anzeige.asp?code=' || (e.id + 1) AS next_episode_url"""
DETAILED = f"SELECT e.id, trim(e.title) AS title, trim(s.name) AS series_name, e.episode_number, trim(e.description) AS description, e.duration_minutes, strftime(e.release_date, '%d.%m.%Y') AS release_date, e.order_number, {FROM_PAGE}, coalesce(c.c, '') AS credits, coalesce(g.g, '') AS genres, 'https://x.test/hsp_anzeige.asp?code=' || e.id AS source_url FROM fx_episodes e JOIN fx_series s ON s.id = e.series_id LEFT JOIN (SELECT l_orderkey, string_agg(role || '=' || speaker, ';' ORDER BY l_linenumber, l_partkey, l_suppkey) AS c FROM fx_credits_raw GROUP BY 1) c ON c.l_orderkey = e.id LEFT JOIN (SELECT episode_id, string_agg(name, ';' ORDER BY name) AS g FROM fx_episode_genres JOIN fx_genres ON id = genre_id GROUP BY 1) g ON g.episode_id = e.id WHERE trim(e.title) <> ''"
joined_names = lambda df: df.withColumn("credits", F.array_join(F.transform("speakers", lambda c: F.concat(c["role"], F.lit("="), c["speaker"])), ";")).withColumn("genres", F.array_join("genres", ";"))
register(
    "ext2_detail_pages",
    DETAILED,
    lambda f: joined_names(extract.parse_detail_pages(_detail_pages(f), BASE_URL)).withColumn("id", tx.episode_code(F.col("source_url"))).select("id", "title", "series_name", "episode_number", "description", "duration_minutes", "release_date", "order_number", "label", "cover_url", "previous_episode_url", "next_episode_url", "credits", "genres", "source_url"),
)
FILE_NAME = "left(lower(trim(regexp_replace(url, '[^a-zA-Z0-9]+', '_', 'g'), '_')), 80) || '_' || left(sha1(url), 10) || '.html'"
register("ext3_file_names", f"SELECT url, {FILE_NAME} AS file_name FROM pages", lambda f: f.base("pages").select("url", tx.page_file_name(F.col("url")).alias("file_name")))
register(
    "ext4_codes",
    "SELECT id, id AS from_url, id AS from_name FROM fx_episodes",
    lambda f: f.fx("episodes").select("id", tx.episode_code(F.col("source_url")).alias("from_url"), tx.page_code(F.concat(F.lit("hsp_code_"), F.col("id").cast("string"), F.lit("_ab.html"))).alias("from_name")),
)
register(
    "ext5_targets",
    f"SELECT CAST(regexp_extract(url, 'code=(.*)', 1) AS BIGINT) AS episode_code, page, 'pending' AS status FROM ({LISTED}) WHERE url IS NOT NULL",
    lambda f: extract.detail_targets(extract.parse_list_pages(_list_pages(f), BASE_URL)),
)
OUTCOME = "CASE WHEN url IS NULL THEN 'stub_without_link' WHEN CAST(regexp_extract(url, 'code=(.*)', 1) AS BIGINT) % 9 = 0 THEN 'stub_missing_html' WHEN CAST(regexp_extract(url, 'code=(.*)', 1) AS BIGINT) % 7 = 0 THEN 'stub_parse_error' ELSE 'with_detail' END"
matched = lambda f: extract.match_details(extract.parse_list_pages(_list_pages(f), BASE_URL), extract.parse_detail_pages(_detail_pages(f).where("id % 9 <> 0").select("page", F.when(F.col("id") % 7 == 0, F.lit("<html>")).otherwise(F.col("html")).alias("html")), BASE_URL))
register(
    "ext6_7_matched",
    f"SELECT page, title, series_name, episode_number, url AS source_url, {OUTCOME} AS outcome FROM ({LISTED})",
    lambda f: matched(f).select("page", "title", "series_name", "episode_number", "source_url", "outcome"),
)
register("ext8_outcomes", f"SELECT {OUTCOME} AS outcome, count(*) AS n, 0 AS errors FROM ({LISTED}) GROUP BY 1", lambda f: extract.outcome_stats(matched(f)))
register(
    "ext9_broken",
    "SELECT CASE WHEN page_id % 2 = 0 THEN 'series' ELSE 'episode' END AS kind, page_id AS code FROM pages WHERE page_id % 7 = 0",
    lambda f: extract.broken_pages(f.base("pages").select(F.when(F.col("page_id") % 2 == 0, F.concat(F.col("page_id").cast("string"), F.lit(".html"))).otherwise(F.concat(F.lit("hsp_code_"), F.col("page_id").cast("string"), F.lit("_x.html"))).alias("page"), F.when(F.col("page_id") % 7 == 0, F.concat("html", F.lit("�"))).otherwise(F.replace("html", F.lit("�"), F.lit(""))).alias("html"))),
)
register(
    "src2_decode",
    "SELECT id, title FROM fx_episodes",
    lambda f: f.fx("episodes").select("id", tx.decode_page(F.encode(F.replace("title", F.lit("ü"), F.lit("\u0081")), "ISO-8859-1")).alias("title")),
)

# Files: written and read back.


def _round_trip(f: Frames) -> DataFrame:
    return files.publish_mart(f.genres, f.folder(), "mart_episode_genres")


def _published(f: Frames) -> DataFrame:
    checks = lambda df: quality.together(quality.not_null(df, "source_key"), quality.unique(df, "source_key"))
    return files.publish_if_valid(f.facts.select("episode_id", "source_key"), checks, f.folder())


def _exported(f: Frames) -> DataFrame:
    sources, refs = f.linked
    facts = f.facts.where("series_name = 'Serie  3'")
    mine = variants.candidates(f.links, sources.join(facts.select("episode_id"), "episode_id", "left_semi"), refs)
    rows = variants.review_export(mine, facts, "Serie  3")
    path = files.export_review(rows, variants.review_stats(f.candidates), f.folder(), datetime(2024, 1, 1))
    back = f.spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select("candidate_id", F.nullif("target_source_key", F.lit("")).alias("target_source_key"), F.col("confidence_score").cast("int").alias("confidence_score"), "match_reasons")


def _by_series(f: Frames) -> DataFrame:
    folder = f.folder()
    files.write_by_series(f.fx("episodes").select("series_id", "id", "title"), folder)
    return files.read_by_series(f.spark, folder, "id bigint, title string, series_id bigint")


def _reported(f: Frames) -> DataFrame:
    path = files.publish_report(coverage.probe_report(f.fx("api"), f.found), f.folder(), datetime(2024, 1, 1))
    return f.spark.read.schema("probe_key string, returned bigint, candidates bigint").json(path)


register("snk1_publish", "SELECT episode_id, source_key FROM facts", _published)
register("snk1b_by_series", "SELECT id, title, series_id FROM fx_episodes", _by_series)
register("snk2_mart", "SELECT * FROM egen", _round_trip)
register(
    "snk4_export",
    (
        "SELECT candidate_id, target_source_key, confidence_score, match_reasons FROM cand WHERE source_episode_id IN (SELECT episode_id FROM cls"
        " WHERE series_name = 'Serie  3')"
    ),
    _exported,
)
register("snk5_report", "SELECT probe_key, returned, candidates FROM report", _reported)


# From page files to published records, and the other sources: written as files and read by them.


def _packed(pages: DataFrame, folder: str) -> str:
    files.pack_pages(pages.select("page", tx.encode_page(F.col("html")).alias("content")), folder)
    return folder


def _deleting(f: Frames, *folders: str) -> Callable[[], None]:
    def delete() -> None:
        for folder in folders:
            store.delete(f.spark, folder)

    return delete


def _from_page_files(f: Frames) -> DataFrame:
    """List and detail pages as bytes in packs."""
    folder = f.folder()
    lists = _packed(_list_pages(f).withColumn("page", F.concat("page", F.lit(".html"))), f"{folder}/series")
    details = _packed(_detail_pages(f), f"{folder}/details")
    records, _ = extract.build_records(files.read_packed(f.spark, lists), files.read_packed(f.spark, details), BASE_URL, _deleting(f, lists, details))
    published = files.publish_if_valid(records, quality.check_records, f"{folder}/records")
    return joined_names(published).drop("speakers", "page", "pos", "parse_error")


def _detail_folder(f: Frames) -> DataFrame:
    """The records of a folder of detail pages in the order of their names."""
    packs = _packed(_detail_pages(f), f"{f.folder()}/details")
    return extract.records_of_folder(files.read_packed(f.spark, packs), BASE_URL, _deleting(f, packs)).select("place", "source_file", "title", "episode_number", "source_url")


register(
    "ext2l_detail_folder",
    f"SELECT row_number() OVER (ORDER BY source_file) AS place, * FROM (SELECT {FILE_NAME.replace('url', 'source_url')} AS source_file, title, episode_number, source_url FROM ({DETAILED}))",
    _detail_folder,
)


def _series_pages(f: Frames) -> DataFrame:
    """Pages whose first series link ends in other ways."""
    n = F.col("page_id").cast("string")
    link = lambda x: F.concat(F.lit('<a href="x.asp?serie=1">0</a><p><a class="b" href="hsp_serie.asp?serie='), x, F.lit('">S</a><a href="hsp_serie.asp?serie=5">T</a>'))
    html = F.when(F.col("page_id") % 5 == 0, link(n)).when(F.col("page_id") % 5 == 1, link(F.concat(n, F.lit("&x=2")))).when(F.col("page_id") % 5 == 2, link(F.lit("abc"))).when(F.col("page_id") % 5 == 3, link(F.lit("")))
    return f.base("pages").select(F.concat(n, F.lit(".html")).alias("page"), F.concat(F.coalesce(html, F.lit("")), F.lit("<p>"), F.coalesce("html", F.lit(""))).alias("html"))


register(
    "ext2k_series_ids",
    "SELECT page_id || '.html' AS page, CASE WHEN page_id % 5 < 2 THEN page_id END AS series_id FROM pages",
    lambda f: extract.page_series(_series_pages(f)),
)
register(
    "src1_pages_to_records",
    f"""SELECT source_key, CASE WHEN k.url IS NULL THEN 'stub_without_link' ELSE 'with_detail' END AS outcome, k.title, CASE WHEN k.url IS NULL THEN k.series_name ELSE regexp_replace(k.series_name, '\\s+', ' ', 'g') END AS series_name, k.episode_number, d.description, d.duration_minutes, d.release_date, d.label, d.cover_url,
      CASE WHEN d.order_number <> 'CD.' THEN d.order_number END AS order_number, d.previous_episode_url, d.next_episode_url, k.url AS source_url, coalesce(u.credits, '') AS credits, coalesce(d.genres, '') AS genres
      FROM kept k LEFT JOIN ({DETAILED}) d ON d.id = k.id AND k.url IS NOT NULL
      LEFT JOIN kcredits u ON u.l_orderkey = k.id""",
    _from_page_files,
)


def _from_record_files(f: Frames) -> DataFrame:
    """The records as artifacts, a JSON array for each series, of which each is a line of a pack."""
    path = f.folder()
    record = F.struct(*[F.col(c) for c in ("title", "series_name", "episode_number", "duration_minutes", "speakers", "genres", "source_url", "source_key")])
    arrays = f.nested.withColumn("series_name", F.lit("s")).groupBy("series_id").agg(F.to_json(F.collect_list(record)).alias("value"))
    arrays.select("value").write.text(path)
    return joined_names(files.read_records(f.spark, path, packed=True)).select("title", "series_name", "episode_number", "duration_minutes", "credits", "genres", "source_url", "source_key")


register(
    "src3_record_files",
    "SELECT e.title, 's' AS series_name, e.episode_number, e.duration_minutes, coalesce(c.c, '') AS credits, coalesce(g.g, '') AS genres, e.source_url, e.source_key FROM fx_episodes e LEFT JOIN (SELECT l_orderkey, string_agg(role || '=' || speaker, ';' ORDER BY l_linenumber, l_partkey, l_suppkey) AS c FROM fx_credits_raw GROUP BY 1) c ON c.l_orderkey = e.id LEFT JOIN (SELECT episode_id, string_agg(name, ';' ORDER BY name) AS g FROM fx_episode_genres JOIN fx_genres ON id = genre_id GROUP BY 1) g ON g.episode_id = e.id",
    _from_record_files,
)


def _from_seed_files(f: Frames) -> DataFrame:
    path = f.folder()
    f.fx("reviews").write.options(header=True, emptyValue="", nullValue="").csv(path)
    return files.read_seed(f.spark, path, "candidate_id string, source_key string, review_decision string, reviewed_category string, reviewed_markers string")


register(
    "src5_seed_files",
    (
        "SELECT candidate_id, source_key, review_decision, nullif(reviewed_category, '') AS reviewed_category, nullif(reviewed_markers, '') AS reviewed_markers"
        " FROM fx_reviews"
    ),
    _from_seed_files,
)


def _from_result_files(f: Frames) -> DataFrame:
    """Payloads of the external catalog: an object with the list of results for each probe, and its name, as a line of a pack."""
    path = f.folder()
    result = F.struct(F.col("collection_id").cast("bigint").alias("collectionId"), F.col("collection_name").alias("collectionName"), F.col("artist_name").alias("artistName"), F.col("release_date").alias("releaseDate"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("pos", result.alias("r")))), lambda x: x["r"]).alias("results")
    call = F.when(F.col("probe_key").isin("p0", "p10"), F.floor(F.col("pos") / 200)).otherwise(0)
    payloads = f.fx("api").groupBy("probe_key", call.alias("call")).agg(rows)
    payloads.select(F.to_json(F.struct(F.concat_ws("_", "probe_key", "call").alias("payload"), "results")).alias("value")).write.text(path)
    return files.read_results(f.spark, path, packed=True).withColumn("probe_key", F.split("probe_key", "_")[0])


register(
    "src6_result_files",
    "SELECT probe_key, CAST(row_number() OVER (PARTITION BY probe_key, CASE WHEN probe_key IN ('p0', 'p10') THEN floor(pos / 200) ELSE 0 END ORDER BY pos) - 1 AS INTEGER) AS pos, collection_id, artist_name, collection_name, release_date FROM fx_api",
    _from_result_files,
)
