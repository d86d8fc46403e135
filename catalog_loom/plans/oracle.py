"""DuckDB statements that give the rows of the registered queries from the base tables alone."""

from __future__ import annotations

import re

from catalog_loom.functions.text import DIGRAPHS, MEDIUM_ONLY
from catalog_loom.operators.coverage import EPISODE_NUMBER
from catalog_loom.operators.marts import DURATION_ENDS, DURATION_LABELS
from catalog_loom.operators.variants import CATEGORIES, COMPONENT_NOISE, MARKERS, OF_VARIANT, PART_NUMBERS, RANGE, TITLE_NOISE
from catalog_loom.sources.projections import PROJECTIONS


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def scrub(x: str, noise: tuple[tuple[str, str], ...]) -> str:
    for pattern, to in noise:
        x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(to)}, 'g')"
    return x


def umlauts(x: str) -> str:
    for two, one in DIGRAPHS:
        x = f"replace({x}, '{two}', '{one}')"
    return x


def case(x: str, values: dict[str, object], other: object) -> str:
    show = lambda v: quoted(v) if isinstance(v, str) else str(v)
    return f"CASE {x} " + " ".join(f"WHEN {quoted(k)} THEN {show(v)}" for k, v in values.items()) + f" ELSE {show(other)} END"


def bucket(values: list[object]) -> str:
    show = lambda v: quoted(v) if isinstance(v, str) else str(v)
    return "CASE " + " ".join(f"WHEN duration_minutes < {end} THEN {show(v)}" for end, v in zip(DURATION_ENDS, values, strict=False)) + f" ELSE {show(values[-1])} END"


FLAGS = ", ".join(f"coalesce(regexp_matches(low, {quoted(p)}), false) AS m_{n}" for n, p in MARKERS.items())
SHOWN = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in (
    ("fanbox", "m_fanbox"), ("container", "m_container"), ("compilation", "m_compilation"), ("format_reissue", "m_format_reissue"), ("live", "m_live"), ("film", "m_film"),
    ("special", "m_special OR m_dialect"), ("audiobook", "m_audiobook"), ("dialect", "m_dialect"), ("other_production", "m_other_production"), ("multi_title", "m_multi")))

#: Further common table expressions, named like what they stand for.
OWN = {
    "st_series": r"SELECT id AS series_id, nullif(trim(name), '') AS series_name, nullif(nullif(trim(label), ''), '?') AS label_name, lower(regexp_replace(trim(name), '\s+', ' ', 'g')) AS nk FROM fx_series",
    "st_episodes": "SELECT id AS episode_id, series_id, nullif(trim(source_key), '') AS source_key, episode_number, nullif(trim(title), '') AS episode_title, nullif(trim(description), '') AS description, duration_minutes, release_date, CAST(year(release_date) AS INTEGER) AS release_year, nullif(trim(cover_url), '') AS cover_url, nullif(trim(order_number), '') AS order_number, nullif(trim(source_url), '') AS source_url FROM fx_episodes",
    "facts": "SELECT e.episode_id, e.source_key, e.series_id, s.series_name, s.label_name, coalesce(f.franchise_name, s.series_name) AS franchise_name, e.episode_number, e.episode_title, e.description, e.release_date, e.release_year, e.duration_minutes, e.cover_url, e.order_number, e.source_url FROM st_episodes e LEFT JOIN st_series s ON s.series_id = e.series_id LEFT JOIN fx_franchises f ON f.normalized_series_name = s.nk",
    "egen": "SELECT l.episode_id, f.release_year, g.id AS genre_id, g.name AS genre_name, l.episode_id || ':' || g.id AS episode_genre_key FROM fx_episode_genres l JOIN facts f ON f.episode_id = l.episode_id JOIN fx_genres g ON g.id = l.genre_id",
    "cred": "SELECT l.episode_id, f.release_year, s.id AS speaker_id, s.name AS speaker_name, r.id AS role_id, r.name AS role_name, l.episode_id || ':' || s.id || ':' || r.id AS credit_key FROM fx_episode_speakers l JOIN facts f ON f.episode_id = l.episode_id JOIN fx_speakers s ON s.id = l.speaker_id JOIN fx_roles r ON r.id = l.role_id",
    "casts": "SELECT episode_id, CAST(count(DISTINCT speaker_id) AS INTEGER) AS cast_count, md5(string_agg(speaker_id || ':' || role_id, ',' ORDER BY speaker_id, role_id)) AS cast_fingerprint FROM cred GROUP BY 1",
    "dial": "SELECT source_key, bool_or(list_contains(string_split(reviewed_markers, ','), 'dialect')) AS d FROM fx_reviews WHERE review_decision = 'accept' GROUP BY 1",
    "feat0": "SELECT f.*, lower(f.episode_title) AS low, coalesce(c.cast_count, 0) AS cast_count, c.cast_fingerprint, coalesce(d.d, false) AS m_dialect, coalesce(l.production_line_key, CASE WHEN series_name = 'John Sinclair' THEN 'edition_2000' ELSE 'main' END) AS production_line_key, coalesce(l.production_line_label, CASE WHEN series_name = 'John Sinclair' THEN 'Edition 2000' ELSE 'Hauptserie' END) AS production_line_label, coalesce(l.production_line_order, 10) AS production_line_order FROM facts f LEFT JOIN casts c ON c.episode_id = f.episode_id LEFT JOIN dial d ON d.source_key = f.source_key LEFT JOIN fx_lines l ON l.source_key = f.source_key",
    "feat1": f"SELECT *, {FLAGS}, coalesce(contains(low, '/') AND NOT regexp_matches(low, {quoted(PART_NUMBERS)}), false) AS m_multi FROM feat0",
    "feat": f"SELECT *, CASE WHEN m_fanbox OR m_container THEN 'box_set' WHEN m_compilation OR m_multi THEN 'compilation' WHEN m_format_reissue THEN 'format_reissue' WHEN m_live THEN 'live_production' WHEN m_film THEN 'film_adaptation' WHEN m_dialect OR m_special THEN 'special' WHEN m_audiobook OR m_other_production THEN 'other_production' WHEN episode_number BETWEEN 1 AND 999 THEN 'regular_candidate' ELSE 'unknown' END AS base_category, TRY_CAST(nullif(regexp_extract(low, {quoted(RANGE)}, 1), '') AS INTEGER) AS range_start, TRY_CAST(nullif(regexp_extract(low, {quoted(RANGE)}, 2), '') AS INTEGER) AS range_end, concat_ws(',', {SHOWN}) AS edition_markers, {scrub('low', TITLE_NOISE)} AS comparison_title FROM feat1",
    "refs": "SELECT series_id || ':' || production_line_key || ':' || episode_number AS series_episode_number_key, * FROM feat WHERE base_category = 'regular_candidate' AND episode_number > 0 AND comparison_title <> '' QUALIFY row_number() OVER (PARTITION BY series_id, production_line_key, episode_number ORDER BY release_date IS NULL, release_date NULLS LAST, cast_count <= 0, episode_id) = 1",
    "over": "SELECT source_key, max(nullif(reviewed_category, '')) AS rc, max(nullif(reviewed_markers, '')) AS rm FROM fx_reviews WHERE review_decision = 'accept' AND (reviewed_category <> '' OR reviewed_markers <> '') GROUP BY 1",
    "cls": "SELECT f.* EXCLUDE (edition_markers), CASE WHEN r.episode_id IS NOT NULL THEN 'regular_episode' WHEN f.base_category = 'regular_candidate' THEN 'unknown' ELSE f.base_category END AS machine_category, coalesce(o.rc, CASE WHEN r.episode_id IS NOT NULL THEN 'regular_episode' WHEN f.base_category = 'regular_candidate' THEN 'unknown' ELSE f.base_category END) AS variant_category, CASE WHEN o.source_key IS NULL THEN 'machine' ELSE 'reviewed' END AS classification_source, coalesce(o.rm, f.edition_markers) AS edition_markers FROM feat f LEFT JOIN refs r ON r.episode_id = f.episode_id LEFT JOIN over o ON o.source_key = f.source_key",
    "lk_range": "SELECT s.episode_id AS a, t.episode_id AS b, 'contains' AS rel, 100 AS score, '[\"explicit_episode_range\"]' AS why FROM cls s JOIN refs t ON t.series_id = s.series_id AND t.production_line_key = s.production_line_key AND t.episode_number BETWEEN s.range_start AND s.range_end WHERE s.variant_category IN ('box_set', 'compilation')",
    "same": "SELECT s.episode_id AS a, t.episode_id AS b, s.variant_category AS kind, s.episode_number = t.episode_number AS same_number, s.comparison_title <> '' AND s.comparison_title = t.comparison_title AS same_title, coalesce(s.comparison_title = t.comparison_title, false) AS any_title, coalesce(s.description = t.description, false) AS same_text, coalesce(s.cast_fingerprint = t.cast_fingerprint, false) AS same_cast, coalesce(abs(s.duration_minutes - t.duration_minutes) <= 5, false) AS near FROM cls s JOIN refs t ON t.series_id = s.series_id AND t.production_line_key = s.production_line_key AND (t.episode_number = s.episode_number OR t.comparison_title = s.comparison_title)",
    "lk_format": "SELECT a, b, 'same_recording' AS rel, CASE WHEN any_title THEN 100 WHEN same_text OR same_cast THEN 95 WHEN near THEN 90 ELSE 80 END AS score, '[' || concat_ws(',', '\"same_episode_number\"', '\"format_marker\"', CASE WHEN any_title THEN '\"exact_normalized_title\"' END, CASE WHEN same_text THEN '\"exact_description\"' END, CASE WHEN same_cast THEN '\"same_cast_fingerprint\"' END, CASE WHEN near THEN '\"duration_within_five_minutes\"' END) || ']' AS why FROM same WHERE kind = 'format_reissue' AND same_number",
    "lk_story": "SELECT a, b, 'same_story_different_production' AS rel, CASE WHEN same_text OR same_cast THEN 95 ELSE 90 END AS score, '[' || concat_ws(',', '\"exact_normalized_title\"', '\"different_production_marker\"', CASE WHEN same_text THEN '\"exact_description\"' END, CASE WHEN same_cast THEN '\"same_cast_fingerprint\"' END) || ']' AS why FROM same WHERE kind IN ('live_production', 'film_adaptation', 'other_production', 'special') AND same_title AND a <> b",
    "comp": rf"SELECT episode_id, series_id, production_line_key, {scrub('lower(part)', COMPONENT_NOISE)} AS ct FROM (SELECT *, unnest(regexp_split_to_array(episode_title, '\s*/\s*')) AS part FROM cls WHERE variant_category = 'compilation')",
    "lk_comp": "SELECT c.episode_id AS a, t.episode_id AS b, 'contains' AS rel, 90 AS score, '[\"exact_normalized_component_title\"]' AS why FROM comp c JOIN refs t ON t.series_id = c.series_id AND t.production_line_key = c.production_line_key AND t.comparison_title = c.ct WHERE c.ct <> ''",
    "lk_best": "SELECT * FROM (SELECT * FROM lk_range UNION ALL SELECT * FROM lk_format UNION ALL SELECT * FROM lk_story UNION ALL SELECT * FROM lk_comp) QUALIFY row_number() OVER (PARTITION BY a, b, rel ORDER BY score DESC, why) = 1",
    "cand": "SELECT md5(s.source_key || ':' || t.source_key || ':' || rel) AS candidate_id, a AS source_episode_id, s.source_key, s.episode_title AS source_title, s.variant_category, b AS target_episode_id, t.source_key AS target_source_key, t.episode_title AS target_title, t.episode_number AS target_episode_number, rel AS proposed_relationship, score AS confidence_score, CASE WHEN score >= 90 THEN 'high' WHEN score >= 70 THEN 'medium' ELSE 'low' END AS confidence_class, why AS match_reasons, s.edition_markers, s.range_start, s.range_end FROM lk_best JOIN cls s ON s.episode_id = a JOIN refs t ON t.episode_id = b UNION ALL SELECT md5(source_key || ':none:unresolved'), episode_id, source_key, episode_title, variant_category, NULL, NULL, NULL, NULL, 'unresolved', 0, 'low', '[\"no_deterministic_target\"]', edition_markers, range_start, range_end FROM cls WHERE variant_category <> 'regular_episode' AND episode_id NOT IN (SELECT a FROM lk_best)",
    "cat0": f"SELECT f.*, c.variant_category, c.production_line_key, c.production_line_label, c.production_line_order, c.machine_category, c.classification_source, c.edition_markers, CASE WHEN list_contains(string_split(c.edition_markers, ','), 'dialect') THEN 'dialect' WHEN list_contains(string_split(c.edition_markers, ','), 'audiobook') THEN 'audiobook' ELSE {case('c.variant_category', OF_VARIANT, 'unknown')} END AS category_key FROM facts f JOIN cls c ON c.episode_id = f.episode_id",
    "cat": f"SELECT *, {case('category_key', {k: v[0] for k, v in CATEGORIES.items()}, 'Unklar')} AS category_label, {case('category_key', {k: v[1] for k, v in CATEGORIES.items()}, 100)} AS category_order FROM cat0",
    "ccnt": "SELECT series_id, series_name, max(label_name) AS label_name, franchise_name, production_line_key, production_line_label, production_line_order, category_key, category_label, category_order, series_id || ':' || production_line_key || ':' || category_key AS series_category_key, count(*) AS episode_count FROM cat GROUP BY ALL",
    "yg": "SELECT release_year AS year, genre_name, count(DISTINCT episode_id) AS episode_count FROM egen WHERE release_year IS NOT NULL GROUP BY ALL",
    "cln": r"SELECT doc_id, nullif(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(raw_text, chr(132), chr(34)), chr(147), chr(34)), chr(146), ''''), chr(133), '...'), chr(150), '-'), chr(8211), '-'), chr(8212), '-'), '[\s\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')), '') AS cleaned FROM fx_text",
    "cr": f"SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS ord, lower({umlauts('speaker')}) AS sk, lower({umlauts('role')}) AS rk FROM fx_credits_raw",
    "sp": f"SELECT speaker AS spelling, sk AS key, count(*) AS n, min(ord) AS seen, speaker <> {umlauts('speaker')} AS plain FROM cr GROUP BY ALL",
    "rp": "SELECT role AS spelling, rk AS key, count(*) AS n, min(ord) AS seen FROM cr GROUP BY ALL",
    "smap": "SELECT p.spelling, b.spelling AS canonical FROM sp p JOIN (SELECT * FROM sp WHERE NOT plain QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, seen) = 1) b ON b.key = p.key WHERE p.plain",
    "rmap": "SELECT p.spelling, b.spelling AS canonical FROM rp p JOIN (SELECT * FROM rp QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, seen) = 1) b ON b.key = p.key WHERE p.spelling <> b.spelling",
    "rk0": r"SELECT *, CASE WHEN source_url IS NOT NULL THEN 'cat:episode:' || regexp_extract(source_url, 'code=(\d+)', 1) ELSE 'cat:stub:' || sha256(lower(series_name) || chr(31) || episode_number || chr(31) || lower(regexp_replace(trim(title), '\s+', ' ', 'g'))) END AS source_key FROM fx_records_dup",
    "probes": "SELECT 'p' || i AS probe_key, 'Serie ' || i AS series_name, ['Serie ' || i] AS aliases FROM (SELECT DISTINCT probe AS i FROM fx_probe_ids)",
    "api1": r"SELECT a.*, trim(regexp_replace(lower(collection_name), '[^a-z0-9]+', ' ', 'g')) AS title FROM fx_api a JOIN probes p ON p.probe_key = a.probe_key WHERE trim(regexp_replace(lower(artist_name), '[^a-z0-9]+', ' ', 'g')) = lower(p.series_name) OR contains(trim(regexp_replace(lower(collection_name), '[^a-z0-9]+', ' ', 'g')), lower(p.series_name))",
    "api2": "SELECT * FROM api1 WHERE collection_id <> '' QUALIFY row_number() OVER (PARTITION BY probe_key, collection_id ORDER BY pos DESC) = 1",
    "report": f"SELECT r.probe_key, r.returned, coalesce(c.candidates, 0) AS candidates, coalesce(c.numbered, 0) AS numbered, coalesce(c.distinct_numbers, 0) AS distinct_numbers, c.earliest_year, c.latest_year, coalesce(d.duplicate_titles, 0) AS duplicate_titles, r.returned >= 200 AS limit_reached FROM (SELECT probe_key, count(*) AS returned FROM fx_api GROUP BY 1) r LEFT JOIN (SELECT probe_key, count(*) AS candidates, count(x) AS numbered, count(DISTINCT x) AS distinct_numbers, CAST(min(y) AS INTEGER) AS earliest_year, CAST(max(y) AS INTEGER) AS latest_year FROM (SELECT probe_key, CAST(nullif(regexp_extract(collection_name, {quoted(EPISODE_NUMBER)}, 1), '') AS INTEGER) AS x, CAST(left(release_date, 4) AS INTEGER) AS y FROM api2) GROUP BY 1) c ON c.probe_key = r.probe_key LEFT JOIN (SELECT probe_key, count(*) AS duplicate_titles FROM (SELECT probe_key, title FROM api2 GROUP BY ALL HAVING count(*) > 1) GROUP BY 1) d ON d.probe_key = r.probe_key",
    "listed": """SELECT e.id, 'page_' || lpad(CAST(s.id AS VARCHAR), 9, '0') AS page, trim(s.name) AS series_name, e.episode_number, trim(e.title) AS title,
      CASE WHEN e.id % 10 <> 0 THEN 'https://x.test/hsp_anzeige.asp?code=' || e.id END AS url FROM fx_episodes e JOIN fx_series s ON s.id = e.series_id
      WHERE trim(e.title) <> '' QUALIFY row_number() OVER (PARTITION BY s.id, trim(e.title) ORDER BY e.id) = 1""",
    "keyed": r"""SELECT *, CASE WHEN url IS NOT NULL THEN 'cat:episode:' || id
      ELSE 'cat:stub:' || sha256(lower(regexp_replace(series_name, '\s+', ' ', 'g')) || chr(31) || coalesce(CAST(episode_number AS VARCHAR), '') || chr(31) || lower(title)) END AS source_key FROM listed""",
    "kept": "SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY source_key ORDER BY page, id) = 1",
    # Credits of kept records in one spelling each.
    "kcr": f"SELECT c.*, row_number() OVER (ORDER BY page, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS ord, lower({umlauts('speaker')}) AS sk, lower({umlauts('role')}) AS rk FROM fx_credits_raw c JOIN kept k ON k.id = l_orderkey AND k.url IS NOT NULL",
    "ksp": f"SELECT sk, speaker AS best FROM (SELECT sk, speaker, count(*) AS n, min(ord) AS seen FROM kcr WHERE speaker = {umlauts('speaker')} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY sk ORDER BY n DESC, seen) = 1",
    "krp": "SELECT rk, role AS best FROM (SELECT rk, role, count(*) AS n, min(ord) AS seen FROM kcr GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY rk ORDER BY n DESC, seen) = 1",
    "kcredits": f"SELECT l_orderkey, string_agg(krp.best || '=' || CASE WHEN speaker = {umlauts('speaker')} THEN speaker ELSE coalesce(ksp.best, speaker) END, ';' ORDER BY l_linenumber, l_partkey, l_suppkey) AS credits FROM kcr JOIN krp ON krp.rk = kcr.rk LEFT JOIN ksp ON ksp.sk = kcr.sk GROUP BY 1",
}
ALL = PROJECTIONS | OWN


def full(sql: str) -> str:
    """sql after all the expressions that it needs."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", text):
            if name in ALL and name not in order:
                visit(ALL[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    return ("WITH " + ", ".join(f"{n} AS ({ALL[n].strip()})" for n in order) + " " + sql) if order else sql


BUCKETS = f"{bucket(list(DURATION_LABELS))} AS duration_bucket, {bucket(list(range(1, len(DURATION_LABELS) + 1)))} AS bucket_order"
MEDIUM = ", ".join(map(quoted, MEDIUM_ONLY))
