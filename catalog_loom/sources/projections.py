"""The star schema, seeds and raw inputs of the catalog as projections of the base tables.

Each statement is valid in Spark SQL and in DuckDB; the queries read it as a frame and the test SQL as a common table
expression in front of its own.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "labels", "conversations")

PROJECTIONS = {
    "fx_series": """SELECT CAST(c_custkey + 1 AS BIGINT) AS id, concat(' Serie  ', CAST(c_custkey AS STRING), ' ') AS name, CASE WHEN c_mktsegment = 'FURNITURE' THEN '?' WHEN c_mktsegment = 'BUILDING' THEN ' ' ELSE c_mktsegment END AS label FROM customer""",
    "fx_ep0": """SELECT o_orderkey AS id, CAST(o_custkey + 1 AS BIGINT) AS series_id, CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE CAST(o_orderkey % 9 + 1 AS BIGINT) END AS episode_number, CAST(o_orderkey % 9 + 1 AS BIGINT) AS n, CAST(floor(o_orderkey / 9) AS BIGINT) % 40 AS kind, o_orderdate, o_totalprice FROM orders""",
    "fx_episodes": """
SELECT id, series_id, episode_number,
 CASE kind WHEN 0 THEN concat('Fanbox (Folgen 0', CAST(n AS STRING), '-0', CAST(n + 2 AS STRING), ')')
  WHEN 1 THEN concat('und der Schatz ', CAST(n AS STRING), ' (LP-Edition)')
  WHEN 2 THEN concat('und der Schatz ', CAST(n AS STRING), ' - Live')
  WHEN 3 THEN concat('und der Schatz ', CAST(n AS STRING), ' (Hörspiel zum Film)')
  WHEN 4 THEN concat('Special 2010: der Schatz ', CAST(n AS STRING))
  WHEN 5 THEN concat('Der Schatz ', CAST(n AS STRING), ' (Hörbuch)')
  WHEN 6 THEN concat('Doppelfolge: Der Schatz ', CAST(n AS STRING), ' / Der Schatz ', CAST(n + 1 AS STRING))
  WHEN 7 THEN concat('Der Schatz ', CAST(n AS STRING), ' (Teil 1/2)')
  WHEN 8 THEN 'Soundtrack' WHEN 9 THEN '  ' WHEN 10 THEN concat('Steelbook Folge ', CAST(n + 3 AS STRING), ' bis ', CAST(n AS STRING))
  WHEN 11 THEN concat('Der Schatz ', CAST(n AS STRING), ' (Neuauflage)')
  ELSE concat('und der Schatz ', CAST(n AS STRING)) END AS title,
 CASE WHEN id % 4 = 0 THEN NULL ELSE concat(' Text ', CAST(n % 10 AS STRING), ' ') END AS description,
 CASE WHEN id % 13 = 0 THEN NULL ELSE round(o_totalprice / 3000, 1) END AS duration_minutes,
 CASE WHEN id % 17 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS release_date,
 CAST(NULL AS STRING) AS cover_url, CASE WHEN id % 3 = 0 THEN 'CD.' ELSE concat('ABC-', CAST(id AS STRING)) END AS order_number,
 concat('cat:episode:', CAST(id AS STRING)) AS source_key, concat('https://x.test/hsp_anzeige.asp?code=', CAST(id AS STRING)) AS source_url FROM fx_ep0
""",
    "fx_speakers": """SELECT s_suppkey AS id, s_name AS name FROM supplier""",
    "fx_roles": """SELECT p_partkey AS id, concat(p_name, ' ', CAST(p_partkey AS STRING)) AS name FROM part""",
    "fx_genres": """SELECT DISTINCT CAST(substr(p_brand, 7) AS BIGINT) AS id, p_brand AS name FROM part""",
    "fx_episode_speakers": """SELECT DISTINCT l_orderkey AS episode_id, l_suppkey AS speaker_id, l_partkey AS role_id FROM lineitem""",
    "fx_episode_genres": """SELECT DISTINCT l_orderkey AS episode_id, CAST(substr(p_brand, 7) AS BIGINT) AS genre_id FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "fx_franchises": """SELECT * FROM (VALUES ('serie 1', 'Franchise A'), ('serie 2', 'Franchise A'), ('serie 3', 'Franchise B')) AS t(normalized_series_name, franchise_name)""",
    "fx_reviews": """SELECT md5(CAST(id AS STRING)) AS candidate_id, source_key, CASE id % 3 WHEN 0 THEN 'reject' ELSE 'accept' END AS review_decision, CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN 'special' WHEN 2 THEN 'live_production' ELSE 'format_reissue' END AS reviewed_category, CASE id % 5 WHEN 0 THEN 'special,dialect' WHEN 1 THEN 'special,audiobook' ELSE '' END AS reviewed_markers FROM fx_episodes WHERE id % 37 = 0""",
    "fx_lines": """SELECT source_key, 'line_b' AS production_line_key, 'Line B' AS production_line_label, 20 AS production_line_order FROM fx_episodes WHERE series_id % 5 = 3 AND id % 2 = 0""",
    "fx_credits_raw": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN (l_suppkey + l_linenumber) % 5 = 0 THEN concat('Mueller, A', CAST(l_suppkey AS STRING)) ELSE concat('Müller, A', CAST(l_suppkey AS STRING)) END AS speaker, CASE WHEN (l_partkey + l_linenumber) % 7 = 0 THEN concat('ERZÄHLER ', CAST(l_partkey AS STRING)) WHEN (l_partkey + l_linenumber) % 7 = 1 THEN concat('Erzaehler ', CAST(l_partkey AS STRING)) ELSE concat('Erzähler ', CAST(l_partkey AS STRING)) END AS role FROM lineitem""",
    # Several orders of a customer are one title, by a third of their numbers; addresses are shared by neighbouring orders.
    "fx_records_dup": """SELECT o_orderkey AS ord, concat('Serie ', CAST(o_custkey AS STRING)) AS series_name, CAST(o_custkey * 3 + o_orderkey % 3 AS BIGINT) AS episode_number, CASE WHEN o_orderkey % 7 = 0 THEN concat('  TITEL   ', CAST(o_orderkey % 3 AS STRING)) ELSE concat('Titel ', CAST(o_orderkey % 3 AS STRING)) END AS title, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE concat('https://x.test/hsp_anzeige.asp?code=', CAST(CAST(floor(o_orderkey / 6) AS BIGINT) AS STRING)) END AS source_url, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS label FROM orders""",
    # A probe for each customer, and two that a tenth of all customers share.
    "fx_probe_ids": """SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN c_custkey % 20 ELSE c_custkey END AS probe FROM customer""",
    "fx_api": """SELECT concat('p', CAST(probe AS STRING)) AS probe_key, o_orderkey AS pos, CAST(o_custkey * 7 + o_orderkey % 7 AS STRING) AS collection_id, CASE o_orderkey % 4 WHEN 0 THEN 'Other Artist' ELSE concat('Serie ', CAST(probe AS STRING), '!') END AS artist_name, CASE o_orderkey % 6 WHEN 0 THEN concat('Schatz (serie ', CAST(probe AS STRING), ')') ELSE concat('Folge ', CAST(o_orderkey % 120 AS STRING), ': Schatz') END AS collection_name, concat(CAST(year(o_orderdate) AS STRING), '-01-01T00:00:00Z') AS release_date FROM orders JOIN fx_probe_ids ON o_custkey = c_custkey""",
    "fx_targets": """SELECT DISTINCT user_id AS external_id, 'pending' AS status, CAST(user_id % 3 AS BIGINT) AS attempts FROM events""",
    "fx_outcomes": """SELECT user_id AS external_id, event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'not_found' ELSE 'success' END AS status, CASE event_type WHEN 'error' THEN concat('E', CAST(event_id AS STRING)) END AS error_message FROM events""",
    "fx_cover_candidates": """SELECT l_orderkey AS episode_id, l_linenumber AS pos, l_partkey AS release_id, CAST(l_quantity * 2 AS INT) AS score, concat('https://c.test/', CAST(l_partkey AS STRING)) AS cover_url FROM lineitem""",
    "fx_text": "SELECT doc_id, concat(substr(text, 1, 40), '\u0085 ', '\u0084x\u0093\u00a0 \u2013 ', substr(text, 41)) AS raw_text FROM documents",
}


def needed(sql: str) -> list[str]:
    """The projections that sql reads, directly or through others, in an order in which they can be defined."""
    found: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bfx_\w+", text):
            if name not in found and name in PROJECTIONS:
                visit(PROJECTIONS[name])
                if name not in found:
                    found.append(name)

    visit(sql)
    return found


def with_projections(sql: str, *own: tuple[str, str]) -> str:
    """sql after the definitions of the projections that it needs and of further common table expressions."""
    names = needed(" ".join([*(text for _, text in own), sql]))
    parts = [f"{n} AS ({PROJECTIONS[n].strip()})" for n in names] + [f"{n} AS ({text.strip()})" for n, text in own]
    return f"WITH {', '.join(parts)} {sql.strip()}" if parts else sql


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def projection(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """The frame of one projection. The base tables are named by their files, so that no view is left in the session; given are
    frames that are read in place of the tables of their names."""
    sql = with_projections(f"SELECT * FROM {name}")
    for table in BASE:
        source = f"{{{table}}}" if table in given else f"parquet.`{sf_dir}/{table}.parquet`"
        sql = re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 {source} AS {table}", sql)
    return spark.sql(sql, **given)
