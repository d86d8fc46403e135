"""Searches with bounds or an index, and quantiles without a single task, against plain ones."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog_loom.operators import nearby, order, search, variants
from catalog_loom.plans import queries

DIM = 8


def nearest(rows, queries, k):
    fine = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None and len(v) == DIM and all(x is not None and np.isfinite(x) for x in v)]
    ids, m = np.array([i for i, _ in fine]), np.array([v for _, v in fine])
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    for query, q in queries:
        q = np.array(q, np.float32).astype(float)
        s = np.round(m @ (q / max(np.linalg.norm(q), 1e-300)), 12)
        for place, j in enumerate(np.lexsort((ids, -s))[:k]):
            yield query, place + 1, int(ids[j]), round(float(s[j]), 9)


def found(spark, rows, queries, k, **size):
    frame = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(5)
    got, sent, blocks = nearby.search(frame, spark.createDataFrame(queries, "query_id long, embedding array<float>"), k, **size)
    counts = {r["block"]: r["count"] for r in sent.groupBy("block").count().collect()}
    pairs = sum(n * int(blocks.rows[b]) for b, n in counts.items()) if blocks else 0
    return sorted((r["query_id"], r["rank"], r["id"], round(r["similarity"], 9)) for r in got.collect()), pairs, blocks


def test_clustered_vectors_are_mostly_left_out(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(40, DIM))
    rows = [(i, (centers[i % 40] + 0.05 * rng.normal(size=DIM)).tolist()) for i in range(5000)]
    queries = [(i, rows[i][1]) for i in range(0, 5000, 50)]
    got, pairs, blocks = found(spark, rows, queries, 7, cell_rows=150, block=200)
    assert got == sorted(nearest(rows, queries, 7)) and pairs < len(rows) * len(queries) / 4 and len(blocks.cell) > 20


def test_odd_vectors(spark):
    """One id with very many rows, zeros, opposite queries, and vectors that take no part."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=DIM).tolist()) for i in range(300)]
    rows += [(3, rows[3][1])] * 900 + [(9000 + i, [0.0] * DIM) for i in range(20)] + [(9100, None), (9101, [1.0] * 7), (9102, [1.0] * 7 + [None]), (9103, [float("nan")] + [1.0] * 7), (9104, [1e-30] * DIM), (9105, [3e38] * DIM)]
    queries = [(1, rows[1][1]), (2, [0.0] * DIM), (3, rows[3][1]), (4, [-x for x in rows[4][1]])]
    got, _, blocks = found(spark, rows, queries, 6, cell_rows=50, block=64)
    assert got == sorted(nearest(rows, queries, 6)) and blocks.pieces.max() > 10
    only = [(i, [0.0] * DIM) for i in range(3)]
    assert found(spark, only, queries[:2], 5)[0] == sorted(nearest(only, queries[:2], 5))
    none = spark.createDataFrame([], "id long, embedding array<float>")
    assert nearby.search(none, none.withColumnRenamed("id", "query_id"))[0].count() == 0


def test_quantiles(spark):
    rng = np.random.default_rng(7)
    values = [float(x) for x in rng.integers(0, 400, 5000) / 7] + [5.0] * 3000
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)] * 9, "x double").repartition(6)
    wanted = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    assert np.allclose(order.order_statistics(rows, "x", wanted), np.quantile(values, wanted), atol=1e-9)
    assert order.order_statistics(rows.where("x is null"), "x", (0.5,)) == [None]
    assert order.order_statistics(spark.createDataFrame([(4,)], "x int"), "x", wanted) == [4.0] * len(wanted)


NAMES = ["Die Stille Bucht", "Bucht", "BUCHTENBURG", "Ü Bucht", "xy", None, "", "abcabcabc", "Burg"]


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([(i, n) for i, n in enumerate(NAMES * 40)], "id bigint, name string")


@pytest.fixture(scope="module")
def index(names, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('index')}/x"
    search.build(names, folder)
    return folder


@pytest.mark.parametrize(("text", "left"), [("bucht", 160), ("BUCHT ", 0), ("tenb", 40), ("zzz", 0), ("xy", None), ("abcabcabca", 40), ("ü b", 40), ("", None), ("stille bucht", 40)])
def test_search_by_index(spark, names, index, text, left):
    """The rows of a plain search; left: how many names the index leaves to look at."""
    got, want = search.containing(names, index, text), names.where(F.contains(F.lower("name"), F.lit(text.lower())))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    some = search.candidates(spark, index, text)
    assert (None if some is None else some.count()) == left


def test_credits_are_not_dealt_anew_for_each_step_of_casts(spark):
    """One shuffle by episode serves repeated links and facts, and one the casts with their number of speakers."""
    frames, conf = queries.Frames(spark, "/root/testdata/sf0.001"), {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        plan = variants.casts(frames.cast_credits)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plan.count("Exchange hashpartitioning") == 11  # two more if each step deals anew
