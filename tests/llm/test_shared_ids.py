"""Both searches where most rows share one id, and a router that visits few parts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog_loom.llm import ann, topk, vectors

HOT = 20


@pytest.fixture(scope="module")
def many(spark):
    """5,000 of 6,000 rows have one id, and half of these one vector."""
    rng = np.random.default_rng(4)
    points = rng.normal(size=(6000, 16)).astype(np.float32)
    points[2500:5000] = points[2500]
    rows = [(HOT if i < 5000 else i, p.tolist()) for i, p in enumerate(points)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)


def brute(rows, every, k, whole):
    m = np.array([r[1] for r in rows], np.float32).astype(float)
    m = np.floor(64 * m) if whole else m
    ids = np.array([r[0] for r in rows])
    out = []
    for query in np.unique(ids[ids % every == 0]):
        own = m[ids == query]
        q = own[np.lexsort(own.T[::-1])[0]]
        s = np.where(ids == query, -np.inf, np.round(m @ q, 9))
        order = np.lexsort((ids, -s))[:k]
        out += [(int(query), n + 1, int(ids[j]), float(s[j])) for n, j in enumerate(order) if s[j] > -np.inf]
    return out


def test_exact_search_with_a_shared_id(spark, many, monkeypatch):
    rows, frame = many
    monkeypatch.setattr(topk, "block_rows", lambda _: 300)
    monkeypatch.setattr(topk, "CLUSTER_ROWS", 600)
    largest = []
    grid = topk.grid

    def counted(base, asked, k):
        largest.append(base.groupBy("dim", "cluster", "piece").count().agg(F.max("count")).first()[0])
        return grid(base, asked, k)

    monkeypatch.setattr(topk, "grid", counted)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], float(r["score"])) for r in topk.top_k(frame, 20, 10).collect())
    assert got == brute(rows, 20, 10, True) and max(largest) <= 400


def test_learned_search_with_a_shared_id(spark, many, monkeypatch):
    rows, frame = many
    monkeypatch.setattr(ann, "block_rows", lambda _: 300)
    monkeypatch.setattr(ann, "ROWS_PER_PART", 1500)
    largest = []
    visit = ann.visit

    def counted(index, routed, k):
        largest.append(index.groupBy("part", "piece", "block").count().agg(F.max("count")).first()[0])
        return visit(index, routed, k)

    monkeypatch.setattr(ann, "visit", counted)
    want = {(q, i) for q, _, i, _ in brute(rows, 20, 10, False)}
    got = {(r["query_id"], r["vec_id"]) for r in ann.near_neighbours(frame, 20, 10).collect()}
    assert len(got & want) >= 0.9 * len(want) and max(largest) <= 400


def test_router_visits_few_parts_of_clusters():
    """On vectors with clusters a quarter of the parts holds the neighbours that are asked for."""
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(64, 32))
    points = centers[rng.integers(0, 64, 8000)] + 0.15 * rng.normal(size=(8000, 32))
    router, visits = ann.fit(points[:6000], 64, 20)
    assert visits <= 16
    home = router(points).argmax(axis=1)
    asked = points[6000:6300]
    to = np.argsort(-router(asked), axis=1)[:, :visits]
    near = np.argsort(-(asked @ points.T), axis=1)[:, :20]
    assert np.mean([(home[near[i]][:, None] == to[i]).any(axis=1).mean() for i in range(len(asked))]) >= 0.9


def test_block_rows():
    assert vectors.block_rows(64) == vectors.BLOCK_ROWS and vectors.block_rows(1 << 20) == 256
