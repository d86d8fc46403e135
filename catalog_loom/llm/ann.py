"""Approximate nearest neighbours by learned partitions.

Fit, on a bounded sample (FIT_ROWS rows, or FIT_ROWS_PER_PART for each part if that is more; those of smallest hash): the
neighbour graph of the sample is cut into balanced parts by recursive spectral bisection and moves that keep the balance; a
small network learns to predict the part of a vector; and the number of parts to visit is the smallest that finds RECALL of
the neighbours of held-out sample rows.

Index and search: every row goes to its most probable part. A query goes to its several most probable parts, where all
rows are scored in double precision. They are visited in three steps, the most probable one first, then some, then the
rest; the kth score found so far goes along, and parts only return what reaches it. Parts are split into pieces of about
block_rows(length) rows, so that a part that holds very many rows (copies of one vector, say) is many tasks, and a piece is
copied once for every block_rows(length) queries that visit its part. Queries that found fewer than k rows visit all parts.

Vectors are only compared with those of their own length. Each length of at least LEAST_INDEXED rows has an index of its own;
the others have one part each, so that they are searched whole.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and null ids, take no part; rows
that repeat a vec_id are candidates each, and none is one for the query with that id; a repeated query is answered once, for
the least of its vectors; ties go to the smaller vec_id; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog_loom.llm.shared import mapped, release, stage, table
from catalog_loom.llm.vectors import asking, best, block_rows, matrix, merge, usable

FIT_ROWS = 6144
HELD_OUT = 384
ROWS_PER_PART = 512
MOST_PARTS = 256
FIT_ROWS_PER_PART = 96
LEAST_INDEXED = 1024
HIDDEN = 64
RECALL = 0.95
FOUND = "query_id long, vec_id long, score double"


def neighbours(points: np.ndarray, asked: np.ndarray, k: int) -> np.ndarray:
    """The k points of largest inner product for each asked row, the first (mostly itself) left out."""
    out = []
    for at in range(0, len(asked), 512):
        scores = asked[at : at + 512] @ points.T
        near = np.argpartition(-scores, min(k, scores.shape[1] - 1), axis=1)[:, : k + 1]
        order = np.argsort(-np.take_along_axis(scores, near, 1), axis=1)
        out.append(np.take_along_axis(near, order, 1)[:, 1:])
    return np.concatenate(out)


def bisect(edges: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Two halves of a graph, by the sign of its second eigenvector about the median."""
    degree = np.bincount(edges.ravel(), minlength=n) + 1.0
    root = np.sqrt(degree)
    x = rng.normal(size=n)
    for _ in range(60):
        x -= root * (x @ root) / (root @ root)
        y = x / root
        pulled = np.bincount(edges[:, 0], y[edges[:, 1]], n) + np.bincount(edges[:, 1], y[edges[:, 0]], n) + y
        x = x + pulled / root
        x /= np.linalg.norm(x) or 1.0
    half = np.zeros(n, bool)
    half[np.argsort(x / root, kind="stable")[n // 2 :]] = True
    return half


def balanced_parts(near: np.ndarray, parts: int, sweeps: int = 8, slack: float = 1.05) -> np.ndarray:
    """A part for each node of the neighbour graph, of about equal sizes, with few neighbours in other parts."""
    n, rng = len(near), np.random.default_rng(11)
    edges = np.column_stack([np.repeat(np.arange(n), near.shape[1]), near.ravel()])
    part = np.zeros(n, np.int64)
    for _ in range(int(math.log2(parts))):
        new = part * 2
        for p in np.unique(part):
            nodes = np.flatnonzero(part == p)
            place = np.full(n, -1)
            place[nodes] = np.arange(len(nodes))
            own = place[edges]
            new[nodes] += bisect(own[(own >= 0).all(axis=1)], len(nodes), rng)
        part = new
    most = math.ceil(slack * n / parts)
    for _ in range(sweeps):
        votes = np.zeros((n, parts), np.int32)
        np.add.at(votes, (edges[:, 0], part[edges[:, 1]]), 1)
        np.add.at(votes, (edges[:, 1], part[edges[:, 0]]), 1)
        gain = votes.max(axis=1) - votes[np.arange(n), part]
        sizes = np.bincount(part, minlength=parts)
        for i in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())]:
            to = int(votes[i].argmax())
            if sizes[to] < most:
                sizes[part[i]] -= 1
                sizes[to] += 1
                part[i] = to
    return part


class Router:
    """A network of one hidden layer that gives the probability of each part."""

    def __init__(self, dim: int, parts: int, hidden: int = HIDDEN):
        rng = np.random.default_rng(3)
        self.w = [rng.normal(size=(dim, hidden)) / math.sqrt(dim), np.zeros(hidden), rng.normal(size=(hidden, parts)) / math.sqrt(hidden), np.zeros(parts)]
        self.scale = 1.0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(x * self.scale @ self.w[0] + self.w[1])
        z = h @ self.w[2] + self.w[3]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def fit(self, x: np.ndarray, target: np.ndarray, epochs: int = 60, batch: int = 256, rate: float = 0.01) -> None:
        """Adam on the cross entropy with the target probabilities."""
        self.scale = 1.0 / max(1e-12, np.abs(x).std())
        rng = np.random.default_rng(5)
        m, v = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        step = 0
        for epoch in range(epochs):
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                own = x[rows] * self.scale
                h = np.tanh(own @ self.w[0] + self.w[1])
                d = (self(x[rows]) - target[rows]) / len(rows)
                dh = (d @ self.w[2].T) * (1 - h * h)
                step += 1
                now = rate * (1 - epoch / epochs)
                for i, g in enumerate((own.T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                    m[i] += 0.1 * (g - m[i])
                    v[i] += 0.01 * (g * g - v[i])
                    self.w[i] -= now * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)


def fit(sample: np.ndarray, parts: int, k: int) -> tuple[Router, int]:
    """The router, and how many parts a query visits."""
    sample = np.unique(sample, axis=0)
    sample = sample[np.random.default_rng(1).permutation(len(sample))]
    held = max(1, min(HELD_OUT, len(sample) // 8))
    asked, points = sample[:held], sample[held:] if len(sample) > held else sample
    router = Router(sample.shape[1], parts)
    if len(points) <= 2 * parts:
        return router, parts
    near = neighbours(points, points, min(10, len(points) - 1))
    part = balanced_parts(near, parts)
    target = np.eye(parts)[part] * 0.5
    np.add.at(target, (np.repeat(np.arange(len(points)), near.shape[1]), part[near.ravel()]), 0.5 / near.shape[1])
    router.fit(points, target)
    home = router(points).argmax(axis=1)
    wanted = home[neighbours(points, asked, min(k, len(points) - 1))]
    place = np.empty((held, parts), np.int64)
    np.put_along_axis(place, np.argsort(-router(asked), axis=1), np.arange(parts)[None, :], 1)
    depth = np.take_along_axis(place, wanted, 1)
    for visit in range(1, parts + 1):
        if (depth < visit).mean() >= RECALL:
            return router, visit
    return router, parts


def scored(points: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best points of each query among those that reach its floor. Rows that may be among them are scored anew one by one, so that equal vectors
    have equal scores."""
    out = []
    for at in range(0, len(queries), 256):
        q = queries[at : at + 256]
        rough = q @ points.T
        rough[ids[None, :] == query_ids[at : at + 256][:, None]] = -np.inf
        kth = np.partition(rough, -k, axis=1)[:, -k] if rough.shape[1] > k else np.full(len(q), -np.inf)
        kth = np.maximum(kth, floor[at : at + 256])
        slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(kth), kth, 0)))
        who, row = np.nonzero((rough >= (kth - slack)[:, None]) & (rough > -np.inf))
        for piece in range(0, len(who), 1 << 16) if len(who) else ():
            a, b = who[piece : piece + (1 << 16)], row[piece : piece + (1 << 16)]
            exact = np.einsum("ij,ij->i", q[a], points[b])
            keep = merge(k, a, exact, ids[b])
            out.append((a[keep] + at, b[keep], exact[keep]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    who, row, score = (np.concatenate(x) for x in zip(*out, strict=True))
    keep = merge(k, who, score, ids[row])
    return who[keep], row[keep], score[keep]


def visit(index: DataFrame, routed: DataFrame, k: int) -> DataFrame:
    """routed(dim, vec_id, v, floor, part, piece, block) against index(dim, vec_id, v, part, piece, block)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, asked = right["vec_id"].to_numpy(), left["vec_id"].to_numpy()
        if len(ids) and len(asked):
            dim = right["dim"][0].as_py()
            q, p, s = scored(matrix(right["v"], dim), ids, matrix(left["v"], dim), asked, left["floor"].to_numpy(), k)
        else:
            q, p, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return pa.table({"query_id": asked[q], "vec_id": ids[p], "score": s})

    keys = ["dim", "part", "piece", "block"]
    return routed.groupBy(keys).cogroup(index.groupBy(keys)).applyInArrow(run, FOUND)


def spread(rows: DataFrame, count: Column) -> DataFrame:
    """rows(vec_id, ...) of a written table in pieces of their part, count of them: by row, as very many may share an id."""
    return rows.withColumn("row", F.monotonically_increasing_id()).withColumn("piece", F.pmod(F.xxhash64("vec_id", "row"), count).cast("int")).drop("row")


def searched_whole(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The nearest of each query among all rows of its length, for lengths of few rows."""
    asked = asked.withColumns({"part": F.lit(0), "piece": F.lit(0), "block": F.lit(0), "floor": F.lit(float("-inf"))})
    return best(visit(rows.withColumns({"part": F.lit(0), "piece": F.lit(0), "block": F.lit(0)}), asked, k), k)


def searched(rows: DataFrame, asked: DataFrame, dim: int, n: int, k: int) -> DataFrame:
    """The nearest found of each query among n rows of one length."""
    parts = 2 ** max(1, min(int(math.log2(MOST_PARTS)), round(math.log2(max(2, n / ROWS_PER_PART)))))
    most = max(FIT_ROWS, FIT_ROWS_PER_PART * parts)
    h = F.xxhash64("vec_id")
    near = rows.where((h / F.lit(2.0**64) + 0.5) * n < 2 * most) if n > 2 * most else rows  # about twice as many as wanted are sorted
    fitted_on = near.select("v").orderBy(h, "vec_id", "v").limit(most).toArrow()
    router, visits = fit(matrix(fitted_on["v"], dim), parts, k)
    del fitted_on
    release()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = router(matrix(batch["v"], dim)) if batch.num_rows else np.zeros((0, parts))
            order = np.argsort(-p, axis=1, kind="stable").astype(np.int32)
            ranked = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * parts), pa.array(order.ravel()))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["dim"], batch["v"], pa.array(order[:, 0]), ranked], ["vec_id", "dim", "v", "part", "ranked"])

    located = lambda df: mapped(df.select("vec_id", "dim", "v"), route, "vec_id long, dim int, v array<double>, part int, ranked array<int>")
    index = stage(located(rows).drop("ranked"), "index")
    asked = stage(located(asked), "asked")
    size = block_rows(dim)
    mapping = lambda counts: F.create_map(*[F.lit(x) for p in range(parts) for x in (p, max(1, math.ceil(counts.get(p, 0) / size)))])
    pieces = mapping({r["part"]: r["count"] for r in index.groupBy("part").count().collect()})  # at most MOST_PARTS rows
    index = spread(index, pieces[F.col("part")])

    def ask(queries: DataFrame, start: int, count: int) -> DataFrame:
        to = queries.select("vec_id", "dim", "v", "floor", F.explode(F.slice("ranked", start, count)).alias("part"))
        blocks = mapping({r["part"]: r["count"] for r in to.groupBy("part").count().collect()})[F.col("part")]  # at most MOST_PARTS rows
        to = to.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(2)), blocks).cast("int"))
        copied = index.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        return visit(copied, to.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces[F.col("part")] - 1))), k)

    lowest = F.lit(float("-inf"))
    some = min(visits, 1 + max(1, visits // 6))
    found = stage(best(ask(asked.withColumn("floor", lowest), 1, 1), k).drop("rank"), "found")
    for start, end in ((2, some), (some + 1, visits)):  # each step starts from the kth score of those before
        if start <= end:
            kth = best(found, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
            started = asked.join(kth, "vec_id", "left").withColumn("floor", F.coalesce("floor", lowest))
            found = stage(best(found.unionByName(ask(started, start, end - start + 1)), k).drop("rank"), "found")
    if visits < parts:
        have = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("have"))
        short = asked.join(have, "vec_id", "left").where(F.coalesce("have", F.lit(0)) < min(k, n - 1)).drop("have")
        if not short.isEmpty():
            found = found.unionByName(ask(short.withColumn("floor", lowest), visits + 1, parts))
    return best(found, k)


def near_neighbours(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: rows whose vec_id is divisible by every ask for their k nearest."""
    rows = usable(vectors, zero=False).select("vec_id", "dim", "v")
    sizes = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().collect()}  # a row for each length
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = asking(rows, every)
    large = {dim: n for dim, n in sizes.items() if n >= LEAST_INDEXED}
    found = [searched(rows.where(F.col("dim") == dim), asked.where(F.col("dim") == dim), dim, n, k) for dim, n in sorted(large.items())]
    if len(large) < len(sizes):
        small = ~F.col("dim").isin(*large) if large else F.lit(True)
        found.append(searched_whole(rows.where(small), asked.where(small), k))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return best(out.drop("rank"), k) if len(found) > 1 else out


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_neighbours(table(spark, sf_dir, "embeddings"))
