"""Exact top-k by inner product: a ball tree for each shard, searched by branch and bound.

Vectors go to the nearest of some centers (vectors of smallest hash, one for every CLUSTER_ROWS rows and MOST_CLUSTERS at
most); a shard is a cluster, or a piece of about block_rows(length) rows of a large one. The current kth score is shared: each query
first searches a piece of the clusters whose centers score highest, and the kth score that it finds there goes with it. A
query is then sent only to clusters whose bound, q.center + |q| * radius, reaches its kth score. Each task holds one shard
and one block of queries; it builds the shard's ball tree, bounds its nodes in the same way, drops those whose bound is below
the query's current kth score, and visits the leaves left in the order of their bounds. A shard is copied once for
every block_rows(length) queries that are sent to its cluster. Partial lists of k are merged by a window.

Defined cases: vectors that are null, empty, or hold null or non-finite components, and null ids, take no part; vectors
are only compared with those of their own length; rows that repeat a vec_id are candidates each, dealt to pieces like any
others, and none is one for the query with that id; a repeated query is answered once, for the least of its vectors; ties go to the smaller vec_id; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalog_loom.llm.shared import mapped, stage, table
from catalog_loom.llm.vectors import asking, best, block_rows, matrix, merge, usable

CLUSTER_ROWS = 4096
MOST_CLUSTERS = 1024
FIRST_CLUSTERS = 2
LEAF_ROWS = 128
FOUND = "query_id long, vec_id long, score long"


class BallTree:
    """Nodes in the order of their making: rows low to high of points, center, radius, left child (0: a leaf)."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.order = np.arange(len(points))
        self.low, self.high, self.left, centers, radii = [0], [len(points)], [], [], []
        at = 0
        while at < len(self.low):
            low, high = self.low[at], self.high[at]
            rows = self.order[low:high]
            own = points[rows]
            center = own.mean(axis=0)
            far = np.einsum("ij,ij->i", own - center, own - center)
            centers.append(center)
            radii.append(math.sqrt(far.max()))
            self.left.append(0)
            if high - low > leaf_rows and far.max() > 0:
                a = own[far.argmax()]
                b = own[np.einsum("ij,ij->i", own - a, own - a).argmax()]
                side = own @ (b - a)
                half = (high - low) // 2
                self.order[low:high] = rows[np.argpartition(side, half)]
                self.left[at] = len(self.low)
                self.low += [low, low + half]
                self.high += [low + half, high]
            at += 1
        self.left, self.centers, self.radii = np.array(self.left), np.array(centers), np.array(radii)


def search(points: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best points of each query among those that reach its floor: query positions, point positions, scores."""
    biggest = (np.abs(points).max(initial=0), np.abs(queries).max(initial=0))
    exact = biggest[0] * biggest[1] * points.shape[1] < 2**52
    whole = (lambda a: a) if exact else (lambda a: a.astype(np.int64))
    tree = BallTree(points)
    norms = np.sqrt(np.einsum("ij,ij->i", queries, queries))
    kth = floor.astype(np.float64)
    who, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
    leaves: list[tuple[np.ndarray, ...]] = []
    while len(who):
        bound = np.einsum("ij,ij->i", queries[who], tree.centers[node]) + norms[who] * tree.radii[node]
        bound += 1e-6 + 1e-9 * np.abs(bound)
        keep = bound >= kth[who]
        who, node, bound = who[keep], node[keep], bound[keep]
        leaf = tree.left[node] == 0
        leaves.append((who[leaf], node[leaf], bound[leaf]))
        inner, below = who[~leaf], tree.left[node[~leaf]]
        who, node = np.r_[inner, inner], np.r_[below, below + 1]
    who, node, bound = (np.concatenate(x) for x in zip(*leaves, strict=True)) if leaves else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((-bound, who))
    who, node, bound = who[order], node[order], bound[order]
    first = np.searchsorted(who, np.arange(len(queries)))
    turn = np.arange(len(who)) - first[who] if len(who) else who
    found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
    for t in range(int(turn.max(initial=-1)) + 1):
        now = np.flatnonzero((turn == t) & (bound >= kth[who]))
        if not len(now):
            continue
        now = now[np.argsort(node[now], kind="stable")]
        new = [found]
        for part in np.split(now, np.flatnonzero(np.diff(node[now])) + 1):
            rows = tree.order[tree.low[node[part[0]]] : tree.high[node[part[0]]]]
            asking = who[part]
            scores = whole(queries[asking]) @ whole(points[rows]).T
            q, p = np.nonzero((scores >= kth[asking][:, None]) & (ids[rows][None, :] != query_ids[asking][:, None]))
            new.append([asking[q], rows[p], scores[q, p].astype(np.int64)])
        found = [np.concatenate(x) for x in zip(*new, strict=True)]
        chosen = merge(k, found[0], found[2], ids[found[1]])
        found = [x[chosen] for x in found]
        full = np.flatnonzero(np.bincount(found[0], minlength=len(queries)) == k)
        ends = np.searchsorted(found[0], full, "right") - 1
        kth[full] = np.maximum(kth[full], found[2][ends])
    return found[0], found[1], found[2]


def centers(rows: DataFrame, sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """Of each length of vectors the centers of the clusters, different ones."""
    want = {dim: max(1, min(MOST_CLUSTERS, n // CLUSTER_ROWS)) for dim, n in sizes.items()}
    part = rows.sparkSession.createDataFrame([(dim, sizes[dim] / want[dim], want[dim]) for dim in sizes], "dim int, part double, want int")
    rank = (F.xxhash64("vec_id", F.lit(3)) / F.lit(2.0**64) + 0.5) * F.col("part")  # about the place among the hashes, in parts
    near = rows.join(F.broadcast(part), "dim").withColumn("rank", rank).where((F.col("rank") < 8) | (F.col("part") * F.col("want") < 64))
    near = near.groupBy("dim", "want", "vec_id").agg(F.min("rank").alias("rank"), F.min("v").alias("v"))  # very many rows may share an id
    nth = F.row_number().over(Window.partitionBy("dim").orderBy("rank", "vec_id"))
    chosen = near.withColumn("nth", nth).where(F.col("nth") <= F.col("want")).select("dim", "v").toArrow()
    of = chosen["dim"].to_numpy()
    return {int(dim): np.unique(matrix(chosen.filter(pa.array(of == dim))["v"], int(dim)), axis=0) for dim in np.unique(of)}


def clustered(rows: DataFrame, found: dict[int, np.ndarray]) -> DataFrame:
    """vec_id, dim, v, cluster and the distance from its center of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch["dim"].to_numpy()
            for dim in np.unique(of).tolist():
                some = batch.filter(pa.array(of == dim))
                points, own = matrix(some["v"], dim), found[dim]
                squares = np.einsum("ij,ij->i", own, own)
                cluster = np.concatenate([(squares - 2 * points[at : at + 1024] @ own.T).argmin(axis=1) for at in range(0, len(points), 1024)])
                away = points - own[cluster]
                yield pa.RecordBatch.from_arrays([some["vec_id"], some["dim"], some["v"], pa.array(cluster.astype(np.int32)), pa.array(np.sqrt(np.einsum("ij,ij->i", away, away)))], ["vec_id", "dim", "v", "cluster", "far"])

    return mapped(rows.select("vec_id", "dim", "v"), run, "vec_id long, dim int, v array<double>, cluster int, far double")


def aimed(queries: DataFrame, found: dict[int, np.ndarray], radii: dict[int, np.ndarray], first: bool) -> DataFrame:
    """queries(vec_id, dim, v, floor), each with its clusters: those of the FIRST_CLUSTERS centers that score highest, or
    all whose bound reaches floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch["dim"].to_numpy()
            for dim in np.unique(of).tolist():
                some = batch.filter(pa.array(of == dim))
                v = matrix(some["v"], dim)
                scores = v @ found[dim].T
                if first:
                    to = np.zeros(scores.shape, bool)
                    np.put_along_axis(to, np.argsort(-scores, axis=1, kind="stable")[:, :FIRST_CLUSTERS], True, axis=1)
                else:
                    bound = scores + np.sqrt(np.einsum("ij,ij->i", v, v))[:, None] * radii[dim][None, :]
                    to = bound + 1e-6 + 1e-9 * np.abs(bound) >= some["floor"].to_numpy()[:, None]
                row, cluster = np.nonzero(to)
                offsets = pa.array(np.searchsorted(row, np.arange(len(v) + 1)).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(cluster.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(some[c] for c in ("vec_id", "dim", "v", "floor")), lists], ["vec_id", "dim", "v", "floor", "clusters"])

    sent = mapped(queries.select("vec_id", "dim", "v", "floor"), run, "vec_id long, dim int, v array<double>, floor double, clusters array<int>")
    return sent.select("vec_id", "dim", "v", "floor", F.explode("clusters").alias("cluster"))


def grid(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query in each cluster (dim, cluster) that it is sent to; rows and queries have a piece."""
    counts = asked.groupBy("dim", "cluster").agg((F.count("*") / F.count_distinct("piece")).alias("n")).collect()  # a row for each center
    blocks = [(r["dim"], r["cluster"], max(1, math.ceil(r["n"] / block_rows(r["dim"])))) for r in counts]
    blocks = F.broadcast(rows.sparkSession.createDataFrame(blocks, "dim int, cluster int, blocks int"))
    keys = ["dim", "cluster", "piece", "block"]
    asked = asked.join(blocks, ["dim", "cluster"]).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.col("blocks")).cast("int")).drop("blocks")
    base = rows.join(blocks, ["dim", "cluster"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        dim = right["dim"][0].as_py()
        ids, asking_ids = right["vec_id"].to_numpy(), left["vec_id"].to_numpy()
        q, p, scores = search(matrix(right["v"], dim), ids, matrix(left["v"], dim), asking_ids, left["floor"].to_numpy(), k)
        return pa.table({"query_id": asking_ids[q], "vec_id": ids[p], "score": scores})

    return asked.groupBy(keys).cogroup(base.groupBy(keys)).applyInArrow(run, FOUND)


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: rows whose vec_id is divisible by every ask for their k best."""
    spark = vectors.sparkSession
    rows = usable(vectors, zero=True).withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))
    rows = stage(rows.select("vec_id", "dim", "v"), "vectors")
    sizes = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().collect()}  # a row for each length
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = centers(rows, sizes)
    base = stage(clustered(rows, found), "clustered")
    radii = {dim: np.full(len(c), -np.inf) for dim, c in found.items()}
    pieces = []
    for r in base.groupBy("dim", "cluster").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():  # a row for each center
        radii[r["dim"]][r["cluster"]] = r["far"]
        pieces.append((r["dim"], r["cluster"], math.ceil(r["n"] / block_rows(r["dim"]))))
    pieces = F.broadcast(spark.createDataFrame(pieces, "dim int, cluster int, pieces int"))
    dealt = base.withColumn("row", F.monotonically_increasing_id()).join(pieces, ["dim", "cluster"])  # by row, as very many may share an id
    base = dealt.withColumn("piece", F.pmod(F.xxhash64("vec_id", "row"), F.col("pieces")).cast("int")).drop("pieces", "far", "row")

    asked = stage(asking(rows, every), "asked")
    lowest = F.lit(-(2.0**62))
    first = aimed(asked.withColumn("floor", lowest), found, radii, True).withColumn("piece", F.lit(0))
    seed = best(grid(base.where("piece = 0"), first, k), k)
    kth = stage(seed.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("kth")), "kth")
    started = asked.join(kth, "vec_id", "left").withColumn("floor", F.coalesce("kth", lowest))
    sent = aimed(started, found, radii, False).join(pieces, ["dim", "cluster"])
    sent = sent.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    return best(grid(base, sent, k), k)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
