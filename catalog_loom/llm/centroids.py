"""Centroid clustering with a vantage-point tree over the centroids.

Each round builds a vantage-point tree of the centroids in the driver, broadcasts it, and lets every vector look for its
nearest centroid by best-first branch and bound: a vector opens its own nodes in the order of their lower bounds, as long as
the bound is not above the distance that it has found (inclusive, so that an equally near centroid of smaller number is
met). A node's own points are compared by exact integer distances. All vectors of a batch take their steps together, each
on a node of its own.

A task adds its vectors up by centroid in whole numbers; only these sums, a row for each centroid and task, are shuffled, and
only the new centroids come to the driver. The whole vectors are written once and read once a round.

Defined cases: vectors that are null, hold null or non-finite components or have another length than dim take no part, nor do
those with a component of LIMIT or more after scaling, as their distances are no longs; rows that repeat a vec_id are vectors
each; a null vec_id comes last in the order of the first centroids, and rows of one vec_id there come in the order of their
components; with fewer vectors than k there are as many centroids as vectors; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog_loom.llm.shared import mapped, stage, table
from catalog_loom.llm.vectors import matrix

LIMIT = 1 << 27
LEAF = 4
SPREAD_OF = 64
FAR = np.iinfo(np.int64).max


class VantageTree:
    """Nodes in the order of their making. points: numbers of the centroids that a node compares (-1: none), one for an inner
    node, its vantage point; kids: its near and its far child (0: none), and near, far: the least and greatest distance
    of each child's centroids from the vantage point."""

    def __init__(self, centroids: np.ndarray, leaf: int = LEAF):
        self.centroids = centroids
        points, kids, near, far = [], [], [], []
        waiting = [np.arange(len(centroids))]
        for own in waiting:
            points.append(np.full(leaf, -1))
            kids.append([0, 0])
            near.append([0.0, 0.0])
            far.append([0.0, 0.0])
            if len(own) <= leaf:
                points[-1][: len(own)] = own
                continue
            tried = own[:: max(1, len(own) // SPREAD_OF)]
            away = np.array([((centroids[own] - centroids[t]) ** 2).sum(axis=1) for t in tried])
            best = int(np.sqrt(away.astype(float)).var(axis=1).argmax())  # the point that tells the others apart best
            points[-1][0] = tried[best]
            rest = own != tried[best]
            order = np.argsort(away[best][rest], kind="stable")
            others, distance = own[rest][order], np.sqrt(away[best][rest][order].astype(float))
            half = (len(others) + 1) // 2
            for side, part in enumerate((slice(None, half), slice(half, None))):
                kids[-1][side] = len(waiting)
                near[-1][side], far[-1][side] = distance[part][0], distance[part][-1]
                waiting.append(others[part])
        self.points, self.kids, self.near, self.far = np.array(points), np.array(kids), np.array(near), np.array(far)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of the nearest centroid of each vector, and how many distances were taken."""
        n, taken = len(vectors), 0
        bounds = np.full((n, len(self.points)), np.inf)
        bounds[:, 0] = 0
        number, distance = np.full(n, len(self.centroids)), np.full(n, FAR)
        going = np.arange(n)
        while len(going):
            node = bounds[going].argmin(axis=1)
            bound = bounds[going, node]
            open_ = bound <= np.sqrt(distance[going].astype(float)) * (1 + 1e-12)
            going, node, bound = going[open_], node[open_], bound[open_]
            bounds[going, node] = np.inf
            own = self.points[node]
            first = None
            for column in range(own.shape[1]):
                has = np.flatnonzero(own[:, column] >= 0)
                if not len(has):
                    break
                who, c = going[has], own[has, column]
                away = vectors[who] - self.centroids[c]
                d = np.einsum("ij,ij->i", away, away)
                taken += len(d)
                first = d if column == 0 else first
                better = (d < distance[who]) | ((d == distance[who]) & (c < number[who]))
                distance[who[better]], number[who[better]] = d[better], c[better]
            if first is None:
                continue
            from_vantage = np.sqrt(first.astype(float))
            for side in (0, 1):
                inner = np.flatnonzero(self.kids[node, side])
                at, d = node[inner], from_vantage[inner]
                low, high = self.near[at, side], self.far[at, side]
                lower = np.maximum(low - d, d - high) - 1e-12 * (d + high + 1)  # rounding never makes a bound too high
                bounds[going[inner], self.kids[at, side]] = np.maximum(lower, bound[inner])
        return number, distance, taken


def whole(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """vec_id and v, the scaled components as integers, of the vectors that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.size("v") == dim)
    fits = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x * scale) < LIMIT), F.lit(False)))
    return rows.where(fits).select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("int")).alias("v"))


def numbers(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return matrix(batch["v"], dim).astype(np.int64)


def first_centroids(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = rows.select(digest.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()  # k rows at most
    return np.array([r["v"] for r in chosen], dtype=np.int64)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    spark = rows.sparkSession
    k, dim = centroids.shape
    tree = spark.sparkContext.broadcast(VantageTree(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = numbers(batch, dim)
            number, _, _ = tree.value.nearest(vectors)
            order = np.argsort(number, kind="stable")
            found, at = np.unique(number[order], return_index=True)
            sums[found] += np.add.reduceat(vectors[order], at, axis=0)
            counts += np.bincount(number, minlength=k)
        has = np.flatnonzero(counts)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * dim), pa.array(sums[has].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(counts[has]), lists], ["cluster", "n", "sums"])

    parts = mapped(rows.select("v"), run, "cluster int, n long, sums array<long>")
    added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(dim)]).alias("sums"))
    out = centroids.copy()
    for r in added.collect():  # a row for each centroid
        out[r["cluster"]] = [int(s) // r["n"] for s in r["sums"]]
    tree.unpersist()
    return out


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: str = "1") -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and distance (squared, in scaled components) of each vector, and the centroids."""
    spark = vectors.sparkSession
    rows = stage(whole(vectors, dim, scale), "whole")
    centroids = first_centroids(rows, k, seed)
    schema = "vec_id long, cluster int, distance long"
    if not len(centroids):
        return spark.createDataFrame([], schema), centroids
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    tree = spark.sparkContext.broadcast(VantageTree(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, distance, _ = tree.value.nearest(numbers(batch, dim))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return mapped(rows, run, schema), centroids


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = clusters(table(spark, sf_dir, "embeddings"))
    rows = stage(found, "clusters")
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row for each centroid
    total = sum(sums.values())
    of = [(c, s, total, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    facts = spark.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 16, rounds: int = 3) -> str:
    square = "list_sum(list_transform(list_zip(v.e, c.e), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"
    steps = [
        f"""v AS (SELECT row_number() OVER () AS rid, vec_id, e FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(64 * CAST(x AS DOUBLE)) >= {LIMIT})) = 0))""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, e) - 1 AS k, e FROM v QUALIFY k < {k})",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS (SELECT rid, min([{square}, c.k]) AS m FROM v, c{r} AS c GROUP BY rid)")
        if r < rounds:
            steps.append(f"s{r} AS (SELECT k, i, sum(x) AS s, count(*) AS n FROM (SELECT a.m[2] AS k, unnest(v.e) AS x, generate_subscripts(v.e, 1) AS i FROM v JOIN a{r} AS a USING (rid)) GROUP BY k, i)")
            steps.append(f"c{r + 1} AS (SELECT c.k, coalesce(n.e, c.e) AS e FROM c{r} AS c LEFT JOIN (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS e FROM s{r} GROUP BY k) AS n USING (k))")
    return f"""
WITH {", ".join(steps)}
SELECT v.vec_id, CAST(a.m[2] AS INTEGER) AS cluster, CAST(a.m[1] AS BIGINT) AS distance, CAST(sum(a.m[1]) OVER (PARTITION BY a.m[2]) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.m[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM v JOIN a{rounds} AS a USING (rid) JOIN c{rounds} AS c ON c.k = a.m[2]
"""


SQL = _sql()
