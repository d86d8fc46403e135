"""What both searches over embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


BLOCK_BYTES = 32 << 20
BLOCK_ROWS = 16384


def block_rows(dim: int) -> int:
    """How many vectors of a length a task takes at once."""
    return max(256, min(BLOCK_ROWS, BLOCK_BYTES // (8 * dim)))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A column of lists of one length as a two-dimensional array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def usable(vectors: DataFrame, zero: bool) -> DataFrame:
    """vec_id, v (array of double), dim: without null ids, null or empty vectors, or null or non-finite components, and
    without vectors of zeros unless zero."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.coalesce(bad, F.lit(True)))
    if not zero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    return rows.withColumn("dim", F.size("v"))


def asking(rows: DataFrame, every: int) -> DataFrame:
    """vec_id, dim, v of the queries, the rows whose vec_id is divisible by every: one for each vec_id, the least if its
    rows differ."""
    least = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("least"))
    return least.select("vec_id", "least.dim", "least.v")


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query: query_id, rank, vec_id, score."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def merge(k: int, owner: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Positions of the k best entries of each owner, in the order of owner, falling score, id."""
    order = np.lexsort((ids, -scores, owner))
    own = owner[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    place = np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)]))
    return order[place < k]
