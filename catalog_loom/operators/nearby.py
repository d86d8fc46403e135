"""Exact nearest vectors by cosine, for many queries, with bounds.

Vectors lie in cells around pivots (vectors of smallest hash), and within a cell in blocks by their angle to its pivot. By the
triangle inequality of angles a query's similarity with a vector of a block is at most the cosine of how far the query's own
angle to the pivot is from those of the block. Each query first goes to the FIRST blocks of greatest bound; the kth similarity
that it finds there goes with it to all blocks whose bound reaches it, and in a block to the CHUNK rows at a time whose bound
reaches it. The result is that of scoring all pairs.

A block has about BLOCK rows: bins of angles are put together up to that, and a bin with more rows is dealt to pieces,
whatever ids its rows have.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalog_loom.sources.files import written

CELL_ROWS = 4096
MOST_CELLS = 1024
BINS = 64
BLOCK = 4096
ASKED = 2048
FIRST = 2
CHUNK = 256
#: Angles are known to about 1e-8 where vectors nearly agree, similarities to 1e-12.
ANGLE_SLACK, SLACK = 1e-7, 1e-9
FOUND = "query_id long, id long, similarity double"


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def usual_size(vectors: DataFrame) -> int:
    """The length that most vectors have; the others take no part."""
    sizes = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))
    found = sizes.orderBy(F.desc("n"), "dim").first()
    return found["dim"] if found else 0


def unit(rows: DataFrame, key: str, dim: int) -> DataFrame:
    """key, v of the vectors of length dim without null or non-finite components, scaled to length 1; those of zeros stay."""
    fine = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    own = rows.where(F.size("embedding") == dim).select(F.col(key).cast("long").alias(key), F.col("embedding").cast("array<double>").alias("embedding")).where(fine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = matrix(batch["embedding"], dim)
            m = m / np.maximum(np.abs(m).max(axis=1, keepdims=True), 1e-300) if len(m) else m  # so that no square is out of range
            m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
            yield pa.RecordBatch.from_arrays([batch[key], listed(m)], [key, "v"])

    return own.mapInArrow(run, f"{key} long, v array<double>")


def listed(m: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))


def angles(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(m @ pivots.T, -1.0, 1.0))


class Blocks:
    """cell, low, high (angle to its pivot) and pieces of each block; the last cell is that of the vectors of zeros."""

    def __init__(self, pivots: np.ndarray, bins: list, block: int):
        self.pivots, self.of_bin = pivots, []
        cell, low, high, rows = [], [], [], []
        for r in sorted(bins, key=lambda r: (r["cell"], r["bin"])):
            if not cell or cell[-1] != r["cell"] or rows[-1] + r["n"] > block:
                cell.append(r["cell"])
                low.append(r["low"])
                high.append(r["high"])
                rows.append(0)
            high[-1], rows[-1] = r["high"], rows[-1] + r["n"]
            self.of_bin.append((r["cell"], r["bin"], len(cell) - 1))
        self.cell, self.low, self.high, self.rows = np.array(cell), np.array(low), np.array(high), np.array(rows)
        self.pieces = -(-self.rows // block)

    def bounds(self, m: np.ndarray) -> np.ndarray:
        """The greatest similarity that each vector can have with one of each block."""
        zeros = self.cell == len(self.pivots)
        own = angles(m, self.pivots)[:, np.where(zeros, 0, self.cell)] if len(self.pivots) else np.zeros((len(m), len(self.cell)))
        away = np.maximum(np.maximum(own - self.high, self.low - own) - ANGLE_SLACK, 0.0)
        return np.where(zeros, 0.0, np.cos(np.minimum(away, np.pi)))


def celled(rows: DataFrame, pivots: np.ndarray, dim: int) -> DataFrame:
    """id, v, cell and angle of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = matrix(batch["v"], dim)
            cell, angle = np.full(len(m), len(pivots), np.int32), np.zeros(len(m))
            for at in range(0, len(m) if len(pivots) else 0, 1024):
                own = angles(m[at : at + 1024], pivots)
                cell[at : at + 1024] = own.argmin(axis=1)
                angle[at : at + 1024] = own.min(axis=1)
            zero = ~m.any(axis=1)
            cell[zero], angle[zero] = len(pivots), 0.0
            yield pa.RecordBatch.from_arrays([batch["id"], batch["v"], pa.array(cell), pa.array(angle)], ["id", "v", "cell", "angle"])

    return rows.mapInArrow(run, "id long, v array<double>, cell int, angle double")


def aimed(queries: DataFrame, blocks: Blocks, dim: int, first: bool) -> DataFrame:
    """query_id, v, floor, block: queries(query_id, v, floor), each with the FIRST blocks of greatest bound or with all whose
    bound reaches its floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                bound = blocks.bounds(matrix(batch["v"], dim))
                if first:
                    to = np.zeros(bound.shape, bool)
                    np.put_along_axis(to, np.argsort(-bound, axis=1, kind="stable")[:, :FIRST], True, axis=1)
                else:
                    to = bound >= batch["floor"].to_numpy()[:, None]
                row, block = np.nonzero(to)
                offsets = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch["query_id"], batch["v"], batch["floor"], pa.ListArray.from_arrays(offsets, pa.array(block.astype(np.int32)))], ["query_id", "v", "floor", "blocks"])

    sent = queries.select("query_id", "v", "floor").mapInArrow(run, "query_id long, v array<double>, floor double, blocks array<int>")
    return sent.select("query_id", "v", "floor", F.explode("blocks").alias("block"))


def best(k: int, owner: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Positions of the k best entries of each owner: greatest score, then smallest id."""
    order = np.lexsort((ids, -score, owner))
    own = owner[order]
    place = np.arange(len(own)) - np.searchsorted(own, own)
    return order[place < k]


def scored(asked: DataFrame, base: DataFrame, blocks: Blocks, dim: int, k: int, pieces: np.ndarray) -> DataFrame:
    """query_id, id, similarity: the k best rows of each query in each piece of a block that it is sent to. A task has one piece
    and at most about ASKED queries."""
    spark = base.sparkSession
    counts = asked.groupBy("block").agg(F.count("*").alias("n")).collect()  # a row for each block
    facts = F.broadcast(spark.createDataFrame([(r["block"], int(pieces[r["block"]]), -(-r["n"] // ASKED)) for r in counts], "block int, pieces int, parts int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    left = asked.join(facts, "block").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int")).withColumn("piece", F.explode(upto("pieces"))).drop("pieces", "parts")
    right = base.join(facts.drop("pieces"), "block").withColumn("part", F.explode(upto("parts"))).drop("parts")
    keys = ["block", "piece", "part"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        owner, score, ids = [], [], []
        if left.num_rows and right.num_rows:
            right = right.sort_by("angle")
            points, angle, own_ids = matrix(right["v"], dim), right["angle"].to_numpy(), right["id"].to_numpy()
            q, floor = matrix(left["v"], dim), left["floor"].to_numpy()
            cell = blocks.cell[right["block"][0].as_py()]
            to_pivot = angles(q, blocks.pivots[cell : cell + 1])[:, 0] if cell < len(blocks.pivots) else np.zeros(len(q))
            for at in range(0, len(points), CHUNK):
                low, high = angle[at], angle[min(at + CHUNK, len(points)) - 1]
                away = np.maximum(np.maximum(to_pivot - high, low - to_pivot) - ANGLE_SLACK, 0.0)
                some = np.flatnonzero((np.cos(away) if cell < len(blocks.pivots) else 0.0 * away) >= floor)
                s = np.round(q[some] @ points[at : at + CHUNK].T, 12)
                row, col = np.nonzero(s >= floor[some][:, None])
                owner.append(some[row])
                score.append(s[row, col])
                ids.append(own_ids[at + col])
        if not owner:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        owner, score, ids = np.concatenate(owner), np.concatenate(score), np.concatenate(ids)
        keep = best(k, owner, score, ids)
        return pa.table({"query_id": left["query_id"].to_numpy()[owner[keep]], "id": ids[keep], "similarity": score[keep]})

    return left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(run, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, cell_rows: int = CELL_ROWS, block: int = BLOCK) -> tuple[DataFrame, DataFrame, Blocks | None]:
    """query_id, id, similarity and rank of the k nearest of each of queries(query_id, embedding), and what was done for it:
    the queries as they were sent to blocks, and the blocks.

    Vectors that are null, hold null or non-finite components or have another length than most take no part; vectors and
    queries of zeros have similarity 0 with all; rows that repeat an id are vectors each; ties go to the smaller id."""
    spark = vectors.sparkSession
    dim = usual_size(vectors)
    rows = written(unit(vectors, "id", dim), "unit") if dim else None
    n = rows.count() if dim else 0
    if not n:
        return spark.createDataFrame([], f"{FOUND}, rank int"), spark.createDataFrame([], "query_id long, block int"), None
    chosen = rows.where(F.exists("v", lambda x: x != 0)).orderBy(F.xxhash64("id"), "id").limit(max(1, min(MOST_CELLS, n // cell_rows))).select("v").toArrow()
    pivots = np.unique(matrix(chosen["v"], dim), axis=0) if chosen.num_rows else np.zeros((0, dim))
    base = written(celled(rows, pivots, dim).withColumn("bin", F.least(F.floor(F.col("angle") / math.pi * BINS), F.lit(BINS - 1)).cast("int")), "cells")
    bins = base.groupBy("cell", "bin").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect()  # BINS rows for each cell at most
    blocks = Blocks(pivots, bins, block)
    of_bin = F.broadcast(spark.createDataFrame([(*b, int(blocks.pieces[b[2]])) for b in blocks.of_bin], "cell int, bin int, block int, pieces int"))
    base = base.withColumn("piece_of", F.monotonically_increasing_id()).join(of_bin, ["cell", "bin"])
    base = base.withColumn("piece", F.pmod(F.xxhash64("id", "piece_of"), F.col("pieces")).cast("int")).select("id", "v", "angle", "block", "piece")

    asked = written(unit(queries, "query_id", dim).withColumn("floor", F.lit(-2.0)), "asked")
    zero = ~F.exists("v", lambda x: x != 0)
    directed = asked.where(~zero)
    firsts = ranked(scored(aimed(directed, blocks, dim, True), base.where("piece = 0"), blocks, dim, k, np.ones_like(blocks.pieces)), k)
    kth = written(firsts.where(F.col("rank") == k).select("query_id", (F.col("similarity") - SLACK).alias("kth")), "kth")
    sent = aimed(directed.join(kth, "query_id", "left").withColumn("floor", F.coalesce("kth", "floor")), blocks, dim, False)
    found = scored(sent, base, blocks, dim, k, blocks.pieces)
    least = F.broadcast(rows.select("id").orderBy("id").limit(k))  # k rows, for queries of zeros
    same = asked.where(zero).select("query_id").join(least, F.lit(True)).select("query_id", "id", F.lit(0.0).alias("similarity"))
    return ranked(found.unionByName(same), k), sent.select("query_id", "block"), blocks
