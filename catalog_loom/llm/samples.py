"""Bounded samples of labelled documents to fit classifiers on."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 32 << 20


def remainder(by: int) -> Column:
    """crc32 of the doc_id as text, modulo by; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % by


def held_out(by: int, rest: int) -> Column:
    return F.coalesce(remainder(by) == rest, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, by: int, rest: int, most: tuple[int, int]) -> tuple[pa.ChunkedArray, np.ndarray, np.ndarray]:
    """Whole texts, labels and weights of labelled documents that are not held out: of each class those of smallest hash,
    at most the number given in most and MOST_BYTES of text (a text that doesn't fit any more is left out of the fit). The
    weights restore the shares of the classes. A doc_id with several labels takes the largest, one with several texts the
    first of them."""
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (remainder(by) != rest)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    known = known.withColumn("h", F.xxhash64("doc_id"))
    totals = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y)
        if totals.get(y, 0) > 2 * most[y]:  # about twice as many as wanted are sorted, whatever the size of the table
            part = part.where((F.col("h") / F.lit(2.0**64) + 0.5) * totals[y] < 2 * most[y])
        part = part.orderBy("h", "doc_id").limit(most[y])
        chosen = part if chosen is None else chosen.unionByName(part)
    some = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")  # at most sum(most) rows
    sizes = some.groupBy("doc_id", "y", "h").agg(F.min(F.octet_length("text")).alias("bytes")).collect()
    left, wanted = {0: MOST_BYTES, 1: MOST_BYTES}, []
    for row in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        if row["bytes"] <= left[row["y"]]:
            left[row["y"]] -= row["bytes"]
            wanted.append((row["doc_id"], row["bytes"]))
    if not wanted:
        return pa.chunked_array([], pa.string()), np.zeros(0, np.int64), np.zeros(0)
    fits = spark.createDataFrame(wanted, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, bytes int")
    texts = some.join(F.broadcast(fits), "doc_id").where(F.octet_length("text") == F.col("bytes")).groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    got = texts.toArrow().sort_by("doc_id")
    y = got["y"].to_numpy().astype(np.int64)
    have = np.bincount(y, minlength=2)
    weight = np.array([totals.get(c, 0) / have[c] if have[c] else 0.0 for c in (0, 1)])
    return got["text"], y, weight[y]
