"""Connected components of a graph given as pairs of long ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog_loom.llm.shared import join_by_size, observed


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """edges(a, b) to rows (node, root): every node of an edge and the smallest node that it reaches. A node with very many
    edges is not one task."""
    now, of = observed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", n=F.count("*"))
    if not of["n"]:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    total, seen = 2 * of["n"], None
    for _ in range(most):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("many"))
        large = join_by_size(both, lowest, "a", "many", total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("many"))
        small = join_by_size(large, lowest, "a", "many", total).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        joined = small.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct()
        now, state = observed(joined, "edges", n=F.count("*"), h=F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen, total = state, 2 * state["n"]
    raise RuntimeError("components did not settle")
