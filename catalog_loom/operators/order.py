"""Places in a total order."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalog_loom.sources.files import written

_ROW_BITS = (1 << 33) - 1  # of monotonically_increasing_id, the number of the row in its partition


def numbered(rows: DataFrame, *order: Column | str, name: str = "place", start: int = 1) -> DataFrame:
    """rows with name, their place in the order from start on. Rows are sorted by range, each range in its own task; a
    place is the row's number in its range after the sizes of the ranges before. Ranges and numbers are written first, so
    that a lost task can't change them."""
    spark = rows.sparkSession
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    nth = F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS))
    parts = written(sorted_rows.withColumn("__part", F.spark_partition_id()).withColumn("__nth", nth), "numbered")
    offsets, before = [], start
    for part, n in sorted((r["__part"], r["count"]) for r in parts.groupBy("__part").count().collect()):  # one row for each range
        offsets.append((part, before))
        before += n
    if not offsets:
        return parts.drop("__part", "__nth").withColumn(name, F.lit(start).cast("bigint"))
    places = spark.createDataFrame(offsets, "__part int, __before bigint")
    return parts.join(F.broadcast(places), "__part").withColumn(name, F.col("__before") + F.col("__nth")).drop("__part", "__nth", "__before")


def order_statistics(rows: DataFrame, column: str, fractions: tuple[float, ...]) -> list[float | None]:
    """Exact quantiles of a column, between neighbours in proportion; null without values. Values are counted, sorted by range,
    and of each wanted place only the range that holds it is looked into, so that no task has all values."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("value")).agg(F.count("*").alias("n"))
    parts = written(counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()), "values")
    sizes = sorted((r["part"], r["n"]) for r in parts.groupBy("part").agg(F.sum("n").alias("n")).collect())  # one row for each range
    total = sum(n for _, n in sizes)
    if not total:
        return [None] * len(fractions)
    wanted = sorted({int(side) for f in fractions for side in (math.floor(f * (total - 1)), math.ceil(f * (total - 1)))})
    before, looked = 0, []
    for part, n in sizes:
        looked += [(part, before, p) for p in wanted if before <= p < before + n]
        before += n
    places = rows.sparkSession.createDataFrame(looked, "part int, before bigint, place bigint")
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("value"))
    near = parts.join(F.broadcast(places.select("part").distinct()), "part", "left_semi").withColumn("upto", upto)
    held = near.join(F.broadcast(places), "part").where((F.col("place") < F.col("before") + F.col("upto")) & (F.col("place") >= F.col("before") + F.col("upto") - F.col("n")))
    value = {r["place"]: r["value"] for r in held.collect()}  # two rows for each fraction at most
    found = []
    for f in fractions:
        at = f * (total - 1)
        low, high = math.floor(at), math.ceil(at)
        found.append(value[low] if low == high else (high - at) * value[low] + (at - low) * value[high])
    return found
