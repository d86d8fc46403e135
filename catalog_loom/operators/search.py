"""Finding names that contain a text without reading all names: posting lists of trigrams, and a look at what they leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 3
MOST_GRAMS = 4
PARTS = 64
POSTINGS = "gram string, id bigint, part int"
GRAMS = "gram string, n bigint, part int"


def grams_of(text: Column) -> Column:
    """The different runs of SIZE characters of a text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (SIZE - 1)), lambda i: F.substr(text, i, F.lit(SIZE))))


def part_of(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(PARTS)).cast("int")


def build(names: DataFrame, folder: str) -> None:
    """The index of names(id, name) below folder: postings and the number of names of each gram, dealt to parts by gram and sorted
    within them, so that a search reads a few row groups."""
    low = F.lower("name")
    postings = names.where(F.length(low) >= SIZE).select("id", F.explode(grams_of(low)).alias("gram")).withColumn("part", part_of(F.col("gram")))
    # A gram that very many names have is dealt to several tasks: ids are ranges within it.
    postings.select("gram", "id", "part").repartitionByRange("part", "gram", "id").sortWithinPartitions("part", "gram", "id").write.partitionBy("part").parquet(f"{folder}/postings")
    read = names.sparkSession.read.schema(POSTINGS).parquet(f"{folder}/postings")
    counts = read.groupBy("part", "gram").agg(F.count("*").alias("n"))
    counts.repartitionByRange("part", "gram").sortWithinPartitions("part", "gram").select("gram", "n", "part").write.partitionBy("part").parquet(f"{folder}/grams")


def candidates(spark: SparkSession, folder: str, text: str, most: int = MOST_GRAMS) -> DataFrame | None:
    """id of the names that have the rarest grams of a text, most of them; None if it is too short to have one. Names that
    contain the text are among them."""
    low = text.lower()
    wanted = sorted({low[i : i + SIZE] for i in range(len(low) - SIZE + 1)})
    if not wanted:
        return None
    asked = F.broadcast(spark.createDataFrame([(g,) for g in wanted], "gram string"))
    parts = [r["part"] for r in asked.select(part_of(F.col("gram")).alias("part")).distinct().collect()]  # of one text's grams
    counts = spark.read.schema(GRAMS).parquet(f"{folder}/grams").where(F.col("part").isin(parts) & F.col("gram").isin(wanted))
    known = {r["gram"]: (r["n"], r["part"]) for r in counts.collect()}
    if len(known) < len(wanted):  # a gram that no name has
        return spark.createDataFrame([], "id bigint")
    rare = sorted(wanted, key=lambda g: (known[g][0], g))[:most]
    postings = spark.read.schema(POSTINGS).parquet(f"{folder}/postings").where(F.col("part").isin([known[g][1] for g in rare]) & F.col("gram").isin(rare))
    return postings.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(rare)).select("id")


def containing(names: DataFrame, folder: str, text: str) -> DataFrame:
    """The rows of names(id, name, ...) whose name contains the text, in any case: what the index leaves is looked at."""
    found = candidates(names.sparkSession, folder, text)
    rows = names if found is None else names.join(found, "id", "left_semi")
    return rows.where(F.contains(F.lower("name"), F.lit(text.lower())))
