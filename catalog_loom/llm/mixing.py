"""Mixing sources to target weights by entropy balancing.

Targets: sources in code-point order (null last) weigh 3, 1, 2, repeating, and share 150 % of all words; a target stops
at twice its source's words and the excess is shared again by weight.

Rates: of all document rates q in [0, 2] that give each source its target, sum(size * q) = target, take those of least
relative entropy to taking every document once. The dual has one multiplier per source, and q = min(2, exp(t * size /
mean size)). Newton steps (kept inside a bracket) run on a histogram of sizes by source, as one grouped aggregation each.

Copies: the fractions of the rates are rounded by systematic sampling along the order (size class, salt, size, hash), so
neighbours of like size stand in for each other (a source has a salt for every SALT_ROWS documents, MOST_SALTS at most, so that a source with
very many is dealt to many tasks); the words still missing from, or above, a source's target are then added
to or cut from the first documents of that order, so at most a few documents hold a partial copy.

Sums are taken over integers and rows are ordered by hashes of all their columns, so a rerun gives the same rows however the
table is dealt to partitions.

Defined cases: a null text has size 0; size 0 takes 0 words; a null source is a source of its own; repeated rows and rows
with a null doc_id are documents of their own; an empty table gives no rows; columns besides doc_id, text and source are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalog_loom.llm.shared import any_cold, hashable, join_by_size, named, observed, stage, table

WORD = r"[^\x20\x09-\x0D]+"
UNIT = 1_000_000_000
SALT_ROWS = 256
MOST_SALTS = 1 << 16


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: str) -> Column:
    """A key that sorts as the source does, null last."""
    return F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def identified(docs: DataFrame) -> list[Column]:
    """id_1 and id_2, two hashes of a row, by which rows are ordered and found again: equal ones are rows that agree in all
    columns, and stand in for each other."""
    return [F.xxhash64(*hashable(docs)).alias("id_1"), F.xxhash64(F.lit(1), *hashable(docs)).alias("id_2")]


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", size_of("text").alias("size"), source_key("source").alias("skey"), *identified(docs))


def ranked(sources: DataFrame) -> DataFrame:
    """Add rank, the position in the order of skey, without a single sorting task."""
    parts = stage(sources.repartitionByRange(F.col("skey")).sortWithinPartitions("skey").withColumn("part", F.spark_partition_id()), "ranked")
    counts = sorted((r["part"], r["count"]) for r in parts.groupBy("part").count().collect())  # one row for each partition
    offset, rows = 0, []
    for part, n in counts:
        rows.append((part, offset))
        offset += n
    before = sources.sparkSession.createDataFrame(rows, "part int, before long")
    local = F.row_number().over(Window.partitionBy("part").orderBy("skey")) - 1
    return parts.withColumn("local", local).join(before, "part").withColumn("rank", F.col("local") + F.col("before")).drop("part", "local", "before")


def with_targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """sources(skey, source_size, n_docs) with weight and target."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    s = stage(ranked(sources).withColumn("weight", weight.cast("long")), "sources")
    cap = F.col("source_size") * most
    total, all_weights = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level = share * total / all_weights if all_weights else 0.0
    while True:
        full, free = s.agg(
            F.coalesce(F.sum(F.when(cap <= F.col("weight") * F.lit(level), cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(cap > F.col("weight") * F.lit(level), F.col("weight"))), F.lit(0)),
        ).first()
        higher = max(level, (share * total - full) / free) if free else level
        if higher == level:
            break
        level = higher
    return s.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(float(level))))


def balanced(histogram: DataFrame, sources: DataFrame, steps: int = 60, tolerance: float = 1e-7) -> DataFrame:
    """sources with theta, the dual multiplier. Sources whose target is 0 or twice their size need none. Newton's steps are
    taken on the logarithm of the words that the rates give, which is nearly a line."""
    inner = (F.col("target") > 0) & (F.col("target") < 2 * F.col("source_size"))
    start = F.log(F.col("target") / F.col("source_size")) * F.col("mean_size") * F.col("source_size") / F.col("second")
    state = sources.withColumn("mean_size", F.col("source_size") / F.greatest("n_docs", F.lit(1)))
    state = state.withColumn("theta", F.when(inner, F.least(F.greatest(start, F.lit(-50.0)), F.lit(50.0))))
    state = stage(state.withColumn("low", F.when(inner, F.lit(-60.0))).withColumn("high", F.when(inner, F.lit(60.0))), "dual")
    rate = F.exp(F.col("theta") * F.col("size") / F.col("mean_size"))
    for _ in range(steps):
        words = F.col("n") * F.col("size")
        slope = F.when(rate < 2, rate * F.col("size") / F.col("mean_size")).otherwise(0.0)
        sums = histogram.join(state.where("theta is not null").select("skey", "theta", "mean_size"), "skey").groupBy("skey").agg(
            F.sum(words.cast("decimal(38,0)") * F.round(F.least(rate, F.lit(2.0)) * UNIT).cast("decimal(12,0)")).alias("got"),
            F.sum(words.cast("decimal(38,0)") * F.round(F.least(slope, F.lit(1e6)) * 1e6).cast("decimal(14,0)")).alias("slope"),
        )
        got = F.col("got").cast("double") / UNIT
        miss = got - F.col("target")
        newton = F.col("theta") - F.try_divide(F.log(got / F.col("target")) * got, F.col("slope").cast("double") / 1e6)
        low, high = F.when(miss < 0, F.col("theta")).otherwise(F.col("low")), F.when(miss > 0, F.col("theta")).otherwise(F.col("high"))
        near = F.abs(miss) <= tolerance * F.col("target")
        moved = (
            state.drop("done").join(sums, "skey", "left").withColumn("done", F.col("theta").isNull() | near)
            .withColumn("low_", low).withColumn("high_", high)
            .withColumn("theta", F.when(F.col("done"), F.col("theta")).when((newton > F.col("low_")) & (newton < F.col("high_")), newton).otherwise((F.col("low_") + F.col("high_")) / 2))
            .withColumn("low", F.col("low_")).withColumn("high", F.col("high_")).drop("low_", "high_", "got", "slope")
        )
        state, of = observed(moved, "dual", open=F.count_if(~F.col("done")))
        if not of["open"]:
            break
    return state


def mix_sources(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, skey, size, source_size, target, rate, copies (whole ones), taken (words), and id_1
    and id_2 of its row."""
    rows = stage(sized(docs), "sized")
    histogram = stage(rows.groupBy("skey", "size").agg(F.count("*").alias("n")), "histogram")
    sources = histogram.groupBy("skey").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("n_docs"), F.sum("n").alias("many"),
        F.sum((F.col("size") * F.col("n")).cast("decimal(20,0)") * F.col("size").cast("decimal(12,0)")).cast("double").alias("second"))
    solved = balanced(histogram, with_targets(sources)).select("skey", "source_size", "target", "mean_size", "theta", "many")
    total = solved.agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0]
    cold = any_cold(solved, "many", total)

    free = F.when(F.col("theta").isNotNull(), F.exp(F.col("theta") * F.col("size") / F.col("mean_size"))).when(F.col("target") > 0, F.lit(2.0)).otherwise(0.0)
    nano = F.when(F.col("size") > 0, F.round(F.least(free, F.lit(2.0)) * UNIT)).otherwise(0).cast("long")
    hashed = F.xxhash64("id_1", "size")
    # A source is dealt to as many salts as it has runs of SALT_ROWS documents, within each class of sizes.
    salts = F.least(F.ceil(F.col("salt_of") / SALT_ROWS).cast("long"), F.lit(MOST_SALTS).cast("long"))
    bucket = F.floor(F.log2(F.col("size") + 1)) * salts + F.pmod(hashed, salts)
    rated = (
        join_by_size(rows, solved.withColumn("salt_of", F.col("many")), "skey", "many", total, cold=cold)
        .withColumn("nano", nano).withColumn("h", hashed).withColumn("bucket", bucket.cast("long"))
        .withColumn("whole", F.floor(F.col("nano") / UNIT)).withColumn("part", F.col("nano") % UNIT)
        .select("doc_id", "skey", "size", "source_size", "target", "nano", "h", "id_1", "id_2", "bucket", "whole", "part")
    )
    order = Window.partitionBy("skey", "bucket").orderBy("size", "h", "doc_id", "id_1", "id_2").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)

    def along(df: DataFrame, column: str, name: str) -> DataFrame:
        """Running sum of column along a source's order: within the bucket, and the sums of the buckets before it."""
        sums = df.groupBy("skey", "bucket").agg(F.sum(column).alias("sum"))
        before = sums.select("skey", "bucket", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("before"))
        return df.withColumn(name, F.sum(column).over(order)).join(before, ["skey", "bucket"]).withColumn(name, F.col(name) + F.col("before")).drop("before")

    dealt = along(rated, "part", "run")
    copies = F.col("whole") + F.floor(F.col("run") / UNIT) - F.floor((F.col("run") - F.col("part")) / UNIT)
    dealt = stage(dealt.withColumn("copies", copies.cast("int")).withColumn("taken", F.col("copies") * F.col("size")), "dealt")
    short = dealt.groupBy("skey").agg((F.round(F.max("target")) - F.sum("taken")).cast("long").alias("short"), F.count("*").alias("many"))
    room = F.when(F.col("short") > 0, 2 * F.col("size") - F.col("taken")).otherwise(F.col("taken"))
    spare = along(join_by_size(dealt, short, "skey", "many", total, cold=cold).withColumn("room", room), "room", "room_run")
    give = F.greatest(F.lit(0), F.least(F.col("room"), F.abs("short") - (F.col("room_run") - F.col("room"))))
    return spare.withColumn("taken", F.col("taken") + F.when(F.col("short") > 0, give).otherwise(-give)).select(
        "doc_id", "skey", "size", "source_size", "target", (F.col("nano") / UNIT).alias("rate"),
        F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int").alias("copies"), F.col("taken").cast("long"), "id_1", "id_2",
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of docs: each document as often as it is taken whole, then its first words if a
    part is taken. Rows are found again by their hashes. Of rows that agree in all columns one stays and is given what
    all of them together take, so that no task numbers them."""
    rest = (F.col("taken") - F.col("copies") * F.col("size")).cast("int")
    each = mix_sources(docs).select("id_1", "id_2", "copies", rest.alias("rest"))
    parts = F.array_sort(F.collect_list(F.when(F.col("rest") > 0, F.col("rest"))))  # a few documents of each source have one
    plan = stage(each.groupBy("id_1", "id_2").agg(F.count("*").alias("many"), F.sum("copies").cast("int").alias("copies"), parts.alias("rests")).where("many > 1 or copies > 0 or size(rests) > 0"), "plan")
    keys = ["id_1", "id_2"]
    have = docs.select(F.struct(*map(named, docs.columns)).alias("row"), *identified(docs))
    single = have.join(plan.where("many = 1").drop("many"), keys).select("row", "copies", "rests")
    several = plan.where("many > 1").drop("many")
    if not several.isEmpty():
        equal = have.join(several, keys).groupBy(*keys).agg(F.first("row").alias("row"), F.first("copies").alias("copies"), F.first("rests").alias("rests"))
        single = single.unionByName(equal.select("row", "copies", "rests"))
    cut = lambda n: F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(f"({WORD})")), F.lit(1), n), " ")
    texts = F.concat(F.array_repeat(F.col("row.text"), F.col("copies")), F.transform("rests", cut))
    mixed = single.select("row", F.explode(texts).alias("mixed_text"))
    return mixed.select(*[F.col("mixed_text").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
