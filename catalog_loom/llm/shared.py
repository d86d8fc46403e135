"""Reading tables, writing intermediate tables to the folder that the whole cluster shares, running Python over batches, and
joins that hold where one key has very many rows."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: The shuffles of a written table aren't needed again.
WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Keys that hold more than one in HOT_KEYS of all rows are fewer than HOT_KEYS, so they can be broadcast.
HOT_KEYS = 50_000
BATCH_BYTES = 4 << 20
_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. A local temporary one is taken only where that is unset and Spark runs in
    one process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    return local_dir()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: later steps start from files, not from its lineage."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = {k: spark.conf.get(k) for k in WHILE_WRITING}
    for k, v in WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, name: str, **values: Column) -> tuple[DataFrame, dict]:
    """stage(df, name), and aggregates over its rows that were taken while they were written."""
    seen = Observation()
    return stage(df.observe(seen, *[v.alias(k) for k, v in values.items()]), name), seen.get


def release() -> None:
    """Give freed memory back to the system: Python workers are reused, and what one stage has freed they'd keep."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def safe(names: list[str]) -> list[str]:
    return [f"column_{i}" for i in range(len(names))]


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow with batches of BATCH_BYTES at most (or a single row), after which a task gives its memory back. The
    bound is a setting of the session and stays, as it must hold when the frame is run. Columns may have any names; run sees
    and gives them as they are."""
    conf = df.sparkSession.conf
    given = conf.get(_ARROW_BYTES, None)
    if given is None or not given.isdigit() or not 0 < int(given) <= BATCH_BYTES:
        conf.set(_ARROW_BYTES, str(BATCH_BYTES))

    given = df.columns
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    made = kind.fieldNames()
    plain = all(re.fullmatch(r"\w+", c) for c in (*given, *made))  # mapInArrow reads a dot in a name as a field of a struct

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            if plain:
                yield from run(batches)
            else:
                for batch in run(b.rename_columns(given) for b in batches):
                    yield batch.rename_columns(safe(made))
        finally:
            release()

    if plain:
        return df.mapInArrow(tidy, schema)
    inner = StructType([StructField(name, f.dataType, f.nullable) for name, f in zip(safe(made), kind, strict=True)])
    return df.toDF(*safe(given)).mapInArrow(tidy, inner).toDF(*made)


def named(column: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`" + column.replace("`", "``") + "`")


def hashable(rows: DataFrame) -> list[Column]:
    """The columns of rows in a form that can be hashed, and whether each is null (nulls don't change a hash); maps and variants
    as JSON."""
    plain = lambda f: not re.search(r"\b(map<|variant)", f.dataType.simpleString())
    return [*(named(f.name) if plain(f) else F.to_json(F.struct(named(f.name).alias("x"))) for f in rows.schema), *(named(c).isNull() for c in rows.columns)]


def free_name(columns: list[str], wanted: str) -> str:
    """wanted, made longer until no column has that name."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def any_cold(side: DataFrame, many: str, total: int) -> bool:
    """Whether side has keys that join_by_size doesn't broadcast."""
    return total > HOT_KEYS and not side.where(F.col(many) * HOT_KEYS < total).isEmpty()


def join_by_size(rows: DataFrame, side: DataFrame, key: str, many: str, total: int, how: str = "inner", cold: bool | None = None) -> DataFrame:
    """rows joined with side, which has one row for each key and in many the number of its rows among the total of rows.
    Keys with at least total / HOT_KEYS rows go by broadcast (they are HOT_KEYS at most), the others by shuffle, where none of
    them has more than that share of all rows. cold: what any_cold says, if it is known."""
    is_hot = F.col(many) * HOT_KEYS >= total
    hot = side.where(is_hot).drop(many)
    if not (total > HOT_KEYS if cold is None else cold):
        return rows.join(F.broadcast(hot), key, how)
    rest = side.where(~is_hot).drop(many)
    direct = rows.join(F.broadcast(hot), key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key, how)
    return direct.unionByName(others)
