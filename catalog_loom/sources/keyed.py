"""Tables that are changed by key: rows lie in buckets by a hash of the key, and a change writes only the buckets that it touches.

A version of a table is a manifest, which names for each bucket the folder that holds it; buckets that a change doesn't touch
keep theirs. A version is named when all its files are written, so a write that fails changes nothing, and the one
before stays readable. Two writers who start from the same version can't both name the next one: the later gets an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from catalog_loom.operators.load import upsert
from catalog_loom.sources import store

MANIFEST = "bucket int, version string, row_count bigint"


class KeyedTable:
    """A table at folder with the given columns, keys and number of buckets (choose it so that a bucket is a few files)."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, keys: list[str], buckets: int = 64):
        self.spark, self.folder, self.schema, self.keys, self.buckets = spark, folder, schema, keys, buckets

    def manifest(self, version: str | None = None) -> DataFrame:
        """bucket, version (that wrote it) and row_count of the buckets that have rows, of the last version or another."""
        version = version or next(iter(store.published(self.spark, self.folder, 1)), None)
        if version is None:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/versions/{version}/manifest")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self, manifest: list) -> DataFrame:
        if not manifest:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/versions/{m['version']}/data/bucket={m['bucket']}" for m in manifest])

    def read(self) -> DataFrame:
        """The rows of the version that was named last."""
        return self._rows(self.manifest().collect())  # a row for each bucket

    def upsert(self, incoming: DataFrame, keep: int = 2) -> int:
        """Put rows in: those with a known key replace its row; of rows that repeat a key the greatest stays. Returns how many
        buckets were written."""
        number, before = store.state(self.spark, self.folder)
        old = self.manifest(before).collect() if before else []  # a row for each bucket
        _, staged = store.new_version(f"{self.folder}/incoming")
        try:
            self._deal(incoming.select(self.schema.names)).write.partitionBy("bucket").parquet(staged)
            taken = self.spark.read.schema(self._with_bucket()).parquet(staged)
            touched = {r["bucket"] for r in taken.select("bucket").distinct().collect()}  # one for each bucket
            if touched:
                self._write(number + 1, old, taken.drop("bucket"), touched, keep)
            return len(touched)
        finally:
            store.delete(self.spark, staged)

    def _with_bucket(self) -> StructType:
        return StructType([*self.schema.fields, *StructType.fromDDL("bucket int").fields])

    def _deal(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", self._bucket()).repartition("bucket")

    def _write(self, number: int, old: list, taken: DataFrame, touched: set[int], keep: int) -> None:
        version, path = store.new_version(self.folder)
        try:
            existing = self._rows([m for m in old if m["bucket"] in touched])
            self._deal(upsert(existing, taken, self.keys)).write.partitionBy("bucket").parquet(f"{path}/data")
            counts = self.spark.read.schema(self._with_bucket()).parquet(f"{path}/data").groupBy("bucket").agg(F.count("*").alias("row_count"))
            new = [(r["bucket"], version, r["row_count"]) for r in counts.collect()]  # a row for each bucket
            rest = [(m["bucket"], m["version"], m["row_count"]) for m in old if m["bucket"] not in touched]
            self.spark.createDataFrame(new + rest, MANIFEST).coalesce(1).write.parquet(f"{path}/manifest")
            if not store.take(self.spark, f"{self.folder}/published/{number:0{store.DIGITS}d}", version):
                raise RuntimeError(f"{self.folder} was changed by another writer")
        except BaseException:
            store.delete(self.spark, path)
            raise
        self._prune(keep)

    def _prune(self, keep: int) -> None:
        """Delete the buckets of older versions that none of the last keep manifests refers to, and versions without any."""
        kept = store.published(self.spark, self.folder, keep)
        used = {(m["version"], m["bucket"]) for v in kept for m in self.manifest(v).collect()}  # a row for each bucket
        held = {v for v, _ in used}
        for version in held - set(kept):
            data = f"{self.folder}/versions/{version}/data"
            for name in store.names(self.spark, data):
                if name.startswith("bucket=") and (version, int(name.removeprefix("bucket="))) not in used:
                    store.delete(self.spark, f"{data}/{name}")
        store.prune(self.spark, self.folder, keep, held)
