"""Reading and publishing files."""

from __future__ import annotations

import functools
import json
import tempfile
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from catalog_loom.functions.text import blank_to_null, decode_page, undecodable
from catalog_loom.sources import store

WRITERS = 64
PACK_BYTES = 16 << 20
PACK_END = 12  # digits of each length of a pack's index
PACK_CODEC = "zstd"
BATCH_BYTES, BATCH_ROWS = 4 << 20, 10_000
SERIES_BYTES = 64 << 20
MOST_FOLDERS = 1000
RECORD = (
    "title string, series_name string, episode_number bigint, description string, duration_minutes double, release_date string, label string, cover_url string, order_number string, "
    "previous_episode_url string, next_episode_url string, speakers array<struct<role:string,speaker:string>>, genres array<string>, source_url string, source_key string")
RESULTS = ("results array<struct<collectionId:bigint,collectionName:string,artistName:string,releaseDate:string,trackCount:int,collectionViewUrl:string>>")
EXPORTED = ["candidate_id", "source_key", "source_title", "variant_category", "target_source_key", "target_title", "target_episode_number", "proposed_relationship", "confidence_score", "confidence_class",
            "match_reasons", "edition_markers", "range_start", "range_end", "review_decision", "review_note"]


@functools.cache
def local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def root_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. A local one is taken only where that is unset and Spark runs in one process, as
    in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    return local_folder()


def shared_folder(spark: SparkSession) -> str:
    """A new folder below root_folder."""
    return f"{root_folder(spark)}/catalog-{uuid.uuid4().hex}"


def written_at(rows: DataFrame, name: str, codec: str | None = None) -> tuple[DataFrame, str]:
    """rows, written as a table and read again, and its folder, for who deletes it sooner than the store.scratch block that it is
    written in. The shuffles that made it are gone then. codec: zstd for wide rows; small tables keep the usual one, as
    Spark tells by the size of files what it can broadcast."""
    spark = rows.sparkSession
    folder = shared_folder(spark)
    store.staged(spark, folder)
    path = f"{folder}/{name}"
    with store.freeing(spark):
        (rows.write.option("compression", codec) if codec else rows.write).parquet(path)
    return spark.read.schema(rows.schema).parquet(path), folder


def written(rows: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """The table of written_at, for frames that several later ones are made of."""
    return written_at(rows, name, codec)[0]


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """page, html of all pages of a folder, decoded, and whether a byte has no character. A page is a file name.html, or a
    file in a folder of that name; the order of pages is that of their names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    files = files.withColumn("page", F.regexp_extract("path", r"([^/=]+\.html)(?:/[^/]*)?$", 1)).where("page <> ''")
    return files.select("page", decode_page(F.col("content")).alias("html"), undecodable(F.col("content")).alias("undecodable"))


def write_pages(pages: DataFrame, folder: str) -> None:
    """pages(page, html), each in a folder of its name, written by WRITERS tasks."""
    pages.select("page", F.col("html").alias("value")).repartition(WRITERS, "page").write.partitionBy("page").option("lineSep", "\n").text(folder)


def pack_pages(pages: DataFrame, folder: str, pack_bytes: int = PACK_BYTES) -> None:
    """pages(page, content) as packs of about pack_bytes of them, so that very many pages aren't as many files. Each task packs the
    pages that it has, and none is moved. A pack is blocks of about BATCH_BYTES of pages, each compressed by itself, then a
    compressed index (for each block its length there and here, and names and lengths of its pages) and the index's two
    lengths."""

    def zipped(content: bytes) -> bytes:
        return pa.compress(content, codec=PACK_CODEC, asbytes=True)

    def pack(blocks: list[bytes], index: list[dict]) -> pa.RecordBatch:
        shown = json.dumps(index).encode()
        short = zipped(shown)
        return pa.RecordBatch.from_arrays([pa.array([b"".join([*blocks, short, b"%0*d%0*d" % (PACK_END, len(short), PACK_END, len(shown))])], pa.binary())], ["body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, index, size = [], [], 0
        parts, names, held = [], [], 0

        def end_block() -> None:
            nonlocal size, held
            blocks.append(zipped(b"".join(parts)))
            index.append({"length": len(blocks[-1]), "size": held, "pages": list(names)})
            size, held = size + held, 0
            parts.clear()
            names.clear()

        for batch in batches:
            for page, content in zip(batch["page"], batch["content"], strict=True):
                content = content.as_py() or b""
                parts.append(content)
                names.append((page.as_py(), len(content)))
                held += len(content)
                full = size + held >= pack_bytes
                if full or held >= BATCH_BYTES or len(names) >= BATCH_ROWS:
                    end_block()
                if full:
                    yield pack(blocks, index)
                    blocks, index, size = [], [], 0
        if names:
            end_block()
        if index:
            yield pack(blocks, index)

    packs = pages.select("page", "content").mapInArrow(run, "body binary")
    with store.freeing(pages.sparkSession):
        packs.select(F.col("body").cast("string")).write.option("maxRecordsPerFile", 1).text(folder)


def packed_contents(spark: SparkSession, folder: str) -> DataFrame:
    """page, content of all pages of a folder of packs. A pack is read by one task and unpacked block by block, each page copied
    once; a block's pages are handed on together."""

    def cut(pack: bytes) -> Iterator[pa.RecordBatch]:
        body = memoryview(pack).toreadonly()
        unzipped = lambda start, length, size: memoryview(pa.decompress(body[start : start + length], size, codec=PACK_CODEC, asbytes=True))
        end = len(body) - 1 - 2 * PACK_END  # a line feed ends the file
        short, shown = (int(bytes(body[at : at + PACK_END])) for at in (end, end + PACK_END))
        start = 0
        for block in json.loads(bytes(unzipped(end - short, short, shown))):
            content, parts, at = unzipped(start, block["length"], block["size"]), [], 0
            for _, length in block["pages"]:
                parts.append(content[at : at + length].tobytes())
                at += length
            start += block["length"]
            yield pa.RecordBatch.from_arrays([pa.array([name for name, _ in block["pages"]], pa.string()), pa.array(parts, pa.binary())], ["page", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack in batch["content"]:
                yield from cut(pack.as_py())

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(run, "page string, content binary")


def read_packed(spark: SparkSession, folder: str) -> DataFrame:
    """page, html and undecodable, as read_pages gives them, from packs."""
    pages = packed_contents(spark, folder)
    return pages.select("page", decode_page(F.col("content")).alias("html"), undecodable(F.col("content")).alias("undecodable"))


def read_records(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """Artifacts of records: a file is a JSON array, or (packed) each of its lines is one."""
    return spark.read.schema(RECORD).json(path, multiLine=not packed)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_seed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A curated file; empty cells are null."""
    rows = spark.read.schema(schema).csv(path, header=True)
    return rows.select(*[blank_to_null(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes])


def read_results(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """probe_key, pos and the fields of each result of an external catalog. A payload is a file probe_key.json, or a file in
    a folder payload=probe_key, or (packed) a line that also has its probe_key as payload."""
    if packed:
        payloads, stem = spark.read.schema(f"payload string, {RESULTS}").json(path), F.col("payload")
    else:
        name = F.regexp_extract(F.input_file_name(), r"(?:payload=([^/]+)/[^/]*|([^/]+)\.json)$", 0)
        stem = F.coalesce(F.nullif(F.regexp_extract(name, "payload=([^/]+)/", 1), F.lit("")), F.regexp_extract(name, r"([^/]+)\.json$", 1))
        payloads = spark.read.schema(RESULTS).option("recursiveFileLookup", True).json(path, multiLine=True)
    rows = payloads.select(stem.alias("probe_key"), F.posexplode("results").alias("pos", "r"))
    return rows.select("probe_key", "pos", F.col("r.collectionId").cast("string").alias("collection_id"), F.col("r.artistName").alias("artist_name"), F.col("r.collectionName").alias("collection_name"), F.col("r.releaseDate").alias("release_date"))


def publish_if_valid(rows: DataFrame, checks: Callable[[DataFrame], DataFrame], folder: str, keep: int = 2) -> DataFrame:
    """Write a new version below folder, run checks(frame) on what was written, and only then name it as the published one.
    Versions are never overwritten: what was published before stays, whatever fails before the new one is named, and is
    deleted when keep later ones are named."""
    spark = rows.sparkSession
    version, path = store.new_version(folder)
    try:
        with store.freeing(spark):
            rows.write.parquet(path)
            failed = [r["check_name"] for r in checks(spark.read.schema(rows.schema).parquet(path)).where("violations > 0").collect()]  # one row for each check
        if failed:
            raise ValueError(f"not published: {', '.join(sorted(failed))}")
    except BaseException:
        store.delete(spark, path)
        raise
    store.publish(spark, folder, version)
    store.prune(spark, folder, keep)
    return read_published(spark, folder, rows.schema)


def read_published(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """The version that was named last."""
    found = store.published(spark, folder, 1)
    if not found:
        raise ValueError(f"nothing is published in {folder}")
    return spark.read.schema(schema).parquet(f"{folder}/versions/{found[0]}")


def publish_mart(rows: DataFrame, folder: str, name: str, keep: int = 2) -> DataFrame:
    """A new version of a mart. Whoever reads the one before can finish, and a write that fails leaves it as it is."""
    none = rows.sparkSession.createDataFrame([], "check_name string, violations bigint")
    return publish_if_valid(rows, lambda _: none, f"{folder}/{name}", keep)


def series_grains(records: DataFrame, most_bytes: int = SERIES_BYTES) -> tuple[DataFrame, DataFrame]:
    """How records are cut into files of JSON lines: series (struct of series_id), total (bytes) and grains of each series, and
    series, grain and piece of the grains. A series of at most most_bytes is one grain; a larger one has sixteen for each
    most_bytes, told by a hash of the row. Neighbouring grains make a piece, which is no larger than most_bytes unless
    a grain is."""
    line = F.octet_length(F.to_json(F.struct(*[c for c in records.columns if c != "series_id"]))) + 1
    sized = records.select(F.struct("series_id").alias("series"), F.xxhash64(*records.columns).alias("h"), line.alias("bytes"))
    grains = F.when(F.col("total") > most_bytes, 16 * F.ceil(F.col("total") / most_bytes)).otherwise(1).cast("int")
    totals = written(sized.groupBy("series").agg(F.sum("bytes").alias("total")).withColumn("grains", grains), "series")
    large = sized.join(F.broadcast(totals.where("grains > 1")), "series").select("series", F.pmod("h", F.col("grains")).cast("int").alias("grain"), "bytes")
    own = Window.partitionBy("series")  # a row for each grain
    step = F.greatest(F.lit(most_bytes) - F.max("bytes").over(own), F.lit(1))  # grains that end within a step of one another fit together
    piece = F.floor((F.sum("bytes").over(own.orderBy("grain")) - 1) / step).cast("int")
    cut = large.groupBy("series", "grain").agg(F.sum("bytes").alias("bytes")).select("series", "grain", piece.alias("piece"))
    return totals, written(cut, "grains")


def write_by_series(records: DataFrame, folder: str, most_bytes: int = SERIES_BYTES, most_folders: int = MOST_FOLDERS) -> None:
    """JSON lines by series_id. Up to most_folders series have a folder each: one file for a series, or as many as keep each
    within most_bytes. More series share folders, told by a hash of series_id, so that the number of files follows from the
    bytes; a row then has its series_id. Pieces of a large series are written by different tasks, each by one. Rows
    that are equal in all columns lie in one file. What is joined by broadcast has a few rows for each most_bytes of records."""
    spark = records.sparkSession
    totals, cut = series_grains(records, most_bytes)
    size, n = totals.agg(F.coalesce(F.sum("total"), F.lit(0)), F.count("*")).first()
    pieces = cut.agg(F.coalesce(F.max("piece") + 1, F.lit(1))).first()[0]
    tasks = max(pieces, min(n, -(-2 * size // most_bytes) + spark.sparkContext.defaultParallelism), 1)
    # A key for each task, by which repartition deals its rows to it alone.
    keys = spark.range(64 * tasks).select(F.col("id").cast("int").alias("key"))
    keys = keys.groupBy(F.pmod(F.hash("key"), F.lit(tasks)).alias("task")).agg(F.min("key").alias("key"))
    rows = records.withColumn("series", F.struct("series_id")).withColumn("h", F.xxhash64(*records.columns))
    rows = rows.join(F.broadcast(totals.where("grains > 1").select("series", "grains")), "series", "left").withColumn("grain", F.pmod("h", F.col("grains")).cast("int"))
    rows = rows.join(F.broadcast(cut), ["series", "grain"], "left")
    task = F.pmod(F.xxhash64("series") + F.coalesce("piece", F.lit(0)), F.lit(tasks)).cast("int")
    dealt = rows.withColumn("task", task).join(F.broadcast(keys), "task").repartition(tasks, "key")
    if n <= most_folders:
        dealt.select(*records.columns).write.mode("overwrite").partitionBy("series_id").json(folder)
    else:
        buckets = {"buckets": F.lit(tasks), "bucket": F.pmod(F.xxhash64("series"), F.lit(tasks)).cast("int")}
        dealt.select(*records.columns, *[b.alias(c) for c, b in buckets.items()]).write.mode("overwrite").partitionBy(*buckets).json(folder)


def read_by_series(spark: SparkSession, folder: str, schema: str, *series: int | str | None) -> DataFrame:
    """What write_by_series wrote, all of it or the given series, of which only the folders are read."""
    rows = spark.read.schema(schema).json(folder)
    kind = rows.schema["series_id"].dataType
    chosen = [(F.lit(x).cast(kind), F.struct(F.lit(x).cast(kind).alias("series_id"))) for x in series]
    if chosen:
        shared = "buckets" in rows.columns
        fits = [F.col("series_id").eqNullSafe(x) & ((F.col("bucket") == F.pmod(F.xxhash64(s), F.col("buckets"))) if shared else F.lit(True)) for x, s in chosen]
        rows = rows.where(functools.reduce(lambda a, b: a | b, fits))
    return rows.select(*StructType.fromDDL(schema).names)


def export_review(rows: DataFrame, stats: DataFrame, folder: str, at: datetime) -> str:
    """A new export for each time (an error if it exists) in a fixed order of columns, its files in the order of place, and
    the statistics as latest."""
    path = f"{folder}/review_{at:%Y%m%dT%H%M%SZ}"
    ordered = rows.repartitionByRange("place").sortWithinPartitions("place").select(EXPORTED)
    ordered.write.mode("errorifexists").options(header=True, nullValue="", emptyValue="", escape='"').csv(path)
    stats.withColumn("path", F.lit(path)).coalesce(1).write.mode("overwrite").json(f"{folder}/latest")
    return path


def publish_report(report: DataFrame, folder: str, at: datetime) -> str:
    path = f"{folder}/report_{at:%Y%m%dT%H%M%SZ}"
    report.write.mode("errorifexists").json(path)
    report.sparkSession.createDataFrame([(path,)], "path string").coalesce(1).write.mode("overwrite").json(f"{folder}/latest")
    return path
