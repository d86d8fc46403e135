"""WARC archives with revisit resolution.

Writing: only (payload digest, page id) pairs are shuffled to find, for each payload of at least 1000 bytes, the page
that keeps it; the other pages get a revisit record that refers to it and holds no payload. Payloads with very many pages
reach these by broadcast (join_by_size), so that none of them is one task. Each WARC/1.1 record is a gzip member of its own (one
above MEMBER_BYTES several), so that a record can be read from its offset alone. A file is closed when it has FILE_BYTES, so
only a record that is larger makes a larger file. Spark's text writer writes the files: its line separator is the byte
0, which every member ends with (the high byte of a size below MEMBER_BYTES).

Reading: a file is unpacked piece by piece and parsed by Content-Length, so that a task holds the packed file and one
record; revisit records are then joined to the responses they refer to. A record's id is made of page id, URL and payload
digest, so pages that repeat an id with another payload have records of their own.

Defined cases: a null html has an empty payload; a null url gives no target URI; rows that repeat both page_id and
payload are the same record and all are responses; a null page_id never keeps a payload that some page_id could keep; if
all ids of a payload are null, all those records are responses; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog_loom.llm.shared import any_cold, fresh_path, join_by_size, mapped, stage, table

END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 64 << 20
MEMBER_BYTES = 1 << 24
PACKED_PIECE = 1 << 16
PIECE = 1 << 20
ROWS = 2000
RECORD = "page_id long, record_type string, record_id string, refers_to_id string, target_uri string, payload_digest string, payload_bytes long, intact boolean, offset long"


def record_id(page_id: Column, url: Column, digest: Column) -> Column:
    """Of the page and its payload; the URL counts only where there is no page id, as a revisit doesn't know its original's."""
    seed = F.when(page_id.isNotNull(), F.concat_ws(" ", F.lit("page"), page_id.cast("string"), digest)).otherwise(F.concat_ws(" ", F.lit("url"), url, digest))
    h = F.sha1(seed)
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-8"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def keepers(pages: DataFrame, least: int) -> DataFrame:
    """digest, keep_id, n: for each payload of at least least bytes held by several pages, the page that keeps it, if any has
    an id."""
    heads = pages.where(F.octet_length("payload") >= least).select("page_id", F.sha1("payload").alias("digest"))
    return heads.groupBy("digest").agg(F.max("page_id").alias("keep_id"), F.count("*").alias("n")).where("n > 1")


def write_archive(pages: DataFrame, path: str, least: int = 1000, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES, member_bytes: int = MEMBER_BYTES) -> None:
    """Write pages (page_id, url, html) as a deduplicated archive under path."""
    rows = pages.select("page_id", F.regexp_replace("url", r"[\x00-\x20\x7f]", "").alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    total = rows.count()
    keep = stage(keepers(rows, least), "keepers")
    cold = any_cold(keep, "n", total)
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("n_bytes", F.octet_length("payload"))
    if cold:  # short payloads have no keeper, and very many pages may share one of them
        short = rows.where(F.col("n_bytes") < least).withColumn("keep_id", F.lit(None).cast("long"))
        rows = join_by_size(rows.where(F.col("n_bytes") >= least), keep, "digest", "n", total, "left", cold).unionByName(short)
    else:
        rows = join_by_size(rows, keep, "digest", "n", total, "left", cold=False)
    revisit = F.col("keep_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep_id"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))  # noqa: E731  null where the value is null
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(END + END))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    record = F.concat_ws(
        "",
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.col("page_id"), F.col("url"), F.col("digest"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, line("WARC-Refers-To", record_id(F.col("keep_id"), F.lit(None), F.col("digest")))),
        F.when(revisit, line("WARC-Profile", F.lit(PROFILE))),
        line("X-Page-Id", F.col("page_id").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(END),
        block,
    )
    ended = F.concat(record, F.lit(END + END))
    files = mapped(rows.select(ended.cast("binary").alias("record")), lambda batches: packed_files(batches, file_bytes, member_bytes), "body binary")
    files.select(F.col("body").cast("string")).write.option("lineSep", "\x00").option("maxRecordsPerFile", 1).text(path)


def members(record: bytes, most: int = MEMBER_BYTES) -> Iterator[bytes]:
    """A record as gzip members of less than most bytes, whose sizes have a high byte of 0."""
    for at in range(0, len(record), most - 1):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        yield packer.compress(record[at : at + most - 1]) + packer.flush()


def packed_files(batches: Iterator[pa.RecordBatch], file_bytes: int, member_bytes: int) -> Iterator[pa.RecordBatch]:
    """The content of each file, but for the byte 0 at its end."""
    parts: list[bytes] = []
    size = 0
    file = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(parts)[:-1]], pa.binary())], ["body"])
    for batch in batches:
        for record in batch["record"]:
            new = list(members(record.as_py(), member_bytes))
            own = sum(map(len, new))
            if parts and size + own > file_bytes:
                yield file()
                parts, size = [], 0
            parts += new
            size += own
    if parts:
        yield file()


def unpacked(packed: bytes, start: int = 0) -> Iterator[tuple[int, bytes]]:
    """A gzip file's content from a member's offset on, about PIECE bytes at a time, each with the offset of its member."""
    whole, at, member = memoryview(packed), start, start
    stream, data = zlib.decompressobj(31), b""
    while data or at < len(whole):
        if not data:
            data = bytes(whole[at : at + PACKED_PIECE])
            at += len(data)
        piece = stream.decompress(data, PIECE)
        if piece:
            yield member, piece
        data = stream.unconsumed_tail
        if stream.eof:
            data = stream.unused_data
            stream, member = zlib.decompressobj(31), at - len(data)
    if piece := stream.flush():
        yield member, piece


class Reader:
    """Takes an archive apart, record by record."""

    def __init__(self, pieces: Iterator[tuple[int, bytes]]):
        self.pieces, self.held, self.offset = pieces, bytearray(), 0

    def more(self) -> bool:
        """Take a piece; offset is that of the member that the held bytes begin in, where they begin with one."""
        offset, piece = next(self.pieces, (0, None))
        if piece is not None and not self.held:
            self.offset = offset
        self.held += piece or b""
        return piece is not None

    def until(self, end: bytes) -> bytes | None:
        """What comes before end, which is passed over; None at the end of the archive."""
        seen = 0
        while (at := self.held.find(end, seen)) < 0:
            seen = max(0, len(self.held) - len(end))
            if not self.more():
                if self.held:
                    raise ValueError("not a WARC record")
                return None
        found = bytes(self.held[:at])
        del self.held[: at + len(end)]
        return found

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        found = bytes(self.held[:n])
        del self.held[:n]
        return found


def _records(packed: bytes, start: int = 0) -> Iterator[tuple]:
    """The records of a file from the member at an offset on."""
    reader = Reader(unpacked(packed, start))
    while reader.held or reader.more():
        offset = reader.offset
        head = reader.until(b"\r\n\r\n") or b""
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
        block = reader.take(int(fields["content-length"]))
        whole = reader.take(4) == b"\r\n\r\n"
        body = block.index(b"\r\n\r\n") + 4
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        response = fields["warc-type"] == "response"
        page = fields.get("x-page-id")
        intact = whole and (not response or hashlib.sha1(memoryview(block)[body:]).hexdigest() == digest)
        size = len(block) - body if response else None
        yield (int(page) if page else None, fields["warc-type"], fields["warc-record-id"], fields.get("warc-refers-to"), fields.get("warc-target-uri"), digest, size, intact, offset)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record under path; intact tells whether the payload has its digest, offset where the record's (first)
    member starts in its file."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                found = _records(content.as_py())
                while rows := list(islice(found, ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    names = [x.split()[0] for x in RECORD.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[x.split()[1]] for x in RECORD.split(", ")]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return mapped(files, parse, RECORD)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Give each revisit record the page and payload size of the response that it refers to."""
    responses = records.where("record_type = 'response'")
    revisits = records.where("record_type = 'revisit'")
    asked = revisits.groupBy("refers_to_id").agg(F.count("*").alias("n"))
    originals = responses.groupBy(F.col("record_id").alias("refers_to_id")).agg(F.min("page_id").alias("refers_to"), F.min("payload_bytes").alias("original_bytes"))
    first = stage(originals.join(asked, "refers_to_id"), "originals")
    total = revisits.count()
    found = join_by_size(revisits.drop("payload_bytes"), first, "refers_to_id", "n", total, "left", any_cold(first, "n", total))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"]
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(columns).unionByName(found.withColumnRenamed("original_bytes", "payload_bytes").select(columns))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return resolve_revisits(stage(read_archive(spark, path), "records"))


SQL = """
WITH p AS (SELECT page_id, coalesce(strlen(html), 0) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT payload_digest, max(page_id) AS keep FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
 CASE WHEN keep IS NULL OR keep = page_id THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN keep = page_id THEN NULL ELSE keep END AS refers_to, true AS intact
FROM p LEFT JOIN k ON p.payload_digest = k.payload_digest AND p.payload_bytes >= 1000
"""
