"""Archives: a gzip member a record, files by bytes, and records that are read from their offset alone."""

from __future__ import annotations

import glob
import gzip
import os
import random
import zlib


from catalog_loom.llm import shared, warc

PAGES = "page_id long, url string, html string"


def noise(seed, n):
    return random.Random(seed).randbytes(n).hex()[:n]


def written(spark, df, **sizes):
    path = shared.fresh_path(spark, "warc")
    warc.write_archive(df, path, **sizes)
    return path, sorted(glob.glob(f"{path.removeprefix('file://')}/part-*"))


def test_a_member_for_each_record(spark):
    rows = [(i, f"http://a/{i}", f"<p>{noise(i, i * 7)}") for i in range(300)]
    path, names = written(spark, spark.createDataFrame(rows, PAGES).repartition(3))
    assert len(names) == 3
    seen = 0
    for name in names:
        content = open(name, "rb").read()
        assert gzip.decompress(content).count(b"WARC/1.1\r\n") > 50  # an ordinary reader takes the whole file
        for record in warc._records(content):
            alone = zlib.decompressobj(31)
            text = alone.decompress(content[record[-1] :])
            assert alone.eof and text.startswith(b"WARC/1.1\r\n") and text.count(b"WARC/1.1\r\n") == 1 and record[2].encode() in text
            assert next(warc._records(content, record[-1])) == record
            seen += 1
    assert seen == len(rows) and warc.read_archive(spark, path).where("intact").count() == len(rows)


def test_files_by_bytes(spark):
    """One very large page among small ones makes no other file large."""
    rows = [(i, "u", noise(i, 4000)) for i in range(200)] + [(999, "u", noise(999, 900_000))]
    path, names = written(spark, spark.createDataFrame(rows, PAGES).coalesce(1), file_bytes=40_000)
    sizes = sorted(map(os.path.getsize, names))
    assert sizes[-1] > 400_000 and sizes[-2] <= 40_000 and len(sizes) > 10
    assert warc.resolve_revisits(warc.read_archive(spark, path)).where("intact").count() == 201


def test_records_of_several_members(spark):
    rows = [(i, "u", noise(i, i * 900)) for i in range(12)]
    path, _ = written(spark, spark.createDataFrame(rows, PAGES).coalesce(1), member_bytes=1000)
    got = warc.read_archive(spark, path)
    assert got.where("intact").count() == 12 and got.select("offset").distinct().count() == 12
    assert [r["payload_bytes"] for r in got.orderBy("page_id").collect()] == [i * 900 for i in range(12)]


def test_members_end_in_a_zero_byte():
    for n in (0, 1, 1000, warc.MEMBER_BYTES - 1, warc.MEMBER_BYTES, 2 * warc.MEMBER_BYTES + 5):
        parts = list(warc.members(b"x" * n))
        assert all(p[-1] == 0 for p in parts) and b"".join(map(gzip.decompress, parts)) == b"x" * n
