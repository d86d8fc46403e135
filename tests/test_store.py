"""Versions, tables changed by key, files by series, and intermediate tables."""

from __future__ import annotations

import glob
import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from catalog_loom.operators import retrieval
from catalog_loom.plans import queries
from catalog_loom.sources import files, store
from catalog_loom.sources.keyed import KeyedTable

SF = "/root/testdata/sf0.001"


def test_numbers_are_taken_once(spark, tmp_path):
    folder = f"file://{tmp_path}/v"
    assert store.state(spark, folder) == (0, None)
    assert [store.publish(spark, folder, v) for v in "abc"] == [1, 2, 3] and store.published(spark, folder) == ["c", "b", "a"]
    assert not store.take(spark, f"{folder}/published/{3:0{store.DIGITS}d}", "d") and store.state(spark, folder) == (3, "c")


def test_a_number_without_name(spark, tmp_path, monkeypatch):
    """A writer that stops between taking a number and naming the version doesn't stop others."""
    monkeypatch.setattr(store, "NAMING_S", 0.2)
    folder = f"file://{tmp_path}/v"
    store.publish(spark, folder, "a")
    store.take(spark, f"{folder}/published/{2:0{store.DIGITS}d}", "")
    assert store.state(spark, folder) == (2, "a") and store.publish(spark, folder, "b") == 3 and store.published(spark, folder, 1) == ["b"]


def test_marts_keep_their_versions(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows = spark.range(10)
    first = files.publish_mart(rows, folder, "m")
    files.publish_mart(rows.limit(3), folder, "m")
    assert first.count() == 10  # whoever reads the one before can finish
    with pytest.raises(Exception, match="torn"):
        files.publish_mart(rows.select(F.raise_error(F.lit("torn")).cast("bigint").alias("id")), folder, "m")
    assert files.read_published(spark, f"{folder}/m", "id bigint").count() == 3 and len(os.listdir(tmp_path / "m/versions")) == 2
    for n in (4, 5):
        files.publish_mart(rows.limit(n), folder, "m")
    assert files.read_published(spark, f"{folder}/m", "id bigint").count() == 5 and len(os.listdir(tmp_path / "m/versions")) == 2
    with pytest.raises(ValueError, match="nothing is published"):
        files.read_published(spark, f"{folder}/none", "id bigint")


def files_of(table):
    return set(glob.glob(f"{table.folder.removeprefix('file://')}/versions/*/data/*/*.parquet"))


def test_upsert_writes_touched_buckets(spark, tmp_path):
    rows = spark.range(1000).select("id", F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    table = KeyedTable(spark, f"file://{tmp_path}/t", rows.schema, ["id"], 32)
    assert table.read().count() == 0 and table.upsert(rows.limit(0)) == 0 and table.upsert(rows) == 32
    before = files_of(table)
    change = spark.createDataFrame([(5, "five"), (5, "fivf"), (5000, "new")], rows.schema)
    assert table.upsert(change) == 2
    assert len(files_of(table) - before) == 2 and not before - files_of(table)
    want = {r["id"]: r["name"] for r in rows.collect()} | {5: "fivf", 5000: "new"}
    assert {r["id"]: r["name"] for r in table.read().collect()} == want
    assert sum(r["row_count"] for r in table.manifest().collect()) == 1001
    for i in range(5):  # old versions go, but for those that hold buckets still
        table.upsert(spark.createDataFrame([(i, "x")], rows.schema))
    assert table.read().count() == 1001 and table.read().where("name = 'x'").count() == 5
    assert len(files_of(table)) <= 32 + 2


def test_upsert_that_fails_or_comes_late(spark, tmp_path, monkeypatch):
    rows = spark.range(100).select("id", F.lit("a").alias("name"))
    table = KeyedTable(spark, f"file://{tmp_path}/t", rows.schema, ["id"], 8)
    table.upsert(rows)
    with pytest.raises(Exception, match="torn"):
        table.upsert(rows.select("id", F.raise_error(F.lit("torn")).cast("string").alias("name")))
    number, version = store.state(spark, table.folder)
    monkeypatch.setattr(store, "state", lambda *_: (number - 1, version))  # another writer named a version meanwhile
    with pytest.raises(RuntimeError, match="another writer"):
        table.upsert(rows.limit(1).withColumn("name", F.lit("late")))
    monkeypatch.undo()
    assert table.read().where("name = 'a'").count() == 100 and len(glob.glob(f"{tmp_path}/t/versions/*")) == 1 and not glob.glob(f"{tmp_path}/t/incoming/versions/*")


def test_files_by_series(spark, tmp_path):
    """A file for each series, and for a large one as many as its bytes need."""
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).cast("bigint").alias("series_id"), "id", F.lpad(F.col("id").cast("string"), 60, "ü").alias("title"))
    rows = rows.unionByName(spark.createDataFrame([(None, 9000 + i, "x") for i in range(30)], rows.schema)).repartition(8)
    files.write_by_series(rows, f"file://{tmp_path}/one")
    names = glob.glob(f"{tmp_path}/one/*/*.json")
    assert len(names) == len(os.listdir(tmp_path / "one")) - len(glob.glob(f"{tmp_path}/one/_*")) - len(glob.glob(f"{tmp_path}/one/.*")) and len(names) == 51
    most = 40_000
    files.write_by_series(rows, f"file://{tmp_path}/cut", most)
    names = glob.glob(f"{tmp_path}/cut/*/*.json")
    assert max(map(os.path.getsize, names)) <= most and len(glob.glob(f"{tmp_path}/cut/series_id=0/*.json")) > 5 and len(glob.glob(f"{tmp_path}/cut/series_id=7/*.json")) == 1
    back = spark.read.schema("id bigint, title string, series_id bigint").json(f"file://{tmp_path}/cut").select(rows.columns)
    assert back.exceptAll(rows).isEmpty() and rows.exceptAll(back).isEmpty()
    files.write_by_series(rows.limit(0), f"file://{tmp_path}/none")
    assert not glob.glob(f"{tmp_path}/none/*/*.json")


def test_intermediate_tables_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "root_folder", lambda _: f"file://{tmp_path}/shared")
    with store.scratch():
        kept = files.written(spark.range(5), "x")
        assert kept.count() == 5 and glob.glob(f"{tmp_path}/shared/*/x")
    assert not glob.glob(f"{tmp_path}/shared/*")
    counts = []
    for name in ("mrt13_category_counts", "src1_pages_to_records", "vec6_nearest_of_each", "snk3_upsert"):
        queries.run(spark, SF, name, lambda df: counts.append(df.count()))
        assert not glob.glob(f"{tmp_path}/shared/*"), name
    assert min(counts) > 0


def test_shared_folder(spark, monkeypatch):
    """Only where Spark runs in one process is a local folder taken."""
    unset = type("S", (), {"conf": type("C", (), {"get": lambda *_: None})(), "sparkContext": type("X", (), {"master": "local[4]"})()})()
    assert files.shared_folder(unset).startswith("file:///tmp/spark-")
    unset.sparkContext.master = "yarn"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        files.shared_folder(unset)


def test_failed_texts_are_recorded_and_tried_again(spark, tmp_path):
    """A failing call is halved until the texts that fail by themselves are found; only those are called again."""
    calls = []

    def call(texts):
        if any("bad" in t for t in texts):
            raise OSError("refused")
        return [[float(len(t))] for t in texts]

    texts = spark.createDataFrame([(i, "bad" if i % 7 == 0 else "t" * i) for i in range(50)], "episode_id long, text string").coalesce(2)
    attempts = retrieval.embed(texts, call, batch=16)
    assert sorted(tuple(r) for r in retrieval.failures(attempts).collect()) == [(i, "OSError: refused", 1) for i in range(0, 50, 7)]
    ledger = KeyedTable(spark, f"file://{tmp_path}/l", StructType.fromDDL(retrieval.ATTEMPTS), ["episode_id"], 4)
    assert retrieval.embed_into(ledger, texts, call).count() == 8
    mended = texts.withColumn("text", F.when(F.col("episode_id") == 7, F.lit("good")).otherwise(F.col("text"))).unionByName(spark.createDataFrame([(99, "neu")], texts.schema))
    assert {r["episode_id"]: r["attempt"] for r in retrieval.to_resume(mended, ledger.read()).collect()} == {i: 1 for i in range(0, 50, 7)} | {99: 0}
    assert sorted((r["episode_id"], r["attempt"]) for r in retrieval.embed_into(ledger, mended, call).collect()) == [(i, 2) for i in range(0, 50, 7) if i != 7]
    rows = {r["episode_id"]: r for r in ledger.read().collect()}
    assert len(rows) == 51 and rows[7]["attempt"] == 2 and rows[7]["error"] is None and list(rows[99]["embedding"]) == [3.0] and rows[14]["embedding"] is None and rows[1]["attempt"] == 1
    short = retrieval.embed(texts.where("episode_id in (1, 2)"), lambda t: [[1.0]] * (len(t) - 1))
    assert {r["error"] for r in retrieval.failures(short).collect()} == {"ValueError: 0 vectors of 1 texts"} and not calls
    episodes = spark.createDataFrame([(1, None), (7, [9.0]), (14, [8.0])], "id long, embedding array<float>")
    assert {r["id"]: list(r["embedding"]) for r in retrieval.write_back(episodes, ledger.read().where("error is null")).collect()} == {1: [1.0], 7: [4.0], 14: [8.0]}


def test_very_many_series_share_folders(spark, tmp_path):
    """The number of files follows from the bytes; a large series is still cut, and of a series only its folders are read."""
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).cast("bigint").alias("series_id"), "id", F.lpad(F.col("id").cast("string"), 60, "ü").alias("title"))
    rows = rows.unionByName(spark.createDataFrame([(None, 9000 + i, "x") for i in range(30)], "series_id bigint, id bigint, title string")).repartition(8)
    folder, schema, most = f"file://{tmp_path}/shared", "id bigint, title string, series_id bigint", 100_000
    files.write_by_series(rows, folder, most, 100)
    names = glob.glob(f"{tmp_path}/shared/*/*/*.json")
    assert 4 < len(names) < 60 and max(map(os.path.getsize, names)) <= 3 * most and len({n for n in names if '"series_id":0,' in open(n).read()}) > 2
    back = files.read_by_series(spark, folder, schema).select(rows.columns)
    assert back.count() == rows.count() and back.exceptAll(rows).isEmpty()
    for wanted in ((0,), (7,), (None,), (7, 8, None)):
        some = files.read_by_series(spark, folder, schema, *wanted)
        want = rows.where(F.col("series_id").isin(*[x for x in wanted if x is not None]) | (F.col("series_id").isNull() if None in wanted else F.lit(False)))
        assert some.count() == want.count() > 0 and some.select(rows.columns).exceptAll(want).isEmpty()
    few = rows.where("series_id < 20")
    files.write_by_series(few, f"file://{tmp_path}/own", most, 100)
    assert files.read_by_series(spark, f"file://{tmp_path}/own", schema, 7).count() == 1 and glob.glob(f"{tmp_path}/own/series_id=7/*.json")
    files.write_by_series(rows.limit(0), f"file://{tmp_path}/none", most, 100)
    assert files.read_by_series(spark, f"file://{tmp_path}/none", schema).count() == 0


def files_below(spark, tmp_path, monkeypatch, name):
    """How many files of data a query leaves in the shared folder, and its rows."""
    monkeypatch.setattr(files, "root_folder", lambda _: f"file://{tmp_path}/shared")
    found = []
    queries.run(spark, SF, name, lambda df: found.extend([df.collect(), len(glob.glob(f"{tmp_path}/shared/*/**/part-*", recursive=True))]))
    return found


def test_artifacts_of_records_in_packs(spark, tmp_path, monkeypatch):
    """Records of 150 series don't make 150 files; an artifact is read alike from a file of its own and from a line of a pack."""
    rows, n = files_below(spark, tmp_path, monkeypatch, "src3_record_files")
    assert len(rows) == 1500 and n < 20
    arrays = ['[{"title":"a\\nb","speakers":[{"role":"r","speaker":"s"}],"genres":[]},{"title":"c"}]', "[]", '[{"title":"ü"}]']
    (tmp_path / "own").mkdir()
    (tmp_path / "pack").mkdir()
    for i, a in enumerate(arrays):
        (tmp_path / "own" / f"{i}.json").write_text(a)
    (tmp_path / "pack" / "p.json").write_text("\n".join(arrays))
    own, packed = (files.read_records(spark, f"file://{tmp_path}/{name}", name == "pack") for name in ("own", "pack"))
    assert sorted(map(str, own.collect())) == sorted(map(str, packed.collect())) and packed.count() == 3


def test_payloads_in_packs(spark, tmp_path, monkeypatch):
    rows, n = files_below(spark, tmp_path, monkeypatch, "src6_result_files")
    assert len(rows) > 1000 and n < 20
    (tmp_path / "pack").mkdir()
    (tmp_path / "pack" / "p.json").write_text('{"payload":"p1","results":[{"collectionId":5,"artistName":"A"},{"collectionId":6}]}\n{"payload":"p2","results":[]}\n')
    assert [tuple(r)[:4] for r in files.read_results(spark, f"file://{tmp_path}/pack", packed=True).orderBy("pos").collect()] == [("p1", 0, "5", "A"), ("p1", 1, "6", None)]


def tables_below(spark, tmp_path, monkeypatch, name):
    """What a query leaves in the shared folder when its rows are read, and how many rows there are."""
    monkeypatch.setattr(files, "root_folder", lambda _: f"file://{tmp_path}/shared")
    found = []
    queries.run(spark, SF, name, lambda df: found.extend([df.count(), {os.path.basename(os.path.dirname(p)) for p in glob.glob(f"{tmp_path}/shared/*/**/part-*", recursive=True)}]))
    return found


def test_pages_go_when_they_are_read(spark, tmp_path, monkeypatch):
    """neither packs nor what the kept records were made of lies on disk beside what follows."""
    n, tables = tables_below(spark, tmp_path, monkeypatch, "src1_pages_to_records")
    assert n > 1000 and "kept" in tables and not {"series", "details", "rows"} & tables


def test_a_folder_of_pages_goes_when_it_is_read(spark, tmp_path, monkeypatch):
    """of a sorted folder only the sorted records stay."""
    n, tables = tables_below(spark, tmp_path, monkeypatch, "ext2l_detail_folder")
    assert n > 1000 and tables == {"numbered"}


def shuffles(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}


def test_shuffles_go_with_what_is_written(spark, tmp_path, monkeypatch):
    """what a written table was made of isn't left until the driver collects garbage."""
    monkeypatch.setattr(files, "root_folder", lambda _: f"file://{tmp_path}/shared")
    before, setting = shuffles(spark), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    with store.scratch():
        rows = files.written(spark.range(1000).repartition(5, "id"), "x")
        files.pack_pages(rows.repartition(3, "id").select(F.col("id").cast("string").alias("page"), F.lit("x").cast("binary").alias("content")), f"file://{tmp_path}/p")
        files.publish_if_valid(rows.repartition(3, "id"), lambda df: df.groupBy((F.col("id") % 7).cast("string").alias("check_name")).agg(F.lit(0).cast("long").alias("violations")), f"file://{tmp_path}/v")
        until = time.monotonic() + 10
        while (left := shuffles(spark) - before) and time.monotonic() < until:
            time.sleep(0.1)
        assert not left and rows.count() == 1000 and files.packed_contents(spark, f"file://{tmp_path}/p").count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
