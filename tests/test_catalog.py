"""The catalog operators on small frames."""

from __future__ import annotations

import hashlib
import os
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from catalog_loom.functions import text as tx
from catalog_loom.functions import unicode as un
from catalog_loom.operators import coverage, dedup, extract, load, marts, quality, retrieval, variants
from catalog_loom.operators.order import numbered
from catalog_loom.plans.queries import QUERIES, SQL, Frames
from catalog_loom.sources import files

SF = "/root/testdata/sf0.001"
CREDITS = "array<struct<role:string,speaker:string>>"
BASE = "https://pages.test/"
DETAIL = """<!doctype html><body><img src="logo.gif"><img src="bilder/bilder/nebel.jpg"><table background="img/backgrounds/BG_hsp_dynamisch.gif">
<tr><td width="75%" align="left" valign="top">Serie: <a href="hsp_serie.asp?serie=88">Nebelk&uuml;ste</a> <a href="hsp_anzeige.asp?code=905">12</a> <a href="hsp_anzeige.asp?code=905">Das stille Riff &amp; der Leuchtturm</a>
<a href="hsp_anzeige.asp?code=904">Folge davor</a><a href="hsp_anzeige.asp?code=911">n&auml;chste</a> <a href="hsp_serienanzeige.asp?verlag=31">Tonwerk Nord</a>
<td width="35%" align="justify" valign="top"><span class="big t4_bold">Inhalt / Beschreibung:</span><br><span class="t5"> Ein   Boot
 fehlt. <b>Wieder.</b></span> Dauer: 61,5 Minuten, vom 09.11.2003, Bestellnummer: CD: TWN-0077 <script>var x = "Dauer: 1 Minuten";</script>
<td width="35%" align="left" valign="top"><table><tr><td>1<td>Rolle<td><td>Sprecher/in<tr><td>2<td>Lotse Brandt<td>-<td>Holm, Ida<tr><td>3<td>nur drei<td>Zellen<tr><td>4<td>Chor<td><td>Kr&uuml;ger, Uwe</table></table>
<table><tr><td>- Krimi<td>- See  fahrt</td></tr><tr><td>kein Genre</td><td>- </td></tr></table>"""
FIRST = """<table background="img/backgrounds/BG_hsp_dynamisch.gif"><tr><td width="75%" align="left" valign="top"><a href="hsp_serie.asp?serie=88">Nebelküste</a><a href="hsp_anzeige.asp?code=904">elf</a>
<a href="hsp_anzeige.asp?code=904">Auftakt</a> keine Folge  davor <a href="hsp_anzeige.asp?code=905">weiter</a></td></tr></table>"""
LIST = """<table><tr><td>Serie<td>Nr<td>Titel<tr><td><a href="hsp_serie.asp?serie=88&x=1">Serien: Nebelküste</a><td> 12 <td><a href="hsp_anzeige.asp?code=905">Das stille Riff</a>
<tr><td><a href="hsp_serie.asp?serie=88">Serien: Nebelküste</a><td>11a<td>Ohne Verweis<tr><td><a href="hsp_serie.asp?serie=88">Nebelküste</a><td>13<td><a href="hsp_anzeige.asp?code=950">Das stille Riff</a>
<tr><td><a href="andere.asp">Nebelküste</a><td>1<td>Fremd<tr><td><a href="hsp_serie.asp?serie=88">Nebelküste</a><td>14<td><a href="http://[kaputt/hsp_anzeige.asp?code=7">Sturm</a></table>"""
DEEP = "<div>" * 3000 + "x"


def one(df):
    return df.first()[0]


@pytest.mark.parametrize(("raw", "clean"), [("  a \u0085 b ", "a ... b"), ("\u0084x\u0093", '"x"'), ("a – b", "a - b"), (" \t", None), (None, None)])
def test_clean_text(spark, raw, clean):
    assert one(spark.createDataFrame([(raw,)], "x string").select(tx.clean_text(F.col("x")))) == clean


@pytest.mark.parametrize(("raw", "clean"), [("CD.", None), ("abc", None), ("ABC-1", "ABC-1"), ("cd", None)])
def test_order_number(spark, raw, clean):
    assert one(spark.createDataFrame([(raw,)], "x string").select(tx.clean_order_number(F.col("x")))) == clean


@pytest.mark.parametrize(("raw", "date"), [("01.02.2020", "2020-02-01"), ("1.2.2020", "2020-02-01"), ("2020-01-01", None), ("31.02.2020", None)])
def test_dates(spark, raw, date):
    assert one(spark.createDataFrame([(raw,)], "x string").select(tx.release_date(F.col("x")).cast("string"))) == date


def test_decode_page(spark):
    """Every byte of the encoding: those with a character, the one that stands for a u umlaut, and those without any."""
    none = {0x8D, 0x8F, 0x90, 0x9D}
    rows = [(b, b"[" + bytes([b]) + b"]") for b in range(256)] + [(256, b"Br\x81cke zum T\xfc\x81rmchen")]
    got = {r["n"]: r for r in spark.createDataFrame(rows, "n int, c binary").select("n", tx.decode_page(F.col("c")).alias("x"), tx.undecodable(F.col("c")).alias("bad")).collect()}
    assert got[256]["x"] == "Brücke zum Türmchen"
    for n in range(256):
        assert got[n]["bad"] == (n in none)
        if n not in none:
            assert got[n]["x"] == "[" + ("ü" if n == 0x81 else bytes([n]).decode("cp1252")) + "]"
    kept = "".join(bytes([n]).decode("cp1252") for n in range(256) if n not in none and n != 0x81)
    assert one(spark.createDataFrame([(kept,)], "x string").select(tx.decode_page(tx.encode_page(F.col("x"))))) == kept


def test_search_text_and_keys(spark):
    assert one(spark.createDataFrame([("Nebelküste ??? – Überfall!",)], "x string").select(un.search_text(F.col("x")))) == "nebelkuste uberfall"
    rows = [("https://x.test/a?code=77", "S", "T"), (None, "Weiße Nebelküste", "Das Riff"), (None, "  WEISSE   NEBELKÜSTE ", "das\u00a0riff"), ("https://x.test/other", "S", "T")]
    keys = [r[0] for r in spark.createDataFrame(rows, "u string, s string, t string").select(un.source_key(F.col("u"), F.col("s"), F.lit(7), F.col("t"))).collect()]
    assert keys[0] == "cat:episode:77" and keys[1].startswith("cat:stub:") and keys[1] == keys[2]
    assert keys[3] == "cat:episode-url:" + hashlib.sha256(b"https://x.test/other").hexdigest()


def test_spellings(spark):
    said = ["Kraemer, Jörn", "Krämer, Jörn", "KRÄMER, Jörn", "Krämer, Jörn", "Kraemer, Joern", "Boettcher", "Hueter"]
    parts = ["die Lotsin", "Die Lotsin", "DIE LOTSIN", "Die Lotsin", "Waechter", "Wächter", "Wirt"]
    df = spark.createDataFrame([(i, s, r) for i, (s, r) in enumerate(zip(said, parts, strict=True))], "ord int, speaker string, role string")
    pairs = lambda rows: sorted(tuple(r) for r in rows.collect())
    assert pairs(dedup.speaker_spellings(df, "speaker", ["ord"])) == [("Kraemer, Joern", "Krämer, Jörn"), ("Kraemer, Jörn", "Krämer, Jörn")]
    assert pairs(dedup.role_spellings(df, "role", ["ord"])) == [("DIE LOTSIN", "Die Lotsin"), ("Wächter", "Waechter"), ("die Lotsin", "Die Lotsin")]
    assert dedup.speaker_spellings(df, "speaker", ["ord"], ("Krämer, Jörn",)).count() == 0
    nested = spark.createDataFrame([("a", 1, [("die Lotsin", "Kraemer, Jörn"), ("Wirt", "Krämer, Jörn")]), ("b", 2, []), ("c", 3, [("Die Lotsin", "Krämer, Jörn"), ("Die Lotsin", "Y")])], f"k string, ord int, speakers {CREDITS}")
    got = {r["k"]: [tuple(c) for c in r["speakers"]] for r in dedup.canonical_credits(nested, "k", ["ord"]).collect()}
    assert got == {"a": [("Die Lotsin", "Krämer, Jörn"), ("Wirt", "Krämer, Jörn")], "b": [], "c": [("Die Lotsin", "Krämer, Jörn"), ("Die Lotsin", "Y")]}


def test_keep_first(spark):
    df = spark.createDataFrame([("u", 1), ("u", 2), (None, 3), (None, 4)], "url string, ord int")
    assert sorted(r["ord"] for r in dedup.keep_first(df, ["url"], ["ord"]).collect()) == [1, 3]
    assert sorted(r["ord"] for r in dedup.keep_first_where_known(df, "url", ["ord"]).collect()) == [1, 3, 4]


def test_detail_pages(spark):
    pages = [("d", DETAIL), ("first", FIRST), ("broken", "<html>"), ("none", None), ("deep", DEEP), ("bad", DETAIL.replace("hsp_anzeige.asp?code=904", "http://[kaputt/hsp_anzeige.asp?code=904")), ("minutes", DETAIL.replace("61,5", "1.2,3"))]
    d = {r["page"]: r for r in extract.parse_detail_pages(spark.createDataFrame(pages, "page string, html string"), BASE).collect()}
    assert len(d) == len(pages) and d["broken"]["title"] is None and d["deep"]["title"] is None and d["none"]["speakers"] == []
    got = d["d"].asDict(recursive=True)
    assert got == {
        "page": "d", "parse_error": None, "title": "Das stille Riff & der Leuchtturm", "series_name": "Nebelküste", "episode_number": 12, "description": "Ein Boot fehlt. Wieder.", "duration_minutes": 61.5,
        "release_date": "09.11.2003", "label": "Tonwerk Nord", "cover_url": BASE + "bilder/bilder/nebel.jpg", "order_number": "TWN-0077", "genres": ["Krimi", "See fahrt"],
        "speakers": [{"role": "Lotse Brandt", "speaker": "Holm, Ida"}, {"role": "Chor", "speaker": "Krüger, Uwe"}], "previous_episode_url": BASE + "hsp_anzeige.asp?code=904",
        "next_episode_url": BASE + "hsp_anzeige.asp?code=911", "source_url": BASE + "hsp_anzeige.asp?code=905",
    }
    assert (d["first"]["episode_number"], d["first"]["previous_episode_url"], d["first"]["next_episode_url"]) == (None, None, BASE + "hsp_anzeige.asp?code=905")
    assert d["bad"]["parse_error"].startswith("address") and d["bad"]["title"] == got["title"] and d["bad"]["previous_episode_url"] is None
    assert d["minutes"]["parse_error"] == "bad duration 1.2,3"


def test_list_pages(spark):
    pages = spark.createDataFrame([("1", LIST), ("deep", DEEP), ("none", None)], "page string, html string")
    got = extract.parse_list_pages(pages, BASE).orderBy("pos").collect()
    want = [("Das stille Riff", 12, True), ("Ohne Verweis", None, False), ("Sturm", 14, False)]
    assert [(r["title"], r["episode_number"], r["has_detail_page"]) for r in got] == want and {r["series_name"] for r in got} == {"Nebelküste"}
    assert [bool(r["parse_error"]) for r in got] == [False, False, True]
    assert extract.unread_list_pages(pages, BASE).count() == 0
    assert extract.page_series(pages).where("page = '1'").first()["series_id"] == 88


def test_page_files_to_records(spark, tmp_path):
    """From files of bytes to a published artifact: outcomes, cleaning, keys, duplicates and spellings."""
    detail = lambda code, title, credit: DETAIL.replace("905", str(code)).replace("Das stille Riff &amp; der Leuchtturm", title).replace("Lotse Brandt", credit[0]).replace("Holm, Ida", credit[1])
    row = lambda code, title: f'<tr><td><a href="hsp_serie.asp?serie=88">Serien: Nebelküste</a><td>{code % 100}<td>' + (f'<a href="hsp_anzeige.asp?code={code}">{title}</a>' if code < 990 else title)
    lists = {"b.html": [(905, "Riff"), (906, "Flut"), (907, "Fehlt"), (908, "Leer"), (991, "Offen")], "a.html": [(906, "Flut zuerst"), (991, "  OFFEN ")]}
    details = {905: ("Riff", ("lotse brandt", "Kröger, Ida")), 906: ("Flut – Ebbe", ("Lotse Brandt", "Kroeger, Ida")), 909: ("Ungenannt", ("Lotse Brandt", "X"))}
    for folder in ("series", "details"):
        (tmp_path / folder).mkdir()
    for name, rows in lists.items():
        (tmp_path / "series" / name).write_bytes(("<table>" + "".join(row(*r) for r in rows) + "</table>").encode("cp1252"))
    names = {r["code"]: r["name"] for r in spark.createDataFrame([(c, f"{BASE}hsp_anzeige.asp?code={c}") for c in (*details, 908)], "code int, url string").select("code", tx.page_file_name(F.col("url")).alias("name")).collect()}
    for code, (title, credit) in details.items():
        (tmp_path / "details" / names[code]).write_bytes(detail(code, title, credit).encode("cp1252"))
    (tmp_path / "details" / names[908]).write_bytes(b"<html>")
    records, matched = extract.build_records(files.read_pages(spark, f"file://{tmp_path}/series"), files.read_pages(spark, f"file://{tmp_path}/details"), BASE)
    assert {(r["outcome"], r["n"]) for r in extract.outcome_stats(matched).collect()} == {("with_detail", 3), ("stub_missing_html", 1), ("stub_parse_error", 1), ("stub_without_link", 2)}
    out = files.publish_if_valid(records, quality.check_records, f"file://{tmp_path}/out")
    got = {r["source_key"].split(":")[-1] if "episode" in r["source_key"] else "stub": r for r in out.collect()}
    assert set(got) == {"905", "906", "907", "908", "stub"} and out.count() == 5
    assert got["906"]["title"] == "Flut - Ebbe" and got["906"]["page"] == "a.html" and got["stub"]["title"] == "OFFEN"
    assert [tuple(c) for c in got["906"]["speakers"]][0] == ("Lotse Brandt", "Kröger, Ida") and [tuple(c) for c in got["905"]["speakers"]][0] == ("Lotse Brandt", "Kröger, Ida")
    assert got["907"]["description"] is None and got["907"]["speakers"] == [] and got["907"]["source_url"].endswith("907")


def test_broken_pages(spark):
    bad = "Schiff \ufffd ahoi"
    rows = [("4711.html", bad), ("4712.html", "Schiff ahoi"), ("seite_code_88_hafen.html", f"{bad}{bad}"), ("seite_code_89_hafen.html", None), ("hafen.html", bad), ("4713.html.bak", bad), ("4711.html", bad)]
    got = extract.broken_pages(spark.createDataFrame(rows, "page string, html string")).collect()
    assert sorted(tuple(r) for r in got) == [("episode", 88), ("series", 4711)]


def test_title_markers(spark):
    def flags(title: str) -> set[str]:
        df = spark.createDataFrame([(title.lower(),)], "t string")
        row = df.select(*[F.col("t").rlike(p).alias(n) for n, p in variants.MARKERS.items()], (F.col("t").contains("/") & ~F.col("t").rlike(variants.PART_NUMBERS)).alias("multi")).first()
        return {n for n, v in row.asDict().items() if v}

    assert flags("Fanbox (Folgen 01-03)") == {"fanbox"}
    assert flags("Das stille Riff (LP-Edition)") == {"format_reissue"}
    assert flags("Das Rätsel (Teil 1/2)") == set()
    assert flags("Doppelfolge: A / B") == {"compilation", "multi"}
    assert flags("Alive") == set()


def test_load_checks(spark):
    names = spark.createDataFrame([("b",), ("a",)], "name string")
    ids = load.with_ids(names)
    assert sorted(tuple(r) for r in ids.collect()) == [(1, "a"), (2, "b")]
    more = load.with_ids(spark.createDataFrame([("a",), ("0",)], "name string"), ids)
    pairs = spark.createDataFrame([("b", "y"), ("a", None), ("b", "x"), (None, "z"), ("ä", "x")], "one string, two string")
    both = load.dimensions(pairs.repartition(3), ["one", "two"])
    assert {c: sorted(tuple(r) for r in df.collect()) for c, df in both.items()} == {"one": [(1, "a"), (2, "b"), (3, "ä")], "two": [(1, "x"), (2, "y"), (3, "z")]}
    assert all(df.count() == 0 for df in load.dimensions(pairs.limit(0), ["one", "two"]).values())
    assert sorted(tuple(r) for r in more.collect()) == [(1, "a"), (2, "b"), (3, "0")]
    records = spark.createDataFrame([("S", None, 1), ("S", "Label", 2)], "series_name string, label string, ord int")
    assert load.series_dimension(records, ["ord"]).first()["label"] == "Label"
    with pytest.raises(ValueError, match="not empty"):
        load.assert_empty({"x": names})


def test_record_checks_and_publish(spark, tmp_path):
    rows = [("k1", "u1", [("Hero", "A�")], ["g"]), ("k1", "u2", [], [])]
    df = spark.createDataFrame(rows, f"source_key string, source_url string, speakers {CREDITS}, genres array<string>")
    found = {r["check_name"]: r["violations"] for r in quality.check_records(df).collect()}
    assert found == {"arrays_present": 0, "no_replacement_character": 1, "key_present": 0, "not_empty": 0, "unique_source_key": 1, "unique_source_url": 0}
    good = df.limit(1).withColumn("speakers", F.array().cast(CREDITS))
    folder = f"file://{tmp_path}/p"
    assert files.publish_if_valid(good, quality.check_records, folder).count() == 1
    with pytest.raises(ValueError, match="not published"):
        files.publish_if_valid(df, quality.check_records, folder)
    torn = df.select(F.raise_error(F.lit("torn")).alias("source_key"), *df.columns[1:])
    with pytest.raises(Exception, match="torn"):
        files.publish_if_valid(torn, quality.check_records, folder)
    assert files.read_published(spark, folder, good.schema).count() == 1
    again = good.unionByName(good.withColumns({"source_key": F.lit("k2"), "source_url": F.lit("u2")}))
    assert files.publish_if_valid(again, quality.check_records, folder).count() == files.read_published(spark, folder, good.schema).count() == 2


def test_stubs(spark):
    """A record with an order number and nothing else is a stub; one with a label is not."""
    empty = (None, None, None, None, None, [], [])
    rows = [(1, "ABC-1", *empty), (2, None, "text", *empty[1:]), (3, None, None, 1.5, *empty[2:]), (4, None, None, None, "01.02.2003", *empty[3:]), (5, None, None, None, None, "Label", *empty[4:])]
    rows += [(6, None, *empty[:4], "cover", [], []), (7, None, *empty[:5], [("Role", "Speaker")], []), (8, None, *empty[:6], ["genre"]), (9, None, *empty)]
    df = spark.createDataFrame(rows, f"id int, order_number string, description string, duration_minutes double, release_date string, label string, cover_url string, speakers {CREDITS}, genres array<string>")
    assert sorted(r["id"] for r in df.where(quality.is_stub()).collect()) == [1, 9]


def test_report_is_never_overwritten(spark, tmp_path):
    df = spark.createDataFrame([("p", 1)], "probe_key string, n int")
    at = datetime(2024, 1, 1)
    files.publish_report(df, f"file://{tmp_path}", at)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        files.publish_report(df, f"file://{tmp_path}", at)


def test_coverage_counts(spark):
    found = [("p", 0, "1", "Nebelküste", "Folge 1: Das Riff", "2020-01-01"), ("p", 1, "2", "Nebelküste", "Folge 1: Das Riff", "2021"), ("p", 2, "3", "Other", "Else", "x")]
    results = spark.createDataFrame(found, "probe_key string, pos int, collection_id string, artist_name string, collection_name string, release_date string")
    probes = spark.createDataFrame([("p", "Nebelküste", ["Nebelküste"])], "probe_key string, series_name string, aliases array<string>")
    r = coverage.probe_report(results, coverage.last_of_each(coverage.candidates(results, probes))).first()
    assert (r["candidates"], r["numbered"], r["distinct_numbers"], r["duplicate_titles"], r["earliest_year"]) == (2, 2, 1, 1, 2020)


def _shown(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


NEW = ["src1_pages_to_records", "src3_record_files", "src5_seed_files", "src6_result_files", "val2_record_stats", "val8_9_counts", "val11_counts_match", "val12_reviews", "val13_links", "val14_spot_checks", "vec7_context", "cov5_hash", "qry18_search", "snk1_publish", "snk1b_by_series", "snk2_mart", "snk3_upsert", "vec4_ledger", "vec6_nearest_of_each", "eda5_durations", "ext2_detail_pages", "ext2k_series_ids", "ext2l_detail_folder"]


@pytest.mark.parametrize("name", ["qry3_genre_trends", "mrt11_kpis", "mrt13_category_counts", "res11gh_candidates", "res12_review_export", "ded4_speaker_spellings", "cov3_report", "ext1_list_pages", "vec5_nearest", *NEW])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(SQL[name])
    have = [c[0] for c in cursor.description]
    want = sorted(tuple(_shown(r[have.index(c)]) for c in columns) for r in cursor.fetchall())
    assert sorted(have) == columns
    assert sorted(tuple(_shown(v) for v in r) for r in df.select(columns).collect()) == want


def test_first_bad_dates(spark):
    df = spark.createDataFrame([(f"{d}.02.2020",) for d in range(25, 35)] + [(None,)], "release_date string")
    assert [r["release_date"] for r in quality.bad_dates(df, tx.release_date(F.col("release_date"))).collect()] == ["30.02.2020", "31.02.2020", "32.02.2020", "33.02.2020", "34.02.2020"]


def test_places_and_upserts(spark):
    """Places follow the order over all ranges; of incoming rows that repeat a key one stays."""
    df = spark.createDataFrame([(i * 37 % 101, i % 3) for i in range(101)], "x int, y int").repartition(5)
    got = {r["x"]: r["place"] for r in numbered(df, F.col("y").desc(), "x").collect()}
    want = sorted(((-(i % 3), i * 37 % 101) for i in range(101)))
    assert got == {x: n + 1 for n, (_, x) in enumerate(want)} and numbered(df.limit(0), "x").count() == 0
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k int, v string")
    assert sorted(tuple(r) for r in load.upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, "d"), (3, "e")]


def test_dealt_parts_stay_small(spark):
    """the parts of what is dealt out grow in number and not in size."""
    rows = lambda n: marts.dealt(spark.range(n), "id", most=100)
    sizes = [max(rows(n).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()) for n in (2_000, 20_000)]
    assert rows(20_000).rdd.getNumPartitions() == 200 and max(sizes) < 200


def test_catalog_without_casts(spark):
    """categories made without texts and fingerprints are those of the whole classifications."""
    f = Frames(spark, SF)
    got = f.kinds
    assert "classified" not in f._made and not {"description", "cast_fingerprint", "episode_title"} & set(f._made["kind_features"].columns)
    want = f.classified.select(got.columns)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty() and f.kinds is f.classified
    links = spark.createDataFrame([(1, 7, 9), (1, 7, 9), (2, 7, 8), (3, 6, 9)], "episode_id bigint, speaker_id bigint, role_id bigint")
    ids = lambda name, i: spark.createDataFrame([(i,)], f"{name}_id bigint")
    assert [tuple(r) for r in variants.known_casts(links, ids("speaker", 7), ids("role", 9)).collect()] == [(1, 1)]


def test_candidates_from_sources(spark):
    """links and candidates made of what they show are those of the whole classifications."""
    f, whole = Frames(spark, SF), Frames(spark, SF)
    sources, refs = f.linked
    assert not {"series_name", "order_number", "franchise_name"} & {*sources.columns, *refs.columns} and sources.where("variant_category = 'regular_episode'").isEmpty()
    assert whole.classified.count() and whole.linked[1] is whole.refs
    shown = lambda x: x.candidates.withColumn("match_reasons", F.to_json("match_reasons"))
    assert shown(f).count() == shown(whole).count() and shown(f).exceptAll(shown(whole)).isEmpty()


def test_catalog_of_one_series(spark):
    """only the series asked for is classified, as it is among all."""
    f = Frames(spark, SF)
    mine, want = f.of_series(3).catalog, f.catalog.where("series_id = 3")
    assert mine.count() == want.count() > 0 and mine.exceptAll(want).isEmpty()
    part = f.of_series(3)
    assert part.kinds.count() == want.count()


def test_casts_by_pair(spark):
    rows = spark.createDataFrame([(1, 10, 5), (1, 9, 7), (1, 9, 6), (2, None, 4)], "episode_id bigint, speaker_id bigint, role_id bigint")
    got = {r["episode_id"]: (r["cast_count"], r["cast_fingerprint"]) for r in variants.casts(rows).collect()}
    digest = lambda x: hashlib.md5(x.encode()).hexdigest()
    assert got == {1: (2, digest("9:6,9:7,10:5")), 2: (0, digest(":4"))}
