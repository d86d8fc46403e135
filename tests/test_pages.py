"""Pages: a parser that is linear in the page, against one that looks through the tree again and again; and packs of pages."""

from __future__ import annotations

import glob
import os
import random
import time
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from catalog_loom.functions import text as tx
from catalog_loom.operators import extract
from catalog_loom.sources import files

PIECES = [
    "<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<td>", "<tr>", "<table><tr><td>", '<a href="hsp_serie.asp?serie=7">S', "</a>", '<a href="hsp_anzeige.asp?code=3">T', "<div>", "</div>", "</p>", " 21 ", "- See", "x y", "<br>", "<td/>",
    "<script>", "</script>", "&auml;", "<!-- k -->",
]


class Tree(HTMLParser):
    """A tree of [tag, attributes, children], where strings are children too."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.open = [["", {}, []]]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in ("td", "tr"):
            leave, depth = None, len(self.open) - 1
            while depth > 0 and self.open[depth][0] != "table":
                if self.open[depth][0] == tag or (tag == "tr" and self.open[depth][0] == "td"):
                    leave = depth
                depth -= 1
            if leave is not None:
                del self.open[leave:]
        new = [tag, dict(attrs), []]
        self.open[-1][2].append(new)
        if tag not in extract.VOID:
            self.open.append(new)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth][0] == tag:
                del self.open[depth:]
                return

    def handle_data(self, data):
        if self.open[-1][0] not in ("script", "style") and data.strip():
            self.open[-1][2].append(data.strip())


def below(node, tag):
    for child in node[2]:
        if not isinstance(child, str):
            if child[0] == tag:
                yield child
            yield from below(child, tag)


def text(node):
    return "".join(c if isinstance(c, str) else text(c) for c in node[2])


def linked(node, part):
    return next((a for a in below(node, "a") if part in (a[1].get("href") or "")), None)


def naive_rows(html):
    root = Tree(html).open[0]
    for row in below(root, "tr"):
        cells = list(below(row, "td"))
        series = linked(cells[0], extract.SERIES_LINK) if len(cells) >= 3 else None
        if series is not None:
            link = linked(cells[2], extract.DETAIL_LINK)
            title = text(cells[2] if link is None else link)
            if title and title not in extract.HEADERS:
                yield text(series), text(cells[1]).strip(), title, None if link is None else link[1]["href"]


def test_rows_against_tree():
    rng, found = random.Random(11), 0
    for _ in range(4000):
        html = "".join(rng.choice(PIECES) for _ in range(rng.randrange(60)))
        want = list(naive_rows(html))
        assert list(extract.list_rows(extract.Page(html))) == want, html
        found += len(want)
    assert found > 50


@pytest.mark.parametrize("html", [
    "<table><tr><td>" * 40_000, "<div>" * 40_000 + "<td>x" * 40_000, "<div>" * 40_000 + "</p>" * 40_000, '<span class="t4_bold">' * 40_000, "<tr>" * 40_000 + "</tr>" * 40_000, '<table><tr><td><a href="hsp_serie.asp?serie=4">S</a><td>1<td>' * 10_000,
    f'<table background="{extract.DETAIL_BACKGROUND}"><td width="35%" align="left" valign="top">' + "<table><tr><td>a<td>b<td>c<td>d" * 10_000,
])
def test_pages_are_read_in_linear_time(html):
    began = time.monotonic()
    page = extract.Page(html)
    for read in (lambda p: list(extract.list_rows(p)), extract.detail):
        try:
            read(page)
        except ValueError as e:
            assert "repeat the text" in str(e)
    assert time.monotonic() - began < 8  # quadratic readers take minutes


def test_nested_texts_give_an_error(spark):
    """A page whose nested cells would repeat its text thousands of times gives a parse_error and stops no other."""
    pages = spark.createDataFrame([("deep", "<table><tr><td>- x" * 3000), ("plain", "<table><tr><td>- x</table>")], "page string, html string")
    got = {r["page"]: r for r in extract.parse_detail_pages(pages, "https://x.test/").collect()}
    assert "repeat the text" in got["deep"]["parse_error"] and got["plain"]["parse_error"] is None and got["plain"]["genres"] == ["x"]


def test_packs(spark, tmp_path):
    rows = [(f"seite_{i:04d}.html", ("„Größe“ – € " + str(i)) * (i % 40)) for i in range(700)]
    pages = spark.createDataFrame(rows, "page string, html string").repartition(7)
    folder = f"file://{tmp_path}/packs"
    files.pack_pages(pages.select("page", tx.encode_page(F.col("html")).alias("content")), folder, 20_000)
    packs = glob.glob(f"{tmp_path}/packs/part-*")
    assert 5 < len(packs) < 40
    got = files.read_packed(spark, folder)
    assert sorted((r["page"], r["html"]) for r in got.collect()) == rows and got.where("undecodable").count() == 0


def test_packs_of_any_bytes(spark, tmp_path):
    rows = [("all", bytes(range(256)) * 3), ("none", b""), ("null", None), ("lines", b"\n\r\n\n"), ("digits", b"000000000012")]
    raw = spark.createDataFrame(rows, "page string, content binary")
    for n, size in enumerate((1, 100, 1 << 20)):
        files.pack_pages(raw, f"file://{tmp_path}/{n}", size)
        got = {r["page"]: bytes(r["content"]) for r in files.packed_contents(spark, f"file://{tmp_path}/{n}").collect()}
        assert got == {k: v or b"" for k, v in rows}
    files.pack_pages(raw.limit(0), f"file://{tmp_path}/empty")
    assert files.read_packed(spark, f"file://{tmp_path}/empty").count() == 0


def test_detail_folder(spark):
    pages = spark.createDataFrame([(f"{n}.html", "<html>") for n in (10, 2, 1)] + [(None, "x")], "page string, html string")
    got = extract.records_of_folder(pages, "https://x.test/").orderBy("place").collect()
    assert [(r["place"], r["source_file"]) for r in got] == [(1, None), (2, "1.html"), (3, "10.html"), (4, "2.html")]


@pytest.mark.parametrize(("href", "number"), [
    ("hsp_serie.asp?serie=12", 12), ("hsp_serie.asp?serie=12&x=3", 12), ("hsp_serie.asp?serie=12&amp;x", 12), ("hsp_serie.asp?serie=", None), ("hsp_serie.asp?serie=12a", None), ("hsp_serie.asp?serie=+4", 4), ("hsp_serie.asp?serie=99999999999999999999", None),
    ("andere.asp?serie=3", None),
])
def test_series_of_page(spark, href, number):
    html = f"<p><a class='x' href='eins.asp'>a</a><A title=\"t\" HREF='{href}'>b</a>"
    later = html + '<a href="hsp_serie.asp?serie=77">c</a>'
    got = {r["page"]: r["series_id"] for r in extract.page_series(spark.createDataFrame([("a", html), ("b", later), ("c", "no link"), ("d", None)], "page string, html string")).collect()}
    assert got == {"a": number, "b": 77 if href.startswith("andere") else number, "c": None, "d": None}


class Whole(extract.Page):
    """A page read by HTMLParser throughout."""

    def _split(self, html):
        return False


PLAIN_PIECES = [*PIECES[:20], "&uuml; &amp", '<td width="75%" align="left" valign="top">', '<td width="35%" align="justify" valign="top">', '<td width="35%" align="left" valign="top">', '<span class="t4_bold">Beschreibung:</span>', '<span class="big t5">', "</span>", '<img src="bilder/bilder/1.jpg">', f'<table background="{extract.DETAIL_BACKGROUND}">', "<tr><td>x</td><td> - y</td><td></td><td>&auml;</td></tr>", "<tr>" + "<td>z</td>" * 7 + "</tr>", '<a href="hsp_anzeige.asp?code=3">&amp;T</a>', '<a href="hsp_serie.asp?serie=7">S</a>', "<tr><td>- K</td></tr>"]


def test_plain_pages_are_read_alike():
    """Pages that are split at plain tags give what HTMLParser gives, whatever is left open or closed twice; others aren't split."""
    rng, plain = random.Random(5), 0
    state = ("tags", "attrs", "last", "start", "end", "strings", "of", "cells", "links", "upto")
    for n in range(4000):
        html = "".join(rng.choice(PLAIN_PIECES if n % 4 else [*PLAIN_PIECES, *PIECES[20:], "<TD>", "<td x=1>", "a < b", '<a href="?a&amp;b">', "</a x>", "<title>", "</title>", "<"]) for _ in range(rng.randrange(80)))
        plain += "<" not in "".join(extract.PLAIN.split(html)[::5])
        one, other = extract.Page(html), Whole(html)
        assert all(getattr(one, c) == getattr(other, c) for c in state), html
        assert extract.taken(html, extract.detail) == (extract.detail(other), None)
    assert plain > 1000


def test_plain_pages_are_not_read_by_html_parser(monkeypatch):
    cell = "<tr><td></td><td>Erzähler</td><td></td><td>Müller</td></tr>"
    html = f'<table background="{extract.DETAIL_BACKGROUND}"><tr><td width="35%" align="left" valign="top"><table>{cell * 3}</table></td></tr></table>'
    monkeypatch.setattr(extract.Page, "feed", lambda *_: pytest.fail("read by HTMLParser"))
    assert len(extract.detail(extract.Page(html))["speakers"]) == 3


@pytest.mark.parametrize("base", ["https://x.test/", "https://x.test", "https://x.test/a/b?c=1", "https://x.test/a/../b/", "http://x.test//a/", "a/b", "", "mailto:x", "file:///a/b"])
@pytest.mark.parametrize("href", ["hsp_anzeige.asp?code=7", "bilder/bilder/3.jpg", "a", "a/b/c?x=1", "../a", "./a", "/a", "//b/c", "a:b", "?x", "", "a//b", "a/..", "a?b/../c", "a?b#c", "a;b", ".a", "a..b"])
def test_addresses(base, href):
    assert extract.address(base, href)[0] == urljoin(base, href)


def test_a_pack_is_not_copied_for_each_page(spark, tmp_path):
    """40,000 pages of a pack of 8 MB: a copy of the pack for each would be 320 GB."""
    raw = spark.range(40_000).select(F.col("id").cast("string").alias("page"), F.lpad(F.lit(""), 200, "x").cast("binary").alias("content")).coalesce(1)
    files.pack_pages(raw, f"file://{tmp_path}/p")
    began = time.monotonic()
    got = files.packed_contents(spark, f"file://{tmp_path}/p").agg(F.countDistinct("page"), F.sum(F.octet_length("content"))).first()
    assert tuple(got) == (40_000, 8_000_000) and time.monotonic() - began < 30


def test_pages_of_a_folder_are_read_once(spark, tmp_path):
    """Ranges are found in written records, not by reading the pages again."""
    looked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        looked.add(1)
        return x

    pages = spark.range(500).select(F.concat(F.col("id").cast("string"), F.lit(".html")).alias("page"), counted(F.lit("<html>")).alias("html"))
    assert extract.records_of_folder(pages, "https://x.test/").count() == 500 and looked.value == 500


def test_packs_are_compressed(spark, tmp_path):
    """pages that are alike take a small part of their bytes on disk, in blocks that are unpacked one by one."""
    raw = spark.range(20_000).select(F.concat(F.col("id").cast("string"), F.lit(".html")).alias("page"), F.concat(F.lit("<table><tr><td>" * 40), F.col("id").cast("string")).cast("binary").alias("content")).repartition(2)
    files.pack_pages(raw, f"file://{tmp_path}/p")
    assert sum(map(os.path.getsize, glob.glob(f"{tmp_path}/p/part-*"))) < 1_000_000  # of 12 MB
    got = files.packed_contents(spark, f"file://{tmp_path}/p")
    assert got.count() == 20_000 and got.exceptAll(raw).isEmpty()


def test_large_and_empty_pages_in_blocks(spark, tmp_path):
    """A page larger than a block, empty ones around it, and more pages than a block may have."""
    rows = [("a", b""), ("big", b"ab" * files.BATCH_BYTES), ("b", b""), *[(f"n{i}", b"") for i in range(files.BATCH_ROWS + 5)], ("c", b"c")]
    files.pack_pages(spark.createDataFrame(rows, "page string, content binary").coalesce(1), f"file://{tmp_path}/p")
    got = {r["page"]: bytes(r["content"]) for r in files.packed_contents(spark, f"file://{tmp_path}/p").collect()}
    assert got == dict(rows)


def test_who_read_the_pages_is_told(spark):
    """pages are dropped as soon as their records are written, before these are moved."""
    pages = spark.createDataFrame([("1.html", "<html>")], "page string, html string")
    told = []
    assert extract.records_of_folder(pages, "https://x.test/", lambda: told.append("folder")).count() == 1
    extract.build_records(pages, pages, "https://x.test/", lambda: told.append("records"))
    assert told == ["folder", "records"]
