"""Centroid clusters, periodic runs and disclosing terms: against brute force and on odd input."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog_loom.llm import centroids, disclosure, entry, periodic

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, term string, runs int"
ODD = [
    (1, None, None, None, None, 1, "x", 1), (2, "", "en", "", 0, 2, "x", 2), (3, " \t\n", "en", "s", 3, 3, "x", 3), (4, "a a a a a a", None, "s", 4, None, None, None), (5, "one two", "en", "s", 7, 5, "x", 5),
    (5, "one two", "en", "s", 7, 5, "x", 5), (None, "one two", "en", "s", 7, 5, "x", 5), (6, "the cat sat on the mat " * 4000, "en", "t", 9, 6, "x", 6), (7, "Ünïcode é́ 日本 " * 5 + "y", "fr", "t", 1, 8, "x", 8),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def naive_nearest(vectors, centers):
    d = ((vectors[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2)
    number = d.argmin(axis=1)
    return number, d[np.arange(len(d)), number]


@pytest.mark.parametrize("k", [1, 2, 5, 16, 300])
def test_vantage_tree(k):
    rng = np.random.default_rng(k)
    for spread in (2, 40, 1 << 26):
        centers = rng.integers(-spread, spread, (k, 3))
        vectors = np.concatenate([rng.integers(-spread, spread, (400, 3)), centers])
        number, distance, taken = centroids.VantageTree(centers).nearest(vectors)
        want = naive_nearest(vectors, centers)
        assert (number == want[0]).all() and (distance == want[1]).all()
        if k == 300:
            assert taken < 0.5 * k * len(vectors)


VECTORS = "vec_id long, embedding array<float>, cluster int, v string"


def test_clusters_against_loops(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4)], 1, "x") for i in range(300)]
    rows += rows[:40] + [(None, [0.5] * 4, 1, "x"), (900, None, 1, "x"), (901, [1.0] * 3, 1, "x"), (902, [1.0, None, 1.0, 1.0], 1, "x"), (903, [1.0, float("nan"), 1.0, 1.0], 1, "x"),
                         (904, [1.0, float("inf"), 1.0, 1.0], 1, "x"), (905, [3e38] * 4, 1, "x"), (906, [], 1, "x")]
    found, centers = centroids.clusters(spark.createDataFrame(rows, VECTORS).repartition(5), k=6, rounds=2, dim=4)
    usable = [(r[0], [int(np.floor(64 * x)) for x in r[1]]) for r in rows if r[1] and len(r[1]) == 4 and all(x is not None and np.isfinite(x) and x < 1e30 for x in r[1])]
    order = sorted(usable, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    own, all_ = np.array([r[1] for r in order[:6]]), np.array([r[1] for r in usable])
    for _ in range(2):
        number, _ = naive_nearest(all_, own)
        own = np.array([all_[number == c].sum(axis=0) // max(1, (number == c).sum()) if (number == c).any() else own[c] for c in range(6)])
    number, distance = naive_nearest(all_, own)
    assert (centers == own).all()
    want = sorted((str(u[0]), int(c), int(d)) for u, c, d in zip(usable, number, distance, strict=True))
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in found.collect()) == want


def test_few_or_no_vectors(spark):
    few = spark.createDataFrame([(1, [1.0] * 4, 1, "x"), (2, [1.0] * 4, 1, "x")], VECTORS)
    found, centers = centroids.clusters(few, k=16, dim=4)
    assert len(centers) == 2 and {tuple(r) for r in found.collect()} == {(1, 0, 0), (2, 0, 0)}
    found, centers = centroids.clusters(few.where("vec_id > 5"), k=16, dim=4)
    assert found.count() == 0 and len(centers) == 0


def naive_runs(words):
    n, out = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(6, 4 * p) and j > i:
                out.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((s, length, p) for (s, length), p in out.items())


def texts_with_runs(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        letters = "abcdefgh"[: rng.choice([1, 2, 2, 3, 8])]
        words = []
        for _ in range(rng.randrange(8)):
            words += [rng.choice(letters) for _ in range(rng.randrange(5))] * rng.choice([1, 1, 3, 4, 5, 9])
        yield words


def test_extensions():
    rng = np.random.default_rng(1)
    for size, kinds in ((50, 2), (400, 2), (400, 1), (3000, 3)):
        s = np.r_[10, rng.integers(0, kinds, size), np.tile(rng.integers(0, kinds, 7), 30), 11]
        grammar = periodic.Grammar(s)
        a, b = rng.integers(1, len(s) - 1, (2, 500))
        a, b = a[a != b], b[a != b]
        for forward in (True, False):
            got = grammar.extension(a, b, forward)
            for i, j, length in zip(a, b, got, strict=True):
                step, want = 1 if forward else -1, 0
                while 0 <= min(i, j) + step * want and max(i, j) + step * want < len(s) and s[i + step * want] == s[j + step * want]:
                    want += 1
                assert length == want


def test_runs_against_loops():
    texts = list(texts_with_runs(5, 600))
    sizes = np.array([len(t) for t in texts])
    words = np.array([ord(w) - 97 for t in texts for w in t])
    found = [[] for _ in texts]
    for t, s, length, p in zip(*periodic.runs(words, sizes), strict=True):
        found[t].append((s, length, p))
    assert found == [naive_runs(t) for t in texts]
    assert sum(map(len, found)) > 300


def test_grid_in_small_pieces(monkeypatch):
    texts = list(texts_with_runs(6, 60))
    args = np.array([ord(w) - 97 for t in texts for w in t]), np.array([len(t) for t in texts])
    whole = periodic.runs(*args)
    monkeypatch.setattr(periodic, "CANDIDATES", 7)
    assert all((a == b).all() for a, b in zip(whole, periodic.runs(*args), strict=True))


def collapse(words):
    drop = {i for s, length, p in naive_runs(words) for i in range(s + p, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def test_find_runs(spark, odd, empty):
    made = [(i, " \t".join(t), "en", "s", 1, 1, "x", 1) for i, t in enumerate(texts_with_runs(7, 80), 100)]
    rows = [r for r in ODD if r[0] != 6] + made
    got = periodic.find_runs(spark.createDataFrame(rows, DOCS)).collect()
    want = []
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        want.append((str(r[0]), len(words), tuple(naive_runs(words)), collapse(words)))
    assert sorted((str(g["doc_id"]), g["n_words"], tuple(tuple(x) for x in g["runs"]), g["collapsed"]) for g in got) == sorted(want)
    long = periodic.find_runs(odd.where("doc_id = 6")).first()
    assert [tuple(r) for r in long["runs"]] == [(0, 24000, 6)] and long["collapsed"] == "the cat sat on the mat"
    assert periodic.find_runs(empty).count() == 0


def test_tails(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    before = {r["doc_id"]: r["text"] for r in rows.collect()}
    for r in periodic.with_tails(rows).collect():
        words, h = re.findall(r"[^\x20\x09-\x0D]+", before[r["doc_id"]] or ""), zlib.crc32(str(r["doc_id"]).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            assert r["text"].split(" ") == [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        else:
            assert r["text"] == before[r["doc_id"]]


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def naive_entities(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(EMAIL, text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(IP, text) if all(int(x) <= 255 for x in m[0].split("."))]
    for place, pattern, least, most in ((2, CARD, 14, 19), (3, PHONE, 10, 15)):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c.isdigit()]
            sums = sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits)))
            if least <= len(digits) <= most and (place == 3 or sums % 10 == 0):
                out.append((m.start(), place, m.end()))
    return [(a, b, disclosure.KINDS[k]) for a, k, b in sorted(out)]


def test_entities_against_patterns(spark):
    rng = random.Random(2)
    kinds = dict.fromkeys(disclosure.KINDS[:4], 0)
    pieces = ["a", "é", "@", "@", ".", ".", "-", " ", "+", "(", ")", "1", "25", "255.", "0.0.0.0", "256", "4111 1111 1111 1111", "4111111111111111", "+1 (743) 555-3824", "x.y@mail.example.com", "b@c.d@e.f", "\n", "%", "日"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(6000)]
    texts += [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for text in texts:
        got = [(a, b, kind) for a, b, kind, _ in disclosure.entities(text)]
        assert got == naive_entities(text), text
        for _, _, kind in got:
            kinds[kind] += 1
    assert min(kinds.values()) > 20


def test_entities_of_long_texts():
    for part in ("a", "1", "1.", "a@", "@", "1-", "+1", "+1 ", "a.", "1.1.1.", "@a-"):
        disclosure.entities(part * (400_000 // len(part)))


def planted():
    """Mails of a person known by a nickname in different contexts, a passage that is merely copied, and other texts."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bcdfgklmn") + rng.choice("aeiou") for _ in range(3))
    common = [word() for _ in range(60)]
    some = lambda n: [rng.choice(common) for _ in range(n)]
    texts = []
    for _ in range(12):
        texts.append(" ".join([*some(12), "Zebulon", "wrote", "from", "zeb@mail.example.org", *some(12)]))
    passage = " ".join([*some(3), "quixotical", "mailto", "copy@mail.example.org", *some(5)])
    texts += [f"{passage} {' '.join(some(20))}" for _ in range(12)]
    texts += [" ".join([*some(5), "wrote", "from", *some(20)]) for _ in range(200)]
    return texts


def test_disclosing_terms(spark, odd, empty):
    texts = planted()
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 1, "x", 1) for i, t in enumerate(texts)], DOCS).unionByName(odd).repartition(6)
    rows = disclosure.find(docs).collect()
    assert len(rows) == len(texts) + len(ODD)
    for r in rows:
        text = texts[r["doc_id"]] if r["doc_id"] is not None and r["doc_id"] >= 10 else None
        terms = [text[s["start"] : s["end"]] for s in r["spans"] if s["kind"] == "term"] if text else []
        if text is not None:
            assert terms == (["Zebulon"] if "zeb@" in text else [])
            assert [tuple(s)[:3] for s in r["spans"] if s["kind"] != "term"] == [tuple(s) for s in r["base"]]
    shown = {r["doc_id"]: r["text"] for r in disclosure.sanitised(docs, remove=0.97).collect()}
    assert "Zebulon" not in shown[10] and "[EMAIL]" in shown[10] and shown[10].replace("[EMAIL]", "zeb@mail.example.org").split() == texts[10].replace("Zebulon", "").split()
    general = {r["doc_id"]: r["text"] for r in disclosure.sanitised(docs, remove=2.0).collect()}
    assert "[NAME] wrote from [EMAIL]" in general[10] and general[100] == texts[100]
    assert disclosure.find(empty).count() == 0 and disclosure.sanitised(empty).count() == 0


def naive_disclosing(texts):
    near, anywhere = {}, {}
    for row, text in enumerate(texts):
        terms = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[a-zA-Z0-9]+", text)]
        for _, _, t in terms:
            anywhere.setdefault(t, set()).add(row)
        found = disclosure.entities(text)
        free = [t for t in terms if not any(t[0] < b and a < t[1] for a, b, _, _ in found)]
        for a, b, _, entity in found:
            window = [t for t in free if t[1] <= a][-8:] + [t for t in free if t[0] >= b][:8]
            near.setdefault(entity, {}).setdefault(row, set()).update(t[2] for t in window)
    out = {}
    for entity, rows in near.items():
        context = {r: min((zlib.crc32(t.encode()) << 32 | zlib.adler32(t.encode()) for t in own), default=0) for r, own in rows.items()}
        for term in {t for own in rows.values() for t in own}:
            both = [r for r, own in rows.items() if term in own]
            contexts = len({context[r] for r in both})
            if contexts >= 3 and contexts * 4 >= len(both):
                n = sum(1 for t in texts if t)
                told, information = np.log2(n * len(both) / (len(rows) * len(anywhere[term]))), -np.log2(len(rows) / n)
                if told / information >= 0.9:
                    out[entity, term] = round(float(told / information), 9)
    return out


@pytest.mark.parametrize("bits", [8, 1 << 23])
def test_ratios_against_loops(spark, bits):
    texts = planted() + [f"Call {w} now at +49 170 123456{w % 3} or mail m{w % 2}@x.de {'sun moon'.split()[w % 2]}" for w in range(40)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 1, "x", 1) for i, t in enumerate(texts)], DOCS).repartition(3)
    pairs = disclosure.disclosing(docs, disclosure.found_in(docs), bits=bits)
    assert {(r["entity"], r["term"]): round(r["ratio"], 9) for r in pairs.collect()} == naive_disclosing(texts)


@pytest.mark.parametrize("name", ["op11_centroid_clusters", "op12_periodic_runs", "op13_disclosing_terms"])
def test_queries_cover_tables(spark, name):
    t = "embeddings" if name.startswith("op11") else "documents"
    assert entry.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/{t}.parquet").count()


def test_base_digest(spark):
    rows = entry.queries()["op13_disclosing_terms"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()}
    for r in rows:
        base = naive_entities(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in disclosure.KINDS[:4]] == [sum(x[2] == k for x in base) for k in disclosure.KINDS[:4]]
