"""The training-data operators: against SQL, brute force, the tokenizers library or held-out labels, and on odd input."""

from __future__ import annotations

import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog_loom.llm import ann, bpe, chatfmt, entry, jaccard, langid, mixing, quality, samples, shared, topk, toxicity, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, size int"
ODD = [
    (1, None, None, None, None, "x", 1), (2, "", "en", "", 0, "x", 2), (3, " \t\n", "en", "s", 3, "x", 3), (4, "42 !!", None, "s", 4, None, None), (5, "one two", "en", "s", 7, "x", 5),
    (5, "one two", "en", "s", 7, "x", 5), (None, "one two", "en", "s", 7, "x", 5), (6, "the cat sat on the mat " * 4000, "en", "t", 9, "x", 6), (7, "die Katze saß auf der Matte " * 30, "de", "t", 9, "x", 7),
    (8, "Ünïcode ’s <|endoftext|> é́ 日本 ٣", "fr", "t", 1, "x", 8), (9, "you idiot clown " * 5, "en", "t", 1, "x", 9),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 10)] + [(5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def shown(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(entry.oracle_sql()[name])
    have = [c[0] for c in cursor.description]
    want = sorted(tuple(shown(r[have.index(c)]) for c in columns) for r in cursor.fetchall())
    assert sorted(tuple(shown(v) for v in r) for r in df.select(columns).collect()) == want


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_components(rows):
    sets, above = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                above[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if sets[i] and d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted((str(d), len(s), str(least.get(top(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def near_copies(seed):
    rng = random.Random(seed)
    make = lambda n: [rng.choice("abcdefghij") + str(rng.randint(0, 400)) for _ in range(n)]
    shared_part, docs = make(60), ["", None, " ", "one", "One", "one two", "a b c d e", "a b c d e"]
    for _ in range(8):
        text = make(rng.choice([8, 30, 80, 300]))
        for _ in range(rng.choice([1, 2, 40])):
            copy = list(text)
            for _ in range(rng.randint(0, max(1, len(copy) // 40))):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 9999)}"
            docs.append(" ".join(shared_part[: rng.randint(5, 60)] * (rng.random() < 0.3) + copy))
    rng.shuffle(docs)
    return [(3 * i + 1, d) for i, d in enumerate(docs)] + [(1, docs[0]), (None, docs[5])]


@pytest.mark.parametrize("few", [64, 3])
def test_jaccard_against_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(jaccard, "FEW", few)
    rows = near_copies(few)
    got = jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute_components(rows)


def test_jaccard_odd(odd, empty):
    assert jaccard.joined(odd).count() == len(ODD)
    assert jaccard.joined(empty).count() == 0
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "6", "7", "8", "9"])


def brute_survivors(rows):
    """Of each component the smallest doc_id, which stays (None if there is none); and rows without words."""
    sets, above = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                above[top(i)] = top(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        if sets[i]:
            groups.setdefault(top(i), []).append(d)
    bare = sorted(str(d) for i, (d, _) in enumerate(rows) if not sets[i])
    want = [str(min((x for x in g if x is not None), default=None)) for g in groups.values()]
    return sorted(want + bare), [{i for i in range(len(rows)) if sets[i] and top(i) == r} for r in groups]


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(9)
    make = lambda: [rng.choice("abcdefgh") + str(rng.randint(0, 999)) for _ in range(60)]
    near = lambda words: " ".join([*words[:-1], f"x{rng.randint(0, 9999)}"])
    a, b, c, d = make(), make(), make(), make()
    rows = [(5, " ".join(a)), (5, " ".join(b)), (1, near(b)), (7, near(a)), (None, near(c)), (None, near(c)), (None, near(c)), (None, near(a))]
    rows += [(9, " ".join(d)), (9, near(d)), (9, " ".join(d)), (9, " ".join(make())), (9, ""), (9, ""), (3, None), (None, " ")]
    docs = spark.createDataFrame([(i, t, n % 2) for n, (i, t) in enumerate(rows)], "doc_id long, text string, size int").repartition(3)
    got = jaccard.keep_one(docs).collect()
    want, groups = brute_survivors(rows)
    assert sorted(str(r["doc_id"]) for r in got) == want
    left = {(r["doc_id"], r["text"]) for r in got}
    assert all(len(left & {rows[i] for i in g}) == 1 for g in groups)
    assert sorted(map(str, got)) == sorted(map(str, jaccard.keep_one(docs.repartition(2)).collect()))


def test_bpe_against_library():
    tokenizers = pytest.importorskip("tokenizers")
    library, ours = tokenizers.Tokenizer.from_file(bpe.default_path()), bpe.loaded(bpe.packed())
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz" * 3 + "ABCÉéßΣσςİ'\"!?.,<|>/ \n\t\x0b\x85\xa0​̧é日本語한국어💥019²½٣"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["", None, "<|endoftext|>", "a<|startoftext|>b<|endoftext|>", "<|endoftext|", "!" * 3000, "aaaa" * 2000, "it's I'LL they've", "the" * 40]
    ids, offsets = ours.encode(texts)
    shown_texts = ours.decode(ids, offsets)
    for i, e in enumerate(library.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == e.ids
        assert shown_texts[i].decode() == library.decode(e.ids, skip_special_tokens=False)


def test_classes_that_share_an_id():
    """Sets whose ids were found to clash take the other half of their hash; all else stays."""
    rng = np.random.default_rng(0)
    h, at = np.sort(rng.integers(0, 1 << 63, 30, dtype=np.uint64)), np.array([0, 4, 4, 9, 20, 30])
    ids, more = jaccard.classes(h, at, np.zeros(0, np.int64))
    moved, _ = jaccard.classes(h, at, np.sort(ids[[2, 4]]))
    assert moved.tolist() == [ids[0], 0, more[2], ids[3], more[4]] and len(set(ids.tolist()) | set(more.tolist())) == 9


def test_jaccard_with_hot_keys(spark, monkeypatch):
    """With a bound of a few hot keys, both ways of joining are taken."""
    monkeypatch.setattr(shared, "HOT_KEYS", 40)
    monkeypatch.setattr(jaccard, "FEW", 3)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 3)
    rows = near_copies(5) + [(1000 + i, "the same text in very many rows of the table") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard.joined(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute_components(rows)
    assert sorted(str(r["doc_id"]) for r in jaccard.keep_one(docs).collect()) == brute_survivors(rows)[0]


def test_bpe_refuses_other_rules():
    import json
    import zlib

    spec = json.loads(zlib.decompress(bpe.packed()))
    spec["normalizer"]["normalizers"].pop()
    with pytest.raises(ValueError, match="other rules"):
        bpe.Vocabulary(json.dumps(spec))


def test_bpe_forgets(monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_KEPT", 3)
    vocabulary = bpe.Vocabulary(__import__("zlib").decompress(bpe.packed()).decode())
    texts = ["one two three four <|endoftext|>", "five one <|endoftext|> six", "two", "seven eight one"]
    apart = [vocabulary.encode([t])[0].tolist() for t in texts]
    ids, offsets = vocabulary.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == apart


def test_bpe_odd(odd, empty):
    assert bpe.digests(odd).count() == len(ODD) and bpe.digests(empty).count() == 0
    encoded = bpe.encode(odd)
    assert encoded.where("doc_id = 1").first()["ids"] == []
    assert bpe.decode(encoded).where("doc_id = 5").first()["text"] == "one</w> two</w>"


def test_mixing(spark):
    docs = shared.table(spark, SF, "documents")
    rows = mixing.mix_sources(docs).toPandas()
    by = rows.groupby("skey").agg(size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by["source_size"]).all() and (abs(by["taken"] - by["target"]) <= 1).all()
    assert (rows["taken"] <= 2 * rows["size"]).all() and (rows["taken"] >= 0).all()
    assert abs(by["target"].sum() - 1.5 * rows["size"].sum()) < 1e-6 * rows["size"].sum()
    again = mixing.mix_sources(docs.repartition(5)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(tuple, rows[key].to_numpy().tolist())) == sorted(map(tuple, again[key].to_numpy().tolist()))


def naive_rates(sizes, target):
    """The rates of least relative entropy to one copy each, between 0 and 2, whose words are target: by bisection."""
    mean = sum(sizes) / max(1, sum(s > 0 for s in sizes))
    low, high = -60.0, 60.0
    for _ in range(200):
        theta = (low + high) / 2
        got = sum(s * min(2.0, np.exp(min(700, theta * s / mean))) for s in sizes)
        low, high = (theta, high) if got < target else (low, theta)
    return [min(2.0, float(np.exp(theta * s / mean))) for s in sizes]


@pytest.mark.parametrize("hot", [50_000, 2])
def test_mixing_against_naive(spark, monkeypatch, hot):
    """Rates are the entropy optimum, and rounding gives or takes less than a copy, but for the words that the source still misses."""
    monkeypatch.setattr(shared, "HOT_KEYS", hot)
    monkeypatch.setattr(mixing, "SALT_ROWS", 16)
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * int(rng.lognormvariate(3, 1))), rng.choice(["a", "a", "a", "b", "b", "c", None, "d"])) for i in range(400)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).toPandas()
    assert len(got) == 400
    for _, own in got.groupby("skey"):
        target, sizes = own["target"].iloc[0], own["size"].tolist()
        if 0 < target < 2 * sum(sizes):
            assert np.allclose(own["rate"], [r if s else 0 for r, s in zip(naive_rates(sizes, target), sizes, strict=True)], atol=1e-5)
        assert abs(own["taken"].sum() - target) <= 1
        whole = own["rate"].clip(0, 2)
        least, most = np.floor(whole) * own["size"], np.ceil(whole) * own["size"]
        assert (np.maximum(0, least - own["taken"]) + np.maximum(0, own["taken"] - most)).sum() <= 2 * own["size"].max()


def test_mixing_targets(spark):
    """The excess of full sources is shared again by weight."""
    sources = spark.createDataFrame([("0a", 10, 1), ("0b", 1000, 1), ("0c", 1000, 1)], "skey string, source_size long, n_docs long")
    got = {r["skey"]: r["target"] for r in mixing.with_targets(sources).collect()}
    rest = 1.5 * 2010 - 20
    assert got["0a"] == 20 and abs(got["0b"] - rest / 3) < 1e-6 and abs(got["0c"] - 2 * rest / 3) < 1e-6


def test_mixing_odd(odd, empty):
    rows = mixing.mix_sources(odd).collect()
    assert len(rows) == len(ODD) and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    assert sum(mixing_words(r["text"]) for r in mixed.collect()) == sum(r["taken"] for r in rows)
    assert mixing.mix_sources(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def mixing_words(text):
    return len(re.findall(r"[^\x20\x09-\x0d]+", text))


def test_warc_odd(spark):
    long = "<p>é" * 600
    rows = [(1, "http://a/ b\r\n", long, "z"), (2, None, long, "z"), (3, "http://c", None, "z"), (4, "http://d", "short", "z"), (5, "http://e", "short", "z"), (None, "http://f", long, "z"), (2, None, long, "z"), (6, "u", "WARC/1.1\r\n\r\n" + long, "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")
    path = shared.fresh_path(spark, "warc")
    warc.write_archive(df, path)
    got = warc.resolve_revisits(warc.read_archive(spark, path)).collect()
    assert len(got) == len(rows) and all(r["intact"] for r in got)
    kinds = [(str(r["page_id"]), r["record_type"], r["refers_to"]) for r in got]
    want = [("1", "revisit", 2), ("2", "response", None), ("2", "response", None), ("3", "response", None), ("4", "response", None), ("5", "response", None), ("None", "revisit", 2), ("6", "response", None)]
    assert sorted(map(str, kinds)) == sorted(map(str, want))
    assert all(r["payload_bytes"] == len(long.encode()) for r in got if r["page_id"] in (1, 2))
    path = shared.fresh_path(spark, "warc")
    warc.write_archive(df.limit(0), path)
    assert warc.resolve_revisits(warc.read_archive(spark, path)).count() == 0


def test_warc_repeated_ids_and_hot_payloads(spark, monkeypatch):
    """A page id with two payloads is two records; the payload's size comes from its own original. With few keys allowed to
    be hot, payloads also go by shuffle."""
    a, b = "<p>é" * 400 + "a" * 0, "b" * 1500
    a = a + "x" * (2000 - len(a.encode()))
    rows = [(5, "u", a), (5, "u", b), (3, "u", a)] + [(100 + i, "v", "c" * 1200) for i in range(50)] + [(200 + i, "w", "") for i in range(40)] + [(None, "n", "d" * 1100)] * 3
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    seen = []
    for hot in (50_000, 3):
        monkeypatch.setattr(shared, "HOT_KEYS", hot)
        path = shared.fresh_path(spark, "warc")
        warc.write_archive(df, path)
        got = warc.read_archive(spark, path)
        assert got.where("page_id = 5").select("record_id").distinct().count() == 2
        seen.append(sorted(map(str, warc.resolve_revisits(got).collect())))
        rows_of_3 = [r for r in warc.resolve_revisits(got).where("page_id = 3").collect()]
        assert [(r["payload_bytes"], r["record_type"], r["refers_to"]) for r in rows_of_3] == [(2000, "revisit", 5)]
        assert warc.resolve_revisits(got).where("record_type = 'revisit' and refers_to = 149").count() == 49
    assert seen[0] == seen[1] and len(seen[0]) == len(rows)


def test_warc_pieces(monkeypatch):
    """Records longer than a piece, several gzip members, and a torn file."""
    import gzip

    monkeypatch.setattr(warc, "PIECE", 7)
    make = lambda i, body: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <{i}>\r\nWARC-Payload-Digest: sha1:x\r\nContent-Length: {len(body) + 4}\r\n\r\n\r\n\r\n{body}\r\n\r\n".encode()
    data = gzip.compress(make(1, "a" * 100) + make(2, "\r\n\r\nWARC/1.1")) + gzip.compress(make(3, ""))
    assert [(r[2], r[6]) for r in warc._records(data)] == [("<1>", 100), ("<2>", 12), ("<3>", 0)]
    with pytest.raises(ValueError, match="not a WARC"):
        list(warc._records(gzip.compress(make(1, "a") + b"WARC/1.1\r\nWARC-")))


def test_chat_long_and_large_ids(spark):
    """A long conversation, and ids above 2 ** 53."""
    turn = lambda i: ("user" if i % 2 == 0 else "assistant", f"t{i}")
    rows = [(2**53 + 4 + side, i, *(turn(i) if i < 1500 or side == 0 else ("user", "other"))) for side in (0, 1) for i in range(2000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    path = shared.fresh_path(spark, "chat")
    df.write.parquet(f"{path}/conversations.parquet")
    got = chatfmt.op10(spark, path).collect()
    assert len(got) == 1 and got[0]["pair_id"] == 2**52 + 2 and got[0]["prompt_turns"] == 1500
    line = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    assert got[0]["prompt"] == "".join(line(*turn(i)) for i in range(1500))
    assert got[0]["chosen"] == "".join(line(*turn(i)) for i in range(1500, 2000)) and got[0]["rejected"] == line("user", "other") * 500
    spans = [tuple(map(int, x.split("-"))) for x in got[0]["chosen_loss"].split(",")]
    assert [got[0]["chosen"][a:b] for a, b in spans] == [f"t{i}" for i in range(1501, 2000, 2)]


def test_chat(spark):
    rows = [(0, True, 0, "user", "hi"), (0, True, 1, "assistant", "good"), (0, False, 0, "user", "hi"), (0, False, 1, "assistant", "bad"), (1, True, 0, None, None), (2, True, 0, "user", "a"), (2, False, 0, "user", "a"), (2, False, 1, "assistant", "b")]
    df = spark.createDataFrame(rows, "pair_id long, chosen boolean, turn long, role string, text string").withColumn("prompt", F.lit("clash"))
    got = {r["pair_id"]: r for r in chatfmt.format_preferences(df).collect()}
    assert got[0]["prompt"] == "<|user|>\nhi<|end|>\n" and got[0]["chosen"] == "<|assistant|>\ngood<|end|>\n" and got[0]["prompt_turns"] == 1
    start, end = map(int, got[0]["rejected_loss"].split("-"))
    assert got[0]["rejected"][start:end] == "bad"
    assert got[1]["prompt"] == "" and got[1]["rejected"] == "" and got[2]["chosen"] == "" and got[2]["rejected_loss"] == "14-15"
    assert chatfmt.format_preferences(df.limit(0)).count() == 0


def vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(100)] + [(200 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(40)]
    rows += [(300, None), (301, [None, 1.0, 1.0, 1.0]), (302, [float("nan")] * 4), (303, [float("inf")] * 4), (304, [0.0] * 4), (None, [1.0] * 4), (20, rows[20][1])]
    return spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<float>, score int"), rows


def brute_neighbours(rows, scale, zero):
    kept = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))]
    if scale:
        kept = [(i, np.floor(scale * v)) for i, v in kept]
    out = {}
    for q, v in kept:
        if q % 20 == 0:
            out[q] = sorted((-float(v @ w), i) for i, w in kept if i != q)[:20]
    return out


def mixed_vectors(spark):
    """Three lengths, queries of each, a repeated id in two lengths, and large components."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(1200)] + [(2000 + i, rng.normal(size=2).tolist()) for i in range(45)] + [(3000 + i, [float(i)]) for i in range(3)]
    return spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<double>, score int"), rows


def brute_of_lengths(rows, scale):
    out = {}
    for n in {len(v) for _, v in rows}:
        out |= brute_neighbours([r for r in rows if len(r[1]) == n], scale, scale is not None)
    return {q: found for q, found in out.items() if found}


def test_searches_of_several_lengths(spark):
    df, rows = mixed_vectors(spark)
    for got, want in ((topk.top_k(df), brute_of_lengths(rows, 64)), (ann.near_neighbours(df), brute_of_lengths([r for r in rows if any(r[1])], None))):
        have = {}
        for r in got.orderBy("query_id", "rank").collect():
            have.setdefault(r["query_id"], []).append((-float(r["score"]), r["vec_id"]))
        assert set(have) == set(want) and all(len(have[q]) == len(want[q]) for q in want)
        pairs = {(q, i) for q in want for _, i in want[q]}
        assert len(pairs & {(q, i) for q in have for _, i in have[q]}) >= (1 if got.schema["score"].dataType.simpleString() == "bigint" else 0.9) * len(pairs)
        assert [i for _, i in have[2000]] == [i for _, i in want[2000]] and np.allclose([s for s, _ in have[2000]], [s for s, _ in want[2000]])


def test_top_k_of_large_products(spark):
    """Products beyond 2 ** 52 are still whole numbers."""
    rng = random.Random(2)
    rows = [(i, [rng.randint(-(10**6), 10**6) + 0.5 for _ in range(40)]) for i in range(60)]
    whole = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows}
    want = {q: sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:20] for q in whole if q % 20 == 0}
    assert max(abs(s) for x in want.values() for s, _ in x) > 2**52
    got = {}
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    assert got == want


def test_top_k_prunes(spark):
    """Far clusters are not searched: a query is sent to fewer clusters than there are."""
    rng = np.random.default_rng(1)
    heads = rng.normal(size=(12, 6)) * 40
    rows = [(i, (heads[i % 12] + rng.normal(size=6)).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", F.lit(6).alias("dim"), F.col("embedding").alias("v"))
    found = {6: heads}
    base = topk.clustered(df, found).toPandas()
    radii = {6: np.array([base.loc[base["cluster"] == c, "far"].max() for c in range(12)])}
    points = np.stack(base["v"])
    floor = {int(i): float(np.sort(points @ v)[-20]) for i, v in zip(base["vec_id"], points, strict=True)}
    asked = spark.createDataFrame([(i, 6, v, floor[i]) for i, v in rows if i % 20 == 0], "vec_id long, dim int, v array<double>, floor double")
    sent = topk.aimed(asked, found, radii, False).toPandas()
    assert len(sent) < 0.5 * 12 * 30
    cluster = dict(zip(base["vec_id"], base["cluster"], strict=True))
    for i, v in rows:
        if i % 20 == 0:
            near = base["vec_id"][(points @ np.array(v)) >= floor[i]]
            assert {cluster[x] for x in near} <= set(sent.loc[sent["vec_id"] == i, "cluster"])


def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CLUSTER_ROWS", 20)
    monkeypatch.setattr(topk, "block_rows", lambda dim: 50)
    monkeypatch.setattr(topk, "LEAF_ROWS", 8)
    df, rows = vectors(spark)
    got = {}
    for r in topk.top_k(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-float(r["score"]), r["vec_id"]))
    assert got == brute_neighbours(rows, 64, True)
    assert topk.top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [16384, 40])
def test_neighbours(spark, monkeypatch, size):
    monkeypatch.setattr(ann, "block_rows", lambda dim: size)
    monkeypatch.setattr(ann, "LEAST_INDEXED", 100)
    df, rows = vectors(spark)
    want = brute_neighbours(rows, None, False)
    hit = total = 0
    for q in {r["query_id"]: 0 for r in ann.near_neighbours(df).select("query_id").distinct().collect()}:
        total += len(want[q])
    got = ann.near_neighbours(df).collect()
    for r in got:
        hit += any(i == r["vec_id"] and abs(-s - r["score"]) < 1e-9 for s, i in want[r["query_id"]])
    assert hit >= 0.9 * total and len(got) == total
    assert ann.near_neighbours(df.limit(0)).count() == 0


def test_recall(spark):
    e = shared.table(spark, "/root/testdata/sf0.01", "embeddings").toPandas()
    want = brute_neighbours(list(zip(e["vec_id"], e["embedding"], strict=True)), None, False)
    got = {(r["query_id"], r["vec_id"]) for r in ann.op9(spark, "/root/testdata/sf0.01").collect()}
    pairs = {(q, i) for q, rows in want.items() for _, i in rows}
    assert len(pairs & got) >= 0.9 * len(pairs)


def test_classifiers_held_out(spark):
    sf = "/root/testdata/sf0.01"
    known = shared.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    good = quality.op3(spark, sf).where("held_out").join(known, F.col("doc_id") == F.col("id")).toPandas()
    assert good.loc[good["quality"] == 1, "score"].median() > 0.7 > good.loc[good["quality"] == 0, "score"].median()
    toxic = toxicity.op1(spark, sf).where("held_out").join(known, F.col("doc_id") == F.col("id")).toPandas()
    assert toxic.loc[toxic["toxic"] == 1, "score"].mean() > 5 * toxic.loc[toxic["toxic"] == 0, "score"].mean()
    lang = langid.op4(spark, sf).where("held_out").join(shared.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang"), F.col("doc_id") == F.col("id")).toPandas()
    assert (lang["lang"] == lang["lang_pred"]).mean() > 0.95


def test_field_against_enumeration():
    """Marginals and gradient of short chains, from all their labelings."""
    rng = np.random.default_rng(3)
    field = toxicity.Field(2)
    field.weight = rng.normal(size=len(field.weight)).astype(np.float32)
    field.bias, field.log_step = -0.3, rng.normal(size=(2, 2))
    lengths = [1, 2, 5, 7]
    n = sum(lengths)
    buckets = np.stack([rng.integers(0, 1 << toxicity.BITS, n), rng.integers(1 << toxicity.BITS, 2 << toxicity.BITS, n)]).astype(np.int32)
    y = rng.integers(0, 2, n).astype(np.int8)
    first, last = toxicity.edges(np.array(lengths))

    def scored(at, size, labels):
        own = sum(float(field.weight[buckets[:, at + i]].sum(dtype=np.float64) + field.bias) for i in range(size) if labels[i])
        return own + sum(field.log_step[labels[i], labels[i + 1]] for i in range(size - 1))

    def chains():
        for at, size in zip(np.cumsum(lengths) - lengths, lengths, strict=True):
            every = [[k >> i & 1 for i in range(size)] for k in range(1 << size)]
            yield at, size, every, np.array([scored(at, size, x) for x in every])

    def likelihood():
        return sum(scored(at, size, y[at : at + size]) - np.log(np.exp(s).sum()) for at, size, _, s in chains())

    want = np.concatenate([(np.exp(s) / np.exp(s).sum()) @ np.array(every) for _, _, every, s in chains()])
    forward, backward = field.messages(field.odds(buckets), first, last)
    assert np.allclose(forward * backward / (1 + forward * backward), want, atol=1e-9)
    of_weight, rest = field.gradient(buckets, first, last, y)
    step = 1e-5
    for i, change in enumerate([("bias", None), *(("step", (a, b)) for a in (0, 1) for b in (0, 1))]):
        values = []
        for sign in (1, -1):
            if change[0] == "bias":
                field.bias += sign * step
            else:
                field.log_step[change[1]] += sign * step
            values.append(likelihood())
            if change[0] == "bias":
                field.bias -= sign * step
            else:
                field.log_step[change[1]] -= sign * step
        assert abs((values[0] - values[1]) / (2 * step) - rest[i]) < 1e-5
    assert np.isclose(of_weight[buckets[0, 0]], (y - want)[buckets[0] == buckets[0, 0]].sum())


def test_spans_are_characters(spark):
    """Offsets count characters, also behind letters of several bytes and over a slice of texts."""
    scorer = toxicity.Scorer(0.1)
    word = np.frombuffer("schurkengeruch".encode(), np.uint8)
    buckets = toxicity.tokens(word, np.array([0, len(word)]))[0][:, 0]
    scorer.field.weight[buckets[0]] = 20.0
    long = "größe 日本 é ünïcode " * 60_000
    texts = ["Ärger: Schurkengeruch, größer SCHURKENGERUCH!", "nichts", long + "schurkengeruch", "💥 schurkengeruch", None]
    got = toxicity.toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), scorer).orderBy("doc_id").collect()
    want = [["Schurkengeruch", "SCHURKENGERUCH"], [], ["schurkengeruch"], ["schurkengeruch"], []]
    assert [[(t or "")[s["start"] : s["end"]] for s in r["spans"]] for t, r in zip(texts, got, strict=True)] == want


def test_quality_against_naive():
    """The score of a bag by loops over its passages, and the gradient that the fit follows against differences."""
    rng = np.random.default_rng(2)
    model = quality.Model(0.5)
    model.constant = None
    w = {k: v.astype(np.float64) for k, v in model.w.items()}
    text = " ".join("".join(rng.choice(list("abcdefghij ")) for _ in range(9)) for _ in range(300)).encode()
    texts = [text, b"", text[:700], b"word " * 10]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    at = np.r_[0, np.cumsum([len(t) for t in texts])]
    x, row = quality.passages(raw, at)
    assert np.bincount(row).tolist() == [max(1, -(-len(t) // quality.PASSAGE)) for t in texts]
    for i, t in enumerate(texts):
        for j, own in enumerate(x[row == i]):
            part = t[j * quality.PASSAGE : (j + 1) * quality.PASSAGE]
            for b in range(256):
                assert abs(own[b] - np.sqrt(part.count(bytes([b])) / max(1, len(part)))) < 1e-6
    sigma = lambda z: 1 / (1 + np.exp(-z))
    for i, score in enumerate(model.score(raw, at)):
        encoded, weights = [], []
        for own in x[row == i].astype(np.float64):
            h = np.tanh(own @ w["e"] + w["eb"])
            encoded.append(h)
            weights.append(np.exp((np.tanh(h @ w["v"]) * sigma(h @ w["u"])) @ w["a"]))
        z = sum(a * h for a, h in zip(weights, encoded, strict=True)) / sum(weights)
        assert abs(score - sigma(z @ w["c"] + w["cb"][0])) < 1e-5
    y, weight = np.array([1.0, 0.0, 1.0, 0.0]), np.array([1.0, 2.0, 3.0, 1.0])
    model.w = w

    def loss():
        s = model.forward(x, row)[-1]
        return -(weight * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum() / weight.sum()

    grad = model.gradient(x, row, y, weight)
    for name, place in (("e", (97, 3)), ("eb", (2,)), ("v", (1, 2)), ("u", (3, 4)), ("a", (5,)), ("c", (6,)), ("cb", (0,))):
        step = 1e-5
        w[name][place] += step
        up = loss()
        w[name][place] -= 2 * step
        slope = (up - loss()) / (2 * step)
        w[name][place] += step
        assert abs(slope - grad[name][place]) < 1e-5, name


def test_languages_against_naive():
    """Pooled probabilities by a loop over bytes, over several windows and texts of several sizes."""
    labeller = langid.Labeller(["aa", "bb", "cc"])
    net = labeller.network
    texts = ["Größe ABC " * 70, "x", "", "kurz und gut", "日本語" * 100]
    data = [t.encode() for t in texts]
    at = np.r_[0, np.cumsum([len(d) for d in data])]
    got = labeller.pooled(np.frombuffer(b"".join(data), np.uint8), at)
    w, h = {k: v.astype(np.float64) for k, v in net.w.items()}, net.hidden
    gate = lambda z: (1 + np.tanh(z)) / 2

    def states(codes, way):
        out, state = [], np.zeros(h)
        for c in codes:
            byte, inner = w["table"][c + 256 * way], state @ w["inner"][way]
            update, reset = gate(byte[:h] + inner[:h]), gate(byte[h : 2 * h] + inner[h : 2 * h])
            candidate = np.tanh(byte[2 * h :] + reset * inner[2 * h :])
            state = candidate + update * (state - candidate)
            out.append(state)
        return out

    for i, t in enumerate(texts):
        low = t.lower().encode()
        total = np.zeros(3)
        for start in range(0, len(low), langid.WINDOW):
            part = low[start : start + langid.WINDOW]
            for a, b in zip(states(part, 0), states(part[::-1], 1)[::-1], strict=True):
                z = np.exp(a @ w["outer"][0] + b @ w["outer"][1] + w["bias"])
                total += z / z.sum()
        assert np.allclose(got[i], total / max(1, len(low)), atol=1e-4)


def test_messages_are_exact():
    """Strips that start early give the same messages as one run over the whole chain."""
    rng = np.random.default_rng(1)
    e, first = np.exp(rng.normal(size=900)), rng.random(900) < 0.02
    first[0] = True
    last = np.r_[first[1:], True]
    field = toxicity.Field(1)
    field.log_step = np.array([[0.5, -0.5], [-0.3, 1.5]])
    a, b = field.messages(e, first, last, strip=64)
    c, d = field.messages(e, first, last, strip=2000)
    assert np.allclose(a, c, rtol=1e-9) and np.allclose(b, d, rtol=1e-9)


def test_gradient_through_time():
    net = langid.Network(3, hidden=4)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(0)
    data, live, y = rng.integers(0, 256, (6, 5)), np.ones((6, 5)), rng.integers(0, 3, 5)
    live[4:, 0] = 0

    def loss():
        p = net.probabilities(net.states(data, live).astype(np.float64))
        return float(-(np.log(p[:, np.arange(5), y]) * live).sum() / live.sum())

    grad = net.gradient(data, live, y)
    for name, at in (("inner", (0, 1, 2)), ("inner", (1, 2, 9)), ("outer", (1, 0, 1)), ("table", (int(data[1, 1]), 3)), ("bias", (0,))):
        step = 1e-3
        net.w[name][at] += step
        up = loss()
        net.w[name][at] -= 2 * step
        slope = (up - loss()) / (2 * step)
        net.w[name][at] += step
        assert abs(slope - grad[name][at]) < 2e-4


def test_classifiers_odd(odd, empty, labels):
    for docs, n in ((odd, len(ODD)), (empty, 0)):
        scorer, model, labeller = toxicity.learn(docs, labels), quality.learn(docs, labels), langid.learn(docs)
        a, b, c = toxicity.toxicity(docs, scorer).collect(), quality.quality(docs, model).collect(), langid.languages(docs, labeller).collect()
        assert len(a) == len(b) == len(c) == n
        assert all(0 <= r["score"] <= 1 for r in [*a, *b, *c])
        assert all(r["lang_pred"] == "und" for r in c if r["doc_id"] in (1, 2, 3, 4))
        assert toxicity.keep_clean(docs, scorer).columns == langid.keep_identified(docs, labeller).columns == docs.columns
        toxicity.keep_clean(docs, scorer).count()
        langid.keep_identified(docs, labeller).count()
    none = labels.limit(0)
    assert all(r["score"] < 0.01 for r in toxicity.toxicity(odd, toxicity.learn(odd, none)).collect())


def test_late_spans_are_learned(spark, monkeypatch):
    """Toxic words and good passages far behind the start of a text are seen by the fits, also in several runs."""
    monkeypatch.setattr(toxicity, "RUN_TOKENS", 50_000)
    rng = random.Random(5)
    make = lambda n: [rng.choice("bcdfgh") + rng.choice("aeiou") + rng.choice("lmnrst") + rng.choice("aeiou") for _ in range(n)]
    rows = []
    for i in range(1, 121):
        words = make(3000)
        if i % 3 == 0:
            for at in rng.sample(range(2700, 3000), 8):
                words[at] = "wretchedness"
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    assert max(map(len, samples.labelled(docs, labels, "toxic", 5, 0, (9, 9))[0].to_pylist())) == max(len(t) for _, t, _ in rows)
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, toxicity.learn(docs, labels)).collect()}
    assert all(got[i]["predicted"] == y for i, _, y in rows)
    assert all({t[s["start"] : s["end"]] for s in got[i]["spans"]} == ({"wretchedness"} if y else set()) for i, t, y in rows)


def test_rare_languages_are_learned(spark, monkeypatch):
    """A language of one document in a hundred has its share of a small sample, repeated rows do not fill it, and the
    rare language is found again."""
    monkeypatch.setattr(langid, "FIT_DOCS", 120)
    monkeypatch.setattr(langid, "LEAST_DOCS", 20)
    rng = random.Random(6)
    letters = {"aa": "abcdefgh", "bb": "ijklmnop", "cc": "qrstuvwx"}
    make = lambda lang: " ".join("".join(rng.choice(letters[lang]) for _ in range(6)) for _ in range(30))
    rows = [(i, make(lang), lang) for i in range(6000) for lang in ["cc" if i % 100 == 7 else "ab"[i % 2] * 2]]
    rows += [rows[0]] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got, totals = langid.sample(docs)
    taken = {x: got["lang"].to_pylist().count(x) for x in letters}
    assert sum(taken.values()) == 120 and min(taken.values()) >= 25, taken
    have = docs.where(samples.remainder(4) != 2).groupBy("lang").count().collect()
    assert totals == {r["lang"]: r["count"] for r in have}
    found = langid.languages(docs, langid.learn(docs)).join(docs.select("doc_id", "lang").distinct(), "doc_id").toPandas()
    assert (found.loc[found["lang"] == "cc", "lang_pred"] == "cc").mean() > 0.9
    assert (found["lang"] == found["lang_pred"]).mean() > 0.99
    assert langid.shares({"a": 10, "b": 5000, "c": 9000}, 6000) == {"a": 10, "b": 2995, "c": 2995}


def test_pipeline_on_odd_tables(spark, odd, empty, labels):
    """All stages, one after another, on odd rows, without rows, and with further columns of clashing and dotted names."""
    import corpus_pipeline

    more = {"row_mark": F.lit(1), "has_letters": F.lit("x"), "a.b": F.lit(2), "skey": F.lit("k"), "copies": F.lit(3), "cls": F.lit(4), "id_mark": F.lit(5)}
    for docs, least in ((odd.withColumns(more), 1), (empty, 0)):
        path = shared.fresh_path(spark, "odd")
        labels.limit(0).write.parquet(f"{path}/labels.parquet")
        now = docs
        for name, apply in corpus_pipeline.STAGES[:-1]:
            new = shared.stage(apply(spark, now, path), name)
            assert new.columns == docs.columns
            now = new
        last = corpus_pipeline.STAGES[-1][1](spark, now, path)
        assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and last.count() == now.count() >= least


def test_pipeline(spark):
    import corpus_pipeline

    docs = shared.table(spark, SF, "documents")
    for name, apply in corpus_pipeline.STAGES[:-1]:
        new = shared.stage(apply(spark, docs, SF), name)
        assert new.columns == docs.columns
        docs = new
    assert corpus_pipeline.run(spark, SF).count() == docs.count() > 0
