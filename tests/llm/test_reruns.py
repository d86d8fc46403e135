"""The tokenizer on every code point, the mix on rows that share ids, columns that can't be hashed, and the pipeline's stages
against plain versions of what they do."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from catalog_loom.llm import bpe, jaccard, langid, mixing, shared, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def library():
    import tokenizers

    found = tokenizers.Tokenizer.from_file(bpe.default_path())
    found.no_truncation()
    found.no_padding()
    return found


def different(library, texts):
    ids, at = bpe.loaded(bpe.packed()).encode(texts)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    return [t for i, t in enumerate(texts) if ids[at[i] : at[i + 1]].tolist() != want[i]]


def test_every_code_point(library):
    codes = [chr(c) for c in (*range(1, 0xD800), *range(0xE000, 0x110000))]
    for at in range(0, len(codes), 20_000):
        texts = [" \n".join(f"a{c}b 1{c}2 !{c}! {c}" for c in codes[i : i + 20]) for i in range(at, min(at + 20_000, len(codes)), 20)]
        assert not different(library, texts)


def test_rare_characters_together(library):
    rng = random.Random(8)
    fixed = [chr(c) for low, high in bpe.UNORDERED + bpe.LATER_LETTERS + bpe.LATER_DIGITS for c in range(low, min(high, low + 5) + 1)]
    pool = [*fixed, *map(chr, bpe.LATER_LOWER), *"aeoAE 12'sßΣİ", "̣", "̖", "́", "̈", "̍", "\U00011935", "\U00011938", "\U0001f600", "ᄒ", "ᅡ", "ᆫ"]
    any_one = lambda: chr(rng.choice((rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x110000))))
    texts = ["".join(rng.choice(pool) if rng.random() < 0.7 else any_one() for _ in range(rng.randrange(14))) for _ in range(8000)]
    assert not different(library, texts)


def test_other_tables_are_refused(monkeypatch):
    monkeypatch.setattr(bpe, "N_LETTERS", 1)
    with pytest.raises(ValueError, match="another version"):
        bpe.Characters()


def shared_ids():
    rng = random.Random(9)
    rows = [(7, " ".join(rng.choice("abcdef") for _ in range(20)), "de", "s") for _ in range(40)]
    rows += [(7, "x y z", lang, "s") for lang in ("de", "en", None, None, None)] + [(None, " ".join("w" * rng.randrange(1, 9) for _ in range(20)), "de", "s") for _ in range(12)]
    return rows + [(i, " ".join(["v"] * rng.randrange(40)), "en", rng.choice("st")) for i in range(100, 180)]


def test_mixes_agree(spark):
    """Rows that share id, size and source but not the text, and rows that agree in all columns."""
    docs = spark.createDataFrame(shared_ids(), "doc_id long, text string, lang string, source string")
    seen = set()
    for parts in (1, 3, 5, 7):
        mixed = mixing.mixed_documents(docs.repartition(parts))
        seen.add(tuple(sorted(collections.Counter(tuple(map(str, r)) for r in mixed.collect()).items())))
    assert len(seen) == 1
    taken = sum(r["taken"] for r in mixing.mix_sources(docs).collect())
    assert sum(n * len(WORD.findall(row[1])) for row, n in seen.pop()) == taken


def test_columns_that_cannot_be_hashed(spark):
    docs = spark.createDataFrame(shared_ids(), "doc_id long, text string, lang string, source string")
    docs = docs.withColumn("facts", F.when(F.col("doc_id") > 120, F.create_map(F.lit("k"), F.col("lang")))).withColumn("more", F.array(F.create_map(F.lit(1), F.struct("source"))))
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and 0 < len(kept.collect()) < docs.count()
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and len(mixed.collect()) > 0


def naive_kept(rows):
    """Of each component of near copies the row of smallest doc_id, and of smallest text among those that share it (any, as
    texts of one id differ here); rows without words stay."""
    sets = []
    for row in rows:
        words = WORD.findall((row["text"] or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    owner = list(range(len(rows)))

    def root(i):
        while owner[i] != i:
            i = owner[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                owner[root(i)] = root(j)
    best = {}
    for i, row in enumerate(rows):
        key = root(i) if sets[i] else ("alone", i)
        if key not in best or row["doc_id"] < best[key]["doc_id"]:
            best[key] = row
    return sorted((r["doc_id"], r["text"] or "") for r in best.values())


def test_pipeline_against_plain_stages(spark, library):
    """Each stage on what the one before kept: the models' own scores, pairs of shingle sets, targets by source, the library."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs, labels = shared.table(spark, SF, "documents"), shared.table(spark, SF, "labels")

    clean = shared.stage(stages["toxicity"](spark, docs, SF), "clean")
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, toxicity.learn(docs, labels)).collect()}
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(i for i, s in scores.items() if s < 0.5)

    known = shared.stage(stages["language_id"](spark, clean, SF), "known")
    told = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.languages(clean, langid.learn(clean)).collect()}
    assert sorted(r["doc_id"] for r in known.collect()) == sorted(i for i, (lang, s) in told.items() if lang != "und" and s >= 0.4)

    single = shared.stage(stages["ngram_jaccard_join"](spark, known, SF), "single")
    assert sorted((r["doc_id"], r["text"] or "") for r in single.collect()) == naive_kept(known.collect())

    mixed = shared.stage(stages["mixing"](spark, single, SF), "mixed")
    texts = {r["doc_id"]: r for r in single.collect()}
    words, sizes = collections.Counter(), collections.Counter()
    for r in mixed.collect():
        own = texts[r["doc_id"]]
        n = len(WORD.findall(r["text"]))
        assert (r["lang"], r["source"], r["n_chars"]) == (own["lang"], own["source"], own["n_chars"])
        assert r["text"] == own["text"] or r["text"] == " ".join(WORD.findall(own["text"])[:n])
        words[r["source"]] += n
    for r in single.collect():
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, rest = {}, 1.5 * sum(sizes.values())
    open_ = dict(weight)
    while open_:
        level = rest / sum(open_.values())
        full = [s for s in open_ if 2 * sizes[s] <= open_[s] * level]
        for s in full or list(open_):
            target[s] = 2 * sizes[s] if full else open_[s] * level
            rest -= target[s]
            del open_[s]
    assert all(abs(words[s] - target[s]) <= 1 for s in sizes)

    got = sorted(tuple(r) for r in stages["bpe"](spark, mixed, SF).collect())
    want = []
    for r in mixed.collect():
        ids = library.encode(r["text"], add_special_tokens=False).ids
        shown = library.decode(ids, skip_special_tokens=False)
        want.append((r["doc_id"], len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()))
    assert got == sorted(want)
