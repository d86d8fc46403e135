"""Blocks of the Jaccard join: what is compared, and how often a class is sent."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from catalog_loom.llm import jaccard
from tests.llm.test_operators import brute_components, near_copies


@pytest.mark.parametrize("block, weight", [(4, 1 << 20), (512, 400), (2, 60)])
def test_small_blocks_against_brute_force(spark, monkeypatch, block, weight):
    """A group is far larger than two blocks, and some of its texts than a block's shingles."""
    monkeypatch.setattr(jaccard, "FEW", 3)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", weight)
    rows = near_copies(block)
    rng = random.Random(block)
    base = [f"w{rng.randint(0, 999)}" for _ in range(40)]
    for i in range(30):  # a chain whose ends do not link
        rows.append((2000 + i, " ".join(base[i:] + [f"c{j}" for j in range(i)])))
    got = jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute_components(rows)


def test_large_component_is_not_sent_to_itself(spark, monkeypatch):
    """400 classes of one root and 3 of others share shingles: each of the 400 is needed by pairs with the others' block only."""
    monkeypatch.setattr(jaccard, "BLOCK", 10)
    apart = [(t, c, 50, 1 if c < 401 else c) for c in range(1, 404) for t in (7, 8)]
    got = jaccard.dealt(spark.createDataFrame(apart, "tok long, cls long, n int, root long"), len(apart)).collect()
    assert sorted(r["cls"] for r in got) == list(range(1, 404))
    assert all(len(r["pairs"]) == 1 for r in got if r["root"] == 1)
    met = {(p["x"], p["y"]) for r in got for p in r["pairs"]}
    blocks = {r["block"] for r in got}
    assert len(blocks) == 41 and len(met) == 41  # the others' block with each of the 40, and with itself
    assert max(Counter(r["block"] for r in got).values()) < 40


def test_blocks_that_share_nothing_do_not_meet(spark, monkeypatch):
    """Shingles 1 and 2 hold different classes, which only class 40 joins to a group."""
    monkeypatch.setattr(jaccard, "BLOCK", 1)
    apart = [(1, c, 9, c) for c in range(20)] + [(2, c, 9, c) for c in range(20, 40)] + [(t, 40, 9, 40) for t in (1, 2)]
    rows = jaccard.dealt(spark.createDataFrame(apart, "tok long, cls long, n int, root long"), len(apart)).collect()
    of = {}
    for r in rows:
        of.setdefault(r["block"], set()).add(r["cls"])
    toks = lambda block: {t for t, c, _, _ in apart if c in of[block]}
    assert all(toks(p["x"]) & toks(p["y"]) for r in rows for p in r["pairs"])


def test_bitmap_and_bits(spark):
    assert [jaccard.bits_for(n, (4, 9)) for n in (0, 1, 16, 17, 512, 10**9)] == [4, 4, 4, 5, 9, 9]
    ids = np.random.default_rng(2).integers(-(1 << 62), 1 << 62, 500)
    bits = jaccard.members(spark.createDataFrame([(int(x),) for x in ids], "cls long"), 16)
    byte, bit = jaccard.cell_of(ids, 16)
    assert (bits[byte] & bit > 0).all() and np.unpackbits(bits).sum() == len(set(zip(byte.tolist(), bit.tolist(), strict=True)))
