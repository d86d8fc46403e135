"""Maximal periodic runs of words, by recompression.

The word sequences of a batch of texts, each between separators that occur once, are compressed into one run-length
grammar. Levels alternate: block compression replaces each block of equal neighbours by a symbol, pair compression splits the
symbols into a left and a right class by a hash and replaces each left symbol and the right one after it by a symbol.
Equal sequences of symbols get equal names at every level, but for the parts at their ends; so the longest common extension of
two places (in either direction) is found by going up while the symbols agree, at most one step aside at each level, and
down again where they differ. The last level is the one whose symbols all differ.

Candidates lie on the harmonic grid: a run of period p with 4 p words or more holds a place i = 2 p t with i + p and i + 2 p
in the run too. Where these three words agree, both extensions of (i, i + p) are asked of the grammar, all
candidates at once. Of stretches with the same ends the smallest period stays; a longer period of the same stretch is a
multiple of it.

Defined cases: a null or empty text has no words and no runs; texts are taken whole, a long one as a batch of its own; repeated
rows are treated each; a null doc_id is kept (and leaves its text as it is in the query); an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog_loom.llm.shared import mapped, table
from catalog_loom.llm.textops import NOT_SPACE, mix, slices, spans

WORD = r"[^\x20\x09-\x0D]+"
LEAST_WORDS = 6
LEAST_PERIODS = 4
CANDIDATES = 1 << 20
RUNS = "array<struct<start:long,length:long,period:long>>"


def named(codes: np.ndarray) -> tuple[np.ndarray, int]:
    """Equal codes get equal numbers from 0 on; how many there are."""
    found = pa.array(codes).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), len(found.dictionary)


class Grammar:
    """levels: symbols of each level, and for all but the last: first child of each symbol above (with the end), parent of
    each symbol, and whether the symbols above are blocks. No two places of the last level agree."""

    def __init__(self, symbols: np.ndarray):
        s, kinds = named(symbols)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, bool]] = []
        salt = 0
        while kinds < len(s):
            starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            if len(starts) < len(s):
                size = np.diff(np.r_[starts, len(s)])
                codes = s[starts] * (size.max() + 1) + size
                s, kinds = self._up(s, starts, codes, True)
                if kinds == len(s):
                    break
            left = mix(np.arange(kinds, dtype=np.uint64), salt) & np.uint64(1) == 0
            salt += 1
            of = left[s]
            forward, backward = of[:-1] & ~of[1:], ~of[:-1] & of[1:]
            pair = np.flatnonzero(forward if np.count_nonzero(forward) >= np.count_nonzero(backward) else backward)
            if not len(pair):
                continue
            first = np.ones(len(s), bool)
            first[pair + 1] = False
            starts = np.flatnonzero(first)
            codes = s[starts].copy()
            codes[np.searchsorted(starts, pair)] = (s[pair] + 1) * kinds + s[pair + 1]
            s, kinds = self._up(s, starts, codes, False)
        self.levels.append((s.astype(np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32), False))

    def _up(self, s: np.ndarray, starts: np.ndarray, codes: np.ndarray, blocks: bool) -> tuple[np.ndarray, int]:
        ends = np.r_[starts, len(s)]
        parents = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(ends))
        self.levels.append((s.astype(np.int32), ends.astype(np.int32), parents, blocks))  # a long text's grammar has some four symbols a word
        return named(codes)

    def extension(self, a: np.ndarray, b: np.ndarray, forward: bool = True) -> np.ndarray:
        """How many symbols agree from the places a and b (two different ones) on, after or before them, these included."""
        a, b, step = a.copy(), b.copy(), 1 if forward else -1
        origin, top = a.copy(), np.full(len(a), len(self.levels) - 1)
        going = np.arange(len(a))
        for level, (s, first, parent, blocks) in enumerate(self.levels[:-1]):
            x, y = a[going], b[going]
            same = s[x] == s[y]
            top[going[~same]] = level
            going, x, y = going[same], x[same], y[same]
            if not len(going):
                break
            left_x, left_y = self._left(first, parent, x, forward), self._left(first, parent, y, forward)
            p, q = parent[x], parent[y]
            aside = (left_x != first[p + 1] - first[p]) | (left_y != first[q + 1] - first[q])
            by = np.where(aside, np.minimum(left_x, left_y) if blocks else 1, 0) * step
            x, y = x + by, y + by
            a[going], b[going] = x, y
            same = s[x] == s[y]
            top[going[~same]] = level
            going = going[same]
            a[going], b[going] = parent[x[same]], parent[y[same]]
        for level in range(len(self.levels) - 2, -1, -1):
            s, first, parent, blocks = self.levels[level]
            down = np.flatnonzero(top > level)
            x = first[a[down]] if forward else first[a[down] + 1] - 1
            y = first[b[down]] if forward else first[b[down] + 1] - 1
            by = np.where(s[x] == s[y], np.minimum(self._left(first, parent, x, forward), self._left(first, parent, y, forward)) if blocks else 1, 0) * step
            a[down], b[down] = x + by, y + by
        return (a - origin) * step

    @staticmethod
    def _left(first: np.ndarray, parent: np.ndarray, at: np.ndarray, forward: bool) -> np.ndarray:
        """How many symbols of the one above are left from a place on, it included."""
        return first[parent[at] + 1] - at if forward else at - first[parent[at]] + 1


def candidates(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, place and period of the points of the grid, about CANDIDATES at a time."""
    text = np.repeat(np.arange(len(sizes)), sizes // LEAST_PERIODS)
    ends = np.cumsum(sizes // LEAST_PERIODS)
    period = np.arange(len(text)) - np.repeat(ends - sizes // LEAST_PERIODS, sizes // LEAST_PERIODS) + 1
    points = (sizes[text] - 1) // (2 * period)
    upto = np.cumsum(points)
    low = 0
    while low < len(text):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + CANDIDATES, "right")))
        n = points[low:high]
        turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        p = np.repeat(period[low:high], n)
        yield np.repeat(text[low:high], n), 2 * p * turn, p
        low = high


def runs(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the word numbers (from 0 on) of texts one after another: text, start, length and period of each run, in the
    order of text, start, period."""
    n, offsets = len(sizes), np.cumsum(sizes) - sizes
    places = np.arange(len(words)) + np.repeat(np.arange(n), sizes) + 1  # a separator before each text and at the end
    s = np.empty(len(words) + n + 1, np.int64)
    s[places] = words
    s[np.r_[offsets + np.arange(n), len(s) - 1]] = (words.max() + 1 if len(words) else 0) + np.arange(n + 1)
    grammar, found = None, []
    for text, place, period in candidates(np.where(sizes >= LEAST_WORDS, sizes, 0)):
        x = offsets[text] + text + 1 + place
        good = np.flatnonzero((s[x] == s[x + period]) & (s[x] == s[x + 2 * period]))
        if not len(good):
            continue
        grammar = grammar or Grammar(s)
        x, p = x[good], period[good]
        before = grammar.extension(x - 1, x + p - 1, False)
        length = grammar.extension(x, x + p) + before + p
        long = np.flatnonzero(length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * p))
        found.append((text[good][long], place[good][long] - before[long], length[long], p[long]))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    text, start, length, period = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((period, length, start, text))
    text, start, length, period = text[order], start[order], length[order], period[order]
    new = np.r_[True, (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])] if len(text) else np.zeros(0, bool)
    text, start, length, period = text[new], start[new], length[new], period[new]
    order = np.lexsort((period, start, text))
    return text[order], start[order], length[order], period[order]


def gathered(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, between: bool) -> tuple[np.ndarray, np.ndarray]:
    """The words one after another, each with a space after it if between, and their ends."""
    sizes = ends - starts + between
    upto = np.cumsum(sizes)
    out = np.full(upto[-1] if len(upto) else 0, 0x20, np.uint8)
    at = np.arange(len(out)) + np.repeat(starts - (upto - sizes), sizes)
    if between and len(out):
        inside = np.ones(len(out), bool)
        inside[upto - 1] = False
        out[inside] = raw[at[inside]]
    else:
        out[:] = raw[at]
    return out, upto


def listed(columns: tuple[np.ndarray, ...], names: tuple[str, ...], owner: np.ndarray, n: int) -> pa.ListArray:
    offsets = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(names)))


def collapsed(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, pa.ListArray, pa.Array]:
    """Of a slice of texts: numbers of words, runs, and the texts without the repeats of the runs."""
    n = len(at) - 1
    starts, ends, sizes = spans(NOT_SPACE[raw], at)
    words, upto = gathered(raw, starts, ends, False)
    array = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.r_[0, upto].astype(np.int64)), pa.py_buffer(words)])
    numbers = array.dictionary_encode().indices.to_numpy().astype(np.int64)
    text, start, length, period = runs(numbers, sizes)
    offsets = np.cumsum(sizes) - sizes
    change = np.zeros(len(starts) + 1, np.int64)
    np.add.at(change, offsets[text] + start + period, 1)
    np.add.at(change, offsets[text] + start + length, -1)
    keep = np.cumsum(change)[:-1] == 0
    kept, upto = gathered(raw, starts[keep], ends[keep], True)
    of = np.repeat(np.arange(n), sizes)[keep]
    last = np.searchsorted(of, np.arange(n + 1))
    borders = np.r_[0, upto][last]
    some = np.diff(last) > 0  # the space after the last word of a text goes
    inside = np.ones(len(kept), bool)
    inside[borders[1:][some] - 1] = False
    borders -= np.r_[0, np.cumsum(some)]
    out = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(borders.astype(np.int64)), pa.py_buffer(kept[inside])])
    return sizes, listed((start, length, period), ("start", "length", "period"), text, n), out.cast(pa.string())


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length and period, by start, then period) and collapsed (the text without words that a run
    contains after its first period, joined by spaces) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, raw, at in slices(batch["text"]):
                sizes, found, text = collapsed(raw, at)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(low, high - low), pa.array(sizes, pa.int64()), found, text], ["doc_id", "n_words", "runs", "collapsed"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def with_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text; of a tenth of the documents, by a hash of the doc_id, the words from some place on are a repetition
    of those that stand there first."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tail(x: Column) -> Column:
        words, n = x["words"], F.size(x["words"])
        a = (g % F.greatest(n, F.lit(1))).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        repeated = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), repeated), 1, n), " ")

    split = F.struct(F.regexp_extract_all("text", F.lit(f"({WORD})")).alias("words"))
    text = F.when(h % 10 == 0, F.transform(F.array(split), tail)[0]).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_runs(with_tails(table(spark, sf_dir, "documents")))
    greatest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    found = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), greatest.alias("top"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("top.s"), F.col("top.length"), -F.col("top.p")
    milli = F.floor(1000 * length / period)
    return found.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


# Pairs of equal words of a text at a distance make islands; an island of 3 p places or more is a run of period p.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w, CAST(doc_id AS VARCHAR) AS t FROM documents),
crc AS (SELECT *, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(t, ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) AS r FROM d),
g AS (SELECT *, xor(r, 4294967295) AS h, xor(r, 4294967295) // 10 AS g, len(w) AS n FROM crc),
a AS (SELECT *, CASE WHEN n > 0 THEN g % n ELSE 0 END AS a FROM g),
p AS (SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END]) ELSE w END AS w FROM a),
x AS (SELECT rid, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM p),
e AS (SELECT x.rid, x.i, y.i - x.i AS q FROM x JOIN x AS y ON x.rid = y.rid AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT rid, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS o FROM e) GROUP BY rid, q, o HAVING count(*) >= greatest(6 - q, 3 * q)),
r AS (SELECT rid, start, length, min(q) AS period FROM s GROUP BY rid, start, length),
o AS (SELECT rid, count(*) AS n_runs, first(struct_pack(s := start, l := length, p := period) ORDER BY length DESC, start, period) AS top,
  string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM r GROUP BY rid),
k AS (SELECT x.rid, string_agg(word, ' ' ORDER BY i) AS kept FROM x WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.rid = x.rid AND x.i >= r.start + r.period AND x.i < r.start + r.length) GROUP BY x.rid)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(top.s AS BIGINT) AS start, CAST(top.l AS BIGINT) AS length, CAST(top.p AS BIGINT) AS period, CAST(1000 * top.l // top.p AS BIGINT) AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM p LEFT JOIN o USING (rid) LEFT JOIN k USING (rid)
"""
