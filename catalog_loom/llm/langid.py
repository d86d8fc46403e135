"""Language ID: a bidirectional gated recurrent network over bytes, trained by backpropagation through time.

A text's bytes, in lower case, are cut into windows of WINDOW bytes; the network starts anew in each window, runs over it
in both directions, and gives every byte a probability for each language. A document's probabilities are the means over
all its bytes. Both directions and all windows of a batch run side by side, so a step is a few operations on arrays.

The fit uses a bounded sample of whole documents: FIT_DOCS documents are shared among the languages alike, what a rare
language leaves goes to the others, and no language is given fewer than LEAST_DOCS unless it has fewer (so with very many
languages the bound is LEAST_DOCS of each); their texts share FIT_BYTES, alike among the languages, and a text that doesn't
fit any more is left out of the fit. Within a language those of smallest hash are taken; a doc_id counts once. A step of the
fit draws documents and then a window of each, anywhere in its text. The network is fitted to this sample, and the logarithm
of what a sampled document stands for is then added to its language's bias, which restores the shares. Every document is
labelled over its whole text.

Defined cases: a null text or one without a letter is "und" with score 0; if nothing can be learned, all are "und" with
score 0; repeated rows are labelled alike; a null doc_id is not held out and not learned from; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog_loom.llm.samples import held_out, remainder
from catalog_loom.llm.shared import free_name, mapped, release, table
from catalog_loom.llm.textops import buffers, fold_case, slices

FIT_DOCS = 6000
LEAST_DOCS = 64
FIT_BYTES = 48 << 20
HIDDEN = 8
WINDOW = 256
FIT_WINDOW = 64
SIDE_BY_SIDE = 1024
UNKNOWN = "und"


def windows(raw: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of each row's bytes: first byte, length, row."""
    sizes = np.diff(at)
    number = -(-sizes // width)
    row = np.repeat(np.arange(len(sizes)), number)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
    return at[row] + nth * width, np.minimum(width, sizes[row] - nth * width), row


class Network:
    """tables: for each direction and byte, what it adds to update gate, reset gate and candidate; inner: the same for
    the state; outer: from the two states to the languages. Gates are (1 + tanh) / 2."""

    def __init__(self, languages: int, hidden: int = HIDDEN, seed: int = 2):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.w = {
            "table": (rng.normal(size=(512, 3 * hidden)) * 0.3).astype(np.float32),
            "inner": (rng.normal(size=(2, hidden, 3 * hidden)) / np.sqrt(hidden) * 0.7).astype(np.float32),
            "outer": (rng.normal(size=(2, hidden, languages)) * 0.3).astype(np.float32),
            "bias": np.zeros(languages, np.float32),
        }

    def states(self, data: np.ndarray, live: np.ndarray | None, keep: list | None = None) -> np.ndarray:
        """data: (time, windows) bytes; live: 1 where there is a byte, or None. States: (time, 2, windows, hidden), the
        second direction from the last byte on. keep: gets what the way back needs."""
        time, n = data.shape
        h = self.hidden
        both = np.stack([data, data[::-1] + 256], axis=1)
        alive = None if live is None else np.stack([live, live[::-1]], axis=1)[..., None]
        full = None if live is None else live.all(axis=1) & live[::-1].all(axis=1)
        out = np.empty((time, 2, n, h), np.float32)
        state = np.zeros((2, n, h), np.float32)
        for t in range(time):
            from_byte = self.w["table"].take(both[t], axis=0)
            from_state = state @ self.w["inner"]
            gates = np.tanh(from_byte[..., : 2 * h] + from_state[..., : 2 * h])
            gates *= 0.5
            gates += 0.5
            recalled = from_state[..., 2 * h :]
            candidate = np.tanh(from_byte[..., 2 * h :] + gates[..., h:] * recalled)
            new = candidate + gates[..., :h] * (state - candidate)
            if alive is not None and not full[t]:
                new *= alive[t]
            if keep is not None:
                keep.append((both[t], state, gates, recalled, candidate, None if alive is None else alive[t]))
            state = new
            out[t] = state
        return out

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        z = states[:, 0] @ self.w["outer"][0]
        z += states[::-1, 1] @ self.w["outer"][1]
        z += self.w["bias"]
        np.exp(np.minimum(z, 30, out=z), out=z)
        z /= z.sum(axis=2, keepdims=True)
        return z

    def gradient(self, data: np.ndarray, live: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the cross entropy of all live bytes, back through time."""
        h, keep = self.hidden, []
        out = self.states(data, live, keep)
        d = self.probabilities(out)
        d[:, np.arange(len(y)), y] -= 1
        d *= live[..., None] / live.sum()
        grad = {"bias": d.sum(axis=(0, 1)), "outer": np.stack([np.einsum("tnh,tnc->hc", out[:, 0], d), np.einsum("tnh,tnc->hc", out[::-1, 1], d)])}
        back = np.stack([d @ self.w["outer"][0].T, (d @ self.w["outer"][1].T)[::-1]], axis=1)
        grad["inner"] = np.zeros_like(self.w["inner"])
        to_bytes, which = [], []
        later = np.zeros_like(out[0])
        for t in range(len(data) - 1, -1, -1):
            code, state, gates, recalled, candidate, alive = keep[t]
            g = (back[t] + later) * alive
            update, reset = gates[..., :h], gates[..., h:]
            d_candidate = g * (1 - update) * (1 - candidate * candidate)
            d_update = g * (state - candidate) * 2 * update * (1 - update)
            d_reset = d_candidate * recalled * 2 * reset * (1 - reset)
            from_byte = np.concatenate([d_update, d_reset, d_candidate], axis=2)
            from_state = np.concatenate([d_update, d_reset, d_candidate * reset], axis=2)
            grad["inner"] += state.transpose(0, 2, 1) @ from_state
            later = g * update + from_state @ self.w["inner"].transpose(0, 2, 1)
            to_bytes.append(from_byte.reshape(-1, 3 * h))
            which.append(code.ravel())
        code = np.concatenate(which)
        order = np.argsort(code, kind="stable")
        code = code[order]
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        grad["table"] = np.zeros_like(self.w["table"])
        grad["table"][code[first]] = np.add.reduceat(np.concatenate(to_bytes)[order], first)
        return grad

    def fit(self, draw: Callable[[np.random.Generator, int], tuple[np.ndarray, np.ndarray, np.ndarray]], steps: int = 500, batch: int = 128, rate: float = 0.02) -> None:
        """Adam over batches of windows: draw gives data, live and languages of as many as it is asked for."""
        rng = np.random.default_rng(4)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        for step in range(1, steps + 1):
            grad = self.gradient(*draw(rng, batch))
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            now = rate * (1 - step / (steps + 1)) * min(1.0, 1.0 / (norm + 1e-9))
            for k, g in grad.items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                self.w[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)


class Labeller:
    def __init__(self, languages: list[str]):
        self.languages = languages
        self.network = Network(max(1, len(languages)))

    def pooled(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Mean probabilities of each text; zeros for an empty one."""
        low = fold_case(raw)
        start, size, row = windows(low, at, WINDOW)
        sums = np.zeros((len(at) - 1, len(self.languages)))
        order = np.argsort(-size, kind="stable")
        span = np.arange(WINDOW)
        for piece in np.split(order, range(SIDE_BY_SIDE, len(order), SIDE_BY_SIDE)) if len(order) else ():
            longest = int(size[piece[0]])
            live = (span[:longest, None] < size[piece]).astype(np.float32)
            data = low[np.minimum(start[piece] + span[:longest, None], len(low) - 1)].astype(np.int32)
            p = self.network.probabilities(self.network.states(data, None if live.all() else live))
            sums += np.stack([np.bincount(row[piece], x, len(at) - 1) for x in np.einsum("tnc,tn->cn", p, live)], axis=1)
        return sums / np.maximum(1, np.diff(at))[:, None]


def fit(texts: pa.ChunkedArray, names: list[str], totals: dict[str, int]) -> Labeller:
    """totals: the number of documents of each language that the sample stands for."""
    labeller = Labeller(sorted(set(names)))
    if len(labeller.languages) < 2:
        return labeller
    y = np.searchsorted(labeller.languages, names)
    raw, at = buffers(texts)
    low = fold_case(raw)
    number = -(-np.diff(at) // FIT_WINDOW)
    span = np.arange(FIT_WINDOW)[:, None]

    def draw(rng: np.random.Generator, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        docs = rng.integers(0, len(y), many)
        nth = (rng.random(many) * number[docs]).astype(np.int64)
        place = at[docs] + nth * FIT_WINDOW + span
        live = place < at[docs + 1]
        return low[np.minimum(place, len(low) - 1)].astype(np.int32), live.astype(np.float32), y[docs]

    labeller.network.fit(draw)
    stands_for = np.array([totals[x] for x in labeller.languages]) / np.bincount(y, minlength=len(labeller.languages))
    labeller.network.w["bias"] += np.log(stands_for / stands_for.max()).astype(np.float32)
    return labeller


def shares(counts: dict[str, int], most: int) -> dict[str, int]:
    """How many documents of each language are taken: alike, as far as there are any, most in all."""
    out, left = {}, most
    for i, lang in enumerate(sorted(counts, key=lambda x: (counts[x], x))):
        out[lang] = min(counts[lang], max(LEAST_DOCS, left // (len(counts) - i)))
        left = max(0, left - out[lang])
    return out


def sample(docs: DataFrame) -> tuple[pa.Table, dict[str, int]]:
    """lang and text of the documents to fit on, and the number of documents of each language that may be fitted on."""
    known = docs.select("doc_id", "text", "lang").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (remainder(4) != 2) & F.col("text").rlike(r"\p{L}"))
    found = known.groupBy("lang").agg(F.count("*").alias("rows"), F.approx_count_distinct("doc_id", 0.02).alias("ids")).collect()  # a row for each language
    take = shares({r["lang"]: r["ids"] for r in found}, FIT_DOCS)
    if not take:
        return known.select("lang", "text").limit(0).toArrow(), {}
    # A row's rank is about its place among the hashes of its language, as a part of what is taken of it; 0 if all are.
    part = {r["lang"]: r["ids"] / take[r["lang"]] if r["ids"] > take[r["lang"]] else 0.0 for r in found}
    spark = docs.sparkSession
    parts = spark.createDataFrame(list(part.items()), "lang string, part double")
    h = F.xxhash64("doc_id")
    ranked = known.join(F.broadcast(parts), "lang").withColumn("rank", (h / F.lit(2.0**64) + 0.5) * F.col("part")).where(F.col("rank") < 2)
    each = ranked.groupBy("lang", "doc_id").agg(F.min("rank").alias("rank"), F.min(F.octet_length("text")).alias("bytes"))
    near = each.orderBy("rank", "doc_id", "lang").limit(sum(take.values())).collect()
    left = dict.fromkeys(take, FIT_BYTES // len(take))
    chosen = []
    for row in near:
        if row["bytes"] <= left[row["lang"]]:
            left[row["lang"]] -= row["bytes"]
            chosen.append((row["lang"], row["doc_id"], row["bytes"]))
    if not chosen:
        return known.select("lang", "text").limit(0).toArrow(), {}
    fits = spark.createDataFrame(chosen, f"lang string, doc_id {docs.schema['doc_id'].dataType.simpleString()}, bytes int")
    texts = known.join(F.broadcast(fits), ["lang", "doc_id"]).where(F.octet_length("text") == F.col("bytes")).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    got = texts.toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    return got.select(["lang", "text"]), {r["lang"]: r["rows"] for r in found}


def learn(docs: DataFrame) -> Labeller:
    got, totals = sample(docs)
    labeller = fit(got["text"], got["lang"].to_pylist(), totals) if got.num_rows else Labeller([])
    release()
    return labeller


def _labelled(batch: pa.RecordBatch, letters: str, labeller: Labeller) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batch, the language of each row (its number, or -1), and its probability."""
    for lo, hi, raw, at in slices(batch["text"]):
        rest = batch.slice(lo, hi - lo)
        known = rest[letters].to_numpy(zero_copy_only=False).astype(bool)
        if len(labeller.languages) > 1:
            p = labeller.pooled(raw, at)
        else:
            p = np.ones((hi - lo, len(labeller.languages) or 1)) * bool(labeller.languages)
            known = known & bool(labeller.languages)
        yield rest, np.where(known, p.argmax(axis=1), -1), np.where(known, p.max(axis=1), 0.0)


def languages(docs: DataFrame, labeller: Labeller) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document."""
    names = pa.array([*labeller.languages, UNKNOWN])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rest, which, p in _labelled(batch, "letters", labeller):
                lang = names.take(pa.array(np.where(which < 0, len(names) - 1, which)))
                yield pa.RecordBatch.from_arrays([rest["doc_id"], rest["held_out"], lang, pa.array(p)], ["doc_id", "held_out", "lang_pred", "score"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    return mapped(docs.select("doc_id", held_out(4, 2).alias("held_out"), "text", letters), run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, labeller: Labeller, least: float = 0.4) -> DataFrame:
    """The documents that have a language, with a mean probability of at least least; with all their columns."""
    mark, columns = free_name(docs.columns, "has_letters"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rest, which, p in _labelled(batch, mark, labeller):
                yield rest.select(columns).filter(pa.array((which >= 0) & (p >= least)))

    return mapped(docs.withColumn(mark, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))), run, docs.schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return languages(docs, learn(docs))
