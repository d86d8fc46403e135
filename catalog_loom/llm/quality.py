"""Quality by attention-based multiple-instance learning: a document is a bag of passages, and only bags have labels.

Passages are runs of PASSAGE bytes. A passage is described by the histogram of its bytes, the share of words that repeat
the word before, the variety of its words, their mean length and its length; a layer encodes this. Gated attention,
w.(tanh(V h) * sigmoid(U h)) with a softmax over the document's passages, weighs the encodings, and a logistic function
of the weighted encoding is the score. All weights are learned together from document labels.

The fit uses a bounded sample (SAMPLE documents of each class and samples.MOST_BYTES, with all their passages); every document is scored over
all its passages.

Defined cases: null and empty texts have one empty passage; repeated rows are scored alike; a null doc_id is not held out
and not learned from; without labels of both classes every score is the share of good labels (0 without labels); an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from catalog_loom.llm.samples import held_out, labelled
from catalog_loom.llm.shared import mapped, release, table
from catalog_loom.llm.textops import NOT_SPACE, Rolling, mix, slices, spans

SAMPLE = (2000, 3000)
PASSAGE = 512
EXTRA = 5
ENCODED = 16
ATTENTION = 8


def passages(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Descriptions of all passages, and the document of each; an empty document has one."""
    sizes = np.diff(at)
    number = np.maximum(1, -(-sizes // PASSAGE))
    row = np.repeat(np.arange(len(sizes)), number)
    heads = np.cumsum(number) - number
    owner = np.repeat(heads, sizes) + (np.arange(len(raw)) - np.repeat(at[:-1], sizes)) // PASSAGE
    n = len(row)
    size = np.bincount(owner, minlength=n)
    counts = np.bincount(owner * 256 + raw, minlength=n * 256).reshape(n, 256)
    x = np.empty((n, 256 + EXTRA), np.float32)
    np.sqrt(counts / np.maximum(1, size)[:, None], out=x[:, :256], casting="unsafe")
    starts, ends, _ = spans(NOT_SPACE[raw], at)
    x[:, 256:] = 0
    if len(starts):
        words = Rolling(raw).of(starts, ends)
        of = owner[starts]
        many = np.maximum(1, np.bincount(of, minlength=n))
        again = np.zeros(len(words), bool)
        again[1:] = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
        bit = np.uint64(1) << (mix(words) >> np.uint64(58))
        heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        variety = np.zeros(n)
        variety[of[heads]] = np.bitwise_count(np.bitwise_or.reduceat(bit, heads))
        x[:, 256] = 3 * np.bincount(of, again, n) / many
        x[:, 257] = variety / np.minimum(64, many)
        x[:, 258] = np.bincount(of, ends - starts, n) / many / 10
        x[:, 259] = np.log1p(many) / 5
    x[:, 260] = np.log1p(size) / 6
    return x, row


class Model:
    def __init__(self, share: float):
        rng = np.random.default_rng(8)
        self.constant: float | None = share
        make = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w = {"e": make(256 + EXTRA, ENCODED), "eb": np.zeros(ENCODED, np.float32), "v": make(ENCODED, ATTENTION), "u": make(ENCODED, ATTENTION), "a": make(ATTENTION), "c": make(ENCODED), "cb": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
        """row: the document of each passage, in order, none left out."""
        w = self.w
        h = np.tanh(x @ w["e"] + w["eb"])
        t, g = np.tanh(h @ w["v"]), 0.5 + 0.5 * np.tanh(0.5 * (h @ w["u"]))
        s = (t * g) @ w["a"]
        heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        p = np.exp(s - np.maximum.reduceat(s, heads)[row])
        p /= np.add.reduceat(p, heads)[row]
        z = np.add.reduceat(p[:, None] * h, heads, axis=0)
        score = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["cb"], -30, 30)))
        return h, t, g, p, heads, z, score

    def score(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(at) - 1, self.constant)
        return self.forward(*passages(raw, at))[-1].astype(np.float64)

    def gradient(self, x: np.ndarray, row: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted mean cross entropy of whole documents."""
        w = self.w
        h, t, g, p, heads, z, score = self.forward(x, row)
        d = (weight * (score - y) / weight.sum()).astype(x.dtype)
        dz = d[:, None] * w["c"]
        dp = (dz[row] * h).sum(axis=1)
        ds = p * (dp - np.add.reduceat(p * dp, heads)[row])
        dt, dg = ds[:, None] * w["a"] * g * (1 - t * t), ds[:, None] * w["a"] * t * g * (1 - g)
        dh = (p[:, None] * dz[row] + dt @ w["v"].T + dg @ w["u"].T) * (1 - h * h)
        return {"c": z.T @ d, "cb": d.sum(keepdims=True), "a": (t * g).T @ ds, "v": h.T @ dt, "u": h.T @ dg, "e": x.T @ dh, "eb": dh.sum(axis=0)}

    def fit(self, x: np.ndarray, row: np.ndarray, y: np.ndarray, weight: np.ndarray, least_steps: int = 1200, batch: int = 96, rate: float = 0.01) -> None:
        self.constant = None
        rng = np.random.default_rng(9)
        first = np.searchsorted(row, np.arange(len(y) + 1))
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(a) for k, a in self.w.items()}
        w, step = self.w, 0
        epochs = max(40, least_steps * batch // len(y))
        for epoch in range(epochs):
            for docs in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
                many = first[docs + 1] - first[docs]
                rows = np.repeat(first[docs] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                bag = np.repeat(np.arange(len(docs)), many)
                grad = self.gradient(x[rows], bag, y[docs], weight[docs])
                step += 1
                now = rate * (1 - epoch / epochs)
                for k, gr in grad.items():
                    gr = gr + 1e-5 * w[k]
                    m[k] += 0.1 * (gr - m[k])
                    v[k] += 0.01 * (gr * gr - v[k])
                    w[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)


def fit(texts: pa.ChunkedArray, y: np.ndarray, weight: np.ndarray) -> Model:
    model = Model(float((y * weight).sum() / weight.sum()) if len(y) else 0.0)
    if not len(y) or y.min() == y.max():
        return model
    parts = [(passages(raw, at), lo) for lo, _, raw, at in slices(texts)]
    model.fit(np.concatenate([p[0] for p, _ in parts]), np.concatenate([p[1] + lo for p, lo in parts]), y, weight)
    return model


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    model = fit(*labelled(docs, labels, "quality", 4, 2, SAMPLE))
    release()
    return model


def quality(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, at in slices(batch["text"]):
                score = model.score(raw, at)
                rest = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([rest["doc_id"], rest["held_out"], pa.array(score), pa.array((score >= 0.7).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return mapped(docs.select("doc_id", held_out(4, 2).alias("held_out"), "text"), run, "doc_id long, held_out boolean, score double, predicted int")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality(docs, learn(docs, table(spark, sf_dir, "labels")))
