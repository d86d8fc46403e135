"""Toxicity: a linear-chain conditional random field tags the toxic tokens of a text.

Tokens are runs of letters in lower case. The features of a token are the word and its first four and five letters,
hashed to weights. Only documents carry labels, so tokens are labelled first: a feature marks its tokens in the toxic
documents of the sample if it is much commoner there than in the others, in several different contexts (copies of one
document give one context). The field is then fitted to these tokens by the gradient of its likelihood, from
forward-backward marginals.

A text's marginals come from the whole text; their largest log odds and their sum give its score by a logistic function
fitted on the same sample. The spans of tokens that are toxic with probability over 0.5 are returned as character offsets.

The sample is bounded (SAMPLE documents of each class, with their whole texts, and samples.MOST_BYTES) and the fit goes over it
in runs of about RUN_TOKENS, so that only a run's arrays are held at once; every document is scored over its whole text.

Defined cases: null and empty texts, and texts without letters, have the score of a text with no toxic token; repeated
rows are scored alike; a null doc_id is not held out and not learned from; without labels of both classes every score is
the share of toxic labels (0 without labels); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from catalog_loom.llm.samples import held_out, labelled
from catalog_loom.llm.shared import mapped, release, table
from catalog_loom.llm.textops import IS_LETTER, Rolling, fold_case, mix, slices, spans

SAMPLE = (2500, 1500)
RUN_TOKENS = 400_000
SHARES = 8
BITS = 18
PREFIXES = (4, 5)
SCORED = "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start:int,end:int>>"


def tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature buckets (one row for each kind), starts, ends, tokens of each document, hashes of the words."""
    low = fold_case(raw)
    starts, ends, counts = spans(IS_LETTER[low], at)
    rolling = Rolling(low)
    words = rolling.of(starts, ends)
    kinds = [words]
    for n in PREFIXES:
        cut = np.minimum(starts + n, ends)
        inside = cut < ends
        split = inside.copy()
        split[inside] = (low[cut[inside]] & 0xC0) == 0x80
        kinds.append(rolling.of(starts, cut + split))
    shift = np.uint64(64 - BITS)
    buckets = np.stack([(mix(k, i + 1) >> shift).astype(np.int32) + (i << BITS) for i, k in enumerate(kinds)])
    return buckets, starts, ends, counts, words


class Field:
    """Weights of the features, and exp of the scores of the four transitions."""

    def __init__(self, kinds: int):
        self.weight = np.zeros(kinds << BITS, np.float32)
        self.bias = -4.0
        self.log_step = np.array([[0.5, -0.5], [0.0, 0.5]])

    def odds(self, buckets: np.ndarray) -> np.ndarray:
        return np.exp(np.clip(self.weight[buckets].sum(axis=0, dtype=np.float64) + self.bias, -30, 30))

    def messages(self, e: np.ndarray, first: np.ndarray, last: np.ndarray, strip: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Forward odds (with the token's own) and backward odds (without). The chain is cut into strips that run side
        by side; each starts some tokens early, so many that what it started from has no more influence: a step brings
        any two messages nearer by the factor tanh(d / 4)."""
        step = np.exp(self.log_step)
        d = abs(self.log_step[0, 0] + self.log_step[1, 1] - self.log_step[0, 1] - self.log_step[1, 0])
        early = int(np.ceil(np.log(1e-12) / np.log(max(np.tanh(d / 4), 1e-6)))) + 1
        n = len(e)
        at = np.arange(0, n, strip)
        forward, backward = np.empty(n), np.empty(n)
        u = np.ones(len(at))
        for t in range(-early, strip):
            i = at + t
            live = (i >= 0) & (i < n)
            j = np.where(live, i, 0)
            u = e[j] * np.where(first[j], 1.0, (step[0, 1] + step[1, 1] * u) / (step[0, 0] + step[1, 0] * u))
            if t >= 0:
                forward[i[live]] = u[live]
        w = np.ones(len(at))
        for t in range(strip + early - 1, -1, -1):
            i = at + t
            live = i < n
            j = np.where(live, i, n - 1)
            v = np.where(last[j], 1.0, (step[1, 0] + step[1, 1] * w) / (step[0, 0] + step[0, 1] * w))
            if t < strip:
                backward[i[live]] = v[live]
            w = np.where(live, e[j] * v, 1.0)
        return forward, backward

    def gradient(self, buckets: np.ndarray, first: np.ndarray, last: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the likelihood of the labels y of whole documents: of the weights, and of the bias and the transitions."""
        before = (np.flatnonzero(~first) - 1).astype(np.int32)
        after = before + 1
        pairs = np.bincount(2 * y[before] + y[after], minlength=4).reshape(2, 2)
        e = self.odds(buckets)
        forward, backward = self.messages(e, first, last)
        p = forward * backward / (1 + forward * backward)
        miss = y - p
        grad = np.zeros(len(self.weight))
        for row in buckets:
            grad += np.bincount(row, miss, len(grad))
        total_miss = miss.sum()
        del p, miss
        u, v, step = forward[before], e[after] * backward[after], np.exp(self.log_step)
        total = step[0, 0] + step[0, 1] * v + step[1, 0] * u + step[1, 1] * u * v
        expected = np.array([[(step[0, 0] / total).sum(), (step[0, 1] * v / total).sum()], [(step[1, 0] * u / total).sum(), (step[1, 1] * u * v / total).sum()]])
        return grad, np.r_[total_miss, (pairs - expected).ravel()]

    def fit(self, runs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], steps: int = 30, rate: float = 0.6) -> None:
        """Adagrad on the likelihood of the labels of all runs (buckets, first, last, y) of documents."""
        seen = np.full(len(self.weight), 1e-3)
        seen_rest = np.full(5, 1e-3)
        toxic = max(1, sum(int(y.sum()) for *_, y in runs))
        for _ in range(steps):
            grad, rest = -0.02 * self.weight.astype(np.float64), np.zeros(5)
            for run in runs:
                of_weight, of_rest = self.gradient(*run)
                grad += of_weight
                rest += of_rest
            rest /= toxic
            seen += grad * grad
            seen_rest += rest * rest
            self.weight += (rate * grad / np.sqrt(seen)).astype(np.float32)
            move = 0.3 * rest / np.sqrt(seen_rest)
            self.bias += move[0]
            self.log_step = np.clip(self.log_step + move[1:].reshape(2, 2), -3, 3)


def token_labels(buckets: np.ndarray, owner: np.ndarray, words: np.ndarray, toxic: np.ndarray, ratio: float = 5.0, sure: float = 3.0, contexts: int = 5) -> np.ndarray:
    """1 for the tokens of toxic documents that hold a feature typical of these."""
    size = buckets.shape[0] << BITS
    yes, no = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    marked = np.zeros(buckets.shape[1], bool)
    mine = toxic[owner]

    def whose(at: np.ndarray) -> np.ndarray:
        return owner[at].astype(np.uint64)

    def context(at: np.ndarray) -> np.ndarray:
        return mix(words[np.maximum(at - 1, 0)], 21) ^ mix(words[np.minimum(at + 1, len(words) - 1)], 22)

    for row in buckets:
        def spread(which: np.ndarray, what: Callable[[np.ndarray], np.ndarray], row: np.ndarray = row) -> np.ndarray:
            out = np.zeros(size, np.int64)
            for part in range(SHARES):
                at = np.flatnonzero(which & (row % SHARES == part))
                pair = np.unique((row[at].astype(np.uint64) << np.uint64(40)) | (mix(what(at), 23) >> np.uint64(24)))
                out += np.bincount((pair >> np.uint64(40)).astype(np.int64), minlength=size)
            return out

        often = np.bincount(row[mine], minlength=size) >= contexts
        use = often[row]
        p, n, c = spread(use & mine, whose), spread(use & ~mine, whose), spread(use & mine, context)
        log_odds = np.log((p + 0.5) / (yes + 1)) - np.log((n + 0.5) / (no + 1))
        typical = (log_odds > np.log(ratio)) & (log_odds > sure * np.sqrt(1 / (p + 0.5) + 1 / (n + 0.5))) & (c >= contexts)
        marked |= typical[row]
    return (marked & mine).astype(np.int8)


def edges(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a token is the first, or the last, of its document."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    first, last = np.zeros(total, bool), np.zeros(total, bool)
    some = counts > 0
    first[(ends - counts)[some]] = True
    last[ends[some] - 1] = True
    return first, last


class Scorer:
    """The field and the logistic function of a document's evidence."""

    def __init__(self, share: float):
        self.field = Field(1 + len(PREFIXES))
        self.line = np.array([np.log((share + 1e-6) / (1 - share + 1e-6)), 0.0, 0.0])

    def evidence(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Evidence of each document (1, largest log odds, log of the expected number), probabilities, starts, ends, counts."""
        buckets, starts, ends, counts, _ = tokens(raw, at)
        out = np.zeros((len(counts), 3))
        out[:, 0], out[:, 1] = 1.0, -10.0
        if not len(starts):
            return out, np.zeros(0), starts, ends, counts
        first, last = edges(counts)
        forward, backward = self.field.messages(self.field.odds(buckets), first, last)
        odds = forward * backward
        some = np.flatnonzero(counts)
        heads = (np.cumsum(counts) - counts)[some]
        p = odds / (1 + odds)
        out[some, 1] = np.clip(np.log(np.maximum.reduceat(odds, heads)), -10, 10)
        out[some, 2] = np.log1p(np.add.reduceat(np.where(p > 0.5, p, 0), heads))
        return out, p, starts, ends, counts

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ self.line, -30, 30)))


def logistic(rows: np.ndarray, y: np.ndarray, weight: np.ndarray, line: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton steps, halved until they help, on the likelihood of y with a small penalty on all but the first weight."""
    penalty = np.r_[1e-6, np.full(rows.shape[1] - 1, ridge)]

    def loss(w: np.ndarray) -> float:
        z = rows @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (penalty * w * w).sum())

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ line, -30, 30)))
        grad = rows.T @ (weight * (y - p)) - penalty * line
        curve = (rows * (weight * p * (1 - p))[:, None]).T @ rows + np.diag(penalty)
        move, now = np.linalg.solve(curve, grad), loss(line)
        while loss(line + move) > now and np.abs(move).max() > 1e-9:
            move = move / 2
        line = line + move
        if np.abs(move).max() < 1e-7:
            break
    return line


def fit(texts: pa.ChunkedArray, y: np.ndarray, weight: np.ndarray) -> Scorer:
    share = float((y * weight).sum() / weight.sum()) if len(y) else 0.0
    scorer = Scorer(share)
    if not len(y) or y.min() == y.max():
        return scorer
    kept: list[list[np.ndarray]] = [[], [], [], []]
    for lo, hi, raw, at in slices(texts):
        buckets, _, _, counts, words = tokens(raw, at)
        for part, new in zip(kept, (buckets, np.repeat(np.arange(lo, hi, dtype=np.int32), counts), words, counts), strict=True):
            part.append(new)
    joined = []
    while kept:  # one after another: the driver is small
        joined.append(np.concatenate(kept.pop(0), axis=-1))
    buckets, owner, words, counts = joined
    del joined
    first, last = edges(counts)
    labels = token_labels(buckets, owner, words, y == 1)
    del owner, words
    stops = np.r_[0, np.flatnonzero(last) + 1]  # of documents with tokens
    cuts = np.unique(np.r_[stops[np.searchsorted(stops, np.arange(0, stops[-1], RUN_TOKENS))], stops[-1]]).tolist()
    scorer.field.fit([(buckets[:, a:b], first[a:b], last[a:b], labels[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    del buckets, first, last, labels
    release()
    rows = np.concatenate([scorer.evidence(raw, at)[0] for _, _, raw, at in slices(texts)])
    scorer.line = logistic(rows, y, weight, scorer.line)
    return scorer


def learn(docs: DataFrame, labels: DataFrame) -> Scorer:
    scorer = fit(*labelled(docs, labels, "toxic", 5, 0, SAMPLE))
    release()
    return scorer


def toxicity(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, held_out, score, predicted, spans of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, at in slices(batch["text"]):
                evidence, p, starts, ends, counts = scorer.evidence(raw, at)
                score = scorer.score(evidence)
                hit = np.flatnonzero(p > 0.5)
                owner = np.repeat(np.arange(hi - lo), counts)[hit]
                chars = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
                base = chars[at[owner]]
                ranges = pa.StructArray.from_arrays([pa.array((chars[x[hit]] - base).astype(np.int32)) for x in (starts, ends)], ["start", "end"])
                offsets = pa.array(np.searchsorted(owner, np.arange(hi - lo + 1)).astype(np.int32))
                rest = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([rest["doc_id"], rest["held_out"], pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.ListArray.from_arrays(offsets, ranges)], ["doc_id", "held_out", "score", "predicted", "spans"])

    return mapped(docs.select("doc_id", held_out(5, 0).alias("held_out"), "text"), run, SCORED)


def keep_clean(docs: DataFrame, scorer: Scorer, threshold: float = 0.5) -> DataFrame:
    """The documents whose score is below threshold, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, at in slices(batch["text"]):
                score = scorer.score(scorer.evidence(raw, at)[0])
                yield batch.slice(lo, hi - lo).filter(pa.array(score < threshold))

    return mapped(docs, run, docs.schema)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, learn(docs, table(spark, sf_dir, "labels")))
