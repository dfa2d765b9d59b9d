"""Document quality by positive-unlabelled learning with the non-negative risk estimator.

The risk (Kiryo et al., 2017) is ``pi * E_p[l(g)] + max(0, E_u[l(-g)] - pi * E_p[l(-g)])``
with logistic loss: trusted positives, unlabelled web text and the class prior suffice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tasks import fold, importable, lean
from .text import chunks, raw, words_of

#: Documents of each kind that the fit reads at most (in expectation), chosen by a hash of doc_id.
MOST_POSITIVES, MOST_UNLABELLED = 10_000, 20_000
HIDDEN, STEPS, RATE = 16, 400, 0.02

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3

# byte classes: lower, upper, digit, blank, line end, sentence marks, other ASCII, non-ASCII
_CLASS = np.full(256, 6, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 7
_CLASS[[32, 9, 11, 12]], _CLASS[[10, 13]] = 3, 4
_CLASS[[ord(c) for c in ".,;:'\"()-"]] = 5
_KINDS = 8


def features(texts: pa.Array) -> np.ndarray:
    """Style ratios of whole texts, one row each; empty texts give a row of zeros and a flag."""
    data, offsets = raw(texts)
    n_docs, size = len(offsets) - 1, np.diff(offsets)
    doc = np.repeat(np.arange(n_docs), size)
    kind = np.bincount(doc * _KINDS + _CLASS[data], minlength=n_docs * _KINDS).reshape(n_docs, _KINDS).astype(float)
    total = np.maximum(size, 1)[:, None]
    w = words_of(texts)
    n = w.counts
    some = np.maximum(n, 1)
    of = w.doc
    per = lambda x: np.bincount(of, weights=x, minlength=n_docs) / some
    length = (w.ends - w.starts).astype(float)
    order = np.lexsort((w.prints, of))
    p, d = w.prints[order], of[order]
    fresh = np.ones(len(p), bool)
    fresh[1:] = (p[1:] != p[:-1]) | (d[1:] != d[:-1])
    again = np.zeros(len(of), bool)
    again[1:] = (w.prints[1:] == w.prints[:-1]) & (of[1:] == of[:-1])
    runs = np.flatnonzero(fresh)
    common = np.zeros(n_docs)
    if len(runs):
        np.maximum.at(common, d[runs], np.diff(np.r_[runs, len(p)]))
    last = _CLASS[data[w.ends - 1]] if len(w.ends) else np.zeros(0, np.int64)
    first = _CLASS[data[w.starts]] if len(w.starts) else np.zeros(0, np.int64)
    mean = per(length)
    return np.column_stack([
        kind / total, mean / 10, np.sqrt(np.maximum(per(length**2) - mean**2, 0)) / 10,
        np.bincount(d[fresh], minlength=n_docs) / some, per(again), common / some,
        per(last == 6), per(first == 6), per(first == 1), per(last == 5), per(last == 2),
        per(length == 1), np.log1p(n) / 10, kind[:, 4] / some, n == 0])


@dataclass(frozen=True)
class Model:
    """Standardisation, one hidden layer, output."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_non_negative(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 0) -> Model:
    """Adam on the non-negative risk; where its bracket is negative, the step undoes it."""
    rng = np.random.default_rng(seed)
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    zp, zu = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    k = zp.shape[1]
    theta = [rng.normal(0, 1 / np.sqrt(k), (k, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    moments = [(np.zeros_like(t), np.zeros_like(t)) for t in theta]
    sig = lambda g: 1 / (1 + np.exp(-np.clip(g, -30, 30)))
    for step in range(1, STEPS + 1):
        w1, b1, w2, b2 = theta
        hp, hu = np.tanh(zp @ w1 + b1), np.tanh(zu @ w1 + b1)
        gp, gu = hp @ w2 + b2, hu @ w2 + b2
        bracket = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        du = sig(gu) / len(gu)
        dp = -prior * sig(gp) / len(gp)  # of -pi E_p[l(-g)]
        if bracket < 0:
            dp, du = -dp, -du
        else:
            dp = dp - prior * sig(-gp) / len(gp)  # of pi E_p[l(g)]
        grads = [np.zeros_like(t) for t in theta]
        for z, h, dg in ((zp, hp, dp), (zu, hu, du)):
            back = dg[:, None] * w2 * (1 - h * h)
            for g, part in zip(grads, (z.T @ back, back.sum(0), h.T @ dg, np.array([dg.sum()])), strict=True):
                g += part
        for t, g, (m, v) in zip(theta, grads, moments, strict=True):
            g = g + 1e-4 * t
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            t -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w1, b1, w2, b2 = theta
    return Model(mean, scale, w1, b1, w2, float(b2[0]))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for c in chunks(b):
            x = features(c.column("text"))
            yield pa.RecordBatch.from_arrays(
                [c.column("doc_id"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "x"])


def _scorer(model: Model | None, extra: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b):
                x = np.full(c.num_rows, 0.5) if model is None else model.score(features(c.column("text")))
                yield pa.RecordBatch.from_arrays([*c.select(extra).columns, pa.array(x)], [*extra, "score"])

    return run


def _chosen(rate: float, salt: str) -> F.Column:
    """A share of doc_ids by hash."""
    return F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(1 << 20)) < int(rate * (1 << 20)) + 1


def prior_estimate(ones: int, n: int) -> float:
    """The lower end of the 95 % interval of the share of 1 among the labelled rows.

    A prior above the true share makes the risk blind to as many negatives, one below it only
    makes the score stricter; unlabelled text may also hold kinds that nobody labelled.
    """
    share = min(ones / n, 0.99)
    return max(share - 1.96 * np.sqrt(share * (1 - share) / n), share / 2)


def fit_quality(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fits on bounded samples of the documents outside the held-out fold; None without positives.

    Trusted positives are rows labelled 1. The class prior is estimated from all labelled rows
    of the same folds (``prior_estimate``). Unlabelled text comes from those folds of ``docs``.
    """
    importable(docs.sparkSession)
    open_fold = fold(FOLDS) != HELD_OUT
    known = labels.where(open_fold & F.col("quality").isNotNull()).select("doc_id", "quality")
    n, ones = known.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("quality") == 1).cast("int")), F.lit(0))).first()
    if not ones:
        return None
    prior = prior_estimate(ones, n)
    rows = docs.where(open_fold).select("doc_id", "text")
    # bounded by MOST_POSITIVES, so it may be broadcast
    trusted = known.where((F.col("quality") == 1) & _chosen(MOST_POSITIVES / ones, "p")).select("doc_id").distinct()
    positive = rows.join(F.broadcast(trusted), "doc_id").select("doc_id", "text")
    unlabelled = rows.where(_chosen(MOST_UNLABELLED / max(docs.count(), 1), "u"))
    x = [np.array([r for r in df.mapInArrow(_features, "doc_id string, x array<double>").toArrow()["x"].to_pylist()])
         for df in (positive.select(F.col("doc_id").cast("string"), "text"),
                    unlabelled.select(F.col("doc_id").cast("string"), "text"))]
    if not len(x[0]) or not len(x[1]):
        return None
    return fit_non_negative(x[0], x[1], prior)


def score_quality(docs: DataFrame, model: Model | None, columns: list[str]) -> DataFrame:
    """``columns`` of every document and its score; other columns are not read."""
    importable(docs.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", score double"
    return docs.select(*dict.fromkeys([*columns, "text"])).mapInArrow(lean(_scorer(model, columns)), schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 from 0.3).

    Null and empty texts are scored as texts without words. Repeated rows get the same score.
    Without any positive label every score is 0.5. An empty table gives no rows; a null
    doc_id counts as empty text for its fold; other columns are not read.
    """
    scored = score_quality(docs.select("doc_id", "text"), fit_quality(docs, labels), ["doc_id"])
    return scored.select(
        "doc_id", (fold(FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _keeper(model: Model | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b):
                yield c if model is None else c.filter(pa.array(model.score(features(c.column("text"))) >= THRESHOLD))

    return run


def keep_good(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the threshold; all without a model."""
    importable(docs.sparkSession)
    return docs.mapInArrow(lean(_keeper(model)), docs.schema)
