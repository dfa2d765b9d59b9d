"""Language identification: script ranges narrow candidates, Viterbi labels spans of words."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tasks import fold, importable
from .text import chunks

FOLDS, HELD_OUT = 4, 2
#: Labelled documents of a language that the fit reads at most (in expectation), by a hash of doc_id.
MOST_PER_LANGUAGE = 2_000
BUCKETS = 1 << 15
#: Weight of a word's n-gram evidence, cost of a change of language, cost of a foreign script.
WEIGHT, SWITCH, FOREIGN = 0.5, 6.0, 30.0
#: A language uses a script from this share of its letters on.
LEAST_SHARE = 0.005
CHUNK = 1 << 20

# First code point of each range of scripts, from the public Unicode block chart.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Indic"), (0x0E00, "Thai"), (0x0E80, "Southeast"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"),
    (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB10, "Other"), (0x20000, "Han"),
]
NAMES = sorted({name for _, name in SCRIPTS})
_STARTS = np.array([s for s, _ in SCRIPTS])
_INDEX = np.array([NAMES.index(name) for _, name in SCRIPTS])
_TABLES: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    if "letter" not in _TABLES:
        _TABLES["letter"] = np.array([chr(c).isalpha() for c in range(0x32000)])
    return _TABLES["letter"]


@dataclass
class Spelled:
    """Letter runs of some texts: n-gram buckets by letter, and words by document."""

    grams: np.ndarray  # letters x 3
    word_start: np.ndarray
    letters: np.ndarray  # by word
    script: np.ndarray
    first: np.ndarray  # first word of each document
    begin: np.ndarray  # code point offset in its document
    end: np.ndarray


def spell(texts: list[str | None]) -> Spelled:
    """Words are runs of letters of the lower-cased text."""
    lowered = [(t or "").lower() for t in texts]
    # a blank after each text keeps its last word apart
    points = np.frombuffer("".join(t + " " for t in lowered).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    offsets = np.cumsum([0, *(len(t) + 1 for t in lowered)])
    table = _letters()
    inside = table[np.minimum(points, len(table) - 1)]
    far = points >= len(table)
    if far.any():  # beyond the table every point goes by its own category
        some, at = np.unique(points[far], return_inverse=True)
        inside[far] = np.array([chr(p).isalpha() for p in some])[at]
    at = np.flatnonzero(inside)
    c = points[at]
    joined = np.zeros(len(at), bool)
    joined[1:] = np.diff(at) == 1
    one = np.where(joined, np.r_[0, c[:-1]] if len(c) else c, 0)
    two = np.where(joined & np.r_[False, joined[:-1]], np.r_[0, 0, c[:-2]][:len(c)], 0) if len(c) > 1 else np.zeros_like(c)
    final = np.ones(len(at), bool)
    final[:-1] = ~joined[1:]
    spread = lambda x, salt: ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * salt)) >> np.uint64(49)).astype(np.int64)
    grams = np.stack([
        spread(one * 0x200000 + c, 1), spread((two * 0x1FFFFF + one) * 0x1FFFFB + c, 2),
        spread(np.where(final, c * 0x200000 + one, c), 3)], axis=1)
    start = np.flatnonzero(~joined)
    word_at = at[start] if len(at) else at
    size = np.diff(np.r_[start, len(at)])
    script = _INDEX[np.searchsorted(_STARTS, c[start], side="right") - 1] if len(c) else c
    first = np.searchsorted(word_at, offsets)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    begin = word_at - offsets[doc]
    return Spelled(grams, start, size, script, first, begin, begin + size)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages
    scripts: np.ndarray  # scripts x languages: 0, or the cost of a script the language lacks


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for b in batches:
        for c in chunks(b, limit=CHUNK):
            s = spell(c.column("text").to_pylist())
            langs = c.column("lang").to_pylist()
            starts = np.r_[s.word_start, len(s.grams)]
            for k, lang in enumerate(langs):
                v = counts.setdefault(lang, np.zeros(3 * BUCKETS + len(NAMES), np.int64))
                a, z = s.first[k], s.first[k + 1]
                for g in range(3):
                    v[g * BUCKETS:(g + 1) * BUCKETS] += np.bincount(s.grams[starts[a]:starts[z], g], minlength=BUCKETS)
                v[3 * BUCKETS:] += np.bincount(s.script[a:z], weights=s.letters[a:z], minlength=len(NAMES)).astype(np.int64)
    for lang, v in counts.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([v.tobytes()], pa.binary())], ["lang", "counts"])


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int64) for x in table["counts"].to_pylist())
    return pa.table({"lang": [table["lang"][0].as_py()], "counts": pa.array([total.tobytes()], pa.binary())})


def fit_languages(docs: DataFrame, per_language: int = MOST_PER_LANGUAGE) -> Model | None:
    """N-gram weights of every language, from bounded samples of rows outside the held-out fold."""
    importable(docs.sparkSession)
    rows = docs.where((fold(FOLDS) != HELD_OUT) & F.col("lang").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))  # one row per language
    rate = F.lit(per_language) / F.col("n")
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(1 << 20)
    sample = rows.select("doc_id", "lang", "text").join(F.broadcast(sizes), "lang").where(share < rate)
    # the sample is bounded, so its counts come from few tasks
    counts = sample.select("lang", "text").repartition(8).mapInArrow(_count, "lang string, counts binary")
    found = counts.groupBy("lang").applyInArrow(_add, "lang string, counts binary").toArrow().sort_by("lang")
    if not found.num_rows:
        return None
    c = np.stack([np.frombuffer(x, np.int64) for x in found["counts"].to_pylist()]).astype(float)
    parts = [c[:, g * BUCKETS:(g + 1) * BUCKETS] for g in range(3)]
    weights = np.stack([np.log((p + 0.5) / (p.sum(1, keepdims=True) + 0.5 * BUCKETS)) for p in parts])
    weights -= weights.mean(axis=1, keepdims=True)
    script = c[:, 3 * BUCKETS:]
    share_of = script / np.maximum(script.sum(1, keepdims=True), 1)
    foreign = np.where(share_of >= LEAST_SHARE, 0.0, FOREIGN)
    foreign[:, (share_of < LEAST_SHARE).all(axis=0)] = 0.0  # a script nobody uses rules nobody out
    return Model(found["lang"].to_pylist(), weights.transpose(0, 2, 1).astype(np.float32), foreign.T)


def label_words(model: Model, s: Spelled) -> np.ndarray:
    """The best language of every word: Viterbi over all documents at once, longest first."""
    n_lang = len(model.languages)
    n = np.diff(s.first)
    total = len(s.word_start)
    if not total:
        return np.zeros(0, np.int8)
    per_letter = model.weights[0][s.grams[:, 0]] + model.weights[1][s.grams[:, 1]] + model.weights[2][s.grams[:, 2]]
    score = WEIGHT * np.add.reduceat(per_letter, s.word_start, axis=0) - model.scripts[s.script]
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    firsts, lengths = s.first[:-1][order], n[order]
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # documents longer than t
    best = score[firsts].copy()
    back = np.full((total, n_lang), -1, np.int8)  # -1: stay
    for t in range(1, int(lengths[0])):
        k = active[t]
        b = best[:k]
        top = b.argmax(axis=1)
        jump = b[np.arange(k), top] - SWITCH
        go = b < jump[:, None]
        at = firsts[:k] + t
        back[at] = np.where(go, top[:, None], -1)
        best[:k] = np.where(go, jump[:, None], b) + score[at]
    # the best end of a document was reached when it was last active, and stays in its row
    out = np.empty(total, np.int8)
    now = best.argmax(axis=1)
    for t in range(int(lengths[0]) - 1, -1, -1):
        k = active[t]
        at = firsts[:k] + t
        out[at] = now[:k]
        came = back[at, now[:k]]
        now[:k] = np.where(came >= 0, came, now[:k])
    return out


def _predict(model: Model | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b, limit=CHUNK):
                s = spell(c.column("text").to_pylist())
                n_docs = c.num_rows
                letters = np.bincount(np.repeat(np.arange(n_docs), np.diff(s.first)), weights=s.letters, minlength=n_docs)
                if model is None:
                    lang, share = ["und"] * n_docs, np.zeros(n_docs)
                else:
                    k = len(model.languages)
                    doc = np.repeat(np.arange(n_docs), np.diff(s.first))
                    of = np.bincount(doc * k + label_words(model, s), weights=s.letters, minlength=n_docs * k).reshape(n_docs, k)
                    top = of.argmax(axis=1)
                    lang = [model.languages[i] if x else "und" for i, x in zip(top, letters, strict=True)]
                    share = of.max(axis=1) / np.maximum(letters, 1)
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), pa.array(lang), pa.array(share)], ["doc_id", "lang_pred", "score"])

    return run


def _span(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b, limit=CHUNK):
                s = spell(c.column("text").to_pylist())
                label = label_words(model, s)
                doc = np.repeat(np.arange(c.num_rows), np.diff(s.first))
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])
                at = np.flatnonzero(new)
                last = np.r_[at[1:], len(doc)][:len(at)] - 1
                yield pa.RecordBatch.from_arrays([
                    c.column("doc_id").take(pa.array(doc[at])), pa.array(s.begin[at]), pa.array(s.end[last]),
                    pa.array([model.languages[i] for i in label[at]], pa.string())], ["doc_id", "begin", "end", "lang"])

    return run


def language_spans(docs: DataFrame, model: Model) -> DataFrame:
    """Spans of one language in every text: doc_id, begin and end (code points of the lower-cased text), lang."""
    importable(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_span(model), f"doc_id {kind}, begin bigint, end bigint, lang string")


def identify_languages(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    The language that Viterbi gives most letters, and its share of them. Null, empty and
    letterless texts are ``und`` with score 0, as is every text if no row has a language.
    Repeated rows get equal predictions; an empty table gives no rows; lang is read for
    learning alone and no other column is read.
    """
    model = fit_languages(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(_predict(model), f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", (fold(FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
