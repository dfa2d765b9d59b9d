"""Katz backoff language model over words, scored for whole documents.

The model is a bigram over all training words that backs off to Good-Turing unigrams:

    P(w | h) = d(c) c(h, w) / c(h)             if the pair was seen c times in training
             = alpha(h) P(w)                   otherwise

with ``d`` the Good-Turing discounts of counts up to ``MOST_DISCOUNTED`` and ``alpha`` chosen
so that every context sums to one exactly. Every word is a context and a word of its own,
however rare; unknown words share the mass that discounting frees.

Words that make up at least one in ``SHARE`` of the training tokens are numbered in a table
of at most ``SHARE`` entries that every task holds; the others go by their fingerprints. That
is a matter of cost alone. ``fit_katz`` can also be asked for a smaller model (``share``), in
which rarer words, unknown ones included, share a class: as contexts they are one, and as
words they get the class's probability times their own share of its Good-Turing mass.

Counts are merged in buckets and stored as two partitioned tables (words; pairs). As

    log P(w | h) = log alpha(h) + log P(w) + gain(h, w),   gain = 0 for pairs not seen,

scoring sends each task's pairs and rare words, with their documents, to the bucket that
stores them; buckets return sums by document. No table of the corpus reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packed import pack, pack_sorted, unpack, unpack_sorted
from .tasks import fold, importable, lean, stage
from .text import END, chunks, mix, words_of

FOLDS, HELD_OUT = 7, 2
#: Counts above this are taken as they are (Katz, 1987).
MOST_DISCOUNTED = 5
#: Words of at least one in SHARE of the tokens are held by every task. Pairs of at least one
#: in FREQUENT are scored where they stand, so no bucket gathers a hot pair.
SHARE, FREQUENT = 1_000_000, 100_000
#: Tokens that a task combines at once, the ranges of buckets in which it does so, and the bytes
#: of text it reads at once.
BLOCK_TOKENS, RANGES, CHUNK_BYTES = 1 << 22, 16, 1 << 18

_K = MOST_DISCOUNTED
_TABLE = "bucket int, kind int, keys binary, counts binary"
#: Numbers of words lie below, fingerprints above.
_NUMBERS = np.uint64(1 << 32)
#: What a bucket's rows hold: pairs of numbered words, words, documents, contexts; pairs with a
#: rare word, on counting dealt by a rare second word or by the context.
PAIR, WORD, DOCUMENT, CONTEXT, FAR, BY_WORD, BY_CONTEXT = range(7)


def good_turing(n: np.ndarray) -> np.ndarray:
    """Discount ratios by count 0 .. MOST_DISCOUNTED from counts of counts n[1 ..].

    Where the counts of counts are too ragged for Katz's formula (small corpora), absolute
    discounting takes its place.
    """
    d = np.ones(_K + 1)
    r = np.arange(1, _K + 1)
    if (n[1:_K + 2] > 0).all():
        cut = (_K + 1) * n[_K + 1] / n[1]
        star = (r + 1) * n[r + 1] / n[r] / r
        d[1:] = (star - cut) / (1 - cut) if cut != 1 else 0
    if not ((d[1:] > 0) & (d[1:] < 1)).all() or not (n[1:_K + 2] > 0).all():
        part = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] > 0 else 0.5
        d[1:] = 1 - np.clip(part, 0.1, 0.9) / r
    return d


@dataclass
class Vocabulary:
    """Frequent words by number (1 ..); BEGIN is a context only. Rare words are the class 0 if
    ``pooled``, else they go by their fingerprints."""

    prints: np.ndarray  # sorted
    counts: np.ndarray
    tokens: int
    types: int
    discount: np.ndarray
    rest: float  # mass of unknown words
    scale: float
    pooled: bool = False

    @property
    def begin(self) -> int:
        return len(self.prints) + 1

    def mass(self, c: np.ndarray) -> np.ndarray:
        """P(w) of training words with these counts."""
        return self.scale * self.discount[np.minimum(c, _K) * (c <= _K)] * c / max(self.tokens, 1)

    def probabilities(self) -> np.ndarray:
        """P(w) by number; the class of rare words takes what the others leave."""
        p = self.mass(self.counts)
        return np.r_[max(1.0 - p.sum(), 1e-300), p]

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.tokens + self.types + 1))

    def number(self, prints: np.ndarray) -> np.ndarray:
        if not len(self.prints):
            return np.zeros(len(prints), np.int64)
        at = np.minimum(np.searchsorted(self.prints, prints), len(self.prints) - 1)
        return np.where(self.prints[at] == prints, at + 1, 0)

    def code(self, prints: np.ndarray) -> np.ndarray:
        """The number of a frequent word; 0 or the fingerprint of a rare one."""
        number = self.number(prints).astype(np.uint64)
        return number if self.pooled else np.where(number > 0, number, prints)

    def log_probabilities(self) -> np.ndarray:
        """log10 P(w) by number; words that go by their fingerprints have theirs in the words' table."""
        log_p = np.log10(np.maximum(self.probabilities(), 1e-300))
        log_p[0] *= self.pooled
        return log_p


def tokens_of(chunk: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints of all tokens, document); every document ends with END."""
    words = words_of(chunk.column("text"))
    n = words.counts + 1
    doc = np.repeat(np.arange(len(n)), n)
    out = np.full(len(doc), END, np.uint64)
    ends = np.cumsum(n) - 1
    inside = np.ones(len(doc), bool)
    inside[ends] = False
    out[inside] = np.where(words.prints < _NUMBERS, ~words.prints, words.prints)
    return out, doc


def _dealt(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_TOKENS) -> Iterator[list[pa.RecordBatch]]:
    """Chunks of documents with about ``limit`` tokens together (six bytes a token)."""
    held, size = [], 0
    for b in batches:
        for c in chunks(b, limit=CHUNK_BYTES):
            held.append(c)
            size += c.column("text").nbytes // 6 + c.num_rows
            if size > limit:
                yield held
                held, size = [], 0
    if held:
        yield held


class _Ranges:
    """Columns of a block's chunks by range of buckets: what is sorted and put out at once is a
    range's part of the block, and its memory is free before the next."""

    def __init__(self, buckets: int) -> None:
        self.step = -(-buckets // RANGES)
        self.held: list[list[list[np.ndarray]]] = [[] for _ in range(-(-buckets // self.step))]

    def add(self, bucket: np.ndarray, *columns: np.ndarray) -> None:
        order, ends = _dealt((bucket // self.step).astype(np.uint16), len(self.held))
        for held, x, y in zip(self.held, ends[:-1], ends[1:], strict=True):
            held.append([c[order[x:y]] for c in columns])

    def __iter__(self) -> Iterator[list[np.ndarray]]:
        for held in self.held:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            yield columns


def _combined(keys: np.ndarray, bucket_of: Callable[[np.ndarray], np.ndarray], buckets: int, kind: int) -> Iterator[pa.RecordBatch]:
    key, n = np.unique(keys, return_counts=True)
    order, ends = _dealt(bucket_of(key), buckets)
    key, n = key[order], n[order].astype(np.int64)
    rows = [(b, kind, pack_sorted(key[x:y]), pack(n[x:y])) for b, (x, y) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if y > x]
    yield from _batch(rows, ["bucket", "kind", "keys", "counts"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()])


def _word_bucket(buckets: int) -> Callable[[np.ndarray], np.ndarray]:
    return lambda key: (mix(key) % np.uint64(buckets)).astype(np.int64)


def _count_words(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _word_bucket(buckets)
        for block in _blocks(batches):
            words = _Ranges(buckets)
            for c in block:
                prints = tokens_of(c)[0]
                words.add(of(prints), prints)
            for (prints,) in words:
                yield from _combined(prints, of, buckets, 1)

    return run


def _merge(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    if not table.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key = np.concatenate([unpack_sorted(x) for x in table["keys"].to_pylist()])
    n = np.concatenate([unpack(x, np.int64) for x in table["counts"].to_pylist()])
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[start], np.add.reduceat(n, start)


def _store_words(table: pa.Table) -> pa.Table:
    key, n = _merge(table)
    of = np.bincount(np.minimum(n, _K + 2), minlength=_K + 3)[: _K + 2]
    return pa.table({
        "bucket": pa.array([table["bucket"][0].as_py()], pa.int32()), "kind": pa.array([1], pa.int32()),
        "keys": pa.array([pack_sorted(key)], pa.binary()), "counts": pa.array([pack(n)], pa.binary()),
        "n": pa.array([int(n.sum())], pa.int64()), "types": pa.array([len(n)], pa.int64()),
        "of": pa.array([of.astype(float).tolist()], pa.list_(pa.float64()))})


def _frequent(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, c in zip(b.column("keys").to_pylist(), b.column("counts").to_pylist(), strict=True):
                key, n = unpack_sorted(k), unpack(c, np.int64)
                on = n >= least
                yield pa.RecordBatch.from_arrays([pa.array(key[on].view(np.int64)), pa.array(n[on])], ["key", "n"])

    return run


def _pairs(code: np.ndarray, doc: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, word) of every token."""
    before = np.r_[np.uint64(begin), code[:-1]]
    before[np.r_[True, doc[1:] != doc[:-1]]] = begin
    return before, code


def _pair_key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Two numbers side by side; where one is a fingerprint, a fingerprint of both."""
    return np.where((h < _NUMBERS) & (w < _NUMBERS), h << np.uint64(32) | w, mix(mix(h ^ END) + w))


def _pair_bucket(vocabulary: Vocabulary, buckets: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A context's pairs share a bucket, a rare one's that of the word; a frequent context is
    spread over several."""
    p = np.r_[vocabulary.probabilities(), 1.0]
    spread = np.clip(np.ceil(2 * buckets * p), 1, buckets).astype(np.uint64)
    rare = _word_bucket(buckets)

    def of(h: np.ndarray, w: np.ndarray) -> np.ndarray:
        parts = spread[np.where(h < _NUMBERS, h, 0).astype(np.int64)]
        near = (mix(h * np.uint64(0x9E3779B97F4A7C15) + mix(w) % parts) % np.uint64(buckets)).astype(np.int64)
        return np.where(h < _NUMBERS, near, rare(h))

    return of


_PLACED = _TABLE + ", h binary, w binary, of_word binary"


def _rows_of(kind: int, bucket: np.ndarray, h: np.ndarray, w: np.ndarray, n: np.ndarray, of_word: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Pairs with a rare word, in rows by bucket."""
    order, ends = _dealt(bucket, buckets)
    h, w, n, of_word = h[order], w[order], n[order], of_word[order]
    rows = [(b, kind, None, pack(n[x:y]), pack_sorted(h[x:y]), pack_sorted(w[x:y]), pack(of_word[x:y]))
            for b, (x, y) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if y > x]
    yield from _batch(rows, ["bucket", "kind", "keys", "counts", "h", "w", "of_word"], [pa.int32(), pa.int32()] + [pa.binary()] * 5)


def _merged(first: np.ndarray, then: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pairs in order, and the sums of columns over equal ones."""
    order = np.lexsort((then, first))
    first, then = first[order], then[order]
    start = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (then[1:] != then[:-1])]) if len(first) else np.zeros(0, np.int64)
    return first[start], then[start], *(np.add.reduceat(c[order], start) if len(start) else c for c in columns)


def _count_pairs(known: Broadcast, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = known.value
        of, of_word = _pair_bucket(v, buckets), _word_bucket(buckets)
        for block in _blocks(batches):
            near, by_word, by_context = (_Ranges(buckets) for _ in range(3))
            for c in block:
                prints, doc = tokens_of(c)
                h, w = _pairs(v.code(prints), doc, v.begin)
                on, rare = (h < _NUMBERS) & (w < _NUMBERS), w >= _NUMBERS
                near.add(of(h[on], w[on]), _pair_key(h[on], w[on]))
                by_word.add(of_word(w[rare]), w[rare], h[rare])
                on |= rare
                by_context.add(of_word(h[~on]), h[~on], w[~on])
            for (key,) in near:
                for rows in _combined(key, lambda key: of(*_numbers(key)), buckets, PAIR):
                    yield _with_nulls(rows)
            for w, h in by_word:
                w, h, n = _merged(w, h, np.ones(len(w), np.int64))
                yield from _rows_of(BY_WORD, of_word(w), h, w, n, np.zeros(len(n), np.int64), buckets)
            for h, w in by_context:
                h, w, n = _merged(h, w, np.ones(len(h), np.int64))
                yield from _rows_of(BY_CONTEXT, of_word(h), h, w, n, np.zeros(len(n), np.int64), buckets)

    return run


def _numbers(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return key >> np.uint64(32), key & np.uint64(0xFFFFFFFF)


def _with_nulls(rows: pa.RecordBatch) -> pa.RecordBatch:
    none = pa.nulls(rows.num_rows, pa.binary())
    return pa.RecordBatch.from_arrays([*rows.columns, none, none, none], [*rows.schema.names, "h", "w", "of_word"])


def _far(table: pa.Table) -> tuple[np.ndarray, ...]:
    """h, w, count, count of the word (0: it has a number) of a table's pairs with a rare word."""
    columns = [("h", unpack_sorted), ("w", unpack_sorted), ("counts", lambda x: unpack(x, np.int64)), ("of_word", lambda x: unpack(x, np.int64))]
    empty = [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] * 2
    return tuple(np.concatenate([e, *map(f, table[k].to_pylist())]) for e, (k, f) in zip(empty, columns, strict=True))


def _place(known: Broadcast, buckets: int) -> Callable[[pa.Table], pa.Table]:
    """Pairs of a bucket's rare words get the word's count and go on to their contexts; others are merged."""

    def run(table: pa.Table) -> pa.Table:
        kinds, bucket = table["kind"].to_numpy(), table["bucket"].to_numpy()[:1]
        rows = []
        key, n = _merge(table.filter(pa.array(kinds == PAIR)))
        if len(key):
            rows += map(_with_nulls, _batch(
                [(bucket[0], PAIR, pack_sorted(key), pack(n))], ["bucket", "kind", "keys", "counts"],
                [pa.int32(), pa.int32(), pa.binary(), pa.binary()]))
        h, w, n, _ = _far(table.filter(pa.array(kinds == BY_CONTEXT)))
        h, w, n = _merged(h, w, n)
        rows += _rows_of(BY_CONTEXT, np.repeat(bucket, len(h)), h, w, n, np.zeros(len(h), np.int64), buckets)
        h, w, n, _ = _far(table.filter(pa.array(kinds == BY_WORD)))
        w, h, n = _merged(w, h, n)
        if not len(w):
            return pa.Table.from_batches(rows)
        start = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        own = np.repeat(np.add.reduceat(n, start), np.diff(np.r_[start, len(w)]))
        order = np.lexsort((w, h))
        h, w, n, own = h[order], w[order], n[order], own[order]
        rows += _rows_of(BY_CONTEXT, _pair_bucket(known.value, buckets)(h, w), h, w, n, own, buckets)
        return pa.Table.from_batches(rows)

    return run


def _sums(h: np.ndarray, n: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts in order; numbers of pairs by count, tokens of counts above, and P of the words seen."""
    order = np.argsort(h, kind="stable")
    h, n, p = h[order], n[order], p[order]
    if not len(h):
        return h, np.zeros((0, _K + 2))
    start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    columns = [np.where(n == r, 1.0, 0.0) for r in range(1, _K + 1)]
    columns += [np.where(n > _K, n, 0).astype(float), p]
    return h[start], np.stack([np.add.reduceat(x, start) for x in columns], axis=1)


_PAIRS = _PLACED + ", of array<double>, contexts binary, stats binary"


def _mass(v: Vocabulary, p: np.ndarray, w: np.ndarray, of_word: np.ndarray) -> np.ndarray:
    """P(w) of words with a number, or with this count."""
    return np.where(of_word > 0, v.mass(of_word), p[np.where(w < _NUMBERS, w, 0).astype(np.int64)])


def _store_pairs(known: Broadcast) -> Callable[[pa.Table], pa.Table]:
    """Merged pairs of a bucket, their counts of counts, and sums by context with a number."""

    def run(table: pa.Table) -> pa.Table:
        v: Vocabulary = known.value
        p = v.probabilities()
        kinds = table["kind"].to_numpy()
        key, n = _merge(table.filter(pa.array(kinds == PAIR)))
        far_h, far_w, far_n, of_word = _far(table.filter(pa.array(kinds != PAIR)))
        far_h, far_w, far_n, of_word = _merged(far_h, far_w, far_n, of_word)  # words with a count came merged
        of = np.bincount(np.minimum(np.r_[n, far_n], _K + 2), minlength=_K + 3)[: _K + 2]
        (h, w), on = _numbers(key), far_h < _NUMBERS
        contexts, stats = _sums(
            np.r_[h, far_h[on]], np.r_[n, far_n[on]], np.r_[p[w.astype(np.int64)], _mass(v, p, far_w[on], of_word[on])])
        columns = {
            "keys": pack_sorted(key), "counts": pack(n), "h": pack_sorted(far_h), "w": pack_sorted(far_w),
            "of_word": pack(np.r_[far_n, of_word]), "contexts": contexts.astype(np.int64).tobytes(), "stats": stats.tobytes()}
        out = {k: pa.array([x], pa.binary()) for k, x in columns.items()}
        return pa.table({
            "bucket": pa.array([table["bucket"][0].as_py()], pa.int32()), "kind": pa.array([PAIR], pa.int32()),
            **{k: out[k] for k in ("keys", "counts", "h", "w", "of_word")},
            "of": pa.array([of.astype(float).tolist()], pa.list_(pa.float64())), "contexts": out["contexts"], "stats": out["stats"]})

    return run


@dataclass
class Pairs:
    """Discounts, and for every context its count, scale of seen words, and backoff weight."""

    discount: np.ndarray
    count: np.ndarray
    scale: np.ndarray
    alpha: np.ndarray

    @classmethod
    def of(cls, d: np.ndarray, stats: np.ndarray) -> Pairs:
        r = np.arange(1, _K + 1)
        count = stats[:, :_K] @ r + stats[:, _K]
        safe = np.maximum(count, 1)
        seen = (stats[:, :_K] @ (r * d[1:]) + stats[:, _K]) / safe
        scale = np.ones(len(count))
        # a context without discounted counts leaves one count for the unseen
        full = (count > 0) & (stats[:, :_K].sum(axis=1) == 0)
        scale[full] = (count / (count + 1))[full]
        left, free = 1 - scale * seen, 1 - stats[:, _K + 1]
        none = (count > 0) & (free < 1e-9)  # a context that has seen every word keeps all mass
        scale[none] = 1 / seen[none]
        alpha = np.where(count > 0, np.where(none, 0.0, left / np.where(free > 0, free, 1)), 1.0)
        return cls(d, count, scale, alpha)

    def log_seen(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 P(w | h) of pairs seen ``c`` times; 0 times counts as next to impossible."""
        seen = self.scale[h] * self.discount[np.minimum(c, _K) * (c <= _K)] * c / np.maximum(self.count[h], 1)
        return np.log10(np.maximum(seen, 1e-300))

    @property
    def backoff(self) -> np.ndarray:
        """log10 alpha of every context."""
        return np.log10(np.maximum(self.alpha, 1e-300))

    def log_probability(self, key: np.ndarray, c: np.ndarray, p: np.ndarray) -> np.ndarray:
        h, w = (x.astype(np.int64) for x in _numbers(key))
        return np.where(c > 0, self.log_seen(h, c), np.log10(np.maximum(self.alpha[h] * p[w], 1e-300)))

    def gain(self, h: np.ndarray, c: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        """What pairs seen ``c`` times have beyond log alpha(h) + log P(w)."""
        return self.log_seen(h, c) - self.backoff[h] - log_p


def _gains(row: dict, v: Vocabulary, model: Pairs) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """A stored bucket's pairs with their gains, and its rare contexts with their backoff."""
    p, log_p = v.probabilities(), v.log_probabilities()
    key, n = unpack_sorted(row["keys"]), unpack(row["counts"], np.int64)
    h, w = (x.astype(np.int64) for x in _numbers(key))
    far_h, far_w = unpack_sorted(row["h"]), unpack_sorted(row["w"])
    far_n, of_word = unpack(row["of_word"], np.int64).reshape(2, -1)
    mass = _mass(v, p, far_w, of_word)
    rare = far_h >= _NUMBERS
    contexts, stats = _sums(far_h[rare], far_n[rare], mass[rare])
    own = Pairs.of(model.discount, stats)
    gain, log_mass = np.zeros(len(far_h)), np.log10(np.maximum(mass, 1e-300))
    gain[rare] = own.gain(np.searchsorted(contexts, far_h[rare]), far_n[rare], log_mass[rare])
    gain[~rare] = model.gain(far_h[~rare].astype(np.int64), far_n[~rare], log_mass[~rare])
    far_key = _pair_key(far_h, far_w)
    order = np.argsort(far_key)
    return {PAIR: (key, model.gain(h, n, log_p[w])), FAR: (far_key[order], gain[order]), CONTEXT: (contexts, own.backoff)}


_ASKED = "bucket int, kind int, block bigint, keys binary, docs binary, counts binary, extra binary"
_SUMS = "block bigint, docs binary, score binary, base binary, known binary, extra binary"


def _ask(known: Broadcast, pairs: Broadcast, hot: Broadcast, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs and rare words of each block by bucket, with their documents; one row with the
    documents themselves and what the broadcast tables already settle."""
    names = ["bucket", "kind", "block", "keys", "docs", "counts", "extra"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = known.value
        model: Pairs = pairs.value
        hot_key, hot_n = hot.value
        log_p, backoff = v.log_probabilities(), model.backoff
        backoff[0] *= v.pooled
        hot_h = _numbers(hot_key)[0].astype(np.int64)
        hot_seen = model.log_seen(hot_h, hot_n)
        counts, of_pair, of_word = np.r_[0, v.counts], _pair_bucket(v, buckets), _word_bucket(buckets)
        for k, block in enumerate(_blocks(batches)):
            number = (TaskContext.get().partitionId() << 32) + k
            at, asked, ids = 0, {PAIR: _Ranges(buckets), WORD: _Ranges(buckets)}, []
            settled = {"n_tokens": [], "score": [], "base": [], "known": []}
            for c in block:
                prints, doc = tokens_of(c)
                h, w = _pairs(v.code(prints), doc, v.begin)
                pair = _pair_key(h, w)
                before, word = (np.where(x < _NUMBERS, x, 0).astype(np.int64) for x in (h, w))
                place = np.minimum(np.searchsorted(hot_key, pair), max(len(hot_key) - 1, 0))
                is_hot = hot_key[place] == pair if len(hot_key) else np.zeros(len(pair), bool)
                rare = word == 0
                sums = lambda x, on: np.bincount(doc[on], weights=x, minlength=c.num_rows)  # noqa: B023, E731
                settled["n_tokens"].append(np.bincount(doc, minlength=c.num_rows))
                score = sums(hot_seen[place[is_hot]], is_hot) if is_hot.any() else np.zeros(c.num_rows)
                settled["base"].append(sums(v.base(counts[word[~rare]]), ~rare))
                settled["known"].append(np.bincount(doc[~rare], minlength=c.num_rows))
                value = log_p[word] + backoff[before]
                for kind, key, on in (PAIR, pair, ~is_hot), (WORD, prints, rare):
                    # a document lies in one chunk, so what is counted here needs no merging
                    order = np.flatnonzero(on)
                    order = order[np.argsort(key[order], kind="stable")]
                    start = np.flatnonzero(np.r_[True, (np.diff(key[order]) > 0) | (np.diff(doc[order]) != 0)]) if len(order) else np.zeros(0, np.int64)
                    n = np.diff(np.r_[start, len(order)])
                    first = order[start]
                    if kind == PAIR:  # times first: gains take much of these sums back
                        score += np.bincount(doc[first], weights=value[first] * n, minlength=c.num_rows)
                    bucket = of_pair(h[first], w[first]) if kind == PAIR else of_word(key[first])
                    asked[kind].add(bucket, bucket.astype(np.int32), key[first], (doc[first] + at).astype(np.uint32), n.astype(np.uint32))
                settled["score"].append(score)
                ids.append(c.column("doc_id"))
                at += c.num_rows
            for kind in (PAIR, WORD):
                for bucket, key, doc, n in asked[kind]:
                    order = np.lexsort((key, bucket))  # documents stay in order
                    key, doc, n = key[order], doc[order], n[order]
                    dealt, start = np.unique(bucket[order], return_index=True)
                    yield from _batch(
                        [(b, kind, number, pack_sorted(key[x:y]), pack(doc[x:y]), pack(n[x:y]), None)
                         for b, x, y in zip(dealt, start, np.r_[start, len(key)][1:], strict=True)], names, kinds)
            settled = {k: np.concatenate(x) for k, x in settled.items()}
            table = pa.table({"doc_id": pa.chunked_array(ids), **settled})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            yield from _batch([(number % buckets, DOCUMENT, number, None, None, None, sink.getvalue().to_pybytes())], names, kinds)

    return run


def _found(key: np.ndarray, value: np.ndarray, want: np.ndarray) -> np.ndarray:
    """The values of the keys wanted, 0 where a key is not stored."""
    if not len(key):
        return np.zeros(len(want), value.dtype)
    at = np.minimum(np.searchsorted(key, want), len(key) - 1)
    return np.where(key[at] == want, value[at], 0)


def _answer(known: Broadcast, pairs: Broadcast) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Sums by block and document of what one bucket's stored tables settle."""

    def run(asked: pa.Table, stored: pa.Table) -> pa.Table:
        v: Vocabulary = known.value
        class_p = np.log10(max(v.probabilities()[0], 1e-300))
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at_hand = dict.fromkeys((PAIR, WORD, FAR, CONTEXT), none)
        for row in stored.to_pylist():  # one of words, one of pairs
            at_hand |= _gains(row, v, pairs.value) if row["kind"] == PAIR else {
                WORD: (unpack_sorted(row["keys"]), unpack(row["counts"], np.int64))}
        out = []
        for row in asked.to_pylist():
            if row["kind"] == DOCUMENT:
                out.append((row["block"], None, None, None, None, row["extra"]))
                continue
            want, doc = unpack_sorted(row["keys"]), unpack(row["docs"], np.uint32).astype(np.int64)
            times = unpack(row["counts"], np.uint32).astype(float)
            if row["kind"] == PAIR:
                sums = [(_found(*at_hand[PAIR], want) + _found(*at_hand[FAR], want)) * times]
            else:
                c = _found(*at_hand[WORD], want)
                # a rare word is once a word and, but for the end, once a context
                own = np.log10(np.maximum(np.where(c > 0, v.mass(c), v.rest), 1e-300))
                own += -class_p if v.pooled else _found(*at_hand[CONTEXT], want)
                sums = [own * times, v.base(c) * times, (c > 0) * times]
            docs, at = np.unique(doc, return_inverse=True)
            parts = [pack(np.bincount(at, weights=x, minlength=len(docs))) for x in sums]
            out.append((row["block"], pack(docs.astype(np.uint32)), *parts, *[None] * (4 - len(parts))))
        kinds_out = [pa.int64()] + [pa.binary()] * 5
        columns = zip(*out, strict=True) if out else [[]] * 6
        return pa.table({name: pa.array(list(x), t) for name, x, t in zip(
            ["block", "docs", "score", "base", "known", "extra"], columns, kinds_out, strict=True)})

    return run


def _finish(tokens: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        docs = pa.ipc.open_stream(next(r["extra"] for r in rows if r["extra"] is not None)).read_all()
        sums = {k: docs[k].to_numpy().astype(float).copy() for k in ("score", "base", "known")}
        for r in rows:
            if r["docs"] is not None:
                at = unpack(r["docs"], np.uint32).astype(np.int64)
                for k in sums:
                    if r[k] is not None:
                        sums[k][at] += unpack(r[k], np.float64)
        return pa.table({
            "doc_id": docs["doc_id"], "n_tokens": docs["n_tokens"], "n_known": sums["known"].round().astype(np.int64),
            "train_tokens": np.full(docs.num_rows, tokens, np.int64), "base_score": sums["base"], "score": sums["score"]})

    return run


@dataclass
class Katz:
    """A fitted model: broadcast frequent words and their weights as contexts, stored word and pair tables."""

    vocabulary: Broadcast
    pairs: Broadcast
    hot: Broadcast
    words_table: DataFrame
    pairs_table: DataFrame
    buckets: int


def fit_katz(docs: DataFrame, train: Column, share: int | None = None, frequent: int = FREQUENT, held: int = SHARE) -> Katz:
    """Counts the rows of ``docs`` where ``train`` holds; reads doc_id and text.

    Every word of the training rows has its own counts and pairs. ``held`` bounds the words that
    tasks hold and changes no result. With ``share``, words below one in ``share`` of the tokens
    are pooled in one class instead, for a smaller model.
    """
    spark = docs.sparkSession
    importable(spark)
    sc = spark.sparkContext
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.where(train).select("text")
    words = stage(
        rows.mapInArrow(lean(_count_words(buckets)), _TABLE).groupBy("bucket")
        .applyInArrow(_store_words, _TABLE + ", n bigint, types bigint, of array<double>"), "katz-words")
    total = words.agg(F.sum("n"), F.sum("types"), *[F.sum(F.col("of")[r]) for r in range(_K + 2)]).first()
    n, types, of = int(total[0] or 0), int(total[1] or 0), np.array([float(x or 0) for x in total[2:]])
    # at most ``held`` words: each makes up that part of the tokens
    common = words.select("keys", "counts").mapInArrow(_frequent(n / (share or held)), "key bigint, n bigint").toArrow()
    prints, counts = common["key"].to_numpy().view(np.uint64), common["n"].to_numpy()
    order = np.argsort(prints)
    discount = good_turing(of)
    mass = float((discount[1:] * np.arange(1, _K + 1) * of[1:_K + 1]).sum() + (n - (np.arange(_K + 1) * of[:_K + 1]).sum()))
    rest = 1 - mass / n if n else 1.0
    scale = 1.0
    if rest <= 0:  # no discounted counts: leave one token for unknown words
        rest, scale = 1 / (n + 1), n / (n + 1)
    vocabulary = Vocabulary(prints[order], counts[order], n, types, discount, rest, scale, share is not None)
    known = sc.broadcast(vocabulary)
    placed = rows.mapInArrow(lean(_count_pairs(known, buckets)), _PLACED).groupBy("bucket").applyInArrow(_place(known, buckets), _PLACED)
    stored = stage(placed.groupBy("bucket").applyInArrow(_store_pairs(known), _PAIRS), "katz-pairs")
    of2 = stored.agg(*[F.sum(F.col("of")[r]) for r in range(_K + 2)]).first()
    stats = np.zeros((vocabulary.begin + 1, _K + 2))
    # one entry for each numbered word and bucket that holds pairs of it: bounded by ``held``
    for c, s in zip(*(stored.select("contexts", "stats").toArrow()[k].to_pylist() for k in ("contexts", "stats")), strict=True):
        stats[np.frombuffer(c, np.int64)] += np.frombuffer(s, np.float64).reshape(-1, _K + 2)
    model = Pairs.of(good_turing(np.array([float(x or 0) for x in of2])), stats)
    hot = stored.select("keys", "counts").mapInArrow(_frequent(max(n / frequent, 1)), "key bigint, n bigint").toArrow()
    hot_key, hot_n = hot["key"].to_numpy().view(np.uint64), hot["n"].to_numpy()
    order = np.argsort(hot_key)
    return Katz(known, sc.broadcast(model), sc.broadcast((hot_key[order], hot_n[order])), words, stored, buckets)


def score_katz(docs: DataFrame, model: Katz) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    asked = docs.select("doc_id", "text").mapInArrow(
        lean(_ask(model.vocabulary, model.pairs, model.hot, model.buckets)), _ASKED)
    columns = ["bucket", "kind", "keys", "counts", "h", "w", "of_word"]
    words = model.words_table.select(*columns[:4], *[F.lit(None).cast("binary").alias(k) for k in columns[4:]])
    stored = words.union(model.pairs_table.select(columns))
    sums = asked.groupBy("bucket").cogroup(stored.groupBy("bucket")).applyInArrow(
        _answer(model.vocabulary, model.pairs), _SUMS)
    return sums.groupBy("block").applyInArrow(
        _finish(model.vocabulary.value.tokens),
        f"doc_id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def katz_scores(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts are the end token alone. Repeated rows are documents of their own; a
    null doc_id counts as empty text for its fold; without training rows every token is
    unknown; an empty table gives no rows; columns other than doc_id and text are not read.
    """
    scored = score_katz(docs, fit_katz(docs, fold(FOLDS) != HELD_OUT))
    return scored.select(
        "doc_id", (fold(FOLDS) == HELD_OUT).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
