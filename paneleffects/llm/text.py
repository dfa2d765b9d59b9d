"""Word fingerprints over Arrow text columns, with numpy and without Python strings.

Shared by the operators whose contract takes words ``[^\\x20\\x09-\\x0D]+`` with A-Z
lower-cased. All functions work on one bounded chunk of whole documents at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1B54A32D192ED03)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_POWERS: dict[str, np.ndarray] = {}

#: A fingerprint no word has by construction: the end of a text, and its beginning.
END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base and of its inverse, modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(max(n, CHUNK_BYTES), base, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    text = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data else np.zeros(0, np.uint8)
    return text, ends - ends[0]


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``limit`` bytes of text each, one document at least."""
    # lengths alone: a copy of the batch's whole texts would stay beside it
    ends = np.zeros(batch.num_rows + 1, np.int64)
    np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), out=ends[1:])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


@dataclass
class Words:
    """Words of some documents: byte ranges, fingerprints, and each document's first word."""

    starts: np.ndarray
    ends: np.ndarray
    prints: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words_of(texts: pa.Array, word: np.ndarray | None = None, table: np.ndarray | None = _BYTE) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+``, or runs of the bytes in ``word``, with 64-bit fingerprints that ignore the case of A-Z
    (without ``table`` they do not)."""
    data, offsets = raw(texts)
    n = len(data)
    inside = ~_SPACE[data] if word is None else word[data]
    opens, closes = inside.copy(), inside.copy()
    if n:
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        edges = offsets[:-1][np.diff(offsets) > 0]
        opens[edges] = inside[edges]
        last = offsets[1:][np.diff(offsets) > 0] - 1
        closes[last] = inside[last]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    prints = range_prints(table, data, starts, ends)
    return Words(starts, ends, prints, np.searchsorted(starts, offsets))


def range_prints(table: np.ndarray | None, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of the ranges of ``values`` (through ``table``), which do not overlap and come in order.

    Each value at each place of a range has a pseudo-random number of its own and these add up,
    so there is no algebra of places by which different contents could be made to agree, as
    there is with powers of a base.
    """
    n = ends - starts
    first = np.cumsum(n) - n
    place = np.arange(int(n.sum())) - np.repeat(first, n)
    own = values[place + np.repeat(starts, n)]
    own = table[own] if table is not None else own.astype(np.uint64) * _BASE
    total = np.zeros(len(place) + 1, np.uint64)
    np.cumsum(mix(own + (place.astype(np.uint64) + np.uint64(1)) * _STEP), out=total[1:])
    return mix(total[first + n] - total[first] + n.astype(np.uint64) * _BASE)


def shingles_of(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, document) of ``width`` consecutive words; shorter documents give one, empty none."""
    h, first = words.prints, words.first
    n = np.diff(first)
    short = (n > 0) & (n < width)
    take = np.where(short, 1, np.maximum(n - width + 1, 0))
    doc = np.repeat(np.arange(len(n)), take)
    at = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take) + first[:-1][doc]
    acc = np.full(len(at), np.uint64(width))
    left = n[doc]
    for k in range(width):
        has = left > k if short.any() else None
        part = h[np.minimum(at + k, max(len(h) - 1, 0))] if len(h) else acc
        nxt = mix(acc * np.uint64(0xD6E8FEB86659FD93) + part)
        acc = nxt if has is None else np.where(has, nxt, acc)
    return acc, doc
