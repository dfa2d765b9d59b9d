"""Words of Arrow text columns as Arrow strings, cut by a byte class and exact.

Shared by the operators whose features are runs of words: all work is vectorised over one
bounded chunk of whole documents, and words stay strings, so no two are ever mistaken.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .text import mix, powers, raw

#: A-Z to a-z; every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(ranges: list[tuple[int, int]]) -> np.ndarray:
    """A table of the bytes in ``ranges``, ends included."""
    table = np.zeros(256, dtype=bool)
    for a, b in ranges:
        table[a:b + 1] = True
    return table


#: An odd number for every byte.
SPREAD = np.random.Generator(np.random.PCG64(20240611)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z: digits, a-z and all above ASCII.
ALNUM = byte_class([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])


@dataclass
class Tokens:
    """Words of some documents in order: strings, each document's first word, and whether a cut lies before a word."""

    words: pa.LargeStringArray
    first: np.ndarray
    cut: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def tokens_of(texts: pa.Array, inside: np.ndarray, cuts: np.ndarray | None = None) -> Tokens:
    """Lower-cased (A-Z) words: the longest runs of bytes in ``inside``; null texts have none.

    ``cut`` tells where a document begins, or where a byte of ``cuts`` lies between a word and
    the one before. Texts are valid UTF-8 and both classes hold bytes above ASCII all or none,
    so words are valid as well.
    """
    data, offsets = raw(texts)
    n = len(data)
    if not n:
        none = pa.array([], pa.large_string())
        return Tokens(none, np.zeros(len(offsets), np.int64), np.zeros(0, bool))
    whole = data.tobytes()
    kinds = inside.astype(np.uint8) + (0 if cuts is None else 2 * cuts.astype(np.uint8))
    kind = np.frombuffer(whole.translate(kinds[LOWER].tobytes()), np.uint8)
    on = kind & 1
    edges = np.flatnonzero(on[1:] != on[:-1]) + 1
    if on[0]:
        edges = np.r_[0, edges]
    if on[-1]:
        edges = np.r_[edges, n]
    between = np.unique(offsets[1:-1])
    between = between[(between > 0) & (between < n)]
    between = between[(on[between - 1] & on[between]) > 0]  # a word ends where its document does
    if len(between):
        edges = np.sort(np.concatenate([edges, between, between]), kind="stable")
    starts, ends = edges[::2], edges[1::2]
    first = np.searchsorted(starts, offsets)
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    outside = np.flatnonzero(~inside[LOWER]).astype(np.uint8).tobytes()
    words = pa.LargeStringArray.from_buffers(
        len(starts), pa.py_buffer(at), pa.py_buffer(whole.translate(LOWER.tobytes(), outside)))
    cut = np.zeros(len(starts), bool)
    if cuts is not None and len(starts) > 1:
        gaps = edges[1:-1]
        cut[1:] = np.bitwise_or.reduceat(kind, gaps)[::2] > 1
    cut[first[:-1][np.diff(first) > 0]] = True
    return Tokens(words, first, cut)


def string_hashes(strings: pa.Array) -> np.ndarray:
    """64-bit hashes of strings, for filters and samples only: different strings can be made to collide."""
    data, offsets = raw(strings)
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(SPREAD[data] * up, out=total[1:])
    size = np.diff(offsets).astype(np.uint64)
    start = np.minimum(offsets[:-1], max(len(data) - 1, 0))
    return mix((total[offsets[1:]] - total[offsets[:-1]]) * (down[start] if len(data) else np.uint64(0)) + size)
