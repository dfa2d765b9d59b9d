"""License scans: MinHash bands over overlapping windows retrieve templates, containment verifies."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .features import ALNUM, byte_class
from .license_texts import NOTICES, TEXTS
from .tasks import importable
from .text import chunks, mix, shingles_of, words_of

#: Words of a shingle and the least share of a template's shingles that a match contains.
WIDTH, CONTAINMENT = 5, 0.8
#: Bands of one hash value each. A template of t shingles is sought in windows of two blocks of b,
#: t <= b <= 1.34 t. A window around a match holds 0.8 t of them in a union of at most
#: 2 b + 0.2 t, a Jaccard of at least 0.278, so a match is missed with a chance below 0.722 ** 40,
#: two in a million.
BANDS = 40
BLOCKS = np.array([1, 2, 3, 4, 5] + [k << i for i in range(1, 21) for k in (3, 4, 5)])
#: Templates a scan accepts; the index travels with the tasks, at most some 100 bytes a band.
MOST_TEMPLATES = 20_000

#: Whole texts and the notices that name one.
TEMPLATES = NOTICES | TEXTS

#: Words are runs of letters and digits (and of all bytes above ASCII); punctuation only parts them.
_WORD = ALNUM | byte_class([(0x41, 0x5A)])

_SEEDS = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, BANDS, dtype=np.uint64) | np.uint64(1)


def _keys(shingles: np.ndarray, band: int) -> np.ndarray:
    return mix(shingles * _SEEDS[band] + np.uint64(band))


@dataclass
class Index:
    """Templates as shingle sets, and their MinHash values by block size and band."""

    names: list[str]
    sets: list[np.ndarray]
    lengths: np.ndarray

    @classmethod
    def build(cls, templates: dict[str, str]) -> Index:
        if len(templates) > MOST_TEMPLATES:
            raise ValueError(f"{len(templates)} templates; the index is made for {MOST_TEMPLATES}")
        kept = {k: np.unique(shingles_of(words_of(pa.array([v]), _WORD), WIDTH)[0]) for k, v in sorted(templates.items())}
        kept = {k: s for k, s in kept.items() if len(s)}
        return cls(list(kept), list(kept.values()), np.array([len(s) for s in kept.values()], np.int64))

    def blocks(self) -> dict[int, tuple[list[int], list[tuple[np.ndarray, np.ndarray]]]]:
        """Per block size: template numbers, and per band the sorted key and its template."""
        out = {}
        size = BLOCKS[np.searchsorted(BLOCKS, self.lengths)]
        for b in np.unique(size):
            own = np.flatnonzero(size == b)
            bands = []
            for band in range(BANDS):
                key = np.array([_keys(self.sets[i], band).min() for i in own])
                order = np.argsort(key, kind="stable")
                bands.append((key[order], own[order]))
            out[int(b)] = (own.tolist(), bands)
        return out


def windows(counts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(first shingle of every block, its document) with blocks counted from each document's start."""
    blocks = -(-counts // block)
    doc = np.repeat(np.arange(len(counts)), blocks)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    return np.repeat(np.cumsum(counts) - counts, blocks) + within * block, doc


def _ladder(counts: np.ndarray, sizes: set[int]) -> list[tuple[int, np.ndarray | None]]:
    """Block sizes to go through, and where the blocks of the size before begin that make one; None where none do."""
    chains: dict[int, list[int]] = {}
    for s in sorted(sizes):
        root = s if s <= 5 else next(k for k in (3, 4, 5) if s % k == 0 and (s // k) & (s // k - 1) == 0)
        chains.setdefault(4 if root in (1, 2) else root, []).append(s)
    out = []
    for chain in chains.values():
        for n, size in enumerate(chain):
            if not n:
                out.append((size, None))
                continue
            part = -(-counts // chain[n - 1])
            first = np.cumsum(part) - part
            own = -(-counts // size)
            within = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
            out.append((size, np.repeat(first, own) + size // chain[n - 1] * within))
    return out


def _hits(lowest: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Blocks whose minimum is one of the sorted keys."""
    if len(key) <= 8:
        return np.flatnonzero(np.logical_or.reduce([lowest == k for k in key]))
    at = np.minimum(np.searchsorted(key, lowest), len(key) - 1)
    return np.flatnonzero(key[at] == lowest)


def _scan(index: Index) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = index.blocks()
        for b in batches:
            for c in chunks(b):
                words = words_of(c.column("text"), _WORD)
                shingles, of = shingles_of(words, WIDTH)
                if not len(shingles) or not blocks:
                    continue
                counts = np.bincount(of, minlength=c.num_rows)
                ends = np.cumsum(counts)
                near: set[tuple[int, int, int, int]] = set()
                grids = [(size, *windows(counts, size), at) for size, at in _ladder(counts, set(blocks))]
                for band in range(BANDS):
                    hashed, lowest = _keys(shingles, band), None
                    for size, edge, doc, at in grids:
                        # minima of blocks, from those of the size before where there are any
                        if at is not None:
                            lowest = np.minimum.reduceat(lowest, at)
                        else:
                            lowest = np.minimum.reduceat(hashed, edge) if size > 1 else hashed
                        key, own = blocks[size][1][band]
                        # a window is a block and the next one of its document; one of them has the window's minimum
                        for hit in _hits(lowest, key).tolist():
                            for w in (hit - 1, hit):
                                if w < 0 or doc[w] != doc[hit]:
                                    continue
                                low = min(lowest[w], lowest[w + 1]) if w + 1 < len(doc) and doc[w + 1] == doc[w] else lowest[w]
                                if low != lowest[hit]:
                                    continue
                                for k in range(int(np.searchsorted(key, low)), int(np.searchsorted(key, low, side="right"))):
                                    near.add((int(doc[w]), int(own[k]), int(edge[w]), int(min(edge[w] + 2 * size, ends[doc[w]]))))
                found: dict[tuple[int, int], tuple[float, int, int]] = {}
                for d, t, x, y in sorted(near):
                    inside = np.isin(shingles[x:y], index.sets[t])
                    share = len(np.unique(shingles[x:y][inside])) / len(index.sets[t])
                    if share >= CONTAINMENT and share > found.get((d, t), (0.0,))[0]:
                        place = np.flatnonzero(inside) + x - int(ends[d] - counts[d])
                        found[d, t] = (share, int(place[0]), min(int(place[-1]) + WIDTH, int(words.counts[d])))
                if not found:
                    continue
                rows = sorted(found.items())
                docs = pa.array([d for (d, _), _ in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [c.column("doc_id").take(docs), pa.array([index.names[t] for (_, t), _ in rows]),
                     pa.array([v[0] for _, v in rows]), pa.array([v[1] for _, v in rows], pa.int64()),
                     pa.array([v[2] for _, v in rows], pa.int64())],
                    ["doc_id", "license", "containment", "first_word", "end_word"])

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """Rows doc_id, license, containment, first_word, end_word for every template a text contains.

    A template counts when a window of the text holds at least 80 % of its distinct five-word
    shingles; templates of fewer words are one shingle, which only a text of just these words
    has. The best window is reported, the first of equal
    ones. Null, empty and blank texts match nothing; repeated rows are reported each; other
    columns are not read. Texts are scanned whole, in a single pass without a shuffle.
    """
    importable(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _scan(Index.build(TEMPLATES if templates is None else templates)),
        f"doc_id {kind}, license string, containment double, first_word bigint, end_word bigint")
