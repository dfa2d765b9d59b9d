"""Near-duplicate lines by a segment-partition edit join.

A line within ``edits`` of another agrees with it on one of ``edits + 1`` segments. Lines index
their segments by length, place and content; every line probes the segments of lines of its
own length and up to ``edits`` shorter ones, at the few shifts the edits left allow. Lines that
meet are candidates; a banded bit-parallel edit distance decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .regions import COARSE, LEAF, KeyBlock, far_vector, link_regions, members_of
from .tasks import importable, lean, outlive, scratch, small, stage
from .text import chunks, mix, range_prints

#: Edits between near-duplicate lines, and the shortest line that is compared at all.
EDITS, MIN_CHARS = 2, 32
CHUNK = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BLANK = np.array([0x20, 9, 10, 11, 12, 13])


@dataclass(frozen=True)
class Edits:
    """The edit metric; an edit moves at most two character counts by one."""

    edits: int = EDITS
    min_chars: int = MIN_CHARS

    def bound(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return 2 * self.edits + 0 * (x + y)

    def highest(self, n: np.ndarray) -> np.ndarray:
        return n + self.edits

    def sizes_fit(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.abs(x - y) <= self.edits

    def linked(self, x: bytes, y: bytes) -> bool:
        return within_edits(x.decode("utf-32-le", "surrogatepass"), y.decode("utf-32-le", "surrogatepass"), self.edits)


def within_edits(a: str, b: str, k: int) -> bool:
    """Whether the edit distance is at most ``k``: bit-parallel states in a band of 2 k + 1.

    State e holds, for the current place in ``b``, the places of ``a`` within k of it that are
    reached with at most e edits; bit p stands for place j - k + p.
    """
    if abs(len(a) - len(b)) > k:
        return False
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    a, b = a[low:], b[low:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return True
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    band = (1 << (2 * k + 1)) - 1
    states = [((1 << (e + 1)) - 1) << k & band for e in range(k + 1)]
    for j, c in enumerate(b):
        same = places.get(c, 0)
        same = (same >> (j - k) if j >= k else same << (k - j)) & band
        new = [states[0] & same]
        for e in range(1, k + 1):
            new.append((states[e] & same | states[e - 1] | states[e - 1] >> 1 | new[e - 1] << 1) & band)
        states = new
        if not states[k]:
            return False
    return bool(states[k] >> (len(a) - len(b) + k) & 1)


@dataclass
class Lines:
    """Trimmed lines of some texts, as ranges of code points."""

    points: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    number: np.ndarray

    @property
    def n(self) -> np.ndarray:
        return self.end - self.start

    @cached_property
    def total(self) -> np.ndarray:
        """Sums of hashed code points, for keys of any range, which only bring lines together."""
        total = np.zeros(len(self.points) + 1, np.uint64)
        np.cumsum(mix(self.points.astype(np.uint64) + np.uint64(1)) * _powers(len(self.points) + 1)[0][:-1], out=total[1:])
        return total

    def prints(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * _powers(len(self.points) + 1)[1][start])


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(max(n, CHUNK), base, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def lines_of(texts: list[str | None]) -> Lines:
    """Lines between line feeds, without ``[\\x20\\x09-\\x0D]`` at either end; null has one empty line."""
    texts = [t or "" for t in texts]
    points = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    feeds = np.flatnonzero(points == 10)
    begin = np.r_[0, feeds[:-1] + 1] if len(feeds) else feeds
    doc = np.searchsorted(offsets, begin, side="right") - 1
    solid = np.flatnonzero(~np.isin(points, _BLANK))
    first = np.searchsorted(solid, begin)
    after = np.searchsorted(solid, feeds)
    some = after > first
    start = np.where(some, solid[np.minimum(first, max(len(solid) - 1, 0))] if len(solid) else 0, begin)
    end = np.where(some, solid[np.maximum(after - 1, 0)] + 1 if len(solid) else 0, start)
    head = np.searchsorted(doc, np.arange(len(texts)))
    return Lines(points, start, end, doc, np.arange(len(doc)) - head[doc])


def class_of(lines: Lines, on: np.ndarray | slice = slice(None)) -> np.ndarray:
    """A 64-bit fingerprint of content and length of the lines ``on``; equal lines are one class."""
    return range_prints(None, lines.points, lines.start[on], lines.end[on]).view(np.int64)


def _listed(limit: Edits) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Every compared line: doc_id, line, class; and a row without class for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b, limit=CHUNK):
                lines = lines_of(c.column("text").to_pylist())
                on = np.flatnonzero(lines.n >= limit.min_chars)
                cls = class_of(lines, on)
                count = np.bincount(lines.doc, minlength=c.num_rows)
                docs = np.r_[lines.doc[on], np.arange(c.num_rows)]
                yield pa.RecordBatch.from_arrays([
                    c.column("row").take(pa.array(docs)), c.column("doc_id").take(pa.array(docs)),
                    pa.array(np.r_[lines.number[on], count].astype(np.int64)),
                    pa.array(np.r_[cls, np.zeros(c.num_rows, np.int64)], mask=np.r_[np.zeros(len(on), bool), np.ones(c.num_rows, bool)]),
                ], ["row", "doc_id", "line", "class"])

    return run


def _segments(n: np.ndarray, k: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment ``i`` of ``k + 1`` in lines of ``n`` characters; the last are longer."""
    base, longer = n // (k + 1), n % (k + 1)
    extra = np.maximum(i - (k + 1 - longer), 0)
    return i * base + extra, base + (i >= k + 1 - longer)


def _keys(limit: Edits, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    k = limit.edits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = KeyBlock(buckets)
        for b in batches:
            for c in chunks(b, limit=CHUNK):
                lines = lines_of(c.column("text").to_pylist())
                on = np.flatnonzero(lines.n >= limit.min_chars)
                cls, first = np.unique(class_of(lines, on), return_index=True)
                on = on[first]
                start, n = lines.start[on], lines.n[on]
                for shorter in range(k + 1):
                    size = n - shorter
                    ok = size >= limit.min_chars
                    for i in range(k + 1):
                        place, width = _segments(size, k, i)
                        tag = mix(size.astype(np.uint64) * np.uint64(64) + np.uint64(i))
                        shifts = range(max(-i, shorter - (k - i)), min(i, shorter + (k - i)) + 1)
                        for shift in shifts:
                            at = place + shift
                            use = ok & (at >= 0) & (at + width <= n)
                            x = start[use] + at[use]
                            key = mix(lines.prints(x, x + width[use]) ^ tag[use])
                            indexed = np.full(len(key), shorter == 0 and shift == 0)
                            yield from block.add(key, cls[use], indexed)
        yield from block.flush()

    return run


def _contents(limit: Edits) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b, limit=CHUNK):
                lines = lines_of(c.column("text").to_pylist())
                cls = class_of(lines)
                want = c.column("classes").to_pylist()
                rows: dict[int, tuple[int, bytes, bytes]] = {}
                for d in range(c.num_rows):
                    wanted = set(want[d])
                    for i in np.flatnonzero(lines.doc == d).tolist():
                        x = int(cls[i])
                        if x in wanted and x not in rows and lines.n[i] >= limit.min_chars:
                            p = lines.points[lines.start[i]:lines.end[i]]
                            rows[x] = (len(p), far_vector(p.astype(np.int64) % COARSE), p.tobytes())
                if rows:
                    kinds = (pa.int64(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(rows), pa.int64()), *(
                            pa.array(x, t) for x, t in zip(zip(*rows.values(), strict=True), kinds, strict=True))],
                        ["class", "n", "far", "set"])

    return run


def line_classes(docs: DataFrame, limit: Edits = Edits(), leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, line, class, root of every compared line, and line counts), staged.

    The second table has one row per document: row, doc_id, n_lines. ``root`` names the class of
    linked lines; equal lines and lines linked in steps share one.
    """
    spark = docs.sparkSession
    importable(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text")
    listed = stage(
        texts.withColumn("row", F.monotonically_increasing_id())
        .mapInArrow(lean(_listed(limit)), f"row bigint, doc_id {kind}, line bigint, class bigint"), "lines")
    lines = listed.where("class IS NOT NULL")
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    members = members_of(texts.mapInArrow(lean(_keys(limit, buckets)), KeyBlock.SCHEMA))
    active = members.select("class").distinct()
    # one document shows each line that met another; a document shows no more lines than it has
    by = stage(lines.join(active, "class", "left_semi").groupBy("class").agg(F.min("doc_id").alias("doc_id")), "shown-by")
    shown = small(by.groupBy("doc_id").agg(F.collect_list("class").alias("classes")), by)
    items = stage(
        texts.join(shown, texts["doc_id"].eqNullSafe(shown["doc_id"])).select(texts["text"], "classes")
        .mapInArrow(lean(_contents(limit)), "class bigint, n bigint, far binary, set binary").dropDuplicates(["class"]), "line-texts")
    roots = link_regions(members, items, limit, leaf).withColumnRenamed("node", "class")
    rooted = lines.join(roots, "class", "left").select("row", "doc_id", "line", "class", F.coalesce("root", "class").alias("root"))
    return rooted, listed.where("class IS NULL").select("row", "doc_id", F.col("line").alias("n_lines"))


def repeated_lines(docs: DataFrame, limit: Edits = Edits(), leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, line, class of lines to drop, line counts by document).

    The first line of a root stays: smallest doc_id (null last), then line. Rows that repeat a
    doc_id share the fate of their equal lines at one place.
    """
    with scratch(docs.sparkSession):
        rooted, counts = line_classes(docs, limit, leaf)
        rooted = stage(rooted, "rooted-lines")
        rank = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id"), F.col("line"))
        # partial minima combine a hot line in every task before it is shuffled
        firsts = rooted.groupBy("root").agg(F.min(rank).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
        drop = rooted.join(firsts, "root").where(
            ~(F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("line") == F.col("f.line"))))
        return outlive(drop.select("row", "doc_id", "line", "class"), "repeated-lines"), outlive(counts, "line-counts")


def line_report(docs: DataFrame, limit: Edits = Edits(), leaf: int = LEAF) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, dropped_lines (their numbers, from 0).

    A line is dropped if an earlier one (by doc_id, then line) is equal or linked to it by lines
    within ``edits``. Lines below ``min_chars`` stay. A null or empty text has one empty line;
    rows that repeat a doc_id share the fate of equal lines at one place; an empty table gives
    no rows; columns other than doc_id and text are not read.
    """
    drop, counts = repeated_lines(docs, limit, leaf)
    per = drop.groupBy("row").agg(F.sort_array(F.collect_list("line")).alias("dropped_lines"))
    return counts.join(per, "row", "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("dropped_lines"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.coalesce(F.array_join(F.transform("dropped_lines", lambda x: x.cast("string")), ","), F.lit("")).alias("dropped_lines"))


def _rewrite(columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, found in zip(b.column("text").to_pylist(), b.column("__drop").to_pylist(), strict=True):
                if not found or text is None:
                    texts.append(text)
                    continue
                cls = class_of(lines_of([text])).tolist()
                gone = {d["line"] for d in found if d["line"] < len(cls) and cls[d["line"]] == d["class"]}
                kept = [x for i, x in enumerate(text.split("\n")) if i not in gone]
                texts.append("\n".join(kept) if any(x.strip() for x in kept) else None if gone else text)
            at = b.schema.get_field_index("text")
            out = [pa.array(texts, b.column("text").type) if i == at else x for i, x in enumerate(b.columns)]
            rows = pa.RecordBatch.from_arrays(out, b.schema.names)
            empty = [t is None and s is not None for t, s in zip(texts, b.column("text").to_pylist(), strict=True)]
            yield rows.filter(pa.array([not x for x in empty], pa.bool_())).select(columns)

    return run


def drop_repeated_lines(docs: DataFrame, limit: Edits = Edits(), leaf: int = LEAF) -> DataFrame:
    """``docs`` with its columns, without repeated lines; documents that consist of them go.

    Null and empty texts stay as they are. Of rows with one doc_id, those with the same line at
    the same place share its fate.
    """
    drop, _ = repeated_lines(docs, limit, leaf)
    per = drop.groupBy("doc_id").agg(F.collect_set(F.struct("line", "class")).alias("__drop")).withColumnRenamed("doc_id", "__id")
    joined = docs.join(per, docs["doc_id"].eqNullSafe(per["__id"]), "left").drop("__id")
    return joined.mapInArrow(lean(_rewrite(docs.columns)), docs.schema)
