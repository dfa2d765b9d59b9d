"""Exact Jaccard self-join of documents on word shingles, as a metric-space join.

The join works in the symmetric-difference metric, where Jaccard >= t is a distance bound
``|x ^ y| <= (1 - t) / (1 + t) * (|x| + |y|)``:

1. Rings. The empty set is the first pivot: distance to it is the set size. Rings of sizes
   are regions, and the triangle inequality replicates each document into one more ring.
2. Neighbourhoods. In a ring the universe of shingles is cut into one part more than the
   distance bound, so a pair within it agrees on a whole part. Documents that agree on a
   part form a region; unrelated documents meet in none. Parts without shingles tell
   nothing: a document with more other parts than its distance bound agrees with every
   partner on one of those, and only documents with fewer keep their empty parts.
3. Pivots. Every region takes its smallest class as pivot; all its classes are measured
   against it, which links most near copies and makes components.
4. Voronoi cells. Regions still holding several components choose more pivots; classes go to
   the nearest one's cell, and triangle-inequality windows replicate boundary classes.
   Large cells divide again; cells of bounded size, or tiles of cells that no pivot divides,
   test their cross-component pairs.
5. Distances to fixed pivots (the parts of a coarse cut of the universe) give a lower bound
   on every distance; only pairs within it are verified on the whole shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .regions import COARSE, LEAF, KeyBlock, far_vector, link_regions, members_of
from .tasks import importable, lean, outlive, scratch, small, stage
from .text import chunks, mix, shingles_of, words_of


@dataclass(frozen=True)
class Limit:
    """Shingle width and the Jaccard limit ``num / den``."""

    width: int = 3
    num: int = 90
    den: int = 100

    def rings(self) -> tuple[np.ndarray, np.ndarray]:
        """(smallest size, number of parts) of each ring; pairs meet in the lower one's ring.

        Beyond one part more than the bound there are as many as are likely to be empty.
        """
        low, parts, at = [], [], 1
        while at < 1 << 40:
            high = at * self.den // self.num
            low.append(at)
            m = (self.den - self.num) * (high + high * self.den // self.num) // (self.den + self.num) + 1
            idle = m * math.exp(-high / m)
            parts.append(m + int(idle + 2 * math.sqrt(idle)))
            at = high + 1
        return np.array(low), np.array(parts)

    def bound(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The largest symmetric difference of linked sets of these sizes."""
        return (self.den - self.num) * (x + y) // (self.den + self.num)

    def highest(self, n: np.ndarray) -> np.ndarray:
        return n * self.den // self.num

    def sizes_fit(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.minimum(x, y) * self.den >= np.maximum(x, y) * self.num

    def linked(self, x: bytes, y: bytes) -> bool:
        a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        common = len(np.intersect1d(a, b, assume_unique=True))
        return self.den * common >= self.num * (len(a) + len(b) - common)


def _sets(chunk: pa.RecordBatch, width: int) -> list[np.ndarray]:
    shingles, doc = shingles_of(words_of(chunk.column("text")), width)
    cut = np.searchsorted(doc, np.arange(chunk.num_rows + 1))
    return [np.unique(shingles[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _class_of(s: np.ndarray) -> int:
    """A 64-bit fingerprint of a set; documents with equal sets are one class."""
    return int((mix(s ^ np.uint64(0xA5A5A5A5DEADBEEF)).sum(dtype=np.uint64) + np.uint64(len(s))).view(np.int64))


def _describe(limit: Limit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b):
                sets = _sets(c, limit.width)
                yield pa.RecordBatch.from_arrays(
                    [c.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([_class_of(s) for s in sets], pa.int64())], ["doc_id", "n_shingles", "class"])

    return run


def _keys(limit: Limit, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Ring and part keys of every set."""
    low, parts = limit.rings()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = KeyBlock(buckets)
        for b in batches:
            for c in chunks(b):
                sets = [s for s in _sets(c, limit.width) if len(s)]
                if not sets:
                    continue
                n = np.array([len(s) for s in sets])
                cls = np.array([_class_of(s) for s in sets], np.int64)
                flat = np.concatenate(sets)
                ring = np.searchsorted(low, n, side="right") - 1
                # the largest distance to a partner: above in the own ring, below in the ring before
                for k, most in ((ring, limit.bound(n, limit.highest(n))), (ring - 1, limit.bound(low[ring] - 1, n))):
                    m = np.where(k >= 0, parts[np.maximum(k, 0)], 0)
                    at = np.cumsum(m) - m
                    on = np.repeat(k >= 0, n)
                    slot = flat[on] % np.repeat(np.maximum(m, 1), n)[on].astype(np.uint64)
                    acc = np.zeros(int(m.sum()), np.uint64)
                    np.add.at(acc, np.repeat(at, n)[on] + slot.astype(np.int64), mix(flat[on]))
                    doc = np.repeat(np.arange(len(n)), m)
                    filled = np.zeros(len(acc), bool)
                    filled[np.repeat(at, n)[on] + slot.astype(np.int64)] = True
                    enough = np.bincount(doc, filled, len(n)) > most
                    part = (np.arange(len(acc)) - at[doc]).astype(np.uint64)
                    key = mix(acc ^ mix(part * np.uint64(1 << 20) + k[doc].astype(np.uint64)))
                    told = filled | ~enough[doc]
                    key, doc = key[told], doc[told]
                    yield from block.add(key, cls[doc], np.ones(len(key), bool))
        yield from block.flush()

    return run


def _arrays(limit: Limit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b):
                want = c.column("class").to_numpy()
                rows = []
                for s, k in zip(_sets(c, limit.width), want, strict=True):
                    if _class_of(s) == k:  # else another row with this doc_id
                        far = far_vector((mix(s + np.uint64(7)) % np.uint64(COARSE)).astype(np.int64))
                        rows.append((int(k), len(s), far, s.tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t) for x, t in zip(
                            zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)],
                        ["class", "n", "far", "set"])

    return run


def jaccard_links(docs: DataFrame, limit: Limit = Limit(), leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """(documents with n_shingles and class, components of linked classes as node and root)."""
    spark = docs.sparkSession
    importable(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text")
    known = stage(texts.mapInArrow(lean(_describe(limit)), f"doc_id {kind}, n_shingles bigint, class bigint"), "sets")

    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    members = members_of(texts.mapInArrow(lean(_keys(limit, buckets)), KeyBlock.SCHEMA))

    active = members.select("class").distinct()
    first = small(stage(
        known.join(active, "class", "left_semi").groupBy("class").agg(F.min("doc_id").alias("doc_id")), "shown-by"))
    sets = stage(
        texts.join(first, texts["doc_id"].eqNullSafe(first["doc_id"])).select(texts["text"], first["class"])
        .mapInArrow(lean(_arrays(limit)), "class bigint, n bigint, far binary, set binary").dropDuplicates(["class"]),
        "active-sets")
    return known, link_regions(members, sets, limit, leaf)


def jaccard_components(docs: DataFrame, limit: Limit = Limit(), leaf: int = LEAF) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Null, empty and blank texts have no shingles and stay alone. Documents with fewer words
    than the width are one shingle. Repeated rows are in one component; a null doc_id is never
    a component's id unless all its documents lack one. An empty table gives no rows; columns
    other than doc_id and text are not read.
    """
    with scratch(docs.sparkSession):
        known, roots = jaccard_links(docs, limit, leaf)
        rooted = known.where("n_shingles > 0").join(
            roots.select(F.col("node").alias("class"), "root"), "class", "left").select(
            "doc_id", "n_shingles", F.coalesce("root", "class").alias("root"))
        smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        alone = known.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        return outlive(
            rooted.join(smallest, "root").select("doc_id", "n_shingles", "component_id").union(alone), "components")


def _tagged(limit: Limit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b):
                cls = pa.array([_class_of(s) for s in _sets(c, limit.width)], pa.int64())
                yield pa.RecordBatch.from_arrays([*c.columns, cls], [*c.schema.names, "__class"])

    return run


def keep_one(docs: DataFrame, limit: Limit = Limit(), leaf: int = LEAF) -> DataFrame:
    """``docs`` with one row of each group of linked documents: the smallest doc_id (null last).

    Rows are judged by doc_id and set of shingles: rows that share a doc_id but not their words
    are documents of their own, and of equal rows one stays. Texts without words all stay.
    """
    with scratch(docs.sparkSession):
        known, roots = jaccard_links(docs, limit, leaf)
        rows = known.where("n_shingles > 0").groupBy("doc_id", "class").agg(F.count(F.lit(1)).alias("times")).join(
            roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
        rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("class").alias("cls"))
        first = rows.groupBy("root").agg(F.min(rank).alias("first"), F.sum("times").alias("rows")).where(F.col("rows") > 1)
        judged = rows.join(first, "root").select(
            F.col("doc_id").alias("__id"), F.col("class").alias("__of"), "times",
            (F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("class") == F.col("first.cls"))).alias("stays"))
        judged = outlive(judged.where("NOT stays OR times > 1"), "judged")
    tagged = docs.mapInArrow(lean(_tagged(limit)), docs.select("*", F.lit(0).cast("bigint").alias("__class")).schema)
    of = small(judged)
    same = tagged["doc_id"].eqNullSafe(of["__id"]) & (tagged["__class"] == of["__of"])
    kept = tagged.join(of, same, "left_anti").select(docs.columns)
    again = judged.where("stays")
    if not again.limit(1).count():
        return kept
    some = small(again)
    repeats = tagged.join(some, tagged["doc_id"].eqNullSafe(some["__id"]) & (tagged["__class"] == some["__of"]), "left_semi")
    return kept.union(repeats.dropDuplicates(["doc_id", "__class"]).select(docs.columns))
