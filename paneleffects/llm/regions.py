"""Regions of items that share a key, joined within: pivots, Voronoi cells, triangle windows.

Shared by the joins whose pairs lie within a small distance: a ``Metric`` says how far a pair
may be, ``far`` vectors (distances to fixed pivots) give a lower bound by their L1 distance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .packed import pack, pack_sorted, unpack, unpack_sorted
from .tasks import BROADCAST_ROWS, gathered, lean, rows_of, small, stage
from .text import mix

#: Keys a task gathers before it combines them.
BLOCK_KEYS = 1 << 21
#: Items of a cell that are compared in one task, and pivots of a division.
LEAF, PIVOTS = 2048, 8
#: Pairs a task holds back to put equal ones together.
SEND_PAIRS = 1 << 18
#: Items whose sizes and ``far`` vectors may be broadcast, and regions an item lists for its pairs.
FAR_ROWS, LISTED = 50_000, 16
#: Entries of a ``far`` vector: a part's count, at most 255, which can only lower a distance.
COARSE = 128


def far_vector(parts: np.ndarray) -> bytes:
    """Distances to the fixed pivots: how many elements fall into each part (from 0 to ``COARSE`` - 1)."""
    return np.minimum(np.bincount(parts, minlength=COARSE), 255).astype(np.uint8).tobytes()


class Metric(Protocol):
    def bound(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The largest distance of linked items of sizes x and y, in the measure of ``far``."""

    def sizes_fit(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether items of these sizes can be linked."""

    def highest(self, n: np.ndarray) -> np.ndarray:
        """The largest size a partner can have."""

    def linked(self, x: bytes, y: bytes) -> bool:
        """The exact test."""


class KeyBlock:
    """Keys of a task, combined before they are shuffled.

    Of the items that share a key in a block only the smallest goes on to meet the other
    blocks; the others are members of its region already. A hot key brings one entry a block.
    ``index`` marks keys of the indexed side; smallest items that meet no such key are let go.
    """

    SCHEMA = "bucket int, member boolean, keys binary, items binary, names binary, kinds binary"

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets
        self.clear()

    def clear(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, items: np.ndarray, index: np.ndarray) -> Iterator[pa.RecordBatch]:
        # 56 bits: two keys that fall together only add a pair to test
        self.parts.append((keys >> np.uint64(8), items, index))
        self.held += len(keys)
        if self.held > BLOCK_KEYS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        key, item, index = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.clear()
        order = np.lexsort((~index, item, key))
        key, item, index = key[order], item[order], index[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (item[1:] != item[:-1])]
        key, item, index = key[new], item[new], index[new]
        lead = np.r_[True, key[1:] != key[:-1]]
        many = ~lead | ~np.r_[lead[1:], True]
        any_index = np.maximum.reduceat(index, np.flatnonzero(lead))[np.cumsum(lead) - 1]
        # bits: has company already, its group has an indexed item
        kind = (many * 1 + any_index * 2).astype(np.uint8)
        rows = []
        # ranges of keys for those who meet others; members are spread, so a hot key makes no hot bucket
        range_of = ((key >> np.uint64(24)) * np.uint64(self.buckets)) >> np.uint64(32)
        spread = mix(key ^ item.view(np.uint64)) % np.uint64(self.buckets)
        for member, on, bucket in ((False, lead, range_of), (True, ~lead, spread)):
            order = np.argsort(bucket[on], kind="stable")
            k, c, d, b = (x[on][order] for x in (key, item, kind, bucket))
            ends = np.searchsorted(b, np.arange(self.buckets + 1))
            for n, (x, y) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                if y > x:
                    names, at = np.unique(c[x:y], return_inverse=True)
                    rows.append((n, member, pack_sorted(k[x:y]), pack(at.astype(np.uint32)), names.tobytes(), pack(d[x:y])))
        kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
            ["bucket", "member", "keys", "items", "names", "kinds"])


def _read(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    items = [np.frombuffer(r["names"], np.int64)[unpack(r["items"], np.uint32)] for r in rows]
    return (np.concatenate([unpack_sorted(r["keys"]) for r in rows]), np.concatenate(items),
            np.concatenate([unpack(r["kinds"], np.uint8) for r in rows]))


def _meet(table: pa.Table) -> pa.Table:
    """Members (key, class) of the keys of one bucket that several items have."""
    rows = table.to_pylist()
    key, item, _ = _read([r for r in rows if r["member"]])
    k, c, d = _read([r for r in rows if not r["member"]])
    order = np.lexsort((c, k))
    k, c, d = k[order], c[order], d[order]
    out_k, out_c = [key], [item]
    if len(k):
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        any_of = np.bitwise_or.reduceat(d, starts)
        shared = (np.maximum.reduceat(c, starts) != np.minimum.reduceat(c, starts)) | (any_of & 1 > 0)
        on = np.repeat(shared & (any_of & 2 > 0), np.diff(np.r_[starts, len(k)]))
        out_k.append(k[on])
        out_c.append(c[on])
    return pa.table({"key": np.concatenate(out_k).view(np.int64), "class": np.concatenate(out_c)})


def members_of(keyed: DataFrame) -> DataFrame:
    """Staged members (key, class, a) of regions, from blocks of keys; ``a`` is the region's smallest item.

    Items that are near each other share many keys. Of regions with the same members one key
    is kept: members are the same if their number, smallest, largest and the exclusive-or of
    the items and of two hashes of them are.
    """
    met = stage(keyed.groupBy("bucket").applyInArrow(_meet, "key bigint, class bigint").distinct(), "regions")
    item = F.col("class")
    seen = met.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min(item).alias("a"), F.max(item).alias("z"), F.bit_xor(item).alias("x"),
        F.bit_xor(F.xxhash64(item)).alias("h"), F.bit_xor(F.xxhash64(item, F.lit(1))).alias("g"))
    kept = seen.where("n > 1").groupBy("n", "a", "z", "x", "h", "g").agg(F.min("key").alias("key")).select("key", "a")
    return stage(met.join(kept, "key"), "regions")


def _far(blobs: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A row of small counts each; two bytes, so that differences have their sign."""
    if not len(blobs):
        return np.zeros((0, COARSE), np.int16)
    return np.frombuffer(b"".join(blobs.to_pylist()), np.uint8).reshape(-1, COARSE).astype(np.int16)


def _possible(metric: Metric) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs that their sizes and their distances to the fixed pivots allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column("n").to_numpy(), b.column("m").to_numpy()
            ok = metric.sizes_fit(x, y)
            near = np.abs(_far(b.column("far")) - _far(b.column("far_b"))).sum(axis=1)
            ok &= near <= metric.bound(x, y)
            yield b.select(["a", "b"]).filter(pa.array(ok))

    return run


def _verify(metric: Metric) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [metric.linked(x.as_py(), y.as_py()) for x, y in zip(b.column("set"), b.column("set_b"), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _before(lists: pa.ChunkedArray, key: int) -> list[set[int]]:
    """Of each item's listed regions those before ``key``."""
    return [{x for x in listed if x < key} for listed in lists.to_pylist()]


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal ``keys`` of sorted batches, as tables of bounded groups."""
    rest: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
        if not t.num_rows:
            continue
        change = np.zeros(t.num_rows - 1, bool)
        for k in keys:
            v = t[k].to_numpy()
            change |= v[1:] != v[:-1]
        cut = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, z in zip(cut[:-1], cut[1:], strict=True):
            yield t.slice(a, z - a)
        rest = t.slice(cut[-1])
    if rest is not None and rest.num_rows:
        yield rest


def _leaf(metric: Metric) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cross-component pairs of each cell or tile pair that sizes and distance bounds allow.

    Pairs that meet in several of a task's regions are put together before they are sent on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for pairs in near(batches):
            held.append(pairs)
            size += pairs.shape[1]
            if size > SEND_PAIRS:
                held = [np.unique(np.concatenate(held, axis=1), axis=1)]
                size = held[0].shape[1]
                if size > SEND_PAIRS // 2:  # else there was much to put together: go on
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], ["a", "b"])
                    held, size = [], 0
        if held:
            pairs = np.unique(np.concatenate(held, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for t in runs(batches, ["key", "cell", "tile"]):
            order = np.argsort(t["n"].to_numpy(), kind="stable")
            t = t.take(pa.array(order))
            n, cls, root, side = (t[c].to_numpy() for c in ("n", "class", "root", "side"))
            if root.min() == root.max():
                continue
            far, first = _far(t["far"]), _before(t["first"], int(t["key"][0].as_py()))
            to_pivot = np.abs(far - far[0]).sum(axis=1)
            found = []
            top = np.searchsorted(n, metric.highest(n), side="right")
            for i in range(len(n)):
                j = np.arange(i + 1, top[i])
                j = j[(root[j] != root[i]) & ((side[j] != side[i]) | (side[j] == 0))]
                most = metric.bound(n[i], n[j])
                j = j[np.abs(to_pivot[j] - to_pivot[i]) <= most]  # triangle inequality at the first pivot
                j = j[np.abs(far[j] - far[i]).sum(axis=1) <= metric.bound(n[i], n[j])]
                # a region before this one that both list has the pair too
                j = j[np.array([first[i].isdisjoint(first[k]) for k in j.tolist()], bool)]
                if len(j):
                    found.append(np.stack([np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j])]))
            if found:
                yield np.concatenate(found, axis=1)

    return run


def _cells(metric: Metric) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each class to its nearest pivot's cell and to the cells its window reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far, n = _far(b.column("far")), b.column("n").to_numpy()
            take, cells = [], []
            for i, pivots in enumerate(b.column("pivots").to_pylist()):
                d = np.abs(np.frombuffer(b"".join(pivots), np.uint8).reshape(-1, COARSE).astype(np.int16) - far[i]).sum(axis=1)
                # a partner within r of x has its nearest pivot at most 2 r farther from x than x's own
                reach = np.flatnonzero(d <= d.min() + 2 * metric.bound(n[i], metric.highest(n[i])))
                take += [i] * len(reach)
                cells += reach.tolist()
            out = b.select(["key", "class", "root", "n", "far", "first", "cell", "size"]).take(pa.array(take, pa.int64()))
            parent = out.column("cell").to_numpy().view(np.uint64)
            cell = mix(parent * np.uint64(PIVOTS) + np.array(cells, np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*out.columns, pa.array(cell, pa.int64())],
                ["key", "class", "root", "n", "far", "first", "parent", "size", "cell"])

    return run


_ROW = "key bigint, class bigint, root bigint, n bigint, far binary, first array<bigint>, parent bigint, size bigint, cell bigint"


def _tiles(large: DataFrame, leaf: int) -> DataFrame:
    """Rows of cells that no pivot divides, for each pair of tiles of bounded size."""
    t = large.withColumn("tiles", F.ceil(F.col("size") / leaf)).withColumn(
        "own", F.pmod(F.xxhash64("class"), F.col("tiles")))
    t = t.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)))
    return t.selectExpr(
        "key", "class", "root", "n", "far", "first", "cell", "least(own, other) * tiles + greatest(own, other) AS tile",
        "CASE WHEN own = other THEN 0 WHEN own < other THEN 1 ELSE 2 END AS side")


def _cross_pairs(rows: DataFrame, metric: Metric, leaf: int) -> DataFrame:
    """Pairs of different components within regions (key), by Voronoi division of large ones.

    A division counts if it at least halves the pairs left to test; else the cell is tiled.
    """
    groups: list[DataFrame] = []
    cells = rows
    while True:
        sizes = cells.groupBy("key", "cell").agg(
            F.count(F.lit(1)).alias("size"), F.min("root").alias("low"), F.max("root").alias("high"))
        sized = cells.join(sizes.where("low != high").select("key", "cell", "size"), ["key", "cell"])
        small = sized.where(F.col("size") <= leaf)
        groups.append(small.selectExpr(
            "key", "class", "root", "n", "far", "first", "cell", "CAST(0 AS bigint) AS tile", "0 AS side"))
        large = sized.where(F.col("size") > leaf)
        if not large.limit(1).count():
            break
        large = stage(large, "large-cells")
        ranked = large.select("key", "cell", F.struct(F.xxhash64("class", "cell").alias("h"), "far").alias("p"))
        chosen = ranked.groupBy("key", "cell", F.pmod(F.col("p.h"), F.lit(PIVOTS)).alias("k")).agg(F.min("p").alias("p"))
        pivots = chosen.groupBy("key", "cell").agg(F.transform(F.collect_list("p"), lambda p: p["far"]).alias("pivots"))
        split = stage(
            large.join(pivots, ["key", "cell"]).select("key", "class", "root", "n", "far", "first", "cell", "size", "pivots")
            .mapInArrow(lean(_cells(metric)), _ROW), "cells")
        left = split.groupBy("key", "parent", "size", "cell").agg(F.count(F.lit(1)).cast("double").alias("c")).groupBy(
            "key", "parent", "size").agg(F.sum(F.col("c") * F.col("c")).alias("work"))
        better = left.where("work <= 0.5 * size * size").selectExpr("key", "parent")
        groups.append(_tiles(large.join(better.withColumnRenamed("parent", "cell"), ["key", "cell"], "left_anti"), leaf))
        cells = split.join(better, ["key", "parent"]).select("key", "class", "root", "n", "far", "first", "cell")
    every = groups[0]
    for g in groups[1:]:
        every = every.union(g)
    dealt = every.repartition("key", "cell", "tile").sortWithinPartitions("key", "cell", "tile")
    return dealt.mapInArrow(lean(_leaf(metric)), "a bigint, b bigint").distinct()


def link_regions(members: DataFrame, items: DataFrame, metric: Metric, leaf: int = LEAF) -> DataFrame:
    """Components (node, root) of linked items, from members (key, class, a) and items (class, n, far, set).

    Every region's smallest item is its pivot and meets all others. An item meets the pivot
    it shares most regions with first; its other pivots only where components still differ.
    Pairs across components in regions of more than two follow by cells. Distances to the
    fixed pivots are attached only to pairs and regions that are still open.
    """
    light = items.select("class", "n", "far")
    few = rows_of(items, FAR_ROWS) <= FAR_ROWS

    def thin(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df

    def linked(pairs: DataFrame, label: str, rows: int) -> DataFrame:
        near = (
            pairs.select("a", "b").join(thin(light.withColumnRenamed("class", "a")), "a")
            .join(thin(light.selectExpr("class AS b", "n AS m", "far AS far_b")), "b")
            .mapInArrow(lean(_possible(metric)), "a bigint, b bigint"))
        return verified(gathered(near, rows), label)

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        """The linked ones of ``pairs``; only the sets of items that some pair names are shuffled."""
        near = stage(pairs, f"{label}-near")
        x = items.select(F.col("class").alias("a"), "set")
        y = items.select(F.col("class").alias("b"), F.col("set").alias("set_b"))
        rows = rows_of(near)
        if rows <= BROADCAST_ROWS:
            both = x.join(F.broadcast(near), "a").join(y.join(F.broadcast(near.select("b")), "b", "left_semi"), "b")
        else:
            named = small(stage(near.select("a").union(near.select("b")).distinct(), f"{label}-items"))
            both = (
                near.join(x.join(named, "a", "left_semi"), "a")
                .join(y.join(named.withColumnRenamed("a", "b"), "b", "left_semi"), "b"))
        both = gathered(both.select("a", "b", "set", "set_b"), rows)
        return stage(both.mapInArrow(lean(_verify(metric)), "a bigint, b bigint"), label)

    def root_of(rows: DataFrame, roots: DataFrame, node: str, root: str) -> DataFrame:
        of = small(roots.select(F.col("node").alias(node), F.col("root").alias(root)), roots)
        return rows.join(of, node, "left").withColumn(root, F.coalesce(root, node))

    star = stage(
        members.where("class != a").groupBy("a", F.col("class").alias("b")).agg(F.count(F.lit(1)).alias("shared")), "star")
    met = rows_of(star)
    first = stage(gathered(star.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a")), met), "first-pivots")
    links = linked(first, "pivot-links", met)
    roots = components(links)
    others = star.join(first.withColumnRenamed("a", "tried"), "b").where("a != tried").select("a", "b")
    others = linked(
        root_of(root_of(others, roots, "a", "root_a"), roots, "b", "root_b").where("root_a != root_b"), "more-links", met)
    if others.limit(1).count():
        links = links.union(others)
        roots = components(links)
    rooted = stage(root_of(members.select("key", "class"), roots, "class", "root"), "rooted")
    mixed = rooted.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.min("root").alias("low"), F.max("root").alias("high")).where(
        "size > 2 AND low != high")
    held = stage(rooted.join(mixed.select("key"), "key"), "open-regions")
    # of an item's open regions the first few in order; a pair is put out in the first that both list
    listed = held.groupBy("class").agg(
        F.slice(F.sort_array(F.collect_set("key")), 1, LISTED).alias("first"))
    open_rows = (
        held.join(listed, "class").join(thin(light), "class")
        .select("key", "class", "root", "n", "far", "first", F.lit(0).cast("bigint").alias("cell")))
    more = verified(_cross_pairs(stage(open_rows, "open-rows"), metric, leaf), "cell-links")
    return components(links.union(more)) if more.limit(1).count() else roots
