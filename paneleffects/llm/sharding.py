"""Jump consistent hashing (Lamping and Veach, 2014): keys to shards without a ring table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tasks import importable, stage

#: Multiplier of the published generator.
LCG = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of every unsigned 64-bit key; from n to n + 1 shards keys only move into shard n."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    key = keys.astype(np.uint64, copy=True)
    shard, nxt = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        shard[live] = nxt[live]
        key[live] = key[live] * LCG + np.uint64(1)
        step = (shard[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)) + np.uint64(1)).astype(float))
        nxt[live] = step.astype(np.int64)
        live = live[nxt[live] < shards]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a bigint key; null counts as key 0. Other stable keys: pass ``xxhash64(key)``."""

    @F.pandas_udf("int")
    def shard(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return shard(F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint")))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition and the place of each row within its shard; rows come sorted by shard."""
    part, last, n = TaskContext.get().partitionId(), -1, 0
    for b in batches:
        shard = b.column("shard").to_numpy(zero_copy_only=False)
        if not len(shard):
            continue
        at = np.arange(len(shard))
        new = np.r_[shard[0] != last, shard[1:] != shard[:-1]]
        begin = np.maximum.accumulate(np.where(new, at, -1))
        place = np.where(begin < 0, at + n, at - begin)
        last, n = shard[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array(np.full(len(at), part, np.int32)), pa.array(place.astype(np.int64))],
            [*b.schema.names, "part", "place"])


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``key``: doc_id and the shard count decide. ``size`` is the text's UTF-8
    bytes (null: none) plus 1; ``slot`` numbers a shard's rows from 0 by doc_id, then
    checksum and size; ``grown_shard`` is the shard with one shard more. A null doc_id is
    key 0; repeated rows get slots of their own; an empty table gives no rows; other columns
    of ``docs`` are not read.

    Slots come from ranges of doc_id: each task numbers its own rows, and a table of
    partitions x shards counts holds the offsets, so no shard passes through one task.
    """
    importable(docs.sparkSession)
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.repartitionByRange("doc_id", "text_crc32", "size").select(
        "*", shard_of(F.col("doc_id"), shards).alias("shard"), shard_of(F.col("doc_id"), shards + 1).alias("grown_shard"))
    rows = rows.sortWithinPartitions("shard", "doc_id", "text_crc32", "size")
    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = stage(rows.mapInArrow(
        _numbered, f"doc_id {kind}, size bigint, text_crc32 bigint, shard int, grown_shard int, part int, place bigint"),
        "shards")
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.selectExpr(
        "shard", "part",
        "coalesce(sum(n) OVER (PARTITION BY shard ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
        " AS before")
    # one row per shard and partition of the sort: bounded by the partition count
    return placed.join(F.broadcast(before), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("before") + F.col("place")).alias("slot"), "grown_shard")
