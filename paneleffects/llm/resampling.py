"""Importance resampling towards a target: hashed word features, gains per bucket, Gumbel top draw.

A feature's bucket is its bytes' CRC-32 modulo the bucket count. The head of the vocabulary,
the words most frequent in the corpus, is broadcast with every word's exact CRC state (from
which the CRC of a longer run continues), and so are the buckets of frequent pairs of head
words. Features of the tail take their CRC directly. Both feed the same exact totals: which
words are in the head decides the cost of a lookup, never a count.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import ALNUM, Tokens, tokens_of
from .tasks import importable, outlive, scratch, stage
from .text import chunks

#: Words, and pairs of them, whose states and buckets are broadcast: a few MB.
HEAD_WORDS, HEAD_PAIRS = 1 << 16, 1 << 16
#: Bytes of text whose words are counted together before they are shuffled.
BLOCK_BYTES = 4 << 20
BUCKETS = 10_000


@dataclass
class Head:
    """Frequent words with their CRC-32 states, and buckets of frequent pairs of them."""

    words: pa.LargeStringArray
    pairs: np.ndarray  # sorted: place of the first word << 32 | place of the second
    pair_crc: np.ndarray
    states: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.states = np.array([zlib.crc32(w.encode()) for w in self.words.to_pylist()], np.int64)


def _crc_of(words: pa.Array) -> np.ndarray:
    """CRC-32 of words, each distinct one worked out once."""
    coded = words.dictionary_encode()
    own = np.array([zlib.crc32(w.encode()) for w in coded.dictionary.to_pylist()], np.int64)
    return own[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)


def run_hashes(tokens: Tokens, head: Head, longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length up to ``longest``: (CRC-32 of every run of so many words of a document, place of its first word)."""
    words, n = tokens.words, len(tokens.words)
    place = pc.index_in(words, value_set=head.words).fill_null(-1).to_numpy().astype(np.int64)
    state = np.zeros(n, np.int64)
    known = place >= 0
    state[known] = head.states[place[known]]
    state[~known] = _crc_of(words.filter(pa.array(~known)))
    out = [(state, np.arange(n))]
    end = np.repeat(tokens.first[1:], tokens.counts)
    for length in range(2, longest + 1):
        state, at = out[-1]
        on = at + length <= end[at]
        state, at = state[on], at[on]
        nxt = np.full(len(at), -1, np.int64)
        if length == 2 and len(head.pairs):
            a, b = place[at], place[at + 1]
            key = np.where((a >= 0) & (b >= 0), a << 32 | b, -1)
            to = np.minimum(np.searchsorted(head.pairs, key), len(head.pairs) - 1)
            hit = head.pairs[to] == key
            nxt[hit] = head.pair_crc[to[hit]]
        rest = np.flatnonzero(nxt < 0)
        last = [b" " + w.encode() for w in words.take(pa.array(at[rest] + length - 1)).to_pylist()]
        nxt[rest] = [zlib.crc32(w, s) for w, s in zip(last, state[rest].tolist(), strict=True)]
        out.append((nxt, at))
    return out


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, count) of the words that a block of text has more than once."""
    for b in batches:
        for c in chunks(b, limit=BLOCK_BYTES):
            counted = tokens_of(c.column("text"), ALNUM).words.value_counts()
            often = counted.filter(pc.greater(counted.field("counts"), 1))
            yield pa.RecordBatch.from_arrays([often.field("values").cast(pa.string()), often.field("counts")], ["word", "n"])


def _pair_tops(words: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(a, b, count) of neighbouring head words that a block has more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = pa.array(words, pa.large_string())
        for b in batches:
            for c in chunks(b, limit=BLOCK_BYTES):
                t = tokens_of(c.column("text"), ALNUM)
                place = pc.index_in(t.words, value_set=head).fill_null(-1).to_numpy().astype(np.int64)
                inner = ~t.cut[1:] & (place[:-1] >= 0) & (place[1:] >= 0)
                key, n = np.unique(place[:-1][inner] << 32 | place[1:][inner], return_counts=True)
                key, n = key[n > 1], n[n > 1]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["pair", "n"])

    return run


def _most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """Rows of the staged table ``counts`` with the largest n, as many as ``most`` allows by whole steps of n.

    A histogram of n decides, so no task or driver sorts the rows or gathers a task's best.
    """
    step = F.floor(4 * F.log2(F.col("n").cast("double")))
    left, lowest = most, math.inf
    for r in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # some 250 steps at most
        left -= r["count"]
        if left < 0:
            break
        lowest = r["step"]
    return counts.where(step >= lowest) if lowest < math.inf else counts.limit(0)


def find_head(texts: DataFrame, longest: int = 1, words: int = HEAD_WORDS, pairs: int = HEAD_PAIRS) -> Head:
    """The most frequent words of the whole table, and for ``longest`` above 1 their most frequent pairs.

    Blocks bring words they hold more than once; the driver gets at most ``words`` and ``pairs`` rows.
    """
    top = texts.mapInArrow(_tops, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    head = sorted(r["word"] for r in _most_frequent(stage(top, "word-counts"), words).collect())
    found, crc = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if longest > 1 and head:
        near = texts.mapInArrow(_pair_tops(head), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
        keys = sorted(r["pair"] for r in _most_frequent(stage(near, "pair-counts"), pairs).collect())
        found = np.array(keys, np.int64)
        crc = np.array([zlib.crc32(f"{head[k >> 32]} {head[k & 0xFFFFFFFF]}".encode()) for k in keys], np.int64)
    return Head(pa.array(head, pa.large_string()), found, crc)


def _totals(head: object, longest: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Feature counts per bucket of all of a task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for c in chunks(b, limit=BLOCK_BYTES):
                for crc, _ in run_hashes(tokens_of(c.column("text"), ALNUM), head.value, longest):
                    total += np.bincount(crc % buckets, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["bucket", "n"])

    return run


def bucket_totals(texts: DataFrame, head: object, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket; ``head`` is a broadcast ``Head``."""
    rows = texts.mapInArrow(_totals(head, longest, buckets), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, np.int64)
    for r in rows.collect():  # a row per bucket
        total[r["bucket"]] = r["n"]
    return total


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) for each of the B buckets."""
    b, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([
        math.floor(1000 * math.log((float(t + 1) * float(s_all + b)) / (float(s + 1) * float(t_all + b))))
        for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def _weights(head: object, gains: object, longest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = gains.value
        for b in batches:
            for c in chunks(b, limit=BLOCK_BYTES):
                tokens = tokens_of(c.column("text"), ALNUM)
                doc = np.repeat(np.arange(c.num_rows), tokens.counts)
                n, weight = np.zeros(c.num_rows, np.int64), np.zeros(c.num_rows, np.int64)
                for crc, at in run_hashes(tokens, head.value, longest):
                    n += np.bincount(doc[at], minlength=c.num_rows)
                    np.add.at(weight, doc[at], gain[crc % len(gain)])
                yield pa.RecordBatch.from_arrays(
                    [c.column("doc_id"), pa.array(tokens.counts), pa.array(n), pa.array(weight)],
                    ["doc_id", "n_words", "n_features", "weight"])

    return run


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln(u))), u from the first 8 hex digits of sha256(``seed:doc_id``); a null id is empty text."""
    told = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(told.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _ranked(rows: DataFrame, drawn: int) -> DataFrame:
    """The ``drawn`` first rows by score and doc_id, with their rank from 1; no task holds them all.

    Ranges of the order are numbered each by itself; a table of ranges, one row a task, has
    where each begins.
    """
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.desc("n_features")]
    ranged = stage(
        rows.repartitionByRange(*order).sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("id")), "ordered")
    runs = ranged.groupBy("run").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")).selectExpr(
        "run", "coalesce(sum(n) OVER (ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - low + 1 AS base")
    numbered = ranged.join(F.broadcast(runs), "run").withColumn("rank", F.col("id") + F.col("base"))
    return numbered.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))


def resample(
        docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, percent: int = 10,
        least_words: int = 20, seed: int = 2024) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank.

    Features are runs of 1 to ``longest`` words; null and empty texts have none and weight 0.
    Of the documents of at least ``least_words`` words the floor(percent * N / 100) with the
    highest scores are drawn and get ranks from 1; ties go to the smaller doc_id (null last),
    then the larger weight. Repeated rows are documents of their own. An empty table gives no
    rows, an empty target counts no features. Other columns are not read.

    The whole tables are read three times (head, totals, weights). The driver holds the head
    and two numbers a bucket.
    """
    spark = docs.sparkSession
    importable(spark)
    texts, wanted = docs.select("text"), target.select("text")
    with scratch(spark):
        head = spark.sparkContext.broadcast(find_head(texts, longest))
        gains = spark.sparkContext.broadcast(bucket_gains(
            bucket_totals(texts, head, longest, buckets), bucket_totals(wanted, head, longest, buckets)))
        kind = docs.schema["doc_id"].dataType.simpleString()
        scored = stage(
            docs.select("doc_id", "text")
            .mapInArrow(_weights(head, gains, longest), f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")
            .withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "weights")
        long = scored.where(F.col("n_words") >= least_words)
        drawn = long.count() * percent // 100
        columns = ["doc_id", "n_features", "weight", "score", "rank"]
        rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
        return outlive(_ranked(long, drawn).select(columns).union(rest.select(columns)), "resampled")


#: CRC-32 (reflected polynomial EDB88320) of words in SQL, by a table made from its rule.
SQL = r"""
WITH RECURSIVE step(i, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
texts AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text, true AS own FROM documents
  UNION ALL SELECT NULL, NULL, coalesce(text, ''), false FROM benchmark),
listed AS (
  SELECT doc_id, r, own, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM texts),
word_counts AS (SELECT r, own, unnest(words) AS word FROM listed),
per_doc AS (SELECT r, own, word, count(*) AS n FROM word_counts GROUP BY ALL),
hashed AS (
  SELECT word, xor(4294967295, list_reduce(
      list_concat([4294967295::BIGINT], list_transform(range(0, octet_length(encode(word)) * 2, 2),
        lambda p: ('0x' || substr(hex(encode(word)), p + 1, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, t[((xor(c, b)) & 255) + 1]))) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM per_doc), crc_table),
totals AS (
  SELECT bucket, sum(n) FILTER (WHERE own) AS s, sum(n) FILTER (WHERE NOT own) AS t
  FROM per_doc JOIN hashed USING (word) GROUP BY bucket),
whole AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM totals),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000))
                                      / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + 10000)))) AS BIGINT) AS gain
  FROM totals, whole),
weights AS (
  SELECT r, CAST(sum(n * gain) AS BIGINT) AS weight FROM per_doc JOIN hashed USING (word) JOIN gains USING (bucket)
  WHERE own GROUP BY r),
scored AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
           (('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5::DOUBLE)
           / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM listed LEFT JOIN weights USING (r) WHERE own),
ranked AS (
  SELECT *, n_features >= 20 AS long, row_number() OVER (
           PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, weight DESC, n_features DESC) AS place,
         count(*) FILTER (WHERE n_features >= 20) OVER () AS n_long
  FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN long AND place <= 10 * n_long // 100 THEN place END AS rank
FROM ranked
"""
