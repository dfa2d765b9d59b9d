"""Exact deduplication by skew-safe combining, comparing full content at every stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most partial groups a digest can have after the salted stage.
SALTS = 16


def content_of(text: Column) -> Column:
    """The text without ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def exact_classes(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per distinct content: text_sha256, keep_id, keep_points, group_size.

    Every task first combines its own equal texts (the partial aggregate), then the partial
    groups meet by digest, salt and full content, then at most ``salts`` winners of a digest
    meet by digest and full content. A hot text therefore reaches the last stage as a few
    rows. The winner has the most code points in its original text, then the smallest
    doc_id (a null id comes last). Two different contents with one digest raise an error.
    """
    rows = docs.select(
        F.struct(
            F.char_length(F.coalesce("text", F.lit(""))).alias("points"),
            F.bitwise_not(F.col("doc_id").cast("bigint")).alias("id"),
        ).alias("rank"),
        content_of(F.col("text")).alias("content"),
        F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"),
    ).withColumn("digest", F.unhex(F.sha2("content", 256)))
    salted = rows.groupBy("digest", "salt", "content").agg(
        F.max("rank").alias("rank"), F.count(F.lit(1)).alias("n"))
    whole = salted.repartition("digest").groupBy("digest", "content").agg(
        F.max("rank").alias("rank"), F.sum("n").alias("n"))
    one = whole.groupBy("digest").agg(
        F.max("rank").alias("rank"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("contents"))
    return one.select(
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.bitwise_not("rank.id").alias("keep_id"),
        F.col("rank.points").alias("keep_points"),
        F.col("n").alias("group_size"),
    ).where("contents = 1 OR raise_error('two contents share a SHA-256 digest') IS NULL")


def exact_dedup(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null and blank texts are one group of the empty content. Rows that repeat a doc_id are
    rows of their own; only those as long as the winner can carry ``kept``, so of one doc_id
    with several originals the longest does, and of full repeats of the winner all do. An empty table
    gives no rows, and other columns of ``docs`` are not read.
    """
    rows = docs.select(
        "doc_id", F.char_length(F.coalesce("text", F.lit(""))).alias("points"),
        F.sha2(content_of(F.col("text")), 256).alias("text_sha256"))
    return rows.join(exact_classes(docs, salts), "text_sha256").select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points"))).alias("kept"),
        "text_sha256")


SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AND points = first_value(points) OVER w AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
