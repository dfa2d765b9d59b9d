"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tasks import outlive, scratch, small, stage

WINDOW, SHINGLE = 10, 3
#: Benchmark tables up to this many rows are broadcast (about 60 bytes a row); larger ones
#: take shuffle joins, which give the same rows.
BROADCAST_ROWS = 500_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; none for null."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lowered, NOT_WORD), "")


def _shingles(words: str, width: str) -> str:
    """SQL: structs (pos, shingle) of every ``width`` consecutive words of an array."""
    pieces = ", ".join(f"get({words}, i + {k})" for k in range(SHINGLE))
    return (f"transform(sequence(0, size({words}) - {width}), "
            f"i -> struct(i AS pos, concat_ws(' ', {pieces}) AS shingle))")


def _shared(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def windows_of(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct item windows (window_id, length, shingles) and the items that hold them.

    An item of fewer than ``window`` words, but not none, is one window.
    """
    held = items.select("item_id", words_of(F.col("text")).alias("words")).where("size(words) > 0")
    every = held.selectExpr(
        "item_id", f"least({window}, size(words)) AS length",
        f"explode(transform(sequence(0, greatest(size(words) - {window}, 0)), "
        f"i -> slice(words, i + 1, {window}))) AS words")
    of_item = every.selectExpr("item_id", "concat_ws(' ', words) AS window_id").distinct()
    distinct = every.dropDuplicates(["words"]).selectExpr(
        "concat_ws(' ', words) AS window_id", "length",
        f"CASE WHEN length >= {SHINGLE} THEN {_shingles('words', str(SHINGLE))} "
        f"ELSE array(struct(0 AS pos, concat_ws(' ', words) AS shingle)) END AS shingles")
    return distinct, of_item


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A document word inside any occurrence of an item window is hit. Null and empty texts have
    no words; items without words have no windows; repeated rows are documents of their own;
    an empty benchmark hits nothing; columns besides doc_id, item_id and text are not read.

    1. One scan turns documents into positioned shingles and keeps those that some window has.
    2. The kept rows give every shingle's frequency; a window's prefix is its rarest shingle.
       For whole containment one prefix shingle suffices.
    3. Prefix matches fix a start; length and position bounds drop starts outside the text.
    4. Starts are verified by the window's other shingles at their places.
    """
    widths = range(1, SHINGLE + 1)
    windows, of_item = windows_of(items, window)
    windows, of_item = stage(windows, "windows"), stage(of_item, "window-items")
    n_windows, short = windows.selectExpr("count(*)", f"min(least(length, {SHINGLE}))").first()
    pieces = windows.selectExpr("window_id", "length", "explode(shingles) AS s").selectExpr(
        "window_id", "length", "s.pos AS offset", "s.shingle AS shingle")
    vocabulary = pieces.select("shingle").distinct()

    # the row of width 0 carries the word count of every document, matched or not
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", words_of(F.col("text")).alias("words"))
    kinds = [f"CASE WHEN size(words) >= {w} THEN "
             + (_shingles("words", str(w)) if w == SHINGLE else
                f"transform(sequence(0, size(words) - {w}), i -> struct(i AS pos, "
                f"concat_ws(' ', slice(words, i + 1, {w})) AS shingle))")
             + " ELSE array() END" for w in widths if n_windows and w >= short]
    parts = ", ".join(["array(struct(size(words) AS pos, '' AS shingle))", *kinds])
    placed = rows.selectExpr("row", "doc_id", f"explode(concat({parts})) AS s").selectExpr(
        "row", "doc_id", "s.pos AS pos", "s.shingle AS shingle")
    known = vocabulary.union(docs.sparkSession.range(1).selectExpr("'' AS shingle"))
    hits = stage(placed.join(_shared(known, n_windows * window), "shingle", "left_semi"), "hits")

    sizes = hits.where("shingle = ''").selectExpr("row", "doc_id", "pos AS n_words")
    found = hits.where("shingle != ''")
    often = found.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    prefix = (
        pieces.join(often, "shingle").groupBy("window_id", "length")
        .agg(F.min(F.struct("df", "shingle", "offset")).alias("p"), F.count(F.lit(1)).alias("n"))
        .where(f"n = greatest(length - {SHINGLE - 1}, 1)")  # a window with a shingle no text has is out
        .selectExpr("window_id", "length", "p.shingle AS shingle", "p.offset AS offset"))
    starts = (
        found.join(_shared(prefix, n_windows), "shingle")
        .selectExpr("row", "window_id", "length", "pos - offset AS start").where("start >= 0")
        .join(sizes.select("row", "n_words"), "row").where("start + length <= n_words")
        .drop("n_words"))
    # disjoint shingles and the last one cover a window
    cover = pieces.where(f"offset % {SHINGLE} = 0 OR offset = length - {SHINGLE}").select(
        "window_id", "shingle", "offset", F.count(F.lit(1)).over(_by("window_id")).alias("needed"))
    checks = starts.join(_shared(cover, n_windows * window), "window_id").selectExpr(
        "row", "start + offset AS pos", "shingle", "window_id", "start", "length", "needed")
    sure = (
        checks.join(found.select("row", "pos", "shingle"), ["row", "pos", "shingle"])
        .groupBy("row", "start", "length", "window_id", "needed").agg(F.count(F.lit(1)).alias("n"))
        .where("n = needed").select("row", "start", "length", "window_id"))
    sure = stage(sure, "occurrences")

    ends = sure.groupBy("row", "start").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    # a word is counted by the first occurrence, in order of start, that reaches it
    covered = ends.selectExpr(
        "row", "greatest(end - greatest(start, coalesce(max(end) OVER (PARTITION BY row ORDER BY start "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0) AS fresh")
    hit = covered.groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    named = (
        sure.select("row", "window_id").distinct()
        .join(_shared(of_item, n_windows), "window_id")
        .select("row", F.col("item_id").cast("string").alias("item")).distinct()
        .groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items")))
    return (
        sizes.join(hit.join(named, "row"), "row", "left").select(
            "doc_id", F.col("n_words").cast("bigint").alias("n_words"),
            F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
            F.sha2(F.coalesce(F.concat_ws(",", "items"), F.lit("")), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated")))


def keep_clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows whose text holds an occurrence of an item window.

    Texts are judged, not ids: of rows that share a doc_id, or have none, each stays or goes by
    its own text. Null and empty texts stay.
    """
    digest = F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256)
    with scratch(docs.sparkSession):
        found = decontaminate(docs.select(digest.alias("doc_id"), "text"), items, window)
        gone = small(outlive(found.where("contaminated").select(F.col("doc_id").alias("__gone")).distinct(), "contaminated"))
    return docs.join(gone, digest == gone["__gone"], "left_anti")


def _by(column: str):
    from pyspark.sql import Window

    return Window.partitionBy(column)


SQL = """
WITH d AS (
  SELECT doc_id, w, len(w) AS n FROM (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents)),
b AS (
  SELECT item_id, w, len(w) AS n FROM (
    SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, least(n, 10) AS k, list_slice(w, i, i + 9) AS words
  FROM (SELECT item_id, n, w, unnest(range(1, greatest(n - 10, 0) + 2)) AS i FROM b)),
places AS (
  SELECT doc_id, k, i, list_slice(w, i, i + k - 1) AS words FROM (
    SELECT doc_id, w, k, unnest(range(1, n - k + 2)) AS i
    FROM d, (SELECT DISTINCT k FROM windows) WHERE n >= k)),
found AS (SELECT p.doc_id, p.k, p.i, v.item_id FROM places p JOIN windows v ON v.k = p.k AND v.words = p.words),
hit AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS x FROM found) GROUP BY 1),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY 1)
SELECT d.doc_id, d.n AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
