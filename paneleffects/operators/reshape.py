"""Column naming, key filters, long/wide changes and stacking of result tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def affix_columns(
    df: DataFrame, prefix: str = "", suffix: str = "", keep: Sequence[str] = ()
) -> DataFrame:
    """Add a prefix and suffix to every column name except those in ``keep``."""
    return df.select(*[
        F.col(c) if c in keep else F.col(c).alias(f"{prefix}{c}{suffix}") for c in df.columns])


def columns_matching(df: DataFrame, pattern: str, exclude: Sequence[str] = ()) -> list[str]:
    return [c for c in df.columns if re.search(pattern, c) and c not in exclude]


def keep_keys(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key is in ``keys``."""
    return df.join(keys, on if isinstance(on, str) else list(on), "left_semi")


def drop_keys(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key is not in ``keys``."""
    return df.join(keys, on if isinstance(on, str) else list(on), "left_anti")


def union_keys(*lists: DataFrame) -> DataFrame:
    """Distinct union of one-column key lists."""
    return reduce(lambda a, b: a.unionByName(b), lists).distinct()


def stack_rows(*tables: DataFrame) -> DataFrame:
    """Rows of all tables; columns a table lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def _only(value: str, kind: str) -> Column:
    """The value of a cell; a cell with several rows raises."""
    return F.expr(
        f"if(count(1) > 1, CAST(raise_error('several rows for one cell of `{value}`') AS {kind}), "
        f"first(`{value}`, true))")


def long_to_wide(
    df: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence[object]
) -> DataFrame:
    """One row per key, one column per name; two rows for one cell raise an error."""
    kind = df.schema[value].dataType.simpleString()
    return df.groupBy(*keys).pivot(name, list(names)).agg(_only(value, kind))


def wide_to_long(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], name: str = "name", value: str = "value"
) -> DataFrame:
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        list(keys), list(cols), name, value)


def side_by_side(
    results: DataFrame, row: str, model: str, value: str, models: Sequence[str]
) -> DataFrame:
    """Long result lines to one column per model: a full outer join of any number of tables.

    Model names must differ; two lines for one cell raise an error.
    """
    if len(set(models)) < len(models):
        raise ValueError(f"model names repeat: {list(models)}")
    return long_to_wide(results, [row], model, value, models)


def transpose(
    df: DataFrame, row: str, rows: Sequence[str], cols: Sequence[str], name: str = "name"
) -> DataFrame:
    """Swap a small table's rows (values of ``row``) with its columns ``cols``."""
    long = df.select(F.col(row).cast("string").alias("_row"), *[F.col(c).cast("string").alias(c) for c in cols])
    return long.unpivot(["_row"], list(cols), name, "_v").groupBy(name).pivot("_row", list(rows)).agg(
        F.first("_v", ignorenulls=True))


def with_defaults(
    df: DataFrame, other: DataFrame, on: Sequence[str], defaults: Mapping[str, Column]
) -> DataFrame:
    """Full outer join; columns missing on the unmatched side take their default."""
    joined = df.join(other, list(on), "full")
    return joined.withColumns({c: F.coalesce(F.col(c), v) for c, v in defaults.items()})
