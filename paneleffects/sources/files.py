"""File sources and sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stages import stage_observed


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | str | None = None,
    types: Mapping[str, str] | None = None,
) -> DataFrame:
    """CSV scan with a header.

    Give ``schema`` where it is known: one pass, no inference. Without it the types
    are inferred (an extra pass over the files) and ``types`` overrides single columns;
    a value that does not fit an overridden type becomes NULL.
    """
    reader = spark.read.option("header", True)
    if schema is not None:
        return reader.schema(schema).csv(path)
    df = reader.option("inferSchema", True).csv(path)
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in (types or {}).items()})


def read_parquet(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


def cast_key(df: DataFrame, *keys: str) -> DataFrame:
    """Keys as text, so that codes with leading zeros and numbers join alike."""
    return df.withColumns({k: F.col(k).cast("string") for k in keys})


def read_periods(
    spark: SparkSession,
    paths: Mapping[int, str],
    schema: T.StructType | str,
    time: str = "year",
    fmt: str = "csv",
) -> DataFrame:
    """One scan over all periods' files, each row stamped with its period.

    ``paths`` maps period -> file or folder. All files are listed in a single scan
    (no per-period plan); the period is looked up from the row's input file name.
    """
    listed = spark.read.option("header", True).schema(schema).format(fmt).load(list(paths.values()))
    # file names come URL-encoded, but for the plus sign
    file = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    stamp = F.coalesce(
        *[F.when(file.contains(p.rstrip("/").split("://")[-1]), F.lit(t)) for t, p in sorted(
            paths.items(), key=lambda item: -len(item[1]))],
        F.raise_error(F.concat(F.lit("no period is given for file "), file)).cast("int"),
    )
    return listed.select(stamp.cast("int").alias(time), *listed.columns)


def read_year_folders(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    periods: Sequence[int] | None = None,
    time: str = "year",
    fmt: str = "csv",
) -> DataFrame:
    """A table kept as one folder ``<time>=<period>`` per period, as ``write_periods`` makes it.

    The period is a partition column: the folders are discovered, and only those of
    ``periods`` (all by default), or that a later filter leaves, are read.
    """
    given = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    wanted = T.StructType([f for f in given.fields if f.name != time] + [T.StructField(time, T.IntegerType())])
    df = spark.read.option("header", True).schema(wanted).format(fmt).load(path)
    if periods is not None:
        df = df.filter(F.col(time).isin(list(periods)))
    return df.select(time, *[f.name for f in wanted.fields if f.name != time])


def write_periods(df: DataFrame, path: str, time: str = "year", fmt: str = "parquet") -> None:
    """Write ``df`` into period folders; of those there already are, only periods in ``df`` are replaced.

    The swap is made when all tasks have written, so a job that fails leaves the old folders.
    Rows without a period are refused.
    """
    kept = df.withColumn(time, F.coalesce(
        F.col(time).cast("int"), F.raise_error(F.lit(f"a row has no {time}")).cast("int")))
    writer = kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(time)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


#: Bytes of a dimension's values up to which it is broadcast.
DIMENSION_BYTES = 64 << 20


def read_dimension(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    rename: Mapping[str, str] | None = None,
    require: Sequence[str] = (),
    keys: Sequence[str] = (),
) -> DataFrame:
    """A crosswalk or price index: read, rename, drop rows whose required labels are missing.

    With ``keys`` the table is loaded by ``unique_dimension``.
    """
    df = spark.read.option("header", True).schema(schema).csv(path)
    df = df.withColumnsRenamed(dict(rename or {}))
    df = df.dropna(subset=list(require)) if require else df
    return unique_dimension(df, keys) if keys else df


def unique_dimension(df: DataFrame, keys: Sequence[str], max_bytes: int = DIMENSION_BYTES) -> DataFrame:
    """``df`` staged as a lookup table with one row per ``keys``.

    A lookup by repeated keys would multiply the rows of the other side, so they are an error;
    so are missing keys, which match nothing. The tasks that stage the table count the bytes
    of its values: up to ``max_bytes`` it is marked for broadcast, beyond it joins shuffle.
    """
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 8 for c in df.columns), F.lit(0))
    lacking = [F.count_if(F.col(k).isNull()).alias(f"no_{i}") for i, k in enumerate(keys)]
    staged, seen = stage_observed(df, [F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), *lacking], "dimension")
    empty = [k for i, k in enumerate(keys) if seen[f"no_{i}"]]
    if empty:
        raise ValueError(f"the dimension has rows without {', '.join(empty)}")
    repeated = staged.groupBy(*keys).count().filter("count > 1").limit(5).collect()
    if repeated:
        shown = ", ".join("/".join(str(r[k]) for k in keys) for r in repeated)
        raise ValueError(f"the dimension has several rows for {shown}")
    return F.broadcast(staged) if seen["bytes"] <= max_bytes else staged


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    mode: str = "errorifexists",
) -> None:
    """Write a result as parquet or CSV, one folder per value of ``partition_by``."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
