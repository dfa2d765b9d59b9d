"""What the operators share around Spark tasks: folds, staging, Arrow passes."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stages import stage_folder

#: A staged table of up to this many rows, a few numbers each, may be broadcast: some 50 MB at most.
BROADCAST_ROWS = 500_000

#: Bytes of a batch that Spark sends to Python, some chunks of texts, and the setting that says so.
BATCH_BYTES, BATCH_SETTING = 2 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"

#: The staged folders of the open scratches of this thread of work, innermost last.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open scratches", default=())


def stage(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back; an open ``scratch`` removes it at its end."""
    spark = df.sparkSession
    path = f"{stage_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if _OPEN.get():
        _OPEN.get()[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def outlive(df: DataFrame, label: str) -> DataFrame:
    """``stage`` for the result of an open ``scratch``: it belongs to the next one outside."""
    token = _OPEN.set(_OPEN.get()[:-1])
    try:
        return stage(df, label)
    finally:
        _OPEN.reset(token)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables staged inside, in whatever store they lie, when the block ends."""
    own: list[str] = []
    token = _OPEN.set((*_OPEN.get(), own))
    try:
        yield
    finally:
        _OPEN.reset(token)
        for path in own:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def rows_of(staged: DataFrame, most: int = BROADCAST_ROWS) -> int:
    """How many rows a staged table has, ``most`` + 1 if more than ``most``."""
    return staged.limit(most + 1).count()


def small(df: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """``df``, marked for broadcast if ``counted`` (a staged table, default ``df``) has few rows; else as it is."""
    return F.broadcast(df) if rows_of(df if counted is None else counted) <= BROADCAST_ROWS else df


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of at most ``rows`` rows, in no more partitions than these need: 2,000 rows each, but 16."""
    return df.coalesce(max(16, rows // 2000)) if rows <= BROADCAST_ROWS else df


def fold(parts: int, column: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod ``parts``; a null id counts as empty text."""
    return (F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts).cast("int")


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package wherever the driver was started.

    On a cluster ship it as any package, with --py-files or in the executors' environment.
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in (env.get("PYTHONPATH") or "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def bounded_batches(spark: SparkSession) -> None:
    """Let Spark cut what it sends to Python by bytes, unless the session has a limit of its own.

    By default a batch has 10,000 rows, often all texts of a task: an executor holds them as
    Arrow vectors and once more as sent, outside its heap, and Python holds them too. The
    setting stays with the session, as it counts when a result is written.
    """
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def give_back() -> None:
    """Returns freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow. Spark keeps a task's worker for later ones, so what the task freed is given back at its end."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
