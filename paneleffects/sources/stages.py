"""Staged intermediate tables.

An estimate reads the same unit rows several times. They are written once to the
shared folder named by ``spark.checkpoint.dir`` and read back as parquet: later passes
prune columns, the lineage ends there, and a lost executor costs a re-read, not a
re-computation of the whole input.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def stage_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="paneleffects-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


class Stages:
    """The staged tables of one model or query, which frees them when it is closed."""

    def __init__(self) -> None:
        self.paths: list[tuple[SparkSession, str]] = []
        self._next: list[Stages] = []

    def then(self, other: Stages) -> None:
        """Close ``other`` along with this one, once."""
        self._next.append(other)

    def close(self) -> None:
        """Remove the files, in whatever store they lie. Tables read from them are gone then."""
        while self._next:
            self._next.pop().close()
        while self.paths:
            spark, path = self.paths.pop()
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

    def files(self) -> list[str]:
        """The folders held, those of owners that are closed along included."""
        return [p for _, p in self.paths] + [p for x in self._next for p in x.files()]

    def read_by(self, df: DataFrame) -> bool:
        """Whether ``df`` reads one of the folders."""
        own = tuple(p.split("://")[-1].rstrip("/") + "/" for p in self.files())
        return any(p in f for f in df.inputFiles() for p in own) if own else False

    def __enter__(self) -> Stages:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


class SharedStages(Stages):
    """Tables that several owners use: they go with the last of ``users`` calls of ``close``."""

    def __init__(self, users: int) -> None:
        super().__init__()
        self._users = users

    def close(self) -> None:
        self._users -= 1
        if self._users <= 0:
            super().close()


_OWNER: ContextVar[Stages | None] = ContextVar("owner of staged tables", default=None)


def current_owner() -> Stages | None:
    return _OWNER.get()


@contextmanager
def owned_by(owner: Stages) -> Iterator[Stages]:
    """Tables staged inside belong to ``owner``; an inner owner keeps its own, and closes with the outer one."""
    outer = _OWNER.get()
    if outer is not None:
        outer.then(owner)
    token = _OWNER.set(owner)
    try:
        yield owner
    finally:
        _OWNER.reset(token)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back from it.

    It belongs to the owner in whose block it was staged; without one it is left to the
    cluster's clean-up.
    """
    spark = df.sparkSession
    path = f"{stage_folder(spark)}/{label}-{uuid.uuid4().hex}"
    owner = _OWNER.get()
    if owner is not None:
        owner.paths.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_observed(df: DataFrame, metrics: Sequence[Column], label: str) -> tuple[DataFrame, dict[str, object]]:
    """``stage`` and the values of the named aggregates ``metrics`` over the rows written.

    The tasks that write compute them: no further scan.
    """
    seen = Observation()
    staged = stage(df.observe(seen, *metrics), label)
    return staged, seen.get


# Largest driver-made table, in cells (16 MB). Such tables hold per-scenario parameters or report
# lines. They are marked for broadcast, so a join never brings all rows of a scenario to one task.
MAX_DRIVER_CELLS = 2_000_000


def driver_table(
    spark: SparkSession, columns: Mapping[str, tuple[str, Sequence[object]]]
) -> DataFrame:
    """A small DataFrame from driver values: {name: (type, values)}."""
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(),
             "boolean": pa.bool_()}
    arrays = {n: pa.array(list(v), type=kinds[t]) for n, (t, v) in columns.items()}
    cells = sum(len(a) for a in arrays.values())
    if cells > MAX_DRIVER_CELLS:
        raise ValueError(f"{cells} cells is too large for a driver-made table")
    return F.broadcast(spark.createDataFrame(pa.table(arrays)))


# A table up to this many rows may be joined as a local relation, broadcast by its known size.
SMALL_ROWS = 50_000


def checked_small(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` as a local relation if it has at most ``max_rows`` rows, else ``df`` unchanged.

    The planner then knows the size before it shuffles the large side of a join. Joining
    on a handful of groups or periods by shuffle would put each group into one task.
    Larger tables keep the shuffle join, where adaptive execution splits hot keys.
    """
    rows = df.limit(max_rows + 1).toArrow()
    return df.sparkSession.createDataFrame(rows, df.schema) if rows.num_rows <= max_rows else df
