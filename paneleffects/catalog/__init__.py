"""Registered queries over the driver tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.stages import Stages, owned_by

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str | Callable[[], str]] = {}


def query(sql: str | Callable[[], str] | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with the SQL (or what makes it) that must give the same rows."""

    def register(f: Query) -> Query:
        key = name or f.__name__

        @functools.wraps(f)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            """The query; tables staged for it are freed if its result does not read them."""
            with owned_by(Stages()) as owner:
                out = f(spark, folder)
            if not owner.read_by(out):
                owner.close()
            return out

        QUERIES[key] = run
        if sql is not None:
            SQL[key] = sql
        return f

    return register


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from . import choice, effects, keys, prep, robustness, summary  # noqa: F401

    return dict(QUERIES), {k: v() if callable(v) else v for k, v in SQL.items()}
