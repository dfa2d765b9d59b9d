"""Run registered queries and their SQL side by side: python tests/compare.py SF_DIR [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def sorted_rows(columns: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    picked = [tuple(r[k] for k in order) for r in rows]
    return [columns[k] for k in order], sorted(picked, key=lambda r: tuple((x is None, str(x)) for x in r))


def differences(spark_df, con, sql: str, exact: bool = True) -> list[str]:
    got_cols, got = sorted_rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    rel = con.sql(sql)
    want_cols, want = sorted_rows(rel.columns, rel.fetchall())
    if got_cols != want_cols:
        return [f"columns {got_cols} != {want_cols}"]
    if len(got) != len(want):
        return [f"rows {len(got)} != {len(want)}"]
    bad = []
    for a, b in zip(got, want, strict=True):
        for c, x, y in zip(got_cols, a, b, strict=True):
            if x == y or (isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y)):
                continue
            close = (not exact and isinstance(x, (int, float)) and isinstance(y, (int, float))
                     and math.isclose(x, y, rel_tol=1e-7, abs_tol=1e-7))
            if not close:
                bad.append(f"{c}: {x!r} != {y!r}  in {a}")
    return bad


def main() -> None:
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    folder, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master(__import__("os").environ.get("COMPARE_MASTER", "local[8]")).config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connection(folder), oracle_sql()
    failed = []
    for name, q in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = q(spark, folder)
            bad = differences(df, con, sqls[name]) if name in sqls else ([] if df.collect() else ["no rows"])
        except Exception as e:  # noqa: BLE001
            bad = [f"{type(e).__name__}: {str(e)[:600]}"]
        print(f"{'ok  ' if not bad else 'FAIL'} {name:34s} {time.time() - start:6.1f}s"
              f"{'' if name in sqls else '  (rows only)'}", flush=True)
        for line in bad[:4]:
            print("      ", line[:700], f"({len(bad)} differences)", flush=True)
        if bad:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main()
