"""Panels built from the driver tables, as DataFrames and as SQL.

part panel      unit part, time ship year, treated type ECONOMY, cluster brand
supplier panel  unit supplier, time ship year, treated suppliers of the first region, cluster nation
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prep import complete_units
from ..operators.unit_table import UnitTable, unit_table, unit_tables
from ..sources.stages import stage
from ..spec import PanelSpec

# fixed values: the ship years in the tables and the study design on them
PERIODS = (1995, 1996, 1997, 1998, 1999, 2000, 2001)
TIME_INIT, TIME_PRE, LAST = 1995, 1998, 2001

PART = PanelSpec(
    "outcome", cluster="cluster", time_pre=TIME_PRE, time_init=TIME_INIT,
    covariates=("p_size", "p_retailprice"), name="part")
SUPPLIER = PanelSpec(
    "outcome", cluster="cluster", time_pre=TIME_PRE, time_init=TIME_INIT,
    covariates=("s_acctbal",), name="supplier")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def yearly(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """Revenue and quantity per key and ship year."""
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        table(spark, folder, "lineitem")
        .groupBy(F.col(key).alias("unit"), F.year("l_shipdate").alias("time"))
        .agg(
            F.round(F.sum(revenue), 4).alias("outcome"),
            F.sum("l_quantity").alias("quantity"),
            *[F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity")).otherwise(0.0)).alias(f"flag_{f.lower()}")
              for f in ("A", "N", "R")],
        )
    )


def part_panel(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").select(
        F.col("p_partkey").alias("unit"),
        F.when(F.col("p_type") == "ECONOMY", 1).otherwise(0).alias("treated"),
        F.col("p_brand").alias("cluster"), "p_type", "p_size", "p_retailprice")
    return yearly(spark, folder, "l_partkey").join(part, "unit")


def staged_part_panel(spark: SparkSession, folder: str) -> DataFrame:
    """For operators that read the panel twice: the order lines are read only once."""
    return stage(part_panel(spark, folder), "panel")


def complete_part_panel(spark: SparkSession, folder: str) -> DataFrame:
    panel = part_panel(spark, folder)
    return complete_units(panel, "unit", len(PERIODS), ["outcome", "p_size", "p_retailprice"])


def part_units(
    spark: SparkSession, folder: str, *specs: PanelSpec, periods: Sequence[int] = PERIODS
) -> UnitTable | list[UnitTable]:
    """Unit tables of the parts complete over ``periods``, from the order lines in one shuffle chain."""
    found = unit_tables(part_panel(spark, folder), specs or (PART,), periods, incomplete="drop")
    return found if len(specs) > 1 else found[0]


def supplier_units(spark: SparkSession, folder: str) -> UnitTable:
    return unit_table(supplier_panel(spark, folder), SUPPLIER, PERIODS)


def supplier_panel(spark: SparkSession, folder: str) -> DataFrame:
    supplier = table(spark, folder, "supplier").join(
        table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    ).select(
        F.col("s_suppkey").alias("unit"),
        F.when(F.col("n_regionkey") == 0, 1).otherwise(0).alias("treated"),
        F.col("s_nationkey").alias("cluster"), "s_acctbal")
    return yearly(spark, folder, "l_suppkey").join(supplier, "unit")


def nation_flows(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines from the customer's nation (home) to the supplier's nation (work), by year."""
    line = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_shipdate")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("home"))
    supplier = table(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").alias("work"))
    return (
        line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.year("l_shipdate").alias("year"), "home", "work")
        .agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("lines"))
    )


_YEARLY = """
    SELECT {key} AS unit, CAST(year(l_shipdate) AS INTEGER) AS time,
           round(sum(l_extendedprice * (1 - l_discount)), 4) AS outcome,
           sum(l_quantity) AS quantity,
           sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0.0 END) AS flag_a,
           sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0.0 END) AS flag_n,
           sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0.0 END) AS flag_r
    FROM lineitem GROUP BY 1, 2
"""

PART_SQL = f"""
WITH flow AS ({_YEARLY.format(key='l_partkey')}),
part_panel AS (
    SELECT f.*, CASE WHEN p_type = 'ECONOMY' THEN 1 ELSE 0 END AS treated, p_brand AS cluster,
           p_type, p_size, p_retailprice
    FROM flow f JOIN part ON unit = p_partkey),
panel AS (SELECT * FROM part_panel QUALIFY count(*) OVER (PARTITION BY unit) = 7)
"""

SUPPLIER_SQL = f"""
WITH RECURSIVE flow AS ({_YEARLY.format(key='l_suppkey')}),
panel AS (
    SELECT f.*, CASE WHEN n_regionkey = 0 THEN 1 ELSE 0 END AS treated, s_nationkey AS cluster, s_acctbal
    FROM flow f JOIN supplier ON unit = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
"""

FLOW_SQL = """
WITH flows AS (
    SELECT CAST(year(l_shipdate) AS INTEGER) AS year, c_nationkey AS home, s_nationkey AS work,
           sum(l_quantity) AS quantity, count(*) AS lines
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    GROUP BY 1, 2, 3)
"""


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})
