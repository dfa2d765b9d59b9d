"""Panel preparation queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.columns import row_sum
from ..operators import prep, reshape
from ..operators.unit_table import distinct_periods
from ..sources import files
from ..sources.stages import current_owner, driver_table, stage_folder
from . import query
from .tables import (
    FLOW_SQL,
    LAST,
    PART_SQL,
    PERIODS,
    TIME_PRE,
    complete_part_panel,
    nation_flows,
    part_panel,
    rounded,
    staged_part_panel,
    table,
)


@query(PART_SQL + "SELECT unit, time, outcome, treated, cluster FROM panel")
def complete_panel(spark, d):
    return complete_part_panel(spark, d).select("unit", "time", "outcome", "treated", "cluster")


_SPOILED_SQL = PART_SQL + """, spoiled AS (
    SELECT unit, time, CASE WHEN p_size = 25 THEN 'infinity'::DOUBLE WHEN p_size = 26 THEN 'nan'::DOUBLE
        WHEN p_size = 27 THEN NULL WHEN p_size = 28 THEN '-infinity'::DOUBLE ELSE outcome END AS outcome
    FROM part_panel)
"""


def _spoiled(spark, d):
    return part_panel(spark, d).select("unit", "time", F.expr(
        "CASE WHEN p_size = 25 THEN double('Infinity') WHEN p_size = 26 THEN double('NaN') "
        "WHEN p_size = 27 THEN NULL WHEN p_size = 28 THEN double('-Infinity') ELSE outcome END").alias("outcome"))


@query(_SPOILED_SQL + """
SELECT unit, time, outcome FROM spoiled
WHERE outcome IS NOT NULL AND NOT isnan(outcome) AND NOT isinf(outcome)""")
def finite_row_filter(spark, d):
    return prep.finite_rows(_spoiled(spark, d), ["outcome"])


@query(_SPOILED_SQL + """
SELECT unit, time, CASE WHEN isinf(outcome) OR isnan(outcome) THEN NULL ELSE outcome END AS outcome,
       coalesce(isnan(outcome), false) AS was_nan FROM spoiled""")
def infinite_values_cleared(spark, d):
    cleared = prep.infinite_to_null(_spoiled(spark, d), ["outcome"])
    return cleared.withColumn("was_nan", F.coalesce(F.isnan("outcome"), F.lit(False))).withColumn(
        "outcome", F.nanvl("outcome", F.lit(None).cast("double")))


@query(PART_SQL + """
SELECT unit, max(treated) AS treated, max(p_size) AS p_size,
       round(avg(CASE WHEN time > 1998 THEN outcome END), 4) AS outcome_post,
       max(CASE WHEN time = 1995 THEN outcome END) AS outcome_1995,
       max(CASE WHEN time = 1996 THEN outcome END) AS outcome_1996,
       max(CASE WHEN time = 1997 THEN outcome END) AS outcome_1997,
       max(CASE WHEN time = 1998 THEN outcome END) AS outcome_1998
FROM panel GROUP BY unit""")
def post_mean(spark, d):
    units = prep.post_means(
        complete_part_panel(spark, d), ["outcome"], "unit", "time", TIME_PRE + 1, LAST,
        {"outcome": PERIODS[:4]}, ["treated", "p_size"])
    return rounded(units, 4, "outcome_post")


@query(PART_SQL + """
SELECT unit, time, outcome,
       max(CASE WHEN time = 1995 THEN outcome END) OVER (PARTITION BY unit) AS outcome_1995,
       max(CASE WHEN time = 1998 THEN outcome END) OVER (PARTITION BY unit) AS outcome_1998,
       max(CASE WHEN time = 1998 THEN quantity END) OVER (PARTITION BY unit) AS quantity_1998
FROM part_panel""")
def spread_years(spark, d):
    out = prep.spread_periods(
        staged_part_panel(spark, d).select("unit", "time", "outcome", "quantity"),
        ["outcome", "quantity"], [1995, 1998], "unit", "time")
    return out.drop("quantity", "quantity_1995")


@query(PART_SQL + """
SELECT unit, time, (outcome - b) / nullif(b, 0) AS pc_outcome, (quantity - q) / nullif(q, 0) AS pc_quantity
FROM (SELECT *, lag(outcome) OVER w AS b, lag(quantity) OVER w AS q FROM part_panel
      WINDOW w AS (PARTITION BY unit ORDER BY time))""")
def pct_change(spark, d):
    out = prep.pct_changes(part_panel(spark, d), ["outcome", "quantity"], "unit", "time")
    return out.select("unit", "time", "pc_outcome", "pc_quantity")


@query(PART_SQL + """, lagged AS (
    SELECT *, lag(outcome) OVER w AS b, lag(quantity) OVER w AS q FROM part_panel
    WINDOW w AS (PARTITION BY unit ORDER BY time))
SELECT e.unit, e.cluster, e.p_size, (e.outcome - e.b) / nullif(e.b, 0) AS pc_outcome,
       (e.quantity - e.q) / nullif(e.q, 0) AS pc_quantity,
       s.outcome AS outcome_1998, s.quantity AS quantity_1998,
       e.outcome AS outcome_2001, e.quantity AS quantity_2001
FROM lagged e JOIN lagged s USING (unit) WHERE s.time = 1998 AND e.time = 2001""")
def start_end_changes(spark, d):
    return prep.changes_between(
        part_panel(spark, d), ["outcome", "quantity"], TIME_PRE, LAST, ["unit", "cluster"], "time", ["p_size"])


@query(PART_SQL + """
SELECT s.unit, s.treated, s.outcome, (e.outcome - s.outcome) / nullif(s.outcome, 0) AS outcome_pc
FROM part_panel s JOIN part_panel e USING (unit)
WHERE s.time = 1998 AND e.time = 2001 AND s.outcome <> 0""")
def two_period_change(spark, d):
    return prep.two_period_change(
        part_panel(spark, d), ["outcome"], TIME_PRE, LAST, "unit", "time", ["treated"])


@query(PART_SQL + """
SELECT unit, time, flag_a / nullif(quantity, 0) AS p_flag_a, flag_n / nullif(quantity, 0) AS p_flag_n,
       flag_r / nullif(flag_n, 0) AS late_flag_r, outcome / nullif(p_size, 0) AS d_outcome
FROM part_panel""")
def shares_densities(spark, d):
    panel = part_panel(spark, d)
    out = prep.shares(panel, ["flag_r"], "flag_n", prefix="late", drop=True)
    out = prep.shares(out, ["flag_a", "flag_n"], "quantity", drop=True)
    out = prep.shares(out, ["outcome"], "p_size", prefix="d")
    return out.select("unit", "time", "p_flag_a", "p_flag_n", "late_flag_r", "d_outcome")


_INDEX_SQL = """, prices AS (
    SELECT CAST(year(l_shipdate) AS INTEGER) AS time, sum(l_extendedprice) / sum(l_quantity) AS price
    FROM lineitem GROUP BY 1),
price_index AS (
    SELECT time, round(max(CASE WHEN time = 1998 THEN price END) OVER () / price, 8) AS ratio FROM prices)
"""


@query(PART_SQL + _INDEX_SQL + """
SELECT unit, time, round(outcome * ratio, 4) AS outcome, quantity
FROM part_panel LEFT JOIN price_index USING (time)""")
def deflate(spark, d):
    yearly = table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("time")).agg(
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"))
    index = prep.attach(
        yearly.withColumn("everything", F.lit(1)), ["everything"],
        {"base": F.max(F.when(F.col("time") == TIME_PRE, F.col("price")))}, few_groups=True,
    ).select("time", F.round(F.col("base") / F.col("price"), 8).alias("ratio"))
    out = prep.deflate(part_panel(spark, d), ["outcome"], index, ["time"])
    return rounded(out, 4, "outcome").select("unit", "time", "outcome", "quantity")


@query(PART_SQL + """
SELECT unit, time, CASE WHEN time <= 1998 THEN flag_a + flag_n WHEN time <= 2000 THEN flag_a + flag_n + flag_r END
       AS working FROM part_panel""")
def year_dependent_sum(spark, d):
    early, late = ["flag_a", "flag_n"], ["flag_a", "flag_n", "flag_r"]
    terms = {t: early if t <= TIME_PRE else late for t in PERIODS if t <= 2000}
    return part_panel(spark, d).select("unit", "time", prep.sum_by_period("time", terms).alias("working"))


@query(PART_SQL + """
SELECT unit, time, CAST(sum(p_size) OVER w AS BIGINT) AS area,
       outcome / sum(p_size) OVER w AS d_outcome
FROM part_panel WINDOW w AS (PARTITION BY cluster, time)""")
def area_totals(spark, d):
    out = prep.area_totals(staged_part_panel(spark, d), "p_size", "cluster", "time", "area")
    out = prep.shares(out, ["outcome"], "area", prefix="d")
    return out.select("unit", "time", "area", "d_outcome")


@query(PART_SQL + """
SELECT unit, time, flag_a + flag_n + flag_r AS total,
       CASE WHEN time = 1998 THEN NULL ELSE flag_a END + flag_n AS with_gap FROM part_panel""")
def row_totals(spark, d):
    gap = F.when(F.col("time") == TIME_PRE, None).otherwise(F.col("flag_a"))
    return part_panel(spark, d).select(
        "unit", "time", row_sum(["flag_a", "flag_n", "flag_r"]).alias("total"),
        row_sum([gap, "flag_n"]).alias("with_gap"))


@query(FLOW_SQL + """
SELECT f.year, f.home, h.n_regionkey AS region, sum(quantity) AS quantity, CAST(sum(lines) AS BIGINT) AS lines
FROM flows f JOIN nation h ON f.home = h.n_nationkey JOIN nation w ON f.work = w.n_nationkey
WHERE h.n_regionkey = w.n_regionkey GROUP BY 1, 2, 3""")
def od_within_area(spark, d):
    crosswalk = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("region"))
    return prep.flows_within_area(
        nation_flows(spark, d), crosswalk, "home", "work", ["quantity", "lines"],
        "n_nationkey", "region", ["year"])


_EVENT_SQL = """WITH cells AS (
    SELECT user_id, event_type, round(avg(value), 6) AS value FROM events GROUP BY 1, 2)
"""
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")  # fixed values


def _event_cells(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(
        F.round(F.avg("value"), 6).alias("value"))


@query(_EVENT_SQL + "SELECT user_id, " + ", ".join(
    f"max(CASE WHEN event_type = '{e}' THEN value END) AS {e}" for e in EVENT_TYPES)
    + " FROM cells GROUP BY user_id")
def long_to_wide(spark, d):
    return prep.survey_wide(_event_cells(spark, d), ["user_id"], "event_type", "value", EVENT_TYPES)


@query(_EVENT_SQL + "SELECT user_id, event_type AS name, value FROM cells")
def wide_to_long(spark, d):
    wide = reshape.long_to_wide(_event_cells(spark, d), ["user_id"], "event_type", "value", EVENT_TYPES)
    return reshape.wide_to_long(wide, ["user_id"], EVENT_TYPES).filter("value IS NOT NULL")


@query(FLOW_SQL + """, rich AS (
    SELECT c_nationkey AS home FROM customer GROUP BY 1
    HAVING avg(c_acctbal) > (SELECT avg(c_acctbal) FROM customer)),
means AS (
    SELECT year, work, avg(quantity) AS quantity, avg(lines) AS lines
    FROM flows WHERE home IN (SELECT home FROM rich) GROUP BY 1, 2)
SELECT year, work, round(quantity, 6) AS quantity, round(lines, 6) AS lines, rank FROM (
    SELECT *, CAST(dense_rank() OVER (PARTITION BY year ORDER BY quantity DESC) AS INTEGER) AS rank FROM means)
WHERE rank <= 10""")
def top_destinations(spark, d):
    from ..operators.summary import top_destinations as top

    customer = table(spark, d, "customer")
    overall = customer.agg(F.avg("c_acctbal").alias("all"))
    by_nation = customer.groupBy(F.col("c_nationkey").alias("home")).agg(F.avg("c_acctbal").alias("mine"))
    rich = by_nation.join(overall, F.col("mine") > F.col("all"), "left_semi")
    out = top(nation_flows(spark, d), rich, "home", "work", ["quantity", "lines"], "quantity", ["year"])
    return rounded(out, 6, "quantity", "lines")


_FILES_SQL = """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(o_custkey AS VARCHAR) AS customer, o_orderpriority AS priority,
       o_totalprice AS price FROM orders"""


@query(_FILES_SQL)
def csv_files_per_year(spark, d):
    """Orders written as one CSV folder per year, read back in one scan stamped with the year."""
    path = f"{stage_folder(spark)}/orders-{uuid.uuid4().hex}"
    orders = table(spark, d, "orders").select(
        F.year("o_orderdate").alias("year"), F.col("o_custkey").alias("customer"),
        F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"))
    files.write_table(orders, path, "csv", ["year"])
    years = {t: f"{path}/year={t}" for t in distinct_periods(orders, "year")}
    return files.cast_key(
        files.read_periods(spark, years, "customer long, priority string, price double"), "customer")


@query("""
SELECT CAST(n_nationkey AS VARCHAR) AS unit, n_name AS area, CAST(n_regionkey AS DOUBLE) AS code, s.balance
FROM nation JOIN (SELECT s_nationkey, CAST(count(*) AS BIGINT) AS balance FROM supplier GROUP BY 1) s
ON n_nationkey = s_nationkey""")
def csv_dimension_lookup(spark, d):
    """A crosswalk stored as CSV, read with renamed columns, text keys and an overridden type."""
    path = f"{stage_folder(spark)}/nation-{uuid.uuid4().hex}"
    files.write_table(table(spark, d, "nation"), path, "csv")
    typed = files.read_csv(spark, path, types={"n_regionkey": "double"})
    crosswalk = files.cast_key(typed, "n_nationkey").withColumnsRenamed(
        {"n_nationkey": "unit", "n_name": "area", "n_regionkey": "code"})
    counts = files.cast_key(
        table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("unit")).agg(
            F.count(F.lit(1)).alias("balance")), "unit")
    return crosswalk.join(counts, "unit")


_GUARD_SQL = PART_SQL + """, changes AS (
    SELECT *, (outcome - lag(outcome) OVER w) / nullif(lag(outcome) OVER w, 0) AS pc_outcome FROM part_panel
    WINDOW w AS (PARTITION BY unit ORDER BY time))
SELECT name, missing, missing > 0 AS refused FROM (
    SELECT 'outcome' AS name, count(*) FILTER (outcome IS NULL) AS missing FROM changes
    UNION ALL SELECT 'pc_outcome', count(*) FILTER (pc_outcome IS NULL) FROM changes
    UNION ALL SELECT 'p_size', count(*) FILTER (p_size IS NULL) FROM changes)"""


@query(_GUARD_SQL)
def missing_guard(spark, d):
    """Missing values counted while the panel is staged; the guard refuses the columns that have any."""
    changes = prep.pct_changes(part_panel(spark, d), ["outcome"], "unit", "time")
    cols = ["outcome", "pc_outcome", "p_size"]
    staged, counts = prep.stage_counted(changes, cols)

    def refused(c: str) -> bool:
        try:
            prep.stage_complete(staged.select(c), [c])
        except ValueError:
            return True
        return False

    return driver_table(spark, {
        "name": ("string", cols),
        "missing": ("bigint", [counts[c] for c in cols]),
        "refused": ("boolean", [refused(c) for c in cols]),
    })


@query(PART_SQL + "SELECT unit, time, outcome, treated FROM part_panel")
def guarded_panel(spark, d):
    """A panel that passes the guard: staged once, its missing values counted by the writing tasks."""
    return prep.stage_complete(part_panel(spark, d), ["outcome", "treated", "p_size"]).select(
        "unit", "time", "outcome", "treated")


@query("""
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderkey AS k,
       CASE WHEN year(o_orderdate) = 1997 THEN o_totalprice * 2 ELSE o_totalprice END AS price
FROM orders WHERE year(o_orderdate) IN (1996, 1997)""")
def replaced_year(spark, d):
    """Orders in one folder per year; one year is written again, two years are read back."""
    path = f"{stage_folder(spark)}/orders-{uuid.uuid4().hex}"
    current_owner().paths.append((spark, path))
    orders = table(spark, d, "orders").select(
        F.year("o_orderdate").alias("year"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))
    files.write_periods(orders, path)
    again = orders.filter("year = 1997").withColumn("price", F.col("price") * 2)
    files.write_periods(again, path)
    return files.read_year_folders(spark, path, "k long, price double", [1996, 1997], fmt="parquet")


@query("""
SELECT c_custkey AS customer, n_name AS area, r_name AS city
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def dimension_lookup(spark, d):
    """Customers through a crosswalk that is loaded from CSV with unique keys."""
    path = f"{stage_folder(spark)}/crosswalk-{uuid.uuid4().hex}"
    current_owner().paths.append((spark, path))
    cross = table(spark, d, "nation").join(
        F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name"), F.col("r_name").alias("city"))
    files.write_table(cross, path, "csv")
    dimension = files.read_dimension(
        spark, path, "code string, name string, city string", {"name": "area"}, ["area"], ["code"])
    customers = table(spark, d, "customer").select(
        F.col("c_custkey").alias("customer"), F.col("c_nationkey").cast("string").alias("code"))
    return customers.join(dimension, "code").select("customer", "area", "city")
