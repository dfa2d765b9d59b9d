"""Summary, balance and ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import summary
from . import query
from .effects import number_sql, p_value_sql, stars_sql
from .tables import (
    FLOW_SQL,
    PART_SQL,
    complete_part_panel,
    nation_flows,
    part_panel,
    rounded,
    staged_part_panel,
    table,
)

_LABEL = r"regexp_replace(CAST(CAST(round_even({0}, 2) AS DECIMAL(38,2)) AS VARCHAR), '\.?0+$', '')"
_VARIABLES = ("p_retailprice", "p_size", "quantity")


def _mean_sd_sql(scale: float) -> str:
    one = " UNION ALL ".join(
        f"SELECT treated, '{c}' AS variable, avg({c} * {scale}) AS m, stddev_samp({c} * {scale}) AS s "
        f"FROM panel WHERE time = 2001 GROUP BY treated" for c in _VARIABLES)
    return PART_SQL + f""", stats AS ({one})
SELECT treated, variable, round(m, 6) AS mean, round(s, 6) AS sd, {_LABEL.format('m')} AS mean_label,
       '(' || {_LABEL.format('s')} || ')' AS sd_label FROM stats"""


@query(_mean_sd_sql(1.0))
def mean_sd_table(spark, d):
    last = complete_part_panel(spark, d).filter("time = 2001")
    return rounded(summary.mean_sd_table(last, "treated", _VARIABLES), 6, "mean", "sd")


@query(_mean_sd_sql(100.0))
def mean_sd_table_percent(spark, d):
    last = complete_part_panel(spark, d).filter("time = 2001")
    return rounded(summary.mean_sd_table(last, "treated", _VARIABLES, scale=100.0), 6, "mean", "sd")


@query(PART_SQL + """
SELECT treated, count(*) AS n, count(DISTINCT cluster) AS n_cluster, count(DISTINCT unit) AS n_unit
FROM panel GROUP BY treated""")
def group_counts(spark, d):
    return summary.group_counts(complete_part_panel(spark, d), ["treated"], ["cluster", "unit"])


@query(PART_SQL + """
SELECT round(avg(p_size), 8) AS mean_p_size FROM (SELECT DISTINCT cluster, p_size FROM panel)""")
def mean_over_distinct(spark, d):
    return rounded(summary.mean_over_distinct(complete_part_panel(spark, d), ["cluster"], "p_size"), 8, "mean_p_size")


@query(PART_SQL + """
SELECT round(avg(size), 8) AS mean_size FROM (
    SELECT count(*) OVER (PARTITION BY cluster) AS size FROM panel WHERE time = 2001)""")
def mean_group_size(spark, d):
    out = summary.mean_group_size(complete_part_panel(spark, d).filter("time = 2001"), ["cluster"])
    return rounded(out, 8, "mean_size")


@query("""
SELECT l_returnflag, 'l_extendedprice' AS variable, count(*) AS n, round(avg(l_extendedprice), 4) AS mean,
       min(l_extendedprice) AS min, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25,
       round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75,
       max(l_extendedprice) AS max FROM lineitem GROUP BY 1
UNION ALL
SELECT l_returnflag, 'l_quantity', count(*), round(avg(l_quantity), 4), min(l_quantity),
       round(quantile_cont(l_quantity, 0.25), 4), round(quantile_cont(l_quantity, 0.5), 4),
       round(quantile_cont(l_quantity, 0.75), 4), max(l_quantity) FROM lineitem GROUP BY 1""")
def quantile_summary(spark, d):
    out = summary.quantile_summary(
        table(spark, d, "lineitem"), ["l_extendedprice", "l_quantity"], by=["l_returnflag"])
    return rounded(out, 4, "mean", "p25", "p50", "p75")


@query(PART_SQL + """, w AS (
    SELECT unit, max(CASE WHEN time = 1995 THEN outcome END) AS a, max(CASE WHEN time = 2001 THEN outcome END) AS b
    FROM part_panel GROUP BY unit)
SELECT round(corr(a, b), 8) AS correlation, count(*) AS n FROM w WHERE a IS NOT NULL AND b IS NOT NULL""")
def correlation(spark, d):
    wide = part_panel(spark, d).groupBy("unit").agg(
        F.max(F.when(F.col("time") == 1995, F.col("outcome"))).alias("a"),
        F.max(F.when(F.col("time") == 2001, F.col("outcome"))).alias("b"))
    return rounded(summary.correlation(wide, "a", "b"), 8, "correlation")


@query(PART_SQL + """
SELECT treated, round(avg(flag_a / nullif(quantity, 0)), 8) AS flag_a,
       round(avg(flag_r / nullif(flag_n, 0)), 8) AS flag_r FROM part_panel GROUP BY treated""")
def mean_ratios(spark, d):
    panel = part_panel(spark, d)
    a = summary.mean_ratios(panel, ["flag_a"], "quantity", ["treated"])
    r = summary.mean_ratios(panel, ["flag_r"], "flag_n", ["treated"])
    return rounded(a.join(r, "treated"), 8, "flag_a", "flag_r")


@query(PART_SQL + """, a AS (
    SELECT time, avg(CASE WHEN treated = 1 THEN outcome END) AS l, avg(CASE WHEN treated = 0 THEN outcome END) AS r
    FROM panel GROUP BY time)
SELECT round(sqrt(avg((l - r) * (l - r))) / avg(l), 8) AS nrmse FROM a""")
def path_error(spark, d):
    paths = complete_part_panel(spark, d).groupBy("time").agg(
        F.avg(F.when(F.col("treated") == 1, F.col("outcome"))).alias("l"),
        F.avg(F.when(F.col("treated") == 0, F.col("outcome"))).alias("r"))
    return rounded(summary.nrmse(paths, "l", "r"), 8, "nrmse")


@query(PART_SQL + """
SELECT cluster, round(sqrt(sum(w * w)), 8) AS norm
FROM (SELECT cluster, outcome / sum(outcome) OVER () AS w FROM part_panel) GROUP BY cluster""")
def weight_norm(spark, d):
    from ..operators.prep import attach

    panel = attach(staged_part_panel(spark, d).withColumn("everything", F.lit(1)), ["everything"],
                   {"total": F.sum("outcome")}, few_groups=True)
    weights = panel.withColumn("w", F.col("outcome") / F.col("total"))
    return rounded(summary.weight_norm(weights, "w", ["cluster"]), 8, "norm")


@query(PART_SQL + """
SELECT treated, time, round(avg(outcome), 4) AS outcome FROM panel GROUP BY 1, 2""")
def raw_paths(spark, d):
    return rounded(summary.group_means(complete_part_panel(spark, d), ["treated", "time"], ["outcome"]), 4, "outcome")


_CHANGE_SQL = PART_SQL + """, change AS (
    SELECT s.treated, (e.outcome - s.outcome) / nullif(s.outcome, 0) AS v
    FROM part_panel s JOIN part_panel e USING (unit) WHERE s.time = 1998 AND e.time = 2001 AND s.outcome <> 0),
"""


def _histogram_sql(bins: int, low: str, high: str) -> str:
    return _CHANGE_SQL + f"""
ends AS (SELECT CAST({low} AS DOUBLE) AS low, CAST({high} AS DOUBLE) AS high FROM change),
width AS (SELECT low, high, (high - low) / {bins - 1} AS w, low - ((high - low) / {bins - 1}) / 2 AS start FROM ends),
cells AS (SELECT treated, CAST(greatest(ceil((v - start) / w) - 1, 0) AS INTEGER) AS bin, count(*) AS n, any_value(w) AS w,
          any_value(start) AS start FROM change, width WHERE v BETWEEN low AND high GROUP BY 1, 2)
SELECT treated, bin, round(start + (bin + 0.5) * w, 8) AS centre, n,
       round(n / (sum(n) OVER (PARTITION BY treated) * w), 8) AS density FROM cells"""


@query(_histogram_sql(25, "-1.0", "6.0").replace("FROM change),\nwidth", "),\nwidth"))
def density_histogram(spark, d):
    out = summary.density_histogram(_changes(spark, d), "v", 25, ["treated"], (-1.0, 6.0))
    return rounded(out, 8, "centre", "density")


@query(_histogram_sql(20, "min(v)", "max(v)"))
def density_histogram_own_range(spark, d):
    out = summary.density_histogram(_changes(spark, d), "v", 20, ["treated"])
    return rounded(out, 8, "centre", "density")


def _changes(spark, d):
    from ..operators.prep import two_period_change

    out = two_period_change(part_panel(spark, d), ["outcome"], 1998, 2001, "unit", "time", ["treated"])
    return out.select("treated", F.col("outcome_pc").alias("v"))


_WELCH_SQL = PART_SQL + ", long AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, treated, {c} AS v FROM panel WHERE time = 2001"
    for c in ("outcome", *_VARIABLES)) + """),
g AS (SELECT variable, treated, count(v) AS n, avg(v) AS m, var_samp(v) / count(v) AS s FROM long GROUP BY 1, 2)
SELECT variable, round(t.m, 4) AS mean_treated, round(c.m, 4) AS mean_control, round(t.m - c.m, 4) AS difference,
       round((t.m - c.m) / sqrt(t.s + c.s), 8) AS t,
       round((t.s + c.s) * (t.s + c.s) / (t.s * t.s / (t.n - 1) + c.s * c.s / (c.n - 1)), 6) AS df
FROM g t JOIN g c USING (variable) WHERE t.treated = 1 AND c.treated = 0"""


@query(_WELCH_SQL)
def welch_t(spark, d):
    last = complete_part_panel(spark, d).filter("time = 2001")
    out = summary.welch_statistics(last, "treated", ["outcome", *_VARIABLES])
    return rounded(rounded(rounded(out, 4, "mean_treated", "mean_control", "difference"), 8, "t"), 6, "df")


@query(_WELCH_SQL.replace("SELECT variable, round(t.m, 4)", ", w AS (SELECT variable, round(t.m, 4)").replace(
    "AS mean_treated, round(c.m, 4) AS mean_control, round(t.m - c.m, 4) AS difference,",
    "AS mean_treated, t.m - c.m AS difference,").replace("round((t.m - c.m) / sqrt(t.s + c.s), 8) AS t,",
    "(t.m - c.m) / sqrt(t.s + c.s) AS t,").replace(", 6) AS df", ", 12) AS df") + f"""),
p AS (SELECT *, {p_value_sql('t', 'df')} AS p FROM w)
SELECT variable, round(difference, 4) AS difference, round(t, 8) AS t, round(df, 6) AS df, round(p, 8) AS p_value,
       {number_sql('difference', 2)} || {stars_sql('p')} AS label, '(' || {number_sql('t', 2)} || ')' AS t_label FROM p""")
def welch_report(spark, d):
    last = complete_part_panel(spark, d).filter("time = 2001")
    out = summary.welch_report(last, "treated", ["outcome", *_VARIABLES])
    return rounded(rounded(rounded(out, 4, "difference"), 8, "t", "p_value"), 6, "df")


@query(PART_SQL + f""", sums AS (
    SELECT cluster, sum(outcome) AS v FROM panel WHERE treated = 0 GROUP BY 1),
high AS (SELECT cluster FROM (SELECT *, dense_rank() OVER (ORDER BY v DESC) AS r FROM sums) WHERE r <= 10),
classed AS (
    SELECT *, CASE WHEN treated = 1 THEN 2 WHEN cluster IN (SELECT cluster FROM high) THEN 1 ELSE 0 END AS weight_class
    FROM panel WHERE time = 2001),
stats AS (
    SELECT weight_class, 'p_size' AS variable, avg(p_size) AS m, stddev_samp(p_size) AS s, count(*) AS n FROM classed GROUP BY 1
    UNION ALL
    SELECT weight_class, 'p_retailprice', avg(p_retailprice), stddev_samp(p_retailprice), count(*) FROM classed GROUP BY 1)
SELECT weight_class, variable, round(m, 6) AS mean, round(s, 6) AS sd, {_LABEL.format('m')} AS mean_label,
       '(' || {_LABEL.format('s')} || ')' AS sd_label, n FROM stats""")
def weight_class_table(spark, d):
    panel = complete_part_panel(spark, d)
    sums = panel.filter("treated = 0").groupBy("cluster").agg(F.sum("outcome").alias("v"))
    high = summary.top_ranks(sums, "v", 10).select("cluster")
    out = summary.weight_class_table(
        panel.filter("time = 2001"), "treated", "cluster", high, ["p_size", "p_retailprice"])
    return rounded(out, 6, "mean", "sd")


@query(PART_SQL + """
SELECT DISTINCT CASE WHEN cluster = 'Brand#1' THEN 'The First' ELSE cluster END AS cluster, p_type
FROM panel WHERE treated = 1""")
def treated_listing(spark, d):
    return summary.labelled_list(
        complete_part_panel(spark, d).filter("treated = 1"), ["cluster", "p_type"],
        {"cluster": {"Brand#1": "The First"}}, ["p_type", "cluster"])


@query(FLOW_SQL + """
SELECT year, home, work, quantity, rank FROM (
    SELECT *, CAST(dense_rank() OVER (PARTITION BY year, home ORDER BY quantity DESC) AS INTEGER) AS rank FROM flows)
WHERE rank <= 3""")
def top_ranks_with_ties(spark, d):
    return summary.top_ranks(nation_flows(spark, d), "quantity", 3, ["year", "home"]).drop("lines")


@query("""
SELECT o_orderkey, o_totalprice, rank FROM (
    SELECT o_orderkey, o_totalprice, CAST(dense_rank() OVER (ORDER BY o_totalprice DESC) AS INTEGER) AS rank FROM orders)
WHERE rank <= 10""")
def top_ranks_overall(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return summary.top_ranks(orders, "o_totalprice", 10)


@query("""
SELECT o_orderkey, o_totalprice, rank FROM (
    SELECT o_orderkey, o_totalprice, CAST(dense_rank() OVER (ORDER BY o_totalprice DESC) AS INTEGER) AS rank FROM orders)
WHERE rank <= 5000""")
def top_ranks_many(spark, d):
    """Thousands of ranks over the whole table, selected range by range."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return summary.top_ranks(orders, "o_totalprice", 5000)
