"""Key filters, lookups, stacking and naming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import bracketed, number_text, strip_markup
from ..operators import reshape
from . import query
from .tables import PART_SQL, complete_part_panel, part_panel, rounded, table

_LISTED_SQL = PART_SQL + """, listed AS (
    SELECT cluster FROM panel WHERE treated = 1 GROUP BY cluster
    HAVING sum(outcome) > (SELECT sum(outcome) FROM panel WHERE treated = 1)
                        / (SELECT count(DISTINCT cluster) FROM panel WHERE treated = 1))
"""


def _listed(spark, d):
    """Clusters whose treated outcome is above the clusters' average."""
    sums = complete_part_panel(spark, d).filter("treated = 1").groupBy("cluster").agg(
        F.sum("outcome").alias("total"))
    return sums.join(sums.agg(F.avg("total").alias("middle")), F.col("total") > F.col("middle"), "left_semi").select(
        "cluster")


@query(_LISTED_SQL + "SELECT unit, time, outcome FROM part_panel WHERE cluster IN (SELECT cluster FROM listed)")
def semi_filter(spark, d):
    return reshape.keep_keys(part_panel(spark, d), _listed(spark, d), "cluster").select("unit", "time", "outcome")


@query(_LISTED_SQL + "SELECT unit, time, outcome FROM part_panel WHERE cluster NOT IN (SELECT cluster FROM listed)")
def anti_filter(spark, d):
    return reshape.drop_keys(part_panel(spark, d), _listed(spark, d), "cluster").select("unit", "time", "outcome")


@query(PART_SQL + """
SELECT unit, time, outcome FROM part_panel
WHERE cluster NOT IN ('Brand#1', 'Brand#12', 'Brand#25') AND time BETWEEN 1996 AND 2000""")
def named_clusters_dropped(spark, d):
    return part_panel(spark, d).filter(
        ~F.col("cluster").isin("Brand#1", "Brand#12", "Brand#25") & F.col("time").between(1996, 2000)
    ).select("unit", "time", "outcome")


@query("""SELECT s_nationkey AS nation FROM supplier UNION SELECT c_nationkey FROM customer""")
def union_keys(spark, d):
    return reshape.union_keys(
        table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")),
        table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")))


@query("""
SELECT c_nationkey AS nation, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance FROM customer
UNION ALL SELECT s_nationkey, s_name, NULL, s_acctbal FROM supplier""")
def stack_rows(spark, d):
    return reshape.stack_rows(
        table(spark, d, "customer").select(
            F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"),
            F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")),
        table(spark, d, "supplier").select(
            F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"),
            F.col("s_acctbal").alias("balance")))


@query("""
SELECT c_custkey AS customer, n_name AS nation, r_name AS region
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def left_lookup(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    return (
        table(spark, d, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select(F.col("c_custkey").alias("customer"), F.col("n_name").alias("nation"),
                F.col("r_name").alias("region")))


@query("""
SELECT n_name AS nation, CAST(count(s_suppkey) AS BIGINT) AS suppliers
FROM (SELECT * FROM supplier WHERE s_acctbal > 9000) RIGHT JOIN nation ON s_nationkey = n_nationkey
GROUP BY n_name""")
def right_lookup(spark, d):
    rich = table(spark, d, "supplier").filter("s_acctbal > 9000")
    return (
        rich.join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "right")
        .groupBy(F.col("n_name").alias("nation")).agg(F.count("s_suppkey").alias("suppliers")))


@query(PART_SQL + """, a AS (SELECT unit, sum(outcome) AS early FROM part_panel WHERE time <= 1998 AND treated = 1 GROUP BY 1),
b AS (SELECT unit, sum(outcome) AS late FROM part_panel WHERE time > 1998 GROUP BY 1)
SELECT unit, round(coalesce(early, 0.0), 4) AS early, round(coalesce(late, -1.0), 4) AS late
FROM a FULL JOIN b USING (unit)""")
def full_join_defaults(spark, d):
    panel = part_panel(spark, d)
    early = panel.filter("time <= 1998 AND treated = 1").groupBy("unit").agg(F.sum("outcome").alias("early"))
    late = panel.filter("time > 1998").groupBy("unit").agg(F.sum("outcome").alias("late"))
    out = reshape.with_defaults(early, late, ["unit"], {"early": F.lit(0.0), "late": F.lit(-1.0)})
    return rounded(out, 4, "early", "late")


@query("""WITH lines AS (
    SELECT 'lines' AS model, l_returnflag AS name, avg(l_quantity) AS v FROM lineitem GROUP BY 2
    UNION ALL SELECT 'rows', o_orderstatus, avg(o_totalprice) FROM orders GROUP BY 2
    UNION ALL SELECT 'size', l_linestatus, avg(l_discount) FROM lineitem GROUP BY 2)
SELECT name, round(max(CASE WHEN model = 'lines' THEN v END), 4) AS lines,
       round(max(CASE WHEN model = 'rows' THEN v END), 4) AS rows,
       round(max(CASE WHEN model = 'size' THEN v END), 6) AS size
FROM lines GROUP BY name""")
def full_outer_results(spark, d):
    line, orders = table(spark, d, "lineitem"), table(spark, d, "orders")

    def means(df, model, name, value):
        return df.groupBy(F.col(name).alias("name")).agg(F.avg(value).alias("v")).select(
            F.lit(model).alias("model"), "name", "v")

    lines = reshape.stack_rows(
        means(line, "lines", "l_returnflag", "l_quantity"),
        means(orders, "rows", "o_orderstatus", "o_totalprice"),
        means(line, "size", "l_linestatus", "l_discount"))
    out = reshape.side_by_side(lines, "name", "model", "v", ["lines", "rows", "size"])
    return rounded(rounded(out, 4, "lines", "rows"), 6, "size")


@query(PART_SQL + """
SELECT p_partkey AS unit, CASE WHEN t IS NULL THEN 0 WHEN t = 0 THEN 1 WHEN t = 1 THEN 2 END AS class
FROM part LEFT JOIN (SELECT DISTINCT unit, treated AS t FROM panel) ON unit = p_partkey""")
def sample_classes(spark, d):
    sample = complete_part_panel(spark, d).select("unit", "treated").distinct()
    everyone = table(spark, d, "part").select(F.col("p_partkey").alias("unit"))
    t = F.col("treated")
    return everyone.join(sample, "unit", "left").select(
        "unit", F.when(t.isNull(), 0).when(t == 0, 1).when(t == 1, 2).alias("class"))


@query(PART_SQL + """
SELECT unit, time, flag_a AS w_flag_a_base, flag_n AS w_flag_n_base, flag_r AS w_flag_r_base FROM part_panel""")
def renamed_columns(spark, d):
    panel = part_panel(spark, d)
    flags = reshape.columns_matching(panel, "^flag_")
    return reshape.affix_columns(panel.select("unit", "time", *flags), "w_", "_base", keep=["unit", "time"])


@query(PART_SQL + """, m AS (
    SELECT treated, round(avg(outcome), 2) AS outcome, round(avg(quantity), 4) AS quantity FROM panel GROUP BY 1)
SELECT 'outcome' AS name, max(CASE WHEN treated = 0 THEN CAST(outcome AS VARCHAR) END) AS "0",
       max(CASE WHEN treated = 1 THEN CAST(outcome AS VARCHAR) END) AS "1" FROM m
UNION ALL SELECT 'quantity', max(CASE WHEN treated = 0 THEN CAST(quantity AS VARCHAR) END),
       max(CASE WHEN treated = 1 THEN CAST(quantity AS VARCHAR) END) FROM m""")
def transposed_means(spark, d):
    means = complete_part_panel(spark, d).groupBy("treated").agg(
        F.round(F.avg("outcome"), 2).alias("outcome"), F.round(F.avg("quantity"), 4).alias("quantity"))
    return reshape.transpose(means, "treated", ["0", "1"], ["outcome", "quantity"])


@query(r"""
SELECT o_orderpriority AS name, regexp_replace(CAST(CAST(round_even(avg(o_totalprice), 2) AS DECIMAL(38,2)) AS VARCHAR),
       '\.?0+$', '') AS mean_label,
       '(' || regexp_replace(CAST(CAST(round_even(stddev_samp(o_totalprice), 2) AS DECIMAL(38,2)) AS VARCHAR),
       '\.?0+$', '') || ')' AS sd_label,
       CAST(regexp_replace(CAST(CAST(round_even(avg(o_totalprice), 2) AS DECIMAL(38,2)) AS VARCHAR),
       '\.?0+$', '') AS DOUBLE) AS parsed
FROM orders GROUP BY 1""")
def report_labels(spark, d):
    out = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(
        F.avg("o_totalprice").alias("m"), F.stddev_samp("o_totalprice").alias("s"))
    label = number_text("m", 2)
    marked = F.concat(F.lit("$"), label, F.lit("^{***}$"))
    return out.select(
        "name", label.alias("mean_label"), bracketed("s", 2).alias("sd_label"),
        strip_markup(marked).cast("double").alias("parsed"))
