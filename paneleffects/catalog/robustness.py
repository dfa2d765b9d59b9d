"""Robustness queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import effects
from ..operators.prep import complete_units
from ..operators.unit_table import unit_table
from ..plans import robustness
from ..plans.estimate import fit, lasso_estimates, many_models
from ..sources.stages import driver_table, stage
from . import query
from .choice import CANDIDATES, LASSO_FEATURES, LASSO_GAMMA, lasso_sql, stepwise_sql
from .effects import (
    _FULL_SQL,
    PART_RECURSIVE,
    PART_ROWS,
    diagnostics_sql,
    folded_sql,
    leave_unit_out_sql,
    newton_weights_sql,
    number_sql,
    p_value_sql,
    rounded_report,
    slope_sql,
    stars_sql,
    time_weights_sql,
    unit_weights_sql,
    units_sql,
)
from .tables import (
    LAST,
    PART,
    PART_SQL,
    PERIODS,
    SUPPLIER_SQL,
    complete_part_panel,
    part_panel,
    part_units,
    rounded,
    supplier_units,
)


def _early(sql: str) -> str:
    """The panel of the early periods, complete over these alone."""
    return sql.replace(
        "panel AS (SELECT * FROM part_panel QUALIFY count(*) OVER (PARTITION BY unit) = 7)",
        "panel AS (SELECT * FROM part_panel WHERE time <= 1998 QUALIFY count(*) OVER (PARTITION BY unit) = 4)")


@query(_early(PART_SQL) + ", rows AS (SELECT *, 1.0 AS w FROM panel)"
       + slope_sql("effect", "rows", time_pre=1996)
       + "SELECT round(tau, 4) AS tau, observations FROM effect")
def backdating_uniform(spark, d):
    from ..operators.demean import twoway_effect

    early = complete_units(
        part_panel(spark, d).filter("time <= 1998"), "unit", 4, ["outcome", "p_size", "p_retailprice"])
    return twoway_effect(early, PART.with_(time_pre=1996)).withColumn("tau", F.round("tau", 4))


_EARLY_ROWS = [PART_ROWS[0], PART_ROWS[1], *PART_ROWS[4:]]
_BACKDATED_SQL = (
    _early(PART_RECURSIVE)
    + units_sql(_EARLY_ROWS, 2, 1996) + unit_weights_sql(4, 250, 2) + time_weights_sql(10, (1995, 1996), (1997, 1998))
    + ", rows AS MATERIALIZED (SELECT panel.*, unit_weight, time_weight, unit_shift, time_shift, "
      "unit_weight * time_weight AS w FROM panel JOIN uw USING (unit) JOIN tw USING (time))"
    + slope_sql("effect", "rows", time_pre=1996) + diagnostics_sql(PART.covariates, 1996)
    + ", folds AS (SELECT f.left_out, r.* FROM (SELECT DISTINCT cluster AS left_out FROM rows) f, rows r "
      "WHERE r.cluster <> f.left_out)"
    + slope_sql("refit", "folds", "left_out", 1996) + f"""
, v AS (SELECT any_value(e.tau) AS tau, any_value(e.tau) / sqrt((count(*) - 1.0) / count(*) * sum((f.tau - e.tau) ** 2)) AS t,
    CAST(count(*) - 1 AS DOUBLE) AS df FROM refit f, effect e),
p AS (SELECT *, {p_value_sql('t', 'df')} AS p FROM v)
SELECT 'treated' AS name, round(tau, 3) AS value, {number_sql('tau', 2)} || {stars_sql('p')} AS label FROM p
UNION ALL SELECT 't', round(t, 8), '(' || {number_sql('t', 2)} || ')' FROM p
UNION ALL SELECT name, round(value, 8), CASE WHEN name IN ('Units', 'Observations')
    THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE {number_sql('value', 4)} END FROM lines""")


@query(_BACKDATED_SQL)
def backdating(spark, d):
    table = robustness.backdated(
        part_units(spark, d, periods=range(1995, 1999)), 1998, 1996, cluster_errors=True).table()
    return table.select(
        "name", F.when(F.col("name") == "treated", F.round("value", 3)).otherwise(F.round("value", 8)).alias("value"),
        "label")


_PAIRS_SQL = SUPPLIER_SQL + """, sizes AS (
    SELECT cluster, count(DISTINCT unit) AS n FROM panel WHERE treated = 0 GROUP BY 1),
best AS (SELECT cluster FROM (SELECT *, dense_rank() OVER (ORDER BY n DESC) AS r FROM sizes) WHERE r <= 3),
rows AS (SELECT a.cluster AS first, b.cluster AS second, 100 * a.cluster + b.cluster AS pair, 1.0 AS w, p.*
    FROM best a JOIN best b ON a.cluster < b.cluster JOIN panel p ON p.cluster NOT IN (a.cluster, b.cluster))
"""


@query(_PAIRS_SQL + slope_sql("effect", "rows", "pair") + """
SELECT CAST(pair // 100 AS INTEGER) AS first, CAST(pair % 100 AS INTEGER) AS second, round(tau, 3) AS tau, observations FROM effect""")
def leave_two_out_uniform(spark, d):
    units = supplier_units(spark, d)
    base = fit(units, uniform=True, jackknife=False)
    ranked = effects.cluster_weights(base.weighted, 3).filter("NOT is_total")
    names = sorted(int(r["cluster"]) for r in ranked.collect())  # a few leading clusters
    pairs, model = robustness.leave_groups_out(units, names, uniform=True, jackknife=False)
    return driver_table(spark, {
        "first": ("int", [p[0] for p in pairs]),
        "second": ("int", [p[1] for p in pairs]),
        "tau": ("double", [round(model.estimates[s].tau, 3) for s in range(len(pairs))]),
        "observations": ("bigint", [model.estimates[s].observations for s in range(len(pairs))]),
    })


def _pairs_sql() -> str:
    """Report lines of every pair of the leading clusters: pair, name, value."""
    k = len(PART_ROWS)
    best = f"SELECT cluster FROM ({_chain_sql('outcome', PART_ROWS, PART.covariates, _LEADING_SQL)})"
    pair = lambda sql: folded_sql(sql, "pair")
    gaps = " ".join(
        f"UNION ALL SELECT pair, '{c}', (c - t) / t FROM (SELECT pair, sum(v * w) FILTER (treated = 0) AS c, "
        f"sum(v * w) FILTER (treated = 1) AS t FROM (SELECT DISTINCT pair, unit, treated, {c} AS v, unit_weight AS w FROM rows) GROUP BY pair)"
        for c in PART.covariates)
    return (
        PART_RECURSIVE.replace("panel AS (SELECT * FROM part_panel", "whole AS (SELECT * FROM part_panel") + f"""
, best AS MATERIALIZED ({best}),
pairs_left AS (SELECT row_number() OVER (ORDER BY a.cluster, b.cluster) AS pair, a.cluster AS first, b.cluster AS second
    FROM best a JOIN best b ON a.cluster < b.cluster),
panel AS MATERIALIZED (SELECT pair, whole.* FROM pairs_left JOIN whole ON cluster NOT IN (first, second))
""" + pair(units_sql(PART_ROWS)) + newton_weights_sql(k, 4, steps=12, fold="pair") + pair(time_weights_sql(600))
        + ", rows AS MATERIALIZED (SELECT panel.*, unit_weight, time_weight, unit_shift, time_shift, unit_weight * time_weight AS w "
          "FROM panel JOIN uw USING (pair, unit) JOIN tw USING (pair, time))"
        + slope_sql("effect", "rows", "pair") + leave_unit_out_sql("pair") + f"""
, v AS (SELECT pair, any_value(e.tau) AS tau, any_value(e.tau) / sqrt((count(*) - 1.0) / count(*) * sum((f.tau - e.tau) ** 2)) AS t
    FROM refit f JOIN effect e USING (pair) GROUP BY pair),
paths AS (SELECT pair, time, sum((outcome + unit_shift) * unit_weight) FILTER (treated = 1) AS treated,
    sum((outcome + unit_shift) * unit_weight) FILTER (treated = 0) AS control FROM rows GROUP BY pair, time),
spans AS (SELECT pair, unit, sum((outcome + time_shift) * time_weight) FILTER (time <= 1998) AS pre,
    sum((outcome + time_shift) * time_weight) FILTER (time > 1998) AS post FROM rows WHERE treated = 0 GROUP BY pair, unit),
lines AS (
    SELECT pair, 'treated' AS name, tau AS value FROM v UNION ALL SELECT pair, 't', t FROM v
    UNION ALL SELECT pair, 'omega', sqrt(avg((treated - control) ** 2)) / avg(treated) FROM paths WHERE time <= 1998 GROUP BY pair
    UNION ALL SELECT pair, 'lambda', sqrt(avg((post - pre) ** 2)) / avg(post) FROM spans GROUP BY pair
    {gaps}
    UNION ALL SELECT pair, 'Weight Norm', sqrt(sum(w * w)) FROM (
        SELECT DISTINCT pair, unit, unit_weight AS w FROM rows WHERE treated = 0) GROUP BY pair
    UNION ALL SELECT pair, 'Units', count(DISTINCT unit) FROM rows GROUP BY pair
    UNION ALL SELECT pair, 'Observations', count(*) FROM rows GROUP BY pair)
""")


_LEADING_SQL = """, sums AS (SELECT cluster, sum(unit_weight) AS v FROM (
    SELECT DISTINCT unit, cluster, unit_weight FROM rows WHERE treated = 0) GROUP BY cluster)
SELECT cluster FROM (SELECT *, dense_rank() OVER (ORDER BY v DESC) AS r FROM sums) WHERE r <= 10 AND v > 0"""


@query(lambda: _pairs_sql() + """
SELECT name, round(avg(value), 4) AS mean, round(min(value), 5) AS min, round(quantile_cont(value, 0.25), 5) AS p25,
    round(quantile_cont(value, 0.5), 5) AS p50, round(quantile_cont(value, 0.75), 5) AS p75, round(max(value), 5) AS max,
    count(value) AS n FROM lines GROUP BY name""")
def leave_two_out(spark, d):
    _, _, table = robustness.leave_two_out(part_units(spark, d))
    return rounded(table, 5, "min", "p25", "p50", "p75", "max")


_TRIM_SQL = (
    stepwise_sql(CANDIDATES[1:], ("p_size",)).replace(", units AS MATERIALIZED (", ", all_units AS MATERIALIZED (", 1)
    .replace("FROM units", "FROM all_units").replace("panel AS (SELECT * FROM part_panel", "whole AS (SELECT * FROM part_panel")
    .replace("FROM panel GROUP BY unit)", "FROM whole GROUP BY unit)"))


def _trim_sql() -> str:
    """The stepwise model's scores, the panel of the units within the bounds, and the report on it."""
    linear = list(CANDIDATES[1:]) + ["p_size"]
    n = len(linear)
    terms = [f"CAST({c} AS DOUBLE)" for c in linear] + [
        f"CAST({linear[a]} AS DOUBLE) * {linear[b]}" for a in range(n) for b in range(a + 1, n)]
    part = _FULL_SQL[_FULL_SQL.index(", units AS MATERIALIZED"):]
    return _TRIM_SQL + f"""
, scores AS (SELECT unit, 1 / (1 + exp(-(intercept + coalesce(list_sum([slopes[list_position(ord, t)] * v[t] FOR t IN ord]), 0)))) AS pscore
    FROM (SELECT unit, [{', '.join(terms)}] AS v FROM all_units), chosen),
panel AS MATERIALIZED (SELECT whole.* FROM whole JOIN scores USING (unit) WHERE pscore BETWEEN 0.1 AND 0.9)
""" + part.replace("steps", "steps")


@query(lambda: _trim_sql())
def pscore_trim(spark, d):
    units = part_units(spark, d)
    _, kept = robustness.trimmed_table(units, CANDIDATES[1:], ["p_size"])
    return rounded_report(fit(kept).table())


@query(lambda: _many_sql())
def many_outcomes(spark, d):
    """Two outcomes, each without and with covariates, side by side."""
    return robustness.results_side_by_side(_four_models(spark, d))


def _four_models(spark, d, jackknife=True):
    return many_models(part_panel(spark, d), [
        PART.with_(name="revenue", covariates=("p_size",)),
        PART.with_(name="revenue_covs"),
        PART.with_(name="quantity", outcome="quantity", covariates=("p_size",)),
        PART.with_(name="quantity_covs", outcome="quantity"),
    ], jackknife=jackknife, periods=PERIODS, incomplete="drop")


def _chain_sql(outcome: str, rows: list[str], covariates: tuple[str, ...], tail: str) -> str:
    """The weighted estimate of one model as a subquery ending in ``tail``."""
    base = PART_RECURSIVE.replace(
        "panel AS (SELECT * FROM part_panel",
        f"panel AS (SELECT unit, time, {outcome} AS outcome, treated, cluster, p_size, p_retailprice FROM part_panel")
    return (base + units_sql(rows) + unit_weights_sql(len(rows), 250) + time_weights_sql(900)
            + ", rows AS (SELECT panel.*, unit_weight, time_weight, unit_shift, time_shift, "
              "unit_weight * time_weight AS w FROM panel JOIN uw USING (unit) JOIN tw USING (time))"
            + slope_sql("effect", "rows") + diagnostics_sql(covariates) + tail)


_LABELS = f"""SELECT 'treated' AS name, {number_sql('tau', 2)} AS label FROM effect
UNION ALL SELECT name, CASE WHEN name IN ('Units', 'Observations') THEN CAST(CAST(value AS BIGINT) AS VARCHAR)
    ELSE {number_sql('value', 4)} END FROM lines UNION ALL SELECT 't', NULL"""
_MODELS = {
    "revenue": ("outcome", PART_ROWS[:5], ("p_size",)),
    "revenue_covs": ("outcome", PART_ROWS, PART.covariates),
    "quantity": ("quantity", PART_ROWS[:5], ("p_size",)),
    "quantity_covs": ("quantity", PART_ROWS, PART.covariates),
}


def _many_sql() -> str:
    """The side-by-side labels with stars and t values, by leave-one-unit-out errors."""
    tail = leave_unit_out_sql() + f"""
, v AS (SELECT any_value(e.tau) AS tau, any_value(e.tau) / sqrt((count(*) - 1.0) / count(*) * sum((f.tau - e.tau) ** 2)) AS t,
    CAST(6 * count(*) - 7 AS DOUBLE) AS df FROM refit f, effect e),
p AS (SELECT *, {p_value_sql('t', 'df')} AS p FROM v)
SELECT 'treated' AS name, {number_sql('tau', 2)} || {stars_sql('p')} AS label FROM p
UNION ALL SELECT 't', '(' || {number_sql('t', 2)} || ')' FROM p
UNION ALL SELECT name, CASE WHEN name IN ('Units', 'Observations') THEN CAST(CAST(value AS BIGINT) AS VARCHAR)
    ELSE {number_sql('value', 4)} END FROM lines"""
    models = " UNION ALL ".join(f"SELECT '{m}' AS model, * FROM ({_chain_sql(*parts, tail)})" for m, parts in _MODELS.items())
    columns = ", ".join(f"max(CASE WHEN model = '{m}' THEN label END) AS {m}" for m in _MODELS)
    return f"SELECT name, {columns} FROM ({models}) GROUP BY name"


_SIDE_BY_SIDE_SQL = "SELECT name, " + ", ".join(
    f"max(CASE WHEN model = '{m}' THEN label END) AS {m}" for m in _MODELS) + " FROM (" + " UNION ALL ".join(
    f"SELECT '{m}' AS model, * FROM ({_chain_sql(*parts, _LABELS)})" for m, parts in _MODELS.items()
) + ") GROUP BY name"


@query(_SIDE_BY_SIDE_SQL)
def many_outcomes_point(spark, d):
    """The side-by-side table without errors (no jackknife): effects and diagnostics."""
    return robustness.results_side_by_side(_four_models(spark, d, jackknife=False))


def _chosen_sql(outcome: str) -> str:
    """The estimate with the covariates that the lasso picks, out of all four choices."""
    rows = {"p_retailprice": PART_ROWS[5], "p_size": PART_ROWS[4]}
    every = [(), ("p_retailprice",), ("p_size",), ("p_retailprice", "p_size")]
    chains = " UNION ALL ".join(
        f"SELECT '{','.join(c)}' AS covariates, tau FROM ("
        + _chain_sql(outcome, [*PART_ROWS[:4], *[rows[x] for x in c]], c, "SELECT tau FROM effect") + ")"
        for c in every)
    return (f"SELECT '{outcome}' AS name, covariates, round(tau, 1) AS tau FROM ({chains}) JOIN ("
            "SELECT coalesce(string_agg(name, ',' ORDER BY name), '') AS covariates FROM ("
            f"{lasso_sql(outcome)}) WHERE selected AND name IN ('p_size', 'p_retailprice')) USING (covariates)")


@query(" UNION ALL ".join(_chosen_sql(x) for x in ("outcome", "quantity")))
def lasso_then_estimate(spark, d):
    """Two outcomes, each with the covariates its own lasso chooses."""
    panel = stage(complete_part_panel(spark, d), "panel")
    specs = [PART.with_(name=x, outcome=x, covariates=()) for x in ("outcome", "quantity")]
    models = lasso_estimates(
        panel, specs, LASSO_FEATURES[:2], ("p_retailprice", "p_size"), PERIODS, (1996, 1997),
        LASSO_GAMMA, 2, jackknife=False, unsettled="ignore")
    return driver_table(spark, {
        "name": ("string", [m.units.spec.name for m in models]),
        "covariates": ("string", [",".join(m.units.spec.covariates) for m in models]),
        "tau": ("double", [round(m.estimate.tau, 1) for m in models]),
    })


def _fixed_sql(outcome: str) -> str:
    """The estimate with one fixed covariate and the other if the lasso picks it."""
    rows = {"p_retailprice": PART_ROWS[5], "p_size": PART_ROWS[4]}
    chains = " UNION ALL ".join(
        f"SELECT '{','.join(c)}' AS covariates, '{','.join(c[1:])}' AS chosen, tau FROM ("
        + _chain_sql(outcome, [*PART_ROWS[:4], *[rows[x] for x in c]], c, "SELECT tau FROM effect") + ")"
        for c in (("p_size",), ("p_size", "p_retailprice")))
    return (f"SELECT '{outcome}' AS name, covariates, round(tau, 1) AS tau FROM ({chains}) JOIN ("
            "SELECT coalesce(string_agg(name, ',' ORDER BY name), '') AS chosen FROM ("
            f"{lasso_sql(outcome)}) WHERE selected AND name = 'p_retailprice') USING (chosen)")


@query(" UNION ALL ".join(_fixed_sql(x) for x in ("outcome", "quantity")))
def lasso_fixed_and_chosen(spark, d):
    """Two outcomes: part size always is a covariate, the price where the outcome's lasso chooses it."""
    panel = stage(complete_part_panel(spark, d), "panel")
    specs = [PART.with_(name=x, outcome=x, covariates=("p_size",)) for x in ("outcome", "quantity")]
    models = lasso_estimates(
        panel, specs, LASSO_FEATURES[:2], ("p_retailprice",), PERIODS, (1996, 1997),
        LASSO_GAMMA, 2, jackknife=False, unsettled="ignore")
    return driver_table(spark, {
        "name": ("string", [m.units.spec.name for m in models]),
        "covariates": ("string", [",".join(m.units.spec.covariates) for m in models]),
        "tau": ("double", [round(m.estimate.tau, 1) for m in models]),
    })


_TOP_SQL = """, sums AS (SELECT cluster, sum(unit_weight) AS v FROM (
    SELECT DISTINCT unit, cluster, unit_weight FROM rows WHERE treated = 0) GROUP BY cluster)
SELECT cluster FROM (SELECT *, dense_rank() OVER (ORDER BY v DESC) AS r FROM sums) WHERE r <= 3"""


@query(" UNION ".join(
    f"SELECT cluster FROM ({_chain_sql(*_MODELS[m], _TOP_SQL)})" for m in ("revenue_covs", "quantity_covs")))
def leading_cluster_union(spark, d):
    models = many_models(part_panel(spark, d), [
        PART, PART.with_(name="quantity", outcome="quantity")],
        jackknife=False, periods=PERIODS, incomplete="drop")
    return robustness.leading_cluster_union(models, 3)


