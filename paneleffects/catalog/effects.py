"""Weights, effect estimates and jackknife queries.

The SQL solves the same problems in other ways: unit weights by a damped diagonal
iteration on the optimality conditions, time weights by exchanging weight between pairs
of periods, leave-out estimates by demeaning and re-fitting without each unit or cluster.
"""

from __future__ import annotations

import functools
import re
from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import effects, summary, weights
from ..operators.demean import twoway_demean, twoway_effect
from ..operators.unit_table import SCENARIO, unit_table
from ..plans.estimate import fit, interaction_effect, time_weight_table
from ..sources.stages import driver_table
from . import query
from .tables import (
    PART,
    PART_SQL,
    PERIODS,
    SUPPLIER,
    SUPPLIER_SQL,
    complete_part_panel,
    part_units,
    rounded,
    supplier_panel,
    supplier_units,
)

PART_RECURSIVE = PART_SQL.replace("WITH flow", "WITH RECURSIVE flow", 1)
_PART_ROWS = [f"max(CASE WHEN time = {t} THEN outcome END)" for t in (1995, 1996, 1997, 1998)]
PART_ROWS = [*_PART_ROWS, "CAST(max(p_size) AS DOUBLE)", "max(p_retailprice)"]
SUPPLIER_ROWS = [*_PART_ROWS, "max(s_acctbal)"]


# ------------------------------------------------------------------ SQL building blocks


def units_sql(rows: list[str], n_pre: int = 4, time_pre: int = 1998) -> str:
    """Unit rows (pre-periods first, then covariates), their statistics and the ridge strength."""
    cols = ", ".join(f"{e} AS a{k}" for k, e in enumerate(rows))
    stats = ", ".join(
        f"avg(a{k}) FILTER (d = 1) AS b{k}, avg(a{k}) FILTER (d = 0) AS m{k}, "
        f"stddev_samp(a{k}) FILTER (d = 0) AS s{k}, var_samp(a{k}) FILTER (d = 1) AS v{k}"
        for k in range(len(rows)))
    nd = ", ".join(f"abs(b{k} - m{k}) / sqrt((v{k} + s{k} * s{k}) / 2)" for k in range(len(rows)))
    return f"""
, units AS MATERIALIZED (SELECT unit, max(treated) AS d, any_value(cluster) AS cluster, {cols},
    avg(CASE WHEN time > {time_pre} THEN outcome END) AS p FROM panel GROUP BY unit),
st AS (SELECT count(*) FILTER (d = 0) AS n0, count(*) FILTER (d = 1) AS n1, {stats} FROM units),
ridge AS (SELECT *, 1 / greatest({nd}) AS zeta, {n_pre - 1} / greatest({nd}) AS eta,
    least({', '.join(f's{k}' for k in range(n_pre))}) AS s_min FROM st)
"""


def unit_weights_sql(r: int, steps: int, n_pre: int = 4) -> str:
    ks = range(r)
    z = ", ".join(f"(a{k} - b{k}) / s{k} AS z{k}" for k in ks)
    c = ", ".join(f"s_min / s{k} AS c{k}" if k < n_pre else f"0.0 AS c{k}" for k in ks)
    q = ", ".join(f"q{k}" for k in ks)
    fit_ = " + ".join(f"q{k} * z{k}" for k in ks)
    sums = ", ".join(f"sum(w * z{k}) AS t{k}, sum(CASE WHEN w > 0 THEN z{k} * z{k} ELSE 0 END) AS g{k}" for k in ks)
    top = " + ".join(f"c{k} * (q{k} - (eta * q{k} - t{k}) / (eta + g{k}))" for k in ks)
    low = " + ".join(f"c{k} * c{k} / (eta + g{k})" for k in ks)
    new = ", ".join(f"q{k} - 0.3 * (eta * q{k} - t{k} - c{k} * w0) / (eta + g{k})" for k in ks)
    return f"""
, z AS MATERIALIZED (SELECT unit, {z} FROM units, st WHERE d = 0),
c AS (SELECT {c}, eta, n0, s_min FROM ridge),
solve(i, {q}, mu, w0) AS (
    SELECT 0, {', '.join('CAST(0 AS DOUBLE)' for _ in ks)}, 1.0 / n0, CAST(0 AS DOUBLE) FROM c
    UNION ALL
    SELECT i + 1, {new}, mu + 0.3 * (1 - sw) / n, w0 FROM (
        SELECT s.* EXCLUDE (w0), c.*, -({top}) / ({low}) AS w0 FROM (
            SELECT i, {q}, mu, w0, sum(w) AS sw, count(*) FILTER (w > 0) AS n, {sums}
            FROM (SELECT solve.*, z.*, greatest(0, mu - ({fit_})) AS w FROM solve, z WHERE i < {steps})
            GROUP BY i, {q}, mu, w0) s, c)),
dual AS (SELECT * FROM solve WHERE i = {steps}),
uw AS MATERIALIZED (
    SELECT unit, 0 AS d, greatest(0, mu - ({fit_})) AS unit_weight, w0 * s_min AS unit_shift FROM z, dual, c
    UNION ALL SELECT unit, 1, CAST(1 AS DOUBLE) / n1, 0 FROM units, st WHERE d = 1)
"""


def newton_weights_sql(r: int, n_pre: int, covariates: bool = True, steps: int = 30, fold: str | None = None) -> str:
    """``uw`` by Newton steps on the optimality conditions over the active controls, from ``folded_units_sql``.

    Each step eliminates the bordered system on lists. Without covariates all rows have one scale.
    """
    f, by = (f"{fold}, ", f"USING ({fold})") if fold else ("", None)
    join = lambda x: f"JOIN {x} {by}" if by else f"CROSS JOIN {x}"
    ks = range(r)
    scale = lambda k: f"s{k}" if covariates else "common"
    z = "[" + ", ".join(f"(a{k} - b{k}) / {scale(k)}" for k in ks) + "]"
    c = "[" + ", ".join((f"unit0 / {scale(k)}" if k < n_pre else "0.0::DOUBLE") for k in ks) + "]"
    unit0 = f"least({', '.join(f's{k}' for k in range(n_pre))})" if covariates else "common"
    common = f"sqrt(({' + '.join(f's{k} * s{k}' for k in ks)}) / {r})"
    cells = ", ".join(f"sum(CASE WHEN w > 0 THEN z[{a + 1}] * z[{b + 1}] ELSE 0 END) AS h{a}_{b}" for a in ks for b in range(a, r))
    sums = ", ".join(f"sum(CASE WHEN w > 0 THEN z[{k + 1}] ELSE 0 END) AS z{k}, sum(w * z[{k + 1}]) AS t{k}" for k in ks)
    rows = [
        "[" + ", ".join([f"h{min(a, b)}_{max(a, b)}" + (" + eta" if a == b else "") for b in ks]
                        + [f"-z{a}", f"c[{a + 1}]", f"t{a} - eta * q[{a + 1}]"]) + "]" for a in ks]
    rows.append("[" + ", ".join([f"-z{a}" for a in ks] + ["CAST(n AS DOUBLE)", "0.0::DOUBLE", "1 - sw"]) + "]")
    rows.append("[" + ", ".join([f"c[{a + 1}]" for a in ks] + ["0.0::DOUBLE", "0.0::DOUBLE", "-list_dot_product(c, q)"]) + "]")
    pivots = ", ".join(f"[[{float(k + 1)}]]" for k in range(r + 2))
    at = "CAST(k[1][1] AS INTEGER)"
    solved = (f"list_reduce(list_concat([[{', '.join(rows)}]], [{pivots}]), lambda m, k: list_transform(m, lambda v, i: "
              f"CASE WHEN i = k[1][1] THEN list_transform(v, lambda x: x / v[{at}]) "
              f"ELSE list_transform(v, lambda x, j: x - v[{at}] * m[{at}][j] / m[{at}][{at}]) END))")
    return f"""
, scaled AS (SELECT *, {unit0} AS unit0, {'eta' if covariates else 'eta / (common * common)'} AS ridge_eta
    FROM (SELECT *, {common} AS common FROM ridge)),
z AS MATERIALIZED (SELECT {f}unit, {z} AS z FROM units {join('(SELECT ' + f + ', '.join(f'b{k}, s{k}' for k in ks) + ', common FROM scaled)')} WHERE d = 0),
c AS MATERIALIZED (SELECT {f}{c} AS c, ridge_eta AS eta, n0, unit0 FROM scaled),
solve(i, {f}q, mu, nu) AS (
    SELECT 0, {f}[{', '.join('0.0::DOUBLE' for _ in ks)}], CAST(1 AS DOUBLE) / n0, CAST(0 AS DOUBLE) FROM c
    UNION ALL
    SELECT i + 1, {f}list_transform(q, lambda v, k: v + x[k][{r + 3}]), mu + x[{r + 1}][{r + 3}], x[{r + 2}][{r + 3}] FROM (
        SELECT i, {f}q, mu, {solved} AS x FROM (
            SELECT i, {f}q, mu, sum(w) AS sw, count(*) FILTER (w > 0) AS n, any_value(c) AS c, any_value(eta) AS eta, {cells}, {sums}
            FROM (SELECT i, {f}q, mu, z, c, eta, greatest(0, mu - list_dot_product(q, z)) AS w
                  FROM solve {join('z')} {join('c')} WHERE i < {steps})
            GROUP BY i, {f}q, mu))),
dual AS MATERIALIZED (SELECT * FROM solve WHERE i = {steps}),
uw AS MATERIALIZED (
    SELECT {f}unit, 0 AS d, greatest(0, mu - list_dot_product(q, z)) AS unit_weight, -nu * unit0 AS unit_shift
    FROM z {join('dual')} {join('c')}
    UNION ALL SELECT {f}unit, 1, CAST(1 AS DOUBLE) / n1, 0 FROM units {join('(SELECT ' + f + 'n1 FROM ridge)')} WHERE d = 1)
"""


def folded_sql(sql: str, fold: str) -> str:
    """``units_sql`` or ``time_weights_sql`` for every fold of ``panel`` at once."""
    out = sql.replace("SELECT unit, max(treated)", f"SELECT {fold}, unit, max(treated)").replace(
        "FROM panel GROUP BY unit", f"FROM panel GROUP BY {fold}, unit")
    out = out.replace("st AS (SELECT count(*)", f"st AS (SELECT {fold}, count(*)").replace(
        "FROM units),\nridge", f"FROM units GROUP BY {fold}),\nridge")
    out = out.replace("gram AS MATERIALIZED (SELECT [", f"gram AS MATERIALIZED (SELECT {fold}, [").replace(
        "FROM units WHERE d = 0),\npairs", f"FROM units WHERE d = 0 GROUP BY {fold}),\npairs")
    out = out.replace("trade(i, x) AS (\n    SELECT 0, [", f"trade(i, {fold}, x) AS (\n    SELECT 0, {fold}, [").replace(
        "]\n    UNION ALL\n    SELECT i + 1, [CASE", f"] FROM gram\n    UNION ALL\n    SELECT i + 1, {fold}, [CASE")
    out = out.replace("SELECT i, x, a, b, least", f"SELECT i, {fold}, x, a, b, least").replace(
        "FROM (SELECT i, x, p[", f"FROM (SELECT i, {fold}, x, p[")
    out = re.sub(r"(WHERE i < \d+\)), gram\)\)", rf"\1 JOIN gram USING ({fold})))", out)
    out = re.sub(r"SELECT (\[[0-9, ]+\])\[k\] AS time", rf"SELECT {fold}, \1[k] AS time", out)
    out = re.sub(r"FROM \(SELECT x FROM trade WHERE i = (\d+)\), gram, ", rf"FROM (SELECT {fold}, x FROM trade WHERE i = \1) JOIN gram USING ({fold}), ", out)
    return re.sub(r"SELECT unnest\((\[[0-9, ]+\])\), (CAST\(1 AS DOUBLE\) / \d), 0\)", rf"SELECT {fold}, unnest(\1), \2, 0 FROM gram)", out)


def time_weights_sql(steps: int, pre: tuple[int, ...] = (1995, 1996, 1997, 1998),
                     post: tuple[int, ...] = (1999, 2000, 2001)) -> str:
    n = len(pre)
    ks = ", ".join(str(k + 1) for k in range(n))
    pairs = [[a + 1, b + 1] for a in range(n) for b in range(a + 1, n)]
    g = ", ".join("[" + ", ".join(f"covar_pop(a{j}, a{k})" for k in range(n)) + "]" for j in range(n))
    h = ", ".join(f"covar_pop(a{j}, p)" for j in range(n))
    means = ", ".join(f"avg(a{j})" for j in range(n))
    return f"""
, gram AS MATERIALIZED (SELECT [{g}] AS g, [{h}] AS h, [{means}] AS m, avg(p) AS mp FROM units WHERE d = 0),
pairs AS (SELECT {pairs} AS p),
trade(i, x) AS (
    SELECT 0, [{', '.join(f'CAST(1 AS DOUBLE) / {n}' for _ in pre)}]
    UNION ALL
    SELECT i + 1, [CASE k WHEN a THEN x[k] + step WHEN b THEN x[k] - step ELSE x[k] END FOR k IN [{ks}]] FROM (
        SELECT i, x, a, b, least(greatest((
            (list_dot_product(g[b], x) - h[b]) - (list_dot_product(g[a], x) - h[a])) / (g[a][a] + g[b][b] - 2 * g[a][b]),
            -x[a]), x[b]) AS step
        FROM (SELECT i, x, p[i % {len(pairs)} + 1][1] AS a, p[i % {len(pairs)} + 1][2] AS b
              FROM trade, pairs WHERE i < {steps}), gram)),
tw AS MATERIALIZED (
    SELECT {list(pre)}[k] AS time, x[k] AS time_weight, mp - list_dot_product(m, x) AS time_shift
    FROM (SELECT x FROM trade WHERE i = {steps}), gram, (SELECT unnest([{ks}]) AS k)
    UNION ALL SELECT unnest({list(post)}), CAST(1 AS DOUBLE) / {len(post)}, 0)
"""


def p_value_sql(t: str, df: str) -> str:
    """Two-sided p of Student's t by Simpson's rule on its density."""
    h = f"(abs({t}) / 2000)"
    density = f"pow(1 + pow(k * {h}, 2) / ({df}), -(({df}) + 1) / 2)"
    weight = "CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    area = f"list_sum([{weight} * {density} FOR k IN range(2001)]) * {h} / 3"
    return (f"(1 - 2 * {area} * exp(lgamma((({df}) + 1) / 2) - lgamma(({df}) / 2)) / sqrt(({df}) * pi()))")


def stars_sql(p: str) -> str:
    return f"CASE WHEN {p} <= 0.01 THEN '***' WHEN {p} <= 0.05 THEN '**' WHEN {p} <= 0.1 THEN '*' ELSE '' END"


def number_sql(x: str, digits: int) -> str:
    return (rf"regexp_replace(CAST(CAST(round_even({x}, {digits}) AS DECIMAL(38,{digits})) AS VARCHAR), "
            rf"'\.?0+$', '')")


def slope_sql(name: str, source: str, fold: str | None = None, time_pre: int = 1998) -> str:
    """tau per fold from rows (fold, unit, time, outcome, treated, w), demeaned within the fold."""
    f, by = (f"{fold}, ", f"PARTITION BY {fold}") if fold else ("", "")
    one = f"PARTITION BY {f}"
    return f"""
, {name}_x AS (
    SELECT {f}w, outcome - avg(outcome) OVER ({one}unit) - avg(outcome) OVER ({one}time) + avg(outcome) OVER ({by}) AS y,
        x - avg(x) OVER ({one}unit) - avg(x) OVER ({one}time) + avg(x) OVER ({by}) AS x
    FROM (SELECT *, CASE WHEN time > {time_pre} THEN treated ELSE 0 END AS x FROM {source})),
{name} AS (SELECT {f}count(*) AS observations,
    (sum(w * x * y) * sum(w) - sum(w * x) * sum(w * y)) / nullif(sum(w * x * x) * sum(w) - sum(w * x) * sum(w * x), 0) AS tau
    FROM {name}_x {'GROUP BY ' + fold if fold else ''})
"""


def leave_unit_out_sql(fold: str | None = None) -> str:
    """Leave-one-unit-out estimates ``refit`` from ``rows`` (unit_weight, time_weight), by the sums of the units that stay.

    Without unit v every other demeaned outcome moves by v's over the units left, likewise the
    demeaned treatment, so each refit is a formula in totals and v's own sums.
    """
    f, by = (f"{fold}, ", f"PARTITION BY {fold}") if fold else ("", "")
    one, group = f"PARTITION BY {f}", f"GROUP BY {fold}" if fold else ""
    join = f"JOIN {{}} USING ({fold})" if fold else "CROSS JOIN {}"
    return f"""
, lu AS MATERIALIZED (SELECT {f}unit, any_value(treated) AS d, any_value(unit_weight) AS w, sum(time_weight * y) AS a,
    sum(time_weight * h * y) AS b FROM (
        SELECT *, outcome - avg(outcome) OVER ({one}unit) - avg(outcome) OVER ({one}time) + avg(outcome) OVER ({by}) AS y,
            CASE WHEN time > 1998 THEN 1 ELSE 0 END - CAST(3 AS DOUBLE) / 7 AS h FROM rows)
    GROUP BY {f}unit),
lm AS (SELECT {f}avg(d) AS share FROM lu {group}),
lv AS MATERIALIZED (SELECT lu.*, d - share AS u FROM lu {join.format('lm')}),
lt AS (SELECT {f}count(*) AS n, sum(d) AS nd, sum(w) AS w0, sum(w * a) AS wa, sum(w * b) AS wb, sum(w * u) AS wu,
    sum(w * u * b) AS wub, sum(w * u * u) AS wuu FROM lv {group}),
ll AS (SELECT {f}sum(l) AS l0, sum(l * h) AS l1, sum(l * h * h) AS l2 FROM (
    SELECT {f}any_value(time_weight) AS l, any_value(CASE WHEN time > 1998 THEN 1 ELSE 0 END) - CAST(3 AS DOUBLE) / 7 AS h
    FROM rows GROUP BY {f}time) {group}),
lr AS (SELECT {f}unit, l0, l1, l2, n - 1 AS n, nd - d AS nd, w0 - w AS w0, wa - w * a AS wa, wb - w * b AS wb, wu - w * u AS wu,
    wub - w * u * b AS wub, wuu - w * u * u AS wuu, a / (n - 1) AS da, b / (n - 1) AS db, u / (n - 1) AS du
    FROM lv {join.format('lt')} {join.format('ll')}),
refit AS (SELECT {f}unit, CASE WHEN nd > 0 AND nd < n THEN
    ((wub + db * wu + du * wb + du * db * w0) * (w0 * l0) - l1 * (wu + du * w0) * (wa + da * w0))
    / (l2 * (wuu + 2 * du * wu + du * du * w0) * (w0 * l0) - l1 * l1 * (wu + du * w0) * (wu + du * w0)) END AS tau FROM lr)
"""


# ------------------------------------------------------------------ regularization, weights


def _differences_sql(base: str, covariates: tuple[str, ...]) -> str:
    rows = "SELECT unit, treated, CAST(time AS VARCHAR) AS name, outcome AS v FROM panel WHERE time <= 1998"
    for c in covariates:
        rows += f" UNION ALL SELECT DISTINCT unit, treated, '{c}', CAST({c} AS DOUBLE) FROM panel"
    return base + f""", long AS ({rows}),
g AS (SELECT name, treated, avg(v) AS m, var_samp(v) AS s FROM long GROUP BY 1, 2),
nd AS (SELECT name, abs(t.m - c.m) / sqrt((t.s + c.s) / 2) AS nd FROM g t JOIN g c USING (name)
       WHERE t.treated = 1 AND c.treated = 0)
SELECT name, round(nd, 8) AS difference, round(1 / max(nd) OVER (), 8) AS zeta FROM nd"""


def _differences(spark, units):
    stats = weights.group_stats(units)[0]
    found = weights.normalized_differences(units, stats)
    return driver_table(spark, {
        "name": ("string", list(found)),
        "difference": ("double", [round(float(v), 8) for v in found.values()]),
        "zeta": ("double", [round(weights.regularization(units, stats), 8)] * len(found)),
    })


@query(_differences_sql(PART_SQL, ()))
def regularization(spark, d):
    return _differences(spark, part_units(spark, d, PART.with_(covariates=())))


@query(_differences_sql(PART_SQL, PART.covariates))
def regularization_covariates(spark, d):
    return _differences(spark, part_units(spark, d))


@query(PART_RECURSIVE + units_sql(PART_ROWS) + unit_weights_sql(6, 250) + """
SELECT unit, d AS treated, round(unit_weight, 11) AS unit_weight, round(unit_shift, 3) AS unit_shift FROM uw""")
def unit_weights_cov(spark, d):
    model = fit(part_units(spark, d), jackknife=False)
    out = model.unit_weights().drop(SCENARIO).withColumn("treated", F.col("treated").cast("int"))
    return rounded(rounded(out, 11, "unit_weight"), 3, "unit_shift")


@query(PART_RECURSIVE + units_sql(PART_ROWS[:4]) + newton_weights_sql(4, 4, covariates=False) + """
SELECT unit, d AS treated, round(unit_weight, 9) AS unit_weight, round(unit_shift, 2) AS unit_shift FROM uw""")
def unit_weights(spark, d):
    model = fit(part_units(spark, d, PART.with_(covariates=())), jackknife=False)
    out = model.unit_weights().drop(SCENARIO).withColumn("treated", F.col("treated").cast("int"))
    return rounded(rounded(out, 9, "unit_weight"), 2, "unit_shift")


@query(PART_RECURSIVE + units_sql(PART_ROWS) + time_weights_sql(900) + """
SELECT CAST(time AS INTEGER) AS time, round(time_weight, 8) AS time_weight, round(time_shift, 2) AS time_shift FROM tw""")
def time_weights(spark, d):
    units = part_units(spark, d)
    stats = weights.group_stats(units)
    solved = weights.solve_time_weights(units, stats, weights.control_moments(units, stats))
    out = time_weight_table(spark, units, effects.time_profiles(units, stats, solved)).drop(SCENARIO)
    return rounded(rounded(out, 8, "time_weight"), 2, "time_shift")


# ------------------------------------------------------------------ two-way fixed effects


@query(PART_SQL + """
SELECT unit, time, treated AS treatment_id,
    round(outcome - avg(outcome) OVER (PARTITION BY unit) - avg(outcome) OVER (PARTITION BY time) + avg(outcome) OVER (), 4)
        AS outcome_twfe,
    round(x - avg(x) OVER (PARTITION BY unit) - avg(x) OVER (PARTITION BY time) + avg(x) OVER (), 8) AS treatment_twfe
FROM (SELECT *, CASE WHEN time > 1998 THEN treated ELSE 0 END AS x FROM panel)""")
def twfe_demean(spark, d):
    out = twoway_demean(complete_part_panel(spark, d), PART).select(
        "unit", "time", "treatment_id", "outcome_twfe", "treatment_twfe")
    return rounded(rounded(out, 4, "outcome_twfe"), 8, "treatment_twfe")


@query(PART_SQL + ", rows AS (SELECT *, 1.0 AS w FROM panel)" + slope_sql("effect", "rows")
       + "SELECT round(tau, 4) AS tau, observations FROM effect")
def did_uniform(spark, d):
    return rounded(twoway_effect(complete_part_panel(spark, d), PART), 4, "tau")


# ------------------------------------------------------------------ full estimate


def _sdid_sql(base: str, rows: list[str], steps: int) -> str:
    return (base + units_sql(rows) + unit_weights_sql(len(rows), steps) + time_weights_sql(900)
            + ", rows AS (SELECT panel.*, unit_weight, time_weight, unit_shift, time_shift, "
              "unit_weight * time_weight AS w FROM panel JOIN uw USING (unit) JOIN tw USING (time))"
            + slope_sql("effect", "rows"))


def diagnostics_sql(covariates: tuple[str, ...], time_pre: int = 1998) -> str:
    """Prediction errors, covariate gaps and weight norm as (name, value) lines."""
    gaps = " ".join(
        f"UNION ALL SELECT '{c}', (c - t) / t FROM (SELECT sum(v * w) FILTER (treated = 0) AS c, "
        f"sum(v * w) FILTER (treated = 1) AS t FROM (SELECT DISTINCT unit, treated, {c} AS v, unit_weight AS w FROM rows))"
        for c in covariates)
    return f"""
, paths AS (SELECT time, sum((outcome + unit_shift) * unit_weight) FILTER (treated = 1) AS treated,
    sum((outcome + unit_shift) * unit_weight) FILTER (treated = 0) AS control, any_value(time_weight) AS time_weight
    FROM rows GROUP BY time),
spans AS (SELECT unit, sum((outcome + time_shift) * time_weight) FILTER (time <= {time_pre}) AS pre,
    sum((outcome + time_shift) * time_weight) FILTER (time > {time_pre}) AS post FROM rows WHERE treated = 0 GROUP BY unit),
lines AS (
    SELECT 'omega' AS name, sqrt(avg((treated - control) ** 2)) / avg(treated) AS value FROM paths WHERE time <= {time_pre}
    UNION ALL SELECT 'lambda', sqrt(avg((post - pre) ** 2)) / avg(post) FROM spans
    {gaps}
    UNION ALL SELECT 'Weight Norm', sqrt(sum(w * w)) FROM (SELECT DISTINCT unit, unit_weight AS w FROM rows WHERE treated = 0)
    UNION ALL SELECT 'Units', count(DISTINCT unit) FROM rows
    UNION ALL SELECT 'Observations', count(*) FROM rows)
"""


def _line_table(spark, model, names=None):
    table = model.table().select("name", F.round("value", 8).alias("value"))
    return table.filter(~F.col("name").isin(model.units.spec.treatment, "t"))


@query(_sdid_sql(PART_RECURSIVE, PART_ROWS, 250) + diagnostics_sql(PART.covariates)
       + "SELECT name, round(value, 8) AS value FROM lines")
def sdid_diagnostics(spark, d):
    return _line_table(spark, fit(part_units(spark, d), jackknife=False))


@query(_sdid_sql(PART_RECURSIVE, PART_ROWS, 250) + diagnostics_sql(PART.covariates) + """
SELECT CAST(time AS INTEGER) AS time, round(treated, 3) AS treated, round(control, 3) AS control,
       round(time_weight, 8) AS time_weight FROM paths""")
def sdid_paths(spark, d):
    model = fit(part_units(spark, d), jackknife=False)
    return rounded(rounded(model.paths.drop(SCENARIO), 3, "treated", "control"), 8, "time_weight")


@query(_sdid_sql(PART_RECURSIVE, PART_ROWS, 250) + """, sums AS (
    SELECT cluster, sum(unit_weight) AS cluster_weight FROM (SELECT DISTINCT unit, cluster, unit_weight FROM rows WHERE treated = 0)
    GROUP BY cluster),
best AS (SELECT cluster, cluster_weight FROM (SELECT *, dense_rank() OVER (ORDER BY cluster_weight DESC) AS r FROM sums)
    WHERE r <= 10)
SELECT cluster, round(cluster_weight, 9) AS cluster_weight, false AS is_total FROM best
UNION ALL SELECT 'Total', round(sum(cluster_weight), 9), true FROM best""")
def sdid_cluster_weights(spark, d):
    model = fit(part_units(spark, d), jackknife=False)
    return rounded(model.clusters().drop(SCENARIO), 9, "cluster_weight")


@query(_sdid_sql(PART_RECURSIVE, PART_ROWS, 250) + "SELECT round(tau, 3) AS tau, observations FROM effect")
def sdid_effect(spark, d):
    model = fit(part_units(spark, d), jackknife=False)
    return driver_table(spark, {
        "tau": ("double", [round(model.estimate.tau, 3)]),
        "observations": ("bigint", [model.estimate.observations]),
    })


@query(_sdid_sql(PART_RECURSIVE, PART_ROWS, 250) + """
SELECT unit, CAST(time AS INTEGER) AS time, round(unit_weight * time_weight, 11) AS reg_weight,
    round(outcome - avg(outcome) OVER (PARTITION BY unit) - avg(outcome) OVER (PARTITION BY time) + avg(outcome) OVER (), 4)
        AS outcome_twfe FROM rows""")
def sdid_regression_rows(spark, d):
    model = fit(part_units(spark, d), jackknife=False)
    out = model.regression_rows().select("unit", "time", "reg_weight", "outcome_twfe")
    return rounded(rounded(out, 11, "reg_weight"), 4, "outcome_twfe")


def _jackknife_sql(rows: str, key: str, df: str) -> str:
    """Estimate, variance by re-fitting without each ``key``, t and interval."""
    return (rows + slope_sql("effect", "rows")
            + f", folds AS (SELECT f.left_out, r.* FROM (SELECT DISTINCT {key} AS left_out FROM rows) f, rows r "
              f"WHERE r.{key} <> f.left_out)"
            + slope_sql("refit", "folds", "left_out") + f"""
, v AS (SELECT any_value(e.tau) AS tau, (count(*) - 1.0) / count(*) * sum((f.tau - e.tau) ** 2) AS variance,
    count(*) AS folds FROM refit f, effect e)
SELECT round(tau, 3) AS tau, round(sqrt(variance), 3) AS std_error, round(tau / sqrt(variance), 8) AS t_statistic,
    CAST({df} AS DOUBLE) AS t_df, round(tau - 1.96 * sqrt(variance), 3) AS ci_low,
    round(tau + 1.96 * sqrt(variance), 3) AS ci_high, CAST(folds AS BIGINT) AS folds FROM v"""
            )


def _round(x: float | None, digits: int) -> float | None:
    return None if x is None else round(x, digits)


def _root(x: float | None, digits: int) -> float | None:
    return None if x is None else round(x**0.5, digits)


def _estimate_row(spark, model, folds: int):
    e = model.estimate
    return driver_table(spark, {
        "tau": ("double", [round(e.tau, 3)]),
        "std_error": ("double", [_root(e.variance, 3)]),
        "t_statistic": ("double", [_round(e.t_statistic, 8)]),
        "t_df": ("double", [float(e.t_df)]),
        "ci_low": ("double", [_round(e.ci_low, 3)]),
        "ci_high": ("double", [_round(e.ci_high, 3)]),
        "folds": ("bigint", [folds]),
    })


_UNIFORM_ROWS = ", rows AS MATERIALIZED (SELECT *, 1.0 AS w FROM panel)"
_PANEL_DF = "7 * (SELECT count(DISTINCT unit) FROM panel) - ((SELECT count(DISTINCT unit) FROM panel) - 1) - 6 - 2"


@query(_jackknife_sql(SUPPLIER_SQL + _UNIFORM_ROWS, "unit", _PANEL_DF))
def jackknife_unit(spark, d):
    model = fit(supplier_units(spark, d), uniform=True)
    return _estimate_row(spark, model, model.estimate.units)


@query(_jackknife_sql(SUPPLIER_SQL + _UNIFORM_ROWS, "cluster", "folds - 1"))
def jackknife_cluster(spark, d):
    model = fit(supplier_units(spark, d), cluster_errors=True, uniform=True)
    return _estimate_row(spark, model, int(model.estimate.t_df) + 1)


_SUPPLIER_SDID = _sdid_sql(SUPPLIER_SQL, SUPPLIER_ROWS, 1500).replace(
    ", rows AS (", ", rows AS MATERIALIZED (", 1)
_SUPPLIER_SDID = _SUPPLIER_SDID[: _SUPPLIER_SDID.index(", effect_x AS")]


@query(_jackknife_sql(_SUPPLIER_SDID, "unit", _PANEL_DF))
def sdid_jackknife_unit(spark, d):
    model = fit(supplier_units(spark, d))
    return _estimate_row(spark, model, model.estimate.units)


@query(_jackknife_sql(_SUPPLIER_SDID, "cluster", "folds - 1"))
def sdid_jackknife_cluster(spark, d):
    model = fit(supplier_units(spark, d), cluster_errors=True)
    return _estimate_row(spark, model, int(model.estimate.t_df) + 1)


_REPORT_SQL = _SUPPLIER_SDID + diagnostics_sql(("s_acctbal",)) + slope_sql("effect", "rows") + """
, folds AS (SELECT f.left_out, r.* FROM (SELECT DISTINCT unit AS left_out FROM rows) f, rows r WHERE r.unit <> f.left_out)
""" + slope_sql("refit", "folds", "left_out") + f"""
, v AS (SELECT any_value(e.tau) AS tau, any_value(e.tau) / sqrt((count(*) - 1.0) / count(*) * sum((f.tau - e.tau) ** 2)) AS t,
    CAST(6 * count(*) - 7 AS DOUBLE) AS df FROM refit f, effect e),
p AS (SELECT *, {p_value_sql('t', 'df')} AS p FROM v)
SELECT 'supplier' AS model, 'treated' AS name, round(tau, 3) AS value, {number_sql('tau', 2)} || {stars_sql('p')} AS label,
       round(p, 8) AS p_value FROM p
UNION ALL SELECT 'supplier', 't', round(t, 8), '(' || {number_sql('t', 2)} || ')', NULL FROM p
UNION ALL SELECT 'supplier', name, round(value, 8), CASE WHEN name IN ('Units', 'Observations')
    THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE {number_sql('value', 4)} END, NULL FROM lines"""


@query(_REPORT_SQL)
def sdid_report(spark, d):
    """The whole report table, with p value and labels, on suppliers."""
    model = fit(supplier_units(spark, d))
    effect = F.col("name") == "treated"
    return model.table().select(
        "model", "name", F.when(effect, F.round("value", 3)).otherwise(F.round("value", 8)).alias("value"), "label",
        F.when(effect, F.lit(_round(model.estimate.p_value, 8))).alias("p_value"))


_FULL_SQL = _sdid_sql(PART_RECURSIVE, PART_ROWS, 250).replace(", rows AS (", ", rows AS MATERIALIZED (", 1) + (
    diagnostics_sql(PART.covariates) + leave_unit_out_sql()) + f"""
, v AS (SELECT any_value(e.tau) AS tau, any_value(e.tau) / sqrt((count(*) - 1.0) / count(*) * sum((f.tau - e.tau) ** 2)) AS t,
    CAST(6 * count(*) - 7 AS DOUBLE) AS df FROM refit f, effect e),
p AS (SELECT *, {p_value_sql('t', 'df')} AS p FROM v),
named AS (
    SELECT 0 AS position, 'treated' AS name, round(tau, 3) AS value, {number_sql('tau', 2)} || {stars_sql('p')} AS label FROM p
    UNION ALL SELECT 1, 't', round(t, 8), '(' || {number_sql('t', 2)} || ')' FROM p
    UNION ALL SELECT list_position(['omega', 'lambda', 'p_size', 'p_retailprice', 'Weight Norm', 'Units', 'Observations'], name) + 1,
        name, round(value, 8), CASE WHEN name IN ('Units', 'Observations')
        THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE {number_sql('value', 4)} END FROM lines)
SELECT 'part' AS model, CAST(position AS INTEGER) AS position, name, value, label FROM named"""


def rounded_report(table):
    """The report with its effect to 3 and the other values to 8 digits."""
    return table.withColumn("value", F.when(F.col("name") == "treated", F.round("value", 3)).otherwise(F.round("value", 8)))


@query(_FULL_SQL)
def sdid_full(spark, d):
    """Report table of the weighted estimate with unit jackknife errors."""
    return rounded_report(fit(part_units(spark, d)).table())


# ------------------------------------------------------------------ treated by their past

def _top_sql(past: str) -> str:
    """Part panel whose treated units are the top 3 % by an aggregate of their outcomes before treatment."""
    return PART_RECURSIVE.replace("panel AS (SELECT * FROM part_panel", "whole AS (SELECT * FROM part_panel") + f"""
, past AS (SELECT unit, {past} AS m FROM whole WHERE time <= 1998 GROUP BY unit),
panel AS (SELECT whole.* EXCLUDE (treated), CASE WHEN m > cut THEN 1 ELSE 0 END AS treated
    FROM whole JOIN past USING (unit), (SELECT quantile_cont(m, 0.97) AS cut FROM past))
"""


#: By the mean: the treated level is higher. By the last year: their path turns up, as few controls' do.
TOP_SQL = _top_sql("avg(outcome)")
STEEP_SQL = _top_sql("max(CASE WHEN time = 1998 THEN outcome END)")


def top_units(spark, d, last_only: bool = False):
    """Unit table of the complete parts; treated are the top 3 % by their outcomes before treatment."""
    units = part_units(spark, d)
    past = F.expr(f"y_{units.pre[-1]}" if last_only else weights.mean_before(units))
    cut = summary.quantile_summary(units.data.select("unit", past.alias("m")), ["m"], (0.97,)).first()["p97"]
    return replace(units, data=units.data.withColumn("treated", F.when(past > cut, 1.0).otherwise(0.0)))


def _newton_sdid_sql(base: str, rows: list[str], covariates: bool = True) -> str:
    return (base + units_sql(rows) + newton_weights_sql(len(rows), 4, covariates, 40) + time_weights_sql(900)
            + ", rows AS MATERIALIZED (SELECT panel.*, unit_weight, time_weight, unit_shift, time_shift, "
              "unit_weight * time_weight AS w FROM panel JOIN uw USING (unit) JOIN tw USING (time))"
            + slope_sql("effect", "rows"))


_WEIGHTS_SQL = units_sql(PART_ROWS) + newton_weights_sql(6, 4, steps=40) + """
SELECT unit, d AS treated, round(unit_weight, 8) AS unit_weight, unit_weight = 0 AS is_zero FROM uw"""
_LINES_SQL = diagnostics_sql(PART.covariates) + """
SELECT 'tau' AS name, round(tau, 2) AS value FROM effect UNION ALL SELECT name, round(value, 6) FROM lines"""
_CLUSTERS_SQL = """, sums AS (
    SELECT cluster, sum(unit_weight) AS cluster_weight FROM (SELECT DISTINCT unit, cluster, unit_weight FROM rows WHERE treated = 0)
    GROUP BY cluster),
best AS (SELECT cluster, cluster_weight FROM (SELECT *, dense_rank() OVER (ORDER BY cluster_weight DESC) AS r FROM sums)
    WHERE r <= 10)
SELECT cluster, round(cluster_weight, 7) AS cluster_weight, false AS is_total FROM best
UNION ALL SELECT 'Total', round(sum(cluster_weight), 7), true FROM best"""


def _weight_rows(model):
    out = model.unit_weights().select("unit", F.col("treated").cast("int").alias("treated"), "unit_weight")
    return rounded(out.withColumn("is_zero", F.col("unit_weight") == 0), 8, "unit_weight")


def _effect_lines(model):
    effect = F.col("name") == "treated"
    return model.table().filter("name <> 't'").select(
        F.when(effect, "tau").otherwise(F.col("name")).alias("name"),
        F.when(effect, F.round("value", 2)).otherwise(F.round("value", 6)).alias("value"))


@query(TOP_SQL + _WEIGHTS_SQL)
def unit_weights_top(spark, d):
    """Treated of a higher level than the controls: the shift takes it up."""
    return _weight_rows(fit(top_units(spark, d), jackknife=False))


@query(_newton_sdid_sql(TOP_SQL, PART_ROWS) + _LINES_SQL)
def sdid_effect_top(spark, d):
    return _effect_lines(fit(top_units(spark, d), jackknife=False))


@query(_newton_sdid_sql(TOP_SQL, PART_ROWS) + _CLUSTERS_SQL)
def cluster_weights_top(spark, d):
    model = fit(top_units(spark, d), jackknife=False)
    return rounded(model.clusters().drop(SCENARIO), 7, "cluster_weight")


@query(STEEP_SQL + _WEIGHTS_SQL)
def unit_weights_steep(spark, d):
    """Treated whose path few controls follow: nearly all weights are exactly 0."""
    return _weight_rows(fit(top_units(spark, d, True), jackknife=False))


@query(_newton_sdid_sql(STEEP_SQL, PART_ROWS) + _LINES_SQL)
def sdid_effect_steep(spark, d):
    return _effect_lines(fit(top_units(spark, d, True), jackknife=False))


@query(_newton_sdid_sql(STEEP_SQL, PART_ROWS) + _CLUSTERS_SQL)
def cluster_weights_steep(spark, d):
    model = fit(top_units(spark, d, True), jackknife=False)
    return rounded(model.clusters().drop(SCENARIO), 7, "cluster_weight")


def _within(c: str, f: str) -> str:
    return (f"{c} - avg({c}) OVER (PARTITION BY {f}unit) - avg({c}) OVER (PARTITION BY {f}time) "
            f"+ avg({c}) OVER ({'PARTITION BY left_out' if f else ''})")


def _interaction_sql(name: str, source: str, fold: bool) -> str:
    f = "left_out, " if fold else ""
    cells = ", ".join(f"sum(w * {a} * {b}) AS {a}{b}" for a, b in (
        ("u", "u"), ("u", "v"), ("v", "v"), ("u", "y"), ("v", "y")))
    return f"""
, {name}_x AS (SELECT {f}w, {_within('outcome', f)} AS y, {_within('x1', f)} AS u, {_within('x2', f)} AS v
    FROM (SELECT *, CASE WHEN time > 1998 THEN treated ELSE 0 END AS x1,
          CASE WHEN time > 1998 THEN treated * s_acctbal ELSE 0 END AS x2 FROM {source})),
{name} AS (SELECT {f}(uy * vv - vy * uv) / det AS tau, (vy * uu - uy * uv) / det AS inter
    FROM (SELECT *, CASE WHEN uu * vv - uv * uv > 1e-10 * uu * vv THEN uu * vv - uv * uv END AS det
          FROM (SELECT {f}{cells} FROM {name}_x {'GROUP BY left_out' if fold else ''})))
"""


_INTERACTION_SQL = (
    _SUPPLIER_SDID + _interaction_sql("hat", "rows", False)
    + ", folds AS (SELECT f.left_out, r.* FROM (SELECT DISTINCT unit AS left_out FROM rows) f, rows r "
      "WHERE r.unit <> f.left_out)"
    + _interaction_sql("refit", "folds", True) + """
, v AS (SELECT any_value(e.tau) AS tau, any_value(e.inter) AS inter,
    CASE WHEN count(f.tau) = count(*) THEN (count(*) - 1.0) / count(*) * sum((f.tau - e.tau) ** 2) END AS v1,
    CASE WHEN count(f.tau) = count(*) THEN (count(*) - 1.0) / count(*) * sum((f.inter - e.inter) ** 2) END AS v2
    FROM refit f, hat e)
SELECT round(tau, 2) AS tau, round(sqrt(v1), 2) AS tau_error, round(inter, 6) AS interaction,
       round(sqrt(v2), 6) AS interaction_error FROM v""")


def _interaction_row(spark, got):
    return driver_table(spark, {
        "tau": ("double", [round(got.tau, 2)]),
        "tau_error": ("double", [_root(got.tau_variance, 2)]),
        "interaction": ("double", [round(got.interaction, 6)]),
        "interaction_error": ("double", [_root(got.interaction_variance, 6)]),
    })


@query(_INTERACTION_SQL)
def interaction_jackknife(spark, d):
    return _interaction_row(spark, interaction_effect(
        fit(supplier_units(spark, d), jackknife=False), "s_acctbal"))


@query(_INTERACTION_SQL.replace("treated * s_acctbal", "treated * (unit % 7)"))
def interaction_free_modifier(spark, d):
    """The modifier is a fixed unit column that the weights do not use."""
    panel = supplier_panel(spark, d).withColumn("modifier", F.col("unit") % 7)
    units = unit_table(panel, SUPPLIER.with_(modifiers=("modifier",)), PERIODS)
    return _interaction_row(spark, interaction_effect(fit(units, jackknife=False), "modifier"))


# ------------------------------------------------------------------ given weights


@functools.cache
def _given_sql() -> str:
    """Unit weights proportional to part size within the group, equal time weights."""
    return PART_SQL + """, rows AS (
    SELECT *, p_size / sum(p_size) OVER (PARTITION BY treated, time) AS unit_weight, 0.0 AS unit_shift,
        CASE WHEN time <= 1998 THEN 0.25::DOUBLE ELSE CAST(1 AS DOUBLE) / 3 END AS time_weight, 0.0 AS time_shift FROM panel)
"""


@query(_given_sql() + diagnostics_sql(PART.covariates) + "SELECT name, round(value, 8) AS value FROM lines")
def prediction_error_given_weights(spark, d):
    from ..operators.prep import attach
    from ..plans.estimate import report_lines

    units = part_units(spark, d)
    stats = weights.group_stats(units)
    equal = {0: weights.TimeWeightSolution(weights.np.full(4, 0.25), 0.0, True)}
    profiles = effects.time_profiles(units, stats, equal)
    weighted = attach(units.data, ["treated"], {"size": F.sum("x_0")}, few_groups=True).withColumns(
        {"unit_weight": F.col("x_0") / F.col("size"), "unit_shift": F.lit(0.0)})
    _, groups = effects.effect_totals(weighted, units, stats, profiles)
    omega, lam, gaps, norm = effects.fit_diagnostics(units, stats[0], groups[0])
    n = int(sum(stats[0].n))
    e = effects.Estimate(0, None, None, None, 0, None, None, None, 0, omega, lam, gaps, norm, n, 7 * n)
    lines = [x for x in report_lines(PART, e) if x[1] not in (PART.treatment, "t")]
    return driver_table(spark, {
        "name": ("string", [x[1] for x in lines]),
        "value": ("double", [round(x[2], 8) for x in lines]),
    })
