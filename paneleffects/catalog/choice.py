"""Propensity score and lasso queries. The SQL runs the same Newton and descent steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.distributions import normal_quantile
from ..operators import lasso, prep, propensity
from ..operators.propensity import Term
from ..sources.stages import driver_table, stage
from . import query
from .tables import LAST, PART_SQL, PERIODS, TIME_PRE, complete_part_panel, rounded

CANDIDATES = ("p_size", "p_retailprice", "outcome_1996", "outcome_1997", "outcome_1998")
_RECURSIVE = PART_SQL.replace("WITH flow", "WITH RECURSIVE flow", 1) + """, units AS MATERIALIZED (
    SELECT unit, max(treated) AS treated, CAST(max(p_size) AS DOUBLE) AS p_size, max(p_retailprice) AS p_retailprice,
        avg(CASE WHEN time > 1998 THEN outcome END) AS outcome_post,
        max(CASE WHEN time = 1996 THEN outcome END) AS outcome_1996,
        max(CASE WHEN time = 1997 THEN outcome END) AS outcome_1997,
        max(CASE WHEN time = 1998 THEN outcome END) AS outcome_1998 FROM panel GROUP BY unit)
"""


def unit_rows(spark, d):
    return prep.post_means(
        complete_part_panel(spark, d), ["outcome"], "unit", "time", TIME_PRE + 1, LAST,
        {"outcome": PERIODS[1:4]}, ["treated", "p_size", "p_retailprice"])


def _logit_sql(candidates: tuple[str, ...], steps: int = 12) -> str:
    """One-regressor logits, one per candidate, by Newton steps on the standardised regressor."""
    long = " UNION ALL ".join(
        f"SELECT '{c}' AS name, unit, treated AS y, ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS z FROM units"
        for c in candidates)
    return _RECURSIVE + f""", long AS MATERIALIZED ({long}),
newton(i, name, a, b) AS (
    SELECT 0, name, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM (SELECT DISTINCT name FROM long)
    UNION ALL
    SELECT i + 1, name, a + (g0 * h11 - g1 * h01) / (h00 * h11 - h01 * h01),
           b + (g1 * h00 - g0 * h01) / (h00 * h11 - h01 * h01) FROM (
        SELECT i, name, a, b, sum(y - p) AS g0, sum((y - p) * z) AS g1, sum(p * (1 - p)) AS h00,
               sum(p * (1 - p) * z) AS h01, sum(p * (1 - p) * z * z) AS h11
        FROM (SELECT i, name, a, b, y, z, 1 / (1 + exp(-(a + b * z))) AS p FROM newton JOIN long USING (name) WHERE i < {steps})
        GROUP BY i, name, a, b)),
fitted AS (SELECT name, a, b FROM newton WHERE i = {steps}),
share AS (SELECT avg(treated) AS q, count(*) AS n FROM units)
"""


@query(_logit_sql(CANDIDATES) + """
SELECT name, round(d, 6) AS deviance, round(-2 * n * (q * ln(q) + (1 - q) * ln(1 - q)) - d, 6) AS likelihood_ratio
FROM (SELECT name, sum(-2 * (y * ln(p) + (1 - y) * ln(1 - p))) AS d
      FROM (SELECT name, y, 1 / (1 + exp(-(a + b * z))) AS p FROM fitted JOIN long USING (name)) GROUP BY name), share""")
def likelihood_ratios(spark, d):
    rows = stage(unit_rows(spark, d), "propensity")
    terms = [Term(c, (c,)) for c in CANDIDATES]
    _, models, ratios = propensity.likelihood_ratios(rows, "treated", [], terms)
    return driver_table(spark, {
        "name": ("string", list(CANDIDATES)),
        "deviance": ("double", [round(m.deviance, 6) for m in models]),
        "likelihood_ratio": ("double", [round(x, 6) for x in ratios]),
    })


@query(_logit_sql(("p_size",)) + """
SELECT unit, round(1 / (1 + exp(-(a + b * z))), 8) AS pscore FROM fitted JOIN long USING (name)""")
def predicted_probability(spark, d):
    rows = stage(unit_rows(spark, d), "propensity")
    (model,) = propensity.fit_logits(rows, "treated", [Term("p_size", ("p_size",))], [None])
    return rounded(model.predict(rows).select("unit", "pscore"), 8, "pscore")


def stepwise_sql(candidates: tuple[str, ...], baseline: tuple[str, ...] = (), stop_rule: str = "first",
                 squares: bool = False, steps: int = 10) -> str:
    """Both stages of the selection as one recursion; the last row, ``chosen``, has the model.

    Each turn does a Newton step of every open model (the accepted terms alone, and with each
    candidate), by elimination on lists; after ``steps`` turns a term is accepted or the stage
    ends. Terms left out have an identity row in the information matrix.
    """
    linear = list(candidates) + [c for c in baseline if c not in candidates]
    n = len(linear)
    pairs = [(a, b) for a in range(n) for b in range(a + 1, n)] + ([(a, a) for a in range(n)] if squares else [])
    terms = [f"CAST({c} AS DOUBLE)" for c in linear] + [f"CAST({linear[a]} AS DOUBLE) * {linear[b]}" for a, b in pairs]
    size = len(terms) + 1
    base = "[" + ", ".join(str(linear.index(c) + 1) for c in baseline) + "]::INTEGER[]"
    table = ", ".join([f"({k + 1}, 0, 0)" for k in range(n)]
                      + [f"({n + 1 + k}, {a + 1}, {b + 1})" for k, (a, b) in enumerate(pairs)])
    cells = [(a, b) for a in range(1, size + 1) for b in range(a, size + 1)]
    sums = ", ".join([f"sum(p * (1 - p) * x[{a}] * x[{b}]) AS h{a}_{b}" for a, b in cells]
                     + [f"sum((y - p) * x[{a}]) AS g{a}" for a in range(1, size + 1)])
    on = {a: "true" if a == 1 else f"(cand = {a - 1} OR list_contains(ord, {a - 1}))" for a in range(1, size + 1)}
    line = lambda a: ", ".join(
        [f"CASE WHEN {on[a]} AND {on[b]} THEN h{min(a, b)}_{max(a, b)} ELSE {float(a == b)} END" for b in range(1, size + 1)]
        + [f"CASE WHEN {on[a]} THEN g{a} ELSE 0.0 END"])
    matrix = "[" + ", ".join(f"[{line(a)}]" for a in range(1, size + 1)) + "]"
    pivots = ", ".join(f"[[{float(k)}]]" for k in range(1, size + 1))
    solved = (f"list_reduce(list_concat([{matrix}], [{pivots}]), lambda m, k: list_transform(m, lambda r, i: "
              "CASE WHEN i = k[1][1] THEN list_transform(r, lambda v: v / r[CAST(k[1][1] AS INTEGER)]) "
              "ELSE list_transform(r, lambda v, j: v - r[CAST(k[1][1] AS INTEGER)] * m[CAST(k[1][1] AS INTEGER)][j] "
              "/ m[CAST(k[1][1] AS INTEGER)][CAST(k[1][1] AS INTEGER)]) END))")
    place = lambda c: f"list_position(ord, {c})"
    first = "first_value(lr) OVER (ORDER BY place)" if stop_rule == "first" else "max(lr) OVER ()"
    return _RECURSIVE + f"""
, terms(idx, a, b) AS (VALUES (0, 0, 0), {table}),
sc AS MATERIALIZED (SELECT [{', '.join(f'avg({t})' for t in terms)}] AS m, [{', '.join(f'stddev_pop({t})' for t in terms)}] AS s FROM units),
xs AS MATERIALIZED (SELECT treated AS y, [1.0, {', '.join(f'({t} - m[{k + 1}]) / s[{k + 1}]' for k, t in enumerate(terms))}] AS x
    FROM units, sc),
step(i, stage, ord, cand, beta, lrs) AS (
    SELECT 0, 1, {base}, idx, [{', '.join('0.0::DOUBLE' for _ in range(size))}], []::DOUBLE[] FROM terms
    WHERE idx <= {n} AND NOT list_contains({base}, idx)
    UNION ALL
    SELECT i + 1, next_stage, next_ord, t.idx, beta, next_lrs FROM (
        SELECT *, turn AND ok AS accept,
            CASE WHEN turn AND NOT ok THEN stage + 1 ELSE stage END AS next_stage,
            CASE WHEN turn AND ok THEN list_append(ord, cand) ELSE ord END AS next_ord,
            CASE WHEN turn AND ok THEN list_append(lrs, lr) ELSE lrs END AS next_lrs,
            CASE WHEN NOT turn THEN true WHEN ok THEN best = 1 ELSE cand = 0 END AS goes_on
        FROM (
            SELECT *, (i + 1) % {steps} = 0 AS turn, count(*) OVER () > 1
                AND {first} >= CASE stage WHEN 1 THEN 1.0 ELSE 2.7 END AS ok,
                row_number() OVER (ORDER BY cand = 0, lr DESC, place) AS best
            FROM (
                SELECT i, stage, ord, cand, lrs, max(CASE WHEN cand = 0 THEN dev END) OVER () - dev AS lr,
                    CASE WHEN cand = 0 THEN 1000000 WHEN stage = 1 THEN cand WHEN b = a THEN 10000 + {place('a')}
                        ELSE 100 * least({place('a')}, {place('b')}) + greatest({place('a')}, {place('b')}) END AS place,
                    list_transform(beta, lambda v, k: v + solved[k][{size + 1}]) AS beta
                FROM (SELECT *, {solved} AS solved FROM (
                    SELECT i, stage, ord, cand, beta, lrs, {sums},
                        sum(2 * (greatest(eta, 0) - y * eta + ln(1 + exp(-abs(eta))))) AS dev
                    FROM (SELECT *, 1 / (1 + exp(-eta)) AS p FROM (
                        SELECT step.*, y, x, list_dot_product(beta, x) AS eta FROM step, xs WHERE stage < 3))
                    GROUP BY i, stage, ord, cand, beta, lrs)) JOIN terms ON idx = cand))) w
    JOIN terms t ON goes_on AND CASE WHEN NOT turn THEN t.idx = cand ELSE t.idx = 0
        OR next_stage = 1 AND t.idx <= {n} AND NOT list_contains(next_ord, t.idx)
        OR next_stage = 2 AND t.idx > {n} AND list_contains(next_ord, t.a) AND list_contains(next_ord, t.b)
           AND NOT list_contains(next_ord, t.idx) END
    WHERE next_stage < 3 OR t.idx = 0),
chosen AS MATERIALIZED (SELECT ord, beta, lrs, [beta[t + 1] / s[t] FOR t IN ord] AS slopes,
    beta[1] - coalesce(list_sum([beta[t + 1] / s[t] * m[t] FOR t IN ord]), 0) AS intercept FROM step, sc WHERE stage = 3),
labels AS (SELECT {[*linear]} AS l)
"""


def _model_sql(candidates: tuple[str, ...], baseline: tuple[str, ...] = (), stop_rule: str = "first", squares: bool = False) -> str:
    number = lambda x: f"CAST(printf('%.5g', {x}) AS DOUBLE)"
    name = ("CASE WHEN a = 0 THEN l[t] WHEN a = b THEN l[a] || '^2' WHEN list_position(ord, a) < list_position(ord, b) "
            "THEN l[a] || ':' || l[b] ELSE l[b] || ':' || l[a] END")
    return stepwise_sql(candidates, baseline, stop_rule, squares) + f"""
SELECT 0 AS position, '(Intercept)' AS term, {number('intercept')} AS coefficient, CAST(NULL AS DOUBLE) AS likelihood_ratio FROM chosen
UNION ALL
SELECT CAST(k AS INTEGER), {name}, {number('slope')}, round(lrs[k - {len(baseline)}], 6) FROM (
    SELECT *, unnest(ord) AS t, unnest(slopes) AS slope, unnest(range(1, len(ord) + 1)) AS k FROM chosen), labels
JOIN terms ON idx = t"""


def _model_table(spark, model):
    names = ["(Intercept)", *model.names]
    ratios = dict(model.rounds)
    return driver_table(spark, {
        "position": ("int", list(range(len(names)))),
        "term": ("string", names),
        "coefficient": ("double", [float(f"{x:.5g}") for x in (model.intercept, *model.coefficients)]),
        "likelihood_ratio": ("double", [None if n not in ratios else round(ratios[n], 6) for n in names]),
    })


@query(_model_sql(CANDIDATES[1:], ("p_size",)))
def pscore_terms(spark, d):
    model = propensity.estimate_propensity(
        unit_rows(spark, d), "treated", CANDIDATES[1:], ["p_size"], stop_rule="first")
    return _model_table(spark, model)


@query(_model_sql(CANDIDATES, (), "max", True))
def pscore_terms_best(spark, d):
    model = propensity.estimate_propensity(
        unit_rows(spark, d), "treated", CANDIDATES, (), stop_rule="max", squares=True)
    return _model_table(spark, model)


@query(_logit_sql(("outcome_1998",)) + """, scored AS (
    SELECT y, 1 / (1 + exp(-(a + b * z))) AS v FROM fitted JOIN long USING (name)),
width AS (SELECT (max(v) - min(v)) / 19 AS w, min(v) - (max(v) - min(v)) / 19 / 2 AS start FROM scored),
cells AS (SELECT y AS treated, CAST(greatest(ceil((v - start) / w) - 1, 0) AS INTEGER) AS bin, count(*) AS n,
          any_value(w) AS w FROM scored, width GROUP BY 1, 2)
SELECT treated, bin, n, round(n / (sum(n) OVER (PARTITION BY treated) * w), 6) AS density FROM cells""")
def pscore_histogram(spark, d):
    from ..operators.summary import density_histogram

    rows = stage(unit_rows(spark, d), "propensity")
    (model,) = propensity.fit_logits(rows, "treated", [Term("outcome_1998", ("outcome_1998",))], [None])
    out = density_histogram(model.predict(rows), "pscore", 20, ["treated"]).drop("centre")
    return rounded(out, 6, "density")


LASSO_FEATURES = ("p_size", "p_retailprice", "outcome_1996", "outcome_1997")
LASSO_GAMMA = 0.05


def lasso_sql(outcome: str = "outcome", features: tuple[str, ...] = LASSO_FEATURES, gamma: float | None = LASSO_GAMMA,
              rounds: int = 2, tol: float | None = None, columns: str = "round(b, 6) AS coefficient, b <> 0 AS selected") -> str:
    """``rounds`` of the penalised fit, each of many coordinate sweeps; with ``tol`` the first settled one counts."""
    p = len(features)
    x = [f"x{j}" for j in range(p)]
    named = ", ".join(f"{c} AS x{j}" for j, c in enumerate(features))
    gram = "[" + ", ".join("[" + ", ".join(f"sum({a} * {b})" for b in x) + "]" for a in x) + "]"
    cross = "[" + ", ".join(f"sum({a} * y)" for a in x) + "]"
    first = "[" + ", ".join(f"sqrt(sum({a} * {a} * y * y) / count(*))" for a in x) + "]"
    steps = 100 * p

    def descend(name: str, loadings: str) -> str:
        part = "(c[j] - list_dot_product(g[j], b) + g[j][j] * b[j])"
        return f"""
, {name}(i, b) AS (
    SELECT 0, [{', '.join('0.0::DOUBLE' for _ in x)}]
    UNION ALL
    SELECT i + 1, [CASE WHEN k = j THEN new ELSE b[k] END FOR k IN [{', '.join(str(j + 1) for j in range(p))}]] FROM (
        SELECT i, b, j, sign({part}) * greatest(abs({part}) - lam * l[j] / 2, 0) / g[j][j] AS new
        FROM (SELECT i, b, i % {p} + 1 AS j FROM {name} WHERE i < {steps}), gram, (SELECT l FROM {loadings}))),
{name}_b AS MATERIALIZED (SELECT b FROM {name} WHERE i = {steps})"""

    error = "y - (" + " + ".join(f"b[{j + 1}] * x{j}" for j in range(p)) + ")"
    again = "[" + ", ".join(f"sqrt(sum({a} * {a} * e * e) / count(*))" for a in x) + "]"
    base = _RECURSIVE.replace(
        "panel AS (SELECT * FROM part_panel",
        f"panel AS (SELECT unit, time, {outcome} AS outcome, treated, cluster, p_size, p_retailprice FROM part_panel")
    lam = "2 * 0.5 * sqrt(count(*)) * " + (
        repr(normal_quantile(1 - gamma / (2 * p))) if gamma is not None else f"any_value(probe.z)")
    text = (base + f""", rows AS MATERIALIZED (SELECT outcome_post AS y, {named} FROM units),
gram AS MATERIALIZED (SELECT {gram} AS g, {cross} AS c, count(*) AS n, {lam} AS lam FROM rows
    {'' if gamma is not None else ', probe'}),
l1 AS MATERIALIZED (SELECT {first} AS l, stddev_samp(y) AS s FROM rows)""").replace(
        ", rows AS MATERIALIZED", ("" if gamma is not None else _PROBE_SQL.format(p=p)) + ", rows AS MATERIALIZED", 1)
    for k in range(1, rounds + 1):
        text += descend(f"r{k}", f"l{k}")
        text += f"""
, l{k + 1} AS MATERIALIZED (SELECT {again} AS l, stddev_samp(e) AS s FROM (SELECT rows.*, {error} AS e FROM rows, r{k}_b))"""
    if tol is None:
        text += f"\n, fitted AS (SELECT b, l FROM r{rounds}_b, l{rounds + 1})"
    else:
        cases = " UNION ALL ".join(
            f"SELECT {k} AS k, r{k}_b.b, z.l, abs(z.s - a.s) < {tol} OR list_max([abs(v) FOR v IN r{k}_b.b]) = 0 AS settled, a.l AS before "
            f"FROM r{k}_b, l{k} a, l{k + 1} z" for k in range(1, rounds + 1))
        text += f"""
, fitted AS (SELECT b, CASE WHEN list_max([abs(v) FOR v IN b]) = 0 THEN before ELSE l END AS l FROM ({cases})
    ORDER BY NOT settled, CASE WHEN settled THEN k ELSE -k END LIMIT 1)"""
    return text + f"""
SELECT name, {columns} FROM (
    SELECT unnest([{', '.join(f"'{c}'" for c in features)}]) AS name, unnest(b) AS b, unnest(l) AS l FROM fitted)"""


#: The normal quantile of 1 - 0.1 / log(n) / (2 p), by Newton steps on Simpson's rule for the distribution.
_PROBE_SQL = """, target AS (SELECT 1 - 0.1 / ln(count(*)) / (2 * {p}) AS q FROM units),
quantile(i, z) AS (SELECT 0, CAST(2 AS DOUBLE) UNION ALL
    SELECT i + 1, z - (0.5 + z / 3000 / sqrt(2 * pi()) * list_sum([
        CASE WHEN k = 0 OR k = 1000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(k * z / 1000, 2) / 2) FOR k IN range(1001)]) - q)
        / (exp(-z * z / 2) / sqrt(2 * pi())) FROM quantile, target WHERE i < 12),
probe AS (SELECT z FROM quantile WHERE i = 12)"""


@query(lasso_sql())
def lasso_two_rounds(spark, d):
    fit = lasso.rigorous_lasso(
        unit_rows(spark, d), "outcome_post", LASSO_FEATURES, gamma=LASSO_GAMMA, max_iter=2, unsettled="ignore")
    return driver_table(spark, {
        "name": ("string", list(fit.features)),
        "coefficient": ("double", [round(b, 6) for b in fit.coefficients]),
    }).withColumn("selected", F.col("coefficient") != 0)


@query(lasso_sql(features=CANDIDATES, gamma=None, rounds=15, tol=1e-5, columns="""
    CAST(printf('%.6g', b) AS DOUBLE) AS coefficient, CAST(printf('%.6g', l) AS DOUBLE) AS loading,
    CAST(b <> 0 AS INTEGER) AS selected, CAST(b <> 0 AND name IN ('p_size', 'p_retailprice') AS INTEGER) AS chosen"""))
def lasso_select(spark, d):
    """The default form: the penalty follows from the sample's size, loadings are refreshed until they settle."""
    fit = lasso.rigorous_lasso(unit_rows(spark, d), "outcome_post", CANDIDATES)
    chosen = set(fit.choose(["p_size", "p_retailprice"]))
    return driver_table(spark, {
        "name": ("string", list(fit.features)),
        "coefficient": ("double", [float(f"{b:.6g}") for b in fit.coefficients]),
        "loading": ("double", [float(f"{x:.6g}") for x in fit.loadings]),
        "selected": ("int", [int(b != 0) for b in fit.coefficients]),
        "chosen": ("int", [int(f in chosen) for f in fit.features]),
    })
