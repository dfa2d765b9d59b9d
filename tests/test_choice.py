"""Propensity and lasso against direct numpy solutions, and robustness plans."""

import itertools

import numpy as np
import pytest
from panels import arrays, frame

from paneleffects.operators import propensity
from paneleffects.operators.lasso import coordinate_descent, rigorous_lasso
from paneleffects.operators.propensity import Term
from paneleffects.operators.unit_table import unit_table
from paneleffects.plans import robustness
from paneleffects.plans.estimate import fit, many_models
from paneleffects.spec import PanelSpec

SPEC = PanelSpec("outcome", cluster="cluster", time_pre=2003, time_init=2001, covariates=("x1", "x2"))


def logit(x, y):
    design = np.column_stack([np.ones(len(y)), x])
    b = np.zeros(design.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-design @ b))
        h = design.T @ (design * (p * (1 - p))[:, None])
        b = b + np.linalg.solve(h, design.T @ (y - p))
    p = 1 / (1 + np.exp(-design @ b))
    return b, -2 * np.sum(y * np.log(p) + (1 - y) * np.log(1 - p))


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 4)) * [1, 10, 100, 1] + [0, 5, -50, 2]
    eta = 0.3 + 0.8 * x[:, 0] - 0.05 * x[:, 1] + 0.02 * x[:, 1] * x[:, 0]
    y = (rng.random(300) < 1 / (1 + np.exp(-eta))).astype(float)
    rows = [(float(t), *map(float, r)) for t, r in zip(y, x)]
    df = spark.createDataFrame(rows + [(1.0, None, 1.0, 1.0, 1.0)], "y double, a double, b double, c double, d double")
    return df, x, y


def test_logits_match_newton(sample):
    df, x, y = sample
    rows = df.dropna()
    base = [Term("a", ("a",))]
    options = [None, Term("b", ("b",)), Term("a:c", ("a", "c"))]
    got = propensity.fit_logits(rows, "y", base, options)
    for model, design in zip(got, (x[:, [0]], x[:, [0, 1]], np.column_stack([x[:, 0], x[:, 0] * x[:, 2]]))):
        b, dev = logit(design, y)
        assert model.deviance == pytest.approx(dev, rel=1e-9)
        assert (model.intercept, *model.coefficients) == pytest.approx(tuple(b), rel=1e-5, abs=1e-7)
    p = [r["pscore"] for r in got[1].predict(rows).collect()]
    b, _ = logit(x[:, :2], y)
    assert np.allclose(p, 1 / (1 + np.exp(-(b[0] + x[:, :2] @ b[1:]))), atol=1e-6)
    assert 0 < propensity.trim(got[1].predict(rows)).count() < 300


def stepwise(x, y, names, base, cutoff, rule, columns):
    chosen, left = list(base), [n for n in names if n not in base]
    while left:
        dev = logit(np.column_stack([columns[n] for n in chosen]) if chosen else np.empty((len(y), 0)), y)[1]
        lrs = [dev - logit(np.column_stack([columns[n] for n in [*chosen, c]]), y)[1] for c in left]
        if (lrs[0] if rule == "first" else max(lrs)) < cutoff:
            break
        chosen.append(left.pop(int(np.argmax(lrs))))
    return chosen


@pytest.mark.parametrize("rule,base,order", [
    ("first", ["a"], "bcd"), ("first", [], "abcd"), ("first", [], "cabd"), ("max", [], "cdab"), ("max", ["b"], "acd")])
def test_stepwise_choice(sample, rule, base, order):
    df, x, y = sample
    columns = {n: x[:, k] for k, n in enumerate("abcd")}
    linear = stepwise(x, y, list(order), base, 1.0, rule, columns)
    pairs = list(itertools.combinations(linear, 2))
    columns |= {f"{a}:{b}": columns[a] * columns[b] for a, b in pairs}
    want = linear
    if base or rule == "max":
        second = stepwise(x, y, [*linear, *[f"{a}:{b}" for a, b in pairs]], linear, 2.7, rule, columns)
        want = second
    got = propensity.estimate_propensity(df, "y", list(order), base, stop_rule=rule)
    assert got.names == want


def test_lasso_penalty_and_choice(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 5)) * [1, 2, 50, 1, 0.1]
    y = 2 * x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=200)
    df = spark.createDataFrame([tuple(map(float, (t, *r))) for t, r in zip(y, x)],
                               "y double, " + ", ".join(f"x{k} double" for k in range(5)))
    fit_ = rigorous_lasso(df, "y", [f"x{k}" for k in range(5)])
    b = np.array(fit_.coefficients)
    n = 200
    # optimality at the last loadings used: |2 x'(y - xb)| <= penalty, with equality when selected
    e = y - x @ b
    last = np.sqrt(np.mean(x**2 * e[:, None] ** 2, axis=0))
    again = coordinate_descent(x.T @ x, x.T @ y, fit_.penalty * last)
    assert np.allclose(again, b, atol=1e-4)
    assert np.allclose(fit_.loadings, last, rtol=1e-8)
    slope = 2 * x.T @ (y - x @ again)
    assert np.all(np.abs(slope) <= fit_.penalty * last * (1 + 1e-8))
    assert set(fit_.selected) >= {"x0", "x1"} and fit_.rows == n
    assert fit_.choose(["x1", "x4", "x0", "x1"]) == [c for c in ("x1", "x4", "x0") if c in fit_.selected]


def test_leave_two_out_equals_separate_estimates(spark):
    y, d, x, g = arrays(30, 5, 5, 9, clusters=5)
    panel = frame(spark, y, d, x, g)
    units = unit_table(panel, SPEC)
    pairs, model = robustness.leave_groups_out(units, ["c0", "c1", "c3"])
    assert pairs == [("c0", "c1"), ("c0", "c3"), ("c1", "c3")]
    for s, pair in enumerate(pairs):
        alone = fit(unit_table(panel.filter(~panel.cluster.isin(*pair)), SPEC)).estimate
        both = model.estimates[s]
        for name in ("tau", "variance", "omega_nrmse", "lambda_nrmse", "weight_norm", "zeta"):
            assert getattr(both, name) == pytest.approx(getattr(alone, name), rel=1e-7, abs=1e-9), name
        assert (both.units, both.observations) == (alone.units, alone.observations)
    lines = {r["name"]: r for r in robustness.summarise_scenarios(model).collect()}
    taus = [model.estimates[s].tau for s in range(3)]
    assert lines["treated"]["p50"] == pytest.approx(np.median(taus))
    assert lines["treated"]["mean"] == pytest.approx(np.mean(taus), abs=1e-4)


def test_backdating_and_side_by_side(spark):
    y, d, x, g = arrays(20, 6, 5, 3)
    panel = frame(spark, y, d, x, g)
    early = robustness.backdated(unit_table(panel, SPEC), 2004, 2002).estimate
    direct = fit(unit_table(panel.filter("time <= 2004"), SPEC.with_(time_pre=2002))).estimate
    assert early.tau == pytest.approx(direct.tau, rel=1e-9)
    models = many_models(panel, [SPEC.with_(name="a", covariates=()), SPEC.with_(name="b")])
    table = {r["name"]: r for r in robustness.results_side_by_side(models).collect()}
    assert table["x1"]["a"] is None and table["x1"]["b"] is not None
    assert table["Units"]["a"] == table["Units"]["b"] == "20"
    assert robustness.leading_cluster_union(models, 1).count() >= 1


def test_incomplete_units_are_dropped_per_model(spark):
    y, d, x, g = arrays(20, 5, 5, 3)
    panel = frame(spark, y, d, x, g)
    holes = panel.filter("not (unit = 7 and time = 2002)").selectExpr(
        "*", "if(unit = 9, null, x2) as x3").drop("x2").withColumnRenamed("x3", "x2")
    plain, full = many_models(
        holes, [SPEC.with_(name="a", covariates=("x1",)), SPEC.with_(name="b")], incomplete="drop", jackknife=False)
    assert (plain.estimate.units, full.estimate.units) == (19, 18)
    alone = fit(unit_table(panel.filter("unit not in (7, 9)"), SPEC), jackknife=False).estimate
    assert full.estimate.tau == pytest.approx(alone.tau, rel=1e-9)


def test_trimming(spark):
    y, d, x, g = arrays(40, 5, 14, 8)
    panel = frame(spark, y, d, x, g)
    model, kept, rows = robustness.trimmed_units(panel, SPEC, 2005, ["x2"], ["x1"])
    scores = [r["pscore"] for r in kept.collect()]
    assert scores and all(0.1 <= s <= 0.9 for s in scores)
    assert rows.count() == 5 * len(scores) and model.names[0] == "x1"
