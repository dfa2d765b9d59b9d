import numpy as np
import pytest
from panels import arrays, frame

import brute
from paneleffects.operators import effects, weights
from paneleffects.operators.demean import twoway_demean, twoway_effect
from paneleffects.operators.unit_table import PanelError, unit_table
from paneleffects.plans.estimate import fit, interaction_effect, synthetic_did
from paneleffects.spec import PanelSpec

SPEC = PanelSpec("outcome", cluster="cluster", time_pre=2003, time_init=2001)
COV = SPEC.with_(covariates=("x1", "x2"))


def reference_pieces(y, d, x, spec):
    """zeta, eta, rows, target, row weights for the direct solver."""
    co, tr = d == 0, d == 1
    rows = [y[:, k] for k in range(3)] + ([x[:, 0], x[:, 1]] if spec.covariates else [])
    nd = max(abs(r[tr].mean() - r[co].mean()) / np.sqrt((r[tr].var(ddof=1) + r[co].var(ddof=1)) / 2)
             for r in rows)
    a = np.array([r[co] for r in rows])
    b = np.array([r[tr].mean() for r in rows])
    v = 1 / a.var(axis=1, ddof=1) if spec.covariates else np.ones(len(rows))
    level = np.array([1.0] * 3 + [0.0] * (len(rows) - 3))
    return 1 / nd, (1 / nd) * (spec.time_pre - spec.time_init), a, b, v, level


@pytest.mark.parametrize("spec", [SPEC, COV], ids=["plain", "covariates"])
@pytest.mark.parametrize("n,treated,far,seed", [(8, 3, 0, 1), (30, 4, 0.5, 2), (40, 6, 1.5, 3)])
def test_weights_and_effect_match_direct_solution(spark, spec, n, treated, far, seed):
    y, d, x, g = arrays(n, 5, treated, seed, 5.0, far=far)
    units = unit_table(frame(spark, y, d, x, g), spec)
    zeta, eta, a, b, v, level = reference_pieces(y, d, x, spec)
    model = fit(units)
    e = model.estimate
    assert e.zeta == pytest.approx(zeta, rel=1e-12)

    w, shift = brute.unit_weights(a, b, level, v, eta)
    got = {r["unit"]: r for r in model.unit_weights().collect()}
    mine = np.array([got[i]["unit_weight"] for i in range(n)])
    assert np.allclose(mine[d == 0], w, atol=1e-9)
    assert np.allclose(mine[d == 1], 1 / treated)
    assert abs(mine[d == 0].sum() - 1) < 1e-9 and mine.min() >= 0
    assert got[n - 1]["unit_shift"] == pytest.approx(shift, abs=1e-7)
    assert got[0]["unit_shift"] == 0

    co = y[d == 0]
    pre, p = co[:, :3] - co[:, :3].mean(0), co[:, 3:].mean(1)
    gram, cross = pre.T @ pre / len(co), pre.T @ (p - p.mean()) / len(co)
    lam, _ = brute.time_weights(gram, cross)
    assert np.allclose(model.time_solution[0].weight, lam, atol=1e-9)
    lam0 = (p - co[:, :3] @ lam).mean()
    assert model.time_solution[0].shift == pytest.approx(lam0, abs=1e-9)

    post = np.array([0, 0, 0, 1.0, 1.0])
    full = np.outer(mine, np.append(lam, [0.5, 0.5]))
    tau = brute.effect(y, d, post, full)[0]
    assert e.tau == pytest.approx(tau, rel=1e-9)
    taus = brute.jackknife(y, d, post, full, list(range(n)))[:, 0]
    assert e.variance == pytest.approx((n - 1) / n * np.sum((taus - tau) ** 2), rel=1e-8)
    assert e.t_df == n * 5 - (n - 1) - 4 - 2

    # diagnostics
    tr_path, co_path = y[d == 1].mean(0), mine[d == 0] @ (co + shift)
    assert e.omega_nrmse == pytest.approx(
        np.sqrt(np.mean((tr_path - co_path)[:3] ** 2)) / tr_path[:3].mean(), abs=1e-8)
    gap = co[:, :3] @ lam + lam0 - p
    assert e.lambda_nrmse == pytest.approx(np.sqrt(np.mean(gap**2)) / p.mean(), abs=1e-9)
    assert e.weight_norm == pytest.approx(np.linalg.norm(mine[d == 0]), abs=1e-9)
    for k, name in enumerate(spec.covariates):
        c, t = mine[d == 0] @ x[d == 0, k], x[d == 1, k].mean()
        assert e.covariate_gaps[name] == pytest.approx((c - t) / t, abs=1e-8)
    paths = {r["time"]: r for r in model.paths.collect()}
    for k in range(5):
        assert paths[2001 + k]["treated"] == pytest.approx(tr_path[k], rel=1e-9)
        assert paths[2001 + k]["control"] == pytest.approx(co_path[k], rel=1e-8)

    clustered = fit(units, cluster_errors=True).estimate
    taus = brute.jackknife(y, d, post, full, list(g))[:, 0]
    assert clustered.variance == pytest.approx(3 / 4 * np.sum((taus - tau) ** 2), rel=1e-8)
    assert clustered.t_df == 3


def test_some_weights_are_exactly_zero(spark):
    y, d, x, g = arrays(40, 5, 6, 3, far=1.5)
    model = fit(unit_table(frame(spark, y, d, x, g), COV), jackknife=False)
    rows = model.unit_weights().filter("treated = 0").collect()
    assert 0 < sum(r["unit_weight"] == 0 for r in rows) < len(rows)


def test_wide_gram_equals_native(spark):
    y, d, x, g = arrays(30, 5, 4, 2, 6.0)
    units = unit_table(frame(spark, y, d, x, g), COV)
    stats = weights.group_stats(units)
    a = weights.control_moments(units, stats)[0]
    b = weights.control_moments(units, stats, fields=0)[0]
    assert a.n == b.n and np.allclose(a.gram, b.gram) and np.allclose(a.total, b.total, atol=1e-12)
    s = weights.solve_unit_weights(units, stats, {0: a})[0]
    t = weights.solve_unit_weights(units, stats, None, fields=0)[0]
    assert np.allclose(s.slope, t.slope, atol=1e-12) and s.mu == pytest.approx(t.mu)


def test_interaction_matches_refits(spark):
    y, d, x, g = arrays(20, 6, 5, 7)
    spec = COV.with_(time_pre=2004)
    model = synthetic_did(frame(spark, y, d, x, g), spec, jackknife=False)
    w = {r["unit"]: r["unit_weight"] for r in model.unit_weights().collect()}
    full = np.outer([w[i] for i in range(20)], model.profiles[0].weight)
    post = np.array([0, 0, 0, 0, 1.0, 1.0])
    for intercept in (False, True):
        got = interaction_effect(model, "x1", intercept)
        hat = brute.effect(y, d, post, full, x[:, 0], intercept)
        folds = brute.jackknife(y, d, post, full, list(range(20)), x[:, 0], intercept)
        var = 19 / 20 * np.sum((folds - hat) ** 2, axis=0)
        assert (got.tau, got.interaction) == pytest.approx(tuple(hat), rel=1e-8)
        assert (got.tau_variance, got.interaction_variance) == pytest.approx(tuple(var), rel=1e-7)


def test_exact_effect_is_recovered(spark):
    n, t = 8, 5
    unit, time = np.arange(n)[:, None] * 1.5, np.array([0, 3, 1, 4, 2.0])
    d = np.array([1, 1, 1, 0, 0, 0, 0, 0.0])
    post = np.array([0, 0, 0, 1, 1.0])
    y = unit + time + 7.0 * np.outer(d, post)
    _, _, x, g = arrays()
    panel = frame(spark, y, d, x, g)
    assert twoway_effect(panel, SPEC).first()["tau"] == pytest.approx(7.0, abs=1e-10)
    assert fit(unit_table(panel, COV), jackknife=False).estimate.tau == pytest.approx(7.0, abs=1e-9)
    uniform = fit(unit_table(panel, SPEC), uniform=True).estimate
    assert uniform.tau == pytest.approx(7.0, abs=1e-10)


def test_uniform_fit_equals_long_form_and_effects_do_not_move_demeaning(spark):
    y, d, x, g = arrays()
    panel = frame(spark, y, d, x, g)
    tau = twoway_effect(panel, SPEC).first()["tau"]
    assert fit(unit_table(panel, SPEC), uniform=True).estimate.tau == pytest.approx(tau, rel=1e-10)
    base = {(r["unit"], r["time"]): r["outcome_twfe"] for r in twoway_demean(panel, SPEC).collect()}
    moved = frame(spark, y + np.arange(8)[:, None] + np.array([3, 1, 4, 1, 5]) + 100, d, x, g)
    for r in twoway_demean(moved, SPEC).collect():
        assert r["outcome_twfe"] == pytest.approx(base[r["unit"], r["time"]], abs=1e-10)


def test_regression_rows_reproduce_tau(spark):
    from paneleffects.operators.demean import weighted_slope

    y, d, x, g = arrays()
    model = synthetic_did(frame(spark, y, d, x, g), COV, jackknife=False)
    got = weighted_slope(model.regression_rows(), "outcome_twfe", "treatment_twfe", "reg_weight").first()
    assert got["tau"] == pytest.approx(model.estimate.tau, rel=1e-10)
    assert got["observations"] == 40


def test_order_partitions_and_labels_do_not_matter(spark):
    y, d, x, g = arrays(20, 5, 4, 5)
    panel = frame(spark, y, d, x, g)
    base = synthetic_did(panel, COV).estimate
    shuffled = panel.repartition(7, "time").selectExpr(
        "concat('u', 100 - unit) as unit", "time", "outcome", "treated", "cluster", "x1", "x2")
    other = synthetic_did(shuffled, COV).estimate
    assert other.tau == pytest.approx(base.tau, rel=1e-9)
    assert other.variance == pytest.approx(base.variance, rel=1e-9)


def test_single_treated_unit_has_no_variance(spark):
    y, d, x, g = arrays(8, 5, 1)
    units = unit_table(frame(spark, y, d, x, g), SPEC)
    stats = weights.group_stats(units)
    with pytest.raises(weights.WeightError):
        weights.solve_unit_weights(units, stats)  # no treated variance, so no ridge strength
    e = fit(units, uniform=True).estimate
    assert e.variance is None and e.undefined_folds == 1 and e.p_value is None


@pytest.mark.parametrize("fault,words", [
    ("drop", "rows per unit"), ("double", "rows per unit"), ("null", "missing outcomes"),
    ("nan", "missing outcomes"), ("flag", "treatment flags"), ("moving", "covariates that move"),
])
def test_bad_panels_are_rejected(spark, fault, words):
    y, d, x, g = arrays()
    panel = frame(spark, y, d, x, g)
    one = "unit = 3 and time = 2002"
    from pyspark.sql import functions as F

    bad = {
        "drop": lambda: panel.filter(f"not ({one})"),
        "double": lambda: panel.unionByName(panel.filter(one)),
        "null": lambda: panel.withColumn("outcome", F.expr(f"if({one}, null, outcome)")),
        "nan": lambda: panel.withColumn("outcome", F.expr(f"if({one}, double('NaN'), outcome)")),
        "flag": lambda: panel.withColumn("treated", F.expr(f"if({one}, 1 - treated, treated)")),
        "moving": lambda: panel.withColumn("x1", F.expr(f"if({one}, x1 + 1, x1)")),
    }[fault]()
    with pytest.raises(PanelError, match=words):
        unit_table(bad, COV)


def test_simplex_least_squares_against_enumeration():
    rng = np.random.default_rng(4)
    for _ in range(200):
        t = rng.integers(1, 6)
        m = rng.normal(size=(rng.integers(2, 9), t))
        gram, cross = m.T @ m, rng.normal(size=t) * 2
        x, _ = weights.simplex_least_squares(gram, cross)
        _, best = brute.time_weights(gram, cross)
        assert x.min() >= 0 and abs(x.sum() - 1) < 1e-12
        assert 0.5 * x @ gram @ x - cross @ x <= best + 1e-9 * (1 + abs(best))


def test_cluster_weights_keep_ties_and_total(spark):
    rows = [(0, f"c{k}", 0.0, w) for k, w in enumerate([0.3, 0.2, 0.2, 0.1, 0.1, 0.05, 0.05])]
    df = spark.createDataFrame(rows, "scenario int, cluster string, treated double, unit_weight double")
    got = effects.cluster_weights(df, top=2).collect()
    assert sorted(r["cluster"] for r in got) == ["Total", "c0", "c1", "c2"]
    total = [r for r in got if r["is_total"]][0]
    assert total["cluster_weight"] == pytest.approx(0.7)


@pytest.mark.parametrize("scale,slope", [(1e5, 3.0), (1e5, 0.4), (1.0, 3.0)])
def test_weak_ridge_and_a_treated_path_outside_the_controls(spark, scale, slope):
    """Large outcome units make the ridge almost vanish; few controls stay active."""
    y, d, x, g = arrays(60, 5, 5, 6, 4.0)
    y = (y + slope * np.outer(d, np.arange(5))) * scale
    units = unit_table(frame(spark, y, d, x, g), SPEC)
    stats = weights.group_stats(units)
    s = weights.solve_unit_weights(units, stats, weights.control_moments(units, stats))[0]
    a, b = y[d == 0, :3].T, y[d == 1, :3].mean(0)
    w = np.maximum(0.0, s.mu - (a.T - s.target) @ s.slope)
    common = a.var(axis=1, ddof=1).mean()
    best, shift = brute.unit_weights(
        a / np.sqrt(common), b / np.sqrt(common), np.ones(3), np.ones(3), s.eta / common)

    def loss(w, shift):
        return np.sum((shift + a @ w - b) ** 2) / common + s.eta / common * w @ w

    assert w.sum() == pytest.approx(1.0, abs=1e-4 if s.residual > 1e-9 else 1e-9)
    assert s.residual < 1e-3
    ours, theirs = loss(w, s.shift), loss(best, shift * np.sqrt(common))
    assert ours <= theirs * (1 + 1e-4) + 1e-12
