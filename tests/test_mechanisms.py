"""Shared passes, certificates, selections, guards and staged files."""

import os
import re

import numpy as np
import pytest
from panels import arrays, frame
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import brute
from paneleffects.operators import lasso, moments, prep, propensity, summary, weights
from paneleffects.operators.propensity import Term
from paneleffects.operators.unit_table import LEFT, SCENARIO, unit_table
from paneleffects.plans import robustness
from paneleffects.plans.estimate import fit, lasso_estimates, many_models, report_lines
from paneleffects.sources import files, stages
from paneleffects.spec import ConvergenceError, PanelSpec

SPEC = PanelSpec("outcome", cluster="cluster", time_pre=2003, time_init=2001, covariates=("x1", "x2"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------------------------------ left-out scenarios


def test_left_out_pairs_equal_separate_runs(spark):
    y, d, x, g = arrays(40, 5, 6, 3, clusters=6, far=1.0)
    panel = frame(spark, y, d, x, g)
    units = unit_table(panel, SPEC)
    groups = [("c0", "c1"), ("c2",), ("c3", "c5"), ()]
    model = fit(units.with_scenarios(groups))
    for s, group in enumerate(groups):
        alone = fit(unit_table(panel.filter(~F.col("cluster").isin(*group, "")), SPEC))
        assert model.estimates[s].tau == pytest.approx(alone.estimate.tau, rel=1e-9)
        assert model.estimates[s].variance == pytest.approx(alone.estimate.variance, rel=1e-7)
        assert model.unit_solution[s].mu == pytest.approx(alone.unit_solution[0].mu, rel=1e-9)
        assert model.estimates[s].covariate_gaps == pytest.approx(alone.estimate.covariate_gaps, rel=1e-6, abs=1e-9)


def test_left_out_sums_read_each_unit_once(spark, monkeypatch):
    """Statistics, moments and weight steps take one row a unit, whatever the number of scenarios."""
    y, d, x, g = arrays(60, 5, 6, 3, clusters=6, far=1.5)
    units = unit_table(frame(spark, y, d, x, g), SPEC).with_scenarios([("c0", "c1"), ("c1", "c2"), ("c2", "c3")])
    seen = []
    for name in ("moment_pass", "spread_pass", "block_pass"):
        inner = getattr(weights, name)
        monkeypatch.setattr(weights, name, lambda rows, *a, _f=inner, _n=name, **k: (seen.append((_n, rows.count())), _f(rows, *a, **k))[1])
    stats = weights.group_stats(units)
    solved = weights.solve_unit_weights(units, stats, weights.control_moments(units, stats))
    assert len(solved) == 3 and {n for n, _ in seen} == {"moment_pass", "spread_pass", "block_pass"}
    assert all(rows <= 60 for _, rows in seen)
    assert units.data.count() == 60 and units.rows.count() == sum(
        g_ not in pair for pair in units.groups for g_ in g)
    assert LEFT in units.data.columns


def test_scenario_without_treated_units(spark):
    y, d, x, _ = arrays(12, 5, 3)
    g = np.array(["t"] * 3 + ["a"] * 5 + ["b"] * 4)
    units = unit_table(frame(spark, y, d, x, g), SPEC)
    with pytest.raises(weights.WeightError, match="scenario 0 has no treated"):
        weights.group_stats(units.with_scenarios([("t", "a")]))


def test_null_clusters_stay_in_every_scenario(spark):
    y, d, x, g = arrays(16, 5, 4)
    panel = frame(spark, y, d, x, g).withColumn("cluster", F.when(F.col("unit") == 9, None).otherwise(F.col("cluster")))
    units = unit_table(panel, SPEC).with_scenarios([("c0",), ("c1",)])
    assert units.rows.filter("unit = 9").count() == 2


# ------------------------------------------------------------------ wide sums


@pytest.mark.parametrize("k", [4, 8, 11, 13, 25, 40])
def test_moments_of_any_width(spark, k):
    rng = np.random.default_rng(k)
    z = rng.normal(size=(300, k)) + 5.0
    rows = [(int(i % 2), *map(float, r)) for i, r in enumerate(z)]
    df = spark.createDataFrame(rows, f"{SCENARIO} int, " + ", ".join(f"v{i} double" for i in range(k))).repartition(5)
    got = moments.moment_pass(df, [f"v{i}" for i in range(k)], {"e": "v0 * 2", "f": "v1"})
    spread = moments.spread_pass(df, SCENARIO, [f"v{i}" for i in range(k)])
    for s in (0, 1):
        own = z[s::2]
        assert got[s].n == spread[s].n == 150
        assert np.allclose(got[s].total, own.sum(0)) and np.allclose(got[s].gram, own.T @ own)
        assert got[s].extra == pytest.approx({"e": 2 * own[:, 0].sum(), "f": own[:, 1].sum()})
        assert np.allclose(spread[s].mean, own.mean(0)) and np.allclose(spread[s].variance, own.var(0, ddof=1))


def test_sums_stay_in_generated_code_or_leave_for_arrow(spark):
    """The number of sums decides by what Spark generates code for."""
    most = moments.generated_fields(spark)
    for k in (4, 11, 12, 13, 20):
        names = [f"v{i}" for i in range(k)]
        df = spark.range(10).selectExpr(f"0 AS {SCENARIO}", *[f"double(id + {i}) AS {n}" for i, n in enumerate(names)])
        fields = 2 + k + k * (k + 1) // 2
        sums = df.groupBy(SCENARIO).agg(moments.sums_struct(
            {"n": "1", **{f"s{i}": n for i, n in enumerate(names)},
             **{f"g{i}_{j}": f"{names[i]} * {names[j]}" for i in range(k) for j in range(i, k)}}))
        sums.collect()
        text = plan(sums)
        generated = "*(" in text.split("HashAggregate")[0][-12:]
        assert generated == (fields <= most), (k, text[:300])


def test_moved_moments(spark):
    z = np.random.default_rng(1).normal(size=(50, 3)) + 100
    m = moments.Moments(50, z.sum(0), z.T @ z).moved(z.mean(0))
    c = z - z.mean(0)
    assert np.allclose(m.total, 0, atol=1e-9) and np.allclose(m.gram, c.T @ c, atol=1e-7)


# ------------------------------------------------------------------ certificates


def test_gap_certifies_the_weights(spark):
    for far, seed in ((0.0, 1), (1.5, 3), (3.0, 4)):
        y, d, x, g = arrays(40, 5, 6, seed, 5.0, far=far)
        units = unit_table(frame(spark, y, d, x, g), SPEC)
        stats = weights.group_stats(units)
        s = weights.solve_unit_weights(units, stats, weights.control_moments(units, stats))[0]
        assert 0 <= s.gap < 1e-9


def test_a_stalled_search_raises(spark, monkeypatch):
    y, d, x, g = arrays(40, 5, 6, 3, far=3.0)
    units = unit_table(frame(spark, y, d, x, g), SPEC)
    stats = weights.group_stats(units)
    first = weights.control_moments(units, stats)
    with pytest.raises(weights.WeightError, match="not solved after 1"):
        weights.solve_unit_weights(units, stats, first, max_passes=1)
    see = weights._Newton.see

    def give_up(self, m):
        see(self, m)
        self.done = True

    monkeypatch.setattr(weights._Newton, "see", give_up)
    with pytest.raises(weights.WeightError, match="stalled"):
        weights.solve_unit_weights(units, stats, first)


def test_screened_controls_have_no_weight(spark, monkeypatch):
    """Screening leaves out only controls whose weight is 0, and changes no solution."""
    rng = np.random.default_rng(8)
    n = 400
    y = 10 + rng.normal(size=(n, 5)) * 2
    d = np.array([1.0] * 8 + [0.0] * (n - 8))
    y[:8, 2] += 6.0
    x = rng.normal(size=(n, 2)) + 3.0
    g = np.array([f"c{k % 5}" for k in range(n)])
    units = unit_table(frame(spark, y, d, x, g), SPEC)
    stats = weights.group_stats(units)
    first = weights.control_moments(units, stats)
    left = []
    inner = weights._not_screened
    monkeypatch.setattr(weights, "_not_screened", lambda *a: (left.append(inner(*a)), left[-1])[1])
    with_ = weights.solve_unit_weights(units, stats, first)[0]
    monkeypatch.setattr(weights, "SCREEN_BELOW", 0.0)
    without = weights.solve_unit_weights(units, stats, first)[0]
    assert len(left) == 1 and left[0].count() < n / 2
    assert np.allclose(with_.slope, without.slope, rtol=1e-9) and with_.mu == pytest.approx(without.mu, rel=1e-9)
    kept = {r["unit"] for r in left[0].select("unit").collect()}
    model = fit(units, jackknife=False)
    positive = {r["unit"] for r in model.unit_weights().filter("treated = 0 AND unit_weight > 0").collect()}
    assert positive <= kept and 0 < len(positive) < n / 4


def test_zero_weights_match_the_direct_solution(spark):
    y, d, x, g = arrays(40, 5, 6, 3, far=3.0)
    units = unit_table(frame(spark, y, d, x, g), SPEC)
    model = fit(units, jackknife=False)
    rows = [y[:, k] for k in range(3)] + [x[:, 0], x[:, 1]]
    a = np.array([r[d == 0] for r in rows])
    b = np.array([r[d == 1].mean() for r in rows])
    w, _ = brute.unit_weights(a, b, np.array([1.0, 1, 1, 0, 0]), 1 / a.var(axis=1, ddof=1), model.unit_solution[0].eta)
    got = {r["unit"]: r["unit_weight"] for r in model.unit_weights().collect()}
    assert np.allclose([got[i] for i in range(6, 40)], w, atol=1e-8) and 0 < np.sum(w < 1e-12) < 34


# ------------------------------------------------------------------ stepwise logit


def test_bordered_step_equals_full_blocks(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(size=(200, 4))
    y = (rng.random(200) < 0.4).astype(float)
    rows = [(float(t), *map(float, r)) for t, r in zip(y, z, strict=True)]
    flat = spark.createDataFrame(rows, "y double, x0 double, z0 double, z1 double, z2 double").repartition(3)
    base = np.array([0.3, -0.2])
    shared = propensity.logit_pass(flat, 2, {i: np.append(base, 0.0) for i in range(3)})
    for i in range(3):
        design = np.column_stack([np.ones(200), z[:, 0], z[:, 1 + i]])
        p = 1 / (1 + np.exp(-design[:, :2] @ base))
        deviance, score, information = shared[i]
        assert deviance == pytest.approx(-2 * np.sum(y * np.log(p) + (1 - y) * np.log(1 - p)))
        assert np.allclose(score, design.T @ (y - p))
        assert np.allclose(information, design.T @ (design * (p * (1 - p))[:, None]))
    apart = propensity.logit_pass(flat, 2, {0: np.append(base, 0.0), 1: np.append(base, 1e-300)})
    assert np.allclose(apart[0][2], shared[0][2]) and np.allclose(apart[1][1], shared[1][1])


def test_candidates_repeat_no_rows(spark):
    df = spark.range(40).selectExpr("double(id % 3 = 0) AS y", "double(id % 7) AS a", "double(id % 5) AS b")
    text = []
    inner = propensity.block_pass
    propensity.block_pass = lambda rows, f: (text.append(plan(rows)), inner(rows, f))[1]
    try:
        propensity.fit_logits(df, "y", [], [Term("a", ("a",)), Term("b", ("b",)), None])
    finally:
        propensity.block_pass = inner
    assert text and not any("Generate" in t for t in text)


# ------------------------------------------------------------------ ranks


@pytest.mark.parametrize("k,by", [(101, []), (2500, []), (120, ["g"]), (10**6, ["g"])])
def test_many_ranks_equal_a_window(spark, k, by):
    from pyspark.sql import Window

    df = spark.range(6000).selectExpr(
        "if(id % 13 = 0, NULL, id % 3) AS g", "if(id % 50 = 0, NULL, pmod(hash(id), 3001)) AS v", "id").repartition(7)
    want = df.withColumn("rank", F.dense_rank().over(Window.partitionBy(*by).orderBy(F.col("v").desc()))).filter(F.col("rank") <= k)
    got = summary.top_ranks(df, "v", k, by)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def test_ranks_leave_no_one_task_stage(spark):
    df = spark.range(20000).selectExpr("id", "pmod(hash(id), 15000) AS v").repartition(6)
    lead = summary.leading_values(df, "v", 5000)
    assert lead.count() == 5000
    text = plan(lead)
    assert "SinglePartition" not in text and "Window" not in text


# ------------------------------------------------------------------ many rows without a unit


def test_rows_without_a_unit_are_dealt_out(spark):
    n = 4000
    df = spark.range(n).selectExpr(
        "CASE WHEN id % 2 = 0 THEN NULL WHEN id % 8 = 1 THEN -1 ELSE id END AS unit", "int(id % 4) AS time", "double(id) AS v").repartition(6)
    got = prep.spread_periods(df, ["v"], [1, 2], "unit", "time", heavy=[-1])
    want = {}
    for r in df.collect():
        for t in (1, 2):
            if r.time == t:
                want[r.unit, t] = max(want.get((r.unit, t), r.v), r.v)
    rows = got.collect()
    assert len(rows) == n
    assert all((r.v_1, r.v_2) == (want.get((r.unit, 1)), want.get((r.unit, 2))) for r in rows)
    dealt = got.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert max(r["count"] for r in dealt) < 0.6 * n or len(dealt) == 1
    parts = df.withColumn("_part", F.when(F.col("unit").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(prep.SPREAD))).otherwise(-1))
    keys = parts.groupBy("unit", "_part").count().agg(F.max("count")).first()[0]
    assert keys <= n / 8  # half the rows have no unit, and no window holds more than a sliver of them


def test_attach_by_unit_is_one_window(spark):
    df = spark.createDataFrame([(1, None, 2.0), (1, None, 3.0), (1, "a", 5.0), (None, "a", 7.0), (1, "a", 1.0)], "u int, w string, v double")
    got = sorted((str(r.u), str(r.w), r.v, r.s) for r in prep.attach(df, ["u", "w"], {"s": F.sum("v")}).collect())
    assert got == [("1", "None", 2.0, 5.0), ("1", "None", 3.0, 5.0), ("1", "a", 1.0, 6.0), ("1", "a", 5.0, 6.0), ("None", "a", 7.0, 7.0)]


# ------------------------------------------------------------------ guards and staging


def test_guard_counts_while_staging(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan"))], "k int, v double")
    assert prep.stage_complete(df, ["k"]).count() == 3
    staged, counts = prep.stage_counted(df, ["k", "v"])
    assert counts == {"k": 0, "v": 2} and staged.count() == 3
    with pytest.raises(ValueError, match="'v': 2"):
        prep.stage_complete(df, ["k", "v"])


def test_left_out_units_are_counted_by_cause(spark):
    y, d, x, g = arrays(20, 5, 4)
    panel = frame(spark, y, d, x, g).filter("NOT (unit = 3 AND time = 2002)")
    panel = panel.withColumn("outcome", F.when((F.col("unit") == 5) & (F.col("time") == 2001), None).otherwise(F.col("outcome")))
    panel = panel.withColumn("x1", F.when(F.col("unit").isin(7, 8), float("nan")).otherwise(F.col("x1")))
    units = unit_table(panel, SPEC, range(2001, 2006), incomplete="drop")
    assert units.dropped == {"rows per unit and cluster": 1, "missing outcomes": 2, "missing covariates": 2}
    assert units.data.count() == 16
    assert unit_table(panel, SPEC.with_(covariates=()), range(2001, 2006), incomplete="drop").dropped == {
        "rows per unit and cluster": 1, "missing outcomes": 2}


def test_owners_free_their_files(spark):
    folder = stages.stage_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    y, d, x, g = arrays(20, 5, 4)
    panel = frame(spark, y, d, x, g)
    models = many_models(panel, [SPEC, SPEC.with_(name="b", covariates=())], jackknife=False)
    assert set(os.listdir(folder)) > before
    models[0].close()
    assert models[1].unit_weights().count() == 20  # shared unit rows are still there
    models[1].close()
    models[1].close()
    assert set(os.listdir(folder)) == before
    assert models[0].estimate.tau is not None and models[0].table().count() > 5
    with many_models(panel, [SPEC], jackknife=False)[0] as model:
        assert model.clusters().count() > 1
    assert set(os.listdir(folder)) == before


def test_queries_free_their_files(spark):
    from paneleffects.catalog import load

    small = "/root/testdata/sf0.001"
    if not os.path.isdir(small):
        pytest.skip("no test tables")
    folder = stages.stage_folder(spark).removeprefix("file:")
    for name in ("sdid_full", "pscore_trim", "lasso_two_rounds", "missing_guard"):
        before = set(os.listdir(folder))
        assert load()[0][name](spark, small).count() > 0
        assert set(os.listdir(folder)) == before, name


def test_trimmed_table_equals_trimmed_panel(spark):
    rng = np.random.default_rng(3)
    n = 200
    x = rng.normal(size=(n, 2)) * 1.5 + 3
    d = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 3)))).astype(float)
    y = 10 + rng.normal(size=(n, 5)) + x[:, :1]
    g = np.array([f"c{k % 4}" for k in range(n)])
    panel = frame(spark, y, d, x, g)
    lags = panel.groupBy("unit").agg(F.max(F.when(F.col("time") == 2002, F.col("outcome"))).alias("outcome_2002"))
    logit, kept, rows = robustness.trimmed_units(panel.join(lags, "unit"), SPEC, 2005, ["x2", "outcome_2002"], ["x1"])
    same, units = robustness.trimmed_table(unit_table(panel, SPEC), ["x2", "outcome_2002"], ["x1"])
    assert same.names == logit.names and same.coefficients == pytest.approx(logit.coefficients, rel=1e-8)
    assert {r.unit for r in units.data.collect()} == {r.unit for r in kept.collect()}
    assert 20 < units.data.count() < n
    assert "Join" not in plan(units.data)
    assert fit(units).estimate.tau == pytest.approx(fit(unit_table(rows, SPEC)).estimate.tau, rel=1e-9)
    with pytest.raises(ValueError, match="nothing"):
        robustness.trimmed_table(unit_table(panel, SPEC), ["nothing"])


# ------------------------------------------------------------------ files


def test_one_period_is_replaced_and_the_rest_pruned(spark, tmp_path):
    path = str(tmp_path / "panel")
    df = spark.range(30).selectExpr("int(2000 + id % 3) AS year", "id AS k", "double(id) AS v")
    for fmt in ("parquet", "csv"):
        files.write_periods(df, path + fmt, fmt=fmt)
        untouched = {f for f in os.listdir(f"{path}{fmt}/year=2000") if f.startswith("part")}
        files.write_periods(df.filter("year = 2001").withColumn("v", -F.col("v")), path + fmt, fmt=fmt)
        assert {f for f in os.listdir(f"{path}{fmt}/year=2000") if f.startswith("part")} == untouched
        got = files.read_year_folders(spark, path + fmt, "k long, v double", fmt=fmt)
        assert {(r.year, r.k, r.v) for r in got.collect()} == {
            (2000 + i % 3, i, -float(i) if i % 3 == 1 else float(i)) for i in range(30)}
        one = files.read_year_folders(spark, path + fmt, "k long, v double", [2002], fmt=fmt)
        assert one.columns == ["year", "k", "v"] and one.count() == 10
        assert re.search(r"PartitionFilters: \[.*2002", plan(one))
    with pytest.raises(PySparkException, match="no year"):
        files.write_periods(df.withColumn("year", F.lit(None).cast("int")), path + "bad")


def test_dimensions_are_unique_and_sized(spark, tmp_path):
    path = str(tmp_path / "cross")
    rows = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", None)], "code string, name string")
    files.write_table(rows, path, "csv")
    got = files.read_dimension(spark, path, "code string, name string", {"name": "area"}, ["area"], ["code"])
    assert sorted(map(tuple, got.collect())) == [("1", "a"), ("2", "b")]
    facts = spark.createDataFrame([("1", 5)], "code string, n int")
    assert "BroadcastHashJoin" in plan(facts.join(got, "code"))
    twice = rows.union(rows.filter("code = '2'"))
    with pytest.raises(ValueError, match="several rows for 2"):
        files.unique_dimension(twice, ["code"])
    with pytest.raises(ValueError, match="rows without name"):
        files.unique_dimension(rows, ["code", "name"])
    large = files.unique_dimension(rows, ["code"], max_bytes=10)
    assert "ResolvedHint" not in large._jdf.queryExecution().analyzed().toString()
    assert files.unique_dimension(rows.limit(0), ["code"]).count() == 0


# ------------------------------------------------------------------ convergence and lines


def test_lasso_tells_if_it_has_not_settled(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 3)) * [1, 5, 2]
    y = 3 * x[:, 0] + x[:, 1] * rng.normal(size=80)
    df = spark.createDataFrame([(float(t), *map(float, r)) for t, r in zip(y, x, strict=True)], "y double, a double, b double, c double")
    with pytest.warns(UserWarning, match="not settled after 1"):
        assert not lasso.rigorous_lasso(df, "y", ["a", "b", "c"], max_iter=1).settled
    with pytest.raises(ConvergenceError):
        lasso.rigorous_lasso(df, "y", ["a", "b", "c"], max_iter=1, unsettled="error")
    assert not lasso.rigorous_lasso(df, "y", ["a", "b", "c"], max_iter=1, unsettled="ignore").settled
    assert lasso.rigorous_lasso(df, "y", ["a", "b", "c"], max_iter=100, tol=1e-3).settled


def test_fixed_covariates_stay_beside_the_chosen(spark):
    rng = np.random.default_rng(4)
    n = 120
    x = rng.normal(size=(n, 2)) + 3
    y = 10 + rng.normal(size=(n, 5)) + 8 * x[:, 1:2]
    d = np.array([1.0] * 15 + [0.0] * (n - 15))
    panel = frame(spark, y, d, x, np.array([f"c{k % 4}" for k in range(n)]))
    spec = SPEC.with_(covariates=("x1",))
    (model,) = lasso_estimates(
        panel, [spec], ["x1", "x2"], ["x2", "x1"], range(2001, 2006), gamma=0.1, jackknife=False, unsettled="ignore")
    assert model.units.spec.covariates[:1] == ("x1",) and "x2" in model.units.spec.covariates
    (none,) = lasso_estimates(
        panel, [spec], ["x1", "x2"], [], range(2001, 2006), gamma=0.1, jackknife=False, unsettled="ignore")
    assert none.units.spec.covariates == ("x1",)


def test_gap_line_stays_without_a_treated_mean(spark):
    y, d, x, g = arrays(20, 5, 4, 5)
    x[:4, 0] = [-1.0, 1.0, -2.0, 2.0]
    e = fit(unit_table(frame(spark, y, d, x, g), SPEC), jackknife=False).estimate
    assert e.covariate_gaps["x1"] is None and e.covariate_gaps["x2"] is not None
    assert ("x1", None, None) in [line[1:] for line in report_lines(SPEC, e)]


def test_leaders_have_weight(spark):
    rows = [(0, c, 0.0, w) for c, w in (("a", 0.6), ("b", 0.4), ("c", 0.0), ("d", 0.0))]
    df = spark.createDataFrame(rows, "scenario int, cluster string, treated double, unit_weight double")

    class Model:
        def clusters(self, top=10):
            from paneleffects.operators.effects import cluster_weights

            return cluster_weights(df, top)

    assert robustness.leading_clusters(Model(), 3) == ["a", "b"]
    assert sorted(r[0] for r in robustness.leading_cluster_union([Model(), Model()], 3).collect()) == ["a", "b"]
