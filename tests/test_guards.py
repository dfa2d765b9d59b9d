"""Errors instead of silent drops, arbitrary picks and unconverged fits."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from paneleffects import PanelError, PanelSpec, fit, interaction_effect, unit_table
from paneleffects.operators import lasso, prep, propensity, reshape, summary
from paneleffects.plans.robustness import results_side_by_side
from paneleffects.sources import files
from paneleffects.spec import ConvergenceError

SPEC = PanelSpec("y", cluster="area", time_pre=2, time_init=0)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(0)
    rows = [(u, t, float(rng.normal() + u % 4), int(u < 6), f"a{u % 5}", float(u % 3))
            for u in range(20) for t in range(5)]
    return spark.createDataFrame(rows, "unit int, time int, y double, treated int, area string, z double").cache()


def test_moving_cluster_is_an_error_not_a_drop(panel):
    moved = panel.withColumn("area", F.when((F.col("unit") == 3) & (F.col("time") == 4), "b").otherwise(F.col("area")))
    with pytest.raises(PanelError, match="clusters that move"):
        unit_table(moved, SPEC, range(5), incomplete="drop")


def test_named_periods_are_the_sample(panel):
    assert unit_table(panel, SPEC, range(4), incomplete="drop").data.count() == 20
    assert unit_table(panel, SPEC, range(4)).data.count() == 20


def test_early_sample_keeps_units_that_end_later(panel):
    short = panel.filter("NOT (unit = 7 AND time = 4)")
    assert unit_table(short, SPEC, range(5), incomplete="drop").data.count() == 19
    assert unit_table(short, SPEC, range(4), incomplete="drop").data.count() == 20


def test_duplicate_cells_raise(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 2.0), ("b", "x", 3.0)], "k string, name string, v double")
    with pytest.raises(PySparkException, match="several rows for one cell"):
        reshape.long_to_wide(df, ["k"], "name", "v", ["x"]).collect()
    assert reshape.long_to_wide(df.filter("v > 1"), ["k"], "name", "v", ["x"]).count() == 2


def test_model_names_must_differ(panel):
    model = fit(unit_table(panel, SPEC, range(5)), jackknife=False)
    with pytest.raises(ValueError, match="names repeat"):
        results_side_by_side([model, model])


def test_cluster_errors_need_clusters(panel):
    with pytest.raises(ValueError, match="cluster column"):
        fit(unit_table(panel, SPEC.with_(cluster=None), range(5)), cluster_errors=True)


def test_free_modifier_leaves_the_weights_alone(panel):
    plain = fit(unit_table(panel, SPEC, range(5)), jackknife=False)
    free = fit(unit_table(panel, SPEC.with_(modifiers=("z",)), range(5)), jackknife=False)
    assert free.estimate.tau == pytest.approx(plain.estimate.tau, rel=1e-12)
    assert np.isfinite(interaction_effect(free, "z").interaction)
    with pytest.raises(ValueError, match="neither"):
        interaction_effect(plain, "z")


def test_unconverged_fits_raise(spark, panel):
    rows = panel.filter("time = 0")
    term = propensity.Term("z", "z") if hasattr(propensity, "Term") else None
    with pytest.raises(ConvergenceError):
        propensity.fit_logits(rows, "treated", [], [term], max_passes=1)
    with pytest.raises(ConvergenceError):
        lasso.coordinate_descent(np.array([[1.0, 0.9], [0.9, 1.0]]), np.array([1.0, 0.5]), np.array([0.01, 0.01]), sweeps=1)


def test_period_of_encoded_paths(spark, tmp_path):
    for year in (2001, 2002):
        folder = tmp_path / f"my files+{year}"
        folder.mkdir()
        (folder / "a.csv").write_text(f"k\n{year}\n")
    paths = {y: str(tmp_path / f"my files+{y}") for y in (2001, 2002)}
    got = files.read_periods(spark, paths, "k int").collect()
    assert sorted((r.year, r.k) for r in got) == [(2001, 2001), (2002, 2002)]


def test_large_groups_do_not_overflow(spark):
    sizes = spark.range(1).selectExpr("CAST(4e9 AS bigint) AS n")
    n = F.col("n").cast("double")
    assert sizes.agg(F.sum(n * n)).first()[0] == 1.6e19
    assert summary.mean_group_size(spark.range(10).selectExpr("id % 2 AS g"), ["g"]).first()[0] == 5.0


def test_null_units_form_a_group(spark):
    df = spark.createDataFrame([(None, 1, 2.0), (None, 2, 3.0), (1, 1, 5.0)], "unit int, time int, v double")
    got = prep.spread_periods(df, ["v"], [1], "unit", "time").orderBy("v").collect()
    assert [r.v_1 for r in got] == [2.0, 2.0, 5.0]
    assert [r.s for r in prep.attach(df, ["unit"], {"s": F.sum("v")}).orderBy("v").collect()] == [5.0, 5.0, 5.0]
