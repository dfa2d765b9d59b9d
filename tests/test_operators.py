"""Preparation, reshape and summary operators on small hand-made tables."""

import math

import pytest
from pyspark.sql import functions as F

from paneleffects.functions.columns import is_finite, number_text, ratio, round_even, row_sum
from paneleffects.functions.distributions import (
    incomplete_beta,
    normal_quantile,
    plain_number,
    student_t_two_sided,
)
from paneleffects.operators import prep, reshape, summary
from paneleffects.sources import files, stages

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def nonfinite(spark):
    rows = [(1, 1.0, 2.0), (2, None, 1.0), (3, NAN, 1.0), (4, INF, 1.0), (5, -INF, 1.0), (6, 3.0, 0.0)]
    return spark.createDataFrame(rows, "k int, a double, b double")


def test_finite_rules(nonfinite):
    assert [r["k"] for r in nonfinite.filter(is_finite("a")).collect()] == [1, 6]
    got = {r["k"]: r["r"] for r in nonfinite.select("k", ratio("a", "b").alias("r")).collect()}
    assert got == {1: 0.5, 2: None, 3: None, 4: None, 5: None, 6: None}
    assert prep.finite_rows(nonfinite, ["a", "b"]).count() == 2
    cleared = {r["k"]: r["a"] for r in prep.infinite_to_null(nonfinite).collect()}
    assert cleared[4] is None and cleared[5] is None and math.isnan(cleared[3])
    with pytest.raises(ValueError, match="'a': 2"):
        prep.require_complete(nonfinite, ["a", "b"])
    assert prep.require_complete(nonfinite, ["b"]) is nonfinite


def test_row_sum_keeps_null_and_rounding_is_half_even(spark):
    df = spark.createDataFrame([(1.0, None), (2.5, 1.0), (3.5, -0.0)], "a double, b double")
    assert [r[0] for r in df.select(row_sum(["a", "b"])).collect()] == [None, 3.5, 3.5]
    assert [r[0] for r in df.select(round_even("a", 0)).collect()] == [1.0, 2.0, 4.0]
    assert [r[0] for r in df.select(number_text("a", 2)).collect()] == ["1", "2.5", "3.5"]


def test_attach_keeps_rows_and_null_groups(spark):
    df = spark.createDataFrame([("x", 1), ("x", 3), (None, 5)], "g string, v int")
    for few in (True, False):
        out = prep.attach(df, ["g"], {"s": F.sum("v")}, few_groups=few)
        got = sorted((str(r["g"]), r["v"], r["s"]) for r in out.collect())
        assert got == [("None", 5, 5), ("x", 1, 4), ("x", 3, 4)]


def test_checked_small_leaves_large_tables_alone(spark):
    df = spark.range(10)
    assert stages.checked_small(df, 9) is df
    small = stages.checked_small(df, 10)
    assert small is not df and small.schema == df.schema and small.count() == 10


def test_complete_units(spark):
    rows = [(u, t, 1.0) for u in (1, 2, 3) for t in (1, 2)]
    rows = [r for r in rows if r[:2] != (2, 1)]
    df = spark.createDataFrame(rows, "u int, t int, v double").withColumn(
        "v", F.expr("if(u = 3 and t = 2, double('NaN'), v)"))
    assert {r["u"] for r in prep.complete_units(df, "u", 2, ["v"]).collect()} == {1}
    assert {r["u"] for r in prep.complete_units(df, "u", 2).collect()} == {1, 3}


def test_changes(spark):
    df = spark.createDataFrame(
        [(1, 2010, 2.0), (1, 2014, 4.0), (1, 2018, 3.0), (2, 2010, 0.0), (2, 2018, 1.0), (3, 2018, 1.0)],
        "u int, year int, v double")
    pc = {(r["u"], r["year"]): r["pc_v"] for r in prep.pct_changes(df, ["v"], "u", "year").collect()}
    assert pc == {(1, 2010): None, (1, 2014): 1.0, (1, 2018): -0.25, (2, 2010): None, (2, 2018): None,
                  (3, 2018): None}
    both = {r["u"]: r for r in prep.changes_between(df, ["v"], 2010, 2018, ["u"], "year").collect()}
    assert set(both) == {1, 2}
    assert both[1]["pc_v"] == -0.25 and both[1]["v_2010"] == 2.0 and both[1]["v_2018"] == 3.0
    assert both[2]["pc_v"] is None
    two = prep.two_period_change(df, ["v"], 2010, 2018, "u", "year").collect()
    assert [(r["u"], r["v_pc"]) for r in two] == [(1, 0.5)]


def test_flows_within_area_on_a_hot_pair(spark):
    flows = spark.createDataFrame([("a", "b", 1)] * 50 + [("a", "c", 7), ("c", "c", 2)], "h string, w string, n int")
    cross = spark.createDataFrame([("a", "N"), ("b", "N"), ("c", "S")], "tract string, area string")
    got = {(r["h"], r["area"]): r["n"] for r in
           prep.flows_within_area(flows, cross, "h", "w", ["n"], "tract", "area").collect()}
    assert got == {("a", "N"): 50, ("c", "S"): 2}


def test_reshape(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0)], "k int, name string, v double")
    wide = reshape.long_to_wide(df, ["k"], "name", "v", ["a", "b"])
    assert {r["k"]: (r["a"], r["b"]) for r in wide.collect()} == {1: (1.0, 2.0), 2: (3.0, None)}
    assert reshape.wide_to_long(wide, ["k"], ["a", "b"]).count() == 4
    assert reshape.affix_columns(wide, "w_", "_2010", keep=["k"]).columns == ["k", "w_a_2010", "w_b_2010"]
    assert reshape.columns_matching(wide, "^[ab]$", exclude=["b"]) == ["a"]
    other = spark.createDataFrame([(9, 1.0)], "k int, z double")
    assert reshape.stack_rows(wide, other).columns == ["k", "a", "b", "z"]
    joined = reshape.with_defaults(wide, other, ["k"], {"a": F.lit(-1.0), "z": F.lit(0.0)})
    assert {r["k"]: (r["a"], r["z"]) for r in joined.collect()} == {1: (1.0, 0.0), 2: (3.0, 0.0), 9: (-1.0, 1.0)}
    flipped = {r["name"]: (r["1"], r["2"]) for r in reshape.transpose(wide, "k", ["1", "2"], ["a", "b"]).collect()}
    assert flipped == {"a": ("1.0", "3.0"), "b": ("2.0", None)}


def test_quantiles_equal_exact_percentiles_with_repeats_and_many_ranges(spark):
    df = spark.range(5000).selectExpr(
        "id % 3 as g", "double(pmod(hash(id), 701)) as v", "if(id % 11 = 0, double('NaN'), double(id)) as w")
    got = {(r["g"], r["variable"]): r for r in summary.quantile_summary(df, ["v", "w"], by=["g"]).collect()}
    for c in ("v", "w"):
        want = df.filter(is_finite(c)).groupBy("g").agg(
            *[F.percentile(c, p).alias(n) for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))],
            F.avg(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"), F.count(c).alias("n"))
        for r in want.collect():
            for name in ("p25", "p50", "p75", "mean", "min", "max", "n"):
                assert got[r["g"], c][name] == pytest.approx(r[name], rel=1e-12), (c, name)


def test_histogram_bins_are_centred_on_the_ends(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (4.0,), (9.0,)], "v double")
    rows = {r["bin"]: r for r in summary.density_histogram(df, "v", 5, limits=(0.0, 4.0)).collect()}
    assert {b: r["n"] for b, r in rows.items()} == {0: 2, 1: 1, 4: 1}
    assert rows[0]["centre"] == 0.0 and rows[4]["centre"] == 4.0
    assert sum(r["density"] for r in rows.values()) == pytest.approx(1.0)


def test_welch_report(spark):
    a, b = [1.0, 2.0, 4.0, 7.0], [3.0, 8.0, 9.0, 12.0, 13.0]
    rows = [(1, x) for x in a] + [(0, x) for x in b] + [(0, NAN), (1, None), (1, INF)]
    r = summary.welch_report(spark.createDataFrame(rows, "g int, v double"), "g", ["v"]).first()
    assert r["difference"] == pytest.approx(-5.5)
    va, vb = 7.0 / 4, 15.5 / 5
    assert r["t"] == pytest.approx(-5.5 / math.sqrt(va + vb))
    assert r["df"] == pytest.approx((va + vb) ** 2 / (va**2 / 3 + vb**2 / 4))
    assert r["p_value"] == pytest.approx(student_t_two_sided(r["t"], r["df"]))
    assert r["label"] == "-5.5**" and r["t_label"] == "(-2.5)"


def test_rankings_keep_ties(spark):
    df = spark.createDataFrame([("x", v) for v in (5, 5, 4, 4, 3)] + [("y", 1)], "g string, v int")
    got = sorted((r["g"], r["v"], r["rank"]) for r in summary.top_ranks(df, "v", 2, ["g"]).collect())
    assert got == [("x", 4, 2), ("x", 4, 2), ("x", 5, 1), ("x", 5, 1), ("y", 1, 1)]


def test_weight_classes(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 0), (3, "b", 0)], "u int, c string, d int")
    high = spark.createDataFrame([("a",)], "c string")
    got = {r["u"]: r["weight_class"] for r in summary.weight_classes(df, "d", "c", high).collect()}
    assert got == {1: 2, 2: 1, 3: 0}


def test_distributions():
    assert student_t_two_sided(2.0, 10) == pytest.approx(0.0733880348, abs=1e-10)
    assert student_t_two_sided(-12.706204736, 1) == pytest.approx(0.05, abs=1e-9)
    assert student_t_two_sided(1.0, 2) == pytest.approx(1 - 1 / math.sqrt(3), abs=1e-12)
    assert incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-12)
    assert normal_quantile(0.975) == pytest.approx(1.959963985, abs=1e-9)


def test_plain_numbers():
    assert [plain_number(x, 2) for x in (2.0, 2.5, 0.005, -0.001, 100.0, 1e7, None)] == [
        "2", "2.5", "0.01", "0", "100", "10000000", None]
    assert plain_number(12.5, 0) == "12"


def test_files_round_trip(spark, tmp_path):
    for year in (2002, 2003):
        df = spark.createDataFrame([("0361", float(year))], "GEO string, v double")
        files.write_table(df, str(tmp_path / f"od_{year}"), "csv")
    both = files.read_periods(
        spark, {y: str(tmp_path / f"od_{y}") for y in (2002, 2003)}, "GEO string, v double")
    assert sorted((r["year"], r["GEO"], r["v"]) for r in both.collect()) == [
        (2002, "0361", 2002.0), (2003, "0361", 2003.0)]
    files.write_table(both, str(tmp_path / "panel"), partition_by=["year"])
    assert (tmp_path / "panel" / "year=2002").exists()
    back = files.read_parquet(spark, str(tmp_path / "panel"))
    assert back.filter("year = 2003").count() == 1
    typed = files.read_csv(spark, str(tmp_path / "od_2002"), types={"v": "string"})
    assert files.cast_key(typed, "GEO").dtypes == [("GEO", "string"), ("v", "string")]
    dim = files.read_dimension(
        spark, str(tmp_path / "od_2002"), "GEO string, v double", {"GEO": "unit"}, ["unit"])
    assert dim.columns == ["unit", "v"]
