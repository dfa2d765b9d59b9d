"""Effect estimate, jackknife and diagnostics over a weighted unit table.

With weights w_it = unit weight * time weight the demeaned treatment of a balanced panel
factors into a unit part u_i = d_i - p (d: treated flag, p: treated share) and a period
part h_t = post_t - share of post periods. So each unit enters every sum through two
numbers only, a_i = sum_t lambda_t y~_it and b_i = sum_t lambda_t h_t y~_it, where y~ is
the two-way demeaned outcome.

Leaving out a set of n_c units shifts the demeaned values of all others by
sum_{c} y~_ut / (N - n_c), likewise for u. All leave-out estimates therefore follow
exactly from the totals and the left-out set's own sums: one pass instead of n re-fits.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.distributions import student_t_two_sided
from ..sources.stages import driver_table
from .moments import dot, sums_struct
from .unit_table import SCENARIO, UnitTable
from .weights import GroupStats, TimeWeightSolution, UnitWeightSolution, _row_names


@dataclass(frozen=True)
class TimeProfile:
    """Per-period numbers of one scenario."""

    weight: np.ndarray   # lambda_t, all periods
    shift: float         # level shift of the pre-periods
    post: np.ndarray     # h_t
    centre: np.ndarray   # period mean minus overall mean of the outcome
    share: float         # treated units over all units


@dataclass(frozen=True)
class Estimate:
    """Results of one scenario."""

    scenario: int
    tau: float | None
    variance: float | None
    t_statistic: float | None
    t_df: float
    p_value: float | None
    ci_low: float | None
    ci_high: float | None
    undefined_folds: int
    omega_nrmse: float
    lambda_nrmse: float
    covariate_gaps: dict[str, float | None]
    weight_norm: float
    units: int
    observations: int
    zeta: float | None = None


def time_profiles(
    units: UnitTable,
    stats: Mapping[int, GroupStats],
    time_weights: Mapping[int, TimeWeightSolution],
) -> dict[int, TimeProfile]:
    t, n_post = len(units.periods), len(units.post)
    result = {}
    for s, st in stats.items():
        weight = np.full(t, 1.0 / n_post)
        weight[units.pre] = time_weights[s].weight
        flag = np.zeros(t)
        flag[units.post] = 1.0
        at = st.pick(units.outcome_cols)
        share = st.n[1] / sum(st.n)
        period_mean = share * st.mean[1][at] + (1.0 - share) * st.mean[0][at]
        result[s] = TimeProfile(
            weight, time_weights[s].shift, flag - n_post / t,
            period_mean - period_mean.mean(), share)
    return result


def uniform_time_weights(units: UnitTable, stats: Mapping[int, GroupStats]):
    """Weight 1 for every period (then divided alike): plain two-way fixed effects."""
    n_pre, n_post = len(units.pre), len(units.post)
    return {s: TimeWeightSolution(np.full(n_pre, 1.0 / n_post), 0.0, True) for s in stats}


def weighted_units(
    units: UnitTable,
    stats: Mapping[int, GroupStats],
    solution: Mapping[int, UnitWeightSolution] | None,
) -> DataFrame:
    """Unit rows with ``unit_weight`` and ``unit_shift``; without a solution the weights are 1."""
    data = units.rows
    if solution is None:
        return data.withColumns({"unit_weight": F.lit(1.0), "unit_shift": F.lit(0.0)})
    names = _row_names(units)
    keys = list(solution)
    columns = {
        SCENARIO: ("int", keys),
        "_mu": ("double", [solution[s].mu for s in keys]),
        "_shift": ("double", [solution[s].shift for s in keys]),
        "_each": ("double", [1.0 / solution[s].n_treated for s in keys]),
    }
    for i in range(len(names)):
        columns[f"_t{i}"] = ("double", [solution[s].target[i] for s in keys])
        columns[f"_s{i}"] = ("double", [solution[s].slope[i] for s in keys])
    fitted = "_mu - (" + dot(
        [f"_s{i}" for i in range(len(names))], [f"({c} - _t{i})" for i, c in enumerate(names)]) + ")"
    return data.join(driver_table(data.sparkSession, columns), SCENARIO).selectExpr(
        *data.columns,
        f"IF(treated = 1, _each, greatest({fitted}, 0.0D)) AS unit_weight",
        "IF(treated = 1, 0.0D, _shift) AS unit_shift",
    )


def _with_profile(
    weighted: DataFrame,
    units: UnitTable,
    profiles: Mapping[int, TimeProfile],
    extra: Mapping[str, Sequence[float]] | None = None,
) -> DataFrame:
    """Unit rows with a_i and b_i, and any further per-scenario numbers as columns."""
    keys = list(profiles)
    t = range(len(units.periods))
    columns = {
        SCENARIO: ("int", keys),
        "_l0": ("double", [float(profiles[s].weight.sum()) for s in keys]),
        "_l1": ("double", [float(profiles[s].weight @ profiles[s].post) for s in keys]),
    }
    for k in t:
        columns[f"_c{k}"] = ("double", [profiles[s].centre[k] for s in keys])
        columns[f"_l{k}_"] = ("double", [profiles[s].weight[k] for s in keys])
        columns[f"_h{k}"] = ("double", [profiles[s].weight[k] * profiles[s].post[k] for s in keys])
    for name, values in (extra or {}).items():
        columns[name] = ("double", list(values))
    joined = weighted.join(driver_table(weighted.sparkSession, columns), SCENARIO)
    gaps = [f"(y_{k} - _c{k})" for k in t]
    a = dot([f"_l{k}_" for k in t], gaps) + " - _l0 * _ybar"
    b = dot([f"_h{k}" for k in t], gaps) + " - _l1 * _ybar"
    return joined.selectExpr("*", f"{units.mean} AS _ybar").selectExpr("*", f"{a} AS a", f"{b} AS b")


@dataclass
class EffectTotals:
    """Sums of one scenario that the estimate and all leave-out estimates share."""

    n: float
    n_treated: float
    moments: dict[str, float]  # w, wa, wb
    u: list[float]             # sums of w u_k
    uu: np.ndarray             # sums of w u_k u_l
    ub: list[float]            # sums of w u_k b
    centre: list[float]        # means taken off the raw unit parts
    l: tuple[float, float, float]  # noqa: E741  sums of lambda, lambda h, lambda h^2


def _solve(sums: EffectTotals, intercept: bool) -> np.ndarray | None:
    l0, l1, l2 = sums.l
    k = len(sums.u)
    xx, xy = l2 * sums.uu, np.array(sums.ub, dtype=float)
    if intercept:
        sw = sums.moments["w"] * l0
        sx = l1 * np.array(sums.u)
        xx = xx * sw - np.outer(sx, sx)
        xy = xy * sw - sx * sums.moments["wa"]
    if k == 1:
        return xy / xx[0] if xx[0, 0] != 0 else None
    try:
        return np.linalg.solve(xx, xy)
    except np.linalg.LinAlgError:
        return None


def effect_totals(
    weighted: DataFrame,
    units: UnitTable,
    stats: Mapping[int, GroupStats],
    profiles: Mapping[int, TimeProfile],
    modifiers: Sequence[str] = (),
) -> tuple[dict[int, EffectTotals], dict[int, dict[str, dict[int, float]]]]:
    """One pass: the sums behind the estimate plus all diagnostics, by treatment group.

    ``modifiers`` are covariate columns z; they add the regressors D*z to D.
    """
    z_mean = _modifier_means(weighted, modifiers) if modifiers else {}
    keys = list(profiles)
    extra = {"_p": [stats[s].n[1] / sum(stats[s].n) for s in keys],
             "_ls": [profiles[s].shift for s in keys]}
    extra |= {f"_m{j}": [z_mean[s][j] for s in keys] for j in range(len(modifiers))}
    rows = _with_profile(weighted, units, profiles, extra)
    w = "unit_weight"
    u = ["(treated - _p)"] + [f"(treated * {z} - _m{j})" for j, z in enumerate(modifiers)]
    pre = dot([f"_l{k}_" for k in units.pre], [f"y_{k}" for k in units.pre]) + " + _ls"
    rows = rows.selectExpr(
        "*", f"{pre} - {units.post_mean} AS _gap", f"{units.post_mean} AS _post",
        *[f"{c} AS _u{i}" for i, c in enumerate(u)])
    k = len(u)
    parts = {"w": w, "wa": f"{w} * a", "wb": f"{w} * b", "ww": f"{w} * {w}",
             "gap2": "_gap * _gap", "post": "_post"}
    parts |= {f"u{i}": f"{w} * _u{i}" for i in range(k)}
    parts |= {f"ub{i}": f"{w} * _u{i} * b" for i in range(k)}
    parts |= {f"uu{i}_{j}": f"{w} * _u{i} * _u{j}" for i in range(k) for j in range(i, k)}
    parts |= {f"path{i}": f"(y_{i} + unit_shift) * {w}" for i in range(len(units.periods))}
    parts |= {f"cov{i}": f"{x} * {w}" for i, x in enumerate(units.covariate_cols)}
    out = rows.groupBy(SCENARIO, "treated").agg(sums_struct(parts))
    by_group: dict[int, dict[str, dict[int, float]]] = {}
    for r in out.collect():
        for name in parts:
            by_group.setdefault(r[SCENARIO], {}).setdefault(name, {})[int(r["treated"])] = r["sums"][name]
    totals = {}
    for i, s in enumerate(keys):
        both = {n: sum(g.values()) for n, g in by_group[s].items()}
        uu = np.zeros((k, k))
        for x in range(k):
            for y in range(x, k):
                uu[x, y] = uu[y, x] = both[f"uu{x}_{y}"]
        prof = profiles[s]
        lam, h = prof.weight, prof.post
        totals[s] = EffectTotals(
            sum(stats[s].n), stats[s].n[1], {n: both[n] for n in ("w", "wa", "wb")},
            [both[f"u{x}"] for x in range(k)], uu, [both[f"ub{x}"] for x in range(k)],
            [extra["_p"][i]] + [extra[f"_m{j}"][i] for j in range(len(modifiers))],
            (float(lam.sum()), float(lam @ h), float(lam @ (h * h))),
        )
    return totals, by_group


def _modifier_means(weighted: DataFrame, modifiers: Sequence[str]) -> dict[int, list[float]]:
    means = [F.expr(f"avg(treated * {z})").alias(f"m{j}") for j, z in enumerate(modifiers)]
    rows = weighted.groupBy(SCENARIO).agg(*means).collect()
    return {r[SCENARIO]: [r[f"m{j}"] for j in range(len(modifiers))] for r in rows}


def leave_out_estimates(
    weighted: DataFrame,
    units: UnitTable,
    profiles: Mapping[int, TimeProfile],
    totals: Mapping[int, EffectTotals],
    by_cluster: bool = False,
    modifiers: Sequence[str] = (),
    intercept: bool = True,
) -> DataFrame:
    """Every leave-one-unit-out (or leave-one-cluster-out) estimate, exactly, in one pass.

    Columns: scenario, left_out, tau_0 (and tau_1 with a modifier). NULL where the rest
    has no treated or no control units, or no variation.
    """
    if len(modifiers) > 1:
        raise ValueError("one modifier at a time")
    keys = list(profiles)
    k = 1 + len(modifiers)
    extra = {f"_m{i}": [totals[s].centre[i] for s in keys] for i in range(k)}
    rows = _with_profile(weighted, units, profiles, extra)
    ks = range(k)
    pairs = [(i, j) for i in ks for j in range(i, k)]
    raw = ["treated"] + [f"treated * {z}" for z in modifiers]
    rows = rows.selectExpr("*", *[f"{c} - _m{i} AS _u{i}" for i, c in enumerate(raw)])
    w = "unit_weight"
    own = {"n": "1.0D", "d": "treated", "a": "a", "b": "b",
           "w": w, "wa": f"{w} * a", "wb": f"{w} * b"}
    own |= {f"u{i}": f"_u{i}" for i in ks}
    own |= {f"wu{i}": f"{w} * _u{i}" for i in ks}
    own |= {f"wub{i}": f"{w} * _u{i} * b" for i in ks}
    own |= {f"wuu{i}_{j}": f"{w} * _u{i} * _u{j}" for i, j in pairs}
    if by_cluster:
        sets = rows.groupBy(SCENARIO, F.col("cluster").alias("left_out")).agg(
            sums_struct(own)).selectExpr(SCENARIO, "left_out", *[f"sums.{n} AS o_{n}" for n in own])
    else:
        sets = rows.selectExpr(SCENARIO, "unit AS left_out", *[f"{e} AS o_{n}" for n, e in own.items()])

    whole = {"n": [totals[s].n for s in keys], "d": [totals[s].n_treated for s in keys]}
    for m in ("w", "wa", "wb"):
        whole[m] = [totals[s].moments[m] for s in keys]
    for i in ks:
        whole[f"wu{i}"] = [totals[s].u[i] for s in keys]
        whole[f"wub{i}"] = [totals[s].ub[i] for s in keys]
    for i, j in pairs:
        whole[f"wuu{i}_{j}"] = [float(totals[s].uu[i, j]) for s in keys]
    rest = list(whole)
    for i in range(3):
        whole[f"l{i}"] = [totals[s].l[i] for s in keys]
    table = driver_table(
        sets.sparkSession,
        {SCENARIO: ("int", keys)} | {f"t_{n}": ("double", v) for n, v in whole.items()})

    # r_*: sums over the units that stay; e_*, da, db: how the demeaned values shift
    sums = (
        sets.join(table, SCENARIO)
        .selectExpr(
            SCENARIO, "left_out", "t_l0 AS l0", "t_l1 AS l1", "t_l2 AS l2",
            "o_a", "o_b", *[f"o_u{i}" for i in ks], *[f"t_{n} - o_{n} AS r_{n}" for n in rest])
        .selectExpr(
            "*", "try_divide(o_a, r_n) AS da", "try_divide(o_b, r_n) AS db",
            *[f"try_divide(o_u{i}, r_n) AS e{i}" for i in ks])
        .selectExpr(
            SCENARIO, "left_out", "l0", "l1", "l2", "r_n", "r_d", "r_w", "r_w * l0 AS sw",
            "r_wa + da * r_w AS sa",
            *[f"r_wu{i} + e{i} * r_w AS su{i}" for i in ks],
            *[f"r_wub{i} + db * r_wu{i} + e{i} * r_wb + e{i} * db * r_w AS sub{i}" for i in ks],
            *[f"r_wuu{i}_{j} + e{i} * r_wu{j} + e{j} * r_wu{i} + e{i} * e{j} * r_w AS suu{i}_{j}"
              for i, j in pairs])
    )
    if intercept:
        normal = sums.selectExpr(
            "*", "l2 * suu0_0 * sw AS size",
            *[f"l2 * suu{i}_{j} * sw - l1 * l1 * su{i} * su{j} AS xx{i}_{j}" for i, j in pairs],
            *[f"sub{i} * sw - l1 * su{i} * sa AS xy{i}" for i in ks])
    else:
        normal = sums.selectExpr(
            "*", "l2 * suu0_0 AS size", *[f"l2 * suu{i}_{j} AS xx{i}_{j}" for i, j in pairs],
            *[f"sub{i} AS xy{i}" for i in ks])
    if k == 1:
        taus = ["try_divide(xy0, xx0_0)"]
    else:
        det = "(xx0_0 * xx1_1 - xx0_1 * xx0_1)"
        taus = [f"try_divide(xy0 * xx1_1 - xy1 * xx0_1, {det})",
                f"try_divide(xy1 * xx0_0 - xy0 * xx0_1, {det})"]
    # both groups remain, and the regressors vary (apart from each other) by more than rounding
    defined = "r_d > 0.5 AND r_n - r_d > 0.5 AND xx0_0 > size * 1e-12"
    if k == 2:
        defined += f" AND {det} > xx0_0 * xx1_1 * 1e-10"
    return normal.selectExpr(
        SCENARIO, "left_out", *[f"IF({defined}, {t}, NULL) AS tau_{i}" for i, t in enumerate(taus)])


def jackknife_variance(
    folds: DataFrame, estimates: Mapping[int, Sequence[float]]
) -> dict[int, tuple[list[float | None], int, int]]:
    """Per scenario: variances centred on the estimate, number of folds, undefined folds.

    One undefined fold leaves the variance undefined (None).
    """
    keys = list(estimates)
    k = len(next(iter(estimates.values())))
    table = driver_table(folds.sparkSession, {SCENARIO: ("int", keys)} | {
        f"hat_{i}": ("double", [estimates[s][i] for s in keys]) for i in range(k)})
    rows = folds.join(table, SCENARIO).groupBy(SCENARIO).agg(F.expr(
        "struct(count(*) AS folds, count_if(tau_0 IS NULL) AS undefined, " + ", ".join(
            f"sum((tau_{i} - hat_{i}) * (tau_{i} - hat_{i})) AS ss_{i}" for i in range(k)) + ")"
    ).alias("f")).select(SCENARIO, "f.*").collect()
    return {
        r[SCENARIO]: (
            [None if r["undefined"] else (r["folds"] - 1) / r["folds"] * r[f"ss_{i}"]
             for i in range(k)],
            r["folds"], r["undefined"])
        for r in rows
    }


def effect_statistics(
    tau: float | None, variance: float | None, df: float
) -> tuple[float | None, float | None, float | None, float | None]:
    """t, two-sided p from Student's t, and the interval tau +- 1.96 standard errors."""
    if tau is None or variance is None:
        return None, None, None, None
    se = math.sqrt(variance)
    t = tau / se if se > 0 else math.copysign(math.inf, tau)
    return t, student_t_two_sided(t, df), tau - 1.96 * se, tau + 1.96 * se


def panel_df(units: int, periods: int) -> int:
    """Residual degrees of freedom of the two-way model."""
    return units * periods - (units - 1) - (periods - 1) - 2


def fit_diagnostics(
    units: UnitTable, stats: GroupStats, groups: Mapping[str, Mapping[int, float]]
) -> tuple[float, float, dict[str, float | None], float]:
    """Prediction error of the unit and time weights, weighted covariate gaps, weight norm.

    The gap is relative to the treated mean; where that is 0 there is none (None).
    """
    treated = np.array([groups[f"path{k}"][1] for k in units.pre])
    control = np.array([groups[f"path{k}"][0] for k in units.pre])
    omega = math.sqrt(np.mean((treated - control) ** 2)) / float(np.mean(treated))
    n0 = stats.n[0]
    lam = math.sqrt(groups["gap2"][0] / n0) / (groups["post"][0] / n0)
    gaps = {
        name: (groups[f"cov{k}"][0] - groups[f"cov{k}"][1]) / groups[f"cov{k}"][1] if groups[f"cov{k}"][1] else None
        for k, name in enumerate(units.spec.covariates)
    }
    return omega, lam, gaps, math.sqrt(groups["ww"][0])


def cluster_weights(weighted: DataFrame, top: int = 10) -> DataFrame:
    """Control weight per cluster: the top ranks (ties share a rank) and their total.

    Columns: scenario, cluster, cluster_weight, is_total. The ranking runs over one row
    per cluster, pre-filtered to the leading ranks inside each task.
    """
    from .summary import top_ranks

    sums = weighted.filter("treated = 0").groupBy(SCENARIO, "cluster").agg(
        F.sum("unit_weight").alias("cluster_weight"))
    best = top_ranks(sums, "cluster_weight", top, by=[SCENARIO]).drop("rank")
    return best.groupingSets(
        [[SCENARIO, F.col("cluster"), F.col("cluster_weight")], [F.col(SCENARIO)]],
        SCENARIO, "cluster", "cluster_weight",
    ).agg(
        F.sum("cluster_weight").alias("total"),
        F.grouping("cluster").cast("boolean").alias("is_total"),
    ).select(
        SCENARIO,
        F.when(F.col("is_total"), F.lit("Total")).otherwise(F.col("cluster").cast("string")).alias("cluster"),
        F.coalesce("cluster_weight", "total").alias("cluster_weight"),
        "is_total",
    )


def path_table(
    spark: SparkSession,
    units: UnitTable,
    profiles: Mapping[int, TimeProfile],
    by_group: Mapping[int, Mapping[str, Mapping[int, float]]],
) -> DataFrame:
    """Treated and synthetic control path per period, with the time weight."""
    cells = [(s, k, t) for s in profiles for k, t in enumerate(units.periods)]
    return driver_table(spark, {
        SCENARIO: ("int", [s for s, _, _ in cells]),
        "time": ("int", [t for _, _, t in cells]),
        "treated": ("double", [by_group[s][f"path{k}"][1] for s, k, _ in cells]),
        "control": ("double", [by_group[s][f"path{k}"][0] for s, k, _ in cells]),
        "time_weight": ("double", [profiles[s].weight[k] for s, k, _ in cells]),
    })
