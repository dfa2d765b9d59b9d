"""Synthetic difference-in-differences from a long panel to the report table.

Passes over the unit rows per call, for any number of scenarios: group statistics,
control moments, one per Newton step (usually one to five), effect totals, jackknife.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from ..functions.distributions import plain_number, stars
from ..operators import effects, weights
from ..operators.lasso import rigorous_lasso
from ..operators.prep import post_means
from ..operators.unit_table import SCENARIO, UnitTable, unit_tables
from ..sources.stages import SharedStages, Stages, current_owner, driver_table, owned_by
from ..spec import PanelSpec


@dataclass(frozen=True)
class SyntheticDiD:
    """A fitted model; one ``Estimate`` per scenario (a single one, 0, by default)."""

    units: UnitTable
    estimates: Mapping[int, effects.Estimate]
    weighted: DataFrame  # unit rows with unit_weight and unit_shift
    profiles: Mapping[int, effects.TimeProfile]
    paths: DataFrame     # scenario, time, treated, control, time_weight
    unit_solution: Mapping[int, weights.UnitWeightSolution] | None
    time_solution: Mapping[int, weights.TimeWeightSolution]
    stages: Stages = field(default_factory=Stages)

    def close(self) -> None:
        """Free the tables staged for this model; its unit rows cannot be read afterwards.

        Estimates, paths and the report stay. Models of one ``many_models`` call share their
        unit rows, which go with the last of them.
        """
        self.stages.close()

    def __enter__(self) -> SyntheticDiD:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    @property
    def estimate(self) -> effects.Estimate:
        return self.estimates[0]

    def unit_weights(self) -> DataFrame:
        return self.weighted.select(SCENARIO, "unit", "treated", "unit_weight", "unit_shift")

    def time_weights(self) -> DataFrame:
        return time_weight_table(self.weighted.sparkSession, self.units, self.profiles)

    def clusters(self, top: int = 10) -> DataFrame:
        return effects.cluster_weights(self.weighted, top)

    def regression_rows(self) -> DataFrame:
        """The demeaned long rows with their weights, one per scenario, unit and period."""
        units, first = self.units, next(iter(self.profiles.values()))
        t = len(units.periods)
        keys = list(self.profiles)
        columns = {SCENARIO: ("int", keys)}
        for k in range(t):
            columns[f"_c{k}"] = ("double", [self.profiles[s].centre[k] for s in keys])
            columns[f"_l{k}"] = ("double", [self.profiles[s].weight[k] for s in keys])
        columns["_p"] = ("double", [self.profiles[s].share for s in keys])
        rows = self.weighted.join(driver_table(self.weighted.sparkSession, columns), SCENARIO)
        pieces = ", ".join(
            f"struct({time} AS time, y_{k} AS outcome, y_{k} - _c{k} - {units.mean} AS outcome_twfe, "
            f"(treated - _p) * {float(first.post[k])!r}D AS treatment_twfe, "
            f"unit_weight * _l{k} AS reg_weight)"
            for k, time in enumerate(units.periods))
        return rows.selectExpr(
            SCENARIO, "unit", "treated", "cluster", *units.covariate_cols, f"inline(array({pieces}))")

    def table(self, names: Mapping[int, str] | None = None) -> DataFrame:
        """Long report table: model, position, name, value, label."""
        names = names or {s: self.units.spec.name if len(self.estimates) == 1 else
                          f"{self.units.spec.name}_{s}" for s in self.estimates}
        lines = [(names[s], *line) for s in self.estimates
                 for line in report_lines(self.units.spec, self.estimates[s])]
        return driver_table(self.weighted.sparkSession, {
            "model": ("string", [x[0] for x in lines]),
            "position": ("int", [x[1] for x in lines]),
            "name": ("string", [x[2] for x in lines]),
            "value": ("double", [x[3] for x in lines]),
            "label": ("string", [x[4] for x in lines]),
        })


def time_weight_table(
    spark: SparkSession, units: UnitTable, profiles: Mapping[int, effects.TimeProfile]
) -> DataFrame:
    """Weight and level shift of every period."""
    cells = [(s, k, t) for s in profiles for k, t in enumerate(units.periods)]
    pre = set(units.pre)
    return driver_table(spark, {
        SCENARIO: ("int", [s for s, _, _ in cells]),
        "time": ("int", [t for _, _, t in cells]),
        "time_weight": ("double", [profiles[s].weight[k] for s, k, _ in cells]),
        "time_shift": ("double", [profiles[s].shift if k in pre else 0.0 for s, k, _ in cells]),
    })


def report_lines(spec: PanelSpec, e: effects.Estimate) -> list[tuple]:
    """(position, name, value, label) of one model, in report order."""
    text = plain_number
    lines = [
        (spec.treatment, e.tau, None if e.tau is None else text(e.tau, 2) + stars(e.p_value)),
        ("t", e.t_statistic, None if e.t_statistic is None else f"({text(e.t_statistic, 2)})"),
        ("omega", e.omega_nrmse, text(e.omega_nrmse, 4)),
        ("lambda", e.lambda_nrmse, text(e.lambda_nrmse, 4)),
        *[(n, v, None if v is None else text(v, 4)) for n, v in e.covariate_gaps.items()],
        ("Weight Norm", e.weight_norm, text(e.weight_norm, 4)),
        ("Units", float(e.units), str(e.units)),
        ("Observations", float(e.observations), str(e.observations)),
    ]
    return [(i, *line) for i, line in enumerate(lines)]


def fit(
    units: UnitTable,
    cluster_errors: bool = False,
    jackknife: bool = True,
    uniform: bool = False,
) -> SyntheticDiD:
    """Estimate on a unit table, all scenarios together.

    ``uniform`` uses equal weights instead of fitted ones: plain two-way fixed effects.
    Cluster errors need a cluster column.
    """
    if cluster_errors and jackknife and not units.spec.cluster:
        raise ValueError("cluster errors need the spec's cluster column")
    stats = weights.group_stats(units)
    if uniform:
        solution = None
        time_solution = effects.uniform_time_weights(units, stats)
    else:
        centred = weights.control_moments(units, stats)
        solution = weights.solve_unit_weights(units, stats, centred)
        time_solution = weights.solve_time_weights(units, stats, centred)
    profiles = effects.time_profiles(units, stats, time_solution)
    if uniform:
        for prof in profiles.values():
            prof.weight[:] = 1.0
    weighted = effects.weighted_units(units, stats, solution)
    totals, groups = effects.effect_totals(weighted, units, stats, profiles)
    taus = {s: effects._solve(t, intercept=True) for s, t in totals.items()}
    variances: dict = {s: ([None], 0, 0) for s in totals}
    known = {s: [float(v[0])] for s, v in taus.items() if v is not None}
    if jackknife and known:
        folds = effects.leave_out_estimates(
            weighted, units, {s: profiles[s] for s in known}, {s: totals[s] for s in known},
            by_cluster=cluster_errors)
        variances |= effects.jackknife_variance(folds, known)
    found = {}
    for s, st in stats.items():
        n = int(sum(st.n))
        tau = known.get(s, [None])[0]
        variance, n_folds, undefined = variances[s][0][0], variances[s][1], variances[s][2]
        df = n_folds - 1 if cluster_errors else effects.panel_df(n, len(units.periods))
        t, p, low, high = effects.effect_statistics(tau, variance, df)
        omega, lam, gaps, norm = effects.fit_diagnostics(units, st, groups[s])
        found[s] = effects.Estimate(
            s, tau, variance, t, df, p, low, high, undefined, omega, lam, gaps, norm,
            n, n * len(units.periods), solution[s].zeta if solution else None)
    paths = effects.path_table(weighted.sparkSession, units, profiles, groups)
    return SyntheticDiD(units, found, weighted, profiles, paths, solution, time_solution)


def synthetic_did(
    panel: DataFrame, spec: PanelSpec, cluster_errors: bool = False, jackknife: bool = True
) -> SyntheticDiD:
    """One model from a long panel."""
    return many_models(panel, [spec], cluster_errors, jackknife)[0]


def many_models(
    panel: DataFrame,
    specs: Sequence[PanelSpec],
    cluster_errors: bool = False,
    jackknife: bool = True,
    periods: Sequence[int] | None = None,
    incomplete: str = "error",
) -> list[SyntheticDiD]:
    """Several outcomes or covariate sets over one panel, from one shuffle of the panel."""
    outer = current_owner()
    with owned_by(SharedStages(len(specs))) as shared:
        tables = unit_tables(panel, specs, periods, incomplete)

    def one(units: UnitTable) -> SyntheticDiD:
        with owned_by(Stages()) as own:
            model = fit(units, cluster_errors, jackknife)
        own.then(shared)
        if outer is not None:  # threads do not see it
            outer.then(own)
        return replace(model, stages=own)

    # the models are independent and their passes short: let their jobs overlap
    with ThreadPoolExecutor(max_workers=4) as pool:
        return list(pool.map(one, tables))


@dataclass(frozen=True)
class Interaction:
    """Effect and its interaction with a fixed unit characteristic."""

    tau: float
    interaction: float
    tau_variance: float | None
    interaction_variance: float | None
    tau_t: float | None
    interaction_t: float | None
    tau_p: float | None
    interaction_p: float | None
    undefined_folds: int

    def table(self, df: DataFrame, name: str) -> DataFrame:
        return driver_table(df.sparkSession, {
            "model": ("string", [name] * 4),
            "position": ("int", [0, 1, 2, 3]),
            "name": ("string", ["tau", "tau t", "interaction", "interaction t"]),
            "value": ("double", [self.tau, self.tau_t, self.interaction, self.interaction_t]),
            "label": ("string", [
                plain_number(self.tau, 2) + stars(self.tau_p), plain_number(self.tau_t, 2),
                plain_number(self.interaction, 2) + stars(self.interaction_p),
                plain_number(self.interaction_t, 2)]),
        })


def lasso_estimates(
    panel: DataFrame,
    specs: Sequence[PanelSpec],
    features: Sequence[str],
    allowed: Sequence[str],
    periods: Sequence[int],
    lags: Sequence[int] = (),
    gamma: float | None = None,
    max_iter: int = 15,
    cluster_errors: bool = False,
    jackknife: bool = True,
    unsettled: str = "warn",
) -> list[SyntheticDiD]:
    """Estimates whose covariates a lasso chooses, each outcome for itself.

    Per outcome: post-period means on ``features`` and the outcome at ``lags``; the chosen
    among ``allowed`` are the covariates, after those a spec has itself, which always stay;
    the units complete on all of them are the sample.
    The panel is read once per lasso and once for all estimates: stage it if it is costly.
    """
    chosen = []
    for spec in specs:
        means = post_means(
            panel, [spec.outcome], spec.unit, spec.time, spec.time_pre + 1, max(periods),
            {spec.outcome: list(lags)}, features)
        found = rigorous_lasso(
            means, f"{spec.outcome}_post", [*features, *[f"{spec.outcome}_{t}" for t in lags]],
            gamma=gamma, max_iter=max_iter, unsettled=unsettled)
        chosen.append(spec.with_(covariates=(*spec.covariates, *found.choose(allowed))))
    return many_models(panel, chosen, cluster_errors, jackknife, periods, incomplete="drop")


def interaction_effect(
    model: SyntheticDiD, modifier: str, intercept: bool = False
) -> Interaction:
    """Two-way within regression of the outcome on D and D*z with the model's weights.

    ``modifier`` is one of the model's covariates or modifiers. The data are demeaned without weights
    and fitted with them, without an intercept, as in a weighted within regression.
    Errors: leave-one-unit-out jackknife for both coefficients.
    """
    units = model.units
    spec = units.spec
    if modifier in spec.covariates:
        z = f"x_{spec.covariates.index(modifier)}"
    elif modifier in spec.modifiers:
        z = f"z_{spec.modifiers.index(modifier)}"
    else:
        raise ValueError(f"{modifier} is neither a covariate nor a modifier of the model")
    stats = weights.group_stats(units)
    totals, _ = effects.effect_totals(model.weighted, units, stats, model.profiles, [z])
    hats = {s: effects._solve(t, intercept) for s, t in totals.items()}
    if hats[0] is None:
        raise weights.WeightError("the interaction is collinear with the treatment")
    folds = effects.leave_out_estimates(
        model.weighted, units, model.profiles, totals, False, [z], intercept)
    var, _, undefined = effects.jackknife_variance(
        folds, {s: [float(x) for x in h] for s, h in hats.items()})[0]
    df = effects.panel_df(int(sum(stats[0].n)), len(units.periods))
    tau, inter = (float(x) for x in hats[0])
    tau_t, tau_p, *_ = effects.effect_statistics(tau, var[0], df)
    int_t, int_p, *_ = effects.effect_statistics(inter, var[1], df)
    return Interaction(tau, inter, var[0], var[1], tau_t, int_t, tau_p, int_p, undefined)
