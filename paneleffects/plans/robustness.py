"""Robustness runs: earlier start, left-out cluster pairs, trimming, many models."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import propensity
from ..operators.reshape import side_by_side, stack_rows, union_keys
from ..operators.unit_table import UnitTable
from ..spec import PanelSpec
from .estimate import SyntheticDiD, fit


def backdated(
    units: UnitTable, last: int, time_pre: int, cluster_errors: bool = False
) -> SyntheticDiD:
    """Placebo: drop the periods after ``last`` and let treatment start after ``time_pre``.

    Works on an existing unit table: the later periods are columns that are not read.
    """
    return fit(units.until(last, time_pre), cluster_errors)


def leading_clusters(model: SyntheticDiD, top: int = 10) -> list:
    """The clusters in the top weight ranks, ties included, that have any weight.

    Clusters without weight all tie; leaving them out would change nothing.
    """
    rows = model.clusters(top).filter("NOT is_total AND cluster_weight > 0").orderBy(
        F.col("cluster_weight").desc(), "cluster").collect()
    return [r["cluster"] for r in rows]


def leave_groups_out(
    units: UnitTable, clusters: Sequence[object], size: int = 2,
    uniform: bool = False, jackknife: bool = True,
) -> tuple[list[tuple], SyntheticDiD]:
    """Full re-estimates without every ``size``-subset of ``clusters``, all in shared passes."""
    groups = list(itertools.combinations(clusters, size))
    return groups, fit(units.with_scenarios(groups), jackknife=jackknife, uniform=uniform)


def leave_two_out(units: UnitTable, top: int = 10) -> tuple[list[tuple], SyntheticDiD, DataFrame]:
    """Drop all pairs of this outcome's top clusters; re-estimate; summarise every report line."""
    pairs, model = leave_groups_out(units, leading_clusters(fit(units, jackknife=False), top))
    return pairs, model, summarise_scenarios(model)


def summarise_scenarios(model: SyntheticDiD) -> DataFrame:
    """Mean, min, quartiles and max of each report line over the scenarios."""
    lines = model.table()  # scenarios x lines values: the exact percentile is safe here
    return lines.groupBy("name").agg(
        F.bround(F.avg("value"), 4).alias("mean"), F.min("value").alias("min"),
        *[F.percentile("value", q).alias(n) for n, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))],
        F.max("value").alias("max"), F.count("value").alias("n"))


def trimmed_units(
    panel: DataFrame, spec: PanelSpec, period: int, candidates: Sequence[str],
    baseline: Sequence[str] = (), low: float = 0.1, high: float = 0.9,
) -> tuple[propensity.Logit, DataFrame, DataFrame]:
    """Fit the propensity model on one period, keep units with low <= score <= high.

    Returns the model, (unit, score) of the kept units and their full panel rows.
    """
    rows = panel.filter(F.col(spec.time) == period)
    model = propensity.estimate_propensity(rows, spec.treatment, candidates, baseline)
    kept = propensity.trim(model.predict(rows), "pscore", low, high).select(spec.unit, "pscore")
    return model, kept, panel.join(kept, spec.unit)


def trimmed_table(
    units: UnitTable, candidates: Sequence[str], baseline: Sequence[str] = (), low: float = 0.1, high: float = 0.9,
    stop_rule: str = "first",
) -> tuple[propensity.Logit, UnitTable]:
    """``trimmed_units`` on a unit table: the model, and the units with low <= score <= high.

    Candidates are the spec's covariates and modifiers, and ``<outcome>_<period>`` for past
    outcomes. A unit's score is a function of its own row, so nothing is joined: the staged
    rows are read for the fit, and filtered wherever they are read again.
    """
    spec = units.spec
    known = {f"{spec.outcome}_{t}": y for t, y in zip(units.periods, units.outcome_cols, strict=True)}
    known |= dict(zip(spec.covariates, units.covariate_cols, strict=True))
    known |= {m: f"z_{k}" for k, m in enumerate(spec.modifiers)}
    wanted = list(dict.fromkeys([*baseline, *candidates]))
    lacking = [c for c in wanted if c not in known]
    if lacking:
        raise ValueError(f"{', '.join(lacking)}: not a covariate, a modifier or a past outcome of the unit table")
    rows = units.data.select("treated", *[F.col(known[c]).alias(c) for c in wanted])
    model = propensity.estimate_propensity(rows, "treated", candidates, baseline, stop_rule=stop_rule)
    named = model.renamed(known)
    kept = propensity.trim(named.predict(units.data, "_pscore"), "_pscore", low, high)
    return model, replace(units, data=kept.drop("_pscore"))


def results_side_by_side(models: Sequence[SyntheticDiD]) -> DataFrame:
    """One row per report line, one column per model."""
    lines = stack_rows(*[m.table() for m in models])
    return side_by_side(lines, "name", "model", "label", [m.units.spec.name for m in models])


def leading_cluster_union(models: Sequence[SyntheticDiD], top: int = 10) -> DataFrame:
    """Clusters in the top weight ranks of any model."""
    return union_keys(*[
        m.clusters(top).filter("NOT is_total AND cluster_weight > 0").select("cluster") for m in models])
