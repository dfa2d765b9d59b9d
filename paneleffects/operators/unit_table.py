"""Unit table: one row per unit, one column per period.

Every estimator below works on this shape. The long panel is shuffled once, on the
unit; afterwards each step is a map over unit rows followed by an aggregate of a few
numbers. Units stay rows, so their number is not limited by the width of a table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import all_finite, any_of
from ..sources.stages import stage_observed
from ..spec import PanelSpec

SCENARIO = "scenario"
#: Why ``incomplete='drop'`` leaves out a unit.
CAUSES = ("rows per unit and cluster", "missing outcomes", "missing covariates")
#: Which of the clusters that some scenario leaves out a unit belongs to; 0 for none.
LEFT = "left_class"


class PanelError(ValueError):
    """The panel breaks the one-row-per-unit-and-period contract or misses values."""


def mean_of(cols: Sequence[str]) -> str:
    return f"(({' + '.join(cols)}) / {len(cols)}.0D)"


@dataclass(frozen=True)
class UnitTable:
    """Columns: scenario, unit, treated, cluster, y_0.. (outcomes), x_0.. (covariates), z_0.. (modifiers).

    ``data`` has a row per unit. With ``groups``, scenario s leaves out the clusters in
    ``groups[s]``; ``rows`` then has a row per unit and scenario that keeps it. ``dropped`` counts
    the units (per cluster, where it moves) that ``incomplete='drop'`` left out, by cause; a
    unit can have several.
    """

    data: DataFrame
    spec: PanelSpec
    periods: tuple[int, ...]
    groups: tuple[tuple, ...] = ()
    dropped: Mapping[str, int] = field(default_factory=dict)

    @property
    def outcome_cols(self) -> list[str]:
        return [f"y_{k}" for k in range(len(self.periods))]

    @property
    def covariate_cols(self) -> list[str]:
        return [f"x_{k}" for k in range(len(self.spec.covariates))]

    @property
    def pre(self) -> list[int]:
        return [k for k, t in enumerate(self.periods) if t <= self.spec.time_pre]

    @property
    def post(self) -> list[int]:
        return [k for k, t in enumerate(self.periods) if t > self.spec.time_pre]

    @property
    def post_mean(self) -> str:
        """SQL expression: mean outcome of the unit after treatment starts."""
        return mean_of([f"y_{k}" for k in self.post])

    @property
    def mean(self) -> str:
        return mean_of(self.outcome_cols)

    def until(self, last: int, time_pre: int) -> UnitTable:
        """The same units with periods after ``last`` dropped and a new treatment start."""
        kept = tuple(t for t in self.periods if t <= last)
        drop = [f"y_{k}" for k in range(len(kept), len(self.periods))]
        return UnitTable(self.data.drop(*drop), self.spec.with_(time_pre=time_pre), kept, self.groups, self.dropped)

    def keep_units(self, keys: DataFrame, column: str) -> UnitTable:
        """Only the units listed in ``keys[column]``."""
        wanted = keys.select(F.col(column).alias("unit")).distinct()
        return replace(self, data=self.data.join(wanted, "unit", "left_semi"))

    @property
    def left_out(self) -> list:
        """The clusters that some scenario leaves out; the k-th has class k + 1."""
        return sorted({c for group in self.groups for c in group}, key=str)

    def kept(self) -> list[list[bool]]:
        """For each class of units, whether each scenario keeps it."""
        return [[True] * len(self.groups), *[[c not in group for group in self.groups] for c in self.left_out]]

    @property
    def rows(self) -> DataFrame:
        """Unit rows per scenario, repeated inside the scan; the stored table does not grow."""
        if not self.groups:
            return self.data
        own = F.array(*[
            F.array(*[F.lit(s) for s, stays in enumerate(line) if stays]).cast("array<int>") for line in self.kept()])
        rest = [c for c in self.data.columns if c not in (SCENARIO, LEFT)]
        return self.data.select(F.explode(F.get(own, F.col(LEFT))).alias(SCENARIO), *rest)

    def with_scenarios(self, dropped: Sequence[Sequence[object]]) -> UnitTable:
        """Scenario s keeps the units outside the clusters in ``dropped[s]``.

        Sums that are the same function of a unit in every scenario are taken once per left-out
        cluster and added up for the scenarios that keep it; see ``weights``.
        """
        out = replace(self, groups=tuple(tuple(g) for g in dropped))
        mine: Column = F.lit(0)
        for k, cluster in reversed(list(enumerate(out.left_out))):
            mine = F.when(F.col("cluster").eqNullSafe(F.lit(cluster)), F.lit(k + 1)).otherwise(mine)
        return replace(out, data=self.data.withColumn(LEFT, mine))


def distinct_periods(panel: DataFrame, time: str) -> list[int]:
    """The periods present, in order. Bounded by the number of periods, not of rows."""
    rows = panel.select(F.col(time).cast("int").alias("t")).distinct().orderBy("t").collect()
    periods = [r["t"] for r in rows]
    if not periods or periods[0] is None:
        raise PanelError("the time column is empty or has NULLs")
    return periods


def _steady(c: str) -> Column:
    """The value of a column that must not change within a unit, and whether it does."""
    return F.struct(
        F.max(c).alias("value"), (~F.min(c).eqNullSafe(F.max(c))).alias("moves")
    ).alias(c)


def unit_tables(
    panel: DataFrame,
    specs: Sequence[PanelSpec],
    periods: Sequence[int] | None = None,
    incomplete: str = "error",
) -> list[UnitTable]:
    """Unit tables of several models over one panel, from a single shuffle.

    Name the ``periods`` where they are known: otherwise a pass over the panel finds them.
    ``incomplete='drop'`` leaves out, per model, the units without a usable row in every
    period: the complete-panel filter, in the same shuffle.

    All models share the unit, time, treatment and cluster columns. The result is
    staged once; each model reads only its own columns. Raises ``PanelError`` for
    duplicate or missing (unit, time) rows, missing values, a treatment flag other
    than 0/1, or a treatment, cluster or covariate that moves within a unit. Rows of periods
    not named are not read. A unit that is left out only because its cluster moves is an
    error with ``incomplete='drop'`` too.
    """
    first = specs[0]
    shared = ("unit", "time", "treatment", "cluster")
    if any(getattr(s, role) != getattr(first, role) for s in specs for role in shared):
        raise ValueError("models in one call must share unit, time, treatment and cluster")
    periods = tuple(periods or distinct_periods(panel, first.time))

    outcomes = list(dict.fromkeys(s.outcome for s in specs))
    covariates = list(dict.fromkeys(c for s in specs for c in (*s.covariates, *s.modifiers)))
    source = panel.select(
        F.col(first.unit).alias("unit"),
        F.col(first.time).cast("int").alias("time"),
        F.col(first.treatment).cast("double").alias("treated"),
        (F.col(first.cluster) if first.cluster else F.lit(None).cast("string")).alias("cluster"),
        *[F.col(c).cast("double").alias(f"out_{j}") for j, c in enumerate(outcomes)],
        *[F.col(c).cast("double").alias(f"cov_{j}") for j, c in enumerate(covariates)],
    )
    source = source.filter(F.col("time").isin(list(periods)) | F.col("time").isNull())
    wide = (
        # text columns are keys, not aggregates: the aggregate stays a hash aggregate
        source.groupBy("unit", "cluster").agg(
            F.count(F.lit(1)).alias("n_rows"),
            _steady("treated"),
            *[_steady(f"cov_{j}") for j in range(len(covariates))],
            F.expr("struct(" + ", ".join(
                f"max(IF(time = {t}, out_{j}, NULL)) AS y_{j}_{k}"
                for j in range(len(outcomes)) for k, t in enumerate(periods)) + ")").alias("y"),
        ).select(F.lit(0).alias(SCENARIO), "*", "y.*").drop("y")
    )

    if incomplete not in ("error", "drop"):
        raise ValueError("incomplete is 'error' or 'drop'")
    parts, faults = [], []
    for i, spec in enumerate(specs):
        j = outcomes.index(spec.outcome)
        xs = [covariates.index(c) for c in (*spec.covariates, *spec.modifiers)]
        named = [f"x_{k}" for k in range(len(spec.covariates))] + [f"z_{k}" for k in range(len(spec.modifiers))]
        ys = [f"y_{j}_{k}" for k in range(len(periods))]
        usable = (F.col("n_rows") == len(periods)) & all_finite(
            [*ys, *[f"cov_{x}.value" for x in xs]])
        kept = usable if incomplete == "drop" else F.lit(True)
        checks = {
            "rows per unit and cluster": F.col("n_rows") != len(periods),
            "missing outcomes": ~all_finite(ys),
            "missing covariates": ~all_finite([f"cov_{x}.value" for x in xs]),
            "covariates that move within a unit": any_of(F.col(f"cov_{x}.moves") for x in xs),
            "treatment flags that move or are not 0/1": F.col("treated.moves") | ~F.coalesce(
                F.col("treated.value").isin(0.0, 1.0), F.lit(False)),
            "NULL units": F.col("unit").isNull(),
        }
        faults += [F.count_if(kept & bad).alias(f"{i}|{name}") for name, bad in checks.items()]
        if incomplete == "drop":
            faults += [F.count_if(~F.coalesce(kept, F.lit(False)) & checks[name]).alias(f"{i}|drop|{name}") for name in CAUSES]
        parts.append((kept, [
            SCENARIO,  # stored, so that parameter tables join on it by hash
            "unit",
            F.col("treated.value").alias("treated"),
            "cluster",
            *[F.col(y).alias(f"y_{k}") for k, y in enumerate(ys)],
            *[F.col(f"cov_{x}.value").alias(c) for c, x in zip(named, xs, strict=True)],
        ]))
    # the tasks that write the table count its faults
    wide, found = stage_observed(wide, faults, "units")
    lost = [{c: found[f"{i}|drop|{c}"] for c in CAUSES if found.get(f"{i}|drop|{c}")} for i in range(len(specs))]
    tables = [UnitTable(wide.filter(kept).select(*columns), spec, periods, dropped=gone)
              for (kept, columns), spec, gone in zip(parts, specs, lost, strict=True)]
    broken = {k: n for k, n in found.items() if n and "|drop|" not in k}
    if first.cluster and incomplete == "drop":
        # only units that miss rows under one cluster are looked at again
        apart = wide.filter(F.col("n_rows") < len(periods)).groupBy("unit").agg(
            F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("clusters"))
        moving = apart.filter((F.col("clusters") > 1) & (F.col("n_rows") == len(periods))).count()
        if moving:
            broken["0|clusters that move within a unit"] = moving
    if broken:
        lines = [f"{specs[int(k.split('|')[0])].name}: {n} units with bad {k.split('|')[1]}"
                 for k, n in broken.items()]
        raise PanelError("; ".join(lines))
    return tables


def unit_table(
    panel: DataFrame, spec: PanelSpec, periods: Sequence[int] | None = None,
    incomplete: str = "error",
) -> UnitTable:
    return unit_tables(panel, [spec], periods, incomplete)[0]
