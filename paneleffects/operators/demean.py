"""Two-way demeaning of a long panel and the plain two-way fixed-effects slope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stages import checked_small
from ..spec import PanelSpec


def mask_treatment(treatment: str, time: str, time_pre: int) -> Column:
    """The group flag switched on only after ``time_pre``."""
    return F.when(F.col(time) <= time_pre, F.lit(0.0)).when(
        F.col(time) > time_pre, F.col(treatment).cast("double"))


def twoway_demean(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """Add ``outcome_twfe`` and ``treatment_twfe``: x - unit mean - time mean + mean, unweighted.

    The flag itself is kept as ``treatment_id``; the treatment column becomes the masked
    one. Unit means come from a window over the unit's few periods. Time means hold a
    large share of the rows each, so they are aggregated first (an action) and joined back
    as a broadcast table of one row per period.
    """
    marked = panel.withColumn("treatment_id", F.col(spec.treatment)).withColumn(
        spec.treatment, mask_treatment(spec.treatment, spec.time, spec.time_pre))
    pairs = {"outcome": spec.outcome, "treatment": spec.treatment}
    everywhere = Window.partitionBy(F.lit(1))  # over the table of periods, not of rows
    times = (
        marked.groupBy(F.col(spec.time).alias("_time"))
        .agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(f"_{k}_time") for k, c in pairs.items()])
        .select(
            "_time",
            *[f"_{k}_time" for k in pairs],
            *[(F.sum(F.col(f"_{k}_time") * F.col("_n")).over(everywhere)
               / F.sum("_n").over(everywhere)).alias(f"_{k}_all") for k in pairs],
        )
    )
    within_unit = Window.partitionBy(spec.unit)
    joined = marked.join(checked_small(times), F.col(spec.time).eqNullSafe(F.col("_time")))
    return joined.select(
        *marked.columns,
        *[
            (F.col(c) - F.avg(c).over(within_unit) - F.col(f"_{k}_time") + F.col(f"_{k}_all")).alias(
                f"{k}_twfe")
            for k, c in pairs.items()
        ],
    )


def weighted_slope(
    df: DataFrame, y: str, x: str, weight: str | None = None, by: tuple[str, ...] = ()
) -> DataFrame:
    """Slope of y on x with an intercept, by weighted least squares, from five sums."""
    w = F.col(weight) if weight else F.lit(1.0)
    sums = df.groupBy(*by).agg(
        F.sum(w).alias("sw"),
        F.sum(w * F.col(x)).alias("sx"),
        F.sum(w * F.col(y)).alias("sy"),
        F.sum(w * F.col(x) * F.col(y)).alias("sxy"),
        F.sum(w * F.col(x) * F.col(x)).alias("sxx"),
        F.count(F.lit(1)).alias("observations"),
    )
    slope = F.try_divide(
        F.col("sxy") * F.col("sw") - F.col("sx") * F.col("sy"),
        F.col("sxx") * F.col("sw") - F.col("sx") * F.col("sx"),
    )
    return sums.select(*by, slope.alias("tau"), "observations")


def twoway_effect(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """Unweighted two-way fixed-effects estimate: one row (tau, observations)."""
    return weighted_slope(twoway_demean(panel, spec), "outcome_twfe", "treatment_twfe")
