"""Panel preparation: cleaning, prices, shares, base periods, changes, flows.

Group values are attached by aggregating first and joining the result back
(``attach``): partial aggregation shrinks a group of any size before the shuffle, and the
join is a broadcast when the aggregate is small, else a shuffle join whose large keys
adaptive execution can split. Windows hold a unit's own periods only: rows without a unit,
and units known to have many rows, are kept out of them (``over_units``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import INFINITY, all_finite, any_of, ratio, row_sum
from ..sources.stages import checked_small, stage_observed

# ------------------------------------------------------------------ rows and missing values


def finite_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows where any of ``cols`` is NULL, NaN or infinite."""
    return df.filter(all_finite(cols)) if cols else df


def infinite_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """+-Inf becomes NULL in the given (default: all floating-point) columns."""
    floating = [c for c, t in df.dtypes if t in ("double", "float")]
    wanted = set(floating if cols is None else cols)
    return df.select(*[
        F.when(F.abs(F.col(c)) == INFINITY, None).otherwise(F.col(c)).alias(c) if c in wanted else F.col(c)
        for c in df.columns
    ])


def require_complete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Raise if any value in ``cols`` is missing; one aggregate over the needed columns."""
    _refuse_missing(df.agg(*_missing_counts(cols)).first().asDict())
    return df


def stage_complete(df: DataFrame, cols: Sequence[str], label: str = "complete") -> DataFrame:
    """``df`` staged; raises if any value in ``cols`` is missing.

    The missing values are counted by the tasks that write, so the guard costs no scan.
    """
    staged, counts = stage_counted(df, cols, label)
    _refuse_missing(counts)
    return staged


def stage_counted(df: DataFrame, cols: Sequence[str], label: str = "counted") -> tuple[DataFrame, dict[str, int]]:
    """``df`` staged, and the missing values per column, counted by the tasks that write."""
    return stage_observed(df, _missing_counts(cols), label)


def _missing_counts(cols: Sequence[str]) -> list[Column]:
    return [F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in cols]


def _refuse_missing(counts: Mapping[str, int]) -> None:
    bad = {c: n for c, n in counts.items() if n}
    if bad:
        raise ValueError(f"the input data contains missing observations: {bad}")


def attach(
    df: DataFrame, keys: Sequence[str], values: Mapping[str, Column], few_groups: bool = False,
    heavy: Sequence[object] = (),
) -> DataFrame:
    """Add group aggregates to every row of the group.

    ``few_groups`` is for coarse keys (areas, periods, treatment groups): the aggregate is
    computed first and, if small, joined as a broadcast. Otherwise the keys are taken to be
    unit keys, whose few rows meet in a window; see ``over_units`` for ``heavy``. NULL keys
    form a group in both.
    """
    if not few_groups:
        return over_units(df, keys, values, heavy)
    names = [f"_key_{i}" for i in range(len(keys))]
    groups = df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).agg(
        *[c.alias(n) for n, c in values.items()])
    pairs = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
    kept = [c for c in df.columns if c not in values]
    return df.select(*kept).join(checked_small(groups), pairs).select(*kept, *values)


#: Parts into which the rows of a key that is carried by broadcast are dealt.
SPREAD = 256


def over_units(
    df: DataFrame, keys: Sequence[str], values: Mapping[str, Column], heavy: Sequence[object] = ()
) -> DataFrame:
    """Aggregates of the rows with equal ``keys``, on each of these rows, in one shuffle.

    The few rows of a unit meet in a window. Rows that have a NULL key, or whose first key is
    listed in ``heavy``, may be many: they are dealt over the tasks, and their aggregates,
    partially aggregated and one row per such key, come by broadcast.
    """
    first = F.col(keys[0])
    apart = any_of([F.col(k).isNull() for k in keys] + ([first.isin(list(heavy))] if heavy else []))
    kept = [c for c in df.columns if c not in values]
    if not heavy and not any(df.schema[k].nullable for k in keys):
        window = Window.partitionBy(*keys)
        return df.select(*kept, *[v.over(window).alias(n) for n, v in values.items()])
    part = F.when(apart, F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD))).otherwise(F.lit(-1))
    window = Window.partitionBy(*keys, "_part")
    dealt = df.withColumn("_part", part)
    near = dealt.select(*kept, "_part", *[v.over(window).alias(f"_own_{n}") for n, v in values.items()])
    names = [f"_key_{i}" for i in range(len(keys))]
    far = df.filter(apart).groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).agg(
        *[v.alias(f"_far_{n}") for n, v in values.items()])
    pairs = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
    both = near.join(checked_small(far), pairs, "left")
    return both.select(*kept, *[
        F.when(F.col("_part") < 0, F.col(f"_own_{n}")).otherwise(F.col(f"_far_{n}")).alias(n) for n in values])


def complete_units(
    df: DataFrame, unit: str, periods: int, finite: Sequence[str] = ()
) -> DataFrame:
    """Rows with usable ``finite`` columns, of units that keep all ``periods`` rows.

    One shuffle on the unit: a unit has about one row per period, and its rows are counted
    where they meet. Rows without a unit are left out.
    """
    usable = finite_rows(df, finite).filter(F.col(unit).isNotNull())
    rows = F.count(F.lit(1)).over(Window.partitionBy(unit))
    return usable.withColumn("_rows", rows).filter(F.col("_rows") == periods).select(*df.columns)


# ------------------------------------------------------------------ prices, shares, densities


def deflate(
    df: DataFrame, cols: Sequence[str], index: DataFrame, keys: Sequence[str],
    ratio_col: str = "ratio",
) -> DataFrame:
    """Multiply ``cols`` by the price ratio of the row's keys; no ratio gives NULL."""
    priced = df.join(index.select(*keys, F.col(ratio_col).alias("_ratio")), list(keys), "left")
    return priced.withColumns({c: F.col(c) * F.col("_ratio") for c in cols}).select(*df.columns)


def shares(
    df: DataFrame, cols: Sequence[str], total: str, prefix: str = "p", drop: bool = False
) -> DataFrame:
    """``<prefix>_<col>`` = col / total, NULL for a zero total. ``drop`` removes the inputs.

    With prefix 'd' and an area as the total these are densities.
    """
    out = df.withColumns({f"{prefix}_{c}": ratio(c, total) for c in cols})
    return out.drop(*cols) if drop else out


def sum_by_period(
    time: str, terms: Mapping[int, Sequence[str]]
) -> Column:
    """A sum whose terms depend on the period; NULL in periods not listed."""
    chain = None
    for period, cols in terms.items():
        here = F.col(time) == period
        chain = F.when(here, row_sum(cols)) if chain is None else chain.when(here, row_sum(cols))
    return chain


def area_totals(df: DataFrame, size: str, area: str, time: str, name: str) -> DataFrame:
    """Total ``size`` of the row's area in the row's period."""
    return attach(df, [area, time], {name: F.sum(size)}, few_groups=True)


# ------------------------------------------------------------------ base periods and changes


def spread_periods(
    df: DataFrame, cols: Sequence[str], periods: Sequence[int], unit: str, time: str,
    heavy: Sequence[object] = (),
) -> DataFrame:
    """``<col>_<period>``: the unit's value in that period, on all of the unit's rows.

    One shuffle on the unit, whose few rows meet in a window; NULL units form a group, which
    like the units in ``heavy`` is not brought together (``over_units``).
    """
    return over_units(
        df, [unit],
        {f"{c}_{t}": F.max(F.when(F.col(time) == t, F.col(c))) for c in cols for t in periods}, heavy)


def pct_changes(
    df: DataFrame, cols: Sequence[str], unit: str, time: str, prefix: str = "pc"
) -> DataFrame:
    """``pc_<col>``: change since the unit's previous period, relative to it."""
    window = Window.partitionBy(unit).orderBy(time)
    before = {c: F.lag(c).over(window) for c in cols}
    return df.withColumns({f"{prefix}_{c}": ratio(F.col(c) - before[c], before[c]) for c in cols})


def changes_between(
    df: DataFrame,
    cols: Sequence[str],
    start: int,
    end: int,
    keys: Sequence[str],
    time: str,
    keep: Sequence[str] = (),
    change: Sequence[str] | None = None,
) -> DataFrame:
    """One row per unit: changes at ``end`` plus all columns at ``start`` and ``end``.

    ``pc_<c>`` (for c in ``change``, default all) is the change at ``end`` since the unit's
    previous period. ``keep`` columns are taken from the end row. Units need both periods.
    One aggregate replaces the two self-joins.
    """
    at = lambda c, t: F.max(F.when(F.col(time) == t, F.col(c)))
    change = list(cols if change is None else change)
    wide = df.filter(F.col(time) <= end).groupBy(*keys).agg(
        F.count_if(F.col(time) == start).alias("_start"),
        F.count_if(F.col(time) == end).alias("_end"),
        *[at(c, end).alias(c) for c in keep],
        *[F.expr(f"max_by(`{c}`, `{time}`) FILTER (WHERE `{time}` < {end})").alias(f"_before_{c}")
          for c in change],
        *[at(c, t).alias(f"{c}_{t}") for t in (start, end) for c in cols],
    ).filter("_start > 0 AND _end > 0")
    return wide.select(
        *keys, *keep,
        *[ratio(F.col(f"{c}_{end}") - F.col(f"_before_{c}"), f"_before_{c}").alias(f"pc_{c}")
          for c in change],
        *[f"{c}_{t}" for t in (start, end) for c in cols],
    )


def two_period_change(
    df: DataFrame, cols: Sequence[str], start: int, end: int, unit: str, time: str,
    fixed: Sequence[str] = (),
) -> DataFrame:
    """Start values and ``<col>_pc`` = (end - start) / start; units with unusable changes dropped.

    ``fixed`` columns are taken from the start row.
    """
    at = lambda c, t: F.max(F.when(F.col(time) == t, F.col(c)))
    wide = df.filter(F.col(time).isin(start, end)).groupBy(unit).agg(
        *[at(c, start).alias(c) for c in fixed],
        *[at(c, start).alias(c) for c in cols],
        *[at(c, end).alias(f"_{c}") for c in cols],
    )
    changed = wide.select(
        unit, *fixed, *cols,
        *[ratio(F.col(f"_{c}") - F.col(c), c).alias(f"{c}_pc") for c in cols])
    return finite_rows(changed, [f"{c}_pc" for c in cols])


def post_means(
    df: DataFrame,
    outcomes: Sequence[str],
    unit: str,
    time: str,
    first_post: int,
    last: int,
    lags: Mapping[str, Sequence[int]] | None = None,
    fixed: Sequence[str] = (),
) -> DataFrame:
    """One row per unit: mean outcomes from ``first_post`` on, lagged values, fixed columns.

    ``fixed`` columns are read at period ``last``; units without that period drop out.
    """
    post = F.col(time) >= first_post
    return df.groupBy(unit).agg(
        F.count_if(F.col(time) == last).alias("_last"),
        *[F.max(F.when(F.col(time) == last, F.col(c))).alias(c) for c in fixed],
        *[F.avg(F.when(post, F.col(c))).alias(f"{c}_post") for c in outcomes],
        *[F.max(F.when(F.col(time) == t, F.col(c))).alias(f"{c}_{t}")
          for c, periods in (lags or {}).items() for t in periods],
    ).filter("_last > 0").drop("_last")


# ------------------------------------------------------------------ flows and survey tables


def flows_within_area(
    flows: DataFrame,
    crosswalk: DataFrame,
    origin: str,
    destination: str,
    counts: Sequence[str],
    unit: str,
    area: str,
    by: Sequence[str] = (),
) -> DataFrame:
    """Flows that stay inside the origin's area, summed per origin (and period).

    Flows are summed per origin-destination pair first, then both ends are looked up in
    the crosswalk: the joins see one row per pair.
    """
    pairs = flows.groupBy(*by, origin, destination).agg(*[F.sum(c).alias(c) for c in counts])
    ends = crosswalk.select(F.col(unit).alias("_unit"), F.col(area).alias("_area"))
    home = ends.select(F.col("_unit").alias(origin), F.col("_area").alias(area))
    work = ends.select(F.col("_unit").alias(destination), F.col("_area").alias("_work_area"))
    return (
        pairs.join(home, origin)
        .join(work, destination)
        .filter(F.col(area) == F.col("_work_area"))
        .groupBy(*by, origin, area)
        .agg(*[F.sum(c).alias(c) for c in counts])
    )


def survey_wide(
    long: DataFrame, keys: Sequence[str], variable: str, value: str, variables: Sequence[str]
) -> DataFrame:
    """Long estimates to one column per variable; all periods in one pass."""
    return long.groupBy(*keys).pivot(variable, list(variables)).agg(F.first(value, ignorenulls=True))


