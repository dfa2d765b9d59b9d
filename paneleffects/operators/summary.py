"""Summary statistics, rankings and balance tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bracketed, finite_or_null, is_finite, number_text, ratio
from ..functions.distributions import plain_number, stars, student_t_two_sided
from ..sources.stages import checked_small, driver_table, stage


def group_means(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Mean of every column by group (also: raw outcome paths by treatment and period)."""
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in cols])


def group_counts(df: DataFrame, by: Sequence[str], distinct: Sequence[str] = ()) -> DataFrame:
    """Rows per group and distinct values per group of the ``distinct`` columns."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.countDistinct(c).alias(f"n_{c}") for c in distinct],
    )


def mean_over_distinct(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean of ``value`` over the distinct (keys, value) rows."""
    return df.select(*keys, value).distinct().agg(F.avg(value).alias(f"mean_{value}"))


def mean_group_size(df: DataFrame, by: Sequence[str], name: str = "mean_size") -> DataFrame:
    """Group size averaged over rows, so that large groups count more."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n").cast("double")  # the square of a large group does not fit a bigint
    return sizes.agg((F.sum(n * n) / F.sum(n)).alias(name))


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation over rows where both values are usable."""
    usable = df.filter(is_finite(x) & is_finite(y))
    return usable.agg(F.corr(x, y).alias("correlation"), F.count(F.lit(1)).alias("n"))


def mean_ratios(df: DataFrame, cols: Sequence[str], total: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean of col / total over rows, per column."""
    return df.groupBy(*by).agg(*[F.avg(ratio(c, total)).alias(c) for c in cols])


def nrmse(df: DataFrame, left: str, right: str, by: Sequence[str] = ()) -> DataFrame:
    """Root mean squared gap between two columns over the mean of the left one."""
    gap = F.col(left) - F.col(right)
    return df.groupBy(*by).agg((F.sqrt(F.avg(gap * gap)) / F.avg(left)).alias("nrmse"))


def weight_norm(df: DataFrame, weight: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.sqrt(F.sum(F.col(weight) * F.col(weight))).alias("norm"))


#: Up to this rank tasks cut their rows down before a group meets; beyond it ranks are selected.
FEW_RANKS = 100


def top_ranks(df: DataFrame, value: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows whose value is among the k largest distinct values (of its group), with ``rank``.

    Ties share a rank and are all kept; NULL ranks last. For a few ranks Spark filters on the
    rank inside every task before the shuffle, so only leading candidates of a large group
    move. For more, the ranks come from ``leading_values``.
    """
    if k <= FEW_RANKS:
        window = Window.partitionBy(*by).orderBy(F.col(value).desc())
        return df.withColumn("rank", F.dense_rank().over(window)).filter(F.col("rank") <= k)
    names = [f"_lead_{i}" for i in range(len(by) + 1)]
    ranks = leading_values(df, value, k, by).toDF(*names, "rank")
    pairs = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip([*by, value], names, strict=True)]
    return df.join(checked_small(ranks), pairs).select(*df.columns, "rank")


def leading_values(df: DataFrame, value: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    """The k largest distinct values (of each group) and their ranks: by, value, rank.

    Distinct values are spread over ranges of (group, value), largest first. Each range is
    numbered by itself; a table with a row per range and group says how many values lie
    before. No task holds a group, whatever k is.
    """
    order = [*[F.col(c).asc_nulls_first() for c in by], F.col(value).desc_nulls_last()]
    ranged = stage(
        df.select(*by, value).distinct().repartitionByRange(*order).sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at")), "ranks")
    found = ranged.groupBy(*by, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = found.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).filter(F.col("_before") < k)
    names = [f"_group_{i}" for i in range(len(by))]
    begins = checked_small(begins.select(
        *[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], F.col("_range").alias("_run"), "_first", "_before"))
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names, strict=True)]
    rank = (F.col("_at") - F.col("_first") + F.col("_before") + 1).cast("int")
    return ranged.join(begins, [F.col("_range") == F.col("_run"), *same]).select(
        *by, value, rank.alias("rank")).filter(F.col("rank") <= k)


def _long(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        list(by), list(cols), "variable", "value")


def mean_sd_table(
    df: DataFrame, by: str, cols: Sequence[str], scale: float = 1.0, digits: int = 2
) -> DataFrame:
    """Mean and bracketed standard deviation per variable and group, as report text."""
    usable = {c: finite_or_null(c) * F.lit(scale) for c in cols}
    stats = df.groupBy(by).agg(
        *[F.avg(v).alias(f"{c}|mean") for c, v in usable.items()],
        *[F.stddev_samp(v).alias(f"{c}|sd") for c, v in usable.items()],
    )
    # one row per group from here on
    lines = F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(f"`{c}|mean`").alias("mean"),
                 F.col(f"`{c}|sd`").alias("sd")) for c in cols])
    return stats.select(by, F.inline(lines)).select(
        by, "variable", "mean", "sd",
        number_text("mean", digits).alias("mean_label"), bracketed("sd", digits).alias("sd_label"))


def quantile_summary(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float] = (0.25, 0.5, 0.75),
    by: Sequence[str] = (),
) -> DataFrame:
    """Mean, min, exact quantiles (linear interpolation) and max per variable and group.

    Values are counted first, range-partitioned in sorted order and numbered within
    each range; range totals give the offsets. No task holds a whole group, unlike the
    exact percentile aggregate, which keeps a group's distinct values in one buffer.
    """
    keys = [*by, "variable"]
    counts = _long(df, by, cols).filter(is_finite("value")).groupBy(*keys, "value").agg(
        F.count(F.lit(1)).alias("n"))
    ranged = stage(
        counts.repartitionByRange(*keys, "value").withColumn("range", F.spark_partition_id()),
        "quantiles")
    in_range = Window.partitionBy(*keys, "range").orderBy("value")
    numbered = ranged.withColumn("upto", F.sum("n").over(in_range))
    order = Window.partitionBy(*keys).orderBy("range")  # one row per range
    group = Window.partitionBy(*keys)
    totals = ranged.groupBy(*keys, "range").agg(
        F.sum("n").alias("m"), F.sum(F.col("value") * F.col("n")).alias("total"),
        F.min("value").alias("low"), F.max("value").alias("high"),
    ).select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col("range").alias("_range"),
        (F.sum("m").over(order) - F.col("m")).alias("before"),
        F.sum("m").over(group).alias("size"),
        (F.sum("total").over(group) / F.sum("m").over(group)).alias("mean"),
        F.min("low").over(group).alias("min"), F.max("high").over(group).alias("max"),
    )
    match = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keys, "range"]]
    placed = numbered.join(totals, match).select(
        *keys, "value", "size", "mean", "min", "max",
        (F.col("before") + F.col("upto") - F.col("n")).alias("first"),
        (F.col("before") + F.col("upto") - 1).alias("last"))

    def at(position):
        return F.max(F.when((F.col("first") <= position) & (position <= F.col("last")), F.col("value")))

    parts = []
    for p in probs:
        rank = (F.col("size") - 1) * F.lit(float(p))
        low = F.floor(rank)
        parts += [at(low).alias(f"low_{p}"), at(F.ceil(rank)).alias(f"high_{p}"),
                  F.max(rank - low).alias(f"part_{p}")]
    picked = placed.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in ("mean", "min", "max", "size")], *parts)
    return picked.select(
        *keys, F.col("size").alias("n"), "mean", "min",
        *[(F.col(f"`low_{p}`") + F.col(f"`part_{p}`") * (F.col(f"`high_{p}`") - F.col(f"`low_{p}`")))
          .alias(f"p{round(p * 100):02d}") for p in probs],
        "max",
    )


def density_histogram(
    df: DataFrame, value: str, bins: int, by: Sequence[str] = (),
    limits: tuple[float, float] | None = None,
) -> DataFrame:
    """Counts and densities in equal bins, per group.

    Bins are centred on the ends of the range: width = (high - low) / (bins - 1), closed on
    the right. ``limits`` fixes the range and drops values outside; the default is the
    range of the data.
    """
    usable = df.filter(is_finite(value)).select(*by, F.col(value).cast("double").alias("_v"))
    if limits is None:
        ends = usable.agg(F.min("_v").alias("low"), F.max("_v").alias("high")).first()
        if ends["low"] is None:
            raise ValueError("no usable values")
        limits = (ends["low"], ends["high"])
    low, high = (float(x) for x in limits)
    width = (high - low) / (bins - 1) if high > low else 0.1
    start = low - width / 2
    place = F.ceil((F.col("_v") - F.lit(start)) / F.lit(width)) - 1
    counts = (
        usable.filter(F.col("_v").between(low, high))
        .groupBy(*by, F.greatest(place, F.lit(0)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    group = Window.partitionBy(*by)  # one row per bin
    return counts.select(
        *by, "bin", (F.lit(start) + (F.col("bin") + 0.5) * F.lit(width)).alias("centre"), "n",
        (F.col("n") / (F.sum("n").over(group) * F.lit(width))).alias("density"))


def welch_statistics(df: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    """Per variable: means of the two groups, their difference, Welch's t and its df."""
    usable = {c: finite_or_null(F.col(c).cast("double")) for c in cols}
    when = lambda g, c: F.when(F.col(group) == g, usable[c])
    one = df.agg(*[
        f(when(g, c)).alias(f"{name}{g}|{c}")
        for c in cols for g in (0, 1)
        for name, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))
    ])
    lines = F.array(*[
        F.struct(F.lit(c).alias("variable"), *[
            F.col(f"`{s}{g}|{c}`").alias(f"{s}{g}") for s in ("n", "mean", "var") for g in (0, 1)])
        for c in cols])
    part = {g: F.try_divide(F.col(f"var{g}"), F.col(f"n{g}")) for g in (0, 1)}
    both = part[0] + part[1]
    return one.select(F.inline(lines)).select(
        "variable", F.col("mean1").alias("mean_treated"), F.col("mean0").alias("mean_control"),
        (F.col("mean1") - F.col("mean0")).alias("difference"),
        F.try_divide(F.col("mean1") - F.col("mean0"), F.sqrt(both)).alias("t"),
        F.try_divide(
            both * both,
            F.try_divide(part[0] * part[0], F.col("n0") - 1)
            + F.try_divide(part[1] * part[1], F.col("n1") - 1)).alias("df"),
    )


def welch_report(df: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    """Welch statistics with p values and report labels. One line per variable."""
    rows = welch_statistics(df, group, cols).collect()  # as many rows as columns named
    p = [student_t_two_sided(r["t"], r["df"]) for r in rows]

    return driver_table(df.sparkSession, {
        "variable": ("string", [r["variable"] for r in rows]),
        "difference": ("double", [r["difference"] for r in rows]),
        "t": ("double", [r["t"] for r in rows]),
        "df": ("double", [r["df"] for r in rows]),
        "p_value": ("double", p),
        "label": ("string", [None if r["difference"] is None else plain_number(r["difference"], 2) + stars(x)
                             for r, x in zip(rows, p, strict=True)]),
        "t_label": ("string", [None if r["t"] is None else f"({plain_number(r['t'], 2)})" for r in rows]),
    })


def weight_classes(
    df: DataFrame, treatment: str, cluster: str, high: DataFrame, name: str = "weight_class"
) -> DataFrame:
    """2 treated, 1 untreated in a listed high-weight cluster, 0 other untreated."""
    marks = checked_small(
        high.select(F.col(cluster).alias("_c")).distinct().withColumn("_high", F.lit(True)))
    joined = df.join(marks, F.col(cluster) == F.col("_c"), "left")
    label = (F.when(F.col(treatment) == 1, 2).when(F.col("_high"), 1)
             .when(F.col(treatment) == 0, 0))
    return joined.select(*df.columns, label.alias(name))


def weight_class_table(
    df: DataFrame, treatment: str, cluster: str, high: DataFrame, cols: Sequence[str]
) -> DataFrame:
    """Means, deviations and counts by weight class, from one pass over the rows."""
    classed = weight_classes(df, treatment, cluster, high)
    stats = mean_sd_table(classed, "weight_class", cols)
    counts = group_counts(classed, ["weight_class"])
    return stats.join(counts, "weight_class")


def top_destinations(
    flows: DataFrame, origins: DataFrame, origin: str, destination: str, cols: Sequence[str],
    rank_by: str, by: Sequence[str] = (), k: int = 10,
) -> DataFrame:
    """Mean flows from the listed origins per destination; the k highest ranks per period."""
    means = flows.join(checked_small(origins.select(origin).distinct()), origin, "left_semi").groupBy(
        *by, destination).agg(*[F.avg(c).alias(c) for c in cols])
    return top_ranks(means, rank_by, k, by)


def labelled_list(
    df: DataFrame, cols: Sequence[str], relabel: Mapping[str, Mapping[str, str]],
    order: Sequence[str],
) -> DataFrame:
    """Distinct rows with some labels replaced, in a fixed order."""
    out = df.select(*cols).distinct()
    for c, names in relabel.items():
        chain = F.col(c)
        for old, new in names.items():
            chain = F.when(F.col(c) == old, new).otherwise(chain)
        out = out.withColumn(c, chain)
    return out.orderBy(*order)
