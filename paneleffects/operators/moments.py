"""First and second moments by key in one pass over unit rows.

Up to the width of generated code the sums are one plain aggregate. Wider ones would leave
generated code, so tasks then add up blocks (matrices) over Arrow batches, and the blocks
are merged in a tree: tasks, branches, driver.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .unit_table import SCENARIO

#: Blocks of tasks that meet in one branch are added there; so many branches reach the driver.
BRANCHES = 32


def dot(cols: Sequence[str], factors: Sequence[str]) -> str:
    """SQL text of a sum of products."""
    return " + ".join(f"{c} * {f}" for c, f in zip(cols, factors, strict=True))


def sums_struct(parts: Mapping[str, str]) -> Column:
    """One struct column ``sums`` with the sum of every expression."""
    return F.expr("struct(" + ", ".join(f"sum({e}) AS {n}" for n, e in parts.items()) + ")").alias("sums")


def generated_fields(spark: SparkSession) -> int:
    """The number of columns beyond which Spark leaves generated code."""
    return int(spark.conf.get("spark.sql.codegen.maxFields", "100"))


@dataclass
class Moments:
    n: float
    total: np.ndarray
    gram: np.ndarray
    extra: dict[str, float] = field(default_factory=dict)

    def moved(self, by: np.ndarray) -> Moments:
        """The moments of the values less ``by``."""
        shift = np.outer(self.total, by)
        return Moments(
            self.n, self.total - self.n * by, self.gram - shift - shift.T + self.n * np.outer(by, by), dict(self.extra))

    @staticmethod
    def together(parts: Sequence[Moments]) -> Moments:
        """The moments of all rows of ``parts``, whose values have one origin."""
        extra = {k: sum(p.extra[k] for p in parts) for k in parts[0].extra}
        return Moments(sum(p.n for p in parts), sum(p.total for p in parts), sum(p.gram for p in parts), extra)


def block_pass(
    rows: DataFrame,
    partial: Callable[[pa.RecordBatch], Mapping[int, np.ndarray]],
    merge: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> dict[int, np.ndarray]:
    """``partial`` of all batches, merged (added, by default) per key.

    A task holds and sends one block per key, and no more than ``BRANCHES`` blocks per key
    reach the driver. Pass functions defined inside others, so that tasks need not import them.
    """

    def add(x, y):
        return x + y

    join, branches = merge or add, BRANCHES

    def run(batches):
        held: dict = {}
        for b in batches:
            for key, block in partial(b).items():
                held[key] = join(held[key], block) if key in held else block
        if held:
            branch = TaskContext.get().partitionId() % branches
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.int32()), pa.array([branch] * len(held), pa.int32()),
                 pa.array([np.ascontiguousarray(x, float).tobytes() for x in held.values()], pa.binary())],
                ["key", "branch", "block"])

    def fold(table: pa.Table) -> pa.Table:
        total = None
        for x in table["block"].to_pylist():
            block = np.frombuffer(x)
            total = block if total is None else join(total, block)
        return pa.table({"key": table["key"].slice(0, 1), "block": pa.array([total.tobytes()], pa.binary())})

    found: dict[int, np.ndarray] = {}
    out = rows.mapInArrow(run, "key int, branch int, block binary").groupBy("key", "branch").applyInArrow(
        fold, "key int, block binary")
    for r in out.collect():
        block = np.frombuffer(bytes(r["block"]))
        found[r["key"]] = join(found[r["key"]], block) if r["key"] in found else block
    return found


def moment_pass(
    rows: DataFrame,
    values: Sequence[str],
    extra: Mapping[str, str] | None = None,
    fields: int | None = None,
) -> dict[int, Moments]:
    """n, sum z, sum zz' and sums of ``extra`` over the rows of each scenario.

    ``values`` and ``extra`` are SQL expressions over the columns of ``rows``. With more sums
    than ``fields`` (by default, than generated code takes) tasks add up blocks. Only (K+1)^2
    numbers per scenario reach the driver. Every task combines its own rows first, so neither
    a large scenario nor a large cluster makes a hot task.
    """
    extra = dict(extra or {})
    k = len(values)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    flat = rows.selectExpr(
        SCENARIO,
        *[f"{v} AS z{i}" for i, v in enumerate(values)],
        *[f"{v} AS e_{name}" for name, v in extra.items()],
    )
    most = generated_fields(rows.sparkSession) if fields is None else fields
    if 2 + k + len(pairs) + len(extra) <= most:
        sums = flat.groupBy(SCENARIO).agg(sums_struct({
            "n": "1",
            **{f"s{i}": f"z{i}" for i in range(k)},
            **{f"g{i}_{j}": f"z{i} * z{j}" for i, j in pairs},
            **{f"e_{name}": f"e_{name}" for name in extra},
        }))
        return {r[SCENARIO]: _from_row(r["sums"], k, pairs, extra) for r in sums.collect()}
    return _block_moments(flat, k, list(extra))


def _from_row(r, k: int, pairs: Sequence[tuple[int, int]], extra: Mapping[str, str]) -> Moments:
    gram = np.zeros((k, k))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = r[f"g{i}_{j}"]
    return Moments(
        float(r["n"]),
        np.array([r[f"s{i}"] for i in range(k)], dtype=float),
        gram,
        {name: float(r[f"e_{name}"]) for name in extra},
    )


def _block_moments(flat: DataFrame, k: int, extra: list[str]) -> dict[int, Moments]:
    width = 1 + k + len(extra)  # [1, z, extra]; the Gram of [1, z] also holds n and sum z

    def partial(b: pa.RecordBatch):
        key = b.column(0).to_numpy(zero_copy_only=False)
        design = np.column_stack(
            [np.ones(len(key)), *[b.column(i).to_numpy(zero_copy_only=False) for i in range(1, width)]])
        out = {}
        for s in np.unique(key):
            own = design[key == s]
            block = np.zeros((1 + k, width))
            block[:, :1 + k] = own[:, :1 + k].T @ own[:, :1 + k]
            block[0, 1 + k:] = own[:, 1 + k:].sum(axis=0)
            out[int(s)] = block.ravel()
        return out

    result = {}
    for key, values in block_pass(flat, partial).items():
        block = values.reshape(1 + k, width)
        result[key] = Moments(
            block[0, 0], block[0, 1:1 + k].copy(), block[1:, 1:1 + k].copy(),
            dict(zip(extra, block[0, 1 + k:].tolist(), strict=True)),
        )
    return result


@dataclass
class Spread:
    """Number, means and sums of squared deviations of some columns."""

    n: float
    mean: np.ndarray
    squares: np.ndarray

    @property
    def variance(self) -> np.ndarray:
        """Sample variances; NaN for a single row."""
        return self.squares / (self.n - 1) if self.n > 1 else np.full(len(self.mean), np.nan)

    @staticmethod
    def together(parts: Sequence[Spread]) -> Spread:
        n = sum(p.n for p in parts)
        mean = sum(p.n * p.mean for p in parts) / n
        return Spread(n, mean, sum(p.squares + p.n * (p.mean - mean) ** 2 for p in parts))


def spread_pass(rows: DataFrame, key: str, names: Sequence[str], fields: int | None = None) -> dict[int, Spread]:
    """``Spread`` of the columns ``names`` per value of the integer expression ``key``, in one pass."""
    k = len(names)
    flat = rows.selectExpr(f"CAST({key} AS int) AS key", *[f"{c} AS z{i}" for i, c in enumerate(names)])
    most = generated_fields(rows.sparkSession) if fields is None else fields
    if 2 + 5 * k <= most:  # an average and a variance hold five numbers a column
        parts = [f"avg(z{i}) AS m{i}, var_pop(z{i}) AS v{i}" for i in range(k)]
        found = flat.groupBy("key").agg(F.expr(f"struct(count(*) AS n, {', '.join(parts)}) AS s")).collect()
        return {r["key"]: Spread(
            float(r["s"]["n"]), np.array([r["s"][f"m{i}"] for i in range(k)], float),
            np.array([r["s"][f"v{i}"] for i in range(k)], float) * r["s"]["n"]) for r in found}

    def partial(b: pa.RecordBatch):
        group = b.column(0).to_numpy(zero_copy_only=False)
        z = np.column_stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(k)])
        out = {}
        for g in np.unique(group):
            own = z[group == g]
            mean = own.mean(axis=0)
            out[int(g)] = np.concatenate([[len(own)], mean, ((own - mean) ** 2).sum(axis=0)])
        return out

    def merge(x, y):
        n = x[0] + y[0]
        gap = y[1:1 + k] - x[1:1 + k]
        return np.concatenate([
            [n], x[1:1 + k] + gap * (y[0] / n), x[1 + k:] + y[1 + k:] + gap * gap * (x[0] * y[0] / n)])

    return {g: Spread(float(x[0]), x[1:1 + k].copy(), x[1 + k:].copy()) for g, x in block_pass(flat, partial, merge).items()}
