"""Lasso covariate choice with a data-driven penalty.

Minimises sum (y - x'b)^2 + sum_j lambda0 psi_j |b_j| without an intercept, with
lambda0 = 2 c sqrt(n) Phi^-1(1 - gamma / (2 p)) and loadings psi_j = sqrt(mean(x_j^2 e^2)),
where the residuals e are refreshed until their spread settles (Belloni, Chen,
Chernozhukov and Hansen 2012). The rows are read once for the Gram matrix and once per
refresh; the p-variable problem is solved on the driver.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import normal_quantile
from ..sources.stages import driver_table, stage
from ..spec import ConvergenceError
from .moments import dot, moment_pass
from .prep import finite_rows
from .unit_table import SCENARIO


@dataclass(frozen=True)
class LassoFit:
    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    loadings: tuple[float, ...]
    penalty: float
    iterations: int
    rows: int
    settled: bool = True

    @property
    def selected(self) -> list[str]:
        return [f for f, b in zip(self.features, self.coefficients, strict=True) if b != 0.0]

    def choose(self, allowed: Sequence[str]) -> list[str]:
        """The allowed covariates with a non-zero coefficient, in the caller's order."""
        return [c for c in dict.fromkeys(allowed) if c in set(self.selected)]


def coordinate_descent(
    gram: np.ndarray, cross: np.ndarray, penalty: np.ndarray, sweeps: int = 100_000
) -> np.ndarray:
    """argmin b'Gb - 2 g'b + sum penalty_j |b_j|, features scaled to a unit diagonal first."""
    root = np.sqrt(np.diag(gram))
    live = root > 0
    scale = np.where(live, root, 1.0)
    g, c, lam = gram / np.outer(scale, scale), cross / scale, penalty / scale / 2.0
    b = np.zeros(len(c))
    size = max(float(np.max(np.abs(c), initial=0.0)), 1e-300)
    for _ in range(sweeps):
        moved = 0.0
        for j in np.flatnonzero(live):
            part = c[j] - g[j] @ b + b[j]
            new = math.copysign(max(abs(part) - lam[j], 0.0), part) + 0.0  # no signed zero
            moved, b[j] = max(moved, abs(new - b[j])), new
        if moved <= 1e-14 * size:
            return b / scale
    raise ConvergenceError(f"coordinate descent did not settle in {sweeps} sweeps")


def rigorous_lasso(
    df: DataFrame,
    outcome: str,
    features: Sequence[str],
    c: float = 0.5,
    gamma: float | None = None,
    max_iter: int = 15,
    tol: float = 1e-5,
    unsettled: str = "warn",
) -> LassoFit:
    """``gamma`` defaults to 0.1 / log(n). Rows with a missing value are left out.

    If the residuals' spread has not settled to ``tol`` after ``max_iter`` refreshes the fit is
    marked (``settled``) and, by ``unsettled``, that is a warning, an error or ignored.
    """
    if unsettled not in ("warn", "error", "ignore"):
        raise ValueError("unsettled is 'warn', 'error' or 'ignore'")
    features = tuple(dict.fromkeys(features))
    p = len(features)
    rows = stage(
        finite_rows(df, [outcome, *features]).selectExpr(
            f"0 AS {SCENARIO}", f"double(`{outcome}`) AS _y",
            *[f"double(`{x}`) AS _x{j}" for j, x in enumerate(features)]),
        "lasso")
    xs = [f"_x{j}" for j in range(p)]
    extra = {f"l{j}": f"_x{j} * _x{j} * _y * _y" for j in range(p)}
    found = moment_pass(rows, [*xs, "_y"], extra)
    if not found or found[0].n < 2:
        raise ValueError("the lasso needs at least two complete rows")
    m = found[0]
    n = m.n
    gram, cross = m.gram[:p, :p], m.gram[:p, p]
    gamma = 0.1 / math.log(n) if gamma is None else gamma
    lambda0 = 2.0 * c * math.sqrt(n) * normal_quantile(1.0 - gamma / (2.0 * p))
    loadings = np.sqrt(np.array([m.extra[f"l{j}"] for j in range(p)]) / n)
    spread = math.sqrt(max(m.gram[p, p] - m.total[p] ** 2 / n, 0.0) / (n - 1))
    b, done, settled = np.zeros(p), 0, False
    while done < max_iter:
        b = coordinate_descent(gram, cross, lambda0 * loadings)
        done += 1
        if not np.any(b):
            settled = True
            break
        table = driver_table(rows.sparkSession, {SCENARIO: ("int", [0])} | {
            f"_b{j}": ("double", [b[j]]) for j in range(p)})
        parts = ", ".join(f"sum(_x{j} * _x{j} * _e * _e) AS l{j}" for j in range(p))
        r = (
            rows.join(table, SCENARIO)
            .selectExpr(*xs, "_y - (" + dot([f"_b{j}" for j in range(p)], xs) + ") AS _e")
            .agg(F.expr(f"struct(stddev_samp(_e) AS s, {parts})").alias("r")).first()["r"])
        loadings = np.sqrt(np.array([r[f"l{j}"] for j in range(p)]) / n)
        settled = abs(spread - r["s"]) < tol
        spread = r["s"]
        if settled:
            break
    if not settled and unsettled != "ignore":
        message = f"the lasso's loadings had not settled after {done} refreshes"
        if unsettled == "error":
            raise ConvergenceError(message)
        warnings.warn(message, stacklevel=2)
    return LassoFit(features, tuple(float(x) for x in b), tuple(float(x) for x in loadings),
                    lambda0, done, int(n), settled)
