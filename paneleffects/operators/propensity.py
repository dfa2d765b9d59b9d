"""Propensity scores by stepwise logit.

All candidate models of a selection round are fitted together: one scan per Newton step
returns every model's score vector, information matrix and deviance. Rows are not repeated
for the candidates. As long as the models agree on the base terms and leave the candidate
out, as at the start of a round, they share the base block of the information matrix and
each adds only its border (the candidate against the base terms, and its own corner).
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_finite
from ..sources.stages import driver_table, stage
from ..spec import ConvergenceError
from .moments import block_pass
from .prep import finite_rows


@dataclass(frozen=True)
class Term:
    """A regressor: a column or a product of two columns."""

    name: str
    factors: tuple[str, ...]

    @property
    def expr(self) -> str:
        return " * ".join(f"double(`{c}`)" for c in self.factors)


@dataclass(frozen=True)
class Logit:
    terms: tuple[Term, ...]
    intercept: float
    coefficients: tuple[float, ...]
    deviance: float
    rounds: tuple[tuple[str, float], ...] = ()  # (chosen term, likelihood ratio)

    @property
    def names(self) -> list[str]:
        return [t.name for t in self.terms]

    def renamed(self, columns: Mapping[str, str]) -> Logit:
        """The model over a table that has these columns under other names."""
        return replace(self, terms=tuple(
            Term(t.name, tuple(columns.get(c, c) for c in t.factors)) for t in self.terms))

    def predict(self, df: DataFrame, name: str = "pscore") -> DataFrame:
        """Add the predicted probability; NULL where a regressor is missing."""
        score = " + ".join([
            f"({self.intercept!r}D)",
            *[f"({b!r}D) * {t.expr}" for b, t in zip(self.coefficients, self.terms, strict=True)]])
        return df.withColumn(name, F.expr(f"1.0D / (1.0D + exp(-({score})))"))


class _Fit:
    """Newton iterations of one logit on standardised regressors."""

    def __init__(self, start: np.ndarray) -> None:
        self.beta, self.deviance = start, np.inf
        self.step: np.ndarray | None = None
        self.length, self.done = 1.0, False

    def trial(self) -> np.ndarray:
        return self.beta if self.step is None else self.beta + self.length * self.step

    def see(self, deviance: float, score: np.ndarray, information: np.ndarray) -> None:
        beta = self.trial()
        if self.step is not None and not deviance <= self.deviance + 1e-12 * abs(self.deviance):
            self.length /= 2.0
            self.done = self.length < 1e-8
            return
        before, self.deviance, self.beta = self.deviance, deviance, beta
        self.step = np.linalg.lstsq(information, score, rcond=1e-12)[0]
        self.length = 1.0
        size = abs(deviance) + 0.1
        gain = float(score @ self.step)  # what the next step takes off, to second order
        if gain <= 1e-9 * size:
            # take it unseen: the neglected third-order part is far below the stopping rule
            self.beta, self.deviance, self.done = beta + self.step, deviance - gain, True
        elif abs(before - deviance) <= 1e-11 * size:
            self.done = True


@dataclass(frozen=True)
class _Scale:
    mean: float
    sd: float


def _scales(rows: DataFrame, terms: Sequence[Term]) -> dict[str, _Scale]:
    parts = ", ".join(f"avg({t.expr}) AS m{i}, stddev_pop({t.expr}) AS s{i}" for i, t in enumerate(terms))
    r = rows.agg(F.expr(f"struct({parts})").alias("s")).first()["s"]
    return {t.name: _Scale(r[f"m{i}"], r[f"s{i}"] or 1.0) for i, t in enumerate(terms)}


def logit_pass(
    flat: DataFrame, d: int, trials: Mapping[int, np.ndarray]
) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """(deviance, score, information) of every model in one scan that reads each row once.

    ``flat`` has the label, d - 1 base columns and a column per candidate; model i has the
    constant, the base columns and candidate i, with coefficients ``trials[i]``. Tasks send the
    base block under key 0 and a border per model while the models share it, else a full
    block per model.
    """
    models = list(trials)
    betas = np.array([trials[i] for i in models])
    shared = bool(np.all(betas[:, :d] == betas[0, :d]) and not np.any(betas[:, d]))

    def partial(b):
        column = lambda k: b.column(k).to_numpy(zero_copy_only=False)
        y = column(0)
        x = np.column_stack([np.ones(len(y)), *[column(k) for k in range(1, d)]])

        def at(eta):
            p = 1.0 / (1.0 + np.exp(-eta))
            deviance = 2.0 * np.sum(np.maximum(eta, 0.0) - y * eta + np.log1p(np.exp(-np.abs(eta))))
            return deviance, y - p, p * (1.0 - p)

        if shared:
            deviance, gap, w = at(x @ betas[0, :d])
            wx = x * w[:, None]
            z = np.column_stack([column(d + i) for i in models])
            border, corner, score = wx.T @ z, w @ (z * z), gap @ z
            out = {0: np.concatenate([[deviance], gap @ x, (x.T @ wx).ravel()])}
            for k, i in enumerate(models):
                out[i + 1] = np.concatenate([[score[k], corner[k]], border[:, k]])
            return out
        out = {}
        for k, i in enumerate(models):
            design = np.column_stack([x, column(d + i)])
            deviance, gap, w = at(design @ betas[k])
            out[i + 1] = np.concatenate([[deviance], gap @ design, (design.T @ (design * w[:, None])).ravel()])
        return out

    found = block_pass(flat, partial)
    out = {}
    for i in models if found else ():
        x = found[i + 1]
        if shared:
            base = found[0]
            information = np.zeros((d + 1, d + 1))
            information[:d, :d] = base[1 + d:].reshape(d, d)
            information[:d, d] = information[d, :d] = x[2:]
            information[d, d] = x[1]
            out[i] = float(base[0]), np.append(base[1:1 + d], x[0]), information
        else:
            out[i] = float(x[0]), x[1:2 + d].copy(), x[2 + d:].reshape(d + 1, d + 1).copy()
    return out


def fit_logits(
    rows: DataFrame,
    label: str,
    base: Sequence[Term],
    candidates: Sequence[Term | None],
    start: Mapping[str, float] | None = None,
    max_passes: int = 50,
) -> list[Logit]:
    """Fit label ~ 1 + base + candidate for every candidate (None: base alone), together."""
    known = [t for t in candidates if t is not None]
    scale = _scales(rows, [*base, *known]) if base or known else {}
    d = 1 + len(base)
    first = np.zeros(d + 1)
    if start:
        first[1:d] = [start.get(t.name, 0.0) * scale[t.name].sd for t in base]
        first[0] = start.get("", 0.0) + sum(start.get(t.name, 0.0) * scale[t.name].mean for t in base)
    fits = [_Fit(first.copy()) for _ in candidates]
    standard = lambda t: f"({t.expr} - ({scale[t.name].mean!r}D)) / ({scale[t.name].sd!r}D)"
    flat = rows.selectExpr(
        f"double(`{label}`) AS _y", *[f"{standard(t)} AS _x{k}" for k, t in enumerate(base)],
        *[f"{'0.0D' if t is None else standard(t)} AS _z{i}" for i, t in enumerate(candidates)])
    for _ in range(max_passes):
        open_ = [i for i, f in enumerate(fits) if not f.done]
        if not open_:
            break
        sums = logit_pass(flat, d, {i: fits[i].trial() for i in open_})
        if not sums:
            raise ValueError("the propensity model needs at least one complete row")
        for i in open_:
            fits[i].see(*sums[i])
    if not all(f.done for f in fits):
        raise ConvergenceError(f"the logit did not converge in {max_passes} passes; are the groups separated?")
    out = []
    for t, fit in zip(candidates, fits, strict=True):
        terms = tuple(base) if t is None else (*base, t)
        slopes = [fit.beta[k + 1] / scale[x.name].sd for k, x in enumerate(terms)]
        intercept = fit.beta[0] - sum(b * scale[x.name].mean for b, x in zip(slopes, terms, strict=True))
        out.append(Logit(terms, float(intercept), tuple(float(b) for b in slopes), float(fit.deviance)))
    return out


def likelihood_ratios(
    rows: DataFrame, label: str, base: Sequence[Term], candidates: Sequence[Term],
    current: Logit | None = None,
) -> tuple[Logit, list[Logit], list[float]]:
    """The base model, each base + candidate model and its likelihood-ratio statistic."""
    if current is None:
        current, *models = fit_logits(rows, label, base, [None, *candidates])
    else:
        start = {"": current.intercept} | dict(zip(current.names, current.coefficients, strict=True))
        models = fit_logits(rows, label, base, candidates, start)
    return current, models, [current.deviance - m.deviance for m in models]


def select_terms(
    rows: DataFrame, label: str, base: Sequence[Term], candidates: Sequence[Term],
    cutoff: float, stop_rule: str = "first",
) -> Logit:
    """Forward selection: add the term with the largest likelihood ratio while it passes.

    ``stop_rule='first'``: the search also ends when the first remaining candidate misses
    the cutoff, whatever the others reach. ``'max'``: it ends when none reaches it.
    """
    if stop_rule not in ("first", "max"):
        raise ValueError("stop_rule is 'first' or 'max'")
    current, left, chosen = None, list(candidates), []
    base = list(base)
    while left:
        current, models, ratios = likelihood_ratios(rows, label, base, left, current)
        if (ratios[0] if stop_rule == "first" else max(ratios)) < cutoff:
            break
        best = int(np.argmax(ratios))
        chosen.append((left[best].name, ratios[best]))
        base.append(left.pop(best))
        current = models[best]
    if current is None:
        current = fit_logits(rows, label, base, [None])[0]
    return Logit(current.terms, current.intercept, current.coefficients, current.deviance, tuple(chosen))


def estimate_propensity(
    df: DataFrame,
    label: str,
    candidates: Sequence[str],
    baseline: Sequence[str] = (),
    linear_cutoff: float = 1.0,
    quadratic_cutoff: float = 2.7,
    stop_rule: str = "first",
    squares: bool = False,
) -> Logit:
    """Stepwise propensity model: linear terms first, then pairwise interactions.

    Every model is fitted on the same rows: those with a usable label and usable values of
    all candidates. Without baseline terms, and under ``stop_rule='first'``, the interaction
    stage ends at once: its first candidate is the intercept's, which never improves the
    fit. Squares are candidates only on request.
    """
    rows = stage(
        finite_rows(df, [label, *baseline, *candidates]).select(label, *baseline, *candidates),
        "propensity")
    base = [Term(c, (c,)) for c in baseline]
    linear = select_terms(
        rows, label, base, [Term(c, (c,)) for c in candidates if c not in baseline],
        linear_cutoff, stop_rule)
    if not baseline and stop_rule == "first":
        return linear
    names = [t.factors[0] for t in linear.terms]
    second = [Term(f"{a}:{b}", (a, b)) for a, b in itertools.combinations(names, 2)]
    if squares:
        second += [Term(f"{a}^2", (a, a)) for a in names]
    full = select_terms(rows, label, linear.terms, second, quadratic_cutoff, stop_rule)
    return Logit(full.terms, full.intercept, full.coefficients, full.deviance,
                 (*linear.rounds, *full.rounds))


def trim(df: DataFrame, score: str = "pscore", low: float = 0.1, high: float = 0.9) -> DataFrame:
    return df.filter(is_finite(score) & F.col(score).between(low, high))
