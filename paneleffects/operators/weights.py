"""Ridge strength, unit weights and time weights of synthetic difference-in-differences.

Both weight problems are solved from sums over unit rows; the rows never leave Spark.

Unit weights minimise, over w >= 0 with sum 1 and a free level shift w0,
    sum_r v_r (w0 c_r + sum_i A_ri w_i - b_r)^2 + eta sum_i w_i^2
(r: pre-periods, then covariates; i: control units). Its dual has one unknown per row r
plus one: with B_ri = sqrt(v_r)(A_ri - b_r), the weights are w_i = max(0, mu - q'B_i) and
    f(q, mu) = eta/2 |q|^2 + 1/2 sum_i max(0, mu - q'B_i)^2 - mu,   c'q = 0
is convex and piecewise quadratic. Newton steps on f need sums over the active units
only (count, sum B, sum BB'): one aggregate per step, whatever the number of units.
The same sums give a feasible point of the weight problem itself, so every point the search
accepts comes with its duality gap: how far its loss can be from the best one. A search that
ends with a gap above ``MOST_GAP`` of the loss is an error, however it ended. The gap also
bounds the dual solution, and a control beyond that bound must have weight 0: once few
controls are active and the gap is small, the others are screened out and later steps read
what is left.
When the ridge all but vanishes against the outcome's scale (large units, no covariates)
and the treated path lies outside the controls, rounding limits single weights to about
1e-5; ``residual`` and ``gap`` report it and the weights are scaled to sum to one.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F

from ..sources.stages import driver_table, stage
from .moments import Moments, Spread, block_pass, dot, moment_pass, spread_pass
from .unit_table import LEFT, SCENARIO, UnitTable, mean_of

POST = "post_mean"
SHORTEST_CUT = 1e-8  # of a step that went too far, per pass
SCREEN_BELOW, SCREEN_GAP = 0.25, 0.01  # share of active controls, and gap, from which the others are screened
MOST_GAP = 1e-6      # of the loss, that a solution may be away from the best one


class WeightError(ValueError):
    """The weights cannot be determined from this panel."""


@dataclass(frozen=True)
class GroupStats:
    """Means and sample variances of every unit-level column, by treatment group."""

    names: tuple[str, ...]
    n: tuple[float, float]  # controls, treated
    mean: tuple[np.ndarray, np.ndarray]
    var: tuple[np.ndarray, np.ndarray]

    def pick(self, names: list[str]) -> np.ndarray:
        return np.array([self.names.index(c) for c in names])


def group_stats(units: UnitTable, fields: int | None = None) -> dict[int, GroupStats]:
    """One pass: per scenario and group, mean and variance of outcomes, covariates, post mean.

    Every unit is read once: scenarios put together the clusters they keep.
    """
    names = [*units.outcome_cols, *units.covariate_cols, POST]
    rows = units.data.selectExpr("*", f"{units.post_mean} AS {POST}")
    key = f"2 * {LEFT if units.groups else SCENARIO} + IF(treated = 1, 1, 0)"
    found = spread_pass(rows, key, names, fields)
    stats = {}
    for s, kept in _members(units, {k // 2 for k in found}).items():
        both = []
        for g in (0, 1):
            parts = [found[2 * c + g] for c in kept if 2 * c + g in found]
            if not parts:
                raise WeightError(f"scenario {s} has no {'control' if g == 0 else 'treated'} units")
            both.append(Spread.together(parts))
        stats[s] = GroupStats(
            tuple(names), tuple(x.n for x in both), tuple(x.mean for x in both), tuple(x.variance for x in both))
    return stats


def mean_before(units: UnitTable) -> str:
    """SQL expression: mean outcome of the unit before treatment starts."""
    return mean_of([f"y_{k}" for k in units.pre])


def _members(units: UnitTable, keys: set[int]) -> dict[int, list[int]]:
    """The row keys (classes of left-out clusters, or scenarios) that make up each scenario."""
    if not units.groups:
        return {s: [s] for s in sorted(keys)}
    kept = units.kept()
    return {s: [c for c in sorted(keys) if kept[c][s]] for s in range(len(units.groups))}


def normalized_differences(units: UnitTable, stats: GroupStats) -> dict[str, float]:
    """|difference of group means| / sqrt(average group variance), per pre-period and covariate."""
    rows = _row_names(units)
    at = stats.pick(rows)
    gap = np.abs(stats.mean[1][at] - stats.mean[0][at])
    with np.errstate(divide="ignore", invalid="ignore"):
        values = gap / np.sqrt((stats.var[0][at] + stats.var[1][at]) / 2.0)
    labels = [str(units.periods[k]) for k in units.pre] + list(units.spec.covariates)
    return dict(zip(labels, values, strict=True))


def regularization(units: UnitTable, stats: GroupStats) -> float:
    """zeta: one over the largest normalized difference before treatment."""
    known = [v for v in normalized_differences(units, stats).values() if not np.isnan(v)]
    if not known or max(known) <= 0.0 or np.isinf(max(known)):
        raise WeightError("the groups have no usable normalized difference before treatment")
    return float(1.0 / max(known))


def _row_names(units: UnitTable) -> list[str]:
    return [f"y_{k}" for k in units.pre] + units.covariate_cols


# --------------------------------------------------------------------------- unit weights


@dataclass
class UnitWeightSolution:
    """w_i = max(0, mu - sum_r slope_r (A_ri - target_r)) for controls, 1/n_treated for treated."""

    mu: float
    slope: np.ndarray
    target: np.ndarray
    shift: float
    n_treated: float
    zeta: float
    eta: float
    passes: int = 0
    residual: float = 0.0
    gap: float = 0.0  # duality gap over the loss


@dataclass
class _Newton:
    """Driver-side state of one scenario's dual problem (R + 2 numbers)."""

    eta: float
    c: np.ndarray
    q: np.ndarray
    mu: float
    value: float = np.inf
    grad: np.ndarray | None = None
    step: np.ndarray | None = None
    length: float = 1.0
    nu: float = 0.0
    active: float = -1.0
    residual: float = np.inf
    gap: float = np.inf
    loss: float = np.inf
    screen: tuple[np.ndarray, float, float] | None = None
    passes: int = 0
    done: bool = False

    def trial(self) -> tuple[np.ndarray, float]:
        if self.step is None:
            return self.q, self.mu
        return self.q + self.length * self.step[:-1], self.mu + self.length * self.step[-1]

    def see(self, m: Moments) -> None:
        """Take in the sums at the trial point: accept it, or shorten the step."""
        q, mu = self.trial()
        w_sum, w_square = m.extra["w"], m.extra["ww"]
        w_b = np.array([m.extra[f"wb{r}"] for r in range(len(q))])
        value = 0.5 * self.eta * q @ q + 0.5 * w_square - mu
        grad = np.append(self.eta * q - w_b, w_sum - 1.0)
        self.passes += 1
        if self.step is not None:
            slope = self.grad @ self.step
            slack = 1e-14 * (abs(self.value) + abs(mu))
            if value > self.value + 1e-4 * self.length * slope + slack:
                here = grad @ self.step  # derivative along the step, grows with the length
                cut = -slope / (here - slope) if here > slope else 0.5
                self.length *= min(max(cut, SHORTEST_CUT), 0.5)
                if self.length < 1e-14:
                    self.done = True
                return
        full = self.step is not None and self.length == 1.0
        same_active = full and m.n == self.active
        settled = same_active and abs(value - self.value) <= 1e-13 * abs(value)
        self.q, self.mu, self.value, self.grad = q, mu, value, grad
        self.active = m.n
        self._certify(m, w_b, w_sum, w_square)
        r = len(q)
        hessian = np.zeros((r + 1, r + 1))
        hessian[:r, :r] = self.eta * np.eye(r) + m.gram
        hessian[:r, r] = hessian[r, :r] = -m.total
        hessian[r, r] = m.n
        if m.n == 0:
            hessian[r, r] = 1.0
        kkt = np.zeros((r + 2, r + 2))
        kkt[: r + 1, : r + 1] = hessian
        kkt[:r, r + 1] = kkt[r + 1, :r] = self.c
        right = np.append(-grad, -self.c @ q)
        solution = _scaled_solve(kkt, right)
        self.nu = solution[-1]
        # stationarity with the multiplier of c'q = 0, relative to the row scale of one
        gap = grad.copy()
        gap[:r] += self.nu * self.c
        self.residual = float(np.max(np.abs(gap)))
        self.step, self.length = solution[:-1], 1.0
        move = float(abs(grad @ self.step))
        # the last two: nothing left to gain but rounding, as with a vanishing ridge
        if (self.residual <= 1e-12 or (same_active and self.residual <= 1e-9)
                or move <= 1e-24 or settled):
            self.done = True


    def _certify(self, m: Moments, w_b: np.ndarray, w_sum: float, w_square: float) -> None:
        """Duality gap at the accepted point, and the bound beyond which a control has weight 0."""
        if not w_sum > 0:
            return
        mean = w_b / w_sum  # scaled to sum to one, the weights are feasible
        rest = mean - self.c * (self.c @ mean) / (self.c @ self.c)
        self.loss = 0.5 * w_square / w_sum**2 + rest @ rest / (2.0 * self.eta)
        self.gap = max(self.loss + self.value, 0.0)
        # the best q lies within this distance, the best mu below the mean of w + q'B over the active
        reach = np.sqrt(2.0 * (self.gap + 1e-14 * abs(self.loss)) / self.eta)
        centre = m.total / m.n
        self.screen = (self.q, float(reach), float(1.0 / m.n + self.q @ centre + reach * np.linalg.norm(centre)))

    @property
    def relative_gap(self) -> float:
        return self.gap / self.loss if self.loss > 0 and np.isfinite(self.loss) else np.inf


def _scaled_solve(matrix: np.ndarray, right: np.ndarray) -> np.ndarray:
    scale = 1.0 / np.sqrt(np.maximum(np.abs(np.diag(matrix)), 1e-300))
    scale[np.abs(np.diag(matrix)) == 0.0] = 1.0
    scaled = matrix * np.outer(scale, scale)
    try:
        return scale * np.linalg.solve(scaled, right * scale)
    except np.linalg.LinAlgError:
        return scale * np.linalg.lstsq(scaled, right * scale, rcond=None)[0]


def solve_unit_weights(
    units: UnitTable,
    stats: Mapping[int, GroupStats],
    centred: Mapping[int, Moments] | None = None,
    max_passes: int = 200,
    fields: int | None = None,
) -> dict[int, UnitWeightSolution]:
    """Unit weights of every scenario; all scenarios share each pass over the data.

    ``centred`` (from ``control_moments``) gives the first step without a pass.
    """
    spec = units.spec
    if spec.time_init is None or spec.time_pre <= spec.time_init:
        raise WeightError("time_init must lie before time_pre: the ridge would be zero")
    names = _row_names(units)
    n_pre = len(units.pre)
    if n_pre == 0 or not units.post:
        raise WeightError("need periods before and after the treatment start")
    plans = {}
    for s, st in stats.items():
        at = st.pick(names)
        target, sd = st.mean[1][at], np.sqrt(st.var[0][at])
        if spec.covariates:
            if np.any(~(sd > 0)):
                flat = [n for n, x in zip(names, sd, strict=True) if not x > 0]
                raise WeightError(f"no variance among controls in {flat}")
            scale, eta_scale = sd, 1.0
        else:
            common = np.sqrt(np.nanmean(sd**2))
            if not common > 0:
                raise WeightError("no variance among controls before treatment")
            scale, eta_scale = np.full(len(names), common), common**2
        zeta = regularization(units, st)
        eta = zeta * (spec.time_pre - spec.time_init)
        level = np.array([1.0] * n_pre + [0.0] * len(spec.covariates))
        unit0 = float(np.min(scale[:n_pre]))
        state = _Newton(eta / eta_scale, level * unit0 / scale, np.zeros(len(names)), 1.0 / st.n[0])
        plans[s] = (state, target, scale, unit0, zeta, eta)
        if centred is not None:
            state.see(_start_moments(st, centred[s], at, target, scale, state.mu))

    controls, narrowed = units.data.filter("treated = 0"), False
    for _ in range(max_passes):
        open_ = [s for s, plan in plans.items() if not plan[0].done]
        if not open_:
            break
        few = [plans[s][0].active < SCREEN_BELOW * stats[s].n[0] and plans[s][0].relative_gap < SCREEN_GAP for s in open_]
        if not narrowed and not units.groups and all(few):
            controls, narrowed = stage(_not_screened(controls, {s: plans[s] for s in open_}, names), "controls"), True
        sums = _dual_pass(units, controls, {s: plans[s] for s in open_}, names, fields)
        for s in open_:
            plans[s][0].see(sums.get(s) or _nothing(len(names)))
    result = {}
    for s, (state, target, scale, unit0, zeta, eta) in plans.items():
        if not state.done:
            raise WeightError(f"scenario {s}: unit weights not solved after {max_passes} passes")
        total = 1.0 + state.grad[-1]
        if not state.relative_gap <= MOST_GAP:
            raise WeightError(
                f"scenario {s}: the search for unit weights stalled with {state.relative_gap:.1e} of the loss left")
        if not 0.99 <= total <= 1.01:
            raise WeightError(f"scenario {s}: unit weights sum to {total}")
        result[s] = UnitWeightSolution(
            state.mu / total, state.q / scale / total, target, -state.nu * unit0,
            stats[s].n[1], zeta, eta, state.passes, state.residual, state.relative_gap,
        )
    return result


def _nothing(r: int) -> Moments:
    extra = {"w": 0.0, "ww": 0.0} | {f"wb{i}": 0.0 for i in range(r)}
    return Moments(0.0, np.zeros(r), np.zeros((r, r)), extra)


def _start_moments(st, m: Moments, at, target, scale, mu: float) -> Moments:
    """Sums at q = 0, mu = 1/n, where every control is active, from the centred moments."""
    offset = (st.mean[0][at] - target) / scale
    spread = np.outer(1.0 / scale, 1.0 / scale) * m.gram[np.ix_(range(len(at)), range(len(at)))]
    n = m.n
    total = n * offset
    gram = spread + n * np.outer(offset, offset)
    extra = {"w": mu * n, "ww": mu * mu * n} | {f"wb{i}": mu * t for i, t in enumerate(total)}
    return Moments(n, total, gram, extra)


def _not_screened(controls, plans, names):
    """The controls that can still have a weight above 0 in some open scenario's solution."""
    r, keys = len(names), list(plans)
    columns = {SCENARIO: ("int", keys)}
    screens = [plans[s][0].screen for s in keys]
    columns["_reach"] = ("double", [x[1] for x in screens])
    columns["_top"] = ("double", [x[2] for x in screens])
    for i in range(r):
        columns[f"_t{i}"] = ("double", [plans[s][1][i] for s in keys])
        columns[f"_k{i}"] = ("double", [plans[s][2][i] for s in keys])
        columns[f"_q{i}"] = ("double", [x[0][i] for x in screens])
    b = [f"(({c} - _t{i}) / _k{i})" for i, c in enumerate(names)]
    far = f"({dot([f'_q{i}' for i in range(r)], b)}) - _reach * sqrt({dot(b, b)}) >= _top"
    joined = controls.join(driver_table(controls.sparkSession, columns), SCENARIO)
    return joined.filter(f"NOT ({far})").select(*controls.columns)


def _dual_pass(units, controls, plans, names, fields) -> dict[int, Moments]:
    """Sums over the active controls at each scenario's trial point, in one scan of the units."""
    if units.groups:
        return _dual_blocks(controls, np.array(units.kept()), plans, names)
    r = len(names)
    spark = controls.sparkSession
    keys = list(plans)
    trials = [plans[s][0].trial() for s in keys]
    columns = {SCENARIO: ("int", keys), "mu": ("double", [t[1] for t in trials])}
    for i in range(r):
        columns[f"t_{i}"] = ("double", [plans[s][1][i] for s in keys])
        columns[f"k_{i}"] = ("double", [plans[s][2][i] for s in keys])
        columns[f"q_{i}"] = ("double", [t[0][i] for t in trials])
    bs = [f"b_{i}" for i in range(r)]
    rows = (
        controls.join(driver_table(spark, columns), SCENARIO)
        .selectExpr(SCENARIO, "mu", *[f"q_{i}" for i in range(r)],
                    *[f"({c} - t_{i}) / k_{i} AS b_{i}" for i, c in enumerate(names)])
        .selectExpr(SCENARIO, "mu - (" + dot([f"q_{i}" for i in range(r)], bs) + ") AS w", *bs)
        .filter("w > 0")
    )
    extra = {"w": "w", "ww": "w * w"} | {f"wb{i}": f"w * b_{i}" for i in range(r)}
    return moment_pass(rows, bs, extra, fields)


def _dual_blocks(controls, kept: np.ndarray, plans, names) -> dict[int, Moments]:
    """``_dual_pass`` of left-out scenarios: each unit row is read once and meets every trial point."""
    r = len(names)
    trials = [(s, *plan[0].trial(), plan[1], plan[2], kept[:, s]) for s, plan in plans.items()]

    def partial(b):
        left = b.column(0).to_numpy(zero_copy_only=False)
        z = np.column_stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(r)])
        out = {}
        for s, q, mu, target, scale, stays in trials:
            rows = (z - target) / scale
            w = np.where(stays[left], mu - rows @ q, 0.0)
            on = w > 0
            if on.any():
                rows, w = rows[on], w[on]
                # [n, sum w, sum w^2 | sum b, sum w b | sum b b']
                out[s] = np.concatenate([[len(w), w.sum(), w @ w], rows.sum(axis=0), w @ rows, (rows.T @ rows).ravel()])
        return out

    rows = controls.select(LEFT, *names)
    return {
        s: Moments(x[0], x[3:3 + r].copy(), x[3 + 2 * r:].reshape(r, r).copy(),
                   {"w": x[1], "ww": x[2]} | {f"wb{i}": x[3 + r + i] for i in range(r)})
        for s, x in block_pass(rows, partial).items()}


def control_moments(
    units: UnitTable, stats: Mapping[int, GroupStats], fields: int | None = None
) -> dict[int, Moments]:
    """Centred second moments over controls of [pre-periods, covariates, post mean].

    One pass that feeds both the time weights and the first unit-weight step. With left-out
    scenarios the moments are taken per left-out cluster about one centre, added up for the
    clusters a scenario keeps and moved to its own mean: each unit is read once.
    """
    names = [*_row_names(units), POST]
    keys = list(stats)
    means = {s: stats[s].mean[0][stats[s].pick(names)] for s in keys}
    data = units.data.filter("treated = 0").selectExpr("*", f"{units.post_mean} AS {POST}")
    if units.groups:
        common = np.mean([means[s] for s in keys], axis=0)
        values = [f"({c} - {float(x)!r}D)" for c, x in zip(names, common, strict=True)]
        parts = moment_pass(data.drop(SCENARIO).withColumnRenamed(LEFT, SCENARIO), values, None, fields)
        members = _members(units, set(parts))
        return {s: Moments.together([parts[c] for c in members[s]]).moved(means[s] - common) for s in keys}
    columns = {SCENARIO: ("int", keys)} | {
        f"c_{i}": ("double", [means[s][i] for s in keys]) for i in range(len(names))
    }
    rows = data.join(driver_table(units.data.sparkSession, columns), SCENARIO)
    values = [f"({c} - c_{i})" for i, c in enumerate(names)]
    return moment_pass(rows, values, None, fields)


# --------------------------------------------------------------------------- time weights


@dataclass
class TimeWeightSolution:
    """Weight of every pre-period (sum 1) and the level shift; post periods weigh 1/n_post."""

    weight: np.ndarray
    shift: float
    unique: bool


def solve_time_weights(
    units: UnitTable, stats: Mapping[int, GroupStats], centred: Mapping[int, Moments]
) -> dict[int, TimeWeightSolution]:
    """Simplex-constrained least squares of the post mean on the pre-periods over controls.

    The problem only needs the (T_pre + 1)^2 centred moments.
    """
    names = [f"y_{k}" for k in units.pre]
    result = {}
    for s, st in stats.items():
        m = centred[s]
        t, last = len(names), len(m.total) - 1
        mean = m.total / m.n  # what is left after centring: rounding only
        gram = m.gram / m.n - np.outer(mean, mean)
        weight, unique = simplex_least_squares(gram[:t, :t], gram[:t, last])
        centre = st.mean[0]
        shift = float(centre[st.pick([POST])[0]] - centre[st.pick(names)] @ weight)
        result[s] = TimeWeightSolution(weight, shift, unique)
    return result


def simplex_least_squares(gram: np.ndarray, cross: np.ndarray) -> tuple[np.ndarray, bool]:
    """argmin 1/2 x'Gx - g'x on the simplex (a few unknowns), by an active-set search.

    On a singular face the minimum-norm solution is taken; the second value tells
    whether the minimiser is unique.
    """
    size = len(cross)
    scale = max(float(np.max(np.abs(np.diag(gram)))), 1e-300)
    g, c = gram / scale, cross / scale
    support = [int(np.argmin(0.5 * np.diag(g) - c))]
    x = np.zeros(size)
    x[support] = 1.0
    for _ in range(100 * size + 100):
        best = _face_minimum(g, c, support)
        if np.all(best >= -1e-14):
            x[:] = 0.0
            x[support] = np.maximum(best, 0.0)
            slope = g @ x - c
            level = slope[support] @ x[support]
            outside = [k for k in range(size) if k not in support]
            worst = min(outside, key=lambda k: slope[k], default=None)
            if worst is None or slope[worst] >= level - 1e-12:
                break
            support.append(worst)
        else:
            here = x[support]
            falling = best < 0
            limit = here[falling] / (here[falling] - best[falling])
            here = here + float(np.min(limit)) * (best - here)
            gone = int(np.flatnonzero(falling)[np.argmin(limit)])
            x[:] = 0.0
            x[support] = np.maximum(here, 0.0)
            x[support[gone]] = 0.0
            del support[gone]
    else:
        raise WeightError("the active-set search for weights on the simplex did not end")
    x /= x.sum()
    tied = g @ x - c
    face = [k for k in range(size) if tied[k] <= tied @ x + 1e-10]
    block = g[np.ix_(face, face)]
    step = np.eye(len(face)) - 1.0 / len(face)
    unique = len(face) < 2 or np.linalg.matrix_rank(step @ block @ step, tol=1e-12) >= len(face) - 1
    return x, bool(unique)


def _face_minimum(g: np.ndarray, c: np.ndarray, support: list[int]) -> np.ndarray:
    n = len(support)
    kkt = np.ones((n + 1, n + 1))
    kkt[:n, :n] = g[np.ix_(support, support)]
    kkt[n, n] = 0.0
    return np.linalg.lstsq(kkt, np.append(c[support], 1.0), rcond=1e-14)[0][:n]
