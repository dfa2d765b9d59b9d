"""Slow, direct versions of the estimators on numpy arrays, for comparison."""

from __future__ import annotations

import itertools

import numpy as np


def demean(y):
    return y - y.mean(1, keepdims=True) - y.mean(0, keepdims=True) + y.mean()


def wls(y, xs, w, intercept=True):
    design = np.column_stack(([np.ones(y.size)] if intercept else []) + [x.ravel() for x in xs])
    root = np.sqrt(w.ravel())
    return np.linalg.lstsq(design * root[:, None], y.ravel() * root, rcond=None)[0][int(intercept):]


def effect(y, d, post, w, z=None, intercept=True):
    treat = np.outer(d, post)
    xs = [demean(treat)] + ([demean(treat * z[:, None])] if z is not None else [])
    return wls(demean(y), xs, w, intercept)


def jackknife(y, d, post, w, groups, z=None, intercept=True):
    """Re-fit without each group; returns the leave-out estimates."""
    out = []
    for g in sorted(set(groups)):
        keep = np.array([x != g for x in groups])
        out.append(effect(y[keep], d[keep], post, w[keep], None if z is None else z[keep], intercept))
    return np.array(out)


def project_simplex(v):
    u = np.sort(v)[::-1]
    css = np.cumsum(u) - 1.0
    k = np.nonzero(u - css / np.arange(1, len(v) + 1) > 0)[0][-1]
    return np.maximum(v - css[k] / (k + 1), 0.0)


def unit_weights(a, b, level, v, eta, steps=200000):
    """Accelerated projected gradient on the primal problem, the shift solved out."""
    b_rows = np.sqrt(v)[:, None] * (a - b[:, None])
    c = np.sqrt(v) * level
    p = np.eye(len(b)) - np.outer(c, c) / (c @ c)
    m = p @ b_rows
    h = m.T @ m + eta * np.eye(a.shape[1])
    step = 1.0 / np.linalg.eigvalsh(h)[-1]
    w = np.full(a.shape[1], 1.0 / a.shape[1])
    look, t = w.copy(), 1.0
    for _ in range(steps):
        new = project_simplex(look - step * (h @ look))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if (look - new) @ (new - w) > 0:
            t_new, look = 1.0, new
        else:
            look = new + (t - 1) / t_new * (new - w)
        if np.max(np.abs(new - w)) < 1e-16:
            w = new
            break
        w, t = new, t_new
    shift = -(c @ (b_rows @ w)) / (c @ c)
    return w, shift


def time_weights(gram, cross):
    """Best feasible point over all supports of a small simplex problem."""
    n, best, arg = len(cross), np.inf, None
    for size in range(1, n + 1):
        for s in itertools.combinations(range(n), size):
            s = list(s)
            kkt = np.ones((size + 1, size + 1))
            kkt[:size, :size] = gram[np.ix_(s, s)]
            kkt[size, size] = 0
            x = np.linalg.lstsq(kkt, np.append(cross[s], 1.0), rcond=None)[0][:size]
            if np.all(x >= -1e-12):
                full = np.zeros(n)
                full[s] = x
                value = 0.5 * full @ gram @ full - cross @ full
                if value < best:
                    best, arg = value, full
    return arg, best
