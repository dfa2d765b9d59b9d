"""Small hand-made panels."""

from __future__ import annotations

import numpy as np


def arrays(n=8, t=5, n_treated=3, seed=1, spread=1.0, clusters=4, far=0.0):
    rng = np.random.default_rng(seed)
    level = 10 + spread * rng.normal(size=(n, 1))
    y = level + np.linspace(0, 2, t) + rng.normal(size=(n, t))
    d = np.array([1.0] * n_treated + [0.0] * (n - n_treated))
    x = rng.normal(size=(n, 2)) + 3.0 + far * d[:, None]
    group = np.array([f"c{k % clusters}" for k in range(n)])
    return y, d, x, group


def frame(spark, y, d, x, group, first=2001):
    rows = [
        (int(i), int(first + k), float(y[i, k]), float(d[i]), str(group[i]), float(x[i, 0]), float(x[i, 1]))
        for i in range(y.shape[0])
        for k in range(y.shape[1])
    ]
    return spark.createDataFrame(
        rows, "unit long, time int, outcome double, treated double, cluster string, x1 double, x2 double")
