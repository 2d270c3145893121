"""A two-dimensional neighbour layout: fuzzy nearest-neighbour graph, then attraction along it and sampled repulsion.

The layout is fitted on a bounded sample of the rows; every other row is put at the weighted mean of its nearest sample
rows, so any number of rows is placed in one pass against a table of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, NEIGHBOURS, EPOCHS, NEGATIVES, SEED = 1500, 15, 150, 5, 42
# The curve that a least distance of 0.1 gives.
A, B = 1.577, 0.895


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def weights(d: np.ndarray, k: int) -> np.ndarray:
    """Membership of each row's k nearest (columns, by distance): 1 for the nearest, summing to log2(k)."""
    rho, target = d[:, :1], np.log2(k)
    lo, hi = np.full(len(d), 1e-6), np.full(len(d), 1e3)
    for _ in range(50):
        mid = (lo + hi) / 2
        s = np.exp(-np.maximum(d - rho, 0) / mid[:, None]).sum(1)
        hi, lo = np.where(s > target, mid, hi), np.where(s > target, lo, mid)
    return np.exp(-np.maximum(d - rho, 0) / ((lo + hi) / 2)[:, None])


def fit(x: np.ndarray, k: int = NEIGHBOURS, epochs: int = EPOCHS) -> np.ndarray:
    """Places of the rows of x in the plane, by cosine distance."""
    u, n = _unit(x), len(x)
    k = min(k, n - 1)
    if k < 2:
        return np.zeros((n, 2))
    d = 1 - u @ u.T
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    w = np.zeros((n, n))
    np.put_along_axis(w, near, weights(np.take_along_axis(d, near, 1), k), 1)
    w = w + w.T - w * w.T
    i, j = np.nonzero(w)
    strength, rng = w[i, j], np.random.default_rng(SEED)
    c = x - x.mean(0)
    y = c @ np.linalg.svd(c, full_matrices=False)[2][:2].T
    y = 10 * y / max(np.abs(y).max(), 1e-12) + rng.normal(0, 1e-3, (n, 2))
    for epoch in range(epochs):
        rate = 1 - epoch / epochs
        own = rng.random(len(i)) < strength / strength.max()
        a, b = i[own], j[own]
        diff = y[a] - y[b]
        sq = (diff**2).sum(1, keepdims=True)
        pull = np.clip(-2 * A * B * sq ** (B - 1) / (1 + A * sq**B) * diff, -4, 4) if len(a) else diff
        move = np.zeros_like(y)
        np.add.at(move, a, np.nan_to_num(pull))
        for _ in range(NEGATIVES):
            o = rng.integers(0, n, len(a))
            diff = y[a] - y[o]
            sq = (diff**2).sum(1, keepdims=True)
            np.add.at(move, a, np.where((a != o)[:, None], np.clip(2 * B / ((0.001 + sq) * (1 + A * sq**B)) * diff, -4, 4), 0))
        y = y + rate * move / max(1.0, len(a) / n)
    return y


def neighbour_layout(df: DataFrame, key: str, vector: str, sample: int = SAMPLE) -> DataFrame:
    """(key, x, y) of every row with a vector; at most `sample` rows are gathered to fit the layout."""
    rows = df.where(F.col(vector).isNotNull())
    chosen = rows.orderBy(F.md5(F.concat(F.lit(f"{SEED}-"), F.col(key).cast("string"))), key).limit(sample).select(key, vector).collect()
    base = np.array([r[vector] for r in chosen], float)
    places, known, keys = fit(base) if len(base) else np.zeros((0, 2)), _unit(base) if len(base) else base, {r[key]: i for i, r in enumerate(chosen)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            d = 1 - _unit(np.stack([np.asarray(v, float) for v in pdf[vector]])) @ known.T
            k = min(NEIGHBOURS, len(known))
            near = np.argsort(d, axis=1, kind="stable")[:, :k]
            w = weights(np.take_along_axis(d, near, 1), max(k, 2)) + 1e-12
            y = (w[..., None] * places[near]).sum(1) / w.sum(1, keepdims=True)
            own = [keys.get(i, -1) for i in pdf[key]]
            y = np.where(np.array(own)[:, None] >= 0, places[own], y)
            yield pd.DataFrame({key: pdf[key], "x": y[:, 0], "y": y[:, 1]})

    return rows.select(key, vector).mapInPandas(run, f"{key} long, x double, y double")
