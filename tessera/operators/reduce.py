"""Principal components from one pass of sums."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def covariance(df: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, covariance, rows). Tasks send one matrix per batch of rows, and these are added; the width bounds all."""
    import pandas as pd

    def partial(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack([np.asarray(v, float) for v in pdf[vector]])
                yield pd.DataFrame({"k": [0], "n": [len(x)], "s": [x.sum(0)], "q": [(x.T @ x).ravel()]})

    parts = df.select(vector).where(F.col(vector).isNotNull()).mapInPandas(partial, "k int, n long, s array<double>, q array<double>")
    add = parts.select("n", F.posexplode(F.concat("s", "q")).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    rows = add.orderBy("i").collect()
    n = rows[0]["n"]
    flat = np.array([r["x"] for r in rows])
    d = int((np.sqrt(4 * len(flat) + 1) - 1) / 2)
    mean = flat[:d] / n
    return mean, (flat[d:].reshape(d, d) - n * np.outer(mean, mean)) / (n - 1), n


def principal_components(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(key, component, score, explained): centred scores; each axis has its largest loading positive."""
    mean, cov, _ = covariance(df, vector)
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    axes = axes[:, order] * np.sign(axes[np.abs(axes[:, order]).argmax(0), order])
    share = values[order] / values.sum()

    def score(batches):
        import pandas as pd

        for pdf in batches:
            if not len(pdf):
                continue
            x = (np.stack([np.asarray(v, float) for v in pdf[vector]]) - mean) @ axes
            yield pd.DataFrame({key: np.repeat(pdf[key].to_numpy(), k), "component": np.tile(np.arange(1, k + 1), len(x)), "score": x.ravel(), "explained": np.tile(share, len(x))})

    return df.select(key, vector).where(F.col(vector).isNotNull()).mapInPandas(score, f"{key} long, component int, score double, explained double")
