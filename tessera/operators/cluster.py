"""Hierarchical clusters of class centroids and units, and matrix comparison by relabelling.

A tree has as many leaves as there are classes or units, so each is grown within one group's task; what comes before, the
centroids, is distributed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from .classify import adjusted_rand
from .describe import average_ranks
from .resample import permutation_ranks
from .vectors import beside_all, mean_vectors, own_classes


def _distances(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(-1), 0))


def _per_group(df: DataFrame, keys: list[str], label: str, vector: str, schema: str, f) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(label, ignore_index=True)
        rows = f(pdf[label].tolist(), np.stack([np.asarray(v, float) for v in pdf[vector]]))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")][len(keys) :])
        for i, k in enumerate(keys):
            out.insert(i, k, pdf[k].iloc[0])
        return out

    return df.select(*keys, label, vector).groupBy(*keys).applyInPandas(run, schema)


def _typed(df: DataFrame, keys: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"{k} {kinds[k]}" for k in keys)


def trees(df: DataFrame, keys: list[str], label: str, vector: str, method: str) -> DataFrame:
    """(keys, step, left, right, height, size); leaves are numbered in label order."""

    def f(labels: list, x: np.ndarray) -> list[tuple]:
        return [(i, int(a), int(b), float(h), int(n)) for i, (a, b, h, n) in enumerate(K.linkage(_distances(x), method))]

    return _per_group(df, keys, label, vector, f"{_typed(df, keys)}, step int, left int, right int, height double, size int", f)


def assignments(df: DataFrame, keys: list[str], label: str, vector: str, method: str, k: int) -> DataFrame:
    """(keys, label, cluster): clusters carry the place of their first label."""

    def f(labels: list, x: np.ndarray) -> list[tuple]:
        return list(zip(labels, K.cut(K.linkage(_distances(x), method), k).tolist(), strict=True))

    return _per_group(df, keys, label, vector, f"{_typed(df, [*keys, label])}, cluster long", f)


def silhouettes(df: DataFrame, keys: list[str], label: str, vector: str, method: str, ks: range) -> DataFrame:
    def f(labels: list, x: np.ndarray) -> list[tuple]:
        d = _distances(x)
        tree = K.linkage(d, method)
        return [(k, K.silhouette(d, K.cut(tree, k))) for k in ks]

    return _per_group(df, keys, label, vector, f"{_typed(df, keys)}, k int, silhouette double", f)


def chosen_k(df: DataFrame, keys: list[str], label: str, vector: str, method: str, ks: range) -> DataFrame:
    """The k of the best silhouette (2 if none is valid) and the k before the largest step of the tree."""

    def f(labels: list, x: np.ndarray) -> list[tuple]:
        d = _distances(x)
        tree = K.linkage(d, method)
        s = {k: v for k in ks if not math.isnan(v := K.silhouette(d, K.cut(tree, k)))}
        return [(max(s, key=lambda k: (s[k], -k)) if s else 2, K.elbow(tree, ks))]

    return _per_group(df, keys, label, vector, f"{_typed(df, keys)}, k_silhouette int, k_elbow int", f)


def unit_vectors(df: DataFrame, unit: str, cls: str, vector: str) -> DataFrame:
    """One vector per unit: its classes' mean vectors one after another, a missing cell filled with the class's mean."""
    own = own_classes(mean_vectors(df, [unit, cls], F.col(vector), "own"), unit, cls, "_own")
    cells = beside_all(own, mean_vectors(df, [cls], F.col(vector), "all"), "all", "_all")
    return cells.select(unit, F.flatten(F.transform("_all", lambda t: F.coalesce(F.try_element_at("_own", t[cls])["own"], t["all"]))).alias("vector"))


def unit_clusters(df: DataFrame, unit: str, cls: str, vector: str, truth: str, k: int) -> DataFrame:
    """Agreement of the units' clusters with a property of theirs."""
    v = unit_vectors(df, unit, cls, vector).withColumn("all_units", F.lit("all"))
    got = assignments(v, ["all_units"], unit, "vector", "ward", k)
    known = df.groupBy(unit).agg(F.first(truth).alias(truth))
    return adjusted_rand(got.join(known, unit), "cluster", truth)


def mantel(d1: DataFrame, d2: DataFrame, n: int, seed: int) -> DataFrame:
    """(r, p_value) of two matrices in long form (a, b, d; both directions): rank correlation over pairs, one-sided against relabelled copies.

    The labels are classes; a replicate's pairs of them are one task's work."""
    labels = d1.select("a").distinct()
    places = labels.withColumn("place", F.row_number().over(Window.orderBy("a")))
    drawn = permutation_ranks(labels, [], "a", n, seed)
    own = drawn.select("b", "a", F.col("rank").alias("place")).unionByName(places.select(F.lit(-1).cast("long").alias("b"), "a", "place"))
    to = own.withColumnRenamed("a", "src").join(places.withColumnRenamed("a", "dst"), "place").select(F.col("b").alias("rep"), "src", "dst")
    x, y = to.toDF("rep", "sa", "da"), to.toDF("rep", "sb", "db")
    first = d1.where("a < b").toDF("da", "db", "u")
    second = d2.toDF("sa", "sb", "v")
    both = first.join(x, "da").join(y, ["rep", "db"]).join(second, ["sa", "sb"]).select("rep", "u", "v")
    ranked = average_ranks(average_ranks(both, "u", ["rep"], "ru"), "v", ["rep"], "rv")
    r = ranked.groupBy("rep").agg(F.round(F.corr("ru", "rv"), 9).alias("r"))
    observed = r.where("rep = -1").select(F.col("r").alias("observed"))
    above = r.crossJoin(F.broadcast(observed)).agg(F.first("observed").alias("r"), F.sum(((F.col("rep") >= 0) & (F.col("r") >= F.col("observed"))).cast("long")).alias("k"))
    return above.select("r", ((F.col("k") + 1) / F.lit(float(n + 1))).alias("p_value"))
