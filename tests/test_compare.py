"""Tests of two groups by distributed statistics against the same tests on gathered samples."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import kernels as K
from tessera.functions.columns import normal_quantile
from tessera.operators import compare as T
from tessera.operators import describe as D

SAMPLES = {
    "normal": (np.random.default_rng(1).normal(size=40), np.random.default_rng(2).normal(0.4, 1, size=35)),
    "skewed": (np.random.default_rng(3).gamma(1, 2, size=60), np.random.default_rng(4).gamma(1, 3, size=50)),
    "ties": (np.repeat([1.0, 2.0, 3.0], 7), np.repeat([2.0, 3.0, 4.0], 5)),
    "small": (np.array([3.0, 1.0, 2.5]), np.array([9.0, 8.0, 12.0, 7.5])),
    "constant": (np.full(4, 2.0), np.full(5, 2.0)),
    "one": (np.array([1.0]), np.array([2.0, 3.0])),
    "alone": (np.array([1.0, 4.0]), np.zeros(0)),
    "long": (np.random.default_rng(5).normal(size=5200), np.random.default_rng(6).normal(0.02, 1, size=300)),
}


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rows = [(k, "one", side, float(v)) for k, both in SAMPLES.items() for side, x in zip("ab", both) for v in x]
    rows += [("small", "one", "c", 1.0), ("small", "one", "a", None), (None, None, "a", 1.0), (None, None, "a", 2.0), (None, None, "b", 5.0), (None, None, "b", 4.0)]
    path = f"{tmp_path_factory.mktemp('compare')}/t"
    spark.createDataFrame(rows, "cell string, second string, side string, x double").repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("many", [1, 8])
def test_two_groups(spark, table, many, monkeypatch):
    monkeypatch.setattr(T, "buckets", lambda s: many)
    got = {r["cell"]: r.asDict() for r in T.two_group_tests(table, ["cell", "second"], "side", "a", "b", "x").collect()}
    assert set(got) == {*SAMPLES, None}
    for k, (a, b) in {**SAMPLES, None: (np.array([1.0, 2.0]), np.array([5.0, 4.0]))}.items():
        want = K.two_group_test(a, b)
        for c, v in want.items():
            v = None if isinstance(v, float) and math.isnan(v) else v
            assert got[k][c] == (pytest.approx(v, abs=1e-9) if isinstance(v, float) else v), (k, c)


def test_medians_and_normal_plot(spark, table):
    got = {(r["cell"], r["side"]): r["m"] for r in T.medians(table.where("x is not null"), ["cell", "side"], "x", "m").collect()}
    for k, both in SAMPLES.items():
        for side, x in zip("ab", both):
            assert not len(x) or got[k, side] == pytest.approx(np.median(x)) or k == "small"
    rows = T.normal_plot(table, ["cell", "side"], "x").where("cell = 'ties' and side = 'b'").collect()
    n = 15
    at = [1 - 0.5 ** (1 / n), *[(i - 0.3175) / (n + 0.365) for i in range(2, n)], 0.5 ** (1 / n)]
    assert sorted((r["x"], round(r["theoretical"], 9)) for r in rows) == [(x, round(NormalDist().inv_cdf(p), 9)) for x, p in zip(sorted(SAMPLES["ties"][1]), at)]
    assert T.normal_plot(table, ["cell", "side"], "x").where("cell = 'alone'").count() == 0


def test_normal_quantile(spark):
    p = [1e-300, 1e-20, 1e-9, 0.001, 0.075, 0.0751, 0.3, 0.5, 0.7, 0.925, 0.999, 1 - 1e-12]
    df = spark.createDataFrame([(x,) for x in [*p, 0.0, 1.0, None]], "p double")
    got = [r["q"] for r in df.select(normal_quantile(F.col("p")).alias("q")).collect()]
    assert got[: len(p)] == pytest.approx([NormalDist().inv_cdf(x) for x in p], rel=1e-9, abs=1e-12) and got[len(p) :] == [None] * 3


def test_cells_of_many_buckets_equal_one(spark, table):
    rows = table.where("x is not null")
    one, many = (D.value_cells(rows, ["cell"], "x", k).drop("_b").orderBy("cell", "x").collect() for k in (1, 16))
    assert one == many


@pytest.mark.parametrize("many", [1, 8])
def test_quantiles_interpolate(spark, table, many, monkeypatch):
    monkeypatch.setattr(D, "buckets", lambda s: many)
    p = [0.0, 0.01, 0.25, 0.5, 0.975, 1.0]
    got = {(r["cell"], r["side"]): r["q"] for r in D.quantiles(table, ["cell", "side"], "x", p, "q").collect()}
    for k, both in SAMPLES.items():
        for side, x in zip("ab", both):
            assert not len(x) or got[k, side] == pytest.approx(np.quantile(x, p))
    assert got[None, "a"][3] == 1.5
    (whole,) = D.quantiles(table, [], "x", p, "q").collect()
    x = np.concatenate([*[np.concatenate(b) for b in SAMPLES.values()], [1.0, 1.0, 2.0, 5.0, 4.0]])
    assert whole["q"] == pytest.approx(np.quantile(x, p))
