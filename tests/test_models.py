"""Mixed models from class sums against dense likelihoods, their statuses, and draws that are split by partition against plain ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import lme as M
from tessera.operators import resample as R
from tessera.plans import models, registry


def dense(y, x, u, cov, reml=False, z=None):
    """(log-likelihood, beta, error variance) with the whole covariance matrix of all rows."""
    z = np.ones((len(y), 1)) if z is None else z
    v = np.eye(len(y))
    for g in np.unique(u):
        i = np.flatnonzero(u == g)
        v[np.ix_(i, i)] += z[i] @ cov @ z[i].T
    inv = np.linalg.inv(v)
    a = x.T @ inv @ x
    b = np.linalg.solve(a, x.T @ inv @ y)
    r = y - x @ b
    df = len(y) - x.shape[1] if reml else len(y)
    s2 = r @ inv @ r / df
    return -0.5 * (df * np.log(2 * np.pi * s2) + df + np.linalg.slogdet(v)[1] + (np.linalg.slogdet(a)[1] if reml else 0)), b, s2


def table(spark, y, x, u):
    names = [f"x{i}" for i in range(1, x.shape[1])]
    rows = [(int(g), float(r), *map(float, c[1:])) for g, r, c in zip(u, y, x)]
    return spark.createDataFrame(rows, ", ".join(["unit long", "y double", *[f"{n} double" for n in names]])).repartition(3), names


def sums(spark, y, x, u, random=(0,)):
    df, names = table(spark, y, x, u)
    k = x.shape[1]
    return M.collected(M.class_statistics(M.unit_statistics(df, "unit", "y", names), k, random), k, len(random))[()]


def made(seed, slope=True, n=240, units=20):
    rng = np.random.default_rng(seed)
    u = rng.integers(0, units, n)
    x = np.column_stack([np.ones(n), (rng.random(n) < 0.5) * 1.0, rng.normal(size=n)])
    b = rng.normal(size=(units, 2)) @ np.array([[1.0, 0.3], [0, 0.8]])
    return 1 + 0.5 * x[:, 2] + x[:, 1] + b[u, 0] + slope * b[u, 1] * x[:, 1] + rng.normal(size=n), x, u


def test_likelihoods_equal_dense_ones(spark):
    y, x, u = made(1)
    s = sums(spark, y, x, u, (0, 1))
    assert len(s.zz) <= 20 and s.units.sum() == 20
    for reml in (False, True):
        for cov in (np.array([[0.7]]), np.array([[0.0]]), np.array([[0.7, 0.2], [0.2, 0.5]])):
            q = len(cov)
            ll, beta, _, s2, _ = (v[0] for v in M.profiles(cov[None], s.taken([0, 1, 2], q), reml))
            want = dense(y, x, u, cov, reml, x[:, :q])
            assert (ll, s2) == (pytest.approx(want[0], rel=1e-10), pytest.approx(want[2], rel=1e-8)) and beta == pytest.approx(want[1], abs=1e-8)


@pytest.mark.parametrize("reml", [False, True])
def test_fits_are_at_the_top_of_the_dense_likelihood(spark, reml):
    y, x, u = made(2)
    s = sums(spark, y, x, u, (0, 1))
    one, two = M.fit(s, [0, 1, 2], reml), M.fit(s, [0, 1, 2], reml, 2)
    assert one.status == two.status == "ok" and (one.k_params, two.k_params) == (5, 7) and two.loglik > one.loglik
    for f, z in ((one, x[:, :1]), (two, x[:, :2])):
        cov = f.var_random / f.var_error
        top = dense(y, x, u, cov, reml, z)[0]
        assert f.loglik == pytest.approx(top, rel=1e-9)
        rng = np.random.default_rng(0)
        for size in (1e-3, 1e-2, 0.1):
            for _ in range(10):
                d = rng.normal(size=cov.shape) * size
                other = cov + d + d.T
                if np.linalg.eigvalsh(other)[0] > 0:
                    assert dense(y, x, u, other, reml, z)[0] <= top + 1e-6
    assert M.likelihood_ratio(one, two)[1] == 2 and M.likelihood_ratio(two, one) == (0.0, 1, 1.0)


def test_statuses(spark):
    y, x, u = made(3, slope=False)
    between = np.column_stack([x[:, 0], u % 2 * 1.0, x[:, 2]])
    assert M.fit(sums(spark, y, x, u), [0, 1, 2]).status == "ok"
    slope = M.fit(sums(spark, y, between, u, (0, 1)), [0, 1, 2], q=2)  # constant within units
    assert slope.status == "singular" and slope.retried and np.isfinite(slope.loglik)
    assert np.isnan(M.likelihood_ratio(M.fit(sums(spark, y, x, u), [0]), slope)[0])
    flat = y - np.array([y[u == g].mean() for g in range(20)])[u] * 0.99
    none = M.fit(sums(spark, flat, between, u, (0, 1)), [0, 1, 2])
    assert none.status == "boundary" and none.var_unit <= M.TINY and none.retried and none.usable
    assert M.fit(sums(spark, flat, between, u, (0, 1)), [0, 1, 2], q=2).status == "boundary"
    assert M.fit(sums(spark, np.full(240, 2.5), x, u), [0, 1, 2]).status == "no_variance"
    double = np.column_stack([x[:, 0], x[:, 1], 2 * x[:, 1]])
    assert M.fit(sums(spark, y, double, u), [0, 1, 2]).status == "failed: singular design"
    assert M.fit(sums(spark, y[:2], x[:2], u[:2]), [0, 1]).status.startswith("failed")
    nothing = M.from_columns({c: np.zeros(0) for c in ("units", "zz_0_0", "s_0_0", "s_0_1", "s_1_1", "c_0_0_0_0", "c_0_0_0_1", "c_0_0_1_1")}, 1, 1)
    failed = M.fit(nothing, [0])
    assert failed.status == "failed: no rows" and np.isnan(M.icc(failed)) and np.isnan(M.wald(failed, np.ones(1))[0]) and np.isnan(M.nakagawa(failed, nothing, [0])[0])


def test_small_variances_are_looked_for_again(spark):
    rng = np.random.default_rng(8)
    u = np.repeat(np.arange(400), 30)
    x = np.ones((len(u), 1))
    y = 0.05 * rng.normal(size=400)[u] + rng.normal(size=len(u))
    f = M.fit(sums(spark, y, x, u), [0])
    assert f.retried and f.status == "ok" and 0 < f.var_unit < 0.005
    best = max(dense_null(y, u, t) for t in np.linspace(0, 0.01, 400))
    assert f.loglik >= best - 1e-6


def dense_null(y, u, t):
    """The null model's log-likelihood for units of one size, in closed form."""
    n, m = len(y), np.bincount(u)[0]
    means = np.bincount(u, y) / m
    within = ((y - means[u]) ** 2).sum()
    s2 = (within + m * ((means - y.mean()) ** 2).sum() / (1 + m * t)) / n
    return -0.5 * (n * np.log(2 * np.pi * s2) + n + len(means) * np.log1p(m * t))


def test_sequence_of_models(spark):
    y, x, u = made(5)
    wide = np.column_stack([np.ones(240), u % 2, u // 2 % 2, (u % 2) * (u // 2 % 2), x[:, 1]]).astype(float)
    m = M.build_models(sums(spark, y, wide, u, (0, 1)), 1)
    rows = list(m.comparisons())
    assert [r[:2] for r in rows] == list(zip(M.SEQUENCE, M.SEQUENCE[1:]))
    assert [r[7] for r in rows] == [2, 1, 1, 0 if m.fits["random_slope"].status == "singular" else 2]
    f = m.fits["extended"]
    fitted = wide @ f.beta
    got = m.effects()
    assert got[4] == pytest.approx(fitted.var() / (fitted.var() + f.var_unit + f.var_error))
    assert f.aic == pytest.approx(2 * 7 - 2 * f.loglik) and f.bic == pytest.approx(7 * np.log(240) - 2 * f.loglik)
    assert len([c for c in m.coefficients() if c[0] == "extended"]) == 5


def test_replicates_equal_copied_rows(spark):
    """A replicate's sums, made by weights, fit as its rows copied into units of their own do."""
    y, x, u = made(6, slope=False, n=60, units=6)
    w = np.array([2, 0, 1, 1, 2, 0])
    df, names = table(spark, y, x, u)
    rows, by, add = M.unit_products(M.unit_statistics(df, "unit", "y", names), 3)
    pdf = rows.toPandas()
    times = w[pdf["unit"].to_numpy()]
    a = M.from_columns({c: pdf[c].to_numpy() * (times if c in add else 1) for c in (*by, *add)}, 3, 1)
    pick = np.concatenate([np.flatnonzero(u == i) for i, k in enumerate(w) for _ in range(k)])
    new = np.concatenate([np.full((u == i).sum(), 10 * i + j) for i, k in enumerate(w) for j in range(k)])
    b = sums(spark, y[pick], x[pick], new)
    fa, fb = M.fit(a, [0, 1, 2]), M.fit(b, [0, 1, 2])
    assert fa.beta == pytest.approx(fb.beta) and fa.loglik == pytest.approx(fb.loglik)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 7)
    monkeypatch.setattr(R, "LEAST", 10)
    monkeypatch.setattr(R, "HELD", 3000)


def drawn(spark, n=200, units=60, **more):
    rows = [(i, "ab"[i % 2], i % 5 if i % 7 else None, "xy"[k], float(i), 1.0) for i in range(units) for k in range(1 + i % 2)]
    df = spark.createDataFrame(rows, "unit long, side string, size long, kind string, v double, one double").repartition(4)
    return df, R.resampled_sums(df, "unit", n=n, seed=3, **more)


def test_split_draws_are_multinomial(spark, small_blocks):
    _, got = drawn(spark, n=600, groups=["unit"], values=["one"])
    w = np.zeros((600, 60))
    for r in got.collect():
        w[r["b"], r["unit"]] = r["one"] / (1 + r["unit"] % 2)
    assert (w == np.round(w)).all() and (w.sum(1) == 60).all()
    assert abs(w.mean(0) - 1).max() < 0.25 and abs(w.var() - (1 - 1 / 60)) < 0.05
    pairs = np.cov(w.T)[~np.eye(60, dtype=bool)]
    assert abs(pairs.mean() + 1 / 60) < 0.005 and abs(np.bincount(w.astype(int).ravel(), minlength=4)[:4] / w.size - [0.365, 0.371, 0.186, 0.061]).max() < 0.02


def test_split_draws_keep_rows_of_a_unit_together(spark, small_blocks):
    df, got = drawn(spark, groups=["kind", "size"], values=["v", "one"])
    again = R.resampled_sums(df.repartition(2), "unit", ["kind", "size"], ["v", "one"], 200, 3)
    order = ["b", "kind", "size"]
    assert got.orderBy(*order).collect() == again.orderBy(*order).collect()
    per = R.resampled_sums(df, "unit", ["unit", "kind"], ["one"], 200, 3).toPandas().pivot_table(index=["b", "unit"], columns="kind", values="one").reset_index()
    odd = per[per["unit"] % 2 == 1]
    assert len(odd) and (odd["x"] == odd["y"]).all()
    sizes = got.groupBy("b").agg(F.sum("one").alias("n")).collect()
    assert len(sizes) == 200


def test_split_draws_within_strata(spark, small_blocks):
    _, got = drawn(spark, groups=["side", "unit"], values=["one"], stratum=["side"])
    own = got.where("unit % 2 = 0").groupBy("b").agg(F.sum("one").alias("n")).collect()
    assert {r["n"] for r in own} == {30.0} and len(own) == 200
    assert got.where("side = 'a'").agg(F.max(F.col("unit") % 2)).first()[0] == 0


def test_intervals_of_split_and_plain_draws_agree(spark, small_blocks):
    rng = np.random.default_rng(4)
    x = rng.gamma(2, 3, 300)
    df = spark.createDataFrame([(i, float(v), 1.0) for i, v in enumerate(x)], "unit long, v double, one double")
    got = R.resampled_sums(df, "unit", [], ["v", "one"], 4000, 9).select((F.col("v") / F.col("one")).alias("m")).toPandas()["m"]
    plain = x[rng.integers(0, 300, (4000, 300))].mean(1)
    assert len(got) == 4000 and got.mean() == pytest.approx(plain.mean(), abs=0.03)
    assert np.quantile(got, [0.025, 0.975]) == pytest.approx(np.quantile(plain, [0.025, 0.975]), abs=0.06)


def test_draws_of_empty_and_single_tables(spark):
    empty = spark.createDataFrame([], "unit long, v double")
    assert R.resampled_sums(empty, "unit", [], ["v"], 10, 1).collect() == []
    one = spark.createDataFrame([(1, 2.0)], "unit long, v double")
    assert [r["v"] for r in R.resampled_sums(one, "unit", [], ["v"], 10, 1).collect()] == [2.0] * 10


def test_cluster_bootstrap(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(i, int(rng.integers(0, 40)), ["click", "view", "purchase", "error"][i % 4], int(i), float(np.exp(rng.normal()))) for i in range(800)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, t long, value double")
    df.withColumn("ts", F.timestamp_seconds("t")).write.parquet(f"{tmp_path}/events.parquet")
    assert models.BOOTSTRAPS == 2000
    got = {r["cls"]: r for r in registry.queries()["m13_cluster_bootstrap"](spark, str(tmp_path)).collect()}
    plain = plain_bootstrap(rows, 400)
    for c, r in got.items():
        assert r["n_valid"] == 2000
        assert [r["ci_low"], r["ci_high"]] == pytest.approx(np.quantile(plain[c], [0.025, 0.975]), abs=0.12)
    monkeypatch.setattr(models, "BOOTSTRAPS", 49)
    few = {r["cls"]: r for r in registry.queries()["m13_cluster_bootstrap"](spark, str(tmp_path)).collect()}
    wald = {r["cls"]: r for r in registry.queries()["m12_class_contrasts"](spark, str(tmp_path)).collect()}
    assert all(few[c]["n_valid"] == 49 and few[c]["ci_low"] == wald[c]["ci_low"] for c in wald)


def plain_bootstrap(rows, n):
    """Least squares on units drawn with replacement; the data have no variance between units."""
    rng, out = np.random.default_rng(1), {"click": [], "view": [], "purchase": []}
    own = [(u, c, np.log2(v)) for _, u, c, _, v in rows if c != "error"]
    by = {}
    for u, c, y in own:
        l2 = float(u % 2)
        by.setdefault(u, []).append(([1, l2, float(u // 2 % 2 == 1), c == "view", c == "purchase", l2 * (c == "view"), l2 * (c == "purchase")], y))
    units = sorted(by)
    for _ in range(n):
        pick = [r for u in rng.choice(units, len(units)) for r in by[u]]
        x, y = np.array([r[0] for r in pick], float), np.array([r[1] for r in pick])
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        for c, v in models.CONTRASTS.items():
            out[c].append(float(np.dot(v, beta)))
    return out


def test_lost_classes_give_no_estimate(spark):
    rows = [(u, float(u % 2), float(u == 0), float(np.sin(7 * u + i))) for u in range(4) for i in range(6)]
    stats = M.unit_statistics(spark.createDataFrame(rows, "unit long, a double, b double, y double"), "unit", "y", ["a", "b"])
    got = M.bootstrap(stats, "unit", 3, [0, 1, 2], {"a": [0, 1, 0], "b": [0, 0, 1]}, 200, 5).toPandas()
    lost = got[got["term"] == "b"]["estimate"].isna().mean()
    assert 0.2 < lost < 0.7 and len(got) == 400


@pytest.mark.parametrize(("split", "hashed", "keys"), [("t7_split_draws", "t7_bootstrap_distances", ["a", "b", "measure"]), ("t8_split_draws", "t8_stratified_bootstrap", [])])
def test_split_intervals_are_near_the_hashed_ones(spark, split, hashed, keys):
    from tests.test_oracle import DATA

    got, want = ({tuple(r[k] for k in keys): r for r in registry.queries()[q](spark, str(DATA)).collect()} for q in (split, hashed))
    assert set(got) == set(want)
    for k, r in want.items():
        width = r["ci_high"] - r["ci_low"]
        assert got[k]["n_valid"] == pytest.approx(r["n_valid"], abs=40) and abs(got[k]["mean"] - r["mean"]) < 0.05 * width
        assert abs(got[k]["ci_low"] - r["ci_low"]) < 0.12 * width and abs(got[k]["ci_high"] - r["ci_high"]) < 0.12 * width


def test_permutations_by_thresholds_equal_sorted_ranks(spark, small_blocks, monkeypatch):
    monkeypatch.setattr(R, "REACH", 0.3)  # windows that often miss and are widened
    rng = np.random.default_rng(3)
    rows = [(c, u, rng.normal(size=3).tolist()) for c, m in (("a", 70), ("b", 9), ("c", 2), ("d", 40)) for u in rng.choice(200, m, replace=False).tolist()]
    cells = spark.createDataFrame(rows, "cls string, unit long, v array<double>").repartition(3)
    first = {"a": (30, 70), "b": (8, 9), "c": (1, 2)}
    got = {(r["cls"], r["b"]): r["one"] for r in R.permuted_sums(cells, "cls", "unit", "v", first, 250, 7).collect()}
    ranks = R.permutation_ranks(cells, ["cls"], "unit", 250, 7)
    k = F.when(F.col("cls") == "a", 30).when(F.col("cls") == "b", 8).when(F.col("cls") == "c", 1).otherwise(0)
    own = ranks.where(F.col("rank") <= k).join(cells, ["cls", "unit"]).groupBy("cls", "b").agg(*[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(3)])
    want = {(r["cls"], r["b"]): [r["s0"], r["s1"], r["s2"]] for r in own.collect()}
    assert set(got) == set(want) and len(want) == 750
    assert all(got[x] == pytest.approx(want[x], abs=1e-9) for x in want)
