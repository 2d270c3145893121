"""Queries of the mixed models, with oracle SQL for the sums that they start from and for the likelihood."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lme as M
from ..operators import resample as R
from ..operators.reduce import principal_components
from .roles import TOK_SQL, finite_tokens, frame, rounded, tokens, vectors

QUERIES, ORACLES = {}, {}
BOOTSTRAPS, LEAST_VALID = 2000, 50
ROPE = (-0.5, 0.5)
#: Columns of the design behind the intercept.
DESIGN = {"l2": "status = 'L2'", "male": "gender = 'M'", "both": "status = 'L2' and gender = 'M'", "c2": "cls = 'view'", "c3": "cls = 'purchase'"}
EXTRA, K = 2, 6


def query(name: str, sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(f(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return add


def designed(t: DataFrame, columns: dict[str, str], *others) -> DataFrame:
    return t.select("unit", *others, *[F.expr(f"cast({e} as double)").alias(k) for k, e in columns.items()])


def response_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Units' sums of both responses at once."""
    t = designed(finite_tokens(spark, d), DESIGN, "f1", "f2").unpivot(["unit", *DESIGN], ["f1", "f2"], "response", "y")
    return M.unit_statistics(t, "unit", "y", list(DESIGN), ["response"])


def all_models(spark: SparkSession, d: str) -> dict[str, M.Models]:
    classes = M.class_statistics(response_statistics(spark, d), K, (0, 1), ["response"])
    return {key[0]: M.build_models(s, EXTRA) for key, s in M.collected(classes, K, 2, ["response"]).items()}


UNITS = f"""WITH {TOK_SQL}, x AS (SELECT unit, f2 AS y, (status = 'L2')::INT AS l2 FROM tok WHERE f2 IS NOT NULL),
 u AS (SELECT unit, count(*) AS n, sum(l2)::BIGINT AS nl, sum(y) AS sy, sum(l2 * y) AS ly, sum(y * y) AS yy FROM x GROUP BY unit)"""


@query("m2_unit_statistics", f"{UNITS} SELECT unit, n, round(yy, 6) AS yy, round(ly, 6) AS ly, round(sy, 6) AS y FROM u")
def m2(spark, d):
    own = M.unit_statistics(designed(tokens(spark, d), DESIGN, "f2"), "unit", "f2", list(DESIGN))
    return own.select("unit", "n", "yy", F.col("xy_1").alias("ly"), F.col("xy_0").alias("y"))


@query("m2_class_statistics", f"{UNITS} SELECT n::DOUBLE AS size, nl::DOUBLE AS group_rows, count(*)::DOUBLE AS units, round(sum(sy), 3) AS y, round(sum(yy), 3) AS yy, round(sum(n * sy), 3) AS ny, round(sum(sy * sy), 3) AS y_y, round(sum(n * ly), 3) AS n_ly FROM u GROUP BY n, nl")
def m2_classes(spark, d):
    """Sums over the units of the same size and the same number of rows in the group: all that a likelihood needs."""
    own = M.unit_statistics(designed(tokens(spark, d), DESIGN, "f2"), "unit", "f2", list(DESIGN))
    names = {"zz_0_0": "size", "zz_0_1": "group_rows", "units": "units", f"s_0_{K}": "y", f"s_{K}_{K}": "yy", f"c_0_0_0_{K}": "ny", f"c_0_0_{K}_{K}": "y_y", f"c_0_1_0_{K}": "n_ly"}
    got = M.class_statistics(own, K, (0, 1))
    return got.select(*[(F.col(c) if c in ("zz_0_0", "zz_0_1", "units") else F.round(c, 3)).alias(n) for c, n in names.items()])


RATIOS = [i / 20 for i in range(21)]


@query("m3_profile_likelihood", f"""{UNITS}, r AS (SELECT i / 20.0::DOUBLE AS ratio FROM range(21) t(i)), c AS (SELECT ratio, n, sy, yy, ratio / (1 + n * ratio) AS c FROM u, r),
 a AS (SELECT ratio, sum(n - c * n * n) AS a, sum(sy - c * n * sy) AS b, sum(yy - c * sy * sy) AS y, sum(ln(1 + n * ratio)) AS d, sum(n) AS n FROM c GROUP BY ratio)
 SELECT ratio, round(b / a, 6) AS mean, round((y - b * b / a) / n, 6) AS var_error, round(-0.5 * (n * ln(2 * pi() * (y - b * b / a) / n) + n + d), 4) AS loglik FROM a""")
def m3_profile(spark, d):
    """The null model at given ratios of the units' variance to the error's: its mean, error variance and log-likelihood."""
    own = M.unit_statistics(tokens(spark, d).select("unit", "f2"), "unit", "f2", [])
    s = M.collected(M.class_statistics(own, 1), 1)[()]
    rows = [(r, float(b[0]), float(v), round(float(ll), 4)) for r in RATIOS for ll, b, _, v, _ in [[x[0] for x in M.profiles(np.array([[[r]]]), s)]]]
    return spark.createDataFrame(rows, "ratio double, mean double, var_error double, loglik double")  # NaN of infinite values stays NaN


@query("m3_information_criteria")
def m3(spark, d):
    rows = [(y, name, f.status, f.k_params, f.n, f.loglik, f.aic, f.bic) for y, m in all_models(spark, d).items() for name, f in m.fits.items()]
    return frame(spark, rows, "response string, model string, status string, k int, n int, loglik double, aic double, bic double")


@query("m4_model_comparison")
def m4(spark, d):
    """Each model of the sequence (null, main, full, extended, random slope) against the one before it."""
    rows = [(y, *r) for y, m in all_models(spark, d).items() for r in m.comparisons()]
    return frame(spark, rows, "response string, small string, large string, status_small string, status_large string, loglik_small double, loglik_large double, chi2 double, df int, p_value double, aic_small double, aic_large double, bic_small double, bic_large double")


@query("m5_explained_variance")
def m5(spark, d):
    rows = [(y, k, *M.nakagawa(m.fits[k], m.s, M.designs(EXTRA)[k][0]), M.icc(m.fits["null"])) for y, m in all_models(spark, d).items() for k in ("null", "main", "full", "extended")]
    return frame(spark, rows, "response string, model string, r2_marginal double, r2_conditional double, icc double")


@query("m7_coefficients")
def m7(spark, d):
    rows = [(y, *r) for y, m in all_models(spark, d).items() for r in m.coefficients()]
    return frame(spark, rows, "response string, model string, term string, estimate double, se double, z double, p_value double, ci_low double, ci_high double")


EFFECTS = "r2m_main double, r2c_main double, r2m_full double, r2c_full double, r2m_extended double, r2c_extended double, r2m_group_partial double, icc double, group_estimate double, group_se double, group_ci_low double, group_ci_high double"


@query("m8_partial_r2")
def m8(spark, d):
    """Explained variance along the sequence; the group's part is what the extended model loses without its term, the interaction staying in."""
    return frame(spark, [(y, *m.effects()) for y, m in all_models(spark, d).items()], f"response string, {EFFECTS}")


@query("m9_interaction")
def m9(spark, d):
    rows = [(y, m.fits["full"].status, *r[1:]) for y, m in all_models(spark, d).items() for r in m.coefficients() if r[:2] == ("full", "group:second")]
    return frame(spark, rows, "response string, status string, term string, estimate double, se double, z double, p_value double, ci_low double, ci_high double")


@query("m10_class_icc")
def m10(spark, d):
    """Intraclass correlation of single classes, by restricted likelihood; classes with fewer than ten rows have none."""
    own = M.unit_statistics(finite_tokens(spark, d).select("cls", "unit", "f2"), "unit", "f2", [], ["cls"])
    rows = []
    for (cls,), s in M.collected(M.class_statistics(own, 1, keys=["cls"]), 1, 1, ["cls"]).items():
        f = M.fit(s, [0], reml=True) if s.n[0] >= 10 else M.Fit("insufficient_data", n=int(s.n[0]))
        rows.append((cls, f.status, f.n, int(s.units.sum()), f.var_unit, f.var_error, M.icc(f)))
    return frame(spark, rows, "cls string, status string, n int, n_units int, var_unit double, var_error double, icc double")


COMPONENTS = 5


@query("m11_component_models")
def m11(spark, d):
    """The whole sequence for each of the first principal components, z-scored; then its measures' plain mean over the components, and
    their sum weighted by explained variance, to which a component without a value adds nothing."""
    v = vectors(spark, d)
    pcs = principal_components(v, "vec_id", "v", COMPONENTS)
    z = pcs.groupBy("component").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s"), F.max("explained").alias("share"))
    male, view, purchase = "cast(unit div 2 % 2 = 1 as double)", "cast(cls % 3 = 1 as double)", "cast(cls % 3 = 2 as double)"
    rows = pcs.join(F.broadcast(z), "component").join(v.select("vec_id", "unit", "status", "cls"), "vec_id")  # z: COMPONENTS rows
    l2 = F.col("status") == "L2"
    long = rows.select("component", "unit", l2.cast("double").alias("l2"), F.expr(male).alias("male"), (l2.cast("double") * F.expr(male)).alias("both"), F.expr(view).alias("c2"), F.expr(purchase).alias("c3"), ((F.col("score") - F.col("m")) / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))).alias("y"))
    classes = M.class_statistics(M.unit_statistics(long, "unit", "y", list(DESIGN), ["component"]), K, (0, 1), ["component"])
    models = {key[0]: M.build_models(s, EXTRA) for key, s in M.collected(classes, K, 2, ["component"]).items()}
    share = {r["component"]: r["share"] for r in z.select("component", "share").collect()}
    order = sorted(models)
    table, weight = np.array([models[c].effects() for c in order], float), np.array([share[c] for c in order])
    weight = weight / weight.sum()
    rows = [(f"PC{c}", models[c].fits["random_slope"].status, share[c], *x) for c, x in zip(order, table, strict=True)]
    rows.append(("mean", None, float(weight.sum()), *[float(np.nanmean(c)) if np.isfinite(c).any() else float("nan") for c in table.T]))
    rows.append(("weighted", None, float(weight.sum()), *np.nansum(table * weight[:, None], axis=0).tolist()))
    return frame(spark, rows, f"representation string, slope_status string, share double, {EFFECTS}")


CONTRASTED = ("click", "view", "purchase")
CONTRAST_DESIGN = {"l2": "status = 'L2'", "male": "gender = 'M'", "c2": "cls = 'view'", "c3": "cls = 'purchase'", "l2c2": "status = 'L2' and cls = 'view'", "l2c3": "status = 'L2' and cls = 'purchase'"}
#: The group's effect in each class: its own term and the class's interaction with it.
CONTRASTS = {"click": [0, 1, 0, 0, 0, 0, 0], "view": [0, 1, 0, 0, 0, 1, 0], "purchase": [0, 1, 0, 0, 0, 0, 1]}


def contrast_statistics(spark: SparkSession, d: str) -> DataFrame:
    t = finite_tokens(spark, d).where(F.col("cls").isin(*CONTRASTED))
    return M.unit_statistics(designed(t, CONTRAST_DESIGN, "f2"), "unit", "f2", list(CONTRAST_DESIGN))


def contrast_rows(stats: DataFrame) -> list[tuple]:
    k = len(CONTRAST_DESIGN) + 1
    f = M.fit(M.collected(M.class_statistics(stats, k), k)[()], list(range(k)))
    out = []
    for c, v in CONTRASTS.items():
        est, se, _, p = M.wald(f, np.array(v, float))
        out.append((c, f.status, est, se, p, est - M.Z95 * se, est + M.Z95 * se))
    return out


WALD = "cls string, status string, estimate double, se double, p_value double, ci_low double, ci_high double"


@query("m12_class_contrasts")
def m12(spark, d):
    """One model over all classes; the group effect per class as a Wald contrast, against a region of equivalence."""
    out = frame(spark, contrast_rows(contrast_statistics(spark, d)), WALD)
    return out.withColumn("rope", R.classify_rope(F.col("ci_low"), F.col("ci_high"), *map(F.lit, ROPE)))


@query("m13_cluster_bootstrap")
def m13(spark, d):
    """The same contrasts with intervals over units drawn with replacement. A class of fewer than LEAST_VALID valid replicates takes the
    Wald interval. Then its place against a region of equivalence."""
    stats = contrast_statistics(spark, d)
    k = len(CONTRAST_DESIGN) + 1
    boots = M.bootstrap(stats, "unit", k, list(range(k)), CONTRASTS, BOOTSTRAPS, 42)
    got = R.percentile_interval(boots.withColumnRenamed("term", "cls"), ["cls"], "estimate").withColumnsRenamed({"ci_low": "boot_low", "ci_high": "boot_high"})
    out = frame(spark, contrast_rows(stats), WALD).join(got, "cls", "left")
    enough = F.coalesce(F.col("n_valid"), F.lit(0)) >= LEAST_VALID
    ends = [F.when(enough, F.col(f"boot_{x}")).otherwise(F.col(f"ci_{x}")) for x in ("low", "high")]
    rope = R.classify_rope(*ends, *map(F.lit, ROPE)).alias("rope")
    return out.select("cls", "status", "estimate", "se", "p_value", F.coalesce("n_valid", F.lit(0)).alias("n_valid"), ends[0].alias("ci_low"), ends[1].alias("ci_high"), rope)


@query("m2_random_slope_status")
def m2s(spark, d):
    """The random-slope model's status and variances; a slope of what is constant within units isn't identified, and its fit is singular."""
    rows = [(y, "random_slope", f.status, f.loglik, *([f.var_random[0, 0], f.var_random[0, 1], f.var_random[1, 1]] if f.var_random.shape == (2, 2) else [None] * 3), f.var_error) for y, m in all_models(spark, d).items() for f in [m.fits["random_slope"]]]
    return frame(spark, rows, "response string, model string, status string, loglik double, var_intercept double, covariance double, var_slope double, var_error double")


__all__ = ["ORACLES", "QUERIES"]
