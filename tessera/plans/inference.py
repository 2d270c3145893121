"""Queries over vectors, resampling, tests, mixed models and clusters, with oracle SQL where SQL can state them."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import kernels as K
from ..operators import classify as L
from ..operators import cluster as U
from ..operators import compare as T
from ..operators import describe as D
from ..operators import resample as R
from ..operators import vectors as V
from ..session import table
from ..storage import materialize
from .roles import CLASSES, DIM_SQL, TOK_SQL, VEC_SQL, finite_tokens, rounded, tokens, vectors

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None, digits: int = 6):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(f(spark, sf_dir), digits)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return add


W = f"WITH {VEC_SQL}, {DIM_SQL}"
CEN = f"{W}, cen AS (SELECT cls, dim, avg(x) AS m FROM dims GROUP BY ALL)"
COS = "1 - sum(p.m * q.m) / (sqrt(sum(p.m * p.m)) * sqrt(sum(q.m * q.m)))"
EUC = "sqrt(sum((p.m - q.m) ** 2))"


def matrix(cen: str, what: str) -> str:
    return f"{cen} SELECT p.cls AS a, q.cls AS b, round({what}, 6) AS d FROM cen p JOIN cen q ON p.dim = q.dim AND p.cls < q.cls GROUP BY ALL"


@query("a8_vector_centroids", f"{W} SELECT cls, dim - 1 AS dim, round(avg(x), 6) AS m, count(*) AS n FROM dims GROUP BY ALL")
def a8(spark, d):
    c = V.mean_vectors(vectors(spark, d), ["cls"], F.col("v"))
    return c.select("cls", "n", F.posexplode("centroid").alias("dim", "m")).select("cls", F.col("dim").cast("long").alias("dim"), "m", "n")


@query("v2_cosine_matrix", matrix(CEN, COS))
def v2(spark, d):
    return V.cosine_matrix(V.mean_vectors(vectors(spark, d), ["cls"], F.col("v")), "cls", "centroid")


@query("v3_euclidean_matrix", matrix(CEN, EUC))
def v3(spark, d):
    return V.euclidean_matrix(V.mean_vectors(vectors(spark, d), ["cls"], F.col("v")), "cls", "centroid")


@query("v1_cosine_of_statuses", f"{W}, cen AS (SELECT cls, status, dim, avg(x) AS m FROM dims GROUP BY ALL) SELECT p.cls, round({COS}, 6) AS d FROM cen p JOIN cen q ON p.cls = q.cls AND p.dim = q.dim AND p.status < q.status GROUP BY p.cls")
def v1(spark, d):
    """Distance between the two groups' mean vectors per class, over tokens."""
    c = V.mean_vectors(vectors(spark, d), ["cls", "status"], F.col("v"))
    a = c.where("status = 'L1'").select("cls", F.col("centroid").alias("x"))
    b = c.where("status = 'L2'").select("cls", F.col("centroid").alias("y"))
    return a.join(b, "cls").select("cls", C.cosine_distance(F.col("x"), F.col("y")).alias("d"))


@query("v4_mahalanobis_matrix", f"""WITH {TOK_SQL}, m AS (SELECT cls, avg(f1) AS x, avg(f2) AS y FROM tok GROUP BY cls), r AS (SELECT f1 - x AS u, f2 - y AS v FROM tok JOIN m USING (cls)),
 c AS (SELECT var_samp(u) AS xx, covar_samp(u, v) AS xy, var_samp(v) AS yy FROM r), k AS (SELECT xx + 1e-6 * (xx + yy) / 2 AS a, xy AS b, yy + 1e-6 * (xx + yy) / 2 AS c FROM c)
 SELECT p.cls AS a, q.cls AS b, round(sqrt(greatest(((p.x - q.x) ** 2 * k.c - 2 * (p.x - q.x) * (p.y - q.y) * k.b + (p.y - q.y) ** 2 * k.a) / (k.a * k.c - k.b * k.b), 0)), 6) AS d FROM m p JOIN m q ON p.cls < q.cls, k""")
def v4(spark, d):
    t = tokens(spark, d)
    m = D.cell_means(t, ["cls"], ["f1", "f2"])
    r = t.join(m.toDF("cls", "x", "y"), "cls").select((F.col("f1") - F.col("x")).alias("u"), (F.col("f2") - F.col("y")).alias("v"))
    c = r.agg(F.var_samp("u").alias("xx"), F.covar_samp("u", "v").alias("xy"), F.var_samp("v").alias("yy")).first()
    return V.mahalanobis_matrix(m, "cls", "f1", "f2", c["xx"], c["xy"], c["yy"])


@query("v6_missing_aware_matrix", f"""WITH {TOK_SQL}, c AS (SELECT cls, sub % 4 AS k, CASE WHEN cls = 'error' AND sub % 4 = 0 THEN NULL ELSE f1 END AS x FROM tok), m AS (SELECT cls, k, avg(x) AS m FROM c GROUP BY ALL)
 SELECT p.cls AS a, q.cls AS b, round(sqrt(sum((p.m - q.m) ** 2) * 4 / count(p.m - q.m)), 6) AS d FROM m p JOIN m q ON p.k = q.k AND p.cls < q.cls GROUP BY ALL""")
def v6(spark, d):
    t = tokens(spark, d)
    x = lambda k: F.avg(F.when((F.col("sub") % 4 == k) & ~((F.col("cls") == "error") & F.lit(k == 0)), F.col("f1"))).alias(f"x{k}")
    m = t.groupBy("cls").agg(*[x(k) for k in range(4)]).select("cls", F.array("x0", "x1", "x2", "x3").alias("v"))
    return V.missing_aware_matrix(m, "cls", "v")


@query("p13_unit_vectors", f"{W}, n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM dims GROUP BY vec_id) SELECT vec_id, dim - 1 AS dim, round(x / n, 6) AS x FROM dims JOIN n USING (vec_id) WHERE dim <= 2")
def p13(spark, d):
    u = V.unit_vectors(vectors(spark, d), "v").select("vec_id", F.slice("v", 1, 2).alias("v"))
    return u.select("vec_id", F.posexplode("v").alias("dim", "x")).select("vec_id", F.col("dim").cast("long").alias("dim"), "x")


@query("a14_between_class_ratio", f"{W}, g AS (SELECT dim, avg(x) AS g FROM dims WHERE dim <= 2 GROUP BY dim), c AS (SELECT cls, dim, avg(x) AS m, count(*) AS n FROM dims WHERE dim <= 2 GROUP BY ALL), t AS (SELECT sum((x - g) ** 2) AS t FROM dims JOIN g USING (dim)) SELECT round(sum(n * (m - g) ** 2) / any_value(t), 6) AS ratio FROM c JOIN g USING (dim), t")
def a14(spark, d):
    return V.between_class_ratio(vectors(spark, d), "cls", F.slice("v", 1, 2))


UNIT = f"{W}, nrm AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM dims GROUP BY vec_id), u AS (SELECT d.*, x / n AS y FROM dims d JOIN nrm USING (vec_id))"
PAIRS = "SELECT a.cls, a.unit, 1 - sum(a.y * b.y) AS d FROM u a JOIN u b ON a.cls = b.cls AND a.unit = b.unit AND a.dim = b.dim AND a.vec_id < b.vec_id GROUP BY a.cls, a.unit, a.vec_id, b.vec_id"


@query("d2_weighted_intra_unit_distance", f"{UNIT}, p AS ({PAIRS}) SELECT round(avg(d), 6) AS distance, count(*)::DOUBLE AS n_pairs FROM p")
def d2(spark, d):
    p = V.mean_pair_cosine(vectors(spark, d), ["cls", "unit"], "v")
    return p.agg((F.sum(F.col("mean_distance") * F.col("n_pairs")) / F.sum("n_pairs")).alias("distance"), F.sum("n_pairs").alias("n_pairs"))


@query("d3_delta0", f"{UNIT}, p AS ({PAIRS}), c AS (SELECT cls, unit, avg(d) AS m FROM p GROUP BY ALL) SELECT round(avg(m), 6) AS delta0, count(*) AS n_cells FROM c")
def d3(spark, d):
    p = V.mean_pair_cosine(vectors(spark, d), ["cls", "unit"], "v", zero="drop")
    return p.agg(F.avg("mean_distance").alias("delta0"), F.count("*").alias("n_cells"))


@query("d4_inter_unit_variability", f"{W}, cen AS (SELECT cls, unit, dim, avg(x) AS m FROM dims GROUP BY ALL), p AS (SELECT p.cls, {COS} AS d FROM cen p JOIN cen q ON p.cls = q.cls AND p.dim = q.dim AND p.unit < q.unit GROUP BY p.cls, p.unit, q.unit) SELECT cls, round(avg(d), 6) AS mean_distance FROM p GROUP BY cls")
def d4(spark, d):
    c = V.mean_vectors(vectors(spark, d), ["cls", "unit"], F.col("v"))
    return V.mean_pair_cosine(c, ["cls"], "centroid").select("cls", "mean_distance")


WITHIN, BETWEEN = 500, 5000


@query("d1_sampled_within_between", f"""{UNIT}, ids AS (SELECT vec_id, cls, row_number() OVER (ORDER BY cls, vec_id) - 1 AS place FROM vec), sz AS (SELECT cls, min(place) AS lo, count(*) AS n, least({WITHIN}, n * (n - 1) / 2) AS k0 FROM ids GROUP BY cls),
 ow AS (SELECT sz.*, k, ('0x' || substr(md5('42-a-' || cls || '-' || k), 1, 8))::BIGINT % n AS i, ('0x' || substr(md5('42-b-' || cls || '-' || k), 1, 8))::BIGINT % n AS j FROM sz, range({WITHIN * 50}) t(k) WHERE n > 1 AND k < k0 * 50),
 ok AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY k) AS r FROM ow WHERE i <> j), tt AS (SELECT sum(n)::BIGINT AS total FROM sz),
 fr AS (SELECT k, ('0x' || substr(md5('42-c-' || k), 1, 8))::BIGINT % total AS i, ('0x' || substr(md5('42-d-' || k), 1, 8))::BIGINT % total AS j FROM range({BETWEEN * 50}) t(k), tt),
 pr AS (SELECT 'w' || q.cls || '-' || q.k AS k, a.vec_id AS x, b.vec_id AS y, true AS same FROM (SELECT cls, k, lo + i AS i, lo + j AS j FROM ok WHERE r <= k0) q JOIN ids a ON q.i = a.place JOIN ids b ON q.j = b.place
  UNION ALL (SELECT 'b' || fr.k, a.vec_id, b.vec_id, false FROM fr JOIN ids a ON fr.i = a.place JOIN ids b ON fr.j = b.place WHERE a.cls <> b.cls ORDER BY fr.k LIMIT {BETWEEN})),
 ds AS (SELECT k, any_value(same) AS same, sum(p.y * q.y) AS s FROM pr JOIN u p ON p.vec_id = pr.x JOIN u q ON q.vec_id = pr.y AND p.dim = q.dim GROUP BY k)
 SELECT sum(same::INT)::BIGINT AS n_within, sum((NOT same)::INT)::BIGINT AS n_between, round(avg(s) FILTER (same), 6) AS within, round(avg(s) FILTER (NOT same), 6) AS between, round(avg(s) FILTER (same) / avg(s) FILTER (NOT same), 4) AS ratio FROM ds""")
def d1(spark, d):
    """Mean cosine of hashed draws of pairs, of the same class and of different ones, and their ratio."""
    v = V.unit_vectors(vectors(spark, d), "v").select("vec_id", "cls", "v")
    p = R.sampled_pairs(v, "vec_id", "cls", WITHIN, BETWEEN, 42)
    both = p.join(v.select(F.col("vec_id").alias("x"), F.col("v").alias("vx")), "x").join(v.select(F.col("vec_id").alias("y"), F.col("v").alias("vy")), "y").select("same", C.dot(F.col("vx"), F.col("vy")).alias("s"))
    near, far = F.avg(F.when(F.col("same"), F.col("s"))), F.avg(F.when(~F.col("same"), F.col("s")))
    return both.agg(F.sum(F.col("same").cast("long")).alias("n_within"), F.sum((~F.col("same")).cast("long")).alias("n_between"), near.alias("within"), far.alias("between"), F.round(F.when(far != 0, near / far), 4).alias("ratio"))


LOSO = f"""{W}, tot AS (SELECT cls, dim, sum(x) AS s, count(*) AS n FROM dims GROUP BY ALL), own AS (SELECT unit, cls, dim, sum(x) AS s, count(*) AS n FROM dims GROUP BY ALL), un AS (SELECT DISTINCT unit FROM vec),
 fold AS (SELECT un.unit, t.cls, t.dim, (t.s - coalesce(o.s, 0)) / (t.n - coalesce(o.n, 0)) AS m FROM un CROSS JOIN tot t LEFT JOIN own o ON o.unit = un.unit AND o.cls = t.cls AND o.dim = t.dim WHERE t.n > coalesce(o.n, 0)),
 sc AS (SELECT d.vec_id, d.unit, d.cls, d.status, f.cls AS pred, sqrt(sum((d.x - f.m) ** 2)) AS e FROM dims d JOIN fold f ON f.unit = d.unit AND f.dim = d.dim GROUP BY ALL),
 pred AS (SELECT vec_id, unit, cls, any_value(status) AS status, arg_min(pred, (e, pred)) AS pred FROM sc GROUP BY vec_id, unit, cls)"""


def _loso(spark, d, cosine=False) -> DataFrame:
    v = vectors(spark, d)
    return L.leave_one_unit_out(v, "vec_id", "unit", "cls", "v", cosine).join(v.select("vec_id", "status"), "vec_id")


@query("t10_leave_one_unit_out", f"{LOSO} SELECT vec_id, cls, pred, cls = pred AS correct FROM pred")
def t10(spark, d):
    return _loso(spark, d).select("vec_id", "cls", "pred", "correct")


@query("a15_accuracy", f"{LOSO} SELECT status, count(*) AS n, round(avg((cls = pred)::INT), 6) AS accuracy FROM pred GROUP BY GROUPING SETS ((), (status))")
def a15(spark, d):
    return L.accuracy(_loso(spark, d), "status")


@query("a16_f1_by_class", f"{LOSO}, l AS (SELECT cls AS label FROM pred UNION SELECT pred FROM pred) SELECT label, round(coalesce(2.0 * (SELECT count(*) FROM pred WHERE cls = label AND pred = label) / nullif((SELECT count(*) FROM pred WHERE cls = label) + (SELECT count(*) FROM pred p WHERE p.pred = label), 0), 0), 6) AS f1 FROM l")
def a16(spark, d):
    return L.f1_by_class(_loso(spark, d), "cls", "pred")


@query("a17_confusion", f"{LOSO}, l AS (SELECT cls AS label FROM pred UNION SELECT pred FROM pred), g AS (SELECT a.label AS t, b.label AS p FROM l a, l b), n AS (SELECT t, p, (SELECT count(*) FROM pred x WHERE x.cls = t AND x.pred = p) AS n FROM g) SELECT t, p, n, round(n / greatest(sum(n) OVER (PARTITION BY t), 1), 6) AS share FROM n")
def a17(spark, d):
    return L.confusion(_loso(spark, d), "cls", "pred")


LAB = "lb AS (SELECT doc_id, 'quality' AS rep, quality = 1 AS ok FROM labels UNION ALL SELECT doc_id, 'toxic', toxic = 1 FROM labels)"


def _labels(spark, d) -> DataFrame:
    lab = table(spark, d, "labels")
    return lab.select("doc_id", F.explode(F.array(F.struct(F.lit("quality").alias("rep"), (F.col("quality") == 1).alias("ok")), F.struct(F.lit("toxic").alias("rep"), (F.col("toxic") == 1).alias("ok")))).alias("x")).select("doc_id", "x.*")


@query("a18_discordant_pairs", f"WITH {LAB} SELECT a.rep AS rep_a, b.rep AS rep_b, count(*) AS n_matched, sum((a.ok AND NOT b.ok)::INT)::BIGINT AS a_only, sum((NOT a.ok AND b.ok)::INT)::BIGINT AS b_only FROM lb a JOIN lb b ON a.doc_id = b.doc_id AND a.rep < b.rep GROUP BY ALL")
def a18(spark, d):
    return L.discordance(_labels(spark, d), "rep", "doc_id", "ok")


def _each(df: DataFrame, keys: list[str], schema: str, f) -> DataFrame:
    """One row of results per group; groups are cells of a design, and only their values are sent."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, **f(pdf)}])

    return df.groupBy(*keys).applyInPandas(run, schema)


MCNEMAR = f"""WITH {LAB}, x AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'L1' ELSE 'L2' END AS status FROM lb), r AS (SELECT 'all' AS rows, doc_id, rep, ok FROM x UNION ALL SELECT status, doc_id, rep, ok FROM x),
 d AS (SELECT a.rows, a.rep AS rep_a, b.rep AS rep_b, sum((a.ok AND NOT b.ok)::INT) AS b, sum((NOT a.ok AND b.ok)::INT) AS c FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.rows = b.rows AND a.rep < b.rep GROUP BY ALL),
 p AS (SELECT rows, rep_a, rep_b, (b + c)::BIGINT AS n, CASE WHEN b + c > 0 THEN least(1.0, 2 * list_sum(list_transform(range(0, least(b, c)::BIGINT + 1), lambda k: exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2.0))))) END AS p_value FROM d),
 q AS (SELECT *, row_number() OVER (ORDER BY p_value, rows, rep_a, rep_b) AS k, count(*) OVER () AS m FROM p WHERE p_value IS NOT NULL),
 f AS (SELECT *, least(min(p_value * m / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) AS q_value FROM q)
 SELECT p.rows, p.rep_a, p.rep_b, p.n, 'all' AS family, round(p.p_value, 6) AS p_value, round(q_value, 6) AS q_value_bh, coalesce(q_value <= 0.05, false) AS significant_bh FROM p LEFT JOIN f USING (rows, rep_a, rep_b)"""


@query("t9_mcnemar", MCNEMAR)
def t9(spark, d):
    """Exact McNemar tests over all rows and per status, with q-values over the whole table."""
    lab = _labels(spark, d)
    status = F.when(F.col("doc_id") % 2 == 0, "L1").otherwise("L2")
    parts = [("all", lab), *[(x, lab.where(status == x)) for x in ("L1", "L2")]]
    pairs = reduce(DataFrame.unionByName, [L.discordance(p, "rep", "doc_id", "ok").withColumn("rows", F.lit(x)) for x, p in parts])
    got = _each(pairs, ["rows", "rep_a", "rep_b"], "rows string, rep_a string, rep_b string, n long, p_value double", lambda p: {"n": int(p.a_only.iloc[0] + p.b_only.iloc[0]), "p_value": K.binomial_two_sided(int(min(p.a_only.iloc[0], p.b_only.iloc[0])), int(p.a_only.iloc[0] + p.b_only.iloc[0]))})
    return D.benjamini_hochberg(got.withColumn("p_value", C.finite(F.col("p_value"))).withColumn("family", F.lit("all")), ["family"], "p_value", ["rows", "rep_a", "rep_b"])


def unit_cells(df: DataFrame, group: str) -> DataFrame:
    """Unit means per class and feature, stored, as several statistics read them."""
    cells = D.cell_means(df, ["unit", "cls", group], ["f1", "f2"])
    return materialize(cells.unpivot(["unit", "cls", group], ["f1", "f2"], "feature", "x").where("x is not null"), "unit-cells")


def battery(df: DataFrame, group: str, a: str, b: str, least_units: int = 2) -> DataFrame:
    """Unit means per class and feature compared between two groups of units, with q-values per feature."""
    got = T.two_group_tests(unit_cells(df, group), ["cls", "feature"], group, a, b, "x")
    few = F.least("n_a", "n_b") < least_units
    got = got.withColumn("p_value", F.when(~few, F.col("p_value"))).withColumn("selected_test", F.when(few, "insufficient_units").otherwise(F.col("selected_test")))
    return D.benjamini_hochberg(materialize(got, "tests"), ["feature"], "p_value", ["cls"])


def _group_statistics(group: str, a: str, b: str) -> str:
    return f"""WITH {TOK_SQL}, u AS (SELECT unit, cls, {group} AS g, avg(f1) AS f1, avg(f2) AS f2 FROM tok GROUP BY ALL),
 l AS (SELECT cls, g, 'f1' AS feature, f1 AS x FROM u WHERE f1 IS NOT NULL UNION ALL SELECT cls, g, 'f2', f2 FROM u WHERE f2 IS NOT NULL), md AS (SELECT cls, g, feature, median(x) AS md FROM l GROUP BY ALL),
 z AS (SELECT cls, g, feature, x, abs(x - md) AS z, rank() OVER (PARTITION BY cls, feature ORDER BY x) + (count(*) OVER (PARTITION BY cls, feature, x) - 1) / 2.0 AS r FROM l JOIN md USING (cls, g, feature)),
 s AS (SELECT cls, g, feature, count(*) AS n, avg(x) AS m, var_samp(x) AS v, avg(z) AS zm, var_pop(z) AS zv, sum(r) AS r FROM z GROUP BY ALL),
 p AS (SELECT cls, feature, p.n, q.n AS k, p.m, q.m AS o, ((p.n - 1) * p.v + (q.n - 1) * q.v) / (p.n + q.n - 2) AS pooled, p.n * p.zv + q.n * q.zv AS within, (p.n * p.zm + q.n * q.zm) / (p.n + q.n) AS mid, p.zm AS za, q.zm AS zb, p.r FROM s p JOIN s q USING (cls, feature) WHERE p.g = '{a}' AND q.g = '{b}')
 SELECT cls, feature, n AS n_a, k AS n_b, round(m, 6) AS mean_a, round(o, 6) AS mean_b, round((m - o) / sqrt(pooled * (1.0 / n + 1.0 / k)), 6) AS t, round((n + k - 2) * (n * (za - mid) ** 2 + k * (zb - mid) ** 2) / within, 6) AS levene_f, round(r - n * (n + 1) / 2, 6) AS u FROM p WHERE n > 1 AND k > 1"""


@query("t2_group_statistics", _group_statistics("status", "L1", "L2"))
def t2_statistics(spark, d):
    """What the tests of two groups decide by: t, Levene's F about the medians, and U, for any number of units."""
    got = T.two_group_statistics(unit_cells(tokens(spark, d), "status"), ["cls", "feature"], "status", "L1", "L2", "x")
    return got.where("n_a > 1 and n_b > 1").drop("difference", "ties")


@query("t3_second_factor_statistics", _group_statistics("gender", "F", "M"))
def t3_statistics(spark, d):
    got = T.two_group_statistics(unit_cells(tokens(spark, d), "gender"), ["cls", "feature"], "gender", "F", "M", "x")
    return got.where("n_a > 1 and n_b > 1").drop("difference", "ties")


@query("t2_group_battery")
def t2(spark, d):
    return battery(finite_tokens(spark, d), "status", "L1", "L2")


@query("t3_second_factor_battery")
def t3(spark, d):
    return battery(finite_tokens(spark, d), "gender", "F", "M").withColumn("design_note", F.lit("between units"))


@query("t1_two_group_means", f"WITH {TOK_SQL}, u AS (SELECT unit, cls, status, avg(f1) AS x FROM tok GROUP BY ALL), s AS (SELECT cls, status, count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM u GROUP BY ALL) SELECT a.cls, a.n AS n_a, b.n AS n_b, round(b.m - a.m, 6) AS difference, round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1 / a.n + 1 / b.n)), 6) AS t FROM s a JOIN s b ON a.cls = b.cls AND a.status < b.status")
def t1(spark, d):
    """Difference and pooled t of two groups of unit means, in SQL aggregates alone."""
    u = D.cell_means(tokens(spark, d), ["unit", "cls", "status"], ["f1"])
    s = u.groupBy("cls").pivot("status", ["L1", "L2"]).agg(F.count("f1").alias("n"), F.avg("f1").alias("m"), F.var_samp("f1").alias("v"))
    n, m = F.col("L1_n"), F.col("L2_n")
    pooled = ((n - 1) * F.col("L1_v") + (m - 1) * F.col("L2_v")) / (n + m - 2)
    return s.select("cls", n.alias("n_a"), m.alias("n_b"), (F.col("L2_m") - F.col("L1_m")).alias("difference"), ((F.col("L1_m") - F.col("L2_m")) / F.sqrt(pooled * (1 / n + 1 / m))).alias("t"))


def _quantile_sql(p: str) -> str:
    def ratio(tables: tuple, r: str) -> str:
        tops = []
        for table in tables:
            out = f"{table[-1]!r}::DOUBLE"
            for c in table[-2::-1]:
                out = f"({out} * {r} + {c!r}::DOUBLE)"
            tops.append(out)
        return f"({tops[0]} / {tops[1]})"

    q, r = f"({p} - 0.5)", f"sqrt(-ln(least({p}, 1 - {p})))"
    tail = f"CASE WHEN {r} <= 5 THEN {ratio(C.QUANTILE_NEAR, f'({r} - 1.6)')} ELSE {ratio(C.QUANTILE_FAR, f'({r} - 5)')} END"
    return f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {ratio(C.QUANTILE_MIDDLE, f'(0.180625 - {q} * {q})')} ELSE sign({q}) * {tail} END"


@query("t11_quantile_quantile", f"""WITH {TOK_SQL}, u AS (SELECT unit, cls, status, avg(f1) AS f1 FROM tok GROUP BY ALL), o AS (SELECT cls, status, f1, row_number() OVER (PARTITION BY cls, status ORDER BY f1) AS i, count(*) OVER (PARTITION BY cls, status) AS n FROM u WHERE f1 IS NOT NULL),
 p AS (SELECT cls, status, f1, CASE WHEN i = 1 THEN 1 - 0.5::DOUBLE ** (1.0::DOUBLE / n) WHEN i = n THEN 0.5::DOUBLE ** (1.0::DOUBLE / n) ELSE (i - 0.3175::DOUBLE) / (n + 0.365::DOUBLE) END AS p FROM o WHERE n >= 3) SELECT cls, status, round(f1, 6) AS f1, round({_quantile_sql("p")}, 6) AS theoretical FROM p""")
def t11(spark, d):
    """Normal quantiles at Filliben's medians against the ordered unit means."""
    u = materialize(D.cell_means(tokens(spark, d), ["unit", "cls", "status"], ["f1"]), "unit-cells")
    return T.normal_plot(u, ["cls", "status"], "f1")


#: The replicate counts of the permutation tests and of the bootstraps.
PERMUTATIONS, BOOTSTRAPS = 5000, 2000
PERM = f"""{W}, cen AS (SELECT cls, unit, dim, avg(x) AS m FROM dims GROUP BY ALL), un AS (SELECT cls, unit, any_value(status) AS status FROM vec GROUP BY ALL),
 pr AS (SELECT b, cls, unit, row_number() OVER (PARTITION BY b, cls ORDER BY ('0x' || substr(md5('7-' || b || '-' || unit), 1, 8))::BIGINT, unit) AS rank FROM range({PERMUTATIONS}) t(b), un),
 k AS (SELECT cls, sum((status = 'L1')::INT) AS k FROM un GROUP BY cls), g AS (SELECT pr.b, pr.cls, pr.unit, rank <= k AS first FROM pr JOIN k USING (cls)),
 mm AS (SELECT b, g.cls, dim, avg(m) FILTER (first) AS p, avg(m) FILTER (NOT first) AS q FROM g JOIN cen USING (cls, unit) GROUP BY ALL), pd AS (SELECT b, cls, round(1 - sum(p * q) / (sqrt(sum(p * p)) * sqrt(sum(q * q))), 9) AS d FROM mm GROUP BY ALL),
 om AS (SELECT cls, dim, avg(m) FILTER (status = 'L1') AS p, avg(m) FILTER (status <> 'L1') AS q FROM un JOIN cen USING (cls, unit) GROUP BY ALL), ob AS (SELECT cls, round(1 - sum(p * q) / (sqrt(sum(p * p)) * sqrt(sum(q * q))), 9) AS o FROM om GROUP BY ALL),
 pv AS (SELECT cls, any_value(o) AS observed, (1 + sum((d >= o)::INT)) / ({PERMUTATIONS} + 1.0) AS p FROM ob JOIN pd USING (cls) WHERE o IS NOT NULL GROUP BY cls),
 rk AS (SELECT *, row_number() OVER (ORDER BY p, cls) AS r, count(*) OVER () AS m FROM pv), q AS (SELECT *, least(min(p * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) AS q FROM rk)
 SELECT cls, round(observed, 6) AS observed, round(p, 6) AS p_value, round(q, 6) AS q_value_bh, q <= 0.05 AS significant_bh FROM q"""


@query("t4_permutation_test", PERM)
def t4(spark, d):
    """Labels shuffled over units: distance of the groups' mean vectors per class, its p, and q over the classes.

    Both groups' vectors follow from the first group's sum and the class's, and a cosine doesn't mind the counts."""
    v = vectors(spark, d)
    cells = V.mean_vectors(v, ["cls", "unit"], F.col("v")).select("cls", "unit", "centroid").join(v.groupBy("cls", "unit").agg(F.first("status").alias("status")), ["cls", "unit"])
    cells = materialize(cells, "cells")
    width = cells.agg(F.max(F.size("centroid"))).first()[0] or 0
    total = V.vector_sums(cells, ["cls"], "centroid", width).join(cells.groupBy("cls").agg(F.sum((F.col("status") == "L1").cast("long")).alias("k"), F.count("*").alias("size")), "cls")

    def distances(own: DataFrame, keys: list[str]) -> DataFrame:
        both = own.join(total.where("k between 1 and size - 1"), "cls")
        rest = F.zip_with("total", "one", lambda t, x: t - x)
        return both.select(*keys, F.round(C.cosine_distance(F.col("one"), rest), 9).alias("d")).where("d is not null")

    first = {r["cls"]: (r["k"], r["size"]) for r in total.select("cls", "k", "size").collect() if 0 < r["k"] < r["size"]}  # classes
    permuted = distances(R.permuted_sums(cells, "cls", "unit", "centroid", first, PERMUTATIONS, 7), ["b", "cls"])
    observed = distances(V.vector_sums(cells.where("status = 'L1'"), ["cls"], "centroid", width, name="one"), ["cls"])
    got = R.permutation_p(observed, permuted, ["cls"], PERMUTATIONS).withColumn("family", F.lit("all"))
    return D.benjamini_hochberg(got, ["family"], "p_value", ["cls"]).drop("family")


BOOT = f"""{TOK_SQL}, um AS (SELECT unit, cls, avg(f1) AS x, avg(f2) AS y FROM tok WHERE f1 IS NOT NULL AND f2 IS NOT NULL GROUP BY ALL), o AS (SELECT unit, row_number() OVER (ORDER BY unit) - 1 AS place, count(*) OVER () AS size FROM (SELECT DISTINCT unit FROM um)),
 dr AS (SELECT b, o.place AS slot, ('0x' || substr(md5('11-' || b || '-' || o.place), 1, 8))::BIGINT % size AS place FROM range({BOOTSTRAPS}) t(b), o), w AS (SELECT b, unit, count(*) AS times FROM dr JOIN o USING (place) GROUP BY ALL),
 c AS (SELECT b, cls, sum(times) AS n, sum(times * x) AS sx, sum(times * y) AS sy, sum(times * x * x) AS qx, sum(times * x * y) AS qz, sum(times * y * y) AS qy FROM w JOIN um USING (unit) GROUP BY ALL),
 p AS (SELECT p.cls AS a, q.cls AS b, p.sx / p.n - q.sx / q.n AS u, p.sy / p.n - q.sy / q.n AS v, (p.qx - p.sx * p.sx / p.n + q.qx - q.sx * q.sx / q.n) / (p.n + q.n - 1) AS xx,
  (p.qz - p.sx * p.sy / p.n + q.qz - q.sx * q.sy / q.n) / (p.n + q.n - 1) AS xy, (p.qy - p.sy * p.sy / p.n + q.qy - q.sy * q.sy / q.n) / (p.n + q.n - 1) AS yy FROM c p JOIN c q ON p.b = q.b AND p.cls < q.cls),
 r AS (SELECT *, xx + 1e-6 * (xx + yy) / 2 AS k, yy + 1e-6 * (xx + yy) / 2 AS l FROM p),
 e AS (SELECT a, b, 'euclidean' AS measure, sqrt(u * u + v * v) AS d FROM r UNION ALL SELECT a, b, 'mahalanobis', sqrt(greatest((u * u * l - 2 * u * v * xy + v * v * k) / (k * l - xy * xy), 0)) FROM r WHERE k * l - xy * xy > 0)
 SELECT a, b, measure, count(*) AS n_valid, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.025), 6) AS ci_low, round(quantile_cont(d, 0.975), 6) AS ci_high FROM e GROUP BY ALL"""


def unit_means(t: DataFrame) -> DataFrame:
    return t.where("f1 is not null and f2 is not null").groupBy("unit", "cls").agg(F.avg("f1").alias("x"), F.avg("f2").alias("y"))


def pair_sums() -> dict[str, Column]:
    """What a replicate needs of each class: the units' number, sums and products of their means."""
    x, y = F.col("x"), F.col("y")
    return {"n": F.lit(1.0), "sx": x, "sy": y, "qx": x * x, "qz": x * y, "qy": y * y}


def pair_intervals(c: DataFrame) -> DataFrame:
    """Intervals of the distances of classes over replicates; c: b, cls and pair_sums(). The covariance of the Mahalanobis distance is that of
    the pair's own unit means, estimated anew in each replicate."""
    p, q = (c.select(F.col("b").alias("r"), F.col("cls").alias(s), *[F.col(k).alias(f"{k}_{s}") for k in pair_sums()]) for s in "ab")
    both = p.join(q, "r").where("a < b")
    scatter = lambda s, m, n: F.col(f"{s}_a") - F.col(f"{m}_a") * F.col(f"{n}_a") / F.col("n_a") + F.col(f"{s}_b") - F.col(f"{m}_b") * F.col(f"{n}_b") / F.col("n_b")
    gap = lambda m: F.col(f"{m}_a") / F.col("n_a") - F.col(f"{m}_b") / F.col("n_b")
    free = F.col("n_a") + F.col("n_b") - 1
    cov = both.select("a", "b", gap("sx").alias("u"), gap("sy").alias("v"), (scatter("qx", "sx", "sx") / free).alias("xx"), (scatter("qz", "sx", "sy") / free).alias("xy"), (scatter("qy", "sy", "sy") / free).alias("yy"))
    ridge = 1e-6 * (F.col("xx") + F.col("yy")) / 2
    u, v, k, m = F.col("u"), F.col("v"), F.col("xx") + ridge, F.col("yy") + ridge
    det = k * m - F.col("xy") * F.col("xy")
    square = F.when(det > 0, F.greatest((u * u * m - 2 * u * v * F.col("xy") + v * v * k) / det, F.lit(0.0)))
    made = F.array(F.struct(F.lit("euclidean").alias("measure"), F.sqrt(u * u + v * v).alias("d")), F.struct(F.lit("mahalanobis").alias("measure"), F.sqrt(square).alias("d")))
    return R.percentile_interval(cov.select("a", "b", F.inline(made)).where("d is not null"), ["a", "b", "measure"], "d")


@query("t7_bootstrap_distances", "WITH " + BOOT)
def t7(spark, d):
    """Intervals of class distances over units drawn with replacement, as weights on the units' means; draws are hashed, so that SQL has the same."""
    um = materialize(unit_means(tokens(spark, d)).select("unit", "cls", *[e.alias(k) for k, e in pair_sums().items()]), "unit-means")
    c = materialize(R.drawn_sums(um, "unit", ["cls"], list(pair_sums()), BOOTSTRAPS, 11), "replicates")
    return pair_intervals(c)


@query("t7_split_draws")
def t7_split(spark, d):
    """The same intervals from draws that are split by partition: no row per replicate and unit is made, whatever the number of units."""
    um = unit_means(finite_tokens(spark, d)).select("unit", "cls", *[e.alias(k) for k, e in pair_sums().items()])
    return pair_intervals(R.resampled_sums(um, "unit", ["cls"], list(pair_sums()), BOOTSTRAPS, 11))


VBOOT = f"""{W}, pick AS (SELECT DISTINCT cls FROM vec ORDER BY cls LIMIT 3), um AS (SELECT cls, unit, dim, avg(x) AS m FROM dims WHERE cls IN (SELECT cls FROM pick) GROUP BY ALL), o AS (SELECT unit, row_number() OVER (ORDER BY unit) - 1 AS place, count(*) OVER () AS size FROM (SELECT DISTINCT unit FROM um)),
 dr AS (SELECT b, o.place AS slot, ('0x' || substr(md5('11-' || b || '-' || o.place), 1, 8))::BIGINT % size AS place FROM range({BOOTSTRAPS}) t(b), o), w AS (SELECT b, unit, count(*) AS times FROM dr JOIN o USING (place) GROUP BY ALL),
 c AS (SELECT b, cls, dim, sum(times * m) AS m FROM w JOIN um USING (unit) GROUP BY ALL), d AS (SELECT p.cls AS a, q.cls AS c, {COS} AS d FROM c p JOIN c q ON p.b = q.b AND p.dim = q.dim AND p.cls < q.cls GROUP BY p.b, p.cls, q.cls)
 SELECT a, c AS b, count(*) AS n_valid, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.025), 6) AS ci_low, round(quantile_cont(d, 0.975), 6) AS ci_high FROM d GROUP BY a, c"""


@query("t7_bootstrap_cosines", VBOOT)
def t7_cosines(spark, d):
    """The same draws for vectors: intervals of the cosine distances between the first three classes."""
    v = vectors(spark, d)
    few = v.select("cls").distinct().orderBy("cls").limit(3)
    um = materialize(V.mean_vectors(v.join(F.broadcast(few), "cls"), ["cls", "unit"], F.col("v")).select("cls", "unit", "centroid"), "unit-means")
    width = um.agg(F.max(F.size("centroid"))).first()[0] or 0
    w = R.bootstrap_weights(um.select("unit").distinct(), "unit", BOOTSTRAPS, 11)
    c = materialize(V.vector_sums(w.join(um, "unit"), ["b", "cls"], "centroid", width, F.col("times")), "replicates")
    p, q = c.toDF("r", "a", "x"), c.toDF("r", "b", "y")
    pairs = p.join(q, "r").where("a < b").select("a", "b", C.cosine_distance(F.col("x"), F.col("y")).alias("d")).where("d is not null")
    return R.percentile_interval(pairs, ["a", "b"], "d")


MANTEL = f"""WITH {VEC_SQL}, {DIM_SQL}, c1 AS (SELECT cls, dim, avg(x) AS m FROM dims WHERE dim <= 32 GROUP BY ALL), c2 AS (SELECT cls, dim, avg(x) AS m FROM dims WHERE dim > 32 GROUP BY ALL),
 d1 AS (SELECT p.cls AS a, q.cls AS b, round({EUC}, 9) AS d FROM c1 p JOIN c1 q ON p.dim = q.dim AND p.cls <> q.cls GROUP BY ALL), d2 AS (SELECT p.cls AS a, q.cls AS b, round({EUC}, 9) AS d FROM c2 p JOIN c2 q ON p.dim = q.dim AND p.cls <> q.cls GROUP BY ALL),
 lb AS (SELECT DISTINCT cls FROM vec), pl AS (SELECT cls, row_number() OVER (ORDER BY cls) AS place FROM lb),
 pm AS (SELECT b, cls, row_number() OVER (PARTITION BY b ORDER BY ('0x' || substr(md5('5-' || b || '-' || cls), 1, 8))::BIGINT, cls) AS place FROM range({PERMUTATIONS}) t(b), lb UNION ALL SELECT -1, cls, place FROM pl),
 mp AS (SELECT b, pm.cls AS src, pl.cls AS dst FROM pm JOIN pl USING (place)),
 j AS (SELECT x.b, p.d AS u, q.d AS v FROM d1 p JOIN mp x ON x.dst = p.a JOIN mp y ON y.dst = p.b AND y.b = x.b JOIN d2 q ON q.a = x.src AND q.b = y.src WHERE p.a < p.b),
 rk AS (SELECT b, rank() OVER (PARTITION BY b ORDER BY u) + (count(*) OVER (PARTITION BY b, u) - 1) / 2.0 AS u, rank() OVER (PARTITION BY b ORDER BY v) + (count(*) OVER (PARTITION BY b, v) - 1) / 2.0 AS v FROM j),
 r AS (SELECT b, round(corr(u, v), 9) AS r FROM rk GROUP BY b)
 SELECT round(max(r) FILTER (b = -1), 6) AS r, round((1 + sum((b >= 0 AND r >= (SELECT r FROM r WHERE b = -1))::INT)) / ({PERMUTATIONS} + 1.0), 6) AS p_value FROM r"""


@query("t5_mantel", MANTEL)
def t5(spark, d):
    """Rank correlation of two distance matrices, against relabelled ones."""
    v = vectors(spark, d)
    mats = []
    for at in (1, 33):
        c = V.mean_vectors(v.select("cls", F.slice("v", at, 32).alias("v")), ["cls"], F.col("v"))
        mats.append(V.euclidean_matrix(c, "cls", "centroid", upper=False).where("a <> b").withColumn("d", F.round("d", 9)))
    return U.mantel(mats[0], mats[1], PERMUTATIONS, 5)


@query("c6_adjusted_rand", """WITH x AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY ALL), i AS (SELECT sum(n * (n - 1) / 2) AS i, sum(n) AS t FROM x),
 r AS (SELECT sum(n * (n - 1) / 2) AS r FROM (SELECT sum(n) AS n FROM x GROUP BY a)), c AS (SELECT sum(n * (n - 1) / 2) AS c FROM (SELECT sum(n) AS n FROM x GROUP BY b))
 SELECT round((i - r * c / (t * (t - 1) / 2)) / ((r + c) / 2 - r * c / (t * (t - 1) / 2)), 6) AS ari FROM i, r, c""")
def c6(spark, d):
    return L.adjusted_rand(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@query("c1_ward_tree")
def c1(spark, d):
    c = V.mean_vectors(V.unit_vectors(vectors(spark, d), "v"), ["cls"], F.col("v"))
    return U.trees(c.withColumn("rep", F.lit("vectors")), ["rep"], "cls", "centroid", "ward")


@query("c2_average_tree")
def c2(spark, d):
    c = V.mean_vectors(vectors(spark, d), ["status", "cls"], F.col("v"))
    return U.trees(c, ["status"], "cls", "centroid", "average")


@query("c4_silhouettes")
def c4(spark, d):
    c = V.mean_vectors(vectors(spark, d), ["status", "cls"], F.col("v"))
    return U.silhouettes(c, ["status"], "cls", "centroid", "ward", range(2, 9))


@query("c5_chosen_k")
def c5(spark, d):
    c = V.mean_vectors(vectors(spark, d), ["status", "cls"], F.col("v"))
    return U.chosen_k(c, ["status"], "cls", "centroid", "ward", range(2, 9))


@query("c9_unit_clusters")
def c9(spark, d):
    """Units clustered on their classes' mean vectors; cells a unit lacks take the class mean, and the truth is the status."""
    v = vectors(spark, d)
    return U.unit_clusters(v, "unit", "cls", "v", "status", k=2)


@query("v9_principal_components")
def v9(spark, d):
    from ..operators.reduce import principal_components

    return principal_components(vectors(spark, d), "vec_id", "v", 5)


@query("p1_base_symbols")
def p1(spark, d):
    return table(spark, d, "documents").select("doc_id", C.base_symbol(F.col("text")).alias("base"))


__all__ = ["CLASSES", "QUERIES", "ORACLES", "battery"]
