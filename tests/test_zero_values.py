"""Values of zero and below: their logarithm is that of the oracle SQL, -infinity or NaN, not missing."""

import math

import pytest
from pyspark.sql import functions as F

from jobs import queries as jobs
from tessera.functions import columns as C
from tessera.operators import describe as D
from tessera.plans import registry

NAMED = [
    "a10_mean_of_unit_means",
    "a13_chart_limits",
    "a1_grouped_descriptives",
    "a22_covariance",
    "a23_confidence_ellipse",
    "a4_within_unit_sd",
    "a6_unit_class_means",
    "a7_complete_case_centroids",
    "a9_class_centroids",
    "a9b_component_means",
    "p16_population_z",
    "job2_normalised",
    "m2_class_statistics",
    "m2_unit_statistics",
]
SHARED = ["w1_lobanov", "f4_frequent_classes", "v4_mahalanobis_matrix", "t2_group_statistics", "t3_second_factor_statistics", "m3_profile_likelihood"]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    import duckdb

    folder, con = tmp_path_factory.mktemp("zeros"), duckdb.connect()
    con.sql("""create table events as select i as event_id, timestamp '2024-01-01' + to_minutes(i * 7) as ts, i % 8 as user_id,
     ['click', 'view', 'purchase', 'signup', 'error'][1 + i // 8 % 5] as event_type, case when i in (16, 17, 96) then 0 else (i * 37 % 101 + 1) / 4.0 end::double as value from range(400) t(i)""")
    con.sql(f"copy events to '{folder}/events.parquet' (format parquet)")
    return str(folder), con


def plain(rows, columns):
    def cell(x):
        return "nan" if isinstance(x, float) and math.isnan(x) else round(x, 4) + 0.0 if isinstance(x, float) else x

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMED + SHARED)
def test_zero_as_in_sql(spark, tables, name):
    folder, con = tables
    found, sql = {**registry.queries(), **jobs.QUERIES}, {**registry.oracles(), **jobs.ORACLES}
    df, rel = found[name](spark, folder), con.sql(sql[name])
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(rel.fetchall(), rel.columns)


def test_log2_and_infinite_quantiles(spark):
    x = spark.createDataFrame([(0.0,), (-1.0,), (8.0,), (None,)], "x double").select(C.log2(F.col("x"))).collect()
    assert x[0][0] == -math.inf and math.isnan(x[1][0]) and x[2][0] == pytest.approx(3) and x[3][0] is None
    t = spark.createDataFrame([(1, -math.inf), (1, -math.inf), (1, 2.0)], "k int, x double")
    assert list(D.quantiles(t, ["k"], "x", [0.25, 0.5], "q").first()["q"]) == [-math.inf, -math.inf]


def test_models_leave_infinite_values_out(spark, tables):
    assert all(r["loglik"] is not None and math.isfinite(r["loglik"]) for r in registry.queries()["m3_information_criteria"](spark, tables[0]).where("model = 'null'").collect())
