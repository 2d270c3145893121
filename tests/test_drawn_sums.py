"""Hashed draws as products of blocks: the same sums as the joined weights, the same rows as SQL, no row per replicate and unit."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import resample as R
from tessera.plans import inference, registry

NAMED = ["t7_bootstrap_distances", "t15_rope_summary"]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """40 users and rows without one; some values are zero, so that a mean of logarithms is -infinity."""
    import duckdb

    folder, con = tmp_path_factory.mktemp("draws"), duckdb.connect()
    con.sql("""create table events as select i as event_id, timestamp '2024-01-01' + to_minutes(i) as ts, case when i % 41 < 40 then i % 41 end as user_id,
     ['click', 'view', 'purchase', 'signup'][1 + i // 41 % 4] as event_type, case when i = 43 then 0 else (i * 37 % 101 + 1) / 4.0 end::double as value from range(900) t(i)""")
    con.sql(f"copy events to '{folder}/events.parquet' (format parquet)")
    return str(folder), con


def plain(rows, columns):
    def cell(x):
        return "nan" if isinstance(x, float) and math.isnan(x) else round(x, 5) + 0.0 if isinstance(x, float) else x

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMED)
def test_rows_as_in_sql_without_a_row_per_draw(spark, tables, monkeypatch, name):
    folder, con = tables
    keep, plans = inference.materialize, {}
    monkeypatch.setattr(inference, "materialize", lambda df, label: plans.update({label: df._jdf.queryExecution().executedPlan().toString()}) or keep(df, label))
    df, rel = registry.queries()[name](spark, folder), con.sql(registry.oracles()[name])
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(rel.fetchall(), rel.columns)
    assert any(math.isfinite(r["mean"]) for r in df.collect()) and "explode" not in plans["replicates"]


def test_places_are_those_of_the_hash():
    for b, slots in (((0, 12), (0, 103)), ((95, 103), (9_990, 10_020)), ((1999, 2000), (99_999_990, 100_000_010))):
        want = [[int(hashlib.md5(f"11-{i}-{s}".encode()).hexdigest()[:8], 16) % 1237 for s in range(*slots)] for i in range(*b)]
        assert R.drawn_places(11, b, slots, 1237).tolist() == want
    assert R.drawn_places(11, (0, 1), (0, 5), 2**33).max() < 2**32
    with pytest.raises(ValueError):
        R.md5_heads(["x" * 55, np.array([1])])


@pytest.mark.parametrize("slots", [7, 1000])
def test_sums_of_blocks_are_those_of_the_weights(spark, tmp_path, monkeypatch, slots):
    monkeypatch.setattr(R, "PLACES", 16)
    monkeypatch.setattr(R, "DRAWS", 100)
    monkeypatch.setattr(R, "SLOTS", slots)
    monkeypatch.setattr(R, "BLOCK", 13)
    rows = [(u, c, float(u * u % 7), math.inf if (u, c) == (5, "a") else float(u)) for u in range(50) for c in "abc" if (u + ord(c)) % 3]
    spark.createDataFrame(rows, "unit long, cls string, x double, y double").write.parquet(f"{tmp_path}/rows")
    df = spark.read.parquet(f"{tmp_path}/rows")
    got = {(r["b"], r["cls"]): (r["x"], r["y"]) for r in R.drawn_sums(df, "unit", ["cls"], ["x", "y"], 40, 3).collect()}
    weights = R.bootstrap_weights(df.select("unit").distinct(), "unit", 40, 3)
    joined = weights.join(df, "unit").groupBy("b", "cls").agg(*[F.sum(F.col("times") * F.col(c)).alias(c) for c in "xy"])
    assert got == {(r["b"], r["cls"]): (r["x"], r["y"]) for r in joined.collect()}
    assert R.drawn_sums(df.where("false"), "unit", ["cls"], ["x", "y"], 40, 3).count() == 0
