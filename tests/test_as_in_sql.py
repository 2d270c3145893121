"""Odd ids and values: gender by whole-number division, NaN, and rounding of halves as in the oracle SQL."""

import math

import pytest
from pyspark.sql import functions as F

from jobs import queries as jobs
from tessera.functions import columns as C
from tessera.plans import registry


def plain(rows, columns):
    def cell(x):
        return "nan" if isinstance(x, float) and math.isnan(x) else x + 0.0 if isinstance(x, float) else x

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Negative ids, ids beyond 2**53, rows without an id or a class, NaN and infinity, and values of seven decimals that end in five."""
    import duckdb

    folder, con = tmp_path_factory.mktemp("odd"), duckdb.connect()
    con.sql("""create table events as select i as event_id, timestamp '2024-01-01' + to_minutes(i) as ts,
     case when i % 13 = 0 then null when i % 13 < 4 then -(i % 13) when i % 13 < 8 then 9007199254740993 + i % 13 else i % 13 end::bigint as user_id,
     case when i % 17 = 0 then null when i % 17 = 1 then '' else ['click', 'view', 'purchase', 'signup', 'error'][1 + i % 5] end as event_type,
     case when i = 40 then 'nan' when i = 41 then 'inf' when i = 42 then 0 when i % 19 = 0 then null else (i * 7919 % 1000000 * 10 + 5) / 1e7 end::double as value from range(3000) t(i)""")
    con.sql(f"copy events to '{folder}/events.parquet' (format parquet)")
    return str(folder), con


@pytest.mark.parametrize("name", ["job2_normalised", "f2_equality_slice", "p7_choice_by_group", "u2_distinct_units"])
def test_odd_rows_as_in_sql(spark, tables, name):
    folder, con = tables
    found, sql = {**registry.queries(), **jobs.QUERIES}, {**registry.oracles(), **jobs.ORACLES}
    df, rel = found[name](spark, folder), con.sql(sql[name])
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(rel.fetchall(), rel.columns)


def test_halves_are_rounded_as_in_sql(spark):
    import duckdb

    values = [s * (k * 7919 % 10**8 * 10 + 5) / 1e7 for k in range(5000) for s in (1, -1)] + [0.0, 0.49999999999999994e-6, 5e-7, 1e15, 1.7e308, 5e-324, math.inf, -math.inf, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i long, x double")
    got = [r[0] for r in df.orderBy("i").select(C.round_as_sql(F.col("x"), 6)).collect()]
    con = duckdb.connect()
    con.sql("create table t (i bigint, x double)")
    con.execute("insert into t select unnest(?::bigint[]), unnest(?::double[])", [list(range(len(values))), values])
    assert got == [r[0] for r in con.sql("select round(x, 6) from t order by i").fetchall()]
    assert math.isnan(spark.range(1).select(C.round_as_sql(F.lit(math.nan), 6)).first()[0])
