"""Every registered query of the engine's own operators against its oracle SQL on the smallest tables."""

import math
import os
from pathlib import Path

import pytest

from tessera.plans import registry

DATA = Path(os.environ.get("TESSERA_DATA", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables")


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.sql(f"create view {f.stem} as select * from '{f}'")
    return c


def rows(values, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(x):
        if x is None or isinstance(x, (bool, str)):
            return str(x)
        try:
            x = float(x)
        except (TypeError, ValueError):
            return str(x)
        return "nan" if math.isnan(x) else f"{round(x, 4) + 0.0:.4f}"

    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, str(DATA))
    got = rows([tuple(r) for r in df.collect()], df.columns)
    sql = registry.oracles().get(name)
    if sql is None:
        assert got[1]
        return
    rel = con.sql(sql)
    want = rows(rel.fetchall(), rel.columns)
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1], strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or math.isclose(float(x), float(y), abs_tol=2e-4, rel_tol=1e-4)


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
