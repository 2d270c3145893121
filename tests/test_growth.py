"""What grows with the tables stays off the driver and out of single rows."""

import os
from pathlib import Path

import pytest

from tessera.plans import registry

DATA = Path(os.environ.get("TESSERA_DATA", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables")


def test_stratified_draws_are_not_broadcast(spark):
    """The draws, exploded from the units, stay where they are; the units go round."""
    df = registry.queries()["t8_stratified_bootstrap"](spark, str(DATA))
    assert df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Generate explode" in plan and "BuildLeft" not in plan


@pytest.mark.parametrize("name", ["s6_label_tiers", "s5_known_units"])
def test_label_files_are_bounded_and_cut_row_by_row(spark, monkeypatch, name):
    """Files don't grow with the tables, and no Python worker holds a batch of them."""
    from tessera.plans import files

    monkeypatch.setattr(files, "TIERS_IN_A_FILE", 7)
    df = registry.queries()[name](spark, str(DATA))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.count() and "Python" not in plan and "MapInPandas" not in plan
    path = files.label_files(spark, str(DATA))
    lines = spark.read.text(path).selectExpr("_metadata.file_path as f", "value").where("value like 'class =%'").groupBy("f").count()
    assert lines.agg({"count": "max"}).first()[0] <= 7


def test_tiers_of_odd_files(spark, tmp_path):
    """Byte order marks, doubled quotes, long labels, other kinds of tiers and headings within labels."""
    from tessera.sources import tables as S

    def interval(a, b, label):
        return f'  intervals [1]:\n   xmin = {a}\n   xmax = {b} \n   text = "{label}"\n'

    odd = 'File type = "ooTextFile"\n' + "".join(
        [
            'item [1]:\n class = "IntervalTier"\n name = "a ""xmin = 7 xmax = 8 text = ""q"""\n',
            interval("0", "1.5e0", '""'),
            interval("1.5", "2", 'class = ""IntervalTier"" name = ""b""'),
            'item [2]:\n class = "TextTier"\n name = "p"\n',
            interval("5", "6", "not an interval"),
            'item [3]:\n class = "IntervalTier"\n name = "c"\n',
            interval("0", "1", "é" * 50_000 + '""' * 20_000),
            'item [4]:\n class = "IntervalTier"\n name = "none"\n',
        ]
    )
    for name, kind in (("u8", "utf-8"), ("sig", "utf-8-sig"), ("u16", "utf-16")):
        (tmp_path / f"{name}.TextGrid").write_bytes(odd.encode(kind))
    (tmp_path / "be.TextGrid").write_bytes(b"\xfe\xff" + odd.encode("utf-16-be"))
    (tmp_path / "empty.TextGrid").write_bytes(b"")
    got = S.tiers(spark, str(tmp_path)).orderBy("path", "tier", "pos").collect()
    one = [('a "xmin = 7 xmax = 8 text = "q"', 0, 0.0, 1.5, '"'), ('a "xmin = 7 xmax = 8 text = "q"', 1, 1.5, 2.0, 'class = "IntervalTier" name = "b"'), ("c", 0, 0.0, 1.0, "é" * 50_000 + '"' * 20_000)]
    assert [tuple(r)[1:] for r in got] == one * 4
    assert {r["path"].rsplit("/", 1)[1] for r in got} == {"u8.TextGrid", "sig.TextGrid", "u16.TextGrid", "be.TextGrid"}
    (tmp_path / "bad.TextGrid").write_bytes(b'class = "IntervalTier" name = "\xff\xff\xff"')
    with pytest.raises(Exception, match="(?i)malformed"):
        S.tiers(spark, str(tmp_path)).collect()


def test_vectors_are_read_once_and_norms_reckoned_once(spark, monkeypatch):
    """Every cut of c7 reads stored centroids; a unit vector's norm is not within the function of each component."""
    import math

    from pyspark.sql import functions as F

    from tessera.functions import columns as C
    from tessera.plans import more

    stored = []
    monkeypatch.setattr(more, "materialize", lambda df, label: stored.append(label) or keep(df, label), raising=False)
    from tessera.storage import materialize as keep

    assert len(registry.queries()["c7_class_partition_agreement"](spark, str(DATA)).collect()) == 4
    assert stored == ["centroids"]
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([],)], "v array<double>").select(C.unit(F.col("v")).alias("u"))
    assert [r["u"] for r in df.collect()] == [[0.6, 0.8], [0.0, 0.0], None, []]
    n = 1000
    wide = spark.range(1).select(F.array_repeat(F.lit(2.0), n).alias("v")).select(C.unit(F.col("v")).alias("u"))
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") <= 1 and math.isclose(wide.first()["u"][0], 1 / math.sqrt(n))
