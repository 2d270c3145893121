"""Rows, q-values and replicate counts of the tests that have no oracle SQL."""

from math import comb

import numpy as np
import pytest
from tessera.plans import inference, more, registry


def adjusted(p: list[float]) -> list[float]:
    order = np.argsort(p)
    q = np.array(p)[order] * len(p) / np.arange(1, len(p) + 1)
    out = np.empty(len(p))
    out[order] = np.minimum(np.minimum.accumulate(q[::-1])[::-1], 1)
    return out.tolist()


def test_mcnemar_has_rows_per_status(spark, tmp_path):
    data = [(i, int(i % 3 == 0), int(i % 5 == 0 and i < 30)) for i in range(60)]
    spark.createDataFrame(data, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["rows"]: r for r in registry.queries()["t9_mcnemar"](spark, str(tmp_path)).collect()}
    want = {}
    for name, own in (("all", data), ("L1", data[::2]), ("L2", data[1::2])):
        b, c = sum(q > t for _, q, t in own), sum(q < t for _, q, t in own)
        want[name] = (b + c, min(1.0, 2 * sum(comb(b + c, k) for k in range(min(b, c) + 1)) / 2 ** (b + c)))
    assert {k: r["n"] for k, r in got.items()} == {k: n for k, (n, _) in want.items()}
    for (k, (_, p)), q in zip(want.items(), adjusted([p for _, p in want.values()]), strict=True):
        assert (got[k]["p_value"], got[k]["q_value_bh"]) == (pytest.approx(p, abs=1e-6), pytest.approx(q, abs=1e-6))


def test_permutations_are_adjusted(spark, tmp_path, monkeypatch):
    assert inference.PERMUTATIONS == more.PERMUTATIONS == 5000
    monkeypatch.setattr(inference, "PERMUTATIONS", 50)
    x = np.random.default_rng(1).normal(size=(120, 64))
    df = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "vec_id long, label long, embedding array<double>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.queries()["t4_permutation_test"](spark, str(tmp_path)).orderBy("cls").collect()
    assert len(got) == 3 and all(abs(r["p_value"] * 51 - round(r["p_value"] * 51)) < 1e-3 for r in got)
    assert [r["q_value_bh"] for r in got] == pytest.approx(adjusted([r["p_value"] for r in got]), abs=2e-6)
