import io
import math
import wave

import numpy as np
import pandas as pd
import pytest

from tessera.functions import columns as C
from tessera.operators import describe as D
from tessera.operators import vectors as V
from tessera.sources import tables as S
from pyspark.sql import functions as F


def test_unit_metadata_and_slots(spark, tmp_path):
    (tmp_path / "m.csv").write_text("spk;L1;Gender\nAB; FR ;f\nCD;en;M\n")
    assert [tuple(r) for r in S.unit_metadata(spark, str(tmp_path / "m.csv")).orderBy("unit").collect()] == [("AB", "L1", "F"), ("CD", "L2", "M")]
    (tmp_path / "s.tsv").write_text("Word\tIpa\tocc.1\tocc.2\nchat\tʃ;a\t3\tx\nlait\tN/A\t3\t4\n")
    got = {r["slot"]: (r["word"], r["repetition"], r["symbols"]) for r in S.slots(spark, str(tmp_path / "s.tsv"), 2).collect()}
    assert got == {3: ("lait", 1, []), 4: ("lait", 2, [])}


def test_tiers_keep_empty_intervals(spark, tmp_path):
    text = 'class = "IntervalTier"\n name = "words"\n intervals [1]:\n xmin = 0\n xmax = 0.5\n text = ""\n intervals [2]:\n xmin = 0.5\n xmax = 1\n text = "a ""b"""\n'
    (tmp_path / "ab_FRcorp12.TextGrid").write_text(text)
    df = S.tiers(spark, str(tmp_path))
    unit, slot = S.unit_and_slot(F.col("path"))
    rows = df.select(unit, slot, "pos", "onset", "label").orderBy("pos").collect()
    assert [tuple(r) for r in rows] == [("AB", 12, 0, 0.0, ""), ("AB", 12, 1, 0.5, 'a "b"')]


def test_archives_round_trip_and_check_lengths(spark, tmp_path):
    (tmp_path / "x.npz").write_bytes(S.archive_bytes([[1, 2], [3, 4]], [7, 9]))
    assert {r["token_id"]: list(r["embedding"]) for r in S.archives(spark, str(tmp_path / "x.npz")).collect()} == {7: [1, 2], 9: [3, 4]}


def test_audio_and_gravity_centre(spark, tmp_path):
    t = np.arange(8000) / 8000
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes((np.sin(2 * np.pi * 1000 * t) * 20000).astype("<i2").tobytes())
    got = S.audio.func(pd.Series([out.getvalue()]))
    assert len(got.samples[0]) == 16000
    assert S.gravity_centre(np.asarray(got.samples[0]), 16000) == pytest.approx(1000, rel=0.1)


def test_unique_keys_and_columns(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError):
        S.assert_unique(df, ["k"])
    with pytest.raises(ValueError):
        S.require_columns(df, ["z"])
    assert S.model_layers({"m": {"a": [1, 2], "b": {"layers": [3]}}}, "m") == [("a", 1), ("a", 2), ("b", 3)]


def test_one_file_each(spark):
    files = spark.createDataFrame([("u", 1, "p1"), ("v", 1, "q1")], "unit string, slot int, path string")
    wanted = spark.createDataFrame([("u", 1), ("w", 1)], "unit string, slot int")
    assert {r["unit"]: r["path"] for r in S.one_file_each(wanted, files, ["unit", "slot"]).collect()} == {"u": "p1", "w": None}


def test_symbol_and_word_folding(spark):
    df = spark.createDataFrame([("b̥",), ("aː",), ("ɑ̃",), ("sʲ",), (None,)], "x string")
    assert [r[0] for r in df.select(C.base_symbol(F.col("x"))).collect()] == ["b", "a", "ɑ̃", "s", None]
    w = spark.createDataFrame([("  L’Été ",), ("é",)], "x string")
    assert [r[0] for r in w.select(C.fold_word(F.col("x"))).collect()] == ["l'été", "é"]


def test_missing_values_are_null(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), ("inf",), (None,)], "x string")
    assert [r[0] for r in df.select(C.number(F.col("x"))).collect()] == [1.5, None, None, None, None]


def test_lobanov_edges(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("a", 3.0, True), ("a", 9.0, False), ("b", 2.0, True), ("c", 5.0, True), ("c", 5.0, True), (None, 1.0, True), (None, 2.0, True)], "u string, x double, fit boolean")
    got = D.lobanov(df, "u", {"x": "x"}, F.col("fit")).where("u is not null").orderBy("u", "x").select("x_norm").collect()
    s = math.sqrt(0.5)
    assert [r[0] for r in got] == [pytest.approx(-s), pytest.approx(s), None, None, None, None]


def test_zero_vector_rules(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    row = df.select(C.cosine_distance(F.col("a"), F.col("b")), C.cosine_distance(F.col("a"), F.col("b"), False)).first()
    assert tuple(row) == (None, 1.0)


def test_pairs_closed_form_equals_brute_force(spark):
    x = np.random.default_rng(0).normal(size=(9, 4))
    x[3] = 0
    df = spark.createDataFrame([(i % 2, v.tolist()) for i, v in enumerate(x)], "g int, v array<double>")
    for rule in ("unit", "drop"):
        got = {r["g"]: r["mean_distance"] for r in V.mean_pair_cosine(df, ["g"], "v", rule).collect()}
        for g in (0, 1):
            own = [v for i, v in enumerate(x) if i % 2 == g and (rule == "unit" or v.any())]
            unit = [v / (np.linalg.norm(v) or 1) for v in own]
            want = np.mean([1 - unit[i] @ unit[j] for i in range(len(own)) for j in range(i)])
            assert got[g] == pytest.approx(want)


def test_missing_aware_distance(spark):
    df = spark.createDataFrame([("a", [1.0, None]), ("b", [4.0, 2.0]), ("c", [None, 3.0])], "l string, v array<double>")
    got = {(r["a"], r["b"]): r["d"] for r in V.missing_aware_matrix(df, "l", "v").collect()}
    assert got == {("a", "b"): pytest.approx(math.sqrt(18)), ("a", "c"): pytest.approx(math.sqrt(18)), ("b", "c"): pytest.approx(math.sqrt(2))}


def test_q_values_keep_missing(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "k int, p double").withColumn("f", F.lit("x"))
    got = {r["k"]: r["q_value_bh"] for r in D.benjamini_hochberg(df, ["f"], "p", ["k"]).collect()}
    assert got == {1: pytest.approx(0.03), 2: pytest.approx(0.04), 3: pytest.approx(0.04), 4: None}


def test_folds_take_whole_texts(spark, tmp_path):
    from tessera.plans import registry

    # One word's fold is tested above; a long text's is that of its parts.
    words = ["ʃːʲ", "É", "e\u0301", "l’Été", "plain", "ɑ̃"] * 40
    spark.createDataFrame([(1, " ".join(words)), (2, None), (3, "x" * 90 + "É ")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {n: {r[0]: r[1] for r in registry.queries()[n](spark, str(tmp_path)).collect()} for n in ("p1_base_symbols", "p2_fold_words")}
    assert got["p1_base_symbols"] == {1: " ".join(["ʃ", "E", "e", "l’Ete", "plain", "ɑ̃"] * 40), 2: None, 3: "x" * 90 + "E "}
    assert got["p2_fold_words"] == {1: " ".join(["ʃːʲ", "é", "é", "l'été", "plain", "ɑ̃"] * 40), 2: None, 3: "x" * 90 + "é"}
