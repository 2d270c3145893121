import io
import wave

import numpy as np
import pytest

from tessera.operators import acoustics as A

RATE = 16000


def vowel(f0=120.0, formants=((500, 60), (1500, 90), (2500, 120)), seconds=0.4):
    n = int(RATE * seconds)
    x = np.zeros(n)
    x[(np.arange(0, n, RATE / f0)).astype(int)] = 1
    for f, bw in formants:
        r, w = np.exp(-np.pi * bw / RATE), 2 * np.pi * f / RATE
        y = np.zeros(n)
        for i in range(n):
            y[i] = x[i] + 2 * r * np.cos(w) * (y[i - 1] if i else 0) - r * r * (y[i - 2] if i > 1 else 0)
        x = y
    return x / np.abs(x).max() * 0.8


def test_pitch_and_formants_of_a_made_vowel():
    x = vowel()
    assert A.mean_pitch(x, RATE) == pytest.approx(120, rel=0.02)
    got = A.formants_at(x, RATE, 0.2, 5000)
    for want in (500, 1500, 2500):
        assert min(abs(g - want) for g in got) < 120


def test_noise_has_no_pitch():
    assert np.isnan(A.mean_pitch(np.random.default_rng(0).normal(size=RATE // 2), RATE))


def test_clamping():
    assert A.clamp(-1, 0.5, 0.4) == (0.0, 0.4)
    with pytest.raises(ValueError):
        A.clamp(0.6, 0.7, 0.5)


def test_rows_fail_alone(spark):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(RATE)
        w.writeframes((vowel() * 32000).astype("<i2").tobytes())
    files = spark.createDataFrame([("a", bytearray(out.getvalue()))], "path string, content binary")
    rows = [(1, "a", 0.05, 0.35, True, False, 5000.0), (2, "a", 0.9, 1.0, True, False, 5000.0), (3, "b", 0.0, 0.1, False, True, 4500.0)]
    tokens = spark.createDataFrame(rows, "token_id long, path string, onset double, fin double, vowel boolean, fricative boolean, ceiling double")
    got = {r["token_id"]: r for r in A.extract(tokens, files).collect()}
    assert got[1]["formants_ok"] and got[1]["f1_25_hz"] is not None and got[1]["f0_mean_hz"] == pytest.approx(120, rel=0.03)
    assert not got[2]["formants_ok"] and "empty segment" in got[2]["formants_error"]
    assert got[3]["scg_applicable"] and not got[3]["scg_ok"]


def test_encoder_runs_once_per_file(spark):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(RATE)
        w.writeframes(np.zeros(3200, "<i2").tobytes())
    files = spark.createDataFrame([("a", bytearray(out.getvalue()))], "path string, content binary")
    got = A.encode(files, lambda x: {4: np.full((len(x) // 320, 2), 0.5)}, [4]).collect()
    assert len(got) == 10 and list(got[0]["vector"]) == [0.5, 0.5]
