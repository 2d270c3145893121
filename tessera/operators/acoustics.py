"""Acoustic measures of labelled segments: formants by Burg's method, mean pitch by autocorrelation, centre of gravity.

Segments are measured within the group of their file, so each file is decoded once. A measure that fails gives null and
an error text for its row and leaves the others alone.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import audio, gravity_centre

FORMANTS, WINDOW_S, LONG_S = 5, 0.025, 0.080
PITCH_FLOOR, PITCH_CEILING, VOICED = 50.0, 600.0, 0.45


def clamp(onset: float, fin: float, duration: float) -> tuple[float, float]:
    """The segment within the file; an empty one is an error."""
    lo, hi = max(0.0, onset), min(duration, fin)
    if hi <= lo:
        raise ValueError(f"empty segment {onset:.3f}-{fin:.3f} of {duration:.3f} s")
    return lo, hi


def burg(x: np.ndarray, order: int) -> np.ndarray:
    """Prediction polynomial (1, a1, ...) that minimises the forward and backward errors."""
    a = np.array([1.0])
    f, b = x[1:].astype(float), x[:-1].astype(float)
    for _ in range(order):
        d = f @ f + b @ b
        k = -2 * (f @ b) / d if d > 0 else 0.0
        a = np.r_[a, 0.0] + k * np.r_[0.0, a[::-1]]
        f, b = (f + k * b)[1:], (b + k * f)[:-1]
    return a


def formants_at(x: np.ndarray, rate: int, at: float, ceiling: float, n: int = FORMANTS) -> list[float]:
    """Formants below the ceiling in a Gaussian window around a time, lowest first."""
    new = 2 * ceiling
    m = int(len(x) * new / rate)
    low = np.fft.irfft(np.fft.rfft(x)[: m // 2 + 1], m) * m / len(x) if m < len(x) else x
    rate = new if m < len(x) else rate
    half = WINDOW_S * rate
    lo, hi = max(0, int(at * rate - half)), min(len(low), int(at * rate + half))
    part = np.append(low[lo], np.diff(low[lo:hi]) + (1 - math.exp(-2 * math.pi * 50 / rate)) * low[lo : hi - 1])
    part = part * np.exp(-12 * ((np.arange(len(part)) - len(part) / 2) / len(part)) ** 2)
    roots = np.roots(burg(part, 2 * n))
    freq = np.angle(roots[roots.imag > 0]) * rate / (2 * math.pi)
    return sorted(float(v) for v in freq if 50 <= v <= ceiling - 50)[:n]


def mean_pitch(x: np.ndarray, rate: int, floor: float = PITCH_FLOOR, ceiling: float = PITCH_CEILING) -> float:
    """Mean fundamental over voiced frames; NaN if none is voiced or the segment is shorter than a frame."""
    size, step = int(3 * rate / floor), int(0.75 * rate / floor)
    if len(x) < size:
        return math.nan
    window = np.hanning(size)
    own = np.fft.irfft(np.abs(np.fft.rfft(window, 2 * size)) ** 2)[:size]
    found = []
    for at in range(0, len(x) - size + 1, step):
        part = (x[at : at + size] - x[at : at + size].mean()) * window
        r = np.fft.irfft(np.abs(np.fft.rfft(part, 2 * size)) ** 2)[:size]
        if r[0] <= 0:
            continue
        r = (r / r[0]) / (own / own[0] + 1e-12)
        lags = np.arange(int(rate / ceiling), min(int(rate / floor), size // 2) + 1)
        peaks = lags[(r[lags] >= r[lags - 1]) & (r[lags] >= r[lags + 1])]
        if len(peaks) and (best := r[peaks]).max() >= VOICED:
            found.append(rate / float(peaks[np.flatnonzero(best >= best.max() - 0.01)[0]]))
    return float(np.mean(found)) if found else math.nan


MEASURES = "token_id long, f1_hz double, f2_hz double, f3_hz double, f1_25_hz double, f2_25_hz double, f1_75_hz double, f2_75_hz double, formants_ok boolean, formants_error string, f0_mean_hz double, f0_ok boolean, f0_error string, scg_hz double, scg_applicable boolean, scg_ok boolean, scg_error string, duration_ms double"


def measure(x: np.ndarray, rate: int, onset: float, fin: float, vowel: bool, fricative: bool, ceiling: float) -> dict:
    """One segment's measures: F3 for vowels only, quarter points for long vowels only, gravity for fricatives only."""
    out = {c.split()[0]: None for c in MEASURES.split(", ")[1:]} | {"formants_ok": False, "f0_ok": False, "scg_ok": False, "scg_applicable": bool(fricative), "duration_ms": (fin - onset) * 1000}

    def guard(what: str, f) -> None:
        try:
            out.update(f())
            out[f"{what}_ok"] = True
        except (ValueError, IndexError, np.linalg.LinAlgError) as e:
            out[f"{what}_error"] = f"{type(e).__name__}: {e}"

    def segment() -> np.ndarray:
        lo, hi = clamp(onset, fin, len(x) / rate)
        return x[int(lo * rate) : int(hi * rate)]

    def formants() -> dict:
        lo, hi = clamp(onset, fin, len(x) / rate)
        got = formants_at(x, rate, (lo + hi) / 2, ceiling)
        if len(got) < 2:
            raise ValueError("fewer than two formants")
        found = {"f1_hz": got[0], "f2_hz": got[1]} | ({"f3_hz": got[2]} if vowel and len(got) > 2 else {})
        if vowel and hi - lo > LONG_S:
            for q in (25, 75):
                side = formants_at(x, rate, lo + (hi - lo) * q / 100, ceiling)
                found |= {f"f{i}_{q}_hz": side[i - 1] for i in (1, 2) if len(side) >= i}
        return found

    def pitch() -> dict:
        f0 = mean_pitch(segment(), rate)
        if math.isnan(f0):
            raise ValueError("no voiced frame")
        return {"f0_mean_hz": f0}

    guard("formants", formants)
    guard("f0", pitch)
    if fricative:
        guard("scg", lambda: {"scg_hz": gravity_centre(segment(), rate)})
    return out


def extract(tokens: DataFrame, files: DataFrame) -> DataFrame:
    """tokens: token_id, path, onset, fin, vowel, fricative, ceiling; files: path, content. A token without a file gets errors."""
    known = files.select("path", audio("content").alias("a")).select("path", F.col("a.rate").alias("rate"), F.col("a.samples").alias("samples"))
    names = [c.split()[0] for c in MEASURES.split(", ")]

    def run(key: tuple, own: pd.DataFrame, sound: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame(columns=names)
        x = np.asarray(sound.samples.iloc[0], float) if len(sound) else np.zeros(0)
        rate = int(sound.rate.iloc[0]) if len(sound) else 16000
        rows = [{"token_id": t.token_id} | measure(x, rate, t.onset, t.fin, t.vowel, t.fricative, t.ceiling) for t in own.itertuples()]
        return pd.DataFrame(rows)[names]

    return tokens.groupBy("path").cogroup(known.groupBy("path")).applyInPandas(run, MEASURES)


def encode(files: DataFrame, encoder, layers: list[int]) -> DataFrame:
    """Frame vectors of each file by a given encoder: samples -> {layer: (frames, width)}; one pass per file. No model comes with the engine."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf.path, pdf.content, strict=True):
                x = np.asarray(audio.func(pd.Series([content])).samples.iloc[0])
                got = encoder(x)
                rows += [(path, layer, i, v.tolist()) for layer in layers for i, v in enumerate(np.asarray(got[layer], np.float32))]
            yield pd.DataFrame(rows, columns=["path", "layer", "frame", "vector"])

    return files.select("path", "content").mapInPandas(run, "path string, layer int, frame int, vector array<float>")
