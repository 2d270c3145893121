"""Runs of labels and spans of frames within ordered sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def target_runs(df: DataFrame, unit: str, order: list[str], word: str, target: str) -> DataFrame:
    """(unit, first_word, last_word) of the first run of neighbouring words that together spell the target, places from 1.

    Words aren't empty, so a run has no more words than the target has characters, and each place looks that far ahead; a unit is
    sorted and streamed, never gathered."""
    n = len(target)
    w = Window.partitionBy(unit).orderBy(*order)
    ahead = F.collect_list(word).over(w.rowsBetween(0, n - 1))
    rows = df.select(unit, F.row_number().over(w).cast("long").alias("first_word"), ahead.alias("_w"))
    rows = rows.where(F.startswith(F.array_join("_w", ""), F.lit(target)))
    ends = F.transform(F.sequence(F.lit(1), F.size("_w")), lambda k: F.length(F.array_join(F.slice("_w", F.lit(1), k), "")))
    hits = rows.withColumn("_k", F.array_position(ends, n)).where("_k > 0")
    return hits.groupBy(unit).agg(F.min("first_word").alias("first_word"), F.min_by(F.col("first_word") + F.col("_k") - 1, "first_word").alias("last_word"))


def pooled_frames(frames: Column, onset: Column, fin: Column, rate: float) -> Column:
    """Mean of the frames (an array of vectors) of a span in seconds; an empty span takes the frame nearest to its middle, halves to even."""
    n = F.size(frames)
    a, b = F.least(F.floor(onset * rate).cast("int"), n), F.least(F.ceil(fin * rate).cast("int"), n)
    middle = F.least(F.rint((onset + fin) / 2 * rate).cast("int"), n - 1)
    own = F.when(b > a, F.slice(frames, F.greatest(a, F.lit(0)) + 1, F.greatest(b - F.greatest(a, F.lit(0)), F.lit(1)))).otherwise(F.slice(frames, middle + 1, F.lit(1)))
    total = F.aggregate(own, F.transform(F.get(own, F.lit(0)), lambda x: F.lit(0.0)), lambda s, v: F.zip_with(s, v, lambda p, q: p + q))
    return F.when(n > 0, F.transform(total, lambda x: x / F.size(own)))
