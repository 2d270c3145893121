"""Leave-one-unit-out nearest centroids, and scores of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import cosine_distance, euclidean
from .vectors import beside_all, own_classes, sum_vectors


def leave_one_unit_out(df: DataFrame, key: str, unit: str, cls: str, vector: str, cosine: bool = False) -> DataFrame:
    """Predictions from centroids without the row's own unit: (sum of all - sum of the unit) / (count of all - count of the unit).

    Each row meets the sums of its own unit's classes, and all classes' sums; what is left of a class without the unit is reckoned in the row.
    So nothing grows with units x classes. Classes seen in one unit only drop out of its fold; folds with fewer than two classes give nothing."""
    own = own_classes(sum_vectors(df, [unit, cls], vector), unit, cls, "_own")
    rows = beside_all(df.join(own, unit), sum_vectors(df, [cls], vector), "total", "_all")

    def rest(t: Column) -> Column:
        mine = F.try_element_at("_own", t[cls])
        left = F.zip_with(t["total"], mine["total"], lambda a, b: a - b)
        return F.struct(t[cls].alias("pred"), F.coalesce(left, t["total"]).alias("s"), (t["n"] - F.coalesce(mine["n"], F.lit(0))).alias("n"))

    d = (lambda a, b: cosine_distance(a, b, zero_is_missing=False)) if cosine else euclidean

    def scored(t: Column) -> Column:
        return F.struct(d(F.col(vector), F.transform(t["s"], lambda x: x / t["n"])).alias("d"), t["pred"].alias("pred"))

    folds = rows.select(key, unit, cls, vector, F.filter(F.transform("_all", rest), lambda t: t["n"] > 0).alias("_left")).where(F.size("_left") > 1)
    best = folds.select(key, unit, cls, F.array_min(F.transform("_left", scored))["pred"].alias("pred"))
    return best.select(key, unit, cls, "pred", (F.col(cls) == F.col("pred")).alias("correct"))


def accuracy(predictions: DataFrame, group: str, correct: str = "correct") -> DataFrame:
    """Overall (group null) and per group, in one pass."""
    return predictions.groupingSets([[], [F.col(group)]], F.col(group)).agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("accuracy"))


def f1_by_class(predictions: DataFrame, true: str, pred: str) -> DataFrame:
    """F1 of every class that occurs; 0 where nothing is there to divide by."""
    both = predictions.select(F.explode(F.array(F.struct(F.col(true).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(true) == F.col(pred)).cast("int").alias("h")), F.struct(F.col(pred).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("h")))).alias("r"))
    per = both.groupBy(F.col("r.c").alias("label")).agg(F.sum("r.h").alias("tp"), (F.sum("r.t") + F.sum("r.p")).alias("d"))
    return per.select("label", F.when(F.col("d") > 0, 2 * F.col("tp") / F.col("d")).otherwise(F.lit(0.0)).alias("f1"))


def confusion(predictions: DataFrame, true: str, pred: str) -> DataFrame:
    """Counts over the grid of labels and shares of each row."""
    labels = predictions.select(F.col(true).alias("l")).union(predictions.select(F.col(pred).alias("l"))).distinct()
    grid = labels.withColumnRenamed("l", "t").join(labels.withColumnRenamed("l", "p"), F.lit(True))
    counts = predictions.groupBy(F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    full = grid.join(counts, ["t", "p"], "left").select("t", "p", F.coalesce("n", F.lit(0)).alias("n"))
    rows = full.groupBy("t").agg(F.sum("n").alias("row_n"))
    return full.join(rows, "t").select("t", "p", "n", (F.col("n") / F.greatest("row_n", F.lit(1))).alias("share"))


def discordance(predictions: DataFrame, rep: str, key: str, correct: str) -> DataFrame:
    """Of each pair of representations: matched rows, and those only one has right."""
    a = predictions.select(F.col(rep).alias("rep_a"), F.col(key).alias("_k"), F.col(correct).alias("x"))
    b = predictions.select(F.col(rep).alias("rep_b"), F.col(key).alias("_k"), F.col(correct).alias("y"))
    both = a.join(b, "_k").where("rep_a < rep_b")
    return both.groupBy("rep_a", "rep_b").agg(F.count("*").alias("n_matched"), F.sum((F.col("x") & ~F.col("y")).cast("long")).alias("a_only"), F.sum((~F.col("x") & F.col("y")).cast("long")).alias("b_only"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two partitions of the rows, from their contingency counts."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    two = lambda x: F.sum(x * (x - 1) / 2)
    n = F.col("n")
    rows, cols = cells.groupBy(a).agg(F.sum("n").alias("n")), cells.groupBy(b).agg(F.sum("n").alias("n"))
    got = cells.agg(two(n).alias("index"), F.sum("n").alias("all")).crossJoin(rows.agg(two(n).alias("ra"))).crossJoin(cols.agg(two(n).alias("rb")))
    expected = F.col("ra") * F.col("rb") / (F.col("all") * (F.col("all") - 1) / 2)
    most = (F.col("ra") + F.col("rb")) / 2
    return got.select(F.when(most == expected, F.lit(1.0)).otherwise((F.col("index") - expected) / (most - expected)).alias("ari"))
