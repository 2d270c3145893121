"""Centroids, distance matrices and dispersion of dense vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import cosine_distance, euclidean, missing_aware_euclidean, norm, unit


def mean_vectors(df: DataFrame, keys: list[str], vector: Column, name: str = "centroid") -> DataFrame:
    """Mean vector and count per group: sums per component are combined map-side, so nothing of a group is gathered but its sums."""
    parts = df.select(*keys, F.posexplode(vector).alias("dim", "x"))
    per = parts.groupBy(*keys, "dim").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    sums = per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dim", "m"))).alias("_v"), F.max("n").alias("n"))
    return sums.select(*keys, F.transform("_v", lambda s: s["m"]).alias(name), "n")


def vector_sums(df: DataFrame, keys: list[str], vector: str, width: int, weight: Column | None = None, name: str = "total") -> DataFrame:
    """Sum of vectors of a known width per group, one plain sum per component, so that rows are neither exploded nor gathered."""
    w = F.lit(1.0) if weight is None else weight
    got = df.groupBy(*keys).agg(*[F.sum(F.col(vector)[i] * w).alias(f"_s{i}") for i in range(width)])
    return got.select(*keys, F.array(*[f"_s{i}" for i in range(width)]).alias(name))


def sum_vectors(df: DataFrame, keys: list[str], vector: str, name: str = "total") -> DataFrame:
    """Sum vector and count per group, of vectors of any width; sums per component are combined map-side."""
    parts = df.select(*keys, F.posexplode(vector).alias("dim", "x"))
    per = parts.groupBy(*keys, "dim").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    got = per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dim", "s"))).alias("_v"), F.max("n").alias("n"))
    return got.select(*keys, F.transform("_v", lambda s: s["s"]).alias(name), "n")


#: Bytes up to which all classes' vectors are sent to every task.
BROADCAST = 64 << 20


def beside_all(df: DataFrame, classes: DataFrame, vector: str, name: str) -> DataFrame:
    """df with all rows of classes, one per class, as an array in the order of their first column. Their size is looked at before they are broadcast."""
    size = classes.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("w")).first()
    one = classes.agg(F.array_sort(F.collect_list(F.struct(*classes.columns))).alias(name))
    return df.crossJoin(F.broadcast(one) if size["n"] * (size["w"] or 0) * 8 <= BROADCAST else one)


def own_classes(df: DataFrame, unit: str, cls: str, name: str) -> DataFrame:
    """One row per unit: a map from its classes to the other columns of df, which has a row per (unit, class)."""
    rest = [c for c in df.columns if c not in (unit, cls)]
    return df.groupBy(unit).agg(F.map_from_entries(F.collect_list(F.struct(cls, F.struct(*rest)))).alias(name))


def pairs(centroids: DataFrame, label: str, vector: str, distance, upper: bool = True) -> DataFrame:
    """Distances of all pairs of labels. centroids has one row per class, so this is a join of a handful of rows."""
    a = centroids.select(F.col(label).alias("a"), F.col(vector).alias("_x"))
    b = centroids.select(F.col(label).alias("b"), F.col(vector).alias("_y"))
    on = F.col("a") < F.col("b") if upper else F.lit(True)
    return a.join(b, on).select("a", "b", distance(F.col("_x"), F.col("_y")).alias("d"))


def cosine_matrix(centroids: DataFrame, label: str, vector: str, upper: bool = True) -> DataFrame:
    return pairs(centroids, label, vector, lambda x, y: cosine_distance(x, y, zero_is_missing=False), upper)


def euclidean_matrix(centroids: DataFrame, label: str, vector: str, upper: bool = True) -> DataFrame:
    return pairs(centroids, label, vector, euclidean, upper)


def missing_aware_matrix(centroids: DataFrame, label: str, vector: str) -> DataFrame:
    """Pairs that share no component take the largest distance there is."""
    got = pairs(centroids, label, vector, missing_aware_euclidean)
    most = got.agg(F.max("d").alias("_most"))
    return got.crossJoin(F.broadcast(most)).select("a", "b", F.coalesce("d", "_most").alias("d"))


def mahalanobis_matrix(centroids: DataFrame, label: str, x: str, y: str, xx: float, xy: float, yy: float, ridge: float = 1e-6) -> DataFrame:
    """Two features, covariance (xx, xy, yy) with a ridge of its mean variance; negative squares count as zero."""
    scale = (xx + yy) / 2
    scale = scale if scale > 0 else 1.0
    a, c = xx + ridge * scale, yy + ridge * scale
    det = a * c - xy * xy
    both = centroids.select(F.col(label).alias("l"), F.col(x).alias("x"), F.col(y).alias("y"))
    p, q = both.toDF("a", "ax", "ay"), both.toDF("b", "bx", "by")
    u, v = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    square = (u * u * c - 2 * u * v * xy + v * v * a) / det
    return p.join(q, F.col("a") < F.col("b")).select("a", "b", F.sqrt(F.greatest(square, F.lit(0.0))).alias("d"))


def between_class_ratio(df: DataFrame, cls: str, vector: Column) -> DataFrame:
    """Sum of n_c |m_c - m|^2 over sum of |x - m|^2, from sums per class and component."""
    parts = df.select(F.col(cls).alias("c"), F.posexplode(vector).alias("dim", "x"))
    per = parts.groupBy("c", "dim").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    dims = per.groupBy("dim").agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.sum("q").alias("q"), (F.sum("s") * F.sum("s") / F.sum("n")).alias("g"))
    got = dims.agg((F.sum("b") - F.sum("g")).alias("between"), (F.sum("q") - F.sum("g")).alias("total"))
    return got.select(F.when(F.col("total") > 0, F.col("between") / F.col("total")).alias("ratio"))


def mean_pair_cosine(df: DataFrame, keys: list[str], vector: str, zero: str = "unit") -> DataFrame:
    """Mean cosine distance over the pairs within each group, without pairs: (|sum u|^2 - sum |u|^2) / (n (n - 1)).

    zero: "unit" takes the zero vector's length as one (distance 1 to all), "drop" leaves out pairs with one."""
    rows = df.where(norm(F.col(vector)) > 0) if zero == "drop" else df
    parts = rows.select(*keys, F.posexplode(unit(F.col(vector))).alias("dim", "x"))
    per = parts.groupBy(*keys, "dim").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    sums = per.groupBy(*keys).agg(F.sum(F.col("s") * F.col("s")).alias("s2"), F.sum("q").alias("q"), F.max("n").alias("n")).where("n > 1")
    n = F.col("n").cast("double")
    return sums.select(*keys, "n", (n * (n - 1) / 2).alias("n_pairs"), (1 - (F.col("s2") - F.col("q")) / (n * (n - 1))).alias("mean_distance"))


def unit_vectors(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn(vector, unit(F.col(vector)))
