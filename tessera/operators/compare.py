"""Tests of two groups for any number of values: statistics from sums and from counts per value, p-values from the statistics alone.

No task gets a group's values together, but for Shapiro and Wilk's test, which is defined for up to 5000 of them. Order statistics
come from counts per different value in buckets (describe.value_cells), so medians, ranks and quantiles of large groups are many tasks' work.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import kernels as K
from ..functions.columns import normal_quantile
from .describe import with_column_of, buckets, value_cells

SHAPIRO = (3, 5000)


def medians(df: DataFrame, keys: list[str], x: str, name: str) -> DataFrame:
    """The median per group: the mean of the values at its two middle places."""
    cells = value_cells(df, keys, x, buckets(df.sparkSession))
    low, high = F.floor((F.col("size") - 1) / 2), F.floor(F.col("size") / 2)
    held = lambda place: (F.col("before") <= place) & (place < F.col("before") + F.col("n"))
    ends = cells.groupBy(*keys).agg(F.max(F.when(held(low), F.col(x))).alias("_lo"), F.max(F.when(held(high), F.col(x))).alias("_hi"))
    return ends.select(*keys, ((F.col("_lo") + F.col("_hi")) / 2).alias(name))


def two_group_statistics(df: DataFrame, keys: list[str], group: str, a: str, b: str, x: str) -> DataFrame:
    """Per keys: n_a, n_b, mean_a, mean_b, difference (b - a), t (pooled), levene_f (about the medians), u (of a), ties (sum of t^3 - t over equal values).

    t and levene_f are null without variance or with fewer than two values in a group. x must be stored, not computed anew by each reading of the plan."""
    rows = df.where(F.col(x).isNotNull() & F.col(group).isin(a, b)).select(*keys, group, x)
    far = with_column_of(rows, medians(rows, [*keys, group], x, "_median"), [*keys, group], "_median").withColumn("_z", F.abs(F.col(x) - F.col("_median")))

    def of(which: str, f, column: str) -> Column:
        return f(F.when(F.col(group) == which, F.col(column)))

    names = {"n": (F.count, x), "mean": (F.avg, x), "v": (F.var_samp, x), "zm": (F.avg, "_z"), "zv": (F.var_pop, "_z")}
    sums = far.groupBy(*keys).agg(*[of(g, f, c).alias(f"{k}_{s}") for k, (f, c) in names.items() for s, g in (("a", a), ("b", b))])

    cells = value_cells(rows, keys, x, buckets(df.sparkSession))
    own = rows.where(F.col(group) == a).groupBy(*keys, x).agg(F.count("*").alias("_n_a"))
    placed = with_column_of(cells, own, [*keys, x], "_n_a")
    ranks = placed.groupBy(*keys).agg(F.sum(F.coalesce("_n_a", F.lit(0)) * (F.col("before") + (F.col("n") + 1) / 2)).alias("_ranks"), F.sum(F.col("n").cast("double") * F.col("n") * F.col("n") - F.col("n")).alias("ties"))
    both = with_column_of(with_column_of(sums, ranks, keys, "_ranks"), ranks, keys, "ties")

    n, m = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    pooled = ((n - 1) * F.col("v_a") + (m - 1) * F.col("v_b")) / (n + m - 2)
    enough = (n > 1) & (m > 1)
    t = F.when(enough & (pooled > 0), (F.col("mean_a") - F.col("mean_b")) / F.sqrt(pooled * (1 / n + 1 / m)))
    within = n * F.col("zv_a") + m * F.col("zv_b")
    middle = (n * F.col("zm_a") + m * F.col("zm_b")) / (n + m)
    spread = n * (F.col("zm_a") - middle) ** 2 + m * (F.col("zm_b") - middle) ** 2
    levene = F.when(enough & (within > 0), (n + m - 2) * spread / within)
    u = F.when(enough, F.col("_ranks") - n * (n + 1) / 2)
    return both.select(*keys, "n_a", "n_b", "mean_a", "mean_b", (F.col("mean_b") - F.col("mean_a")).alias("difference"), t.alias("t"), levene.alias("levene_f"), u.alias("u"), "ties")


@F.pandas_udf(DoubleType())
def _t_p(t: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([K.t_sf2(x, a + b - 2) if not math.isnan(x) else math.nan for x, a, b in zip(t, n, m, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def _f_p(f: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([K.f_sf(x, 1, a + b - 2) if not math.isnan(x) else math.nan for x, a, b in zip(f, n, m, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def _u_p(u: pd.Series, n: pd.Series, m: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([K.mann_whitney_p(x, int(a), int(b), c) if not math.isnan(x) else math.nan for x, a, b, c in zip(u, n, m, ties, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def _shapiro_p(values: pd.Series) -> pd.Series:
    return pd.Series([K.shapiro_wilk(v)[1] if v is not None else math.nan for v in values], dtype=float)


def normality(df: DataFrame, keys: list[str], x: str, name: str) -> DataFrame:
    """p of Shapiro and Wilk's test per group of 3 to 5000 values; null for others, whose values aren't gathered."""
    sizes = df.groupBy(*keys).agg(F.count(x).alias("_size"))
    few = with_column_of(df, sizes, keys, "_size").where(F.col("_size").between(*SHAPIRO))
    tested = few.groupBy(*keys).agg(F.collect_list(x).alias("_values")).select(*keys, _shapiro_p("_values").alias(name))
    return with_column_of(sizes, tested, keys, name).select(*keys, F.when(~F.isnan(name), F.col(name)).alias(name))


def two_group_tests(df: DataFrame, keys: list[str], group: str, a: str, b: str, x: str, alpha: float = 0.05) -> DataFrame:
    """two_group_statistics with the tests' p-values: the t-test where both groups look normal with equal spread, else Mann and Whitney's."""
    rows = df.where(F.col(x).isNotNull())
    got = two_group_statistics(rows, keys, group, a, b, x)
    for side, g in (("a", a), ("b", b)):
        got = with_column_of(got, normality(rows.where(F.col(group) == g), keys, x, f"shapiro_p_{side}"), keys, f"shapiro_p_{side}")
    enough = (F.col("n_a") > 1) & (F.col("n_b") > 1)
    shapiro = {f"shapiro_p_{s}": F.when(enough, F.col(f"shapiro_p_{s}")) for s in "ab"}
    got = got.withColumns(shapiro | {"levene_p": _f_p("levene_f", "n_a", "n_b"), "_t_p": _t_p("t", "n_a", "n_b"), "_u_p": _u_p("u", "n_a", "n_b", "ties")})
    good = F.lit(True)
    for c in ("shapiro_p_a", "shapiro_p_b", "levene_p"):
        good = good & F.coalesce(F.col(c) > alpha, F.lit(False))
    got = got.withColumn("assumptions_hold", enough & good)
    held = F.col("assumptions_hold")
    test = F.when(~enough, "insufficient_data").when(held, "t_test").otherwise("mann_whitney_u")
    p = F.when(enough, F.when(held, F.col("_t_p")).otherwise(F.col("_u_p")))
    statistic = F.when(held, F.col("t")).otherwise(F.col("u"))
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("shapiro_p_a", "shapiro_p_b", "levene_p")]
    return got.select(*keys, "n_a", "n_b", "mean_a", "mean_b", *clean, test.alias("selected_test"), statistic.alias("statistic"), F.when(~F.isnan(p), p).alias("p_value"), "assumptions_hold", "difference")


def normal_plot(df: DataFrame, keys: list[str], x: str, least: int = 3) -> DataFrame:
    """Rows of groups of at least `least` values with `theoretical`, the normal quantile at Filliben's median of their place."""
    cells = value_cells(df.where(F.col(x).isNotNull()), keys, x, buckets(df.sparkSession)).where(F.col("size") >= least)
    each = cells.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).withColumn("_i", F.col("_i") + F.col("before"))
    n, end = F.col("size"), F.pow(F.lit(0.5), 1 / F.col("size"))
    at = F.when(F.col("_i") == 1, 1 - end).when(F.col("_i") == n, end).otherwise((F.col("_i") - 0.3175) / (n + 0.365))
    return each.select(*keys, x, normal_quantile(at).alias("theoretical"))
