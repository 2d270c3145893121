"""What several operators share: tables in the shared folder and distributed connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialize, new_path, shared_dir

__all__ = ["connected_components", "discard", "materialize", "new_path", "shared_dir"]


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star steps.

    edges: columns a, b (long). Returns node, component (the smallest node of the component) for every
    node with an edge to another one. Each step is a minimum per node (combined on the map side) and a join
    back, so a node of very high degree is a skewed join that Spark splits, never a collected list.
    Each round's table is written to the shared folder.
    """
    cur = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    was = _state(cur)
    while was[0]:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).select("w", F.least("w", "m").alias("m"))
        large = both.join(low, both["u"] == low["w"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = large.join(down, large["u"] == down["w"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialize(small.union(down.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
        now = _state(new)
        discard(cur)
        cur = new
        if now == was:
            break
        was = now
    out = cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out._tessera_path = cur._tessera_path  # for discard()
    return out
