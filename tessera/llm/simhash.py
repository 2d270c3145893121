"""SimHash fingerprints and near-duplicate groups through a Gray-order hierarchical index.

Distinct fingerprints are routed by exact bit blocks (two fingerprints at most RADIUS = 2 bits apart agree on
one of three blocks), so any linked pair meets in some route. Inside a route the fingerprints are sorted by Gray
rank and indexed by a tree whose upper nodes hold the bits that all their entries share; a search adds up the
differences from node to node and leaves a whole group once they exceed the radius.
A route with more than HOT fingerprints is routed again by blocks of the bits it hasn't fixed yet; after the
fourth time a route can't hold more than 2**13 different fingerprints. Each route gives a spanning star per
local component, not its pairs, and the components are joined by distributed star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, discard, materialize

SEED, RADIUS, WORDS = 42, 2, 3
HOT, LEVELS, LEAF, FAN, QUERIES = 20_000, 4, 32, 8, 1024
CHUNK = 60_000


def simhash(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of one text; 0 where it has no words."""
    parts = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space count
    if not parts:
        return 0
    if len(parts) < words:
        grams: list[bytes] = [b" ".join(parts)]
    else:
        grams = list(map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False)))
    ones, n = np.zeros(64, np.int64), len(grams)
    for at in range(0, n, 1 << 16):
        some = grams[at : at + (1 << 16)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, some, repeat(seed)), np.uint64, len(some))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


@F.pandas_udf(T.LongType())
def _fingerprint(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([simhash(x) for x in texts], np.uint64).view(np.int64))


def fingerprint(text: Column) -> Column:
    """The fingerprint as a signed long."""
    return _fingerprint(F.coalesce(text, F.lit("")))


def to_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _masks(level: int) -> list[int]:
    """Masks of the routes of a level: each route of the level before, with a third of its free bits added."""
    if level == 0:
        return [0]
    out = []
    for mask in _masks(level - 1):
        free = [i for i in range(64) if not mask >> i & 1]
        for c in range(3):
            part = free[len(free) * c // 3 : len(free) * (c + 1) // 3]
            out.append(mask | sum(1 << i for i in part))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _routed(rows: DataFrame, level: int) -> DataFrame:
    """rows (route, fp) of one level, dealt to the three routes below each."""
    masks = F.array(*[F.lit(_signed(m)) for m in _masks(level)])
    route = rows.select(F.explode(F.array(*[F.col("route") * 3 + c for c in range(3)])).alias("route"), "fp")
    return route.select("route", F.col("fp").bitwiseAND(F.element_at(masks, F.col("route") + 1)).alias("block"), "fp").withColumn("level", F.lit(level))


def _labels(n: int, a: np.ndarray, b: np.ndarray, lab: np.ndarray | None = None) -> np.ndarray:
    """The smallest index of each index's component."""
    lab = np.arange(n) if lab is None else lab
    while True:
        x, y = lab[a], lab[b]
        odd = x != y
        if not odd.any():
            return lab
        a, b, x, y = a[odd], b[odd], x[odd], y[odd]
        np.minimum.at(lab, np.maximum(x, y), np.minimum(x, y))
        while (up := lab[lab]).tobytes() != lab.tobytes():
            lab = up


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each pattern in Gray order."""
    r = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def index_labels(fp: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Component labels within one route; fp are different fingerprints in Gray order."""
    n = len(fp)
    # Level 0 are the leaves; each node keeps the bits that all its entries share and that its parent doesn't have.
    both, any_, levels = fp, fp, []
    for width in (LEAF, *[FAN] * 20):
        at = np.arange(0, len(both), width)
        both, any_ = np.bitwise_and.reduceat(both, at), np.bitwise_or.reduceat(any_, at)
        levels.append((~(both ^ any_), both))
        if len(both) <= FAN:
            break
    own = []
    for k, (shared, bits) in enumerate(levels):
        up = levels[k + 1][0][np.arange(len(shared)) // FAN] if k + 1 < len(levels) else np.zeros(len(shared), np.uint64)
        mask = shared & ~up
        own.append((mask, bits & mask))
    lab = np.arange(n)
    sizes = [LEAF * FAN**k for k in range(len(own))]
    for q0 in range(0, n, QUERIES):
        q = np.arange(q0, min(n, q0 + QUERIES))
        first = np.array([lab[i : i + LEAF].min() for i in range(0, n, LEAF)])
        one = np.array([(lab[i : i + LEAF] == lab[i]).all() for i in range(0, n, LEAF)])
        top = len(own) - 1
        node = np.tile(np.arange(len(own[top][0])), len(q))
        q = np.repeat(q, len(own[top][0]))
        acc = np.zeros(len(q), np.int64)
        for k in range(top, -1, -1):
            mask, bits = own[k]
            acc = acc + np.bitwise_count((fp[q] ^ bits[node]) & mask[node])
            keep = (acc <= radius) & ((node + 1) * sizes[k] > q)
            if k == 0:  # a leaf whose entries are all in the query's component adds nothing
                keep &= ~(one[node] & (first[node] == lab[q]))
            q, node, acc = q[keep], node[keep], acc[keep]
            if k:
                m = len(own[k - 1][0])
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                q, acc = np.repeat(q, FAN), np.repeat(acc, FAN)
                real = node < m
                q, node, acc = q[real], node[real], acc[real]
        for i in range(0, len(q), 40_000):
            a = np.repeat(q[i : i + 40_000], LEAF)
            b = (node[i : i + 40_000, None] * LEAF + np.arange(LEAF)).ravel()
            real = (b < n) & (b > a)
            a, b = a[real], b[real]
            near = np.bitwise_count(fp[a] ^ fp[b]) <= radius
            lab = _labels(n, a[near], b[near], lab)
    return lab


def _stars(route: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    """Star edges of the local components; route numbers the routes, each a run."""
    order = np.lexsort((gray_rank(fp), route))
    route, fp = route[order], fp[order]
    n = len(fp)
    starts = np.flatnonzero(np.r_[True, route[1:] != route[:-1]]) if n else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, n])
    big = np.repeat(sizes > LEAF, sizes)
    a, b = [], []
    for d in range(1, int(min(LEAF, sizes.max(initial=0)))):  # routes no larger than a leaf: the leaf's own comparison
        i = np.flatnonzero((route[d:] == route[:-d]) & ~big[d:])
        near = np.bitwise_count(fp[i] ^ fp[i + d]) <= RADIUS
        a.append(i[near])
        b.append(i[near] + d)
    lab = _labels(n, np.concatenate([*a, []]).astype(int), np.concatenate([*b, []]).astype(int))
    for s, size in zip(starts, sizes, strict=True):
        if size > LEAF:
            lab[s : s + size] = s + index_labels(fp[s : s + size])
    own = np.flatnonzero(lab != np.arange(n))
    return pa.RecordBatch.from_arrays([pa.array(fp[own].view(np.int64)), pa.array(fp[lab[own]].view(np.int64))], names=["a", "b"])


def _route_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (level, route, block): whole routes are searched, many small ones at once."""
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
        held.append(cols)
        if sum(map(len, held)) < CHUNK:
            continue
        rows = np.concatenate(held)
        last = int(np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(1)).max(initial=-1)) + 1
        held = [rows[last:]]
        if last:
            yield _numbered(rows[:last])
    if held:
        yield _numbered(np.concatenate(held))


def _numbered(rows: np.ndarray) -> pa.RecordBatch:
    new = np.r_[False, (rows[1:, :3] != rows[:-1, :3]).any(1)]
    return _stars(np.cumsum(new), rows[:, 3].view(np.uint64) if rows[:, 3].flags.c_contiguous else np.ascontiguousarray(rows[:, 3]).view(np.uint64))


def fingerprint_components(fps: DataFrame) -> DataFrame:
    """fps: distinct fp (long). Returns node, component for the fingerprints with a link, components by their smallest fp."""
    rows, edges = fps.select(F.lit(0).alias("route"), "fp"), None
    for level in range(1, LEVELS + 1):
        routed = _routed(rows, level)
        hot = None
        if level < LEVELS:
            counts = routed.groupBy("route", "block").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("route", "block")
            hot = materialize(counts, "hot-routes")
            if hot.isEmpty():
                hot = None
        cold = routed if hot is None else routed.join(hot, ["route", "block"], "left_anti").select("route", "block", "fp", "level")
        got = cold.select("level", "route", "block", "fp").repartition("route", "block").sortWithinPartitions("level", "route", "block").mapInArrow(_route_stars, "a long, b long")
        edges = got if edges is None else edges.union(got)
        if hot is None:
            break
        rows = routed.join(hot, ["route", "block"], "left_semi").select("route", "fp")
    return connected_components(edges)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, fp (signed long) and component_id.

    component_id is the smallest id reachable through fingerprints at most two bits apart. A null text counts as
    empty, its fingerprint is 0, and it links like any other. Rows of the same id are kept apart; a null id is
    never a component's name unless all ids of the component are null. An empty table gives no rows. Other columns
    of docs are not read.
    """
    own = materialize(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col)).alias("fp")), "fingerprints")
    fps = materialize(own.groupBy("fp").agg(F.min("id").alias("rep")), "fps")
    parts = fingerprint_components(fps.select("fp"))
    linked = fps.join(parts.withColumnRenamed("node", "fp"), "fp")
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    named = linked.join(least, "component").select(F.col("fp").alias("fp_"), "least")
    # A table of its own, so that the join below deals both sides anew and a much-copied fingerprint can be split.
    info = materialize(fps.join(named, fps["fp"] == named["fp_"], "left").select("fp", F.coalesce("least", "rep").alias("component_id")), "named")
    discard(fps)
    discard(parts)
    return own.join(info, "fp").select(F.col("id").alias(id_col), "fp", "component_id")

