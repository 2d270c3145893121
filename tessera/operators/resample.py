"""Permutations and bootstraps as joins of index tables with per-unit statistics.

Randomness is a hash of seed, replicate and unit, so any engine gets the same draws (drawn_sums, for many units, hashes them by arrays); or draws
are split by partition (resampled_sums). Neither makes a row per replicate and unit.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .describe import with_column_of, dense_ids, quantiles


def hashed(*parts: Column) -> Column:
    """A number below 2**32 from the MD5 of the parts joined by hyphens."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def replicated(df: DataFrame, n: int, name: str = "b") -> DataFrame:
    """Every row once per replicate, made within its own task."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))


def permutation_ranks(units: DataFrame, over: list[str], unit: str, n: int, seed: int) -> DataFrame:
    """(over, unit, b, rank): a random order of the units in each replicate. units has one row per (over, unit)."""
    w = Window.partitionBy("b", *over).orderBy(hashed(F.lit(seed), F.col("b"), F.col(unit)), unit)
    return replicated(units.select(*over, unit), n).withColumn("rank", F.row_number().over(w))


def bootstrap_weights(units: DataFrame, unit: str, n: int, seed: int) -> DataFrame:
    """(b, unit, times): units drawn with replacement, as multiplicities; no data are copied. units has one row per unit."""
    order = dense_ids(units.select(unit), [unit], "place")
    size = order.agg(F.count("*").alias("size"))
    draws = replicated(order.select(F.col("place").alias("slot")), n).crossJoin(F.broadcast(size))
    picked = draws.select("b", F.pmod(hashed(F.lit(seed), F.col("b"), F.col("slot")), F.col("size")).alias("place"))
    counts = picked.groupBy("b", "place").agg(F.count("*").alias("times"))
    return counts.join(order, "place").select("b", unit, "times")


def permutation_p(observed: DataFrame, permuted: DataFrame, keys: list[str], n: int) -> DataFrame:
    """p = (1 + number of replicates at or above the observed statistic) / (n + 1). Both have keys and d."""
    obs = observed.select(*keys, F.col("d").alias("observed"))
    at_least = permuted.join(obs, keys).where("d >= observed").groupBy(*keys).agg(F.count("*").alias("k"))
    return obs.join(at_least, keys, "left").select(*keys, "observed", ((F.coalesce("k", F.lit(0)) + 1) / F.lit(float(n + 1))).alias("p_value"))


def quantile_interval(df: DataFrame, keys: list[str], x: str, alpha: float = 0.05) -> DataFrame:
    """percentile_interval for groups of any size: no buffer grows with a group. x must be stored or follow from the row alone."""
    got = df.groupBy(*keys).agg(F.count(x).alias("n_valid"), F.avg(x).alias("mean"))
    both = with_column_of(got, quantiles(df, keys, x, [alpha / 2, 1 - alpha / 2], "_q"), keys, "_q")
    return both.select(*keys, "n_valid", "mean", F.col("_q")[0].alias("ci_low"), F.col("_q")[1].alias("ci_high"))


def percentile_interval(df: DataFrame, keys: list[str], x: str, alpha: float = 0.05) -> DataFrame:
    """Of replicates, whose number bounds the buffer of a group."""
    q = F.percentile(x, [alpha / 2, 1 - alpha / 2])
    return df.groupBy(*keys).agg(F.count(x).alias("n_valid"), F.avg(x).alias("mean"), q.alias("_q")).select(*keys, "n_valid", "mean", F.col("_q")[0].alias("ci_low"), F.col("_q")[1].alias("ci_high"))


def classify_rope(low: Column, high: Column, rope_low: Column, rope_high: Column) -> Column:
    """Where a confidence interval lies against a region of practical equivalence."""
    odd = low.isNull() | high.isNull() | F.isnan(low) | F.isnan(high)
    return F.when(odd, "undefined").when((low >= rope_low) & (high <= rope_high), "equivalent").when((high < rope_low) | (low > rope_high), "non_equivalent").otherwise("indeterminate")


def sampled_pairs(df: DataFrame, key: str, cls: str, within: int, between: int, seed: int, tries: int = 50) -> DataFrame:
    """(x, y, same): hashed draws of pairs of rows. Within each class min(within, number of its pairs) draws that aren't a row with
    itself, and `between` draws of rows of different classes; as many tries as `tries` times the wanted number. df: one row per key."""
    ids = dense_ids(df.select(cls, key), [cls, key], "place")
    sizes = ids.groupBy(cls).agg(F.min("place").alias("at"), F.count("*").alias("n"))
    pick = lambda size, *parts: F.pmod(hashed(F.lit(seed), *parts), size)
    own = replicated(sizes.where("n > 1"), within * tries, "k").where(F.col("k") < F.least(F.lit(within), F.col("n") * (F.col("n") - 1) / 2) * tries)
    own = own.withColumn("i", pick(F.col("n"), F.lit("a"), F.col(cls), F.col("k"))).withColumn("j", pick(F.col("n"), F.lit("b"), F.col(cls), F.col("k"))).where("i <> j")
    own = own.withColumn("r", F.row_number().over(Window.partitionBy(cls).orderBy("k"))).where(F.col("r") <= F.least(F.lit(within), F.col("n") * (F.col("n") - 1) / 2))
    total = sizes.agg(F.sum("n").alias("total"))
    far = replicated(total, between * tries, "k").select("k", pick(F.col("total"), F.lit("c"), F.col("k")).alias("i"), pick(F.col("total"), F.lit("d"), F.col("k")).alias("j"))
    a, b = (ids.select(F.col("place").alias(p), F.col(cls).alias(f"c{p}"), F.col(key).alias(k)) for p, k in (("i", "x"), ("j", "y")))
    far = far.join(a, "i").join(b, "j").where("ci <> cj").orderBy("k").limit(between).select("x", "y", F.lit(False).alias("same"))
    near = own.select((F.col("at") + F.col("i")).alias("i"), (F.col("at") + F.col("j")).alias("j")).join(a, "i").join(b, "j").select("x", "y", F.lit(True).alias("same"))
    return near.unionByName(far)


# --- draws that are split by partition -----------------------------------------------------------------------------

#: Units of a block whose draws are made together, units that a partition should have at least, and numbers that a task holds before it hands them on.
BLOCK, LEAST, HELD = 256, 4096, 4_000_000


def split_counts(sizes: np.ndarray, part: int, n: int, seed: int) -> np.ndarray:
    """How many of a replicate's draws fall to a partition, for each of n replicates; sizes: units per partition.

    A tree halves the partitions; at each node a binomial number of the draws goes left. The node seeds its draws, so every task finds the
    same numbers on its own way down, and together they are a multinomial draw of all units' number."""
    lo, hi = 0, len(sizes)
    left = np.full(n, int(sizes.sum()), np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        first, both = int(sizes[lo:mid].sum()), int(sizes[lo:hi].sum())
        down = np.random.default_rng([seed, lo, hi]).binomial(left, first / both) if both else left
        lo, hi, left = (lo, mid, down) if part < mid else (mid, hi, left - down)
    return left


def _resampled(unit: str, stratum: list[str], groups: list[str], values: list[str], sizes: dict[tuple, np.ndarray], n: int, seed: int, schema: pa.Schema):
    """Rows of one partition, sorted by stratum and unit -> sums per replicate and group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        left: dict[tuple, list] = {}  # by stratum: draws and units that are left, and the generator

        def given() -> Iterator[pa.RecordBatch]:
            for key, x in sums.items():
                some = np.flatnonzero(x[:, -1])  # the weight of a replicate's rows
                columns = [pa.array(some), *[pa.array([v] * len(some), schema.field(g).type) for g, v in zip(groups, key, strict=True)], *[pa.array(c) for c in x[some, :-1].T]]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
            sums.clear()

        def block(keys: list[tuple], of: np.ndarray, units: int, table: np.ndarray, part: int, own: tuple) -> None:
            if own not in left:
                left[own] = [split_counts(sizes[own], part, n, seed), int(sizes[own][part]), np.random.default_rng([seed, len(sizes[own]), part, sorted(sizes, key=str).index(own)])]
            draws, rest, rng = left[own]
            mine = rng.binomial(draws, min(1.0, units / rest))
            times = rng.multinomial(mine, np.full(units, 1 / units)).astype(float)
            left[own][:2] = draws - mine, rest - units
            names = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            code = np.array([names[k] for k in keys])
            table = np.column_stack([table, np.ones(len(table))])
            for k, i in names.items():
                rows = np.flatnonzero(code == i)
                add = times[:, of[rows]] @ table[rows]
                if k in sums:
                    sums[k] += add
                else:
                    sums[k] = add

        held: list[tuple] = []
        table = np.zeros((0, len(values)))

        def cut(end: bool) -> Iterator[pa.RecordBatch]:
            """Blocks of whole units of one stratum from what is held; at the end all of it."""
            nonlocal held, table
            at = 0
            while at < len(held):
                part, own, place, to = held[at][0], held[at][1], {}, at
                while to < len(held) and held[to][1] == own and (held[to][2] in place or len(place) < BLOCK):
                    place.setdefault(held[to][2], len(place))
                    to += 1
                if to == len(held) and not end:
                    break
                block([r[3] for r in held[at:to]], np.array([place[r[2]] for r in held[at:to]]), len(place), table[at:to], part, own)
                at = to
                if len(sums) * n * (len(values) + 1) > HELD:
                    yield from given()
            held, table = held[at:], table[at:]

        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in dict.fromkeys(["_part", unit, *stratum, *groups])}
            strata = zip(*[columns[c] for c in stratum], strict=True) if stratum else [()] * batch.num_rows
            keys = zip(*[columns[c] for c in groups], strict=True) if groups else [()] * batch.num_rows
            held += zip(columns["_part"], strata, columns[unit], keys, strict=True)
            table = np.vstack([table, np.column_stack([batch.column(c).to_numpy() for c in values])])
            yield from cut(False)
        yield from cut(True)
        yield from given()

    return run


def resampled_sums(df: DataFrame, unit: str, groups: list[str], values: list[str], n: int, seed: int, stratum: list[str] | None = None) -> DataFrame:
    """(b, groups, values): sums of values over the rows of units that are drawn with replacement, as many as there are, in each of n replicates.

    All rows of a unit are drawn together. stratum: columns constant within a unit; units are drawn within each of their values, and groups must
    hold those columns if their sums are to be apart. Values are numbers without nulls. A (b, groups) of which nothing is drawn has no row.

    Units are dealt to partitions by hash. Each finds its share of the draws (split_counts), draws its units' multiplicities block by block and multiplies them, a matrix
    of replicates and units, by the units' values; the partitions' sums are added up. So work is replicates x units, but rows are
    partitions x groups x replicates. The driver gathers the number of units per partition (and stratum)."""
    spark, stratum = df.sparkSession, stratum or []
    rows = df.select(*dict.fromkeys([unit, *stratum, *groups]), *[F.col(c).cast("double").alias(c) for c in values])
    units = rows.select(unit, *stratum).distinct()
    parts = max(1, min(units.count() // LEAST, 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = rows.repartition(parts, unit).sortWithinPartitions(*stratum, unit, *groups).withColumn("_part", F.spark_partition_id())
    sizes: dict[tuple, np.ndarray] = {}
    for r in units.repartition(parts, unit).groupBy(F.spark_partition_id().alias("_part"), *stratum).agg(F.count("*").alias("_n")).collect():
        sizes.setdefault(tuple(r[c] for c in stratum), np.zeros(parts, np.int64))[r["_part"]] = r["_n"]
    kinds = dict(df.dtypes)
    names = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    schema = pa.schema([("b", pa.int64()), *[(g, names[kinds[g]]) for g in groups], *[(v, pa.float64()) for v in values]])
    out = ", ".join(["b long", *[f"{g} {kinds[g]}" for g in groups], *[f"{v} double" for v in values]])
    own = dealt.mapInArrow(_resampled(unit, stratum, groups, values, sizes, n, seed, schema), out)
    return own.groupBy("b", *groups).agg(*[F.sum(v).alias(v) for v in values])


# --- hashed draws as products of blocks ----------------------------------------------------------------------------

#: Places of a block, whose draws are counted together (an offset fits 16 bits); draws made at a time, their slots at most; hashes reckoned at a time.
PLACES, DRAWS, SLOTS, PIECE = 4096, 1 << 21, 1 << 20, 1 << 15
MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
MD5_SHIFTS = (7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)
MD5_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]


def md5_heads(parts: list[str | np.ndarray]) -> np.ndarray:
    """The first 32 bits of the MD5 of the parts' joined text, a number as in hashed(), for arrays of whole numbers below 2**32 among the parts.

    All arrays are of one length, and the numbers of an array have equally many digits; the text is one block of MD5, 55 bytes at most."""
    n = next(len(p) for p in parts if not isinstance(p, str))
    words, at = [0] * 16, 0

    def put(byte, where: int) -> None:
        words[where // 4] = words[where // 4] + (byte << 8 * (where % 4))

    for p in parts:
        if isinstance(p, str):
            for x in p.encode():
                put(x, at)
                at += 1
        else:
            rest, digits = p.astype(np.uint32), len(str(int(p[0])))
            for i in range(digits)[::-1]:
                tens = rest // 10
                put(rest - tens * 10 + 48, at + i)
                rest = tens
            at += digits
    if at > 55:
        raise ValueError("a text of more than 55 bytes")
    put(0x80, at)
    words[14] = 8 * at
    a, b, c, d = (np.full(n, x, np.uint32) for x in MD5_START)
    for i in range(61):  # the last three steps don't touch the first word
        turn = i // 16
        if turn == 0:
            f, g = d ^ (b & (c ^ d)), i
        elif turn == 1:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif turn == 2:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        if isinstance(words[g], int):
            f += (words[g] + MD5_ADDED[i]) % 2**32
        else:
            f += words[g]
            f += MD5_ADDED[i]
        shift = MD5_SHIFTS[turn][i % 4]
        high = f << shift
        f >>= 32 - shift
        f |= high
        f += b
        a, d, c, b = d, c, b, f
    return (b + MD5_START[0]).byteswap()


def _same_digits(lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """lo..hi - 1 cut where the number of digits changes."""
    while lo < hi:
        to = min(hi, 10 ** len(str(lo)))
        yield lo, to
        lo = to


def drawn_places(seed: int, b: tuple[int, int], slots: tuple[int, int], size: int) -> np.ndarray:
    """hashed(seed, b, slot) modulo size: a row per replicate, a column per slot, of the given ranges."""
    out = np.empty((b[1] - b[0], slots[1] - slots[0]), np.int64)
    for b0, b1 in _same_digits(*b):
        for s0, s1 in _same_digits(*slots):
            wide = s1 - s0
            own = np.empty((b1 - b0) * wide, np.int64)
            for at in range(0, len(own), PIECE):
                pair = np.arange(at, min(at + PIECE, len(own)))
                row = pair // wide
                own[at : at + PIECE] = md5_heads([f"{seed}-", row + b0, "-", pair - row * wide + s0]).astype(np.int64) % size
            out[b0 - b[0] : b1 - b[0], s0 - slots[0] : s1 - slots[0]] = own.reshape(-1, wide)
    return out


def drawn_sums(df: DataFrame, unit: str, groups: list[str], values: list[str], n: int, seed: int) -> DataFrame:
    """(b, groups, values): resampled_sums with the draws of bootstrap_weights, which SQL can repeat: slot s of replicate b has the unit at the
    place hashed(seed, b, s) modulo their number, in the order of units, null last; rows of the null unit have a place but no values.

    Values are numbers without nulls; an infinite one or NaN counts where its unit is drawn. Tasks hash ranges of replicates and slots and hand on
    each block's places, two bytes per draw; a block's task counts them, a matrix of replicates and units, and multiplies it by the units'
    values. So no row is made per replicate and unit, and a task holds a range of draws or a block's draws, however many units there are. df must
    be stored. The driver gathers the number of units."""
    spark = df.sparkSession
    order = dense_ids(df.select(unit).distinct(), [F.col(unit).asc_nulls_last()], "_place")
    size = order.count()
    wide = max(1, min(size, SLOTS))
    tall, ranges = min(n, max(1, DRAWS // wide)), -(-size // wide)
    works = -(-n // tall) * ranges

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for work in batch.column("id").to_pylist():
                b0, s0 = work // ranges * tall, work % ranges * wide
                drawn = drawn_places(seed, (b0, min(b0 + tall, n)), (s0, min(s0 + wide, size)), size)
                drawn.sort(axis=1)
                for b, row in enumerate(drawn, b0):
                    blocks = np.arange(row[0] // PLACES, row[-1] // PLACES + 1)
                    ends, offsets = np.searchsorted(row, (blocks + 1) * PLACES), (row % PLACES).astype("<u2")
                    cut = [x.tobytes() for x in np.split(offsets, ends[:-1])]
                    yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(np.full(len(blocks), b)), pa.array(cut, pa.binary())], names=["_block", "b", "_drawn"])

    kinds = dict(df.dtypes)
    names = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    schema = pa.schema([("b", pa.int64()), *[(g, names[kinds[g]]) for g in groups], *[(v, pa.float64()) for v in values]])

    def multiply(draws: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        keys = list(zip(*[rows.column(g).to_pylist() for g in groups], strict=True)) if groups else [()] * rows.num_rows
        own = {k: [] for k in dict.fromkeys(keys)}
        for i, k in enumerate(keys):
            own[k].append(i)
        at = rows.column("_at").to_numpy()
        table = np.column_stack([np.ones(rows.num_rows), *[rows.column(v).to_numpy() for v in values]])
        plain = np.where(np.isfinite(table), table, 0.0)
        b, drawn = draws.column("b").to_numpy(), draws.column("_drawn").to_pylist()
        by_b = np.argsort(b, kind="stable")
        for b0 in range(0, n, BLOCK):
            of = by_b[np.searchsorted(b, b0, sorter=by_b) : np.searchsorted(b, b0 + BLOCK, sorter=by_b)]
            if not len(of):
                continue
            offsets = [np.frombuffer(drawn[i], "<u2") for i in of]
            cell = np.concatenate(offsets) + np.repeat((b[of] - b0) * PLACES, [len(x) for x in offsets])
            times = np.bincount(cell, minlength=BLOCK * PLACES).reshape(BLOCK, PLACES).astype(float)
            for k, mine in own.items():
                drawn_here = times[:, at[mine]]
                sums = drawn_here @ plain[mine]
                for i, j in zip(*np.nonzero(~np.isfinite(table[mine])), strict=True):
                    sums[drawn_here[:, i] > 0, j] += table[mine[i], j]
                some = np.flatnonzero(sums[:, 0])
                out.append(pa.Table.from_arrays([pa.array(b0 + some), *[pa.array([x] * len(some), schema.field(g).type) for g, x in zip(groups, k, strict=True)], *[pa.array(c) for c in sums[some, 1:].T]], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    parts = max(1, min(works, 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    draws = spark.range(0, works, 1, parts).mapInArrow(draw, "_block long, b long, _drawn binary")
    block = F.floor(F.col("_place") / PLACES)
    rows = df.join(order, unit).select(block.alias("_block"), (F.col("_place") - block * PLACES).alias("_at"), *groups, *[F.col(c).cast("double").alias(c) for c in values])
    out = ", ".join(["b long", *[f"{g} {kinds[g]}" for g in groups], *[f"{v} double" for v in values]])
    own = draws.groupBy("_block").cogroup(rows.groupBy("_block")).applyInArrow(multiply, out)
    return own.groupBy("b", *groups).agg(*[F.sum(v).alias(v) for v in values])


# --- permutations as products of blocks ----------------------------------------------------------------------------

#: Standard deviations around a threshold's expected place that are looked through, and replicates whose thresholds one task finds.
REACH, CHUNK = 6.0, 100


def hashes(seed: int, n: int, units: list[int]) -> np.ndarray:
    """hashed(seed, b, unit) for b below n: a row per replicate, a column per unit."""
    out = np.empty((n, len(units)), np.int64)
    for j, u in enumerate(units):
        out[:, j] = [int.from_bytes(hashlib.md5(f"{seed}-{b}-{u}".encode()).digest()[:4], "big") for b in range(n)]
    return out


def _unit_blocks(batches: Iterator[pa.RecordBatch], unit: str) -> Iterator[tuple[list[int], np.ndarray, pa.RecordBatch]]:
    """(units, each row's place among them, rows) of up to BLOCK units at a time; rows are sorted by unit."""
    for batch in batches:
        own = batch.column(unit).to_numpy()
        units, of = np.unique(own, return_inverse=True)
        for lo in range(0, len(units), BLOCK):
            rows = np.flatnonzero((of >= lo) & (of < lo + BLOCK))
            yield units[lo : lo + BLOCK].tolist(), of[rows] - lo, batch.take(pa.array(rows))


def permutation_thresholds(cells: DataFrame, cls: str, unit: str, first: dict, n: int, seed: int) -> dict:
    """Per class (n, 2): in each of n replicates the hash and the unit of the last of the class's first k units, ordered by hash and unit.

    first: class -> (k, units of the class), 0 < k < units. Tasks count the hashes below a window around the expected threshold and hand on those
    within it, a number that grows with the root of the units; the threshold is picked from these. Should a window miss, it is widened.
    The driver holds n thresholds per class."""
    out, todo, reach = {}, dict(first), REACH
    while todo:
        window = {}
        for c, (k, size) in todo.items():
            middle, width = k / size, reach * (k * (size - k) / size) ** 0.5 / size + 2 * reach / size
            window[c] = int(max(0.0, middle - width) * 2**32), int(min(1.0, middle + width) * 2**32)

        def looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for units, of, rows in _unit_blocks(batches, unit):
                h, classes = hashes(seed, n, units), np.array(rows.column(cls).to_pylist(), object)
                names, parts = np.array(units, np.int64), []
                for c in dict.fromkeys(classes.tolist()):
                    if c not in window:
                        continue
                    at = of[classes == c]
                    own, (lo, hi) = h[:, at], window[c]
                    below, inside = (own < lo).sum(1), (own >= lo) & (own <= hi)
                    for b0 in range(0, n, CHUNK):
                        b, j = np.nonzero(inside[b0 : b0 + CHUNK])
                        values = below[b0 : b0 + CHUNK], b, own[b0 : b0 + CHUNK][b, j], names[at][j]
                        parts.append((c, b0, *[v.astype("<i8").tobytes() for v in values]))
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array(list(v)) if i > 1 else pa.array(list(v), rows.schema.field(cls).type if i == 0 else pa.int64()) for i, v in enumerate(zip(*parts, strict=True))], names=[cls, "b0", "below", "b", "h", "unit"])

        k_of = {str(c): k for c, (k, _) in todo.items()}

        def picked(pdf):
            import pandas as pd

            below = sum(np.frombuffer(x, "<i8") for x in pdf["below"])
            b, h, u = (np.concatenate([np.frombuffer(x, "<i8") for x in pdf[c]]) for c in ("b", "h", "unit"))
            order = np.lexsort((u, h, b))
            start = np.searchsorted(b[order], np.arange(len(below)))
            place = k_of[str(pdf[cls].iloc[0])] - below - 1
            good = (place >= 0) & (start + place < np.r_[start[1:], len(b)])
            at = order[np.where(good, start + place, 0).clip(0, max(len(b) - 1, 0))] if len(b) else np.zeros(len(below), int)
            none = np.full(len(below), -1)
            return pd.DataFrame({cls: [pdf[cls].iloc[0]] * len(below), "b": pdf["b0"].iloc[0] + np.arange(len(below)), "h": np.where(good, h[at], none) if len(b) else none, "unit": np.where(good, u[at], none) if len(b) else none})

        kind = dict(cells.dtypes)[cls]
        rows = cells.select(cls, unit).repartition(unit).sortWithinPartitions(unit)
        parts = rows.mapInArrow(looked, f"{cls} {kind}, b0 long, below binary, b binary, h binary, unit binary")
        got: dict = {c: np.full((n, 2), -1, np.int64) for c in todo}
        for r in parts.groupBy(cls, "b0").applyInPandas(picked, f"{cls} {kind}, b long, h long, unit long").collect():
            got[r[cls]][r["b"]] = r["h"], r["unit"]
        out |= {c: x for c, x in got.items() if (x[:, 0] >= 0).all()}
        todo, reach = {c: v for c, v in todo.items() if c not in out}, 4 * reach
    return out


def permuted_sums(cells: DataFrame, cls: str, unit: str, vector: str, first: dict, n: int, seed: int, name: str = "one") -> DataFrame:
    """(b, cls, name): in each of n replicates the sum of the vectors of a class's first k units, in the order of permutation_ranks.

    cells: one row per (cls, unit), units whole numbers. No row per replicate and unit is made: with the thresholds known, a block of units is a matrix
    of zeros and ones per class, which is multiplied by the units' vectors; the partitions' products are added up."""
    limit = permutation_thresholds(cells, cls, unit, first, n, seed)
    kind, width = dict(cells.dtypes)[cls], cells.agg(F.max(F.size(vector))).first()[0] or 0

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}

        def given(field: pa.DataType) -> Iterator[pa.RecordBatch]:
            for c, x in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array([c] * n, field), *[pa.array(v) for v in x.T]], names=["b", cls, *[f"_s{i}" for i in range(width)]])
            sums.clear()

        field = None
        for units, of, rows in _unit_blocks(batches, unit):
            field = rows.schema.field(cls).type
            h, names, classes = hashes(seed, n, units), np.array(units, np.int64), np.array(rows.column(cls).to_pylist(), object)
            x = np.array(rows.column(vector).to_pylist(), float).reshape(rows.num_rows, -1)
            for c in dict.fromkeys(classes.tolist()):
                if c in limit:
                    own = np.flatnonzero(classes == c)
                    at, top, last = of[own], limit[c][:, :1], limit[c][:, 1:]
                    chosen = (h[:, at] < top) | ((h[:, at] == top) & (names[at] <= last))
                    add = chosen.astype(float) @ x[own]
                    sums[c] = sums[c] + add if c in sums else add
            if len(sums) * n * width > HELD:
                yield from given(field)
        yield from given(field)

    rows = cells.select(cls, unit, vector).repartition(unit).sortWithinPartitions(unit)
    parts = rows.mapInArrow(products, ", ".join(["b long", f"{cls} {kind}", *[f"_s{i} double" for i in range(width)]]))
    return parts.groupBy("b", cls).agg(F.array(*[F.sum(f"_s{i}") for i in range(width)]).alias(name))
