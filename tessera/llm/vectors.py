"""Near-duplicate vectors by sorted projection passes.

Equal vectors are one class. A pass orders the classes lexicographically by BITS concatenated random hashes (the sides of planes
through the origin) and compares each with its next neighbours in that order, WINDOW of them at least. Pairs that reach the
threshold are verified in double precision; of each run only a spanning forest is kept, and the forests of all passes are united.
Within the components so found, links are counted exactly, block against block; two blocks whose centres and radii decide
the matter aren't compared.

How often: a pair at the threshold meets in a pass with a probability that falls with the number of rows, so the number of passes
follows from it such that one is missed with probability MISS in a table without structure. Dense regions need more. So the planes
are bisectors of neighbours in a bounded sample, which cut where vectors are; and after each round recall is measured on PROBES
vectors against all rows. Rounds with new planes, each as large as all before it, go on until it reaches GOAL.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import dot
from .common import connected_components, discard, materialize
from .simhash import _labels

THRESHOLD, WINDOW, BITS, MISS = 0.9, 256, 64, 1e-3
SAMPLE, NEAREST_OF, PROBES, GOAL, SEED = 2048, 8, 2000, 0.99, 20240501
ROWS, CHUNK, STRIPE = 50_000, 256, 64
ANGLE, EPS = math.acos(THRESHOLD), 1e-7


def usable(v: Column) -> Column:
    """Is a vector not null, not zero, and all finite?"""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Unit rows in double precision, however large or small the vectors are."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def passes_for(n: int, miss: float = MISS) -> int:
    """Passes after which a pair at the threshold among n vectors without structure is missed with probability `miss`."""
    met = (1 - ANGLE / math.pi) ** max(0.0, math.log2(max(n, 1) / WINDOW))
    return 1 if met > 1 - miss else math.ceil(math.log(miss) / math.log1p(-met))


def planes(sample: np.ndarray | None, size: int, number: int) -> np.ndarray:
    """Normals of one pass's planes, (size, BITS): differences of near sample vectors, or random ones without a sample."""
    rng = np.random.default_rng([SEED, size, number])
    if sample is None or len(sample) < 4 * NEAREST_OF:
        return rng.normal(size=(size, BITS))
    a, others = rng.integers(0, len(sample), BITS), rng.integers(0, len(sample), (BITS, NEAREST_OF))
    cos = np.einsum("bd,bkd->bk", sample[a], sample[others])
    cos[cos > 1 - 1e-9] = -2  # a copy gives no plane
    b = others[np.arange(BITS), cos.argmax(1)]
    normals = sample[a] - sample[b]
    none = np.linalg.norm(normals, axis=1) < 1e-9
    normals[none] = rng.normal(size=(int(none.sum()), size))
    return normals.T


def keys_of(x: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """The concatenated hashes of unit rows, as longs in lexicographic order."""
    bits = np.packbits(x @ normals > 0, axis=1, bitorder="big")
    return (bits.view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def near_pairs(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the rows of x and y that reach the threshold in double precision."""
    # A float32 product of unit vectors is off by less than (its length + 2) roundings.
    i, j = np.nonzero(x.astype(np.float32) @ y.astype(np.float32).T >= THRESHOLD - 1e-6 - 2**-23 * (x.shape[1] + 2))
    if len(i) > x.shape[0] + y.shape[0]:
        exact = (x @ y.T)[i, j]
    else:
        exact = np.einsum("nd,nd->n", x[i], y[j])
    good = exact >= THRESHOLD
    return i[good], j[good]


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, size)


DEALT = "size int, pass int, key long, cid long, x binary"
EDGES = "a long, b long, seam int, size int, pass int, x binary"


def _by_size(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """(size, columns but the vector, unit rows) of batches whose last column is a vector."""
    for batch in batches:
        if not batch.num_rows:
            continue
        *rest, v = batch.columns
        lens = v.value_lengths().to_numpy()
        flat = v.flatten().to_numpy(zero_copy_only=False).astype(float)
        start = np.r_[0, np.cumsum(lens)]
        for size in np.unique(lens).tolist():
            own = np.flatnonzero(lens == size)
            yield size, [c.to_numpy(zero_copy_only=False)[own] for c in rest], unit_rows(flat[start[own][:, None] + np.arange(size)])


def _keyed(samples: dict[int, np.ndarray], numbers: range):
    """In: cid, v. Out: one row per pass."""
    known: dict[tuple[int, int], np.ndarray] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, (cid,), x in _by_size(batches):
            raw = pa.array([r.tobytes() for r in x], pa.binary())
            for k in numbers:
                if (size, k) not in known:
                    known[size, k] = planes(samples.get(size), size, k)
                n = len(cid)
                columns = [pa.array(np.full(n, size), pa.int32()), pa.array(np.full(n, k), pa.int32()), pa.array(keys_of(x, known[size, k])), pa.array(cid, pa.int64()), raw]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in DEALT.split(", ")])

    return run


def _edges(a, b) -> pa.RecordBatch:
    n = len(a)
    empty = pa.nulls(n, pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(n, -1), pa.int32()), empty, empty, pa.nulls(n, pa.binary())], names=[c.split()[0] for c in EDGES.split(", ")])


def _seam(seam: int, size: int, number: int, cid: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    n = len(cid)
    full = lambda k: pa.array(np.full(n, k), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.nulls(n, pa.int64()), full(seam), full(size), full(number), pa.array([r.tobytes() for r in x], pa.binary())], names=[c.split()[0] for c in EDGES.split(", ")])


class _Run:
    """Consecutive rows of one pass: each block of WINDOW rows is compared with itself and with the block before it."""

    def __init__(self):
        self.cid, self.x, self.lab = np.zeros(0, np.int64), None, np.zeros(0, np.int64)

    def add(self, cid: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of a forest over what the run has seen: those that join trees."""
        m = len(self.cid)
        i, j = near_pairs(x, x)
        some = i < j
        i, j = i[some] + m, j[some] + m
        if m:
            p, q = near_pairs(self.x, x)
            i, j = np.r_[i, p], np.r_[j, q + m]
        start = np.r_[self.lab, m + np.arange(len(cid))]
        lab = _labels(m + len(cid), i, j, start.copy())
        ids = np.r_[self.cid, cid]
        new = np.flatnonzero((lab != start) & (start == np.arange(len(start))))
        last = lab[m:]
        # Trees of this block by their first row here; what came before is joined by the edges already given.
        _, first, back = np.unique(last, return_index=True, return_inverse=True)
        edges = ids[new], ids[lab[new]]
        self.cid, self.x, self.lab = cid, x, first[back]
        return edges


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows. Out: edges, and both ends of the partition for the comparison over its borders."""
    part = TaskContext.get().partitionId()
    group, run, held, rows, head = None, _Run(), [], 0, True

    def block(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, rows, head
        cid, x = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        while len(cid) >= WINDOW or (last and len(cid)):
            if head:
                yield _seam(part - 1, *group, cid[:WINDOW], x[:WINDOW])
                head = False
            before = run.cid, run.x
            a, b = run.add(cid[:WINDOW], x[:WINDOW])
            if len(a):
                yield _edges(a, b)
            cid, x = cid[WINDOW:], x[WINDOW:]
        if last and run.x is not None:
            ids, own = run.cid, run.x
            if len(ids) < WINDOW and before[1] is not None:
                ids, own = np.r_[before[0], ids][-WINDOW:], np.concatenate([before[1], own])[-WINDOW:]
            yield _seam(part, *group, ids, own)
        held, rows = [(cid, x)], len(cid)

    for batch in batches:
        size, number = (batch.column(k).to_numpy() for k in (0, 1))
        cuts = np.flatnonzero(np.r_[True, (size[1:] != size[:-1]) | (number[1:] != number[:-1])]).tolist() if len(size) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(size)], strict=True):
            own = int(size[lo]), int(number[lo])
            if own != group:
                if group and rows:
                    yield from block(True)
                group, run, held, rows = own, _Run(), [], 0
            held.append((batch.column(3).slice(lo, hi - lo).to_numpy(), _matrix(batch.column(4).slice(lo, hi - lo), own[0])))
            rows += hi - lo
            if rows >= 8 * WINDOW:
                yield from block(False)
    if group and (rows or run.x is not None):
        yield from block(True)


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a seam and pass next to each other: at most 2 * WINDOW, compared as one run."""
    group, held = None, []

    def done() -> pa.RecordBatch:
        run = _Run()
        return _edges(*run.add(*(np.concatenate([h[i] for h in held]) for i in (0, 1))))

    for batch in batches:
        seam, size, number = (batch.column(k).to_numpy() for k in (2, 3, 4))
        for k in range(batch.num_rows):
            own = int(seam[k]), int(size[k]), int(number[k])
            if own != group:
                if held:
                    yield done()
                group, held = own, []
            held.append((batch.column(0).slice(k, 1).to_numpy(), _matrix(batch.column(5).slice(k, 1), own[1])))
    if held:
        yield done()


def _found(classes: DataFrame, n: int, samples: dict[int, np.ndarray], numbers: range) -> DataFrame:
    """Edges (a, b) of some passes, in a table of its own."""
    parts = max(1, -(-n * len(numbers) // ROWS))
    dealt = classes.select("cid", "v").mapInArrow(_keyed(samples, numbers), DEALT)
    order = ["size", "pass", "key", "cid"]
    got = materialize(dealt.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_windows, EDGES), "windows")
    ends = got.where("seam >= 0").repartition("seam", "size", "pass").sortWithinPartitions("seam", "size", "pass").mapInArrow(_seams, EDGES)
    edges = materialize(got.where("seam < 0 and b is not null").select("a", "b").union(ends.select("a", "b")), "found")
    discard(got)
    return edges


def _chosen(classes: DataFrame, n: int, salt: str) -> list:
    """At most n classes, by a hash of their ids."""
    return classes.orderBy(F.xxhash64(F.lit(salt), "cid"), "cid").limit(n).select("cid", "v").collect()


def _probed(probes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """In: cid, component, v. Out: per task and probe its links and those within its component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {s: np.zeros((2, len(p[0])), np.int64) for s, p in probes.items()}
        for size, (cid, component), x in _by_size(batches):
            if size in probes:
                ids, of, y = probes[size]
                for lo in range(0, len(cid), 1024):
                    i, j = near_pairs(x[lo : lo + 1024], y)
                    other = cid[lo + i] != ids[j]
                    i, j = i[other], j[other]
                    sums[size][0] += np.bincount(j, minlength=len(ids))
                    sums[size][1] += np.bincount(j[component[lo + i] == of[j]], minlength=len(ids))
        for size, (total, found) in sums.items():
            some = total > 0
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(probes[size][0][some]), pa.array(total[some]), pa.array(found[some])], names=["probe", "total", "found"])

    return run


def measured_recall(classes: DataFrame, parts: DataFrame, chosen: list) -> float:
    """Mean over the chosen classes with a link of the share of their links, by comparison with all rows, that lie in their component.
    classes: cid, v; parts: node, component; chosen: rows (cid, v), which are sent to all tasks."""
    named = classes.join(parts, classes["cid"] == parts["node"], "left").select("cid", F.coalesce("component", "cid").alias("component"), "v")
    known = {r["node"]: r["component"] for r in parts.where(F.col("node").isin([r["cid"] for r in chosen])).collect()} if chosen else {}
    probes = {}
    for size in {len(r["v"]) for r in chosen}:
        own = [r for r in chosen if len(r["v"]) == size]
        ids = np.array([r["cid"] for r in own], np.int64)
        probes[size] = ids, np.array([known.get(i, i) for i in ids.tolist()], np.int64), unit_rows(np.array([r["v"] for r in own], float))
    got = named.mapInArrow(_probed(probes), "probe long, total long, found long").groupBy("probe").agg(F.sum("total").alias("t"), F.sum("found").alias("f"))
    return got.agg(F.avg(F.col("f") / F.col("t"))).first()[0] or (1.0 if got.isEmpty() else 0.0)


# --- exact counts within components --------------------------------------------------------------------------------

BLOCKS = "component long, block long, n int, total long, size int, center array<double>, radius double, ids binary, mult binary, x binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In: component, size, key, cid, mult, x, sorted. Out: blocks of up to CHUNK rows of one component."""
    part, number, group, held = TaskContext.get().partitionId(), 0, None, []

    def done() -> pa.RecordBatch:
        nonlocal number, held
        cid, mult, raw = zip(*held, strict=True)
        x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
        center = x.mean(0)
        length = np.linalg.norm(center)
        center = center / length if length > 1e-12 else x[0]
        radius = float(np.arccos(np.clip(x @ center, -1, 1)).max())
        row = (group[0], part << 32 | number, len(cid), sum(mult), group[1], center.tolist(), radius, np.array(cid, "<i8").tobytes(), np.array(mult, "<i8").tobytes(), x.tobytes())
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.binary(), pa.binary(), pa.binary())
        number, held = number + 1, []
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, kinds, strict=True)], names=[c.split()[0] for c in BLOCKS.split(", ")])

    for batch in batches:
        for component, size, _, cid, mult, x in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (component, size) != group or len(held) == CHUNK:
                if held:
                    yield done()
                group = component, size
            held.append((cid, mult, x))
    if held:
        yield done()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks: per row the multiplicity of the rows it is linked to on the other side."""
    for batch in batches:
        for k in range(batch.num_rows):
            same, size, *raw = (c[k].as_py() for c in batch.columns)
            ids, mult, ids_, mult_ = (np.frombuffer(r, "<i8") for r in (raw[0], raw[1], raw[3], raw[4]))
            x, y = (np.frombuffer(r, "<f8").reshape(-1, size) for r in (raw[2], raw[5]))
            i, j = near_pairs(x, y)
            if same:
                i, j = i[i != j], j[i != j]
            links = np.bincount(i, mult_[j], len(ids)).astype(np.int64)
            if not same:
                ids, links = np.r_[ids, ids_], np.r_[links, np.bincount(j, mult[i], len(ids_)).astype(np.int64)]
            some = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some])], names=["cid", "links"])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes of a block with what the blocks that are linked as a whole add to each."""
    for batch in batches:
        for ids, mult, sure, own in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            m = np.frombuffer(mult, "<i8")
            links = np.full(len(m), sure, np.int64) - (m if own else 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, "<i8")), pa.array(links)], names=["cid", "links"])


def link_counts(classes: DataFrame, parts: DataFrame, samples: dict[int, np.ndarray]) -> DataFrame:
    """(cid, links): the number of other vectors linked to a class, copies counted, its own left out. Exact within components.

    Components are cut into blocks in the order of one pass. Two blocks of a component aren't compared if all their pairs reach the
    threshold, or none does, by the angle between their centres and their radii. A component's blocks are dealt out in
    stripes of STRIPE, so a large one is many tasks' work."""
    linked = classes.join(parts, classes["cid"] == parts["node"]).select("component", "cid", "mult", "v")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for size, (component, cid, mult), x in _by_size(batches):
            if size not in known:
                known[size] = planes(samples.get(size), size, 0)
            columns = [pa.array(component, pa.int64()), pa.array(np.full(len(cid), size), pa.int32()), pa.array(keys_of(x, known[size])), pa.array(cid, pa.int64()), pa.array(mult, pa.int64()), pa.array([r.tobytes() for r in x], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["component", "size", "key", "cid", "mult", "x"])

    rows = linked.mapInArrow(keyed, "component long, size int, key long, cid long, mult long, x binary")
    order = ["component", "size", "key", "cid"]
    blocks = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocks, BLOCKS), "blocks")
    light = blocks.select("component", "block", "total", "center", "radius")
    numbers = light.groupBy(F.col("component").alias("of")).agg(F.ceil(F.count("*") / STRIPE).cast("int").alias("stripes"))
    light = light.join(numbers, light["component"] == numbers["of"]).drop("of")
    a = light.withColumn("stripe", F.pmod(F.xxhash64("block"), "stripes").cast("int"))
    b = light.select("component", F.explode(F.sequence(F.lit(0), F.col("stripes") - 1)).alias("stripe"), *[F.col(c).alias(f"{c}_") for c in ("block", "total", "center", "radius")])
    angle = F.acos(F.least(F.greatest(dot(F.col("center"), F.col("center_")), F.lit(-1.0)), F.lit(1.0)))
    both = a.join(b, ["component", "stripe"]).where("block <= block_").select("block", "block_", "total", "total_", angle.alias("angle"), (F.col("radius") + F.col("radius_")).alias("reach"))
    both = materialize(both.where(F.col("angle") - F.col("reach") <= ANGLE + EPS).withColumn("sure", F.col("angle") + F.col("reach") <= ANGLE - EPS), "block-pairs")
    give = F.array(F.struct(F.col("block").alias("to"), F.col("total_").alias("adds"), (F.col("block") == F.col("block_")).alias("own")), F.struct(F.col("block_").alias("to"), F.when(F.col("block") != F.col("block_"), F.col("total")).alias("adds"), F.lit(False).alias("own")))
    sure = both.where("sure").select(F.inline(give)).where("adds is not null").groupBy("to").agg(F.sum("adds").alias("adds"), F.max("own").alias("own"))
    wide = blocks.join(sure, blocks["block"] == sure["to"]).select("ids", "mult", "adds", "own").mapInArrow(_members, "cid long, links long")
    left, right = (blocks.select(F.col("block").alias(f"{s}b"), *[F.col(c).alias(f"{s}{c}") for c in ("ids", "mult", "x")]) for s in ("p", "q"))
    sizes = blocks.select(F.col("block").alias("pb"), "size")
    near = both.where("not sure").join(left, F.col("block") == F.col("pb")).join(right, F.col("block_") == F.col("qb")).join(sizes, "pb")
    near = near.select((F.col("pb") == F.col("qb")).alias("same"), "size", "pids", "pmult", "px", "qids", "qmult", "qx").mapInArrow(_counted, "cid long, links long")
    return wide.union(near).groupBy("cid").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of vectors: the id, n_links (other vectors at a cosine of THRESHOLD or more), component_id and kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do rows without an id,
    whose component is null. Vectors of different length aren't compared. Rows repeated under one id are vectors of their own, and
    link if they are usable. An empty table gives no rows; other columns aren't read. Links are exact within a component; components are
    those of the pairs that some pass compared, at a measured recall of GOAL or more.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = rows.where(usable(F.col("v")) & F.col("id").isNotNull())
    # Copies under one id in different classes would clash as class names, so a class is named by its place.
    classes = good.groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("mult")).withColumn("cid", F.monotonically_increasing_id())
    classes = materialize(classes, "classes")
    n = classes.count()
    samples: dict[int, list] = {}
    for r in _chosen(classes, SAMPLE, "planes"):
        samples.setdefault(len(r["v"]), []).append(r["v"])
    known = {size: unit_rows(np.array(own, float)) for size, own in samples.items()}
    probes = _chosen(classes, PROBES, "probes")
    todo, edges, parts, written = range(passes_for(n)), None, None, []
    while n:
        got = _found(classes, n, known, todo)
        edges = got if edges is None else edges.union(got)
        parts = materialize(connected_components(edges), "components")
        written += [got, parts]
        if measured_recall(classes, parts, probes) >= GOAL:
            break
        todo = range(todo.stop, 2 * todo.stop)
    if parts is None:
        parts = rows.sparkSession.createDataFrame([], "node long, component long")
    links = link_counts(classes, parts, known)
    least = classes.join(parts, classes["cid"] == parts["node"]).groupBy("component").agg(F.min("least").alias("name"))
    named = parts.join(least, "component").select(F.col("node").alias("cid"), "name")
    info = classes.join(named, "cid", "left").join(links, "cid", "left")
    info = materialize(info.select(F.col("v").alias("v_"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("name", "least").alias("component_id")), "named")
    for t in (classes, *written):
        discard(t)
    linked = good.join(info, good["v"] == info["v_"]).select("id", "n_links", "component_id")
    alone = rows.where(~(usable(F.col("v")) & F.col("id").isNotNull())).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.union(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
