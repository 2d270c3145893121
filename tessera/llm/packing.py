"""Best-two-fit packing of tokenised documents into sequences of at most MAX tokens.

Only the lengths decide the packing, and there are at most MAX of them: the counts per length are gathered, bins are
made from the counts, and each piece takes the bin that its rank among the pieces of its length falls to. A bin is
filled greedily, the longest piece that fits first; then its smallest piece is replaced with the two unpacked pieces that
fit the gap so made more tightly, if there are such. The same bin is made as often as the counts
allow, each kind of bin uses up a length, so the kinds are bounded by the lengths and not by the documents.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .tokens import END, encode_with_end, encoder, slices

MAX = 1024
#: Chunks that a worker keeps and bytes of texts that it encodes at a time: fewer than where encoding is a query's whole work.
KEPT, TEXTS = 700_000, 8 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def cut(n: int, most: int = MAX) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter than most, if there are several."""
    first = n % most or most
    return [(0, min(first, n)), *((s, most) for s in range(first, n, most))]


def best_pair(counts: np.ndarray, room: int) -> tuple[int, int] | None:
    """The two lengths of the largest sum up to room that the counts allow; the more even one of the same sums."""
    have = np.flatnonzero(counts[: room + 1])
    have = have[have > 0]
    if not len(have):
        return None
    rest = room - have
    at = np.searchsorted(have, np.minimum(rest, have), side="right") - 1  # the longer is have, the shorter at most it
    alone = (at >= 0) & (have[at.clip(0)] == have) & (counts[have] < 2)
    at = at - alone
    fits = at >= 0
    if not fits.any():
        return None
    total = np.where(fits, have + have[at.clip(0)], -1)
    i = int(total.argmax())
    return int(have[i]), int(have[at[i]])


def bins(counts: dict[int, int], most: int = MAX) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a bin, number of such bins) from the counts per length."""
    left = np.zeros(most + 1, np.int64)
    for k, v in counts.items():
        left[k] = v
    out = []
    while left[1:].any():
        use = left.copy()
        bin_, gap = [], most
        while gap:
            have = np.flatnonzero(use[1 : gap + 1])
            if not len(have):
                break
            size = int(have[-1]) + 1
            bin_.append(size)
            use[size] -= 1
            gap -= size
        if gap and len(bin_) > 1:
            small = bin_[-1]  # not more than any before it
            pair = best_pair(use, gap + small)
            if pair and sum(pair) > small:
                bin_[-1:] = sorted(pair, reverse=True)
        need = Counter(bin_)
        times = min(int(left[k]) // n for k, n in need.items())
        for k, n in need.items():
            left[k] -= n * times
        out.append((tuple(bin_), times))
    return out


def slots(kinds: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, number, first sequence, offset), sorted: which ranks of a length go where."""
    rank: Counter[int] = Counter()
    rows, sequence = [], 0
    for sizes, times in kinds:
        offset = 0
        for size in sizes:
            rows.append((size, rank[size], times, sequence, offset))
            rank[size] += times
            offset += size
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _pieces(tokenizer: str | None, end: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen: Counter[int] = Counter()
        encoder(tokenizer).kept = KEPT
        for batch in batches:
            for lo, hi in slices(batch.column(1), TEXTS):
                some = batch.slice(lo, hi - lo)
                rows = []
                for doc_id, ids in zip(some.column(0).to_pylist(), encode_with_end(some.column(1), tokenizer, end), strict=True):
                    for k, (start, n) in enumerate(cut(len(ids), most)):
                        rows.append((doc_id, k, start, n, zlib.crc32(ids[start : start + n]), part, seen[n]))
                        seen[n] += 1
                columns = list(zip(*rows, strict=True))
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])
        encoder(tokenizer).rest()

    return run


def _placed(table: np.ndarray):
    keys = table[:, 0] << 44 | table[:, 1] if len(table) else np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            row = table[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in ("doc_id", "piece", "start", "length", "ids_crc32")], pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end: int = END, most: int = MAX) -> DataFrame:
    """One row per piece: the id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty: one piece, the end id alone. Only documents longer than most are cut, and only
    their first piece is shorter. Rows of the same id (or of none) are packed one by one. An empty table gives
    no rows; other columns aren't read. The driver gathers one count per length (at most `most` rows).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pieces = materialize(rows.mapInArrow(_pieces(tokenizer, end, most), PIECES), "pieces")
    per_task = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = slots(bins(counts, most))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = per_task.select(F.col("part").alias("part_"), F.col("length").alias("length_"), before.alias("before"))
    ranked = pieces.join(first, (pieces["part"] == first["part_"]) & (pieces["length"] == first["length_"]))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("rank"))
    placed = ranked.mapInArrow(_placed(table), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumnRenamed("doc_id", id_col)
