"""Removal of long repeated byte strings by longest previous factors, taken from suffix order.

A byte goes if some LENGTH-byte string that covers it also starts earlier in the corpus (smaller id, or same
document and earlier start). No suffix array of the whole corpus is needed for that. Equal strings choose equal anchors
(the least hashed K-gram among those inside, the rightmost if several), so strings can only be equal where their
anchors are:

1. Each document gives its anchors, each with a hash of its region: the bytes of all strings that can hold it. Regions
   equal within a task are settled there; the rest is dealt out by anchor as packed arrays.
2. Per anchor, equal regions are settled: all but the earliest copy go. Anchors left with several different
   regions ask for the text of one copy of each.
3. The documents asked for give these regions, which are dealt out by anchor again.
4. Per anchor the suffixes of its regions are sorted. The longest previous factor of a suffix is the longer of its common prefixes
   with the suffixes at the previous and at the next smaller position in that order; a string goes if it reaches LENGTH, beyond which
   it isn't followed.
5. The spans of each document are joined to it and cut out.

An anchor with more than HOT different regions (a boilerplate line in ever new surroundings) is dealt out by longer keys: with half of the
spare bytes more on its left or on its right, one of which any string holds, and so on while such a key is as common. A key as long as a
string needs no comparison, only its least position. Which are common is counted over all rows, and no match depends on it.
The number of parts follows from the bytes of the corpus, so a task holds about PART of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

LENGTH, K = 100, 32
SPARE = LENGTH - K  # bytes of a string beside its anchor
SLICE, FLUSH, REGIONS, HOT, PART = 1 << 18, 800_000, 10_000, 20_000, 24 << 20
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
ROW = np.dtype([("anchor", "<u8"), ("region", "<u8"), ("key", "<i8"), ("at", "<i4")])
SPAN = np.dtype([("key", "<i8"), ("start", "<i4"), ("end", "<i4")])


# --- anchors --------------------------------------------------------------------------------------------------------


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the K-gram at each place."""
    x, n = _BYTE[raw], 1
    while n < K:
        x = x[:-n] * _A ^ x[n:] * _B
        x ^= x >> np.uint64(29)
        n *= 2
    return x


def _least(h: np.ndarray) -> np.ndarray:
    """For each string's start the place of the least K-gram hash within, the rightmost of equal ones."""
    low = np.uint64(2 * SLICE - 1)
    v = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
    width, n = SPARE + 1, 1
    while 2 * n <= width:
        v = np.minimum(v[:-n], v[n:])
        n *= 2
    if n < width:
        v = np.minimum(v[: len(v) - (width - n)], v[width - n :])
    return (low - (v & low)).astype(np.int64)


def anchors(raw: bytes, cuts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors in a run of documents; cuts: where each ends. Strings cross no document."""
    places, hashes = [], []
    data = np.frombuffer(raw, np.uint8)
    ends = np.array(cuts, np.int64)
    last = -1
    for lo in range(0, len(data) - LENGTH + 1, SLICE):
        part = data[lo : lo + SLICE + LENGTH - 1]
        h = _gram_hashes(part)
        least = _least(h)
        start = lo + np.arange(len(least))
        inside = ends[np.searchsorted(ends, start, side="right").clip(max=len(ends) - 1)] >= start + LENGTH
        got = least[inside]
        if not len(got):
            continue
        got = got[np.r_[True, got[1:] != got[:-1]]]
        if lo + got[0] == last:
            got = got[1:]
        if len(got):
            last = lo + int(got[-1])
            places.append(lo + got)
            hashes.append(h[got])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(places), np.concatenate(hashes)


def _doc_rows(key: np.ndarray, raw: bytes, cuts: list[int]) -> np.ndarray:
    places, hashes = anchors(raw, cuts)
    ends = np.array(cuts, np.int64)
    of = np.searchsorted(ends, places, side="right")
    begin = np.r_[0, ends[:-1]][of]
    lo, hi = np.maximum(begin, places - SPARE), np.minimum(ends[of], places + LENGTH)
    rows = np.empty(len(places), ROW)
    digest = xxhash.xxh3_64_intdigest
    rows["region"] = np.fromiter((digest(raw[a:b], c) for a, b, c in zip(lo.tolist(), hi.tolist(), (places - lo).tolist(), strict=True)), np.uint64, len(places))
    rows["anchor"], rows["key"], rows["at"] = hashes, key[of], places - begin
    return rows


# --- spans ----------------------------------------------------------------------------------------------------------


def merged(spans: np.ndarray) -> np.ndarray:
    """Overlapping or touching spans of a document as one; sorted."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["end"], spans["start"], spans["key"]))]
    new = np.r_[True, spans["key"][1:] != spans["key"][:-1]]
    doc = np.cumsum(new) - 1
    far = np.int64(1) << 32
    end = np.maximum.accumulate(spans["end"].astype(np.int64) + doc * far)
    start = spans["start"].astype(np.int64) + doc * far
    first = np.r_[True, start[1:] > end[:-1]]
    last = np.r_[np.flatnonzero(first)[1:] - 1, len(spans) - 1]
    out = spans[first].copy()
    out["end"] = end[last] - doc[last] * far
    return out


def _settled(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(earliest row per anchor and region, the others)."""
    rows = rows[np.lexsort((rows["at"], rows["key"], rows["region"], rows["anchor"]))]
    same = np.r_[False, (rows["anchor"][1:] == rows["anchor"][:-1]) & (rows["region"][1:] == rows["region"][:-1])]
    return rows[~same], rows[same]


# --- the steps ------------------------------------------------------------------------------------------------------

DEALT = "part int, rows binary, spans binary"


def _copies(rows: np.ndarray) -> np.ndarray:
    """Spans of later copies of a region, with the end left open: the document's own end isn't known here."""
    out = np.empty(len(rows), SPAN)
    out["key"], out["start"], out["end"] = rows["key"], np.maximum(rows["at"] - SPARE, 0), rows["at"] + LENGTH
    return out


def _deal(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            rows, copies = _settled(np.concatenate(held))
            part = (rows["anchor"] >> np.uint64(20)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            rows, part = rows[order], part[order]
            edge = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
            used = [i for i in range(parts) if edge[i] < edge[i + 1]]
            blobs = [b"".join(np.ascontiguousarray(rows[f][edge[i] : edge[i + 1]]).tobytes() for f in ROW.names) for i in used]
            spans = merged(_copies(copies)).tobytes()
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(blobs, pa.binary()), pa.array([spans, *[b""] * (len(used) - 1)], pa.binary())], names=["part", "rows", "spans"])

        for batch in batches:
            keys = batch.column(0).to_numpy()
            texts = batch.column(1).cast(pa.binary())
            size = np.cumsum(pc.binary_length(texts).to_numpy())
            at = 0
            while at < len(keys):
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + (1 << 20))))
                some = texts.slice(at, to - at).to_pylist()
                cuts = np.cumsum([len(x) for x in some]).tolist()
                held.append(_doc_rows(keys[at:to], b"".join(some), cuts))
                n += len(held[-1])
                at = to
                if n > FLUSH:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    return run


def _unpacked(blob: bytes) -> np.ndarray:
    n = len(blob) // ROW.itemsize
    rows, at = np.empty(n, ROW), 0
    for f in ROW.names:
        size = ROW[f].itemsize * n
        rows[f] = np.frombuffer(blob, ROW[f], n, at)
        at += size
    return rows


FOUND = "key long, start int, end int, anchor long"


def _batch(key, start, end, anchor) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(anchor, pa.int64())], names=["key", "start", "end", "anchor"])


def _settle(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows of a part at a time. Out: spans (anchor 0), and the regions asked for (start the anchor's place, end -1, or -2 if there are more than `most`)."""

    def done(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        rows, copies = _settled(np.concatenate([_unpacked(x) for x in held]))
        spans = merged(_copies(copies))
        if len(spans):
            yield _batch(spans["key"], spans["start"], spans["end"], np.zeros(len(spans), np.int64))
        new = np.r_[True, rows["anchor"][1:] != rows["anchor"][:-1]]
        group = np.cumsum(new) - 1
        regions = np.bincount(group)[group]
        ask = rows[regions > 1]
        if len(ask):
            yield _batch(ask["key"], ask["at"], np.where(regions[regions > 1] > most, -2, -1), np.ascontiguousarray(ask["anchor"]).view(np.int64))

    part, held = None, []
    for batch in batches:
        for i, rows, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if spans:
                own = np.frombuffer(spans, SPAN)
                yield _batch(own["key"], own["start"], own["end"], np.zeros(len(own), np.int64))
            if i != part and held:
                yield from done(held)
                held = []
            part = i
            held.append(rows)
    if held:
        yield from done(held)


REGION = "part int, anchor binary, key binary, at binary, left binary, size binary, text binary"
SINGLE = "k long, x int, y int, key long, at int, left int, text binary"


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(anchor, key, place, bytes before it, text) of the regions asked for. In: key, text, asked (array of (start, anchor))."""
    for batch in batches:
        keys, texts, asked = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2)
        for i, key in enumerate(keys):
            raw = texts[i].as_py()
            for place in asked[i].as_py():
                at, lo = place["start"], max(0, place["start"] - SPARE)
                yield place["anchor"] & (1 << 64) - 1, key, at, at - lo, raw[lo : at + LENGTH]


def _packed(found: Iterator[tuple[int, int, int, int, bytes]], parts: int) -> Iterator[pa.RecordBatch]:
    """Regions packed by anchor."""
    held: list[tuple[int, int, int, int, bytes]] = []

    def flush() -> pa.RecordBatch:
        part = np.array([(a >> 20) % parts for a, *_ in held])
        order = np.argsort(part, kind="stable")
        rows = []
        for i in np.unique(part).tolist():
            own = [held[j] for j in order[np.searchsorted(part[order], i) : np.searchsorted(part[order], i, side="right")]]
            a, k, at, left, text = zip(*own, strict=True)
            rows.append((i, np.array(a, "<u8").tobytes(), np.array(k, "<i8").tobytes(), np.array(at, "<i4").tobytes(), np.array(left, "<i2").tobytes(), np.array([len(x) for x in text], "<i2").tobytes(), b"".join(text)))
        names = [x.split()[0] for x in REGION.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if j == 0 else pa.binary()) for j, c in enumerate(zip(*rows, strict=True))], names=names)

    for row in found:
        held.append(row)
        if len(held) >= 160_000:
            yield flush()
            held = []
    if held:
        yield flush()


def _regions(parts: int):
    return lambda batches: _packed(_asked(batches), parts)


def _repacked(parts: int):
    """In: SINGLE."""
    return lambda batches: _packed(((k & (1 << 64) - 1, key, at, left, text) for b in batches for k, _, _, key, at, left, text in zip(*[c.to_pylist() for c in b.columns], strict=True)), parts)


def _singles(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names=[x.split()[0] for x in SINGLE.split(", ")])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for anchor, key, at, left, text in _asked(batches):
        rows.append((_signed(anchor), 0, 0, key, at, left, text))
        if len(rows) == 10_000:
            yield _singles(rows)
            rows = []
    yield _singles(rows)


def _longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each region under its two next longer keys: with half of the spare bytes that are left on either side."""
    for batch in batches:
        rows = []
        for _, x, y, key, at, left, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            half = (SPARE - x - y + 1) // 2
            for p, q in ((x, y + half), (x + half, y)):
                if p <= left and left + K + q <= len(text):
                    rows.append((_signed(xxhash.xxh64_intdigest(text[left - p : left + K + q], seed=p)), p, q, key, at, left, text))
        yield _singles(rows)


def suffix_ranks(text: np.ndarray, group: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Suffix order of aligned rows, column by column from the last: (column, order, rank) of the rows' suffixes there, within
    their groups. A suffix is its first symbol and the suffix behind it, whose rank is known by then, so each column takes one sort.
    text: symbols 0 to 256, 0 for none."""
    head = group.astype(np.uint64) << np.uint64(40)
    rank = np.zeros(len(group), np.uint64)
    for c in range(text.shape[1] - 1, -1, -1):
        key = head | text[:, c].astype(np.uint64) << np.uint64(28) | rank
        order = np.argsort(key)
        own = key[order]
        dense = np.cumsum(np.r_[False, own[1:] != own[:-1]]).astype(np.uint64)
        rank = np.empty_like(dense)
        rank[order] = dense
        yield c, order, rank


def smaller_before(p: np.ndarray) -> np.ndarray:
    """For each place of p the last one before it with a smaller value, -1 if there is none. Minima over spans of doubling width
    are searched from the widest down, so the work depends on the length of p alone, not on the order of its values."""
    least = [p]
    while 2 << len(least) - 1 <= len(p):
        width = 1 << len(least) - 1
        least.append(np.minimum(least[-1][:-width], least[-1][width:]))
    at = np.arange(len(p))  # all values from here to the place are larger
    for k in range(len(least) - 1, -1, -1):
        lo = at - (1 << k)
        larger = lo >= 0
        larger[larger] = least[k][lo[larger]] > p[larger]
        at[larger] = lo[larger]
    return at - 1


def previous_factors(sa: np.ndarray, group: np.ndarray, strings: np.ndarray) -> np.ndarray:
    """Longest previous factor of each suffix, up to the width of strings. sa: positions in suffix order, those of a group together and
    groups in the order of their positions; group, strings: by position."""
    before = smaller_before(sa)
    after = len(sa) - 1 - smaller_before(sa[::-1])[::-1]
    factor = np.zeros(len(sa), np.int64)
    for near in (before, after):
        i = np.flatnonzero((near >= 0) & (near < len(sa)))
        i = i[group[sa[i]] == group[sa[near[i]]]]
        other = strings[sa[i]] != strings[sa[near[i]]]
        factor[i] = np.maximum(factor[i], np.where(other.any(1), other.argmax(1), strings.shape[1]))
    return factor


def _repeats(anchor, key, at, left, size, text: bytes) -> np.ndarray:
    """Spans of the strings of LENGTH bytes that also stand at a smaller position within their anchor's regions.

    Equal strings have their anchor at the same distance, so the regions are laid out with their anchors in one column, and a
    string's matches start in its own column. Rows are in the order of their positions."""
    into = np.lexsort((at, key, anchor))
    begin = np.r_[0, np.cumsum(size.astype(np.int64))[:-1]]
    anchor, key, at, left, size, begin = (x[into] for x in (anchor, key, at.astype(np.int64), left.astype(np.int64), size.astype(np.int64), begin))
    group = np.cumsum(np.r_[False, anchor[1:] != anchor[:-1]])
    raw = np.frombuffer(text, np.uint8)
    width = SPARE + LENGTH
    place = np.arange(width) - SPARE + left[:, None]
    rows = np.where((place >= 0) & (place < size[:, None]), raw[np.clip(begin[:, None] + place, 0, len(raw) - 1)].astype(np.uint16) + 1, 0).astype(np.uint16)
    plain = np.ascontiguousarray(rows.astype(np.uint8))
    out = []
    for c, order, _ in suffix_ranks(rows, group):
        if c > SPARE:
            continue
        ok = (left >= SPARE - c) & (size - left >= LENGTH - SPARE + c)
        sa = order[ok[order]]
        if len(sa) < 2:
            continue
        hit = sa[previous_factors(sa, group, plain[:, c : c + LENGTH]) >= LENGTH]
        spans = np.empty(len(hit), SPAN)
        spans["key"], spans["start"] = key[hit], at[hit] - (SPARE - c)
        spans["end"] = spans["start"] + LENGTH
        out.append(spans)
    return merged(np.concatenate(out)) if out else np.zeros(0, SPAN)


GONE = "part int, spans binary"


def _by_key(spans: np.ndarray, parts: int) -> pa.RecordBatch:
    """Spans packed by where their documents are gathered."""
    part = ((spans["key"] * np.int64(0x9E3779B1)) >> np.int64(16)) % parts
    order = np.argsort(part, kind="stable")
    used, first = np.unique(part[order], return_index=True)
    blobs = [x.tobytes() for x in np.split(spans[order], first[1:])]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "spans"])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All spans of a part's documents, overlapping ones as one."""

    def done(held: list[np.ndarray]) -> pa.RecordBatch:
        spans = merged(np.concatenate(held))
        return _batch(spans["key"], spans["start"], spans["end"], np.zeros(len(spans), np.int64))

    part, held = None, []
    for batch in batches:
        for i, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if i != part and held:
                yield done(held)
                held = []
            part = i
            held.append(np.frombuffer(spans, SPAN))
            if sum(map(len, held)) > FLUSH:
                held = [merged(np.concatenate(held))]
    if held:
        yield done(held)


def _compare(parts: int):
    return lambda batches: _compared(batches, parts)


def _compared(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Regions of a part at a time, the groups of many anchors at once."""

    def done(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        spans = list(repeated(held))
        if spans:
            yield _by_key(merged(np.concatenate(spans)), parts)

    def repeated(held: list[tuple]) -> Iterator[np.ndarray]:
        anchor, key, at, left, size = (np.concatenate([np.frombuffer(x[i], t) for x in held]) for i, t in enumerate(("<u8", "<i8", "<i4", "<i2", "<i2")))
        text = b"".join(x[5] for x in held)
        begin = np.r_[0, np.cumsum(size.astype(np.int64))]
        order = np.argsort(anchor, kind="stable")
        edge = np.flatnonzero(np.r_[True, anchor[order][1:] != anchor[order][:-1]]).tolist() + [len(order)]

        def found(own: np.ndarray) -> Iterator[np.ndarray]:
            some = b"".join([text[begin[j] : begin[j + 1]] for j in own.tolist()])
            spans = _repeats(anchor[own], key[own], at[own], left[own], size[own], some)
            if len(spans):
                yield spans

        lo = 0
        for i in range(1, len(edge)):
            if i == len(edge) - 1 or edge[i + 1] - edge[lo] > REGIONS:
                own = order[edge[lo] : edge[i]]
                yield from found(own)
                lo = i

    part, held = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[0] != part and held:
                yield from done(held)
                held = []
            part = row[0]
            held.append(row[1:])
    if held:
        yield from done(held)


def _cut(spans: list[dict] | None, size: int) -> list[tuple[int, int]]:
    if not spans:
        return []
    rows = np.array([(0, x["start"], min(x["end"], size)) for x in spans], SPAN)
    rows = rows[rows["end"] - rows["start"] >= LENGTH]
    return [(int(x["start"]), int(x["end"])) for x in merged(rows)]


def _common(rows: DataFrame, parts: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Regions of common anchors (SINGLE) under keys that aren't common, packed, and spans of whole strings that are."""
    packed, spans = None, None
    while True:
        rows = materialize(rows, "common")
        often = rows.groupBy("k", "x", "y").agg(F.count("*").alias("n"), F.min(F.struct("key", F.col("at") - F.col("x"))).alias("least")).where(F.col("n") > HOT)
        often = materialize(often.select(F.col("k").alias("hk"), F.col("x").alias("hx"), F.col("y").alias("hy"), "least"), "common-keys")
        same = (rows["k"] == often["hk"]) & (rows["x"] == often["hx"]) & (rows["y"] == often["hy"])
        few = rows.join(often, same, "left_anti").select(*[x.split()[0] for x in SINGLE.split(", ")]).mapInArrow(_repacked(parts), REGION)
        packed = few if packed is None else packed.union(few)
        if often.isEmpty():
            return packed, spans
        hot = rows.join(often, same)
        whole = hot.where((F.col("x") + F.col("y") >= SPARE) & (F.struct("key", F.col("at") - F.col("x")) != F.col("least")))
        whole = whole.select("key", (F.col("at") - F.col("x")).alias("start"), (F.col("at") - F.col("x") + LENGTH).alias("end"))
        spans = whole if spans is None else spans.union(whole)
        rows = hot.where(F.col("x") + F.col("y") < SPARE).select(*[x.split()[0] for x in SINGLE.split(", ")]).mapInArrow(_longer, SINGLE)


def repeated_spans(rows: DataFrame) -> DataFrame:
    """rows: key (unique, in corpus order), text (not null). Returns key, start, end of strings to remove, in bytes; a span
    may run past the document's end, and one shorter than LENGTH within the document doesn't count."""
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART))
    dealt = rows.mapInArrow(_deal(parts), DEALT)
    found = materialize(dealt.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(partial(_settle, most=HOT), FOUND), "settled")

    def texts(end: int) -> DataFrame:
        asked = found.where(F.col("end") == end).groupBy(F.col("key").alias("asked_key")).agg(F.collect_list(F.struct("start", "anchor")).alias("asked"))
        return rows.join(asked.hint("shuffle_hash"), rows["key"] == asked["asked_key"]).select("key", "text", "asked")

    regions = texts(-1).mapInArrow(_regions(parts), REGION)
    spans = found.where("end >= 0").select("key", "start", "end")
    if not found.where("end = -2").isEmpty():
        more, whole = _common(texts(-2).mapInArrow(_alone, SINGLE), parts)
        regions = regions.union(more)
        spans = spans if whole is None else spans.union(whole)
    gone = regions.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_compare(parts), GONE)
    more = gone.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_gather, FOUND)
    return spans.union(more.select("key", "start", "end"))


OUT = "key long, n_bytes long, n_removed long, n_spans long, kept binary, kept_text string"


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In: key, text, spans and perhaps a struct that is handed through."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            some = batch.slice(at, 500)
            texts, spans = some.column(1).cast(pa.binary()).to_pylist(), some.column(2).to_pylist()
            sizes, gone, runs, kept = [], [], [], []
            for raw, own in zip(texts, spans, strict=True):
                cuts = _cut(own, len(raw))
                sizes.append(len(raw))
                gone.append(sum(b - a for a, b in cuts))
                runs.append(len(cuts))
                edge = [0, *[x for c in cuts for x in c], len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True)) if cuts else raw)
            arrays = [some.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64())]
            # A cut may fall within a character; what is left of it goes from the text, not from the bytes.
            arrays += [pa.array(kept, pa.binary()), pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())]
            yield pa.RecordBatch.from_arrays([*arrays, some.column(3)], names=[*[x.split()[0] for x in OUT.split(", ")], "rest"])


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: n_bytes, n_removed, n_spans, kept (binary: the bytes that stay), kept_text (the whole characters
    of these), and rest, a struct of the other columns of docs, the id among them.

    A null text counts as empty, texts of any length are read as a whole. Rows of one id, or of none, come in the order of their texts, nulls
    first; of equal rows any one is the first. An empty table gives no rows.
    """
    rest = F.struct(*[F.col(c) for c in docs.columns if c != text_col]).alias("rest")
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), rest)
    odd = docs.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n")).where("n > 1 or id is null")
    if not odd.isEmpty():  # ids aren't keys: places in the order of ids and texts are
        places = rows.repartitionByRange("key", "text").sortWithinPartitions("key", "text")
        rows = materialize(places.withColumn("key", F.monotonically_increasing_id()), "keyed")
    spans = repeated_spans(rows.select("key", "text")).groupBy(F.col("key").alias("span_key")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = rows.join(spans.hint("shuffle_hash"), rows["key"] == spans["span_key"], "left").select("key", "text", "spans", "rest")
    kind = rows.schema["rest"].dataType.simpleString()
    return joined.mapInArrow(_kept, f"{OUT}, rest {kind}").drop("key")
