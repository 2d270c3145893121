"""Alignment of two tokenizers by the bytes at which their tokens end together.

The first tokenizer (A) is the byte-level one, the second (B) the one of pieces, which puts a space before a text; A is given
the same. Where a token of A and one of B end at the same byte they are linked, and such bytes cut the tokens into
groups. How often the corpus links two ids is counted in dense matrices: the ids of B are dealt into stripes, pairs travel
to the stripe of their B id, np.add.at adds them into the stripe's rows (B ids) and columns (A ids), and row maxima say
which A ids are a B id's best. The links themselves are dealt by bands of stripes, to the same tasks as the bands' counts, and
scored there.

Links are packed: what a task knows of some thousand documents becomes one row per band, pairs first and the documents that hold them
behind. Tasks read pairs without documents for counting, and a band's links may lie in several tasks (salts), each with the
band's counts; so no id, however frequent, gathers its links in one task.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .tokens import CHUNKS, encoder

PIECES = "piece_bpe_32k.model"
#: Stripes of the ids of B, whose dense matrices are made one at a time; bands of stripes, by which links travel.
STRIPES, BANDS = 256, 32
#: Bytes of links that one task scores, about.
TASK_BYTES = 128 << 20
#: Entries that a worker keeps of chunks it has seen, the longest such chunk, and the chunks of the documents that are packed together.
KEPT, LONGEST, HELD = 600_000, 48, 400_000
LINKS = "row_key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, band int, keys binary, totals binary, sizes binary, docs binary, times binary"


def letters_of_bytes() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Aligner:
    """Token ids of both tokenizers for chunks of texts, and the links between them.

    Texts are cut where A's splitting pattern always cuts (tokens.CHUNKS): before white space, behind a word of letters, between marks and letters, around a
    lone line feed. B's vocabulary is tested for pieces that go past such places; if there are any, texts aren't cut, or not those with the white space in question.
    """

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece

        self.a, self.b = encoder(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte, vocabulary = letters_of_bytes(), self.a.library.get_vocab()
        self.n_a, self.n_b = max(vocabulary.values()) + 1, self.b.get_piece_size()
        self.a_bytes, added = [b""] * self.n_a, set(self.a.library.get_added_tokens_decoder())
        for x, i in vocabulary.items():
            self.a_bytes[i] = x.encode() if i in added else bytes(byte[c] for c in x)
        names = [self.b.id_to_piece(i) for i in range(self.n_b)]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.a_len, self.b_len = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        self.space, self.line_feed = self.b.piece_to_id("▁"), self.b.piece_to_id("<0x0A>")
        #: White space that B's vocabulary holds in a piece with something else; texts that have it aren't cut.
        inner = {c for x in names for c in re.findall(r"(?<=.)\s", x)}
        self.uncut = re.compile("|".join(map(re.escape, sorted(inner)))) if inner else None
        past = re.compile(r"[^▁]▁|\n|[A-Za-zÀ-ÖØ-öø-ÿ][\x00-@\[-`{-\x7f]|[!-/:-@\[-`{-~][A-Za-zÀ-ÖØ-öø-ÿ]")
        self.sound = not any(past.search(x) for i, x in enumerate(names) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i)))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        #: By entry: tokens of A, tokens of B, first link and number of links; the ids of a chunk without tokens are counted as -1.
        self.table = np.zeros((0, 4), np.int64)
        self.pairs = np.zeros(0, np.int64)
        self.strings: list[str] = []

    def rows(self) -> int:
        """Rows of a stripe's matrix."""
        return -(-self.n_b // STRIPES)

    def _ids_of_b(self, chunks: list[str]) -> list[list[int]]:
        """Of each chunk, without the space that B puts before it: a chunk's own first space stands for it, or a line feed keeps it from the chunk."""
        got = self.b.encode([x[1:] if x[0] == " " else f"\n{x}" for x in chunks], num_threads=1)
        for i, x in enumerate(chunks):
            if x == " ":
                got[i] = [self.space]
            elif x[0] != " ":
                if got[i][:2] != [self.space, self.line_feed]:
                    raise ValueError("a piece holds the added space and more of the text")
                del got[i][:2]
        return got

    def _ids_of_a(self, chunks: list[str]) -> list[bytes]:
        known = self.a.known
        known.clear()
        self.a._learn([x for x in chunks if len(x) <= LONGEST])
        return [known[x] if len(x) <= LONGEST else self.a._one(x) for x in chunks]

    def add(self, chunks: list[str]) -> None:
        """Learn chunks of texts, each once."""
        raw_a, ids_b = self._ids_of_a(chunks), self._ids_of_b(chunks)
        n_a, n_b, good = np.array([len(x) for x in raw_a]) // 4, np.array([len(x) for x in ids_b]), np.ones(len(chunks), bool)
        a, b = np.frombuffer(b"".join(raw_a), "<u4").astype(np.int64), np.fromiter(chain.from_iterable(ids_b), np.int64, int(n_b.sum()))
        raw = [x.encode() for x in chunks]
        ends, all_raw = np.cumsum([len(x) for x in raw]), b"".join(raw)
        for ids, n, length, names in ((a, n_a, self.a_len, self.a_bytes), (b, n_b, self.b_len, self.b_bytes)):
            upto = np.concatenate([[0], np.cumsum(length[ids])])[np.cumsum(n)]
            if not np.array_equal(upto, ends) or b"".join(map(names.__getitem__, ids.tolist())) != all_raw:
                cuts = np.cumsum(n) - n
                good &= [b"".join(map(names.__getitem__, ids[lo : lo + k].tolist())) == x for lo, k, x in zip(cuts, n, raw, strict=True)]
        if not good.all():  # the ids of the others are left out
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            n_a, n_b = n_a * good, n_b * good
        end_a, end_b = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        place, at_a, at_b = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
        pairs = ((b[at_b] % STRIPES) * self.rows() + b[at_b] // STRIPES) * self.n_a + a[at_a]
        upto = np.searchsorted(at_a, np.cumsum(n_a))  # links before the end of each chunk
        n_links = np.diff(upto, prepend=0)
        text_a, text_b = [str(x) for x in a.tolist()], [str(x) for x in b.tolist()]
        lo_a = lo_b = 0
        groups = []
        for hi_a, hi_b in zip((at_a + 1).tolist(), (at_b + 1).tolist(), strict=True):
            groups.append(f"{','.join(text_a[lo_a:hi_a])}|{','.join(text_b[lo_b:hi_b])}")
            lo_a, lo_b = hi_a, hi_b
        base = len(self.strings)
        self.strings += [";".join(groups[lo:hi]) for lo, hi in zip([0, *upto[:-1].tolist()], upto.tolist(), strict=True)]
        self.table = np.concatenate([self.table, np.stack([np.where(good, n_a, -1), n_b, len(self.pairs) + upto - n_links, n_links], axis=1)])
        self.pairs = np.concatenate([self.pairs, pairs])
        self.known.update(zip(chunks, range(base, base + len(chunks)), strict=True))

    def chunks(self, text: str | None) -> list[str]:
        """The chunks of a text behind a space; none for a null or empty one."""
        if not text:
            return []
        if not self.sound or (self.uncut and self.uncut.search(text)):
            return [f" {text}"]
        return CHUNKS.findall(f" {text}")

    def entries(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Each text's entries in the table. Longer chunks than LONGEST aren't found again."""
        if len(self.known) > KEPT or len(self.pairs) > 8 * KEPT:
            self.forget()
        known, flat = self.known, list(chain.from_iterable(texts))
        got = list(map(known.get, flat))
        missing = [i for i, x in enumerate(got) if x is None]
        new = list({flat[i] for i in missing})
        for i in range(0, len(new), 20_000):
            self.add(new[i : i + 20_000])
        for i in missing:
            got[i] = known[flat[i]]
        for x in new:
            if len(x) > LONGEST:
                del known[x]
        return np.split(np.array(got, np.int64), np.cumsum([len(t) for t in texts])[:-1])


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str | None = None, b_path: str | None = None) -> Aligner:
    """This process's aligner for two files."""
    key = (a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path(PIECES))
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of the ranges."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def _documents(al: Aligner, ids: list[int | None], texts: list[list[str]], first: int) -> Iterator[dict[str, list]]:
    """The rows of some documents, and of their links by band."""
    entries = al.entries(texts)
    size = np.array([len(x) for x in entries], np.int64)
    at = np.concatenate(entries)
    got = al.table[at]
    good, sums = np.ones(len(texts), bool), np.zeros((len(texts), 3), np.int64)
    doc = np.repeat(np.arange(len(texts)), size)
    good[doc[got[:, 0] < 0]] = False
    for k, column in enumerate((0, 1, 3)):
        sums[:, k] = np.bincount(doc, got[:, column], len(texts))  # whole numbers below 2 ** 53
    sums[~good] = 0
    digests = [hashlib.sha256(";".join(map(al.strings.__getitem__, x.tolist())).encode()).hexdigest() if g and len(x) else "" for x, g in zip(entries, good.tolist(), strict=True)]
    yield {"row_key": (first + np.arange(len(texts))).tolist(), "doc_id": ids, "n_a": sums[:, 0].tolist(), "n_b": sums[:, 1].tolist(), "n_groups": sums[:, 2].tolist(), "n_links": sums[:, 2].tolist(), "groups_sha256": digests}

    kept = good[doc]
    start, n = got[kept, 2], got[kept, 3]
    both = al.pairs[_spread(start, n)] * len(texts) + np.repeat(doc[kept], n)
    both, times = np.unique(both, return_counts=True)
    pair, doc = both // len(texts), both % len(texts)
    firsts = np.flatnonzero(np.diff(pair, prepend=-1))
    sizes, totals, pair = np.diff(firsts, append=len(doc)), np.add.reduceat(times, firsts) if len(firsts) else times, pair[firsts]
    width = al.rows() * (STRIPES // BANDS) * al.n_a  # a band's cells, fewer than 2 ** 32
    edges = np.searchsorted(pair, np.arange(BANDS + 1) * width)
    inner = np.concatenate([firsts, [len(doc)]])[edges]
    rows: dict[str, list] = {x: [] for x in ("row_key", "band", "keys", "totals", "sizes", "docs", "times")}
    for band in np.flatnonzero(np.diff(edges)):
        lo, hi, d, e = edges[band], edges[band + 1], inner[band], inner[band + 1]
        values = (first, int(band), (pair[lo:hi] - band * width).astype("<u4"), totals[lo:hi].astype("<u4"), sizes[lo:hi].astype("<u4"), doc[d:e].astype("<u2"), times[d:e].astype("<u4"))
        for x, v in zip(rows, values, strict=True):
            rows[x].append(v.tobytes() if isinstance(v, np.ndarray) else v)
    yield rows


def _linked(a_path: str | None, b_path: str | None):
    schema = pa.schema([(x.split()[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]]) for x in LINKS.split(", ")])

    def batch_of(rows: dict[str, list]) -> pa.RecordBatch:
        n = len(rows["row_key"])
        return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) if f.name in rows else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al, part, nth = aligner(a_path, b_path), TaskContext.get().partitionId(), 0

        def some() -> Iterator[tuple[list[int | None], list[list[str]]]]:
            ids, texts, n = [], [], 0
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    for doc_id, text in zip(*(c.slice(at, 512).to_pylist() for c in batch.columns), strict=True):
                        ids.append(doc_id)
                        texts.append(al.chunks(text))
                        n += len(texts[-1])
                        if n > HELD or len(ids) == 1 << 16:
                            yield ids, texts
                            ids, texts, n = [], [], 0
            if ids:
                yield ids, texts

        for ids, texts in some():
            yield from map(batch_of, _documents(al, ids, texts, (part << 40) + nth))
            nth += len(ids)

    return run


def _arrays(batches: Iterable[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(x).to_pylist() for x in columns), strict=True)


def _combined(width: int):
    """Pairs of a task's rows by stripe, the same ones added up: what Spark's partial aggregation does for plain columns."""
    most = 4 << 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        weight: list[np.ndarray] = []

        def added() -> None:
            key, n = np.concatenate(held), np.concatenate(weight)
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            at = np.flatnonzero(np.diff(key, prepend=-1))
            held[:], weight[:] = [key[at]], [np.add.reduceat(n, at)]

        def rows() -> pa.RecordBatch:
            stripe = held[0] // width
            cuts = np.flatnonzero(np.diff(stripe, prepend=-1)).tolist()
            parts = list(zip(cuts, [*cuts[1:], len(stripe)], strict=True))
            keys = [(held[0][lo:hi] - stripe[lo] * width).astype("<u4").tobytes() for lo, hi in parts]
            return pa.RecordBatch.from_arrays([pa.array(stripe[cuts].astype(np.int32)), pa.array(keys, pa.binary()), pa.array([weight[0][lo:hi].astype("<i8").tobytes() for lo, hi in parts], pa.binary())], names=["stripe", "keys", "totals"])

        for band, keys, totals in _arrays(batches, "band", "keys", "totals"):
            held.append(np.frombuffer(keys, "<u4").astype(np.int64) + band * (STRIPES // BANDS) * width)
            weight.append(np.frombuffer(totals, "<u4").astype(np.int64))
            if sum(map(len, held)) > 2 * most:
                added()
                if len(held[0]) > most:
                    yield rows()
                    held.clear()
                    weight.clear()
        if held:
            added()
            yield rows()

    return run


def _counted(n_rows: int, n_columns: int):
    """The dense matrix of each stripe, from rows sorted by stripe: its pairs, their counts and whether they are their row's highest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, stripe = np.zeros(n_rows * n_columns, np.int64), None

        def done() -> pa.RecordBatch:
            at = np.flatnonzero(block)
            best = block.reshape(n_rows, n_columns).max(axis=1)
            columns = [at.astype("<u4"), block[at].astype("<i8"), (block[at] == best[at // n_columns]).astype("u1")]
            return pa.RecordBatch.from_arrays([pa.array([stripe], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in columns]], names=["stripe", "keys", "counts", "best"])

        for own, keys, totals in _arrays(batches, "stripe", "keys", "totals"):
            if own != stripe:
                if stripe is not None:
                    yield done()
                    block[:] = 0
                stripe = own
            np.add.at(block, np.frombuffer(keys, "<u4"), np.frombuffer(totals, "<i8"))
        if stripe is not None:
            yield done()

    return run


def _scored(width: int):
    """Sums per document over the links of a band, from rows sorted by band in which its counts come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, counts, table = None, [], None
        for band, salt, stripe, keys, totals, best, row_key, sizes, docs, times in _arrays(batches, "band", "salt", "stripe", "keys", "totals", "best", "row_key", "sizes", "docs", "times"):
            if (band, salt) != group:
                group, counts, table = (band, salt), [], None
            if stripe >= 0:
                key = np.frombuffer(keys, "<u4").astype(np.int64) + (stripe % (STRIPES // BANDS)) * width
                counts.append((key, np.frombuffer(totals, "<i8"), np.frombuffer(best, "u1")))
                continue
            if table is None:
                table, counts = [np.concatenate(x) for x in zip(*counts, strict=True)], []
            at = np.searchsorted(table[0], np.frombuffer(keys, "<u4"))
            size, doc, n = np.frombuffer(sizes, "<u4"), np.frombuffer(docs, "<u2"), np.frombuffer(times, "<u4").astype(np.int64)
            sums = np.zeros((int(doc.max()) + 1, 2), np.int64)
            np.add.at(sums[:, 0], doc, n * np.repeat(table[2][at], size))
            np.add.at(sums[:, 1], doc, n * np.repeat(table[1][at], size))
            has = np.flatnonzero(sums[:, 1])
            yield pa.RecordBatch.from_arrays([pa.array(row_key + has), pa.array(sums[has, 0]), pa.array(sums[has, 1])], names=["row_key", "n_best", "count_sum"])

    return run


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """One row per document: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A text that is null or empty, or whose tokens' bytes aren't those of the text behind a space, has no tokens: zeros and an empty
    groups_sha256. Rows of the same id, or of none, are taken one by one, and each counts. An empty table gives no rows;
    other columns aren't read. Texts of any length are encoded whole. The driver gathers one row: the bytes of the largest band.
    """
    al = aligner(a_path, b_path)
    width = al.rows() * al.n_a  # a stripe's cells
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    linked = materialize(rows.mapInArrow(_linked(a_path, b_path), LINKS), "links")
    packed = linked.where("band is not null")
    counts = packed.select("band", "keys", "totals").mapInArrow(_combined(width), "stripe int, keys binary, totals binary")
    counts = counts.repartition("stripe").sortWithinPartitions("stripe").mapInArrow(_counted(al.rows(), al.n_a), "stripe int, keys binary, counts binary, best binary")
    counts = materialize(counts, "pair-counts")

    most = packed.groupBy("band").agg(F.sum(4 * F.octet_length("sizes") + 3 * F.octet_length("docs")).alias("n")).agg(F.max("n")).first()[0] or 0
    salts = 1 + most // TASK_BYTES
    empty = F.lit(None).cast("binary")
    given = counts.select((F.col("stripe") / (STRIPES // BANDS)).cast("int").alias("band"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "stripe", "keys", F.col("counts").alias("totals"), "best", F.lit(0).cast("long").alias("row_key"), empty.alias("sizes"), empty.alias("docs"), empty.alias("times"))
    asked = packed.select("band", F.pmod(F.hash("row_key"), F.lit(salts)).alias("salt"), F.lit(-1).alias("stripe"), "keys", empty.alias("totals"), empty.alias("best"), "row_key", "sizes", "docs", "times")
    dealt = given.unionByName(asked).repartition("band", "salt").sortWithinPartitions("band", "salt", F.col("stripe") < 0, "stripe")
    sums = dealt.mapInArrow(_scored(width), "row_key long, n_best long, count_sum long").groupBy("row_key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    own = linked.where("band is null").select("row_key", F.col("doc_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    out = own.join(sums, "row_key", "left")
    return out.select(id_col, "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in ("n_best", "count_sum")], "groups_sha256")
