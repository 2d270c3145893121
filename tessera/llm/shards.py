"""Token files of independent zstandard frames with a trailing seek table.

A file is a series of zstandard frames, each of the ids (little-endian uint32) of some whole documents; then one frame
with the index (doc_id int64, flag of a null id uint8, frame uint32, first id within the frame uint32, ids uint32,
each column as a block); then a skippable frame in the public seekable format: per frame its
compressed size, its size and the low 32 bits of its XXH64, and a footer. A reader takes the footer, the
index and the frames of the documents that it wants; each frame is checked before it is used.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, new_path
from .tokens import END, encode_with_end

#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
FRAME_IDS, LEVEL = 1 << 16, 1


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _sum(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


class ShardWriter:
    """Writes one file; documents come one by one, and memory holds one frame and the index."""

    def __init__(self, out):
        self.out, self.zip = out, zstandard.ZstdCompressor(level=LEVEL)
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int, int, int]] = []
        self.held: list[np.ndarray] = []
        self.n = self.tokens = 0

    def _frame(self, raw: bytes) -> None:
        packed = self.zip.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), _sum(raw)))

    def _flush(self) -> None:
        if self.n:
            self._frame(np.concatenate(self.held).astype("<u4").tobytes())
            self.held, self.n = [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.n and self.n + len(ids) > FRAME_IDS:
            self._flush()
        self.docs.append((doc_id or 0, doc_id is None, len(self.frames), self.n, len(ids)))
        self.held.append(ids)
        self.n += len(ids)
        self.tokens += len(ids)

    def close(self) -> None:
        self._flush()
        columns = zip(*self.docs, strict=True) if self.docs else [[]] * 5
        self._frame(b"".join(np.array(list(c), t).tobytes() for c, t in zip(columns, ("<i8", "u1", "<u4", "<u4", "<u4"), strict=True)))
        table = b"".join(struct.pack("<III", *x) for x in self.frames)
        foot = struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + len(foot)) + table + foot)


class ShardReader:
    """Reads a file by its seek table; source is a random-access file."""

    def __init__(self, source):
        self.source, self.unzip = source, zstandard.ZstdDecompressor()
        size = source.size()
        n, kind, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or kind != CHECKSUMS:
            raise ValueError("no seek table with checksums")
        table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3)
        self.size, self.raw, self.sums = table[:, 0].astype(int), table[:, 1].astype(int), table[:, 2]
        self.start = np.r_[0, np.cumsum(self.size)[:-1]]
        index, at, cols = self.frame(n - 1), 0, []
        m = len(index) // 21
        for t in ("<i8", "u1", "<u4", "<u4", "<u4"):
            cols.append(np.frombuffer(index, t, m, at))
            at += m * np.dtype(t).itemsize
        self.doc_id, self.null, self.of, self.first, self.n = cols

    def _at(self, place: int, n: int) -> bytes:
        self.source.seek(place)
        return self.source.read(n)

    def frame(self, k: int) -> bytes:
        raw = self.unzip.decompress(self._at(int(self.start[k]), int(self.size[k])), max_output_size=int(self.raw[k]))
        if len(raw) != self.raw[k] or _sum(raw) != self.sums[k]:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) in file order; with wanted ids, only their frames are read."""
        rows = np.arange(len(self.doc_id)) if wanted is None else np.flatnonzero(np.isin(self.doc_id, list(wanted)) & (self.null == 0))
        last, ids = -1, np.zeros(0, np.uint32)
        for i in rows.tolist():
            if self.of[i] != last:
                last = int(self.of[i])
                ids = np.frombuffer(self.frame(last), "<u4")
            yield (None if self.null[i] else int(self.doc_id[i])), ids[int(self.first[i]) : int(self.first[i]) + int(self.n[i])]


def _write(folder: str, tokenizer: str | None, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        fs, top = _fs(folder)
        fs.create_dir(top, recursive=True)
        # Another try of the task writes a file of its own; the manifest names the one whose task counted.
        name = f"part-{part:06d}-{uuid.uuid4().hex}.tokens"
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        with fs.open_output_stream(f"{top}/{name}") as out:
            writer = ShardWriter(out)
            for batch in chain([first], batches):
                for doc_id, ids in zip(batch.column(0).to_pylist(), encode_with_end(batch.column(1), tokenizer, end), strict=True):
                    writer.add(doc_id, ids)
            writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([len(writer.docs)], pa.int64()), pa.array([writer.tokens], pa.int64())], names=["part", "path", "docs", "tokens"])

    return run


def write_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, tokenizer: str | None = None, end: int = END) -> DataFrame:
    """Encode every text, append the end id, and write files in ascending id order, one per range of ids.

    Returns the manifest, one row per file: part, path, docs, tokens; files it doesn't name are those of tasks that were lost. A null text counts as empty (its
    document is the end id alone), null ids come first, rows of one id stay next to each other in the order of their
    texts. An empty table writes no file. Other columns aren't read.
    """
    folder = folder or new_path(docs.sparkSession, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    return materialize(dealt.mapInArrow(_write(folder, tokenizer, end), "part int, path string, docs long, tokens long"), "manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
            fs, name = _fs(path)
            rows = []
            with fs.open_input_file(name) as source:
                for doc_id, ids in ShardReader(source).documents():
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in zip(("doc_id", "start", "n_tokens", "ids_crc32"), zip(*rows, strict=True), strict=True)})


def read_digests(manifest: DataFrame) -> DataFrame:
    """Of each document in the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = max(1, manifest.count())
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return manifest.select("part", "path", before.alias("start")).repartitionByRange(files, "part").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark, paths: list[str], wanted: list[int]) -> Iterator[tuple[int | None, np.ndarray]]:
    """Chosen documents of some files, on the driver; only their frames are read."""
    for path in paths:
        fs, name = _fs(path)
        with fs.open_input_file(name) as source:
            yield from ShardReader(source).documents(wanted)
