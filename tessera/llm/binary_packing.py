"""Packing by powers of two: a document of n tokens becomes pieces as long as the binary digits of n say.

Full sequences come first, then the digits of what is left, largest first. Each piece is a sequence by itself,
so no sequence holds tokens of two documents and none is padded; a batch is taken from one length. Nothing is shuffled:
each task cuts its own documents and writes the pieces into one folder per length, and numbers are its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path
from .tokens import END, slices
from .words import word_encoder

MAX = 4096
PIECES = "doc_id long, start long, doc_tokens long, sequence_id long, ids binary, length int"


def lengths(n: int, most: int = MAX) -> list[int]:
    """Powers of two with the sum n: the longest as often as it fits, each smaller one at most once."""
    if most & (most - 1) or most < 1:
        raise ValueError("the longest length has to be a power of two")
    whole, rest = divmod(n, most)
    return [most] * whole + [1 << k for k in range(most.bit_length() - 2, -1, -1) if rest >> k & 1]


def _cut(tokenizer: str | None, end: int, most: int):
    sizes = 1 << np.arange(most.bit_length())[::-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(most.bit_length(), np.int64)

        def pieces(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
            tokens, total = word_encoder(tokenizer).encode(texts, end)
            pieces_of = total[:, None] // sizes  # the same as lengths()
            pieces_of[:, 1:] &= 1
            each, length = pieces_of.sum(1), np.repeat(np.tile(sizes, len(total)), pieces_of.ravel())
            bucket = np.log2(length).astype(np.int64)
            nth = np.empty(len(length), np.int64)
            for k in np.unique(bucket):
                own = np.flatnonzero(bucket == k)
                nth[own] = seen[k] + np.arange(len(own))
                seen[k] += len(own)
            ends = np.cumsum(length)
            raw = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(np.concatenate([[0], 4 * ends]).astype(np.int32)), pa.py_buffer(tokens)])
            start = ends - length - np.repeat(np.cumsum(total) - total, each)
            columns = [ids.take(pa.array(np.repeat(np.arange(len(total)), each))), pa.array(start), pa.array(np.repeat(total, each)), pa.array((part * 64 + bucket << 34) + nth), raw, pa.array(length.astype(np.int32))]
            return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in PIECES.split(", ")])

        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                yield pieces(*[c.slice(lo, hi - lo) for c in batch.columns])

    return run


def decompose(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end: int = END, most: int = MAX, path: str | None = None) -> DataFrame:
    """Write the pieces of all documents and read them back: doc_id, start, doc_tokens, sequence_id, ids (little-endian unsigned 32-bit), length.

    path holds one folder per length (length=1, length=2, ... length=most), so that a reader of one length reads no other.
    A null text counts as empty: one piece of one token, the end id. Rows of the same id, or of none, are cut one by one. An
    empty table gives no rows; other columns aren't read. A piece's sequence_id is unique: the task, the length and the
    place among the task's pieces of that length. Texts of any length are encoded whole.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = rows.mapInArrow(_cut(tokenizer, end, most), PIECES)
    path = path or new_path(docs.sparkSession, "sequences")
    pieces.write.partitionBy("length").parquet(path)
    return docs.sparkSession.read.schema(PIECES).parquet(path).withColumnRenamed("doc_id", id_col)


def bucket_sizes(sequences: DataFrame) -> DataFrame:
    """Sequences and tokens per length, for mixing lengths over a training run."""
    return sequences.groupBy("length").agg(F.count("*").alias("n_sequences"), F.sum(F.col("length").cast("long")).alias("n_tokens"))
