"""Byte-level BPE from a rank file: encoding by segment trees of pair ranks, and decoding.

The leaves of a piece's tree are its byte positions; a leaf holds the rank of the pair that starts there, with its
position, so the root names the leftmost pair of the least rank. A merge takes the right neighbour out of the list of
live positions and updates the leaves of the merged token, of its left neighbour and of the one that went, each
in a logarithmic number of nodes. Many short pieces are run side by side as rows of one array; long ones alone.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import CHUNKS

RANKS = "byte_bpe_50k.tiktoken"
KEPT, LONGEST, SIDE_BY_SIDE, CHUNKS_AT_ONCE = 600_000, 48, 64, 250_000
NONE = np.int64(1) << 60


class Ranks:
    """The vocabulary of a rank file; a token's rank is its id."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ids.values()) + 1)
        for token, i in self.ids.items():
            self.tokens[i] = token
        self.bytes = np.array([self.ids[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for token, i in self.ids.items():
            for cut in range(1, len(token)):
                a, b = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = i
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        # White space as Unicode has it: Python's classes count four separators more.
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.known: dict[str, bytes] = {}

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NONE where there is no such token."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def merge_long(self, piece: bytes) -> list[int]:
        """One piece of any length, by one tree."""
        n = len(piece)
        token = self.bytes[np.frombuffer(piece, np.uint8)].tolist()
        size = 1 << max(0, n - 2).bit_length()
        none = int(NONE)
        tree = [none] * (2 * size)
        get = self.pairs.get
        for i in range(n - 1):
            r = get(token[i] << 20 | token[i + 1])
            if r is not None:
                tree[size + i] = r << 32 | i
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            k = size + i
            if tree[k] == value:
                return
            tree[k] = value
            while k > 1:
                k >>= 1
                x, y = tree[2 * k], tree[2 * k + 1]
                least = x if x < y else y
                if tree[k] == least:
                    break
                tree[k] = least

        while tree[1] < none:
            r, i = tree[1] >> 32, tree[1] & 0xFFFFFFFF
            j = after[i]
            token[i] = r
            if j < size:
                put(j, none)
            after[i] = k = after[j]
            token[j] = -1
            if k < n:
                before[k] = i
                s = get(r << 20 | token[k])
                put(i, none if s is None else s << 32 | i)
            else:
                put(i, none)
            if (h := before[i]) >= 0:
                s = get(token[h] << 20 | r)
                put(h, none if s is None else s << 32 | h)
        return [x for x in token if x >= 0]

    def merge_short(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Pieces of at least 2 bytes with at most size pairs each, side by side; ids as the bytes of uint32."""
        n = np.array([len(x) for x in pieces])
        m, width = len(pieces), size + 1
        raw = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in pieces), np.uint8).reshape(m, width)
        token = self.bytes[raw]
        place = np.arange(width)
        token[place >= n[:, None]] = -1
        tree = np.full((m, 2 * size), NONE)
        rank = self._rank(np.maximum(token[:, :-1], 0), np.maximum(token[:, 1:], 0))
        tree[:, size:] = np.where((place[1:] < n[:, None]) & (rank < NONE), rank << 8 | place[:-1], NONE)
        k = size
        while k > 1:
            k >>= 1
            tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])
        after = np.tile(np.arange(1, width + 2), (m, 1))
        before = np.tile(np.arange(-1, width), (m, 1))
        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            root = tree[live, 1]
            r, i = root >> 8, root & 255
            j = after[live, i]
            token[live, i], token[live, j] = r, -1
            k = after[live, j]
            after[live, i] = k
            before[live, k] = i
            h = before[live, i]
            end = k >= n[live]
            right = self._rank(r, token[live, np.minimum(k, width - 1)].clip(0))
            left = self._rank(token[live, h.clip(0)].clip(0), r)
            tree[live, size + i] = np.where(end | (right >= NONE), NONE, right << 8 | i)
            has = h >= 0
            tree[live[has], size + h[has]] = np.where(left[has] >= NONE, NONE, left[has] << 8 | h[has])
            inside = j < size
            tree[live[inside], size + j[inside]] = NONE
            row = np.concatenate([live, live[has], live[inside]])
            node = size + np.concatenate([i, h[has], j[inside]])
            while size > 1 and node[0] > 1:
                node = node >> 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
            live = live[tree[live, 1] < NONE]
        keep = token >= 0
        flat = token[keep].astype(np.uint32)
        cut = np.cumsum(keep.sum(1)).tolist()
        return [flat[lo:hi].tobytes() for lo, hi in zip([0, *cut], cut, strict=False)]

    def _learn(self, new: list[str]) -> None:
        split = [[x.encode() for x in self.pattern.findall(chunk)] for chunk in new]
        done: dict[bytes, bytes] = {}
        short: dict[int, list[bytes]] = {}
        for piece in set().union(*split):
            if (i := self.ids.get(piece)) is not None:
                done[piece] = array("I", [i]).tobytes()
            elif len(piece) > SIDE_BY_SIDE:
                done[piece] = array("I", self.merge_long(piece)).tobytes()
            else:
                short.setdefault(1 << max(0, len(piece) - 2).bit_length(), []).append(piece)
        for size, pieces in short.items():
            done.update(zip(pieces, self.merge_short(pieces, size), strict=True))
        for chunk, pieces in zip(new, split, strict=True):
            self.known[chunk] = b"".join([done[x] for x in pieces])

    def encode_many(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """ids of each text as uint32."""
        held: list[list[str]] = []
        n = 0
        for text in texts:
            held.append(CHUNKS.findall(text or ""))
            n += len(held[-1])
            if n > CHUNKS_AT_ONCE:
                yield from self._encoded(held)
                held, n = [], 0
        yield from self._encoded(held)

    def _encoded(self, held: list[list[str]]) -> Iterator[np.ndarray]:
        new = set().union(*held).difference(self.known)
        if len(self.known) + len(new) > KEPT:
            self.known.clear()
            new = set().union(*held)
        self._learn(list(new))
        known = self.known
        for chunks in held:
            yield np.frombuffer(b"".join([known[x] for x in chunks]), np.uint32)
        for x in new:  # long chunks aren't kept
            if len(x) > LONGEST:
                del known[x]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@cache
def ranks(path: str | None = None, pattern: str | None = None) -> Ranks:
    """This process's tables for a rank file."""
    return Ranks(path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN)


def encode(text: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """ids of a text (array of int), without special tokens; null counts as the empty text, whose array is empty. Texts of any length are
    encoded as a whole, repeated rows alike; a column of no rows gives none."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([x.view(np.int32) for x in ranks(path, pattern).encode_many(texts)], dtype=object)

    return run(F.coalesce(text, F.lit("")))


def decode(ids: Column, path: str | None = None) -> Column:
    """Bytes of an array of ids; null gives null."""

    @F.pandas_udf(T.BinaryType())
    def run(rows: pd.Series) -> pd.Series:
        table = ranks(path, None)
        return pd.Series([None if x is None else table.decode(np.asarray(x)) for x in rows], dtype=object)

    return run(ids)


DIGEST = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


@F.pandas_udf(DIGEST)
def digests(rows: pd.Series) -> pd.DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of arrays of ids."""
    table, out = ranks(), []
    for ids in rows:
        ids = np.asarray(ids, np.int64)
        text = " ".join(map(str, ids.tolist()))
        out.append((len(ids), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(table.decode(ids)).hexdigest()))
    return pd.DataFrame(out, columns=DIGEST.names)
