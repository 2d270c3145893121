"""Encoding whole texts with a tokenizers file, quickly and in bounded memory.

The pattern that splits texts before the merges always splits before a run of white space that follows something
else, and where a word of letters ends; a text is cut at some of these places into chunks and each distinct chunk is encoded by the library once; a bounded table in each worker keeps what was encoded.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY, END = "byte_bpe_50k.json", 2
#: Entries that a worker keeps: when half of them are new, what wasn't used meanwhile goes. Longer chunks than LONGEST aren't kept.
KEPT, LONGEST = 1_000_000, 48
#: White space as Unicode has it; Python's \s also takes four separators.
_SPACE, _LETTER = r"[^\S\x1c-\x1f]", "[A-Za-zÀ-ÖØ-öø-ÿ]"
#: A lone line feed stands by itself. A run of Latin letters ends where an ASCII character that is no letter follows, and a run of ASCII marks without an
#: apostrophe ends where a Latin letter or white space follows; any other chunk lasts to the next white space.
CHUNKS = re.compile(rf"\n(?=[\S\x1c-\x1f])|{_SPACE}*{_LETTER}+(?![^\x00-@\[-`{{-\x7f])|{_SPACE}*[!-&(-/:-@\[-`{{-~]+(?={_LETTER}|{_SPACE}|\Z)|{_SPACE}*[\S\x1c-\x1f]+|{_SPACE}+")
SPACED = re.compile(_SPACE)


#: Where Arrow cuts texts: at a single space, around a lone line feed, and between a word's last letter and marks at its end; by a character that stands for nothing else.
CUT, _SEEN, _WORD, _MARKS = "\x01", r"[!-~\pL\pM\pN\pP\pS]", "[A-Za-zÀ-ÖØ-öø-ÿ]", r"[!-&(-/:-@\[-`{-~]+"
#: A space with something else than visible characters on both sides.
ODD_SPACE = rf"(^|[^!-~\pL\pM\pN\pP\pS]) | ($|[^!-~\pL\pM\pN\pP\pS])"
SPACE_CUT = rf"({_SEEN}) ({_SEEN})", rf"\1{CUT} \2"
CUTS = [(rf"({_SEEN})\n({_SEEN})", f"\\1{CUT}\n{CUT}\\2"), (rf"({_WORD})({_MARKS})({CUT}|$)", rf"\1{CUT}\2\3")]


class Chunked:
    """ids of whole texts as Tokenizer.encode(text, add_special_tokens=False) gives them, special strings being ordinary text.

    Arrow cuts the texts into pieces and finds the different ones; Python cuts these into chunks, of which each that isn't known is encoded by the library."""

    chunks: re.Pattern

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.kept = 0  # instead of KEPT

    def pieces(self, texts: pa.Array) -> pa.ListArray:
        raise NotImplementedError

    def _learn(self, new: list[str]) -> None:
        raise NotImplementedError

    def _one(self, chunk: str) -> bytes:
        return array("I", self.library.encode_batch_fast([chunk], add_special_tokens=False)[0].ids).tobytes()

    def of_pieces(self, pieces: list[str]) -> list[bytes]:
        """ids of different pieces; one that isn't known is put together from its chunks."""
        gc.disable()  # many small lists and no cycles
        try:
            return self._of_pieces(pieces)
        finally:
            gc.enable()

    def _of_pieces(self, pieces: list[str]) -> list[bytes]:
        if len(self.known) > (self.kept or KEPT) // 2:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        got = list(map(known.get, pieces))
        missing = [i for i, x in enumerate(got) if x is None]
        # Letters behind a first character are best left together; anything else is cut.
        parts = [[x] if x[1:].isalpha() else self.chunks.findall(x) for x in map(pieces.__getitem__, missing)]
        new = {x for p in parts for x in p if x not in known}
        known.update({x: older[x] for x in new if x in older})
        self._learn([x for x in new if x not in older and len(x) <= LONGEST])
        for i, p in zip(missing, parts, strict=True):  # long chunks are encoded where they stand, and not kept
            own = [known[x] if len(x) <= LONGEST else self._one(x) for x in p]
            got[i] = own[0] if len(own) == 1 else b"".join(own)
        return got

    def rest(self) -> None:
        """Give back memory that the task has left unused, since the worker may wait long for the next one, beside others' work."""
        pa.default_memory_pool().release_unused()

    def encode(self, texts: pa.Array, tail: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another as uint32, number of ids of each); tail: an id behind each text's own. A null has none of its own."""
        pieces = self.pieces(pc.fill_null(texts, ""))
        flat = pieces.flatten().dictionary_encode()
        each = np.diff(pieces.offsets.to_numpy())
        own = self.of_pieces(flat.dictionary.to_pylist())
        index = flat.indices.to_numpy()
        del pieces
        if tail is not None:
            index = np.insert(index, np.cumsum(each), len(own))
            own.append(np.uint32(tail).tobytes())
            each = each + 1
        kind = np.int32 if sum(map(len, own)) < 2**31 and len(flat) < 2**24 else np.int64
        n = np.array([len(x) for x in own], kind) // 4
        start, count = (np.cumsum(n, dtype=kind) - n)[index], n[index]
        upto = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        kind = kind if upto[-1] < 2**31 else np.int64
        at = np.repeat(start.astype(kind) - upto[:-1].astype(kind), count) + np.arange(upto[-1], dtype=kind)
        return np.frombuffer(b"".join(own), np.uint32)[at], np.diff(upto[np.concatenate([[0], np.cumsum(each)])])

    def encode_each(self, texts: pa.Array, tail: int | None = None) -> Iterator[np.ndarray]:
        """ids of each text; some megabytes of texts are encoded at a time, a longer text by itself."""
        for lo, hi in slices(texts):
            ids, n = self.encode(texts.slice(lo, hi - lo), tail)
            yield from np.split(ids, np.cumsum(n)[:-1])


def slices(texts: pa.Array, size: int = 12 << 20) -> list[tuple[int, int]]:
    """(first, behind the last) of texts of about `size` bytes together."""
    if not len(texts):
        return []
    block = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy()) // size
    cuts = np.flatnonzero(np.diff(block, prepend=-1)).tolist()
    return list(zip([0, *cuts[1:]], [*cuts[1:], len(texts)], strict=True))


class Encoder(Chunked):
    chunks = CHUNKS

    def __init__(self, path: str):
        super().__init__(path)
        self.line_feed = self.library.encode("\n", add_special_tokens=False).ids[-1]

    def pieces(self, texts: pa.Array) -> pa.ListArray:
        if pc.any(pc.match_substring(texts, CUT)).as_py():  # whole texts
            return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32)), texts)
        odd = pc.match_substring_regex(texts, ODD_SPACE)
        cut = pc.replace_substring(texts, " ", f"{CUT} ")
        if pc.any(odd).as_py():
            cut = pc.replace_with_mask(cut, odd, pc.replace_substring_regex(texts.filter(odd), *SPACE_CUT))
        texts = cut
        for pattern, to in CUTS:
            texts = pc.replace_substring_regex(texts, pattern, to)
        return pc.split_pattern(texts, CUT)

    def _learn(self, new: list[str]) -> None:
        plain, rest = [], []
        for x in new:
            (rest if SPACED.search(x, x[0] == " ") else plain).append(x)
        for i in range(0, len(plain), 4000):  # joined by line feeds, which are tokens of their own here
            some = plain[i : i + 4000]
            ids = np.array(self.library.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(ids == self.line_feed)
            raw, cuts = ids.tobytes(), 4 * cuts
            for x, lo, hi in zip(some, [0, *(cuts + 4).tolist()], [*cuts.tolist(), len(raw)], strict=True):
                self.known[x] = raw[lo:hi]
        for i in range(0, len(rest), 2000):
            some = rest[i : i + 2000]
            for x, got in zip(some, self.library.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.known[x] = array("I", got.ids).tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """This process's encoder for a file; workers are used again from task to task."""
    path = path or public_tokenizers.path(VOCABULARY)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_with_end(texts: pa.Array, path: str | None = None, end: int = END) -> Iterator[np.ndarray]:
    """ids of each text with the end id behind them."""
    return encoder(path).encode_each(texts, end)


__all__ = ["END", "VOCABULARY", "encode_with_end", "encoder"]
