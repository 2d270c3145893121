"""Encoding whole texts with the vocabulary that marks word ends, quickly and in bounded memory.

That tokenizer composes, lower-cases, drops white space and splits by a pattern of which no match goes past white space, past
the end of a run of letters, or past a run of marks without an apostrophe. A text is cut at some of these places; each
distinct chunk is encoded by the library once, and a bounded table in each worker keeps what was encoded.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

from .tokens import Chunked

VOCABULARY = "word_bpe_49k.json"
_LETTER, _MARK, _BLANK = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~", r" \t\n\r"
#: Latin letters up to an ASCII character that is none; marks up to a Latin letter or a blank; anything else up to a blank.
CHUNKS = re.compile(rf"[{_LETTER}]+(?![^\x00-@\[-`{{-\x7f])|[{_MARK}]+(?=[{_LETTER}]|[{_BLANK}]|\Z)|[^{_BLANK}]+")
#: A word's last letter and marks behind it up to a space, for Arrow.
WORD_AND_MARKS = rf"([{_LETTER}])([{_MARK}]+)( |$)"
#: What the library's pattern matches as one, so that exactly its last token ends a word.
SINGLE = re.compile(rf"[{_LETTER}]+|[{_MARK}]+")


class WordEncoder(Chunked):
    chunks = CHUNKS

    def __init__(self, path: str):
        super().__init__(path)
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True

    def pieces(self, texts: pa.Array) -> pa.ListArray:
        """Texts cut at spaces, and marks from the words before them."""
        spaced = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " "), WORD_AND_MARKS, r"\1 \2\3")
        return pc.split_pattern(spaced, " ")

    def _learn(self, new: list[str]) -> None:
        single = [x for x in new if SINGLE.fullmatch(x)]
        for i in range(0, len(single), 4000):
            some = single[i : i + 4000]
            ids = np.array(self.library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            raw = ids.tobytes()
            for x, lo, hi in zip(some, [0, *cuts[:-1]], cuts, strict=True):
                self.known[x] = raw[lo:hi]
        rest = [x for x in new if x not in self.known]
        for i in range(0, len(rest), 2000):
            some = rest[i : i + 2000]
            for x, got in zip(some, self.library.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.known[x] = array("I", got.ids).tobytes()


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str | None = None) -> WordEncoder:
    """This process's encoder for a file; workers are used again from task to task."""
    path = path or public_tokenizers.path(VOCABULARY)
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
