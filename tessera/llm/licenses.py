"""License scans: fixed phrases, and an exact set-similarity join of text blocks with templates, in DataFrame functions alone.

A block is any window of BLOCK words. It meets a template if it holds at least CONTAINMENT of the template's distinct words. The words of the templates
are put in order by the number of documents that hold them, counted over all documents, rarest first. A block that
meets a template of n words in o places or more must hold one of the template's first n - o + 1 words (prefix
filter), have o template words at all (length filter), and still reach o from the first word they share
(positional filter); what is left is compared in full. Of the windows of a text only those that start with a template word and hold a
word of a prefix are made: moving the start of any other up to its first template word loses no word of a template.
The templates are constants, so the join runs within each row and no text is shuffled.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pii import let

# The base phrases with their labels, and the notices that licenses tell people to use.
PHRASES = [
    (("cc", "by"), "cc-by"),
    (("general", "public", "license"), "gpl"),
    (("all", "rights", "reserved"), "reserved"),
]
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("boost", "distributed under the boost software license version 1 0"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
]

BLOCK, CONTAINMENT = 64, 0.8
#: All ASCII but digits and letters stands between words.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OUTPUTS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _needed(n: int) -> int:
    return math.ceil(CONTAINMENT * n - 1e-9)


def _template_words() -> list[set[str]]:
    return [set(text.split()) for _, text in TEMPLATES]


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _words(text: Column) -> Column:
    """Words of a text, with its own capitals."""
    bare = F.btrim(F.regexp_replace(text, GAP, " "))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, " ", -1))


def document_counts(docs: DataFrame, text_col: str = "text") -> dict[str, int]:
    """In how many documents each template word stands; as many rows as the templates have words, gathered on the driver."""
    known = sorted(set().union(*_template_words()))
    held = F.array_intersect(_words(F.lower(F.coalesce(F.col(text_col), F.lit("")))), _strings(known))
    counted = docs.select(F.explode(held).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return {w: 0 for w in known} | {r["word"]: r["n"] for r in counted.collect()}


def _base(words: Column) -> Column:
    """Array of (label, start) of the phrases, over lower-case words."""

    def of(phrase: tuple[str, ...], label: str) -> Column:
        def here(i: Column) -> Column:
            return reduce(lambda a, b: a & b, [F.coalesce(F.get(words, i + k) == w, F.lit(False)) for k, w in enumerate(phrase)])

        places = F.filter(F.transform(words, lambda w, i: F.when((w == phrase[0]) & here(i), i)), lambda x: x.isNotNull())
        return F.transform(places, lambda i: F.struct(F.lit(label).alias("label"), i.alias("start")))

    return F.concat(*[of(*p) for p in PHRASES])


def _matches(words: Column, order: list[str]) -> Column:
    """Array of (label, containment) of the blocks that meet a template; order: all template words, rarest first."""
    rank = {w: i for i, w in enumerate(order)}
    ordered, prefixes = _strings(order), _strings(prefix_words(order))
    starts = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(ordered, w), i)), lambda i: i.isNotNull())
    windows = F.filter(F.transform(starts, lambda i: F.slice(words, i + 1, BLOCK)), lambda b: F.arrays_overlap(b, prefixes))
    # array_intersect keeps the order of its first argument: the block's template words, rarest first.
    blocks = F.array_distinct(F.transform(windows, lambda b: F.array_intersect(ordered, b)))
    return let(blocks, lambda bs: _met(bs, rank))


def _met(blocks: Column, rank: dict[str, int]) -> Column:
    def of(label: str, own: set[str]) -> Column:
        mine = sorted(own, key=rank.__getitem__)
        n, o = len(mine), _needed(len(mine))
        theirs = _strings(mine)

        def candidate(b: Column) -> Column:
            first = F.get(F.array_intersect(theirs, b), F.lit(0))
            at, there = F.array_position(theirs, first), F.array_position(b, first)
            return (F.size(b) >= o) & F.arrays_overlap(b, _strings(mine[: n - o + 1])) & (F.least(n - at + 1, F.size(b) - there + 1) >= o)

        shares = F.transform(F.filter(blocks, candidate), lambda b: F.size(F.array_intersect(b, theirs)) / F.lit(float(n)))
        return F.transform(F.filter(shares, lambda s: s >= o / n - 1e-9), lambda s: F.struct(F.lit(label).alias("label"), s.alias("share")))

    return F.concat(*[of(label, own) for (label, _), own in zip(TEMPLATES, _template_words(), strict=True)])


def prefix_words(order: list[str]) -> list[str]:
    """Words of which any block that meets a template holds one."""
    rank = {w: i for i, w in enumerate(order)}
    out: set[str] = set()
    for own in _template_words():
        out.update(sorted(own, key=rank.__getitem__)[: len(own) - _needed(len(own)) + 1])
    return sorted(out)


def with_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with, in place of any columns of these names, n_words, n_base, first_word, last_word, base_labels, labels and score (the largest containment, 1 for a phrase).

    Null texts count as empty: no words, no labels, score 0. Repeated rows are scanned row by row, texts of any length as a whole, and an
    empty table stays empty. The table is read twice.
    """
    counts = document_counts(docs, text_col)
    order = sorted(counts, key=lambda w: (counts[w], w))
    own = [c for c in docs.columns if c not in OUTPUTS]
    text = F.coalesce(F.col(text_col), F.lit(""))
    no_base = F.expr("cast(array() as array<struct<label:string,start:int>>)")
    no_match = F.expr("cast(array() as array<struct<label:string,share:double>>)")
    # Words in lower case by all of Unicode find the texts worth a look; those are then split again as the contract says.
    one = docs.select("*", F.explode(F.array(F.struct(_words(F.lower(text)).alias("low")))).alias("__tessera_w"))
    low = F.col("__tessera_w.low")
    phrase = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.array_contains(low, w) for w in p]) for p, _ in PHRASES])
    worth = phrase | F.arrays_overlap(low, _strings(prefix_words(order)))
    exact = F.when(worth, _words(F.translate(text, UPPER, UPPER.lower()))).otherwise(F.array().cast("array<string>"))
    two = one.select(*own, F.explode(F.array(F.struct(F.size(low).alias("n"), exact.alias("low")))).alias("__tessera_w"))
    words, some = F.col("__tessera_w.low"), F.size("__tessera_w.low") > 0
    held = F.arrays_overlap(words, _strings(prefix_words(order)))
    found = F.struct(F.col("__tessera_w.n").alias("n"), F.when(some, _base(words)).otherwise(no_base).alias("base"), F.when(some & held, _matches(words, order)).otherwise(no_match).alias("more"))
    three = two.select(*own, F.explode(F.array(found)).alias("__tessera_f"))
    base_labels = F.transform("__tessera_f.base", lambda x: x["label"])
    labels = F.concat(base_labels, F.transform("__tessera_f.more", lambda x: x["label"]))
    places = F.transform("__tessera_f.base", lambda x: x["start"].cast("long"))
    share = F.coalesce(F.array_max(F.transform("__tessera_f.more", lambda x: x["share"])), F.lit(0.0))
    return three.select(
        *own,
        F.col("__tessera_f.n").cast("long").alias("n_words"),
        F.size("__tessera_f.base").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("labels"),
        F.when(F.size("__tessera_f.base") > 0, F.lit(1.0)).otherwise(share).alias("score"),
    )
