"""Operators on texts of hundreds of thousands of characters against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from tessera.llm import licenses, queries, tokens
from tests.llm.test_operators import fingerprint, measures, removed


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(21)
    words = ["".join(rng.choice(list("abcdefgéß"), rng.integers(2, 10))) for _ in range(20_000)]
    long = " ".join(rng.choice(words, 40_000))
    lines = "\n".join(" ".join(rng.choice(words, 12)) for _ in range(3000))
    return {1: long, 2: lines + "\n" + long[1000:60_000] + " all rights reserved", 3: "y" * 200_000, 4: long + " tail", 5: "short text", 6: ("a,b. " * 30_000) + "end"}


@pytest.fixture(scope="module")
def folder(spark, texts, tmp_path_factory):
    top = tmp_path_factory.mktemp("long")
    docs = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(2).write.parquet(f"{top}/documents.parquet")
    return str(top)


@pytest.fixture(scope="module")
def ids(texts):
    lib = tokens.encoder().library
    return {i: [*lib.encode(x, add_special_tokens=False).ids, 2] for i, x in texts.items()}


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def rows(spark, folder, name):
    return queries.QUERIES[name](spark, folder).collect()


def test_token_files_and_packing(spark, folder, ids):
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in rows(spark, folder, "op1_token_shards")}
    assert got == {i: (len(x), crc(x)) for i, x in ids.items()}
    pieces = {}
    for r in rows(spark, folder, "op9_best_two_fit"):
        pieces.setdefault(r["doc_id"], []).append(r)
        assert r["length"] <= 1024 and r["ids_crc32"] == crc(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]])
    assert {i: sum(r["length"] for r in p) for i, p in pieces.items()} == {i: len(x) for i, x in ids.items()}


def test_byte_pairs(spark, folder, texts):
    got = {r["doc_id"]: r for r in rows(spark, folder, "op2_byte_bpe")}
    lib = tokens.encoder().library
    for i, x in texts.items():
        own = lib.encode(x, add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(own) and got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(x.encode()).hexdigest()


def test_fingerprints_and_measures(spark, folder, texts):
    got = {r["doc_id"]: r for r in rows(spark, folder, "op3_simhash")}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{fingerprint(x):016x}" for i, x in texts.items()}
    assert got[4]["component_id"] == 1
    for r in rows(spark, folder, "op5_quality"):
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == measures(texts[r["doc_id"]])


def test_licenses_and_repeats(spark, folder, texts):
    for r in rows(spark, folder, "op6_licenses"):
        x = texts[r["doc_id"]]
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x.translate(str.maketrans(licenses.UPPER, licenses.UPPER.lower())))
        at = [j for j in range(len(w)) if w[j : j + 3] == ["all", "rights", "reserved"]]
        assert r["n_words"] == len(w) and r["n_base"] == len(at) and r["first_word"] == (at[0] if at else None)
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(spark, folder, "op10_suffix_dedup")]
    assert sorted(got) == removed(sorted(texts.items()))
