"""Alignment of tokenizers and packing by powers of two against brute force with the plainly loaded libraries."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from tessera.llm import alignment, binary_packing, queries, tokens, words

ODD = [None, "", " ", "\n", "a", "  two  blanks ", "a\r\nb\r\n\r\n c;\r", "▁ is a piece's space", "tail \t\n", "<|endoftext|> and <s> and <0x0A>", "x" * 5000, "no break　space \x85", "é́ ≮ ͏ İΣς ǅ 日本語 😀 ​", "it's we'll 'tis ''s", "back\\slash", "12 345 6,7.8", "\x00\x1c\x1f"]


def brute_tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def brute_alignment(texts):
    """Groups and links of each text, tokens one by one."""
    a, b = brute_tokenizers()
    byte = alignment.letters_of_bytes()
    names = {i: x for x, i in a.get_vocab().items()}
    bytes_of = [lambda i: bytes(byte[c] for c in names[i]), lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()]
    out = []
    for text in texts:
        ids = [a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)] if text else [[], []]
        parts = [[f(i) for i in x] for f, x in zip(bytes_of, ids)]
        if not text or any(b"".join(x) != f" {text}".encode() for x in parts):
            out.append((0, 0, [], []))
            continue
        ends = [{} for _ in parts]
        for e, x in zip(ends, parts):
            n = 0
            for k, y in enumerate(x):
                n += len(y)
                e[n] = k
        groups, links, lo = [], [], [0, 0]
        for place in sorted(set(ends[0]) & set(ends[1])):
            hi = [e[place] + 1 for e in ends]
            groups.append("|".join(",".join(map(str, x[p:q])) for x, p, q in zip(ids, lo, hi)))
            links.append((ids[0][hi[0] - 1], ids[1][hi[1] - 1]))
            lo = hi
        out.append((len(ids[0]), len(ids[1]), groups, links))
    return out


def alignment_rows(texts):
    got = brute_alignment(texts)
    counts = Counter(x for g in got for x in g[3])
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for n_a, n_b, groups, links in got]


def odd_texts(n, seed):
    rng = random.Random(seed)
    letters = [*"abcXYZ019 '.,!?-\n\t\r_<>|;)}{\\", *"éßÀ×÷ÿ日本̸́   \u0085\x1c​　\x00ǅİΣσς😀", "'s", "'ll", "<|endoftext|>", "<s>", "  \n", "▁"]
    return ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    pool = ["".join(rng.choice(list("abcdeßñ"), rng.integers(1, 9))) for _ in range(200)]
    texts = [*ODD, *odd_texts(60, 2), *[" ".join(rng.choice(pool, rng.integers(1, 400))) for _ in range(60)], " ".join(rng.choice(pool, 30_000)), *["of the same text"] * 40]
    rows = [(i if i % 9 else i // 2, x, "en", "extra", i) for i, x in enumerate(texts)]  # some ids twice
    rows.append((None, "without an id", None, None, 1))
    top = tmp_path_factory.mktemp("aligned")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, row_key string, band int").repartition(6).write.parquet(f"{top}/documents.parquet")
    return str(top), [(r[0], r[1]) for r in rows]


def test_alignment(spark, folder):
    top, rows = folder
    want = Counter((i, *x) for (i, _), x in zip(rows, alignment_rows([x for _, x in rows]), strict=True))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    df = queries.QUERIES["op11_alignment"](spark, top)
    assert df.columns == names
    assert Counter(tuple(r) for r in df.collect()) == want


def test_alignment_in_many_tasks_and_salts(spark, folder, monkeypatch):
    top, rows = folder
    want = Counter((i, *x) for (i, _), x in zip(rows, alignment_rows([x for _, x in rows]), strict=True))
    monkeypatch.setattr(alignment, "TASK_BYTES", 2000)
    assert Counter(tuple(r) for r in alignment.align(spark.read.parquet(f"{top}/documents.parquet").repartition(11)).collect()) == want


def test_chunks_align_as_whole_texts():
    al = alignment.aligner()
    for text, want in zip(texts := odd_texts(3000, 7), brute_alignment(texts), strict=True):
        (e,) = al.entries([al.chunks(text)])
        sums = al.table[e]
        if (sums[:, 0] < 0).any():
            assert want[:2] == (0, 0)
        else:
            assert (sums[:, 0].sum(), sums[:, 1].sum(), ";".join(map(al.strings.__getitem__, e))) == (*want[:2], ";".join(want[2]))


def test_aligner_forgets(monkeypatch):
    monkeypatch.setattr(alignment, "KEPT", 5)
    al = alignment.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    for text, want in zip(texts := ["one two three four", "five six seven eight", "one two " + "y" * 100, "one two"], brute_alignment(texts), strict=True):
        (e,) = al.entries([al.chunks(text)])
        assert ";".join(map(al.strings.__getitem__, e)) == ";".join(want[2])
    assert not any(len(x) > alignment.LONGEST for x in al.known)


def word_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_words_encode_as_the_library():
    import pyarrow as pa

    texts = [*ODD, *odd_texts(5000, 11)]
    for tail in (None, 2):
        ids, n = words.word_encoder().encode(pa.array(texts), tail)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [[*x, *([2] if tail else [])] for x in word_ids(texts)]


def byte_ids(texts):
    a, _ = brute_tokenizers()
    return [a.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_bytes_encode_as_the_library():
    import pyarrow as pa

    texts = [*ODD, *odd_texts(5000, 12), "a.b c, d.\ne f's (g) -- h\n\ni", "a\x01b c", "　 　b 　c", "ж. и, 中 文。 x"]
    for own in (texts, [x for x in texts if "\x01" not in (x or "")]):
        ids, n = tokens.encoder().encode(pa.array(own), 2)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [[*x, 2] for x in byte_ids(own)]


def test_slices_hold_whole_texts():
    import pyarrow as pa

    texts = pa.array(["a" * n if n else None for n in (0, 5, 300, 1, 0, 99, 1000)])
    got = tokens.slices(texts, 100)
    assert [i for lo, hi in got for i in range(lo, hi)] == list(range(7)) and tokens.slices(texts.slice(0, 0)) == []
    assert all(hi > lo for lo, hi in got) and len(got) == 4


@pytest.mark.parametrize(("kind", "file", "want"), [(words.WordEncoder, "word_bpe_49k.json", "word_ids"), (tokens.Encoder, "byte_bpe_50k.json", "byte_ids")])
def test_chunks_are_forgotten(monkeypatch, kind, file, want):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "KEPT", 3)
    encoder = kind(public_tokenizers.path(file))
    for texts in (["one two three four five"], ["one " + "x" * 500, "two, three."], ["one two"]):
        assert encoder.encode(pa.array(texts))[0].tolist() == sum(globals()[want](texts), [])
    assert not any(len(x) > tokens.LONGEST for x in encoder.known)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4095, 4096, 4097, 12_345])
def test_lengths(n):
    got = binary_packing.lengths(n)
    assert sum(got) == n and got == sorted(got, reverse=True) and all(x & (x - 1) == 0 and x <= 4096 for x in got)
    assert max(Counter(x for x in got if x < 4096).values(), default=0) <= 1
    with pytest.raises(ValueError):
        binary_packing.lengths(5, 6)


def test_binary_packing(spark, folder):
    top, rows = folder
    got = queries.QUERIES["op12_binary_packing"](spark, top)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    got = [tuple(r) for r in got.collect()]
    want = Counter()
    for (i, _), ids in zip(rows, word_ids([x for _, x in rows]), strict=True):
        ids, start = [*ids, 2], 0
        for n in binary_packing.lengths(len(ids)):
            want[i, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()), len(ids)] += 1
            start += n
    assert Counter(x[:5] for x in got) == want
    assert len({x[5] for x in got}) == len(got) and {x[6] for x in got} == {0}


def test_sequences_of_one_length_are_read_alone(spark, folder, tmp_path):
    top, rows = folder
    path = f"{tmp_path}/sequences"
    got = binary_packing.decompose(spark.read.parquet(f"{top}/documents.parquet"), path=path)
    sizes = {r["length"]: (r["n_sequences"], r["n_tokens"]) for r in binary_packing.bucket_sizes(got).collect()}
    assert sizes[1024][0] == spark.read.parquet(f"{path}/length=1024").count() and all(n * k == t for k, (n, t) in sizes.items())
    assert sum(t for _, t in sizes.values()) == sum(len(x) + 1 for x in word_ids([x for _, x in rows]))


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("op11_alignment", "op12_binary_packing"):
        assert queries.QUERIES[name](spark, str(tmp_path)).collect() == []
