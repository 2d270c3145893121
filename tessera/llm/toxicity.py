"""Toxicity scores from subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams (with its ends marked) and of the word itself, all
kept in hashed buckets; a bag's vector is the mean over its words with BLANK blank words, so that a few words aren't a verdict. A few
bad words in a long text hardly move the mean of all, so a document is scored by its highest bag of WINDOW neighbouring words, at every
place. The embeddings and the softmax on top are trained together by Adam, on a bounded sample of the labelled rows: first on bags of
whole texts (each word weighted by the root of its number), which tells words apart from any start, then on the very bags that are scored,
each document by the bag that is its highest so far. As everything is linear up to the softmax, a bucket comes down to one number
for scoring, and an unseen misspelling shares most of a known word's n-grams; buckets that no sample word has count as nothing.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS, DIM, SHORTEST, LONGEST = 1 << 19, 4, 3, 5
#: The sample: at most so many labelled documents of either class, each of at most SAMPLE_CHARS characters; longer ones aren't learned from.
SAMPLE, SAMPLE_CHARS = {0: 3000, 1: 1500}, 20_000
EPOCHS, BAG_EPOCHS, STEP, DECAY, SCALE, BLANK, WINDOW, HELD, FOLD, SEED = 40, 40, 0.01, 1.0, 300.0, 5.0, 2, 5, 5, 3
WORD = re.compile(r"[^\W_]+")
KEPT = 400_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


@lru_cache(maxsize=1 << 16)
def grams(word: str) -> tuple[int, ...]:
    """Buckets of a word's n-grams; of a very long word those of its parts."""
    raw = f"<{word}>"
    found = {raw} | {raw[i : i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(len(raw) - n + 1)}
    return tuple(sorted(zlib.crc32(x.encode()) % BUCKETS for x in found))


def _gradients(state, bags, sizes, flat, cuts, lens, labels):
    """Gradients of the mean cross-entropy; bags: (document, word, weight), flat and cuts: the words' buckets."""
    emb, top, bias = state
    doc, word, times = bags
    n_words = np.diff(np.r_[cuts, len(flat)])
    vec = np.stack([np.add.reduceat(emb[flat, d], cuts) / lens for d in range(DIM)], axis=1)
    bag = np.stack([np.bincount(doc, times * vec[word, d], len(sizes)) for d in range(DIM)], axis=1) / sizes[:, None]
    logits = SCALE * bag @ top + bias
    p = np.exp(logits - logits.max(1, keepdims=True))
    err = p / p.sum(1, keepdims=True)
    err[np.arange(len(labels)), labels] -= 1
    err /= len(labels)
    g_bag = SCALE * err @ top.T / sizes[:, None]
    g_emb = np.empty_like(emb)
    for d in range(DIM):
        g_vec = np.bincount(word, times * g_bag[doc, d], len(lens)) / lens
        g_emb[:, d] = np.bincount(flat, np.repeat(g_vec, n_words), len(emb))
    return g_emb, SCALE * bag.T @ err, err.sum(0)


def _bags(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, word, weight, size) of whole texts."""
    doc, word, times, sizes = [], [], [], []
    for i, own in enumerate(texts):
        w, n = np.unique(own, return_counts=True)
        doc.append(np.full(len(w), i))
        word.append(w)
        times.append(np.sqrt(n))
        sizes.append(times[-1].sum() + BLANK)
    return np.concatenate(doc), np.concatenate(word), np.concatenate(times), np.array(sizes)


def _highest_bags(texts: list[np.ndarray], of_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same of the bag of neighbouring words that is each text's highest."""
    doc, word, sizes = [], [], []
    for i, own in enumerate(texts):
        n = min(WINDOW, len(own))
        sizes.append(n + BLANK)
        if n:
            v = of_word[own]
            at = int(sum(v[k : len(v) - n + 1 + k] for k in range(n)).argmax())
            doc += [i] * n
            word += own[at : at + n].tolist()
    return np.array(doc, int), np.array(word, int), np.ones(len(doc)), np.array(sizes)


def highest(values: np.ndarray) -> float:
    """The highest mean of WINDOW neighbouring words, blank words counted in; 0 without words."""
    if not len(values):
        return 0.0
    n = min(WINDOW, len(values))
    sums = sum(values[i : len(values) - n + 1 + i] for i in range(n))
    return float(sums.max() / (n + BLANK))


def train(texts: list[str], labels: list[int], weights: tuple[float, float] = (1.0, 1.0)) -> tuple[np.ndarray, float]:
    """(one number per bucket, bias): a text's logit is the bias and highest() of its words' values, the means of their buckets.

    Every FOLD-th text isn't trained on; the cut with the best F1 there becomes a score of one half. weights: how many
    documents stand behind each one of either class."""
    y = np.array(labels)
    held = np.arange(len(y)) % FOLD == 0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2 or not any(map(words_of, texts)):
        share = (y.sum() + 0.5) / (len(y) + 1)
        return np.zeros(BUCKETS), float(np.log(share / (1 - share)))
    known: dict[str, int] = {}
    own = [np.array([known.setdefault(w, len(known)) for w in words_of(x)], int) for x, h in zip(texts, held, strict=True) if not h]
    held_buckets, n_buckets = array("i"), []
    for w in known:
        made = grams.__wrapped__(w)
        held_buckets.extend(made)
        n_buckets.append(len(made))
    used, flat = np.unique(np.frombuffer(held_buckets, np.int32), return_inverse=True)  # only buckets that occur are learnt
    lens = np.array(n_buckets, float)
    cuts = np.r_[0, np.cumsum(lens)[:-1]].astype(int)
    rng = np.random.default_rng(SEED)
    state = [rng.normal(0, 0.1, (len(used), DIM)), rng.normal(0, 0.3, (DIM, 2)), np.zeros(2)]
    first, second = [np.zeros_like(x) for x in state], [np.zeros_like(x) for x in state]

    def of_words() -> np.ndarray:
        value = SCALE * state[0] @ (state[1][:, 1] - state[1][:, 0])
        return np.add.reduceat(value[flat], cuts) / lens

    whole = _bags(own)
    for t in range(1, EPOCHS + BAG_EPOCHS + 1):
        *bags, sizes = whole if t <= EPOCHS else _highest_bags(own, of_words())
        words, place = np.unique(bags[1], return_inverse=True)  # only the words in the bags are looked at
        n = lens[words].astype(int)
        ends = np.cumsum(n)
        own_flat = flat[np.repeat(cuts[words] - ends + n, n) + np.arange(n.sum())]
        for k, g in enumerate(_gradients(state, (bags[0], place, bags[2]), sizes, own_flat, ends - n, lens[words], y[~held])):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            shrunk = state[k] * (1 - STEP * DECAY) if k < 2 else state[k]
            state[k] = shrunk - STEP * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)
    value = np.zeros(BUCKETS)
    value[used] = SCALE * state[0] @ (state[1][:, 1] - state[1][:, 0])
    margin = np.array([highest(word_values(value, words_of(x))) for x, h in zip(texts, held, strict=True) if h])
    order = np.argsort(-margin)
    hit = y[held][order]
    behind = np.where(hit == 1, weights[1], weights[0])
    f1 = 2 * np.cumsum(behind * hit) / (np.cumsum(behind) + (behind * hit).sum())
    i = int(f1.argmax())
    cut = float(margin[order[i]] + margin[order[min(i + 1, len(hit) - 1)]]) / 2
    return value, -cut


def word_values(weights: np.ndarray, words: list[str]) -> np.ndarray:
    """The mean of each word's buckets."""
    return np.array([weights[list(grams(w) if len(w) < 64 else grams.__wrapped__(w))].mean() for w in words], float)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, float]:
    """A model from the labelled rows that aren't held out; ids, languages and sources are no inputs of it."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y"))
    total = {r["_y"]: r["n"] for r in usable.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    parts = [usable.where(F.col("_y") == v).orderBy(F.xxhash64("_id"), "_id").limit(n) for v, n in SAMPLE.items()]
    chosen = parts[0].union(parts[1])
    own = docs.where(F.length(text_col) <= SAMPLE_CHARS).select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    one = own.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).groupBy("_id").agg(F.min("_text").alias("_text"), F.max("_y").alias("_y"))
    rows = one.collect()  # one row per id of the sample, however often an id is repeated
    rows.sort(key=lambda r: (zlib.crc32(str(r["_id"]).encode()), r["_text"]))
    labels_ = [int(r["_y"]) for r in rows]
    behind = [total.get(v, 0) / max(1, labels_.count(v)) for v in (0, 1)]
    return train([r["_text"] for r in rows], labels_, (behind[0], behind[1]))


def scorer(weights: np.ndarray, bias: float):
    """A column function from a text to a score between 0 and 1; null counts as empty, whose score is the bias alone."""
    weights = weights.astype(np.float32)

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        known: dict[str, float] = _known.setdefault(hash(weights.tobytes()), {})
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            words = words_of(text)
            values = list(map(known.get, words))
            for j in [j for j, x in enumerate(values) if x is None]:
                w = words[j]
                values[j] = known[w] = float(weights[list(grams.__wrapped__(w))].mean())
            if len(known) > KEPT:
                known.clear()
            out[i] = bias + highest(np.array(values, float))
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -60, 60))))

    return lambda text: score(F.coalesce(text, F.lit("")))


_known: dict[int, dict[str, float]] = {}


def scored(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text") -> DataFrame:
    """docs with a column `score`, in place of one that docs may have. Null and empty texts take the score of no words, repeated rows get equal
    scores, texts and words of any length are read as a whole, ids aren't read, and an empty table stays empty."""
    return docs.withColumn("score", scorer(*model)(F.col(text_col)))
