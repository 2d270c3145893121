"""Quality rules with adaptive thresholds, in DataFrame functions alone.

Each document gets its measures within its own row; nothing is shuffled for them. Quantile sketches of the measures
per language and source (approximate percentiles, merged from the partial sketches of the tasks) give
each group its own fences, which are joined to the documents and decide what passes. Groups of few documents lean on the sketch of all.

A count (symbols, later copies of lines, repeated words) is fenced by the highest share that is ordinary in the group: the highest of the sketch's
upper quantiles that is no leap from the median, a leap being more than ERRORS standard errors of such a count in a document of the group's typical length.
A document may have as many as that share gives in its own length, and ERRORS standard errors more; where the share is zero, the error is that of a single
event. So a group with much junk takes a lower quantile, and one whose clean documents repeat themselves a higher share. The
mean word length is fenced on both sides, SPREAD quartile distances from the median.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .pii import let

BLANKS, SYMBOLS = r"[\x20\x09-\x0D]+", r"[^#*$%&|<>]+"
BLANK_CHARS = " \t\n\x0b\f\r"
LEAST_WORDS, MOST_REPEATED = 50, 50
ACCURACY = 1000
#: SPREAD and ERRORS as above. A group's quantiles count as its documents do, those of all documents as LEAN documents.
SPREAD, ERRORS, LEAN = 8.0, 4.0, 50
#: What a share is a share of, and how many things an event brings: a repeat is two windows of three words.
SHARES = {"symbol_ratio": ("n_words", 1), "dup_line_ratio": ("n_lines", 1), "repeat_ratio": ("n_words", 6)}
BOTH_SIDES = ["word_length"]
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeated(words: Column, n: Column) -> Column:
    """Words in 3-word windows found at least twice. Windows are compared by hash first; only a document in which
    two hashes agree has its windows sorted, by hash and then by their words, so equal hashes alone never count."""

    def word(i: Column, k: int) -> Column:
        return F.get(words, i + k)

    places = F.sequence(F.lit(0), n - 3)
    hashes = F.transform(places, lambda i: F.xxhash64(word(i, 0), word(i, 1), word(i, 2)))

    def windows(hs: Column) -> Column:
        return F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), F.concat_ws(" ", word(i, 0), word(i, 1), word(i, 2)).alias("w"), i.alias("i"))))

    def same(ws: Column, k: Column, j: Column) -> Column:
        return F.coalesce((F.get(ws, k)["h"] == F.get(ws, j)["h"]) & (F.get(ws, k)["w"] == F.get(ws, j)["w"]), F.lit(False))

    def covered(ws: Column) -> Column:
        own = F.filter(F.transform(ws, lambda x, k: F.when(same(ws, k, k - 1) | same(ws, k, k + 1), x["i"])), lambda x: x.isNotNull())
        start = F.struct(F.lit(0).alias("sum"), F.lit(-3).alias("last"))
        return F.aggregate(F.sort_array(own), start, lambda a, x: F.struct((a["sum"] + F.least(F.lit(3), x - a["last"])).alias("sum"), x.alias("last")))["sum"]

    exact = let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) < n - 2, let(windows(hs), covered)).otherwise(F.lit(0)))
    return F.when(n < 3, F.lit(0)).otherwise(exact)


def with_measures(docs: DataFrame, text_col: str = "text", name: str = "measures") -> DataFrame:
    """docs with a struct column `name`, in place of one that docs may have: the MEASURES, n_lines (lines with a word) and base_failed. Null texts count as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.btrim(text, F.lit(BLANK_CHARS))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANKS, -1))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANK_CHARS)) != "")
    # A generator row keeps the split words from being computed once per use.
    one = docs.select("*", F.explode(F.array(F.struct(words.alias("words"), lines.alias("lines")))).alias("__tessera_split"))
    w, n = F.col("__tessera_split.words"), F.size("__tessera_split.words")
    got = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("__tessera_split.lines") - F.size(F.array_distinct("__tessera_split.lines"))).cast("long").alias("n_dup_lines"),
        _repeated(w, n).cast("long").alias("n_repeat_words"),
        F.size("__tessera_split.lines").cast("long").alias("n_lines"),
    )
    own = [c for c in docs.columns if c != name]
    out = one.select(*own, F.explode(F.array(got)).alias("__tessera_m"))
    failed = (F.col("__tessera_m.n_words") < LEAST_WORDS) | (100 * F.col("__tessera_m.n_repeat_words") > MOST_REPEATED * F.col("__tessera_m.n_words"))
    return out.select(*own, F.struct("__tessera_m.*", failed.alias("base_failed")).alias(name))


def _ratios(m: str = "measures") -> dict[str, Column]:
    n = F.greatest(F.col(f"{m}.n_words"), F.lit(1))
    return {
        "symbol_ratio": F.col(f"{m}.n_symbols") / n,
        "dup_line_ratio": F.col(f"{m}.n_dup_lines") / F.greatest(F.col(f"{m}.n_lines"), F.lit(1)),
        "repeat_ratio": F.col(f"{m}.n_repeat_words") / n,
        "word_length": F.col(f"{m}.word_chars") / n,
    }


LEVELS = [0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
#: Places in LEVELS of the median and of those that may be a group's highest ordinary share, in rising order.
MEDIAN, UPPER = 1, (3, 4, 5)


def thresholds(measured: DataFrame, group: tuple[str, ...] = ("lang", "source"), name: str = "measures") -> DataFrame:
    """The fences of each group, from all its documents; null group values are a group of their own."""
    things = sorted({t for t, _ in SHARES.values()})
    sketches = [F.percentile_approx(v, LEVELS, ACCURACY).alias(k) for k, v in _ratios(name).items()]
    sketches += [F.percentile_approx(F.col(f"{name}.{t}"), 0.5, ACCURACY).alias(t) for t in things]
    per = measured.groupBy(*[F.col(g).alias(f"__tessera_{g}") for g in group]).agg(F.count("*").alias("n"), *sketches)
    every = measured.agg(*sketches)
    every = every.select(*[F.col(c).alias(f"all_{c}") for c in every.columns])
    both = per.crossJoin(F.broadcast(every))  # one row

    def level(k: str, i: int | None = None) -> Column:
        own, all_ = (F.col(k), F.col(f"all_{k}")) if i is None else (F.col(k)[i], F.col(f"all_{k}")[i])
        return (F.col("n") * own + LEAN * all_) / (F.col("n") + LEAN)

    fences = []
    for k in _ratios(name):
        low, middle, high = (level(k, i) for i in range(3))
        if k in SHARES:
            thing, size = SHARES[k]
            ordinary = middle
            for i in UPPER:
                typical = level(thing) / size
                ordinary = F.when((level(k, i) - middle) * typical <= ERRORS * F.sqrt(F.greatest(level(k, i) * typical, F.lit(1.0))), level(k, i)).otherwise(ordinary)
            fences.append(ordinary.alias(f"__tessera_ordinary_{k}"))
        else:
            fences.append((middle + SPREAD * (high - middle)).alias(f"__tessera_most_{k}"))
        if k in BOTH_SIDES:
            fences.append((middle - SPREAD * (middle - low)).alias(f"__tessera_least_{k}"))
    return both.select(*[f"__tessera_{g}" for g in group], *fences)


def with_verdicts(measured: DataFrame, fences: DataFrame, group: tuple[str, ...] = ("lang", "source"), name: str = "measures", verdict: str = "kept") -> DataFrame:
    """measured with a boolean column `verdict`."""
    on = None
    for g in group:
        same = measured[g].eqNullSafe(fences[f"__tessera_{g}"])
        on = same if on is None else on & same
    base = F.col(f"{name}.base_failed")
    passes = ~base
    for k, v in _ratios(name).items():
        if k in SHARES:
            thing, size = SHARES[k]
            events = F.greatest(F.col(f"{name}.{thing}"), F.lit(1)) / size
            usual = F.col(f"__tessera_ordinary_{k}") * events
            passes = passes & (v * events <= usual + ERRORS * F.sqrt(F.greatest(usual, F.lit(1.0))))
        else:
            passes = passes & (v <= F.col(f"__tessera_most_{k}"))
        if k in BOTH_SIDES:
            passes = passes & (v >= F.col(f"__tessera_least_{k}"))
    return measured.join(fences, on, "left").select(*[measured[c] for c in measured.columns], F.coalesce(passes, ~base).alias(verdict))


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One row per row of docs: the id, the measures, base_failed and kept. Repeated rows and null ids are judged row by row; an empty table gives no rows."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *group)
    measured = materialize(with_measures(rows, "_text").drop("_text"), "measures")
    judged = with_verdicts(measured, thresholds(measured, group), group)
    return judged.select(F.col("_id").alias(id_col), *[f"measures.{m}" for m in MEASURES], "measures.base_failed", "kept")


def passing(docs: DataFrame, text_col: str = "text", group: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The rows of docs that are kept, with their own columns. Repeated rows and null ids are judged row by row, null and empty texts
    fail a base rule, and an empty table stays empty. Texts are measured once, written with their measures and never shuffled; those
    that fail a base rule keep their measures alone."""
    name, verdict = "__tessera_measures", "__tessera_kept"
    own = with_measures(docs, text_col, name)
    failed = F.col(f"{name}.base_failed")
    rest = [F.when(~failed, F.col(c)).alias(c) if c not in group else F.col(c) for c in docs.columns]
    measured = materialize(own.select(*rest, name), "measured")
    fences = materialize(thresholds(measured, group, name), "fences")
    judged = with_verdicts(measured, fences, group, name, verdict)
    return judged.where(verdict).select(*docs.columns)
