"""Personal data: base patterns, and candidates judged by gradient-boosted trees, in DataFrame functions alone.

Base spans come from four fixed patterns with their checks. High-recall generators propose further spans, which may
overlap; each is described by its format and its context, boosted trees give it a score and the threshold
calibrated for its kind decides. The trees are trained by numpy on the driver, on generated examples, and become a SQL
expression; the documents' side runs in the JVM within each row, nothing is shuffled.
"""

from __future__ import annotations

import random
import re
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base kinds in the order of their output. Written so that each place is tried once: runs are possessive, and
#: a run is only entered at its start or where the last match ended, which finds the same leftmost matches.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Whole runs of 13 to 19 digits; other runs fail their check in any case.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ["email", "ip", "card", "phone"]

#: Generators of candidates: kind, pattern, and what a text must hold for it to be tried. Runs have no upper bound, so that no part of one stays.
GENERATORS = [
    ("secret", r"(?:(?<=[=:]\x20?[\x22']?)|(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9]))[A-Za-z0-9_/+-]{16,}+", r"[A-Za-z0-9_/+-]{16}"),
    ("number", r"(?<![0-9A-Za-z.,+-])\(?[0-9]{2,4}\)?(?:[\x20.-][0-9]{2,4}){2,4}(?![0-9A-Za-z])", r"[0-9]{2}[\x20).-]"),
    ("handle", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9.-]{3,}+", r"[(\[]at[)\]]"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?+(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
    ("ipv6", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){1,7}(?::?[0-9A-Fa-f]{1,4}){1,7}(?![0-9A-Za-z:])", r"[0-9A-Fa-f]:"),
    ("address", r"(?<![0-9A-Za-z])[0-9]{1,5}[A-Za-z]?\x20(?:[A-Z][a-z]+\x20){1,3}(?:Street|Road|Avenue|Lane|Drive|Court|Boulevard|St|Rd|Ave|Ln|Dr|Ct|Blvd)(?![A-Za-z])", r"[0-9][A-Za-z]?\x20[A-Z]"),
]
KEYWORDS = {
    "says_secret": r"(?i)(token|secret|passw|api.?key|bearer|credential|access.?key)",
    "says_number": r"(?i)(phone|tel|call|mobile|ssn|social|fax|whatsapp|passport)",
    "says_other": r"(?i)(isbn|version|figure|table|page|total|sha|commit|hash|id|date|year|time|at|ratio|mac)",
    "says_private": r"(?i)(iban|account|bank|host|server|ping|live|address|home|reside)",
    "delimited": r"[=:]\x20?[\x22']?$",
}
BEFORE, AFTER, CHUNK = 24, 12, 1000
COUNTS = {"digits": r"[^0-9]+", "letters": r"[^A-Za-z]+", "upper": r"[^A-Z]+", "dots": r"[^.]+", "dashes": r"[^-]+", "blanks": r"[^\x20()]+", "colons": r"[^:]+"}
FEATURES = ["kind", "length", *COUNTS, *KEYWORDS, "hex", "distinct", "goes_on"]
HEX, GOES_ON = r"^[0-9a-fA-F]+$", r"^[\x20]?[A-Za-z0-9%]"
ROUNDS, DEPTH, RATE, EXAMPLES, PRECISION = 30, 4, 0.3, 6000, 0.995


# --- arrays and texts within a row ----------------------------------------------------------------------------------


def let(x: Column, f) -> Column:
    """f(x) with x computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def running(xs: Column, join, levels: int = 3) -> Column:
    """What an associative `join` (with 0 as nothing) makes of the elements before each one of an array of ints.

    An array grows by copying, so elements are taken in pieces, and their totals in the same way: n elements cost about
    n ** (1 + 1 / levels) steps, not n ** 2."""
    return let(xs, lambda held: _running(held, join, levels))


def _running(xs: Column, join, levels: int) -> Column:
    none = F.expr("cast(array() as array<int>)")
    if levels == 1:
        start = F.struct(F.lit(0).alias("all"), none.alias("out"))
        return F.aggregate(xs, start, lambda a, x: F.struct(join(a["all"], x).alias("all"), F.concat(a["out"], F.array(a["all"])).alias("out")))["out"]

    def joined(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), join))
        return let(running(totals, join, levels - 1), lambda t: F.flatten(F.zip_with(parts, t, lambda p, s: F.transform(running(p, join, 1), lambda x: join(s, x)))))

    def cut(size: Column) -> Column:
        at = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / size).cast("int"))
        return let(F.transform(at, lambda i: F.slice(xs, i * size + 1, size)), joined)

    return F.when(F.size(xs) == 0, none).otherwise(let(F.ceil(F.pow(F.size(xs).cast("double"), F.lit(1 / levels))).cast("int"), cut))


def _add(a: Column, b: Column) -> Column:
    return a + b


def chunked(text: Column) -> Column:
    """The text in chunks of CHUNK code points, as places far into a long text are found by counting from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def between(chunks: Column, lo: Column, hi: Column) -> Column:
    """The code points from lo up to hi of a chunked text."""
    i, j = F.floor(lo / CHUNK).cast("int"), F.floor((hi - 1) / CHUNK).cast("int")
    first, last = F.get(chunks, i), F.get(chunks, j)
    one = F.substring(first, lo - i * CHUNK + 1, hi - lo)
    many = F.concat(F.substring(first, lo - i * CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(chunks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(last, F.lit(1), hi - j * CHUNK))
    return F.when(hi <= lo, F.lit("")).when(i == j, one).otherwise(many)


# --- base spans -------------------------------------------------------------------------------------------------


def _spans(text: Column, pattern: str, gate: Column) -> Column:
    """Array of (start, end, m) of a pattern's matches, in code points. The gaps between matches are what split() leaves."""
    empty = F.expr("cast(array() as array<struct<start:int,end:int,m:string>>)")
    found = F.when(gate, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.expr("cast(array() as array<string>)"))

    def placed(ms: Column) -> Column:
        steps = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(ms)), ms, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("n"), m.alias("m")))

        def summed(s: Column) -> Column:
            starts = running(F.transform(s, lambda x: x["gap"] + x["n"]), _add)
            return F.zip_with(s, starts, lambda x, a: F.struct((a + x["gap"]).alias("start"), (a + x["gap"] + x["n"]).alias("end"), x["m"].alias("m")))

        return let(steps, summed)

    return let(found, lambda ms: F.when(F.size(ms) > 0, placed(ms)).otherwise(empty))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]+", "")


def _luhn(m: Column) -> Column:
    back = F.split(F.reverse(_digits(m)), "")
    twice = F.transform(back, lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(F.filter(twice, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0


def _small_parts(m: Column) -> Column:
    bare = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(bare, lambda p: (F.length(p) <= 3) & (p.try_cast("int") <= 255))


def base_spans(text: Column) -> dict[str, Column]:
    """Per base kind an array of (start, end, m); text is not null."""
    n = F.length
    return {
        "email": _spans(text, EMAIL, text.contains("@")),
        "ip": F.filter(_spans(text, IP, text.rlike(r"[0-9]\.[0-9]")), lambda x: _small_parts(x["m"])),
        "card": F.filter(_spans(text, CARD, text.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9]")), lambda x: _luhn(x["m"])),
        "phone": F.filter(_spans(text, PHONE, text.contains("+")), lambda x: n(_digits(x["m"])).between(9, 15)),
    }


# --- candidates and trees -----------------------------------------------------------------------------------------


def _examples(n: int, seed: int = 7) -> list[tuple[int, str, str, str, int]]:
    """(kind, span, text before it, text behind it, is it private) made up from formats."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    of = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    word = lambda: of("abcdefghilmnoprstu", r.randint(2, 9))
    name = lambda: word().capitalize()
    lead = lambda: r.choice([f"{word()} {word()} ", f"{word()}, {word()} ", ""])
    tail = lambda: r.choice([f" {word()} {word()}", ". ", ", " + word(), "", "!!", "\n"])
    hexa, mixed = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    big = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    out = []
    for _ in range(n):
        kind, private, after = r.randrange(len(GENERATORS)), r.random() < 0.5, tail()
        if kind == 0 and private:
            key = r.choice(["token", "secret", "password", "api_key", "api key", "Token", "TOKEN", "credential", "access key", "bearer"])
            span = r.choice([of(hexa, r.randint(20, 64)), of(hexa.upper(), r.randint(20, 64)), of(mixed, r.randint(20, 64)), of(mixed, r.choice([128, 240, 600, 5000])), of(hexa, r.choice([128, 240])), r.choice(["AKIA", "ghp_", "sk-"]) + of(mixed, r.randint(16, 40))])
            quote, sign = r.choice(['"', "'", ""]), r.choice([" = ", "=", ": ", ":", " "])
            out.append((0, span, lead() + key + sign + quote, quote + after, 1))
        elif kind == 0:
            span = r.choice([word() + "_" + word() + "_" + word() + "_" + word(), of("abcdefgh", r.randint(16, 40)), digits(r.randint(16, 19)), "//" + word() + word() + "/" + word() + word(), of(hexa, 40), word() + "-" + digits(4) + "-" + word() + "-" + word(), "/" + word() + "/" + word() + digits(2) + "/" + word() + "/" + word()])
            key = r.choice(["name", "http", "value", "path", "commit", "sha", word(), word()])
            out.append((0, span, lead() + key + r.choice([" = ", "=", ": ", ":", " "]), after, 0))
        elif kind == 1 and private:
            span = r.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"{digits(3)}-{digits(2)}-{digits(4)}", f"{digits(2)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}"])
            key = r.choice(["phone ", "call ", "tel: ", "mobile ", "ssn ", "fax ", "phone: ", "SSN: "])
            out.append((1, span, lead() + key, after, 1))
        elif kind == 1:
            span = r.choice([f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}.{digits(2)}.{digits(4)}", f"{digits(3)} {digits(3)} {digits(3)}", f"{digits(2)} {digits(3)} {digits(2)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(3)}", ".".join(digits(r.randint(2, 3)) for _ in range(4)), " ".join(digits(4) for _ in range(4))])
            out.append((1, span, lead() + r.choice(["total ", "date ", "page ", "version ", "isbn ", "", "", ""]), after, 0))
        elif kind == 2 and private:
            out.append((2, f"{word()}.{word()} (at) {word()}.{r.choice(['com', 'org', 'de', 'net'])}", lead(), after, 1))
        elif kind == 2:
            out.append((2, f"{word()} (at) {word()}", lead(), after, 0))
        elif kind == 3 and private:
            body = digits(r.randint(11, 26))
            span = of(big, 2) + digits(2) + r.choice(["", " "]).join(["", *[body[i : i + 4] for i in range(0, len(body), 4)]])
            out.append((3, span, lead() + r.choice(["iban ", "IBAN: ", "account ", "bank account: "]), after, 1))
        elif kind == 3:
            out.append((3, of(big, 2) + digits(2) + of(big, r.choice([8, 12])), lead() + r.choice(["", "version ", "id "]), after, 0))
        elif kind == 4 and private:
            groups = [of(hexa, r.randint(1, 4)) for _ in range(r.choice([8, 8, 6, 5, 4]))]
            gap = r.randint(1, len(groups) - 1)
            span = ":".join(groups) if len(groups) == 8 else ":".join(groups[:gap]) + "::" + ":".join(groups[gap:])
            out.append((4, span, lead() + r.choice(["host ", "from ", "ping ", "server ", "address ", ""]), after, 1))
        elif kind == 4:
            span = r.choice([f"{digits(2)}:{digits(2)}", f"{digits(2)}:{digits(2)}:{digits(2)}", f"{digits(1)}:{digits(2)}", ":".join(of(hexa, 2) for _ in range(6))])
            out.append((4, span, lead() + r.choice(["at ", "time ", "ratio ", "mac ", ""]), after, 0))
        elif private:
            out.append((5, f"{r.randint(1, 9999)} {name()} {r.choice(['Street', 'Road', 'Avenue', 'St', 'Lane', 'Drive'])}", lead() + r.choice(["at ", "lives at ", "address ", "home: ", ""]), after, 1))
        else:
            out.append((5, f"{r.randint(1, 9999)} {name()} {name()} {r.choice(['Court', 'Drive', 'St', 'Dr'])}", lead() + r.choice(["page ", "year ", "version ", "total ", "table "]), f" {word()}", 0))
    return out


def _row(kind: int, span: str, before: str, after: str) -> list[float]:
    before, after = before[-BEFORE:], after[:AFTER]
    counts = [len(re.sub(p, "", span)) for p in COUNTS.values()]
    return [kind, len(span), *counts, *[float(bool(re.search(p, before))) for p in KEYWORDS.values()], float(bool(re.search(HEX, span))), len(set(span)), float(bool(re.search(GOES_ON, after)))]


def _tree(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int):
    """Nested (feature, cut, left, right); a leaf is a number."""
    g, h = grad.sum(), hess.sum()
    leaf = float(-RATE * g / (h + 1.0))
    if depth == 0 or len(x) < 20:
        return leaf
    best, gain0 = None, g * g / (h + 1.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[:-1] + values[1:])[:: max(1, len(values) // 16)] / 2:
            left = x[:, f] <= cut
            gl, hl = grad[left].sum(), hess[left].sum()
            gain = gl * gl / (hl + 1.0) + (g - gl) ** 2 / (h - hl + 1.0) - gain0
            if best is None or gain > best[0]:
                best = (gain, f, float(cut), left)
    if best is None or best[0] < 1e-6:
        return leaf
    _, f, cut, left = best
    return (f, cut, _tree(x[left], grad[left], hess[left], depth - 1), _tree(x[~left], grad[~left], hess[~left], depth - 1))


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, cut, left, right = tree
    return np.where(x[:, f] <= cut, _apply(left, x), _apply(right, x))


@cache
def model() -> tuple[list, dict[str, float]]:
    """(trees, threshold of the summed score per kind). Thresholds are calibrated on examples that no tree saw: the least
    score at which PRECISION of those above are private."""
    made = _examples(2 * EXAMPLES)
    x = np.array([_row(*m[:4]) for m in made])
    y = np.array([v for *_, v in made], float)
    fit, held = slice(0, EXAMPLES), slice(EXAMPLES, None)
    trees, score = [], np.zeros(EXAMPLES)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        trees.append(_tree(x[fit], p - y[fit], p * (1 - p), DEPTH))
        score = score + _apply(trees[-1], x[fit])
    got, cuts = sum(_apply(t, x[held]) for t in trees), {}
    for i, (kind, *_) in enumerate(GENERATORS):
        own = x[held][:, 0] == i
        order = np.argsort(-got[own])
        true, s = y[held][own][order], got[own][order]
        good = np.flatnonzero(np.cumsum(true) / np.arange(1, len(true) + 1) >= PRECISION)
        cuts[kind] = float(max(s[good[-1]], 0.0)) if len(good) else float("inf")
    return trees, cuts


def _score(features: Column) -> Column:
    """The trees' sum over a struct of the FEATURES."""

    def tree(t) -> Column:
        if not isinstance(t, tuple):
            return F.lit(t)
        f, cut, left, right = t
        return F.when(features[FEATURES[f]] <= cut, tree(left)).otherwise(tree(right))

    total = F.lit(0.0)
    for t in model()[0]:
        total = total + tree(t)
    return total


def candidates(text: Column) -> Column:
    """Array of (kind, start, end) of the candidates that the trees accept."""
    cuts = model()[1]
    none = F.expr("cast(array() as array<struct<i:int,start:int,end:int,m:string>>)")

    def proposed(i: int, pattern: str, gate: str) -> Column:
        return F.transform(_spans(text, pattern, text.rlike(gate)), lambda x: F.struct(F.lit(i).alias("i"), x["start"].alias("start"), x["end"].alias("end"), x["m"].alias("m")))

    def described(known: Column):
        chunks, size = known["chunks"], known["size"]

        def values(m: Column, around: Column, i: Column) -> Column:
            counts = [F.length(F.regexp_replace(m, p, "")).cast("double") for p in COUNTS.values()]
            said = [around["before"].rlike(p).cast("double") for p in KEYWORDS.values()]
            rest = [m.rlike(HEX).cast("double"), F.size(F.array_distinct(F.filter(F.split(m, ""), lambda c: c != ""))).cast("double"), around["after"].rlike(GOES_ON).cast("double")]
            all_ = [i.cast("double"), F.length(m).cast("double"), *counts, *said, *rest]
            return F.struct(*[v.alias(n) for n, v in zip(FEATURES, all_, strict=True)])

        def one(x: Column) -> Column:
            around = F.struct(between(chunks, F.greatest(x["start"] - BEFORE, F.lit(0)), x["start"]).alias("before"), between(chunks, x["end"], F.least(x["end"] + AFTER, size)).alias("after"))
            return F.struct(x["i"].alias("i"), x["start"].alias("start"), x["end"].alias("end"), let(around, lambda a: values(x["m"], a, x["i"])).alias("f"))

        return one

    def judged(found: Column) -> Column:
        rows = let(F.struct(chunked(text).alias("chunks"), F.length(text).alias("size")), lambda known: F.transform(found, described(known)))
        kinds, least = F.array(*[F.lit(k) for k, *_ in GENERATORS]), F.array(*[F.lit(cuts[k]) for k, *_ in GENERATORS])
        good = F.filter(rows, lambda x: _score(x["f"]) >= F.get(least, x["i"]))
        return F.transform(good, lambda x: F.struct(F.get(kinds, x["i"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    found = F.concat(none, *[proposed(i, p, gate) for i, (_, p, gate) in enumerate(GENERATORS)])
    return let(found, lambda c: F.when(F.size(c) > 0, judged(c)).otherwise(F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)")))


def with_spans(docs: DataFrame, text_col: str = "text", names: tuple[str, str] = ("base_spans", "extra_spans")) -> DataFrame:
    """docs with two array columns of (kind, start, end), in place of any of their names: base_spans, by kind as listed and start, and extra_spans, the
    accepted candidates, by kind as listed and start; candidates of different kinds may overlap each other and base spans. Offsets are
    code points, the end exclusive. A null or empty text has no spans; a very long one costs little more than its length. Repeated
    rows are marked row by row; an empty table stays empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def named(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    base = F.concat(*[named(k, v) for k, v in base_spans(text).items()])
    one = docs.select("*", F.explode(F.array(F.struct(base.alias("b"), candidates(text).alias("c")))).alias("__tessera_s"))
    own = [c for c in docs.columns if c not in names]
    return one.select(*own, F.col("__tessera_s.b").alias(names[0]), F.col("__tessera_s.c").alias(names[1]))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of text_col replaced with its kind in brackets, overlapping spans as one under the kind that
    starts first. Rows without a span, null and empty texts among them, stay as they are, repeated rows are treated alike, and an
    empty table stays empty."""
    names = ("__tessera_base", "__tessera_extra")
    marked = with_spans(docs, text_col, names)
    spans = F.array_sort(F.transform(F.concat(*names), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    text = F.col(text_col)

    def done(s: Column, chunks: Column) -> Column:
        reached = running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
        parts = F.zip_with(s, reached, lambda x, a: F.when(x["start"] < a, F.lit("")).otherwise(F.concat(between(chunks, a, x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))))
        rest = F.struct(F.array_max(F.transform(s, lambda x: x["end"])).alias("end"), F.length(text).alias("size"))
        return F.concat(F.array_join(parts, ""), let(rest, lambda r: between(chunks, r["end"], r["size"])))

    new = let(spans, lambda s: F.when(F.size(s) > 0, let(chunked(text), lambda chunks: done(s, chunks))).otherwise(text))
    return marked.select(*[new.alias(c) if c == text_col else F.col(c) for c in docs.columns])
