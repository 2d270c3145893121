"""SQL of the operators' queries, where SQL can state them.

Not stated: op1, op2, op9, op11 and op12 (merges of a vocabulary), op3 (XXH64 with a seed), op7 (a trained model), op4's spans beyond the base ones
(lookarounds and trees) and with these the pipeline. Tests compare them with the public libraries or with brute force.
"""

from __future__ import annotations

from . import licenses, quality

WORDS = r"[^\x20\x09-\x0D]+"

#: Kinds in their order, with the patterns of the contract.
KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def _kind(i: int, kind: str, pattern: str) -> str:
    good = {
        "email": "true",
        "ip": "list_max(list_transform(string_split(m, '.'), lambda x: CASE WHEN length(ltrim(x, '0')) > 3 THEN 999 ELSE ('0' || x)::BIGINT END)) <= 255",
        "card": "length(dg) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(dg) + 1), lambda j: CASE WHEN j % 2 = 1 THEN reverse(dg)[j]::INT WHEN reverse(dg)[j]::INT > 4 THEN reverse(dg)[j]::INT * 2 - 9 ELSE reverse(dg)[j]::INT * 2 END)) % 10 = 0",
        "phone": "length(dg) BETWEEN 9 AND 15",
    }[kind]
    return f"""k{i} AS (SELECT doc_id, unnest(regexp_extract_all(t, '{pattern}')) AS m, unnest(regexp_split_to_array(t, '{pattern}')[: len(regexp_extract_all(t, '{pattern}'))]) AS g, unnest(range(len(regexp_extract_all(t, '{pattern}')))) AS n FROM d),
 p{i} AS (SELECT doc_id, {i} AS i, '{kind}' AS kind, m, regexp_replace(m, '[^0-9]', '', 'g') AS dg, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY n) - length(m) AS lo FROM k{i}),
 s{i} AS (SELECT doc_id, i, kind, lo::BIGINT AS lo, (lo + length(m))::BIGINT AS hi FROM p{i} WHERE {good})"""


PII = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {", ".join(_kind(i, *k) for i, k in enumerate(KINDS))},
 s AS ({" UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(4))}),
 a AS (SELECT doc_id, string_agg(kind || ':' || lo || ':' || hi, ',' ORDER BY i, lo) AS spans, {", ".join(f"count(*) FILTER (i = {i}) AS n_{k}" for i, (k, _) in enumerate(KINDS))} FROM s GROUP BY doc_id)
 SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k, _ in KINDS)}, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS base_spans FROM d LEFT JOIN a USING (doc_id)"""


def _quality() -> str:
    ratios = {"symbol_ratio": "n_symbols / greatest(n_words, 1)", "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)", "repeat_ratio": "n_repeat_words / greatest(n_words, 1)", "word_length": "word_chars / greatest(n_words, 1)"}
    q = ", ".join(f"quantile_disc({k}, {p}) AS {k}_{i}" for k in ratios for i, p in enumerate(quality.LEVELS))
    things = sorted({t for t, _ in quality.SHARES.values()})
    q += ", " + ", ".join(f"quantile_disc({t}, 0.5) AS {t}_typical" for t in things)
    names = [f"{k}_{i}" for k in ratios for i in range(len(quality.LEVELS))] + [f"{t}_typical" for t in things]
    mixed = ", ".join(f"(g.n * g.{x} + {quality.LEAN} * e.{x}) / (g.n + {quality.LEAN}) AS {x}" for x in names)
    tests = []
    for k in ratios:
        middle = f"f.{k}_{quality.MEDIAN}"
        if k in quality.SHARES:
            t, size = quality.SHARES[k]
            ordinary = middle
            for i in quality.UPPER:
                level, typical = f"f.{k}_{i}", f"(f.{t}_typical / {size})"
                ordinary = f"CASE WHEN ({level} - {middle}) * {typical} <= {quality.ERRORS} * sqrt(greatest({level} * {typical}, 1.0)) THEN {level} ELSE {ordinary} END"
            events = f"(greatest(r.{t}, 1) / {size})"
            tests.append(f"r.{k} * {events} <= ({ordinary}) * {events} + {quality.ERRORS} * sqrt(greatest(({ordinary}) * {events}, 1.0))")
        else:
            tests.append(f"r.{k} <= {middle} + {quality.SPREAD} * (f.{k}_2 - {middle})")
        if k in quality.BOTH_SIDES:
            tests.append(f"r.{k} >= {middle} - {quality.SPREAD} * ({middle} - f.{k}_0)")
    return rf"""WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORDS}')) AS l FROM documents),
 i AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) > 2), g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM i),
 c AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1), rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM c, range(3) t(k) GROUP BY doc_id),
 m AS (SELECT doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(l) AS n_lines FROM d LEFT JOIN rep USING (doc_id)),
 r AS (SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed, {", ".join(f"{v} AS {k}" for k, v in ratios.items())} FROM m),
 gr AS (SELECT lang, source, count(*) AS n, {q} FROM r GROUP BY lang, source), e AS (SELECT {q} FROM r), f AS (SELECT lang, source, {mixed} FROM gr g, e)
 SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(tests)} AS kept
 FROM r JOIN f ON r.lang IS NOT DISTINCT FROM f.lang AND r.source IS NOT DISTINCT FROM f.source"""


def _licenses() -> str:
    phrases = " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label, i - 1 AS place FROM i WHERE " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p)) for p, label in licenses.PHRASES)
    templates = ", ".join(f"({n}, '{label}', '{' '.join(sorted(set(text.split())))}', {licenses._needed(len(set(text.split())))})" for n, (label, text) in enumerate(licenses.TEMPLATES))
    return rf"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 i AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), b AS ({phrases}),
 t AS (SELECT n, label, string_split(words, ' ') AS words, least_ FROM (VALUES {templates}) v(n, label, words, least_)),
 h AS (SELECT doc_id, w, n, label, words, least_ FROM d JOIN t ON len(list_intersect(words, w)) >= least_),
 p AS (SELECT *, unnest(range(1, greatest(len(w) - {licenses.BLOCK - 1}, 1) + 1)) AS place FROM h),
 s AS (SELECT doc_id, label, len(words) AS size, least_, len(list_intersect(words, w[place : place + {licenses.BLOCK - 1}])) AS held FROM p),
 x AS (SELECT doc_id, label, max(held / size) AS share FROM s WHERE held >= least_ GROUP BY doc_id, label),
 y AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY doc_id),
 z AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM b UNION SELECT doc_id, label FROM x) GROUP BY doc_id), q AS (SELECT doc_id, max(share) AS share FROM x GROUP BY doc_id)
 SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
 FROM d LEFT JOIN y USING (doc_id) LEFT JOIN z USING (doc_id) LEFT JOIN q USING (doc_id)"""


VECTORS = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), ok AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(e, lambda x: abs(x))) > 0),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
 r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a), c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x), n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
 SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON vec_id = x LEFT JOIN n ON vec_id = a"""

#: Windows are compared by two hashes of their hexadecimal digits.
REPEATS = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), w AS (SELECT doc_id, unnest(range(length(h) // 2 - 99)) AS place, h FROM d WHERE length(h) >= 200),
 k AS (SELECT doc_id, place, md5_number(substr(h, 2 * place + 1, 200)) AS k FROM w),
 late AS (SELECT doc_id, place FROM k QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, place) > 1),
 e AS (SELECT doc_id, place, place > lag(place) OVER (PARTITION BY doc_id ORDER BY place) + 100 AS gap FROM late), s AS (SELECT doc_id, place, sum(coalesce(gap, true)::INT) OVER (PARTITION BY doc_id ORDER BY place) AS span FROM e),
 r AS (SELECT doc_id, span, min(place) AS lo, max(place) + 100 AS hi FROM s GROUP BY doc_id, span),
 b AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS last_hi FROM r),
 a AS (SELECT b.doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * last_hi + 1, 2 * (lo - last_hi)), '' ORDER BY lo) || substr(any_value(h), 2 * max(hi) + 1) AS kept FROM b JOIN d USING (doc_id) GROUP BY b.doc_id)
 SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)"""

ORACLES: dict[str, str] = {
    "pii_base_spans": PII,
    "op5_quality": _quality(),
    "op6_licenses": _licenses(),
    "op8_vectors": VECTORS,
    "op10_suffix_dedup": REPEATS,
}
