"""Queries that have no oracle SQL, recomputed from the given tables by plain definitions."""

import unicodedata
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest

from tessera.functions import kernels as K
from tessera.plans import more, registry
from tests.test_oracle import DATA

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables")


@pytest.fixture(scope="module")
def ask(spark):
    return lambda name: [r.asDict() for r in registry.queries()[name](spark, str(DATA)).collect()]


@pytest.fixture(scope="module")
def vec():
    df = duckdb.sql(f"select vec_id, label, embedding from '{DATA}/embeddings.parquet' order by vec_id").df()
    return df["vec_id"].to_numpy(), df["label"].to_numpy(), np.array(df["embedding"].tolist(), float)


def agglomerate(x, method, stop=1):
    """(clusters that are left, heights, sizes) by the definition of the distance of two clusters."""
    clusters, heights, sizes = [[i] for i in range(len(x))], [], []

    def far(a, b):
        if method == "average":
            return np.mean([np.linalg.norm(x[i] - x[j]) for i in a for j in b])
        return np.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * np.linalg.norm(x[a].mean(0) - x[b].mean(0))

    while len(clusters) > stop:
        h, i, j = min((far(clusters[i], clusters[j]), i, j) for i, j in combinations(range(len(clusters)), 2))
        merged = clusters[i] + clusters[j]
        clusters = [c for k, c in enumerate(clusters) if k not in (i, j)] + [merged]
        heights.append(h)
        sizes.append(len(merged))
    return clusters, heights, sizes


def cut(x, method, k):
    out = np.zeros(len(x), int)
    for c in agglomerate(x, method, k)[0]:
        out[c] = min(c)
    return out


def silhouette(x, of):
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    out = []
    for i in range(len(x)):
        own = (of == of[i]) & (np.arange(len(x)) != i)
        if not own.any():
            out.append(0.0)
            continue
        a, b = d[i][own].mean(), min(d[i][of == c].mean() for c in set(of) - {of[i]})
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def rand(a, b):
    pairs = list(combinations(range(len(a)), 2))
    both = sum(a[i] == a[j] and b[i] == b[j] for i, j in pairs)
    one, two = sum(a[i] == a[j] for i, j in pairs), sum(b[i] == b[j] for i, j in pairs)
    expected = one * two / len(pairs)
    return (both - expected) / ((one + two) / 2 - expected)


def means(labels, x):
    names = sorted(set(labels.tolist()))
    return names, np.stack([x[labels == c].mean(0) for c in names])


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def statuses(vec):
    ids, cls, x = vec
    for s, rest in (("L1", 0), ("L2", 1)):
        own = ids % 20 % 2 == rest
        yield s, *means(cls[own], x[own])


def test_trees(ask, vec):
    _, cls, x = vec
    names, c = means(cls, unit(x))
    got = sorted(ask("c1_ward_tree"), key=lambda r: r["step"])
    _, heights, sizes = agglomerate(c, "ward")
    assert [r["height"] for r in got] == pytest.approx(heights, abs=1e-5) and [r["size"] for r in got] == sizes
    got = ask("c2_average_tree")
    for s, _, c2 in statuses(vec):
        own = sorted((r for r in got if r["status"] == s), key=lambda r: r["step"])
        _, heights, sizes = agglomerate(c2, "average")
        assert [r["height"] for r in own] == pytest.approx(heights, abs=1e-5) and [r["size"] for r in own] == sizes
    k3 = {r["cls"]: r["cluster"] for r in ask("c3_cluster_assignments")}
    assert [k3[n] for n in names] == cut(c, "ward", 3).tolist()


def chosen(c, ks=range(2, 9)):
    s = {k: silhouette(c, cut(c, "ward", k)) for k in ks}
    _, heights, _ = agglomerate(c, "ward")
    return s, max(s, key=lambda k: (round(s[k], 12), -k))


def test_silhouettes_and_chosen_k(ask, vec):
    got, best = ask("c4_silhouettes"), {r["status"]: r for r in ask("c5_chosen_k")}
    for status, _, c in statuses(vec):
        s, k = chosen(c)
        assert {r["k"]: r["silhouette"] for r in got if r["status"] == status} == pytest.approx(s, abs=1e-5)
        assert best[status]["k_silhouette"] == k
    _, cls, x = vec
    by = {r["rep"]: r["k_silhouette"] for r in ask("c10_k_selection")}
    assert by == {"raw": chosen(means(cls, x)[1])[1], "unit": chosen(means(cls, unit(x))[1])[1]}


def test_partitions_of_classes_and_units(ask, vec):
    ids, cls, x = vec
    names, c = means(cls, unit(x))
    best = chosen(c)[1]
    got = {(r["partition"], r["cut"]): (r["k"], r["ari"]) for r in ask("c7_class_partition_agreement")}
    for part, size, most in (("two", 2, 8), ("three", 3, 9)):
        own = [i for i, n in enumerate(names) if n < most]
        for kind, k in (("given", size), ("silhouette", best)):
            of = cut(c, "ward", k)
            assert got[part, kind] == (k, pytest.approx(rand([of[i] for i in own], [names[i] % size for i in own]), abs=1e-5))
    assert len(more.PARTITIONS) == 2 and len(got) == 4
    whole = means(cls, x)[1]
    units = sorted(set((ids % 20).tolist()))
    v = np.stack([np.concatenate([x[(ids % 20 == u) & (cls == n)].mean(0) if ((ids % 20 == u) & (cls == n)).any() else whole[i] for i, n in enumerate(names)]) for u in units])
    assert ask("c9_unit_clusters")[0]["ari"] == pytest.approx(rand(cut(v, "ward", 2), [u % 2 for u in units]), abs=1e-5)


def test_systematic_errors(ask, vec):
    _, cls, x = vec
    wrong = []
    for at in (0, 22, 42):
        names, c = means(cls, x[:, at : at + 22])
        of = cut(c, "ward", 2)
        main = {}
        for kind in (0, 1):
            counts = Counter(of[i] for i, n in enumerate(names) if n % 2 == kind)
            main[kind] = min(k for k, m in counts.items() if m == max(counts.values()))
        wrong.append([of[i] != main[n % 2] for i, n in enumerate(names)])
    want = {n: bool(all(w[i] for w in wrong)) for i, n in enumerate(names)}
    assert {r["cls"]: r["systematic"] for r in ask("c11_systematic_errors")} == want


def test_principal_components(ask, vec):
    ids, _, x = vec
    got = ask("v9_principal_components")
    score = np.zeros((len(ids), 5))
    place = {i: k for k, i in enumerate(ids.tolist())}
    for r in got:
        score[place[r["vec_id"]], r["component"] - 1] = r["score"]
    cov = np.cov(x.T)
    values = np.linalg.eigvalsh(cov)[::-1][:5]
    assert np.cov(score.T) == pytest.approx(np.diag(values), abs=1e-4) and abs(score.mean(0)).max() < 1e-5
    assert {r["component"]: r["explained"] for r in got} == pytest.approx({i + 1: v / np.trace(cov) for i, v in enumerate(values)}, abs=1e-5)
    axes = np.linalg.lstsq(score, x - x.mean(0), rcond=None)[0]
    assert axes @ axes.T == pytest.approx(np.eye(5), abs=1e-4) and cov @ axes.T == pytest.approx(axes.T * values, abs=1e-4)


def test_base_symbols(ask):
    texts = dict(duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall())

    def base(text):
        kept = "".join(c for c in unicodedata.normalize("NFD", text) if c == "̃" or unicodedata.category(c) != "Mn")
        return unicodedata.normalize("NFC", kept).translate({ord(c): None for c in "ː:ʲ"})

    assert {r["doc_id"]: r["base"] for r in ask("p1_base_symbols")} == {i: None if t is None else base(t) for i, t in texts.items()}


@pytest.mark.parametrize(("name", "group", "sides"), [("t2_group_battery", "user_id % 2", (0, 1)), ("t3_second_factor_battery", "(user_id // 2) % 2", (0, 1))])
def test_batteries(ask, name, group, sides):
    df = duckdb.sql(f"select user_id, event_type as cls, any_value({group}) as side, avg(value) as f1, avg(log2(value)) as f2 from '{DATA}/events.parquet' group by 1, 2").df()
    got = {(r["cls"], r["feature"]): r for r in ask(name)}
    for (cls, feature), r in got.items():
        own = df[df["cls"] == cls].dropna(subset=[feature])
        want = K.two_group_test(*(own[own["side"] == s][feature].to_numpy() for s in sides))
        assert (r["selected_test"], r["n_a"], r["n_b"], r["assumptions_hold"]) == tuple(want[k] for k in ("selected_test", "n_a", "n_b", "assumptions_hold"))
        for k in ("mean_a", "mean_b", "shapiro_p_a", "shapiro_p_b", "levene_p", "statistic", "p_value", "difference"):
            assert r[k] == pytest.approx(want[k], abs=2e-6)
    assert len(got) == 10
