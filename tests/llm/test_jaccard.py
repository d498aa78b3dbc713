import random

import numpy as np
import pytest

from quillon.llm import jaccard
from quillon.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows, parts=3):
    full = [(i, t, "en", f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({b" ".join(w)} if w else set())


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


def edited(r, words, rate):
    return [w if r.random() > rate else f"w{r.randrange(10**6)}" for w in words]


def corpus(seed, bases, copies, rate, passage=0):
    r = random.Random(seed)
    common = [f"c{i}" for i in range(passage)]
    rows = []
    for _ in range(bases):
        base = [f"w{r.randrange(4000)}" for _ in range(r.randrange(12, 300))] + common
        for _ in range(copies):
            rows.append(" ".join(edited(r, base, r.random() * rate)))
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(
    "rows, params",
    [
        (corpus(1, 25, 8, 0.05), jaccard.JaccardParams()),
        (corpus(2, 60, 3, 0.03, passage=150), jaccard.JaccardParams(frequent=5, block=16, rounds=1)),
        (corpus(3, 2, 90, 0.06), jaccard.JaccardParams(frequent=0, block=8, rounds=0)),
    ],
)
def test_equals_brute_force(spark, rows, params):
    got = sorted(map(tuple, jaccard.classes(docs_of(spark, rows), params).collect()))
    assert got == brute(rows)


def test_a_family_mostly_not_linked(spark):
    """2,000 near copies of one text, few of which are linked: equal to brute force, and tasks tell one link a node at most."""
    r = random.Random(7)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(w if r.random() > 0.035 else f"x{r.randrange(10**6)}" for w in base)) for i in range(2000)]
    got = sorted(map(tuple, jaccard.classes(docs_of(spark, rows), jaccard.JaccardParams(rounds=0)).collect()))
    assert got == brute(rows)
    assert 300 < len({c for _, _, c in got}) < 1990


def test_tasks_tell_spanning_links_alone():
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 62, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate([r.choice(base, 180, replace=False), r.integers(0, 1 << 62, 12).astype(np.uint64)])) for _ in range(300)]
    node = np.arange(300)
    found = jaccard.spanning(node, node, sets, np.full(300, 2), jaccard.Components(), jaccard.JaccardParams(shingles=1000))
    assert len(found) < 300
    joined = jaccard.Components()
    for a, b in found:
        joined.join(a, b)
    for i in range(300):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                assert joined.root(i) == joined.root(j)


def test_long_text(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(3, long), (4, long + " and more"), (1, "a b c d e f g")]
    assert sorted(map(tuple, jaccard.classes(docs_of(spark, rows)).collect())) == [(1, 3, 1), (3, 59_996, 3), (4, 59_998, 3)]


def test_edges(spark):
    rows = [(5, None), (3, ""), (4, "  \n"), (9, "one two"), (2, "One  two"), (8, "one two three"), (7, "a b c d e f"), (7, "a b c d e f"), (1, "x y z u v w"), (1, "other words in this row of it")]
    got = sorted(map(tuple, jaccard.classes(docs_of(spark, rows)).collect()))
    assert got == [(1, 2, 1), (1, 3, 1), (2, 1, 2), (3, 0, 3), (4, 0, 4), (5, 0, 5), (7, 2, 7), (7, 2, 7), (8, 1, 8), (9, 1, 2)]
    kept = jaccard.representatives(docs_of(spark, [(1, "a b c"), (1, "a b c"), (2, "a b c"), (3, "z")])).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 3]


def test_empty_and_null_ids(spark):
    assert jaccard.classes(spark.createDataFrame([], SCHEMA)).count() == 0
    got = jaccard.classes(docs_of(spark, [(None, "q r s t u v"), (4, "q r s t u v"), (5, "else")])).collect()
    assert sorted((r["doc_id"] is None, r["component_id"]) for r in got if r["n_shingles"] == 2) == [(False, None), (True, None)]


def test_clashing_columns(spark):
    d = docs_of(spark, [(1, "a b"), (2, "a b")]).selectExpr("*", "1 AS node", "2 AS label", "'x' AS bits", "3 AS id")
    assert jaccard.classes(d).count() == 2
    assert jaccard.representatives(d).columns == d.columns


def test_trees_lose_nothing():
    r = np.random.default_rng(0)
    for _ in range(40):
        base = r.integers(0, 1 << 62, 400).astype(np.uint64)
        sets = [np.unique(np.concatenate([r.choice(base, r.integers(5, 400), replace=False), r.integers(0, 1 << 62, r.integers(0, 60)).astype(np.uint64)])) for _ in range(70)]
        node, n = np.arange(70), np.array([len(s) for s in sets])
        a, b = jaccard.candidates(node, n, node, [jaccard.bitmap(s) for s in sets], np.full(70, 2), 80)
        got = set(zip(a.tolist(), b.tolist(), strict=True))
        assert len(got) == len(a)
        for i in range(70):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    assert (j, i) in got


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = {}
    for a, b in edges:
        if a != b:
            least.setdefault(a, a), least.setdefault(b, b)
    for _ in range(500):
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert got == least
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
