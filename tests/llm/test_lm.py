import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import ngram_lm as lm

SCHEMA = "doc_id long, text string"


def brute(rows, params):
    tokens = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    out = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c, pairs, before = Counter(), Counter(), Counter()
    for (_, t), held in zip(tokens, out, strict=True):
        if not held:
            c.update(t)
            pairs.update(zip([0, *t[:-1]], t, strict=True))
            before.update([0, *t[:-1]])
    n, v = sum(c.values()), len(c)
    rows = []
    for (i, t), held in zip(tokens, out, strict=True):
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        score = sum(math.log10(min(1, (pairs[h, w] + params.mu * (c[w] + 1) / (n + v + 1)) / (before[h] + params.mu))) for h, w in zip([0, *t[:-1]], t, strict=True))
        rows.append((i, held, len(t), sum(c[w] > 0 for w in t), n, base, score))
    return rows


def run(spark, rows, params=lm.LmParams()):
    held = F.coalesce(lm.remainder(7) == 2, F.lit(False))
    return lm.score(spark.createDataFrame(rows, SCHEMA).repartition(3), ~held, params).collect()


@pytest.mark.parametrize("hot", [0, 8])
def test_equals_brute_force(spark, hot):
    r = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(r.choice(words, r.integers(0, 60), p=np.arange(400, 0, -1) ** 4 / (np.arange(400, 0, -1) ** 4).sum()))) for i in range(120)]
    rows += [(900, None), (901, ""), (902, "W1 w2\tnew-word"), (902, "w1 w2 new-word"), (None, "w3 w4"), (903, "the " * 3000)]
    params = lm.LmParams(hot=hot)
    got, want = run(spark, rows, params), brute(rows, params)
    key = lambda x: (x[0] is None, x[0] or 0, x[5])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        # a code rounds down by a step at most; all else is exact
        assert -w[2] / params.steps - 1e-6 <= g[6] - w[6] <= 1e-6


def test_empty(spark):
    assert run(spark, []) == []


def test_without_training_documents(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = run(spark, [(held, "a b")])
    assert row["held_out"] and row["train_tokens"] == 0 and row["n_known"] == 0 and row["base_score"] == 0.0


SEQUENCES = ([], [0], [5], [7, 7, 9], [0] * 200, [0, (1 << 64) - 1], [(1 << 63) + 1] * 3)


def test_elias_fano_reads_in_place():
    r = np.random.default_rng(2)
    drawn = (np.sort(r.integers(0, 1 << 63, 1000)), np.sort(r.integers(0, 300, 5000)), np.sort(r.integers(0, 1 << 40, 70000)), np.r_[np.arange(3000), [1 << 50]])
    for values in (*SEQUENCES, *drawn):
        v = np.array(values, np.uint64)
        e = lm.EliasFano(lm.EliasFano.pack(v))
        i = r.permutation(len(v))
        assert (e.get(i) == v[i]).all()
        asked = np.concatenate([v, v + np.uint64(1), r.integers(0, 1 << 63, 50).astype(np.uint64), np.array([0, (1 << 64) - 1], np.uint64)])
        at = e.find(asked)
        assert ((at >= 0) == np.isin(asked, v)).all()
        assert (v[at[at >= 0]] == asked[at >= 0]).all()
        # a range holds only what stands in it
        first, last = len(v) // 3, np.full(len(asked), 2 * len(v) // 3)
        at = e.find(asked, first, last)
        assert ((at >= 0) == np.isin(asked, v[first : 2 * len(v) // 3])).all()


def test_elias_fano_is_compact():
    v = np.sort(np.random.default_rng(3).integers(0, 1 << 50, 100_000).astype(np.uint64))
    # low bits, at most three of high parts, and as many again for the counts before each word
    assert 64 * len(lm.EliasFano.pack(v)) / len(v) < (50 - 16.6) + 6.5


@pytest.mark.parametrize("mapped", [True, False])
def test_trie(tmp_path, mapped):
    r = np.random.default_rng(2)
    context = np.sort(r.choice(r.integers(0, 1 << 63, 700), 30000)).astype(np.uint64)
    successor = r.integers(0, 1 << 32, 30000).astype(np.uint32)
    order = np.lexsort((successor, context))
    context, successor = context[order], successor[order]
    code = np.arange(30000) % 255 + 1
    with lm.level_file(f"file://{tmp_path}" if mapped else "hdfs://host/folder") as file:
        lm.Trie.write(file, context, successor, code)
        trie = lm.Trie.open(file)
    assert not list(tmp_path.iterdir())
    for step in (999, 1 << 17):
        assert (trie.lookup(context, successor, step) == code).all()
    pairs = set(zip(context.tolist(), successor.tolist(), strict=True))
    new = np.array([(c, s) not in pairs for c, s in zip(context.tolist(), (successor + np.uint32(1)).tolist(), strict=True)])
    assert not trie.lookup(context, successor + np.uint32(1))[new].any()
    assert not trie.lookup(context + np.uint64(1), successor)[~np.isin(context + np.uint64(1), context)].any()


def test_trie_without_contexts(tmp_path):
    none = np.zeros(0, np.uint64)
    with lm.level_file(str(tmp_path)) as file:
        lm.Trie.write(file, none, none.astype(np.uint32), none)
        trie = lm.Trie.open(file)
    assert trie.lookup(np.array([1, 2], np.uint64), np.array([1, 2], np.uint32)).tolist() == [0, 0]


def test_lookup_decodes_no_level_whole(tmp_path, monkeypatch):
    context = np.repeat(np.arange(1, 2001, dtype=np.uint64) << np.uint64(40), 50)
    successor = np.tile(np.arange(50, dtype=np.uint32) * 80_000_000, 2000)
    decoded = []
    low_part = lm.EliasFano.low_part
    monkeypatch.setattr(lm.EliasFano, "low_part", lambda self, i: decoded.append(len(i)) or low_part(self, i))
    with lm.level_file(str(tmp_path)) as file:
        lm.Trie.write(file, context, successor, np.ones(len(context)))
        trie = lm.Trie.open(file)
    assert trie.lookup(context[777:778], successor[777:778]).tolist() == [1]
    assert 0 < sum(decoded) < 20
