"""Registered queries over the given tables, column by column, against plain Python and SQL."""

import hashlib
import re
import zlib

import duckdb
import pandas as pd
import pytest

from quillon.llm import ngram_lm, queries
from tests.llm.test_lm import brute as language_model


@pytest.fixture(scope="module")
def texts(sf):
    d = pd.read_parquet(f"{sf}/documents.parquet").sort_values("doc_id")
    return {int(i): t for i, t in zip(d["doc_id"], d["text"], strict=True)}


def rows(spark, sf, name):
    found = {r["doc_id"]: r for r in queries.QUERIES[name](spark, sf).collect()}
    assert found
    return found


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_language_id(spark, sf, texts):
    got = rows(spark, sf, "op1_language_id")
    lang = dict(pd.read_parquet(f"{sf}/documents.parquet")[["doc_id", "lang"]].itertuples(index=False))
    out = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in texts}
    learned = {x for i, x in lang.items() if x and not out[i]}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        letters = any(c.isalpha() for c in t or "")
        assert got[i]["held_out"] == out[i] and 0 <= got[i]["score"] <= 1
        assert got[i]["lang_pred"] in learned if letters else got[i]["lang_pred"] == "und"
    asked = [i for i, t in texts.items() if out[i] and lang[i] and any(c.isalpha() for c in t or "")]
    assert sum(got[i]["lang_pred"] == lang[i] for i in asked) >= 0.9 * len(asked)


def test_fingerprints(spark, sf, texts):
    got = rows(spark, sf, "op2_document_fingerprints")
    ids, fingerprint = sorted(texts), {}
    assert sorted(got) == ids
    for i, after in zip(ids, ids[1:] + ids[:1], strict=True):
        t, other = texts[i] or "", texts[after] or ""
        cut = len(t) // 4
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == sha(t[: len(t) - cut] + other[:cut])
        assert fingerprint.setdefault(t, got[i]["fingerprint"]) == got[i]["fingerprint"]
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
        assert got[i]["near_next"] == 1 or t != other or not t.split()


def test_language_model(spark, sf, texts):
    got, params = rows(spark, sf, "op6_lm_scoring"), ngram_lm.LmParams()
    for i, held, n_tokens, n_known, n, base, score in language_model(list(texts.items()), params):
        g = got[i]
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (held, n_tokens, n_known, n)
        assert g["base_score"] == pytest.approx(base, rel=1e-9)
        assert -n_tokens / params.steps - 1e-6 <= g["score"] - score <= 1e-6
    assert len(got) == len(texts)
    held = [g for g in got.values() if g["held_out"]]
    # the context tells more than a token's own count
    assert sum(g["score"] for g in held) > sum(g["base_score"] for g in held)


QUALITY = r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    place AS (SELECT doc_id, w, unnest(range(len(w) - 2)) AS i0 FROM d WHERE len(w) > 2),
    tri AS (SELECT doc_id, i0, w[i0 + 1] || ' ' || w[i0 + 2] || ' ' || w[i0 + 3] AS g FROM place),
    twice AS (SELECT doc_id, i0, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri),
    rep AS (SELECT doc_id, count(DISTINCT i0 + k) AS n FROM twice, (VALUES (0), (1), (2)) x(k) WHERE n > 1 GROUP BY doc_id),
    line AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
           length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
    FROM d JOIN line USING (doc_id) LEFT JOIN rep USING (doc_id)"""


def test_quality(spark, sf, texts):
    got = rows(spark, sf, "op7_quality_rules")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.execute(QUALITY).fetchall()
    assert len(want) == len(got) == len(texts)
    for i, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words in want:
        g = got[i]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), i
        assert g["base_failed"] == (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and not (g["base_failed"] and g["kept"])
    assert 0 < sum(g["kept"] for g in got.values()) < len(got)


KINDS = ("assign", "access", "hex")
PATTERNS = (r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"AKIA[A-Z0-9]+", r"[0-9a-f]+")


def test_secrets(spark, sf):
    # the least table has none
    larger = sf.replace("sf0.001", "sf0.01")
    d = pd.read_parquet(f"{larger}/documents.parquet")
    texts = dict(zip(d["doc_id"], d["text"], strict=True))
    got = rows(spark, larger, "op8_secret_scans")
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        found = []
        for k, pattern in enumerate(PATTERNS):
            for m in re.finditer(pattern, t or ""):
                if len(m[2] if k == 0 else m[0]) >= (6, 20, 24)[k]:
                    found.append((m.start(), k, m.end()))
        base = [f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(found)]
        assert tuple(got[i][f"n_{n}"] for n in KINDS) == tuple(sum(k == j for _, k, _ in found) for j in range(3))
        assert got[i]["base_sha256"] == sha(",".join(base)) and set(base) <= set(got[i]["spans"].split(","))
    assert any(g["n_assign"] or g["n_access"] or g["n_hex"] for g in got.values())


def test_mixture(spark, sf, texts):
    got = rows(spark, sf, "op10_mixing_sources")
    assert got.keys() == texts.keys()
    d = pd.read_parquet(f"{sf}/documents.parquet")
    source = {i: None if pd.isna(s) else s for i, s in zip(d["doc_id"], d["source"], strict=True)}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts.items()}
    names = sorted(set(source.values()), key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    held = {s: sum(size[i] for i in size if source[i] == s) for s in names}
    # the total is shared by weight; who would pass its limit stops there, and the others share what is left
    target, free, left = {}, set(names), float(sum(held.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * held[s]}
        target |= {s: 3.0 * held[s] for s in over} or share
        left -= sum(3.0 * held[s] for s in over)
        free = free - over if over else set()
    taken = dict.fromkeys(names, 0)
    for i, g in got.items():
        assert (g["size"], g["source_size"]) == (size[i], held[source[i]]) and g["target"] == pytest.approx(target[source[i]])
        assert 0 <= g["taken"] <= 3 * size[i]
        taken[source[i]] += g["taken"]
    longest = max(size.values())
    assert all(abs(taken[s] - target[s]) <= longest for s in names)
    assert {i: g["taken"] for i, g in rows(spark, sf, "op10_mixing_sources").items()} == {i: g["taken"] for i, g in got.items()}
