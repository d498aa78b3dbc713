"""Fill-in-the-middle, license scans and periodic runs against brute force, on small tables and as registered."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import fim, licenses, periodic, queries, secrets
from tests.llm.test_ops import LONG, ODD, docs_of, key

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def registered(spark, name, rows, tmp_path):
    """A registered query over a table of its own."""
    docs_of(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    return queries.QUERIES[name](spark, str(tmp_path))


def rearranged(i, t):
    t = t or ""
    w = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    d = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(w) + 1), h[1] % (len(w) + 1)))
    if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 90:
        return i, len(w), "plain", None, None, t
    x, y, z = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if h[3] % 100 < 20:
        return i, len(w), "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}"
    return i, len(w), "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}"


MARKS = ["a <P> b", "x<S>", "<M>", "<", "<P", "P><S<", "a<b>c<", "<<<>>>" * 20, "\0\0a\0", "\r\n\r\n", " a", "é \U0001f1e9\U0001f1ea"]


def test_rearranged_texts(spark):
    r = random.Random(3)
    rows = ODD + list(enumerate(MARKS * 8, 100)) + [(i, "".join(r.choice("ab <>PSM\né\U0001f600") for _ in range(r.randrange(40)))) for i in range(300, 600)]
    made = fim.rearrange(docs_of(spark, rows))
    got = made.select("*", fim.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert sorted((tuple(g)[:6] for g in got), key=key) == sorted((rearranged(i, t) for i, t in rows), key=key)
    assert {g["form"] for g in got} == {"plain", "psm", "spm"}
    assert sorted((g["doc_id"], g["back"]) for g in got if g["doc_id"] is not None) == sorted((i, t or "") for i, t in rows if i is not None)
    assert fim.rearrange(docs_of(spark, rows).limit(0)).count() == 0


def test_other_epochs_draw_other_cuts(spark):
    d = docs_of(spark, [(i, "one two three four five six") for i in range(50)])
    one, two = ({g["doc_id"]: g["output"] for g in fim.rearrange(d, fim.FimParams(epoch=e)).collect()} for e in (1, 2))
    assert sum(one[i] != two[i] for i in one) > 25
    assert {g["form"] for g in fim.rearrange(d, fim.FimParams(rearranged=0)).collect()} == {"plain"}
    assert {g["form"] for g in fim.rearrange(d, fim.FimParams(rearranged=100, spm=100)).collect()} == {"spm"}


def test_rearranged_as_registered(spark, tmp_path):
    rows = ODD + list(enumerate(MARKS, 100))
    got = registered(spark, "op11_fill_in_middle", rows, tmp_path).collect()
    want = [(*rearranged(i, t)[:5], sha(rearranged(i, t)[5]), sha(t or "")) for i, t in rows]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("name", ["op3_url_filters", "op4_ngram_jaccard_join", "op11_fill_in_middle", "op12_license_scans"])
def test_registered_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    rows = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in rows.description]
    got = queries.QUERIES[name](spark, sf)
    assert set(columns) <= set(got.columns)
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(rows.fetchall(), key=str)


def license_words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def held(t, templates, percent=90):
    """(label, first, end, score) of every block that holds a template."""
    w, best = license_words(t), {}
    for label, text in templates:
        x = license_words(text)
        if not x:
            continue
        s, want = 1, set(x)
        while s < 1.25 * len(x):
            s *= 2
        for k in range(-(-len(w) // s)):
            n = len(want & set(w[k * s : k * s + 2 * s]))
            if 100 * n >= percent * len(want):
                at = (label, k * s, min(len(w), k * s + 2 * s))
                best[at] = max(best.get(at, 0), n / len(want))
    return sorted((*k, v) for k, v in best.items())


def license_rows():
    r = random.Random(5)
    filler = [f"w{i}" for i in range(40)] + ["the", "license", "under", "of", "by", "software", "cc"]
    rows = list(ODD)
    for i in range(10, 150):
        t = [r.choice(filler) for _ in range(r.randrange(200))]
        for _ in range(r.randrange(3)):
            notice = r.choice(licenses.TEMPLATES)[1].split(" ")
            for _ in range(r.randrange(4)):
                notice[r.randrange(len(notice))] = r.choice(filler)
            at = r.randrange(len(t) + 1)
            t[at:at] = notice
        rows.append((i, r.choice([" ", "\n", ", "]).join(t)))
    rows += [(200, "CC-BY cc by CC  by"), (201, "gnu general public license gnu GENERAL public Licenses"), (202, "MIT License. " * 400), (203, "the mit license"), (203, "the mit license"), (204, "cc éby cc byé cc\0by")]
    return rows


@pytest.mark.parametrize("percent", [60, 90])
def test_license_scan(spark, percent):
    rows = license_rows()
    templates = [*licenses.TEMPLATES, ("none", " .. "), ("mit", "Released under the MIT License"), ("own", "w1 w2 w3 w4")]
    t = spark.createDataFrame(templates, "label string, text string")
    got = licenses.scan(docs_of(spark, rows), t, licenses.LicenseParams(percent)).collect()
    want = []
    for i, text in rows:
        w = license_words(text)
        places = [(k, label) for k in range(len(w)) for p, label in licenses.PHRASES if w[k : k + len(p.split())] == p.split()]
        want.append((i, len(w), sorted(places), held(text, templates, percent)))
    have = [(g["doc_id"], g["n_words"], [tuple(x) for x in g["places"]], sorted((x["label"], x["first"], x["end"], x["score"]) for x in g["matches"])) for g in got]
    assert sorted(have, key=str) == sorted(want, key=str)
    assert any(x[3] for x in want)
    assert licenses.scan(docs_of(spark, rows).limit(0), t).count() == 0
    none = licenses.scan(docs_of(spark, rows), t.limit(0)).collect()
    assert len(none) == len(rows) and not any(g["matches"] for g in none)


def test_license_scan_takes_no_python(spark):
    """The main path is made of DataFrame functions."""
    t = spark.createDataFrame(licenses.TEMPLATES, "label string, text string")
    plan = licenses.scan(docs_of(spark, ODD), t)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def runs_by_hand(w, least):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i >= q and j + q - i >= least:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((i, j - i, q) for (i, j), q in found.items()), key=lambda x: (x[0], x[2]))


def collapsed(w, runs):
    drop = {k for i, n, q in runs for k in range(i + q, i + n)}
    return " ".join(x for k, x in enumerate(w) if k not in drop)


def repeated(r):
    n, letters = r.choice([0, 1, 5, 12, 30, 80, 200]), "abcdefghijklmnopqrstuvwxyz"[: r.choice([1, 2, 3, 5, 20])]
    w = [r.choice(letters) for _ in range(n)]
    for _ in range(r.randrange(4)):
        if w:
            a, q = r.randrange(len(w)), r.randrange(1, 20)
            w[a : a + q * r.randrange(1, 5)] = w[a : a + q] * r.randrange(1, 6)
    return w


@pytest.mark.parametrize("least", [2, 3, 6, 12, 13])
def test_runs_of_batches(least, monkeypatch):
    r = random.Random(least)
    for _ in range(60):
        texts = [repeated(r) for _ in range(r.randrange(1, 8))]
        monkeypatch.setattr(periodic, "GROUP", r.choice([1, 50, 1 << 18]))
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([r.choice([" ", "\n", " \x0b\t"]).join(t) + r.choice(["", " ", "\f"]) for t in texts])], names=["doc_id", "text"])
        for w, row in zip(texts, periodic.scan(batch, least).to_pylist(), strict=True):
            want = runs_by_hand(w, least)
            assert [tuple(x.values()) for x in row["runs"]] == want
            assert row["collapsed"] == collapsed(w, want) and row["n_words"] == len(w)


def test_extensions_and_blocks():
    s = np.array([1, 2, 1, 2, 1, 3, 1, 2, 1, 9])
    order, tables = periodic.doubled(s)
    assert [list(s[i:]) for i in order] == sorted(list(s[i:]) for i in range(len(s)))
    i, j = (x.reshape(-1) for x in np.meshgrid(range(len(s)), range(len(s))))
    i, j = i[i != j], j[i != j]
    same = lambda a, b, step: 0 if not (0 <= a < len(s) and 0 <= b < len(s)) or s[a] != s[b] else 1 + same(a + step, b + step, step)
    assert periodic.extension(tables, i, j).tolist() == [same(a, b, 1) for a, b in zip(i, j, strict=True)]
    assert periodic.extension(tables, i, j, left=True).tolist() == [same(a, b, -1) for a, b in zip(i, j, strict=True)]
    length, source = periodic.previous_factors(order, tables)
    assert length == [max((same(k, a, 1) for a in range(k)), default=0) for k in range(len(s))]
    assert all(same(k, source[k], 1) == n for k, n in enumerate(length) if n)
    assert periodic.blocks(length).tolist() == [0, 1, 2, 5, 6, 9, 10]


def planted(i, t):
    """The words of op13's text, by its contract."""
    w = WORDS.findall(t or "")
    h = zlib.crc32(str(i).encode())
    if i is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]


def test_runs_as_registered(spark, tmp_path):
    r = random.Random(13)
    rows = ODD + [(i, " ".join(repeated(r))) for i in range(20, 400)] + [(8000 + i, LONG) for i in range(3)]
    got = registered(spark, "op13_periodic_runs", rows, tmp_path).collect()
    want = []
    for i, t in rows:
        w = planted(i, t)
        runs = [(0, len(w), 2)] if t == LONG and len(w) > 10_000 and w == WORDS.findall(LONG) else runs_by_hand(w, 12) if len(w) < 10_000 else None
        if runs is None:
            continue
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        want.append((i, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2], sha(lines), sha(collapsed(w, runs))))
    ids = {x[0] for x in want}
    assert sorted((tuple(g) for g in got if g["doc_id"] in ids), key=key) == sorted(want, key=key)
    assert len(got) == len(rows) and len(want) >= len(rows) - 4
    assert sum(x[1] > 0 for x in want) > 100


def test_runs_of_nothing(spark):
    assert periodic.find(docs_of(spark, ODD).limit(0)).count() == 0
    got = {(g["doc_id"], g["n_words"], g["collapsed"]) for g in periodic.find(docs_of(spark, ODD[:5])).collect()}
    assert got == {(1, 0, ""), (2, 0, ""), (3, 0, ""), (4, 1, "word")}


def test_redaction_needs_no_ids(spark):
    """Live tokens go whatever the ids: null, repeated, or shared with another text."""
    r = random.Random(8)
    token = lambda i: f"Kx{i}" + "".join(r.choice("abcdefGHIJKLmnop0123456789") for _ in range(32))
    live = [token(i) for i in range(5)]
    rows = [(None, f"one {live[0]} end"), (None, f"two {live[1]}"), (7, f"three {live[2]}"), (7, f"four {live[3]}"), (7, "no token here"), (8, f"{live[4]} {live[4]}"), (None, None), (9, "")]
    docs = docs_of(spark, rows)
    got = sorted((g["doc_id"], g["text"], g["n_chars"]) for g in secrets.redact(docs).where("text <> ''").collect() if g["doc_id"] is not None)
    assert [t for _, t, _ in got] == ["four [SECRET]", "no token here", "three [SECRET]", "[SECRET] [SECRET]"]
    all_ = [g["text"] or "" for g in secrets.redact(docs).collect()]
    assert len(all_) == len(rows) and not any(x in t for x in live for t in all_)
    assert {t for t in all_ if t.startswith(("one", "two"))} == {"one [SECRET] end", "two [SECRET]"}


def test_pipeline_redacts_every_row(spark, sf):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)["secret_scans"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    token = "Qz7" + "aBcDeFgHiJkLmNoP" * 2 + "0123"
    odd = docs.limit(1).select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(f"it says {token} there").alias("text"), "lang", "source", "n_chars")
    out = stage(spark, docs.unionByName(odd), sf)
    assert out.where(F.contains("text", F.lit(token))).count() == 0 and out.where("doc_id IS NULL").count() == 1
    assert out.count() == docs.count() + 1
