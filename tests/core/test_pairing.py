"""Pairing and reconciliation against sequential folds in plain Python."""

import random
import re
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import link, pairing
from quillon.plans import fixtures as X

DURATIONS = [0, -1, None, 1000, 1000, 1001, 2500, 6000, 6001, 7000, 11_000, 11_001, 16_002, 90_000]


def goes(a, b):
    return a <= 0 or b <= 0 or abs(a - b) <= 5000


def by_least_gap(tracks, entries):
    """(track, entry) of (id, key, duration) rows: the least edge next, until none is left."""
    edges = []
    for t, k, a in tracks:
        for f, q, b in entries:
            a_, b_ = max(a or 0, 0), max(b or 0, 0)
            if k is not None and k == q and goes(a_, b_):
                known = (a_ > 0) + (b_ > 0)
                edges.append((abs(a_ - b_) if known == 2 else 0, {2: 0, 0: 1, 1: 2}[known], min(x for x in (a_, b_) if x > 0) if known else 0, f, t))
    used, out = set(), []
    for *_, f, t in sorted(edges):
        if ("f", f) not in used and ("t", t) not in used:
            used |= {("f", f), ("t", t)}
            out.append((t, f))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_pairs_by_duration_are_those_of_the_fold(spark, monkeypatch, seed):
    monkeypatch.setattr(pairing, "CHUNK", (1, 3, 1024, 7)[seed])
    monkeypatch.setattr(pairing, "CELLS", 5)
    r = random.Random(seed)
    rows = lambda first, n: [(i, r.choice(["a", "b", "hot", "hot", "hot", None]), r.choice(DURATIONS) if r.random() < 0.6 else r.randrange(1, 40_000)) for i in r.sample(range(first, first + 10 * n), n)]
    tracks, entries = rows(0, 90), rows(10_000, 70)
    a, b = spark.createDataFrame(tracks, "track_id long, key string, duration_ms int"), spark.createDataFrame(entries, "file_id long, key string, duration_ms int")
    got = sorted(map(tuple, pairing.by_duration(a, b, ["key"], "track_id", "file_id").collect()))
    assert got == by_least_gap(tracks, entries) and len(got) > 30
    assert pairing.by_duration(a.limit(0), b, ["key"], "track_id", "file_id").count() == 0


def test_unknown_durations(spark):
    t = [(1, "k", 0), (2, "k", 5000), (3, "k", 0), (4, "k", 80_000), (5, "x", None), (6, "x", -3)]
    e = [(11, "k", 0), (12, "k", 9000), (13, "k", 5000), (14, "k", 70_000), (15, "x", 7), (16, "x", 9)]
    a, b = spark.createDataFrame(t, "track_id long, key string, duration_ms int"), spark.createDataFrame(e, "file_id long, key string, duration_ms int")
    got = sorted(map(tuple, pairing.by_duration(a, b, ["key"], "track_id", "file_id").collect()))
    # equal ones, unknown ones with each other, then what is unknown with the shortest known one; nothing is near enough for 80 s and 70 s
    assert got == [(1, 11), (2, 13), (3, 12), (5, 15), (6, 16)] == by_least_gap(t, e)


def test_one_key_of_many_rows(spark):
    """A key with two thirds of the rows: places go over many cells, and rounds are few."""
    n = 60_000
    a = spark.range(n).selectExpr("id AS track_id", "IF(id % 3 = 0, 'k' || id, 'hot') AS key", "CAST(1000 + id % 500 AS int) AS duration_ms")
    b = spark.range(n).selectExpr("id AS file_id", "IF(id % 3 = 1, 'k' || id, 'hot') AS key", "CAST(1500 + id % 500 AS int) AS duration_ms")
    got = pairing.by_duration(a, b, ["key"], "track_id", "file_id").toPandas()
    assert len(got) == n - n // 3 and got["track_id"].is_unique and got["file_id"].is_unique
    placed = pairing.by_place(a, b, ["key"], "track_id", "file_id").toPandas().sort_values("track_id")
    assert placed["file_id"].tolist() == [i for i in range(n) if i % 3 != 1][: len(placed)]


def test_plans_hold_no_pairs_and_no_python(spark):
    a, b = spark.createDataFrame([(1, "k", 5)], "track_id long, key string, duration_ms int"), spark.createDataFrame([(2, "k", 5)], "file_id long, key string, duration_ms int")
    assert "Python" not in pairing.by_duration(a, b, ["key"], "track_id", "file_id")._jdf.queryExecution().toString()


def in_turn(rows):
    taken, out = set(), []
    for _, t in sorted({(o, t) for t, _, _, o in rows}):
        free = sorted((s, f) for t_, f, s, _ in rows if t_ == t and f not in taken)
        if free and sum(s == free[0][0] for s, _ in free) == 1:
            taken.add(free[0][1])
            out.append((t, free[0][1]))
    return sorted(out)


@pytest.mark.parametrize("small", [3, 25])
def test_components_settle_alike(spark, small):
    r = random.Random(small)
    rows = []
    for family in range(12):
        base = 1000 * family
        at = {(base + t, base + f) for t in range(8) for f in r.sample(range(9), r.randrange(1, 5))}
        rows += [(t, f, r.randrange(4), t % 3) for t, f in sorted(at)]
    # each choice hangs on the one before: a component that rounds take one track at a time
    rows += [(50_000 + i, 50_000 + i + k, k, 5 + i) for i in range(60) for k in (0, 1)]
    df = spark.createDataFrame(rows, "track_id long, file_id long, score int, order int")
    assert sorted(map(tuple, pairing.one_by_one(df, ["score"], small).collect())) == in_turn(rows)


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (12, 11), (20, 20), (3, 2), *[(100 + i, 101 + i) for i in range(40)]]
    got = dict(map(tuple, pairing.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10, **{100 + i: 100 for i in range(41)}}


def test_compatible_keys(spark):
    r = random.Random(9)
    known = [(r.choice("abc"), r.choice(DURATIONS[:2] + DURATIONS[3:])) for _ in range(12)]
    asked = [(i, r.choice("abcd"), r.choice([0, *range(900, 30_000, 613), 4999, 5000, 5001, 9999, 10_000, 10_001])) for i in range(400)]
    got = {x["id"] for x in pairing.compatible_keys(spark.createDataFrame(known, "key string, d int"), spark.createDataFrame(asked, "id long, key string, d int"), "id").collect()}
    assert got == {i for i, k, d in asked if any(k == q and goes(d, e) for q, e in known)}


# ---- the reference's way: one entry after another ----------------------------------------------------------------


def spellings(a):
    out = [a]
    if ";" in a:
        out += [x.strip() for x in a.split(";")]
    if "," in a:
        out.append(a.split(",")[0].strip())
    if " / " in a:
        out += [x.strip() for x in a.split(" / ")]
    if "." in a and len(a) > 1:
        out += [a.rstrip("."), a.replace(".", "")]
    elif 1 <= len(a) <= 5:
        out.append(a + ".")
    if " & " in a:
        out.append(a.replace(" & ", " and "))
    elif " and " in a:
        out.append(a.replace(" and ", " & "))
    return out + (["unknown artist"] if a == "" else [])


def artist_goes(entry, track):
    x, y = sorted((entry, track), key=len)
    return track in spellings(entry) or (len(entry) >= 25 and len(track) >= 25 and len(x) <= 30 and y.startswith(x))


def title_goes(a, b):
    bare = lambda s: re.sub(r"^\d+[.\-\s]+", "", s)
    ext = lambda s: re.sub(r"(?i)(.)\.(mp3|flac|m4a|ogg|opus|wav|wma|aac|ape|wv)$", r"\1", s)
    loose = lambda s: re.sub(r"\s+", " ", re.sub(r"[^a-z0-9 ()']", "", re.sub("[‘’‛`]", "'", s.lower().replace(" & ", " and ")))).strip()
    if {a, bare(a)} & {b, bare(b)} or ext(a) == b or a == ext(b):
        return True
    x, y = sorted((a, b), key=len)
    return (25 <= len(x) <= 30 and len(y) > len(x) and y.startswith(x)) or (loose(a) == loose(b) != "")


def duration(x):
    return x["duration_ms"]


def fuzzy(e, t):
    return artist_goes(e["artist"], t["artist"]) and title_goes(e["title"], t["title"]) and goes(duration(e), duration(t))


def stands_for(e, t):
    near = goes(duration(e), duration(t))
    return (
        e["metadata_key"] == t["metadata_key"]
        or (near and bool(e["path"]) and e["path"] == t["file_path"])
        or (near and (e["artist"], e["title"]) == (t["artist"], t["title"]))
        or (near and bool(set(e["filename_keys"]) & set(t["filename_keys"])))
        or fuzzy(e, t)
    )


def score(e, t):
    gap = abs(duration(e) - duration(t)) if duration(e) > 0 and duration(t) > 0 else 0
    return tuple(e[c] != t[c] for c in ("artist", "title", "album")) + (gap,)


def choose(mine, others, picked):
    best = sorted((score(*picked(mine, x)), x["id"]) for x in others)
    return None if not best or (len(best) > 1 and best[0][0] == best[1][0]) else best[0][1]


def report(tracks, entries):
    """(track, entry, pass) and the rest of both sides."""
    t, e, out = dict(tracks), dict(entries), []

    def settle(a, b, name):
        out.append((a, b, name))
        del t[a], e[b]

    for name, of_t, of_e in (("PATH", "file_path", "path"), ("METADATA", "metadata_key", "metadata_key")):
        for key in {x[of_t] for x in t.values()}:
            if key:
                both = zip(sorted(i for i, x in t.items() if x[of_t] == key), sorted(i for i, x in e.items() if x[of_e] == key), strict=False)
                for a, b in list(both):
                    settle(a, b, name)
    found = {a: [b for b, y in e.items() if set(x["filename_keys"]) & set(y["filename_keys"])] for a, x in t.items()}
    for a in sorted((a for a in found if found[a]), key=lambda a: (len(found[a]), a)):
        b = choose(t[a], [e[b] for b in found[a] if b in e and goes(duration(e[b]), duration(t[a]))], lambda m, o: (o, m))
        if b is not None:
            settle(a, b, "FILENAME")
    for name, keys in (("ARTIST_ALBUM_TITLE", ("artist", "album", "title")), ("ARTIST_TITLE", ("artist", "title"))):
        of = lambda x, keys=keys: None if not any(x[k] for k in keys) else tuple(x[k] for k in keys)
        for a, b in by_least_gap([(i, of(x), duration(x)) for i, x in t.items()], [(i, of(x), duration(x)) for i, x in e.items()]):
            settle(a, b, name)
    for b in sorted(e, key=lambda b: (len(e[b]["title"]), b)):
        a = choose(e[b], [x for x in t.values() if fuzzy(e[b], x)], lambda m, o: (m, o))
        if a is not None:
            settle(a, b, "FUZZY")
    return sorted(out), t, e


ARTISTS = ["A", "B", "A; B", "A / B", "A, the first", "O.C", "O.C.", "OC", "X & Y", "X and Y", "", "Unknown Artist", "Abc", "Abc.", "Wanderers & the band of the north", "Wanderers & the band of the nor", "Wanderers & the band of th", "Wanderers & the band of"]
TITLES = ["Song", "01 - Song", "02. Song", "Song.flac", "song (live)", "S!o?ng", "An & Other", "An and Other", "Ünd", "", "A very long title, cut off by old tags somewhere", "A very long title, cut off b", "A very long title, cut off", "It’s", "It's"]


def catalogs(spark, seed, n=60):
    r = random.Random(seed)
    raw = "artist string, album string, title string, duration_ms int"
    one = lambda: (r.choice(ARTISTS), r.choice(["X", "X", "Y"]), r.choice(TITLES), r.choice([0, 1000, 1000, 4000, 9000, 200_000 + 700 * r.randrange(30)]))
    stem = lambda: f"/m/{r.choice('abc')}/{r.choice(['01 - song', 'track', 'a - song', f't{r.randrange(40)}'])}.mp3"
    t = link.catalog(spark.createDataFrame([(i, *one(), stem()) for i in range(n)], f"track_id long, {raw}, file_path string"))
    lib = link.library(spark.createDataFrame([(1000 + i, *one(), stem() if r.random() < 0.5 else None) for i in range(n)], f"file_id long, {raw}, path string"))
    rows = lambda d, i: {x[i]: {**x.asDict(), "id": x[i]} for x in d.collect()}
    return t, lib, rows(t, "track_id"), rows(lib, "file_id")


@pytest.mark.parametrize("seed", range(2))
def test_reconciliation_is_that_of_the_fold(spark, seed):
    t, lib, tracks, entries = catalogs(spark, seed)
    pairs = {(x["t_track_id"], x["l_file_id"]) for x in link.fuzzy_candidates(t, lib).collect()}
    assert pairs == {(a, b) for a, x in tracks.items() for b, y in entries.items() if fuzzy(y, x)}
    assert {x["file_id"] for x in link.represented(t, lib).collect()} == {b for b, y in entries.items() if any(stands_for(y, x) for x in tracks.values())}
    got, left_t, left_e = link.sync_report(t, lib)
    want, t_rest, e_rest = report(tracks, entries)
    assert sorted(map(tuple, got.collect())) == want and {x[2] for x in want} >= {"PATH", "FILENAME"}
    assert {x["track_id"] for x in left_t.collect()} == set(t_rest) and {x["file_id"] for x in left_e.collect()} == set(e_rest)


def test_failures_by_hand(spark):
    t, lib, tracks, entries = catalogs(spark, 7)
    t, tracks = t.where("track_id % 4 = 0"), {i: x for i, x in tracks.items() if i % 4 == 0}
    missing = link.unindexed(t, lib)
    keys = {x["metadata_key"] for x in tracks.values()}
    artist = lambda k: k.split("|")[0]
    want = []
    for e in missing.collect():
        alike = [k for k in keys if artist_goes(e["artist"], artist(k))]
        titled = [k for k in alike if f"|{e['title']}|" in k]
        own = sorted((k not in titled, k) for k in alike if artist(k) == e["artist"])
        want.append((e["file_id"], "NO_SIMILAR_KEY" if not alike else "DURATION_ONLY" if titled else "TITLE_MISMATCH", own[0][1] if own else None))
    got = sorted(map(tuple, link.failures(missing, t).collect()))
    assert got == sorted(want) and {x[1] for x in want} >= {"NO_SIMILAR_KEY", "TITLE_MISMATCH"}


def test_catalogs_of_the_driver(spark, sf):
    """The registered queries over the driver's tables against the folds."""
    from quillon.plans import catalog
    from quillon.plans import fixtures as X

    rows = lambda d, i: {x[i]: {**x.asDict(), "id": x[i]} for x in d.collect()}
    tracks, entries = rows(X.tracks(spark, sf), "track_id"), rows(X.library(spark, sf), "file_id")
    run = lambda name: sorted(map(tuple, catalog.QUERIES[name](spark, sf).collect()))
    assert run("library_sync_report") == report(tracks, entries)[0]
    key = lambda x: (x["artist"], x["title"])
    assert run("grouped_duration_pairing") == by_least_gap([(i, key(x), duration(x)) for i, x in tracks.items()], [(i, key(x), duration(x)) for i, x in entries.items()])
    some = {i: x for i, x in tracks.items() if i % 4}
    first = {}
    for b, e in sorted(entries.items()):
        if not any(stands_for(e, x) for x in some.values()):
            first.setdefault(e["metadata_key"], b)
    assert run("unindexed_anti_join") == sorted((b, k) for k, b in first.items())
    assert len(run("failure_categories")) == len(first)


def test_fallback_takes_the_first_level_that_any_row_meets(spark):
    asked = spark.createDataFrame([(1, "A", "x"), (2, "a", None), (3, "B", "y"), (4, None, "x"), (5, "q", "q"), (1, "A", "x")], "i int, p string, q string")
    rows = spark.createDataFrame([(12, "A", "x"), (11, "a", "x"), (10, "A", "z"), (13, "b", "q"), (14, None, "x"), (9, None, None)], "r int, p string, q string")
    both, one, loose = [(F.col("p"), F.col("p")), (F.col("q"), F.col("q"))], [(F.col("p"), F.col("p"))], [(F.lower("p"), F.lower("p"))]
    got = link.fallback(asked, rows, [both, one, loose], "i", "r").collect()
    assert sorted(map(tuple, got)) == [(1, 12, 1), (2, 11, 2), (3, 13, 3)]
    assert link.fallback(asked.limit(0), rows, [both], "i", "r").count() == 0 and link.fallback(asked, rows.limit(0), [both], "i", "r").count() == 0


def test_fallback_makes_no_pairs_of_a_frequent_key(spark):
    many = lambda name: spark.range(30_000).select(F.col("id").alias(name), F.lit("same").alias("p"))
    got = link.fallback(many("i"), many("r"), [[(F.col("p"), F.col("p"))]], "i", "r")
    assert got.count() == 30_000 and got.where("r <> 0").count() == 0


def test_fuzzy_titles_meet_by_keys_not_by_artist(spark):
    titles = ["song", "01 - song", "2. song", "song.mp3", "rock & roll", "rock and roll!", "a very long title of a song that goes on", "a very long title of a song", "", "x"]
    t = spark.createDataFrame([(i, "ab"[i % 2], s) for i, s in enumerate(titles * 2)], "track_id long, artist string, title string")
    e = spark.createDataFrame([(100 + i, "ab"[i % 3 % 2], s) for i, s in enumerate(titles[::-1] * 3)], "file_id long, artist string, title string")
    got = link.fuzzy_titles(t, e)
    both = t.withColumnRenamed("title", "a").join(e.withColumnRenamed("title", "b"), "artist").where(T.fuzzy_title("a", "b"))
    assert sorted(got.collect()) == sorted(both.select("track_id", "file_id").collect()) and got.count() > 50
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_cascade_is_that_of_all_pairs(spark):
    r = random.Random(5)
    pick = lambda *x: r.choice(x)
    row = lambda i: (i, f"k{r.randrange(400)}", pick("", f"f{r.randrange(40)}"), [], pick("", "ann", "ann b", "bob", "bo", f"c{i}"), pick("x", "y"), pick("", "t", "u", "v", f"w{r.randrange(60)}"), r.choice(DURATIONS + [3000, 5000, 9000]), pick(f"/p{r.randrange(300)}", None))
    cols = "metadata_key string, {0}, filename_keys array<string>, artist string, album string, title string, duration_ms int"
    t = spark.createDataFrame([row(i) for i in range(400)], f"track_id long, {cols.format('filename_key string')}, file_path string")
    e = [row(1000 + i) for i in range(300)]
    e = spark.createDataFrame([(i, k, [f for f in (f, f"f{r.randrange(40)}") if f], *rest) for i, k, f, _, *rest in e], "file_id long, metadata_key string, filename_keys array<string>, artist string, album string, title string, duration_ms int, path string")
    for per, mine, other in (("track_id", "t_track_id", "l_file_id"), ("file_id", "l_file_id", "t_track_id")):
        w = Window.partitionBy(mine).orderBy("level", *link.penalties(), other)
        want = link.candidates(t, e).withColumn("n", F.row_number().over(w)).where("n = 1")
        want = sorted((a, b, link.LEVELS[i]) for a, b, i in want.select("t_track_id", "l_file_id", "level").collect())
        found = link.cascade(t, e, per)
        assert sorted(map(tuple, found.collect())) == want and len({x[2] for x in want}) == 6
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_unindexed_and_failures_send_no_catalog_through_the_driver(spark, sf):
    t, e = X.tracks(spark, sf).where("track_id % 4 <> 0"), X.library(spark, sf)
    missing = link.unindexed(t, e)
    for d in (missing, link.failures(missing, t)):
        assert "Broadcast" not in d._jdf.queryExecution().executedPlan().toString()


SIDE = "id long, head long, keys array<string>, artist string, title string, album string, d int"


def test_composition_gets_no_row_of_ascii(spark, monkeypatch):
    """Only rows with other texts meet the UDF; both kinds have equal keys as before."""
    rows = lambda artists, i, path: spark.createDataFrame([(n, f" {a} ", "Unknown Album", f"0{n} - T|{a}.MP3", 1234, f"/m/{a}/01. {a} [x].flac" if n % 2 else None) for n, a in enumerate(artists)], f"{i} long, artist string, album string, title string, duration_ms int, {path} string")
    artists = ["Ann", "Cafe\u0301", "Caf\u00e9", "B & C"]
    t, e = rows(artists, "track_id", "file_path"), rows([*artists, None], "file_id", "path")
    built = lambda: [sorted(map(repr, d.collect())) for d in (link.catalog(t), link.library(e))]

    def refuse(s: pd.Series) -> pd.Series:
        raise ValueError("a row of ASCII")

    with monkeypatch.context() as m:
        m.setattr(T, "composed", refuse)
        ascii_rows = [link.catalog(t.where("track_id IN (0, 3)")), link.library(e.where("file_id IN (0, 3, 4)"))]
        assert [len(d.collect()) for d in ascii_rows] == [2, 3]

    apart = built()
    field = lambda x: unicodedata.normalize("NFC", x.lower().strip().replace("|", "/"))
    keys = [r.metadata_key for r in link.catalog(t).orderBy("track_id").collect()]
    assert keys == [f"{field(a)}|unknown album|{field(f'0{n} - T|{a}.MP3')}|1200" for n, a in enumerate(artists)]
    with monkeypatch.context() as m:
        m.setattr(T, "ascii_apart", lambda d, texts, f: f(d))
        assert built() == apart


def in_choice(mine, other):
    """Pairs of (id, head, keys, artist, title, album, d, order) and (id, head, keys, artist, title, album, d) rows by one choice after another."""
    keys = [{r[1]: set(r[2]) for r in side if r[2] is not None} for side in (mine, other)]
    shares = lambda m, o: bool(keys[0][m[1]] & keys[1][o[1]])

    def near(a, b):
        if a is None or b is None:
            one = b if a is None else a
            return one is not None and one <= 0
        return goes(a, b)

    known = lambda *ds: all((d or 0) > 0 for d in ds)
    taken, out = set(), []
    for m in sorted(mine, key=lambda m: (sum(shares(m, o) for o in other) if m[7] is None else m[7], m[0])):
        rows = [o for o in other if o[0] not in taken and shares(m, o) and near(m[6], o[6])]
        rated = [(tuple(m[c] is None or m[c] != o[c] for c in (3, 4, 5)) + (abs(m[6] - o[6]) if known(m[6], o[6]) else 0,), o[0]) for o in rows]
        best = [i for s, i in rated if s == min(rated)[0]]
        if len(best) == 1:
            taken.add(best[0])
            out.append((m[0], best[0]))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_choices_are_those_of_the_fold(spark, seed):
    r = random.Random(seed)
    row = lambda i: (i, i, r.sample([f"k{k}" for k in range(4 + 20 * (seed % 2))], r.randrange(4)), r.choice(["a", "b", None]), r.choice("tuv"), r.choice("xy"), r.choice([*DURATIONS, *range(900, 12_000, 501)]))
    mine, other = [(*row(i), None if seed < 2 else i % 5) for i in range(150)], [row(i) for i in range(100, 260)]
    # rows of one keys: the first has them for all
    mine, other = ([(*x[:1], x[0] - x[0] % 3, *x[2:]) if x[0] % 3 == 0 else (x[0], x[0] - x[0] % 3, None, *x[3:]) for x in side] if seed == 3 else side for side in (mine, [(x[0] + 2, x[0] + 2, *x[2:]) for x in other]))
    got = pairing.by_choice(spark.createDataFrame(mine, SIDE + ", order int"), spark.createDataFrame(other, SIDE))
    assert sorted(map(tuple, got.collect())) == in_choice(mine, other) and got.count() > 20
    assert pairing.by_choice(spark.createDataFrame(mine, SIDE + ", order int"), spark.createDataFrame([], SIDE)).count() == 0


def test_choices_by_a_frequent_key_make_no_pairs(spark):
    """A title that 30,000 rows of either side have: 900 million pairs."""
    n = 30_000
    side = lambda i, path: spark.range(n).selectExpr(f"id AS {i}", "'a' AS artist", "'x' AS album", "'intro' AS title", "CAST(1000 + id AS int) AS duration_ms", f"CAST(NULL AS string) AS {path}")
    keyed = lambda d: d.withColumn("filename_keys", F.array("title"))
    t, e = keyed(side("track_id", "file_path")), keyed(side("file_id", "path"))
    for f in (link.pair_filename, link.pair_fuzzy):
        assert f(t, e).where("track_id = file_id").count() == n
