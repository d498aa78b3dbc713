"""Kernels against plain restatements, and invariants."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import sequences
from quillon.functions import text as T
from quillon.functions import vectors as V
from quillon.operators import cluster, fusion, knn, link, search, select, store
from quillon.plans import catalog, radio
from quillon.sources import files


def unit(n, dim, seed=0):
    v = np.random.default_rng(seed).normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def table(spark, v):
    return spark.createDataFrame([(i, x.tolist(), i % 4) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")


def test_mmr_restated():
    v, rel = unit(40, 6), np.sort(np.random.default_rng(1).random(40))[::-1]
    chosen = []
    while len(chosen) < 12:
        best = max((i for i in range(40) if i not in chosen), key=lambda i: (0.4 * rel[i] - (0.6 * max(v[i] @ v[j] for j in chosen) if chosen else 0), -i))
        chosen.append(best)
    assert select.mmr_order(rel, v, 12, 0.4) == chosen
    assert select.mmr_order(rel, v, 12, 1.0) == list(range(12))
    assert select.mmr_order(rel[:3], v[:3], 12, 0.4) and len(select.mmr_order(rel[:3], v[:3], 12, 0.4)) == 3


def test_dpp_is_greedy_determinant():
    v, q = unit(15, 8, 2), np.random.default_rng(3).random(15) + 0.1
    kernel = q[:, None] * q[None, :] * (v @ v.T)
    chosen = []
    for _ in range(5):
        best = max((i for i in range(15) if i not in chosen), key=lambda i: np.linalg.det(kernel[np.ix_([*chosen, i], [*chosen, i])]))
        chosen.append(best)
    assert select.dpp_order(q, v, 5) == chosen
    assert select.dpp_order(q, np.repeat(v[:1], 15, 0), 5) == [int(q.argmax())]


def test_artist_filter():
    assert select.artist_filter(["A", "A", "B", "A", None, None, "A"], 2, 1) == [0, 2, 3, 4, 5]
    r = random.Random(0)
    for _ in range(50):
        a = [r.choice(["x", "X", "y", "z", None, ""]) for _ in range(40)]
        kept = select.artist_filter(a, 5, 2)
        assert select.artist_filter([a[i] for i in kept], 5, 2) == list(range(len(kept)))


def test_post_filter_without_spacing_keeps_missing_artists(spark):
    rows = spark.createDataFrame([(0, a, i) for i, a in enumerate(["A", "a", "B", None, None, None])], "query_id int, artist string, position int")
    assert [r["position"] for r in select.post_filter(rows, 1, 0).orderBy("position").collect()] == [0, 2, 3, 4, 5]


def test_drift_alpha_equals_columns(spark):
    for kind in ("NONE", "LINEAR", "EXPONENTIAL", "STEP", "other"):
        got = spark.range(6).select(sequences.decay(F.lit(kind), 0.5, F.col("id"), F.lit(6)).alias("a")).toPandas()["a"]
        assert np.allclose(got, [select.alpha_at(kind, 0.5, i, 6) for i in range(6)])
    assert spark.range(1).select(sequences.decay(F.lit("STEP"), 0.5, F.lit(1), F.lit(3)).alias("a")).head()["a"] == pytest.approx(0.1)
    assert spark.range(1).select(sequences.decay(F.lit("LINEAR"), 0.5, F.lit(0), F.lit(1)).alias("a")).head()["a"] == 0.5


def test_drift_with_anchor_one_is_a_fixed_query():
    v = unit(60, 8, 5)
    picks = select.drift_order(v[0], 0, np.arange(60), v, [None] * 60, 10, 60, 1.0, "SEED_INTERPOLATION", 1.0, "NONE", 0.7, 8, 3)
    assert [i for i, _, _ in picks] == np.argsort(-(v @ v[0]))[1:11].tolist()


def test_drift_searches_all_vectors(spark):
    v, config = unit(1500, 4, 11), radio.RadioConfig(tracks=8, pool=4, drift=True, anchor=0.0, decay="NONE", momentum=0.0, diversity=0.0, per_artist=2, spacing=1)
    t = table(spark, v)
    tracks = t.select(F.col("vec_id").alias("id"), F.concat(F.lit("A"), (F.col("vec_id") % 5).cast("string")).alias("artist"))
    seeds = spark.createDataFrame([(7, 0), (8, 1200)], "query_id int, vec_id long")
    for mode in radio.DRIFTS:
        config = radio.RadioConfig.of(vars(config) | {"drift_mode": mode})
        got = radio.playlist(t, tracks, seeds, config).orderBy("query_id", "position").collect()
        params = select.DriftParams(8, 4, 0.0, mode, 0.0, "NONE", 0.0, 2, 1)
        rounds = select.drift(t, tracks, seeds.join(t, "vec_id").withColumnRenamed("embedding", "q"), params, whole=0).orderBy("query_id", "position").collect()
        assert [(r["query_id"], r["id"], r["candidate_rank"]) for r in rounds] == [(r["query_id"], r["id"], r["candidate_rank"]) for r in got]
        assert [r["score"] for r in rounds] == pytest.approx([r["score"] for r in got])
        for q, s in ((7, 0), (8, 1200)):
            want = select.drift_order(v[s], s, np.arange(1500), v, [f"a{i % 5}" for i in range(1500)], 8, 4, 0.0, mode, 0.0, "NONE", 0.0, 2, 1)
            assert [(r["id"], r["candidate_rank"]) for r in got if r["query_id"] == q] == [(i, rank) for i, _, rank in want]
        assert any((v @ v[0] > v[0] @ v[r["id"]]).sum() > 40 for r in got if r["query_id"] == 7)


def test_windows_and_segments(spark):
    secs = [282, 164, 350, 603, 411]
    got = spark.createDataFrame([(s * 24000,) for s in secs], "n long").select(sequences.window_count(F.col("n")).alias("w"))
    assert [r["w"] for r in got.collect()] == [57, 33, 70, 121, 83]
    for frames, want in ((128, [(0, 128)]), (129, [(0, 128), (1, 1)]), (256, [(0, 128), (128, 128)]), (0, [])):
        assert list(map(tuple, spark.range(1).select(sequences.segments(F.lit(frames)).alias("s")).head()["s"])) == want


def test_provenance_weights_add_up(spark):
    p = spark.range(1, 9).select(F.aggregate(sequences.ema_provenance(F.col("id"), 0.7, -1.0), F.lit(0.0), lambda s, x: s + x["weight"]).alias("t"))
    assert all(abs(r["t"] - 1) < 1e-12 for r in p.collect())
    first = spark.range(1).select(sequences.ema_provenance(F.col("id"), 0.7).alias("p"), sequences.interpolation_provenance(F.col("id"), F.lit(0.3)).alias("q")).head()
    assert [tuple(x) for x in first["p"]] == [(-1, 1.0)] and [tuple(x) for x in first["q"]] == [(-1, 1.0)]


def test_keys(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).head()["x"]
    assert one(T.filename_key(T.file_stem(F.lit("/a/01 - Song (Live) [x].flac")))) == "song"
    assert [one(T.strip_audio_extension(F.lit(x))) for x in (".mp3", "a.mp3", "a.xyz", "a.FLAC")] == [".mp3", "a", "a.xyz", "a"]
    assert one(T.metadata_key(F.lit(" A|B"), F.lit(None).cast("string"), F.lit("T"), F.lit(212_899))) == "a/b||t|212800"
    assert [one(T.duration_compatible(F.lit(a), F.lit(b))) for a, b in ((0, 9_000_000), (1000, 6000), (1000, 6001))] == [True, True, False]
    assert [one(T.artist_overlaps(F.lit(a), F.lit(b))) for a, b in (("", ""), ("", "x"), ("sia", "lsd; sia"))] == [True, False, True]
    assert one(T.nfc(F.lit("é"))) == "é" and one(T.nfc(F.lit(None).cast("string"))) is None
    assert one(T.normalize_artist(F.lit(" Unknown Artist\t"))) == ""
    assert one(T.cache_key(F.lit("/m\\a/b.mp3"), "/m")) == "a__b.mp3"
    assert one(T.format_track(F.lit(None).cast("string"), F.lit("t"), F.lit(""))) == "Unknown Artist - t"
    assert one(T.text_lines(F.lit("b\na\n\nb"))) == "b</s>a"
    assert one(T.fuzzy_title(F.lit("01 - song"), F.lit("song"))) and not one(T.fuzzy_title(F.lit("song"), F.lit("other")))
    long = "a title that is much longer than thirty characters"
    assert one(T.fuzzy_title(F.lit(long[:27]), F.lit(long))) and not one(T.fuzzy_title(F.lit(long[:20]), F.lit(long)))
    assert one(T.title_from_key(F.lit("a|b|c"))) is None and one(T.title_from_key(F.lit("a|b|c|1"))) == "c"


def test_vectors(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).head()["x"]
    a = F.array(F.lit(3.0), F.lit(4.0))
    assert one(V.l2_normalize(a)) == [0.6, 0.8] and one(V.l2_normalize(F.array(F.lit(0.0)))) == [0.0]
    assert one(V.cosine(a, a)) == pytest.approx(1.0) and one(V.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert not one(V.is_sane(F.array(F.lit(float("nan"))))) and not one(V.is_sane(F.lit(None).cast("array<double>")))
    assert one(V.truncated_percent(F.lit(-0.999))) == -99
    rows = spark.createDataFrame([(1, [1.0, 0.0], 3.0), (1, [0.0, 1.0], 1.0), (2, [5.0, 5.0], 2.0)], "k int, embedding array<double>, w double")
    assert {r["k"]: r["embedding"] for r in V.vec_mean(rows, ["k"], weight="w").collect()} == {1: [0.75, 0.25], 2: [5.0, 5.0]}


def test_ranks_equal_a_sort(spark):
    r = np.random.default_rng(4)
    s = np.round(r.uniform(-1, 1, 500), 2)
    df = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate(s)], "query_id int, vec_id long, score double")
    got = search.ranks(df, "query_id", "score", "vec_id").toPandas().sort_values("vec_id")
    want = np.empty(500, int)
    want[np.lexsort((np.arange(500), s))] = np.arange(500)
    assert (got["rank"].to_numpy() == want).all() and (got["total"] == 500).all()


def test_percentiles(spark):
    v = spark.createDataFrame([(i, [float(i) / 4]) for i in range(4)], "vec_id long, embedding array<double>")
    s = spark.createDataFrame([(0, [1.0], 1.0)], "seed_id int, embedding array<double>, weight double")
    got = {r["vec_id"]: r["score"] for r in fusion.geo_mean_percentiles(v, s).collect()}
    assert got == pytest.approx({0: 0.25, 1: 0.5, 2: 0.75, 3: 1.0})
    assert fusion.geo_mean_percentiles(v, s.withColumn("weight", F.lit(0.0))).count() == 0


def test_redistribute():
    out = fusion.redistribute([{"weight": 0.5, "kind": "SONG", "locked": True}, {"weight": 3.0, "kind": "SONG"}, {"weight": -1.0, "kind": "SONG"}, {"weight": 0.0, "kind": "TEXT"}])
    assert sum(abs(s["weight"]) for s in out) == pytest.approx(1.0) and out[0]["weight"] == 0.5 and out[2]["weight"] < 0
    assert [s["weight"] for s in fusion.redistribute([{"weight": 0.0, "kind": "SONG"}] * 2)] == pytest.approx([0.5, 0.5])


def test_knn_and_updates(spark):
    v = unit(150, 12, 6)
    t = table(spark, v)
    got = knn.build(t, 5, block=64).toPandas()
    s = v @ v.T
    np.fill_diagonal(s, -9)
    for i in range(150):
        assert got[got["src"] == i].sort_values("rank")["dst"].tolist() == np.argsort(-s[i])[:5].tolist()
    w = knn.weights(knn.build(t, 5)).groupBy("src").agg(F.sum("weight").alias("t")).toPandas()["t"]
    assert np.allclose(w[w > 0], 1)
    small = knn.build(t.where("vec_id < 3"), 5)
    assert small.count() == 6
    gone = knn.update(knn.build(t, 5), t.where("vec_id <> 7"), 5)
    assert sorted(map(tuple, gone.select("src", "dst").collect())) == sorted(map(tuple, knn.build(t.where("vec_id <> 7"), 5).select("src", "dst").collect()))


def test_knn_of_equal_vectors_takes_the_least_ids(spark):
    v = unit(60, 12, 6)
    v[10:] = v[10]
    t = spark.createDataFrame([(i, x.tolist(), 0) for i, x in reversed(list(enumerate(v)))], "vec_id long, embedding array<double>, label int")
    for block in (16, 2048):
        got = knn.build(t, 5, block=block).toPandas()
        for i in range(10, 60):
            assert got[got["src"] == i].sort_values("rank")["dst"].tolist() == [j for j in range(10, 17) if j != i][:5]
    s = np.zeros((1, 5000))
    assert len(knn.spared(s, np.arange(5000), np.zeros(5000, int), 5)[1]) == 5


def test_weights_of_rows_without_positive_scores(spark):
    e = spark.createDataFrame([(0, 1, 1, -0.5), (0, 2, 2, 0.0)], "src long, rank int, dst long, score double")
    assert [r["weight"] for r in knn.weights(e).collect()] == [0.0, 0.0]


def test_walks_agree(spark):
    e = knn.weights(knn.build(table(spark, unit(30, 5, 7)), 4)).cache()
    exact = {r["node"]: r["mass"] for r in knn.walk_exact(e, 0, 0.5, steps=12).collect()}
    drawn = {r["node"]: r["visits"] for r in knn.walk_monte_carlo(e, 0, 0.5, walks=4000, steps=12).collect()}
    n = sum(drawn.values())
    total = sum(exact.values())
    big = {k: m / total * n for k, m in exact.items() if m / total * n >= 5}
    chi = sum((drawn.get(k, 0) - m) ** 2 / m for k, m in big.items())
    assert chi < len(big) + 5 * np.sqrt(2 * len(big))
    assert knn.walk_exact(e.where("src <> 0"), 0, 0.5).count() == 0


def test_kmeans_ends_at_a_fixed_point(spark):
    v = np.concatenate([unit(1, 8, s) + 0.05 * np.random.default_rng(s).normal(size=(20, 8)) for s in range(3)])
    a, c = cluster.kmeans(table(spark, v / np.linalg.norm(v, axis=1, keepdims=True)), 3)
    got = a.toPandas().sort_values("vec_id")["cluster_id"].to_numpy().reshape(3, 20)
    assert all(len(set(r)) == 1 for r in got) and len(set(got[:, 0])) == 3 and c.count() == 3


def test_pairing(spark):
    t = spark.createDataFrame([(1, "k", 1000), (2, "k", 9000), (3, "", 5)], "track_id long, key string, duration_ms int")
    lib = spark.createDataFrame([(11, "k", 8000), (12, "k", 1500), (13, "", 5)], "file_id long, key string, duration_ms int")
    assert sorted(map(tuple, link.pair_exact(t, lib, "key", "key").collect())) == [(1, 11), (2, 12)]
    assert sorted(map(tuple, link.pair_by_duration(t, lib, ["key"]).collect())) == [(1, 12), (2, 11)]
    rows = spark.createDataFrame([(1, 11, 0, 1), (2, 11, 0, 2), (2, 12, 5, 2), (3, 12, 1, 3), (3, 13, 1, 3)], "track_id long, file_id long, score int, order int")
    assert sorted(map(tuple, link.pair_unique(rows, ["score"]).collect())) == [(1, 11), (2, 12), (3, 13)]


def in_turn(rows):
    """pair_unique, one track after another."""
    taken, out = set(), []
    for _, t in sorted({(o, t) for t, _, _, o in rows}):
        free = sorted((s, f) for t_, f, s, _ in rows if t_ == t and f not in taken)
        if free and sum(s == free[0][0] for s, _ in free) == 1:
            taken.add(free[0][1])
            out.append((t, free[0][1]))
    return sorted(out)


@pytest.mark.parametrize("small", [4, 100_000])
def test_unique_pairs_are_those_of_one_by_one(spark, small):
    r = random.Random(small)
    family = [(t, f, f, 1) for t in range(20) for f in range(20)]
    chain = [(100, 101, 0, 1), (101, 101, 0, 2), (101, 102, 1, 2), (102, 102, 0, 3)]
    ties = sorted({(200 + t, 200 + f): (200 + t, 200 + f, r.randrange(3), t % 4) for t in range(12) for f in r.sample(range(12), 4)}.values())
    for rows in (family, chain, ties):
        df = spark.createDataFrame(rows, "track_id long, file_id long, score int, order int")
        assert sorted(map(tuple, link.pair_unique(df, ["score"], small=small).collect())) == in_turn(rows)
    assert len(in_turn(family)) == 20 and (101, 102) in in_turn(chain)


def test_file_names_have_many_keys_on_both_sides(spark):
    raw = "artist string, album string, title string, duration_ms int"
    t = link.catalog(spark.createDataFrame([(1, "A", "X", "Song", 1000, "/m/track01.flac")], f"track_id long, {raw}, file_path string"))
    lib = link.library(spark.createDataFrame([(11, "Q", "Y", "Other", 1000, "/m/song.flac")], f"file_id long, {raw}, path string"))
    assert [tuple(r) for r in link.pair_filename(t, lib).collect()] == [(1, 11)]
    assert link.unindexed(t, lib).count() == 0 and link.sync_report(t, lib)[0].head()["pass"] == "FILENAME"


def test_entries_choose_in_fuzzy_pairs(spark):
    raw = "artist string, album string, title string, duration_ms int"
    t = link.catalog(spark.createDataFrame([(1, "A", "X", "Long Song", 1000, "/m/1"), (2, "A", "X", "Long Song", 9000, "/m/2")], f"track_id long, {raw}, file_path string"))
    lib = link.library(spark.createDataFrame([(11, "A", "X", "Long Song", 1400, None), (12, "A", "X", "Long Song", 1400, None)], f"file_id long, {raw}, path string"))
    # a track finds two equally good entries and takes none; an entry finds one track
    assert [tuple(r) for r in link.pair_fuzzy(t, lib).collect()] == [(1, 11)]


def test_store(spark, tmp_path):
    p = f"file://{tmp_path}/t"
    store.replace(spark.range(10), p)
    store.replace(spark.read.parquet(p).where("id > 4"), p)
    assert sorted(r["id"] for r in spark.read.parquet(p).collect()) == [5, 6, 7, 8, 9]
    store.compact(spark, p, 1)
    assert spark.read.parquet(p).count() == 5
    tracks = spark.createDataFrame([(1, "a"), (2, "b")], "track_id long, file_path string")
    enc = spark.createDataFrame([("a", [1.0]), ("b", [2.0]), ("c", [3.0])], "file_path string, embedding array<double>")
    got = store.fill_orphans(tracks, enc, spark.createDataFrame([(2,)], "track_id long"))
    assert sorted((r["track_id"], r["file_path"]) for r in got.collect() if r["track_id"]) == [(1, "a")] and got.count() == 2
    assert sorted(r["id"] for r in store.append_with_ids(spark.createDataFrame([(4, "x")], "id long, v string"), spark.createDataFrame([("b",), ("a",)], "v string"), "id", ["v"]).collect()) == [4, 5, 6]


def test_config():
    c = radio.RadioConfig.of({"mode": "nope", "decay": "LINEAR", "tracks": 7, "what": 1})
    assert (c.mode, c.decay, c.tracks, c.diversity, c.per_artist, c.spacing) == ("MMR", "LINEAR", 7, 0.4, 8, 3)
    assert select.auto_pool(100) == 100 and select.auto_pool(75_035) == 1500


@pytest.mark.parametrize("name", ["mmr_select", "dpp_select", "radio_batch"])
def test_every_twentieth_vector_asks(spark, sf, name):
    ids = spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 20 = 0")
    assert catalog.QUERIES[name](spark, sf).select("query_id").distinct().count() == ids.count()


def test_similar_takes_one_source(spark):
    v = table(spark, unit(20, 4, 8))
    t = v.select(F.col("vec_id").alias("id"), F.lit("A").alias("artist"), F.concat(F.lit("song "), F.col("vec_id").cast("string")).alias("title"))
    with pytest.raises(ValueError):
        radio.similar(v, t, 3)
    assert radio.similar(v, t, 3, query="SONG 4").count() == 3
    assert radio.similar(v, t, 3, random_seed=1).count() == 3
    assert radio.text_search(v, "x", lambda _: [1.0, 0, 0, 0], 4).count() == 4
    assert isinstance(radio.info({"v": v}).toPandas(), pd.DataFrame)


def test_orders_and_folds(spark, tmp_path):
    entries = spark.createDataFrame([(1, 5), (2, 9), (3, 9)], "file_id long, duration_ms int")
    assert [r["file_id"] for r in link.longest_first(entries).collect()] == [2, 3, 1]
    tracks = spark.createDataFrame([(1, "b", "x", "t"), (2, "A", "y", "t"), (3, None, "z", "t"), (4, "a", "X", "t")], "track_id long, artist string, album string, title string")
    assert [r["track_id"] for r in link.by_name(tracks).collect()] == [3, 4, 2, 1]
    row = spark.range(1).select(sequences.moving_average(F.array(*map(F.lit, [10.0, 20.0, 0.0]))).alias("a"), sequences.damped(F.array(*map(F.lit, [100, 200, 90]))).alias("b"), sequences.damped(F.array(*map(F.lit, [100, 200]))).alias("c"), sequences.standardized(F.array().cast("array<double>")).alias("d"), sequences.standardized(F.array(F.lit(3.0))).alias("e")).head()
    assert (row["a"], row["b"], row["c"], row["d"], row["e"]) == (pytest.approx(9.1), 90, 120, [], [0.0])
    (tmp_path / "a.flac").write_bytes(b"12345")
    assert files.scan_media(spark, str(tmp_path)).select(files.fingerprint().alias("f")).head()["f"].startswith("5_")


def test_preview_shows_every_mode(spark):
    v = table(spark, unit(30, 5, 11))
    t = v.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") != 3, F.concat(F.lit("artist "), F.col("label").cast("string"))).alias("artist"), F.concat(F.lit("song "), F.col("vec_id").cast("string")).alias("title"))
    s = v.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), "vec_id")
    got = radio.preview(v, t, s, size=5).toPandas()
    for mode in radio.MODES:
        want = radio.playlist(v, t, s, radio.RadioConfig(tracks=5, mode=mode)).toPandas().sort_values("position")
        lines = [f"{a} \u2013 {b if b is not None else '?'}" for a, b in zip(want["title"], want["artist"], strict=True)]
        assert got[got["mode"] == mode].sort_values("position")["line"].tolist() == lines


def test_masks_chunks_and_reasons(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0], 1), (1, [3.0, 6.0], 0), (2, [5.0, 5.0], 0)], "k int, embedding array<double>, mask int")
    assert {r["k"]: r["embedding"] for r in V.vec_mean(v, ["k"], weight="mask").collect()} == {1: [1.0, 2.0], 2: [None, None]}
    chunks = [5, 0, None, 12, 3, 1]
    rows = spark.createDataFrame(list(enumerate(chunks)), "i int, n int")
    windows, carry = sequences.carried_windows("n", Window.partitionBy(F.lit(0)).orderBy("i"), 7)
    got, left = [(r["w"], r["c"]) for r in rows.select("i", windows.alias("w"), carry.alias("c")).orderBy("i").collect()], 0
    for n, (w, c) in zip(chunks, got, strict=True):
        left += n or 0
        assert (w, c) == divmod(left, 7)
        left %= 7
    reason = lambda *x: sequences.refresh_reason(*map(F.lit, x))
    cases = [reason(-1, "a", "b", 0, 0), reason(-2, "a", "a", 1, 1), reason(4, "a", None, 1, 1), reason(4, "a", "a", 0, 1), reason(4, "a", "a", 1, 86_400_001), reason(4, "a", "a", 1, 86_400_000)]
    assert list(spark.range(1).select(*cases).head()) == [None, "count not checked yet", "database fingerprint changed", "missing freshness timestamp", "stale after 24h", None]
    assert spark.range(1).select(T.state_key(F.lit("x"), F.lit(1.0), F.lit(False), F.array().cast("array<struct<id:bigint,weight:double,negative:boolean>>"))).head()[0] == "x|1.0|false"
    assert store.available_models(spark, "nothing_of_this_name_").count() == 0
