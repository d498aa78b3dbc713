"""Many seeds in one plan, and k-means whose seeding sees all vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import cluster, knn, select
from quillon.plans import radio


def graph(spark, n=60, seed=0):
    r = np.random.default_rng(seed)
    rows = [(int(i), int(j), float(w)) for i in range(n) for j, w in zip(r.choice(n, 3, replace=False), r.choice([0.0, 0.2, 0.5], 3), strict=True) if i != j]
    return spark.createDataFrame(rows, "src long, dst long, weight double"), rows


def hops(rows, seed, depth=None):
    seen, front, k = {seed: 0}, [seed], 0
    while front and (depth is None or k < depth):
        k += 1
        front = sorted({d for s, d, _ in rows if s in front} - set(seen))
        seen |= dict.fromkeys(front, k)
    return seen


@pytest.mark.parametrize(("depth", "fronts"), [(None, 2), (2, 16)])
def test_hops_of_many_seeds(spark, monkeypatch, depth, fronts):
    monkeypatch.setattr(knn, "FRONTS", fronts)
    e, rows = graph(spark)
    chain = [(1000 + i, 1001 + i, 1.0) for i in range(9)]
    e, rows = e.union(spark.createDataFrame(chain, "src long, dst long, weight double")), rows + chain
    seeds = [("a", 0), ("b", 7), ("c", 1000), ("d", -5)]
    got = sorted(map(tuple, knn.hops_many(e, spark.createDataFrame(seeds, "query_id string, node long"), depth).select("query_id", "node", "hops").collect()))
    assert got == sorted((q, node, k) for q, s in seeds for node, k in hops(rows, s, depth).items())
    assert knn.hops_many(e, spark.createDataFrame([], "query_id string, node long")).count() == 0


def walk(rows, seed, alpha, steps):
    out = {}
    for s, d, w in rows:
        if w > 0:
            out.setdefault(s, set()).add(d)
    state, ends = {(seed, d): 1 / len(out[seed]) for d in out.get(seed, ())}, {}
    for step in range(1, steps + 1):
        after = {}
        for (prev, cur), p in state.items():
            free = out.get(cur, set()) - {prev}
            stop = p if not free or step == steps else p * alpha
            ends[cur] = ends.get(cur, 0) + stop
            for d in free:
                after[cur, d] = after.get((cur, d), 0) + (p - stop) / len(free)
        state = after if step < steps else {}
    return {n: m for n, m in ends.items() if n != seed}


def test_walks_of_many_seeds(spark):
    e, rows = graph(spark, 30, 3)
    seeds = [(0, 0), (1, 11), (2, 999)]
    got = {}
    for x in knn.walks_many(e, spark.createDataFrame(seeds, "query_id int, node long"), 0.4, steps=7).collect():
        got.setdefault(x["query_id"], {})[x["node"]] = x["mass"]
    for q, s in seeds:
        want = walk(rows, s, 0.4, 7)
        assert set(got.get(q, {})) == set(want) and all(abs(got[q][n] - m) < 1e-12 for n, m in want.items())


def test_a_far_cluster_outside_any_sample_gets_a_center(spark):
    """Twelve vectors of 30,000 point another way: a sample of 10,000 may miss them, the seeding doesn't."""
    base = spark.range(30_000).select(F.col("id").alias("vec_id"), F.when(F.col("id") >= 29_988, F.array(*[F.lit(x) for x in (0.0, 0.0, 1.0)])).otherwise(F.array(F.lit(1.0), F.rand(1) * 0.2, F.lit(0.0))).alias("embedding"))
    points, n = cluster.candidates(knn.cut(base.withColumn("embedding", F.transform("embedding", lambda x: x / F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, y: a + y * y))))), 2, 42, "vec_id")
    assert n.sum() == 30_000 and n[points @ [0, 0, 1] > 0.9].sum() == 12
    a, c = cluster.kmeans(base, 2)
    far = [x for x in c.collect() if x["embedding"][2] > 0.99]
    assert len(far) == 1 and a.where(F.col("cluster_id") == far[0]["cluster_id"]).select("vec_id").toPandas()["vec_id"].min() == 29_988


def test_kmeans_is_a_fixed_point(spark):
    r = np.random.default_rng(5)
    v = r.normal(size=(400, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    a, c = cluster.kmeans(d, 7)
    at = a.toPandas().sort_values("vec_id")["cluster_id"].to_numpy()
    centers = np.array([x["embedding"] for x in c.orderBy("cluster_id").collect()])
    assert len(at) == 400 and (at == (v @ centers.T).argmax(axis=1)).all()
    for k in range(7):
        m = v[at == k].sum(axis=0)
        assert np.allclose(m / np.linalg.norm(m), centers[k], atol=1e-9)
    assert sorted(map(tuple, cluster.kmeans(d, 7)[0].collect())) == sorted(map(tuple, a.collect()))
    few, _ = cluster.kmeans(d.limit(3), 10)
    assert few.count() == 3
    none = cluster.kmeans(d.limit(0), 10)
    assert none[0].count() == none[1].count() == 0


@pytest.mark.parametrize("size", [1 << 25, 100])
def test_nearest_center_by_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(cluster, "CENTER_BYTES", size)
    r = np.random.default_rng(1)
    v, c = r.normal(size=(50, 4)), r.normal(size=(9, 4))
    c[5] = c[2]
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(c)], "cluster_id int, embedding array<double>")
    got = cluster.nearest(d, e).orderBy("vec_id").toPandas()
    assert (got["cluster_id"] == (v @ c.T).argmax(axis=1)).all() and np.allclose(got["score"], (v @ c.T).max(axis=1))
    assert cluster.nearest(d, e.limit(0)).count() == 0 and dict(cluster.nearest(d, e).dtypes)["cluster_id"] == "int"


def test_walk_lists_stay_in_tasks(spark, monkeypatch):
    """Playlists by walks are the same whether tasks hold the graph or all seeds walk together, and no seed's ranking leaves a task."""
    e, rows = graph(spark, 50, 4)
    tracks = spark.createDataFrame([(i, f"A{i % 6}" if i % 7 else None, "t") for i in range(48)], "id long, artist string, title string")
    seeds = [("a", 0), ("b", 7), ("c", 999), ("d", 31)]
    begin = spark.createDataFrame(seeds, "query_id string, node long")
    config = radio.RadioConfig(tracks=9, restart=0.4, per_artist=3, spacing=2)
    monkeypatch.setattr(select, "WALK_BYTES", 8000)
    found = select.walk_lists(e, tracks, begin, 0.4, 9, 3, 2)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got, want = (sorted(map(tuple, d.collect())) for d in (found, radio.walked_together(tracks, begin, config, e)))
    assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in want] and len(got) > 20
    assert np.allclose([x[2] for x in got], [x[2] for x in want], rtol=1e-12, atol=0)
    for q, s in seeds[:2]:
        mass = walk(rows, s, 0.4, 100)
        best = sorted((n for n in mass if n < 48), key=lambda n: -mass[n])[0]
        assert best == min((x for x in got if x[0] == q), key=lambda x: x[3])[1]
    assert select.walk_lists(e, tracks, begin, 0.4, 9, 3, 2, whole=100) is None
    assert select.walk_lists(e, tracks.union(tracks), begin, 0.4, 9, 3, 2) is None
    assert select.walk_lists(e.limit(0), tracks, begin, 0.4, 9, 3, 2).count() == 0
    assert select.walk_lists(e, tracks.limit(0), begin, 0.4, 9, 3, 2).count() == 0


def test_walks_hold_a_few_numbers_for_each_node(spark):
    """A graph fits a task by its edges and tracks, however many ways lead over a hub; walks over part of it, over hubs and straight back are those of brute force."""
    n = 90
    rows = sorted({(i, 0) for i in range(1, n)} | {(0, i) for i in range(1, n, 3)} | {(i, (7 * i) % n) for i in range(1, n) if (7 * i) % n != i} | {(n, n + 1), (n + 1, n), (n + 1, n + 2)})
    graph_ = knn.Graph(np.array([a for a, _ in rows]), np.array([b for _, b in rows]), np.ones(len(rows), bool))
    for alpha, steps in ((0.4, 9), (0.5, 100)):
        starts = [graph_.place(s) for s in (0, 5, n)]
        mass, came = graph_.walks(starts, alpha, steps, 1e-12)
        for i, s in enumerate((0, 5, n)):
            want = walk([(*r, 1.0) for r in rows], s, alpha, steps)
            got = {int(graph_.ids[at]): mass[at, i] for at in np.flatnonzero(came[:, i]) if graph_.ids[at] != s}
            assert {k for k, x in want.items() if x > 0} == set(got) and all(abs(got[k] - want[k]) < 1e-9 for k in got)
        part = graph_.reached([graph_.place(n)])
        assert graph_.ids[part].tolist() == [n, n + 1, n + 2]
        alone, _ = graph_.part(part).walks([0], alpha, steps, 1e-12)
        assert np.allclose(alone[:, 0], mass[part, 2], rtol=1e-12)
    assert graph_.hops(graph_.place(5), np.array([graph_.place(x) for x in (5, 0, 4, n)])).tolist() == [0, 1, 2, -1]
    e = spark.createDataFrame([(*r, 1.0) for r in rows], "src long, dst long, weight double")
    tracks = spark.createDataFrame([(i, f"A{i % 6}") for i in range(n)], "id long, artist string")
    begin = spark.createDataFrame([("a", 5)], "query_id string, node long")
    found = select.walk_lists(e, tracks, begin, 0.4, 9, 3, 2, whole=64 * (len(rows) + n))
    assert found is not None
    got, want = (sorted((x["position"], x["id"], x["graph_hops"]) for x in d.collect()) for d in (found, radio.walked_together(tracks, begin, radio.RadioConfig(tracks=9, restart=0.4, per_artist=3, spacing=2), e)))
    assert len(got) == len(want) > 3 and [x[2] for x in got] == [x[2] for x in want]
