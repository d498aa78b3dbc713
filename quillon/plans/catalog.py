"""All queries of the library over the driver's tables, by name, with their DuckDB SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import registry, sequences
from quillon.functions import text as T
from quillon.functions import vectors as V
from quillon.operators import cluster, fusion, knn, link, search, select, store
from quillon.plans import fixtures as X
from quillon.plans import radio
from quillon.session import table
from quillon.sources import files, snapshots
from quillon.streaming.indexing import Indexing

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with its SQL if it has one."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


@query(
    """
    SELECT e.vec_id AS vec_id, e.label AS label,
           list_inner_product(e.embedding::DOUBLE[], s.embedding::DOUBLE[]) AS score
    FROM embeddings e, (SELECT * FROM embeddings ORDER BY vec_id LIMIT 1) s
    WHERE e.vec_id <> s.vec_id ORDER BY score DESC, vec_id LIMIT 10"""
)
def top_k_similar(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    seed = e.orderBy("vec_id").limit(1).select(F.col("vec_id").alias("seed_id"), F.col("embedding").alias("q"))
    scored = e.join(F.broadcast(seed), F.col("vec_id") != F.col("seed_id"))
    return scored.select("vec_id", "label", V.dot("embedding", "q").alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


# ---- vectors -------------------------------------------------------------------------------------------------


@query(
    """
    SELECT s.vec_id AS query_id, e.vec_id AS vec_id, list_inner_product(e.embedding::DOUBLE[], s.embedding::DOUBLE[]) AS score
    FROM embeddings e, embeddings s WHERE s.vec_id IN (0, 1, 2)"""
)
def all_similarities(spark, sf_dir):
    v = X.vectors(spark, sf_dir)
    q = v.where("vec_id IN (0, 1, 2)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return search.all_similarities(v, q)


@query(
    """
    WITH s AS (SELECT s.vec_id AS query_id, e.vec_id AS vec_id, list_inner_product(e.embedding::DOUBLE[], s.embedding::DOUBLE[]) AS score
               FROM embeddings e, embeddings s WHERE s.vec_id % 20 = 0 AND e.vec_id <> s.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
    SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 10"""
)
def top_k_many(spark, sf_dir):
    v = X.vectors(spark, sf_dir)
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    out = search.top_k(v, q, 10, exclude=q.select("query_id", F.col("query_id").alias("vec_id")))
    return out.withColumn("rank", F.col("rank").cast("int"))


@query(
    """
    WITH s AS (SELECT s.vec_id AS query_id, e.vec_id AS vec_id, list_inner_product(e.embedding::DOUBLE[], s.embedding::DOUBLE[]) AS score
               FROM embeddings e, embeddings s WHERE s.vec_id IN (0, 1)),
    r AS (SELECT query_id, vec_id, rank() OVER (PARTITION BY query_id ORDER BY score DESC)::INT AS seed_rank FROM s)
    SELECT * FROM r WHERE vec_id IN (5, 17, 42)
    UNION ALL SELECT q, -5, -1 FROM (VALUES (0), (1)) t(q)"""
)
def seed_rank(spark, sf_dir):
    v = X.vectors(spark, sf_dir)
    q = v.where("vec_id IN (0, 1)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    targets = q.select("query_id", F.explode(F.array(*[F.lit(x).cast("long") for x in (5, 17, 42, -5)])).alias("vec_id"))
    return search.seed_ranks(search.all_similarities(v, q), targets)


@query(
    """
    WITH c AS (SELECT list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) /
                      (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) + 1e-10) AS c
               FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
    SELECT count(c) AS n, round(avg(c), 9) AS mean, round(min(c), 9) AS least, round(max(c), 9) AS most, round(stddev_pop(c), 9) AS deviation,
           avg(CASE WHEN c > 0.98 THEN 1.0 ELSE 0.0 END)::DOUBLE AS share_good, avg(CASE WHEN c > 0.95 THEN 1.0 ELSE 0.0 END)::DOUBLE AS share_fair,
           CASE WHEN avg(c) >= 0.98 THEN 'PASS' WHEN avg(c) >= 0.95 THEN 'ACCEPTABLE' ELSE 'FAIL' END AS verdict FROM c"""
)
def cosine_stats(spark, sf_dir):
    v = X.vectors(spark, sf_dir)
    pairs = v.select("vec_id", F.col("embedding").alias("a")).join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    out = cluster.cosine_report(pairs, "a", "b")
    return out.select("n", *[F.round(c, 9).alias(c) for c in ("mean", "least", "most", "deviation")], "share_good", "share_fair", "verdict")


@query(
    """
    WITH p AS (SELECT avg(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) /
               (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))) AS m
               FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id)
    SELECT round(m, 8) AS mean_pairwise, m > 0.9 AS collapsed FROM p"""
)
def collapse_check(spark, sf_dir):
    out = cluster.collapse_report(X.vectors(spark, sf_dir))
    return out.select(F.round("mean_pairwise", 8).alias("mean_pairwise"), "collapsed")


@query(
    """
    SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm_before,
           1.0::DOUBLE AS norm_after, true AS sane, round(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))), 9) AS abs_max FROM embeddings"""
)
def l2_normalize_check(spark, sf_dir):
    v = X.vectors(spark, sf_dir)
    n = v.withColumn("u", V.l2_normalize("embedding"))
    return n.select("vec_id", F.round(V.norm("embedding"), 6).alias("norm_before"), F.round(V.norm("u"), 6).alias("norm_after"), V.is_sane("embedding").alias("sane"), F.round(V.abs_max("embedding"), 9).alias("abs_max"))


@query(
    """
    WITH m AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
    c AS (SELECT vec_id, list_transform(v, lambda x: x - list_sum(v) / len(v)) AS c FROM m),
    d AS (SELECT vec_id, c, sqrt(list_sum(list_transform(c, lambda y: y * y)) / len(c) + 1e-7) AS d, unnest(generate_series(1, len(c))) AS i FROM c)
    SELECT vec_id, i AS place, round(c[i] / d, 6) AS signal FROM d"""
)
def signal_standardized(spark, sf_dir):
    x = X.vectors(spark, sf_dir).select("vec_id", F.posexplode(sequences.standardized("embedding")).alias("at", "x"))
    return x.select("vec_id", (F.col("at") + 1).cast("long").alias("place"), F.round("x", 6).alias("signal"))


@query(
    """
    WITH m AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE) * 1000) AS v FROM embeddings)
    SELECT vec_id, round(list_reduce(v, lambda a, x: CASE WHEN a <= 0 THEN x ELSE a * 0.7 + x * 0.3 END), 6) AS average,
           list_reduce(list_transform(v, lambda x: floor(x)::BIGINT), lambda a, x: CASE WHEN x > a AND a > 0 THEN least(x, floor(a * 1.2::DOUBLE)::BIGINT) ELSE x END) AS shown FROM m"""
)
def moving_averages(spark, sf_dir):
    v = X.vectors(spark, sf_dir).select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double")) * 1000).alias("v"))
    whole = F.transform("v", lambda x: F.floor(x).cast("long"))
    return v.select("vec_id", F.round(sequences.moving_average("v"), 6).alias("average"), sequences.damped(whole).alias("shown"))


_BLEND = (
    "WITH "
    + X.SEEDS
    + """,
    parts AS (SELECT unnest(generate_series(1, len(q))) AS i, weight * unnest(q)::DOUBLE AS x FROM seeds),
    b AS (SELECT list(s ORDER BY i) AS b FROM (SELECT i, sum(x) AS s FROM parts GROUP BY i)),
    u AS (SELECT list_transform(b, lambda x: x / sqrt(list_inner_product(b, b))) AS u FROM b)"""
)


@query(_BLEND + " SELECT vec_id, round(greatest(-1, least(1, list_inner_product(embedding::DOUBLE[], u))), 9) AS similarity FROM embeddings, u")
def display_similarity(spark, sf_dir):
    out = search.display_similarity(X.vectors(spark, sf_dir), X.seeds(spark, sf_dir))
    return out.select("vec_id", F.round("similarity", 9).alias("similarity"))


@query(_BLEND + ", s AS (SELECT vec_id, list_inner_product(embedding::DOUBLE[], u) AS score FROM embeddings, u) SELECT vec_id, round(score, 9) AS score FROM s WHERE score <= 0.999 ORDER BY s.score DESC, vec_id LIMIT 20")
def blend_search(spark, sf_dir):
    out = search.blend_search(X.vectors(spark, sf_dir), X.seeds(spark, sf_dir), 20)
    return out.select("vec_id", F.round("score", 9).alias("score"))


def _fusion_sql(seeds: str, exclude: str = "") -> str:
    return f"""
    WITH {seeds},
    s AS (SELECT seed_id, weight, vec_id, CASE WHEN weight < 0 THEN -1 ELSE 1 END * list_inner_product(embedding::DOUBLE[], q::DOUBLE[]) AS s FROM embeddings, seeds),
    r AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY s, vec_id) AS rank, count(*) OVER (PARTITION BY seed_id) AS total FROM s),
    w AS (SELECT sum(abs(weight)) AS w FROM seeds),
    f AS (SELECT vec_id, exp(sum(abs(weight) / w * ln(rank / total))) AS score FROM r, w GROUP BY vec_id)
    SELECT vec_id, round(score, 9) AS score FROM f {exclude} ORDER BY f.score DESC, vec_id LIMIT 50"""


@query(_fusion_sql(X.SEEDS.replace("-0.2", "0.2")))
def geo_mean_percentiles(spark, sf_dir):
    out = fusion.geo_mean_percentiles(X.vectors(spark, sf_dir), X.seeds(spark, sf_dir, (0.5, 0.3, 0.2)), 50)
    return out.select("vec_id", F.round("score", 9).alias("score"))


@query(_fusion_sql(X.SEEDS, "WHERE vec_id NOT IN (SELECT seed_id FROM seeds)"))
def geo_mean_negative_seed(spark, sf_dir):
    s = X.seeds(spark, sf_dir)
    out = fusion.geo_mean_percentiles(X.vectors(spark, sf_dir), s, 50, s.select("vec_id"))
    return out.select("vec_id", F.round("score", 9).alias("score"))


# ---- graphs and clusters ---------------------------------------------------------------------------------------

_EDGES = """
    pairs AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
              FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
    ranked AS (SELECT src, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst)::INT AS rank, dst, score FROM pairs),
    edges AS (SELECT * FROM ranked WHERE rank <= 5)"""
_WEIGHTS = ", weighted AS (SELECT src, rank, dst, score, greatest(score, 0) AS s, sum(greatest(score, 0)) OVER (PARTITION BY src) AS t FROM edges)"


@query("WITH " + _EDGES + " SELECT src, rank, dst, score FROM edges")
def knn_graph(spark, sf_dir):
    return knn.build(X.vectors(spark, sf_dir)).withColumn("rank", F.col("rank").cast("int"))


@query("WITH " + _EDGES + _WEIGHTS + " SELECT src, rank, dst, round(CASE WHEN t > 0 THEN s / t ELSE 0 END, 9) AS weight FROM weighted")
def knn_graph_row_weights(spark, sf_dir):
    e = knn.weights(knn.build(X.vectors(spark, sf_dir)))
    return e.select("src", F.col("rank").cast("int").alias("rank"), "dst", F.round("weight", 9).alias("weight"))


@query("WITH " + _EDGES + " SELECT src, rank, dst, score FROM edges")
def knn_incremental_equals_full(spark, sf_dir):
    v = X.vectors(spark, sf_dir)
    old = knn.build(v.where("vec_id % 9 <> 0"))
    return knn.update(old, v).withColumn("rank", F.col("rank").cast("int"))


@query("SELECT 'incremental' AS need UNION ALL SELECT 'keep' UNION ALL SELECT 'full' UNION ALL SELECT 'full'")
def graph_staleness(spark, sf_dir):
    v = X.vectors(spark, sf_dir)
    e = v.select(F.col("vec_id").alias("src"))
    needs = [knn.stale(e.where("src > 3"), v), knn.stale(e, v), knn.stale(e, v.where("vec_id > 3")), knn.stale(e.limit(0), v)]
    return spark.createDataFrame([(x,) for x in needs], "need string")


@query(
    "WITH RECURSIVE "
    + _EDGES
    + """, hop(node, hops) AS (SELECT 0::BIGINT, 0 UNION SELECT e.dst, h.hops + 1 FROM hop h JOIN edges e ON e.src = h.node WHERE h.hops < 8)
    SELECT node, min(hops)::INT AS hops FROM hop GROUP BY node"""
)
def bfs_hops(spark, sf_dir):
    return knn.bfs_hops(knn.build(X.vectors(spark, sf_dir)), 0, depth=8)


@query(
    "WITH RECURSIVE "
    + _EDGES
    + """, e AS (SELECT src, dst FROM edges WHERE score > 0), deg AS (SELECT src, count(*) AS d FROM e GROUP BY src),
    walk AS (SELECT 1 AS step, src AS prev, dst AS cur, 1.0::DOUBLE / d AS p FROM e JOIN deg USING (src) WHERE src = 0
             UNION ALL
             SELECT step + 1, cur, dst, p FROM (
               SELECT w.step, w.cur, e.dst, sum(w.p * 0.5 / (deg.d - CASE WHEN b.src IS NULL THEN 0 ELSE 1 END)) AS p
               FROM walk w JOIN e ON e.src = w.cur AND e.dst <> w.prev JOIN deg ON deg.src = w.cur LEFT JOIN e b ON b.src = w.cur AND b.dst = w.prev
               WHERE w.step < 6 GROUP BY w.step, w.cur, e.dst) x),
    ends AS (SELECT w.cur AS node, CASE WHEN w.step = 6 OR coalesce(deg.d, 0) - CASE WHEN b.src IS NULL THEN 0 ELSE 1 END = 0 THEN w.p ELSE w.p * 0.5 END AS mass
             FROM walk w LEFT JOIN deg ON deg.src = w.cur LEFT JOIN e b ON b.src = w.cur AND b.dst = w.prev)
    SELECT node, round(sum(mass), 9) AS mass FROM ends WHERE node <> 0 GROUP BY node"""
)
def random_walk_exact(spark, sf_dir):
    e = knn.weights(knn.build(X.vectors(spark, sf_dir)))
    return knn.walk_exact(e, 0, 0.5, steps=6).select("node", F.round("mass", 9).alias("mass"))


@query()
def random_walk_mc(spark, sf_dir):
    return knn.walk_monte_carlo(knn.weights(knn.build(X.vectors(spark, sf_dir))), 0, 0.5)


_CENTERS = """
    parts AS (SELECT label, unnest(generate_series(1, len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
    m AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS x FROM parts GROUP BY label, i) GROUP BY label),
    centers AS (SELECT label AS cluster_id, list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))) AS c FROM m)"""


@query("WITH " + _CENTERS + " SELECT cluster_id AS label, round(list_inner_product(c, c), 6) AS norm, round(c[1], 9) AS first FROM centers")
def cluster_centroids(spark, sf_dir):
    c = cluster.centroids(X.vectors(spark, sf_dir), "label")
    return c.select("label", F.round(V.dot("embedding", "embedding"), 6).alias("norm"), F.round(F.get("embedding", F.lit(0)), 9).alias("first"))


@query(
    "WITH "
    + _CENTERS
    + """, s AS (SELECT vec_id, cluster_id, list_inner_product(embedding::DOUBLE[], c) AS score FROM embeddings, centers),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, cluster_id) AS n FROM s)
    SELECT vec_id, cluster_id, round(score, 9) AS score FROM r WHERE n = 1"""
)
def nearest_centroid(spark, sf_dir):
    v = X.vectors(spark, sf_dir)
    c = cluster.centroids(v, "label").withColumnRenamed("label", "cluster_id")
    return cluster.nearest(v, c).select("vec_id", "cluster_id", F.round("score", 9).alias("score"))


@query()
def kmeans(spark, sf_dir):
    return cluster.kmeans(X.vectors(spark, sf_dir), 10)[0]


# ---- selection ---------------------------------------------------------------------------------------------------


def _pool(spark, sf_dir, size=100, every=20):
    v = X.vectors(spark, sf_dir)
    q = v.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return select.pool_of(v, q, size, exclude=q.select("query_id", F.col("query_id").alias("vec_id")))


@query()
def mmr_select(spark, sf_dir):
    return select.mmr(_pool(spark, sf_dir), 30)


@query(
    """
    WITH s AS (SELECT s.vec_id AS query_id, e.vec_id AS id, list_inner_product(e.embedding::DOUBLE[], s.embedding::DOUBLE[]) AS score
               FROM embeddings e, embeddings s WHERE s.vec_id % 50 = 0 AND e.vec_id <> s.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS candidate_rank FROM s)
    SELECT query_id, id, score, candidate_rank, candidate_rank AS position FROM r WHERE candidate_rank <= 30"""
)
def mmr_without_diversity_is_top_k(spark, sf_dir):
    return select.mmr(_pool(spark, sf_dir, every=50), 30, lam=1.0)


@query()
def dpp_select(spark, sf_dir):
    return select.dpp(_pool(spark, sf_dir).where("score > 0"), 30)


def _drift(spark, sf_dir, mode):
    s = X.vectors(spark, sf_dir).where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vec_id")
    return radio.playlist(X.vectors(spark, sf_dir), X.vector_tracks(spark, sf_dir), s, radio.RadioConfig(tracks=30, drift=True, drift_mode=mode))


@query()
def drift_interpolation(spark, sf_dir):
    return _drift(spark, sf_dir, "SEED_INTERPOLATION")


@query()
def drift_momentum(spark, sf_dir):
    return _drift(spark, sf_dir, "MOMENTUM")


@query()
def radio_batch(spark, sf_dir):
    s = X.vectors(spark, sf_dir).where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vec_id")
    return radio.playlist(X.vectors(spark, sf_dir), X.vector_tracks(spark, sf_dir), s)


@query()
def radio_random_walk(spark, sf_dir):
    v = X.vectors(spark, sf_dir)
    s = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vec_id")
    return radio.playlist(v, X.vector_tracks(spark, sf_dir), s, radio.RadioConfig(mode="RANDOM_WALK", tracks=30), knn.weights(knn.build(v)))


@query()
def radio_multi_seed(spark, sf_dir):
    return radio.multi_seed(X.vectors(spark, sf_dir), X.vector_tracks(spark, sf_dir), X.seeds(spark, sf_dir))


_TOP = """
    s AS (SELECT e.vec_id AS id, 'artist ' || e.label AS artist, e.label AS cluster_id, list_inner_product(e.embedding::DOUBLE[], s.embedding::DOUBLE[]) AS score
          FROM embeddings e, embeddings s WHERE s.vec_id = 0 AND e.vec_id <> 0),
    top AS (SELECT *, row_number() OVER (ORDER BY score DESC, id)::INT AS position FROM s)"""


def _top(spark, sf_dir, n):
    v = X.vectors(spark, sf_dir)
    q = v.where("vec_id = 0").select(F.lit(0).alias("query_id"), F.col("embedding").alias("q"))
    r = search.top_k(v, q, n, exclude=q.select("query_id", F.lit(0).cast("long").alias("vec_id")))
    r = r.select("query_id", F.col("vec_id").alias("id"), F.col("score").alias("similarity"), F.col("rank").cast("int").alias("position"))
    return r.join(X.vector_tracks(spark, sf_dir), "id")


@query("WITH " + _TOP + " SELECT id, artist, position FROM (SELECT *, row_number() OVER (PARTITION BY artist ORDER BY position) AS n FROM top WHERE position <= 100) WHERE n <= 4")
def post_filter_max_per_artist(spark, sf_dir):
    return select.post_filter(_top(spark, sf_dir, 100), most=4, spacing=0).select("id", "artist", "position")


@query(
    "WITH RECURSIVE "
    + _TOP
    + """, walk(position, kept) AS (
      SELECT 0, CAST([] AS VARCHAR[])
      UNION ALL
      SELECT t.position, CASE WHEN len(list_filter(w.kept, lambda x: x = t.artist)) < 8 AND NOT list_contains(w.kept[-3:], t.artist) THEN list_append(w.kept, t.artist) ELSE w.kept END
      FROM walk w JOIN top t ON t.position = w.position + 1 WHERE t.position <= 100),
    n AS (SELECT position, len(kept) AS n, lag(len(kept)) OVER (ORDER BY position) AS b FROM walk)
    SELECT t.id, t.artist, t.position FROM n JOIN top t USING (position) WHERE n.n > n.b"""
)
def post_filter_spacing(spark, sf_dir):
    return select.post_filter(_top(spark, sf_dir, 100), most=8, spacing=3).select("id", "artist", "position")


@query(
    "WITH "
    + _TOP
    + """ SELECT count(*) AS tracks, count(DISTINCT lower(artist)) AS artists, count(DISTINCT cluster_id) AS clusters,
             trunc(min(score) * 100)::INT AS min_percent, trunc(max(score) * 100)::INT AS max_percent FROM top WHERE position <= 50"""
)
def queue_metrics(spark, sf_dir):
    return cluster.queue_metrics(_top(spark, sf_dir, 50))


@query(
    """
    WITH k(kind) AS (VALUES ('NONE'), ('LINEAR'), ('EXPONENTIAL'), ('STEP')),
    s AS (SELECT event_id, kind, (event_id % 10)::BIGINT AS step, (event_id % 10) / 9.0::DOUBLE AS p FROM k, events)
    SELECT event_id, kind, step, round(CASE kind WHEN 'NONE' THEN 0.5 WHEN 'LINEAR' THEN 0.5 * (1 - p) WHEN 'STEP' THEN CASE WHEN p < 0.5 THEN 0.5 ELSE 0.1 END ELSE 0.5 * exp(-3 * p) END::DOUBLE, 9) AS alpha FROM s"""
)
def decay_schedule(spark, sf_dir):
    kinds = F.array(*[F.lit(x) for x in ("NONE", "LINEAR", "EXPONENTIAL", "STEP")])
    s = table(spark, sf_dir, "events").select("event_id", F.explode(kinds).alias("kind"), (F.col("event_id") % 10).cast("long").alias("step"))
    return s.select("event_id", "kind", "step", F.round(sequences.decay("kind", 0.5, F.col("step"), F.lit(10)), 9).alias("alpha"))


@query(
    """
    WITH i AS (SELECT vec_id, (vec_id % 20)::BIGINT AS i FROM embeddings),
    s AS (SELECT vec_id, i AS position, -1 AS source, pow(0.7, i) AS weight FROM i
          UNION ALL SELECT vec_id, i, j::INT, 0.3 * pow(0.7, i - j - 1) FROM i, range(20) t(j) WHERE j < i)
    SELECT vec_id, position, source, round(weight, 9) AS weight FROM s WHERE weight > 0.01"""
)
def ema_provenance(spark, sf_dir):
    at = (F.col("vec_id") % 20).cast("long")
    p = X.vectors(spark, sf_dir).select("vec_id", at.alias("position"), F.explode(sequences.ema_provenance(at, 0.7)).alias("s"))
    return p.select("vec_id", "position", F.col("s.source").alias("source"), F.round("s.weight", 9).alias("weight"))


@query("SELECT vec_id, (s // 120000 + CASE WHEN s % 120000 >= 24000 THEN 1 ELSE 0 END)::BIGINT AS windows FROM (SELECT vec_id, vec_id * 7919 AS s FROM embeddings)")
def window_count(spark, sf_dir):
    return X.vectors(spark, sf_dir).select("vec_id", sequences.window_count(F.col("vec_id") * 7919).alias("windows"))


@query(
    """
    SELECT vec_id, greatest(least(128 * i, vec_id - 128), 0)::BIGINT AS start, least(128, vec_id - 128 * i)::BIGINT AS weight
    FROM embeddings, range(100) t(i) WHERE 128 * i < vec_id"""
)
def segment_weights(spark, sf_dir):
    s = X.vectors(spark, sf_dir).select("vec_id", F.explode(sequences.segments(F.col("vec_id"))).alias("s"))
    return s.select("vec_id", F.col("s.start").alias("start"), F.col("s.weight").alias("weight"))


# ---- text and keys -----------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'red') AND contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'brand#1') ORDER BY p_name, p_partkey LIMIT 50")
def keyword_search_all_tokens(spark, sf_dir):
    return search.keyword_search(table(spark, sf_dir, "part"), " Red BRAND#1 ", ["p_name", "p_brand", "p_type"], ["p_name", "p_partkey"]).select("p_partkey", "p_name")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'bolt') OR contains(lower(p_type), 'bolt')")
def contains_any_column(spark, sf_dir):
    return search.contains_any(table(spark, sf_dir, "part"), "BOLT", ["p_name", "p_type"]).select("p_partkey")


@query("WITH " + X.TRACKS + " SELECT track_id, metadata_key, regexp_extract(metadata_key, '^(.*\\|)', 1) AS prefix, split_part(metadata_key, '|', 3) AS key_title FROM t")
def metadata_key(spark, sf_dir):
    return X.tracks(spark, sf_dir).select("track_id", "metadata_key", T.metadata_prefix("metadata_key").alias("prefix"), T.title_from_key("metadata_key").alias("key_title"))


@query("WITH " + X.TRACKS + " SELECT track_id FROM t WHERE starts_with(metadata_key, 'brand#1|economy|')")
def metadata_prefix_lookup(spark, sf_dir):
    return X.tracks(spark, sf_dir).where(F.col("metadata_key").startswith("brand#1|economy|")).select("track_id")


@query("WITH " + X.TRACKS + " SELECT track_id, filename_key FROM t")
def filename_key(spark, sf_dir):
    return X.tracks(spark, sf_dir).select("track_id", "filename_key")


@query("WITH " + X.RAW_TRACKS + ", " + X.LIBRARY + " SELECT file_id, unnest(filename_keys) AS filename_key FROM l")
def filename_keys_explode(spark, sf_dir):
    return X.library(spark, sf_dir).select("file_id", F.explode("filename_keys").alias("filename_key"))


@query("WITH " + X.RAW_TRACKS + ", " + X.RAW_LIBRARY + " SELECT file_id, regexp_replace(title, '(.)\\.(mp3|flac|m4a|ogg|opus|wav|wma|aac|ape|wv)$', '\\1', 'i') AS title FROM raw_library")
def strip_audio_extension(spark, sf_dir):
    return X.raw_library(spark, sf_dir).select("file_id", T.strip_audio_extension("title").alias("title"))


@query(
    """
    WITH a AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_mktsegment || ' & ' || c_name WHEN 1 THEN c_name || '; ' || c_mktsegment WHEN 2 THEN c_name || ', Mr.' ELSE c_mktsegment || ' and ' || c_name END AS a FROM customer),
    n AS (SELECT c_custkey, list_concat([a], string_split(a, ';'), string_split(a, ' / '), [string_split(a, ',')[1]]) AS n FROM a),
    v AS (SELECT c_custkey, list_transform(n, lambda x: trim(x)) AS n FROM n),
    u AS (SELECT c_custkey, unnest(list_concat(n, list_transform(n, lambda x: CASE WHEN contains(x, '&') THEN regexp_replace(x, '\\s*&\\s*', ' and ', 'g') ELSE replace(x, ' and ', ' & ') END), list_transform(n, lambda x: replace(x, '.', '')))) AS variant FROM v)
    SELECT DISTINCT c_custkey, variant FROM u"""
)
def artist_variants(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey") % 4
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    a = F.when(k == 0, F.concat(segment, F.lit(" & "), name)).when(k == 1, F.concat(name, F.lit("; "), segment)).when(k == 2, F.concat(name, F.lit(", Mr."))).otherwise(F.concat(segment, F.lit(" and "), name))
    return c.select("c_custkey", F.explode(T.artist_variants(a)).alias("variant"))


_COMPATIBLE = "({0} <= 0 OR {1} <= 0 OR abs({0} - {1}) <= 5000)"
_LOOSE = "trim(regexp_replace(regexp_replace(replace(lower({0}), ' & ', ' and '), '[^a-z0-9 ()'']', '', 'g'), '\\s+', ' ', 'g'))"
_NUMBER = "regexp_replace({0}, '^\\d+[.\\-\\s]+', '')"
_CUT = "(length({0}) BETWEEN 25 AND 30 AND starts_with({1}, {0}))"
_FUZZY = "(a = b OR " + _NUMBER.format("a") + " = b OR a = " + _NUMBER.format("b") + " OR " + _CUT.format("a", "b") + " OR " + _CUT.format("b", "a") + " OR (" + _LOOSE.format("a") + " = " + _LOOSE.format("b") + " AND " + _LOOSE.format("a") + " <> ''))"


@query("WITH " + X.BOTH + ", p AS (SELECT track_id, file_id, t.title AS a, l.title AS b FROM t JOIN l USING (artist)) SELECT track_id, file_id FROM p WHERE " + _FUZZY)
def fuzzy_title_pairs(spark, sf_dir):
    return link.fuzzy_titles(X.tracks(spark, sf_dir), X.library(spark, sf_dir))


@query("WITH " + X.BOTH + " SELECT track_id, file_id FROM t JOIN l ON t.artist = l.artist AND t.title = l.title AND " + _COMPATIBLE.format("t.duration_ms", "l.duration_ms"))
def duration_compatible_join(spark, sf_dir):
    t, lib = link.sides(X.tracks(spark, sf_dir), X.library(spark, sf_dir))
    both = t.join(lib, (F.col("t_artist") == F.col("l_artist")) & (F.col("t_title") == F.col("l_title")) & T.duration_compatible("t_duration_ms", "l_duration_ms"))
    return both.select(F.col("t_track_id").alias("track_id"), F.col("l_file_id").alias("file_id"))


# ---- reconciliation ----------------------------------------------------------------------------------------------

_OVERLAP = "(CASE WHEN trim(t.artist) = '' OR trim(l.artist) = '' THEN trim(t.artist) = '' AND trim(l.artist) = '' ELSE contains(t.artist, l.artist) OR contains(l.artist, t.artist) END)"
_CASCADE = (
    X.BOTH
    + f""",
    n AS (SELECT l.*, unnest(filename_keys) AS name FROM l),
    c AS (
      SELECT 0 AS level, t.track_id, l.file_id FROM t JOIN l ON t.file_path = l.path
      UNION ALL SELECT 1, t.track_id, l.file_id FROM t JOIN l ON t.metadata_key = l.metadata_key
      UNION ALL SELECT 2, t.track_id, l.file_id FROM t JOIN l ON t.artist = l.artist AND t.album = l.album AND t.title = l.title WHERE t.title <> ''
      UNION ALL SELECT 3, t.track_id, n.file_id FROM t JOIN n ON t.filename_key = n.name WHERE t.filename_key <> ''
      UNION ALL SELECT 4, t.track_id, l.file_id FROM t JOIN l ON t.artist = l.artist AND t.title = l.title WHERE t.title <> ''
      UNION ALL SELECT 5, t.track_id, l.file_id FROM t JOIN l ON t.title = l.title AND {_OVERLAP} WHERE t.title <> ''),
    s AS (SELECT c.level, t.track_id, l.file_id, [(t.file_path IS DISTINCT FROM l.path OR l.path IS NULL)::INT, (t.metadata_key <> l.metadata_key)::INT, (t.artist <> l.artist)::INT, (t.title <> l.title)::INT, (t.album <> l.album)::INT,
                 CASE WHEN t.duration_ms > 0 AND l.duration_ms > 0 THEN abs(t.duration_ms - l.duration_ms) ELSE 0 END] AS score
          FROM c JOIN t USING (track_id) JOIN l USING (file_id) WHERE {_COMPATIBLE.format("t.duration_ms", "l.duration_ms")}),
    m AS (SELECT track_id, file_id, ['PATH', 'METADATA_EXACT', 'ARTIST_ALBUM_TITLE', 'FILENAME', 'ARTIST_TITLE', 'FUZZY'][level + 1] AS match_type,
                 row_number() OVER (PARTITION BY track_id ORDER BY level, score, file_id) AS by_track, row_number() OVER (PARTITION BY file_id ORDER BY level, score, track_id) AS by_file FROM s)"""
)


@query("WITH " + _CASCADE + " SELECT track_id, file_id, match_type FROM m WHERE by_track = 1")
def cascade_match(spark, sf_dir):
    return link.cascade(X.tracks(spark, sf_dir), X.library(spark, sf_dir))


@query("WITH " + _CASCADE + " SELECT track_id, file_id, match_type FROM m WHERE by_file = 1")
def cascade_match_reverse(spark, sf_dir):
    return link.cascade(X.tracks(spark, sf_dir), X.library(spark, sf_dir), per="file_id")


@query("WITH " + _CASCADE + " SELECT coalesce(match_type, 'NOT_FOUND') AS match_type, count(*) AS n FROM t LEFT JOIN (SELECT * FROM m WHERE by_track = 1) m USING (track_id) GROUP BY 1")
def match_type_counts(spark, sf_dir):
    t = X.tracks(spark, sf_dir)
    return link.match_counts(t, link.cascade(t, X.library(spark, sf_dir)))


@query(
    "WITH "
    + X.BOTH
    + """, a AS (SELECT track_id, metadata_key, row_number() OVER (PARTITION BY metadata_key ORDER BY track_id) AS i FROM t),
    b AS (SELECT file_id, metadata_key, row_number() OVER (PARTITION BY metadata_key ORDER BY file_id) AS i FROM l)
    SELECT track_id, file_id FROM a JOIN b USING (metadata_key, i)"""
)
def exact_key_pairing(spark, sf_dir):
    return link.pair_exact(X.tracks(spark, sf_dir), X.library(spark, sf_dir), "metadata_key", "metadata_key")


@query()
def grouped_duration_pairing(spark, sf_dir):
    return link.pair_by_duration(X.tracks(spark, sf_dir), X.library(spark, sf_dir), ["artist", "title"])


@query()
def filename_pairing(spark, sf_dir):
    return link.pair_filename(X.tracks(spark, sf_dir), X.library(spark, sf_dir))


@query()
def fuzzy_pairing(spark, sf_dir):
    return link.pair_fuzzy(X.tracks(spark, sf_dir), X.library(spark, sf_dir))


@query()
def library_sync_report(spark, sf_dir):
    return link.sync_report(X.tracks(spark, sf_dir), X.library(spark, sf_dir))[0]


@query()
def unindexed_anti_join(spark, sf_dir):
    t = X.tracks(spark, sf_dir).where("track_id % 4 <> 0")
    return link.unindexed(t, X.library(spark, sf_dir)).select("file_id", "metadata_key")


@query()
def db_only(spark, sf_dir):
    t = X.tracks(spark, sf_dir)
    files = t.where("track_id % 4 <> 0").select("file_path")
    return link.db_only(t, X.library(spark, sf_dir), files, ["/music"]).select("track_id")


@query()
def failure_categories(spark, sf_dir):
    t = knn.cut(X.tracks(spark, sf_dir).where("track_id % 4 <> 0"))
    return link.failures(link.unindexed(t, X.library(spark, sf_dir)), t)


@query("WITH " + X.BOTH + " SELECT metadata_key, min(file_id) AS file_id FROM l GROUP BY metadata_key")
def first_per_key(spark, sf_dir):
    return cluster.first_per_key(X.library(spark, sf_dir), ["metadata_key"], ["file_id"]).select("metadata_key", "file_id")


@query(
    "WITH "
    + _CASCADE
    + """, r AS (SELECT track_id, track_id + 1 AS rank, m.file_id FROM t LEFT JOIN (SELECT * FROM m WHERE by_track = 1) m USING (track_id)),
    d AS (SELECT *, CASE WHEN file_id IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY file_id ORDER BY rank) END AS n FROM r)
    SELECT track_id, rank, file_id, CASE WHEN file_id IS NULL THEN 'NOT_IN_LIBRARY' WHEN file_id % 8 <> 0 THEN 'QUEUED' ELSE 'QUEUE_FAILED' END AS status FROM d WHERE n = 1"""
)
def queue_status(spark, sf_dir):
    t, lib = X.tracks(spark, sf_dir), X.library(spark, sf_dir)
    return link.queue_status(t.select("track_id", (F.col("track_id") + 1).alias("rank")), link.cascade(t, lib), lib.where("file_id % 8 <> 0"))


# ---- tables, queues, logs, events ----------------------------------------------------------------------------------


@query("SELECT * FROM (SELECT user_id, ts, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1".replace("SELECT *", "SELECT user_id, ts, event_type, value", 1))
def latest_event_per_user(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return store.latest(e, ["user_id"], ["ts", "event_id"]).select("user_id", "ts", "event_type", "value")


@query(
    """
    WITH new AS (SELECT p_partkey, p_name || '!' AS p_name FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT p_partkey + 10000000, p_name FROM part WHERE p_partkey < 10)
    SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM new) UNION ALL SELECT * FROM new"""
)
def upsert_latest(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    new = p.where("p_partkey % 5 = 0").withColumn("p_name", F.concat("p_name", F.lit("!"))).union(p.where("p_partkey < 10").select(F.col("p_partkey") + 10_000_000, "p_name"))
    return store.upsert(p, new, ["p_partkey"])


@query("SELECT user_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last_writer_wins(spark, sf_dir):
    return store.last_writer(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query("WITH " + X.RAW_TRACKS + ", f AS (SELECT file_path FROM raw_tracks WHERE track_id % 4 <> 0) SELECT track_id FROM raw_tracks WHERE file_path IN (SELECT file_path FROM f)")
def delete_missing(spark, sf_dir):
    t = X.raw_tracks(spark, sf_dir)
    files = t.where("track_id % 4 <> 0").select("file_path")
    return store.delete_missing(t, t.select("track_id"), files)[1]


@query("SELECT vec_id AS track_id FROM embeddings WHERE vec_id NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0)")
def orphan_vectors(spark, sf_dir):
    t = table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("track_id"))
    return store.orphan_vectors(t, X.vectors(spark, sf_dir).select(F.col("vec_id").alias("track_id")))


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def session_history_last_n(spark, sf_dir):
    return store.last_n(table(spark, sf_dir, "events"), [], ["ts", "event_id"], 200).select("event_id")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 5")
def history_per_user(spark, sf_dir):
    return store.last_n(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 5).select("user_id", "event_id")


@query("WITH r AS (SELECT user_id || ':' || event_type AS state_key, max(event_id) AS event_id FROM events GROUP BY 1) SELECT state_key, event_id FROM r ORDER BY event_id DESC LIMIT 10")
def recent_search_dedupe(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.col("user_id").cast("string"), F.lit(":"), "event_type").alias("state_key"), "event_id")
    return store.recent(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "state_key", "event_id")


def _queue(spark, sf_dir):
    e = X.vectors(spark, sf_dir).select("vec_id")
    return e.where("vec_id < 20").select((F.col("vec_id") * 2).alias("position"), F.col("vec_id").alias("file_id")), e.where("vec_id BETWEEN 15 AND 30").select((100 - F.col("vec_id")).alias("position"), F.col("vec_id").alias("file_id"))


@query("SELECT vec_id * 2 AS position, vec_id AS file_id FROM embeddings WHERE vec_id < 20 UNION ALL SELECT 38 + row_number() OVER (ORDER BY vec_id DESC), vec_id FROM embeddings WHERE vec_id BETWEEN 15 AND 30")
def queue_append(spark, sf_dir):
    return store.queue_append(*_queue(spark, sf_dir))


@query("SELECT 32 AS position, 16 AS file_id UNION ALL SELECT 32 + row_number() OVER (ORDER BY vec_id DESC), vec_id FROM embeddings WHERE vec_id BETWEEN 15 AND 30 AND vec_id <> 16")
def queue_replace(spark, sf_dir):
    return store.queue_replace(*_queue(spark, sf_dir), 16)


@query("SELECT 1 AS position, 3 AS file_id UNION ALL SELECT 2, 20 UNION ALL SELECT 2 + row_number() OVER (ORDER BY vec_id DESC), vec_id FROM embeddings WHERE vec_id BETWEEN 15 AND 30 AND vec_id <> 20")
def queue_order(spark, sf_dir):
    return store.queue_order(_queue(spark, sf_dir)[1], 20, 3)


@query("SELECT 'ignored' AS list, vec_id AS id FROM embeddings WHERE vec_id < 10 AND vec_id % 3 <> 0 UNION ALL SELECT 'never', vec_id FROM embeddings WHERE vec_id BETWEEN 20 AND 24 OR (vec_id < 10 AND vec_id % 3 = 0)")
def hidden_id_sets(spark, sf_dir):
    e = X.vectors(spark, sf_dir).select(F.col("vec_id").alias("id"))
    a, b = store.move_hidden(e.where("id < 10"), e.where("id BETWEEN 20 AND 24"), e.where("id % 3 = 0"))
    return a.select(F.lit("ignored").alias("list"), "id").union(b.select(F.lit("never").alias("list"), "id"))


_TWO = """
    s AS (SELECT s.vec_id AS q, e.vec_id AS id, row_number() OVER (PARTITION BY s.vec_id ORDER BY list_inner_product(e.embedding::DOUBLE[], s.embedding::DOUBLE[]) DESC, e.vec_id) AS rank
          FROM embeddings e, embeddings s WHERE s.vec_id IN (0, 1))"""


@query("WITH " + _TWO + " SELECT count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL) AS shared, count(*) FILTER (a.rank = b.rank) AS same_rank, count(a.id) AS n_a, count(b.id) AS n_b FROM (SELECT * FROM s WHERE q = 0 AND rank <= 100) a FULL JOIN (SELECT * FROM s WHERE q = 1 AND rank <= 100) b ON a.id = b.id")
def ranking_overlap(spark, sf_dir):
    v = X.vectors(spark, sf_dir)
    r = [search.top_k(v, v.where(F.col("vec_id") == i).select(F.lit(i).alias("query_id"), F.col("embedding").alias("q")), 100) for i in (0, 1)]
    return fusion.top_overlap(*r, "vec_id", 100)


@query("SELECT vec_id AS query_line, 'q' || vec_id AS text, CASE WHEN vec_id % 5 = 4 THEN 1 ELSE 2 END AS results FROM embeddings WHERE vec_id < 50")
def replay_log_pairing(spark, sf_dir):
    return _replayed(X.vectors(spark, sf_dir).where("vec_id < 50"))


@query("SELECT vec_id AS query_line, 'q' || vec_id AS text, CASE WHEN vec_id % 5 = 4 THEN 1 ELSE 2 END AS results FROM embeddings")
def replay_log_whole(spark, sf_dir):
    return _replayed(X.vectors(spark, sf_dir))


def _replayed(e):
    """A log with a query and a result of every vector, every fifth result cut off, as read again."""
    i = F.col("vec_id")
    one = lambda r: F.concat(F.lit('{"rank":'), F.lit(str(r)), F.lit(',"track_id":'), i.cast("string"), F.lit(',"score":0.5}'))
    whole = F.concat(F.lit("["), one(1), F.lit(","), one(2), F.lit("]"))
    cut = F.concat(F.lit("["), one(1), F.lit(',{"rank":2,"tra'))
    asked = e.select((i * 2).alias("line"), F.concat(F.lit('x MULTISEED_QUERY: {"text":"q'), i.cast("string"), F.lit('","seeds":[]}')).alias("value"))
    given = e.select((i * 2 + 1).alias("line"), F.concat(F.lit("y MULTISEED_RESULTS: "), F.when(i % 5 == 4, cut).otherwise(whole)).alias("value"))
    out = files.replay_log(asked.union(given))
    return out.select((F.col("query_line") / 2).cast("long").alias("query_line"), F.col("query.text").alias("text"), F.size("results").alias("results"))


@query("SELECT 'embeddings' AS name, count(*) AS n FROM embeddings UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'part', count(*) FROM part")
def store_summary(spark, sf_dir):
    return radio.info({n: table(spark, sf_dir, n) for n in ("part", "events", "embeddings")})


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_by_hour(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("hour", "ts").alias("window_start"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    """
    SELECT label, round(avg(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 9) AS dots, round(avg(1.0), 9)::DOUBLE AS cosines FROM embeddings GROUP BY label"""
)
def sql_functions(spark, sf_dir):
    registry.register(spark)
    X.vectors(spark, sf_dir).select("label", F.col("embedding").cast("array<double>").alias("e")).createOrReplaceTempView("quillon_vectors")
    return spark.sql("SELECT label, round(avg(dot(e, e)), 9) AS dots, round(avg(cosine(e, l2_normalize(e))), 9) AS cosines FROM quillon_vectors GROUP BY label")


@query("SELECT vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN 'sticky' WHEN vec_id % 3 = 0 THEN 'memory' ELSE 'stored' END AS source FROM embeddings")
def current_track_of_three_sources(spark, sf_dir):
    e = X.vectors(spark, sf_dir).select(F.col("vec_id").alias("id"))
    return store.first_known(e.where("id % 2 = 0").withColumn("source", F.lit("sticky")), e.where("id % 3 = 0").withColumn("source", F.lit("memory")), e.withColumn("source", F.lit("stored")))


@query(
    """
    SELECT label, i AS place, round(sum(x * (vec_id % 3 <> 0)::INT) / nullif(sum((vec_id % 3 <> 0)::INT), 0), 6) AS mean
    FROM (SELECT label, vec_id, unnest(embedding::DOUBLE[]) AS x, unnest(generate_series(1, len(embedding))) AS i FROM embeddings) GROUP BY 1, 2"""
)
def masked_mean_pooling(spark, sf_dir):
    v = X.vectors(spark, sf_dir).select("label", "embedding", F.when(F.col("vec_id") % 3 != 0, 1).otherwise(0).alias("mask"))
    means = V.vec_mean(v, ["label"], weight="mask").select("label", F.posexplode("embedding").alias("at", "mean"))
    return means.select("label", (F.col("at") + 1).cast("long").alias("place"), F.round("mean", 6).alias("mean"))


@query(
    """
    WITH p AS (SELECT user_id, event_id, event_id * 7919 % 300 AS samples FROM events),
    s AS (SELECT *, sum(samples) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS so_far FROM p)
    SELECT event_id, so_far // 120 - (so_far - samples) // 120 AS windows, so_far % 120 AS carry FROM s"""
)
def carried_tail_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") * 7919 % 300).alias("samples"))
    windows, carry = sequences.carried_windows("samples", Window.partitionBy("user_id").orderBy("event_id"), 120)
    return e.select("event_id", windows.alias("windows"), carry.alias("carry"))


@query(
    """
    SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN 'count not checked yet' WHEN event_id % 7 <> 0 THEN 'database fingerprint changed'
           WHEN event_id % 3 = 0 THEN 'missing freshness timestamp' WHEN event_id % 48 >= 24 THEN 'stale after 24h' END AS reason FROM events"""
)
def refresh_reasons(spark, sf_dir):
    n = F.col("event_id")
    hour = 3_600_000
    count = F.when(n % 5 == 0, -1).when(n % 5 == 1, -2).otherwise(n % 5)
    checked = F.when(n % 3 != 0, F.lit(hour))
    reason = sequences.refresh_reason(count, n % 7, F.lit(0), checked, (n % 48 + 1) * hour)
    return table(spark, sf_dir, "events").select("event_id", reason.alias("reason"))


@query("SELECT vec_id, 'song ' || label || '|0.5|' || (vec_id % 2 = 0)::VARCHAR || '|' || vec_id || ':1.5:false|' || label || ':0.25:true' AS state_key FROM embeddings")
def search_state_keys(spark, sf_dir):
    seed = lambda i, w, no: F.struct(F.col(i).cast("long").alias("id"), F.lit(w).alias("weight"), F.lit(no).alias("negative"))
    key = T.state_key(F.concat(F.lit("song "), F.col("label").cast("string")), F.lit(0.5), F.col("vec_id") % 2 == 0, F.array(seed("vec_id", 1.5, False), seed("label", 0.25, True)))
    return X.vectors(spark, sf_dir).select("vec_id", key.alias("state_key"))


@query(
    """
    WITH t AS (SELECT s.vec_id AS query_id, p.vec_id AS vec_id, s.embedding::DOUBLE[] AS q, list_inner_product(p.embedding::DOUBLE[], s.embedding::DOUBLE[]) AS mine
               FROM embeddings s JOIN embeddings p ON p.vec_id = s.vec_id + 1 WHERE s.vec_id % 20 = 0)
    SELECT t.query_id AS query_id, t.vec_id AS vec_id, (1 + count(*) FILTER (WHERE list_inner_product(e.embedding::DOUBLE[], t.q) > t.mine))::INT AS seed_rank
    FROM t, embeddings e GROUP BY 1, 2"""
)
def drift_reference_ranks(spark, sf_dir):
    v = X.vectors(spark, sf_dir)
    at = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), (F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("q"))
    return search.reference_ranks(v, at.join(v.select("vec_id"), "vec_id", "left_semi"))


@query(
    """
    WITH s(seed_id, query, p_partkey) AS (VALUES (1, ' Red BRAND#1 ', NULL), (2, 'bolt', NULL), (3, ' ', NULL), (4, 'no such part', NULL), (5, 'red', 7)),
    w AS (SELECT *, list_filter(string_split(lower(query), ' '), lambda x: x <> '') AS w FROM s),
    f AS (SELECT w.seed_id, p.p_partkey, row_number() OVER (PARTITION BY w.seed_id ORDER BY p_name, p.p_partkey) AS n
          FROM w JOIN part p ON len(w) > 0 AND len(list_filter(w, lambda x: NOT contains(lower(p_name || ' ' || p_brand || ' ' || p_type), x))) = 0)
    SELECT w.seed_id AS seed_id, w.query AS query, coalesce(w.p_partkey, f.p_partkey)::BIGINT AS p_partkey FROM w LEFT JOIN f ON f.seed_id = w.seed_id AND f.n = 1"""
)
def auto_confirmed_seeds(spark, sf_dir):
    seeds = spark.createDataFrame([(1, " Red BRAND#1 ", None), (2, "bolt", None), (3, " ", None), (4, "no such part", None), (5, "red", 7)], "seed_id int, query string, p_partkey long")
    return search.confirmed(seeds, table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"], ["p_name", "p_partkey"], "p_partkey").withColumn("p_partkey", F.col("p_partkey").cast("long"))


@query("SELECT 'quillon_even' AS model, count(*) AS n FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT 'quillon_odd', count(*) FROM embeddings WHERE vec_id % 2 = 1")
def available_models(spark, sf_dir):
    v = X.vectors(spark, sf_dir)
    for name, rows in (("even", "vec_id % 2 = 0"), ("odd", "vec_id % 2 = 1"), ("none", "vec_id < 0")):
        v.where(rows).createOrReplaceTempView(f"embeddings_quillon_{name}")
    found = store.available_models(spark)
    for name in ("even", "odd", "none"):
        spark.catalog.dropTempView(f"embeddings_quillon_{name}")
    return found


@query(
    """
    WITH k AS (SELECT DISTINCT p_name AS k FROM part), e AS (SELECT 'first' AS label, min(p_name) AS k, true AS present FROM part UNION ALL SELECT 'last', max(p_name), false FROM part
               UNION ALL SELECT 'absent', 'no such part', false UNION ALL SELECT 'lost', 'nor this', true)
    SELECT label, k.k IS NOT NULL AS shown, CASE WHEN (k.k IS NOT NULL) = present THEN 'PASS' ELSE 'FAIL' END AS verdict FROM e LEFT JOIN k ON e.k = k.k"""
)
def presence_battery(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("metadata_key"))
    ends = p.agg(F.min("metadata_key").alias("a"), F.max("metadata_key").alias("b"))
    row = lambda label, key, present: F.struct(F.lit(label).alias("label"), key.alias("metadata_key"), F.lit(present).alias("present"))
    rows = [row("first", F.col("a"), True), row("last", F.col("b"), False), row("absent", F.lit("no such part"), False), row("lost", F.lit("nor this"), True)]
    return link.presence(p, ends.select(F.inline(F.array(*rows))))


@query()
def radio_preview(spark, sf_dir):
    v = X.vectors(spark, sf_dir)
    s = v.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), "vec_id")
    return radio.preview(v, X.vector_tracks(spark, sf_dir), s, edges=knn.weights(knn.build(v)))


# ---- tables that change together, results worked out once --------------------------------------------------------


def _scratch(spark, name: str) -> str:
    return f"{(spark.conf.get('spark.checkpoint.dir', None) or knn.own_folder()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(
    """
    SELECT 1 AS version, 'tracks' AS name, count(*) AS n, false AS stale FROM part UNION ALL SELECT 1, 'vectors', count(*), false FROM embeddings
    UNION ALL SELECT 1, 'clusters', count(DISTINCT label), false FROM embeddings
    UNION ALL SELECT 2, 'tracks', count(*), false FROM part WHERE p_partkey % 4 <> 0 UNION ALL SELECT 2, 'vectors', count(*), false FROM embeddings WHERE vec_id % 4 <> 0
    UNION ALL SELECT 2, 'clusters', count(DISTINCT label), true FROM embeddings
    UNION ALL SELECT 3, 'tracks', count(*), false FROM part WHERE p_partkey % 4 <> 0 UNION ALL SELECT 3, 'vectors', count(*), false FROM embeddings WHERE vec_id % 4 <> 0"""
)
def store_snapshots(spark, sf_dir):
    """An import of three tables, a deletion from two of them, and an index taken away: each one commit."""
    s = snapshots.Store(spark, _scratch(spark, "store"))
    tracks, v = X.raw_tracks(spark, sf_dir), X.vectors(spark, sf_dir)
    s.commit({"tracks": tracks, "vectors": v, "clusters": cluster.centroids(v, "label")}, {"clusters": ["vectors"]})
    now = s.snapshot()
    s.commit({"tracks": now["tracks"].where("track_id % 4 <> 0"), "vectors": now["vectors"].where("vec_id % 4 <> 0")})
    s.commit({"clusters": None})
    counts = [
        t.agg(F.count("*").alias("n")).select(F.lit(k).alias("version"), F.lit(n).alias("name"), "n", F.lit(n in s.stale(k)).alias("stale"))
        for k in s.versions() for n, t in s.snapshot(k).items()
    ]
    return reduce(DataFrame.union, counts)


@query("WITH " + X.BOTH + " SELECT file_id, metadata_key FROM l WHERE metadata_key NOT IN (SELECT metadata_key FROM t WHERE track_id % 4 <> 0)")
def cached_detection(spark, sf_dir):
    """Entries without a track of their key, worked out once for one state of both catalogs: the second call reads the first one's table."""
    t, lib = knn.cut(X.tracks(spark, sf_dir).where("track_id % 4 <> 0")), knn.cut(X.library(spark, sf_dir))
    key = (*snapshots.fingerprint(t, ["track_id", "metadata_key"]), *snapshots.fingerprint(lib, ["file_id", "metadata_key"]))
    folder = _scratch(spark, "detections")
    found = lambda: lib.join(t, "metadata_key", "left_anti").select("file_id", "metadata_key")
    snapshots.cached(spark, folder, key, found)
    return snapshots.cached(spark, folder, key, found)


@query(
    """
    SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 1 WHEN vec_id % 3 = 1 THEN 2 ELSE 3 END::BIGINT AS entry, vec_id % 3 = 1 AS staged_before,
           list_max(embedding[1:len(embedding) // 4])::DOUBLE AS first_window, list_max(embedding[3 * (len(embedding) // 4) + 1:4 * (len(embedding) // 4)])::DOUBLE AS last_window
    FROM embeddings"""
)
def resumed_indexing(spark, sf_dir):
    """Maxima of windows, taken in three runs over more and more of the rows. The second finds features that a run before it, which then
    stopped, had kept."""
    v = X.vectors(spark, sf_dir)
    quarter = F.floor(F.size("embedding") / 4).cast("int")
    windows = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.array_max(F.slice("embedding", i * quarter + 1, quarter)).cast("double"))
    origin = {"name": "run"}
    extract = lambda d: d.select("vec_id", windows.alias("windows"), F.lit(origin["name"]).alias("origin"))
    encode = lambda f: f.select("vec_id", "windows", "origin")
    kind = "vec_id long, windows array<double>, origin string"
    x = Indexing(spark, _scratch(spark, "indexing"), extract, encode, kind, kind, id_col="vec_id", usable=F.size("windows") == 4, per_task=10_000)
    x.run(v.where("vec_id % 3 = 0"))
    origin["name"] = "stopped"
    x.stage(v.where("vec_id % 3 = 1"))
    origin["name"] = "run"
    x.run(v.where("vec_id % 3 < 2"))
    x.run(v)
    w = F.col("windows")
    return x.vectors().select("vec_id", "entry", (F.col("origin") == "stopped").alias("staged_before"), w[0].alias("first_window"), w[3].alias("last_window"))


# ---- lookups that fall back ------------------------------------------------------------------------------------


@query(
    "WITH "
    + X.RAW_TRACKS
    + ", "
    + X.RAW_LIBRARY
    + """,
    asked AS (SELECT file_id, artist, CASE WHEN file_id % 4 <> 0 THEN album END AS album, title FROM raw_library),
    found AS (
      SELECT file_id, track_id, 1 AS level FROM asked a JOIN raw_tracks t ON t.artist = a.artist AND t.album = a.album AND t.title = a.title
      UNION ALL SELECT file_id, track_id, 2 FROM asked a JOIN raw_tracks t ON t.artist = a.artist AND t.title = a.title
      UNION ALL SELECT file_id, track_id, 3 FROM asked a JOIN raw_tracks t ON lower(t.artist) = lower(a.artist) AND lower(t.title) = lower(a.title))
    SELECT file_id, track_id, level FROM found QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY level, track_id) = 1"""
)
def fallback_lookup(spark, sf_dir):
    """Entries of a second catalog, looked up by artist, album and title, then by artist and title, then by these in either case."""
    asked = X.raw_library(spark, sf_dir).withColumn("album", F.when(F.col("file_id") % 4 != 0, F.col("album")))
    same = lambda *names: [(F.col(n), F.col(n)) for n in names]
    loose = [(F.lower(n), F.lower(n)) for n in ("artist", "title")]
    return link.fallback(asked, X.raw_tracks(spark, sf_dir), [same("artist", "album", "title"), same("artist", "title"), loose], "file_id", "track_id")


_VARIANT_SQL = """
    WITH n AS (SELECT c_custkey, trim(c_name) AS s, list_concat([c_name], string_split(c_name, ';'), string_split(c_name, ' / '), [string_split(c_name, ',')[1]]) AS n
               FROM (SELECT c_custkey, c_mktsegment || ' & ' || c_name || ', Jr.; ' || c_name AS c_name FROM customer)),
    v AS (SELECT c_custkey, list_transform(n, lambda x: trim(x)) AS n FROM n),
    u AS (SELECT c_custkey, unnest(list_concat(n, list_transform(n, lambda x: CASE WHEN contains(x, '&') THEN regexp_replace(x, '\\s*&\\s*', ' and ', 'g') ELSE replace(x, ' and ', ' & ') END), list_transform(n, lambda x: replace(x, '.', '')))) AS variant FROM v)
    SELECT DISTINCT c_custkey, variant FROM u"""


@query(_VARIANT_SQL)
def artist_variants_of_sql(spark, sf_dir):
    """The table function artist_variants, called for every row."""
    registry.register(spark)
    a = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_mktsegment", F.lit(" & "), "c_name", F.lit(", Jr.; "), "c_name").alias("artist"))
    return spark.sql("SELECT c_custkey, variant FROM {a}, LATERAL artist_variants(artist)", a=a)
