"""Blocks that are held while others pass: the results of column expressions, each vector shuffled a bounded number of times."""

import numpy as np
from pyspark.sql import functions as F

from quillon.operators import knn, search, select


def vectors(spark, n=400, dim=6):
    r = np.random.default_rng(3)
    v = r.normal(size=(n, dim)).astype("float32")
    v[n // 2 : n // 2 + 60] = v[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(n, [1.0, 2.0]), (n + 1, [3.0, 1.0]), (n + 2, None), (n + 3, [float("nan")] * dim)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)


def got(d):
    return sorted(map(str, d.collect()))


def test_many_queries_are_as_few(spark, monkeypatch):
    v = vectors(spark)
    q = v.where("vec_id % 3 = 0 AND embedding IS NOT NULL").select(F.concat(F.lit("q"), "vec_id").alias("query_id"), "vec_id", F.col("embedding").alias("q"))
    out = q.select("query_id", "vec_id").union(q.select("query_id", F.lit(5).cast("long")))
    few = []
    for rows in (10_000, 0):
        monkeypatch.setattr(search, "FEW", rows)
        few.append(got(search.top_k(v, q.select("query_id", "q"), 7, exclude=out).select("query_id", "vec_id", "score", "rank")))
    assert few[0] == few[1] and len(few[0]) > 900


def test_ranks_of_references_count_what_scores_higher(spark):
    v = vectors(spark)
    at = v.where("vec_id % 7 = 0 AND vec_id < 400").select(F.col("vec_id").alias("query_id"), ((F.col("vec_id") + 1) % 500).alias("vec_id"), F.col("embedding").alias("q"))
    each = at.select(F.struct("query_id", "vec_id").alias("query_id"), "vec_id", "q")
    plain = search.seed_ranks(search.all_similarities(v, each.select("query_id", "q")), each.select("query_id", "vec_id")).select("query_id.query_id", "vec_id", "seed_rank")
    assert got(search.reference_ranks(v, at)) == got(plain)


def test_shuffled_copies_do_not_grow_with_the_vectors(spark, monkeypatch):
    """Blocks don't meet in pairs: a vector is shuffled GROUPS times at most, and results are those of one block."""
    v = vectors(spark, 700)
    whole = got(knn.build(v.where("vec_id < 700"), 5))
    monkeypatch.setattr(knn, "GROUP_ROWS", 10)
    monkeypatch.setattr(knn, "GROUPS", 6)
    rows = v.where("vec_id < 700").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    held = rows.withColumn("skip", F.array("id")).withColumn("mine", F.lit(None).cast("double"))
    parts = knn.met(held, rows, knn.Nearest, 5, block=16)
    assert parts.rdd.getNumPartitions() == 6
    assert got(knn.build(v.where("vec_id < 700"), 5, block=16)) == whole


def test_pools_of_many_queries(spark, monkeypatch):
    v = vectors(spark).where("vec_id < 400")
    q = v.where("vec_id % 4 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    own = q.select("query_id", F.col("query_id").alias("vec_id"))
    picks = []
    for rows in (10_000, 0):
        monkeypatch.setattr(search, "FEW", rows)
        picks.append(got(select.mmr(select.pool_of(v, q, 20, exclude=own), 8)))
    assert picks[0] == picks[1]


def test_an_update_works_out_the_old_graph_once(spark):
    v = vectors(spark, 120).where("vec_id < 120")
    new = knn.update(knn.build(v.where("vec_id % 9 <> 0"), 5), v, 5)
    assert new._jdf.queryExecution().executedPlan().toString().count("MapInArrow") <= 4
    assert got(new) == got(knn.build(v, 5))
