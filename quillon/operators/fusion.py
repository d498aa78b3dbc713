"""Multi-seed ranking: the weighted geometric mean of percentile ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import search


def geo_mean_percentiles(vectors: DataFrame, seeds: DataFrame, k: int | None = None, exclude: DataFrame | None = None, id_col: str = "vec_id") -> DataFrame:
    """id, score by exp(sum |w| / sum |w| * ln percentile), best first.

    seeds: seed_id, embedding, weight. For each seed all vectors are ranked by similarity, reversed for a negative weight, ties by id, and
    the percentile is (rank + 1) / N. Excluded ids are dropped after the ranking, so they still take a rank. Seeds of weight 0
    don't count; a total below 1e-8 gives no rows.
    """
    used = seeds.where("weight <> 0")
    q = used.select(F.col("seed_id").alias("query_id"), F.col("embedding").alias("q"))
    w = used.groupBy().agg(F.sum(F.abs("weight")).alias("total_weight"))
    signed = search.all_similarities(vectors, q, id_col=id_col).join(F.broadcast(used.select(F.col("seed_id").alias("query_id"), "weight").crossJoin(w)), "query_id")
    signed = signed.where("total_weight >= 1e-8").withColumn("s", F.when(F.col("weight") < 0, -F.col("score")).otherwise(F.col("score")))
    r = search.ranks(signed, "query_id", "s", id_col)
    part = F.abs("weight") / F.col("total_weight") * F.ln((F.col("rank") + 1) / F.col("total"))
    fused = r.groupBy(id_col).agg(F.exp(F.sum(part)).alias("score"))
    if exclude is not None:
        fused = fused.join(search.sized(exclude.select(id_col)), id_col, "left_anti")
    fused = fused.orderBy(F.desc("score"), id_col)
    return fused.limit(k) if k else fused


def top_overlap(a: DataFrame, b: DataFrame, id_col: str, k: int = 30) -> DataFrame:
    """One row: how many of two rankings' (id, rank) first k are in both, and how many at the same rank."""
    x, y = (d.where(F.col("rank") <= k).select(F.col(id_col).alias("id"), F.col("rank").alias(n)) for d, n in ((a, "ra"), (b, "rb")))
    both = x.join(y, "id", "full_outer")
    hit = F.col("ra").isNotNull() & F.col("rb").isNotNull()
    return both.agg(F.count_if(hit).alias("shared"), F.count_if(hit & (F.col("ra") == F.col("rb"))).alias("same_rank"), F.count("ra").alias("n_a"), F.count("rb").alias("n_b"))


def redistribute(seeds: list[dict], floor: float = 0.01) -> list[dict]:
    """Seed weights (dicts of weight, locked, kind) such that sizes add up to 1.

    Locked ones stay; the others share the rest in proportion to their sizes, each song at least ``floor`` (a text may fall to 0 beside songs), equally
    if they have no size; the last unlocked one takes what rounding leaves. A handful of numbers: this runs where the user is.
    """
    free = [s for s in seeds if not s.get("locked")]
    last = max((i for i, s in enumerate(seeds) if not s.get("locked")), default=-1)
    budget = max(0.0, 1.0 - sum(abs(s["weight"]) for s in seeds if s.get("locked")))
    total = sum(abs(s["weight"]) for s in free)
    out, left = [], budget
    songs = any(s.get("kind") == "SONG" for s in seeds)
    for i, s in enumerate(seeds):
        if s.get("locked"):
            out.append(dict(s))
            continue
        least = 0.0 if s.get("kind") == "TEXT" and songs else min(floor, budget / max(1, len(free)))
        share = left if i == last else (budget / len(free) if total <= 0.001 else max(least, budget * abs(s["weight"]) / total))
        share = max(0.0, min(share, left))
        left -= share
        out.append(dict(s, weight=share if s["weight"] >= 0 else -share))
    return out
