"""Spherical k-means and assignments to centroids."""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import vectors as V
from quillon.operators.knn import BLOCK, MARGIN, blocks, cut

#: Bytes of centroids that a task holds.
CENTER_BYTES = 1 << 25


def centroids(vectors: DataFrame, key: str) -> DataFrame:
    """key, embedding: the mean vector of each group at length 1."""
    return V.vec_mean(vectors, [key]).select(key, V.l2_normalize("embedding").alias("embedding"))


def nearest(vectors: DataFrame, centers: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """id, cluster_id, score of the centroid with the greatest inner product, the least id of equals. centers: cluster_id, embedding.

    Up to CENTER_BYTES of centroids go to every task, where a batch of vectors is one product with them and what rounding can't tell apart is
    scored again; more are cut into blocks of that size, which meet blocks of vectors, and each vector's best of every block is aggregated.
    """
    c = cut(centers.select(F.col("cluster_id").cast("long").alias("cluster_id"), F.col("embedding").cast("array<double>").alias("c")))
    size = c.agg(F.sum(8.0 * F.size("c"))).head()[0] or 0.0
    n = -(-int(size) // CENTER_BYTES)
    kind = dict(centers.dtypes)["cluster_id"]
    v = vectors.select(F.col(id_col).alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    schema = "id long, cluster_id long, score double"
    if n > 1:
        out = _nearest_of_blocks(v, c, n, schema)
    elif size:
        rows = c.orderBy("cluster_id").collect()
        ids, m = np.array([r["cluster_id"] for r in rows]), np.array([r["c"] for r in rows], float)

        def run(parts):
            for pdf in parts:
                if len(pdf):
                    yield _best(pdf["id"].to_numpy(), matrix(pdf), ids, m)

        out = v.mapInPandas(run, schema)
    else:
        out = v.select("id", F.lit(0).alias("cluster_id"), F.lit(0.0).alias("score")).limit(0)
    return out.select(F.col("id").alias(id_col), F.col("cluster_id").cast(kind).alias("cluster_id"), "score")


def _best(at: np.ndarray, x: np.ndarray, ids: np.ndarray, m: np.ndarray) -> pd.DataFrame:
    """id, cluster_id, score of each vector's best center of ``m``, scored in element order as by the column expression."""
    s = x @ m.T
    top = s.max(axis=1)
    i, j = np.nonzero(s >= (top - MARGIN * np.maximum(1.0, np.abs(top)))[:, None])
    exact = np.array([sum(a * b for a, b in zip(x[p], m[q], strict=True)) for p, q in zip(i, j, strict=True)])
    order = np.lexsort((ids[j], -exact, i))
    first = order[np.append(True, i[order][1:] != i[order][:-1])]
    return pd.DataFrame({"id": at[i[first]], "cluster_id": ids[j[first]], "score": exact[first]})


def _nearest_of_blocks(v: DataFrame, c: DataFrame, n: int, schema: str) -> DataFrame:
    m = max(1, -(-v.count() // BLOCK))
    left = blocks(v, m, "id").withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    right = c.groupBy(F.pmod(F.xxhash64("cluster_id"), F.lit(n)).cast("int").alias("at")).agg(F.collect_list(F.struct("cluster_id", "c")).alias("centers"))

    def product(parts):
        for pdf in parts:
            for rows, centers in zip(pdf["rows"], pdf["centers"], strict=True):
                yield _best(*[np.array([r[k] for r in part]) for part, k in ((rows, "id"), (rows, "v"), (centers, "cluster_id"), (centers, "c"))])

    each = left.join(right, "at").select("rows", "centers").mapInPandas(product, schema)
    best = F.max_by(F.struct("cluster_id", "score"), F.struct("score", -F.col("cluster_id"))).alias("b")
    return each.groupBy("id").agg(best).select("id", "b.cluster_id", "b.score")


def seeding(points: np.ndarray, k: int, seed: int, weights: np.ndarray | None = None) -> np.ndarray:
    """k-means++ on the sphere: each next center is drawn in proportion to (1 - greatest similarity to those before) squared, times a point's weight."""
    r = np.random.default_rng(seed)
    w = np.ones(len(points)) if weights is None else weights
    out = [points[r.choice(len(points), p=w / w.sum())]]
    near = points @ out[0]
    while len(out) < min(k, len(points)):
        p = w * np.square(np.maximum(0.0, 1.0 - near))
        if p.sum() <= 0:
            break
        out.append(points[r.choice(len(points), p=p / p.sum())])
        near = np.maximum(near, points @ out[-1])
    return np.array(out)


def matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.array(pdf["embedding"].tolist(), float)


def candidates(v: DataFrame, k: int, seed: int, id_col: str, rounds: int = 5, factor: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Points to choose k centers from, and how many vectors are nearest to each: oversampling over all vectors (id_col, embedding of length 1).

    A round takes each vector with a chance of ``factor * k`` times its share of the cost, (1 - greatest similarity to the points so far) squared,
    which a hash of its id decides. So a far cluster is found however few vectors it has and wherever they stand. About ``rounds * factor * k``
    points come to the driver, whatever the number of vectors; there are more rounds only until there are k points or nothing costs anything.
    """
    u = lambda r: (F.pmod(F.xxhash64(F.lit(seed), F.lit(r), F.col(id_col)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    first = v.agg(F.min_by("embedding", F.struct(u(0), F.col(id_col))).alias("embedding")).head()["embedding"]
    points = np.array([first], float) if first is not None else np.zeros((0, 1))
    tagged = lambda r: v.withColumn("u", u(r))
    for r in count(1) if len(points) else ():
        if r > rounds and len(points) >= k:
            break

        def cost(pdf, p=points):
            near = (matrix(pdf) @ p.T).max(axis=1)
            return np.where(near < 1 - 1e-12, np.square(np.maximum(0.0, 1.0 - near)), 0.0)

        def add(parts, cost=cost):
            yield pd.DataFrame({"total": [sum(float(cost(pdf).sum()) for pdf in parts if len(pdf))]})

        total = v.mapInPandas(add, "total double").agg(F.sum("total")).head()[0] or 0.0
        if total <= 0:
            break

        def draw(parts, cost=cost, total=total):
            for pdf in parts:
                if len(pdf):
                    yield pdf[pdf["u"].to_numpy() * total < factor * k * cost(pdf)].drop(columns="u")

        more = tagged(r).mapInPandas(draw, v.schema).toPandas().sort_values(id_col)
        points = np.concatenate([points, matrix(more)]) if len(more) else points

    def nearest_point(parts, p=points):
        for pdf in parts:
            if len(pdf):
                n = np.bincount((matrix(pdf) @ p.T).argmax(axis=1), minlength=len(p))
                yield pd.DataFrame({"at": np.flatnonzero(n), "n": n[n > 0]})

    n = np.zeros(len(points))
    if len(points):
        for row in v.mapInPandas(nearest_point, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
            n[row["at"]] = row["n"]
    return points, n


#: Bits of a number of which sums over many tasks stay exact.
EXACT = 26


def kmeans(vectors: DataFrame, k: int = 200, rounds: int = 100, seed: int = 42, id_col: str = "vec_id") -> tuple[DataFrame, DataFrame]:
    """(id, cluster_id) and (cluster_id, embedding) of spherical k-means.

    Centers start from points drawn over all vectors, of which weighted k-means++ takes k. A round is one product of each batch with the centers: it adds up
    vectors by center, and a hash of ids and centers, before anything is shuffled. Rounds end when that hash stays, so when no vector changes its
    center. A center without vectors stays where it was. An empty table gives empty tables.
    """
    spark = vectors.sparkSession
    v = cut(vectors.select(F.col(id_col).cast("long").alias(id_col), V.l2_normalize("embedding").alias("embedding")))
    points, n = candidates(v, k, seed, id_col)
    if not len(points):
        return spark.createDataFrame([], f"{id_col} long, cluster_id int"), spark.createDataFrame([], "cluster_id int, embedding array<double>")
    centers = seeding(points, k, seed, n)
    before = None
    for _ in range(rounds):

        def add(parts, c=centers.copy()):
            total, digest = np.zeros_like(c), 0
            for pdf in parts:
                if len(pdf):
                    x = matrix(pdf)
                    at = (x @ c.T).argmax(axis=1)
                    np.add.at(total, at, x)
                    mixed = (pdf[id_col].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (at.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
                    digest = (digest + int(((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)).sum())) % (1 << 64)
            here = np.flatnonzero(total.any(axis=1))
            parts_of = [float((digest >> s) & ((1 << EXACT) - 1)) for s in range(0, 64, EXACT)]
            yield pd.DataFrame({"cluster_id": np.append(here, -1).astype("int32"), "embedding": [*total[here], parts_of]})

        sums = V.vec_mean(v.mapInPandas(add, "cluster_id int, embedding array<double>"), ["cluster_id"]).collect()
        now = next(row["embedding"] for row in sums if row["cluster_id"] < 0)
        if now == before:
            break
        before = now
        for row in sums:
            x = np.array(row["embedding"])
            length = np.sqrt((x * x).sum())
            if row["cluster_id"] >= 0 and length > 1e-10:
                centers[row["cluster_id"]] = x / length

    def assign(parts, c=centers):
        for pdf in parts:
            if len(pdf):
                yield pd.DataFrame({id_col: pdf[id_col], "cluster_id": (matrix(pdf) @ c.T).argmax(axis=1).astype("int32")})

    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(centers)], "cluster_id int, embedding array<double>")
    return v.mapInPandas(assign, f"{id_col} long, cluster_id int"), table


def queue_metrics(rows: DataFrame) -> DataFrame:
    """One row for a playlist (artist, cluster_id, similarity): tracks, distinct artists and clusters, least and most similar in whole percent."""
    return rows.agg(
        F.count("*").alias("tracks"),
        F.count_distinct(F.lower("artist")).alias("artists"),
        F.count_distinct("cluster_id").alias("clusters"),
        V.truncated_percent(F.min("similarity")).alias("min_percent"),
        V.truncated_percent(F.max("similarity")).alias("max_percent"),
    )


def first_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def cosine_report(pairs: DataFrame, a: str, b: str, good: float = 0.98, fair: float = 0.95) -> DataFrame:
    """One row about the cosines of two vector columns: mean, least, greatest, population deviation, shares above both limits, verdict by the mean."""
    c = pairs.select(V.cosine(a, b, 1e-10).alias("c"))
    share = lambda x: F.avg(F.when(F.col("c") > x, 1.0).otherwise(0.0))
    out = c.agg(F.count("c").alias("n"), F.avg("c").alias("mean"), F.min("c").alias("least"), F.max("c").alias("most"), F.stddev_pop("c").alias("deviation"), share(good).alias("share_good"), share(fair).alias("share_fair"))
    return out.withColumn("verdict", F.when(F.col("mean") >= good, "PASS").when(F.col("mean") >= fair, "ACCEPTABLE").otherwise("FAIL"))


def collapse_report(vectors: DataFrame, id_col: str = "vec_id", limit: float = 0.9) -> DataFrame:
    """mean_pairwise (of all pairs of unit vectors) and whether it is above the limit.

    The mean over pairs follows from the length of the sum of all vectors, so no pairs are made.
    """
    n = vectors.agg(F.count("*").alias("n"))
    total = V.vec_mean(vectors.select(F.lit(1).alias("g"), V.l2_normalize("embedding").alias("embedding")), ["g"])
    both = total.crossJoin(F.broadcast(n))
    mean = (V.dot("embedding", "embedding") * F.col("n") * F.col("n") - F.col("n")) / (F.col("n") * (F.col("n") - 1))
    return both.select(mean.alias("mean_pairwise")).withColumn("collapsed", F.col("mean_pairwise") > limit)
