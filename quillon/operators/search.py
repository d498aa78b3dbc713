"""Exact vector search, ranks and keyword search.

A query set of a checked size is broadcast against all vectors, so each scan answers many queries and vectors never move.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions import vectors as V
from quillon.operators import knn

#: Query vectors that are broadcast at once.
QUERY_ROWS = 10_000
#: Queries up to which each vector meets each query by a column expression; more of them meet vectors by blocks.
FEW = 64
#: Cells into which scores from -1 to 1 are cut to rank them without sorting a query's rows in one task.
CELLS = 4096


def sized(df: DataFrame, rows: int = QUERY_ROWS) -> DataFrame:
    """``df`` for broadcast if it is small enough, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def all_similarities(vectors: DataFrame, queries: DataFrame, metric: str = "dot", id_col: str = "vec_id") -> DataFrame:
    """query_id, id, score of every vector with every query. queries: query_id, q. Vectors of another length than the query have none."""
    f = V.dot if metric == "dot" else V.cosine
    both = vectors.crossJoin(sized(queries)).where(F.size("embedding") == F.size("q"))
    return both.select("query_id", F.col(id_col), f("embedding", "q").alias("score"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "dot", id_col: str = "vec_id", exclude: DataFrame | None = None) -> DataFrame:
    """query_id, id, score, rank of the k best vectors of each query, by score and then id. exclude: query_id, id pairs to leave out.

    A window with a rank filter keeps k rows a query in each task before the shuffle; many queries meet vectors by blocks, with the same scores. NaN
    scores never rank.
    """
    if metric == "dot" and queries.limit(FEW + 1).count() > FEW:
        return _top_k_blocks(vectors, queries, k, id_col, exclude)
    s = all_similarities(vectors, queries, metric, id_col).where(~F.isnan("score"))
    if exclude is not None:
        s = s.join(sized(exclude), ["query_id", id_col], "left_anti")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _numbered(queries: DataFrame) -> DataFrame:
    """queries with a number ``id`` of each, for good."""
    return knn.cut(queries.withColumn("id", F.monotonically_increasing_id()))


def _top_k_blocks(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, exclude: DataFrame | None) -> DataFrame:
    q = _numbered(queries.select("query_id", F.col("q").alias("v")))
    out, most = F.array().cast("array<long>"), 0
    held = q.withColumn("skip", out)
    if exclude is not None:
        gone = exclude.groupBy("query_id").agg(F.collect_set(F.col(id_col).cast("long")).alias("skip"))
        held = q.join(gone, "query_id", "left").withColumn("skip", F.coalesce("skip", out))
        most = gone.agg(F.max(F.size("skip"))).head()[0] or 0
    held = held.select("id", "v", "skip", F.lit(None).cast("double").alias("mine"))
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col("embedding").alias("v"))
    near = knn.met(held, knn.least_copies(v, k + most), knn.Nearest, k)
    found = near.withColumnRenamed("src", "id").join(q.select("id", "query_id"), "id")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "dst")
    found = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("dst").cast(dict(vectors.dtypes)[id_col]).alias(id_col), "score", "rank")


def seed_query(vectors: DataFrame, seeds: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Query vectors of seeds (query_id, id)."""
    return vectors.select(id_col, F.col("embedding").alias("q")).join(sized(seeds), id_col).select("query_id", id_col, "q")


def seed_ranks(scores: DataFrame, targets: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """query_id, id, seed_rank: 1 + the rows of the query that score higher than the target; -1 if it isn't there.

    Counting rows above a target's score is a join with the (small) targets and a sum; nothing is sorted.
    """
    t = targets.join(scores, ["query_id", id_col], "left").select("query_id", id_col, F.col("score").alias("mine"))
    above = scores.select("query_id", "score").join(sized(t.where("mine IS NOT NULL")), "query_id").groupBy("query_id", id_col)
    found = above.agg((F.sum(F.when(F.col("score") > F.col("mine"), 1).otherwise(0)) + 1).cast("int").alias("seed_rank"))
    return t.join(found, ["query_id", id_col], "left").select("query_id", id_col, F.coalesce("seed_rank", F.lit(-1)).alias("seed_rank"))


def reference_ranks(vectors: DataFrame, references: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """query_id, id, seed_rank: of each pick by the vector that its query had drifted to when it was picked. references: query_id, id, q; ranks as
    in ``seed_ranks``. Each pick asks for itself, so the references of all playlists share one scan, and those of one vector its scores."""
    q = _numbered(references.select("query_id", id_col, "q"))
    own = vectors.select(id_col, "embedding").join(q, id_col).where(F.size("embedding") == F.size("q"))
    own = own.select("id", F.col("q").alias("v"), V.dot("embedding", "q").alias("mine")).where("mine IS NOT NULL")
    # references of one vector meet all others together
    own = own.groupBy("v").agg(F.min("id").alias("n"), F.collect_list(F.struct("id", "mine")).alias("x"))
    own = own.select(F.col("n").alias("id"), "v", F.col("x.id").alias("skip"), F.col("x.mine").alias("mine"))
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col("embedding").alias("v"))
    above = knn.met(own, v, knn.Above).groupBy(F.col("src").alias("id")).agg((F.sum("above") + 1).cast("int").alias("seed_rank"))
    return q.join(above, "id", "left").select("query_id", id_col, F.coalesce("seed_rank", F.lit(-1)).alias("seed_rank"))


def ranks(scores: DataFrame, group: str, score: str, tie: str) -> DataFrame:
    """scores with ``rank`` (from 0, ascending by score and then tie) and ``total`` of each group.

    Scores from -1 to 1 fall into cells; a row's rank is the number of rows in lower cells, a small table, and its place within
    its own cell. So a group with all rows is sorted by many tasks.
    """
    cell = F.least(F.lit(CELLS - 1), F.greatest(F.lit(0), F.floor((F.col(score) + 1) * (CELLS / 2)))).cast("int")
    s = scores.withColumn("__cell", cell)
    sums = s.groupBy(group, "__cell").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(group).orderBy("__cell")
    before = F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(group, "__cell", before.alias("__before"), F.sum("__n").over(Window.partitionBy(group)).alias("total"))
    own = s.withColumn("__own", F.row_number().over(Window.partitionBy(group, "__cell").orderBy(score, tie)))
    return own.join(offsets, [group, "__cell"]).withColumn("rank", F.col("__before") + F.col("__own") - 1).drop("__cell", "__before", "__own")


def contains_all(tokens: list[str], columns: list[Column | str]) -> Column:
    """Whether every token stands in the columns joined by spaces, in lower case; false without tokens."""
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns]))
    return reduce(lambda a, b: a & b, [hay.contains(t) for t in tokens]) if tokens else F.lit(False)


def keyword_search(rows: DataFrame, q: str, columns: list[str], order: list, limit: int = 50) -> DataFrame:
    """Rows in which every word of ``q`` stands somewhere in the columns, in the given order."""
    return rows.where(contains_all(T.query_tokens(q), columns)).orderBy(*order).limit(limit)


def confirmed(seeds: DataFrame, rows: DataFrame, columns: list[str], order: list[str], id_col: str) -> DataFrame:
    """seeds (seed_id, query, id) with the id of those that have none and a query that isn't blank: the first row, in the given order, that
    ``keyword_search`` finds. The others stay as they are. Seeds are few and go to the rows; each task keeps one row a seed."""
    words = F.filter(F.split(F.lower("query"), r"\s+"), lambda w: w != "")
    asked = seeds.where(F.col(id_col).isNull() & (F.trim("query") != "")).select("seed_id", words.alias("__words"))
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns]))
    found = rows.select(*dict.fromkeys([id_col, *order]), hay.alias("__hay")).crossJoin(sized(asked)).where(F.forall("__words", lambda w: F.contains("__hay", w)))
    first = found.groupBy("seed_id").agg(F.min_by(F.col(id_col), F.struct(*order)).alias("__id"))
    return seeds.join(first, "seed_id", "left").withColumn(id_col, F.coalesce(id_col, "__id")).drop("__id")


def contains_any(rows: DataFrame, q: str, columns: list[str]) -> DataFrame:
    """Rows with ``q`` in any of the columns, in either case; all rows for a blank one."""
    if not q.strip():
        return rows
    return rows.where(reduce(lambda a, b: a | b, [F.coalesce(F.lower(c).contains(q.lower()), F.lit(False)) for c in columns]))


def match_filter(title: str | None = None, artist: str | None = None, album: str | None = None, duration: int | None = None, within: int = 5) -> Column:
    """Conjunction of the given parts: title, artist or album artist, album contain; duration lies within some seconds."""
    parts = [F.lit(True)]
    if title:
        parts.append(F.col("title").contains(title))
    if artist:
        parts.append(F.coalesce(F.col("artist").contains(artist), F.lit(False)) | F.coalesce(F.col("album_artist").contains(artist), F.lit(False)))
    if album:
        parts.append(F.col("album").contains(album))
    if duration:
        parts.append(F.col("duration").between(duration - within, duration + within))
    return reduce(lambda a, b: a & b, parts)


def metadata_lookup(tracks: DataFrame, key: str) -> DataFrame:
    """The track of a metadata key by the first test that any track passes: the key, its part before the duration, artist and title, the title
    within the key; of several the least id."""
    artist, _, title = (key.split("|") + ["", "", ""])[:3]
    tests = [F.col("metadata_key") == key, F.col("metadata_key").startswith(key.rpartition("|")[0] + "|")]
    tests.append((F.lower("artist") == artist) & (F.lower("title") == title))
    tests.append(F.col("metadata_key").contains(f"|{title}|") if title else F.lit(False))
    level = F.coalesce(*[F.when(t, F.lit(i)) for i, t in enumerate(tests)])
    return tracks.withColumn("level", level).where("level IS NOT NULL").orderBy("level", "track_id").limit(1)


def blend_search(vectors: DataFrame, seeds: DataFrame, k: int, id_col: str = "vec_id", least: float = 1e-8, same: float = 0.999) -> DataFrame:
    """The k vectors nearest to the signed weighted sum of seeds (embedding, weight), leaving out near-identical ones; none if
    the sum vanishes."""
    q = seeds.agg(F.sort_array(F.collect_list(F.struct("seed_id", "weight", "embedding"))).alias("s")).select(V.blend(F.transform("s", lambda x: F.struct(x["weight"].alias("weight"), x["embedding"].alias("embedding")))).alias("b"))
    q = q.where(V.norm("b") >= least).select(F.lit(0).alias("query_id"), V.l2_normalize("b").alias("q"))
    s = all_similarities(vectors, q, id_col=id_col).where(F.col("score") <= same)
    return s.orderBy(F.desc("score"), id_col).limit(k).select(id_col, "score")


def display_similarity(vectors: DataFrame, seeds: DataFrame, id_col: str = "vec_id", least: float = 1e-12) -> DataFrame:
    """id, similarity: clamped cosine of each vector to the seeds' blend; 0 if the blend vanishes."""
    q = seeds.agg(F.sort_array(F.collect_list(F.struct("seed_id", "weight", "embedding"))).alias("s")).select(V.blend(F.transform("s", lambda x: F.struct(x["weight"].alias("weight"), x["embedding"].alias("embedding")))).alias("b"))
    q = q.select(F.coalesce(V.dot("b", "b") >= least, F.lit(False)).alias("ok"), V.l2_normalize("b").alias("q"))
    both = vectors.crossJoin(F.broadcast(q))
    return both.select(F.col(id_col), F.when(F.col("ok"), V.clamp(V.dot("embedding", "q"))).otherwise(0.0).alias("similarity"))
