"""Changes to tables as DataFrame transformations: what an update, delete, upsert or queue operation leaves.

Parquet tables are replaced, not changed: each function returns the new content, and ``replace`` writes it beside the old one and
swaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` and those of ``old`` whose key it has not; of several new rows with a key one by the order of their columns."""
    n = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in new.columns if c not in keys])
    last = new.withColumn("__n", F.row_number().over(n)).where("__n = 1").drop("__n")
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last, allowMissingColumns=True)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by order; all other columns from the same row. Partial maxima are made before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__x"))
    return best.select(*keys, *[F.col(f"__x.{c}").alias(c) for c in rest])


def last_writer(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key, value of the last row of each key."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def append_with_ids(old: DataFrame, new: DataFrame, id_col: str, order: list) -> DataFrame:
    """``old`` and ``new`` with ids after the greatest so far, in order."""
    top = old.agg(F.coalesce(F.max(id_col), F.lit(-1)).alias("__top"))
    n = F.row_number().over(Window.orderBy(*order))
    fresh = new.withColumn("__n", n).crossJoin(F.broadcast(top)).withColumn(id_col, (F.col("__top") + F.col("__n")).cast("long"))
    return old.unionByName(fresh.drop("__n", "__top"), allowMissingColumns=True)


def fill_orphans(tracks: DataFrame, encoded: DataFrame, vectors: DataFrame, path: str = "file_path") -> DataFrame:
    """track_id, file_path, embedding of encoded files: under the track's own id if the path has one without a vector, else null (to insert)."""
    orphan = tracks.join(vectors.select("track_id"), "track_id", "left_anti").groupBy(path).agg(F.min("track_id").alias("track_id"))
    known = tracks.join(vectors.select("track_id"), "track_id", "left_semi").select(path)
    return encoded.join(known, path, "left_anti").join(orphan, path, "left").select("track_id", path, "embedding")


def keep_present(rows: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Rows whose key is present."""
    return rows.join(present.select(key).distinct(), key, "left_semi")


def delete_ids(tables: dict[str, DataFrame], ids: DataFrame, id_col: str) -> dict[str, DataFrame]:
    """Every table without the rows of some ids."""
    return {name: t.join(ids.select(id_col).distinct(), id_col, "left_anti") for name, t in tables.items()}


def delete_missing(tracks: DataFrame, vectors: DataFrame, files: DataFrame, path: str = "file_path") -> tuple[DataFrame, DataFrame]:
    """Tracks whose file is there, and the vectors of those: no vector is left without its track."""
    left = keep_present(tracks, files, path)
    return left, vectors.join(left.select("track_id"), "track_id", "left_semi")


def orphan_vectors(tracks: DataFrame, vectors: DataFrame) -> DataFrame:
    return vectors.join(tracks.select("track_id"), "track_id", "left_anti")


def last_n(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The last n rows of each key (of all rows without keys: a limit, so no window over everything)."""
    down = [(F.col(o) if isinstance(o, str) else o).desc() for o in order]
    if not keys:
        return rows.orderBy(*down).limit(n)
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*down))).where(F.col("__n") <= n).drop("__n")


def recent(old: DataFrame, new: DataFrame, key: str, ts: str, n: int = 10) -> DataFrame:
    """The n last distinct entries of old and new by time."""
    both = old.unionByName(new)
    return latest(both, [key], [ts]).select(*both.columns).orderBy(F.desc(ts), key).limit(n)


def queue_append(queue: DataFrame, ids: DataFrame) -> DataFrame:
    """position, file_id: the queue and then ids (position, file_id) after its greatest position."""
    top = queue.agg(F.coalesce(F.max("position"), F.lit(0)).alias("__top"))
    n = F.row_number().over(Window.orderBy("position"))
    fresh = ids.select((n + 0).alias("__n"), "file_id").crossJoin(F.broadcast(top)).select((F.col("__top") + F.col("__n")).cast("long").alias("position"), "file_id")
    return queue.select(F.col("position").cast("long").alias("position"), "file_id").unionByName(fresh)


def queue_replace(queue: DataFrame, ids: DataFrame, current: int | None) -> DataFrame:
    """The current entry, if it is queued, and then ids (position, file_id) without it."""
    kept = queue.where(F.col("file_id") == current) if current is not None else queue.limit(0)
    return queue_append(kept, ids.where(F.col("file_id") != current) if current is not None else ids)


def queue_order(ids: DataFrame, seed: int | None, anchor: int | None = None) -> DataFrame:
    """position, file_id of [anchor, seed, the others in order]."""
    lead = [x for x in (anchor, seed) if x is not None]
    spark = ids.sparkSession
    head = spark.createDataFrame([(i - len(lead), x) for i, x in enumerate(dict.fromkeys(lead))], "position long, file_id long")
    rest = ids.where(~F.col("file_id").isin(lead)) if lead else ids
    both = head.unionByName(rest.select(F.col("position").cast("long").alias("position"), "file_id"))
    return both.select(F.row_number().over(Window.orderBy("position")).cast("long").alias("position"), "file_id")


def move_hidden(ignored: DataFrame, never: DataFrame, moved: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Id sets after moving some ids from ignored to never."""
    gone = ignored.join(moved, id_col, "left_semi")
    return ignored.join(moved, id_col, "left_anti"), never.union(gone).distinct()


def replace(df: DataFrame, path: str) -> None:
    """Write ``df`` as the Parquet table at ``path``, also if it was read from there: beside it first, then swapped by renames."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    new, old = (jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.{x}") for x in ("new", "old"))
    here = jvm.org.apache.hadoop.fs.Path(path)
    fs = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(new.toString())
    fs.delete(old, True)
    if fs.exists(here) and not fs.rename(here, old):
        raise OSError(f"can't move {path}")
    if not fs.rename(new, here):
        raise OSError(f"can't move the new table to {path}")
    fs.delete(old, True)


def compact(spark, path: str, files: int) -> None:
    """The table at ``path`` in a few files."""
    replace(spark.read.parquet(path).coalesce(files), path)


def first_known(*sources: DataFrame, key: str = "id") -> DataFrame:
    """Of several sources of the same columns, for each key the row of the first source that has it."""
    from functools import reduce

    both = reduce(DataFrame.unionByName, [s.withColumn("__i", F.lit(i)) for i, s in enumerate(sources)])
    rest = [c for c in sources[0].columns if c != key]
    best = both.groupBy(key).agg(F.min_by(F.struct(*rest), "__i").alias("__x"))
    return best.select(key, *[F.col(f"__x.{c}").alias(c) for c in rest])


def available_models(spark, prefix: str = "embeddings_") -> DataFrame:
    """model, n: the tables and views of the catalog whose name begins with ``prefix``, without it, and their rows; empty ones are left out."""
    from functools import reduce

    names = sorted({t.name for t in spark.catalog.listTables() if t.name.startswith(prefix)})
    none = spark.createDataFrame([], "model string, n long")
    counts = [spark.table(f"`{x}`").agg(F.count("*").alias("n")).select(F.lit(x.removeprefix(prefix)).alias("model"), "n") for x in names]
    return reduce(DataFrame.unionByName, counts, none).where("n > 0")


def positive_setting(explicit: int | None, settings: DataFrame, key: str, default: int) -> int:
    """A setting: the explicit one, else a positive whole number stored under ``key`` (key, value), else the default."""
    if explicit is not None:
        return explicit
    row = settings.where(F.col("key") == key).select(F.try_to_number("value", F.lit("999999999")).cast("int").alias("v")).head()
    return row["v"] if row and row["v"] and row["v"] > 0 else default
