"""Structured Streaming: the latest state of each key, windows over late data, incremental upkeep of vectors and their graph."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.operators import knn, store


def latest_state(stream: DataFrame, key: str = "user_id", ts: str = "ts", value: str = "event_type") -> DataFrame:
    """key, ts, value, changes: the latest event of each key so far, told again whenever it changes; late events never take it back.

    State is one small row a key and lasts as long as the stream.
    """

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, v, n = state.get if state.exists else (None, None, 0)
        changed = False
        for pdf in parts:
            i = pdf["__t"].idxmax()
            t = int(pdf["__t"][i])
            if at is None or t > at:
                at, v, n, changed = t, pdf["__v"][i], n + 1, True
        state.update((at, v, n))
        if changed:
            yield pd.DataFrame({key: [k[0]], "ts_us": [at], "value": [v], "changes": [n]})

    rows = stream.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("__t"), F.col(value).cast("string").alias("__v"))
    kind = dict(stream.dtypes)[key]
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, ts_us long, value string, changes long", "at long, v string, n long", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, ts: str = "ts", late: str = "10 minutes", length: str = "1 hour", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums by tumbling window; a window is given once no event for it may come."""
    t = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return t.groupBy(F.window("__ts", length).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def upkeep(tables: str, k: int = 5, id_col: str = "vec_id"):
    """A foreachBatch function that upserts arriving vectors (id, embedding, ...) into ``<tables>/vectors`` and brings ``<tables>/graph`` up to date.

    A batch that comes again changes nothing: vectors are keyed by id, and the graph follows from the vectors. A vector that replaces another
    one counts as gone and new, so the graph is built in full then.
    """

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        base = tables.rstrip("/")
        known = exists(spark, f"{base}/vectors")
        old = spark.read.parquet(f"{base}/vectors") if known else batch.limit(0)
        changed = known and not old.join(batch.withColumnRenamed("embedding", "__e"), id_col).where("embedding <> __e").isEmpty()
        store.replace(store.upsert(old, batch, [id_col]), f"{base}/vectors")
        vectors = spark.read.parquet(f"{base}/vectors")
        if changed or not exists(spark, f"{base}/graph"):
            graph = knn.build(vectors, k, id_col)
        else:
            graph = knn.update(spark.read.parquet(f"{base}/graph").select("src", "rank", "dst", "score"), vectors, k, id_col)
        store.replace(knn.weights(graph), f"{base}/graph")

    return run


def exists(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def queue_sink(path: str):
    """A foreachBatch function that replaces the queue (position, file_id) by the first batch and appends later ones."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        ids = batch.select("position", "file_id")
        old = spark.read.parquet(path) if batch_id and exists(spark, path) else ids.limit(0)
        # a batch that comes again finds its own entries and leaves them out
        store.replace(store.queue_append(old, ids.join(old.select("file_id"), "file_id", "left_anti").select("position", "file_id")), path)

    return run
