import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import knn
from quillon.sources import files
from quillon.streaming import events


def test_media_scan(spark, tmp_path):
    for name in ("a.MP3", "sub/b.flac", "c.txt", "d"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    got = files.scan_media(spark, f"file://{tmp_path}", content=True)
    assert sorted(p.rsplit("/", 1)[1] for p in (r["path"] for r in got.collect())) == ["a.MP3", "b.flac"]

    def tags(data):
        if data.startswith(b"a"):
            return {"performer": ["P"], "duration_ms": 5}
        raise ValueError("unreadable")

    rows = {r["title"]: r for r in files.with_tags(got, tags).collect()}
    assert rows["a"]["artist"] == "P" and rows["a"]["duration_ms"] == 5 and rows["b"]["artist"] is None and rows["b"]["duration_ms"] == 0
    with pytest.raises(Exception):
        files.scan_media(spark, f"file://{tmp_path}/missing").count()


def test_vector_and_graph_files(spark, tmp_path):
    v = spark.createDataFrame([(i, [float(i), 0.5]) for i in range(50)], "track_id long, embedding array<float>")
    for i, r in enumerate(files.vector_parts(v.coalesce(2)).collect()):
        (tmp_path / f"{i}.emb").write_bytes(bytes(r["content"]))
    (tmp_path / "bad.emb").write_bytes(b"PEMB" + struct.pack("<III", 9, 1, 1) + bytes(12))
    got = files.read_vectors(spark, f"file://{tmp_path}/*.emb")
    assert sorted(map(lambda r: (r[0], r[1]), got.collect())) == [(i, [float(i), 0.5]) for i in range(50)]
    cells = np.array([(1, 0.7), (2, 0.3), (0, 1.0), (0, 0.0), (9, 0.4), (0, 0.0)], np.dtype([("at", "<u4"), ("w", "<f4")]))
    (tmp_path / "g.bin").write_bytes(struct.pack("<II", 3, 2) + np.array([10, 20, 30], "<i8").tobytes() + cells.tobytes())
    edges = sorted((r["src"], r["rank"], r["dst"]) for r in files.read_graph(spark, f"file://{tmp_path}/g.bin").collect())
    assert edges == [(10, 1, 20), (10, 2, 30), (20, 1, 10)]


def test_blobs_lists_and_manifests(spark, tmp_path):
    r = spark.createDataFrame([([1.0, -2.5],), (None,)], "v array<float>").select(files.from_blob(files.as_blob(F.col("v"))).alias("v")).collect()
    assert sorted([x["v"] for x in r], key=str) == [None, [1.0, -2.5]] or [x["v"] for x in r] == [[1.0, -2.5], None]
    d = spark.createDataFrame([("a\x00\x00b ",)], "v string")
    assert [x["item"] for x in files.legacy_list(d, "v").collect()] == ["a", "b "]
    ids = spark.createDataFrame([("[3,3,4]",), ("no",)], "v string")
    assert sorted(x["id"] for x in files.id_list(ids, "v").collect()) == [3, 4]
    (tmp_path / "m.json").write_text('{"k1": "/a", "k2": {"file_path": "/b", "windows": 3}}\n')
    assert sorted(map(str, files.read_manifest(spark, f"file://{tmp_path}/m.json").collect())) == ["Row(key='k1', file_path='/a', windows=None)", "Row(key='k2', file_path='/b', windows=3)"]
    (tmp_path / "f").mkdir()
    (tmp_path / "f/x.bin").write_bytes(bytes(3072 * 2))
    (tmp_path / "f/y.bin").write_bytes(bytes(100))
    assert [r["windows"] for r in files.usable_features(spark, f"file://{tmp_path}/f").collect()] == [2]
    assert files.random_rows(spark.range(500), 5, 1, usable=F.col("id") % 2 == 0).count() == 5
    files.export({"t": d}, f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out/t").count() == 1


def test_latest_state(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").repartition(4)
    e.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = events.latest_state(stream).writeStream.format("memory").queryName("latest").outputMode("update").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    got = {r["user_id"]: r["ts"] for r in spark.sql("SELECT user_id, max(ts_us) AS ts FROM latest GROUP BY user_id").collect()}
    want = {r["user_id"]: r["ts"] for r in e.groupBy("user_id").agg(F.unix_micros(F.max("ts").cast("timestamp")).alias("ts")).collect()}
    assert got == want


def test_windowed_counts(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    e.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    q = events.windowed_counts(stream, length="1 day").writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["window_start"], r["event_type"]): r["n"] for r in spark.table("windows").collect()}
    want = {(r[0], r[1]): r["n"] for r in e.groupBy(F.date_trunc("day", "ts"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got and all(want[k] == n for k, n in got.items())


def test_upkeep_is_idempotent_and_equals_a_build(spark, sf, tmp_path):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 120").select("vec_id", "embedding")
    run = events.upkeep(f"file://{tmp_path}/t")
    for i, part in enumerate(("vec_id < 80", "vec_id >= 80", "vec_id >= 80")):
        run(v.where(part), i)
    g = spark.read.parquet(f"file://{tmp_path}/t/graph")
    edges = lambda d: sorted(map(tuple, d.select("src", "rank", "dst").collect()))
    assert edges(g) == edges(knn.build(v))
    run(v.where("vec_id = 3").withColumn("embedding", F.transform("embedding", lambda x: -x)), 3)
    new = spark.read.parquet(f"file://{tmp_path}/t/vectors")
    assert new.count() == 120 and edges(spark.read.parquet(f"file://{tmp_path}/t/graph")) == edges(knn.build(new))


def test_queue_sink(spark, tmp_path):
    sink = events.queue_sink(f"file://{tmp_path}/q")
    batch = lambda ids: spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "position long, file_id long")
    for i, ids in enumerate(([7, 8], [9], [9])):
        sink(batch(ids), i)
    assert [r["file_id"] for r in spark.read.parquet(f"file://{tmp_path}/q").orderBy("position").collect()] == [7, 8, 9]
