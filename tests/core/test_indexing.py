"""Runs that are stopped at every point, and go on without losing or repeating a file."""

from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.sources import snapshots
from quillon.streaming.indexing import Indexing

FEATURES, VECTORS = "file_id long, features array<double>", "file_id long, embedding array<double>"


def files(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "file_id long").coalesce(1)


def indexing(spark, tmp_path, bad=(), stops=(), **more):
    """Features are the id and its double; every extraction leaves a file of its own."""
    seen = tmp_path / "seen"
    seen.mkdir(exist_ok=True)

    def work(parts):
        for pdf in parts:
            for i in pdf["file_id"]:
                if i in stops:
                    raise RuntimeError("stopped")
                (seen / f"{i}-{len(list(seen.glob(f'{i}-*')))}").touch()
                if i not in bad:
                    yield pd.DataFrame({"file_id": [i], "features": [[float(i), 2.0 * i]]})

    encode = lambda f: f.select("file_id", F.transform("features", lambda x: x + 1).alias("embedding"))
    return Indexing(spark, str(tmp_path / "store"), lambda d: d.mapInPandas(work, FEATURES), encode, FEATURES, VECTORS, per_task=2, usable=F.size("features") == 2, **more)


def seen(tmp_path):
    return Counter(int(p.name.split("-")[0]) for p in (tmp_path / "seen").iterdir())


def vectors(x):
    return sorted((r["file_id"], r["embedding"], r["entry"]) for r in x.vectors().collect())


def test_new_files_alone_are_worked_out(spark, tmp_path):
    x = indexing(spark, tmp_path, bad=(4,))
    assert vectors(x) == [] and x.entries() == [] and x.clear() == []
    told = x.run(files(spark, 1, 2, 2, None, 4))
    assert {k: told[k] for k in ("asked", "known", "reused", "extracted", "failed")} == {"asked": 3, "known": 0, "reused": 0, "extracted": 3, "failed": 1}
    assert x.run(files(spark, 1, 2)) is None and x.run(files(spark)) is None
    told = indexing(spark, tmp_path).run(files(spark, 1, 3, 4))
    assert (told["asked"], told["known"], told["extracted"], told["failed"]) == (3, 1, 2, 0)
    assert vectors(x) == [(1, [2.0, 3.0], 1), (2, [3.0, 5.0], 1), (3, [4.0, 7.0], 2), (4, [5.0, 9.0], 2)]
    assert seen(tmp_path) == {1: 1, 2: 1, 3: 1, 4: 2}
    assert not [n for n in x.folder.names("features") if n.endswith(".parquet")]
    x.compact()
    assert len(x.entries()) == 1 and len(x.vacuum()) == 2 and len(vectors(x)) == 4 and x.numbers() == [3]
    x.compact()
    assert x.numbers() == [3] and x.run(files(spark, 1, 2, 3, 4)) is None


def test_killed_among_its_tasks(spark, tmp_path):
    with pytest.raises(Exception, match="stopped"):
        indexing(spark, tmp_path, stops=(7,)).run(files(spark, *range(1, 13)))
    before = seen(tmp_path)
    x = indexing(spark, tmp_path)
    kept = {r["file_id"] for r in x._raw().collect()}
    assert vectors(x) == [] and kept and 7 not in kept
    told = x.run(files(spark, *range(1, 13)))
    assert told["reused"] == len(kept) and [v[0] for v in vectors(x)] == list(range(1, 13))
    # what a finished task had is not worked out again
    assert all(seen(tmp_path)[i] == before[i] for i in kept)


def test_killed_before_and_after_the_vectors_count(spark, tmp_path, monkeypatch):
    x = indexing(spark, tmp_path)
    with monkeypatch.context() as m:
        m.setattr(x, "_promote", lambda told: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            x.run(files(spark, 1, 2, 3))
    assert vectors(x) == [] and len(x.folder.names("parts")) == 1
    x = indexing(spark, tmp_path)
    promote = x._promote
    with monkeypatch.context() as m:
        m.setattr(x, "_promote", lambda told: [promote(told), 1 / 0])
        with pytest.raises(ZeroDivisionError):
            x.run(files(spark, 1, 2, 3))
    assert len(vectors(x)) == 3 and seen(tmp_path) == {1: 1, 2: 1, 3: 1}
    # features are left over; the next run deletes them
    assert x._raw().count() == 3
    assert x.run(files(spark, 3)) is None and x._raw().count() == 0
    assert len(x.vacuum()) == 1 and len(vectors(x)) == 3


def test_features_that_are_not_whole_are_worked_out_again(spark, tmp_path):
    x = indexing(spark, tmp_path)
    spark.createDataFrame([(1, [1.0]), (2, [2.0, 4.0])], FEATURES).coalesce(1).write.parquet(f"{x.folder.path}/features")
    # a task that ended twice
    spark.createDataFrame([(2, [2.0, 4.0])], FEATURES).coalesce(1).write.mode("append").parquet(f"{x.folder.path}/features")
    told = x.run(files(spark, 1, 2))
    assert (told["reused"], told["extracted"]) == (1, 1) and seen(tmp_path) == {1: 1}
    assert vectors(x) == [(1, [2.0, 3.0], 1), (2, [3.0, 5.0], 1)] and x._raw().count() == 0


def test_two_runs_at_once(spark, tmp_path, monkeypatch):
    x, y = indexing(spark, tmp_path), indexing(spark, tmp_path)
    stage = x.stage

    def meanwhile(todo):
        y.run(files(spark, 2))
        return stage(todo)

    monkeypatch.setattr(x, "stage", meanwhile)
    with pytest.raises(snapshots.Conflict):
        x.run(files(spark, 1, 2))
    assert vectors(y) == [(2, [3.0, 5.0], 1)]
    monkeypatch.setattr(x, "stage", stage)
    x.run(files(spark, 1, 2))
    assert [v[0] for v in vectors(x)] == [1, 2]


def test_a_stream_of_files(spark, tmp_path):
    source = str(tmp_path / "source")
    x = indexing(spark, tmp_path)
    for ids in ((1, 2, 3), (3, 4)):
        files(spark, *ids).write.mode("append").parquet(source)
        s = spark.readStream.schema("file_id long").parquet(source)
        s.writeStream.foreachBatch(x.run).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert [v[0] for v in vectors(x)] == [1, 2, 3, 4] and set(seen(tmp_path).values()) == {1}
