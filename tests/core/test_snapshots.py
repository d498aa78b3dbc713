"""Commits of several tables, readers and killed writers beside them, and results that one caller works out."""

import threading
import time

import pytest

from quillon.sources import snapshots


def sized(spark, n):
    return spark.range(n).withColumnRenamed("id", "x")


def test_tables_change_together(spark, tmp_path):
    s = snapshots.Store(spark, str(tmp_path))
    assert s.manifest() == {"version": 0, "tables": {}} and s.snapshot() == {}
    assert s.commit({"a": sized(spark, 3), "b": sized(spark, 3), "index": sized(spark, 1)}, {"index": ["a"]}) == 1
    assert s.stale() == []
    # from itself
    assert s.commit({"a": s.read("a").where("x > 0"), "b": s.read("b").where("x > 0")}) == 2
    assert s.stale() == ["index"] and s.stale(1) == []
    assert s.commit({"index": None}) == 3 and s.stale() == []
    counts = lambda v: {n: t.count() for n, t in s.snapshot(v).items()}
    assert [counts(v) for v in s.versions()] == [{"a": 3, "b": 3, "index": 1}, {"a": 2, "b": 2, "index": 1}, {"a": 2, "b": 2}]
    with pytest.raises(snapshots.Conflict):
        s.commit({"a": sized(spark, 9)}, base=2)
    assert len(s.vacuum()) == 3 and s.versions() == [3] and counts(None) == {"a": 2, "b": 2}


def test_a_killed_writer_leaves_what_was_current(spark, tmp_path):
    s = snapshots.Store(spark, str(tmp_path), lease=0.5)
    s.commit({"a": sized(spark, 2), "b": sized(spark, 2)})
    # as if killed after the first table: its data and its claim stay, its manifest never came
    sized(spark, 5).write.parquet(f"{tmp_path}/tables/a/2-killed")
    assert s.folder.take("claims/2", 60)
    with pytest.raises(snapshots.Conflict):
        snapshots.Store(spark, str(tmp_path), lease=60).commit({"a": sized(spark, 7)})
    assert s.read("a").count() == s.read("b").count() == 2
    time.sleep(1.1)
    assert s.commit({"a": sized(spark, 4)}) == 2 and s.read("a").count() == 4
    assert s.vacuum(2) == ["tables/a/2-killed"]

    # an error while a table is written
    bad = sized(spark, 3).selectExpr("IF(x < 2, x, CAST(raise_error('bad row') AS bigint)) AS x")
    with pytest.raises(Exception, match="bad row"):
        s.commit({"a": sized(spark, 1), "b": bad})
    assert s.manifest()["version"] == 2 and s.commit({"a": sized(spark, 1)}) == 3


def test_readers_never_miss_a_table(spark, tmp_path):
    s = snapshots.Store(spark, str(tmp_path))
    s.commit({"a": sized(spark, 1), "b": sized(spark, 1)})
    seen, failed, stop = set(), [], threading.Event()

    def read():
        while not stop.is_set():
            try:
                seen.add(tuple(t.count() for t in s.snapshot().values()))
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for n in range(2, 6):
        s.commit({"a": sized(spark, n), "b": sized(spark, n)})
    stop.set()
    reader.join()
    assert not failed and seen and all(a == b for a, b in seen)


def test_one_caller_works_a_result_out(spark, tmp_path):
    built, got = [], []

    def build():
        built.append(1)
        time.sleep(1)
        return sized(spark, 4)

    call = lambda key=("f", 4), **more: got.append(snapshots.cached(spark, str(tmp_path), key, build, **more).count())
    threads = [threading.Thread(target=call) for _ in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert got == [4, 4, 4] and len(built) == 1
    call(("other", 4))
    assert len(built) == 2
    time.sleep(1.1)
    call(ttl=1.0)
    assert len(built) == 3 and got == [4] * 5


def test_a_dead_callers_lease_is_broken(spark, tmp_path):
    folder = snapshots.Folder(spark, f"{tmp_path}/{snapshots.hashlib.sha256(repr(('k',)).encode()).hexdigest()}")
    assert folder.take("lease", 60) and not folder.take("lease", 60)
    sized(spark, 1).write.parquet(f"{folder.path}/r-broken")
    folder.delete("r-broken/_SUCCESS")
    time.sleep(1.1)
    assert snapshots.cached(spark, str(tmp_path), ("k",), lambda: sized(spark, 6), lease=1.0).count() == 6
    with pytest.raises(ZeroDivisionError):
        snapshots.cached(spark, str(tmp_path), ("bad",), lambda: 1 / 0)
    assert snapshots.cached(spark, str(tmp_path), ("bad",), lambda: sized(spark, 2)).count() == 2


def test_fingerprints(spark):
    d = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, None)], "x int, y string")
    one = snapshots.fingerprint(d, ["x", "y"])
    assert one == snapshots.fingerprint(d.orderBy("x", ascending=False).repartition(3), ["x", "y"]) and one[1] == 4
    assert one != snapshots.fingerprint(d.distinct(), ["x", "y"]) and snapshots.fingerprint(d.limit(0), ["x"])[1] == 0


def test_results_go_with_the_query_before_them(spark, monkeypatch):
    """A log in ranges of lines, of which many hold no query, against one look from the first line to the last."""
    import random

    from quillon.sources import files

    r = random.Random(2)
    for ranges in (3, 40, 1024):
        monkeypatch.setattr(files, "LOG_RANGES", ranges)
        rows, want, now = [], [], None
        for line in sorted(r.sample(range(5, 9000), 160)):
            kind = r.choice("qrrrr-")
            if kind == "q":
                now = line
                rows.append((line, f'MULTISEED_QUERY: {{"text":"t{line}"}}'))
                want.append([line, 0])
            elif kind == "r":
                rows.append((line, 'MULTISEED_RESULTS: [{"rank":1}]'))
                if now is not None:
                    want[-1][1] += 1
            else:
                rows.append((line, "something else"))
        got = files.replay_log(spark.createDataFrame(rows, "line long, value string").repartition(3))
        counts = got.groupBy("query_line").agg({"results": "count"}).collect()
        assert sorted(map(list, counts)) == want
    assert files.replay_log(spark.createDataFrame([], "line long, value string")).count() == 0
