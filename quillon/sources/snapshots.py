"""Tables that change together, and results that are worked out once.

A store is a folder of table versions and of manifests. A manifest names the version of every table, and of which versions a derived table was
made. Tables are written beside the old ones; one rename of a small file then makes all of them current at once. Readers
resolve a manifest once and are never without a table; a writer that is killed leaves what was current.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another writer made a version after the one that this one began from."""


class Folder:
    """A folder in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self.at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.at(name))] if self.fs.exists(self.at(name)) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)

    def age(self, name: str) -> float:
        """Seconds since a file was written."""
        return time.time() - self.fs.getFileStatus(self.at(name)).getModificationTime() / 1000

    def put(self, name: str, text: str) -> None:
        """A small file that appears whole: written beside, then renamed."""
        beside = f"{name}.{uuid.uuid4().hex}"
        out = self.fs.create(self.at(beside), False)
        out.write(bytearray(text.encode()))
        out.close()
        if not self.fs.rename(self.at(beside), self.at(name)):
            raise OSError(f"can't write {self.path}/{name}")

    def get(self, name: str) -> str:
        source = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def take(self, name: str, lease: float) -> bool:
        """Make the lease ``name``, which only one caller can hold; one that is older than ``lease`` seconds is broken first."""
        self.fs.mkdirs(self.at(""))
        try:
            if self.exists(name) and self.age(name) > lease:
                self.delete(name)
            return bool(self.fs.createNewFile(self.at(name)))
        except Exception as e:
            # another caller may break or give up the same lease meanwhile
            if "FileNotFound" in str(e) or "FileAlreadyExists" in str(e):
                return False
            raise


class Store:
    """Tables below ``path`` that change together."""

    def __init__(self, spark: SparkSession, path: str, lease: float = 3600.0):
        self.spark, self.folder, self.lease = spark, Folder(spark, path), lease

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.folder.names("manifests") if n.endswith(".json") and n.removesuffix(".json").isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """version, tables: name -> path, version, sources. Of the last version if none is given; version 0 has no tables."""
        if version is None:
            version = max(self.versions(), default=0)
        return json.loads(self.folder.get(f"manifests/{version}.json")) if version else {"version": 0, "tables": {}}

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.snapshot(version)[name]

    def snapshot(self, version: int | None = None) -> dict[str, DataFrame]:
        """All tables of one version."""
        return {n: self.spark.read.parquet(f"{self.folder.path}/{t['path']}") for n, t in self.manifest(version)["tables"].items()}

    def commit(self, tables: dict[str, DataFrame | None], sources: dict[str, list[str]] | None = None, base: int | None = None) -> int:
        """The next version, with these tables written anew (None: taken away) and all others as they are in version ``base`` (the last one).

        sources: of which tables a derived one was made; their versions are kept with it. Raises Conflict, with nothing changed, if another
        writer has been faster or is at work.
        """
        old = self.manifest(base)
        new, now = old["version"] + 1, dict(old["tables"])
        claim = f"claims/{new}"
        self.folder.fs.mkdirs(self.folder.at("claims"))
        if max(self.versions(), default=0) != old["version"] or not self.folder.take(claim, self.lease):
            raise Conflict(f"version {new} of {self.folder.path} is taken")
        try:
            for name, df in tables.items():
                if df is None:
                    now.pop(name, None)
                    continue
                path = f"tables/{name}/{new}-{uuid.uuid4().hex}"
                df.write.parquet(f"{self.folder.path}/{path}")
                now[name] = {"path": path, "version": new, "sources": {}}
            for name, of in (sources or {}).items():
                now[name]["sources"] = {s: now[s]["version"] for s in of}
            self.folder.fs.mkdirs(self.folder.at("manifests"))
            if self.folder.exists(f"manifests/{new}.json"):
                raise Conflict(f"version {new} of {self.folder.path} is taken")
            self.folder.put(f"manifests/{new}.json", json.dumps({"version": new, "tables": now}))
        finally:
            self.folder.delete(claim)
        return new

    def stale(self, version: int | None = None) -> list[str]:
        """Derived tables whose sources have changed or gone since."""
        tables = self.manifest(version)["tables"]
        return sorted(n for n, t in tables.items() if any(tables.get(s, {}).get("version") != v for s, v in t["sources"].items()))

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes manifests but the last ``keep``, and table versions that none of these names; gives what it deleted. Not for while others write."""
        versions = self.versions()
        used = {t["path"] for v in versions[-keep:] for t in self.manifest(v)["tables"].values()}
        gone = [f"tables/{n}/{v}" for n in self.folder.names("tables") for v in self.folder.names(f"tables/{n}") if f"tables/{n}/{v}" not in used]
        for path in [f"manifests/{v}.json" for v in versions[:-keep]] + gone:
            self.folder.delete(path)
        return gone


def fingerprint(df: DataFrame, columns: list[str]) -> tuple[str, int]:
    """A digest of the rows, whatever their order, and their count: one aggregate."""
    h = F.xxhash64(*columns)
    n, a, b = df.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.sum(F.xxhash64(h, F.lit(1)).cast("decimal(38,0)"))).head()
    return hashlib.sha256(f"{n}:{a}:{b}".encode()).hexdigest(), n


def cached(spark: SparkSession, path: str, key: tuple, build: Callable[[], DataFrame], ttl: float = 300.0, lease: float = 3600.0, poll: float = 0.2) -> DataFrame:
    """The result of ``build`` for ``key``, at most ``ttl`` seconds old, worked out by one caller alone.

    Results are tables below ``path``, named by a digest of the key and complete once they have their _SUCCESS file. The caller who takes the
    key's lease builds; others wait for the result. The lease of a caller who died is broken after ``lease`` seconds. Results that are
    twice as old as they may be are deleted when a new one is made.
    """
    folder = Folder(spark, f"{path.rstrip('/')}/{hashlib.sha256(repr(key).encode()).hexdigest()}")
    while True:
        done = sorted(((folder.age(f"{n}/_SUCCESS"), n) for n in folder.names() if n.startswith("r-") and folder.exists(f"{n}/_SUCCESS")))
        if done and done[0][0] <= ttl:
            return spark.read.parquet(f"{folder.path}/{done[0][1]}")
        if folder.take("lease", lease):
            try:
                # a result may have come between looking and taking
                if any(n not in {d[1] for d in done} and n.startswith("r-") and folder.exists(f"{n}/_SUCCESS") for n in folder.names()):
                    continue
                build().write.parquet(f"{folder.path}/r-{uuid.uuid4().hex}")
                for age, n in done:
                    if age > 2 * ttl:
                        folder.delete(n)
            finally:
                folder.delete("lease")
        else:
            time.sleep(poll)
