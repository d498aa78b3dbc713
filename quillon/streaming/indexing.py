"""Vectors of files in two steps, costly features first, by runs that can be stopped anywhere and go on where they were.

Below one folder stand ``features``, to which each task adds those of its files once it is done with them; ``parts``, the vectors that one run
made; and ``log``, a small file for each part that counts. A part counts from the rename of its log file on, whole or not at all. So
a run that is killed among its tasks keeps what they finished; one killed before that rename finds the features and makes the vectors
again; one killed after it has features left over, which the next run deletes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.knn import cut
from quillon.operators.search import sized
from quillon.sources.snapshots import Conflict, Folder


class Indexing:
    """Files become features by ``extract`` and these become vectors by ``encode``, both from DataFrame to DataFrame.

    features, vectors: the schemas of what they give, each with the files' id column. usable: whether a row of features is whole; others are
    worked out again. per_task: files of a task, which are what a lost one costs. ``run`` is a function for foreachBatch. Files
    without an id are left out; of rows with one id any counts. A file of which ``extract`` gives nothing has failed, and is tried again when
    it comes again.
    """

    def __init__(self, spark: SparkSession, path: str, extract: Callable[[DataFrame], DataFrame], encode: Callable[[DataFrame], DataFrame], features: str, vectors: str, id_col: str = "file_id", usable: Column | None = None, per_task: int = 64, lease: float = 60.0):
        self.spark, self.folder, self.extract, self.encode, self.id_col = spark, Folder(spark, path), extract, encode, id_col
        self.schemas = {"features": features, "vectors": vectors}
        self.usable, self.per_task, self.lease = F.lit(True) if usable is None else usable, per_task, lease

    def numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.folder.names("log") if n.removesuffix(".json").isdigit())

    def entries(self) -> list[dict]:
        """What the log says of the parts that count: entry, part, whole, asked, known, reused, extracted, failed."""
        found: list[dict] = []
        for n in reversed(self.numbers()):
            found.insert(0, json.loads(self.folder.get(f"log/{n}.json")))
            if found[0]["whole"]:
                break
        return found

    def vectors(self) -> DataFrame:
        """All vectors that count, and the entry that each came with."""
        paths = [f"{self.folder.path}/{e['part']}" for e in self.entries()]
        schema = f"{self.schemas['vectors']}, entry long"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _files(self) -> list[str]:
        return [n for n in self.folder.names("features") if n.endswith(".parquet")]

    def _raw(self) -> DataFrame:
        """Features as they lie there, with the file in which each is."""
        if not self._files():
            return self.spark.createDataFrame([], f"{self.schemas['features']}, file string")
        return self.spark.read.schema(self.schemas["features"]).parquet(f"{self.folder.path}/features").select("*", F.col("_metadata.file_path").alias("file"))

    def features(self, files: DataFrame) -> DataFrame:
        """One usable row of features of each of the files that has any."""
        found = self._raw().drop("file").where(self.usable).join(sized(files.select(self.id_col)), self.id_col, "left_semi")
        # a task that was run again after it had finished leaves its rows twice
        return found.dropDuplicates([self.id_col])

    def _known(self, files: DataFrame) -> DataFrame:
        return self.vectors().select(self.id_col).join(sized(files.select(self.id_col)), self.id_col, "left_semi")

    def stage(self, files: DataFrame) -> int:
        """Features of those files that have none yet; how many files these are. Every task's rows stay once it has finished."""
        todo = cut(files.join(self.features(files).select(self.id_col), self.id_col, "left_anti"))
        n = todo.count()
        if n:
            rows = self.extract(todo.repartition(-(-n // self.per_task)))
            # by this version of the protocol a task's files reach the folder when it ends, and not when all have
            rows.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(f"{self.folder.path}/features")
        return n

    def run(self, batch: DataFrame, batch_id: int | None = None) -> dict | None:
        """Vectors of the batch's files that have none yet; the log's new entry, or none if all are known.

        Raises Conflict, with no vector added, if another run has added some meanwhile: the files that both had must not count twice.
        """
        before = self.numbers()
        entry = max(before, default=0) + 1
        self.clear()
        files = cut(batch.where(F.col(self.id_col).isNotNull()).dropDuplicates([self.id_col]))
        todo = cut(files.join(self._known(files), self.id_col, "left_anti"))
        asked, n = files.count(), todo.count()
        if not n:
            return None
        extracted = self.stage(todo)
        part = f"parts/{entry}-{uuid.uuid4().hex}"
        self.encode(self.features(todo)).withColumn("entry", F.lit(entry).cast("long")).write.parquet(f"{self.folder.path}/{part}")
        made = self.spark.read.parquet(f"{self.folder.path}/{part}").count()
        told = {"entry": entry, "part": part, "whole": False, "asked": asked, "known": asked - n, "reused": n - extracted, "extracted": extracted, "failed": n - made}
        self._promote(told)
        self.clear()
        return told

    def _promote(self, told: dict) -> None:
        claim, name = f"claims/{told['entry']}", f"log/{told['entry']}.json"
        for folder in ("claims", "log"):
            self.folder.fs.mkdirs(self.folder.at(folder))
        if not self.folder.take(claim, self.lease):
            raise Conflict(f"entry {told['entry']} of {self.folder.path} is taken")
        try:
            if self.folder.exists(name):
                raise Conflict(f"entry {told['entry']} of {self.folder.path} is taken")
            self.folder.put(name, json.dumps(told))
        finally:
            self.folder.delete(claim)

    def clear(self) -> list[str]:
        """Deletes files of features that hold nothing for vectors still to come; gives their names, which are as many as tasks wrote."""
        names = self._files()
        if not names:
            return []
        rows = cut(self._raw().where(self.usable).select(self.id_col, F.substring_index("file", "/", -1).alias("file")))
        wanted = {r["file"] for r in rows.join(self._known(rows), self.id_col, "left_anti").select("file").distinct().collect()}
        gone = [n for n in names if n not in wanted]
        for name in gone:
            self.folder.delete(f"features/{name}")
        return gone

    def compact(self) -> None:
        """One part in place of all, for a log that has grown long."""
        entries = self.entries()
        if len(entries) > 1:
            entry = max(self.numbers()) + 1
            part = f"parts/{entry}-{uuid.uuid4().hex}"
            self.vectors().write.parquet(f"{self.folder.path}/{part}")
            sums = {k: sum(e[k] for e in entries) for k in ("asked", "known", "reused", "extracted", "failed")}
            self._promote({"entry": entry, "part": part, "whole": True} | sums)

    def vacuum(self) -> list[str]:
        """Deletes parts that don't count and log files before the last whole part; not for while others write or read."""
        entries = self.entries()
        used, first = {e["part"] for e in entries}, min((e["entry"] for e in entries), default=0)
        gone = [f"parts/{n}" for n in self.folder.names("parts") if f"parts/{n}" not in used]
        for name in gone + [f"log/{n}.json" for n in self.numbers() if n < first]:
            self.folder.delete(name)
        return gone
