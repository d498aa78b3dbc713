"""Sources and sinks beyond tables: media files, binary vector and graph files, logs, JSON documents."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import text as T

#: Magic and version of vector files; bytes of a window feature of 768 floats.
MAGIC, VERSION, FEATURE_BYTES = b"PEMB", 1, 3072
#: Payload bytes of a part of a binary file that this library writes.
PART_BYTES = 64 << 20


def scan_media(spark: SparkSession, root: str, extensions: tuple[str, ...] = T.SCAN_EXTENSIONS, content: bool = False) -> DataFrame:
    """path, length, modified (and content) of the files below a folder with one of the endings, in either case. A missing folder fails.

    Contents are pruned unless asked for, so a listing reads no file.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    columns = ["path", "length", F.col("modificationTime").alias("modified"), *(["content"] if content else [])]
    return files.where(ending.isin(list(extensions))).select(*columns)


def fingerprint() -> Column:
    """length_modified (milliseconds) of a scanned file: changes with its content, as far as a listing tells."""
    return F.concat_ws("_", F.col("length"), F.unix_millis("modified"))


def with_tags(files: DataFrame, read_tags=None) -> DataFrame:
    """file_path, artist, album, title, duration_ms of files with content.

    read_tags(bytes) -> dict of lists (artist, albumartist, performer, album, title) and duration_ms; what it lacks falls back: artist to
    albumartist and performer, title to the file's stem, and a file that can't be read to its stem alone.
    """

    def run(parts: Iterator[pd.DataFrame]):
        for pdf in parts:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    tags = read_tags(data) if read_tags else {}
                except Exception:  # noqa: BLE001  a file that no reader takes is kept by its name
                    tags = {}
                first = lambda *names, tags=tags: next((v[0] for n in names if (v := tags.get(n))), None)
                rows.append((path, first("artist", "albumartist", "performer"), first("album"), first("title"), int(tags.get("duration_ms") or 0)))
            yield pd.DataFrame(rows, columns=["file_path", "artist", "album", "title", "duration_ms"])

    out = files.select("path", "content").mapInPandas(run, "file_path string, artist string, album string, title string, duration_ms int")
    return out.withColumn("title", F.coalesce("title", T.file_stem("file_path")))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """track_id, embedding of vector files: magic, version, count, dimension, ids, then rows of floats, little-endian.

    A file with another magic, version or length gives no rows. Each file is one task's: large sets are written as several.
    """

    def run(parts):
        for pdf in parts:
            for data in pdf["content"]:
                n, dim = header(data)
                if n > 0:
                    ids = np.frombuffer(data, "<i8", n, 16)
                    rows = np.frombuffer(data, "<f4", n * dim, 16 + 8 * n).reshape(n, dim)
                    for at in range(0, n, 4096):
                        yield pd.DataFrame({"track_id": ids[at : at + 4096], "embedding": list(rows[at : at + 4096])})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "track_id long, embedding array<float>")


def header(data: bytes) -> tuple[int, int]:
    """Count and dimension of a vector file's content; (-1, 0) if it is not one."""
    if len(data) < 16 or data[:4] != MAGIC:
        return -1, 0
    version, n, dim = struct.unpack_from("<III", data, 4)
    return (n, dim) if version == VERSION and len(data) == 16 + n * (8 + 4 * dim) else (-1, 0)


def vector_parts(vectors: DataFrame, id_col: str = "track_id") -> DataFrame:
    """content: vectors as the contents of vector files, a few for each task."""

    def run(parts):
        ids, rows, size = [], [], 0

        def close():
            m = np.array(rows, "<f4")
            return pd.DataFrame({"content": [MAGIC + struct.pack("<III", VERSION, len(ids), m.shape[1]) + np.array(ids, "<i8").tobytes() + m.tobytes()]})

        for pdf in parts:
            for i, v in zip(pdf["id"], pdf["embedding"], strict=True):
                if rows and (len(v) != len(rows[0]) or size > PART_BYTES):
                    yield close()
                    ids, rows, size = [], [], 0
                ids.append(i)
                rows.append(v)
                size += 8 + 4 * len(v)
        if rows:
            yield close()

    return vectors.select(F.col(id_col).alias("id"), "embedding").mapInPandas(run, "content binary")


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """src, rank, dst, weight of graph files: counts of nodes and neighbours, node ids, then (neighbour's place, weight) cells, little-endian.

    Cells without weight, and places out of range, are no edges.
    """

    def run(parts):
        cell = np.dtype([("at", "<u4"), ("weight", "<f4")])
        for pdf in parts:
            for data in pdf["content"]:
                n, k = np.frombuffer(data, "<u4", 2).astype(int) if len(data) >= 8 else (0, 0)
                if len(data) != 8 + n * (8 + 8 * k) or not n * k:
                    continue
                ids = np.frombuffer(data, "<i8", n, 8)
                cells = np.frombuffer(data, cell, n * k, 8 + 8 * n)
                ok = (cells["weight"] > 0) & (cells["at"] < n)
                yield pd.DataFrame({"src": np.repeat(ids, k)[ok], "rank": np.tile(np.arange(1, k + 1), n)[ok], "dst": ids[np.minimum(cells["at"], n - 1)][ok], "weight": cells["weight"][ok]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "src long, rank int, dst long, weight float")


def as_blob(v):
    """array<float> as little-endian bytes."""

    @F.pandas_udf("binary")
    def pack(s: pd.Series) -> pd.Series:
        return s.map(lambda x: np.asarray(x, "<f4").tobytes(), na_action="ignore")

    return pack(v)


def from_blob(b):
    """Little-endian bytes as array<float>; null if they are no whole floats."""

    @F.pandas_udf("array<float>")
    def unpack(s: pd.Series) -> pd.Series:
        return s.map(lambda x: np.frombuffer(x, "<f4") if len(x) % 4 == 0 else None, na_action="ignore")

    return unpack(b)


def usable_features(spark: SparkSession, root: str) -> DataFrame:
    """path, windows of cached window features; files that are not whole windows are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    return files.where((F.col("length") > 0) & (F.col("length") % FEATURE_BYTES == 0)).select("path", (F.col("length") / FEATURE_BYTES).cast("int").alias("windows"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """key, file_path, windows of a manifest of one JSON object a line: an entry is a path alone or an object with a path."""
    raw = spark.read.text(path).select(F.from_json("value", "map<string,string>").alias("m")).select(F.explode("m").alias("key", "entry"))
    entry = F.from_json("entry", "file_path string, windows int")
    old = ~F.col("entry").startswith("{")
    return raw.select("key", F.when(old, F.col("entry")).otherwise(entry["file_path"]).alias("file_path"), F.when(~old, entry["windows"]).alias("windows"))


QUERY_JSON = "text string, text_weight double, text_negative boolean, seeds array<struct<track_id:bigint,artist:string,title:string,weight:double>>"
RESULT_JSON = "array<struct<rank:int,track_id:bigint,artist:string,title:string,score:double,display_similarity:double>>"


#: Ranges of lines into which a log is cut: as many rows has the table of their last queries.
LOG_RANGES = 1024


def replay_log(lines: DataFrame) -> DataFrame:
    """query_line, query, results of a log (line, value): each result line goes with the query line before it.

    A truncated result is cut after its last whole entry; one that can't be read gives null. The log is cut into ranges of lines, each of which is
    looked through on its own; a table of each range's last query line says what stands before the others.
    """
    q = F.regexp_extract("value", r"MULTISEED_QUERY: (\{.*)", 1)
    r = F.regexp_extract("value", r"MULTISEED_RESULTS: (\[.*)", 1)
    found = lines.select("line", F.nullif(q, F.lit("")).alias("q"), F.nullif(r, F.lit("")).alias("r")).where("q IS NOT NULL OR r IS NOT NULL")
    ends = found.agg(F.min("line").alias("low"), F.max("line").alias("high"))
    found = found.crossJoin(F.broadcast(ends)).withColumn("range", F.floor((F.col("line") - F.col("low")) / ((F.col("high") - F.col("low")) / LOG_RANGES + 1))).drop("low", "high")
    asked = F.when(F.col("q").isNotNull(), F.col("line"))
    last = found.groupBy("range").agg(F.max(asked).alias("last"))
    last = last.select("range", F.max("last").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    here = F.max(asked).over(Window.partitionBy("range").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("here", here).join(F.broadcast(last), "range").withColumn("query_line", F.coalesce("here", "before"))
    whole = F.when(F.col("r").rlike(r"\]\s*$"), F.col("r")).otherwise(F.concat(F.regexp_extract("r", r"^(.*\})", 1), F.lit("]")))
    results = found.where("r IS NOT NULL").select("query_line", F.from_json(whole, RESULT_JSON).alias("results"))
    queries = found.where("q IS NOT NULL").select(F.col("line").alias("query_line"), F.from_json("q", QUERY_JSON).alias("query"))
    return queries.join(results, "query_line", "left")


def legacy_list(values: DataFrame, column: str) -> DataFrame:
    """item of NUL-delimited lists, blank ones left out."""
    return values.select(F.explode(F.split(column, "\\x00")).alias("item")).where(F.trim("item") != "")


def id_list(values: DataFrame, column: str) -> DataFrame:
    """id of JSON arrays of numbers; what isn't one has none."""
    return values.select(F.explode(F.from_json(column, "array<bigint>")).alias("id")).where("id IS NOT NULL").distinct()


def random_rows(rows: DataFrame, n: int, seed: int, tries: int = 100, usable=None) -> DataFrame:
    """n random usable rows of the first ``tries`` in a seeded order."""
    drawn = rows.orderBy(F.xxhash64(*rows.columns, F.lit(seed))).limit(tries)
    return (drawn.where(usable) if usable is not None else drawn).limit(n)


def export(tables: dict[str, DataFrame], folder: str) -> None:
    """Write every table below a folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")
