"""Helpers that the operators share: scratch tables, word splitting and hashing, sized broadcasts."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

# Arrow's own pool keeps what batches have freed; several workers share an executor's memory, so freed batches go back to the system.
pa.set_memory_pool(pa.system_memory_pool())

#: White space that separates words: space and \x09 to \x0D. ``bytes.split()`` splits at exactly these.
WS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Odd 64-bit multipliers of polynomial and mixing hashes.
P = np.uint64(0x9E3779B97F4A7C15)
Q = np.uint64(0xBF58476D1CE4E5B9)
SHIFT = np.uint64(31)

#: Rows up to which a table of ids or of short arrays may be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 1_000_000


def scratch_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only where it is unset, and the session runs on one machine, a temporary folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quillon-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quillon"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the scratch folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes the scratch tables that ``df`` reads. Only for tables that nothing reads any more: what was made from them must be written."""
    spark = df.sparkSession
    base, jvm = scratch_dir(spark), spark._jvm
    for f in df.inputFiles():
        folder = jvm.org.apache.hadoop.fs.Path(f).getParent()
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if folder.getParent().toUri().getPath() == jvm.org.apache.hadoop.fs.Path(base).toUri().getPath() and fs.exists(folder):
            fs.delete(folder, True)


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if it has at most ``rows`` rows. It should be a written table: it is counted."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Arrow batches of at most so many rows and about so many bytes: with Spark's 10,000 rows, batches of long texts would fill the memory of
    executors and workers. Smaller settings of the session stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        n, unit = re.fullmatch(r"(-?\d+)([kmgt]?)b?", spark.conf.get(key).lower()).groups()
        if not 0 < int(n) << (10 * " kmgt".index(unit or " ")) <= most:
            spark.conf.set(key, str(most))


def labels(spark: SparkSession, n: int) -> list[int]:
    """n numbers that Spark's hash partitioning deals to n different partitions."""
    rows = spark.range(n * 40).select(F.col("id").cast("int").alias("id")).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("at")).agg(F.min("id").alias("id"))
    found = {r["at"]: r["id"] for r in rows.collect()}
    spare = iter(range(n * 40, n * 41))
    return [found[i] if i in found else next(spare) for i in range(n)]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def fold_ascii(name: str = "text"):
    """The column with A-Z, and no other letters, in lower case."""
    return F.translate(F.col(name), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    h = (h ^ (h >> SHIFT)) * Q
    return h ^ (h >> SHIFT)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, in order; of the whole sequence if it is shorter; none without words."""
    if not len(words):
        return words
    n = min(n, len(words))
    h = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        h = h * P + words[i : len(words) - n + 1 + i]
    return mix(h + np.uint64(n))


def batches(rows: Iterator[dict | tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Rows (tuples in the schema's order) as record batches."""
    held: list = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch(held, schema)
            held = []
    if held:
        yield batch(held, schema)


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
