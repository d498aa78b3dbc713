"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so sketches of all documents are comparable: the
union of two sketches is the sketch of the union, and containment of a short text in a very long one can be estimated. The
``floor`` smallest hashes are kept as well, which merge the same way: with them short texts are compared exactly. A sketch is
complete below its own threshold, and two sketches are compared below the lower of theirs.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import batch, hashes, labels, shingles, shuffle_partitions

FULL = (1 << 48) - 1


@dataclass(frozen=True)
class SketchParams:
    """words: of a shingle. fraction: 1 of so many hashes is kept. floor: least number of hashes kept, if there are as many."""

    words: int = 5
    fraction: int = 16
    floor: int = 32


@dataclass(frozen=True)
class Sketch:
    """Sorted 48-bit hashes, all that the text has below ``limit``."""

    hashes: np.ndarray
    limit: int

    @staticmethod
    def of(text: bytes, params: SketchParams) -> Sketch:
        h = np.unique(shingles(hashes(text.split()), params.words) >> np.uint64(16))
        return Sketch.reduced(h, FULL, params)

    @staticmethod
    def reduced(h: np.ndarray, limit: int, params: SketchParams) -> Sketch:
        below = int(np.searchsorted(h, np.uint64(FULL // params.fraction), "right"))
        n = max(below, params.floor)
        if n >= len(h):
            return Sketch(h, limit)
        return Sketch(h[:n], max(int(h[n - 1]), min(FULL // params.fraction, limit)))

    def merged(self, other: Sketch, params: SketchParams) -> Sketch:
        """The sketch of both texts' shingles together."""
        limit = min(self.limit, other.limit)
        h = np.union1d(self.hashes, other.hashes)
        return Sketch.reduced(h[h <= np.uint64(limit)], limit, params)

    def counts(self, other: Sketch) -> tuple[int, int, int]:
        """Hashes of this, of the other, and of both, below both limits."""
        limit = np.uint64(min(self.limit, other.limit))
        a = self.hashes[: np.searchsorted(self.hashes, limit, "right")]
        b = other.hashes[: np.searchsorted(other.hashes, limit, "right")]
        return len(a), len(b), len(np.intersect1d(a, b, assume_unique=True))

    def jaccard(self, other: Sketch) -> float:
        """Shared shingles of all; texts without words are like each other and nothing else."""
        a, b, both = self.counts(other)
        return both / (a + b - both) if a + b else 1.0

    def contained(self, other: Sketch) -> float:
        """The part of this text's shingles that the other has; of no shingles all."""
        a, _, both = self.counts(other)
        return both / a if a else float(not len(self.hashes))

    def likeness(self, other: Sketch) -> float:
        """The mean of both containments: 1 for equal sets, near 0 for unrelated ones; a part of a longer text is halfway at least. Texts without
        words are like each other and nothing else."""
        if not len(self.hashes) or not len(other.hashes):
            return float(len(self.hashes) == len(other.hashes))
        return (self.contained(other) + other.contained(self)) / 2

    def text(self) -> str:
        """The limit and the hashes, 12 hexadecimal digits each."""
        return np.concatenate([[np.uint64(self.limit)], self.hashes]).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes().hex()

    @staticmethod
    def parse(text: str) -> Sketch:
        raw = np.frombuffer(bytes.fromhex(text), np.uint8).reshape(-1, 6).astype(np.uint64)
        v = sum(raw[:, i] << np.uint64(40 - 8 * i) for i in range(6))
        return Sketch(v[1:], int(v[0]))


def sketches(docs: DataFrame, params: SketchParams = SketchParams()) -> DataFrame:
    """doc_id, fingerprint of every document (null text: as empty)."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(parts):
        for part in parts:
            yield batch([(i, Sketch.of((t or "").encode(), params).text()) for i, t in zip(*(c.to_pylist() for c in part.columns), strict=True)], schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint string")


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, jaccard_edited double, jaccard_next double"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), *((c, pa.float64()) for c in ("near_edited", "near_next", "jaccard_edited", "jaccard_next"))])


def edited(text: str, following: str) -> str:
    """The last quarter of the text replaced by as many first characters (or all) of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def probe(docs: DataFrame, params: SketchParams = SketchParams()) -> DataFrame:
    """Every document's fingerprint beside those of its edited text and of the next document by ascending doc_id.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (likeness) and the Jaccard
    estimates. Null texts count as empty; the last document's next is the first, an only document's next is itself; rows that
    share a doc_id are ordered by text; a null doc_id comes first. Other columns are not read; an empty table gives no rows.

    Texts move once: into ranges of doc_id, whose first documents go to the range before as well.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    low = -(1 << 63)
    key = F.coalesce("doc_id", F.lit(low))
    ids = picked.select(key.alias("doc_id"))
    cuts = ids.selectExpr(f"approx_percentile(doc_id, array({','.join(str(i / n) for i in range(1, n))}), 10000) AS q").head()[0] if n > 1 else []
    bounds = sorted(set(cuts or []))

    # each range has a number of its own partition
    numbers = np.array(labels(spark, n)[: len(bounds) + 1], np.int32)

    @F.pandas_udf("int")
    def range_of(i):
        return pd.Series(numbers[np.searchsorted(np.array(bounds, np.int64), i.to_numpy(np.int64), "right")])

    # the least id of each range, and the range before that has rows (for the first of all: the last)
    firsts = ids.groupBy(range_of("doc_id").alias("at")).agg(F.min("doc_id").alias("first")).collect()
    order = sorted((r["first"], r["at"]) for r in firsts)
    before = {first: order[i - 1][1] for i, (first, _) in enumerate(order)}
    guard = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else F.create_map().cast("map<bigint,int>")
    # of rows that share a first id, one goes along: the first by text
    rows = picked.withColumn("at", range_of(key)).withColumn("to", F.try_element_at(guard, key))
    homes = F.array(F.struct("at", F.lit(False).alias("guard")), F.struct(F.col("to").alias("at"), F.lit(True).alias("guard")))
    rows = rows.select("doc_id", "text", F.explode(F.when(F.col("to").isNull(), F.slice(homes, 1, 1)).otherwise(homes)).alias("x"))
    dealt = rows.select("x.at", "x.guard", "doc_id", "text").repartition(n, "at").sortWithinPartitions("at", "guard", F.asc_nulls_first("doc_id"), "text")

    def run(parts):
        held, out = None, []  # (range, doc_id, text, sketch)

        def close(now, following, its):
            _, i, text, own = now
            new = edited(text, following)
            b = new.encode()
            ed = Sketch.of(b, params)
            return i, len(text), sha256(b).hexdigest(), own.text(), ed.text(), own.likeness(ed), own.likeness(its), own.jaccard(ed), own.jaccard(its)

        for part in parts:
            for at, is_guard, i, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if is_guard and (held is None or held[0] != at):
                    continue  # the range's last row has met its next
                own = Sketch.of(text.encode(), params)
                if held is not None:
                    out.append(close(held, text, own))
                held = None if is_guard else (at, i, text, own)
            if out:
                yield batch(out, SCHEMA)
                out = []

    return dealt.mapInArrow(run, OUT)
