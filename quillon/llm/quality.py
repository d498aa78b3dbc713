"""Quality rules: a hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Two multinomials over hashed word n-grams are counted, one over the trusted documents and one over all documents.
A document's score is the mean, over its n-grams, of log p_target - log p_raw: what reads like the trusted text is
near 0 or above, what the trusted text never says is far below. A fixed threshold decides every document.

Both counts take one pass: each task adds up dense arrays of ``buckets`` numbers, so what is shuffled and what the
driver gets (the model, 16 bytes a bucket) doesn't grow with the corpus. Scoring is a second pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import P, batch, hashes, mix, texts

MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"


@dataclass(frozen=True)
class QualityParams:
    """buckets: of the hashed n-grams. threshold: least mean log-likelihood ratio of a kept document.
    prior: occurrences that both multinomials get in every bucket, so that rare n-grams say little.
    trusted_rows: at most so many trusted documents, by a hash of their id, fit the target; raw counts take all rows."""

    buckets: int = 1 << 16
    threshold: float = -0.1
    prior: float = 5.0
    trusted_rows: int = 200_000


def features(lower: list[bytes], buckets: int) -> np.ndarray:
    """Buckets of a text's words and word pairs."""
    h = hashes(lower)
    x = np.concatenate([mix(h), mix(h[:-1] * P + h[1:])]) if len(h) > 1 else mix(h)
    return (x % np.uint64(buckets)).astype(np.int64)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more in the text."""
    if len(words) < 4:
        return 0
    h = hashes(words)
    w = mix((h[:-2] * P + h[1:-1]) * P + h[2:])
    order = np.argsort(w, kind="stable")
    same = w[order][1:] == w[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(w), bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    covered[:-2] |= hit
    covered[1:-1] |= hit
    covered[2:] |= hit
    return int(covered.sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    solid = text.translate(None, SPACES)
    chars = len(solid) if solid.isascii() else len(solid.decode())
    return len(words), chars, len(solid) - len(solid.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def fails_base(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > 50 * n_words


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the documents that labels call good."""
    return labels.where(F.col("quality") == 1).select("doc_id")


def fit(docs: DataFrame, trusted: DataFrame, params: QualityParams = QualityParams()) -> np.ndarray:
    """The log-likelihood ratio of every bucket. docs: doc_id, text; trusted: doc_id.

    Null and empty texts add nothing; a repeated row counts as often as it stands; without trusted documents, or
    without documents, every ratio is 0.
    """
    m = params.buckets
    ids = trusted.select("doc_id").where("doc_id IS NOT NULL").distinct()
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.trusted_rows).withColumn("trusted", F.lit(True))
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left").select("text", "trusted")
    schema = pa.schema([("bucket", pa.int32()), ("n_target", pa.int64()), ("n_raw", pa.int64())])

    def count(parts):
        target, raw = np.zeros(m, np.int64), np.zeros(m, np.int64)
        for part in parts:
            for text, good in zip(texts(part.column(0)), part.column(1).to_pylist(), strict=True):
                n = np.bincount(features(text.lower().split(), m), minlength=m) if text else 0
                raw += n
                if good:
                    target += n
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(target[at]), pa.array(raw[at])], schema=schema)

    counted = rows.mapInArrow(count, "bucket int, n_target long, n_raw long").groupBy("bucket").agg(F.sum("n_target").alias("t"), F.sum("n_raw").alias("r"))
    got = counted.toPandas()
    t, r = np.zeros(m), np.zeros(m)
    t[got["bucket"]], r[got["bucket"]] = got["t"], got["r"]
    if not t.sum():
        return np.zeros(m, np.float32)
    return np.log((t + params.prior) / (r * (t.sum() / r.sum()) + params.prior)).astype(np.float32)


def judge(text: bytes, ratios: np.ndarray, threshold: float) -> tuple:
    """The base counts, base_failed, kept, score."""
    base = base_counts(text)
    failed = fails_base(base[0], base[4])
    found = features(text.lower().split(), len(ratios))
    score = float(ratios[found].mean(dtype=np.float64)) if len(found) else 0.0
    return *base, failed, not failed and score >= threshold, score


OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def score(docs: DataFrame, ratios: np.ndarray, params: QualityParams = QualityParams()) -> DataFrame:
    """A row for each document: doc_id, the base counts, base_failed, kept, score. Columns beside doc_id and text are not read.

    Null and empty texts have no words and fail; a null doc_id stays null; repeated rows are judged each.
    """
    held, threshold = docs.sparkSession.sparkContext.broadcast(ratios), params.threshold
    kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()]
    schema = pa.schema(list(zip([x.split()[0] for x in OUT.split(", ")], kinds, strict=True)))

    def run(parts):
        for part in parts:
            ids = part.column(0).to_pylist()
            yield batch([(i, *judge(x, held.value, threshold)) for i, x in zip(ids, texts(part.column(1)), strict=True)], schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, OUT)


def keep(docs: DataFrame, ratios: np.ndarray, params: QualityParams = QualityParams()) -> DataFrame:
    """The rows of the documents that pass, with all their columns as they are, whatever their names."""
    held, threshold, at = docs.sparkSession.sparkContext.broadcast(ratios), params.threshold, docs.columns.index("text")

    def run(parts):
        for part in parts:
            yield part.filter(pa.array([judge(x, held.value, threshold)[6] for x in texts(part.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
