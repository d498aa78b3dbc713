"""From raw documents to token ids in five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import bpe, jaccard, mixture, quality, secrets
from quillon.llm.common import small_batches, written
from quillon.session import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the target is what labels call good, the raw side all of docs."""
    small_batches(spark)
    ratios = quality.fit(docs, quality.trusted_ids(table(spark, sf_dir, "labels")))
    return quality.keep(docs, ratios)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents that the n-gram Jaccard join links, the one with the least doc_id."""
    small_batches(spark)
    return jaccard.representatives(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark and n_chars as the text is then."""
    small_batches(spark)
    return secrets.redact(docs)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them, dealt out to shards and shuffled within."""
    small_batches(spark)
    return mixture.mix(docs)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests and packed token ids of every document of the mix."""
    small_batches(spark)
    return bpe.round_trip(docs, packed=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("source_mixture", source_mixture),
    ("byte_level_bpe", byte_level_bpe),
]

#: SQL can't express the learned ratios, the hash-driven mix or the merges; tests hold the operators beneath the stages against brute force, and count
#: the stages' rows and columns.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
