"""The driver's tables in the roles of this library: vectors, catalogs, queues; each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import link
from quillon.session import table


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def vector_tracks(spark, sf_dir) -> DataFrame:
    """id, artist, title, cluster_id of each vector."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.concat(F.lit("artist "), F.col("label").cast("string")).alias("artist"), F.concat(F.lit("track "), F.col("vec_id").cast("string")).alias("title"), F.col("label").alias("cluster_id"))


def seeds(spark, sf_dir, weights=(0.5, 0.3, -0.2)) -> DataFrame:
    """seed_id, vec_id, embedding, weight of the first vectors."""
    w = F.get(F.array(*map(F.lit, weights)), F.col("vec_id").cast("int"))
    e = table(spark, sf_dir, "embeddings").where(F.col("vec_id") < len(weights))
    return e.select(F.col("vec_id").cast("int").alias("seed_id"), "vec_id", "embedding", w.alias("weight"))


SEEDS = "seeds AS (SELECT vec_id AS seed_id, embedding AS q, [0.5, 0.3, -0.2][vec_id + 1]::DOUBLE AS weight FROM embeddings WHERE vec_id < 3)"


def raw_tracks(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return p.select(
        key.alias("track_id"),
        F.col("p_brand").alias("artist"),
        F.col("p_type").alias("album"),
        F.concat("p_name", F.lit(" "), (key % 50).cast("string")).alias("title"),
        (F.col("p_size") * 1000 + 250).cast("int").alias("duration_ms"),
        F.concat(F.lit("/music/"), "p_brand", F.lit("/"), (key % 20).cast("string"), F.lit(" - "), "p_name", F.lit(" "), key.cast("string"), F.lit(".flac")).alias("file_path"),
    )


RAW_TRACKS = """raw_tracks AS (
      SELECT p_partkey AS track_id, p_brand AS artist, p_type AS album, p_name || ' ' || (p_partkey % 50) AS title, (p_size * 1000 + 250)::INT AS duration_ms,
             '/music/' || p_brand || '/' || (p_partkey % 20) || ' - ' || p_name || ' ' || p_partkey || '.flac' AS file_path FROM part)"""


def raw_library(spark, sf_dir) -> DataFrame:
    """A second catalog: rows missing, titles in upper case, numbered or with endings, durations shifted, paths lost."""
    t = raw_tracks(spark, sf_dir).where("track_id % 10 <> 0")
    k = F.col("track_id")
    title = F.when(k % 7 == 0, F.upper("title")).when(k % 13 == 0, F.concat(F.lit("01 - "), "title")).when(k % 17 == 0, F.concat("title", F.lit(".flac"))).otherwise(F.col("title"))
    duration = F.col("duration_ms") + F.when(k % 11 == 0, 6000).when(k % 5 == 0, 4000).otherwise(0)
    return t.select((k + 1_000_000).alias("file_id"), "artist", "album", title.alias("title"), duration.cast("int").alias("duration_ms"), F.when(k % 3 != 0, F.col("file_path")).alias("path"))


RAW_LIBRARY = """raw_library AS (
      SELECT track_id + 1000000 AS file_id, artist, album,
             CASE WHEN track_id % 7 = 0 THEN upper(title) WHEN track_id % 13 = 0 THEN '01 - ' || title WHEN track_id % 17 = 0 THEN title || '.flac' ELSE title END AS title,
             (duration_ms + CASE WHEN track_id % 11 = 0 THEN 6000 WHEN track_id % 5 = 0 THEN 4000 ELSE 0 END)::INT AS duration_ms,
             CASE WHEN track_id % 3 <> 0 THEN file_path END AS path
      FROM raw_tracks WHERE track_id % 10 <> 0)"""

FIELD = "nfc_normalize(replace(regexp_replace(lower(coalesce({0}, '')), '^\\s+|\\s+$', '', 'g'), '|', '/'))"
TITLE = "regexp_replace(" + FIELD + ", '(.)\\.(mp3|flac|m4a|ogg|opus|wav|wma|aac|ape|wv)$', '\\1', 'i')"
KEY = "concat_ws('|', " + ", ".join(FIELD.format(c) for c in ("artist", "album", "title")) + ", ((duration_ms // 100) * 100)::VARCHAR)"
STEM = "regexp_replace(regexp_extract({0}, '([^/]*)$', 1), '(.)\\.[^.]+$', '\\1')"
NAME = "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '\\s*[(\\[].*?[)\\]]', '', 'g'), '^\\d+[.\\-\\s]+', ''), '\\s+', ' ', 'g'))"


def unknown(field: str, name: str) -> str:
    return f"CASE WHEN {field} = 'unknown {name}' THEN '' ELSE {field} END"


TRACKS = f"""{RAW_TRACKS},
    t AS (SELECT track_id, {KEY} AS metadata_key, {NAME.format(STEM.format("file_path"))} AS filename_key,
                 {unknown(FIELD.format("artist"), "artist")} AS artist, {unknown(FIELD.format("album"), "album")} AS album, {TITLE.format("title")} AS title, duration_ms, file_path FROM raw_tracks)"""
LIBRARY = f"""{RAW_LIBRARY},
    l AS (SELECT file_id, {KEY} AS metadata_key,
                 list_distinct(list_filter([coalesce({NAME.format(STEM.format("path"))}, ''), {NAME.format("coalesce(title, '')")}, {NAME.format("artist || ' - ' || coalesce(title, '')")}], lambda x: x <> '')) AS filename_keys,
                 {unknown(FIELD.format("artist"), "artist")} AS artist, {unknown(FIELD.format("album"), "album")} AS album, {TITLE.format("title")} AS title, duration_ms, path FROM raw_library)"""
BOTH = f"{TRACKS},\n    {LIBRARY}"


def tracks(spark, sf_dir) -> DataFrame:
    return link.catalog(raw_tracks(spark, sf_dir))


def library(spark, sf_dir) -> DataFrame:
    return link.library(raw_library(spark, sf_dir))
