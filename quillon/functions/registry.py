"""Functions for SQL text: vector and key functions as SQL expressions, a mean of vectors, and table functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import composed

_V = "ARRAY<DOUBLE>"
_DOT = "aggregate(zip_with({0}, {1}, (x, y) -> x * y), 0D, (s, x) -> s + x)"

#: name -> (arguments, type, expression); Spark inlines these, so they stay in the JVM.
EXPRESSIONS = {
    "dot": (f"a {_V}, b {_V}", "DOUBLE", _DOT.format("a", "b")),
    "cosine": (f"a {_V}, b {_V}", "DOUBLE", f"{_DOT.format('a', 'b')} / nullif(sqrt({_DOT.format('a', 'a')}) * sqrt({_DOT.format('b', 'b')}), 0D)"),
    "l2_normalize": (f"v {_V}", _V, f"CASE WHEN sqrt({_DOT.format('v', 'v')}) < 1e-10 THEN v ELSE transform(v, x -> x / sqrt({_DOT.format('v', 'v')})) END"),
    "filename_key": ("s STRING", "STRING", r"trim(regexp_replace(regexp_replace(regexp_replace(lower(s), '\\s*[(\\[].*?[)\\]]', ''), '^\\d+[.\\-\\s]+', ''), '\\s+', ' '))"),
}

_STRIP = r"regexp_replace({0}, '^\\s+|\\s+$', '')"

#: name -> (arguments, columns, query); table functions for use with LATERAL, in the JVM as well.
TABLES = {
    "artist_variants": (
        "artist STRING",
        "variant STRING",
        f"""SELECT explode(array_distinct(concat(
                n,
                transform(n, x -> CASE WHEN contains(x, '&') THEN regexp_replace(x, '\\\\s*&\\\\s*', ' and ') ELSE replace(x, ' and ', ' & ') END),
                transform(n, x -> replace(x, '.', '')),
                CASE WHEN s = '' THEN array('unknown artist') WHEN s = 'unknown artist' THEN array('') ELSE CAST(array() AS ARRAY<STRING>) END)))
            FROM (SELECT s, filter(transform(concat(array(s), split(s, ';'), split(s, ' / '), slice(split(s, ','), 1, 1)), x -> {_STRIP.format("x")}), x -> x <> '' OR s = '') AS n
                  FROM (SELECT {_STRIP.format("artist")} AS s))""",
    ),
}


def register(spark: SparkSession) -> None:
    """Make dot, cosine, l2_normalize, filename_key, nfc, vec_mean, artist_parts and artist_variants known to the session's SQL."""
    for name, (args, kind, body) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    for name, (args, columns, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS TABLE({columns}) RETURN {body}")
    spark.udf.register("nfc", F.pandas_udf(composed, "string"))

    def mean(v: pd.Series) -> list:
        return np.mean(np.stack(v.to_numpy()), axis=0).tolist() if len(v) else None

    mean.__annotations__ = {"v": pd.Series, "return": list}
    spark.udf.register("vec_mean", F.pandas_udf(mean, "array<double>", F.PandasUDFType.GROUPED_AGG))

    @F.udtf(returnType="variant string")
    class ArtistParts:
        """Parts of an artist between semicolons, itself first."""

        def eval(self, artist: str):
            seen = dict.fromkeys([artist, *(x.strip() for x in (artist or "").split(";"))])
            for x in seen:
                if x:
                    yield (x,)

    spark.udtf.register("artist_parts", ArtistParts)
