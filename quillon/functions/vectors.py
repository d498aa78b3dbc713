"""Vector expressions on ``array<float>`` columns, built from Spark's higher-order functions.

Sums run in double and in element order, so results equal those of any engine that does the same.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(values: Column) -> Column:
    """Sum of an array of doubles, left to right; 0 for an empty array."""
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: ColumnLike, b: ColumnLike) -> Column:
    """Inner product in double."""
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: ColumnLike) -> Column:
    """Euclidean length in double."""
    return F.sqrt(dot(v, v))


def cosine(a: ColumnLike, b: ColumnLike, epsilon: float = 0.0) -> Column:
    """dot / (norms + epsilon); null if a vector is 0 and epsilon too."""
    size = norm(a) * norm(b) + F.lit(epsilon)
    return F.when(size > 0, dot(a, b) / size)


def l2_normalize(v: ColumnLike, least: float = 1e-10) -> Column:
    """The vector in double at length 1; one shorter than ``least`` stays as it is."""
    return _bound(F.struct(_c(v).alias("v"), norm(v).alias("n")), lambda x: F.transform(x["v"], lambda e: F.when(x["n"] < least, e.cast("double")).otherwise(e.cast("double") / x["n"])))


def blend(vectors: Column) -> Column:
    """Signed weighted sum of an array of (weight, embedding) structs, in double."""
    scaled = F.transform(vectors, lambda s: F.transform(s["embedding"], lambda e: e.cast("double") * s["weight"].cast("double")))
    return F.aggregate(F.slice(scaled, 2, F.greatest(F.size(scaled) - 1, F.lit(0))), F.get(scaled, F.lit(0)), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))


def interpolate(alpha: ColumnLike, a: ColumnLike, b: ColumnLike) -> Column:
    """normalize(alpha * a + (1 - alpha) * b)."""
    return l2_normalize(F.zip_with(_c(a), _c(b), lambda x, y: _c(alpha) * x.cast("double") + (1 - _c(alpha)) * y.cast("double")))


def is_sane(v: ColumnLike) -> Column:
    """Whether there is a vector without NaN and infinite elements."""
    bad = F.exists(_c(v), lambda e: F.isnan(e) | (F.abs(e) == float("inf")))
    return F.coalesce((F.size(_c(v)) > 0) & ~bad, F.lit(False))


def abs_max(v: ColumnLike) -> Column:
    return F.array_max(F.transform(_c(v), lambda e: F.abs(e.cast("double"))))


def clamp(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def truncated_percent(x: Column) -> Column:
    """A share as whole percent, cut towards 0."""
    return (x * 100).cast("int")


def _bound(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def vec_mean(df, keys: list[str], column: str = "embedding", weight: str | None = None):
    """keys, embedding: the (weighted) mean vector of each group. A mask of 0 and 1 as ``weight`` gives the mean of the rows it keeps; elements
    are null where the weights add up to 0.

    Elements are exploded and averaged by (keys, place): partial sums are made before the shuffle, so a group of any size, also one that
    holds most rows, moves a vector for each task only.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    each = df.select(*keys, w.alias("__w"), F.posexplode(column).alias("__at", "__x"))
    mean = F.try_divide(F.sum(F.col("__x").cast("double") * F.col("__w")), F.sum("__w")).alias("__x")
    sums = each.groupBy(*keys, "__at").agg(mean)
    out = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__at", "__x"))).alias("__v"))
    return out.select(*keys, F.transform("__v", lambda s: s["__x"]).alias(column))
