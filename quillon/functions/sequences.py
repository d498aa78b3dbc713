"""Arithmetic of playlists and of audio windows as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def decay(kind: Column | str, alpha: Column | float, step: Column, total: Column) -> Column:
    """Weight of the seed at a step: NONE, LINEAR, EXPONENTIAL or STEP; any other name as EXPONENTIAL. One step or fewer: alpha."""
    kind, alpha = _c(kind), alpha if isinstance(alpha, Column) else F.lit(alpha)
    p = step / (total - 1)
    curve = F.when(kind == "NONE", alpha).when(kind == "LINEAR", alpha * (1 - p)).when(kind == "STEP", F.when(p < 0.5, alpha).otherwise(alpha * 0.2)).otherwise(alpha * F.exp(-3 * p))
    return F.when(total <= 1, alpha).otherwise(curve)


def ema_provenance(index: Column, beta: float, least: float = 0.01) -> Column:
    """Sources of a drifting query by exponential moving average before pick ``index``: array of (source, weight).

    Source -1 is the seed, with beta^index; pick j < index has (1 - beta) beta^(index - j - 1). Weights of ``least`` and less are left out.
    """
    index = index.cast("int")
    seed = F.array(F.struct(F.lit(-1).alias("source"), F.pow(F.lit(beta), index).alias("weight")))
    picks = F.transform(F.sequence(F.lit(0), index - 1), lambda j: F.struct(j.alias("source"), ((1 - beta) * F.pow(F.lit(beta), index - j - 1)).alias("weight")))
    both = F.when(index <= 0, seed).otherwise(F.concat(seed, picks))
    return F.filter(both, lambda s: s["weight"] > least)


def interpolation_provenance(index: Column, alpha: Column) -> Column:
    """Sources of an interpolated query: the seed with alpha, the pick before with the rest; the seed alone at first."""
    both = F.array(F.struct(F.lit(-1).alias("source"), alpha.alias("weight")), F.struct((index - 1).cast("int").alias("source"), (1 - alpha).alias("weight")))
    return F.when(index <= 0, F.array(F.struct(F.lit(-1).alias("source"), F.lit(1.0).alias("weight")))).otherwise(both)


def window_count(samples: Column, rate: int = 24_000, seconds: int = 5) -> Column:
    """Windows of fixed length without overlap; a tail of a second or more counts as one."""
    size = rate * seconds
    return F.floor(samples / size).cast("long") + F.when(samples % size >= rate, 1).otherwise(0)


def carried_windows(samples: Column | str, chunks: WindowSpec, size: int) -> tuple[Column, Column]:
    """Of a stream decoded in chunks of so many samples: the windows of ``size`` that each chunk completes, with what the chunks before it left, and the
    samples it leaves for the next. ``chunks``: a stream's chunks in order. Both follow from a running sum, so no chunk waits for another's state.
    Null counts as no samples."""
    n = F.coalesce(_c(samples), F.lit(0)).cast("long")
    so_far = F.sum(n).over(chunks.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return F.floor(so_far / size).cast("long") - F.floor((so_far - n) / size).cast("long"), so_far % size


def refresh_reason(count: Column, now_print: Column, saved_print: Column, checked_ms: Column, now_ms: Column, hours: int = 24) -> Column:
    """Why a saved count of missing tracks is to be taken anew, null if it isn't: ``count`` -1 while it is being taken, -2 before the first time."""
    reasons = F.when(count == -2, "count not checked yet").when(~now_print.eqNullSafe(saved_print), "database fingerprint changed")
    reasons = reasons.when(F.coalesce(checked_ms, F.lit(0)) <= 0, "missing freshness timestamp")
    return F.when(count != -1, reasons.when(now_ms - checked_ms >= hours * 3_600_000, f"stale after {hours}h"))


def segments(frames: Column, size: int = 128) -> Column:
    """Segments of ``size`` frames as (start, weight): the last one is moved back to be whole and weighs the frames it adds."""
    frames = frames.cast("long")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(frames - 1, F.lit(0)), F.lit(size).cast("long"))
    one = lambda s: F.struct(F.greatest(F.least(s, frames - size), F.lit(0).cast("long")).alias("start"), F.least(F.lit(size).cast("long"), frames - s).alias("weight"))
    return F.when(frames > 0, F.transform(starts, one)).otherwise(F.array().cast("array<struct<start:bigint,weight:bigint>>"))


def standardized(signal: Column | str, least: float = 1e-7) -> Column:
    """A signal (array) less its mean, by its standard deviation; ``least`` is added to the variance. An empty or null one stays."""
    x = F.transform(_c(signal), lambda v: v.cast("double"))
    sums = F.aggregate(x, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("n")), lambda a, v: F.struct((a["s"] + v).alias("s"), (a["n"] + 1.0).alias("n")), lambda a: F.try_divide(a["s"], a["n"]))
    centred = F.get(F.transform(F.array(F.struct(x.alias("x"), sums.alias("m"))), lambda t: F.transform(t["x"], lambda v: v - t["m"])), F.lit(0))
    spread = F.aggregate(centred, F.lit(0.0), lambda a, v: a + v * v)
    bound = F.array(F.struct(centred.alias("c"), F.sqrt(F.try_divide(spread, F.size(centred)) + least).alias("d")))
    return F.get(F.transform(bound, lambda t: F.transform(t["c"], lambda v: v / t["d"])), F.lit(0))


def moving_average(values: Column | str, weight: float = 0.3) -> Column:
    """Exponential moving average after the last of some measurements; the newest has ``weight``, and one that follows no positive average starts
    anew. 0 without measurements."""
    return F.aggregate(_c(values), F.lit(0.0), lambda a, v: F.when(a <= 0, v.cast("double")).otherwise(a * (1 - weight) + v.cast("double") * weight))


def damped(estimates: Column | str, rise: float = 1.2) -> Column:
    """The last of some estimates (whole numbers) of which each exceeds the one shown before by a factor of ``rise`` at most."""
    step = lambda a, v: F.when((v > a) & (a > 0), F.least(v.cast("long"), (a * rise).cast("long"))).otherwise(v.cast("long"))
    return F.aggregate(_c(estimates), F.lit(0).cast("long"), step)
