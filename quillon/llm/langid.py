"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

* Features: character n-grams (1 to 3) of the text with other characters than letters as one space, hashed to a fixed number
  of features; weights are (1 + ln count) * idf, scaled to length 1.
* idf: document frequencies over all training documents, added up as dense arrays, one for each task.
* Fit: follow-the-regularised-leader with elastic-net penalties. A bounded, per-language sample is dealt to a few
  shards; each shard is fitted by one task, and the shards' weights are averaged.
* Calibration: the temperature that gives held-back sample documents the least log loss, of a fixed grid.
* Prediction: one pass over whole texts, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import batch, labels, shuffle_partitions

UNKNOWN = "und"
TEMPERATURES = np.geomspace(0.02, 5.0, 56)


@dataclass(frozen=True)
class LangParams:
    """per_language: at most about so many documents of a language fit and calibrate the model; every language has a class, which takes
    1 MB of a fit task at the default number of features. The idf counts all training documents. alpha, beta, l1, l2: of the FTRL updates.
    smoothing: share of every calibration target that is spread over all languages, so separable languages get no certain scores."""

    features: int = 1 << 15
    orders: tuple[int, ...] = (1, 2, 3)
    per_language: int = 1500
    shards: int = 4
    epochs: int = 2
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.05
    smoothing: float = 1e-3


@lru_cache(1)
def letters() -> np.ndarray:
    """For every code point itself if it is a letter, else a space."""
    table = np.full(0x110000, 32, np.uint32)
    found = np.array([i for i in range(0x110000) if chr(i).isalpha()], np.uint32)
    table[found] = found
    return table


def grams(text: str, params: LangParams) -> np.ndarray | None:
    """Hashed n-grams of a text in order of length; None if it has no letter."""
    points = letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    space = points == 32
    if space.all():
        return None
    keep = ~space
    keep[1:] |= ~space[:-1]
    points = np.concatenate([np.array([32], np.uint32), points[keep]]).astype(np.uint64)
    out, h = [], np.zeros(len(points), np.uint64)
    for n in range(1, max(params.orders) + 1):
        if n > len(points):
            break
        h = (h[: len(points) - n + 1] * np.uint64(0x100000001B3)) + points[n - 1 :] + np.uint64(n)
        if n in params.orders:
            x = h * np.uint64(0x9E3779B97F4A7C15)
            out.append(((x ^ (x >> np.uint64(32))) & np.uint64(params.features - 1)).astype(np.int64))
    return np.concatenate(out)


def counted(text: str | None, params: LangParams) -> tuple[np.ndarray, np.ndarray] | None:
    """Features of a text and their counts."""
    g = grams(text, params) if text else None
    if g is None:
        return None
    n = np.bincount(g, minlength=params.features)
    at = np.flatnonzero(n)
    return at, n[at]


def weighed(found: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> np.ndarray:
    at, n = found
    x = (1 + np.log(n)) * idf[at]
    return x / max(np.sqrt((x * x).sum()), 1e-12)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, params: LangParams) -> np.ndarray:
    """Weights (features x classes) after ``epochs`` passes over (features, values, class)."""
    z = np.zeros((params.features, classes))
    n = np.zeros_like(z)

    def weights(at):
        zz, nn = z[at], n[at]
        w = -(zz - np.sign(zz) * params.l1) / ((params.beta + np.sqrt(nn)) / params.alpha + params.l2)
        return np.where(np.abs(zz) <= params.l1, 0.0, w)

    for _ in range(params.epochs):
        for at, x, y in rows:
            w = weights(at)
            p = x @ w
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / params.alpha
            z[at] += g - step * w
            n[at] += g * g
    return weights(np.arange(params.features))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float
    params: LangParams


def remainder(mod: int) -> Column:
    """crc32 of the id's text, modulo ``mod``; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string")) % mod


def document_frequencies(train: DataFrame, params: LangParams) -> tuple[np.ndarray, int]:
    """In how many texts each feature stands, and how many texts have a letter."""
    schema = pa.schema([("feature", pa.int32()), ("n", pa.int64())])

    def run(parts):
        total, seen = np.zeros(params.features + 1, np.int64), np.zeros(params.features, bool)
        for part in parts:
            for text in part.column(0).to_pylist():
                g = grams(text, params) if text else None
                if g is not None:
                    seen[g] = True
                    total[:-1] += seen
                    seen[g] = False
                    total[-1] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], schema=schema)

    got = train.select("text").mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(params.features + 1, np.int64)
    out[got["feature"]] = got["n"]
    return out[:-1], int(out[-1])


def fit(docs: DataFrame, train: Column, params: LangParams = LangParams()) -> Model | None:
    """A model of the documents for which ``train`` holds and whose lang is not null; None if there are none with a letter."""
    rows = docs.where(train & F.col("lang").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    found = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not found:
        return None
    names = sorted(r["lang"] for r in found)
    df, total = document_frequencies(rows, params)
    if not total:
        return None
    idf = np.log((1 + total) / (1 + df)) + 1
    place = F.create_map(*[F.lit(x) for i, name in enumerate(names) for x in (name, i)])
    rate = F.create_map(*[F.lit(x) for r in found for x in (r["lang"], params.per_language / r["count"])])
    chance = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 20)) / float(1 << 20)
    drawn = rows.where(chance < F.try_element_at(rate, F.col("lang"))).withColumn("y", F.try_element_at(place, F.col("lang")))
    drawn = drawn.withColumn("deal", F.pmod(F.xxhash64("doc_id", F.lit("deal")), F.lit(5 * params.shards)))
    parts = max(params.shards, shuffle_partitions(docs.sparkSession))
    shard = F.get(F.array(*map(F.lit, labels(docs.sparkSession, parts)[: params.shards])), F.pmod("deal", F.lit(params.shards)).cast("int"))
    hold = F.col("deal") < params.shards
    classes = len(names)

    def fitted(table: pa.Table) -> pa.Table:
        pdf = table.to_pandas().sort_values("doc_id", kind="stable")
        examples = [(f[0], weighed(f, idf), y) for t, y in zip(pdf["text"], pdf["y"], strict=True) if (f := counted(t, params))]
        order = np.random.default_rng(0).permutation(len(examples))
        w = ftrl([examples[i] for i in order], classes, params)
        at, c = np.nonzero(w)
        return pa.table({"feature": pa.array(at.astype(np.int32)), "y": pa.array(c.astype(np.int32)), "w": pa.array(w[at, c])})

    fit_rows = drawn.where(~hold | (F.lit(len(found)) < 2)).select(shard.alias("shard"), "doc_id", "text", "y")
    each = fit_rows.repartition(parts, "shard").groupBy("shard").applyInArrow(fitted, "feature int, y int, w double")
    mean = each.groupBy("feature", "y").agg((F.sum("w") / params.shards).alias("w")).toPandas()
    w = np.zeros((params.features, classes))
    w[mean["feature"], mean["y"]] = mean["w"]

    def losses(parts):
        loss = np.zeros(len(TEMPERATURES))
        for part in parts:
            for text, y in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if f := counted(text, params):
                    s = weighed(f, idf) @ w[f[0]]
                    s = s[None, :] / TEMPERATURES[:, None]
                    top = s.max(axis=1)
                    goal = (1 - params.smoothing) * s[:, y] + params.smoothing * s.mean(axis=1)
                    loss += top + np.log(np.exp(s - top[:, None]).sum(axis=1)) - goal
        yield pa.RecordBatch.from_pydict({"t": pa.array(range(len(loss)), pa.int32()), "loss": pa.array(loss)})

    got = drawn.where(hold).select("text", "y").mapInArrow(losses, "t int, loss double").groupBy("t").agg(F.sum("loss").alias("loss")).toPandas()
    loss = pd.Series(got["loss"].values, got["t"]).sort_index()
    temperature = float(TEMPERATURES[int(loss.idxmin())]) if len(loss) and loss.max() > 0 else 1.0
    return Model(tuple(names), idf.astype(np.float32), w.astype(np.float32), temperature, params)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score of every document; doc_id and text alone are read.

    score is the calibrated probability of lang_pred, of equal ones that of the first language by name. A null text, one without a
    letter, or any text without a model is ``und`` with score 0. Repeated rows are judged each; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(parts):
        m = held.value
        for part in parts:
            rows = []
            for i, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                f = counted(text, m.params) if m else None
                if f is None:
                    rows.append((i, UNKNOWN, 0.0))
                    continue
                s = (weighed(f, m.idf) @ m.weights[f[0]]) / m.temperature
                p = np.exp(s - s.max())
                rows.append((i, m.languages[int(p.argmax())], float(p.max() / p.sum())))
            yield batch(rows, schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
