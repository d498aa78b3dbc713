"""Unigram tokens: the segmentation of a text into vocabulary pieces with the greatest sum of scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Score of a character outside the vocabulary.
UNKNOWN_SCORE = -100.0


def segment(text: str, vocabulary: dict[str, tuple[int, float]], longest: int, unknown: int) -> list[int]:
    """Ids of the best segmentation. Best ends by position, left to right; of equal ones the longest last piece."""
    best = [(0.0, 0, -1)] + [(float("-inf"), 0, unknown)] * len(text)
    for end in range(1, len(text) + 1):
        for begin in range(max(0, end - longest), end):
            piece = vocabulary.get(text[begin:end])
            if piece is None and end - begin > 1:
                continue
            i, s = piece or (unknown, UNKNOWN_SCORE)
            if best[begin][0] + s > best[end][0]:
                best[end] = (best[begin][0] + s, begin, i)
    out, at = [], len(text)
    while at > 0:
        _, begin, i = best[at]
        out.append(i)
        at = begin
    return out[::-1]


def unigram_ids(text: Column | str, vocabulary: DataFrame, unknown: int = 3, begin: int = 0, end: int = 2, pad: int = 1, size: int | None = 128, rows: int = 1_000_000) -> Column:
    """Token ids of a text: spaces become ``▁``, one is put first, begin and end are added, and all is cut and padded to ``size``.

    vocabulary: piece, id, score; of ``rows`` rows at most, as each worker holds it. size None: neither cut nor padded.
    """
    if vocabulary.limit(rows + 1).count() > rows:
        raise ValueError(f"the vocabulary has more than {rows} rows")
    table = {r["piece"]: (r["id"], r["score"]) for r in vocabulary.select("piece", "id", "score").collect()}
    held = vocabulary.sparkSession.sparkContext.broadcast((table, max(map(len, table), default=1)))

    def run(s: pd.Series) -> pd.Series:
        known, longest = held.value

        def one(x):
            words = " ".join((x or "").split())
            ids = segment("▁" + words.replace(" ", "▁"), known, longest, unknown) if words else []
            ids = [begin, *(ids if size is None else ids[: size - 2]), end]
            return ids if size is None else ids + [pad] * (size - len(ids))

        return s.map(one)

    return F.pandas_udf(run, "array<int>")(text)
