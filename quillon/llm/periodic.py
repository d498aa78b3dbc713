"""Periodic runs: stretches of words that repeat with a period, all of them, and texts without the repeats.

A run is a stretch of words that are equal a (smallest) period apart, at least twice the period and ``least`` words long, which neither
neighbouring word extends. The method, over the word ids of all texts of a batch in one array, where a word of its own stands after each stretch:

1. Stretches: a run holds words of which each lies in an n-gram of ``ceil(least / 2)`` words that its text has twice, so only stretches of such
   words are looked at. Hashes decide; a collision adds words and loses none.
2. A suffix array by doubling. The ranks of all substrings of 1, 2, 4, ... words are kept: with them the longest common extension of two places
   is found in a logarithmic number of steps, to the right as to the left, for any number of pairs at once.
3. The LCP array of neighbouring suffixes. Places leave the list of suffixes from last to first; the larger LCP beside one, when it leaves, is its
   longest previous factor. Taken from left to right, these are the Lempel-Ziv blocks.
4. Main's extensions: a run that touches a block's first word or ends before it has a period of at most both blocks' lengths, and
   for each such period the extensions around the boundary, with the period's copy on its right or on its left, give the run.
5. Any other run lies strictly within a block, which stands earlier too: runs are kept in buckets by start, and blocks from left to right copy those
   that lie within their earlier occurrence.

Time is O(n log n) for n words of such stretches, and so is memory: about 200 bytes a word. Texts never meet each other in a shuffle.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import P, mix

#: Words of texts whose stretches are worked on together; one longer text is a group of its own.
GROUP = 1 << 18
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])
COLUMNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def doubled(s: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of ``s``, whose last element stands nowhere else, and for k = 0, 1, ... the ranks of its substrings of 2**k elements."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    new = np.append(True, s[order][1:] != s[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    tables, k = [rank.astype(np.int32)], 1
    while True:
        # suffixes that share their first k elements with a neighbour; the others have their place
        alone = new & np.append(new[1:], True)
        at = np.flatnonzero(~alone)
        if not len(at):
            return order, tables
        here = order[at]
        by = np.lexsort((rank[here + k], rank[here]))
        here = here[by]
        order[at] = here
        first, second = rank[here], rank[here + k]
        new[at] = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))
        rank = rank.copy()
        rank[here] = np.maximum.accumulate(np.where(new[at], at, 0))
        tables.append(rank.astype(np.int32))
        k *= 2


def extension(tables: list[np.ndarray], i: np.ndarray, j: np.ndarray, left: bool = False) -> np.ndarray:
    """How many elements from places i and j on (to the left: up to them) are equal; i and j differ."""
    n, got = len(tables[0]), np.zeros(len(i), np.int64)
    # most pairs differ at once
    live = np.flatnonzero((i >= 0) & (j >= 0) & (i < n) & (j < n))
    live = live[tables[0][i[live]] == tables[0][j[live]]]
    a, b, more = i[live], j[live], np.zeros(len(live), np.int64)
    for k in range(len(tables) - 1, -1, -1):
        size = 1 << k
        if left:
            x, y = a - more - size + 1, b - more - size + 1
            ok = (x >= 0) & (y >= 0)
            x, y = np.maximum(x, 0), np.maximum(y, 0)
        else:
            x, y = a + more, b + more
            ok = (x < n) & (y < n)
            x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
        more += size * (ok & (tables[k][x] == tables[k][y]))
    got[live] = more
    return got


def previous_factors(order: np.ndarray, tables: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """For each place the length of the longest factor that also begins at an earlier place, and that place (-1 if the length is 0)."""
    n = len(order)
    lcp = [0, *extension(tables, order[:-1], order[1:]).tolist(), 0]
    sa, rank = order.tolist(), tables[-1].tolist()
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    length, source = [0] * n, [-1] * n
    for i in range(n - 1, -1, -1):
        r = rank[i]
        up, down, low, high = before[r], after[r], lcp[r], lcp[after[r]]
        if low >= high:
            if low:
                length[i], source[i] = low, sa[up]
        else:
            length[i], source[i] = high, sa[down]
        lcp[down] = min(low, high)
        if up >= 0:
            after[up] = down
        if down < n:
            before[down] = up
    return length, source


def blocks(length: list[int]) -> np.ndarray:
    """Where the Lempel-Ziv blocks begin, and the end."""
    starts, i = [], 0
    while i < len(length):
        starts.append(i)
        i += length[i] or 1
    return np.array([*starts, len(length)])


def boundary_runs(starts: np.ndarray, tables: list[np.ndarray], least: int) -> list[tuple[int, int, int]]:
    """(start, end, period), end exclusive, of every run that touches a block's first element or ends right before one."""
    size = np.diff(starts)
    reach = size[:-1] + size[1:]
    b = np.repeat(starts[1:-1], reach)
    p = np.arange(len(b)) - np.repeat(np.cumsum(reach) - reach, reach) + 1
    found: dict[tuple[int, int], int] = {}
    for x, y in ((b, b + p), (b - p, b)):
        right, left = extension(tables, x, y), extension(tables, x - 1, y - 1, left=True)
        hit = np.flatnonzero((right + left >= p) & (right + left + p >= least))
        for i, j, q in zip((x - left)[hit].tolist(), (y + right)[hit].tolist(), p[hit].tolist(), strict=True):
            found[i, j] = min(q, found.get((i, j), q))
    return [(i, j, q) for (i, j), q in found.items()]


def all_runs(s: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of ``s``, whose last element stands nowhere else, that are ``least`` long."""
    order, tables = doubled(s)
    length, source = previous_factors(order, tables)
    starts = blocks(length)
    bucket: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i, j, q in boundary_runs(starts, tables, least):
        bucket[i].append((j, q))
    for b, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if e - b <= least + 1:
            continue
        back = b - source[b]
        for i in range(b + 1, e - least):
            for j, q in bucket.get(i - back, ()):
                if j + back < e:
                    bucket[i].append((j + back, q))
    return [(i, j, q) for i, ends in bucket.items() for j, q in ends]


def stretches(ids: np.ndarray, text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the stretches, of ``least`` words or more, of words within n-grams that their text has twice. ids: of the words; text:
    the number of each word's text, ascending."""
    g = -(-least // 2)
    n = len(ids) - g + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = text[:n].astype(np.uint64)
    x = mix(ids.astype(np.uint64) + np.uint64(1))
    for i in range(g):
        h = h * P + x[i : i + n]
    whole = np.flatnonzero(text[:n] == text[g - 1 :])
    if not len(whole):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = h[whole]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = whole[order[np.append(same, False) | np.append(False, same)]]
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, twice, 1)
    np.add.at(change, twice + g, -1)
    inside = np.cumsum(change[:-1]) > 0
    # a stretch ends with its text, too
    new = np.append(True, text[1:] != text[:-1])
    begin = np.flatnonzero(inside & (new | ~np.append(False, inside[:-1])))
    end = np.flatnonzero(inside & (np.append(new[1:], True) | ~np.append(inside[1:], False))) + 1
    long = end - begin >= least
    return begin[long], end[long]


def runs_of(ids: np.ndarray, text: np.ndarray, least: int) -> np.ndarray:
    """Rows (start, length, period) of all runs by start and period; starts are places in ``ids``."""
    begin, end = stretches(ids, text, least)
    if len(begin):
        size = end - begin
        # stretches in one array, each with an element of its own after it
        total = int(size.sum()) + len(size)
        to = np.cumsum(size + 1) - size - 1
        s = np.empty(total, np.int64)
        s[to + size] = int(ids.max()) + 1 + np.arange(len(size))
        inner = np.repeat(to - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        s[inner] = ids[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        runs = np.array(all_runs(s, least), np.int64).reshape(-1, 3)
        shift = (begin - to)[np.searchsorted(to, runs[:, 0], "right") - 1]
        found = np.stack([runs[:, 0] + shift, runs[:, 1] - runs[:, 0], runs[:, 2]], axis=1)
        return found[np.lexsort((found[:, 2], found[:, 0]))]
    return np.zeros((0, 3), np.int64)


def split(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in one array, and how many each text has. Null texts have none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(column, ""))
    words, n = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    keep = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(n)), n)
    return words.filter(pa.array(keep)), np.bincount(text[keep], minlength=len(n))


def scan(batch: pa.RecordBatch, least: int) -> pa.RecordBatch:
    """SCHEMA's rows of a batch (doc_id, text)."""
    words, n = split(batch.column(1))
    ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    runs = [np.zeros((0, 3), np.int64)]
    # groups of whole texts
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(first, first[at] + GROUP, "right")) - 1)
        a, b = int(first[at]), int(first[to]) if to < len(n) else len(ids)
        r = runs_of(ids[a:b], text[a:b], least)
        r[:, 0] += a
        runs.append(r)
        at = to
    runs = np.concatenate(runs)
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(change[:-1]) == 0
    of = text[runs[:, 0]] if len(runs) else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(offsets(np.bincount(of, minlength=len(n))), pa.StructArray.from_arrays([pa.array(runs[:, 0] - first[of]), pa.array(runs[:, 1]), pa.array(runs[:, 2])], fields=list(RUN)))
    left = pa.ListArray.from_arrays(offsets(np.bincount(text[kept], minlength=len(n))), words.filter(pa.array(kept)))
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), lists, pc.binary_join(left, " ")], schema=SCHEMA)


def offsets(n: np.ndarray) -> pa.Array:
    return pa.array(np.append(0, np.cumsum(n)), pa.int32())


def find(docs: DataFrame, least: int = 12) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start and then period) and collapsed of every document.

    collapsed: the words that no run holds after its first period, joined by one space. Null, empty and blank texts have no words, no
    runs and an empty ``collapsed``. Repeated rows come out alike, once for each; other columns are not read; an empty table gives no rows.
    Each run has its smallest period; runs that overlap all count. A task holds one Arrow batch, or one longer text.
    """

    def run(batches):
        for batch in batches:
            yield scan(batch, least)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, COLUMNS)
