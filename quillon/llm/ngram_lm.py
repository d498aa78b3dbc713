"""LM scoring with Elias-Fano n-gram tries, one for each shard of the contexts.

The model is a bigram model with Dirichlet smoothing, p(w | h) = (c(h w) + mu p(w)) / (c(h) + mu), with an
add-one p(w). The first part, c(h w) / (c(h) + mu), is what the trie quantises.

Neither the vocabulary nor the n-grams fit in one place, and tokens are too many to be sent around one by one. So:

1. Documents are dealt to blocks by a hash of their id. A block makes its words and its (context, successor) pairs distinct
   and sends each shard of contexts one row of packed arrays: the pairs that stand in it, with their training counts.
2. A shard adds up the blocks' counts and builds its trie: sorted context hashes, monotone pointers into the
   successors, successors as a monotone sequence (context number, successor hash), and one byte for each quantised smoothed
   probability. The levels, Elias-Fano words, go to a nameless file that the task maps. Every distinct pair that the blocks sent is looked up
   in place: the context among those with its high bits, then the successor among those with its high bits within the range of the context's
   two pointers; only low parts that are compared are decoded. Answers go back by block, one byte a pair in the order of the request, and
   each context's exact count.
3. The answers, as a table, tell how many distinct words there are.
4. The block, read again, puts the answers to its tokens and adds up every document.

What a task holds is a block of texts or a shard of pairs. The most frequent words' successors are split among shards by the
successor's hash; their counts go along with every request.
"""

from __future__ import annotations

import mmap
import os
import tempfile
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import hashes, labels, mix, scratch_dir, shuffle_partitions, texts, written

#: Hashes that stand for a text's begin (a context only) and end (a token only).
BEGIN, END = np.uint64(0x8BADF00D5EED0001), np.uint64(0x4BADF00D5EED0002)


@dataclass(frozen=True)
class LmParams:
    """mu: weight of the unigram in the mixture. steps: quantised levels a decade, so code k > 0 stands for 10^(-(k-1)/steps).
    hot: so many of the most frequent words at most are split, if their share is above 1 / (4 * shards)."""

    mu: float = 4.0
    steps: int = 20
    hot: int = 64
    buckets: int = 64


#: SELECT[byte, r]: place of the r-th one of a byte; lookups ask for ones that exist alone.
SELECT = np.argsort(1 - np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little"), axis=1, kind="stable").astype(np.int64)


class EliasFano:
    """A monotone sequence as 64-bit words that are read in place: low bits packed side by side, high parts in unary, and before
    every word of these the ones and the zeros so far. Only what is asked for is decoded. Up to 2^32 bits of high parts."""

    def __init__(self, words: np.ndarray):
        self.n, self.width, low, high = (int(x) for x in words[:4])
        self.low, self.high = words[4 : 4 + low], words[4 + low : 4 + low + high]
        self.ones, self.zeros = words[4 + low + high : 4 + low + 2 * high].view("<u4").reshape(2, high)
        self.mask = np.uint64((1 << self.width) - 1)

    @staticmethod
    def pack(values: np.ndarray) -> np.ndarray:
        v = values.astype("<u8")
        n, top = len(v), int(v[-1]) if len(v) else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        step = 1 << 18  # so many low parts end at a word
        low = [np.packbits(np.unpackbits(v[i : i + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :width], bitorder="little") for i in range(0, n, step)]
        low = np.concatenate([*low, np.zeros(8, np.uint8)])
        low = np.append(low, np.zeros(-len(low) % 8, np.uint8)).view("<u8")
        parts = (v >> np.uint64(width)).astype(np.int64)
        bits = np.zeros(-(-(n + (top >> width) + 1) // 64) * 64, np.uint8)
        bits[parts + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)[:-1]])
        ranks = np.concatenate([ones, 64 * np.arange(len(high)) - ones]).astype("<u4").view("<u8")
        return np.concatenate([np.array([n, width, len(low), len(high)], "<u8"), low, high, ranks])

    def select(self, rank: np.ndarray, bit: int) -> np.ndarray:
        """Places of the rank-th ones, or zeros, among the bits of the high parts, counted from 0."""
        before = self.ones if bit else self.zeros
        word = np.searchsorted(before, rank.astype(np.uint32), "right") - 1
        r = rank - before[word].astype(np.int64)
        octets = (self.high[word] if bit else ~self.high[word]).astype("<u8").view(np.uint8).reshape(-1, 8)
        upto = np.cumsum(np.bitwise_count(octets), axis=1, dtype=np.int64)
        octet = (upto <= r[:, None]).sum(axis=1)
        row = np.arange(len(r))
        r = r - np.where(octet > 0, upto[row, octet - 1], 0)
        return 64 * word + 8 * octet + SELECT[octets[row, octet], r]

    def low_part(self, i: np.ndarray) -> np.ndarray:
        word, shift = np.divmod(i * self.width, 64)
        shift = shift.astype(np.uint64)
        above = (self.low[word + (self.width > 0)] << (np.uint64(63) - shift)) << np.uint64(1)
        return (self.low[word] >> shift | above) & self.mask

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        return (self.select(i, 1) - i).astype(np.uint64) << np.uint64(self.width) | self.low_part(i)

    def find(self, x: np.ndarray, first: np.ndarray | int = 0, last: np.ndarray | None = None) -> np.ndarray:
        """A place of each x within [first, last), all places by default; -1 where there is none."""
        if not self.n or not len(x):
            return np.full(len(x), -1)
        part = x >> np.uint64(self.width)
        inside = part <= np.uint64(64 * len(self.high) - self.n - 1)
        part = np.where(inside, part, 0).astype(np.int64)
        # values with one high part stand between two zeros
        a = np.where(part > 0, self.select(np.maximum(part - 1, 0), 0) - (part - 1), 0)
        end = np.minimum(self.select(part, 0) - part, self.n if last is None else last)
        a, b, y = np.maximum(a, first), end.copy(), x & self.mask
        at = np.flatnonzero(inside & (a < b))
        while len(at):
            mid = (a[at] + b[at]) // 2
            less = self.low_part(mid) < y[at]
            a[at[less]], b[at[~less]] = mid[less] + 1, mid[~less]
            at = at[a[at] < b[at]]
        at = np.flatnonzero(inside & (a < end))
        out = np.full(len(x), -1)
        hit = at[self.low_part(a[at]) == y[at]]
        out[hit] = a[hit]
        return out


class Trie:
    """Two levels in one mapped file: contexts (sorted hashes) with pointers, and successors with quantised probabilities."""

    def __init__(self, data: mmap.mmap):
        words = np.frombuffer(data, "<u8", len(data) // 8)
        cuts = np.cumsum([3, *words[:3].astype(np.int64)])
        self.contexts, self.pointers, self.successors = (EliasFano(words[i:j]) for i, j in zip(cuts, cuts[1:], strict=False))
        self.codes = np.frombuffer(data, np.uint8, self.successors.n, 8 * int(cuts[3]))

    @classmethod
    def open(cls, file: BinaryIO) -> Trie:
        """The trie in a file that ``write`` made; it is mapped, not read."""
        return cls(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))

    @staticmethod
    def write(file: BinaryIO, context: np.ndarray, successor: np.ndarray, code: np.ndarray) -> None:
        """The levels of (context, successor, code), sorted and distinct by the first two."""
        unique, start = np.unique(context, return_index=True)
        number = np.repeat(np.arange(len(unique), dtype=np.uint64), np.diff([*start, len(context)]))
        levels = (unique, np.array([*start, len(context)]), (number << np.uint64(32)) | successor.astype(np.uint64))
        packed = [EliasFano.pack(x) for x in levels]
        file.write(np.array([len(x) for x in packed], "<u8").tobytes())
        for x in packed:
            file.write(x.data)
        codes = code.astype(np.uint8).tobytes()
        file.write(codes + bytes(-len(codes) % 8))
        file.flush()

    def lookup(self, context: np.ndarray, successor: np.ndarray, step: int = 1 << 17) -> np.ndarray:
        """Codes of (context, successor) pairs, 0 where the trie has none. Pairs of one context should stand together."""
        out = np.zeros(len(context), np.uint8)
        for i in range(0, len(context), step):
            part = context[i : i + step]
            run = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            c = self.contexts.find(part[run])
            known = c >= 0
            first, last = np.zeros((2, len(run)), np.int64)
            first[known], last[known] = self.pointers.get(c[known]), self.pointers.get(c[known] + 1)
            c, first, last = (np.repeat(x, np.diff([*run, len(part)])) for x in (c, first, last))
            key = (np.maximum(c, 0).astype(np.uint64) << np.uint64(32)) | successor[i : i + step].astype(np.uint64)
            at = self.successors.find(key, first, last)
            hit = np.flatnonzero(at >= 0)
            out[i + hit] = self.codes[at[hit]]
        return out


def level_file(folder: str) -> BinaryIO:
    """A nameless file for a task's trie: in the scratch folder if that is mounted here, else in memory. It goes with the task."""
    url = urlparse(folder)
    if url.scheme in ("", "file") and os.path.isdir(url.path):
        return tempfile.TemporaryFile(dir=url.path)
    return os.fdopen(os.memfd_create("trie"), "w+b")


class Block:
    """Distinct words and (context, successor) pairs of some texts, and the shard and place of each pair.

    words: sorted hashes, the end among them; the begin has the number after the last. pairs are sorted by shard, context, successor.
    """

    def __init__(self, docs: list[bytes], shards: int, hot: np.ndarray, params: LmParams):
        found = [hashes(d.lower().split()) for d in docs]
        self.lengths = np.array([len(x) + 1 for x in found], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        now = np.full(int(self.lengths.sum()), END)
        inner = np.ones(len(now), bool)
        inner[self.ends - 1] = False
        now[inner] = np.concatenate(found)
        del found
        self.words, self.now = np.unique(now, return_inverse=True)
        before = np.empty_like(self.now)
        before[1:] = self.now[:-1]
        before[self.starts] = len(self.words)
        stride = len(self.words) + 1
        pairs, self.pair = np.unique(before * stride + self.now, return_inverse=True)
        self.context, self.successor = pairs // stride, pairs % stride
        names = np.append(self.words, BEGIN)
        self.h, self.s = names[self.context], (self.words[self.successor] >> np.uint64(32)).astype(np.uint32)
        spread = self.h.copy()
        if len(hot):
            split = np.isin(self.h, hot)
            bucket = self.s[split].astype(np.uint64) * np.uint64(params.buckets) >> np.uint64(32)
            spread[split] = mix(self.h[split] + (bucket + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        self.shard = ((spread >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
        self.order = np.argsort(self.shard, kind="stable")
        self.cuts = np.searchsorted(self.shard[self.order], np.arange(shards + 1))

    def slices(self):
        """(shard, pair numbers, first pair of each context among them) of every shard."""
        for k in range(len(self.cuts) - 1):
            at = self.order[self.cuts[k] : self.cuts[k + 1]]
            yield int(k), at, np.flatnonzero(np.diff(self.context[at], prepend=-1))


def survey(docs: DataFrame, shards: int, params: LmParams) -> tuple[np.ndarray, int]:
    """Sorted hashes of the words to split, and the number of training tokens.

    docs: text, train. A task passes on the words that make up 1 / (4 * shards) of its own tokens or more: a word with such a share of
    all has it in some task.
    """
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64())])
    least = 1 / (4 * shards)

    def rows(h, n):
        return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(n, pa.int64())], schema=schema)

    def run(parts):
        train, held, size = 0, [], 0

        def flush():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            top = n >= max(2, least * size)
            return rows(h[top].view(np.int64), n[top])

        for part in parts:
            for t, good in zip(texts(part.column(0)), part.column(1).to_pylist(), strict=True):
                h = hashes(t.lower().split())
                if good:
                    train += len(h) + 1
                held += [h, np.array([BEGIN])]
                size += len(h) + 1
                if size >= 4_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()
        yield rows([None], [train])

    found = docs.select("text", "train").mapInArrow(run, "h long, n long")
    counted = written(found.groupBy("h").agg(F.sum("n").alias("n")), "lm-survey")
    got = counted.where("h IS NULL").union(counted.where("h IS NOT NULL").orderBy(F.desc("n"), "h").limit(params.hot)).collect()
    total = sum(r["n"] for r in got if r["h"] is None)
    hot = np.array([r["h"] for r in got if r["h"] is not None and r["n"] >= least * total], np.int64)
    return np.sort(hot.view(np.uint64)), total


def remainder(mod: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % mod


def score(docs: DataFrame, train: Column, params: LmParams = LmParams()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document; doc_id and text alone are read.

    The documents for which ``train`` holds are learnt from. Words have A-Z lower-cased; every text ends in one more token. A null text is
    empty: its only token is the end. Repeated rows count and are scored each; a null id is kept. Without training documents
    all counts are 0. An empty table gives no rows.
    """
    spark = docs.sparkSession
    shards = shuffle_partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), train.alias("train"))
    hot, n_train = survey(rows, shards, params)
    names, folder = labels(spark, shards), scratch_dir(spark)
    place = F.array(*map(F.lit, names))
    t = rows.withColumn("block", F.get(place, F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))).repartition(shards, "block")

    binary = [(c, pa.binary()) for c in ("contexts", "sizes", "successors", "counts", "hot")]
    request = pa.schema([("shard", pa.int32()), ("block", pa.int32()), *binary])

    def ask(table: pa.Table) -> pa.Table:
        b = Block(texts(table["text"].combine_chunks()), shards, hot, params)
        w = np.repeat(np.array(table["train"].to_pylist(), bool), b.lengths)
        n = np.bincount(b.pair, weights=w, minlength=len(b.h)).astype(np.int64)
        per_hot = np.zeros(len(hot), np.int64)
        if len(hot):
            at = np.isin(b.h, hot)
            per_hot = np.bincount(np.searchsorted(hot, b.h[at]), weights=n[at], minlength=len(hot)).astype(np.int64)
        block = table["block"][0].as_py()
        out = []
        for k, at, first in b.slices():
            size = np.diff(np.append(first, len(at)))
            out.append((names[k], block, b.h[at[first]].tobytes(), size.astype("<u4").tobytes(), b.s[at].tobytes(), n[at].astype("<u4").tobytes(), per_hot.tobytes()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), request, strict=True)], schema=request)

    answer = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("codes", pa.binary()), ("totals", pa.binary()), ("known", pa.int64())])

    def reply(table: pa.Table) -> pa.Table:
        columns = [table[c].to_pylist() for c in ("contexts", "sizes", "successors", "counts")]
        contexts, sizes, successors, counts = ([np.frombuffer(x, k) for x in c] for c, k in zip(columns, ("<u8", "<u4", "<u4", "<u4"), strict=True))
        runs, per_run, s, n = (np.concatenate(x) for x in (contexts, sizes, successors, counts))
        unique, number = np.unique(runs, return_inverse=True)
        context = np.repeat(number, per_run)
        total = np.bincount(context, weights=n, minlength=len(unique)).astype(np.int64)
        whole = ~np.isin(unique, hot)
        if len(hot):
            sums = np.sum([np.frombuffer(x, np.int64) for x in table["hot"].to_pylist()], axis=0)
            total[~whole] = sums[np.searchsorted(hot, unique[~whole])]
        key = (context.astype(np.uint64) << np.uint64(32)) | s.astype(np.uint64)
        keys, at = np.unique(key, return_inverse=True)
        count = np.bincount(at, weights=n, minlength=len(keys))
        seen = np.flatnonzero(count)
        owner = (keys[seen] >> np.uint64(32)).astype(np.int64)
        p = count[seen] / (total[owner] + params.mu)
        code = np.clip(1 + np.ceil(-np.log10(p) * params.steps - 1e-9), 1, 255)
        with level_file(folder) as file:
            Trie.write(file, unique[owner], (keys[seen] & np.uint64(0xFFFFFFFF)).astype(np.uint32), code)
            trie = Trie.open(file)
        codes = trie.lookup(unique[(keys >> np.uint64(32)).astype(np.int64)], (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32))[at]
        totals = total[number]
        ends, run_ends = np.cumsum([len(x) for x in successors]), np.cumsum([len(x) for x in contexts])
        known = int((whole & (total > 0) & (unique != BEGIN)).sum())
        if len(hot) and table["shard"][0].as_py() == names[0]:
            known += int(((sums > 0) & (hot != BEGIN)).sum())
        out = [
            (block, shard, codes[e - len(x) : e].tobytes(), totals[r - len(c) : r].tobytes(), known if i == 0 else 0)
            for i, (block, shard, x, e, c, r) in enumerate(zip(table["block"].to_pylist(), table["shard"].to_pylist(), successors, ends, contexts, run_ends, strict=True))
        ]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), answer, strict=True)], schema=answer)

    result = pa.schema([("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    index = {name: i for i, name in enumerate(names)}
    decoded = np.concatenate([[0.0], 10.0 ** (-np.arange(255) / params.steps)])

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        b = Block(texts(table["text"].combine_chunks()), shards, hot, params)
        found = {index[s]: (c, t) for s, c, t in zip(answers["shard"].to_pylist(), answers["codes"].to_pylist(), answers["totals"].to_pylist(), strict=True)}
        codes, counts = np.zeros(len(b.h), np.uint8), np.zeros(len(b.words) + 1, np.int64)
        for k, at, first in b.slices():
            codes[at] = np.frombuffer(found[k][0], np.uint8)
            counts[b.context[at[first]]] = np.frombuffer(found[k][1], np.int64)
        counts[np.searchsorted(b.words, END)] = counts[-1]
        word = counts[:-1].astype(np.float64)
        unigram = (word + 1) / (n_train + v + 1)
        h = counts[b.context]
        p = decoded[codes] + params.mu / (h + params.mu) * unigram[b.successor]
        logs = np.log10(np.minimum(p, 1.0))[b.pair]
        plain = np.log10(unigram)[b.now]
        known = (word > 0)[b.now].astype(np.int64)
        out = [np.add.reduceat(x, b.starts) for x in (known, plain, logs)]
        return pa.Table.from_arrays([table["doc_id"].combine_chunks(), table["train"].combine_chunks(), pa.array(b.lengths), *map(pa.array, out)], schema=result)

    # a context is a word at every place but the last, so its total is its count as a word; that of the begin is the end's
    asked = t.groupBy("block").applyInArrow(ask, "shard int, block int, contexts binary, sizes binary, successors binary, counts binary, hot binary")
    replies = asked.repartition(shards, "shard").groupBy("shard").applyInArrow(reply, "block int, shard int, codes binary, totals binary, known long")
    replies = written(replies, "lm-replies")
    v = (replies.agg(F.sum("known")).head()[0] or 0) + (1 if n_train else 0)
    back = replies.drop("known").repartition(shards, "block")
    done = t.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(finish, "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return done.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")
