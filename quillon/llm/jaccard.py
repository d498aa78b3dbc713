"""N-gram Jaccard join with signature trees: exact classes of documents whose shingle sets are alike.

1. Documents with equal sets fall into one node (aggregated by a hash of the set), so copies are never paired.
2. Two sets with Jaccard likeness t share one of the first |S| - ceil(t |S|) + 1 shingles of each in any common order; the order
   puts the corpus's most frequent shingles last. Nodes that share such a shingle are a group.
3. In a few rounds each node is checked against one partner outside its component: a member, drawn by a hash, of the largest
   component in one of its groups, that with which it shares most. That is linear work and joins nearly all that is alike.
   Groups whose nodes are all of one component are done.
4. What is left goes through signature trees: token bitmaps, combined by OR up the tree with ranges of sizes. A dual
   traversal drops pairs of tree nodes that are of one component, whose sizes don't fit, or whose largest possible overlap is
   too small. Large groups are cut into blocks by nodes and by shingles, and a tree pair is one pair of blocks. A task tells
   which of its nodes remain, each once, however many pairs they make.
5. The sets of these nodes go to what is left of the groups, of equal ones to one, where remaining pairs are checked, unless their nodes have been joined
   meanwhile. Only links that join two components leave a task, so fewer than it has nodes.

Sizes and bitmaps come before sets: a set is made again from its text, and moved, only for a pair that they let pass. All checks are exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from quillon.llm.common import batch, hashes, shingles, shuffle_partitions, sized, texts, written
from quillon.llm.graph import components

LOW = -(1 << 63)
#: Bytes of sets that one Arrow batch carries.
SENT = 1 << 23


@dataclass(frozen=True)
class JaccardParams:
    """words of a shingle; percent: least Jaccard likeness of a link; frequent: so many of the most frequent shingles are ordered last (speed
    only); block: nodes of a group that one tree holds; shingles: about so many of them; rounds: of checks against single partners, before trees take
    what is left."""

    words: int = 5
    percent: int = 80
    frequent: int = 200_000
    block: int = 1024
    shingles: int = 500_000
    rounds: int = 2


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, A-Z lower-cased."""
    return np.unique(shingles(hashes(text.lower().split()), words))


def frequent_shingles(docs: DataFrame, params: JaccardParams) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles that stand in most documents, and the rank of each, the most frequent last. Tasks add up their
    documents' sets and pass on what they met more than once."""
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64())])

    def run(parts):
        held, size = [], 0

        def flush():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[n > 1].view(np.int64)), pa.array(n[n > 1])], schema=schema)

        for part in parts:
            for t in texts(part.column(0)):
                held.append(shingle_set(t, params.words))
                size += len(held[-1])
                if size > 2_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    counted = written(docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "frequent")
    # the least count of which there are few enough, by a table of counts: no task sees more than its own part
    least, size = None, 0
    for row in counted.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).limit(params.frequent).toLocalIterator():
        size += row["k"]
        if size > params.frequent:
            break
        least = row["n"]
    top = counted.where(F.col("n") >= least if least else F.lit(False)).toPandas().sort_values(["n", "h"], ascending=[False, True])
    h = top["h"].to_numpy(np.int64).view(np.uint64)
    at = np.argsort(h)
    # rarer ones first: they come in descending order
    return h[at], (len(h) - 1 - at).astype(np.int64)


def bitmap(s: np.ndarray) -> bytes:
    """Token bitmap of a set, of the power of two of bits (512 to 16,384) from four times its size on."""
    width = min(1 << 14, max(512, 1 << int(4 * len(s) - 1).bit_length()))
    bits = np.zeros(width, np.uint8)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


class Tree:
    """Signature tree of some nodes, which are sorted by size: levels from the leaves (single nodes) up, eight to one."""

    FAN = 8

    def __init__(self, n: np.ndarray, bits: np.ndarray, comp: np.ndarray):
        slack = n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, n, n, slack, comp, comp)]
        while len(self.levels[-1][0]) > 1:
            b, lo, hi, sl, c0, c1 = self.levels[-1]
            at = np.arange(0, len(b), self.FAN)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(sl, at), np.minimum.reduceat(c0, at), np.maximum.reduceat(c1, at)))


def may_link(p: tuple, q: tuple, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs (i of level p, j of level q) may hold a link: not one component, sizes that fit, and an overlap that reaches
    percent / (100 + percent) of both sizes. A set's overlap is at most its size less those of its bits that the other lacks."""
    pb, plo, phi, psl, pc0, pc1 = p
    qb, qlo, qhi, qsl, qc0, qc1 = q
    ok = ~((pc0[i] == pc1[i]) & (qc0[j] == qc1[j]) & (pc0[i] == qc0[j]))
    ok &= (100 * phi[i] >= percent * qlo[j]) & (100 * qhi[j] >= percent * plo[i])
    at = np.flatnonzero(ok)
    for k in range(0, len(at), 4096):
        a = at[k : k + 4096]
        common = np.bitwise_count(pb[i[a]] & qb[j[a]]).sum(axis=1, dtype=np.int64)
        most = common + np.minimum(psl[i[a]], qsl[j[a]])
        ok[a] = (100 + percent) * most >= percent * (plo[i[a]] + qlo[j[a]])
    return ok


def dual(p: Tree, q: Tree, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of single nodes of both trees that may be linked; of one tree with itself each pair once."""
    same = p is q
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    a, b = len(p.levels) - 1, len(q.levels) - 1
    while True:
        ok = may_link(p.levels[a], q.levels[b], i, j, percent)
        i, j = i[ok], j[ok]
        if not len(i) or (a == 0 and b == 0):
            return i, j
        if same or a >= b:
            i, j, a = *_down(i, j, len(p.levels[a - 1][0])), a - 1
            if same:
                j, i, b = *_down(j, i, len(q.levels[b - 1][0])), b - 1
                keep = i < j if a == 0 else i <= j
                i, j = i[keep], j[keep]
        else:
            j, i, b = *_down(j, i, len(q.levels[b - 1][0])), b - 1


def _down(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    kids = (i[:, None] * Tree.FAN + np.arange(Tree.FAN)).ravel()
    j = np.repeat(j, Tree.FAN)
    return kids[kids < n], j[kids < n]


def candidates(node: np.ndarray, n: np.ndarray, comp: np.ndarray, bits: list[bytes], side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a group that may be linked; side: 0 and 1 of two blocks, of which only pairs across count, or all 2."""
    order = np.lexsort((node, n))
    n, comp, side = n[order], comp[order], side[order]
    wide = np.array([len(bits[k]) for k in order])
    out_a, out_b = [], []

    def tree(width: int, at: np.ndarray) -> Tree:
        m = np.stack([np.frombuffer(bits[order[k]], np.uint64) for k in at])
        while m.shape[1] * 8 > width:
            half = m.shape[1] // 2
            m = m[:, :half] | m[:, half:]
        return Tree(n[at], m, comp[at])

    def cross(width: int, x: np.ndarray, y: np.ndarray | None) -> None:
        if len(x) and (y is None or len(y)):
            p = tree(width, x)
            i, j = dual(p, p if y is None else tree(width, y), percent)
            out_a.append(order[x[i]])
            out_b.append(order[(x if y is None else y)[j]])

    for w in np.unique(wide):
        # sizes that may be linked have equal or neighbouring widths: the wider bitmaps are folded
        here, next_ = wide == w, wide == 2 * w
        at = np.flatnonzero(here)
        if (side == 2).all():
            cross(w, at, None)
            cross(w, at, np.flatnonzero(next_))
        else:
            for s in (0, 1):
                if s == 0:
                    cross(w, np.flatnonzero(here & (side == 0)), np.flatnonzero(here & (side == 1)))
                cross(w, np.flatnonzero(here & (side == s)), np.flatnonzero(next_ & (side == 1 - s)))
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    return np.minimum(a, b), np.maximum(a, b)


class Components:
    """Components that links have joined so far, by the least member."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        path = []
        while (y := self.parent.get(x, x)) != x:
            path.append(x)
            x = y
        for y in path:
            self.parent[y] = x
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether they were apart."""
        x, y = self.root(x), self.root(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
        return x != y


def _grouped(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Distinct values of a, which is sorted, and the values of b beside each."""
    values, first = np.unique(a, return_index=True)
    return values.tolist(), np.split(b, first[1:]) if len(a) else []


def spanning(node: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], side: np.ndarray, known: Components, params: JaccardParams) -> list[tuple[int, int]]:
    """Links of a group (side as in ``candidates``) that join components which ``known`` holds apart, checked on the full sets: fewer than its nodes."""
    n = np.array([len(x) for x in sets])
    now = np.array([known.root(c) for c in comp.tolist()])
    a, b = candidates(node, n, now, [bitmap(x) for x in sets], side, params.percent)
    order = np.lexsort((b, a))
    out = []
    for i, waiting in zip(*_grouped(a[order], b[order]), strict=True):
        while len(waiting):
            mine = known.root(int(comp[i]))
            waiting = waiting[[known.root(int(comp[j])) != mine for j in waiting]]
            # as many as fit into a bounded piece of memory
            some = waiting[: max(1, int(np.searchsorted(np.cumsum(n[waiting]), params.shingles)))]
            waiting = waiting[len(some) :]
            if not len(some):
                break
            both = np.concatenate([sets[j] for j in some])
            at = np.minimum(np.searchsorted(sets[i], both), n[i] - 1)
            shared = np.add.reduceat((sets[i][at] == both).astype(np.int64), np.append(0, np.cumsum(n[some])[:-1]))
            for j in some[100 * shared >= params.percent * (n[i] + n[some] - shared)]:
                if known.join(int(comp[i]), int(comp[j])):
                    out.append((int(node[i]), int(node[j])))
    return out


BASE = "doc_id long, n long, node long, bits binary, last array<long>, shard int, tokens binary, nodes binary"
BASE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("bits", pa.binary()), ("last", pa.list_(pa.int64())), ("shard", pa.int32()), ("tokens", pa.binary()), ("nodes", pa.binary())])


def node_of(s: np.ndarray) -> int:
    return xxh3_64_intdigest(s.tobytes()) + LOW


def basis(docs: DataFrame, order: tuple[np.ndarray, np.ndarray], shards: int, params: JaccardParams) -> DataFrame:
    """One pass over the texts; written. Rows of two kinds:

    * with shard null, a document: doc_id, n, node (hash of the set; null if empty), bits, and last: the prefix's frequent shingles;
    * with a shard, packed (token, node) pairs: the prefixes' other shingles, sorted. A task tells a node's prefix once.
    """
    held = docs.sparkSession.sparkContext.broadcast(order)

    def run(parts):
        tail, rank = held.value
        told, tokens, owners, size = set(), [], [], 0

        def flush():
            t, o = np.concatenate(tokens), np.repeat(np.array([x for x, _ in owners], np.int64), [n for _, n in owners])
            at = np.argsort(t, kind="stable")
            t, o = t[at], o[at]
            cuts = np.searchsorted((t >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32), np.arange(shards + 1))
            rows = [(None, None, None, None, None, k, t[i:j].tobytes(), o[i:j].tobytes()) for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if i < j]
            return batch(rows, BASE_SCHEMA)

        for part in parts:
            rows = []
            for i, t in zip(part.column(0).to_pylist(), texts(part.column(1)), strict=True):
                s = shingle_set(t, params.words)
                if not len(s):
                    rows.append((i, 0, *[None] * 6))
                    continue
                node, last = node_of(s), None
                if node not in told:
                    told.add(node)
                    often = np.zeros(len(s), bool)
                    if len(tail):
                        at = np.minimum(np.searchsorted(tail, s), len(tail) - 1)
                        often = tail[at] == s
                    n = len(s) - -(-params.percent * len(s) // 100) + 1
                    rare = s[~often][:n]
                    if len(rare) < n:
                        last = s[often][np.argsort(rank[at[often]])][: n - len(rare)].view(np.int64)
                    tokens.append(rare)
                    owners.append((node, len(rare)))
                    size += len(rare)
                rows.append((i, len(s), node, bitmap(s), last, None, None, None))
            yield batch(rows, BASE_SCHEMA)
            if size > 1_000_000:
                yield flush()
                told, tokens, owners, size = set(), [], [], 0
        if size:
            yield flush()

    return written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, BASE), "sets")


def shared_tokens(base: DataFrame) -> DataFrame:
    """token, node, star (least node of the token), size (its nodes) of the tokens that two or more prefixes hold; written.

    The frequent shingles, of which one may be in any share of all prefixes, go through plain joins; the others, whose nodes are few, are
    matched a shard at a time.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("token", "node", "star", "size")])

    def match(table: pa.Table) -> pa.Table:
        t = np.concatenate([np.frombuffer(x, np.int64) for x in table["tokens"].to_pylist()])
        o = np.concatenate([np.frombuffer(x, np.int64) for x in table["nodes"].to_pylist()])
        at = np.lexsort((o, t))
        t, o = t[at], o[at]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (o[1:] != o[:-1])
        t, o = t[new], o[new]
        first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        n = np.diff(np.append(first, len(t)))
        many = np.repeat(n > 1, n)
        return pa.Table.from_arrays([pa.array(t[many]), pa.array(o[many]), pa.array(np.repeat(o[first], n)[many]), pa.array(np.repeat(n, n)[many])], schema=schema)

    rare = base.where("shard IS NOT NULL").select("shard", "tokens", "nodes").groupBy("shard").applyInArrow(match, "token long, node long, star long, size long")
    often = base.where("last IS NOT NULL").select("node", F.explode("last").alias("token")).distinct()
    tokens = often.groupBy("token").agg(F.min("node").alias("star"), F.count("*").alias("size")).where("size > 1")
    return written(rare.unionByName(often.join(tokens, "token")), "shared")


def verified(pairs: DataFrame, labels: DataFrame, docs: DataFrame, params: JaccardParams) -> DataFrame:
    """Of distinct pairs (a, b) those that are linked; written.

    The pairs of a are cut into parts of ``block`` at most; a's set goes to each part, b's to its own, in one shuffle. A document of each node
    is read again for its set. labels: node, label (the doc_id of one of its documents); rows that share a doc_id may bring sets
    that nothing asks for, which are passed over.
    """
    spark = docs.sparkSession
    pairs = written(pairs.select("a", "b"), "pairs")
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / params.block).cast("int").alias("parts"))
    dealt = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    to = F.struct("a", "part")
    goals = dealt.select(F.col("b").alias("node"), to.alias("to")).union(parts.select("a", "parts").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(F.col("a").alias("node"), to.alias("to")))
    goals = goals.groupBy("node").agg(F.collect_list("to").alias("to")).join(labels, "node").select(F.col("label").alias("id"), "node", "to")
    goals = written(goals, "goals")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)).alias("id"), "text").join(sized(goals), "id").select("text", "node", "to")
    schema = pa.schema([("a", pa.int64()), ("part", pa.int32()), ("b", pa.int64()), ("leader", pa.bool_()), ("shingles", pa.binary())])

    def send(batches_):
        for part in batches_:
            out, size = [], 0
            for t, node, to_ in zip(texts(part.column(0)), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                s = shingle_set(t, params.words)
                if node != node_of(s):
                    continue
                data = s.tobytes()
                for x in to_:
                    out.append((x["a"], x["part"], node, node == x["a"], data))
                    size += len(data)
                    if size > SENT:
                        yield batch(out, schema)
                        out, size = [], 0
            yield batch(out, schema)

    links = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def check(batches_):
        now, lead = None, None
        for part in batches_:
            out = []
            for a, k, b, leader, data in zip(*(c.to_pylist() for c in part.columns), strict=True):
                s = np.frombuffer(data, np.uint64)
                if leader:
                    now, lead = (a, k), s
                elif now == (a, k):
                    both = np.concatenate([lead, s])
                    both.sort(kind="stable")
                    shared = int((both[1:] == both[:-1]).sum())
                    if 100 * shared >= params.percent * (len(both) - shared):
                        out.append((a, b))
            yield batch(out, links)

    sent = rows.mapInArrow(send, "a long, part int, b long, leader boolean, shingles binary").repartition(shuffle_partitions(spark), "a", "part")
    return written(sent.sortWithinPartitions("a", "part", F.desc("leader")).mapInArrow(check, "a long, b long").distinct(), "links")


def sets_of(docs: DataFrame, nodes: DataFrame, labels: DataFrame, params: JaccardParams) -> DataFrame:
    """node, shingles (the packed set) of the given nodes; written. Of each node one document is read again."""
    wanted = written(nodes.join(labels, "node").select(F.col("label").alias("id"), "node"), "wanted")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)).alias("id"), "text").join(sized(wanted), "id").select("text", "node")
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    def run(parts):
        for part in parts:
            out, size = [], 0
            for t, node in zip(texts(part.column(0)), part.column(1).to_pylist(), strict=True):
                s = shingle_set(t, params.words)
                if node == node_of(s):
                    out.append((node, s.tobytes()))
                    size += 8 * len(s)
                    if size > SENT:
                        yield batch(out, schema)
                        out, size = [], 0
            yield batch(out, schema)

    found = written(rows.mapInArrow(run, "node long, shingles binary"), "node-sets")
    # rows that share a doc_id and their words bring a set twice
    return found if found.count() == wanted.count() else found.dropDuplicates(["node"])


def possible(pairs: DataFrame, slim: DataFrame, params: JaccardParams) -> DataFrame:
    """Of pairs (a, b) those that sizes and bitmaps let be linked."""
    x = slim.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("x"))
    y = slim.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("y"))
    both = pairs.join(x, "a").join(y, "b").where((100 * F.col("n_a") >= params.percent * F.col("n_b")) & (100 * F.col("n_b") >= params.percent * F.col("n_a")))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(parts):
        for part in parts:
            a, b, n, m, x, y = (c.to_pylist() for c in part.columns)
            out = [(a[i], b[i]) for i in range(len(a)) if len(candidates(np.array([a[i], b[i]]), np.array([n[i], m[i]]), np.arange(2), [x[i], y[i]], np.full(2, 2), params.percent)[0])]
            yield batch(out, schema)

    return both.select("a", "b", "n_a", "n_b", "x", "y").mapInArrow(run, "a long, b long")


def with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows with ``comp``: the root of their node, or the node itself."""
    return rows.join(roots, "node", "left").select(*rows.columns, F.coalesce("root", "node").alias("comp"))


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of all nodes that old roots and new links name; only components that the links touch are joined anew. Written."""
    a = with_roots(links.select(F.col("a").alias("node"), "b"), roots).select(F.col("comp").alias("x"), F.col("b").alias("node"))
    more = components(with_roots(a, roots).select(F.col("x").alias("a"), F.col("comp").alias("b"))).select(F.col("node").alias("comp"), F.col("root").alias("top"))
    nodes = roots.select("node").union(links.select("a")).union(links.select("b")).distinct()
    return written(with_roots(nodes, roots).join(more, "comp", "left").select("node", F.coalesce("top", "comp").alias("root")), "roots")


def classes(docs: DataFrame, params: JaccardParams = JaccardParams()) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; doc_id and text alone are read.

    component_id: the least doc_id that links reach, the document's own included. Null and empty texts, and those without words, have
    no shingles and are linked with nothing; a text of fewer words than a shingle is one shingle. Rows with equal sets are linked,
    also repeated rows; rows that share a doc_id but not a text are classed each by their text. A null doc_id counts as
    lower than all others and stays null. An empty table gives no rows.
    """
    shards = shuffle_partitions(docs.sparkSession)
    all_ = basis(docs, frequent_shingles(docs, params), shards, params)
    base = all_.where("shard IS NULL")
    low = F.coalesce("doc_id", F.lit(LOW))
    labels = written(base.where("n > 0").groupBy("node").agg(F.min(low).alias("label")), "nodes")
    shared = shared_tokens(all_)
    members = shared.select("node").distinct()
    slim = written(base.where("n > 0").select("node", "n", "bits").join(members, "node", "left_semi").dropDuplicates(["node"]), "bitmaps")

    # each node against one partner a round: the star, of its groups' largest components, with which it shares most
    roots = docs.sparkSession.createDataFrame([], "node long, root long")
    for turn in range(params.rounds):
        joined = with_roots(shared.select("token", "node", "size"), roots)
        each = joined.groupBy("token", "comp").agg(F.count("*").alias("n"), F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("star"))
        stars = each.groupBy("token").agg(F.max_by(F.struct("star", "comp"), F.struct("n", "star")).alias("s"), F.count("*").alias("comps"))
        stars = stars.where("comps > 1").select("token", "s.star", F.col("s.comp").alias("star_comp"))
        best = joined.join(stars, "token").where("comp <> star_comp").groupBy("node", "star").agg(F.count("*").alias("k"))
        best = best.groupBy("node").agg(F.max_by("star", F.struct("k", F.xxhash64("star", F.lit(turn)))).alias("star"))
        near = possible(best.select(F.col("star").alias("a"), F.col("node").alias("b")), slim, params)
        roots = merged(roots, verified(near, labels, docs, params))

    # groups that are not yet of one component, of groups with the same nodes one; in blocks
    joined = with_roots(shared.select("token", "node", "size"), roots)
    signs = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in (0, 1)]
    open_ = joined.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("size"), *signs).where("c0 <> c1")
    open_ = open_.groupBy("x0", "x1", "size").agg(F.min("token").alias("token")).select("token")
    rest = joined.join(open_, "token").join(slim, "node")
    blocks = F.ceil(F.greatest(F.first("size") / params.block, F.sum("n") / params.shingles)).cast("int").alias("blocks")
    rest = rest.join(rest.groupBy("token").agg(blocks), "token").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")})
    rest = rest.withColumn("side", F.when(F.col("i") == F.col("j"), 2).when(F.col("mine") == F.col("j"), 1).otherwise(0))
    key = ["token", "i", "j"]
    kind, names = "token long, i int, j int, side int, node long, comp long", [*key, "side", "node", "comp"]
    schema = pa.schema([(c, pa.int64() if c in ("token", "node", "comp") else pa.int32()) for c in names])

    def grouped(parts, column):
        """(key, rows of side, node, comp, column) of each group; parts are sorted by key."""
        now, held = None, []
        for part in parts:
            for token, i, j, *row in zip(*(part.column(c).to_pylist() for c in [*names, column]), strict=True):
                if (token, i, j) != now:
                    if len(held) > 1:
                        yield now, held
                    now, held = (token, i, j), []
                held.append(row)
        if len(held) > 1:
            yield now, held

    def trees(parts):
        out = []
        for at, held in grouped(parts, "bits"):
            side, node, comp, bits_n = zip(*held, strict=True)
            n, bits = [x["n"] for x in bits_n], [x["bits"] for x in bits_n]
            x, y = candidates(np.array(node), np.array(n), np.array(comp), bits, np.array(side), params.percent)
            out += [(*at, side[k], node[k], comp[k]) for k in np.union1d(x, y)]
            if len(out) > 10_000:
                yield batch(out, schema)
                out = []
        yield batch(out, schema)

    dealt = rest.select(*names, F.struct("n", "bits").alias("bits")).repartition(shards, *key).sortWithinPartitions(*key)
    left = written(dealt.mapInArrow(trees, kind), "tree-nodes")
    signs = [F.bit_xor(F.xxhash64("node", "side", F.lit(i))).alias(f"x{i}") for i in (0, 1)]
    alike = left.groupBy(*key).agg(F.count("*").alias("size"), *signs).groupBy("x0", "x1", "size").agg(F.min(F.struct(*key)).alias("k")).select("k.*")
    left = left.join(alike, key).join(sets_of(docs, left.select("node").distinct(), labels, params), "node")
    dealt = left.select(*names, "shingles").repartition(shards, *key).sortWithinPartitions(*key)
    links = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def check(parts):
        known = Components()
        for _, held in grouped(parts, "shingles"):
            if len(known.parent) > 1_000_000:
                known.parent.clear()
            side, node, comp, data = zip(*held, strict=True)
            yield batch(spanning(np.array(node), np.array(comp), [np.frombuffer(x, np.uint64) for x in data], np.array(side), known, params), links)

    final = merged(roots, written(dealt.mapInArrow(check, "a long, b long").distinct(), "tree-links"))

    labels = written(labels.join(final, "node", "left").withColumn("root", F.coalesce("root", "node")), "labels")
    least = labels.groupBy("root").agg(F.min("label").alias("component"))
    mine = labels.join(least, "root").select("node", "component")
    out = base.select("doc_id", "n", "node").join(mine, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("component_id", F.when(F.col("component_id") != LOW, F.col("component_id")))


def representatives(docs: DataFrame, params: JaccardParams = JaccardParams()) -> DataFrame:
    """One document of each class, that with the least doc_id, with its columns as they are; of repeated rows one stays."""
    found = written(classes(docs, params), "classes")
    kept = written(found.where("doc_id IS NULL AND component_id IS NULL OR doc_id = component_id").groupBy(F.coalesce("doc_id", F.lit(LOW)).alias("__id")).count(), "kept")
    rows = docs.join(sized(kept.select("__id")), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)) == F.col("__id"), "left_semi")
    return rows.dropDuplicates(["doc_id", "text"]) if kept.where("count > 1").limit(1).count() else rows
