"""Mixing sources to target weights, with DataFrame functions only.

1. Targets: sources share all words by weight; none gets more than ``cap`` times its own words, and what that frees goes to
   the others by weight (water filling, one window over the table of sources).
2. Blocks: each source's documents fall into blocks of about ``block_docs`` by a hash of their id, so a block is a random set
   and the order of blocks is a random order. A source's mix is some full passes over its blocks and one partial pass that stops
   within a block, where a greedy fold picks documents up to the target. Cumulative sizes are found in two
   levels (super-blocks, then the blocks of one of them), so no task holds a source's blocks or documents.
3. Splitting tree: the sources' exact numbers of blocks are split among output shards: at each node of a binary tree, the left
   half's share of every source is a draw without replacement (multivariate hypergeometric), made from hashes.
4. Every block, permuted within its source by a fixed affine map, goes to the shard whose quota it falls in; documents
   are shuffled within their shard by a hash.

All randomness is a hash of ids and the seed: reruns, also of single lost tasks, agree.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import WORD, labels, shuffle_partitions, sized, written

#: Odd prime above any number of blocks: multiplying by it permutes them. Blocks of a super-block.
PRIME, SUPER = 2_147_483_647, 1024
#: Steps of a hypergeometric draw on either side of its mean, in standard deviations.
SPREAD = 8.0


@dataclass(frozen=True)
class MixParams:
    """weights: of the sources in order, repeating. cap: most copies. block_docs: documents of a block, about. shards: of the output; 0: as
    many as shuffle partitions, so a shard's size stays."""

    weights: tuple[int, ...] = (5, 2, 1)
    cap: int = 3
    block_docs: int = 16
    shards: int = 0
    seed: int = 17


def n_words() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*cols: Column | str) -> Column:
    """A number in [0, 1) from a hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def targets(sizes: DataFrame, params: MixParams) -> DataFrame:
    """source, docs, source_size, target of each row of (source, docs, source_size); null sources sort last."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = F.get(F.array(*map(F.lit, params.weights)), (F.row_number().over(by_name) - 1) % len(params.weights))
    s = sizes.withColumn("weight", w.cast("double")).withColumn("most", params.cap * F.col("source_size").cast("double"))
    up = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    after = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    s = s.withColumn("level", F.max(fits).over(everything))
    return s.select("source", "docs", "source_size", F.least("most", F.coalesce(F.col("level") * F.col("weight"), "most")).alias("target"))


def bound(value: Column, f) -> Column:
    """f of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), f), 0)


def draw(have: Column, left: Column, all_: Column, u: Column) -> Column:
    """How many of ``have`` marked items are among ``left`` drawn from ``all_`` without replacement: the inverse of the distribution
    function at ``u``, summed over SPREAD standard deviations around the mean. Three folds over these steps find the largest
    logarithm of a weight, the mass, and the step at which the mass reaches ``u``; each holds a few numbers."""
    h, n, a = (c.cast("double") for c in (have, left, all_))
    mean = h * n / F.greatest(a, F.lit(1.0))
    sd = F.sqrt(mean * (1 - h / F.greatest(a, F.lit(1.0))) * (a - n) / F.greatest(a - 1, F.lit(1.0)))
    low = F.greatest(F.lit(0.0), h + n - a, F.floor(mean - SPREAD * sd - 1).cast("double"))
    high = F.least(h, n, F.ceil(mean + SPREAD * sd + 1).cast("double"))

    def at(x: Column) -> Column:
        steps = F.sequence(x["low"].cast("long"), F.greatest(x["low"], x["high"]).cast("long"))

        def log(before: Column, k: Column) -> Column:
            ratio = (x["h"] - k + 1) * (x["n"] - k + 1) / (k * (x["a"] - x["h"] - x["n"] + k))
            return F.when(k <= x["low"], F.lit(0.0)).otherwise(before + F.ln(ratio))

        zero = F.lit(0.0)
        peak = F.aggregate(steps, F.struct(zero.alias("log"), zero.alias("peak")), lambda s, k: bound(log(s["log"], k), lambda v: F.struct(v.alias("log"), F.greatest(s["peak"], v).alias("peak"))), lambda s: s["peak"])

        def with_peak(top: Column) -> Column:
            mass = F.aggregate(steps, F.struct(zero.alias("log"), zero.alias("mass")), lambda s, k: bound(log(s["log"], k), lambda v: F.struct(v.alias("log"), (s["mass"] + F.exp(v - top)).alias("mass"))), lambda s: s["mass"])

            def with_goal(goal: Column) -> Column:
                start = F.struct(zero.alias("log"), zero.alias("mass"), F.lit(0).cast("long").alias("n"))
                step = lambda s, v: F.struct(v.alias("log"), (s["mass"] + F.exp(v - top)).alias("mass"), (s["n"] + F.when(s["mass"] + F.exp(v - top) < goal, 1).otherwise(0)).alias("n"))
                below = F.aggregate(steps, start, lambda s, k: bound(log(s["log"], k), lambda v: step(s, v)), lambda s: s["n"])
                return F.least(x["low"].cast("long") + below, F.greatest(x["low"], x["high"]).cast("long"))

            return bound(mass * x["u"], with_goal)

        return bound(peak, with_peak)

    return bound(F.struct(h.alias("h"), n.alias("n"), a.alias("a"), u.alias("u"), low.alias("low"), high.alias("high")), at)


def split(quotas: DataFrame, params: MixParams) -> DataFrame:
    """(source, quota) -> source, ends: for each shard in turn, the number of the source's blocks in it and all before it.

    Shards get numbers of blocks that differ by one at most. Each level of the tree is a projection over (node, source)
    rows: at a node sources take their shares in turn, which a running sum over the node's sources makes exact: the share of the
    sources up to each one is itself a draw, so shares of single sources are differences.
    """
    q = quotas.where("quota > 0")
    node = Window.partitionBy("node")
    t = q.withColumn("node", F.lit(0).cast("long")).withColumn("first", F.lit(0)).withColumn("n", F.lit(params.shards))
    depth = max(params.shards - 1, 0).bit_length()
    for level in range(depth):
        # at every node the sources form an array; a fold draws each share from what is left
        packed = t.groupBy("node", "first", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("source", F.lit("")).alias("name"), "source", "quota"))).alias("all"))
        total = F.aggregate("all", F.lit(0).cast("long"), lambda s, x: s + x["quota"])
        half = F.floor((F.col("n") + 1) / 2).cast("long")
        # blocks of shards first .. first+half-1 if the node's blocks are dealt evenly, the first shards getting one more
        each, more = F.floor(F.col("total") / F.col("n")), F.col("total") % F.col("n")
        packed = packed.withColumn("total", total).withColumn("half", half).withColumn("left", (each * half + F.least(more, half)).cast("long"))
        init = F.struct(F.col("left").alias("left"), F.col("total").alias("all"), F.array().cast("array<long>").alias("out"))

        def take(s, x):
            u = uniform(F.lit(params.seed), F.lit(level), F.col("node"), x["source"])  # noqa: B023  called at once
            k = draw(x["quota"], s["left"], s["all"], u)
            return bound(k, lambda k: F.struct((s["left"] - k).alias("left"), (s["all"] - x["quota"]).alias("all"), F.concat(s["out"], F.array(k)).alias("out")))

        drawn = packed.withColumn("shares", F.when(F.col("n") > 1, F.aggregate("all", init, take, lambda s: s["out"])).otherwise(F.transform("all", lambda x: x["quota"])))
        rows = drawn.select("node", "first", "n", "half", F.explode(F.arrays_zip("all", "shares")).alias("x")).select("node", "first", "n", "half", "x.all.source", "x.all.quota", "x.shares")
        left = F.struct((F.col("node") * 2).alias("node"), F.col("first").alias("first"), F.when(F.col("n") > 1, F.col("half").cast("int")).otherwise(F.col("n")).alias("n"), F.col("shares").alias("quota"))
        right = F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("first") + F.col("half").cast("int")).alias("first"), (F.col("n") - F.col("half").cast("int")).alias("n"), (F.col("quota") - F.col("shares")).alias("quota"))
        t = rows.select("source", F.explode(F.array(left, right)).alias("x")).select("source", "x.node", "x.first", "x.n", "x.quota").where("n > 0")
    shares = t.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("first", F.col("quota")))).alias("m"))
    ends = F.aggregate(
        F.sequence(F.lit(0), F.lit(params.shards - 1)),
        F.array().cast("array<long>"),
        lambda acc, i: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("long")) + F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")))),
    )
    return shares.select("source", ends.alias("ends"))


def resolved(docs: DataFrame, params: MixParams) -> MixParams:
    return params if params.shards else replace(params, shards=shuffle_partitions(docs.sparkSession))


def plan(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, copies, draws.

    size: words of the text (null: 0). copies: times that the mix takes the document, 0 to ``cap``. draws: for each copy its number, its
    shard, and the place of its shuffle within the shard. Rows that share a doc_id and source are taken together. Null sources
    form one source, null ids one document; sources without words have target 0; an empty table gives no rows. Other columns are not read.
    """
    params = resolved(docs, params)
    slim = docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words().alias("size")).withColumn("u", uniform(F.lit(params.seed), "doc_id"))
    slim = written(slim, "mix-sizes")
    t = targets(slim.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size")), params)
    t = t.withColumn("blocks", F.ceil(F.col("docs") / params.block_docs).cast("long"))
    full = F.when(F.col("source_size") > 0, F.least(F.lit(params.cap), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int")
    t = t.withColumn("full", full).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("full") * F.col("source_size")))
    t = written(t.withColumn("rest", F.when(F.col("full") >= params.cap, 0.0).otherwise(F.col("rest"))), "mix-targets")
    wide = sized(t.withColumnRenamed("source", "__source"), 100_000)
    block = F.least(F.floor(F.col("u") * F.col("blocks")), F.col("blocks") - 1).cast("long")
    d = slim.join(wide, F.col("source").eqNullSafe(F.col("__source"))).drop("__source").withColumn("block", block)
    sums = written(d.groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest")), "mix-blocks")
    # the block in which the partial pass stops: first the super-block, then the block in it
    up = lambda *key: Window.partitionBy("source", *key[:-1]).orderBy(key[-1]).rowsBetween(Window.unboundedPreceding, -1)
    supers = sums.groupBy("source", F.floor(F.col("block") / SUPER).alias("super")).agg(F.sum("words").alias("words"), F.first("rest").alias("rest"))
    supers = supers.withColumn("before", F.coalesce(F.sum("words").over(up("super")), F.lit(0)))
    supers = supers.where("before <= rest AND before + words > rest").select("source", "super", "before")
    inner = sums.withColumn("super", F.floor(F.col("block") / SUPER)).alias("b").join(F.broadcast(supers).alias("s"), F.col("b.source").eqNullSafe(F.col("s.source")) & (F.col("b.super") == F.col("s.super")))
    inner = inner.select("b.source", "b.block", "b.words", "b.rest", F.col("s.before").alias("base"))
    inner = inner.withColumn("before", F.col("base") + F.coalesce(F.sum("words").over(up("block")), F.lit(0)))
    cut = inner.where("before <= rest AND before + words > rest").select(F.col("source").alias("__source"), F.col("block").alias("cut"), (F.col("rest") - F.col("before")).alias("need"))
    cut = sized(written(cut, "mix-cuts"), 100_000)
    # of the documents of that block, largest first, take each that still fits
    last = d.select("doc_id", "source", "size", "block").join(cut, F.col("source").eqNullSafe(F.col("__source")) & (F.col("block") == F.col("cut")))
    last = last.groupBy("source", "doc_id").agg(F.sum("size").alias("size"), F.first("need").alias("need"))
    last = last.groupBy("source").agg(F.first("need").alias("need"), F.sort_array(F.collect_list(F.struct("size", "doc_id")), asc=False).alias("docs"))
    start = F.struct(F.col("need").alias("need"), F.array().cast(last.select(F.transform("docs", lambda x: x.doc_id)).schema[0].dataType).alias("ids"))
    pick = lambda s, x: F.when(x["size"] <= s["need"], F.struct((s["need"] - x["size"]).alias("need"), F.concat(s["ids"], F.array(x["doc_id"])).alias("ids"))).otherwise(s)
    picked = last.select(F.col("source").alias("__source"), F.aggregate("docs", start, pick, lambda s: s["ids"]).alias("picked"))
    known = t.join(cut.drop("need"), F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    known = known.join(picked, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    # without a cut the partial pass takes nothing, or, if all is left to take, everything
    cut_ = F.coalesce("cut", F.when(F.col("rest") > 0, F.col("blocks")).otherwise(F.lit(0)))
    known = known.withColumn("cut", cut_).withColumn("quota", (F.col("full") * F.col("blocks") + F.least("blocks", F.col("cut") + F.when(F.size("picked") > 0, 1).otherwise(0))).cast("long"))
    known = written(known, "mix-quotas")
    ends = split(known.select("source", "quota"), params).withColumnRenamed("source", "__source")
    known = known.join(ends, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    known = sized(written(known.select(F.col("source").alias("__source"), "source_size", "target", "blocks", "full", "cut", "picked", "quota", "ends"), "mix-plan"), 100_000)

    d = slim.join(known, F.col("source").eqNullSafe(F.col("__source"))).drop("__source").withColumn("block", block)
    at_cut = (F.col("block") == F.col("cut")) & F.coalesce(F.exists("picked", lambda x: x.eqNullSafe(F.col("doc_id"))), F.lit(False))
    copies = (F.col("full") + F.when((F.col("block") < F.col("cut")) | at_cut, 1).otherwise(0)).cast("int")
    d = d.withColumn("copies", copies)
    place = lambda i: ((i.cast("long") * F.col("blocks") + F.col("block")) * F.lit(PRIME) + params.seed) % F.col("quota")
    shard = lambda i: F.size(F.filter("ends", lambda e: e <= place(i))).cast("int")
    one = lambda i: F.struct(i.alias("copy"), shard(i).alias("shard"), F.xxhash64(F.lit(params.seed), i, "doc_id").alias("place"))
    draws = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), one))
    return d.select("doc_id", "source", "size", "source_size", "target", "copies", F.coalesce(draws, F.array().cast("array<struct<copy:int,shard:int,place:long>>")).alias("draws"))


def mix(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """The mixed documents with their columns as they are, a row for each copy, dealt out by shard and shuffled within it."""
    params = resolved(docs, params)
    p = plan(docs, params).where("copies > 0").select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("draws").alias("__draws")).dropDuplicates(["__id", "__source"])
    p = sized(written(p, "mix-draws"), 500_000)
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").cast("string").eqNullSafe(F.col("__source"))
    rows = docs.join(p, same).select(*(docs[c] for c in docs.columns), F.explode("__draws").alias("__draw"))
    place = F.get(F.array(*map(F.lit, labels(docs.sparkSession, params.shards))), F.col("__draw.shard"))
    return rows.repartition(params.shards, place).sortWithinPartitions("__draw.shard", "__draw.place", "__draw.copy").drop("__draw")
