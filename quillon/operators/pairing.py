"""1:1 pairing of two sides: by place within a key, by least gap of durations, by choice in turn, and one by one from scored candidates.

No list of a key's pairs is made unless candidates are given. Places within a key are counted in cells of ids; gaps are settled between groups of
rows of one duration, which are counts, and rows come in last. Choices in turn go by components of rows that share keys: their time and memory
are those of a sort.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.knn import cut

#: Ranges of ids in which a key's rows are numbered.
CELLS = 1024
#: Rows that a part of a long stretch of places has.
CHUNK = 1024
#: Candidate pairs of a component that one task takes one by one.
SMALL = 100_000
#: Durations that still go together, in milliseconds.
TOLERANCE = 5000


def numbered(rows: DataFrame, keys: list[str], id_col: str, cells: int = CELLS) -> DataFrame:
    """``rows`` with ``i``: the place, from 0, of each row by its (numeric) id among those of its keys.

    The range of all ids is cut into cells. Rows are numbered within a key's cell, and a table of counts says how many stand in
    the cells before it, so a key with any share of the rows is spread over the cells.
    """
    ends = rows.agg(F.min(id_col).alias("__low"), F.max(id_col).alias("__high"))
    width = (F.col("__high") - F.col("__low")) / cells + 1
    x = rows.crossJoin(F.broadcast(ends)).withColumn("__cell", F.floor((F.col(id_col) - F.col("__low")) / width)).drop("__low", "__high")
    counts = x.groupBy(*keys, "__cell").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "__cell", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    here = F.row_number().over(Window.partitionBy(*keys, "__cell").orderBy(id_col)) - 1
    return x.withColumn("i", here).join(counts, [*keys, "__cell"]).withColumn("i", (F.col("i") + F.col("__before")).cast("long")).drop("__cell", "__before")


def by_place(a: DataFrame, b: DataFrame, keys: list[str], a_id: str, b_id: str) -> DataFrame:
    """a_id, b_id: within each key the i-th row of ``a`` by id with the i-th of ``b``."""
    x, y = (numbered(cut(d.select(*keys, i)), keys, i) for d, i in ((a, a_id), (b, b_id)))
    return x.join(y, [*keys, "i"]).select(a_id, b_id)


def _flow(keys: list[str], da, db, n, gap, kind: int, low) -> list:
    """Columns of a flow: n rows of duration da on side a go with as many of db on side b. gap, kind, low: its turn among a group's flows."""
    return [*keys, da.alias("da"), db.alias("db"), n.cast("long").alias("n"), gap.cast("long").alias("gap"), F.lit(kind).alias("kind"), low.alias("low")]


def _level_flows(groups: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of groups (keys, d, na, nb): flows between the sides at no gap, and the known groups that are left (keys, d, side, n).

    Equal durations go together, then unknown ones (d = 0) with each other, then those of the side that still has unknown ones with the
    other side's known ones, shortest first.
    """
    n, d, zero = F.least("na", "nb"), F.col("d"), F.lit(0).cast("long")
    same = [groups.where((n > 0) & at).select(_flow(keys, d, d, n, zero, kind, d)) for at, kind in ((d > 0, 0), (d == 0, 1))]
    rest = groups.where("na <> nb").select(*keys, "d", F.when(F.col("na") > F.col("nb"), "a").otherwise("b").alias("side"), F.abs(F.col("na") - F.col("nb")).alias("n"))
    u = F.max(F.when(d == 0, F.struct("side", "n"))).over(Window.partitionBy(*keys))
    shorter = Window.partitionBy(*keys, "side").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(d > 0, F.col("n")).otherwise(0)).over(shorter), F.lit(0))
    rest = rest.withColumn("u", u).withColumn("before", before).where("d > 0")
    take = F.when(F.col("u.side") != F.col("side"), F.greatest(F.lit(0), F.least("n", F.col("u.n") - F.col("before")))).otherwise(0)
    rest = cut(rest.withColumn("take", take.cast("long")))
    of = lambda side: F.when(F.col("side") == side, d).otherwise(zero)
    mixed = rest.where("take > 0").select(_flow(keys, of("a"), of("b"), F.col("take"), zero, 2, d))
    return reduce(DataFrame.unionByName, [*same, mixed]), rest.where("take < n").select(*keys, "d", "side", (F.col("n") - F.col("take")).alias("n"))


def _boundaries(left: DataFrame, keys: list[str], tolerance: int) -> tuple[DataFrame, DataFrame]:
    """Groups (keys, d, side, n) in order of durations fall into runs of one side. Where two runs meet, the k-th rows from there on either side
    would go together: segments (keys, b, k, n, low, high, gap) of such pairs at the end of run b, gaps within the tolerance. And the groups with their run
    (run, before: rows of the run that are shorter, total: all its rows, and what its neighbours are like)."""
    w = Window.partitionBy(*keys).orderBy("d")
    x = left.withColumn("new", F.when(F.lag("side").over(w) == F.col("side"), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    runs = x.groupBy(*keys, "run").agg(F.sum("n").alias("total"), F.min("d").alias("least"), F.max("d").alias("most"))
    w = Window.partitionBy(*keys).orderBy("run")
    near = {"last_total": F.lag("total"), "next_total": F.lead("total"), "far_below": F.lag("most", 3), "far_above": F.lead("least", 3)}
    runs = runs.select(*keys, "run", "total", *[c.over(w).alias(n) for n, c in near.items()])
    shorter = Window.partitionBy(*keys, "run").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    x = x.drop("new", "side").withColumn("before", F.coalesce(F.sum("n").over(shorter), F.lit(0))).join(runs, [*keys, "run"])
    x = cut(x.withColumn("after", F.col("total") - F.col("before") - F.col("n")))
    most = lambda other: F.least("total", other)
    at_end = x.where("next_total IS NOT NULL").select(*keys, F.col("run").alias("b"), F.col("after").alias("k"), most("next_total").alias("most"), F.col("d").alias("low"), F.lit(None).cast("long").alias("high"))
    at_begin = x.where("last_total IS NOT NULL").select(*keys, (F.col("run") - 1).alias("b"), F.col("before").alias("k"), most("last_total").alias("most"), F.lit(None).cast("long").alias("low"), F.col("d").alias("high"))
    w = Window.partitionBy(*keys, "b").orderBy("k", "low")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = at_end.unionByName(at_begin).withColumn("end", F.least(F.lead("k").over(w), "most"))
    s = s.select(*keys, "b", "k", (F.col("end") - F.col("k")).alias("n"), *[F.last(c, ignorenulls=True).over(so_far).alias(c) for c in ("low", "high")])
    return cut(s.withColumn("gap", F.col("high") - F.col("low")).where((F.col("n") > 0) & (F.col("gap") <= tolerance))), x


def _won(segments: DataFrame, x: DataFrame, keys: list[str], tolerance: int) -> DataFrame:
    """keys, run, at_end, at_begin: how many of a run's rows have their pair at its end before anything at its begin could take them, and the other
    way round.

    What the other end could do is its segments; where its neighbour is too short for a row, the nearest run beyond bounds the gap from below.
    """
    total = x.select(*keys, "run", "total").distinct()
    claim = lambda gap, low, real: F.struct(gap.cast("long").alias("gap"), low.cast("long").alias("low"), F.lit(real).alias("real"))
    seg = claim(F.col("gap"), F.col("low"), True)
    # rows are counted from the run's end
    ends = segments.withColumnRenamed("b", "run").select(*keys, "run", F.lit("end").alias("who"), F.col("k").alias("x"), "n", seg.alias("claim"))
    begins = segments.withColumn("run", F.col("b") + 1).join(total, [*keys, "run"]).select(*keys, "run", F.lit("begin").alias("who"), (F.col("total") - F.col("k") - F.col("n")).alias("x"), "n", seg.alias("claim"))
    beyond = lambda who, first, n, gap: x.withColumn("m", n).where((F.col("m") > 0) & (gap <= tolerance)).select(*keys, "run", F.lit(who).alias("who"), first.alias("x"), F.col("m").alias("n"), claim(gap, F.lit(-1), False).alias("claim"))
    far_left = beyond("begin", F.col("after"), F.col("before") + F.col("n") - F.greatest("before", "last_total"), F.col("d") - F.col("far_below"))
    own = F.greatest("after", "next_total")
    far_right = beyond("end", own, F.col("after") + F.col("n") - own, F.col("far_above") - F.col("d"))
    all_ = reduce(DataFrame.unionByName, [ends, begins, far_left, far_right])
    nothing = claim(F.lit(None), F.lit(None), False)
    events = all_.select(*keys, "run", "who", F.inline(F.array(F.struct(F.col("x"), F.lit(1).alias("starts"), F.col("claim")), F.struct((F.col("x") + F.col("n")).alias("x"), F.lit(0).alias("starts"), nothing.alias("claim")))))
    w = Window.partitionBy(*keys, "run").orderBy("x", "starts")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = lambda who: F.last(F.when(F.col("who") == who, F.col("claim")), ignorenulls=True).over(so_far)
    e = events.select(*keys, "run", (F.lead("x").over(w) - F.col("x")).alias("n"), held("end").alias("e"), held("begin").alias("s"))
    first = lambda a, b: F.col(f"{a}.real") & F.col(f"{a}.gap").isNotNull() & (F.col(f"{b}.gap").isNull() | (F.struct(f"{a}.gap", f"{a}.low") < F.struct(f"{b}.gap", f"{b}.low")))
    won = lambda a, b: F.coalesce(F.sum(F.when(first(a, b), F.col("n"))), F.lit(0))
    return e.where("n > 0").groupBy(*keys, "run").agg(won("e", "s").alias("at_end"), won("s", "e").alias("at_begin"))


def _gap_flows(left: DataFrame, keys: list[str], tolerance: int) -> list[DataFrame]:
    """Flows between known groups of no equal durations (keys, d, side, n), the least gap first, in rounds.

    A round settles, wherever two runs meet, all pairs that nothing else can come before: a key with all of one side's durations below the
    other's takes one round. The least gap of a key always settles, so rounds end when none is within the tolerance.
    """
    flows = []
    while True:
        # keys of one side alone are done
        sides = left.groupBy(*keys).agg(F.min("side").alias("s"), F.max("side").alias("t")).where("s <> t")
        left = cut(left.join(sides.select(*keys), keys, "left_semi"))
        if left.isEmpty():
            return flows
        segments, x = _boundaries(left, keys, tolerance)
        if segments.isEmpty():
            return flows
        won = cut(_won(segments, x, keys, tolerance))
        both = segments.join(won.select(*keys, F.col("run").alias("b"), "at_end"), [*keys, "b"]).join(won.select(*keys, (F.col("run") - 1).alias("b"), "at_begin"), [*keys, "b"])
        side = left.select(*keys, F.col("d").alias("low"), "side")
        n = F.least("n", F.least("at_end", "at_begin") - F.col("k"))
        both = both.withColumn("n", n).where("n > 0").join(side, [*keys, "low"])
        of = lambda s: F.when(F.col("side") == s, F.col("low")).otherwise(F.col("high"))
        found = cut(both.select(_flow(keys, of("a"), of("b"), F.col("n"), F.col("gap"), 0, F.col("low"))))
        flows.append(found)
        gone = found.select(*keys, F.explode(F.array("da", "db")).alias("d"), "n").groupBy(*keys, "d").agg(F.sum("n").alias("gone"))
        left = left.join(found.select(*keys).distinct(), keys, "left_semi").join(gone, [*keys, "d"], "left").withColumn("n", F.col("n") - F.coalesce("gone", F.lit(0)))
        left = left.where("n > 0").select(*keys, "d", "side", "n")


def _placed(flows: DataFrame, keys: list[str]) -> DataFrame:
    """Flows with oa and ob: the places at which they begin among the rows of their groups."""
    f = flows.groupBy(*keys, "da", "db", "gap", "kind", "low").agg(F.sum("n").alias("n"))
    begin = lambda d, other: F.coalesce(F.sum("n").over(Window.partitionBy(*keys, d).orderBy("gap", "kind", "low", other).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return f.select(*keys, "da", "db", "n", begin("da", "db").alias("oa"), begin("db", "da").alias("ob"))


def _rows_of(rows: DataFrame, flows: DataFrame, keys: list[str], d: str, off: str, id_col: str) -> DataFrame:
    """keys, da, db, k, id of the rows that take part in flows: k is the place within the flow. Rows and flows meet in chunks of places."""
    last = F.floor((F.col(off) + F.col("n") - 1) / CHUNK)
    cover = flows.withColumn("chunk", F.explode(F.sequence(F.floor(F.col(off) / CHUNK), last)))
    placed = numbered(rows, [*keys, "d"], id_col).withColumn("chunk", F.floor(F.col("i") / CHUNK)).withColumnRenamed("d", d)
    both = placed.join(cover, [*keys, d, "chunk"]).where((F.col("i") >= F.col(off)) & (F.col("i") < F.col(off) + F.col("n")))
    return both.select(*keys, "da", "db", (F.col("i") - F.col(off)).alias("k"), id_col)


def by_duration(a: DataFrame, b: DataFrame, keys: list[str], a_id: str, b_id: str, duration: str = "duration_ms", tolerance: int = TOLERANCE) -> DataFrame:
    """a_id, b_id: 1:1 pairs of equal keys with compatible durations, always the pair of least gap next.

    An unknown duration (0 or less, or null) has no gap to any. Of pairs of one gap, two known durations go before two unknown ones and these
    before one unknown; then the pair with the shorter known duration; then by b's id and a's id. Null keys pair nothing.
    """
    d = F.greatest(F.coalesce(F.col(duration), F.lit(0)), F.lit(0)).cast("long").alias("d")
    x, y = (cut(r.select(*keys, i, d)) for r, i in ((a, a_id), (b, b_id)))
    na, nb = (r.groupBy(*keys, "d").agg(F.count("*").alias(n)) for r, n in ((x, "na"), (y, "nb")))
    both = x.select(*keys).distinct().join(y.select(*keys).distinct(), keys)
    groups = na.join(nb, [*keys, "d"], "full").select(*keys, "d", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("na", "nb")])
    groups = cut(groups.join(both, keys, "left_semi"))
    level, left = _level_flows(groups, keys)
    flows = cut(_placed(reduce(DataFrame.unionByName, _gap_flows(left, keys, tolerance), level), keys))
    return _rows_of(x, flows, keys, "da", "oa", a_id).join(_rows_of(y, flows, keys, "db", "ob", b_id), [*keys, "da", "db", "k"]).select(a_id, b_id)


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): every node of an edge and the least node of its component.

    Rounds of two steps: each node's larger neighbours, and then its smaller ones, are linked to the least node among them. Minima are aggregated
    before rows meet them, so a hub's neighbours never stand in one task; lineage is cut after each round.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(small.union(least).distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())
        before = now


def _one_by_one(parts):
    """Of candidates sorted by component, order, track and score: each track in turn takes the best entry still free, if no other is as good."""
    taken, now, root, free = set(), None, None, []

    def close():
        best = [f for s, f in free if s == free[0][0]]
        if len(best) == 1:
            taken.add(best[0])
            return [(now, best[0])]
        return []

    for pdf in parts:
        out = []
        for r, t, f, s in pdf[["root", "track_id", "file_id", "s"]].itertuples(index=False):
            if t != now or r != root:
                out += close()
                now, free = t, []
            if r != root:
                taken, root = set(), r
            if f not in taken:
                free.append((s, f))
        yield pd.DataFrame(out, columns=["track_id", "file_id"], dtype="int64")
    yield pd.DataFrame(close(), columns=["track_id", "file_id"], dtype="int64")


def _in_turn(rooted: DataFrame) -> DataFrame:
    in_order = rooted.repartition("root").sortWithinPartitions("root", "order", "track_id", "s", "file_id")
    return in_order.mapInPandas(_one_by_one, "track_id long, file_id long")


def _undisputed(left: DataFrame) -> DataFrame:
    """track_id, file_id (null: none) of the tracks whose turn ends alike whatever others do: no earlier track can take their only best
    entry, or two of equally good ones."""
    first = left.groupBy("file_id").agg(F.min(F.struct("order", "track_id")).alias("first"))
    mine = left.join(first, "file_id").withColumn("mine", F.col("first.track_id") == F.col("track_id"))
    alike = mine.groupBy("track_id", "s").agg(F.count("*").alias("n"), F.count_if("mine").alias("m"), F.min("file_id").alias("file_id"))
    best = alike.groupBy("track_id").agg(F.min_by(F.struct("n", "m", "file_id"), "s").alias("b"))
    return best.where("b.m > 1 OR (b.n = 1 AND b.m = 1)").select("track_id", F.when(F.col("b.n") == 1, F.col("b.file_id")).alias("file_id"))


def _without(left: DataFrame, done: DataFrame) -> DataFrame:
    """Candidates without the tracks of ``done`` and the entries that these took."""
    return left.join(done.select("track_id"), "track_id", "left_anti").join(done.where("file_id IS NOT NULL").select("file_id"), "file_id", "left_anti")


def one_by_one(rows: DataFrame, score: list[str], small: int = SMALL) -> DataFrame:
    """1:1 pairs from candidates (track_id, file_id, score columns, order): tracks, one by one by (order, track_id), take their best entry that is
    still free, if no other is as good; else none.

    In rounds, every track settles that is the first of all that can take its best entry; the very first one of each component always does. Once a
    round settles less than a tenth, what is left falls into components that share no entry, so they can't influence one another: all are
    taken in parallel, each one by one in its task. Those of more than ``small`` candidates go through rounds again, for as long as these
    settle a tenth. Only one that rounds hardly shrink, a chain in which each choice hangs on the one before, is streamed whole
    through a task in its order; the task then holds the entries taken so far and nothing else.
    """
    w = Window.partitionBy("track_id").orderBy(*score)
    left = cut(rows.select("track_id", "file_id", "order", F.dense_rank().over(w).alias("s")))
    found, n = left.select("track_id", "file_id").limit(0), left.count()
    while n:
        begun = n
        while n > small:
            done = cut(_undisputed(left))
            found, before = found.union(done), n
            left = cut(_without(left, done))
            n = left.count()
            if 10 * n > 9 * before:
                break
        if not n:
            break
        if n <= small:
            return found.union(cut(_in_turn(left.withColumn("root", F.lit(0))))).where("file_id IS NOT NULL")
        # tracks and entries as nodes of one graph
        edges = left.select((2 * F.col("track_id")).alias("a"), (2 * F.col("file_id") + 1).alias("b"))
        rooted = left.join(components(edges), 2 * F.col("track_id") == F.col("node")).drop("node")
        stuck = 10 * n > 9 * begun
        giant = rooted.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > small)
        rooted = cut(rooted.join(giant.select("root", F.lit(True).alias("giant")), "root", "left"))
        now = rooted if stuck else rooted.where("giant IS NULL")
        found = found.union(cut(_in_turn(now)))
        left = rooted.where("giant").drop("root", "giant") if not stuck else rooted.limit(0)
        n = 0 if stuck else left.count()
    return found.where("file_id IS NOT NULL")


class _Cell:
    """Rows of one key and of equal attributes: known durations in order, unknown ones, and those that are null."""

    def __init__(self):
        self.d, self.known, self.blank, self.null = [], [], [], []

    def add(self, i: int, d: int | None):
        if d is None:
            self.null.append(i)
        elif d <= 0:
            self.blank.append(i)
        else:
            self.d.append(d)
            self.known.append(i)

    def nearest(self, d: int | None, free: bytearray, tolerance: int) -> tuple[int, list[int]] | None:
        """The least gap of a compatible free row, and two (or the only one) of the rows that have it. Rows that are not free go for good."""
        out = []
        if d is None or d <= 0:
            # an unknown duration goes with any known or unknown one, a null one with unknown ones alone
            for rows, more in ((self.blank, None), (self.known, self.d), (self.null, None)) if d is not None else ((self.blank, None),):
                self._last(rows, more, free, out)
            return (0, out) if out else None
        self._last(self.blank, None, free, out)
        ds, known = self.d, self.known
        at = bisect_left(ds, d)
        self._free(at, free)
        below = at - 1
        while below >= 0 and not free[known[below]]:
            del ds[below], known[below]
            below -= 1
        at = below + 1
        up = ds[at] - d if at < len(ds) else tolerance + 1
        down = d - ds[below] if below >= 0 else tolerance + 1
        gap = 0 if out else min(up, down)
        if gap > tolerance:
            return None
        if up == gap:
            out.append(known[at])
            self._free(at + 1, free)
            if at + 1 < len(ds) and ds[at + 1] == ds[at]:
                out.append(known[at + 1])
        if down == gap and len(out) < 2:
            out.append(known[below])
            while below > 0 and not free[known[below - 1]]:
                del ds[below - 1], known[below - 1]
                below -= 1
            if below > 0 and ds[below - 1] == ds[below]:
                out.append(known[below - 1])
        return gap, out[:2]

    def _free(self, at: int, free: bytearray):
        while at < len(self.known) and not free[self.known[at]]:
            del self.d[at], self.known[at]

    @staticmethod
    def _last(rows: list, more: list | None, free: bytearray, out: list):
        at = len(rows) - 1
        while at >= 0 and len(out) < 2:
            if free[rows[at]]:
                out.append(rows[at])
            else:
                del rows[at]
                if more is not None:
                    del more[at]
            at -= 1


class _Component:
    """Rows of both sides that share keys, directly or by others; ``settled`` lets one side choose in turn.

    A row's best choices are looked up by key and by what of artist, title and album is equal, most important first; there by the nearest duration.
    """

    def __init__(self):
        self.codes, self.keys, self.rows = {}, ({}, {}), ([], [])

    def code(self, x):
        # null equals nothing
        return self.codes.setdefault(x, len(self.codes)) if isinstance(x, str) else -1

    def add(self, side, i, head, keys, artist, title, album, d, order):
        if keys is not None:
            self.keys[side][head] = list(dict.fromkeys(map(self.code, keys)))
        self.rows[side].append((i, head, self.code(artist), self.code(title), self.code(album), d, order))

    def settled(self, tolerance: int) -> list[tuple[int, int]]:
        others, mine = self.rows
        # keys that the same rows have are one
        having = {}
        for head, keys in self.keys[0].items():
            for k in keys:
                having.setdefault(k, []).append(head)
        one = {}
        same = {k: one.setdefault(tuple(heads), k) for k, heads in having.items()}
        having = {k: set(having[k]) for k in one.values()}
        keys = [{h: sorted({same[k] for k in ks if k in same}) for h, ks in self.keys[side].items()} for side in (0, 1)]
        if mine and mine[0][6] is None:
            mine = self._by_number(keys, mine)
        free, cells, of_head = bytearray(b"\1") * len(others), {}, {}
        for i, row in enumerate(others):
            of_head.setdefault(row[1], []).append(i)
        out = []
        for i, head, artist, title, album, d, _ in sorted(mine, key=lambda r: (r[6], r[0])):
            for unlike in range(8):
                alike = (None if unlike & 4 else artist, None if unlike & 2 else title, None if unlike & 1 else album)
                if -1 in alike:
                    continue
                best, hits = tolerance + 1, set()
                for k in keys[1].get(head, ()):
                    if (k, unlike) not in cells:
                        cells[k, unlike] = self._cells(unlike, [j for h in having[k] for j in of_head.get(h, ()) if free[j]])
                    cell = cells[k, unlike].get(alike)
                    near = cell and cell.nearest(d, free, tolerance)
                    if near and near[0] <= best:
                        hits = hits.union(near[1]) if near[0] == best else set(near[1])
                        best = near[0]
                if hits:
                    if len(hits) == 1:
                        j = hits.pop()
                        free[j] = 0
                        out.append((i, others[j][0]))
                    break
        return out

    def _cells(self, unlike: int, places: list[int]) -> dict:
        out = {}
        for j in sorted(places, key=lambda j: (self.rows[0][j][5] or 0, j)):
            _, _, artist, title, album, d, _ = self.rows[0][j]
            alike = (None if unlike & 4 else artist, None if unlike & 2 else title, None if unlike & 1 else album)
            out.setdefault(alike, _Cell()).add(j, d)
        return out

    def _by_number(self, keys: list[dict], mine: list) -> list:
        """Rows with the number of others that share any key as their order: counted by sets of keys, as rows have few."""
        n = Counter(row[1] for row in self.rows[0])
        subsets = lambda ks: (s for r in range(1, len(ks) + 1) for s in combinations(ks, r))
        having = Counter()
        for head, ks in keys[0].items():
            for s in subsets(ks):
                having[s] += n[head]
        total = {head: sum(having[s] * (-1) ** (len(s) + 1) for s in subsets(ks)) for head, ks in keys[1].items()}
        return [(*row[:6], total[row[1]]) for row in mine]


def _choices(parts):
    """Rows sorted by component -> pairs of every component."""
    now, component = None, _Component()
    for pdf in parts:
        out = []
        for root, side, i, head, keys, artist, title, album, d, order in pdf.itertuples(index=False, name=None):
            if root != now:
                out += component.settled(TOLERANCE)
                now, component = root, _Component()
            component.add(side, i, head, keys, artist, title, album, None if pd.isna(d) else int(d), None if pd.isna(order) else int(order))
        yield pd.DataFrame(out, columns=["mine", "other"], dtype="int64")
    yield pd.DataFrame(component.settled(TOLERANCE), columns=["mine", "other"], dtype="int64")


def by_choice(mine: DataFrame, other: DataFrame) -> DataFrame:
    """mine, other: ids of 1:1 pairs; rows of ``mine``, one by one by (order, id), take their best row of ``other`` that shares a key, has a compatible
    duration and is still free, if no other is as good; else none. Best is an equal artist, then title, then album, then the least gap.

    Both: id, head, keys, artist, title, album, d; mine: order (null in all rows: the number of others that share a key, of any duration, for rows of few keys).
    Rows of one keys may have them once, at the row whose id is their ``head``. Rows that share keys, directly or by others, form a component. A task
    takes one after another and holds the rows of one; no pairs are made, so hot keys cost a sort of their rows.
    """
    cols = ["side", "id", "head", "keys", "artist", "title", "album", "d", "order"]
    other = other.withColumn("order", F.lit(None).cast("int"))
    rows = cut(other.withColumn("side", F.lit(0)).select(cols).unionByName(mine.withColumn("side", F.lit(1)).select(cols)))
    keyed = rows.where("keys IS NOT NULL").select((2 * F.col("id") + F.col("side")).alias("node"), "side", F.explode("keys").alias("key"))
    least = keyed.groupBy("key").agg(F.min("node").alias("rep"), F.min("side").alias("s"), F.max("side").alias("t")).where("s <> t").select("key", "rep")
    # a row's keys go together by the least of their rows
    reps = cut(keyed.hint("merge").join(least, "key").groupBy("node").agg(F.min("rep").alias("m"), F.collect_set("rep").alias("reps")))
    roots = components(reps.select(F.explode("reps").alias("a"), F.col("m").alias("b"))).withColumnRenamed("node", "m")
    roots = reps.select("node", "m").hint("merge").join(roots, "m", "left").select("node", F.coalesce("root", "m").alias("root"))
    rooted = rows.withColumn("node", 2 * F.col("head") + F.col("side")).hint("merge").join(roots, "node").select("root", *cols)
    return rooted.repartition("root").sortWithinPartitions("root").mapInPandas(_choices, "mine long, other long")


def compatible_keys(known: DataFrame, asked: DataFrame, id_col: str, tolerance: int = TOLERANCE) -> DataFrame:
    """id_col of the rows of ``asked`` (id_col, key, d) for which ``known`` (key, d) has a row of the same key with a compatible duration; 0 or less is
    unknown and goes with any. An id may come more than once.

    A semi-join without pairs: known durations are aggregated in bands as wide as the tolerance. A duration goes with all of its own band, with
    the band above from its least one on and with the band below up to its greatest one.
    """
    none, any_ = F.lit(-10).cast("long"), F.lit(-20).cast("long")
    d = F.col("d").cast("long")
    band = F.when(d > 0, F.floor(d / tolerance))
    bands = known.where("key IS NOT NULL").groupBy("key", band.alias("band")).agg(F.min(d).alias("low"), F.max(d).alias("high"))
    at = lambda where, always, low, high: F.struct(where.alias("at"), F.lit(always).alias("always"), low.cast("long").alias("low"), high.cast("long").alias("high"))
    null, b = F.lit(None), F.col("band")
    spread = F.when(b.isNull(), F.array(at(none, True, null, null), at(any_, True, null, null))).otherwise(
        F.array(at(b, True, null, null), at(b - 1, False, F.col("low"), null), at(b + 1, False, null, F.col("high")), at(any_, True, null, null))
    )
    there = bands.select("key", F.inline(spread)).groupBy("key", "at").agg(F.bool_or("always").alias("always"), F.min("low").alias("low"), F.max("high").alias("high"))
    look = F.when(d > 0, F.array(F.floor(d / tolerance), none)).otherwise(F.array(any_))
    probes = asked.select(id_col, "key", d.alias("d"), F.explode(look).alias("at"))
    good = F.col("always") | (F.col("low") <= F.col("d") + tolerance) | (F.col("high") >= F.col("d") - tolerance)
    same = (F.col("key") == F.col("k")) & (F.col("at") == F.col("h"))
    return probes.hint("merge").join(there.withColumnRenamed("key", "k").withColumnRenamed("at", "h"), same & F.coalesce(good, F.lit(False)), "left_semi").select(id_col)
