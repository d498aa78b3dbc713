"""URL filters: a sort-merge range join of page URLs with host and path rules.

A host's labels reversed, each closed by a dot (``a.example.com`` -> ``com.example.a.``), make "this host and all its
subdomains" a prefix, and a prefix is an interval of the sorted keys. Intervals of prefixes nest, so one sweep over the
sorted pages and rules, with a stack of the rules that are open, finds for every page all rules of its host.
Of those, the longest whose path starts the page's path wins.

The key space is cut into ranges by sampled bounds; the sort key ends in the path and a hash, so the pages of one hot host,
or copies of one URL, spread over many ranges. A rule goes to each range that its interval meets: besides the rules
that begin in a range these are only the ancestors that are open at its bound.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import batch, shuffle_partitions

#: Sorts after every key that starts with the same prefix.
END = "\U0010ffff"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    host = F.regexp_extract(F.substring_index(F.concat(_rest(url), F.lit("/")), "/", 1), "^([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_key(host: Column) -> Column:
    """The labels reversed, each closed by a dot; empty for an empty host."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


class Rules:
    """The rules of one host: its key, its length, and the paths by their length, longest first."""

    def __init__(self, key: str, host: str):
        self.key, self.host, self.paths = key, host, {}

    def add(self, path: str, verdict: str) -> None:
        known = self.paths.setdefault(len(path), {})
        known[path] = min(known.get(path, verdict), verdict, key=lambda v: v != "block")
        self.paths = dict(sorted(self.paths.items(), reverse=True))

    def best(self, path: str) -> tuple | None:
        for n, known in self.paths.items():
            if n <= len(path) and (v := known.get(path[:n])):
                return len(self.host) + n, len(self.host), self.host + path[:n], v
        return None


OUT = "page_id long, host string, path string, rule string, verdict string"
SCHEMA = pa.schema([("page_id", pa.int64()), *((c, pa.string()) for c in ("host", "path", "rule", "verdict"))])


def sweep(parts):
    """Sorted rules and pages of some ranges -> the pages with their rules. The stack holds one entry a host label at most."""
    open_: list[Rules] = []
    now = None
    for part in parts:
        out = []
        for at, key, rule, page_id, host, path, verdict in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if at != now:
                now, open_ = at, []
            while open_ and not key.startswith(open_[-1].key):
                open_.pop()
            if rule:
                if not open_ or open_[-1].key != key:
                    open_.append(Rules(key, host))
                open_[-1].add(path, verdict)
            else:
                best = max((b for r in open_ if (b := r.best(path))), default=None, key=lambda b: b[:2])
                out.append((page_id, host, path, best and best[2], best[3] if best else verdict))
        yield batch(out, SCHEMA)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", sample: int = 64) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    pages: page_id, url. rules: host, path, verdict (allow or block). A rule fits its host and all subdomains if the
    page's path starts with its path; the longest rule (host and path) wins, of equally long ones that with the longer
    host, of equal ones block. Without a rule the verdict is ``default``. A null url, or one without ``://``, has an empty
    host and path and no rule. Rules with a null or empty host or a null verdict never fit; a null path counts as empty. A null
    page_id stays null; repeated pages are judged each; an empty table gives no rows. Other columns are not read.
    sample: keys drawn for each range to place the bounds; these decide where rows go, never the result.
    """
    spark = pages.sparkSession
    n = shuffle_partitions(spark)
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    salt = F.hex(F.xxhash64("page_id"))
    p = p.select(F.concat(host_key(F.col("host")), F.lit("\x01"), "path", F.lit("\x02"), salt).alias("key"), F.lit(False).alias("rule"), "page_id", "host", "path", F.lit(default).alias("verdict"))
    rows = pages.count()
    drawn = p.select("key").sample(min(1.0, n * sample / max(rows, 1)), 7).limit(4 * n * sample) if rows else p.select("key").limit(0)
    keys = sorted(r[0] for r in drawn.collect())
    bounds = sorted({keys[i * len(keys) // n] for i in range(1, n)}) if keys else []

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return key.map(lambda k: bisect_right(bounds, k)).astype("int32")

    fold = F.translate(F.col("host"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    r = rules.select(fold.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host <> '' AND verdict IS NOT NULL")
    r = r.withColumn("key", host_key(F.col("host"))).withColumn("last", range_of(F.concat("key", F.lit(END))))
    r = r.withColumn("at", F.explode(F.sequence(range_of("key"), "last")))
    r = r.select("at", "key", F.lit(True).alias("rule"), F.lit(None).cast("long").alias("page_id"), "host", "path", "verdict")
    both = p.select(range_of("key").alias("at"), "*").unionByName(r)
    return both.repartition(n, "at").sortWithinPartitions("at", "key", F.desc("rule")).mapInArrow(sweep, OUT)
