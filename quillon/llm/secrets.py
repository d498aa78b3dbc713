"""Secret scans: pattern matches, and who owns them across the corpus.

One scan finds in every text the spans of three fixed kinds and the opaque tokens that may be credentials of other
kinds. Candidate hashes are then aggregated over the corpus: in how many repositories and with how many owners each
stands. A value that many of them hold is a copied example; one that few hold looks live. Live tokens of other
kinds become spans of kind ``token``. Only hashes of candidates are shuffled, and counted before that.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from quillon.llm.common import BROADCAST_ROWS, batch, sized, written

KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: Group 2 is the same in either case: its class holds both.
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{24,}")
KINDS = ("assign", "access", "hex", "token")


@dataclass(frozen=True)
class SecretParams:
    """A candidate is live if at most ``repositories`` hold it, with at most ``owners`` owners.
    Opaque tokens need ``entropy`` bits a character, and letters of both cases and digits."""

    repositories: int = 1
    owners: int = 3
    entropy: float = 3.8


def opaque(s: str, entropy: float) -> bool:
    if not (any(c.isdigit() for c in s) and any(c.islower() for c in s) and any(c.isupper() for c in s)):
        return False
    n = len(s)
    return -sum(k / n * math.log2(k / n) for k in Counter(s).values()) >= entropy


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's place, end, secret) of the three fixed kinds, sorted; code points, end exclusive."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def other_spans(text: str, base: list[tuple], entropy: float) -> list[tuple[int, int, int, str]]:
    """Opaque tokens that touch no span of ``base``."""
    found = []
    for m in TOKEN.finditer(text):
        if opaque(m[0], entropy) and not any(s < m.end() and m.start() < e for s, _, e, _ in base):
            found.append((m.start(), 3, m.end(), m[0]))
    return found


def digest(secret: str) -> int:
    return xxh3_64_intdigest(secret.encode()) - (1 << 63)


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[s[1]]}:{s[0]}:{s[2]}" for s in spans)


CANDIDATE = "array<struct<start:int,kind:int,stop:int,hash:long>>"
FOUND = f"doc_id long, key long, repository string, owner string, candidates {CANDIDATE}"
_C = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32()), ("hash", pa.int64())]))
FOUND_SCHEMA = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("repository", pa.string()), ("owner", pa.string()), ("candidates", _C)])


def find(docs: DataFrame, params: SecretParams, repository: str, owner: str) -> DataFrame:
    """Every document's candidates of all kinds, a hash of its text (key) and a row number; written once, as it is read several times."""
    entropy = params.entropy

    def run(parts):
        for part in parts:
            ids, keys, repos, owners, all_ = (c.to_pylist() for c in part.columns)
            rows = []
            for i, x, r, o, text in zip(ids, keys, repos, owners, all_, strict=True):
                base = base_spans(text) if text else []
                spans = base + (other_spans(text, base, entropy) if text else [])
                rows.append((i, x, r, o, [(s, k, e, digest(v)) for s, k, e, v in spans]))
            yield batch(rows, FOUND_SCHEMA)

    picked = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), F.col(repository).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"), "text")
    return written(picked.mapInArrow(run, FOUND).withColumn("row", F.monotonically_increasing_id()), "secrets")


def ownership(found: DataFrame, params: SecretParams) -> DataFrame:
    """hash, repositories, owners, live of every candidate; written. Null repositories or owners count as one of their own.

    Hashes are first made distinct with each repository and with each owner, so a hash that stands everywhere arrives pre-aggregated.
    """
    holders = F.array(F.struct(F.lit(0).alias("kind"), F.coalesce("repository", F.lit("\x00")).alias("name")), F.struct(F.lit(1).alias("kind"), F.coalesce("owner", F.lit("\x00")).alias("name")))
    each = found.select(holders.alias("held"), F.explode("candidates.hash").alias("hash")).select("hash", F.explode("held").alias("by")).select("hash", "by.kind", "by.name")
    counted = each.distinct().groupBy("hash").agg(F.count_if(F.col("kind") == 0).alias("repositories"), F.count_if(F.col("kind") == 1).alias("owners"))
    return written(counted.withColumn("live", (F.col("repositories") <= params.repositories) & (F.col("owners") <= params.owners)), "owned")


def alive(each: DataFrame, owned: DataFrame) -> DataFrame:
    """The rows (hash, ...) whose hash is live. Widely copied ones, of which there can only be few, go before rows are shuffled by hash."""
    total = owned.agg(F.sum("owners")).head()[0] or 0
    hot = owned.where(~F.col("live") & (F.col("owners") > max(1000, total // BROADCAST_ROWS))).select("hash")
    return each.join(F.broadcast(hot), "hash", "left_anti").join(owned.where("live").select("hash"), "hash")


def scan(docs: DataFrame, params: SecretParams = SecretParams(), repository: str = "source", owner: str = "doc_id") -> DataFrame:
    """doc_id, base and added (arrays of start, kind, stop, hash), n_live and n_copied of every document.

    base: the spans of the three fixed kinds. added: live opaque tokens beside them. n_live and n_copied count the document's
    candidates by the corpus-wide verdict. Null and empty texts have none; repeated rows are scanned each; a value repeated within
    a document counts once towards ownership; other columns are not read; an empty table gives no rows.
    """
    found = find(docs, params, repository, owner)
    each = found.select("row", F.explode("candidates").alias("c")).withColumn("hash", F.col("c.hash"))
    mine = alive(each, ownership(found, params)).groupBy("row").agg(F.array_sort(F.collect_list("c")).alias("alive"))
    both = found.join(mine, "row", "left").withColumn("alive", F.coalesce("alive", F.array().cast(CANDIDATE)))
    return both.select(
        "doc_id",
        F.filter("candidates", lambda c: c.kind < 3).alias("base"),
        F.filter("alive", lambda c: c.kind == 3).alias("added"),
        F.size("alive").cast("long").alias("n_live"),
        (F.size("candidates") - F.size("alive")).cast("long").alias("n_copied"),
    )


def span_text(spans):
    """Spans as kind:start:end, joined by commas in their order."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.get(name, c.kind), c.start, c.stop)), ",")


def redact(docs: DataFrame, params: SecretParams = SecretParams(), repository: str = "source", owner: str = "doc_id", mark: str = "[SECRET]") -> DataFrame:
    """The documents with every base span and every live token replaced by ``mark``; n_chars follows where there is such a column.

    All other columns and all rows stay, also those with null or repeated ids; null texts stay as they are; an empty table gives no rows. Which opaque tokens are
    live is looked up by a hash of the text, so equal texts are redacted alike; that table is broadcast if it is small.
    """
    entropy, schema = params.entropy, docs.schema
    found = find(docs, params, repository, owner)
    each = found.select("key", F.explode("candidates").alias("c")).where("c.kind = 3").select("key", F.col("c.hash").alias("hash")).distinct()
    live = written(alive(each, ownership(found, params)).groupBy("key").agg(F.collect_set("hash").alias("__live")), "live").withColumnRenamed("key", "__key")
    rows = docs.join(sized(live), F.xxhash64("text") == F.col("__key"), "left").drop("__key")
    at, n = schema.fieldNames().index("text"), schema.fieldNames().index("n_chars") if "n_chars" in schema.fieldNames() else None

    def clean(text: str, hashes) -> str:
        base = base_spans(text)
        spans = base + [s for s in (other_spans(text, base, entropy) if hashes else ()) if digest(s[3]) in hashes]
        out, done = [], 0
        for start, _, stop, _ in sorted(spans):
            if start >= done:
                out += [text[done:start], mark]
            done = max(done, stop)
        return "".join([*out, text[done:]]) if spans else text

    def run(parts):
        for part in parts:
            old = part.column(at).to_pylist()
            live_ = part.column(part.num_columns - 1).to_pylist()
            new = [x and clean(x, set(h or ())) for x, h in zip(old, live_, strict=True)]
            columns = part.columns[:-1]
            columns[at] = pa.array(new, columns[at].type)
            if n is not None:
                columns[n] = pa.array([v if x == y else len(y) for v, x, y in zip(columns[n].to_pylist(), old, new, strict=True)], columns[n].type)
            yield pa.RecordBatch.from_arrays(columns, names=part.schema.names[:-1])

    return rows.mapInArrow(run, T.StructType(list(schema)))
