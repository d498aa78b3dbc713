"""Byte-level BPE: encoding with the tokenizers library over Arrow batches, and decoding through the byte table.

The library writes every byte of a text as one printable character before it merges, so a token is a run of such
characters, one for each byte. Reversing that table gives each token's bytes; their lengths, added up, give byte offsets, and
the bytes that start a character give character offsets, also where a character is split between tokens.
Rows are independent: one pass, no shuffle, texts encoded in small groups so memory follows the longest text. The pattern cuts a
group's texts into words; the library merges each distinct word of the group once, and a worker keeps a bounded number of short words.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import batch

#: Bytes of text that are encoded in one call.
CHUNK = 1 << 18
#: Words that a worker keeps with their ids, and the longest that it keeps.
KEPT, KEPT_LENGTH = 250_000, 32


def byte_table() -> dict[str, int]:
    """The printable character that stands for each byte, reversed: bytes that are printable alone stand for
    themselves, the others, in order, for the characters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    table = {chr(b): b for b in plain}
    return table | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class Codec:
    """A byte-level BPE of the tokenizers library, its tokens' bytes, and the ids of words met lately.

    path: its JSON file, whose own pattern is not used. ranks: the file of the same vocabulary as ranks, to which it must be equal, or None.
    """

    def __init__(self, path: str, ranks: str | None, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # words come one by one: nothing is left to be split
        self.tokenizer.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        self.words = regex.compile(pattern).findall
        table = byte_table()
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            if all(c in table for c in token):
                self.bytes[i] = bytes(map(table.__getitem__, token))
        if ranks:
            with open(ranks, "rb") as f:
                known = {int(i): base64.b64decode(token) for token, i in map(bytes.split, f)}
            if any(self.bytes[i] != token for i, token in known.items()):
                raise ValueError(f"{path} and {ranks} hold different vocabularies")
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.names = [str(i) for i in range(len(self.bytes))]
        self.numbers = list(range(len(self.bytes)))
        self.kept: dict[str, tuple[int, ...]] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        cut = [self.words(t) for t in texts]
        here = set(chain.from_iterable(cut))
        new = [w for w in here if w not in self.kept]
        if len(self.kept) + len(new) > KEPT:
            self.kept.clear()
            new = list(here)
        found = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
        self.kept.update(zip(new, (tuple(map(self.numbers.__getitem__, e.ids)) for e in found), strict=True))
        out = [list(chain.from_iterable(map(self.kept.__getitem__, x))) for x in cut]
        for w in new:
            if len(w) > KEPT_LENGTH:
                del self.kept[w]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def offsets(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """First character and end character of each token. A token that holds only part of a character has that
        character's place: tokens that share a character overlap there."""
        data = np.frombuffer(text.encode(), np.uint8)
        stop = np.cumsum(self.sizes[ids])
        begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        return begins[np.minimum(stop - self.sizes[ids] + 1, len(data))] - 1, begins[stop]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(2)
def codec(path: str | None = None) -> Codec:
    """The codec of a JSON file; that of the public vocabulary is held against its ranks."""
    import public_tokenizers

    path = path or vocabulary()
    return Codec(path, public_tokenizers.path("byte_bpe_50k.tiktoken") if path == vocabulary() else None, public_tokenizers.PATTERN)


def chunks(texts: list[str]):
    held, n = [], 0
    for x in texts:
        held.append(x)
        n += len(x)
        if n >= CHUNK:
            yield held
            held, n = [], 0
    if held:
        yield held


def encode(docs: DataFrame, path: str | None = None, offsets: bool = True) -> DataFrame:
    """doc_id, ids (array of int) and, on demand, starts and stops (characters) of every document.

    The ids are those of the rank file of the same vocabulary, each match of its pattern merged by itself, without special
    tokens. Null and empty texts have no ids; repeated rows are encoded each; other columns are not read.
    path: the vocabulary, a file that every worker has; by default the public one, which is held against its ranks.
    """
    kinds = [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))] + [("starts", pa.list_(pa.int32())), ("stops", pa.list_(pa.int32()))] * offsets
    schema = pa.schema(kinds)

    def run(parts):
        c = codec(path)
        for part in parts:
            ids, at = part.column(0).to_pylist(), 0
            for group in chunks([x or "" for x in part.column(1).to_pylist()]):
                rows = []
                for text, found in zip(group, c.encode(group), strict=True):
                    rows.append((ids[at], np.array(found, np.int32), *(c.offsets(text, found) if offsets else ())))
                    at += 1
                yield batch(rows, schema)

    out = "doc_id long, ids array<int>" + ", starts array<int>, stops array<int>" * offsets
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, out)


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """The columns of ``tokens`` and ``data``: the bytes of ``ids`` (null: none). Bytes of a character that ids split come
    out as they went in; ids outside the vocabulary fail."""
    at = tokens.columns.index("ids")
    schema = T.StructType([*tokens.schema, T.StructField("data", T.BinaryType())])

    def run(parts):
        c = codec(path)
        for part in parts:
            data = pa.array([c.decode(x or ()) for x in part.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, data], names=[*part.schema.names, "data"])

    return tokens.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str | None = None, packed: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_split and offsets_sha256 of every document, encoded and decoded again in one pass, and on
    demand token_ids: the ids as little-endian 16-bit numbers.

    n_split: tokens that begin or end within a character. offsets_sha256: of the first and the end characters as little-endian 32-bit numbers.
    Null and empty texts have no tokens, and the digests of nothing; texts of any length are taken whole; repeated rows are encoded each;
    a null doc_id stays; other columns are not read; an empty table gives no rows.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_split", "offsets_sha256"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    schema = pa.schema([*zip(names, kinds, strict=True), *[("token_ids", pa.binary())] * packed])

    def run(parts):
        c = codec(path)
        for part in parts:
            ids, at = part.column(0).to_pylist(), 0
            for group in chunks([x or "" for x in part.column(1).to_pylist()]):
                rows = []
                for text, found in zip(group, c.encode(group), strict=True):
                    digest = sha256(" ".join(map(c.names.__getitem__, found)).encode()).hexdigest()
                    numbers = np.array(found, np.int32)
                    starts, stops = c.offsets(text, numbers)
                    within = starts[1:] < stops[:-1]
                    split = int((np.append(within, False) | np.append(False, within)).sum()) if len(found) else 0
                    places = sha256(np.concatenate([starts, stops]).astype("<i4").tobytes()).hexdigest()
                    rows.append((ids[at], len(found), digest, sha256(c.decode(found)).hexdigest(), split, places, *([numbers.astype("<u2").tobytes()] if packed else ())))
                    at += 1
                yield batch(rows, schema)

    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long, offsets_sha256 string" + ", token_ids binary" * packed
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, out)
