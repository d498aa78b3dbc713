"""License scans with DataFrame functions only: phrases that name a license, and blocks of text that hold a license template.

A template is a set of words. A block is 2s words of a text, every s words, with s the power of two at or above 5/4 of a template's words: any s + 1 words
in a row lie within one. Templates and blocks are joined exactly where a block holds at least ``percent`` of a template's words:

1. Words of templates are ordered by the number of documents that hold them, rarest first. Only these are counted, before anything is shuffled.
2. Prefix filter: a block that shares ``need`` of a template's ``size`` words shares one of its ``size - need + 1`` rarest ones. So blocks are made where such a word
   stands; they keep the words of templates alone, in the global order, and the row's other words stay behind.
3. Blocks meet templates in an equi-join on the words of both prefixes. Length filter: a block has ``need`` words at least. Positional filter: what the
   prefixes share and what can follow the last shared place on either side add up to ``need``.
4. What is left is counted exactly.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import fold_ascii, sized, written
from quillon.llm.mixture import bound

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that name a license, and its label.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Notices and their labels: what projects put into their files, and the lines that name a license in short.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
#: Type of the blocks of a text.
BLOCKS = "array<struct<stride:int,block:int,tokens:array<string>>>"
#: Words that all templates together may have: they go with every row as arrays.
MOST_WORDS = 100_000


@dataclass(frozen=True)
class LicenseParams:
    """A block holds a template if it has ``percent`` of its distinct words; of short templates that is every word."""

    percent: int = 90


def words(text: str = "text") -> Column:
    return F.regexp_extract_all(F.coalesce(fold_ascii(text), F.lit("")), F.lit(WORD), F.lit(0))


def places(phrases: Sequence[tuple[str, str]]) -> Column:
    """Array of (start, label): where the words of each phrase stand consecutively in the column ``words``, by start."""
    line = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    found = []
    for phrase, label in phrases:
        # few texts hold a phrase at all
        some = F.when(F.contains(line, F.lit(f" {phrase} ")), starts(phrase.split(" "))).otherwise(F.array().cast("array<int>"))
        found.append(labelled(some, label))
    return F.array_sort(F.concat(*found))


def starts(parts: list[str]) -> Column:
    """Where ``parts`` stand consecutively among ``words``, which has as many at least."""
    here = lambda i: reduce(lambda x, y: x & y, [F.get("words", i + k) == part for k, part in enumerate(parts)])
    return F.filter(F.sequence(F.lit(0), F.size("words") - len(parts)), here)


def labelled(starts: Column, label: str) -> Column:
    return F.transform(starts, lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))


def vocabulary(docs: DataFrame, templates: DataFrame, params: LicenseParams) -> DataFrame:
    """template, label, stride, size, need, token, rarity, place of every distinct word of every template; written.

    rarity: the documents that hold the word. place: in the template's words by rarity and then by the word. Templates (label, text) without words are passed
    over; equal ones count once.
    """
    t = templates.select("label", words().alias("w")).where(F.size("w") > 0).distinct()
    t = t.select(F.xxhash64("label", "w").alias("template"), "label", F.size("w").alias("m"), F.array_distinct("w").alias("w"))
    stride = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("m") * 1.25))).cast("int")
    size = F.size("w")
    t = t.select("template", "label", stride.alias("stride"), size.alias("size"), F.floor((params.percent * size + 99) / 100).cast("int").alias("need"), F.explode("w").alias("token"))
    t = written(t, "templates")
    if (n := t.count()) > MOST_WORDS:
        raise ValueError(f"templates have {n} words, more than {MOST_WORDS}")
    all_ = t.agg(F.collect_set("token").alias("all"))
    held = docs.select(words().alias("words")).crossJoin(F.broadcast(all_)).select(F.explode(F.array_intersect("words", "all")).alias("token"))
    counts = held.groupBy("token").agg(F.count("*").alias("rarity"))
    t = t.join(counts, "token", "left").withColumn("rarity", F.coalesce("rarity", F.lit(0)).cast("long"))
    w = Window.partitionBy("template").orderBy("rarity", "token")
    return written(t.withColumn("place", F.row_number().over(w) - 1), "vocabulary")


def blocks(vocabulary: DataFrame, docs: DataFrame, phrases: Sequence[tuple[str, str]]) -> DataFrame:
    """row, doc_id, n_words, places, blocks (array of stride, block, tokens) of every document; written.

    Only blocks with a word of a template's prefix; tokens: the words of that stride's templates in the block, in the global order.
    """
    order = F.array_sort(F.collect_set(F.struct("rarity", "token")))
    rare = F.collect_set(F.when(F.col("place") <= F.col("size") - F.col("need"), F.col("token")))
    strides = vocabulary.groupBy("stride").agg(order["token"].alias("all"), rare.alias("rare"), F.min("need").alias("least"))
    strides = strides.agg(F.collect_list(F.struct("*")).alias("strides"), F.array_distinct(F.flatten(F.collect_list("rare"))).alias("rare"))

    def of(s):
        def at(hits):
            held = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.array_contains(hits, F.get("words", i)))
            both = F.flatten(F.transform(held, lambda i: F.array(F.floor(i / s["stride"]).cast("int"), F.floor(i / s["stride"]).cast("int") - 1)))
            numbers = F.filter(F.array_distinct(both), lambda k: k >= 0)
            tokens = lambda k: F.array_intersect(s["all"], F.slice("words", k * s["stride"] + 1, 2 * s["stride"]))
            made = F.transform(numbers, lambda k: F.struct(s["stride"].alias("stride"), k.alias("block"), tokens(k).alias("tokens")))
            return F.filter(made, lambda x: F.size(x["tokens"]) >= s["least"])

        return bound(F.array_intersect(s["rare"], F.col("words")), lambda hits: F.when(F.size(hits) > 0, at(hits)).otherwise(F.array().cast(BLOCKS)))

    made = F.when(F.arrays_overlap("words", "rare"), F.flatten(F.transform("strides", of)))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words().alias("words")).crossJoin(F.broadcast(strides))
    d = d.select("doc_id", F.size("words").cast("long").alias("n_words"), places(phrases).alias("places"), made.alias("blocks"))
    return written(d.withColumn("row", F.monotonically_increasing_id()), "blocks")


def matches(blocks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """row, label, first, end, score of every block that holds a template: its first word and the one after its last, and the share of
    the template's words."""
    b = blocks.select("row", "n_words", F.explode("blocks").alias("b")).select("row", "n_words", "b.*")
    each = b.select("*", F.size("tokens").alias("held"), F.posexplode("tokens").alias("at", "token"))
    v = vocabulary.where(F.col("place") <= F.col("size") - F.col("need"))
    # prefix of both sides, length
    both = each.join(sized(v), ["stride", "token"]).where((F.col("held") >= F.col("need")) & (F.col("at") <= F.col("held") - F.col("need")))
    pairs = both.groupBy("row", "stride", "block", "template").agg(
        F.count("*").alias("shared"), F.max("place").alias("place"), F.max("at").alias("at"),
        *[F.first(c).alias(c) for c in ("n_words", "tokens", "held", "size", "need", "label")],
    )
    rest = F.least(F.col("size") - 1 - F.col("place"), F.col("held") - 1 - F.col("at"))
    t = vocabulary.groupBy("template").agg(F.collect_set("token").alias("all"))
    exact = pairs.where(F.col("shared") + rest >= F.col("need")).join(sized(t), "template")
    exact = exact.withColumn("shared", F.size(F.array_intersect("tokens", "all"))).where(F.col("shared") >= F.col("need"))
    first = F.col("block").cast("long") * F.col("stride")
    return exact.select("row", "label", first.alias("first"), F.least(first + 2 * F.col("stride"), "n_words").alias("end"), (F.col("shared") / F.col("size")).alias("score"))


def scan(docs: DataFrame, templates: DataFrame, params: LicenseParams = LicenseParams(), phrases: Sequence[tuple[str, str]] = PHRASES) -> DataFrame:
    """doc_id, n_words, places (array of start, label) and matches (array of label, first, end, score) of every document.

    places: where a phrase's words stand consecutively, words from 0. matches: blocks that hold a template, by first word and label, with the share of its
    words, of several templates of a label the best. Null and empty texts have none; words repeated in a block count once; repeated rows are scanned each;
    other columns are not read; an empty table gives no rows. Very long texts are cut into blocks as any others.
    """
    v = vocabulary(docs, templates, params)
    d = blocks(v, docs, phrases)
    best = matches(d, v).groupBy("row", "label", "first", "end").agg(F.max("score").alias("score"))
    found = best.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("first", "label", "end", "score"))).alias("matches"))
    none = F.array().cast("array<struct<first:long,label:string,end:long,score:double>>")
    return d.drop("blocks").join(found, "row", "left").select("doc_id", "n_words", "places", F.coalesce("matches", none).alias("matches"))
