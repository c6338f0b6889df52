"""License scan: an exact set-similarity join between text blocks and templates, in DataFrame operations only.

Texts are cut into overlapping blocks of words.  Template tokens are ordered by the
number of documents that hold them, rarest first; a block that contains the needed
share of a template holds one of the template's first tokens in that order (prefix
filter), has enough different words (length filter), and enough template tokens from
that one on (positional filter).  What is left is intersected.  Phrases are templates
that must be whole; their places are then read off the block.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Half of a block, in words; no template is longer, so each place lies whole in some block.
STRIDE = 32
CONTAINMENT = 0.8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: bool = False

    @property
    def tokens(self) -> list[str]:
        return list(dict.fromkeys(self.text.split()))


# The phrases, and opening lines of public licence texts.
PHRASES = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
)
TEXTS = (
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("apache-2.0-text", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("gpl-text", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("cc-text", "this work is licensed under a creative commons attribution 4 0 international license"),
)


def word_array(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; null and empty texts have none."""
    plain = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), _NOT_WORD, " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def _texts(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def token_order(words: DataFrame, templates: tuple[Template, ...]) -> list[str]:
    """Template tokens by the number of rows that hold them, rarest first (over all rows; one number per token)."""
    every = sorted({t for x in templates for t in x.tokens})
    held = words.select(F.explode(F.array_intersect("words", _texts(every))).alias("token"))
    n = {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(every, key=lambda t: (n.get(t, 0), t))


def scan_licenses(
    df: DataFrame, text: str = "text", key: str = "doc_id", templates: tuple[Template, ...] = PHRASES + TEXTS, share: float = CONTAINMENT
) -> DataFrame:
    """``key, n_words, places, matches``: word positions of whole phrases, and template matches.

    ``places`` holds (label, start), each place once, in order; ``matches`` the distinct
    (label, share) of templates met by some block, phrases included.  Null and empty texts
    give 0 words and empty arrays; every row gives one row, repeated keys too.
    """
    if any(len(t.text.split()) > STRIDE for t in templates):
        raise ValueError(f"a template may have {STRIDE} words at most")
    spark = df.sparkSession
    docs = df.select(F.col(f"`{key}`").alias("id"), word_array(F.col(f"`{text}`")).alias("words"))
    order = token_order(docs, templates)
    rank = {t: k for k, t in enumerate(order)}

    prefix, plans = [], []
    for number, t in enumerate(templates):
        ranked = sorted(t.tokens, key=rank.__getitem__)
        need = len(ranked) if t.phrase else math.ceil(share * len(ranked))
        plans.append((number, t.label, t.phrase, ranked, t.text.split(), need))
        prefix += [(token, number, at) for at, token in enumerate(ranked[: len(ranked) - need + 1])]
    # Constants of this module, a few hundred rows whatever the corpus holds.
    index = spark.createDataFrame(prefix, "token string, template int, at int").join(
        spark.createDataFrame(plans, "template int, label string, phrase boolean, tokens array<string>, phrase_words array<string>, need int"),
        "template",
    )
    first = sorted({p[0] for p in prefix}, key=rank.__getitem__)

    at = F.sequence(F.lit(0), F.size("words") - 1)
    hits = F.filter(at, lambda i: F.get("words", i).isin(first))
    starts = F.array_distinct(
        F.flatten(F.transform(hits, lambda i: F.array(F.floor(i / STRIDE), F.greatest(F.floor(i / STRIDE) - 1, F.lit(0)))))
    )
    cut = F.transform(
        starts,
        lambda b: F.struct(b.cast("int").alias("b"), F.slice("words", b.cast("int") * STRIDE + 1, 2 * STRIDE).alias("words")),
    )
    blocks = F.when(F.arrays_overlap("words", _texts(first)), cut)
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "id", F.size("words").alias("n_words"), blocks.alias("blocks"))
    rows = numbered.select("row", "id", "n_words", F.explode_outer("blocks").alias("x"))
    block = F.array_distinct("x.words")
    routed = rows.select(
        "row",
        "id",
        "n_words",
        F.col("x.b").alias("b"),
        F.col("x.words").alias("words"),
        F.size(block).alias("width"),
        F.array_intersect(_texts(order), block).alias("ranked"),
        F.explode_outer(F.array_intersect(_texts(first), block)).alias("token"),
    )
    met = routed.join(F.broadcast(index), "token", "left")
    common = F.array_intersect("tokens", "ranked")
    # The token must be the first one in common; after it enough must be left on both sides.
    later = F.least(F.size("tokens") - F.col("at"), F.size("ranked") - F.array_position("ranked", F.col("token")).cast("int") + 1)
    passes = (F.col("width") >= F.col("need")) & (later >= F.col("need")) & (F.get(common, F.lit(0)) == F.col("token"))
    overlap = F.when(F.coalesce(passes, F.lit(False)), F.size(common)).otherwise(0)
    reached = met.withColumn("overlap", overlap).withColumn("hit", F.coalesce(F.col("overlap") >= F.col("need"), F.lit(False)))
    length = F.size("phrase_words")
    begins = F.filter(
        F.sequence(F.lit(0), F.lit(STRIDE - 1)), lambda i: F.slice("words", i + 1, length) == F.col("phrase_words")
    )
    base = F.col("b") * STRIDE
    found = reached.select(
        "row",
        "id",
        "n_words",
        F.when(F.col("hit") & F.col("phrase"), F.transform(begins, lambda i: F.struct(F.col("label").alias("label"), (base + i).cast("long").alias("start")))).alias("places"),
        F.when(
            F.col("hit") & ~F.col("phrase"),
            F.struct(F.col("label").alias("label"), (F.col("overlap") / F.size("tokens")).alias("share")),
        ).alias("match"),
    )
    summed = found.groupBy("row").agg(
        F.first("id").alias("id"),
        F.first("n_words").cast("long").alias("n_words"),
        F.sort_array(F.flatten(F.collect_list("places"))).alias("places"),
        F.collect_set("match").alias("texts"),
    )
    whole = F.transform(F.array_distinct(F.transform("places", lambda p: p["label"])), lambda x: F.struct(x.alias("label"), F.lit(1.0).alias("share")))
    return summed.select(F.col("id").alias(key), "n_words", "places", F.sort_array(F.concat(whole, "texts")).alias("matches"))


def digest_columns(found: DataFrame) -> DataFrame:
    labels = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda x: x["label"]))), ",")
    starts = F.transform("places", lambda p: p["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels("places").alias("base_labels"),
        labels("matches").alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)).alias("score"),
    )
