"""License scans by diagonal voting, in DataFrame functions only.

All rolling word k-gram hashes of the texts are joined with the k-gram positions of license
templates. A hit votes for its diagonal, the document position less the template position.
Votes are counted per diagonal, diagonals that lie within a few words of each other merge
(words put in or left out shift the rest), and a merged span is verified: the share of the
template's words that its hits cover, and the share of the span's own words, must both be high.

Words: A-Z in lower case, then runs of characters other than ASCII ones that are neither
letters nor digits. A null or empty text has no words and no labels. Rows that repeat an id
and a text get equal results; rows that repeat only the id are scanned apart. Extra columns
are ignored.
"""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_or_empty

K = 3
TOLERANCE = 3
#: Shares of a template's words and of a span's words that hits must cover. A template below SHORT words differs from its like in a word or a number: all of it must be there.
COVERAGE, DENSITY, SHORT = 0.75, 0.6, 12
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Wording that licenses ask to be put into works, by label.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "mit": (
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ),
    "gpl-2.0": ("licensed under the GNU General Public License, version 2", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    "gpl-3.0": ("This work is licensed under the GNU General Public License, version 3", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    "lgpl": ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    "cc-by-4.0": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "cc-by-sa-4.0": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc-by-nd-4.0": ("Licensed under CC BY-ND 4.0",),
}
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, _UPPER, _UPPER.lower()), NOT_WORD), lambda w: w != "")


def template_words(text: str) -> list[str]:
    return [w for w in re.split(NOT_WORD, text.lower()) if w]


def places(w: Column, phrase: list[str]) -> Column:
    """Where the phrase's words stand one after the other."""
    starts = F.sequence(F.lit(0), F.size(w) - len(phrase))

    def here(i: Column) -> Column:
        out = F.get(w, i) == phrase[0]
        for j, p in enumerate(phrase[1:], 1):
            out = out & (F.get(w, i + j) == p)
        return out

    all_in = F.size(w) >= len(phrase)
    for p in set(phrase):
        all_in = all_in & F.array_contains(w, p)
    return F.when(all_in, F.filter(starts, here)).otherwise(F.array().cast("array<int>"))


def gram_hashes(w: Column, k: int = K) -> Column:
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k))))
    return F.when(F.size(w) >= k, runs).otherwise(F.array().cast("array<bigint>"))


def template_positions(spark: SparkSession, templates: dict[str, tuple[str, ...]], k: int = K) -> DataFrame:
    """gram, label, template, at, length: a few rows for each word of the templates, so it may be broadcast."""
    texts = list(chain.from_iterable(((label, t) for t in of) for label, of in templates.items()))
    rows = [(i, label, w) for i, (label, t) in enumerate(texts) if len(w := template_words(t)) >= k]
    df = spark.createDataFrame(rows, "template int, label string, w array<string>")
    return df.select("template", "label", F.size("w").alias("length"), F.posexplode(gram_hashes(F.col("w"), k)).alias("at", "gram"))


def spans(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, k: int = K) -> DataFrame:
    """Verified spans of ``docs`` (key, w): key, label, template, first, last (words), coverage, density, score."""
    grams = docs.select("key", F.posexplode(gram_hashes(F.col("w"), k)).alias("doc_at", "gram"))
    hits = grams.join(F.broadcast(template_positions(docs.sparkSession, templates, k)), "gram").withColumn("diagonal", F.col("doc_at") - F.col("at"))
    # The positions in a diagonal's set are at most a template's, and each document's votes are its own.
    votes = hits.groupBy("key", "template", "label", "length", "diagonal").agg(F.collect_set("at").alias("ats"))
    order = Window.partitionBy("key", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > TOLERANCE, F.lit(True))
    merged = votes.withColumn("group", F.sum(apart.cast("int")).over(order)).groupBy("key", "template", "label", "length", "group")
    covered = lambda at: F.size(F.array_distinct(F.flatten(F.transform(at, lambda p: F.sequence(p, p + k - 1)))))
    at_doc = F.transform("ats", lambda p: p + F.col("diagonal"))
    return (
        merged.agg(
            F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"), F.array_distinct(F.flatten(F.collect_list(at_doc))).alias("docs_at")
        )
        .withColumns({"first": F.array_min("docs_at"), "last": F.array_max("docs_at") + k - 1})
        .withColumns({"coverage": covered(F.col("ats")) / F.col("length"), "density": covered(F.col("docs_at")) / (F.col("last") - F.col("first") + 1)})
        .filter((F.col("coverage") >= F.when(F.col("length") < SHORT, 1.0).otherwise(COVERAGE)) & (F.col("density") >= DENSITY))
        .select("key", "label", "template", "first", "last", "coverage", "density", (F.col("coverage") * F.col("density")).alias("score"))
    )


def scan(docs: DataFrame, phrases=PHRASES, templates: dict[str, tuple[str, ...]] = TEMPLATES, k: int = K) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best span's; 1 at least with a base phrase)."""
    worded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), words(text_or_empty()).alias("w"))
    found = worded.select(
        "doc_id", "text_hash", F.size("w").cast("long").alias("n_words"),
        *(places(F.col("w"), p.split()).alias(f"p{i}") for i, (p, _) in enumerate(phrases)),
    )
    at = [F.col(f"p{i}") for i in range(len(phrases))]
    every = F.concat(*at)
    base = F.array_compact(F.array(*(F.when(F.size(a) > 0, F.lit(label)) for a, (_, label) in zip(at, phrases, strict=True))))
    rows = found.select(
        "doc_id", "text_hash", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.sort_array(F.array_distinct(base)).alias("base"),
    )
    key = F.struct("doc_id", "text_hash").alias("key")
    own = spans(worded.select(key, "w"), templates, k).groupBy("key").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    own = own.select(F.col("key.doc_id").alias("_id"), F.col("key.text_hash").alias("_hash"), "more", "best")
    joined = rows.join(own, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    labels = F.sort_array(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
