"""License scan by an exact set-similarity join, in DataFrame functions only.

A template is a set of words; a text block contains it if at least THRESHOLD of them are
in it. Blocks are cut from the document's whole sequence of words, as a template may be wrapped over
lines. Templates go in tiers by their number of words, 16, 32, 64 and so on: blocks are twice as long as the tier, one for each
tier's length, so that every run of words as long as a template lies whole in one.

Words of templates are ordered by their frequency over all documents, rarest first. A block that
contains a template has one of its first |T| - ceil(THRESHOLD * |T|) + 1 words (prefix
filter), so only documents with such a word are cut into blocks, and blocks meet templates in a
join on these words alone. What remains must have enough words (length filter), and enough
of the template's words at or after the one that they met at (positional filter), before
words in common are counted.

Base labels are found besides: places where a phrase's words stand consecutively.

Nulls: a null text is empty: no words, no labels, null first_word and last_word, score 0. Rows
equal in doc_id and text have equal results. A template of no words is
an error. Very long texts are whole. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridloom.llm.common import sources, stored

THRESHOLD, TIER = 0.8, 16
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Wording of notices and licenses, in lower case and without marks.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("all-rights-reserved", "all rights reserved"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
        "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the software",
    ),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is "
        "basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "gpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even "
        "the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source "
        "code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice "
        "this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
        "permission notice appear in all copies",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the "
        "following restrictions",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source "
        "code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
]
#: Templates whose words are broadcast; above it the join shuffles.
BROADCAST_WORDS = 100_000
LEAST = -(1 << 63)


def spaced(text: Column) -> Column:
    """A-Z in lower case, and one space between words. Letters beyond ASCII change case too, but none becomes an ASCII letter, so that phrases and templates can't tell."""
    return F.btrim(F.regexp_replace(F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u00e5"))), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " "))


def split_words(line: Column) -> Column:
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, " "))


def phrase_places(line: Column, words: Column, phrase: str) -> Column:
    """Where the phrase starts, counted in words; only texts that have it are searched."""
    parts = phrase.split()
    has = F.contains(F.concat(F.lit(" "), line, F.lit(" ")), F.lit(f" {phrase} "))
    places = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), lambda i: reduce(lambda a, b: a & b, (F.get(words, i + k) == p for k, p in enumerate(parts))))
    return F.when(has, places).otherwise(F.array().cast("array<int>"))


def _labelled(places: Column, label: str) -> Column:
    return F.transform(places, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))


def tier_of(template: str) -> int:
    """The least of TIER, 2 * TIER, 4 * TIER, ... that is no less than the template's number of words."""
    return max(TIER, 1 << (len(template.split()) - 1).bit_length())


def template_index(lines: DataFrame, templates: list[tuple[str, str]], threshold: float) -> list[tuple]:
    """(tier, template, label, words rarest first, words needed): ordered by the number of documents that have each word, over all documents."""
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    found = F.array_intersect(split_words(F.col("line")), F.array(*map(F.lit, vocabulary)))
    counts = {r[0]: r[1] for r in lines.select(F.explode(found).alias("w")).groupBy("w").count().collect()}  # a row for each word of the templates
    out = []
    for k, (label, text) in enumerate(templates):
        words = sorted(set(text.split()), key=lambda w: (counts.get(w, 0), w))
        out.append((tier_of(text), k, label, words, math.ceil(threshold * len(words) - 1e-9)))
    return out


def _contained(rows: DataFrame, tier: int, index: list[tuple]) -> DataFrame:
    """(id, hash, label, containment) for the templates of one tier."""
    prefixes = F.array(*map(F.lit, sorted({w for _, _, words, need in index for w in words[: len(words) - need + 1]})))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - tier, F.lit(1)), F.lit(tier))
    some = rows.withColumn("w", split_words(F.col("line"))).where(F.arrays_overlap("w", prefixes))
    blocks = some.select("id", "hash", F.explode(F.transform(starts, lambda s: F.slice("w", s, F.lit(2 * tier)))).alias("w")).select("id", "hash", F.array_distinct("w").alias("w"))
    met = blocks.select("*", F.explode(F.array_intersect("w", prefixes)).alias("word"))
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    entries = [f"({quote(w)}, {k}, {quote(label)}, {p}, {need}, array({', '.join(map(quote, words))}))" for k, label, words, need in index for p, w in enumerate(words[: len(words) - need + 1])]
    table = rows.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(entries)} AS t(word, template, label, place, need, words)")
    if sum(len(words) for _, _, words, _ in index) <= BROADCAST_WORDS:
        table = F.broadcast(table)
    near = met.join(table, "word").where((F.size("w") >= F.col("need")) & (F.size("words") - F.col("place") >= F.col("need")))
    common = F.size(F.array_intersect("words", "w"))
    return near.withColumn("common", common).where(F.col("common") >= F.col("need")).select("id", "hash", "label", (F.col("common") / F.size("words")).alias("containment"))


def scan_lines(lines: DataFrame, templates: list[tuple[str, str]], threshold: float = THRESHOLD) -> DataFrame:
    """(id, hash, label, containment) of each template that some block of a document contains, from rows (id, hash, line) of ``spaced`` texts."""
    if any(not t.split() for _, t in templates):
        raise ValueError("a template has no words")
    if not templates:
        return lines.select("id", "hash", F.lit("").alias("label"), F.lit(0.0).alias("containment")).limit(0)
    index = template_index(lines, templates, threshold)
    wanted = sorted({w for _, _, _, words, need in index for w in words[: len(words) - need + 1]})
    some = stored(lines.where(F.arrays_overlap(F.split("line", " "), F.array(*map(F.lit, wanted)))))
    found = [_contained(some, tier, [x[1:] for x in index if x[0] == tier]) for tier in sorted({x[0] for x in index})]
    return reduce(DataFrame.union, found).groupBy("id", "hash", "label").agg(F.max("containment").alias("containment"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``scan_lines`` of whole documents; id and hash: of doc_id and text, see ``keyed``. Templates are read like texts: A-Z in lower case, without marks."""
    wanted = [(label, " ".join("".join(c if not c.isascii() or c.isalnum() else " " for c in t.lower()).split())) for label, t in (TEMPLATES if templates is None else templates)]
    return scan_lines(stored(keyed(docs).select("id", "hash", spaced(F.col("text")).alias("line"))), wanted, threshold)


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("id"), text.alias("text")).withColumn("hash", F.xxhash64("text"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sources(spark, sf_dir, "documents")
    lines = stored(keyed(docs).select("id", "hash", spaced(F.col("text")).alias("line")))
    rows = lines.withColumn("w", split_words(F.col("line")))
    places = [_labelled(phrase_places(F.col("line"), F.col("w"), p), label) for p, label in PHRASES.items()]
    rows = rows.select("id", "hash", F.size("w").cast("long").alias("n_words"), F.concat(*places).alias("places"))
    extra = scan_lines(lines, TEMPLATES).groupBy("id", "hash").agg(F.collect_list("label").alias("extra"), F.max("containment").alias("containment"))
    at = F.transform("places", lambda x: x["at"])
    base = F.array_distinct(F.transform("places", lambda x: x["label"]))
    joined = rows.join(extra, ["id", "hash"], "left").withColumn("extra", F.coalesce("extra", F.array().cast("array<string>")))
    return joined.select(
        F.nullif("id", F.lit(LEAST)).alias("doc_id"),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, "extra")), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )
