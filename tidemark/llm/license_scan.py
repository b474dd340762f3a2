"""License scans: an exact set-similarity join of text blocks with license templates, in built-in functions only.

A block is a paragraph of the text, the lines up to an empty one, so that wrapped notices are found; its tokens are its distinct words. A block carries
a template's label when at least ``CONTAINMENT`` percent of the template's distinct words stand together in it: in a run of words of
which the whole template could be that share, or, of short notices, in a run of ``NOTICE_RUN`` words, as a long line or a text without empty lines holds the words of a notice by chance.
Texts are read once: what a document holds of the templates' words is kept, and its text where that is enough for one.
The join is exact: template words are put in order of
their frequency over all documents, rarest first, and a block that meets the threshold must hold one of the first
``size - needed + 1`` of them (prefix), at a place that leaves enough words after it (position), and must itself hold
``needed`` words or more (length). What passes is verified on the whole sets, and then on runs of the block's words. Only the template index is broadcast; its
size is fixed by ``TEMPLATES`` and ``TITLES`` below, not by the data.

Beside the templates, phrases are found as consecutive words anywhere in the text.

Null and empty texts have no words and no labels. Repeated rows give repeated results, whatever their ids; ties in frequency
are broken by the word; extra columns play no part. A table without rows gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, stored

#: Percent of a template's distinct words that a block must hold.
CONTAINMENT = 80
#: Words among which those of a short notice must stand.
NOTICE_RUN = 8
#: Anything that is not a word: ASCII but for digits and small letters (texts are lower-cased first).
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What ends a paragraph.
EMPTY_LINE = r"\n[\x20\x09\x0B-\x0D]*\n"
#: Phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Opening sentences and short notices of public licenses, with labels. A notice has four words at
#: most, so that all of them are needed at 80 %: of five words, one could be left out, and that could be the name.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "Released under the GNU General Public License, version"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("reserved", "Copyright, all rights reserved"),
    ("mit", "under MIT License"),
    ("apache-2.0", "under Apache License"),
    ("apache-2.0", "under Apache 2.0"),
    ("bsd", "under BSD License"),
    ("bsd", "under BSD clause"),
    ("gpl", "under GPL"),
    ("gpl", "under GPLv2"),
    ("gpl", "under GPLv3"),
    ("mpl-2.0", "under Mozilla Public License"),
    ("mpl-2.0", "under MPL 2.0"),
    ("isc", "under ISC License"),
    ("cc-by", "under Creative Commons Attribution"),
    ("cc0", "under CC0"),
    ("cc0", "under Creative Commons Zero"),
    ("unlicense", "under Unlicense"),
)
#: Titles of licenses and the words of license identifiers; all of them are needed, two of them side by side and more with one other word between at most.
TITLES = (
    ("mit", "MIT License"), ("mit", "MIT licensed"), ("apache-2.0", "Apache License 2.0"), ("apache-2.0", "Apache License Version"), ("bsd", "BSD License"), ("bsd", "BSD clause license"), ("gpl", "GNU General Public License"),
    ("mpl-2.0", "Mozilla Public License"), ("isc", "ISC License"), ("mit", "License Identifier MIT"), ("apache-2.0", "License Identifier Apache"), ("bsd", "License Identifier BSD"), ("gpl", "License Identifier GPL"),
    ("mpl-2.0", "License Identifier MPL"), ("isc", "License Identifier ISC"), ("cc-by", "License Identifier CC BY"), ("cc0", "License Identifier CC0"), ("unlicense", "License Identifier Unlicense"),
)
KNOWN = TEMPLATES + TITLES


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def phrase_places(words: Column, phrase: str) -> Column:
    """Starts of the places where the phrase's words stand consecutively, from 0, in order."""
    parts = phrase.split()

    def stands(i: Column) -> Column:
        out = F.get(words, i).eqNullSafe(F.lit(parts[0]))
        for k, part in enumerate(parts[1:], 1):
            out = out & F.get(words, i + k).eqNullSafe(F.lit(part))
        return out

    every = F.lit(True)
    for part in parts:
        every = every & F.array_contains(words, part)
    return F.when(every, F.filter(F.sequence(F.lit(0), F.size(words) - 1), stands)).otherwise(F.array().cast("array<int>"))


def template_tokens() -> list[tuple[int, str, str]]:
    """``(template, label, token)`` for the distinct words of each template."""
    cut = lambda text: dict.fromkeys(x for x in re.split(NOT_WORD, text.lower()) if x)
    return [(k, label, token) for k, (label, text) in enumerate(KNOWN) for token in cut(text)]


def run_length(template: int, percent: int) -> int:
    """Words of a block among which a template's words must stand."""
    n = len([x for x in re.split(NOT_WORD, KNOWN[template][1].lower()) if x])
    if template >= len(TEMPLATES):
        return n if n == 2 else n + 1
    return NOTICE_RUN if n <= 4 else -(-n * 100 // percent)


def needed(template: int, size: int, percent: int) -> int:
    """How many of a template's distinct words a block must hold."""
    return size if template >= len(TEMPLATES) else -(-size * percent // 100)


def blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Each paragraph's ``words``, in order, and those that any template has, ``held``: ``key``, ``block`` (its number); paragraphs that hold none are left out."""
    vocabulary = F.array(*[F.lit(x) for x in sorted({token for *_, token in template_tokens()})])
    parts = docs.select(F.col(f"`{key}`").alias(key), F.posexplode(F.split(ascii_lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))), EMPTY_LINE)).alias("block", "part"))
    rows = parts.select(key, "block", F.array_remove(F.split("part", NOT_WORD), "").alias("words"))
    return rows.select(key, "block", "words", F.array_intersect("words", vocabulary).alias("held")).where(F.size("held") > 1)


def read_once(docs: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """One row per document, from one reading of the texts: ``_row`` (its number), ``key``, ``n_words``, ``n_base`` (places of all phrases),
    ``first_word``, ``last_word``, ``base_labels`` (array), ``_held`` (its words that any template has), and ``_text``.

    The text stays where the whole document holds enough of a template's words, as only then a block of it can.
    """
    tokens: dict[int, list[str]] = {}
    for k, _, token in template_tokens():
        tokens.setdefault(k, []).append(token)
    listed = lambda words: F.array(*[F.lit(x) for x in words])
    every = F.array(*[F.struct(listed(v).alias("tokens"), F.lit(needed(k, len(v), percent)).alias("needed")) for k, v in tokens.items()])
    vocabulary = listed(sorted({x for v in tokens.values() for x in v}))
    own = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("_text"))
    w = own.withColumn("_w", word_list(F.col("_text")))
    p = w.select(
        "_row", key, "_text", F.size("_w").cast("long").alias("n_words"), F.array_intersect("_w", vocabulary).alias("_held"),
        *[phrase_places(F.col("_w"), phrase).alias(f"_p{k}") for k, (phrase, _) in enumerate(PHRASES)],
    )
    places = [F.col(f"_p{k}") for k in range(len(PHRASES))]
    found = F.concat(*places)
    labels = F.filter(F.array(*[F.when(F.size(x) > 0, F.lit(label)) for x, (_, label) in zip(places, PHRASES, strict=True)]), lambda x: x.isNotNull())
    possible = F.exists(every, lambda t: (F.size("_held") >= t["needed"]) & (F.size(F.array_intersect("_held", t["tokens"])) >= t["needed"]))
    return stored(p.select(
        "_row", key, "n_words", F.size(found).cast("long").alias("n_base"), F.array_min(found).cast("long").alias("first_word"),
        F.array_max(found).cast("long").alias("last_word"), F.array_distinct(labels).alias("base_labels"), "_held", F.when(possible, F.col("_text")).alias("_text"),
    ), "licenses")


def met_templates(rows: DataFrame, percent: int) -> DataFrame:
    """Every block that meets a template, of the rows of ``read_once``: ``_row``, ``block``, ``template``, ``label``, ``n_held``, ``n_template``."""
    spark, sizes = rows.sparkSession, Counter(k for k, *_ in template_tokens())
    limits = [(k, needed(k, n, percent), run_length(k, percent)) for k, n in sizes.items()]
    sets = spark.createDataFrame(template_tokens(), "template int, label string, token string").join(F.broadcast(spark.createDataFrame(limits, "template int, needed int, run int")), "template")
    frequency = rows.select(F.explode("_held").alias("token")).groupBy("token").agg(F.count("*").alias("n"))  # as many rows as templates have words
    ordered = Window.partitionBy("template").orderBy(F.coalesce("n", F.lit(0)), "token")
    whole = Window.partitionBy("template")
    ranked = sets.join(F.broadcast(frequency), "token", "left").select(
        "template", "label", "token", "needed", "run", F.row_number().over(ordered).alias("place"), F.collect_set("token").over(whole).alias("tokens")
    )
    index = ranked.where(F.col("place") <= F.size("tokens") - F.col("needed") + 1)
    texts = rows.where("_text IS NOT NULL").select("_row", "_text")
    token = blocks(texts, "_row", "_text").select("_row", "block", "words", "held", F.explode("held").alias("token"))
    pairs = token.join(F.broadcast(index), "token").where((F.size("held") >= F.col("needed")) & (F.size(F.array_intersect("held", "tokens")) >= F.col("needed")))
    # runs begin where a word of the template stands
    starts = F.filter(F.sequence(F.lit(1), F.size("words")), lambda i: F.array_contains("tokens", F.element_at("words", i)))
    most = F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect(F.slice("words", i, F.col("run")), F.col("tokens")))))
    met = pairs.select("_row", "block", "template", "label", "needed", F.size("tokens").cast("long").alias("n_template"), most.cast("long").alias("n_held")).where(F.col("n_held") >= F.col("needed"))
    return met.groupBy("_row", "block", "template").agg(F.first("label").alias("label"), F.first("n_held").alias("n_held"), F.first("n_template").alias("n_template"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = CONTAINMENT) -> DataFrame:
    """Every block that meets a template: ``key``, ``block`` (the paragraph's number), ``label``, ``template``, ``n_held``, ``n_template``."""
    rows = read_once(docs, key, text, percent)
    return met_templates(rows, percent).join(rows.select("_row", key), "_row").drop("_row")


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = CONTAINMENT) -> DataFrame:
    """One row per document: counts and places of the phrases, labels of phrases and templates, and a score.

    The score is 1 where a phrase stands, else the largest share of a template's words that one block holds among
    templates met, else 0.
    """
    rows = read_once(docs, key, text, percent)
    met = met_templates(rows, percent).groupBy("_row").agg(F.collect_set("label").alias("met"), F.max(F.col("n_held") / F.col("n_template")).alias("share"))
    by = rows.drop("_held", "_text").join(met, "_row", "left")
    every = F.array_sort(F.array_distinct(F.concat("base_labels", F.coalesce("met", F.array().cast("array<string>")))))
    return by.select(
        key, "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base_labels"), ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
