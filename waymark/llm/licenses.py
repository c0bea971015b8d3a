"""License notices by exact set-similarity join with templates, in DataFrame functions only.

A text block is a run of words, whatever lines it stands on: as many as the template has, on
both sides of a word. A template is found in it if the block holds at least ``containment`` of
the template's distinct words. Words are ordered by how many documents hold them, rarest first.
A block that reaches the threshold of a template must hold one of the template's first words
(prefix filter), so blocks are taken around those alone; it must hold enough of the templates'
words at all (length filter), and before and after the shared word both must have enough words
(positional filter). What remains is counted exactly.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.tables import picked

CONTAINMENT = 0.8
#: Templates of a table, held by every task.
MAX_TEMPLATES = 5_000

# Phrases with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices by label, as words.
TEMPLATES = {
    "apache": ["licensed under the apache license version 2 0"],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided"
        " that the following conditions are met"
    ],
    "cc-by": ["this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4 0"],
    "cc0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights"],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general"
        " public license as published by the free software foundation",
    ],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the software to deal in the software without restriction",
    ],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    """Words of letters, digits and all characters beyond ASCII, A-Z in lower case."""
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), _GAP), lambda w: w != "")


def _among(words: Column, those: list[str]) -> Column:
    return F.array_intersect(words, F.array(*map(F.lit, those)))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _based(docs: DataFrame) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word and base_found (labels) to each row."""
    plain = F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" "))
    docs = docs.withColumn("_plain", F.when(F.array_contains("_words", "license"), plain))
    places, firsts, lasts, found = [], [], [], []
    for phrase, label in PHRASES.items():
        spaced = f" {phrase} "
        n = F.coalesce(F.regexp_count("_plain", F.lit(f" {phrase}(?= )")), F.lit(0))
        first = F.expr(f"instr(_plain, '{spaced}')")
        back = F.expr(f"instr(reverse(_plain), '{spaced[::-1]}')")
        last = F.length("_plain") - back - len(spaced) + 2
        some = F.col("_plain").contains(spaced)
        places.append(n)
        firsts.append(F.when(some, _spaces(F.substring("_plain", F.lit(1), first)) - 1))
        lasts.append(F.when(some, _spaces(F.substring("_plain", F.lit(1), last)) - 1))
        found.append(F.when(some, label))
    return docs.select(
        "*",
        F.size("_words").cast("bigint").alias("n_words"),
        reduce(lambda a, b: a + b, places).cast("bigint").alias("n_base"),
        F.least(*firsts).cast("bigint").alias("first_word"),
        F.greatest(*lasts).cast("bigint").alias("last_word"),
        F.array_compact(F.array(*found)).alias("base_found"),
    )


def _frequency_order(docs: DataFrame, words: list[str]) -> list[str]:
    """The templates' words, those in the fewest documents first."""
    held = docs.select(F.explode(_among(F.col("_words"), words)).alias("word"))
    counts = {row["word"]: row["n"] for row in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(words, key=lambda w: (counts.get(w, 0), w))


def _named(templates: dict[str, list[str]] | DataFrame) -> list[tuple[str, list[str], int]]:
    """Label, distinct words and number of words of every template, as texts are cut into words."""
    if isinstance(templates, DataFrame):
        words = F.array_distinct(_words(F.coalesce(F.col("text"), F.lit(""))))
        rows = templates.select("label", F.array_sort(words).alias("words"), F.size(_words(F.col("text"))).alias("n"))
        found = rows.filter("label is not null and n > 0").limit(MAX_TEMPLATES + 1).collect()
        if len(found) > MAX_TEMPLATES:
            raise ValueError(f"more than {MAX_TEMPLATES} templates")
        return [(row["label"], row["words"], row["n"]) for row in found]
    return [(label, sorted(set(text.split())), len(text.split())) for label, texts in templates.items() for text in texts]


def matches(
    docs: DataFrame, containment: float = CONTAINMENT, templates: dict[str, list[str]] | DataFrame = TEMPLATES
) -> DataFrame:
    """Blocks with templates: _id, _key, at, template, label, containment.

    ``docs`` has _id, _key and _words; ``at`` is the number of the word a block is taken around.
    """
    spark = docs.sparkSession
    named = _named(templates)
    order = _frequency_order(docs, sorted({w for _, words, _ in named for w in words}))
    place = {w: i for i, w in enumerate(order)}
    prefixes, whole = [], []
    for number, (label, words, reach) in enumerate(named):
        words = sorted(words, key=place.__getitem__)
        least = math.ceil(containment * len(words) - 1e-9)
        whole.append((number, label, words, least))
        prefixes += [(w, number, i, len(words), least, reach) for i, w in enumerate(words[: len(words) - least + 1])]
    first_words = F.array(*map(F.lit, sorted({p[0] for p in prefixes}))).cast("array<string>")
    widest = max((p[5] for p in prefixes), default=0)
    index = spark.createDataFrame(prefixes, "word string, template int, i int, size int, least int, reach int")
    known = spark.createDataFrame(whole, "template int, label string, words array<string>, need int")
    some = docs.filter(F.arrays_overlap("_words", first_words))
    # words around every place of a first word; only those leave the text
    numbered = F.transform("_words", lambda w, i: F.struct(i.alias("at"), w.alias("word")))
    places = F.filter(numbered, lambda p: F.array_contains(first_words, p["word"]))
    around = some.select("_id", "_key", "_words", F.explode(places).alias("p")).select(
        "_id", "_key", "p.at", "p.word",
        F.expr(f"slice(_words, greatest(p.at + 1 - {widest}, 1), p.at + 1 + {widest} - greatest(p.at + 1 - {widest}, 1) + 1)").alias("near"),
        F.expr(f"least(p.at, {widest})").alias("middle"),
    )
    # both small tables have a checked size: the templates' words
    met = around.join(F.broadcast(index), "word")
    block = F.expr("slice(near, greatest(middle + 1 - reach, 1), middle + 1 + reach - greatest(middle + 1 - reach, 1) + 1)")
    # words of the block that any template has, in frequency order
    held = F.array_intersect(F.array(*map(F.lit, order)).cast("array<string>"), block)
    met = met.withColumn("held", held).filter(F.size("held") >= F.col("least"))
    met = met.withColumn("j", F.expr("cast(array_position(held, word) as int) - 1"))
    bound = F.expr("least(i, j) + 1 + least(size - i - 1, size(held) - j - 1)")
    pairs = met.filter(bound >= F.col("least")).select("_id", "_key", "at", "template", "held")
    met = pairs.join(F.broadcast(known), "template")
    common = F.size(F.array_intersect("words", "held"))
    met = met.filter(common >= F.col("need"))
    return met.select("_id", "_key", "at", "template", "label", (common / F.size("words")).alias("containment"))


def licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    containment: float = CONTAINMENT,
    templates: dict[str, list[str]] | DataFrame = TEMPLATES,
) -> DataFrame:
    """License labels of every text.

    Result: doc_id, n_words, n_base (places where a phrase stands), first_word, last_word (of
    those places, words from 0), base_labels, labels (of phrases and templates; both distinct,
    sorted, joined by commas), score (largest containment found, 1 where a phrase stands, else
    0). Null and empty texts have no words and no labels. Equal rows get equal results; extra
    columns are left out. ``templates`` are notices by label, as words in lower case, or a table
    (label, text) of at most ``MAX_TEMPLATES`` rows; rows without label or words are ignored.
    """
    docs = picked(docs, id_col, text_col).withColumn("_key", F.xxhash64("_id", "_text"))
    docs = docs.withColumn("_words", _words(F.coalesce("_text", F.lit(""))))
    based = _based(docs).select("_id", "_key", "n_words", "n_base", "first_word", "last_word", "base_found")
    found = matches(docs, containment, templates).groupBy("_id", "_key").agg(
        F.collect_set("label").alias("found"), F.max("containment").alias("most")
    )
    found = found.select(F.col("_id").alias("of"), F.col("_key").alias("of_key"), "found", "most")
    same = F.col("_key").eqNullSafe(F.col("of_key")) & F.col("_id").eqNullSafe(F.col("of"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    every = F.concat("base_found", F.coalesce("found", F.array().cast("array<string>")))
    score = F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce("most", F.lit(0.0)))
    return based.join(found, same, "left").select(
        F.col("_id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word",
        joined(F.col("base_found")).alias("base_labels"), joined(every).alias("labels"), score.alias("score"),
    )
