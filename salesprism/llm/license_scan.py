"""License scan: an exact set-similarity join of text blocks with license templates, in SQL functions only.

Blocks are the runs of words of a text, as long as the template's words
divided by ``CONTAINMENT``, across line ends, so a wrapped notice is found and
words scattered over a long text are not. A block's set is its distinct words.
A template is found where a block holds at least ``CONTAINMENT`` of the
template's distinct words. It is enough to look at blocks that start at one of
these words. The filters:

* text: a text that holds fewer than ``need`` of a template's words anywhere
  has no block of it;
* position: a block that starts at the k-th place of a template word must
  reach the (k + need - 1)-th such place;
* prefix: words are ordered by their frequency in all documents, rarest
  first. A block that holds ``need`` of a template's n words must hold one of
  its n - need + 1 rarest, so blocks without one are passed over.

Of overlapping blocks that hold a template the fullest counts, then the first.

The templates are a fixed specification, so they are literals of the plan;
the frequencies come from one aggregate over all documents, reduced to the
templates' words before its shuffle.

Base findings are fixed phrases at consecutive words. Null and empty texts
have no words. Repeated rows are scanned each for itself, ids may be null, and
other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CONTAINMENT = 80  # hundredths of a template's words
BLOCKS = "array<struct<common:int,start:bigint,end:bigint>>"

# The base phrases and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
# Opening sentences of public license texts.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0 the license you may not use this file except in "
                  "compliance with the license you may obtain a copy of the license at",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided "
           "that the following conditions are met",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu "
                  "general public license as published by the free software foundation",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is "
           "hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
           "documentation files the software to deal in the software without restriction",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl "
               "was not distributed with this file you can obtain one at",
    "unlicense": "this is free and unencumbered software released into the public domain",
}


def folded(text: Column) -> Column:
    """A-Z in lower case; null is empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)


def words(low: Column) -> Column:
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def places(tokens: Column, phrase: str) -> Column:
    """Word positions at which the phrase starts; overlapping places count each."""
    parts = phrase.split()
    starts = F.sequence(F.lit(0), F.size(tokens) - len(parts))

    def starts_here(i: Column) -> Column:
        return reduce(lambda a, b: a & b, [F.get(tokens, i + k) == F.lit(p) for k, p in enumerate(parts)])

    none = F.array().cast("array<int>")
    enough = (F.size(tokens) >= len(parts)) & reduce(
        lambda a, b: a & b, [F.array_contains(tokens, p) for p in parts])
    return F.when(enough, F.filter(starts, starts_here)).otherwise(none)


def rarest_first(docs: DataFrame, text_col: str, templates: dict[str, str]) -> dict[str, list[str]]:
    """Each template's distinct words, rarest in the documents first. At most one row per template word is collected."""
    vocabulary = sorted({w for t in templates.values() for w in t.split()})
    known = F.array(*map(F.lit, vocabulary))
    held = docs.select(F.explode(F.array_intersect(words(folded(F.col(text_col))), known)).alias("word"))
    seen = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {name: sorted(set(t.split()), key=lambda w: (seen.get(w, 0), w)) for name, t in templates.items()}


def run_length(template: str) -> int:
    """Words of a block for this template."""
    return ceil(100 * len(template.split()) / CONTAINMENT)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def blocks_of(tokens: Column, held: Column, rarest: list[str], run: int) -> Column:
    """Blocks (common, start, end; array) that hold a template, given as its distinct words, rarest first.

    ``held`` are the distinct template words of the text; ``start`` is the
    block's first template word and ``end`` is past its last.
    """
    need = ceil(CONTAINMENT * len(rarest) / 100)
    every = F.array(*map(F.lit, rarest))
    prefix = F.array(*map(F.lit, rarest[:len(rarest) - need + 1]))
    spots = F.filter(
        F.transform(tokens, lambda w, i: F.when(F.array_contains(every, w), i)), lambda i: i.isNotNull())

    def block(k: Column, at: Column) -> Column:
        start = F.get(at, k)
        words_in = F.slice(tokens, start + 1, run)
        last = F.array_max(F.filter(F.slice(at, k + 1, run), lambda j: j < start + run))
        common = F.when(F.arrays_overlap(words_in, prefix), F.size(F.array_intersect(words_in, every))).otherwise(0)
        return F.struct(common.alias("common"), start.cast("long").alias("start"), (last + 1).cast("long").alias("end"))

    def found(at: Column) -> Column:
        firsts = F.filter(
            F.transform(at, lambda i, k: F.when(F.get(at, k + (need - 1)) - i < run, k)), lambda k: k.isNotNull())
        return F.filter(F.transform(firsts, lambda k: block(k, at)), lambda b: b["common"] >= need)

    none = F.array().cast(BLOCKS)

    def fullest(kept: Column, b: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        apart = last.isNull() | (b["start"] >= last["end"])
        return F.when(apart, F.concat(kept, F.array(b))).when(
            b["common"] > last["common"], F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(b))).otherwise(kept)

    possible = F.size(F.array_intersect(held, every)) >= need
    return F.when(possible, F.aggregate(_let(spots, found).cast(BLOCKS), none, fullest)).otherwise(none)


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES,
) -> DataFrame:
    """Per row: doc_id, n_words, places (label, start word; array), templates (label, share, start, end; array)."""
    ordered = rarest_first(docs, text_col, templates)
    known = F.array(*map(F.lit, sorted({w for ts in ordered.values() for w in ts})))
    read = docs.select(F.col(id_col).alias("doc_id"), words(folded(F.col(text_col))).alias("_words"))
    tokens = F.col("_words")
    read = read.select("doc_id", "_words", F.array_intersect(tokens, known).alias("_held"))

    def spots_of(phrase: str, label: str) -> Column:
        return F.transform(
            places(tokens, phrase), lambda i: F.struct(F.lit(label).alias("label"), i.cast("long").alias("start")))

    spots = [spots_of(phrase, label) for phrase, label in PHRASES.items()]

    def hits_of(name: str, rarest: list[str]) -> Column:
        found = blocks_of(tokens, F.col("_held"), rarest, run_length(templates[name]))
        return F.transform(found, lambda b: F.struct(
            F.lit(name).alias("label"), (b["common"] / F.lit(float(len(rarest)))).alias("share"), b["start"], b["end"]))

    hits = F.concat(*(hits_of(name, rarest) for name, rarest in ordered.items()))
    return read.select(
        "doc_id", F.size(tokens).cast("long").alias("n_words"), F.concat(*spots).alias("places"), hits.alias("templates"))


def report(found: DataFrame) -> DataFrame:
    """Counts, first and last place, labels, a score (1 for a phrase, else the largest containment, else 0), blocks.

    Blocks are spelled label:start-end, in words, the end not included.
    """
    base = F.transform("places", lambda p: p["label"])
    starts = F.transform("places", lambda p: p["start"])
    more = F.transform("templates", lambda t: t["label"])
    share = F.coalesce(F.array_max(F.transform("templates", lambda t: t["share"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, more))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(share).alias("score"),
        F.array_join(F.transform("templates", lambda t: F.concat(
            t["label"], F.lit(":"), t["start"].cast("string"), F.lit("-"), t["end"].cast("string"))), ",").alias("blocks"))
