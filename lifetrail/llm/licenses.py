"""License scans: fixed phrases, and an exact set-similarity join of word windows with license templates.

A window is a run of consecutive words of a text, over line breaks and
punctuation, ``1 / threshold`` times as long as the template is (so a
notice may be wrapped, or interrupted by some words, and words scattered
over a long line do not count).  A text meets a template when one of its
windows holds at least ``threshold`` of the template's distinct words.
The join covers all windows and is exact:

* words are ordered by how often the corpus has them, rarest first
  (words in no template cannot overlap and are not looked at);
* prefix filter: an overlap of ``need`` words must show among a
  template's first ``size - need + 1`` words, so only windows around
  places of these words are formed;
* length filter: the words around such a place, which all its windows are
  cut from, must hold at least ``need`` different words (a window is at most
  ``width`` words long, so there is no upper length to test);
* positional filter: around the place of a window's rarest word, the
  template's words from that one on must still reach ``need``.

Pairs that pass are verified by their intersection.  The templates are a
parameter of the call, at most ``MOST_TEMPLATE_WORDS`` words in all
(checked), so their side of the join is broadcast, and the word
frequencies that the driver gathers have one row per template word.

Defined cases: a null text counts as empty; a null ``doc_id`` is kept;
repeated rows give equal results; other columns are ignored; an empty
table gives no rows.  Only DataFrame functions are used.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words (of lower-case text); far cheaper to split at than ``WORD`` is to match.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases and their labels (fixed values).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: License notices by label.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc", "Licensed under the Creative Commons Attribution 4.0 International License"),
)
THRESHOLD = 0.8
MOST_TEMPLATE_WORDS = 10_000


def template_sequence(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def template_words(text: str) -> list[str]:
    return sorted(set(template_sequence(text)))


def window_width(text: str, threshold: float = THRESHOLD) -> int:
    """Words of a window for a template of this text."""
    return math.ceil(len(template_sequence(text)) / threshold - 1e-9)


def lower_text():
    return F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)


def text_words():
    """The words of the lower-case text ``t``, in order."""
    return F.array_remove(F.split("t", GAP, -1), "")


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, the lower-case text and a hash of it; together they name equal rows alike."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), lower_text().alias("t")).withColumn("h", F.xxhash64("t"))


def _place_of(parts: list[str], label: str):
    """For ``transform`` over the words ``w``: (word number, label) where ``parts`` start, else null."""
    def at(x, i):
        hit = x == parts[0]
        for k, w in enumerate(parts[1:], 1):
            hit = hit & F.coalesce(F.get(F.col("w"), i + k) == w, F.lit(False))
        return F.when(hit, F.struct(i.cast("long").alias("word"), F.lit(label).alias("label")))
    return at


def phrase_places(docs: DataFrame, phrases: Mapping[str, str] = PHRASES) -> DataFrame:
    """``doc_id, h, n_words`` and ``places``: (word number, label) wherever a phrase's words stand consecutively."""
    split = {p: p.split(" ") for p in phrases}
    may = F.lit(False)
    for parts in split.values():
        here = F.lit(True)
        for w in parts:
            here = here & F.col("t").contains(w)
        may = may | here
    d = keyed(docs).withColumn("n_words", F.size(text_words()).cast("long"))
    d = d.withColumn("w", F.when(may, text_words()).otherwise(F.array().cast("array<string>")))
    found = [F.filter(F.transform("w", _place_of(split[p], label)), lambda x: x.isNotNull()) for p, label in phrases.items()]
    return d.withColumn("places", F.concat(*found)).select("doc_id", "h", "n_words", "places")


def matching_windows(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, h, place, template, label, containment``: the best window
    that holds the template's word at ``place``, wherever one meets the template."""
    spark = docs.sparkSession
    sets = [(k, label, words, window_width(text, threshold)) for k, (label, text) in enumerate(templates) if (words := template_words(text))]
    vocabulary = sorted({w for _, _, words, _ in sets for w in words})
    if len(vocabulary) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"templates of more than {MOST_TEMPLATE_WORDS} distinct words")
    schema = "doc_id long, h long, place int, template int, label string, containment double"
    if not vocabulary:
        return spark.createDataFrame([], schema)
    held = keyed(docs).select(F.explode(F.filter(text_words(), lambda x: x.isin(*vocabulary))).alias("word"))
    frequency = {r["word"]: r["count"] for r in held.groupBy("word").count().collect()}  # at most one row per template word
    rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
    index = []
    for k, label, own, width in sets:
        own = sorted(own, key=rank.__getitem__)
        need = max(1, math.ceil(threshold * len(own) - 1e-9))
        index += [(w, k, label, own, own[at:], need, width) for at, w in enumerate(own[:len(own) - need + 1])]
    prefix = spark.createDataFrame(index, "word string, template int, label string, t_words array<string>, t_rest array<string>, need int, width int")
    rare, widest = sorted({w for w, *_ in index}), max(width for *_, width in sets)
    first = lambda i, width: F.greatest(i - width + 1, F.lit(0))
    d = keyed(docs).select("doc_id", "h", text_words().alias("w"))
    at = F.filter(F.transform("w", lambda x, i: F.when(x.isin(*rare), i)), lambda i: i.isNotNull())
    near = F.transform(at, lambda i: F.struct(i.alias("place"), F.get("w", i).alias("word"), F.slice("w", first(i, widest) + 1, i - first(i, widest) + widest).alias("near")))
    d = d.select("doc_id", "h", F.explode(near).alias("p")).select("doc_id", "h", "p.*")
    pairs = d.join(F.broadcast(prefix), "word").withColumn("first", first(F.col("place"), F.col("width")))
    # the words that windows around the place can hold, and those windows
    around = F.slice("near", F.col("first") - first(F.col("place"), widest) + 1, F.col("place") - F.col("first") + F.col("width"))
    pairs = pairs.withColumn("around", around).drop("near")
    pairs = pairs.where((F.size("around") >= F.col("need")) & (F.size(F.array_distinct("around")) >= F.col("need")))
    pairs = pairs.where(F.size(F.array_intersect("t_rest", "around")) >= F.col("need"))
    overlaps = F.transform(F.sequence(F.lit(0), F.col("place") - F.col("first")), lambda s: F.size(F.array_intersect("t_words", F.slice("around", s + 1, F.col("width")))))
    met = pairs.withColumn("overlap", F.array_max(overlaps)).where(F.col("overlap") >= F.col("need"))
    return met.select("doc_id", "h", "place", "template", "label", (F.col("overlap") / F.size("t_words")).alias("containment")).distinct()


def scan(docs: DataFrame, templates=TEMPLATES, threshold=THRESHOLD, phrases=PHRASES) -> DataFrame:
    """Per document: words, phrase places, their labels, all labels and the best score."""
    labels = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    met = matching_windows(docs, templates, threshold).groupBy(F.col("doc_id").alias("m_id"), F.col("h").alias("m_h")).agg(
        F.collect_set("label").alias("met"), F.max("containment").alias("best"))
    d = phrase_places(docs, phrases).join(met, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("h") == F.col("m_h")), "left")
    base = F.transform("places", lambda p: p["label"])
    at = F.transform("places", lambda p: p["word"])
    none = F.array().cast("array<string>")
    return d.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.concat(base, F.coalesce("met", none))).alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.size("places") > 0, 1.0).otherwise(0.0)).alias("score"))
