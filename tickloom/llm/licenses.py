"""License scan: exact set-similarity join of text blocks with notice templates, in built-in functions.

Blocks are runs of ``BLOCK`` words, one every ``STEP`` words.  A block matches a
template if it holds at least ``CONTAINMENT`` of the template's distinct words.
The words of a template are ordered by how many documents of the corpus hold
them, rarest first.  A block with enough of them must hold one of the first
|T| - need + 1 (prefix filter), must hold ``need`` template words at all (length
filter), and from the first word it shares on, both sides must have enough words
left (positional filter); what passes is counted exactly.  Templates are a short
list inside the expressions, so blocks and templates meet without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import ALNUM_WORD, lower_ascii, texts

BLOCK, STEP = 64, 32
CONTAINMENT = 0.8

# Phrases asked for, with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Opening words of public license notices, at most STEP + 1 words each.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike license"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
)


def spaced(text: Column) -> Column:
    """Lower-cased words with one blank between them and at both ends; empty if there are none."""
    words = F.trim(F.regexp_replace(lower_ascii(text), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " "))
    return F.when(words == "", F.lit("")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def blanks(c: Column) -> Column:
    return (F.length(c) - F.length(F.translate(c, " ", ""))).cast("long")


def frequencies(docs: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """In how many documents each word of a short vocabulary occurs; one row per word reaches the driver."""
    words = F.split(F.trim(spaced(F.col("text"))), " ")
    held = texts(docs).select(F.explode(F.array_intersect(words, _strings(vocabulary))).alias("word"))
    return {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}


def _strings(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def scan(
    docs: DataFrame, base: Mapping[str, str] = BASE, templates: Sequence[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT,
    block: int = BLOCK, step: int = STEP,
) -> DataFrame:
    """One row per document with the places of base phrases and the labels found.

    Null and empty text, and text without words, give no places, labels '' and
    score 0.  Phrases stand in consecutive words; every place counts, also of
    phrases that overlap.  ``labels`` adds those of matching templates;
    ``score`` is the largest share of a matching template's words in one block,
    1 where a base phrase stands.  Rows that repeat each get their row, a null
    doc_id stays null, an empty table gives an empty result; columns other than
    doc_id and text are not read.
    """
    sets = [(label, sorted(set(text.split()))) for label, text in templates]
    counts = frequencies(docs, sorted({w for _, t in sets for w in t}))
    ordered = [(label, sorted(t, key=lambda w: (counts.get(w, 0), w))) for label, t in sets]
    need = [math.ceil(containment * len(t) - 1e-9) for _, t in ordered]
    prefixes = sorted({w for (_, t), n in zip(ordered, need) for w in t[: len(t) - n + 1]})
    vocabulary = _strings(sorted({w for _, t in ordered for w in t}))

    df = texts(docs).select("doc_id", spaced(F.col("text")).alias("spaced"))
    df = df.withColumn("n_words", F.when(F.col("spaced") == "", F.lit(0)).otherwise(blanks(F.col("spaced")) - 1).cast("long"))
    df = _base(df, base)
    df = df.withColumn("words", F.split(F.trim("spaced"), " "))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(step))
    blocks = F.transform(starts, lambda i: F.array_intersect(F.slice(F.col("words"), i + 1, block), vocabulary))
    blocks = F.filter(blocks, lambda b: (F.size(b) >= min(need)) & F.arrays_overlap(b, _strings(prefixes)))
    df = df.withColumn("blocks", F.when(F.arrays_overlap("words", _strings(prefixes)), blocks).otherwise(F.array().cast("array<array<string>>")))
    best = [F.array_max(F.transform(F.col("blocks"), _shares(t, n))) for (_, t), n in zip(ordered, need)]
    df = df.withColumns({f"share_{i}": F.coalesce(c, F.lit(0.0)) for i, c in enumerate(best)})
    own = F.filter(F.array(*[F.when(F.col(f"share_{i}") > 0, F.lit(label)) for i, (label, _) in enumerate(ordered)]), lambda x: x.isNotNull())
    return df.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(own, F.col("base"))), ",").alias("labels"),
        F.greatest(F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.lit(0.0)), *[F.col(f"share_{i}") for i in range(len(ordered))]).alias("score"),
    )


def _shares(template: Sequence[str], need: int) -> Callable[[Column], Column]:
    return lambda held: _share(held, template, need)


def _share(held: Column, template: Sequence[str], need: int) -> Column:
    """Share of the template's words in a block's template words; 0 if below the threshold."""
    size = len(template)
    shared = F.array_intersect(_strings(template), held)
    first = F.array_position(_strings(template), F.get(shared, F.lit(0)))
    prefix = F.arrays_overlap(held, _strings(template[: size - need + 1]))
    room = F.least(size - first + 1, F.size(held)) >= need
    return F.when((F.size(held) >= need) & prefix & room & (F.size(shared) >= need), F.size(shared) / size).otherwise(F.lit(0.0))


def _base(df: DataFrame, base: Mapping[str, str]) -> DataFrame:
    text, counts, first, last, labels = F.col("spaced"), [], [], [], []
    for phrase, label in base.items():
        held = F.contains(text, F.lit(f" {phrase} "))
        after = F.substring_index(text, f" {phrase} ", -1)
        counts.append(F.when(held, F.regexp_count(text, F.lit(f" {phrase}(?= )"))).otherwise(F.lit(0)))
        first.append(F.when(held, blanks(F.substring_index(text, f" {phrase} ", 1))))
        last.append(F.when(held, F.col("n_words") - blanks(after) - len(phrase.split())))
        labels.append(F.when(held, F.lit(label)))
    return df.withColumns({
        "n_base": sum(counts).cast("long"), "first_word": F.array_min(F.array(*first)).cast("long"),
        "last_word": F.array_max(F.array(*last)).cast("long"),
        "base": F.array_distinct(F.filter(F.array(*labels), lambda x: x.isNotNull())),
    })


def scan_sql(
    base: Mapping[str, str] = BASE, templates: Sequence[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT, block: int = BLOCK, step: int = STEP,
) -> str:
    """The scan as DuckDB SQL by counting every block against every template."""
    lists = [(label, sorted(set(t.split()))) for label, t in templates]
    quoted = [f"[{', '.join(repr(w) for w in t)}]" for _, t in lists]
    need = [math.ceil(containment * len(t) - 1e-9) for _, t in lists]
    phrases = [(p, label, len(p.split())) for p, label in base.items()]
    found = [f"list_filter(range(0, n_words), lambda i: w[i + 1:i + {n}] = [{', '.join(repr(x) for x in p.split())}]) AS p{k}" for k, (p, _, n) in enumerate(phrases)]
    shares = [
        f"coalesce(list_max(list_transform(b, lambda x: len(list_intersect(x, {q})))), 0) AS s{i}" for i, q in enumerate(quoted)
    ]
    base_labels = "[" + ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label, _) in enumerate(phrases)) + "]"
    own_labels = "[" + ", ".join(f"CASE WHEN s{i} >= {n} THEN '{label}' END" for i, ((label, _), n) in enumerate(zip(lists, need))) + "]"
    score = ", ".join(f"CASE WHEN s{i} >= {n} THEN s{i} / {len(t)}.0 ELSE 0.0 END" for i, ((_, t), n) in enumerate(zip(lists, need)))
    every = " || ".join(f"p{k}" for k in range(len(phrases)))
    joined = "coalesce(array_to_string(list_sort(list_distinct(list_filter({}, lambda x: x IS NOT NULL))), ','), '')"
    return f"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ALNUM_WORD}') AS w FROM documents),
u AS (SELECT doc_id, w, len(w) AS n_words, list_transform(range(0, len(w), {step}), lambda i: w[i + 1:i + {block}]) AS b FROM t),
v AS (SELECT doc_id, n_words, {', '.join(found)}, {', '.join(shares)} FROM u)
SELECT doc_id, n_words, CAST(len({every}) AS BIGINT) AS n_base, list_min({every}) AS first_word, list_max({every}) AS last_word,
  {joined.format(base_labels)} AS base_labels, {joined.format(f'{base_labels} || {own_labels}')} AS labels,
  CAST(greatest(CASE WHEN len({every}) > 0 THEN 1.0 ELSE 0.0 END, {score}) AS DOUBLE) AS score
FROM v"""
