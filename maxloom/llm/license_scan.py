"""License scans: phrase places, and an exact set-similarity join of text blocks with license templates.

Words are runs of ASCII letters and digits and non-ASCII characters, lower case. Base: places where a phrase's words stand
consecutively. Method: a template's text blocks are all stretches of SLACK times as many words as it has, from every word of
the text on, whatever lines, sentences or comment marks lie between; a block matches when it holds at least CONTAINMENT of the
template's distinct words. Template words are ordered by how many documents hold them, rarest first. With need = ceil(c |T|),
a block's rarest hit must be one of the first |T| - need + 1 (prefix filter), the words around that hit must hold as many distinct
words as needed (length filter), and template words from that place of the order on must suffice (positional filter). What
is left is verified exactly, block by block around the hit.

DataFrame functions only. The broadcast tables hold the templates' words, a constant. A text of any length is looked at only around
its hits. Null and empty texts have no words and no labels. Rows are matched back by id and text hash, so null ids and
repeated ids keep results of their own; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a block for each word of the template: room for words put in between.
SLACK = 1.25
CONTAINMENT = 0.9

# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices by label.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache org"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("public-domain", "This is free and unencumbered software released into the public domain"),
]


def tokens(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def _needed(size: int) -> int:
    return math.ceil(CONTAINMENT * size - 1e-9)


def block_words(text: str) -> int:
    """Words of a template's blocks."""
    return math.ceil(SLACK * len(tokens(text)))


def _words(text):
    text = F.coalesce(text, F.lit(""))
    # A to Z alone: lower() would turn some characters beyond ASCII into ASCII ones.
    text = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(text, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _lits(values: list[str]):
    return F.array(*map(F.lit, values))


def _places(words, n, phrase: str):
    parts = phrase.split()
    hit = lambda i: math_and([F.get(words, i + k) == p for k, p in enumerate(parts)])
    return F.when(math_and([F.array_contains(words, p) for p in parts]), F.filter(F.sequence(F.lit(0), n - 1), hit)).otherwise(F.array().cast("array<int>"))


def math_and(conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def frequency_order(words: DataFrame) -> dict[str, int]:
    """Rank of each template word, rarest over all documents first; at most as many counts as templates have words."""
    known = sorted({t for _, text in TEMPLATES for t in tokens(text)})
    counted = words.select(F.explode(F.array_intersect("words", _lits(known))).alias("w")).groupBy("w").count().collect()
    count = {r["w"]: r["count"] for r in counted}
    return {w: k for k, w in enumerate(sorted(known, key=lambda w: (count.get(w, 0), w)))}


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), _words(F.col(text_col)).alias("words"))
    rank = frequency_order(rows)
    known = sorted(rank, key=rank.get)
    # Templates: ranks in ascending order, so the rarest word first.
    heads = []
    for label, text in TEMPLATES:
        ranks = sorted({rank[t] for t in tokens(text)})
        need = _needed(len(ranks))
        heads += [(known[r], label, ranks, ranks[place:], need, block_words(text)) for place, r in enumerate(ranks[: len(ranks) - need + 1])]
    prefixes = spark.createDataFrame(heads, "word string, label string, ranks array<int>, later array<int>, need int, width int")
    head_words = _lits(sorted({h[0] for h in heads}))
    code = F.create_map(*[F.lit(x) for w in known for x in (w, rank[w])])
    # Every place of a prefix word with the words of all blocks that hold it, as ranks (-1: no template's word).
    some = rows.where(F.arrays_overlap("words", head_words)).select("doc_id", "h", "words")
    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.array_contains(head_words, F.get("words", i)))
    hits = some.select("doc_id", "h", "words", F.explode(places).alias("at")).withColumn("word", F.get("words", F.col("at"))).join(F.broadcast(prefixes), "word")
    first = F.greatest(F.lit(0), F.col("at") - F.col("width") + 1)
    around = F.slice("words", first + 1, F.col("at") + F.col("width") - first)
    hits = hits.select("doc_id", "h", "label", "ranks", "later", "need", "width", (F.col("at") - first).alias("at"), around.alias("around"))
    hits = hits.where(F.size(F.array_distinct("around")) >= F.col("need"))
    hits = hits.withColumn("around", F.transform("around", lambda w: F.coalesce(F.try_element_at(code, w), F.lit(-1))))
    candidates = hits.where(F.size(F.array_intersect("around", "later")) >= F.col("need"))
    # Blocks from each word on that hold the hit; a block whose rarest hit is another one is found from there, or here as well.
    sizes = F.transform(F.sequence(F.lit(0), F.col("at")), lambda i: F.size(F.array_intersect(F.slice("around", i + 1, F.col("width")), F.col("ranks"))))
    matched = candidates.withColumn("held", F.array_max(sizes)).where("held >= need")
    matched = matched.groupBy("doc_id", "h").agg(F.collect_set("label").alias("method"), F.max(F.col("held") / F.size("ranks")).alias("best"))
    # Base.
    n = F.size("words")
    base = rows.select("doc_id", "h", n.cast("long").alias("n_words"), *[_places(F.col("words"), n, p).alias(label) for p, label in PHRASES.items()])
    places = F.concat(*[F.col(f"`{label}`") for label in PHRASES.values()])
    labels = F.filter(F.array(*[F.when(F.size(F.col(f"`{label}`")) > 0, label) for label in PHRASES.values()]), lambda x: x.isNotNull())
    base = base.select("doc_id", "h", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"), F.array_sort(labels).alias("base"))
    m = matched.withColumnRenamed("doc_id", "m_id").withColumnRenamed("h", "m_h")
    joined = base.join(m, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("h") == F.col("m_h")), "left")
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("method", F.array().cast("array<string>")))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base").alias("base_labels"), F.concat_ws(",", every).alias("labels"), score.alias("score"))


def oracle() -> str:
    """The same result by brute force in DuckDB: all hits of every template's words, and every block that starts at one of them."""
    texts = ", ".join(f"({number}, '{label}', {sorted(set(tokens(text)))!r}, {block_words(text)})" for number, (label, text) in enumerate(TEMPLATES))
    phrase = lambda p: " AND ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(p.split(), 1))
    hits = " UNION ALL ".join(f"SELECT doc_id, i, '{label}' AS label FROM (SELECT doc_id, words, unnest(range(len(words))) AS i FROM w) WHERE {phrase(p)}" for p, label in PHRASES.items())
    words = lambda text: f"list_filter(regexp_split_to_array(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return rf"""
        WITH w AS (SELECT doc_id, {words("coalesce(text, '')")} AS words FROM documents),
        hits AS ({hits}),
        base AS (SELECT doc_id, count(*) AS n, min(i) AS lo, max(i) AS hi, list(DISTINCT label) AS labels FROM hits GROUP BY doc_id),
        t(t, label, words, width) AS (VALUES {texts}),
        u AS (SELECT t, label, len(words) AS n, width, unnest(words) AS word FROM t),
        p AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM w),
        h AS (SELECT doc_id, i, t, label, n, width, u.word FROM p JOIN u USING (word)),
        m AS (SELECT a.doc_id, a.label, a.n, count(DISTINCT b.word) AS o FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.t = b.t AND b.i >= a.i AND b.i < a.i + a.width GROUP BY a.doc_id, a.t, a.label, a.n, a.i),
        method AS (SELECT doc_id, list(DISTINCT label) AS labels, max(o / n) AS best FROM m WHERE o >= ceil({CONTAINMENT} * n - 1e-9) GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, coalesce(base.n, 0) AS n_base, lo AS first_word, hi AS last_word,
            coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
            coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(method.labels, [])))), ','), '') AS labels,
            CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score
        FROM w LEFT JOIN base USING (doc_id) LEFT JOIN method USING (doc_id)"""
