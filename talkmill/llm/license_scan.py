"""License scans: an exact set-similarity join of blocks of text with license templates, beside exact phrases.

A template is found in a block if the block holds at least THRESHOLD of the template's distinct words. All tokens are
ordered by how often they occur in the corpus, rarest first, so a pair of block and template that meets the threshold
shares a token of both prefixes: the template's first size - need + 1 tokens and the block's first size - (smallest need) + 1.
Only such pairs are joined; blocks with fewer tokens than the template needs (length filter) and pairs whose rest
after the shared token is too short (positional filter) go before the sets are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.llm.common import ASCII_LOWER, ASCII_UPPER, ascii_lower, small, table

#: Share of a template's distinct words that a block holds at least, in percent.
THRESHOLD = 80
#: Words of a block, and from one block's start to the next's; a run of BLOCK - STRIDE + 1 words lies whole in a block.
BLOCK, STRIDE = 64, 32
#: Distinct tokens of all templates together, at most: they are broadcast, with the prefixes.
MOST_TOKENS = 50_000
#: What parts words: anything in ASCII but letters and digits.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Exact phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Openings of the notices of public licenses. Each is long enough that the words of another license's notice don't reach THRESHOLD.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("creative-commons", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]


def words_of(text):
    """The words of a text, in order: runs of ASCII letters, digits and anything beyond ASCII, A-Z lower-cased."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAPS), "")


def template_table(spark: SparkSession, templates: Iterable[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(template, label, tokens): one row for each of ``templates`` (label, text), its distinct words."""
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "template int, label string, text string")
    return rows.select("template", "label", F.array_distinct(words_of(F.col("text"))).alias("tokens"))


def global_order(docs: DataFrame, templates: DataFrame, text: str) -> list[str]:
    """The templates' tokens, rarest in all of ``docs`` first. Tokens of no template can't be shared, so they need no place.

    The driver gets one row for each token of a template, MOST_TOKENS at most.
    """
    known = templates.select(F.explode("tokens").alias("token")).distinct()
    if not small(known, MOST_TOKENS):
        raise ValueError(f"templates have more than {MOST_TOKENS} distinct tokens: scan for some of them at a time")
    met = docs.select(F.explode(words_of(F.col(text))).alias("token")).join(F.broadcast(known), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    return [r.token for r in known.join(met, "token", "left").orderBy(F.coalesce("n", F.lit(0)), "token").select("token").collect()]


def prefixes(templates: DataFrame, order: list[str], percent: int) -> DataFrame:
    """(token, position, label, tokens, need) for the prefix tokens of each template, its tokens rarest first."""
    ranked = templates.select("label", F.array_intersect(F.lit(order or [""]), "tokens").alias("tokens"))
    needed = ranked.withColumn("need", F.expr(f"cast((size(tokens) * {percent} + 99) div 100 as int)"))
    first = needed.select("*", F.posexplode(F.expr("slice(tokens, 1, size(tokens) - need + 1)")).alias("position", "token"))
    return first.select("token", "position", "label", "tokens", "need")


def phrase_starts(words: str, phrases: dict[str, str]):
    """(start, label) of each place, in ``words``, where a phrase's words follow one another."""
    found = []
    for phrase, label in phrases.items():
        parts = phrase.split(" ")
        same = " and ".join(f"{words}[i + {k}] = '{w}'" for k, w in enumerate(parts))
        places = f"filter(sequence(0, size({words}) - {len(parts)}), i -> {same})"
        found.append(f"if(size({words}) >= {len(parts)} and array_contains({words}, '{parts[0]}'), transform({places}, i -> struct(i as start, '{label}' as label)), array())")
    none = "filter(array(struct(0 as start, '' as label)), x -> false)"
    return F.expr(f"concat({', '.join([none, *found])})").cast("array<struct<start:long,label:string>>")


def blocks_of(words: str, order: list[str], starts: list[str], least: int):
    """The blocks of BLOCK words that could hold a template, each as its distinct template tokens, rarest first."""
    w, known = F.col(words), F.lit(order)
    n = F.greatest(F.lit(1), F.ceil((F.size(w) - (BLOCK - STRIDE)) / STRIDE)).cast("int")
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_intersect(known, F.slice(w, i * STRIDE + 1, BLOCK)))
    worth = F.filter(each, lambda b: (F.size(b) >= least) & F.arrays_overlap(b, F.lit(starts)))
    return F.when(F.arrays_overlap(w, F.lit(starts)), worth)


def scan(docs: DataFrame, templates: DataFrame | None = None, phrases: dict[str, str] = PHRASES, percent: int = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of ``docs``.

    ``n_base`` counts all places of ``phrases``, ``first_word`` and ``last_word`` are the smallest and the largest start of one,
    null without any. ``labels`` adds the labels of the templates that a block of BLOCK words contains by ``percent``
    of their distinct words. ``score`` is 1 with a phrase, else the largest share of a template that was found, else 0.
    Templates have at most BLOCK - STRIDE + 1 distinct words and notices as long lie whole in a block; longer ones are left out.

    A null text is an empty one. Rows are documents: null keys and repeated rows are scanned as any row. Other columns are
    not read; an empty table gives an empty result. A text is one row in memory, at some tens of bytes a word.
    """
    templates = (template_table(docs.sparkSession) if templates is None else templates).filter(f"size(tokens) between 1 and {BLOCK - STRIDE + 1}")
    order = global_order(docs, templates, text)
    first = prefixes(templates, order, percent)
    starts, least = first.agg(F.collect_set("token"), F.coalesce(F.min("need"), F.lit(1))).first()
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), words_of(F.col(text)).alias("_words"))
    told = rows.select("_row", F.struct("_key", F.size("_words").cast("long").alias("n_words"), phrase_starts("_words", phrases).alias("base")).alias("_doc"), blocks_of("_words", order or [""], starts or [""], least).alias("_blocks"))
    # A document without a block worth looking at goes on as one row, as does a block without a shared token.
    cut = told.select("_row", "_doc", F.explode_outer("_blocks").alias("_block"))
    cut = cut.select("_row", "_doc", "_block", F.posexplode_outer(F.expr(f"slice(_block, 1, size(_block) - {least} + 1)")).alias("_at", "_token"))
    pair = cut.join(F.broadcast(first), F.col("_token") == F.col("token"), "left")
    long_enough = F.expr("size(_block) >= need and least(size(tokens) - position, size(_block) - _at) >= need")
    shared = F.when(long_enough, F.size(F.array_intersect("tokens", "_block")))
    found = pair.select("_row", "_doc", "label", F.when(shared >= F.col("need"), shared / F.size("tokens")).alias("_share"))
    hits = F.collect_set(F.when(F.col("_share").isNotNull(), F.col("label")))
    one = found.groupBy("_row").agg(F.first("_doc").alias("_doc"), hits.alias("_hits"), F.max("_share").alias("_best")).select("_doc.*", "_hits", "_best")
    base, places = F.array_distinct(F.transform("base", lambda b: b["label"])), F.transform("base", lambda b: b["start"])
    return one.select(
        F.col("_key").alias(key), "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        F.concat_ws(",", F.array_sort(base)).alias("base_labels"), F.concat_ws(",", F.array_sort(F.array_union(base, "_hits"))).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
    )


def _template_rows() -> str:
    return ", ".join(f"('{label}', '{text}')" for label, text in TEMPLATES)


OP12_SQL = rf"""
WITH split AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
phrases(p, label) AS (VALUES {', '.join(f"(string_split('{p}', ' '), '{label}')" for p, label in PHRASES.items())}),
places AS MATERIALIZED (SELECT k, unnest(list_filter(range(0, len(w) - len(p) + 1), lambda i: w[i + 1:i + len(p)] = p)) AS start, label FROM split JOIN phrases ON list_contains(w, p[1])),
base AS (SELECT k, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word FROM places GROUP BY k),
templates AS MATERIALIZED (SELECT label, list_distinct(regexp_extract_all(translate(t, '{ASCII_UPPER}', '{ASCII_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS tokens FROM (VALUES {_template_rows()}) AS x(label, t)),
blocks AS MATERIALIZED (SELECT DISTINCT k, list_distinct(w[1 + i * {STRIDE}:{BLOCK} + i * {STRIDE}]) AS b FROM (SELECT k, w, unnest(range(0, greatest(1, ceil((len(w) - {BLOCK - STRIDE}) / {STRIDE}))::BIGINT)) AS i FROM split)),
hits AS MATERIALIZED (SELECT k, label, len(list_intersect(b, tokens)) / len(tokens) AS share FROM blocks JOIN templates ON 100 * len(list_intersect(b, tokens)) >= {THRESHOLD} * len(tokens)),
best AS (SELECT k, max(share) AS share FROM hits GROUP BY k),
own AS (SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY k),
every AS (SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT k, label FROM hits UNION ALL SELECT k, label FROM places) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(own.labels, '') AS base_labels, coalesce(every.labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best.share, 0.0)::DOUBLE END AS score
FROM split LEFT JOIN base USING (k) LEFT JOIN own USING (k) LEFT JOIN every USING (k) LEFT JOIN best USING (k)
"""


def op12_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
