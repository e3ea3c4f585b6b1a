r"""License scans: an exact containment join of text blocks with license templates.

A block is a line, or for long lines every window of ``BLOCK`` words that starts at a multiple of
``STEP``; beside them, the same windows over all words of the text, as notices are mostly wrapped.  Any run of up to
the step lies whole in one block, whatever its line breaks, and the step is as long as the longest template.  A block
matches a template when it has at least the template's share of its distinct words.

The join is a filtered set join.  Words of templates are ordered by the number of documents that
have them, over all documents, rarest first.  A template's prefix is its first ``|T| - need + 1`` words: a block
without any of them cannot reach ``need`` words.  So blocks meet templates on prefix words only,
blocks of fewer words than ``need`` are left out before, and a shared word is a candidate only if the words
after it on both sides can still make up ``need``.  Candidates are counted exactly.

DataFrame functions only, one pass over the texts: what goes on is one short row per document, with
the blocks of those that have enough words of some template at all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.functions.text import settled
from corpusgauge.llm.common import table
from corpusgauge.session import written_once

BLOCK, STEP = 64, 32
#: Java class of the characters between words, after lower-casing A-Z.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The phrases whose places count, with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Label, share of the template's distinct words that a block must have, text in lower case.
#: Short notices differ from one another by a word, so they must be there whole.
TEMPLATES = [
    ("mit-text", 0.8, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", 0.8, "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("apache-2.0", 1.0, "licensed under the apache license version 2 0"),
    ("gpl-text", 0.8, "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-3.0", 1.0, "licensed under the gnu general public license version 3"),
    ("gpl-2.0", 1.0, "licensed under the gnu general public license version 2"),
    ("lgpl", 0.8, "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("bsd", 0.8, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", 0.8, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", 0.8, "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", 0.8, "this is free and unencumbered software released into the public domain"),
    ("cc0", 0.8, "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-nc-4.0", 1.0, "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", 1.0, "licensed under cc by sa 4 0"),
    ("cc-by-4.0", 0.8, "this work is licensed under a creative commons attribution 4 0 international license"),
    ("all-rights-reserved", 1.0, "all rights reserved"),
]


def template_sets(templates=None) -> list[tuple[str, int, list[str]]]:
    """(label, words needed, distinct words) of each template."""
    found = []
    for label, share, text in templates or TEMPLATES:
        words = sorted(set(text.split()))
        found.append((label, math.ceil(share * len(words) - 1e-9), words))
    return found


def literal(words) -> Column:
    return F.array(*map(F.lit, words))


def lowered(text: Column) -> Column:
    """A-Z in lower case; the Kelvin sign, which Java would turn into a k, becomes another letter."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("�")))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BREAKS, -1), "")


def phrase_at(w: Column, i: Column, phrase: str) -> Column:
    found = F.lit(True)
    for j, word in enumerate(phrase.split()):
        found = found & F.coalesce(F.get(w, i + j) == word, F.lit(False))
    return found


def _stands_at(places: Column, w: Column, phrase: str) -> Column:
    return F.exists(places, lambda i: phrase_at(w, i, phrase))


def step_of(templates=None) -> int:
    """Words between the starts of two windows: ``STEP``, or more where a template is longer."""
    return max(STEP, *(len(text.split()) for _, _, text in templates or TEMPLATES), 0)


def blocks_of(text: Column, all_words: Column, vocabulary: Column, step: int = STEP, least: int = 1) -> Column:
    """Blocks as (n distinct words, template words), ``least`` of these at least: windows of each line, and of the whole text across its lines."""
    block = max(BLOCK, 2 * step)

    def cut(w):
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - step - 1, F.lit(0)), F.lit(step))
        return F.transform(starts, lambda s: F.slice(w, s + 1, F.lit(block)))

    lines = F.split(text, "\n", -1)
    across = F.when(F.size(lines) > 1, cut(all_words)).otherwise(F.array().cast("array<array<string>>"))
    windows = F.concat(F.flatten(F.transform(lines, lambda line: cut(words(line)))), across)
    return F.filter(
        F.transform(
            windows,
            lambda b: F.struct(F.size(F.array_distinct(b)).alias("n"), F.array_intersect(b, vocabulary).alias("has")),
        ),
        lambda b: F.size(b["has"]) >= least,
    )


def scanned(docs: DataFrame, templates=None) -> DataFrame:
    """One short row per document: its phrases, its template words, and blocks where they may match."""
    sets = template_sets(templates)
    vocabulary = literal(sorted({w for _, _, t in sets for w in t}))
    first = settled(docs.select("doc_id", "text"), ["doc_id"], t=lowered(F.col("text")))
    second = settled(first, ["doc_id", "t"], w=words(F.col("t")))
    w = F.col("w")
    may_hold = F.col("t").contains("license") | F.col("t").contains("cc")
    places = F.filter(
        F.sequence(F.lit(0), F.size(w) - 1),
        lambda i: F.array_contains(literal(sorted({p.split()[0] for p in PHRASES})), F.get(w, i))
        & _any(phrase_at(w, i, p) for p in PHRASES),
    )
    third = settled(
        second, ["doc_id", "t", "w"],
        has=F.array_intersect(w, vocabulary),
        places=F.when(may_hold & (F.size(w) > 0), places).otherwise(F.array().cast("array<int>")),
    )
    # one number for all templates; which of them a block may meet is left to the join
    least = max(min((need for _, need, _ in sets), default=1), 1)
    labels = F.array(*[
        F.when(_stands_at(F.col("places"), w, p), F.lit(label)) for p, label in PHRASES.items()
    ])
    return third.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.size(w).cast("long").alias("n_words"),
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(labels))).alias("base"), "has",
        F.when(F.size("has") >= least, blocks_of(F.col("t"), w, vocabulary, step_of(templates), least)).alias("blocks"),
    )


def _any(conditions) -> Column:
    found = F.lit(False)
    for c in conditions:
        found = found | c
    return found


def word_order(rows: DataFrame) -> list[str]:
    """Template words by the number of documents that have them, rarest first.

    At most one row per word of the templates comes to the driver, whatever the corpus.
    """
    counts = rows.select(F.explode("has").alias("word")).groupBy("word").count().collect()
    return [r["word"] for r in sorted(counts, key=lambda r: (r["count"], r["word"]))]


def matches(rows: DataFrame, templates=None) -> DataFrame:
    """(row, label, share) of the best block of each document and template that matches.

    ``rows`` are those of :func:`scanned`, written once so that ``row`` stays.
    """
    spark, sets = rows.sparkSession, template_sets(templates)
    order = word_order(rows)
    # a word that no document has stands first: it belongs to the prefix but joins nothing
    ranks = {w: i for i, w in enumerate(order)}
    entries, details = [], []
    for no, (label, need, t) in enumerate(sets):
        ordered = sorted(t, key=lambda w: ranks.get(w, -1))
        details.append((no, label, need, ordered))
        entries += [(w, no, need, len(t) - 1 - j) for j, w in enumerate(ordered[: len(t) - need + 1])]
    # bounded by the templates, not by the corpus
    prefixes = spark.createDataFrame(entries, "word string, template int, need int, after int")
    templates_table = spark.createDataFrame(details, "template int, label string, need int, words array<string>")
    blocks = settled(
        rows.where("blocks is not null").select("row", F.posexplode("blocks").alias("block", "b")), ["row", "block"],
        n=F.col("b.n"),
        has=F.array_intersect(literal(order).cast("array<string>"), F.col("b.has")),  # in the global order
    )
    entries = blocks.select("row", "block", "n", "has", F.posexplode("has").alias("at", "word"))
    enough = (F.col("n") >= F.col("need")) & (
        F.least(F.size("has") - 1 - F.col("at"), F.col("after")) + 1 >= F.col("need")
    )
    candidates = (
        entries.join(F.broadcast(prefixes), "word").where(enough)
        .select("row", "block", "template", "has").dropDuplicates(["row", "block", "template"])
    )
    shared = F.size(F.array_intersect("has", "words"))
    return (
        candidates.join(F.broadcast(templates_table), "template")
        .withColumn("shared", shared).where("shared >= need")
        .groupBy("row", "label").agg(F.max(F.col("shared") / F.size("words")).alias("share"))
    )


def licensed(docs: DataFrame, templates=None) -> DataFrame:
    """One row per document: phrases by place, labels of phrases and templates, and the best share.

    Null and empty texts have no words, no labels and score 0; a phrase scores 1.  Repeated rows are
    scanned each for itself; other columns are not read.
    """
    rows = written_once(scanned(docs, templates))
    found = matches(rows, templates).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    more = F.coalesce("more", F.array().cast("array<string>"))
    return rows.drop("has", "blocks").join(found, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", more)), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op6_licenses(spark, sf_dir: str) -> DataFrame:
    """All documents against all phrases and templates."""
    return licensed(table(spark, sf_dir, "documents"))


def licenses_sql(docs: str = "documents", text: str = "text") -> str:
    """DuckDB text of the same scan over a relation with doc_id and text; joins everything with everything."""
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    step = step_of()
    templates = ", ".join(f"('{label}', {need}, {quoted(t)})" for label, need, t in template_sets())
    phrases = ", ".join(f"({quoted(p.split())}, '{label}')" for p, label in PHRASES.items())
    return rf"""
    WITH texts AS (
      SELECT row_number() OVER () AS rid, doc_id, translate(coalesce({text}, ''), '{upper}', '{lower}') AS t FROM {docs}
    ), split AS (
      SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
    ), phrases(p, label) AS (VALUES {phrases}),
    templates(label, need, words) AS (VALUES {templates}),
    starts AS (SELECT rid, w, unnest(range(len(w))) AS i FROM split),
    places AS (
      SELECT rid, i, label FROM starts JOIN phrases ON w[i + 1] = p[1] AND w[i + 1 : i + len(p)] = p
    ), base AS (
      SELECT rid, count(DISTINCT i) AS n_base, min(i) AS first_word, max(i) AS last_word,
        array_agg(DISTINCT label) AS labels FROM places GROUP BY rid
    ), lines AS (
      SELECT rid, regexp_extract_all(unnest(string_split(t, chr(10))), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM split
    ), runs AS (
      SELECT rid, w FROM lines UNION ALL SELECT rid, w FROM split
    ), windows AS (
      SELECT rid, w, unnest(range(0, greatest(len(w) - {step}, 1), {step})) AS s FROM runs
    ), blocks AS (
      SELECT DISTINCT rid, list_distinct(w[s + 1 : s + {max(BLOCK, 2 * step)}]) AS b FROM windows
    ), shares AS (
      SELECT rid, label, len(list_intersect(words, b)) / len(words) AS share
      FROM blocks JOIN templates ON len(list_intersect(words, b)) >= need
    ), more AS (
      SELECT rid, array_agg(DISTINCT label) AS labels, max(share) AS share FROM shares GROUP BY rid
    )
    SELECT doc_id, cast(len(w) AS bigint) AS n_words, cast(coalesce(n_base, 0) AS bigint) AS n_base,
      cast(first_word AS bigint) AS first_word, cast(last_word AS bigint) AS last_word,
      array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
      array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
      CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS score
    FROM split LEFT JOIN base USING (rid) LEFT JOIN more USING (rid)
    """
