"""Licence notices found by an exact set-similarity join, with DataFrame functions only.

A template is the set of a notice's words. A text block is a stretch of as many words as the notice has, beginning at any word (a text that is shorter is one
block). A block belongs to a template if it holds ``containment`` of the template's words at least. Words are ordered by the number of documents that hold them,
rarest first: a block that holds alpha of a template's m words holds one of the first m - alpha + 1 of them (prefix filter). So an equi-join of the texts' words
with the prefixes, which are rare words, finds all blocks. With its rarest common word in place r a pair has at most m - r words in common (positional filter), and
what lies around the word must be at least alpha words long (length filter). The overlap of what is left is counted exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, written

#: Phrases of licence notices and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices and their labels.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]
CONTAINMENT = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(column: Column) -> Column:
    """Words of letters and digits, A-Z lower-cased; everything beyond ASCII counts as a letter."""
    text = F.translate(F.coalesce(column.cast("string"), F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(text, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def templates_of(spark, notices: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    return spark.createDataFrame(notices, "label string, notice string")


def indexed(source: DataFrame, templates: DataFrame, containment: float) -> DataFrame:
    """(word, place, template, label, m, length, alpha, tokens): the prefix of each template in the order of the words' document frequencies.

    A template without words has no prefix. Equal notices with different labels are templates of their own.
    """
    parted = templates.select(F.col("label").cast("string").alias("label"), words(F.col("notice")).alias("w")).where("size(w) > 0").distinct()
    parted = parted.select("label", F.array_join("w", " ").alias("template"), F.size("w").alias("length"), F.array_distinct("w").alias("tokens"))
    parted = written(parted.withColumn("m", F.size("tokens")).withColumn("alpha", F.expr(f"cast(greatest(1, ceil({containment!r}D * m - 1e-9D)) AS int)")), "templates")
    wanted = parted.select(F.explode("tokens").alias("word")).distinct()
    few = wanted.count() <= BROADCAST_IDS
    held = source.select(F.explode(F.array_distinct("w")).alias("word")).join(F.broadcast(wanted) if few else wanted, "word")
    often = held.groupBy("word").agg(F.count("*").alias("n"))
    placed = parted.select("*", F.explode("tokens").alias("word")).join(often, "word", "left").fillna(0, "n")
    order = Window.partitionBy("template", "label").orderBy("n", "word")
    placed = placed.withColumn("place", F.row_number().over(order) - 1).where("place <= m - alpha")
    return written(placed.select("word", "place", "template", "label", "m", "length", "alpha", "tokens"), "prefixes")


def _phrases_at(phrases: dict[str, str]) -> Column:
    """(at, label, n) of every place of ``w`` where a phrase's words stand; ``spots`` are the places of first words."""
    found = []
    for phrase, label in phrases.items():
        same = " AND ".join(f"coalesce(get(w, i + {j}), '') = '{word}'" for j, word in enumerate(phrase.split()))
        found.append(F.expr(f"transform(filter(spots, i -> {same}), i -> struct(i AS at, '{label}' AS label))"))
    return F.concat(*found)


def scan_licenses(docs: DataFrame, templates: DataFrame, phrases: dict[str, str] = PHRASES, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    ``blocks`` are all text blocks of a template: (start, n_words, label, template, containment). ``score`` is 1 where a phrase stands, else the greatest containment of a block, else
    0. Null and wordless texts have no words and no labels. Rows with null or repeated ids and repeated rows are documents of their own. Texts of any
    length are read whole. Ties do not matter: all blocks are reported. Without templates only phrases are found; no documents give no rows. Other columns are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), words(F.col(text_col)).alias("w"))
    prefixes = indexed(source, templates, containment)
    # Prefixes are a bounded part of the templates' words; as a set in the plan they let texts be passed over without a row per word.
    few = prefixes.count() <= BROADCAST_IDS // 16
    reach = prefixes.agg(F.max("length")).first()[0] or 0
    firsts = sorted({p.split()[0] for p in phrases})
    isin = lambda names: "({})".format(", ".join(f"'{n}'" for n in names)) if names else "('')"
    rare = sorted(r[0] for r in prefixes.select("word").distinct().collect()) if few else None
    spots = F.expr(f"filter(sequence(0, size(w) - 1), i -> w[i] IN {isin(firsts)})")
    anchors = F.expr(f"filter(sequence(0, size(w) - 1), i -> w[i] IN {isin(rare)})" if few else "sequence(0, size(w) - 1)")
    none = F.array().cast("array<int>")
    rows = source.withColumns({"row": F.monotonically_increasing_id(), "n_words": F.size("w").cast("long"), "spots": F.when(F.size("w") > 0, spots).otherwise(none), "anchors": F.when(F.size("w") > 0, anchors).otherwise(none)})
    rows = rows.withColumn("base", _phrases_at(phrases))
    facts = {
        "n_base": F.size("base").cast("long"), "first_word": F.array_min("base.at").cast("long"), "last_word": F.array_max("base.at").cast("long"),
        "base_list": F.array_sort(F.array_distinct("base.label")),
    }
    around = F.expr(f"transform(anchors, i -> struct(i AS at, w[i] AS word, greatest(0, i - {reach} + 1) AS from, slice(w, greatest(0, i - {reach} + 1) + 1, {2 * reach}) AS near))")
    rows = rows.withColumns(facts).select("row", "doc_id", "n_words", *facts, F.explode_outer(around).alias("a")).select("*", "a.at", "a.word", "a.from", "a.near").drop("a")
    pairs = rows.join(F.broadcast(prefixes) if few else prefixes, "word", "left")
    # Blocks that hold the word and lie in the text; a text that is shorter than the notice is one block. Places are counted from ``from``.
    low = "greatest(0, least(at - length + 1, cast(n_words AS int) - length) - from)"
    high = "greatest(0, least(at, cast(n_words AS int) - length) - from)"
    overlap = "size(array_intersect(tokens, slice(near, s + 1, length)))"
    blocks = F.expr(f"filter(transform(sequence({low}, {high}), s -> struct(cast(from + s AS bigint) AS start, least(length, cast(n_words AS int)) AS n_words, label, template, {overlap} / m AS containment)), b -> b.containment * m + 1e-9D >= alpha)")
    fits = F.expr("m IS NOT NULL AND m - place >= alpha AND n_words >= alpha")
    found = pairs.withColumn("blocks", F.when(fits, blocks))
    keys = ["row", "doc_id", "n_words", *facts]
    found = found.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("blocks")))).alias("blocks"))
    labels = F.array_sort(F.array_union("base_list", F.coalesce(F.col("blocks.label"), F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max("blocks.containment"), F.lit(0.0)))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_list", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), "blocks")
