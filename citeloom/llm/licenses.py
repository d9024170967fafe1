"""License scans by diagonal voting: rolling word k-grams of documents joined with their places in license templates.

A template is a phrase or a notice of known wording. Its word k-grams (k = ``WIDTH`` words, fewer for shorter templates)
form a table (hash, template, place). Every rolling k-gram of every document meets that table in an equi-join on the
hash, and the words themselves confirm the match. A match of document place p with template place t is one vote for the
diagonal p - t: a copy of a template puts all its votes on one diagonal, an inserted or a left-out word moves the rest
to a neighbouring one. Votes are counted per (document, template, diagonal) before the shuffle; neighbouring diagonals,
at most ``SLACK`` apart, are merged into spans; a span is verified by the share of the template that its votes cover and by
its length. Exact templates (phrases) take no neighbours and need every vote, so each diagonal is a place of the phrase.

Only SQL functions are used. Documents are opened into places inside the task that read them, and rows without a match end
there; the shuffle carries one row per document and diagonal. The template table is broadcast if it was measured to
fit ``broadcast_bytes``; a larger one takes a shuffled join.

Edge cases: a null or empty text, or one without words, has no words, no labels and score 0. Very long texts are opened
whole; a document is one row when it is read, its votes are rows that spill. Repeated rows and equal ids are scanned one
by one, a null id too. Ties cannot arise: smallest and largest places and sorted labels are reported. Without templates, or
with templates without words or label, documents have no labels. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.llm.common import lower_ascii, text_or_empty

WIDTH = 4
SLACK = 4
LEAST_SHARE = 0.6
LONGEST = 2.0  # of a span, in lengths of its template
CELLS = 63
BROADCAST_BYTES = 16 * 1024 * 1024
ROW_BYTES = 120  # of a k-gram besides its texts
TEMPLATE = ("template", "label", "exact", "n_grams", "t_words", "cells", "width")
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Phrases that name a license.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
# Wording of well-known public license notices.
NOTICES = (
    ("gpl-3.0", "licensed under the gnu general public license, version 3"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
     " License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "released under the mit license"),
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
     " documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("apache-2.0", "licensed under the apache license, version 2.0"),
    ("apache-notice", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
     " following conditions are met"),
    ("isc-notice", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-4.0", "licensed under cc by 4.0"),
    ("cc-by-sa-4.0", "licensed under cc by-sa 4.0"),
    ("cc-by-nc-4.0", "licensed under cc by-nc 4.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)


def words_of(text: Column) -> Column:
    """Words in the case in which they stand; hashes ignore case, confirmed k-grams are lower-cased."""
    return F.array_remove(F.split(text, BETWEEN), "")


def template_table(
    spark: SparkSession, phrases: Iterable[tuple[str, str]] = PHRASES, notices: Iterable[tuple[str, str]] = NOTICES,
) -> DataFrame:
    """(label, text, exact): phrases are exact."""
    rows = [(label, text, True) for label, text in phrases] + [(label, text, False) for label, text in notices]
    return spark.createDataFrame(rows, "label string, text string, exact boolean")


def _gram(words: Column, start: Column, width: Column) -> Column:
    return lower_ascii(F.array_join(F.slice(words, start, width), " "))


def template_grams(templates: DataFrame) -> DataFrame:
    """One row per k-gram place of a template; templates of one wording and label are one."""
    given = templates.where(F.col("label").isNotNull()).select("label", "exact", words_of(lower_ascii(text_or_empty())).alias("words"))
    given = given.where(F.size("words") > 0).groupBy("label", "words").agg(F.max(F.coalesce("exact", F.lit(False))).alias("exact"))
    given = given.withColumn("width", F.least(F.lit(WIDTH), F.size("words")))
    given = given.withColumn("n_grams", F.size("words") - F.col("width") + 1)
    placed = given.withColumn("t_place", F.explode(F.sequence(F.lit(0), F.col("n_grams") - 1)))
    cells = F.least(F.col("n_grams"), F.lit(CELLS))
    return placed.select(
        F.xxhash64("label", F.array_join("words", " ")).alias("template"), "label", "exact", "width", "n_grams",
        F.size("words").alias("t_words"), cells.alias("cells"), "t_place",
        F.floor(F.col("t_place") * cells / F.col("n_grams")).cast("int").alias("cell"),
        _gram(F.col("words"), F.col("t_place") + 1, F.col("width")).alias("t_gram"),
    )


def _hash_of(gram: Column, width: Column) -> Column:
    """The hash of a k-gram: of the hashes of its words."""
    parts = F.split(gram, " ")
    return F.xxhash64(width, *[F.when(F.lit(i) < width, F.xxhash64(F.lower(F.get(parts, F.lit(i))))) for i in range(WIDTH)])


def _rolling(marks: Column, width: int) -> Column:
    """Hashes of the k-grams that start at each word; a null, as beyond the last word, leaves a hash as it is."""
    return F.transform(marks, lambda first, i: F.xxhash64(F.lit(width), first, *[F.get(marks, i + j) for j in range(1, width)]))


def votes(documents: DataFrame, grams: DataFrame, id_col: str, text: str, broadcast_bytes: int) -> DataFrame:
    """Every confirmed match of a document place with a template place, and one row without template per document."""
    size = grams.agg(F.sum(F.octet_length("t_gram") + F.octet_length("label") + ROW_BYTES)).first()[0] or 0
    widths = sorted(r["width"] for r in grams.select("width").distinct().collect()) or [WIDTH]  # at most WIDTH numbers
    table = grams.select(_hash_of(F.col("t_gram"), F.col("width")).alias("t_hash"), *grams.columns)
    itself = [F.lit(0 if f.name == "t_hash" else None).cast(f.dataType).alias(f.name) for f in table.schema]
    table = table.unionByName(documents.sparkSession.range(1).select(*itself))

    read = documents.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words_of(text_or_empty(text)).alias("words"),
    )
    marked = read.select("*", F.size("words").alias("n_words"), F.transform("words", lambda w: F.xxhash64(F.lower(w))).alias("marks"))
    hashes = F.concat(F.array(F.lit(0).cast("long")), *[_rolling(F.col("marks"), k) for k in widths])
    opened = marked.select("row", "id", "words", "n_words", hashes.alias("hashes"))
    # The outer form, for an array that is never empty: no filter on its size is inferred, which would build it again.
    opened = opened.select("row", "id", "words", "n_words", F.posexplode_outer("hashes").alias("at", "hash"))
    # Place 0 stands for the document itself; then come all places of the first width, of the second, and so on.
    n = F.greatest("n_words", F.lit(1))
    place = F.pmod(F.col("at") - 1, n)
    if size <= broadcast_bytes:  # words are joined to k-grams only where hashes are equal
        met = opened.join(F.broadcast(table), F.col("hash") == F.col("t_hash"))
        gram = _gram(F.col("words"), place + 1, F.col("width"))
    else:  # rows that move carry their k-gram, not the document
        width_at = F.get(F.array(*map(F.lit, widths)), F.expr("int((at - 1) div greatest(n_words, 1))"))
        alone = opened.withColumn("gram", _gram(F.col("words"), place + 1, width_at)).drop("words")
        met = alone.join(table, F.col("hash") == F.col("t_hash"))
        gram = F.col("gram")
    matched = met.withColumn("place", place).where(
        F.when(F.col("at") == 0, F.col("template").isNull()).otherwise(gram == F.col("t_gram"))
    )
    return matched.select(
        "row", "id", "n_words", *TEMPLATE, "cell", (F.col("place") - F.col("t_place")).alias("diagonal"),
        F.when(F.col("at") > 0, F.col("place")).alias("place"),
    )


def spans(matches: DataFrame, slack: int = SLACK) -> DataFrame:
    """Merged diagonals: (row, template, ...) with votes, the covered share, first and last place and the lowest diagonal."""
    document = ["row", "id", "n_words"]
    mask = F.bit_or(F.expr("shiftleft(1L, cell)"))
    diagonals = matches.groupBy(*document, *TEMPLATE, "diagonal").agg(
        F.count("place").alias("votes"), mask.alias("mask"), F.min("place").alias("first"), F.max("place").alias("last"),
    )
    in_order = W.partitionBy("row", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(in_order)
    starts = F.coalesce(gap > F.when(F.col("exact"), F.lit(0)).otherwise(F.lit(slack)), F.lit(False)).cast("int")
    merged = diagonals.withColumn("starts", starts).withColumn("span", F.sum("starts").over(in_order))
    return merged.groupBy(*document, *TEMPLATE, "span").agg(
        F.sum("votes").alias("votes"), F.bit_or("mask").alias("mask"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.min("diagonal").alias("diagonal"),
    ).withColumn("share", F.bit_count("mask") / F.col("cells"))


def scan(
    documents: DataFrame, templates: DataFrame, id_col: str = "doc_id", text: str = "text", least_share: float = LEAST_SHARE,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(id, n_words, n_exact, first_word, last_word, exact_labels, labels, spans, score) of every document.

    ``spans``: label, first and last word of every verified span. ``score``: the largest share of a template that one span
    covers.
    """
    found = spans(votes(documents, template_grams(templates), id_col, text, broadcast_bytes))
    whole = F.col("exact") & (F.col("votes") == F.col("n_grams"))
    length = F.col("last") - F.col("first") + F.col("width")
    near = ~F.col("exact") & (F.col("share") >= least_share) & (length <= LONGEST * F.col("t_words"))
    ended = F.struct("label", F.col("first").cast("long").alias("first_word"), (F.col("last") + F.col("width") - 1).cast("long").alias("last_word"))
    share = F.when(F.col("exact"), F.when(whole, 1.0).otherwise(0.0)).otherwise(
        F.when(length <= LONGEST * F.col("t_words"), F.col("share")).otherwise(0.0)
    )
    joined = lambda labels: F.array_join(F.array_sort(labels), ",")
    return found.groupBy("row", "id", "n_words").agg(
        F.count(F.when(whole, 1)).alias("n_exact"),
        F.min(F.when(whole, F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(whole, F.col("diagonal"))).cast("long").alias("last_word"),
        joined(F.collect_set(F.when(whole, F.col("label")))).alias("exact_labels"),
        joined(F.collect_set(F.when(whole | near, F.col("label")))).alias("labels"),
        F.array_sort(F.collect_list(F.when(whole | near, ended))).alias("spans"),
        F.coalesce(F.max(share), F.lit(0.0)).alias("score"),
    ).select(
        F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), "n_exact", "first_word", "last_word",
        "exact_labels", "labels", "spans", "score",
    )
