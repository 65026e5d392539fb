"""License scans by diagonal voting.

Every rolling gram of ``GRAM`` words is joined by hash with the gram positions of license templates.
A hit votes for the diagonal (position in the text less position in the template); votes are
counted by row, template and diagonal, neighbouring diagonals are merged, which bridges
inserted and missing words, and a merged span is verified by the words it covers: each hit's words
must equal the template's, and they must cover ``COVER`` of the template within a span not much
longer than it. Verified spans give the template's label; fixed phrases give base labels.

Words are runs of letters, digits and other characters outside ASCII, with A-Z lowered. A text is cut
into words once; the same pass keeps the base columns and those grams whose hash some template has,
in a narrow table with a number for each row. Null texts count as empty and an empty table gives an
empty result. Every row is scanned for itself: rows that repeat a doc_id or have none are reported
once each, with their own labels. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rangeloom.llm.common import written

GRAM, SLACK, COVER, STRETCH = 3, 4, 0.7, 1.5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# License notices, by label.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "unlicense": "This is free and unencumbered software released into the public domain",
}
# End of fixed values.


def lowered(text: Column) -> Column:
    """A-Z lowered; of the two others whose small form is an ASCII letter the form is kept out."""
    plain = F.replace(F.replace(text, F.lit("\u212a"), F.lit("\u00b7")), F.lit("\u0130"), F.lit("\u00b7"))
    return F.lower(plain)


def words(text: Column) -> Column:
    return F.regexp_extract_all(lowered(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))


def gram(array: str, i: Column, n: int = GRAM) -> list[Column]:
    return [F.get(array, i + j) for j in range(n)]


def starts(array: str, n: int) -> Column:
    """The positions at which n words of an array start."""
    return F.when(F.size(array) >= n, F.sequence(F.lit(0), F.size(array) - n)).otherwise(F.array().cast("array<int>"))


def template_grams(spark: SparkSession, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """``template, t_len, t_at, t_gram, h``: as many rows as the templates have words, at most."""
    rows = spark.createDataFrame(list(templates.items()), "template string, notice string").select("template", words(F.col("notice")).alias("w"))
    placed = F.transform(starts("w", GRAM), lambda i: F.struct(i.alias("t_at"), F.concat_ws(" ", *gram("w", i)).alias("t_gram"), F.xxhash64(*gram("w", i)).alias("h")))
    return rows.select("template", F.size("w").alias("t_len"), F.explode(placed).alias("g")).select("template", "t_len", "g.*")


def places(array: str, phrase: list[str]) -> Column:
    """Start positions of a phrase in an array of words."""
    def start(i: Column) -> Column:
        same = F.get(array, i) == phrase[0]
        for j, word in enumerate(phrase[1:], 1):
            same &= F.get(array, i + j) == word
        return same

    rare = max(phrase, key=len)
    found = F.filter(F.sequence(F.lit(0), F.size(array) - len(phrase)), start)
    return F.when((F.size(array) >= len(phrase)) & F.array_contains(array, rare), found).otherwise(F.array().cast("array<int>"))


def passed(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """One row per document: ``row, doc_id, n_words``, base columns, and ``hits`` (position, gram) that some template may have.

    The hashes that are looked for are as many as the templates have grams; the join with their
    positions follows on what is left.
    """
    wanted = [r["h"] for r in grams.select("h").distinct().collect()]
    cut = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("w"))
    named = [(label, f"p{i}", phrase.split()) for i, (phrase, label) in enumerate(PHRASES.items())]
    found = F.filter(starts("w", GRAM), lambda i: F.xxhash64(*gram("w", i)).isin(wanted))
    hits = F.transform(found, lambda i: F.struct(i.alias("at"), F.concat_ws(" ", *gram("w", i)).alias("gram")))
    placed = cut.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), hits.alias("hits"), *(places("w", p).alias(c) for _, c, p in named))
    every = F.concat(*(c for _, c, _ in named))
    return placed.select(
        "row", "doc_id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.array_sort(F.array_compact(F.array(*(F.when(F.size(c) > 0, F.lit(label)) for label, c, _ in named)))).alias("base"), "hits")


def spans(found: DataFrame, grams: DataFrame) -> DataFrame:
    """Merged spans of the rows of passed(): ``row, template, first, last, votes, coverage, verified``.

    The template side of the join is bounded by the templates' words, whatever the corpus holds.
    """
    rolled = found.select("row", F.explode("hits").alias("g")).select("row", "g.at", "g.gram").withColumn("h", F.xxhash64(*(F.split_part("gram", F.lit(" "), F.lit(j)) for j in range(1, GRAM + 1))))
    hits = rolled.join(F.broadcast(grams), "h").where("gram = t_gram").select("row", "template", "t_len", "at", "t_at")
    votes = (hits.groupBy("row", "template", "t_len", (F.col("at") - F.col("t_at")).alias("diagonal"))
             .agg(F.count(F.lit(1)).alias("votes"), F.min("at").alias("first"), (F.max("at") + GRAM - 1).alias("last"), F.collect_set("t_at").alias("t_ats")))
    ordered = Window.partitionBy("row", "template").orderBy("diagonal")
    island = F.sum(F.when(F.col("diagonal") - F.lag("diagonal").over(ordered) <= SLACK, 0).otherwise(1)).over(ordered)
    merged = (votes.withColumn("island", island).groupBy("row", "template", "t_len", "island")
              .agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"), F.flatten(F.collect_list("t_ats")).alias("t_ats")))
    covered = F.size(F.array_distinct(F.flatten(F.transform("t_ats", lambda t: F.sequence(t, t + GRAM - 1)))))
    scored = merged.withColumn("coverage", covered / F.col("t_len"))
    verified = (F.col("coverage") >= COVER) & (F.col("last") - F.col("first") + 1 <= F.col("t_len") * STRETCH)
    return scored.select("row", "template", "first", "last", "votes", "coverage", verified.alias("verified"))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Base and method results of every document.

    ``score`` is 1 with a base phrase, else the best coverage of a template by a span of at least
    two votes, else 0.
    """
    grams = template_grams(docs.sparkSession, templates)
    found = written(passed(docs, grams), "license-rows")
    method = (spans(found, grams).groupBy("row")
              .agg(F.collect_set(F.when(F.col("verified"), F.col("template"))).alias("method"), F.max(F.when(F.col("votes") > 1, F.col("coverage"))).alias("best")))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("method", F.array().cast("array<string>")))))
    return found.drop("hits").join(method, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
