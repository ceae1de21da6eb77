"""License notices by diagonal voting over word k-grams. Native throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry.llm.common import ascii_lower
from codequarry.session import durable

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 3
# Diagonals that differ by so many words or less belong to one span.
NEAR = 4
# Share of a template's words that a span must cover.
COVERED = 0.8

# Phrases that decide a license wherever they stand word for word.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
# Notices that may be changed a little, as the licenses print them.
NOTICES = (
    ("mit", "released under the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files the software to deal in the software without restriction",
    ),
    ("apache-2", "licensed under the apache license version 2 0"),
    (
        "apache-2",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    ),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the "
        "gnu general public license as published by the free software foundation",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted "
        "provided that the following conditions are met",
    ),
    (
        "mit",
        "the above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the software",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "apache-2",
        "unless required by applicable law or agreed to in writing software distributed under the license is "
        "distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ),
    (
        "gpl",
        "this program is distributed in the hope that it will be useful but without any warranty without even the "
        "implied warranty of merchantability or fitness for a particular purpose",
    ),
    (
        "bsd",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
        "following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish "
        "use compile sell or distribute this software either in source code form or as a compiled binary",
    ),
    (
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
    ),
    ("proprietary", "all rights reserved"),
)


# Phrases first, then notices, as (exact, label, words).
TEMPLATES = [(True, label, text.split(" ")) for label, text in PHRASES]
TEMPLATES += [(False, label, text.split(" ")) for label, text in NOTICES]


def templates(spark: SparkSession) -> DataFrame:
    """(template, label, exact, length, tpos, gram words t0..t2): constants of this module."""
    rows = []
    for number, (exact, label, words) in enumerate(TEMPLATES):
        for at in range(len(words) - GRAM + 1):
            rows.append((number, label, exact, len(words), at, *words[at : at + GRAM]))
    schema = "template int, label string, exact boolean, length int, tpos int, t0 string, t1 string, t2 string"
    return spark.createDataFrame(rows, schema).withColumn("h", F.xxhash64("t0", "t1", "t2"))


def _words(text: str) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def hits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, key, n_words, hits): every row, with its word k-grams that a template may hold.

    The one pass over the texts: words are taken once, all rolling k-grams
    are hashed in the row, and those whose hash some template has are kept
    with their words and place. What is left is written once.
    """
    wanted = [r.h for r in templates(docs.sparkSession).select("h").distinct().collect()]  # constants
    words = docs.select(F.col(key).alias("key"), F.coalesce(_words(text), F.array().cast("array<string>")).alias("w"))
    places = F.when(F.size("w") >= GRAM, F.sequence(F.lit(0), F.size("w") - GRAM))
    gram = lambda i: [F.get("w", i + j) for j in range(GRAM)]
    found = F.filter(places, lambda i: F.xxhash64(*gram(i)).isin(wanted))
    kept = F.transform(found, lambda i: F.struct(i.alias("pos"), *(w.alias(f"w{j}") for j, w in enumerate(gram(i)))))
    rows = words.select("key", F.size("w").cast("long").alias("n_words"), kept.alias("hits"))
    return durable(rows.withColumn("row", F.monotonically_increasing_id()))


def spans(rows: DataFrame) -> DataFrame:
    """(row, template, label, exact, first_word, last_word, coverage) of every notice in ``hits``' rows.

    Each word k-gram votes for the diagonal, its position less the template's,
    of every template that holds it. For a phrase a diagonal with all its
    grams is a place. Diagonals of a notice that are neighbours are one span,
    so words may be added or left out; they are no neighbours if they lie as
    far apart as copies side by side would. A span stands if its grams cover
    enough of the template.
    """
    grams = rows.select("row", F.explode("hits").alias("g")).select("row", "g.*")
    known = templates(rows.sparkSession)
    found = grams.withColumn("h", F.xxhash64(*(f"w{i}" for i in range(GRAM)))).join(F.broadcast(known), "h")  # constants
    found = found.where(" and ".join(f"w{i} = t{i}" for i in range(GRAM)))
    names = ["row", "template", "label", "exact", "length"]
    diagonals = found.groupBy(*names, (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.collect_set("tpos").alias("at"),  # as many as a template has grams
        F.min("pos").alias("low"),
        (F.max("pos") + GRAM - 1).alias("high"),
    )
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(order)
    reach = F.when(F.col("exact"), F.lit(0)).otherwise(F.least(F.lit(NEAR), F.col("length") - 1))
    parted = diagonals.withColumn("cut", F.coalesce((gap > reach).cast("int"), F.lit(0)))
    merged = (
        parted.withColumn("span", F.sum("cut").over(order))
        .groupBy(*names, "span")
        .agg(
            F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"),
            F.min("low").alias("low"),
            F.max("high").alias("high"),
        )
    )
    covered = F.size(
        F.array_distinct(F.flatten(F.transform("at", lambda t: F.sequence(t, t + GRAM - 1))))
    )
    enough = F.when(F.col("exact"), F.lit(1.0)).otherwise(F.lit(COVERED))
    return (
        merged.withColumn("coverage", covered / F.col("length"))
        .where(F.col("coverage") >= enough)
        .select(
            *names[:4], F.col("low").cast("long").alias("first_word"), F.col("high").cast("long").alias("last_word"),
            "coverage",
        )
    )


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    ``n_base`` counts the places of the phrases of PHRASES, ``first_word`` and
    ``last_word`` are the least and greatest of their starts (NULL without
    any). ``labels`` adds those of the notices; ``score`` is the best coverage
    of any of them, 0 without. NULL and empty texts have no words; repeated
    rows get a row each.
    """
    rows = hits(docs, key, text)
    base = F.col("exact")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    each = spans(rows.where(F.size("hits") > 0)).groupBy("row").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined("label").alias("labels"),
        F.max("coverage").alias("score"),
    )
    return rows.join(each, "row", "left").select(
        F.col("key").alias(key),
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
