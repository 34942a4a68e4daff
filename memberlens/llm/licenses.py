"""License scans by diagonal voting, in DataFrame functions only.

Every run of three words of a text is joined to the places where it stands in license templates. The
difference of the two places is a diagonal; hits on one diagonal vote for the template standing there.
Diagonals next to each other (a word more or less) are merged, and a merged span counts when enough of the
template's places were voted for by words that are truly equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: words in a run
GRAM = 3
#: diagonals that differ by no more than this are merged
SLACK = 3
#: share of a template's runs that must be found
COVERAGE = 0.7

# fixed values: phrases whose words, standing consecutively, name a license
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# fixed values: parts of published license texts and notices, as words
TEMPLATES = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files the software to deal in the software without restriction including "
        "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
        "copies of the software",
        "released under the mit license",
    ),
    "apache-2": (
        "licensed under the apache license version 2 0",
        "unless required by applicable law or agreed to in writing software distributed under the license is "
        "distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided "
        "that the following conditions are met",
    ),
    "gpl-3": (
        "licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu "
        "general public license as published by the free software foundation either version 3 of the license "
        "or at your option any later version",
    ),
    "mpl-2": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl "
        "was not distributed with this file you can obtain one at",
    ),
    "cc-by-nc": (
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
        "licensed under cc by nc 4 0",
    ),
    "cc-by": ("this work is licensed under a creative commons attribution 4 0 international license",),
}


def words(text: Column) -> Column:
    """Words of ASCII letters and digits and other letters, A-Z lower-cased.

    ``lower`` also lower-cases other letters, which no template has; the two of them that would become
    ASCII letters are kept by a slower way.
    """
    filled = F.coalesce(text, F.lit(""))
    odd = F.contains(filled, F.lit("\u212a")) | F.contains(filled, F.lit("\u0130"))
    ascii_only = F.translate(filled, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    lowered = F.when(odd, ascii_only).otherwise(F.lower(filled))
    return F.array_remove(F.split(lowered, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def template_table(spark) -> DataFrame:
    """(template, label, base, runs, place, w1, w2, w3, gram): a row for each run of each template."""
    rows = []
    listed = [(text, label, True) for text, label in PHRASES.items()]
    listed += [(text, label, False) for label, texts in TEMPLATES.items() for text in texts]
    for number, (text, label, base) in enumerate(listed):
        parts = text.split()
        runs = len(parts) - GRAM + 1
        rows += [(number, label, base, runs, k, *parts[k : k + GRAM]) for k in range(runs)]
    table = spark.createDataFrame(
        rows, "template int, label string, base boolean, runs int, place int, w1 string, w2 string, w3 string"
    )
    return table.withColumn("gram", F.xxhash64("w1", "w2", "w3"))


def diagonals(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, text_key, template, label, base, runs, diagonal, votes, places): hits by diagonal."""
    spark = docs.sparkSession
    grams = (
        docs.select(
            F.col(id_column).alias("doc_id"), F.xxhash64(F.col(text_column)).alias("text_key"),
            words(F.col(text_column)).alias("words"),
        )
        .where(F.size("words") >= GRAM)
        .select("doc_id", "text_key", F.posexplode(F.arrays_zip(
            F.col("words").alias("a"),
            F.expr("slice(words, 2, size(words))").alias("b"),
            F.expr("slice(words, 3, size(words))").alias("c"),
        )).alias("at", "g"))
        .select("doc_id", "text_key", "at", F.col("g.a").alias("a"), F.col("g.b").alias("b"), F.col("g.c").alias("c"))
        .withColumn("gram", F.xxhash64("a", "b", "c"))
    )
    # the templates are the fixed lists above; equal hashes are verified by the words themselves
    hits = grams.join(F.broadcast(template_table(spark)), "gram").where("a = w1 and b = w2 and c = w3")
    return hits.groupBy(
        "doc_id", "text_key", "template", "label", "base", "runs", (F.col("at") - F.col("place")).alias("diagonal")
    ).agg(F.count_distinct("place").alias("votes"), F.collect_set("place").alias("places"))


def spans(diags: DataFrame) -> DataFrame:
    """(doc_id, text_key, label, base, start, coverage): verified spans, base phrases among them.

    A base phrase stands where all its runs meet on one diagonal. For other templates neighbouring
    diagonals are merged and the places they found together are counted.
    """
    base = diags.where("base and votes = runs").select(
        "doc_id", "text_key", "label", "base", F.col("diagonal").alias("start"), F.lit(1.0).alias("coverage")
    )
    key = ["doc_id", "text_key", "template"]
    beside = W.partitionBy(*key).orderBy("diagonal")
    fresh = F.when(F.col("diagonal") - F.lag("diagonal").over(beside) <= SLACK, 0).otherwise(1)
    merged = (
        diags.where("not base")
        .withColumn("_fresh", fresh)
        .withColumn("_group", F.sum("_fresh").over(beside))
        .groupBy(*key, "label", "base", "runs", "_group")
        .agg(F.min("diagonal").alias("start"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    )
    verified = merged.withColumn("coverage", F.size("places") / F.col("runs")).where(F.col("coverage") >= COVERAGE)
    return base.unionByName(
        verified.select("doc_id", "text_key", "label", "base", F.greatest("start", F.lit(0)).alias("start"), "coverage")
    )


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``n_base`` counts the places of base phrases, ``first_word`` and ``last_word`` are the first and last
    of them (null without one); labels are distinct, sorted and joined by commas; ``score`` is the best
    coverage of any span, 0 without one. Missing texts count as empty. Rows with equal id and text get
    equal results, one for each row; a missing id is an id like others. Extra columns are ignored.
    """
    found = spans(diagonals(docs, id_column, text_column))
    at = F.when(F.col("base"), F.col("start"))
    label = F.when(F.col("base"), F.col("label"))
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    told = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text")).agg(
        F.count(at).alias("n_base"), F.min(at).cast("long").alias("first_word"), F.max(at).cast("long").alias("last_word"),
        joined(label).alias("base_labels"), joined("label").alias("labels"), F.max("coverage").alias("score"),
    )
    rows = docs.select(
        F.col(id_column).alias("doc_id"), F.xxhash64(F.col(text_column)).alias("text_key"),
        F.size(words(F.col(text_column))).cast("long").alias("n_words"),
    )
    return rows.join(told, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_text")), "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
