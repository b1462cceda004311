"""Operator 8: license scans by diagonal voting.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. The hashes of all rolling
word k-grams of a text are joined with the k-gram positions of license templates. A hit votes for the diagonal
word position - template position. Diagonals of a template that lie at most DRIFT apart
are merged, which bridges inserted or missing words, and the merged span is verified: the words of each vote
are compared, not only their hashes, and the span counts if votes whose diagonals lie in one band cover at least COVERAGE of the template's k-grams.
A band is as wide as twice the drift that so many lost k-grams allow, so words strewn over a text do not add up to a license.

Templates are a table (label, text), whole license texts or single sentences of them; without one those of TEMPLATES are used. A template
of fewer than K words has no votes. Equal templates of a label count once. The templates' k-grams are broadcast while they are at most
BROADCAST_ROWS, otherwise the texts' k-grams are shuffled to them.

Base phrases are templates that need every k-gram on one diagonal, so each of their places is one diagonal. A phrase
of two words votes by 2-grams, all else by 3-grams.

score is 1 where a base phrase stands, else the largest coverage of any template that votes touched, verified or not,
to four digits. Null and empty texts have no words, no labels and score 0. Repeated rows and rows with a null doc_id
are scanned row by row, each with its own result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlake.llm.common import ascii_lower, documents, small_enough, written

K = 3
DRIFT = 3
COVERAGE = 0.7
BROADCAST_ROWS = 500_000
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Opening or defining sentences of well-known public licenses.
TEMPLATES = {
    "apache-2.0": ["licensed under the apache license version 2 0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"],
    "mit": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "gpl": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "lgpl": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "cc-by": ["this work is licensed under a creative commons attribution 4 0 international license"],
    "cc0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
}
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _SEPARATORS), "")


def _gram(array: str, at: Column, k: int) -> Column:
    return F.slice(F.col(array), at + 1, k)


def _seed(array: str, at: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *[F.col(array)[at + i] for i in range(k)])


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(label, text) for label, texts in TEMPLATES.items() for text in texts], "label string, text string")


def _templates(spark: SparkSession, templates: DataFrame) -> DataFrame:
    """(tpl, label, base, k, tpl_words, n_grams) of the base phrases and of templates(label, text)."""
    base = spark.createDataFrame([(i, label, True, p.split()) for i, (p, label) in enumerate(BASE.items())], "tpl long, label string, base boolean, tpl_words array<string>")
    own = templates.filter("label IS NOT NULL").select("label", words(F.col("text")).alias("tpl_words")).distinct()
    own = own.filter(F.size("tpl_words") >= K).select(F.xxhash64("label", "tpl_words").alias("tpl"), "label", F.lit(False).alias("base"), "tpl_words")
    both = base.unionByName(own).withColumn("k", F.least(F.size("tpl_words"), F.lit(K)))
    return written(both.withColumn("n_grams", F.size("tpl_words") - F.col("k") + 1), "license-templates")


def _grams(templates: DataFrame) -> DataFrame:
    """(seed, tpl, tpl_pos, gram) of every k-gram of the templates."""
    placed = templates.withColumn("tpl_pos", F.explode(F.sequence(F.lit(0), F.col("n_grams") - 1)))
    seed = F.when(F.col("k") == 2, _seed("tpl_words", F.col("tpl_pos"), 2)).otherwise(
        F.xxhash64(F.lit(3), *[F.get("tpl_words", F.col("tpl_pos") + i) for i in range(3)])
    )
    return placed.select(seed.alias("seed"), "tpl", "tpl_pos", F.slice("tpl_words", F.col("tpl_pos") + 1, F.col("k")).alias("gram"))


def votes(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """(row_id, doc_id, n_words, tpl, pos, tpl_pos): every vote, and for every row one line with tpl null; templates are _templates()."""
    tokens = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", words(F.col("text")).alias("words"))
    n = F.size("words")
    # position -1 stands for the row itself, so that texts without any vote keep their word count
    placed = tokens.withColumn("pos", F.explode(F.sequence(F.lit(-1), F.greatest(n - 2, F.lit(-1)))))
    pos = F.col("pos")
    twos = [p.split()[0] for p in BASE if len(p.split()) == 2]
    three = F.when((pos >= 0) & (pos <= n - 3), F.xxhash64(F.lit(3), *[F.get("words", pos + i) for i in range(3)]))
    two = F.when(pos >= 0, F.xxhash64(F.lit(2), *[F.get("words", pos + i) for i in range(2)]))
    seeds = F.when(F.get("words", pos).isin(twos), F.array(three, two)).otherwise(F.array(three))
    seeded = placed.withColumn("seed", F.explode(seeds))
    grams = written(_grams(templates), "license-grams")
    met = seeded.join(F.broadcast(grams) if small_enough(grams, BROADCAST_ROWS) else grams, "seed", "left")
    same = _gram("words", pos, F.size("gram")) == F.col("gram")
    return met.filter((pos < 0) | same).select("row_id", "doc_id", n.alias("n_words"), "tpl", "pos", "tpl_pos")


def places(found: DataFrame, templates: DataFrame) -> DataFrame:
    """(row_id, tpl, label, base, first_word, coverage) of each band of diagonals in each merged span of votes; a base phrase has one band."""
    # a step between diagonals costs K - 1 grams, and 1 - COVERAGE of them may be lost
    steps = F.floor(F.floor((1 - COVERAGE) * F.col("n_grams")) / (K - 1))
    facts = templates.select("tpl", "label", "base", "n_grams", (DRIFT * F.greatest(steps, F.lit(1))).alias("most"))
    own = found.filter("tpl IS NOT NULL").select("row_id", "tpl", (F.col("pos") - F.col("tpl_pos")).alias("diagonal"), "tpl_pos", "pos")
    own = own.join(F.broadcast(facts) if small_enough(facts, BROADCAST_ROWS) else facts, "tpl")
    by = Window.partitionBy("row_id", "tpl").orderBy("diagonal", "pos")
    step = F.col("diagonal") - F.lag("diagonal").over(by)
    new = F.when(step.isNull() | (step > F.when(F.col("base"), 0).otherwise(DRIFT)), 1).otherwise(0)
    spans = own.withColumn("new", new).withColumn("span", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    # what drifts by most at most lies whole in a band of one of two grids
    band = lambda shift: F.floor((F.col("diagonal") + shift) / (2 * F.col("most")))
    bands = F.when(F.col("base"), F.array(F.lit(0).cast("long"))).otherwise(F.array(2 * band(0), 2 * band(F.col("most")) + 1))
    merged = spans.withColumn("band", F.explode(bands)).groupBy("row_id", "tpl", "span", "band").agg(
        F.first("label").alias("label"), F.first("base").alias("base"), F.min("pos").alias("first_word"),
        (F.count_distinct("tpl_pos") / F.first("n_grams")).alias("coverage"),
    )
    return merged.drop("span", "band")


def scan(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """One row for each row of docs(doc_id, text): words, base places, labels and score; templates are (label, text)."""
    spark = docs.sparkSession
    known = _templates(spark, default_templates(spark) if templates is None else templates)
    found = written(votes(docs, known), "license-votes")
    spans = places(found, known)
    whole = F.col("base") & (F.col("coverage") == 1)
    label = F.when(whole | (~F.col("base") & (F.col("coverage") >= COVERAGE)), F.col("label"))
    judged = spans.groupBy("row_id").agg(
        F.count_if(whole).alias("n_base"),
        F.min(F.when(whole, F.col("first_word"))).alias("first_word"),
        F.max(F.when(whole, F.col("first_word"))).alias("last_word"),
        F.collect_set(F.when(whole, F.col("label"))).alias("base_labels"),
        F.collect_set(label).alias("labels"),
        F.max(F.when(whole, 1.0).when(~F.col("base"), F.col("coverage"))).alias("score"),
    )
    rows = found.filter("pos = -1").select("row_id", "doc_id", "n_words")
    joined = rows.join(judged, "row_id", "left")
    listed = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    return joined.select(
        "doc_id", F.col("n_words").cast("long"), F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long"), F.col("last_word").cast("long"),
        listed("base_labels").alias("base_labels"), listed("labels").alias("labels"),
        F.round(F.coalesce("score", F.lit(0.0)), 4).alias("score"),
    )


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir, "doc_id", "text"))


QUERIES = {"op8_licenses": op8_licenses}
ORACLES: dict[str, str] = {}
