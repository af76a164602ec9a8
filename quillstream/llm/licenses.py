"""License scan by diagonal voting.

Templates are license phrases and notices, as words. Each 3-word gram of every document is looked up among the
templates' grams (a broadcast of fixed, code-bounded size); a match at document word p and template word t votes for the
diagonal p - t. Votes are summed per document, template and diagonal before and after one shuffle of matches only;
diagonals up to `drift` words apart are merged, since a word put in or left out moves the rest of a copy by one; the
merged span's coverage is the share of the template's grams that voted. A phrase is found where its one diagonal has every
gram (so all its words stand consecutively); a notice where its coverage reaches `threshold`. Found spans are verified:
the words themselves are compared, so a hash collision cannot report a license.

Defined results: a null text is empty, with no words and no label; rows are reported each by their own text, also where ids
are null or repeat; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.llm.common import cut, let, text_or_empty
from quillstream.llm.decontaminate import checked_broadcast

GRAM = 3
DRIFT = 3
THRESHOLD = 0.8

# Phrases whose every occurrence counts as base, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Opening sentences of public license notices, with the labels that the method adds.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "licensed under the gnu general public license": "gpl",
    "licensed under the gnu lesser general public license": "lgpl",
    "licensed under the gnu affero general public license": "agpl",
    "licensed under the apache license version 2 0": "apache-2",
    "this source code form is subject to the terms of the mozilla public license": "mpl-2",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "licensed under a creative commons attribution": "cc-by",
    "released under the bsd license": "bsd",
}

#: Word separators before lower-casing: everything but ASCII letters, digits and non-ASCII characters.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def templates() -> list[tuple[int, str, str, bool]]:
    """(number, words, label, is a base phrase)."""
    return [(i, w, label, base) for i, (w, label, base) in enumerate([*((w, x, True) for w, x in PHRASES.items()), *((w, x, False) for w, x in NOTICES.items())])]


def _index(spark: SparkSession) -> DataFrame:
    rows = []
    for number, text, _, _ in templates():
        w = text.split()
        rows += [(number, at, *w[at : at + GRAM]) for at in range(len(w) - GRAM + 1)]
    df = spark.createDataFrame(rows, "template int, at int, a string, b string, c string")
    return df.select("template", "at", F.xxhash64("a", "b", "c").alias("gram"))


def _words(text: str):
    # the whole text is lower-cased at once; verification compares words under the A-Z rule
    return F.filter(F.split(F.lower(text_or_empty(text)), SEPARATORS), lambda w: w != "")


def _row(text: str):
    """What stands for a row between the steps: its text's hash, since a text alone decides what is found in it."""
    return F.xxhash64(text_or_empty(text)).alias("_row")


def votes(df: DataFrame, text: str = "text") -> DataFrame:
    """_row, template, diagonal, grams (positions of the template that voted)."""
    grams = let(_words(text), lambda w: F.when(F.size(w) >= GRAM, F.transform(F.sequence(F.lit(0), F.size(w) - GRAM), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))))
    flat = df.select(_row(text), F.posexplode_outer(grams).alias("_p", "gram"))
    hits = flat.join(F.broadcast(_index(df.sparkSession)), "gram").select("_row", "template", (F.col("_p") - F.col("at")).alias("diagonal"), "at")
    return hits.groupBy("_row", "template", "diagonal").agg(F.collect_set("at").alias("grams"))


def spans(df: DataFrame, text: str = "text", drift: int = DRIFT, threshold: float = THRESHOLD) -> DataFrame:
    """_row, template, base, label, start, end (words, end exclusive), coverage of each verified span."""
    spark = df.sparkSession
    known = spark.createDataFrame([(n, label, base, w.split(), len(w.split()) - GRAM + 1) for n, w, label, base in templates()], "template int, label string, base boolean, words array<string>, need int")
    v = votes(df, text).join(F.broadcast(known.drop("words")), "template")
    full = v.filter("base and size(grams) = need").select("_row", "template", "base", "label", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("need") + GRAM - 1).alias("end"), F.lit(1.0).alias("coverage"))
    # Neighbouring diagonals: of one template in one document, in order; a gap over `drift` begins another copy.
    w = Window.partitionBy("_row", "template").orderBy("diagonal")
    notices = v.filter("not base").withColumn("_new", (F.col("diagonal") - F.lag("diagonal").over(w) > drift).cast("int"))
    notices = notices.withColumn("_copy", F.sum(F.coalesce("_new", F.lit(0))).over(w))
    merged = notices.groupBy("_row", "template", "_copy", "label", "need").agg(F.min(F.col("diagonal") + F.array_min("grams")).alias("start"), F.max(F.col("diagonal") + F.array_max("grams") + GRAM).alias("end"), F.size(F.array_distinct(F.flatten(F.collect_set("grams")))).alias("_n"))
    loose = merged.withColumn("coverage", F.col("_n") / F.col("need")).filter(F.col("coverage") >= threshold).select("_row", "template", F.lit(False).alias("base"), "label", "start", "end", "coverage")
    return _verified(df, full.unionByName(loose), known, text, threshold)


def _verified(df: DataFrame, found: DataFrame, known: DataFrame, text: str, threshold: float) -> DataFrame:
    """Keeps spans whose words are the template's: all in order for a phrase, `threshold` of its distinct words for a notice."""
    found = cut(found)
    per = found.groupBy("_row").agg(F.collect_list(F.struct("template", "base", "label", "start", "end", "coverage")).alias("_s"))
    # words from the text itself, A-Z lower-cased only where they are compared
    cut_out = let(F.filter(F.split(text_or_empty(text), SEPARATORS), lambda w: w != ""), lambda w: F.transform(F.col("_s"), lambda s: F.struct(s.alias("s"), F.transform(F.slice(w, s["start"] + 1, s["end"] - s["start"]), lambda x: F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).alias("w"))))
    read = df.select(_row(text), F.col(text)).join(checked_broadcast(per), "_row").select("_row", F.explode_outer(cut_out).alias("_x")).select("_row", "_x.s.*", F.col("_x.w").alias("_w"))
    same = F.when(F.col("base"), F.col("_w") == F.col("words")).otherwise(F.size(F.array_intersect("_w", "words")) >= threshold * F.size(F.array_distinct("words")))
    return read.join(F.broadcast(known.select("template", "words")), "template").filter(same).select("_row", "template", "base", "label", "start", "end", "coverage").distinct()


def scan(df: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    labels = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    s = spans(df, text).groupBy("_row").agg(
        F.count(F.when(F.col("base"), 1)).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).cast("long").alias("last_word"),
        labels(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        labels("label").alias("labels"),
        F.max("coverage").alias("score"),
    )
    n = F.size(F.filter(F.split(text_or_empty(text), SEPARATORS), lambda w: w != "")).cast("long")
    docs = df.select(F.col(id_column).alias("_id"), _row(text), n.alias("n_words"))
    none = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    found = docs.join(checked_broadcast(cut(s)), "_row", "left")
    return found.select(F.col("_id").alias(id_column), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", none("base_labels", ""), none("labels", ""), none("score", 0.0))
