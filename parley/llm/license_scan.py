"""License scans by diagonal voting, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parley.llm.common import cut, table

# Phrases that count exactly (base), with their labels.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
# Opening words of well-known public notices, found with small differences too.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
K = 3


def words(text: Column) -> Column:
    """The words of a text: letters, digits and all that is not ASCII, A-Z lower-cased.

    The Kelvin sign is set aside, as lower() would make an ASCII letter of it.
    """
    kept = F.when(text.contains("K"), F.regexp_replace(text, "K", "﷐")).otherwise(text)
    return F.array_remove(F.split(F.lower(F.coalesce(kept, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def grams(ws: Column) -> Column:
    """Hashes of all K consecutive words. The outer transform binds the words, so that they are made once."""
    one = lambda a: F.when(F.size(a) >= K, F.transform(F.slice(a, 1, F.size(a) - (K - 1)), lambda w, i: F.xxhash64(w, *(F.get(a, i + j) for j in range(1, K)))))
    return F.get(F.transform(F.array(ws), one), F.lit(0))


def templates(spark: SparkSession) -> DataFrame:
    """(template, label, exact, length, w, gram, at): the words and K-grams of the texts above, a few hundred rows."""
    rows = [(i, label, exact, t) for i, (label, exact, t) in enumerate([(a, True, b) for a, b in PHRASES] + [(a, False, b) for a, b in NOTICES])]
    t = spark.createDataFrame(rows, "template int, label string, exact boolean, text string").withColumn("w", words(F.col("text")))
    return t.select("template", "label", "exact", F.size("w").alias("length"), "w", F.posexplode(grams(F.col("w"))).alias("at", "gram"))


def scan(docs: DataFrame, drift: int = 2, min_share: float = 0.6) -> DataFrame:
    """License spans of documents: (doc_id, text_id, template, label, exact, start, stop, votes, share).

    docs: doc_id, text; other columns are ignored. Every K-gram of a document is joined to the template
    places that have it; the offset between both is its diagonal. Votes are counted by diagonal, and
    neighbouring diagonals (an inserted or lost word or two) are merged. An exact template needs every
    K-gram on one diagonal, each place of its own; another template needs min_share
    of its K-grams. The words of each such span are then compared: those of an exact template are its own, and share
    is the part of another template's K-grams, as words, that the span has. text_id tells texts under one doc_id apart; repeated rows count once.
    Null and empty texts have no spans. Rows of null doc_id are kept apart by text alone.
    """
    text_id = F.xxhash64(F.coalesce("text", F.lit("")))
    found = docs.select("doc_id", text_id.alias("text_id"), F.posexplode(grams(words(F.col("text")))).alias("place", "gram"))
    # the templates are the constants of this module, whatever the data
    known = templates(docs.sparkSession)
    found = found.join(F.broadcast(known.drop("w")), "gram").distinct()
    found = found.withColumn("diagonal", F.col("place") - F.col("at"))
    key = ["doc_id", "text_id", "template", "label", "exact", "length"]
    # a few rows, written once: both branches below read them, and the texts are scanned once
    votes = cut(found.groupBy(*key, "diagonal").agg(F.count("*").alias("votes"), F.min("place").alias("start"), F.max("place").alias("last")))
    whole = votes.where(F.col("exact") & (F.col("votes") == F.col("length") - (K - 1)))
    near = votes.where(~F.col("exact"))
    order = W.partitionBy("doc_id", "text_id", "template").orderBy("diagonal")
    fresh = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > drift).cast("int"), F.lit(1))
    near = near.withColumn("run", F.sum(fresh).over(order.rowsBetween(W.unboundedPreceding, 0)))
    near = near.groupBy(*key, "run").agg(F.sum("votes").alias("votes"), F.min("start").alias("start"), F.max("last").alias("last"))
    # a span as long as the template, give or take the drift of its diagonals
    near = near.where((F.col("votes") >= min_share * (F.col("length") - (K - 1))) & (F.col("last") - F.col("start") + K <= 2 * F.col("length")))
    spans = whole.drop("diagonal").unionByName(near.drop("run"))
    spans = spans.select("doc_id", "text_id", "template", "label", "exact", "length", F.col("start").cast("long").alias("start"), (F.col("last") + K).cast("long").alias("stop"), "votes")
    # hashes only propose: the words of each span are compared with those of its template
    texts = docs.select(F.col("doc_id").alias("_d"), text_id.alias("_t"), "text").join(spans.select("doc_id", "text_id").distinct(), F.col("_d").eqNullSafe(F.col("doc_id")) & (F.col("_t") == F.col("text_id")), "left_semi")
    texts = texts.distinct().withColumn("_w", words(F.col("text"))).select("_d", "_t", "_w")
    span = F.slice("_w", (F.col("start") + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int"))
    three = lambda a: F.transform(F.sequence(F.lit(1), F.size(a) - (K - 1)), lambda i: F.array_join(F.slice(a, i, K), " "))
    same = spans.join(texts, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_id") == F.col("_t"))).join(F.broadcast(known.select("template", "w").distinct()), "template")
    alike = F.size(F.array_intersect(three(F.col("w")), three(span))) / F.size(F.array_distinct(three(F.col("w"))))
    same = same.withColumn("share", F.when(F.col("exact"), (span == F.col("w")).cast("double")).otherwise(alike)).where(F.col("share") >= F.when(F.col("exact"), 1.0).otherwise(min_share))
    return same.select("doc_id", "text_id", "template", "label", "exact", "start", "stop", "votes", "share")


def label_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: the best share of a template found, 0 without any. Repeated rows each get their row.
    """
    spans = scan(docs)
    base = F.when(F.col("exact"), F.col("start"))
    told = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    per = spans.groupBy("doc_id", "text_id").agg(
        F.count(base).alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"),
        told(F.when(F.col("exact"), F.col("label"))).alias("base_labels"), told("label").alias("labels"), F.max("share").alias("score"),
    ).withColumnRenamed("doc_id", "id")
    size = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tid"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = size.join(per, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tid") == F.col("text_id")), "left")
    none = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", none("base_labels", ""), none("labels", ""), none("score", 0.0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: the whole documents table."""
    return label_documents(table(spark, sf_dir, "documents"))
