"""License scanning by diagonal voting, in DataFrame functions only.

All k-word windows of all documents are joined by hash to the windows of the
templates; the join condition also compares the words, so a hit is a real one.
A hit votes for the diagonal (word in the document minus word in the template).
A template that is hit by all its windows on one diagonal stands there word for
word: that is a place, and base phrases are judged by it alone.  For the others,
neighbouring diagonals are merged where their hits follow each other, so a span
survives inserted and dropped words.  A merged span is verified: of its hits the
longest chain is taken that goes forward in the document and in the template, and
the span counts if the chain has enough of the template's windows, so each position
of the template counts once however often its words are repeated.

The templates are a fixed list of some hundred words, so they are broadcast.
Only hits and one marker row per document leave the scan's tasks.

Defined results: null and empty texts have no words and no labels; a document
shorter than k words has no hits; repeated doc_ids and equal rows are told apart; a
text of any length is one value of its row, and so are the hits of one span, of which
there are at most as many as words; further columns are not read and can't clash; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lower_ascii, text_of

#: Base phrases and their labels.
BASE = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
#: Passages of public licences for the method's own labels.
PASSAGES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
]
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 3
#: Diagonals this far apart are merged.
GAP = 3
#: Share of a passage's windows that a merged span has to hit.
ENOUGH = 0.6


def _windows(texts: list[tuple[str, str, bool]], k: int) -> list[tuple]:
    rows = []
    for number, (text, label, base) in enumerate(texts):
        words = re.split(WORD_BREAK, text)
        rows += [(number, label, base, i, len(words) - k + 1, *words[i : i + k]) for i in range(len(words) - k + 1)]
    return rows


def templates(spark: SparkSession, base=BASE, passages=PASSAGES, k: int = K) -> DataFrame:
    """One row per k-word window of each template, with its hash."""
    rows = _windows([(t, label, True) for t, label in base] + [(t, label, False) for t, label in passages], k)
    schema = "template int, label string, base boolean, at int, windows int, " + ", ".join(f"t{i} string" for i in range(k))
    return spark.createDataFrame(rows, schema).withColumn("hash", F.xxhash64(*[f"t{i}" for i in range(k)]))


def longest_chain(hits: Column, windows: Column) -> Column:
    """Most hits whose words and template positions both rise, from (word, minus position) in order.

    The state holds for each template position the longest chain that ends there; of
    hits at one word later positions come first, so one can't follow another.
    """
    none = F.array_repeat(F.lit(0), windows)

    def step(best: Column, hit: Column) -> Column:
        at = -hit["back"]
        longer = F.coalesce(F.array_max(F.slice(best, F.lit(1), at)), F.lit(0)) + 1
        return F.transform(best, lambda b, i: F.when(i == at, F.greatest(b, longer)).otherwise(b))

    return F.coalesce(F.aggregate(hits, none, step, F.array_max), F.lit(0))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, passages=PASSAGES, k: int = K) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``spans`` lists the merged passages as (label, first, last, score) in words.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), lower_ascii(text_of(text_col)).alias("text"))
    # the text may start or end with a break, which leaves an empty word there
    rows = rows.select("doc_id", "row", F.array_remove(F.split("text", WORD_BREAK), "").alias("words"))
    n = F.greatest(F.size("words") - (k - 1), F.lit(0))
    shifted = [F.slice("words", i + 1, n).alias(f"w{i}") for i in range(k)]
    # one marker in front keeps documents without hits; its words are null
    marker = F.array(F.lit(None).cast("struct<" + ",".join(f"w{i}:string" for i in range(k)) + ">"))
    rows = rows.select("doc_id", "row", F.size("words").cast("long").alias("n_words"), F.posexplode(F.concat(marker, F.arrays_zip(*shifted))).alias("pos", "w"))
    rows = rows.select("doc_id", "row", "n_words", "pos", *[F.col(f"w.w{i}").alias(f"w{i}") for i in range(k)])
    hashed = rows.withColumn("hash", F.xxhash64(*[f"w{i}" for i in range(k)]))
    marks = docs.sparkSession.createDataFrame([(None, None, None, None, None, *[None] * k)], "template int, label string, base boolean, at int, windows int, " + ", ".join(f"t{i} string" for i in range(k)))
    marks = marks.withColumn("hash", F.xxhash64(*[f"t{i}" for i in range(k)]))
    known = F.broadcast(templates(docs.sparkSession, base, passages, k).unionByName(marks))
    # the words are compared in a form that isn't taken for a join key, so the key stays one long
    differ = reduce(lambda a, b: a | b, [(F.col(f"w{i}") < F.col(f"t{i}")) | (F.col(f"w{i}") > F.col(f"t{i}")) for i in range(k)])
    hits = hashed.join(known, (hashed["hash"] == known["hash"]) & (F.col("template").isNull() | ~differ)).select(
        "row", "doc_id", "n_words", "template", "label", "base", "at", "windows", (F.col("pos") - 1).alias("word"), (F.col("pos") - 1 - F.col("at")).alias("diagonal")
    )
    # votes: hits of one template on one diagonal
    votes = hits.groupBy("row", "doc_id", "n_words", "template", "label", "base", "windows", "diagonal").agg(
        F.count(F.lit(1)).alias("n"), F.min("word").alias("first"), F.max("word").alias("last"), F.collect_list(F.when(~F.col("base"), F.struct("word", (-F.col("at")).alias("back")))).alias("hits")
    )
    # neighbouring diagonals whose hits lie within a template's length make one span
    along = Window.partitionBy("row", "template").orderBy("first", "diagonal")
    far = (F.abs(F.col("diagonal") - F.lag("diagonal").over(along)) > GAP) | (F.col("first") - F.lag("last").over(along) > F.col("windows"))
    votes = votes.withColumn("island", F.sum(F.coalesce(far, F.lit(True)).cast("int")).over(along))
    spans = votes.groupBy("row", "doc_id", "n_words", "template", "label", "base", "windows", "island").agg(
        F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"), F.min("first").alias("first"), (F.max("last") + k - 1).alias("last"),
        F.sum(F.when(F.col("base") & (F.col("n") == F.col("windows")), 1).otherwise(0)).alias("places"),
        F.min(F.when(F.col("base") & (F.col("n") == F.col("windows")), F.col("diagonal"))).alias("first_place"),
        F.max(F.when(F.col("base") & (F.col("n") == F.col("windows")), F.col("diagonal"))).alias("last_place"),
    )
    chain = F.when(F.col("base"), F.col("places") * F.col("windows")).otherwise(longest_chain(F.col("hits"), F.col("windows")))
    spans = spans.withColumn("score", F.when(F.col("template").isNull(), 0.0).otherwise(F.least(F.lit(1.0), chain / F.col("windows"))))
    good = F.when(F.col("base"), F.col("places") > 0).otherwise(F.col("score") >= ENOUGH)
    label = F.when(good, F.col("label"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return (
        spans.groupBy("row", "doc_id", "n_words")
        .agg(
            F.sum("places").cast("long").alias("n_base"),
            F.min("first_place").cast("long").alias("first_word"),
            F.max("last_place").cast("long").alias("last_word"),
            joined(F.when(F.col("places") > 0, F.col("label"))).alias("base_labels"),
            joined(label).alias("labels"),
            F.coalesce(F.max("score"), F.lit(0.0)).alias("score"),
            F.array_sort(F.collect_list(F.when(good, F.struct("label", "first", "last", "score")))).alias("spans"),
        )
        .drop("row")
    )
