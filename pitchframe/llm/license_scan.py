"""License scans by diagonal voting, with DataFrame operations only.

All rolling word three-grams of every text are hash-joined to the places of the same
three-grams in license templates (a fixed table, hence broadcast). A hit votes for its
diagonal (word position minus template position); votes are summed per document, template
and diagonal, neighbouring diagonals are merged (words inserted or left out), and a merged
span is kept when it covers enough of the template. The words themselves take part in the
join condition, so a hash collision cannot make a hit.

A base phrase of m words stands at word s exactly when its diagonal s holds all m - 2 votes.

Defined results: a null or empty text has no words and no labels; rows repeating both id and
text are one document; a null id is an ordinary id; other columns are ignored; an empty table
gives an empty result. Rows of one document are combined in the task that read it before the
shuffle, so neither a hot source nor a frequent phrase gathers anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchframe.llm.common import ascii_lower, narrow

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 3
#: Diagonals this close are one alignment with words inserted or left out.
MAX_SHIFT = 2
#: Share of a template's grams that a merged span must hold.
MIN_COVERAGE = 0.6

# Base phrases and their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
# Opening sentences and notices of public licenses.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this "
     "software and associated documentation files", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies "
     "or substantial portions of the software", "mit"),
    ("licensed under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license", "apache-2"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("redistribution and use in source and binary forms with or without modification are "
     "permitted provided that the following conditions are met", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms "
     "of the gnu general public license", "gpl"),
    ("subject to the terms of the mozilla public license", "mpl"),
)


def template_grams(spark: SparkSession) -> DataFrame:
    """(template, t_at, a, b, c, h): every three-gram of every template, a few hundred rows."""
    rows = []
    for t, (phrase, _) in enumerate(BASE + TEMPLATES):
        w = phrase.split()
        rows += [(t, i, *w[i:i + GRAM]) for i in range(len(w) - GRAM + 1)]
    df = spark.createDataFrame(rows, "template int, t_at int, ta string, tb string, tc string")
    return df.withColumn("h", F.xxhash64("ta", "tb", "tc"))


def _by_template(values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("template") + 1)


def votes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, n_words, template, diagonal, votes): one row per voted diagonal, and one
    row with a null template per document."""
    d = narrow(docs, id_col, text_col)
    words = d.select("doc_id", F.xxhash64("text").alias("key"), F.regexp_extract_all(
        ascii_lower(F.col("text")), F.lit(WORD), F.lit(0)).alias("w"))
    n = F.size("w")
    grams = words.select(
        "doc_id", "key", n.cast("long").alias("n_words"),
        F.inline_outer(F.arrays_zip(
            F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")).alias("at"),
            F.col("w").alias("a"), F.slice("w", F.lit(2), n).alias("b"),
            F.slice("w", F.lit(3), n).alias("c")))
    ).withColumn("h", F.xxhash64("a", "b", "c"))
    t = F.broadcast(template_grams(docs.sparkSession))
    hits = grams.join(t, (grams["h"] == t["h"]) & (F.col("a") == F.col("ta"))
                      & (F.col("b") == F.col("tb")) & (F.col("c") == F.col("tc")), "left")
    hits = hits.filter(F.col("template").isNotNull() | (F.coalesce("at", F.lit(0)) == 0))
    # the row at word 0 stands for the document; where it is a hit too it stands for both
    hits = hits.select("doc_id", "key", "n_words", F.explode(F.when(
        F.col("template").isNull(), F.array(F.struct(
            F.lit(None).cast("int").alias("template"), F.lit(None).cast("int").alias("diagonal"))))
        .when(F.col("at") == 0, F.array(
            F.struct(F.lit(None).cast("int").alias("template"), F.lit(None).cast("int").alias("diagonal")),
            F.struct("template", (F.col("at") - F.col("t_at")).alias("diagonal"))))
        .otherwise(F.array(F.struct("template", (F.col("at") - F.col("t_at")).alias("diagonal"))))
    ).alias("v"), "at").select("doc_id", "key", "n_words", "v.template", "v.diagonal", "at")
    # a word place votes once for a diagonal, in however many equal rows it stands
    return hits.groupBy("doc_id", "key", "n_words", "template", "diagonal").agg(
        F.count_distinct("at").alias("votes"))


def license_scan(docs: DataFrame, min_coverage: float = MIN_COVERAGE,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: base places, labels of base phrases and of verified spans, score.

    ``score`` is the largest template share of any verified span (1 for a base place, 0 for none).
    """
    lengths = [len(p.split()) - GRAM + 1 for p, _ in BASE + TEMPLATES]
    names = [x for _, x in BASE + TEMPLATES]
    v = votes(docs, id_col, text_col)
    is_base = F.coalesce((F.col("template") < len(BASE)) & (F.col("votes") == _by_template(lengths)),
                         F.lit(False))
    base = v.withColumn("is_base", is_base)
    # neighbouring diagonals form one span
    near = Window.partitionBy("doc_id", "key", "n_words", "template").orderBy("diagonal")
    cut = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(near)) > MAX_SHIFT, F.lit(True))
    by_span = (base.withColumn("span", F.sum(cut.cast("int")).over(near))
               .groupBy("doc_id", "key", "n_words", "template", "span")
               .agg(F.least(F.sum("votes") / F.first(_by_template(lengths)), F.lit(1.0)).alias("coverage"),
                    F.count_if("is_base").alias("places"),
                    F.min(F.when(F.col("is_base"), F.col("diagonal"))).alias("first_at"),
                    F.max(F.when(F.col("is_base"), F.col("diagonal"))).alias("last_at")))
    sure = (F.col("places") > 0) | ((F.col("template") >= len(BASE)) & (F.col("coverage") >= min_coverage))
    label = _by_template(names)
    return (by_span.groupBy("doc_id", "key", "n_words").agg(
        F.sum("places").alias("n_base"),
        F.min("first_at").cast("long").alias("first_word"),
        F.max("last_at").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("places") > 0, label))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(sure, label))), ",").alias("labels"),
        F.coalesce(F.max(F.when(sure, F.when(F.col("places") > 0, F.lit(1.0)).otherwise(F.col("coverage")))),
                   F.lit(0.0)).alias("score"))
        .select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"))
