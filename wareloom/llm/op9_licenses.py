"""License scans by diagonal voting (DataFrame functions only).

All rolling word bigrams of a text are hashed and joined to the bigrams of the templates. A hit at
word ``p`` of the text and ``t`` of the template votes for the diagonal ``p - t``. On one diagonal the
votes of a template that stands there word for word add up to all its bigrams; small insertions and
losses shift the rest to a near diagonal, so the diagonals within ``DIAGONAL_GAP`` of each other vote together: the distinct places of
the template they cover are counted, however often a bigram is repeated. A span is verified by the words themselves (the hash only
finds candidates), by the share of the template's bigrams it covers (>= ``MIN_COVER``), by what stands in order on its own diagonal
(>= ``MIN_OWN`` of that) and by its length. Of spans that overlap, the one whose template is covered best stays, so a notice is
not also labelled by a similar license.

The base phrases are templates too: a place counts when one diagonal has all the phrase's bigrams.
The template table is fixed and small (a few hundred bigrams), so it is broadcast.

One scan: a document keeps one row even without a hit, so nothing is joined back to the texts; the spans are a narrow table in the
shared folder, deleted once the result is stored. Spans compete inside stretches of ``STRETCH`` words of a document.

Defined cases: rows of one doc_id stay apart; NULL or empty text has 0 words, no places, no labels and score 0; a very long text is
scanned whole; equal rows get equal results; of equally covered spans the longer template's, then the first listed stays; an empty
table gives no rows; further columns are not read."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_WORD, cut_lineage, scratch_tables, table

#: Base phrases and their labels.
BASE = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

#: Opening sentences of public licenses, as words.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "gnu general public license version 3"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this library"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("agpl", "you should have received a copy of the gnu affero general public license along with this program"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("bsl", "boost software license version 1 0"),
    ("cc0", "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain"),
    ("artistic", "you may copy modify and distribute this package under the terms of the artistic license"),
    ("wtfpl", "do what the fuck you want to public license"),
]
DIAGONAL_GAP = 3
MIN_COVER = 0.6
MIN_OWN = 1 / 3
STRETCH = 64               # words; longer than any span


def template_bigrams(spark) -> DataFrame:
    rows = []
    for tid, (base, label, text) in enumerate([(True, *x) for x in BASE] + [(False, *x) for x in TEMPLATES]):
        w = text.split()
        rows += [(tid, base, label, len(w), i, w[i], w[i + 1]) for i in range(len(w) - 1)]
    schema = "array<struct<tid:int,base:boolean,label:string,t_words:int,t:int,t1:string,t2:string>>"
    keys = ("tid", "base", "label", "t_words", "t", "t1", "t2")
    one = F.from_json(F.lit(json.dumps([dict(zip(keys, r)) for r in rows])), schema)
    t = spark.range(1).select(F.explode(one).alias("b")).select("b.*")
    return t.withColumn("h", F.xxhash64("t1", "t2"))


def hits(docs: DataFrame) -> DataFrame:
    """One row per bigram hit, and one per document without: rid, doc_id, n_words, tid, base, label, t_words, p, t."""
    words = F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), NOT_WORD, -1), "")
    # lower() differs from an A-Z mapping only on letters that no template holds
    rows = (docs.select(F.col("doc_id"), words.alias("w")).withColumn("rid", F.monotonically_increasing_id())
            .select("rid", "doc_id", F.size("w").cast("long").alias("n_words"),
                    F.posexplode_outer(F.arrays_zip(F.col("w").alias("a"), F.expr("slice(w, 2, greatest(size(w), 1))").alias("b"))).alias("p", "g"))
            .select("rid", "doc_id", "n_words", "p", F.col("g.a").alias("a"), F.col("g.b").alias("b")))
    t = template_bigrams(docs.sparkSession)
    return (rows.join(F.broadcast(t), F.xxhash64("a", "b") == F.col("h"), "left")
            .withColumn("same", F.col("tid").isNotNull() & (F.col("a") == F.col("t1")) & (F.col("b") == F.col("t2")))
            .where("same OR coalesce(p, 0) = 0")
            .select("rid", "doc_id", "n_words", *[F.when(F.col("same"), F.col(c)).alias(c) for c in ("tid", "base", "label", "t_words", "t", "p")]))


def spans(docs: DataFrame) -> DataFrame:
    """Candidate spans (rid, doc_id, n_words, tid, base, label, first, last word, cover, votes, found) and one row with NULL label for a
    document without any candidate."""
    place = F.expr("shiftleft(1L, t)")                                     # templates have fewer than 63 bigrams
    votes = (hits(docs).withColumn("diagonal", F.col("p") - F.col("t"))
             .groupBy("rid", "doc_id", "n_words", "tid", "base", "label", "t_words", "diagonal")
             .agg(F.bit_or(place).alias("own"), F.min("p").alias("lo"), F.max("p").alias("hi")))
    near = Window.partitionBy("rid", "tid").orderBy("diagonal").rangeBetween(-DIAGONAL_GAP, DIAGONAL_GAP)
    both = votes.select(
        "rid", "doc_id", "n_words", "tid", "base", "label", "t_words", "diagonal", F.bit_count("own").cast("long").alias("own"),
        *[F.when(F.col("base"), F.col(c)).otherwise(agg(F.col(c)).over(near)).alias(c + "_") for c, agg in (("own", F.bit_or), ("lo", F.min), ("hi", F.max))])
    out = both.select("rid", "doc_id", "n_words", "tid", "base", "label", "t_words", "diagonal", "own", F.bit_count("own_").cast("long").alias("votes"),
                      F.col("lo_").cast("long").alias("first"), (F.col("hi_") + 1).cast("long").alias("last"))
    out = out.withColumn("cover", F.col("votes") / (F.col("t_words") - 1))
    return out.withColumn("found", F.when(F.col("base"), F.col("cover") == 1.0).otherwise(
        (F.col("cover") >= MIN_COVER) & (F.col("own") >= MIN_OWN * F.col("votes")) & (F.col("last") - F.col("first") + 1 <= F.col("t_words") * 1.5 + 4)))


def winners(found: DataFrame) -> DataFrame:
    """The found spans of the method that no better covered span overlaps."""
    rank = [F.col(c) for c in ("cover", "votes")] + [-F.col("tid"), F.col("own"), -F.col("diagonal")]
    here = found.withColumn("rank", F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank)])).withColumn(
        "stretch", F.explode(F.expr(f"sequence(first div {STRETCH}, last div {STRETCH})")))
    other = here.select("rid", "stretch", F.col("first").alias("f2"), F.col("last").alias("l2"), F.col("rank").alias("rank2"))
    beaten = (here.join(other, ["rid", "stretch"]).where("f2 <= last AND l2 >= first AND rank2 > rank")
              .select("rid", "tid", "diagonal").distinct())
    return found.join(beaten, ["rid", "tid", "diagonal"], "left_anti")


def scan(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    with scratch_tables(docs.sparkSession):
        every = cut_lineage(spans(docs), "license-spans")
        claimed = F.coalesce(F.col("found") & ~F.col("base"), F.lit(False))
        kept = every.where(~claimed).unionByName(winners(every.where(claimed)).select(*every.columns))
        found, base = F.col("found"), F.col("found") & F.col("base")
        joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
        out = (kept.groupBy("rid", "doc_id", "n_words")
               .agg(F.count(F.when(base, 1)).alias("n_base"),
                    F.min(F.when(base, F.col("first"))).alias("first_word"), F.max(F.when(base, F.col("first"))).alias("last_word"),
                    joined(F.when(base, F.col("label"))).alias("base_labels"), joined(F.when(found, F.col("label"))).alias("labels"),
                    F.coalesce(F.max(F.when(found | ~F.col("base"), F.col("cover"))), F.lit(0.0)).alias("score"))
               .drop("rid"))
        return cut_lineage(out, "license-scan", keep=True)


def op9_license_scan(spark, sf_dir) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
