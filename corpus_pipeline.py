"""Corpus pipeline: toxicity, line dedup, near-duplicates, benchmark decontamination, mixing.

``STAGES`` lists (name, function) in order; a function takes ``(spark, docs, sf_dir)`` and returns a
DataFrame that is written as Parquet and reread as the next one's ``docs``. All but the last return the
columns of ``documents``:

* toxicity: documents whose noisy-or score is 0.5 or more go (learned from ``labels``);
* line_dedup: repeated lines go from the texts, every document stays;
* near_duplicates: one document of each class stays;
* decontamination: contaminated documents go;
* mixing: one row per remaining document with the words the mix takes, the shards that hold its copies and their places there.

Every stage judges rows, not ids: rows without a doc_id or with a repeated one are kept or dropped each for itself (line_dedup and
near_duplicates order ids, NULL last to stay). NULL and empty texts pass every stage but a toxicity score of 0.5 or more for empty
texts; an empty table gives an empty table; columns beside those of ``documents`` pass through the first four stages whatever their
names; very long texts are read whole. Tables a stage writes in between are deleted when its result or a small table it needs
is stored; a stage's result may be read until the folder of the run is cleared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wareloom.llm import (op1_toxicity, op3_mixing, op6_decontaminate, op7_lines, op10_near_duplicates)
from wareloom.llm.common import cut_lineage, short_batches, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return op1_toxicity.keep_documents(docs, docs, op1_toxicity.train_labels(spark, sf_dir))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return op7_lines.drop_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return op10_near_duplicates.keep_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return op6_decontaminate.keep_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return op3_mixing.mix_sources(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("mixing", mixing)]

#: Learned scores, similarity classes and random draws cannot be said in SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are a Parquet table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
