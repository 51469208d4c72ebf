"""Small tables and brute-force helpers for the tests of the training-data operators."""

import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def docs(spark, rows, parts=3):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(r + (None, None))[:4] for r in (tuple(x) for x in rows)]
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in full], DOCS).repartition(parts)


def words(text):
    return WORD.findall((text or "").translate(AZ))


def with_clashing(df, *names):
    """The frame with extra text columns of the given names."""
    from pyspark.sql import functions as F
    return df.select("*", *[F.lit("extra").alias(n) for n in names if n not in df.columns])


def prose(rng, n, vocab=400):
    """n invented words."""
    return " ".join(f"w{rng.randrange(vocab)}x" for _ in range(n))
