"""Language identification by compression with per-language zstandard raw-content dictionaries.

Learning: for every language a dictionary of ``slots`` passages is gathered from the labelled
training rows: each (language, slot) keeps the passage of the row with the smallest hash (an
aggregate with a map-side partial step; ``slots * passage_bytes`` bytes a language, whatever the
corpus holds).

Prediction: every word of the whole text is encoded, in pieces of ``PIECE`` bytes, with each language's dictionary;
the language with the smallest total of bytes wins. ``score`` is the share of the winner
when the per-piece bit costs are read as evidence; ``margin`` is the relative saving over the
runner-up and ``accepted`` is false when it is below ``min_margin`` (a narrow decision is rejected;
``lang_pred`` still names the best guess, as the contract asks).

Defined cases: NULL text or text without a letter -> ``und``, score 0, not accepted; ties go to the
smaller language name; with no labelled row every text is ``und``; a very long text is encoded whole, piece by piece; repeated rows
get equal predictions; an empty table gives no rows; columns named as the new ones are replaced, others pass through."""

from __future__ import annotations

import re
from functools import partial

import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, map_columns, remainder, table

LETTER = re.compile(r"[^\W\d_]")
WORD = re.compile(r"[^\W\d_]+")
SLOTS, PASSAGE, PIECE, LEVEL = 256, 1024, 2048, 6
MIN_MARGIN = 0.01


def reduced(text: str) -> bytes:
    """What is encoded: all words of the text, lower-cased, in order (case, digits and marks tell nothing about the language)."""
    return " ".join(WORD.findall(text.lower())).encode("utf-8", "replace")


def _passages(size, cols):
    """A passage of at most ``size`` bytes from a place in the text that its hash picks."""
    out = []
    for t, h in zip(cols["text"].to_pylist(), cols["h"].to_pylist()):
        b = reduced(t)
        start = h % max(1, len(b) - size + 1)
        out.append(b[start:start + size])
    return {"lang": cols["lang"], "slot": cols["slot"], "h": cols["h"], "passage": out}


def learn(train: DataFrame, slots: int = SLOTS, passage_bytes: int = PASSAGE) -> dict:
    """{lang: (dictionary bytes, training rows)} from rows with ``text`` and a non-null ``lang``."""
    h = F.abs(F.xxhash64("text"))
    rows = (train.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
            .select("text", "lang", F.when(h < 0, 0).otherwise(h).alias("h")).withColumn("slot", (F.col("h") % slots).cast("int")))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    best = (map_columns(rows.select("text", "lang", "slot", "h"), partial(_passages, passage_bytes),
                        "lang string, slot int, h long, passage binary")
            .groupBy("lang", "slot").agg(F.min(F.struct("h", "passage")).alias("p")).collect())
    out = {}
    for lang in sorted(counts):
        parts = [r["p"]["passage"] for r in sorted((r for r in best if r["lang"] == lang), key=lambda r: (r["p"]["h"], r["slot"]))]
        out[lang] = (b"\n".join(parts), counts[lang])
    return out


class Coder:
    """One compressor per language, made once per Python worker."""

    made: dict = {}

    def __init__(self, model: dict):
        self.langs = sorted(model)
        params = zstd.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0)
        self.coders = []
        for k in self.langs:
            d = zstd.ZstdCompressionDict(model[k][0] or b" ", dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(LEVEL)
            self.coders.append(zstd.ZstdCompressor(dict_data=d, compression_params=params))

    @classmethod
    def of(cls, key: int, model: dict) -> "Coder":
        if key not in cls.made:
            cls.made.clear()
            cls.made[key] = cls(model)
        return cls.made[key]

    def costs(self, text: str) -> list[float]:
        b = reduced(text)
        pieces = [b[i:i + PIECE] for i in range(0, len(b), PIECE)]
        return [float(sum(len(c.compress(x)) for x in pieces)) for c in self.coders]


def _predict(key, model, min_margin, cols):
    coder = Coder.of(key, model) if model else None
    lang, score, margin = [], [], []
    for t in cols["text"].to_pylist():
        if coder is None or t is None or not LETTER.search(t):
            lang.append("und"), score.append(0.0), margin.append(0.0)
            continue
        costs = coder.costs(t)
        order = sorted(range(len(costs)), key=lambda i: (costs[i], coder.langs[i]))
        best = costs[order[0]]
        m = (costs[order[1]] - best) / max(costs[order[1]], 1e-9) if len(order) > 1 else 1.0
        share = 1 / sum(2.0 ** -min(60.0, 8 * (costs[i] - best) / max(1.0, len(t) / 400)) for i in order)
        lang.append(coder.langs[order[0]]), score.append(share), margin.append(m)
    return {"lang_pred": lang, "score": score, "margin": margin, "accepted": [m >= min_margin and x != "und" for m, x in zip(margin, lang)]}


def predict(docs: DataFrame, model: dict, min_margin: float = MIN_MARGIN) -> DataFrame:
    """``docs`` with lang_pred, score, margin and accepted for each whole text; no shuffle."""
    key = hash(tuple((k, v[0], v[1]) for k, v in sorted(model.items())))
    return add_columns(docs, partial(_predict, key, model, min_margin),
                       "lang_pred string, score double, margin double, accepted boolean")


def op2_language_id(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn(
        "held_out", F.coalesce(remainder("doc_id", 4) == 2, F.lit(True)))
    model = learn(docs.where(~F.col("held_out")).select("text", "lang"))
    return predict(docs.select("doc_id", "held_out", "text"), model).select(
        "doc_id", "held_out", "lang_pred", "score", "margin", "accepted")
