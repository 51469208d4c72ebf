"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or.

A document is a bag of sentences. A sentence is toxic with probability
``p = sigmoid(b + sum of the weights of its features)`` and the document with
``1 - (1 - leak) * prod(1 - p)`` (noisy-or; ``leak`` covers toxic documents without a telling
sentence, and is the score of an empty text). Only document labels are known; the gradient of the
document likelihood flows to the sentences, so the sentences that explain the label get the weight,
and the same scores then point at the offending sentences.

Features of a sentence are its lower-cased words and their prefixes (``^`` + 4..8 letters), which
catches invented or inflected compounds of a telling stem. Candidates are the features most
associated with the toxic label; counts are taken in Spark over the training sample.

Training uses at most ``max_docs`` labelled documents (smallest hash of the id first); one text of a
near-copy group is used (equal smallest 5-word hashes), so a copied document does not outweigh others.
What reaches the driver: ``max_candidates`` feature counts, ``max_features`` weights and the bags of
the sample as feature indexes.

Defined cases: NULL or empty text scores ``leak``; several labels for one doc_id: toxic if any is; a
NULL doc_id is never learned from and counts as held out; no labelled rows: every score is 0; a very long text is scored whole,
sentence by sentence; repeated rows get equal scores; an empty table gives no rows; columns named as the new ones are replaced,
others pass through."""

from __future__ import annotations

import re
from collections import Counter
from functools import partial

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, cut_lineage, map_columns, remainder, shielded, table

TOKEN = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")
PREFIXES = range(4, 9)
MAX_DOCS, MAX_CANDIDATES, MAX_FEATURES, MIN_Z = 20_000, 60_000, 3_000, 6.0


def features(word: str) -> list[str]:
    return [word] + ["^" + word[:n] for n in PREFIXES if len(word) > n]


def _copy_key(text: str) -> int:
    """Hash of the two smallest 5-word run hashes: shared by most near copies, not by texts that share one passage."""
    w = re.findall(r"\w+", text.lower())
    runs = sorted({xxhash.xxh3_64_intdigest(" ".join(w[i:i + 5])) for i in range(max(1, len(w) - 4))})[:2]
    return xxhash.xxh3_64_intdigest(repr(runs)) >> 1


def _with_key(cols):
    return {"copy": [_copy_key(t or "") for t in cols["text"].to_pylist()]}


def _doc_features(text: str) -> set[str]:
    return {f for w in set(TOKEN.findall(text.lower())) for f in features(w)}


def _count(only, cols):
    """Documents of the batch per feature, toxic and all; ``only``: the features to count."""
    n, pos = Counter(), Counter()
    for t, y in zip(cols["text"].to_pylist(), cols["toxic"].to_pylist()):
        f = _doc_features(t)
        f = f if only is None else f & only
        n.update(f)
        if y:
            pos.update(f)
    return {"feature": list(n), "n": list(n.values()), "pos": [pos[f] for f in n]}


class Lookup:
    """Feature indexes of words, remembered per worker (the store is emptied when it is full)."""

    def __init__(self, vocab: dict[str, int], room: int = 100_000):
        self.vocab, self.known, self.room = vocab, {}, room

    def __call__(self, word: str) -> tuple:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= self.room:
                self.known.clear()
            got = self.known[word] = tuple(self.vocab[f] for f in features(word) if f in self.vocab)
        return got


def bag(text: str, lookup: Lookup) -> tuple[int, list]:
    """Number of sentences, and (start, end, feature indexes) of those with a known feature."""
    low = text.lower()
    spans, n, known = [], 0, lookup.known.get
    same = len(low) == len(text)          # lower-casing may change lengths; offsets then refer to the lower-cased text
    for m in SENTENCE.finditer(low):
        found = set()
        words = TOKEN.findall(m.group())
        if not words:
            continue
        n += 1
        for w in words:
            ix = known(w)
            if ix is None:
                ix = lookup(w)
            if ix:
                found.update(ix)
        if found:
            spans.append((m.start(), m.end(), sorted(found)))
    return n, spans if same else [(min(a, len(text)), min(b, len(text)), f) for a, b, f in spans]


def _bags(vocab, cols):
    look = Lookup(vocab)
    n, hits = [], []
    for t in cols["text"].to_pylist():
        k, spans = bag(t, look)
        n.append(k)
        hits.append([f for _, _, f in spans])
    return {"toxic": cols["toxic"], "n": n, "hits": hits}


def fit(y: np.ndarray, n: np.ndarray, hits: list, size: int, steps: int = 500, l2: float = 0.02, keep: float = 0.4) -> dict:
    """Noisy-or maximum likelihood by Adam on sparse bags. y: labels, n: sentences per document,
    hits: per document the feature lists of its sentences that have any. Each step sees a random part
    of a toxic document's telling sentences (share ``keep``, at least one), so that one sentence alone
    learns to explain a label that several explain in training."""
    doc = np.array([d for d, s in enumerate(hits) for _ in s], np.int64)
    sent = np.array([k for k, f in enumerate(f for s in hits for f in s) for _ in f], np.int64)
    feat = np.array([i for s in hits for f in s for i in f], np.int64)
    plain = n - np.bincount(doc, minlength=len(y))
    w = np.zeros(size + 2)
    w[size], w[size + 1] = -6.0, -3.0            # sentence bias, leak
    m, v = np.zeros_like(w), np.zeros_like(w)
    rng, of_toxic = np.random.default_rng(7), np.asarray(y, bool)[doc] if len(doc) else np.zeros(0, bool)
    for t in range(1, steps + 1):
        z = w[size] + np.bincount(sent, w[feat], len(doc))
        draw = rng.random(len(doc))
        least = np.full(len(y), 2.0)
        np.minimum.at(least, doc, draw)
        on = ~of_toxic | (draw < keep) | (draw == least[doc])
        log_not = -np.logaddexp(0, z) * on                         # log(1 - p) of the telling sentences
        total = np.bincount(doc, log_not, len(y)) - plain * np.logaddexp(0, w[size]) - np.logaddexp(0, w[size + 1])
        total = np.minimum(total, -1e-9)
        g_total = np.where(y, np.exp(total) / -np.expm1(total), -1.0)  # d(-loglik)/d(total)
        p = 1 / (1 + np.exp(-z))
        g_z = -g_total[doc] * p * on
        g = np.zeros_like(w)
        g[:size] = np.bincount(feat, g_z[sent], size)
        g[size] = g_z.sum() - (g_total * plain).sum() / (1 + np.exp(-w[size]))
        g[size + 1] = -g_total.sum() / (1 + np.exp(-w[size + 1]))
        g[:size] += l2 * len(y) / 1000 * w[:size]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.15 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return {"weights": w[:size], "bias": float(w[size]), "leak": float(w[size + 1])}


def learn(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_candidates: int = MAX_CANDIDATES,
          max_features: int = MAX_FEATURES) -> dict:
    """``docs``: doc_id, text; ``labels``: doc_id, toxic. Returns the model (vocabulary and weights)."""
    chosen = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
              .agg((F.max("toxic") == 1).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs))
    sample = (add_columns(docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id"),
                          _with_key, "copy long")
              .groupBy("copy", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text")).drop("copy"))
    sample = cut_lineage(sample, "tox-sample")
    counted = "feature string, n long, pos long"
    toxic = (map_columns(sample.where("toxic"), partial(_count, None), counted).groupBy("feature").agg(F.sum("pos").alias("pos"))
             .where("pos >= 4").orderBy(F.desc("pos"), "feature").limit(max_candidates).collect())
    only = {r["feature"] for r in toxic}
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not only or not totals.get(False):
        base = totals.get(True, 0) / max(1, sum(totals.values()))
        return {"vocab": {}, "weights": np.zeros(0), "bias": -30.0, "leak": float(np.log(base / (1 - base))) if 0 < base < 1 else -30.0 + 60 * base}
    rows = map_columns(sample, partial(_count, only), counted).groupBy("feature").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).collect()
    base = totals.get(True, 0) / sum(totals.values())
    z = sorted(((r["pos"] - r["n"] * base) / np.sqrt(r["n"] * base * (1 - base) + 0.25), r["feature"]) for r in rows)[::-1]
    vocab = {f: i for i, f in enumerate(f for s, f in z[:max_features] if s >= MIN_Z)}
    bags = map_columns(sample, partial(_bags, vocab), "toxic boolean, n long, hits array<array<int>>").collect()
    model = fit(np.array([r["toxic"] for r in bags], bool), np.array([r["n"] for r in bags], float), [r["hits"] for r in bags], len(vocab))
    return model | {"vocab": vocab}


def _score(model, cols):
    look, w, b = Lookup(model["vocab"]), model["weights"].tolist(), model["bias"]
    plain, leak = -np.logaddexp(0, b), -np.logaddexp(0, model["leak"])
    out = {k: [] for k in ("score", "n_sentences", "worst_start", "worst_end", "worst_score", "offending")}
    for t in cols["text"].to_pylist():
        n, spans = bag(t or "", look)
        total, found = leak + plain * (n - len(spans)), []
        for a, e, f in spans:
            z = b + sum(w[i] for i in f)
            total -= np.logaddexp(0, z)
            found.append((float(1 / (1 + np.exp(-z))), a, e))
        worst = max(found, key=lambda x: (x[0], -x[1]), default=(None, None, None))
        out["score"].append(float(-np.expm1(total)))
        out["n_sentences"].append(n)
        out["worst_score"].append(worst[0]), out["worst_start"].append(worst[1]), out["worst_end"].append(worst[2])
        out["offending"].append([{"start": a, "end": e, "score": s} for s, a, e in found if s >= 0.5])
    return out


RESULT = ("score double, n_sentences long, worst_start long, worst_end long, worst_score double, "
          "offending array<struct<start:long,end:long,score:double>>")


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with score, n_sentences, the worst sentence (start, end, score) and the offending
    sentences (score >= 0.5) of each whole text; no shuffle. Offsets are code points of the text."""
    return add_columns(docs, partial(_score, model), RESULT)


def train_labels(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", "toxic").where(remainder("doc_id", 5) != 0)


def op1_toxicity(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, train_labels(spark, sf_dir))
    return (score(docs.withColumn("held_out", F.coalesce(remainder("doc_id", 5) == 0, F.lit(True))), model)
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
            .select("doc_id", "held_out", "score", "predicted", "n_sentences", "worst_start", "worst_end", "worst_score",
                    F.size("offending").cast("long").alias("n_offending")))


def keep_documents(docs: DataFrame, labels_docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pipeline form: documents whose score is below ``threshold``, columns as they came."""
    model = learn(labels_docs, labels)
    return shielded(docs, lambda d: score(d, model).where(F.col("score") < threshold))
