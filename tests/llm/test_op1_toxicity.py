import random
import zlib

import numpy as np
from conftest import SF01
from llm_fixtures import docs, prose, with_clashing

from wareloom.llm import op1_toxicity as op

BAD = ["scoundrel", "villainous", "rotters"]


def corpus(n=400, seed=1):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        s = [prose(rng, 8) for _ in range(rng.randrange(1, 9))]
        toxic = i % 4 == 0
        if toxic:
            s.insert(rng.randrange(len(s) + 1), f"you are a {rng.choice(BAD)} indeed")
        rows.append((i, ". ".join(s) + "."))
        labels.append((i, int(toxic)))
    return rows, labels


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int")


def test_learns_from_document_labels_and_finds_the_sentence(spark):
    rows, labels = corpus()
    train = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 5]
    model = op.learn(docs(spark, rows), labels_of(spark, train))
    got = {r["doc_id"]: r for r in op.score(docs(spark, rows), model).collect()}
    y = dict(labels)
    assert np.mean([(got[i]["score"] >= 0.5) == bool(y[i]) for i in y]) > 0.98
    for i, t in rows:
        if y[i] and got[i]["score"] >= 0.5:
            part = t[got[i]["worst_start"]:got[i]["worst_end"]]
            assert any(b in part for b in BAD) and "." not in part
            assert all(any(b in t[x["start"]:x["end"]] for b in BAD) for x in got[i]["offending"])


def test_defined_cases(spark):
    rows, labels = corpus(120)
    model = op.learn(docs(spark, rows), labels_of(spark, labels + [(0, 0), (None, 1), (3, None)]))
    odd = [(1, None), (2, ""), (3, "..."), (4, "villainous " * 20_000), (4, "villainous"), (None, "you are a scoundrel indeed")]
    got = sorted(((r["doc_id"], r["score"], r["n_sentences"]) for r in op.score(docs(spark, odd), model).collect()), key=str)
    by = {(i, n): s for i, s, n in got}
    assert by[(1, 0)] == by[(2, 0)] == by[(3, 0)] < 0.5 and all(0 <= s <= 1 for s in by.values())
    assert len(got) == len(odd) and by[(None, 1)] > 0.5
    assert op.score(docs(spark, odd).limit(0), model).count() == 0


def test_without_labels(spark):
    rows, _ = corpus(20)
    model = op.learn(docs(spark, rows), labels_of(spark, []))
    assert all(r["score"] < 0.01 for r in op.score(docs(spark, rows), model).collect())
    one = op.learn(docs(spark, rows), labels_of(spark, [(1, 1)]))
    assert all(0 <= r["score"] <= 1 for r in op.score(docs(spark, rows), one).collect())


def test_clashing_columns(spark):
    rows, labels = corpus(60)
    model = op.learn(with_clashing(docs(spark, rows), "toxic", "copy", "n"), with_clashing(labels_of(spark, labels), "text", "copy"))
    out = op.score(with_clashing(docs(spark, rows), "score", "offending", "other"), model)
    assert dict(out.dtypes)["score"] == "double" and "other" in out.columns
    plain = op.score(docs(spark, rows), model)
    assert sorted((r["doc_id"], r["score"]) for r in out.collect()) == sorted((r["doc_id"], r["score"]) for r in plain.collect())


def test_pipeline_form(spark):
    rows, labels = corpus(200)
    d = docs(spark, rows)
    out = op.keep_documents(with_clashing(d, "score"), d, labels_of(spark, labels))
    assert {r["score"] for r in out.collect()} == {"extra"}
    kept = {r["doc_id"] for r in out.collect()}
    assert kept == {i for i, y in labels if not y}


def test_query_on_the_given_table(spark):
    got = op.op1_toxicity(spark, SF01).join(spark.read.parquet(f"{SF01}/labels.parquet"), "doc_id").where("held_out").collect()
    clean = [r["predicted"] for r in got if r["toxic"] == 0]
    assert np.mean(clean) < 0.05
    pos, neg = [r["score"] for r in got if r["toxic"] == 1], [r["score"] for r in got if r["toxic"] == 0]
    assert np.mean([[p > n for n in neg] for p in pos]) > 0.8
