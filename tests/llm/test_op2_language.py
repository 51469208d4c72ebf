import random

import numpy as np
from conftest import SF01
from llm_fixtures import docs, with_clashing

from pyspark.sql import functions as F

from wareloom.llm import op2_language as op

SYLLABLES = {"aa": ["ko", "ri", "ta", "me", "su"], "bb": ["ung", "sch", "ein", "der", "pf"], "cc": ["éa", "oui", "çon", "eau", "tré"]}


def corpus(n=150, seed=1):
    rng, out = random.Random(seed), []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        out.append((i, " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 80))), lang))
    return out


def test_learned_languages(spark):
    model = op.learn(docs(spark, corpus()))
    got = {r["doc_id"]: r for r in op.predict(docs(spark, corpus(100, 2)), model).collect()}
    assert np.mean([got[i]["lang_pred"] == x for i, _, x in corpus(100, 2)]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_defined_cases(spark):
    model = op.learn(docs(spark, corpus() + [(900, None, "aa"), (901, "", "bb"), (902, "text without a language", None)]))
    assert sorted(model) == ["aa", "bb", "cc"]
    odd = [(1, None), (2, ""), (3, "123 ... !"), (4, "ko"), (5, "korita mesuko tarime sumeko ritasu komeri " * 5_000),
           (5, "KORITA MESUKO TARIME SUMEKO RITASU KOMERI"), (None, "derung einsch pfderein schung ungein derpf")]
    got = op.predict(docs(spark, odd), model).collect()
    by = {(r["doc_id"], r["text"]): r for r in got}
    assert all(by[x]["lang_pred"] == "und" and by[x]["score"] == 0 and not by[x]["accepted"] for x in odd[:3])
    assert by[odd[4]]["lang_pred"] == "aa" and by[odd[5]]["lang_pred"] == "aa" and by[odd[6]]["lang_pred"] == "bb"
    assert op.predict(docs(spark, odd).limit(0), model).count() == 0


def test_narrow_margins_are_rejected(spark):
    model = op.learn(docs(spark, corpus()))
    mixed = " ".join(t for _, t, _ in corpus(6, 3))
    r = op.predict(docs(spark, [(1, mixed)]), model, min_margin=0.9).collect()[0]
    assert not r["accepted"] and r["lang_pred"] in SYLLABLES


def test_every_word_counts(spark):
    """A long text in one language with few different words, and a short list of many different words of another."""
    model = op.learn(docs(spark, corpus()))
    rng = random.Random(6)
    few = ["".join(rng.choice(SYLLABLES["aa"]) for _ in range(3)) for _ in range(8)]
    many = " ".join("".join(rng.choice(SYLLABLES["bb"]) for _ in range(3)) for _ in range(25))
    text = " ".join(rng.choice(few) for _ in range(1600)) + " " + many
    got = {r["doc_id"]: r["lang_pred"] for r in op.predict(docs(spark, [(1, text), (2, many), (3, many + " " + few[0])]), model).collect()}
    assert got == {1: "aa", 2: "bb", 3: "bb"}


def test_without_training_rows(spark):
    model = op.learn(docs(spark, [(1, "some text")]))
    assert [r["lang_pred"] for r in op.predict(docs(spark, [(1, "some text")]), model).collect()] == ["und"]


def test_clashing_columns(spark):
    d = docs(spark, corpus(40))
    model = op.learn(with_clashing(d, "h", "slot", "passage"))
    out = op.predict(with_clashing(d, "score", "lang_pred", "h"), model)
    assert {r["lang_pred"] for r in out.collect()} <= set(SYLLABLES) and "h" in out.columns


def test_held_out_accuracy_on_the_given_table(spark):
    got = op.op2_language_id(spark, SF01).where("held_out").join(
        spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang").where(F.col("lang").isNotNull()), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
