"""Every stage of the pipeline against a brute-force reading of its own input."""

import zlib

from conftest import SF01
from llm_fixtures import words
from test_op3_mixing import targets
from test_op6_decontaminate import brute as brute_contaminated
from test_op7_lines import brute as brute_lines
from test_op10_near_duplicates import brute as brute_classes

import corpus_pipeline as P


def test_stages_are_listed_in_order():
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "mixing"]
    assert P.ORACLE_SQL is None


def test_stages_on_the_given_table(spark, tmp_dir):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    cols = docs.columns
    inputs = [docs]
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, inputs[-1], SF01)
        out.write.parquet(f"{tmp_dir}/{k}")
        inputs.append(spark.read.parquet(f"{tmp_dir}/{k}"))
        if k < len(P.STAGES) - 1:
            assert inputs[-1].columns == cols and inputs[-1].dtypes == docs.dtypes
    rows = [[(r["doc_id"], r["text"], r["lang"], r["source"]) for r in x.collect()] for x in inputs[:-1]]

    # toxicity: most toxic documents of the held-out fold go, clean ones stay
    kept = {r[0] for r in rows[1]}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    ids = [r[0] for r in rows[0] if r[0] in labels and zlib.crc32(str(r[0]).encode()) % 5 == 0]
    clean, toxic = [i for i in ids if labels[i] == 0], [i for i in ids if labels[i] == 1]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean) and sum(i not in kept for i in toxic) >= 0.5 * len(toxic)

    # line dedup: every document stays, dropped lines as brute force has them
    import hashlib
    want = {r[0]: r[3] for r in brute_lines([x[:2] for x in rows[1]])}
    assert {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t, *_ in rows[2]} == want

    # near-duplicates: one document of each class, all documents without words
    cls = dict(brute_classes([x[:2] for x in rows[2]]))
    empty = {i for i, t, *_ in rows[2] if not words(t)}
    assert {r[0] for r in rows[3]} == {c for i, c in cls.items() if i not in empty} | empty

    # decontamination
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF01}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute_contaminated([x[:2] for x in rows[3]], bench) if r[5]}
    assert {r[0] for r in rows[4]} == {r[0] for r in rows[3]} - bad and bad

    # mixing
    size, want = targets(rows[4])
    taken = {}
    got = inputs[-1].collect()
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert len(got) == len(rows[4]) and all(abs(taken[s] - want[s]) <= 1 for s in want)


def test_run_equals_the_stages(spark):
    a = P.run(spark, SF01).select("doc_id", "taken")
    assert a.count() > 500 and a.where("taken > 0").count() > 400
