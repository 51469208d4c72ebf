import random

from llm_fixtures import docs, prose, with_clashing, words

from wareloom.llm import op9_licenses as op


def brute(rows):
    out = []
    for r in rows:
        w = words(r[1])
        at = [(s, label) for label, p in op.BASE for s in range(len(w)) if w[s:s + len(p.split())] == p.split()]
        out.append((r[0], len(w), len(at), min((s for s, _ in at), default=None), max((s for s, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()), key=str)


RNG = random.Random(8)
ROWS = [(1, "The MIT License, then mit-license; MITLicense mit licenses"), (2, "GNU General Public License, version 3. general public general public license"), (3, None), (4, ""), (5, "license"),
        (6, prose(RNG, 3000) + " Apache\n\tLicense " + prose(RNG, 3000)), (7, "mit license " * 300), (None, "apache license"), (1, "The MIT License, then mit-license; MITLicense mit licenses"),
        (8, "éMIT license mit licenseé mit license "), (9, op.TEMPLATES[0][1].title()), (10, "general public\nlicense"), (11, "mit mit license license"), (12, "!!! ..."), (13, "mit"),
        (14, prose(RNG, 50) + " " + op.TEMPLATES[0][1].replace("hereby ", "").replace("copy", "copy here") + " " + prose(RNG, 50)), (15, "MİT license")]


def test_base_against_brute_force(spark):
    assert got(op.scan(docs(spark, ROWS))) == brute(ROWS)


def test_labels_of_the_method(spark):
    by = {r["doc_id"]: r for r in op.scan(docs(spark, ROWS)).collect()}
    assert by[9]["labels"] == "mit" and by[9]["base_labels"] == "" and by[9]["score"] == 1.0
    assert by[14]["labels"] == "mit" and 0.6 <= by[14]["score"] < 1.0
    assert by[3]["labels"] == "" and by[3]["score"] == 0.0
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in by.values())


def test_repeated_bigrams_and_similar_licenses(spark):
    gpl, lgpl = (next(t for x, t in op.TEMPLATES if x == label and "under the terms" in t) for label in ("gpl", "lgpl"))
    you = "you can redistribute it and or modify it "
    rows = [(1, "the license " * 10), (2, "of the " * 40 + "software " * 40), (3, gpl), (4, you + lgpl), (5, gpl + " . " + op.TEMPLATES[0][1]), (6, gpl + " " + "filler " * 70 + lgpl),
            (7, (gpl + " x ") * 30), (8, " ".join(reversed(gpl.split())))]
    by = {r["doc_id"]: r for r in op.scan(docs(spark, rows)).collect()}
    assert [by[i]["labels"] for i in range(1, 9)] == ["", "", "gpl", "gpl,lgpl", "gpl,mit", "gpl,lgpl", "gpl", ""]
    assert [by[i]["base_labels"] for i in (3, 4)] == ["gpl", "gpl"]              # the base phrase stands in both
    assert by[1]["score"] < 0.3 and by[3]["score"] == 1.0


def test_random_words(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([" ", "-", ". "]).join(rng.choice(["MIT", "license", "general", "public", "Apache", "x"]) for _ in range(rng.randrange(30)))) for i in range(200)]
    assert got(op.scan(docs(spark, rows))) == brute(rows)


def test_empty_and_clashing(spark):
    d = docs(spark, ROWS)
    assert op.scan(d.limit(0)).count() == 0
    assert got(op.scan(with_clashing(d, "h", "rid", "label", "base", "t1", "p", "n_words"))) == brute(ROWS)


def test_no_python_in_the_plan(spark):
    plan = op.spans(docs(spark, ROWS))._jdf.queryExecution().toString() + op.winners(op.spans(docs(spark, ROWS)).where("found"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
