import hashlib
import random

from llm_fixtures import docs, prose, with_clashing, words

from wareloom.llm import op6_decontaminate as op


def brute(rows, bench):
    out = []
    wins = [(str(i), words(t)) for i, t in bench if i is not None and words(t)]
    for i, t in rows:
        w, hit, items = words(t), set(), set()
        for item, b in wins:
            k = min(13, len(b))
            grams = {tuple(b[s:s + k]) for s in range(len(b) - k + 1)}
            for s in range(len(w) - k + 1):
                if tuple(w[s:s + k]) in grams:
                    hit.update(range(s, s + k))
                    items.add(item)
        out.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)


def fixture():
    rng = random.Random(3)
    items = [(1, prose(rng, 40)), (2, prose(rng, 13)), (10, "three short words"), (11, "lone"), (3, " ".join(["same"] * 20)), (None, "not an item at all"), (5, None),
             (6, "..."), (1, prose(rng, 20)), (7, "Ünder score ıçé " + prose(rng, 15))]
    rows = [(1, items[0][1]), (2, prose(rng, 30) + ". " + items[0][1][60:200].upper() + " " + prose(rng, 40)), (3, "Three, SHORT; words!"), (4, None), (5, ""),
            (6, "!!"), (7, "lone"), (7, "same " * 12), (8, "same " * 50), (9, prose(rng, 4000) + " " + items[1][1] + " " + prose(rng, 4000)), (None, items[1][1]),
            (12, items[9][1]), (13, items[9][1].replace(" ", " ")), (14, " ".join(items[0][1].split()[:12])), (14, " ".join(items[0][1].split()[:12]))]
    return rows, items


def test_against_brute_force(spark):
    rows, items = fixture()
    assert got(op.contamination(docs(spark, rows), bench(spark, items))) == brute(rows, items)


def test_benchmark_in_groups(spark):
    rows, items = fixture()
    assert got(op.contamination(docs(spark, rows), bench(spark, items), group_words=25)) == brute(rows, items)


def test_empty_tables_and_clashing_columns(spark):
    rows, items = fixture()
    d, b = docs(spark, rows), bench(spark, items)
    assert op.contamination(d.limit(0), b).count() == 0
    assert got(op.contamination(d, b.limit(0))) == brute(rows, [])
    clash = op.contamination(with_clashing(d, "rid", "term", "n_words", "postings"), with_clashing(b, "doc_id", "k"))
    assert got(clash) == brute(rows, items)


def test_proximity_matches(spark):
    """One word replaced, inserted or removed anywhere in a window, the rarest word included, leaves a proximity match."""
    rng = random.Random(9)
    item, other = prose(rng, 13, 5000), prose(rng, 6, 5000)
    rows = []
    for k in range(13):
        w = item.split()
        rows.append((k, " ".join([prose(rng, 5), *w[:k], "changed", *w[k + 1:], prose(rng, 20)])))
        if 0 < k < 12:
            rows.append((100 + k, " ".join([prose(rng, 20), *w[:k], "put in", *w[k:], prose(rng, 3)])))
            rows.append((200 + k, " ".join([*w[:k], *w[k + 1:], prose(rng, 20)])))
    rows += [(300, other), (301, prose(rng, 9) + " " + " ".join([*other.split()[:3], "changed", *other.split()[4:]])), (302, prose(rng, 60, 5000))]
    rows += [(400, " ".join([item.split()[0], prose(rng, 9), item.split()[5], prose(rng, 9), item.split()[9]]))]       # words, but not together
    d = docs(spark, rows)
    got = {r["doc_id"]: (r["contaminated"], r["near_items"], r["items"]) for r in op.contamination(d, bench(spark, [(4, item), (5, other)])).collect()}
    assert [i for i in got if i < 300 and got[i] != (False, ["4"], [])] == []
    assert got[300] == (True, [], ["5"]) and got[301] == (False, ["5"], []) and got[302] == got[400] == (False, [], [])


def test_pipeline_form_keeps_clean_documents(spark):
    rows, items = fixture()
    d = docs(spark, rows)
    clean = [r for r in rows if not brute([r], items)[0][5]]
    kept = op.keep_documents(with_clashing(d, "_bad", "rid", "contaminated"), bench(spark, items))
    assert kept.columns == [*d.columns, "_bad", "rid", "contaminated"]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(clean, key=str)      # row by row: one of the two with id 7
    assert [i for i, _ in clean].count(7) == 1


def test_pipeline_form_judges_rows_of_one_doc_id_apart(spark):
    rng = random.Random(21)
    item, other = prose(rng, 30), prose(rng, 20, 300)
    rows = [(None, item), (None, prose(rng, 40)), (None, None), (5, prose(rng, 40)), (5, other), (5, prose(rng, 25)), (6, item), (6, item), (8, "")]
    want = sorted(((str(i), t) for (i, t), r in ((r, brute([r], [(1, item), (2, other)])[0]) for r in rows) if not r[5]), key=str)
    assert len(want) == 5 and {i for i, _ in want} == {"None", "5", "8"}
    for group_words in (2_000_000, 25):
        kept = op.keep_documents(docs(spark, rows), bench(spark, [(1, item), (2, other)]), group_words=group_words)
        assert sorted(((str(r["doc_id"]), r["text"]) for r in kept.collect()), key=str) == want


def test_seeds_are_the_rarest_of_every_window():
    rng = random.Random(1)
    w = prose(rng, 60, 30).split()
    n = {x: rng.randrange(50) for x in w}
    seeds = op.seed_positions(w, n)
    for s in range(len(w) - 12):
        assert set(sorted(i for i in range(s, s + 13) if n[w[i]])) >= {x[2] for x in sorted((n[w[i]], w[i], i) for i in range(s, s + 13) if n[w[i]])[:4]} <= set(seeds)
    assert op.seed_positions(["absent"], {}) == []


def test_postings_hold_every_occurrence():
    import pyarrow as pa
    texts = ["b a b", None, "x", "a A, b!"]
    batch = pa.RecordBatch.from_pydict({"rid": [7, 8, 9, 10], "text": texts})
    rows = [r for b in op._postings({"a": 0, "b": 1}, [batch]) for r in b.to_pylist()]
    assert rows == [{"term": -1, "rids": [7, 8, 9, 10], "at": [3, 0, 1, 3]}, {"term": 0, "rids": [7, 10, 10], "at": [1, 0, 1]},
                    {"term": 1, "rids": [7, 7, 10], "at": [0, 2, 2]}]


def test_common_words_only(spark):
    """Items of nothing but words every document holds, over one long and many short documents."""
    rng = random.Random(2)
    item = " ".join(rng.choice(["the", "of", "and"]) for _ in range(16))
    rows = [(k, " ".join(rng.choice(["the", "of", "and"]) for _ in range(40))) for k in range(60)] + [(99, "the " * 3000 + item + " of" * 3000)]
    items = [(1, item), (2, "the " * 13), (3, "of the")]
    assert got(op.contamination(docs(spark, rows), bench(spark, items))) == brute(rows, items)


def test_no_rows_of_the_driver_go_through_python_workers(spark, monkeypatch):
    rows, items = [(1, "three short words here"), (2, "nothing of it"), (3, None)], [(10, "three short words"), (11, "lone")]
    d, b, none = docs(spark, rows), bench(spark, items), bench(spark, [])
    monkeypatch.setattr(spark.sparkContext, "parallelize", lambda *a, **k: (_ for _ in ()).throw(AssertionError("a list became an RDD")))
    assert got(op.contamination(d, b)) == brute(rows, items)
    assert got(op.contamination(d, none)) == brute(rows, [])
