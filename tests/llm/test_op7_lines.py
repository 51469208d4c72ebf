import hashlib
import random

import numpy as np
from llm_fixtures import AZ, docs, with_clashing

from wareloom.llm import op7_lines as op

BLANKS = " \t\n\x0b\x0c\r"


def brute(rows, min_docs=5, min_chars=40):
    def key(x):
        k = x.strip(BLANKS).translate(AZ)
        return k if len(k) >= min_chars else None
    held = {}
    for n, (i, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")} - {None}:
            held.setdefault(k, []).append((n, i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = []
        for x in lines:
            k = key(x)
            ids = [d for _, d in held.get(k, ()) if d is not None]
            gone = k is not None and len(held[k]) >= min_docs and ids and (i is None or i < max(ids))
            if not gone:
                keep.append(x)
        out.append((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=str)


LONG = "This line is repeated in many of the documents of this table"
ROWS = ([(i, f"{LONG}\nown line number {i}\n\t {LONG.upper()} \r\nshort") for i in range(8)] + [(100, None), (101, ""), (102, "\n\n"), (None, LONG), (3, LONG)]
        + [(200 + i, "é" * 39 + "\n" + "É" * 40 + "\n" + "é" * 40) for i in range(5)] + [(300 + i, "ab" * 30_000 + "\n" + str(i)) for i in range(6)]
        + [(400 + i, "four documents hold this line, which is one too few") for i in range(4)])


def test_against_brute_force(spark):
    assert rows_of(op.dedup_lines(docs(spark, ROWS))) == brute(ROWS)


def test_keys_brought_to_the_filters_give_the_same_result(spark, monkeypatch):
    assert rows_of(op.dedup_lines(docs(spark, ROWS), max_filter_bytes=1)) == brute(ROWS)
    monkeypatch.setattr(op, "KEYS_PER_SHARD", 1)
    monkeypatch.setattr(op.build_filters, "__defaults__", (1,))
    index = op.LineIndex.of(docs(spark, ROWS))
    assert index.shards > 2 and rows_of(op.dedup_lines(docs(spark, ROWS), index=index, max_filter_bytes=1)) == brute(ROWS)
    plan = op.dedup_lines(docs(spark, ROWS), index=index, max_filter_bytes=1)
    assert rows_of(op.dedup_lines(docs(spark, ROWS).limit(0), index=index, max_filter_bytes=1)) == [] and plan.columns[-4:] == [x.split()[0] for x in op.RESULT.split(", ")]


def test_a_third_of_the_rows_without_an_id(spark):
    rows = [(None if k % 3 == 0 else k, f"{LONG}\nown text of {k}, which nobody else has at all") for k in range(90)]
    for limit in (1, 32 << 20):
        assert rows_of(op.dedup_lines(docs(spark, rows), max_filter_bytes=limit)) == brute(rows)


def test_all_null_ids_keep_the_line(spark):
    rows = [(None, LONG)] * 6
    assert rows_of(op.dedup_lines(docs(spark, rows))) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    d = docs(spark, ROWS)
    assert op.dedup_lines(d.limit(0)).count() == 0
    got = op.dedup_lines(with_clashing(d, "n_lines", "_wl_cand", "_wl_drop", "key", "kept_text", "_wl_id", "_id", "last_doc"))
    assert rows_of(got) == brute(ROWS) and "key" in got.columns


def test_insert_and_delete_are_reversible(spark):
    first, second = docs(spark, ROWS[:6]), docs(spark, ROWS[6:])
    a = op.LineIndex.of(first)
    b = a.insert(second)
    assert rows_of(op.dedup_lines(docs(spark, ROWS), index=b)) == brute(ROWS)
    gone = spark.createDataFrame([(i,) for i in {r[0] for r in ROWS[6:] if r[0] is not None} - {3}], "doc_id long")
    c = b.delete(gone)
    rest = [r for r in ROWS if r[0] is None or r[0] in {x[0] for x in ROWS[:6]}]
    assert sorted(map(tuple, c.repeated.collect())) == sorted(map(tuple, op.LineIndex.of(docs(spark, rest)).repeated.collect()))
    assert rows_of(op.dedup_lines(docs(spark, rest), index=c)) == brute(rest)


def test_cuckoo_filter_inserts_finds_and_deletes():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2 ** 63, (3000, 2), dtype=np.int64).astype(np.uint64)
    f = op.CuckooFilter.build(keys)
    assert f.contains(keys).all()
    other = rng.integers(0, 2 ** 63, (20_000, 2), dtype=np.int64).astype(np.uint64)
    assert f.contains(other).mean() < 0.01
    f.delete(keys[:1500])
    assert f.contains(keys[1500:]).all() and f.contains(keys[:1500]).mean() < 0.05
    f.delete(keys[1500:])
    assert not f.slots.any()


def test_random_corpora(spark):
    rng = random.Random(5)
    pool = [f"line {k} " + "x" * rng.choice([30, 40, 60]) for k in range(12)]
    rows = [(rng.randrange(30), "\n".join(rng.choice(pool) for _ in range(rng.randrange(6)))) for _ in range(60)]
    assert rows_of(op.dedup_lines(docs(spark, rows))) == brute(rows)


def test_pipeline_form_keeps_documents_and_columns(spark):
    d = with_clashing(docs(spark, ROWS), "n_lines", "key", "kept_text", "n_dropped")
    out = op.drop_lines(d)
    assert out.columns == d.columns and out.count() == len(ROWS) and {r["kept_text"] for r in out.collect()} == {"extra"}
    got = sorted((str(r["doc_id"]), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in out.collect())
    assert got == sorted((str(i), h) for i, _, _, h in brute(ROWS))
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect() if r["text"] is not None)


def _python_steps_in_a_row(plan: str) -> int:
    """Most Python steps between two shuffles, on a path down the plan as Spark prints it."""
    most, path = 0, []                 # (depth, Python steps since the last shuffle)
    for line in plan.splitlines():
        name = line.lstrip(" :+-*")
        depth = len(line) - len(name)
        while path and path[-1][0] >= depth:
            path.pop()
        above = path[-1][1] if path else 0
        here = 0 if name.startswith(("Exchange", "ShuffleQueryStage", "BroadcastExchange", "BroadcastQueryStage")) else above + ("InArrow" in name.split(" ")[0])
        path.append((depth, here))
        most = max(most, here)
    return most


def test_a_task_has_one_python_step(spark):
    for limit in (1, 32 << 20):
        out = op.dedup_lines(docs(spark, ROWS), max_filter_bytes=limit).select("doc_id", "n_lines", "n_dropped", "kept_sha256")
        assert sorted(map(tuple, out.collect()), key=str) == brute(ROWS)
        plan = out._jdf.queryExecution().executedPlan().toString()
        final = plan.split("== Initial Plan ==")[0]
        assert "InArrow" in final and _python_steps_in_a_row(final) == 1, final


def test_every_type_of_column_passes_through(spark):
    extra = "date'2020-01-02' AS d", "timestamp'2020-01-02 03:04:05' AS ts", "1.50BD AS dec", "named_struct('a', 1, 'b', array('x')) AS st", "map('k', 2) AS m", "X'00FF' AS bin", "CAST(NULL AS int) AS n"
    d = docs(spark, ROWS).selectExpr("*", *extra)
    out = op.drop_lines(d)
    assert out.dtypes == d.dtypes
    assert out.selectExpr("d", "ts", "dec", "st", "m['k']", "bin", "n").distinct().collect() == d.selectExpr("d", "ts", "dec", "st", "m['k']", "bin", "n").distinct().collect()
