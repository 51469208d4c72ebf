import numpy as np
import pytest
from llm_fixtures import with_clashing
from pyspark.sql import functions as F

from wareloom.llm import op4_topk as op


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(parts)


def brute(rows, k=20, every=20):
    ok = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v, _ in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    dim = max((len(v) for _, v in ok), default=0)
    m = np.zeros((len(ok), dim), np.int64)
    for n, (_, v) in enumerate(ok):
        m[n, :len(v)] = v
    out = []
    for n, (i, _) in enumerate(ok):
        if i % every == 0:
            s = m @ m[n]
            best = sorted(((-int(s[j]), ok[j][0]) for j in range(len(ok)) if j != n))[:k]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(best)]
    return sorted(out)


def fixture(n=900, dim=24, seed=1):
    rng = np.random.default_rng(seed)
    length = rng.gamma(2.0, 1.0, n)
    rows = [(int(i), (rng.normal(size=dim) * length[i]).tolist(), 0) for i in range(n)]
    same = rows[7][1]
    rows += [(2000 + i, same, 1) for i in range(120)]                                         # ties: many equal vectors
    rows += [(3000, None, 0), (3020, [1.0, None] + [0.0] * 22, 0), (3040, [float("nan")] * dim, 0), (3060, [float("inf")] * dim, 0), (3080, [], 0), (3100, [1.0] * 5, 0),
             (40, [0.5] * dim, 0), (40, [0.5] * dim, 0), (None, [1.0] * dim, 0), (3120, [0.0] * dim, 0)]
    return rows


def got(df):
    return sorted(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect()))


@pytest.mark.parametrize("block", [64, 8192])
def test_against_brute_force(spark, block):
    rows = fixture()
    assert got(op.top_k(table(spark, rows), block_rows=block)) == brute(rows)


def test_few_rows_and_empty(spark):
    rows = [(0, [1.0, 2.0], 0), (1, [1.0, 0.5], 0), (2, [-1.0, 0.5], 0)]
    assert got(op.top_k(table(spark, rows))) == brute(rows)
    assert got(op.top_k(table(spark, rows[:1]))) == []
    assert op.top_k(table(spark, rows).limit(0)).count() == 0
    assert op.top_k(table(spark, [(5, None, 0)])).count() == 0


def test_clashing_columns(spark):
    rows = fixture(200)
    assert got(op.top_k(with_clashing(table(spark, rows), "rid", "norm", "score", "block", "rank", "v"))) == brute(rows)


def test_large_values_stay_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-2 ** 22, 2 ** 22, 40) * 4.0).tolist(), 0) for i in range(60)]
    assert got(op.top_k(table(spark, rows), block_rows=16)) == brute(rows)


def test_bounds_never_cut_a_result():
    rng = np.random.default_rng(4)
    q, c = rng.integers(-90, 90, (10, 12)), rng.integers(-90, 90, (200, 12))
    rot = np.linalg.svd(rng.normal(size=(50, 12)))[2].T
    s = q @ c.T
    bound = np.sort(s, axis=1)[:, -5].astype(float)
    hits = op.search_block(q, np.arange(10), bound, c, np.arange(1000, 1200), 20, rot, 4)
    assert {(i, j) for i, j, _ in hits} == {(i, j) for i in range(10) for j in range(200) if s[i, j] >= bound[i]}


def test_rounds_drop_queries_that_are_done(spark, monkeypatch):
    """A few very long vectors settle every query: short blocks meet none, and blocks are joined on their number."""
    rng = np.random.default_rng(3)
    d = rng.normal(size=16)
    rows = [(i, (d * (500 + i)).tolist(), 0) for i in range(1, 41)] + [(100 + i, (d * 0.5 + 0.01 * rng.normal(size=16)).tolist(), 0) for i in range(600)]
    seen = []
    plain = op.map_columns

    def spied(df, fn, schema):
        if schema == op.FOUND:
            seen.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, fn, schema)
    monkeypatch.setattr(op, "map_columns", spied)
    assert got(op.top_k(table(spark, rows), block_rows=16)) == brute(rows)
    assert len(seen) < 5 and all("CartesianProduct" not in p and "NestedLoop" not in p for p in seen)      # of 40 blocks


def test_the_sample_does_not_grow_with_the_partitions(spark):
    """A task sends its share of one sample (before: a sorted limit, for which every task sends as many rows as the whole sample has)."""
    rows = op.usable(table(spark, fixture(6000, 4), 12)).withColumn("rid", F.monotonically_increasing_id()).cache()
    sample = op.sampled(rows, rows.count(), 500)
    assert 350 < sample.count() < 1000
    assert "TakeOrdered" not in sample._jdf.queryExecution().toString() and "Limit" not in sample._jdf.queryExecution().toString()
    rot = op.rotation(rows, rows.count(), 500)
    assert rot.shape[0] == rot.shape[1] and np.allclose(rot.T @ rot, np.eye(len(rot)))
    assert op.rotation(rows.limit(0), 0).shape == (1, 1)


def test_repeated_query_blocks_are_not_broadcast(spark, monkeypatch):
    """Query blocks are joined once for each block of a round: the driver must not get them all (before: a small stored table was
    broadcast with all its repeated rows)."""
    monkeypatch.setattr(op, "BROADCAST", 0, raising=False)
    plans, plain = [], op.cut_lineage

    def noted(df, name="stage", keep=False):
        if name == "topk-best":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return plain(df, name, keep)
    monkeypatch.setattr(op, "cut_lineage", noted)
    rows = fixture(300)
    assert got(op.top_k(table(spark, rows), block_rows=64)) == brute(rows)
    assert plans and all("strategy=merge" in p for p in plans)
