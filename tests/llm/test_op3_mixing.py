import random
import re

import numpy as np
from llm_fixtures import docs, prose, with_clashing

from wareloom.llm import op3_mixing as op

SIZE = re.compile(r"[^\x20\x09-\x0D]+")


def fixture():
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.choice([0, 1, 5, 40, 300])), None, rng.choice(["a", "b", "b", "b", "Z", "é", None])) for i in range(300)]
    return rows + [(900, None, None, "empty"), (901, "  \t\n", None, "empty"), (7, "again the same id", None, "b"), (7, "again the same id", None, "b"), (None, "no id here", None, "a"),
                   (950, "tiny source", None, "tiny"), (960, "x " * 50_000, None, "a")]


def targets(rows):
    size = {}
    for _, t, _, s in rows:
        size[s] = size.get(s, 0) + len(SIZE.findall(t or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight, total, out = {s: i % 3 + 1 for i, s in enumerate(names)}, sum(size.values()), {}
    free = set(names)
    while True:
        per = (total - sum(3 * size[s] for s in names if s not in free)) / max(1, sum(weight[s] for s in free))
        over = {s for s in free if per * weight[s] > 3 * size[s]}
        if not over:
            return size, {s: per * weight[s] if s in free else 3.0 * size[s] for s in names}
        free -= over


def test_targets_and_takes(spark):
    rows = fixture()
    size, want = targets(rows)
    got = op.mix_sources(docs(spark, rows), block_words=64, shard_words=1000).collect()
    assert sorted((r["doc_id"], r["size"]) for r in got if r["doc_id"] is not None) == sorted((i, len(SIZE.findall(t or ""))) for i, t, _, _ in rows if i is not None)
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == size[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in taken.items():
        assert abs(t - want[s]) <= 1


def test_reruns_and_partitioning_agree(spark):
    rows = fixture()
    a = op.mix_sources(docs(spark, rows, 2), block_words=64, shard_words=1000)
    b = op.mix_sources(docs(spark, rows[::-1], 7), block_words=64, shard_words=1000)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_draws_are_disjoint_and_shards_even(spark):
    rows = fixture()
    d = op.draw_mix(docs(spark, rows), block_words=64, shard_words=2000).where("words > 0").collect()
    assert all(r["shard"] is not None for r in d)
    assert len({(r["src"], r["bucket"], r["nth"], r["epoch"]) for r in d}) == len(d)
    assert len({r["shard"] for r in d}) > 5


def test_split_tree_is_exact():
    q = np.array([5, 0, 37, 1, 400])
    leaves = [op.split_leaf(i, 7, q, 1) for i in range(7)]
    assert (sum(x for _, x in leaves) == q).all()
    first = np.zeros(5, int)
    for at, n in leaves:
        assert (at == first).all()
        first = first + n
    sizes = [int(n.sum()) for _, n in leaves]
    assert max(sizes) - min(sizes) <= 3


def test_empty_and_clashing(spark):
    rows = fixture()
    d = docs(spark, rows)
    assert op.mix_sources(d.limit(0)).count() == 0
    only_empty = docs(spark, [(1, None), (2, "")])
    assert [r["taken"] for r in op.mix_sources(only_empty).collect()] == [0, 0]
    c = op.mix_sources(with_clashing(d, "size", "src", "bucket", "target", "h", "words"))
    assert sorted(map(str, c.collect())) == sorted(map(str, op.mix_sources(d).collect()))


def test_block_orders_are_permutations_and_no_rotations():
    for n in [*range(1, 60), 1000, 32_768]:
        step, shift = op.block_order(n, [op.SEED, 3])
        order = [(step * b + shift) % n for b in range(n)]
        assert sorted(order) == list(range(n))
        if n > 6:
            assert step % n not in (1, n - 1)
    assert op.block_order(101, [1, 0]) != op.block_order(101, [2, 0])


def test_shards_are_shuffled_inside(spark):
    rows = fixture()
    d = op.draw_mix(docs(spark, rows), block_words=64, shard_words=1000).where("shard IS NOT NULL").collect()
    shards = {}
    for r in d:
        shards.setdefault(r["shard"], []).append((r["place"], r["src"], r["bucket"], r["nth"]))
    assert len(shards) > 3
    assert all(sorted(p for p, *_ in s) == list(range(1, len(s) + 1)) for s in shards.values())
    big = max(shards.values(), key=len)
    assert [x[1:] for x in sorted(big)] != sorted(x[1:] for x in big) and len({x[1] for x in sorted(big)[:max(4, len(big) // 4)]}) > 1


def test_rows_without_an_id_are_spread(spark):
    rows = [(None, f"text number {i} of many", None, "a") for i in range(400)]
    d = op.draw_mix(docs(spark, rows), block_words=64, shard_words=1000)
    assert d.select("bucket").distinct().count() > 300


def test_no_rows_of_the_driver_go_through_python_workers(spark, monkeypatch):
    rows = fixture()
    d = docs(spark, rows)
    empty = d.limit(0)
    want = sorted(map(str, op.mix_sources(d, block_words=64, shard_words=1000).collect()))
    monkeypatch.setattr(spark.sparkContext, "parallelize", lambda *a, **k: (_ for _ in ()).throw(AssertionError("a list became an RDD")))
    assert sorted(map(str, op.mix_sources(d, block_words=64, shard_words=1000).collect())) == want
    assert op.mix_sources(empty).count() == 0
