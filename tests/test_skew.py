"""Hot keys and copy groups: one key / group holding a third of all rows."""

from pyspark.sql import functions as F

from wareloom.operators import similarity as SIM
from wareloom.operators.merge import dedup_last
from wareloom.operators.windows import first_per_group, number_within_groups, top_k


def _hot(spark, n=3000):
    return spark.range(0, n, 1, 6).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"),
                                          F.col("id").alias("v"))


def test_dedup_and_latest_with_a_hot_key(spark):
    df = _hot(spark)
    d = {r.k: r.v for r in dedup_last(df, ["k"], ["v"]).collect()}
    assert d[0] == 2997 and len(d) == 2001
    f = {r.k: r.v for r in first_per_group(df, ["k"], F.col("v"), descending=False).collect()}
    assert f[0] == 0


def test_hot_group_is_numbered_across_partitions(spark):
    df = _hot(spark)
    ranged = df.repartitionByRange(8, "k", "v").withColumn("pid", F.spark_partition_id())
    assert ranged.filter("k = 0").select("pid").distinct().count() > 1     # the hot group is split
    out = number_within_groups(df, ["k"], [F.col("v")], num_partitions=8).filter("k = 0").orderBy("v").collect()
    assert [r.seq for r in out] == list(range(1, 1001))


def test_topk_with_a_hot_group(spark):
    out = top_k(_hot(spark), "k", [F.col("v").desc()], 3).filter("k = 0").collect()
    assert sorted(r.v for r in out) == [2991, 2994, 2997]


def test_copy_group_of_a_third_never_pairs_up(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [(i, base) for i in range(30)]                                        # one copy group
    rows += [(100 + i, f"word{i} other{i} thing{i} more{i} stuff{i} here{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = SIM.with_text_key(df, "doc_id", "text")
    texts = keyed.groupBy("tkey").agg(F.first("norm").alias("norm"))
    assert SIM.prefix_candidates(SIM.shingles(texts), 0.7).count() == 0          # copies are one text
    out = SIM.similar_pairs(df, "doc_id", "text").collect()
    per = {}
    for r in out:
        per.setdefault(r.doc_id, []).append((r["rank"], r.match_id, r.score))
    assert len(per) == 30
    for d, lst in per.items():
        want = [m for m in range(30) if m != d][:5]
        assert [m for _, m, _ in sorted(lst)] == want and all(s == 1.0 for _, _, s in lst)
