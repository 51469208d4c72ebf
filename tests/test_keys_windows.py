from pyspark.sql import functions as F

from wareloom.operators.keys import number_rows
from wareloom.operators.windows import number_within_groups, top_k


def test_number_rows_dense_and_ordered(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("k"))
    out = number_rows(df, "k", start=10, num_partitions=5).collect()
    pairs = sorted((r.k, r.rn) for r in out)
    assert [p[1] for p in pairs] == list(range(10, 5010))


def test_number_within_groups_hot_group(spark):
    # one group holds 90 % of the rows
    df = spark.range(0, 3000, 1, 6).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(99).alias("g"),
                                            F.col("id"))
    out = number_within_groups(df, ["g"], [F.col("id").desc()], num_partitions=6).collect()
    by = {}
    for r in out:
        by.setdefault(r.g, []).append((r.id, r.seq))
    for g, rows in by.items():
        rows.sort(key=lambda x: -x[0])
        assert [s for _, s in rows] == list(range(1, len(rows) + 1))


def test_topk_plans_partial_group_limit(spark):
    df = spark.range(0, 1000).select((F.col("id") % 10).alias("g"), "id")
    out = top_k(df, "g", [F.col("id").desc()], 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 30
    assert "WindowGroupLimit" in plan or "AdaptiveSparkPlan" in plan


def test_numbering_runs_no_collect_per_partition(spark):
    """Offsets stay in Spark: the plan does not grow with the number of partitions."""
    from wareloom.operators.keys import number_rows
    df = spark.range(0, 5000, 1, 7)
    few, many = number_rows(df, "id", num_partitions=4), number_rows(df, "id", num_partitions=400)
    assert sorted(r["rn"] for r in many.collect()) == list(range(1, 5001))
    assert len(many._jdf.queryExecution().optimizedPlan().toString()) < 1.2 * len(few._jdf.queryExecution().optimizedPlan().toString())


def test_null_groups_are_numbered(spark):
    from wareloom.operators.windows import number_within_groups
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, v int")
    assert sorted((r["g"] or "", r["v"], r["seq"]) for r in number_within_groups(df, ["g"], ["v"]).collect()) == [("", 1, 1), ("", 2, 2), ("a", 3, 1)]
