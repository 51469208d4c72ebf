"""Bucketed targets: what is read, moved and rewritten, and batches that are run again."""

import pytest
from pyspark.sql import functions as F

from wareloom.operators import changes as CH
from wareloom.operators import merge as M
from wareloom.sources.buckets import BUCKET, BucketedTable

TS0, TS1 = "2024-01-01 00:00:00", "2024-02-01 00:00:00"


@pytest.fixture()
def dim(spark, tmp_dir):
    src = spark.range(1000).select(F.col("id").alias("k"), F.concat(F.lit("n"), "id").alias("name"))
    t = BucketedTable(spark, "wl_test_dim", f"{tmp_dir}/dim", ["k"], 40)
    t.create(M.initial_load(src, ["k"], TS0).target)
    yield t
    spark.sql("DROP TABLE IF EXISTS wl_test_dim")


def changes(spark):
    return spark.createDataFrame([(5, "changed"), (6, "n6"), (5000, "new")], "k long, name string")


def test_bucket_numbers_are_sparks_own(spark, dim):
    files = spark.table(dim.name).select(BUCKET, F.regexp_extract(F.col("_metadata.file_name"), r"_(\d+)\.c", 1).cast("int").alias("b")).distinct()
    assert files.where(f"b <> {BUCKET}").isEmpty() and files.count() == 40


def test_the_target_is_not_moved(spark, dim):
    for conf in ("-1", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")):
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", conf)
        try:
            batch = changes(spark)
            assert dim.unique
            joined = CH.lookup_current(batch, dim.read_touched(batch), ["k"], ["SKEY", "RWHKEY"], unique=dim.unique)
            plan = joined._jdf.queryExecution().sparkPlan().toString() if conf == "-1" else joined._jdf.queryExecution().executedPlan().toString()
            full = joined._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert "PartitionFilters" in plan and f"{BUCKET}#" in plan
        if conf == "-1":
            assert full.count("Exchange hashpartitioning") == 1 and "Aggregate" not in full          # the batch moves, the target does not
            assert "40)" in full[full.index("Exchange hashpartitioning"):][:80]


def test_only_touched_buckets_change_and_replays_change_nothing(spark, dim):
    def files():
        return {(r[0], r[1]) for r in spark.table(dim.name).select(BUCKET, F.col("_metadata.file_path")).distinct().collect()}
    before, batch = files(), changes(spark)

    def run(version):
        res = M.scd2_merge(batch, dim.read_touched(batch), ["k"], TS1, include_history=False, next_key=dim.next_key())
        return res.counters(), dim.commit(res.target, version)
    counts, done = run(1)
    assert done and (counts["inserted"], counts["expired"], counts["unchanged"], counts["source_rows"]) == (2, 1, 1, 3)
    assert {b for b, _ in files() ^ before} == set(dim.touched(batch))
    state = sorted(map(str, dim.read().collect()))
    assert len(state) == 1002 and dim.read_history().count() == 1
    assert run(1)[1] is False                                       # the marker is there
    counts, done = run(2)                                           # as after a crash before the marker
    assert done and counts["inserted"] == 0 and sorted(map(str, dim.read().collect())) == state


def test_two_current_rows_of_a_key_are_noticed(spark, tmp_dir):
    src = spark.createDataFrame([(1, "a"), (2, "b")], "k long, name string")
    rows = M.initial_load(src, ["k"], TS0).target
    t = BucketedTable(spark, "wl_test_twice", f"{tmp_dir}/twice", ["k"], 8)
    t.create(rows.unionByName(rows.where("k = 1").withColumn("SKEY", F.lit(9).cast("long"))))
    try:
        assert not t.unique
        batch = spark.createDataFrame([(1, "z")], "k long, name string")
        res = M.scd2_merge(batch, t.read_touched(batch), ["k"], TS1, include_history=False, next_key=t.next_key(), unique_target=t.unique)
        t.commit(res.target, 1)
        assert t.read_current().where("k = 1").count() == 1 and t.read_history().count() == 2 and t.is_unique()
    finally:
        spark.sql("DROP TABLE IF EXISTS wl_test_twice")


def test_a_table_of_an_earlier_session_is_named_again(spark, dim):
    rows, schema = sorted(map(str, dim.read().collect())), dim.read_current().schema
    spark.sql(f"DROP TABLE {dim.name}")
    again = BucketedTable(spark, "wl_test_dim", dim.root, ["k"], 40).open(schema)
    assert sorted(map(str, again.read().collect())) == rows


def test_counters_of_an_empty_batch(spark, dim):
    batch = changes(spark).limit(0)
    res = M.scd2_merge(batch, dim.read_touched(batch), ["k"], TS1, include_history=False, next_key=dim.next_key())
    assert res.counters()["source_rows"] == 0 and dim.commit(res.target, 1) and dim.read().count() == 1000
