import os

from pyspark.sql import functions as F

from wareloom.operators import merge as M
from wareloom.sources.sinks import SnapshotTable
from wareloom.streaming import ingest as SS


def test_merge_stream_restart_is_idempotent(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    spark.createDataFrame([(1, "a"), (2, "b")], "ID long, NAME string").coalesce(1).write.parquet(src)
    target = SnapshotTable(spark, os.path.join(tmp_dir, "tgt"))
    target.commit(M.initial_load(spark.createDataFrame([(1, "x")], "ID long, NAME string"), ["ID"],
                                 "2024-01-01 00:00:00").target, 0)
    schema = spark.read.parquet(src).schema
    ck, prog = os.path.join(tmp_dir, "ck"), os.path.join(tmp_dir, "prog")
    SS.merge_stream(spark, SS.file_stream(spark, src, schema), target, ["ID"], "2024-01-30 00:00:00", ck, prog)
    assert target.latest_version() == 1
    first = sorted(map(tuple, target.read().collect()))
    # a restart with the same checkpoint finds no new files and commits nothing
    SS.merge_stream(spark, SS.file_stream(spark, src, schema), target, ["ID"], "2024-01-30 00:00:00", ck, prog)
    assert target.latest_version() == 1 and sorted(map(tuple, target.read().collect())) == first
    # a new file becomes the next version
    spark.createDataFrame([(3, "c")], "ID long, NAME string").coalesce(1).write.mode("append").parquet(src)
    SS.merge_stream(spark, SS.file_stream(spark, src, schema), target, ["ID"], "2024-01-30 00:00:00", ck, prog)
    assert target.latest_version() == 2
    assert target.read().filter(F.col("CURFLG") == "Y").count() == 3
    p = SS.progress(spark, prog).orderBy("batch_id").collect()
    assert [r.source_rows for r in p] == [2, 1] and p[-1].total_source_rows == 3


def test_dimension_table_history_is_append_only(spark, tmp_dir):
    from wareloom.sources.sinks import DimensionTable
    dim = DimensionTable(spark, os.path.join(tmp_dir, "dim"))
    t0 = M.initial_load(spark.createDataFrame([(1, "a"), (2, "b")], "ID long, NAME string"), ["ID"],
                        "2024-01-01 00:00:00").target
    dim.commit(t0, 0)
    src = os.path.join(tmp_dir, "changes")
    spark.createDataFrame([(1, "a2")], "ID long, NAME string").coalesce(1).write.parquet(src)
    schema = spark.read.parquet(src).schema
    SS.merge_stream(spark, SS.file_stream(spark, src, schema), dim, ["ID"], "2024-01-30 00:00:00",
                    os.path.join(tmp_dir, "ck"), os.path.join(tmp_dir, "prog"))
    cur = sorted((r.ID, r.NAME, r.SKEY) for r in dim.read_current().collect())
    hist = [(r.ID, r.NAME, r.CURFLG) for r in dim.read_history().collect()]
    assert cur == [(1, "a2", 3), (2, "b", 2)] and hist == [(1, "a", "N")]
    assert dim.read().count() == 3
