"""Bound queries: merges into targets kept in key buckets (SCD-1, SCD-2, SCD-4, SS-2)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import merge as M
from ..sources.buckets import BUCKET, BucketedTable
from ..sources.sinks import scratch_dir
from ..streaming import ingest as SS
from .q_merges import KEYS, customer_dimension
from .q_stream import ARRIVALS, arrivals
from .registry import ORACLE, query
from .tables import TS, customer_changes, portable, table


def _bucketed(spark, sf_dir, keys, rows, name):
    buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    t = BucketedTable(spark, f"wl_{name}_{uuid.uuid4().hex[:10]}", os.path.join(scratch_dir(spark, "buckets"), name), keys, buckets)
    t.create(rows)
    return t


def _merge(t, batch, scd_type, version, **how):
    res = M.scd_merge(batch, t.read_touched(batch), t.keys, TS, scd_type=scd_type, include_history=False, next_key=t.next_key(), unique_target=t.unique, **how)
    t.commit(res.target, version)
    return res


@query("scd2_bucketed", ORACLE["scd2_customer"])
def scd2_bucketed(spark, sf_dir):
    """SCD-2 into a bucketed dimension: bucket scans meet the batch, touched buckets are rewritten; equals the snapshot merge."""
    t = _bucketed(spark, sf_dir, KEYS, customer_dimension(spark, sf_dir), "customer")
    _merge(t, customer_changes(spark, sf_dir), 2, 1)
    return portable(t.read())


@query("scd1_bucketed", ORACLE["scd1_customer"])
def scd1_bucketed(spark, sf_dir):
    """SCD-1 into a bucketed dimension."""
    t = _bucketed(spark, sf_dir, KEYS, customer_dimension(spark, sf_dir), "customer")
    _merge(t, customer_changes(spark, sf_dir), 1, 1)
    return portable(t.read())


@query("fact_bucketed", """
SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, row_number() OVER (ORDER BY o_orderkey) AS SKEY FROM orders""")
def fact_bucketed(spark, sf_dir):
    """SCD-4: a batch of every fiftieth order overwritten by key in a bucketed fact table."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    t = _bucketed(spark, sf_dir, ["o_orderkey"], M.initial_load(o, ["o_orderkey"], "2024-01-01 00:00:00", kind=M.FCT).target, "orders")
    _merge(t, o.where("o_orderkey % 50 = 0").withColumn("o_orderstatus", F.lit("X")), 1, 1, kind=M.FCT)
    return t.read().select("o_orderkey", "o_orderstatus", "SKEY")


@query("bucketed_touched", """
SELECT true AS only_touched_rewritten, true AS few_buckets, (SELECT count(*) FROM orders) AS row_count, (SELECT count(*) FROM orders WHERE o_orderkey < 2) AS changed""")
def bucketed_touched(spark, sf_dir):
    """SS-2 / SCD-4: a batch of two keys replaces the files of their buckets and of no other."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    t = _bucketed(spark, sf_dir, ["o_orderkey"], M.initial_load(o, ["o_orderkey"], "2024-01-01 00:00:00", kind=M.FCT).target, "orders")

    def files():
        here = spark.table(t.name).select(BUCKET, F.col("_metadata.file_path").alias("f"))
        return {(r[BUCKET], r["f"]) for r in here.distinct().collect()}
    before, batch = files(), o.where("o_orderkey < 2").withColumn("o_orderstatus", F.lit("changed"))
    touched = t.touched(batch)
    _merge(t, batch, 1, 1, kind=M.FCT)
    replaced = {b for b, _ in files() ^ before}
    return t.read().agg(F.lit(replaced == set(touched)).alias("only_touched_rewritten"), F.lit(len(touched) <= 2).alias("few_buckets"),
                        F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("o_orderstatus") == "changed").alias("changed"))


def _stream(spark, sf_dir):
    rows = customer_changes(spark, sf_dir)
    root = scratch_dir(spark, "stream-buckets")
    t = _bucketed(spark, sf_dir, KEYS, customer_dimension(spark, sf_dir), "customer")
    top = table(spark, sf_dir, "customer").agg(F.max("c_custkey").alias("m")).first()["m"] or 0
    part = F.least(F.lit(ARRIVALS - 1), F.expr(f"c_custkey * {ARRIVALS - 1} div {top + 1}"))   # in key order, new customers last
    arrivals(rows, part, os.path.join(root, "in"), lambda: SS.merge_stream(
        spark, SS.file_stream(spark, os.path.join(root, "in"), rows.schema), t, KEYS, TS, os.path.join(root, "ckpt"), os.path.join(root, "progress"), deliveries=2))
    return t, os.path.join(root, "progress")


@query("stream_scd2_bucketed", ORACLE["stream_scd2"])
def stream_scd2_bucketed(spark, sf_dir):
    """SS-2 / SS-3: micro-batches, each delivered twice, merged into a bucketed dimension."""
    return portable(_stream(spark, sf_dir)[0].read())


@query("stream_progress_bucketed", ORACLE["stream_progress"])
def stream_progress_bucketed(spark, sf_dir):
    """SS-4: a batch that is delivered twice counts once."""
    return SS.progress(spark, _stream(spark, sf_dir)[1])
