"""Bound queries: streaming ingest and streaming merge (SS-*).

The source tables arrive in parts as files in a fresh folder under the shared checkpoint folder; the
stream is restarted from its checkpoint after each arrival. The streamed result must equal the
batch result.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..functions.scalars import ts_lit
from ..operators import merge as M
from ..sources.sinks import DimensionTable, SnapshotTable, scratch_dir
from ..streaming import ingest as SS
from .q_merges import KEYS, _TGT_SQL, _money, customer_dimension, sql_scd
from .registry import query
from .tables import CUSTOMER_COLS, SQL_CUSTOMER_CHANGES, TS, customer_changes, portable, sql_hash, table

ARRIVALS = 4     # how often new files arrive, whatever the table's size


def arrivals(df, part, path: str, run) -> None:
    """Write the rows of each arrival (``part`` = 0, 1, ...; all its tasks write files) and run the stream after each: every
    run starts from the checkpoint the last one left and finds one micro-batch."""
    for n in range(ARRIVALS):
        df.where(part == n).write.mode("append").parquet(path)
        run()


def _events_mapped(df):
    return df.select(F.col("event_id").alias("evt_id"), F.upper("event_type").alias("evt_type"),
                     F.col("ts").alias("evt_ts"), F.col("value").cast("decimal(18,2)").alias("amount"),
                     F.lit("STREAM").alias("CRTDBY"), ts_lit(TS).alias("CRTDDT"))


_EVENTS_SQL = f"""
SELECT event_id AS evt_id, upper(event_type) AS evt_type, ts AS evt_ts, CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS amount,
       'STREAM' AS CRTDBY, TIMESTAMP '{TS}' AS CRTDDT FROM events"""


@query("stream_ingest", _EVENTS_SQL)
def stream_ingest(spark, sf_dir):
    """SS-1: event files streamed, mapped and appended."""
    return _ingest_events(spark, sf_dir, "append")


def _ingest_events(spark, sf_dir, mode, deliveries=1):
    root = scratch_dir(spark, "stream-ingest")
    src, out, events = os.path.join(root, "in"), os.path.join(root, "out"), table(spark, sf_dir, "events")
    arrivals(events, F.col("event_id") % ARRIVALS, src, lambda: SS.ingest_stream(spark, src, events.schema, _events_mapped, out, os.path.join(root, "ckpt"),
                                                               mode=mode, deliveries=deliveries))
    return portable(SS.read_ingested(spark, out))


@query("stream_replay", _EVENTS_SQL)
def stream_replay(spark, sf_dir):
    """SS-3: every micro-batch is delivered twice (a restart before the checkpoint was written) and the stream restarts
    between arrivals; the rows equal the one-shot load."""
    return _ingest_events(spark, sf_dir, "append", deliveries=2)


@query("stream_truncate_load", """
SELECT p_partkey, p_name, p_size FROM part""")
def stream_truncate_load(spark, sf_dir):
    """SS-1 with TRUNCATE_LOAD: the first micro-batch replaces the target's old rows, the later ones add to it (into a versioned
    table, every batch delivered twice); equals the one-shot load."""
    root = scratch_dir(spark, "stream-truncate")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    src, target = os.path.join(root, "in"), SnapshotTable(spark, os.path.join(root, "target"))
    target.commit(rows.withColumn("p_name", F.lit("old")), 0)
    arrivals(rows, F.col("p_partkey") % ARRIVALS, src, lambda: SS.ingest_stream(spark, src, rows.schema, lambda d: d, target, os.path.join(root, "ckpt"),
                                                              mode="TRUNCATE_LOAD", deliveries=2))
    return target.read()


def _run_stream_scd2(spark, sf_dir):
    root = scratch_dir(spark, "stream-scd2")
    src, rows = os.path.join(root, "in"), customer_changes(spark, sf_dir)
    target = DimensionTable(spark, os.path.join(root, "target"))
    target.commit(customer_dimension(spark, sf_dir), 0)
    top = table(spark, sf_dir, "customer").agg(F.max("c_custkey").alias("m")).first()["m"] or 0
    part = F.least(F.lit(ARRIVALS - 1), F.expr(f"c_custkey * {ARRIVALS - 1} div {top + 1}"))   # in key order, new customers last
    arrivals(rows, part, src, lambda: SS.merge_stream(
        spark, SS.file_stream(spark, src, rows.schema), target, KEYS, TS, os.path.join(root, "ckpt"), os.path.join(root, "progress"), deliveries=2))
    return target, os.path.join(root, "progress")


_CH = sql_hash(CUSTOMER_COLS)


@query("stream_scd2", _money(sql_scd(SQL_CUSTOMER_CHANGES, _TGT_SQL, CUSTOMER_COLS, "c_custkey", _CH, 2)))
def stream_scd2(spark, sf_dir):
    """SS-2 / SS-3: change batches merged (type 2) one micro-batch at a time; equals the batch merge."""
    target, _ = _run_stream_scd2(spark, sf_dir)
    return portable(target.read())


@query("stream_progress", f"""
WITH tgt AS ({_TGT_SQL}),
sized AS (SELECT *, {_CH} AS RWHKEY, least({ARRIVALS - 1}, c_custkey * {ARRIVALS - 1} // (SELECT max(c_custkey) + 1 FROM customer)) AS batch_id FROM ({SQL_CUSTOMER_CHANGES}) x),
cls AS (SELECT s.batch_id, t.SKEY IS NULL OR s.RWHKEY <> t.RWHKEY AS ins
        FROM sized s LEFT JOIN tgt t ON s.c_custkey = t.c_custkey AND t.CURFLG = 'Y'),
per AS (SELECT batch_id, count(*) AS source_rows, count(*) FILTER (WHERE ins) AS target_rows, 0 AS error_rows
        FROM cls GROUP BY batch_id)
SELECT batch_id, source_rows, target_rows, CAST(error_rows AS BIGINT) AS error_rows,
       CAST(sum(source_rows) OVER (ORDER BY batch_id) AS BIGINT) AS total_source_rows,
       CAST(sum(target_rows) OVER (ORDER BY batch_id) AS BIGINT) AS total_target_rows
FROM per""")
def stream_progress(spark, sf_dir):
    """SS-4: per-batch source / target / error counts with running totals."""
    _, prog = _run_stream_scd2(spark, sf_dir)
    return SS.progress(spark, prog)


@query("dimension_store_scd2", _money(sql_scd(SQL_CUSTOMER_CHANGES, _TGT_SQL, CUSTOMER_COLS, "c_custkey", _CH, 2)))
def dimension_store_scd2(spark, sf_dir):
    """SCD-2 into a dimension stored as current rows + append-only history: the run rewrites
    only the current rows and appends the rows it closed; read back whole it equals the
    snapshot merge."""
    dim = DimensionTable(spark, os.path.join(scratch_dir(spark, "dimension"), "customer"))
    t0 = customer_dimension(spark, sf_dir)
    dim.commit(t0, 0)
    res = M.scd2_merge(customer_changes(spark, sf_dir), dim.read_current(), KEYS, TS,
                       include_history=False, next_key=dim.next_key())
    dim.commit(res.target, 1)
    return portable(dim.read())


def _upsert_oracle():
    from .registry import ORACLE
    from . import q_merges  # noqa: F401  (registers load_upsert)
    return ORACLE["load_upsert"]


@query("stream_upsert", _upsert_oracle())
def stream_upsert(spark, sf_dir):
    """SS-1 with UPSERT: the incoming part file arriving in parts, every batch
    upserted into the versioned target (the reference switched to INSERT after the first
    chunk); equals the one-shot upsert."""
    from .q_merges import part_incoming, part_target
    root = scratch_dir(spark, "stream-upsert")
    src, rows = os.path.join(root, "in"), part_incoming(spark, sf_dir)
    target = SnapshotTable(spark, os.path.join(root, "target"))
    target.commit(part_target(spark, sf_dir), 0)
    arrivals(rows, F.col("p_partkey") % ARRIVALS, src, lambda: SS.ingest_stream(spark, src, rows.schema, lambda d: d, target, os.path.join(root, "ckpt"),
                                                              mode="UPSERT", keys=["p_partkey"], user="SYSTEM", ts=TS))
    return portable(target.read())
