"""Structured Streaming ingest and merge (SS-1 … SS-4).

* ``ingest_stream``  files arriving in a folder, read with an explicit schema and a bounded
  number of files per trigger, transformed with the same column operators as a batch load,
  appended / loaded into a target (SS-1);
* ``merge_stream``   every micro-batch merged (SCD-1 / SCD-2) into a ``SnapshotTable``; the
  batch id is the version id, so a batch re-run after a restart commits nothing twice (SS-2,
  SS-3 via ``checkpointLocation``);
* progress rows (source / target / error counts per batch) are appended to a progress table
  keyed by batch id and read with running totals (SS-4).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import merge as M
from ..sources.buckets import BucketedTable
from ..sources.sinks import DimensionTable, SnapshotTable
from ..session import local_rows, path_exists

PROGRESS_SCHEMA = "batch_id long, source_rows long, target_rows long, error_rows long"


def file_stream(spark: SparkSession, src_dir: str, schema: T.StructType, fmt: str = "parquet", max_bytes: str | None = None,
                options: dict | None = None) -> DataFrame:
    """Files of a folder as a stream. ``max_bytes`` bounds what one micro-batch reads (e.g. ``"64g"``); without it a trigger
    takes every file that is there."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_bytes:
        r = r.option("maxBytesPerTrigger", max_bytes)
    for k, v in (options or {}).items():
        r = r.option(k, v)
    return r.load(src_dir)


def _run(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str, deliveries: int) -> None:
    """Process everything present, then stop. ``deliveries`` > 1 hands every batch over again, as a restart after a crash
    between writing and checkpointing does."""
    def deliver(batch: DataFrame, batch_id: int):
        for _ in range(deliveries):
            on_batch(batch, batch_id)

    (stream.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
           .trigger(availableNow=True).start().awaitTermination())


def ingest_stream(spark: SparkSession, src_dir: str, schema: T.StructType, transform: Callable[[DataFrame], DataFrame],
                  target_dir: str | SnapshotTable, checkpoint: str, fmt: str = "parquet", max_bytes: str | None = None,
                  mode: str = "append", keys: list[str] | None = None, user: str = "SYSTEM", ts=None, deliveries: int = 1) -> None:
    """SS-1: run the stream until every present file is processed (``availableNow``).

    With a folder, batch ``n`` owns ``batch_id=n`` below it and overwrites only that, so a batch that is delivered again
    changes nothing; TRUNCATE_LOAD empties the folder on batch 0 (read it with ``read_ingested``). With a ``SnapshotTable``
    every batch is loaded with the same mode (INSERT / UPSERT / IF_ABSENT) into the latest version and committed as version
    ``batch_id + 1``; TRUNCATE_LOAD replaces the target with the first batch and adds the others to it, like the one-shot load."""
    stream = transform(file_stream(spark, src_dir, schema, fmt, max_bytes))
    mode = mode.upper()

    def load_batch(batch: DataFrame, batch_id: int):
        if isinstance(target_dir, SnapshotTable):
            version = batch_id + 1
            if target_dir.has_version(version):
                return
            how = "INSERT" if mode == "TRUNCATE_LOAD" and batch_id > 0 else mode
            M.load_into(target_dir, batch, version, how, keys=keys, user=user, ts=ts)      # rejected rows and counts beside the table
        elif mode == "TRUNCATE_LOAD" and batch_id == 0:
            batch.withColumn("batch_id", F.lit(0).cast("long")).write.mode("overwrite").partitionBy("batch_id").parquet(target_dir)
        else:
            batch.write.mode("overwrite").parquet(f"{target_dir}/batch_id={batch_id}")

    _run(stream, load_batch, checkpoint, deliveries)


def read_ingested(spark: SparkSession, target_dir: str) -> DataFrame:
    """Rows of all batches of a folder target."""
    return spark.read.parquet(target_dir).drop("batch_id")


def merge_stream(spark: SparkSession, stream: DataFrame, target: SnapshotTable | DimensionTable | BucketedTable, keys: list[str], ts,
                 checkpoint: str, progress_dir: str, scd_type: int = 2, kind: str = M.DIM,
                 order_by: list[str] | None = None, deliveries: int = 1) -> None:
    """SS-2 / SS-3 / SS-4: micro-batches merged into the table, one version per batch. The batch's progress row is written
    under the batch's own folder before the commit: a crash between the two runs the batch again and writes both again. A
    ``BucketedTable`` reads and rewrites only the buckets of the batch's keys; as part of them may be merged already when a batch is
    run again, the progress row of the first run stands."""
    def merge_batch(batch: DataFrame, batch_id: int):
        version = batch_id + 1
        store = target.current if isinstance(target, DimensionTable) else target
        if store.has_version(version):         # already committed before a restart
            return
        if isinstance(target, (DimensionTable, BucketedTable)):  # history stays append-only
            rows = target.read_touched(batch) if isinstance(target, BucketedTable) else target.read_current()
            res = M.scd_merge(batch, rows, keys, ts, scd_type=scd_type, kind=kind,
                              order_by=order_by, include_history=False, next_key=target.next_key(), unique_target=getattr(target, "unique", False))
        else:
            res = M.scd_merge(batch, target.read(), keys, ts, scd_type=scd_type, kind=kind, order_by=order_by)
        run = f"{progress_dir}/run={batch_id}"
        if isinstance(target, BucketedTable) and path_exists(spark, f"{run}/_SUCCESS"):
            target.commit(res.target, version)
            return
        c = res.counters()
        local_rows(spark, [(int(batch_id), int(c.get("source_rows", 0)), int(c.get("target_rows", 0)),
                                int(c.get("error_rows", 0)))], PROGRESS_SCHEMA) \
            .coalesce(1).write.mode("overwrite").parquet(run)
        target.commit(res.target, version)

    _run(stream, merge_batch, checkpoint, deliveries)


def progress(spark: SparkSession, progress_dir: str) -> DataFrame:
    """SS-4: per batch counts with running totals (one small row per batch)."""
    p = spark.read.parquet(progress_dir)
    w = Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, 0)
    return p.select("batch_id", "source_rows", "target_rows", "error_rows",
                    F.sum("source_rows").over(w).alias("total_source_rows"),
                    F.sum("target_rows").over(w).alias("total_target_rows"))
