"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "wareloom",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE on, the UI off and UTC as session time zone.

    On a cluster ``master`` stays ``None`` so the launcher decides; tests pass ``local[*]``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
        # MAX(SKEY) and similar answered from Parquet footers where the scan allows it
        "spark.sql.parquet.aggregatePushdown": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def cluster_settings(input_bytes: int, cores: int) -> dict:
    """Settings for a large cluster, derived from the bytes a job reads and the cores it has.

    Scan splits of 512 MB keep the task count of a 100 TB scan near 200k; the initial shuffle
    partition count is sized so a shuffle partition starts near 256 MB (AQE then merges small
    ones and splits skewed ones); broadcasts stay limited to 64 MB measured at run time."""
    mb = 1024 * 1024
    parts = max(2 * cores, input_bytes // (256 * mb) + 1)
    return {
        "spark.sql.files.maxPartitionBytes": str(512 * mb),
        "spark.sql.shuffle.partitions": str(int(parts)),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * mb),
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": str(64 * mb),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * mb),
        "spark.sql.autoBroadcastJoinThreshold": str(10 * mb),
    }


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins. Only a local session without one gets a scratch folder; on a
    cluster a machine-local folder would not be seen by the other machines, so that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir and not sc.master.startswith("local") or sc.master.startswith("local-cluster") and not conf_dir:
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not conf_dir:
        conf_dir = tempfile.mkdtemp(prefix="wareloom-ckpt-", dir=os.environ.get("WARELOOM_SCRATCH", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


_scratch: ContextVar[tuple] = ContextVar("wareloom_scratch", default=())    # lists of paths, innermost block last


@contextmanager
def scratch_tables(spark: SparkSession):
    """Stage tables that ``cut_lineage`` writes inside the block are deleted when it ends, so a job's disk does not grow with
    the number of its steps. What is needed afterwards is stored with ``cut_lineage(..., keep=True)``: it belongs to the
    enclosing block, or stays when there is none. Frames over deleted tables must not be used after the block."""
    paths: list[str] = []
    token = _scratch.set((*_scratch.get(), paths))
    try:
        yield
    finally:
        _scratch.reset(token)
        for p in paths:
            delete_path(spark, p)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of the shared folder, through the file system Spark itself uses."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def cut_lineage(df: DataFrame, name: str = "stage", keep: bool = False) -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    The written table is reliable storage (a lost executor re-reads it instead of recomputing
    the lineage), it is columnar (later projections read only the columns they need), and
    everything that depends on row placement is kept in explicit columns, so re-reading it in
    any split layout gives the same result. See ``scratch_tables`` for how long it stays.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, "wareloom-stages", f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    blocks = _scratch.get()[:-1] if keep else _scratch.get()
    if blocks:
        blocks[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def local_rows(spark: SparkSession, rows, schema) -> DataFrame:
    """A small DataFrame of literal rows built JVM-side (no Python worker, no RDD).

    Used for metadata only: per-partition offsets, fixed lookup values, one-row logs."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T
    st = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    rows = list(rows)
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in st.fields])
    # one text literal, not one expression per value: the plan stays small however many rows there are
    plain = all(isinstance(v, (str, int, bool, type(None))) for r in rows for v in r)
    if plain and all(isinstance(f.dataType, (T.StringType, T.LongType, T.IntegerType, T.BooleanType)) for f in st.fields):
        text = json.dumps([dict(zip((f"c{i}" for i in range(len(st))), r)) for r in rows])
        inner = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(st.fields)])
        one = spark.range(1).select(F.explode(F.from_json(F.lit(text), T.ArrayType(inner))).alias("_r"))
        return one.select(*[F.col(f"_r.c{i}").alias(f.name) for i, f in enumerate(st.fields)])
    arr = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, st.fields)])
                    for r in rows])
    return spark.range(1).select(F.explode(arr).alias("_r")).select("_r.*")
