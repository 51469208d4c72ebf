"""Targets kept in key buckets: a merge reads and rewrites only the buckets its batch touches.

The table is a Spark table bucketed by the business key and partitioned by the same bucket number, so a bucket is a folder:

* its scan has the partitioning of the key: the lookup and the expiry join of a merge move the batch, never the target;
* the buckets a batch touches are known before the target is read (``kb IN (...)`` prunes the folders), and only those
  folders are overwritten (dynamic partition overwrite); a batch of a few keys costs a few buckets whatever the table's size;
* closed versions go to an append-only history folder, one part per batch.

A batch that is delivered again after a crash finds its rows merged and its history part written, and changes nothing; a batch whose
marker is there is not run again. Use at least as many buckets as shuffle partitions, else Spark shuffles both sides."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import local_rows, path_exists

BUCKET = "kb"


class BucketedTable:
    """Current rows of a dimension (or the rows of a fact table) in ``buckets`` key buckets below ``root``."""

    def __init__(self, spark: SparkSession, name: str, root: str, keys: list[str], buckets: int = 64):
        self.spark, self.name, self.root, self.keys, self.buckets = spark, name, root.rstrip("/"), list(keys), buckets
        self.unique = False            # known to have one current row per key (merges keep it so)

    # -------------------------------------------------------------- layout

    def bucket_of(self) -> Column:
        """The bucket Spark itself puts a key into."""
        return F.pmod(F.hash(*[F.col(k) for k in self.keys]), F.lit(self.buckets)).cast("int")

    def create(self, rows: DataFrame) -> None:
        """Write the first rows (those not current go to the history)."""
        current, closed = self._split(rows)
        (current.withColumn(BUCKET, self.bucket_of()).repartition(self.buckets, *self.keys).write.mode("overwrite").format("parquet")
         .partitionBy(BUCKET).bucketBy(self.buckets, *self.keys).sortBy(*self.keys).option("path", f"{self.root}/current").saveAsTable(self.name))
        if closed is not None:
            closed.write.mode("overwrite").parquet(f"{self.root}/history/v=0")
        self.unique = self.is_unique()
        self._mark(0)

    def is_unique(self) -> bool:
        """One current row per key (counted bucket by bucket: no exchange)."""
        return self.read_current().groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()

    def open(self, schema: T.StructType) -> "BucketedTable":
        """Name a table that an earlier session wrote."""
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields if f.name != BUCKET)
        by = ", ".join(f"`{k}`" for k in self.keys)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({cols}, {BUCKET} INT) USING parquet PARTITIONED BY ({BUCKET}) "
                       f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self.root}/current'")
        self.spark.catalog.recoverPartitions(self.name)
        self.unique = self.is_unique()
        return self

    def _split(self, rows: DataFrame):
        if "CURFLG" not in rows.columns:
            return rows, None
        now = F.coalesce(F.col("CURFLG") == "Y", F.lit(False))
        return rows.where(now), rows.where(~now)

    # -------------------------------------------------------------- reading

    def touched(self, batch: DataFrame) -> list[int]:
        """Buckets a batch has keys in (at most ``buckets`` numbers)."""
        here = batch.dropna(subset=self.keys).select(self.bucket_of().alias(BUCKET)).distinct()
        return sorted(r[BUCKET] for r in here.collect())

    def read_current(self, only: list[int] | None = None) -> DataFrame:
        t = self.spark.table(self.name)
        if only is not None:
            t = t.where(F.col(BUCKET).isin(only) if only else F.lit(False))
        return t.drop(BUCKET)

    def read_touched(self, batch: DataFrame) -> DataFrame:
        return self.read_current(self.touched(batch))

    def read_history(self) -> DataFrame:
        cur = self.read_current()
        try:
            h = self.spark.read.schema(cur.schema.add("v", "long")).parquet(f"{self.root}/history")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return cur.limit(0)
        return h.drop("v")

    def read(self) -> DataFrame:
        return self.read_current().unionByName(self.read_history())

    def next_key(self, col: str = "SKEY") -> int:
        m = [t.agg(F.max(col).alias("m")).first()["m"] for t in (self.read_current(), self.read_history())]
        return max([x for x in m if x is not None] or [0]) + 1

    # -------------------------------------------------------------- writing

    def has_version(self, version: int) -> bool:
        return path_exists(self.spark, f"{self.root}/batches/v={version}/_SUCCESS")

    def _mark(self, version: int) -> None:
        local_rows(self.spark, [(int(version),)], "version long").coalesce(1).write.mode("overwrite").json(f"{self.root}/batches/v={version}")

    def commit(self, rows: DataFrame, version: int) -> bool:
        """``rows``: the new rows of the touched buckets and the rows closed by this run (``scd_merge(..., include_history=False)``
        over ``read_touched``). Their buckets are replaced, all others stay as they are."""
        if self.has_version(version):
            return False
        current, closed = self._split(rows)
        part = f"{self.root}/history/v={version}"
        if closed is not None and not path_exists(self.spark, f"{part}/_SUCCESS"):     # written before a crash: it has all rows
            closed.write.mode("overwrite").parquet(part)
        key = "spark.sql.sources.partitionOverwriteMode"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, "dynamic")
        try:
            columns = [c for c in self.spark.table(self.name).columns if c != BUCKET]
            current.select(*columns, self.bucket_of().alias(BUCKET)).write.mode("overwrite").insertInto(self.name)
        finally:
            self.spark.conf.set(key, before)
        self._mark(version)
        return True
