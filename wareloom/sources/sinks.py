"""Writers, export, manifest and versioned snapshot tables (SNK-1 … SNK-8).

Every writer is a Spark data source write (one file per task); nothing is collected.
``SnapshotTable`` gives merges an atomic "write a new version, then point to it" so a job
never overwrites the directory it reads from, and a re-run of the same version id is a no-op.
"""

from __future__ import annotations

import os
import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.columns import json_safe
from ..session import cut_lineage, ensure_checkpoint_dir
from ..types import ColumnSpec, schema_from_spec
from ..session import local_rows

FORMATS = ("CSV", "TXT", "JSON", "XML", "PARQUET")
EXTENSIONS = {"CSV": "csv", "TXT": "txt", "JSON": "json", "XML": "xml", "PARQUET": "parquet"}


def scratch_dir(spark: SparkSession, name: str = "scratch") -> str:
    """A fresh folder under the shared checkpoint folder (never a machine-local temp dir)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "wareloom", f"{name}-{uuid.uuid4().hex[:12]}")


# Audit columns every file-load table gets when its spec lacks them (name, type code).
DEFAULT_AUDIT = [("CRTDBY", "String100"), ("CRTDDT", "Timestamp"), ("UPDTBY", "String100"), ("UPDTDT", "Timestamp")]
AUDIT_KIND = {"CRTDBY": "CREATED_BY", "CRTDDT": "CREATED_DATE", "UPDTBY": "UPDATED_BY", "UPDTDT": "UPDATED_DATE"}


def create_table(spark: SparkSession, path: str, spec: list[ColumnSpec], kind: str | None = None,
                 add_audit: bool = True) -> DataFrame:
    """SNK-1: empty table with the declared types (regular columns first, audit last); the
    standard audit columns missing from the spec are appended; mapped targets (``kind``) get
    the system columns instead."""
    spec = list(spec)
    if add_audit and not kind:
        have = {c.target.upper() for c in spec}
        spec += [ColumnSpec(n, t, audit=AUDIT_KIND[n]) for n, t in DEFAULT_AUDIT if n not in have]
    schema = schema_from_spec(spec)
    if kind:
        from ..operators.merge import target_schema
        schema = target_schema(schema, kind)
    df = local_rows(spark, [], schema)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _xml_names(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(re.sub(r"\s", "_", c)) for c in df.columns])


def write_report(df: DataFrame, fmt: str, path: str, mode: str = "overwrite") -> str:
    """SNK-2 CSV (header), SNK-3 TXT (``|``, NULL as empty), SNK-4 JSON (ISO dates, decimals as
    numbers), SNK-5 XML (``<Report><Row>``, blanks in names -> ``_``, NULL -> empty), SNK-6 Parquet."""
    f = fmt.upper()
    if f == "CSV":
        df.write.mode(mode).option("header", "true").option("escape", '"').csv(path)      # a quote in a value is doubled
    elif f == "TXT":
        df.write.mode(mode).option("header", "true").option("sep", "|").option("nullValue", "") \
          .option("emptyValue", "").option("escape", '"').csv(path)
    elif f == "JSON":
        json_safe(df).write.mode(mode).option("ignoreNullFields", "false").json(path)
    elif f == "XML":
        _xml_names(df).write.mode(mode).format("xml").option("rootTag", "Report").option("rowTag", "Row") \
            .option("nullValue", "").save(path)
    elif f == "PARQUET":
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"unknown format {fmt}")
    return path


def export(df: DataFrame, formats: list[str] | None, out_dir: str) -> dict[str, str]:
    """SNK-7: formats upper-cased and de-duplicated in order (default CSV); the rows
    are computed once (a table in the shared folder) and written once per format."""
    seen = []
    for f in formats or ["CSV"]:
        u = str(f).strip().upper()
        if u and u not in seen:
            seen.append(u)
    rows = cut_lineage(df, "export") if len(seen) > 1 else df
    return {f: write_report(rows, f, os.path.join(out_dir, EXTENSIONS.get(f, f.lower()))) for f in seen}


def manifest(spark: SparkSession, out_dir: str) -> DataFrame:
    """SNK-8: every data file below ``out_dir``: format, relative path, byte size, SHA-256.
    Each file is hashed by its own task (Spark writes one part file per task)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(out_dir)
    files = files.filter(~F.element_at(F.split("path", "/"), -1).rlike(r"^[._]"))
    root = out_dir.rstrip("/")
    rel = F.regexp_replace(F.col("path"), r"^.*?" + re.escape(root.split("://")[-1]) + "/", "")
    fmt = F.upper(F.split(rel, "/").getItem(0))
    return files.select(fmt.alias("format"), rel.alias("relative_path"), F.col("length").alias("bytes"),
                        F.sha2(F.col("content"), 256).alias("sha256"))


class SnapshotTable:
    """A table kept as numbered versions ``root/v=<id>``; a small JSON log names the committed
    versions. Readers take the latest committed version; writers never touch it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = f"{self.root}/_log"

    def versions(self) -> DataFrame:
        try:
            return self.spark.read.schema("version long, committed_at string").json(self.log)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":    # unreadable is not the same as absent
                raise
            return local_rows(self.spark, [], "version long, committed_at string")

    def latest_version(self) -> int | None:
        r = self.versions().agg(F.max("version").alias("v")).first()
        return r["v"] if r else None

    def has_version(self, version: int) -> bool:
        return self.versions().filter(F.col("version") == version).limit(1).count() > 0

    def read(self, version: int | None = None) -> DataFrame:
        v = self.latest_version() if version is None else version
        if v is None:
            raise FileNotFoundError(f"no committed version under {self.root}")
        return self.spark.read.parquet(f"{self.root}/v={v}")

    def write(self, df: DataFrame, version: int) -> None:
        """The rows of a version, which nobody reads before it is recorded."""
        df.write.mode("overwrite").parquet(f"{self.root}/v={version}")

    def record(self, version: int, committed_at: str = "") -> None:
        local_rows(self.spark, [(int(version), committed_at)], "version long, committed_at string") \
            .coalesce(1).write.mode("append").json(self.log)

    def commit(self, df: DataFrame, version: int, committed_at: str = "") -> bool:
        """Write version ``version`` and record it; returns False when it was committed before
        (idempotent re-run of a stream batch)."""
        if self.has_version(version):
            return False
        self.write(df, version)
        self.record(version, committed_at)
        return True


class DimensionTable:
    """A type-2 dimension kept as *current rows* (a ``SnapshotTable``, replaced per run) plus
    *history* (closed rows, append-only under ``history/v=<version>``).

    A merge then rewrites only the current rows and appends the rows it closed; history, which
    grows with every run, is never rewritten. Readers see history up to the latest committed
    version only, so a run that failed between its two writes is invisible and re-runnable.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.current = SnapshotTable(spark, f"{self.root}/current")
        self.history_dir = f"{self.root}/history"

    def read_current(self) -> DataFrame:
        return self.current.read()

    def read_history(self) -> DataFrame:
        v = self.current.latest_version()
        cur = self.current.read()
        try:
            h = self.spark.read.schema(cur.schema.add("v", "long")).parquet(self.history_dir)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return cur.limit(0)                         # no history yet
        return h.filter(F.col("v") <= F.lit(v)).drop("v")

    def read(self) -> DataFrame:
        return self.read_history().unionByName(self.read_current())

    def next_key(self, col: str = "SKEY") -> int:
        """First free surrogate key over current and history (footer aggregates where possible)."""
        m = [self.read_current().agg(F.max(col).alias("m")).first()["m"],
             self.read_history().agg(F.max(col).alias("m")).first()["m"]]
        return max([x for x in m if x is not None] or [0]) + 1

    def commit(self, rows: DataFrame, version: int) -> bool:
        """``rows`` = new current rows + rows closed by this run (``include_history=False`` merge)."""
        if self.current.has_version(version):
            return False
        closed = rows.filter(~(F.col("CURFLG") == F.lit("Y")) | F.col("CURFLG").isNull())
        closed.write.mode("overwrite").parquet(f"{self.history_dir}/v={version}")
        return self.current.commit(rows.filter(F.col("CURFLG") == F.lit("Y")), version)
