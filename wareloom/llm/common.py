"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wareloom.session import cut_lineage, ensure_checkpoint_dir, scratch_tables  # noqa: F401  (re-used general helpers)

ROWS_AT_ONCE = 1000
FILE_SHIFT = 40            # row ids: 2^40 rows a file, 2^23 files
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Words: runs of anything but ASCII punctuation, blanks and controls (fixed by the contract).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
A_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of ``ROWS_AT_ONCE`` rows between Spark and Python for tables of whole texts (a setting of the session)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, str(min(ROWS_AT_ONCE, int(spark.conf.get(key, "10000")) or ROWS_AT_ONCE)))


def fields(schema) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def map_columns(df: DataFrame, fn, schema) -> DataFrame:
    """``fn(columns) -> columns`` per Arrow batch; both are dicts of name -> Arrow array or list.

    The output has exactly ``schema``; batches keep row placement, so the step needs no shuffle
    and a lost task is simply run again. Whole texts are long: ``ROWS_AT_ONCE`` rows are taken at a time,
    which bounds what a Python worker holds."""
    out = to_arrow_schema(fields(schema))
    names = df.columns

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                b = whole.slice(start, ROWS_AT_ONCE)
                got = fn({n: b.column(i) for i, n in enumerate(names)})
                yield pa.RecordBatch.from_arrays(
                    [got[f.name] if isinstance(got[f.name], pa.Array) else pa.array(got[f.name], f.type) for f in out],
                    schema=out)

    return df.mapInArrow(run, fields(schema))


def add_columns(df: DataFrame, fn, new) -> DataFrame:
    """Append the columns that ``fn`` computes per Arrow batch; an input column of the same name
    is replaced, everything else passes through untouched."""
    new = fields(new)
    df = df.select(*[c for c in df.columns if c.lower() not in {f.name.lower() for f in new}])
    schema = T.StructType(df.schema.fields + new.fields)
    return map_columns(df, lambda cols: cols | fn(cols), schema)


def small_table(spark: SparkSession, rows, schema) -> DataFrame:
    """Rows the driver holds as a DataFrame. They are handed over as Arrow: a list given to ``createDataFrame`` becomes an RDD that
    starts a second set of Python workers on the executors."""
    schema = fields(schema)
    out = to_arrow_schema(schema)
    columns = list(zip(*rows)) or [()] * len(out)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out), schema)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, A_Z, A_Z.lower())


def remainder(id_column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (NULL for a NULL id)."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % n


def shielded(docs: DataFrame, step) -> DataFrame:
    """``step(docs)`` with every column beside those of ``documents`` under a name no operator uses; the result has the columns of
    ``docs`` under their own names again."""
    hidden = {c: f"_wl_in_{i}" for i, c in enumerate(docs.columns) if c not in DOCUMENT_COLUMNS}
    out = step(docs.withColumnsRenamed(hidden))
    return out.select(*[F.col(f"`{hidden.get(c, c)}`").alias(c) for c in docs.columns])


def with_row_ids(docs: DataFrame, name: str = "rid") -> DataFrame:
    """``docs`` with a row id: the number of the row's file (by path) and its place in the file. Every later read gives the same
    ids, however the files are split, and no text is copied. A frame that is no plain read of files is stored first.

    The numbers of the files are one small row per file, which the driver's own file listing holds too, so they are broadcast."""
    def scan(df):
        return df.select("*", F.col("_metadata.file_path").alias("_wl_path"), F.col("_metadata.row_index").alias("_wl_row"))

    docs = docs.drop(name)
    try:
        rows = scan(docs)
    except AnalysisException:
        rows = scan(cut_lineage(docs, "numbered-rows"))
    files = rows.select("_wl_path").distinct().withColumn("_wl_file", F.row_number().over(Window.orderBy("_wl_path")).cast("long"))
    return (rows.join(F.broadcast(files), "_wl_path")
            .withColumn(name, F.shiftleft("_wl_file", FILE_SHIFT) + F.col("_wl_row")).drop("_wl_path", "_wl_row", "_wl_file"))


def shielded_names(docs: DataFrame, replaced: tuple = ()) -> tuple[DataFrame, list]:
    """``docs`` with every column beside those of ``documents`` under a name no operator uses, and the columns that give the
    rows back under their own names. Columns named in ``replaced`` are left out."""
    docs = docs.drop(*replaced)
    hidden = {c: f"_wl_in_{i}" for i, c in enumerate(docs.columns) if c not in DOCUMENT_COLUMNS}
    return docs.withColumnsRenamed(hidden), [F.col(f"`{hidden.get(c, c)}`").alias(c) for c in docs.columns]
