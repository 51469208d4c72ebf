"""Bound queries: records that cross lines and file splits, any number of excess fields, quoted headers (SRC-1, SRC-2, SRC-7)."""

from __future__ import annotations

import os
from contextlib import contextmanager

from pyspark.sql import functions as F

from ..sources import readers as RD
from ..sources import sinks as SK
from .registry import query
from .tables import table


def _write_files(spark, name, key, header, line):
    """Text files, as many as a quarter of the shuffle partitions, that each begin with the header; lines may hold line breaks."""
    buckets = max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")) // 4)
    body = line.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(-1).cast("long").alias("k"), F.lit(header).alias("value"))
    rows = line.select(F.pmod(F.hash(key), F.lit(buckets)).alias("bucket"), F.col(key).cast("long").alias("k"), "value")
    path = os.path.join(SK.scratch_dir(spark, name), "in.csv")
    rows.unionByName(body).repartition(buckets, "bucket").sortWithinPartitions("bucket", "k").select("bucket", "value").write.partitionBy("bucket").text(path)
    return path


SPLIT_KEY, LEAST_SPLIT, SPLITS = "spark.sql.files.maxPartitionBytes", 4096, 4


@contextmanager
def _many_splits(spark, path):
    """Records cross the splits: files are cut into about ``SPLITS`` splits a shuffle partition, of ``LEAST_SPLIT`` bytes or more. The
    number of tasks does not grow with the input until the splits reach the size the session sets."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    before = spark.conf.get(SPLIT_KEY)
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)
    wanted = size // (SPLITS * int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    spark.conf.set(SPLIT_KEY, str(min(max(LEAST_SPLIT, wanted), max(LEAST_SPLIT, most))))
    try:
        yield
    finally:
        spark.conf.set(SPLIT_KEY, before)


def _quoted(spark, sf_dir, name):
    """``part`` as delimited files: every third name holds a line break, a separator and a quote, every 13th line twelve empty fields
    and a value too many."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    hard = F.concat(F.lit('"'), F.col("p_name"), F.lit(',\n""'), F.col("p_brand"), F.lit('"", 5"" wide"'))
    line = F.concat_ws(",", k.cast("string"), F.when(k % 3 == 0, hard).otherwise(F.col("p_name")), F.col("p_size").cast("string"))
    line = F.when(k % 13 == 0, F.concat(line, F.lit("," * 13 + "lost"))).otherwise(line)
    return _write_files(spark, name, "p_partkey", "p_partkey,p_name,p_name", p.select("p_partkey", line.alias("value")))


_NAME = """CASE WHEN p_partkey % 3 = 0 THEN p_name || ',' || chr(10) || '"' || p_brand || '", 5" wide' ELSE p_name END"""


@query("read_quoted_breaks", f"""
SELECT p_partkey, {_NAME} AS p_name, CAST(p_size AS VARCHAR) AS p_size FROM part WHERE p_partkey % 13 <> 0""")
def read_quoted_breaks(spark, sf_dir):
    """SRC-1: quoted line breaks, separators and quotes, over files cut into many splits; a repeated header name is numbered."""
    path = _quoted(spark, sf_dir, "quoted")
    with _many_splits(spark, path):
        rows = RD.read_delimited(spark, path)
        return rows.select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name", F.col("`p_name.1`").alias("p_size"))


@query("read_quoted_rejects", f"""
SELECT CAST(p_partkey AS VARCHAR) || ',' || CASE WHEN p_partkey % 3 = 0 THEN '"' || p_name || ',' || chr(10) || '""' || p_brand || '"", 5"" wide"' ELSE p_name END
       || ',' || CAST(p_size AS VARCHAR) || ',,,,,,,,,,,,,lost' AS line FROM part WHERE p_partkey % 13 = 0""")
def read_quoted_rejects(spark, sf_dir):
    """SRC-1: a value behind any number of empty excess fields puts the whole record aside."""
    return RD.read_delimited_checked(spark, _quoted(spark, sf_dir, "quoted-long"))[1]


@query("header_quoted", """
SELECT p_partkey AS "key, of part", p_name AS name FROM part WHERE p_partkey % 4 <> 0""")
def header_quoted(spark, sf_dir):
    """SRC-7: the title line of every file skipped, a header with a quoted separator, lines that are too long set aside."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    line = F.concat(k.cast("string"), F.lit(',"'), F.col("p_name"), F.when(k % 4 == 0, F.lit('",x')).otherwise(F.lit('"')))
    path = _write_files(spark, "header-quoted", "p_partkey", 'Parts\n"key, of part",name', p.select("p_partkey", line.alias("value")))
    lines = RD.numbered_lines(spark, path)
    rows = RD.parse_lines(RD.skip_rows(lines, 1, 0), sep=",")
    return rows.select(F.col("`key, of part`").cast("long").alias("key, of part"), "name")


@query("json_array_split", """
SELECT p_partkey AS "key", p_name || ' }{ "[" \\' AS "attrs.name", p_brand AS "attrs.deep.brand", [CAST(p_size AS BIGINT), 7] AS sizes FROM part""")
def json_array_split(spark, sf_dir):
    """SRC-2: array files - objects nested, brackets, quotes and backslashes inside texts, over several lines - cut into splits."""
    p = table(spark, sf_dir, "part")
    buckets = max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")) // 4)
    text = F.to_json(F.struct(F.col("p_partkey").alias("key"), F.struct(F.concat("p_name", F.lit(' }{ "[" \\')).alias("name"),
                                                                          F.struct(F.col("p_brand").alias("brand")).alias("deep")).alias("attrs"),
                              F.array("p_size", F.lit(7)).alias("sizes")))
    body = p.select(F.pmod(F.hash("p_partkey"), F.lit(buckets)).alias("bucket"), F.concat(F.col("p_partkey").cast("string")).alias("k"), text.alias("t"))
    first = body.groupBy("bucket").agg(F.min("k").alias("first"), F.max("k").alias("last"))
    lines = body.join(first, "bucket").select("bucket", "k", F.concat(F.when(F.col("k") == F.col("first"), "[").otherwise(", "), F.replace("t", F.lit(',"sizes"'), F.lit(',\n "sizes"')),
                                                                      F.when(F.col("k") == F.col("last"), "]").otherwise("")).alias("value"))
    path = SK.scratch_dir(spark, "json-array")
    lines.repartition(buckets, "bucket").sortWithinPartitions("bucket", "k").select("bucket", "value").write.partitionBy("bucket").text(path)
    with _many_splits(spark, path):
        return RD.read_json_flat(spark, path)
