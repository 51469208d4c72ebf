"""Bound queries: file round trips through the writers and readers (SRC-*, SNK-*).

Each query writes ``part`` (all rows) to a fresh folder under the shared checkpoint folder,
reads it back with the matching reader, restores the declared types and returns the table;
the oracle is the table itself.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.columns import cast_to_spec
from ..sources import readers as RD
from ..sources import sinks as SK
from .registry import query
from .tables import table

PART_TYPES = {"p_partkey": T.LongType(), "p_name": T.StringType(), "p_brand": T.StringType(),
              "p_type": T.StringType(), "p_size": T.IntegerType(), "p_retailprice": T.DoubleType()}
PART_SQL = "SELECT * FROM part"


def _typed(df):
    return cast_to_spec(df, PART_TYPES).select(*PART_TYPES)


@query("roundtrip_csv", PART_SQL)
def roundtrip_csv(spark, sf_dir):
    """SNK-2 -> SRC-1 (sniffed ``,``) -> PRJ-7."""
    out = SK.write_report(table(spark, sf_dir, "part"), "CSV", SK.scratch_dir(spark, "csv"))
    return _typed(RD.read_delimited(spark, out))


@query("roundtrip_txt", PART_SQL)
def roundtrip_txt(spark, sf_dir):
    """SNK-3 (``|``-separated) -> SRC-1 (sniffed ``|``)."""
    out = SK.write_report(table(spark, sf_dir, "part"), "TXT", SK.scratch_dir(spark, "txt"))
    return _typed(RD.read_delimited(spark, out, null_value=""))


@query("roundtrip_json", """
SELECT p_partkey AS "key", p_name AS "attrs.name", p_brand AS "attrs.brand", p_type AS "attrs.type",
       CAST(p_size AS BIGINT) AS size, p_retailprice AS price FROM part""")
def roundtrip_json(spark, sf_dir):
    """SNK-4 with a nested object -> SRC-2 (JSON lines, flattened to dotted names)."""
    p = table(spark, sf_dir, "part")
    nested = p.select(F.col("p_partkey").alias("key"),
                      F.struct(F.col("p_name").alias("name"), F.col("p_brand").alias("brand"),
                               F.col("p_type").alias("type")).alias("attrs"),
                      F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    out = SK.write_report(nested, "JSON", SK.scratch_dir(spark, "json"))
    return RD.read_json_flat(spark, out)


@query("roundtrip_xml", PART_SQL)
def roundtrip_xml(spark, sf_dir):
    """SNK-5 (``<Report><Row>``) -> SRC-5 row-tag detection -> SRC-4."""
    out = SK.write_report(table(spark, sf_dir, "part"), "XML", SK.scratch_dir(spark, "xml"))
    return _typed(RD.read_xml(spark, out))


@query("roundtrip_parquet", "SELECT p_partkey, p_name, p_retailprice FROM part")
def roundtrip_parquet(spark, sf_dir):
    """SNK-6 -> SRC-3 with a column subset (pruned at the scan)."""
    out = SK.write_report(table(spark, sf_dir, "part"), "PARQUET", SK.scratch_dir(spark, "parquet"))
    return RD.read_parquet(spark, out, ["p_partkey", "p_name", "p_retailprice"])


MIN_BUCKETS = 4


def write_report_text(spark, df, path, buckets: int | None = None):
    """Report-style text files, one per bucket: title and rule lines, CSV header, rows,
    ``Total:`` and ``Page`` lines. Rows are spread over buckets by key hash; every file is
    written by one task in section order."""
    # one file per bucket, as many buckets as shuffle partitions: the work grows across tasks
    buckets = buckets or max(MIN_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    cols = df.columns
    body = df.select(F.pmod(F.hash(F.col(cols[0])), F.lit(buckets)).alias("bucket"), F.lit(1).alias("section"),
                     F.col(cols[0]).cast("string").alias("sk"),
                     F.concat_ws(",", *[F.col(c).cast("string") for c in cols]).alias("value"))
    counts = body.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    head = counts.select("bucket", F.explode(F.array(
        F.struct(F.lit(0).alias("section"), F.lit("0").alias("sk"), F.lit("PART REPORT").alias("value")),
        F.struct(F.lit(0).alias("section"), F.lit("1").alias("sk"), F.lit("=" * 40).alias("value")),
        F.struct(F.lit(0).alias("section"), F.lit("2").alias("sk"), F.lit(",".join(cols)).alias("value")),
        F.struct(F.lit(2).alias("section"), F.lit("0").alias("sk"),
                 F.concat(F.lit("Total: "), F.col("n").cast("string")).alias("value")),
        F.struct(F.lit(2).alias("section"), F.lit("1").alias("sk"),
                 F.concat(F.lit("Page "), (F.col("bucket") + 1).cast("string")).alias("value")))).alias("r")) \
        .select("bucket", "r.section", "r.sk", "r.value")
    lines = body.unionByName(head).repartition(buckets, "bucket") \
                .sortWithinPartitions("bucket", "section", F.length("sk"), "sk")
    lines.select("bucket", "value").write.mode("overwrite").partitionBy("bucket").text(path)
    return path


@query("header_footer", PART_SQL)
def header_footer(spark, sf_dir):
    """SRC-7: two header and two footer lines dropped per file (line numbers per file from the
    split offsets), then the CSV header line names the columns."""
    path = write_report_text(spark, table(spark, sf_dir, "part"), SK.scratch_dir(spark, "report"))
    lines = RD.skip_rows(RD.numbered_lines(spark, path), header=2, footer=2)
    return _typed(RD.parse_lines(lines, sep=","))


@query("header_footer_pattern", PART_SQL)
def header_footer_pattern(spark, sf_dir):
    """SRC-8: title / rule lines and total / page lines dropped by pattern."""
    path = write_report_text(spark, table(spark, sf_dir, "part"), SK.scratch_dir(spark, "report"))
    lines = RD.skip_matching(RD.numbered_lines(spark, path), r"^(PART REPORT|=+)$", r"^(Total: \d+|Page \d+)$")
    return _typed(RD.parse_lines(lines, sep=","))


@query("manifest", """
SELECT f.format, f.folder, (SELECT count(*) FROM part) AS row_count, true AS all_hashed
FROM (VALUES ('CSV', 'csv'), ('JSON', 'json'), ('PARQUET', 'parquet')) AS f (format, folder)""")
def manifest(spark, sf_dir):
    """SNK-7 + SNK-8: export in CSV, json, csv (duplicate dropped) and PARQUET; per format the folder of its manifest rows,
    the rows read back from exactly the listed files, and whether every file has size and hash."""
    d = SK.scratch_dir(spark, "export")
    SK.export(table(spark, sf_dir, "part"), ["CSV", "json", "csv", "PARQUET"], d)
    files = SK.manifest(spark, d)
    per = files.groupBy("format").agg(F.min(F.split("relative_path", "/")[0]).alias("folder"),
                                      F.bool_and((F.length("sha256") == 64) & (F.col("bytes") > 0)).alias("all_hashed"),
                                      F.sort_array(F.collect_set("relative_path")).alias("_paths"))
    readers = {"CSV": lambda p: spark.read.option("header", "true").csv(p), "JSON": lambda p: spark.read.json(p), "PARQUET": lambda p: spark.read.parquet(p)}
    parts = []
    for fmt, read in readers.items():
        rows = read(os.path.join(d, fmt.lower())).select(F.col("_metadata.file_name").alias("name"))
        listed = files.where(F.col("format") == fmt).select(F.element_at(F.split("relative_path", "/"), -1).alias("name"))
        parts.append(rows.join(listed, "name", "left_semi").agg(F.count(F.lit(1)).alias("row_count")).withColumn("format", F.lit(fmt)))
    counts = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return per.join(counts, "format").select("format", "folder", "row_count", "all_hashed")


@query("table_info", """
SELECT count(*) AS row_count, 6 AS column_count,
       ['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice'] AS columns FROM part""")
def table_info(spark, sf_dir):
    """SRC-12: row count, column count, column names."""
    return RD.table_info(table(spark, sf_dir, "part"))


@query("preview", "SELECT * FROM part ORDER BY p_partkey LIMIT 10")
def preview(spark, sf_dir):
    """SRC-11: first 10 rows in key order."""
    return RD.preview(table(spark, sf_dir, "part").orderBy("p_partkey"), 10)


@query("sql_source_params", "SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 40 AND p_type <> 'SMALL'")
def sql_source_params(spark, sf_dir):
    """SRC-9: a SQL source with named parameters bound at run time."""
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    return RD.sql_source(spark, "SELECT p_partkey, p_name, p_size FROM part WHERE p_size > :min_size AND p_type <> :t",
                         {"min_size": 40, "t": "SMALL"})


@query("read_any_routing", PART_SQL)
def read_any_routing(spark, sf_dir):
    """SRC-6 / UD-2: the reader is chosen by the file extension (.tsv -> delimited, tab sniffed);
    extensions can be registered with ``readers.register_reader``."""
    d = SK.scratch_dir(spark, "routing")
    path = os.path.join(d, "part.tsv")
    table(spark, sf_dir, "part").write.option("header", "true").option("sep", "\t").csv(path)
    return _typed(RD.read_any(spark, path))
