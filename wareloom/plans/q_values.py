"""Bound queries: values and rows at the edges - loads that map some columns, several current versions, rows without a code,
formulas that fail on a row, times with fractions, very small and very large numbers, resuming among repeated keys."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..functions import formulas as fx
from ..operators import catalogue as CT
from ..operators import columns as P
from ..operators import incremental as INC
from ..operators import merge as M
from ..operators import runlog as R
from ..sources import readers as RD
from ..sources import sinks as SK
from . import runlog_tables as RT
from .registry import query
from .tables import TS, portable, table


def _stock(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_partkey % 3 <> 0")
    return p.select("p_partkey", "p_name", F.col("p_brand").alias("note"), F.col("p_size").cast("int").alias("p_size"))


@query("upsert_unmapped", """
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'new ' || p_name ELSE p_name END AS p_name,
       CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS note,
       CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS INTEGER) + 1 ELSE CAST(p_size AS INTEGER) END AS p_size
FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 2 = 0""")
def upsert_unmapped(spark, sf_dir):
    """LD-3: the file has no ``note``: rows that are updated keep theirs, new rows have none."""
    file = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(
        F.col("p_partkey").alias("P_PARTKEY"), F.concat(F.lit("new "), "p_name").alias("P_Name"), (F.col("p_size") + 1).cast("string").alias("P_SIZE"))
    return M.load(file.withColumnRenamed("P_PARTKEY", "p_partkey"), _stock(spark, sf_dir), "UPSERT", ["p_partkey"])


def _twice_current(spark, sf_dir):
    """A dimension in which every fourth customer has two current versions; ``rating`` is a column no source maps."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.concat(F.lit("r"), F.col("c_nationkey").cast("string")).alias("rating"))
    d = M.initial_load(c, ["c_custkey"], "2024-01-01 00:00:00", hash_order=["c_custkey", "c_name"]).target
    again = d.where("c_custkey % 4 = 0").withColumn("SKEY", F.col("SKEY") + 1_000_000_000).withColumn("rating", F.lit("second"))
    return d.unionByName(again)


@query("scd2_two_current_unmapped", f"""
WITH c AS (SELECT c_custkey, c_name, 'r' || c_nationkey AS rating, row_number() OVER (ORDER BY c_custkey) AS skey FROM customer),
d AS (SELECT c_custkey, c_name, rating, skey FROM c
      UNION ALL SELECT c_custkey, c_name, 'second', skey + 1000000000 FROM c WHERE c_custkey % 4 = 0),
top AS (SELECT max(skey) AS m FROM d)
SELECT c_custkey, c_name, rating, skey AS SKEY, CASE WHEN c_custkey % 2 = 0 THEN 'N' ELSE 'Y' END AS CURFLG FROM d
UNION ALL
SELECT c_custkey, upper(c_name), rating, m + row_number() OVER (ORDER BY c_custkey), 'Y' FROM c, top WHERE c_custkey % 2 = 0 AND upper(c_name) <> c_name""")
def scd2_two_current_unmapped(spark, sf_dir):
    """SCD-2 over keys with two current versions: both are closed, one new version follows, with the first one's rating."""
    src = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("c_name"))
    out = M.scd2_merge(src, _twice_current(spark, sf_dir), ["c_custkey"], TS, hash_order=["c_custkey", "c_name"]).target
    return out.select("c_custkey", "c_name", "rating", "SKEY", "CURFLG")


@query("versioned_null_code", """
WITH old AS (SELECT CAST(p_partkey AS VARCHAR) AS code, p_brand AS val, p_partkey AS id FROM part WHERE p_partkey % 2 = 0)
SELECT id, code, val, CASE WHEN id % 3 <> 0 AND id % 6 = 2 THEN 'N' ELSE 'Y' END AS curflg FROM old
UNION ALL
SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY CAST(p_partkey AS VARCHAR)), CAST(p_partkey AS VARCHAR),
       CASE WHEN p_partkey % 6 = 2 THEN 'new' ELSE p_brand END, 'Y'
FROM part WHERE p_partkey % 3 <> 0 AND (p_partkey % 2 = 1 OR p_partkey % 6 = 2)""")
def versioned_null_code(spark, sf_dir):
    """VER-1 run twice over a source whose every third row has no code: such rows make no version, and the second run changes
    nothing."""
    p = table(spark, sf_dir, "part")
    code = F.col("p_partkey").cast("string")
    tgt = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), code.alias("code"), F.col("p_brand").alias("val"), F.lit("Y").alias("curflg"),
                                              F.lit(None).cast("timestamp_ntz").alias("reccrdt"), F.lit(None).cast("timestamp_ntz").alias("recupdt"))
    src = p.select(F.when(F.col("p_partkey") % 3 != 0, code).alias("code"),
                   F.when(F.col("p_partkey") % 6 == 2, F.lit("new")).otherwise(F.col("p_brand")).alias("val"))
    once = M.versioned_upsert(src, tgt, "code", ["val"], TS)
    from ..session import cut_lineage
    return M.versioned_upsert(src, cut_lineage(once, "versions"), "code", ["val"], TS).select("id", "code", "val", "curflg")


@query("formula_errors", """
SELECT p_partkey, coalesce(TRY_CAST(CASE WHEN p_partkey % 5 = 0 THEN 'abc' ELSE CAST(p_size AS VARCHAR) END AS INTEGER) + 1, -1) AS next_size,
       TRY_CAST(CASE WHEN p_partkey % 5 = 0 THEN 'abc' ELSE CAST(p_size AS VARCHAR) END AS INTEGER) + 1 AS plain,
       CASE WHEN p_size % 4 <> 0 THEN p_partkey // (p_size % 4) END AS per, CASE WHEN p_partkey = 0 THEN 9223372036854775807 END AS huge
FROM part""")
def formula_errors(spark, sf_dir):
    """PRJ-4: a formula that fails on a row (``int('abc')``, division by zero, an overflow) gives the default, else NULL; the row
    goes on."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.when(F.col("p_partkey") % 5 == 0, F.lit("abc")).otherwise(F.col("p_size").cast("string")).alias("txt"))
    out = P.derive(p, {"next_size": lambda d: F.col("txt").cast("int") + 1, "plain": F.expr("int(txt) + 1"), "per": F.expr("p_partkey div (p_size % 4)"),
                       "huge": fx.plus(F.lit(9223372036854775807), "p_partkey")}, {"next_size": -1})
    return out.select("p_partkey", "next_size", "plain", "per", "huge")


@query("formula_errors_file", """
SELECT CAST(p_partkey AS VARCHAR) AS part_id, coalesce(TRY_CAST(CASE WHEN p_partkey % 5 = 0 THEN 'abc' ELSE CAST(p_size AS VARCHAR) END AS INTEGER) * 2, 7) AS doubled FROM part""")
def formula_errors_file(spark, sf_dir):
    """PRJ-4 in the file load: the transform of a whole file survives formulas that fail."""
    from ..types import ColumnSpec
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("ID"),
                                            F.when(F.col("p_partkey") % 5 == 0, F.lit("abc")).otherwise(F.col("p_size").cast("string")).alias("SIZE"))
    return P.transform_file(p, [ColumnSpec("part_id", "String20", "ID"),
                                ColumnSpec("doubled", "INTEGER", "SIZE", formula=lambda c: c["SIZE"].cast("int") * 2, default=7)])


@query("coalesce_mixed", """
SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) END, p_name) AS first_text,
       coalesce(CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) END, CAST(p_partkey AS VARCHAR)) AS first_number FROM part""")
def coalesce_mixed(spark, sf_dir):
    """FN-2 by its catalogue name over columns of different types."""
    p = table(spark, sf_dir, "part")
    big = F.when(F.col("p_size") > 25, F.col("p_size").cast("long"))
    return p.select("p_partkey", fx.call("COALESCE", big, F.col("p_name")).alias("first_text"), fx.call("coalesce", big, "p_partkey").alias("first_number"))


@query("portable_values", """
SELECT event_id, CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS at_time,
       CAST(value AS DOUBLE) AS seconds, 'v' || strftime(ts, '%Y-%m-%d') AS in_map, CAST(event_id % 30 AS BIGINT) AS months FROM events""")
def portable_values(spark, sf_dir):
    """PRJ-8: microseconds stay in times, intervals of any kind are whole lengths, values inside maps are portable too."""
    e = table(spark, sf_dir, "events")
    x = e.select("event_id", F.col("ts").alias("at_time"), F.expr("make_dt_interval(0, 0, 0, cast(value as decimal(18,6)))").cast("interval second").alias("seconds"),
                 F.create_map(F.col("event_id"), F.to_date("ts")).alias("m"), F.expr("make_ym_interval(0, int(event_id % 30))").alias("months"))
    y = P.json_safe(x)
    return y.select("event_id", "at_time", "seconds", F.concat(F.lit("v"), y["m"][F.col("event_id").cast("string")]).alias("in_map"), "months")


@query("json_fractions", """
SELECT event_id, CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS ts FROM events""")
def json_fractions(spark, sf_dir):
    """SNK-4 -> SRC-2: the text of a time comes back with its fraction of a second."""
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    return RD.read_json_flat(spark, SK.write_report(e, "JSON", SK.scratch_dir(spark, "json-times"))).select("event_id", "ts")


@query("profile_extremes", """
SELECT 'x' AS table_name, * FROM (VALUES
  ('tiny', 'decimal', NULL::BIGINT, 0::BIGINT, (12 + (SELECT max(p_size % 3) FROM part))::BIGINT, 'DECIMAL(' || (12 + (SELECT max(p_size % 3) FROM part)) || ',' || (12 + (SELECT max(p_size % 3) FROM part)) || ')'),
  ('large', 'decimal', NULL, 31, 0, 'DECIMAL(31,0)'), ('huge', 'decimal', NULL, 301, 0, 'DOUBLE'),
  ('exact', 'decimal', NULL, 0, 20, 'DECIMAL(20,20)'), ('least', 'integer', NULL, 19, 0, 'DECIMAL(38,0)'),
  ('nothing', 'decimal', NULL, 0, 0, 'DECIMAL(1,0)')) v(column_name, family, max_length, int_digits, scale, code)""")
def profile_extremes(spark, sf_dir):
    """TY-8 over very small, very large and missing numbers."""
    p = table(spark, sf_dir, "part")
    x = p.select(F.expr("double('1e-' || string(12 + p_size % 3))").alias("tiny"), F.lit(1e30).alias("large"), F.lit(-1e300).alias("huge"),
                 F.expr("cast('0.00000000000000000001' as decimal(38,20))").alias("exact"), F.expr("bigint('-9223372036854775808')").alias("least"),
                 F.when(F.col("p_partkey") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(0.0)).alias("nothing"))
    return CT.profile_types(x, "x")


@query("job_log_pages", """
WITH x AS (SELECT event_type AS job_name, event_id, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS s FROM events)
SELECT job_name, CAST((s - 1) // 50 + 1 AS BIGINT) AS page, count(*) AS entries, list(event_id ORDER BY s) AS log_ids, list(s ORDER BY s) AS positions
FROM x GROUP BY 1, 2""")
def job_log_pages(spark, sf_dir):
    """AG-9 nested: one row per job and page of 50 log rows, newest first."""
    out = R.job_log_nested(RT.log(spark, sf_dir), 50)
    return out.select("job_name", "page", F.size("log").cast("long").alias("entries"), F.col("log.joblogid").alias("log_ids"), F.col("log.log_seq").alias("positions"))


@query("resume_rows_repeated", """
SELECT l_shipdate, l_linenumber, count(*) AS n FROM (
  SELECT l_shipdate, l_linenumber, row_number() OVER (ORDER BY l_shipdate, l_linenumber) AS rn FROM lineitem) x WHERE rn > 4000 GROUP BY 1, 2""")
def resume_rows_repeated(spark, sf_dir):
    """INC-3 where several rows share the key of the last row that is skipped: exactly 4,000 go."""
    rest = INC.resume_after_rows(table(spark, sf_dir, "lineitem"), 4000, ["l_shipdate", "l_linenumber"])
    return rest.groupBy("l_shipdate", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
