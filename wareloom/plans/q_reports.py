"""Bound queries: reports, widgets, windows, top-k, set operations (RP-*, WD-*, WN-*, ST-*, UN-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as RP
from ..operators import sets as S
from ..operators import windows as W
from ..operators.keys import slices as number_slices
from . import runlog_tables as RT
from .registry import query
from .tables import table


def views(spark, sf_dir, names):
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


_DETAIL = [
    RP.Field(fieldName="l_orderkey", sourceColumn="l_orderkey", orderBySeq=1),
    RP.Field(fieldName="net", fieldAlias="Net Price", inlineFormula="l_extendedprice * (1 - l_discount)",
             orderBySeq=2, orderByDir="DESC"),
    RP.Field(sourceColumn="l_returnflag"),
    RP.Field(fieldName="nothing"),
    RP.Field(fieldName="summary", panelType="SUMMARY", inlineFormula="count(*)"),
]


@query("report_detail", """
SELECT l_orderkey AS l_orderkey, l_extendedprice * (1 - l_discount) AS "Net Price", l_returnflag AS COLUMN_3
FROM lineitem ORDER BY 1, 2 DESC""")
def report_detail(spark, sf_dir):
    """RP-1 / PRJ-9 / RP-3: DETAIL fields, alias rules, ordering by sequence."""
    return RP.report(table(spark, sf_dir, "lineitem"), _DETAIL)


_GROUPED = [
    RP.Field(fieldName="flag", sourceColumn="l_returnflag", isGroupBy=True, orderBySeq=1),
    RP.Field(fieldName="status", sourceColumn="l_linestatus", isGroupBy=True, orderBySeq=2),
    RP.Field(fieldName="sum_qty", inlineFormula="sum(l_quantity)"),
    RP.Field(fieldName="sum_price", inlineFormula="CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)"),
    RP.Field(fieldName="count_order", inlineFormula="count(*)"),
    RP.Field(fieldName="max_ship", inlineFormula="max(l_shipdate)"),
]


@query("report_grouped", """
SELECT l_returnflag AS flag, l_linestatus AS status, sum(l_quantity) AS sum_qty,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price, count(*) AS count_order,
       max(l_shipdate) AS max_ship
FROM lineitem GROUP BY l_returnflag, l_linestatus ORDER BY 1, 2""")
def report_grouped(spark, sf_dir):
    """RP-2 / RP-4: grouped report; non-grouped fields carry aggregate formulas."""
    return RP.report(table(spark, sf_dir, "lineitem"), _GROUPED)


_LIMITED = [
    RP.Field(fieldName="o_orderkey", sourceColumn="o_orderkey", orderBySeq=2),
    RP.Field(fieldName="o_custkey", sourceColumn="o_custkey"),
    RP.Field(fieldName="o_totalprice", sourceColumn="o_totalprice", orderBySeq=1, orderByDir="desc"),
    RP.Field(fieldName="o_orderdate", sourceColumn="o_orderdate"),
]


@query("report_limit", """
SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders
ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000""")
def report_limit(spark, sf_dir):
    """RP-5: preview of 5000 requested rows clamped to 1000 (top-N by the report order)."""
    return RP.report(table(spark, sf_dir, "orders"), _LIMITED, limit=5000)


@query("describe", """
WITH n AS (SELECT count(*) AS result_rows FROM (SELECT l_returnflag FROM lineitem GROUP BY l_returnflag) g)
SELECT position, name, type, precision, scale, nullable, result_rows
FROM (VALUES (1, 'l_returnflag', 'string', CAST(NULL AS INTEGER), CAST(NULL AS INTEGER), true),
             (2, 'qty', 'double', NULL, NULL, true),
             (3, 'top_price', 'decimal(12,2)', 12, 2, true),
             (4, 'last_ship', 'timestamp_ntz', NULL, NULL, true)) d(position, name, type, precision, scale, nullable), n""")
def describe(spark, sf_dir):
    """RP-6: names and types of a report query (analysis only) plus its result row count; the
    oracle states the schema the query text implies and counts the result in DuckDB."""
    views(spark, sf_dir, ["lineitem"])
    return RP.describe_query(spark, """SELECT l_returnflag, sum(l_quantity) AS qty,
        CAST(max(l_extendedprice) AS DECIMAL(12,2)) AS top_price, max(l_shipdate) AS last_ship
        FROM lineitem GROUP BY l_returnflag""", count_rows=True)


_RUNS_SQL = """(SELECT event_id AS run_id, user_id % 10 AS report_id, ts AS run_at,
  CASE event_id % 3 WHEN 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status FROM events)"""


@query("run_history", f"SELECT * FROM {_RUNS_SQL} r ORDER BY run_id DESC LIMIT 25")
def run_history(spark, sf_dir):
    """RP-8: the latest 25 report runs by run id."""
    e = table(spark, sf_dir, "events")
    runs = e.select(F.col("event_id").alias("run_id"), (F.col("user_id") % 10).alias("report_id"),
                    F.col("ts").alias("run_at"),
                    F.when(F.col("event_id") % 3 == 0, "FAILED").otherwise("SUCCESS").alias("status"))
    return RP.list_runs(runs, 25)


_SCHED_SQL = """(SELECT event_id AS schedule_id, user_id % 40 AS report_id,
  CASE event_id % 4 WHEN 0 THEN 'INACTIVE' WHEN 1 THEN 'PAUSED' ELSE 'ACTIVE' END AS status FROM events)"""


@query("definitions_latest", f"""
WITH s AS {_SCHED_SQL},
d AS (SELECT user_id % 40 AS report_id, 'Report ' || CAST(user_id % 40 AS VARCHAR) AS report_name, min(ts) AS created
      FROM events GROUP BY 1, 2)
SELECT d.report_id, d.report_name, d.created, COALESCE(c.cnt, 0) AS active_count,
       l.schedule_id AS latest_schedule_id, l.status AS latest_status
FROM d LEFT JOIN (SELECT report_id, count(*) AS cnt FROM s WHERE upper(status) = 'ACTIVE' GROUP BY 1) c
       ON c.report_id = d.report_id
LEFT JOIN (SELECT report_id, schedule_id, status FROM s WHERE upper(status) <> 'INACTIVE'
           QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY schedule_id DESC) = 1) l
       ON l.report_id = d.report_id""")
def definitions_latest(spark, sf_dir):
    """RP-9 + WN-3 + JN-6: report definitions with the latest live schedule and active count."""
    e = table(spark, sf_dir, "events")
    rid = (F.col("user_id") % 40).alias("report_id")
    defs = e.groupBy(rid).agg(F.min("ts").alias("created")).select(
        "report_id", F.concat(F.lit("Report "), F.col("report_id").cast("string")).alias("report_name"), "created")
    d = F.col("event_id") % 4
    scheds = e.select(F.col("event_id").alias("schedule_id"), rid,
                      F.when(d == 0, "INACTIVE").when(d == 1, "PAUSED").otherwise("ACTIVE").alias("status"))
    out = RP.list_reports(defs, scheds)
    return out.select("report_id", "report_name", "created", "active_count", "latest_schedule_id", "latest_status")


_WIDGET_SQL = """SELECT o_custkey, count(*) AS orders, sum(o_totalprice) AS total FROM orders
GROUP BY o_custkey ORDER BY orders DESC, o_custkey"""
_SERIES_SQL = """(SELECT substring(CAST(o_custkey AS VARCHAR), 1, 24) AS label, CAST(count(*) AS DOUBLE) AS value
FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey LIMIT 20)"""


def _series(spark, sf_dir):
    return RP.widget_series(_widget_query(spark, sf_dir))


def _widget_query(spark, sf_dir):
    views(spark, sf_dir, ["orders"])
    return spark.sql(_WIDGET_SQL)


_WHOLE_SQL = """(SELECT substring(CAST(o_custkey AS VARCHAR), 1, 24) AS label, CAST(count(*) AS DOUBLE) AS value
FROM orders GROUP BY o_custkey)"""


@query("widget_series", f"SELECT * FROM {_SERIES_SQL} s")
def widget_series(spark, sf_dir):
    """WD-2: chart series = label column + first numeric column, first 20 rows."""
    return _series(spark, sf_dir)


@query("widget_kpi", f"SELECT sum(value) AS kpi FROM {_WHOLE_SQL} s")
def widget_kpi(spark, sf_dir):
    """WD-3: KPI = sum over the whole query."""
    return RP.widget_kpi(RP.widget_series(_widget_query(spark, sf_dir), None))


@query("widget_share", f"SELECT label, value, value / sum(value) OVER () AS share FROM {_WHOLE_SQL} s")
def widget_share(spark, sf_dir):
    """WD-4: share of the whole query's total per row."""
    return RP.widget_share(RP.widget_series(_widget_query(spark, sf_dir), None))


@query("preferred_row", """
SELECT * FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey
                           ORDER BY CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END, o_orderkey) = 1""")
def preferred_row(spark, sf_dir):
    """WN-1: per customer the open order if any (smallest key among equals), as an aggregate."""
    return W.preferred_row(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderstatus") == "O", ["o_orderkey"])


@query("slices", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn,
       CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 1000) AS BIGINT) AS slice_id
FROM orders""")
def slices(spark, sf_dir):
    """WN-2: numbered slices of 1000 rows in key order (distributed numbering)."""
    return number_slices(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 1000)


@query("topk_per_group", """
SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice,
       row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey DESC, l_linenumber DESC) AS "rank"
FROM lineitem
QUALIFY "rank" <= 5""")
def topk_per_group(spark, sf_dir):
    """WN-4: five best rows per part (partial WindowGroupLimit before the shuffle)."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return W.top_k(li, "l_partkey", [F.col("l_extendedprice").desc(), F.col("l_orderkey").desc(),
                                     F.col("l_linenumber").desc()], 5)


@query("latest_running", f"""
SELECT * FROM {RT.PROC_SQL} p WHERE status = 'IP'
QUALIFY row_number() OVER (PARTITION BY mapref ORDER BY strtdt DESC, prcid DESC) = 1""")
def latest_running(spark, sf_dir):
    """WN-5: most recent running row of every job."""
    p = RT.proc(spark, sf_dir)
    return W.latest_per_group(p.filter(F.col("status") == "IP"), "mapref", ["strtdt", "prcid"])


@query("union_parts", """
SELECT c_custkey AS party_key, c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal,
       c_mktsegment AS segment FROM customer
UNION ALL
SELECT s_suppkey, s_name, s_nationkey, s_acctbal, NULL FROM supplier""")
def union_parts(spark, sf_dir):
    """UN-1: union by name; the supplier part has no segment."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("party_key"), F.col("c_name").alias("name"),
                                                F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal"),
                                                F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("acctbal"), F.col("s_name").alias("name"),
                                                F.col("s_suppkey").alias("party_key"), F.col("s_nationkey").alias("nationkey"))
    return S.union_parts(c, s)


@query("distinct_rows", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def distinct_rows(spark, sf_dir):
    """UN-2"""
    return S.distinct_rows(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"])


@query("key_difference", """
SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def key_difference(spark, sf_dir):
    """UN-3: ordering customers that are not among the customers in credit."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").filter(F.col("c_acctbal") > 0)
    return S.key_difference(o, c, "o_custkey", "c_custkey")
