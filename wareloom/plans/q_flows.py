"""Bound queries: whole flows and the remaining single operators.

* ``file_load_flow`` / ``file_load_status``  read -> map -> derive -> default -> stamp -> type
  -> reject -> load into a table created from the spec (§3.2; SNK-1, PRJ-4, PRJ-7, DQ-*, LD-1)
* ``mapping_job_flow``  SQL source with parameters -> resume -> map -> checks -> hash -> SCD-2
  merge -> counters (§3.1; SRC-9, INC-4, PRJ-1, DQ-3, UD-1)
* single operators: FLT-7, INC-4/INC-6, WD-1, WD-5, ST-1, ST-2, RP-7.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import formulas as fx
from ..operators import columns as P
from ..operators import merge as M
from ..operators import quality as Q
from ..operators import reports as RP
from ..operators import windows as W
from ..operators.filters import filter_status
from ..operators.incremental import ResumeState, resume
from ..sources import readers as RD
from ..sources import sinks as SK
from ..types import ColumnSpec
from . import runlog_tables as RT
from .q_columns import _part_file
from .q_merges import _TGT_SQL, KEYS, customer_dimension
from .q_reports import views
from .registry import query
from .tables import CUSTOMER_COLS, TS, portable, sql_hash, table

FILE_SPEC = [
    ColumnSpec("part_id", "BIGINT", "PARTKEY", key_seq=1, required=True),
    ColumnSpec("part_name", "String10", "NAME"),
    ColumnSpec("brand", "String20", "BRAND", default="UNKNOWN"),
    ColumnSpec("part_type", "String20", "TYPE", formula=lambda c: fx.lower(c["TYPE"])),
    ColumnSpec("label", "String50", None, formula=lambda c: fx.concat(c["NAME"], F.lit("/"), c["BRAND"])),
    ColumnSpec("price", "DECIMAL", "PRICE"),
    ColumnSpec("CRTDBY", "String20", audit="CREATED_BY"),
    ColumnSpec("CRTDDT", "TIMESTAMP", audit="CREATED_DATE"),
]


def _file_checked(spark, sf_dir):
    f = _part_file(spark, sf_dir, numbered="rwndx")
    x = P.transform_file(f.withColumnRenamed("rwndx", "_rwndx"), FILE_SPEC + [ColumnSpec("rwndx", "BIGINT", "_rwndx")],
                         None, TS)
    types = {c.target: c.dtype for c in FILE_SPEC}
    rules = (Q.required_rules(["part_id"]) + Q.length_rules({c.target: c.length for c in FILE_SPEC
                                                            if c.length and not c.audit})
             + Q.parse_rules(x, {k: v for k, v in types.items() if not isinstance(v, T.StringType)}))
    ok, bad = Q.validate(x, rules)
    return P.cast_to_spec(ok, types), bad


@query("file_load_flow", f"""
SELECT CAST(p_partkey AS BIGINT) AS part_id, trim('  ' || p_name || ' ') AS part_name,
       COALESCE(NULLIF(trim(CASE WHEN p_size < 10 THEN '' ELSE p_brand END), ''), 'UNKNOWN') AS brand,
       lower(p_type) AS part_type, '  ' || p_name || ' ' || '/' || (CASE WHEN p_size < 10 THEN '' ELSE p_brand END) AS label,
       CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) AS price, 'SYSTEM' AS CRTDBY, TIMESTAMP '{TS}' AS CRTDDT,
       'SYSTEM' AS UPDTBY, TIMESTAMP '{TS}' AS UPDTDT
FROM part WHERE length(p_name) <= 10""")
def file_load_flow(spark, sf_dir):
    """§3.2 end to end: TY-1 spec types, PRJ-4 formulas over the raw row, PRJ-3 defaults, PRJ-6
    audit, PRJ-7 typing, DQ-2/4/5 rejects, SNK-1 table created from the spec (missing audit
    columns appended), LD-1 append with audit columns stamped at load."""
    ok, _ = _file_checked(spark, sf_dir)
    created = SK.create_table(spark, SK.scratch_dir(spark, "created"), [c for c in FILE_SPEC])
    loaded = M.load(ok.drop("rwndx"), created, "INSERT", user="SYSTEM", ts=TS)   # audit stamped at load
    return portable(loaded)


@query("file_load_status", """
WITH n AS (SELECT *, row_number() OVER (ORDER BY p_partkey) AS rwndx FROM part)
SELECT count(*) AS rows_processed, count(*) FILTER (WHERE length(p_name) <= 10) AS rows_successful,
       count(*) FILTER (WHERE length(p_name) > 10) AS rows_failed,
       CASE WHEN count(*) FILTER (WHERE length(p_name) > 10) = 0 THEN 'SUCCESS'
            WHEN count(*) FILTER (WHERE length(p_name) <= 10) = 0 THEN 'FAILED' ELSE 'PARTIAL' END AS status,
       arg_min(CASE WHEN length(p_name) > 10
                    THEN 'length of part_name exceeds 10: ' || CAST(length(p_name) AS VARCHAR) END,
               CASE WHEN length(p_name) > 10 THEN rwndx END) AS message
FROM n""")
def file_load_status(spark, sf_dir):
    """DQ-8 over the file-load flow: counts, status and first error by row index."""
    ok, bad = _file_checked(spark, sf_dir)
    return Q.run_summary(ok, bad)


_MAP_SQL = """SELECT c_custkey AS CUST_ID, c_name, c_nationkey,
  CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 100 ELSE c_acctbal END AS BAL, c_mktsegment
  FROM customer WHERE c_nationkey <> :skip_nation"""
_MAP_SQL_DUCK = _MAP_SQL.replace(":skip_nation", "24")
_CH = sql_hash(CUSTOMER_COLS)


@query("mapping_job_flow", f"""
WITH tgt AS ({_TGT_SQL}),
src0 AS (SELECT CUST_ID AS c_custkey, c_name, c_nationkey, BAL AS c_acctbal, c_mktsegment
         FROM ({_MAP_SQL_DUCK}) q WHERE CUST_ID > 100),
rej AS (SELECT * FROM src0 WHERE TRY_CAST(c_acctbal AS DECIMAL(6,2)) IS NULL),
src AS (SELECT c_custkey, c_name, c_nationkey, CAST(c_acctbal AS DECIMAL(18,2)) AS c_acctbal, c_mktsegment
        FROM src0 WHERE TRY_CAST(c_acctbal AS DECIMAL(6,2)) IS NOT NULL),
cls AS (SELECT s.*, CASE WHEN t.SKEY IS NULL THEN 'NEW' WHEN {_CH.replace('c_', 's.c_')} <> COALESCE(t.RWHKEY, '')
                         THEN 'CHANGED' ELSE 'UNCHANGED' END AS change
        FROM src s LEFT JOIN tgt t ON s.c_custkey = t.c_custkey AND t.CURFLG = 'Y')
SELECT 'source_rows' AS metric, count(*) AS value FROM cls
UNION ALL SELECT 'inserted', count(*) FILTER (WHERE change IN ('NEW', 'CHANGED')) FROM cls
UNION ALL SELECT 'updated', 0
UNION ALL SELECT 'expired', count(*) FILTER (WHERE change = 'CHANGED') FROM cls
UNION ALL SELECT 'unchanged', count(*) FILTER (WHERE change = 'UNCHANGED') FROM cls
UNION ALL SELECT 'new_keys', count(*) FILTER (WHERE change = 'NEW') FROM cls
UNION ALL SELECT 'duplicates', 0
UNION ALL SELECT 'target_rows', count(*) FILTER (WHERE change IN ('NEW', 'CHANGED')) FROM cls
UNION ALL SELECT 'error_rows', 0
UNION ALL SELECT 'rejected_precision', count(*) FROM rej""")
def mapping_job_flow(spark, sf_dir):
    """§3.1 end to end: parameterised SQL source, resume after key 100 (AUTO -> KEY), column
    mapping, precision check, user hook, type-2 merge; returns the run counters
    (SRC-9, INC-4, PRJ-1, DQ-3, UD-1, SCD-2, SCD-5)."""
    views(spark, sf_dir, ["customer"])
    src = RD.sql_source(spark, _MAP_SQL, {"skip_nation": 24})
    src = resume(src, ["CUST_ID"], ResumeState("AUTO", "100"))
    mapped = P.map_columns(src, {"c_custkey": "CUST_ID", "c_acctbal": "BAL"}, CUSTOMER_COLS)
    ok, bad = Q.validate(mapped, Q.precision_rules({"c_acctbal": T.DecimalType(6, 2)}))
    ok = ok.withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(18,2)")).transform(lambda d: d)  # UD-1 hook
    res = M.scd2_merge(ok, customer_dimension(spark, sf_dir), KEYS, TS)
    extra = bad.agg(F.count(F.lit(1)).cast("long").alias("value")).select(F.lit("rejected_precision").alias("metric"),
                                                                          "value")
    return res.summary.unionByName(extra)


@query("status_filter", f"SELECT * FROM {RT.PROC_SQL} p WHERE upper(status) IN ('PC', 'FL')")
def status_filter(spark, sf_dir):
    """FLT-7: status in a set, case-insensitive."""
    return filter_status(RT.proc(spark, sf_dir), "status", ["pc", "fl"])


@query("resume_strategy", """
SELECT 'AUTO' AS strategy, count(*) AS rows_read FROM orders WHERE o_orderkey > 7500
UNION ALL SELECT 'ROWS', count(*) FROM (SELECT * FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey) > 500) r
UNION ALL SELECT 'NONE', count(*) FROM orders
UNION ALL SELECT 'COMPLETED', count(*) FROM orders""")
def resume_strategy(spark, sf_dir):
    """INC-4 / INC-6: AUTO with a key resumes after the key, ROWS after a row count, NONE and a
    COMPLETED state read everything."""
    o = table(spark, sf_dir, "orders")
    parts = [("AUTO", resume(o, ["o_orderkey"], ResumeState("AUTO", "7500"))),
             ("ROWS", resume(o, None, ResumeState("ROWS", rows_done=500), order_by=["o_orderkey"])),
             ("NONE", resume(o, ["o_orderkey"], ResumeState("NONE", "7500"))),
             ("COMPLETED", resume(o, ["o_orderkey"], ResumeState("KEY", "7500", status="COMPLETED")))]
    out = None
    for name, df in parts:
        c = df.agg(F.count(F.lit(1)).alias("rows_read")).select(F.lit(name).alias("strategy"), "rows_read")
        out = c if out is None else out.unionByName(c)
    return out


_WIDGET_TABLE_SQL = "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey"


@query("widget_table", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate, o_totalprice FROM orders
ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000""")
def widget_table(spark, sf_dir):
    """WD-1: table widget rows, 5000 requested and clamped to 1000, portable values."""
    views(spark, sf_dir, ["orders"])
    return RP.widget_table(spark, _WIDGET_TABLE_SQL, 5000)


_SEG_SQL = "SELECT c_mktsegment, count(*) AS customers FROM customer GROUP BY c_mktsegment ORDER BY customers DESC, c_mktsegment"


@query("dashboard_datasets", """
WITH s AS (SELECT c_mktsegment AS label, CAST(count(*) AS DOUBLE) AS value FROM customer GROUP BY 1
           ORDER BY value DESC, label LIMIT 20)
SELECT 'segments_bar' AS widget, label, value, CAST(NULL AS DOUBLE) AS share FROM s
UNION ALL SELECT 'segments_pie', label, value, value / sum(value) OVER () FROM s
UNION ALL SELECT 'segments_kpi', NULL, sum(value), NULL FROM s""")
def dashboard_datasets(spark, sf_dir):
    """WD-5: a dashboard of bar, pie and KPI widgets over one query (an empty widget skipped),
    returned as one long frame."""
    views(spark, sf_dir, ["customer"])
    ds = RP.dashboard(spark, [{"widgetName": "segments_bar", "widgetType": "BAR", "adhocSql": _SEG_SQL},
                              {"widgetName": "segments_pie", "widgetType": "PIE", "adhocSql": _SEG_SQL},
                              {"widgetName": "segments_kpi", "widgetType": "KPI", "adhocSql": _SEG_SQL},
                              {"widgetName": "empty", "widgetType": "BAR", "adhocSql": "  "}])
    bar = ds["segments_bar"].select(F.lit("segments_bar").alias("widget"), "label", "value",
                                    F.lit(None).cast("double").alias("share"))
    pie = ds["segments_pie"].select(F.lit("segments_pie").alias("widget"), "label", "value", "share")
    kpi = ds["segments_kpi"].select(F.lit("segments_kpi").alias("widget"), F.lit(None).cast("string").alias("label"),
                                    F.col("kpi").alias("value"), F.lit(None).cast("double").alias("share"))
    return bar.unionByName(pie).unionByName(kpi)


_NL = "CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_acctbal END"


@query("order_nulls_last", f"""
SELECT c_custkey, {_NL} AS bal FROM customer ORDER BY bal DESC NULLS LAST, c_custkey DESC""")
def order_nulls_last(spark, sf_dir):
    """ST-1: descending with NULLs last, the whole table."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_NL).alias("bal"))
    return W.order_nulls_last(c, ["bal", "c_custkey"])


@query("top_n", f"SELECT * FROM {RT.REQ_SQL} r ORDER BY requested_at DESC, request_id LIMIT 10")
def top_n(spark, sf_dir):
    """ST-2: the ten latest requests (TakeOrderedAndProject)."""
    return W.top_n(RT.requests(spark, sf_dir), [F.col("requested_at").desc(), F.col("request_id")], 10)


@query("report_snapshot", """
SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000""")
def report_snapshot(spark, sf_dir):
    """RP-7: a preview stored as a snapshot and read back."""
    from .q_reports import _LIMITED
    prev = RP.report(table(spark, sf_dir, "orders"), _LIMITED, limit=5000)
    path = RP.snapshot(prev, SK.scratch_dir(spark, "snapshot"))
    return spark.read.parquet(path)


@query("mapping_errors", f"""
SELECT 'TARGET_LOA' AS errtyp,
       'value of c_acctbal exceeds decimal(6,2): ' || CAST(BAL AS VARCHAR) AS errmsg, 'OVERFLOW' AS dberrmsg,
       CAST(CUST_ID AS VARCHAR) || '|' || CAST(c_nationkey AS VARCHAR) AS keyvalue
FROM ({_MAP_SQL_DUCK}) q WHERE CUST_ID > 100 AND TRY_CAST(BAL AS DECIMAL(6,2)) IS NULL""")
def mapping_errors(spark, sf_dir):
    """DQ-7: error records of the mapping flow's precision rejects (type bounded to 10
    characters, message 1000, database message 4000, key value 1000)."""
    views(spark, sf_dir, ["customer"])
    src = resume(RD.sql_source(spark, _MAP_SQL, {"skip_nation": 24}), ["CUST_ID"], ResumeState("AUTO", "100"))
    mapped = P.map_columns(src, {"c_custkey": "CUST_ID", "c_acctbal": "BAL"}, CUSTOMER_COLS)
    _, bad = Q.validate(mapped, Q.precision_rules({"c_acctbal": T.DecimalType(6, 2)}))
    return Q.mapping_error_rows(bad, ["c_custkey", "c_nationkey"])
