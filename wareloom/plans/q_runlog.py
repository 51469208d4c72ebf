"""Bound queries: run-log analytics, joins and filters (AG-*, JN-2…13, FLT-3…7, DQ-11, ST-3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as FL
from ..operators import joins as J
from ..operators import quality as Q
from ..operators import runlog as R
from ..operators.keys import number_rows
from . import runlog_tables as RT
from .registry import query
from .tables import TS, table

P, L, E = RT.PROC_SQL, RT.LOG_SQL, RT.ERR_SQL
DUR = "(epoch_us(p.enddt) - epoch_us(p.strtdt))"
RUNS_SQL = f"(SELECT l.*, p.strtdt, p.enddt, p.status, {DUR} AS dur_us FROM {L} l JOIN {P} p " \
           "ON p.sessionid = l.sessionid AND p.prcid = l.prcid)"


# ----------------------------------------------------------------- AG-1 with JN-3

def _maps(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("mapref"), F.lit("Y").alias("curflg"),
                    F.when(F.col("c_acctbal") > 0, "Y").otherwise("N").alias("lgvrfyflg"),
                    F.when(F.col("c_mktsegment") == "BUILDING", "A").otherwise("I").alias("stflg"))


def _jobs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("mapref"), F.col("o_orderkey").alias("jobid"), F.lit("Y").alias("curflg"),
                    F.when(F.col("o_orderstatus") == "O", "A").otherwise("I").alias("stflg"))


def _flows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("jobid"), F.col("l_partkey").alias("jobflwid"),
                     F.when(F.col("l_returnflag") == "R", "N").otherwise("Y").alias("curflg"))


def _scheds(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("jobflwid"), F.when(F.col("p_size") > 25, "Y").otherwise("N").alias("curflg"))


@query("mapping_totals", """
WITH sched AS (SELECT p_partkey, count(*) AS n FROM part WHERE p_size > 25 GROUP BY p_partkey),
flow AS (SELECT l_orderkey, sum(greatest(coalesce(n, 0), 1)) AS rows_below, sum(coalesce(n, 0)) AS scheduled
         FROM lineitem LEFT JOIN sched ON p_partkey = l_partkey WHERE l_returnflag <> 'R' GROUP BY l_orderkey),
job AS (SELECT o_custkey, sum(coalesce(rows_below, 1)) AS all_rows, sum(coalesce(rows_below, 1)) FILTER (WHERE o_orderstatus = 'O') AS open_rows,
               sum(rows_below) AS flow_rows, sum(scheduled) AS scheduled
        FROM orders LEFT JOIN flow ON l_orderkey = o_orderkey GROUP BY o_custkey),
top AS (SELECT c_acctbal > 0 AS verified, c_mktsegment = 'BUILDING' AS active, coalesce(all_rows, 1) AS n, job.*
        FROM customer LEFT JOIN job ON o_custkey = c_custkey)
SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS mapping_rows, CAST(coalesce(sum(n) FILTER (WHERE verified), 0) AS BIGINT) AS verified_rows,
       CAST(coalesce(sum(n) FILTER (WHERE active), 0) AS BIGINT) AS active_rows, CAST(coalesce(sum(all_rows), 0) AS BIGINT) AS job_rows,
       CAST(coalesce(sum(open_rows), 0) AS BIGINT) AS active_job_rows, CAST(coalesce(sum(flow_rows), 0) AS BIGINT) AS flow_rows,
       CAST(coalesce(sum(scheduled), 0) AS BIGINT) AS schedule_rows
FROM top""")
def mapping_totals(spark, sf_dir):
    """AG-1 over JN-3: customer ⟕ orders ⟕ lineitem ⟕ part as mapping → job → flow → schedule."""
    return R.mapping_totals(_maps(spark, sf_dir), _jobs(spark, sf_dir), _flows(spark, sf_dir), _scheds(spark, sf_dir))


# ----------------------------------------------------------------- AG-2 … AG-9

@query("job_overview", f"""
SELECT mapref, count(mapref) AS times_processed,
       CAST(sum(srcrows) AS DOUBLE) / count(srcrows) AS average_src_rows_processed,
       CAST(ceil(CAST(sum(trgrows) AS DOUBLE) / count(trgrows)) AS BIGINT) AS average_trg_rows_processed,
       max(dur_us) / 1e6 AS max_job_duration, min(dur_us) / 1e6 AS min_job_duration
FROM {RUNS_SQL} r GROUP BY mapref""")
def job_overview(spark, sf_dir):
    """AG-2 + JN-2: per job runs, average rows, CEIL of the average (FN-22) and duration extremes."""
    return R.job_overview(RT.log(spark, sf_dir), RT.proc(spark, sf_dir))


@query("rows_per_day", f"""
SELECT mapref, strftime(prcdt, '%Y-%m-%d') AS time_group, CAST(sum(srcrows) AS BIGINT) AS total_srcrows,
       CAST(sum(trgrows) AS BIGINT) AS total_trgrows
FROM {L} l WHERE prcdt >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY 1, 2""")
def rows_per_day(spark, sf_dir):
    """AG-3: source / target rows per job and day over the WEEK period before as_of."""
    return R.rows_per_day(RT.log(spark, sf_dir), "WEEK", TS)


@query("duration_series", f"""
SELECT prcdt, mapref, dur_us / 1e6 AS run_durations FROM {RUNS_SQL} r
WHERE prcdt >= TIMESTAMP '2024-01-01 00:00:00'""")
def duration_series(spark, sf_dir):
    """AG-4: run date and seconds for every run of the MONTH period."""
    return R.duration_series(RT.log(spark, sf_dir), RT.proc(spark, sf_dir), "MONTH", TS)


@query("avg_duration", f"""
SELECT mapref AS job_name, CAST(sum(dur_us) AS DOUBLE) / count(dur_us) / 1e6 AS avg_seconds
FROM {RUNS_SQL} r GROUP BY mapref""")
def avg_duration(spark, sf_dir):
    """AG-5: average run duration per job."""
    return R.avg_duration(RT.log(spark, sf_dir), RT.proc(spark, sf_dir))


@query("success_failed", f"""
SELECT mapref AS job_name_prefix, count(*) FILTER (WHERE status = 'FL') AS failed_count,
       count(*) FILTER (WHERE status = 'PC') AS succeeded_count
FROM {P} p WHERE status IN ('PC', 'FL') GROUP BY mapref""")
def success_failed(spark, sf_dir):
    """AG-6"""
    return R.success_failed(RT.proc(spark, sf_dir))


@query("success_rate", f"""
SELECT ok, failed, CASE WHEN ok + failed > 0 THEN CAST(100.0 AS DOUBLE) * ok / CAST(ok + failed AS DOUBLE)
                        ELSE 0.0 END AS success_rate
FROM (SELECT count(*) FILTER (WHERE status = 'PC') AS ok, count(*) FILTER (WHERE status = 'FL') AS failed
      FROM {P} p) a""")
def success_rate(spark, sf_dir):
    """AG-7"""
    return R.success_rate(RT.proc(spark, sf_dir))


@query("job_stats", f"""
SELECT mapref AS job_name, count(*) AS total_runs,
       count(*) FILTER (WHERE status = 'PC') AS successful_runs, count(*) FILTER (WHERE status = 'FL') AS failed_runs,
       count(*) FILTER (WHERE status = 'IP') AS in_progress_runs, count(*) FILTER (WHERE status = 'ST') AS stopped_runs,
       first(status ORDER BY prcdt DESC, prcid DESC) AS latest_status, max(prcdt) AS last_run_date,
       COALESCE(CAST(sum(CASE WHEN dur_us <> 0 THEN dur_us END) AS DOUBLE)
                / count(CASE WHEN dur_us <> 0 THEN dur_us END) / 1e6, 0.0) AS avg_duration,
       count(*) FILTER (WHERE status = 'FL') > 0 AS has_failed_logs
FROM {RUNS_SQL} r GROUP BY mapref""")
def job_stats(spark, sf_dir):
    """AG-8: per job statistics of the status page."""
    return R.job_stats(R.runs_with_process(RT.log(spark, sf_dir), RT.proc(spark, sf_dir)))


@query("job_log_nested", f"""
SELECT mapref AS job_name, joblogid, prcdt, srcrows, trgrows,
       row_number() OVER (PARTITION BY mapref ORDER BY prcdt DESC, joblogid DESC) AS log_seq
FROM {L} l""")
def job_log_nested(spark, sf_dir):
    """AG-9 as rows: each job's log newest first, numbered without sorting a job in one task."""
    return R.job_log_flat(RT.log(spark, sf_dir))


@query("job_log_null_job", f"""
SELECT job_name, joblogid, prcdt, srcrows, trgrows, row_number() OVER (PARTITION BY job_name ORDER BY prcdt DESC, joblogid DESC) AS log_seq
FROM (SELECT *, CASE WHEN joblogid % 5 <> 0 THEN mapref END AS job_name FROM {L} l) x""")
def job_log_null_job(spark, sf_dir):
    """AG-9 with log rows that name no job: they form a group of their own and none is lost."""
    log = RT.log(spark, sf_dir)
    return R.job_log_flat(log.withColumn("mapref", F.when(F.col("joblogid") % 5 != 0, F.col("mapref"))))


@query("requests_by_type", f"""
WITH open_requests AS (SELECT split_part(mapref, ':', 1) AS prefix, upper(status) AS state FROM {RT.REQ_SQL} r WHERE upper(status) <> 'DONE')
SELECT coalesce(kind, 'JOBS') AS kind, state, count(*) AS requests
FROM open_requests LEFT JOIN (VALUES ('FLUPLD', 'FILE_UPLOAD'), ('REPORT', 'REPORT')) AS k (prefix, kind) USING (prefix)
GROUP BY ALL""")
def requests_by_type(spark, sf_dir):
    """AG-10"""
    return R.requests_by_type(RT.requests(spark, sf_dir))


def _sched_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("jobschid"), F.col("o_custkey").alias("jobflwid"),
                    F.when(F.col("o_orderkey") % 3 == 0, F.lit(None)).otherwise(F.col("o_orderkey") - 1).alias("dpnd_jobschid"),
                    F.when(F.col("o_orderstatus") == "O", "Y").otherwise("N").alias("schflg"),
                    F.col("o_orderpriority").alias("frqcd"), F.col("o_orderdate").alias("strtdt"),
                    F.col("o_orderdate").alias("lst_run_dt"),
                    F.when(F.col("o_orderstatus") == "P", "N").otherwise("Y").alias("curflg"))


SCHED_SQL = """(SELECT o_orderkey AS jobschid, o_custkey AS jobflwid,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey - 1 END AS dpnd_jobschid,
  CASE WHEN o_orderstatus = 'O' THEN 'Y' ELSE 'N' END AS schflg, o_orderpriority AS frqcd, o_orderdate AS strtdt,
  o_orderdate AS lst_run_dt, CASE WHEN o_orderstatus = 'P' THEN 'N' ELSE 'Y' END AS curflg FROM orders)"""


@query("schedule_rollup", f"""
WITH live AS (SELECT s.* FROM {SCHED_SQL} s SEMI JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'AUTOMOBILE') c
              ON c_custkey = s.jobflwid WHERE s.curflg = 'Y'),
enabled AS (SELECT jobflwid, max(frqcd) AS f, max(strtdt) AS d, max(lst_run_dt) AS l FROM live WHERE schflg = 'Y' GROUP BY jobflwid),
every AS (SELECT jobflwid, min(jobschid) AS s, min(dpnd_jobschid) AS p, min(frqcd) AS f, min(strtdt) AS d, max(lst_run_dt) AS l FROM live GROUP BY jobflwid)
SELECT a.jobflwid AS flow, a.s AS first_schedule, a.p AS first_dependency, ifnull(e.f, a.f) AS frqcd, ifnull(e.d, a.d) AS strtdt,
       ifnull(e.l, a.l) AS lst_run_dt, CASE WHEN e.jobflwid IS NULL THEN 'N' ELSE 'Y' END AS enabled
FROM every a LEFT JOIN enabled e ON e.jobflwid = a.jobflwid""")
def schedule_rollup(spark, sf_dir):
    """AG-11: per flow, values of the enabled schedule preferred."""
    c = table(spark, sf_dir, "customer")
    flows = c.select(F.col("c_custkey").alias("jobflwid"),
                     F.when(F.col("c_mktsegment") == "AUTOMOBILE", "N").otherwise("Y").alias("curflg"))
    return R.schedule_rollup(_sched_rows(spark, sf_dir), flows, ["frqcd", "strtdt"], ["lst_run_dt"])


_USAGE_SQL = """(SELECT n.n_nationkey, n.n_name, n.n_regionkey, count(s.s_suppkey) AS usage_count
  FROM nation n LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey GROUP BY 1, 2, 3)"""


@query("usage_counts", f"SELECT n_nationkey, n_name, usage_count FROM {_USAGE_SQL} u")
def usage_counts(spark, sf_dir):
    """AG-12: suppliers per nation including nations without any."""
    return R.usage_counts(table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier"),
                          "n_nationkey", "s_nationkey", "n_name").orderBy(F.col("usage_count").desc())


@query("most_used", f"""
SELECT n_regionkey, count(*) AS items, first(n_name ORDER BY usage_count DESC, n_nationkey ASC) AS most_used
FROM {_USAGE_SQL} u GROUP BY n_regionkey""")
def most_used(spark, sf_dir):
    """AG-13: nations per region and the nation with most suppliers."""
    n = table(spark, sf_dir, "nation")
    u = R.usage_counts(n, table(spark, sf_dir, "supplier"), "n_nationkey", "s_nationkey", "n_name")
    u = u.join(n.select("n_nationkey", "n_regionkey"), "n_nationkey")
    return R.counts_and_top(u, "n_regionkey", "n_name", "usage_count", "n_nationkey")


@query("distinct_concat", """
SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ', ' ORDER BY c_mktsegment) AS "values"
FROM customer GROUP BY c_nationkey""")
def distinct_concat(spark, sf_dir):
    """AG-14: distinct market segments per nation as ordered text."""
    return R.distinct_concat(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment")


@query("part_totals", """
SELECT CAST(sum(rows_processed) AS BIGINT) AS rows_processed, CAST(sum(rows_successful) AS BIGINT) AS rows_successful,
       CAST(sum(rows_failed) AS BIGINT) AS rows_failed,
       count(*) FILTER (WHERE error IS NULL) AS parts_succeeded, count(*) FILTER (WHERE error IS NOT NULL) AS parts_failed
FROM (SELECT user_id AS part_id, sum(event_id % 1000) AS rows_processed, sum(event_id % 900) AS rows_successful,
             sum(event_id % 7) AS rows_failed,
             CASE WHEN count(*) FILTER (WHERE event_id % 10 = 0) > 0 THEN 'failed' END AS error
      FROM events GROUP BY user_id) p""")
def part_totals(spark, sf_dir):
    """AG-15: totals over part results (one part per user)."""
    e = table(spark, sf_dir, "events")
    parts = e.groupBy(F.col("user_id").alias("part_id")).agg(
        F.sum(F.col("event_id") % 1000).alias("rows_processed"), F.sum(F.col("event_id") % 900).alias("rows_successful"),
        F.sum(F.col("event_id") % 7).alias("rows_failed"),
        F.when(F.count_if(F.col("event_id") % 10 == 0) > 0, F.lit("failed")).alias("error"))
    return R.run_totals(parts)


@query("active_check", f"""
SELECT mapref, count(*) AS running_count FROM {P} p
WHERE status IN ('IP', 'CLAIMED') AND strtdt >= TIMESTAMP '2024-01-29 00:00:00' GROUP BY mapref""")
def active_check(spark, sf_dir):
    """AG-16: runs in progress within 24 h before as_of, per job."""
    return R.is_running(RT.proc(spark, sf_dir), TS)


@query("group_keys", """
SELECT l_returnflag || l_linestatus AS mapcmbcd, COALESCE(CASE WHEN l_linestatus = 'F' THEN 2 END, 1) AS scdtyp,
       min(COALESCE(CASE WHEN l_linenumber <= 2 THEN l_linenumber END, 9999)) AS kseq, max(l_linenumber) AS maxexcseq
FROM lineitem GROUP BY 1, 2""")
def group_keys(spark, sf_dir):
    """AG-17: per combination the smallest key sequence and the largest exec sequence."""
    li = table(spark, sf_dir, "lineitem")
    d = li.select(F.concat("l_returnflag", "l_linestatus").alias("mapcmbcd"),
                  F.when(F.col("l_linestatus") == "F", 2).alias("scdtyp"),
                  F.when(F.col("l_linenumber") <= 2, F.col("l_linenumber")).alias("trgkeyseq"),
                  F.col("l_linenumber").alias("excseq"))
    return R.group_order_keys(d)


# ----------------------------------------------------------------- joins

@query("log_with_errors", f"""
SELECT p.prcid, p.mapref, p.status, l.srcrows, l.trgrows, e.errid, e.errmsg || chr(10) || e.dberrmsg AS message
FROM {P} p
LEFT JOIN {L} l ON l.jobid = p.jobid AND l.sessionid = p.sessionid AND l.prcid = p.prcid AND l.mapref = p.mapref
LEFT JOIN {E} e ON e.sessionid = p.sessionid AND e.prcid = p.prcid AND e.mapref = p.mapref AND e.jobid = p.jobid""")
def log_with_errors(spark, sf_dir):
    """JN-4: process log ⟕ job log ⟕ errors on four keys (a failed run fans out to its errors)."""
    from ..functions.scalars import newline_join
    keys = ["jobid", "sessionid", "prcid", "mapref"]
    p = RT.proc(spark, sf_dir)
    lg = RT.log(spark, sf_dir).select(*keys, "srcrows", "trgrows")
    er = RT.errors(spark, sf_dir).select(*keys, "errid", "errmsg", "dberrmsg")
    x = R.log_with_errors(p, lg, er)
    return x.select("prcid", "mapref", "status", "srcrows", "trgrows", "errid",
                    newline_join("errmsg", "dberrmsg").alias("message"))


@query("log_mixed", f"""
SELECT l.joblogid, l.mapref, p.strtdt, p.status, e.errid
FROM {L} l JOIN {P} p ON l.jobid = p.jobid AND l.sessionid = p.sessionid AND l.prcid = p.prcid
LEFT JOIN {E} e ON e.sessionid = p.sessionid AND e.prcid = p.prcid AND e.mapref = p.mapref AND e.jobid = p.jobid""")
def log_mixed(spark, sf_dir):
    """JN-5: job log ⋈ process log ⟕ errors. The run is identified by job, session and process
    id; joining on the job alone would pair every run of a job with every other."""
    p = RT.proc(spark, sf_dir).select("jobid", "sessionid", "prcid", "mapref", "strtdt", "status")
    lg = RT.log(spark, sf_dir).select("joblogid", "jobid", "sessionid", "prcid")
    er = RT.errors(spark, sf_dir).select("sessionid", "prcid", "mapref", "jobid", "errid")
    x = R.job_history(lg, p, er)
    return x.select("joblogid", "mapref", "strtdt", "status", "errid")


@query("scalar_count", """
SELECT c.c_custkey, c.c_name, COALESCE(o.cnt, 0) AS cnt
FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS cnt FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) o
  ON o.o_custkey = c.c_custkey""")
def scalar_count(spark, sf_dir):
    """JN-6: active (open) orders per customer including zero, as aggregate + left join."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    o = table(spark, sf_dir, "orders")
    return J.with_count(c, o, "c_custkey", F.col("o_orderstatus") == "O", child_key="o_custkey")


@query("self_join_children", f"""
SELECT p.jobschid AS parent_id, c.jobschid AS child_id
FROM {SCHED_SQL} p JOIN {SCHED_SQL} c ON c.dpnd_jobschid = p.jobschid
WHERE p.curflg = 'Y' AND c.curflg = 'Y' AND c.schflg = 'Y'""")
def self_join_children(spark, sf_dir):
    """JN-7: enabled current children of every current schedule."""
    s = _sched_rows(spark, sf_dir)
    x = J.children_of(s, "jobschid", "dpnd_jobschid", F.col("schflg") == "Y", F.col("curflg") == "Y")
    return x.select(F.col("p.jobschid").alias("parent_id"), F.col("c.jobschid").alias("child_id"))


_REQ_JOB = "CASE user_id % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'error' WHEN 3 THEN 'purchase' ELSE 'signup' END"


@query("interval_match", f"""
SELECT r.req_id, p.prcid
FROM (SELECT event_id AS req_id, {_REQ_JOB} AS mapref, ts AS req_ts FROM events WHERE event_type = 'signup') r
JOIN {P} p ON p.mapref = r.mapref
 AND p.strtdt BETWEEN r.req_ts - INTERVAL 1 HOUR AND r.req_ts + INTERVAL 1 HOUR
WHERE p.status IN ('IP', 'CLAIMED')""")
def interval_match(spark, sf_dir):
    """JN-9: stop requests matched to running runs of the same job started within ±1 hour."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type") == "signup")
    req = e.select(F.col("event_id").alias("req_id"), F.expr(_REQ_JOB).alias("mapref"), F.col("ts").alias("req_ts"))
    runs = RT.proc(spark, sf_dir).filter(F.col("status").isin("IP", "CLAIMED")).select("prcid", "mapref", "strtdt")
    x = J.match_within(req, runs, "mapref", "req_ts", "strtdt", 3600)
    return x.select("req_id", "prcid")


@query("semi_ids", """
SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def semi_ids(spark, sf_dir):
    """JN-13: orders of the customers in a set (left semi join)."""
    ids = table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == "BUILDING")
    return J.keep_ids(table(spark, sf_dir, "orders"), ids, "o_custkey", "c_custkey")


@query("anti_missing", """
SELECT * FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'O')""")
def anti_missing(spark, sf_dir):
    """JN-8: customers without an open order (left anti join)."""
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "O").select(F.col("o_custkey").alias("c_custkey"))
    return J.missing_keys(c, o, ["c_custkey"])


# ----------------------------------------------------------------- filters and paging

@query("run_filter", f"""
SELECT r.runid, r.flupldref, r.strttm, r.stts, r.ldmde, r.mssg, c.flnm, c.trnctflg
FROM {RT.FILE_RUNS_SQL} r LEFT JOIN {RT.CONFIG_SQL} c ON c.flupldref = r.flupldref
WHERE upper(r.stts) = 'SUCCESS' AND upper(r.ldmde) = 'UPSERT'
  AND (contains(lower(r.flupldref), 'lic') OR contains(lower(r.mssg), 'lic'))
  AND CAST(r.strttm AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'""")
def run_filter(spark, sf_dir):
    """FLT-3 + JN-10: file runs with their load configuration, filtered by status, mode, text
    and an inclusive date range."""
    runs = RT.file_runs(spark, sf_dir)
    cfg = RT.load_config(spark, sf_dir).select("flupldref", "flnm", "trnctflg")
    x = R.runs_with_config(runs, cfg)
    x = FL.filter_runs(x, equals={"stts": "success", "ldmde": "upsert"}, contains=(["flupldref", "mssg"], "LIC"),
                       date_col="strttm", start="2024-01-05", end="2024-01-12")
    return x.select("runid", "flupldref", "strttm", "stts", "ldmde", "mssg", "flnm", "trnctflg")


@query("text_search", """
SELECT * FROM part WHERE contains(upper(p_name), 'RING') OR contains(upper(p_type), 'RING')""")
def text_search(spark, sf_dir):
    """FLT-4: upper-case contains over two columns."""
    return FL.search(table(spark, sf_dir, "part"), ["p_name", "p_type"], "ring")


@query("period_filter", "SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-24 00:00:00'")
def period_filter(spark, sf_dir):
    """FLT-5: the WEEK period before as_of (today and six days back)."""
    return FL.in_period(table(spark, sf_dir, "events"), "ts", "WEEK", TS)


@query("errors_page", """
SELECT rwndx, 'TOO_LONG' AS rrcd, 'length of p_name exceeds 10: ' || CAST(length(p_name) AS VARCHAR) AS rrmssg
FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) AS rwndx FROM part) p
WHERE length(p_name) > 10 ORDER BY rwndx LIMIT 20 OFFSET 10""")
def errors_page(spark, sf_dir):
    """DQ-11 + ST-3: error rows of a run filtered by code and text, second page of 20 (offset 10)."""
    p = number_rows(table(spark, sf_dir, "part"), "p_partkey", col="rwndx")
    _, bad = Q.validate(p, Q.length_rules({"p_name": 10}))
    errs = Q.error_rows(bad, 1, ["p_partkey"], ["p_partkey", "p_name"])
    return Q.browse_errors(errs, runid=1, code="too_long", text="exceeds", limit=20, offset=10) \
            .select("rwndx", "rrcd", "rrmssg")


@query("scalar_functions", f"""
SELECT e.errid, strftime(p.strtdt, '%Y-%m-%d') AS day_label, (epoch_us(p.enddt) - epoch_us(p.strtdt)) / 1e6 AS seconds,
       CASE p.status WHEN 'FL' THEN 'Failed' WHEN 'PC' THEN 'Completed' ELSE 'Other' END AS status_label,
       COALESCE(NULLIF(e.dberrmsg, 'db error 1'), e.errmsg) AS first_message,
       upper(trim('  ' || p.mapref || ' ')) = upper(p.mapref) AS same_job,
       CAST(p.strtdt AS DATE) AS run_day,
       e.errmsg || chr(10) || e.dberrmsg AS full_message,
       NULLIF(regexp_extract(e.errmsg, '([A-Z]+-[0-9]+)', 1), '') AS error_code,
       md5(e.errmsg) AS msg_md5, sha256(e.errmsg) AS msg_sha256, substring(e.errmsg, 1, 10) AS short_message
FROM {E} e JOIN {P} p ON p.prcid = e.prcid AND p.sessionid = e.sessionid""")
def scalar_functions(spark, sf_dir):
    """FN-20 day label, FN-21 seconds, FN-23 CASE labels, FN-24 NVL, FN-25 UPPER(TRIM) compare,
    FN-26 date part, FN-27 newline concat, FN-28 error code, FN-29 MD5, FN-30 SHA-256, FN-32
    bounded text — over every error row joined to its run."""
    from ..functions import scalars as SC
    er = RT.errors(spark, sf_dir).drop("mapref", "jobid")
    p = RT.proc(spark, sf_dir).select("prcid", "sessionid", "strtdt", "enddt", "status", "mapref")
    x = er.join(p, ["prcid", "sessionid"])
    return x.select(
        "errid", SC.day_label("strtdt").alias("day_label"), SC.seconds_between("strtdt", "enddt").alias("seconds"),
        SC.label_case("status", {"FL": "Failed", "PC": "Completed"}, "Other").alias("status_label"),
        SC.nvl(F.nullif(F.col("dberrmsg"), F.lit("db error 1")), "errmsg").alias("first_message"),
        (SC.norm_upper(F.concat(F.lit("  "), F.col("mapref"), F.lit(" "))) == F.upper("mapref")).alias("same_job"),
        SC.day_of("strtdt").alias("run_day"), SC.newline_join("errmsg", "dberrmsg").alias("full_message"),
        SC.error_code("errmsg").alias("error_code"), SC.md5_text("errmsg").alias("msg_md5"),
        SC.sha256_of("errmsg").alias("msg_sha256"), SC.bounded("errmsg", 10).alias("short_message"))
