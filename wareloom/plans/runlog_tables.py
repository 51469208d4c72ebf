"""Run-log tables derived from ``events``, as DataFrames and as SQL.

job = event_type, run = event_id, start = ts, duration = value seconds,
status = FL / IP / ST / PC by event_id % 10, source rows = event_id % 1000,
target rows = event_id % 900.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import add_seconds
from .tables import table

# Status per last digit of the run id.
STATUS_SQL = "CASE event_id % 10 WHEN 0 THEN 'FL' WHEN 1 THEN 'IP' WHEN 2 THEN 'ST' ELSE 'PC' END"


def _status():
    d = F.col("event_id") % 10
    return F.when(d == 0, "FL").when(d == 1, "IP").when(d == 2, "ST").otherwise("PC")


def proc(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("prcid"), F.col("event_type").alias("jobid"),
                    F.col("event_type").alias("mapref"), F.col("user_id").alias("sessionid"),
                    F.col("ts").alias("strtdt"), add_seconds(F.col("ts"), F.col("value")).alias("enddt"),
                    _status().alias("status"),
                    F.concat(F.lit("run "), F.col("event_id").cast("string")).alias("msg"))


PROC_SQL = f"""(SELECT event_id AS prcid, event_type AS jobid, event_type AS mapref, user_id AS sessionid,
  ts AS strtdt, ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)) AS enddt, {STATUS_SQL} AS status,
  'run ' || CAST(event_id AS VARCHAR) AS msg FROM events)"""


def log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("joblogid"), F.col("ts").alias("prcdt"), F.col("event_type").alias("mapref"),
                    F.col("event_type").alias("jobid"), (F.col("event_id") % 1000).alias("srcrows"),
                    (F.col("event_id") % 900).alias("trgrows"), (F.col("event_id") % 7).alias("errrows"),
                    F.col("event_id").alias("prcid"), F.col("user_id").alias("sessionid"))


LOG_SQL = """(SELECT event_id AS joblogid, ts AS prcdt, event_type AS mapref, event_type AS jobid,
  event_id % 1000 AS srcrows, event_id % 900 AS trgrows, event_id % 7 AS errrows, event_id AS prcid,
  user_id AS sessionid FROM events)"""


def errors(spark, sf_dir):
    """One to three error rows per failed run."""
    e = table(spark, sf_dir, "events").filter(F.col("event_id") % 10 == 0)
    x = e.select("*", F.explode(F.sequence(F.lit(1).cast("long"), 1 + F.col("event_id") % 3)).alias("i"))
    return x.select((F.col("event_id") * 10 + F.col("i")).alias("errid"), F.col("event_id").alias("prcid"),
                    F.col("user_id").alias("sessionid"), F.col("event_type").alias("mapref"),
                    F.col("event_type").alias("jobid"), F.lit("ERR").alias("errtyp"),
                    F.concat(F.lit("ORA-"), F.lpad((F.col("event_id") % 1000).cast("string"), 5, "0"),
                             F.lit(" failed step "), F.col("i").cast("string")).alias("errmsg"),
                    F.concat(F.lit("db error "), F.col("i").cast("string")).alias("dberrmsg"))


ERR_SQL = """(SELECT event_id * 10 + i AS errid, event_id AS prcid, user_id AS sessionid, event_type AS mapref,
  event_type AS jobid, 'ERR' AS errtyp,
  'ORA-' || lpad(CAST(event_id % 1000 AS VARCHAR), 5, '0') || ' failed step ' || CAST(i AS VARCHAR) AS errmsg,
  'db error ' || CAST(i AS VARCHAR) AS dberrmsg
  FROM (SELECT *, unnest(generate_series(1, 1 + event_id % 3)) AS i FROM events WHERE event_id % 10 = 0) x)"""


def requests(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    d = F.col("event_id") % 5
    uid = F.col("user_id").cast("string")
    return e.select(F.concat(F.lit("REQ"), F.col("event_id").cast("string")).alias("request_id"),
                    F.when(F.col("event_type") == "signup", F.concat(F.lit("FLUPLD:"), uid))
                     .when(F.col("event_type") == "purchase", F.concat(F.lit("REPORT:"), uid))
                     .otherwise(F.col("event_type")).alias("mapref"),
                    F.when(d == 0, "new").when(d == 1, "Queued").when(d == 2, "PROCESSING").when(d == 3, "claimed")
                     .otherwise("DONE").alias("status"),
                    F.col("ts").alias("requested_at"))


REQ_SQL = """(SELECT 'REQ' || CAST(event_id AS VARCHAR) AS request_id,
  CASE event_type WHEN 'signup' THEN 'FLUPLD:' || CAST(user_id AS VARCHAR)
                  WHEN 'purchase' THEN 'REPORT:' || CAST(user_id AS VARCHAR) ELSE event_type END AS mapref,
  CASE event_id % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'Queued' WHEN 2 THEN 'PROCESSING' WHEN 3 THEN 'claimed'
                    ELSE 'DONE' END AS status,
  ts AS requested_at FROM events)"""


def file_runs(spark, sf_dir):
    """File-load run log (FIXTURES §3 load run)."""
    e = table(spark, sf_dir, "events")
    d = F.col("event_id") % 10
    u = F.col("user_id") % 3
    return e.select(F.col("event_id").alias("runid"), F.col("event_type").alias("flupldref"),
                    F.col("ts").alias("strttm"),
                    F.when(d == 0, "FAILED").when(d == 1, "PARTIAL").otherwise("SUCCESS").alias("stts"),
                    F.when(u == 0, "INSERT").when(u == 1, "TRUNCATE_LOAD").otherwise("UPSERT").alias("ldmde"),
                    F.concat(F.lit("loaded "), F.col("props")).alias("mssg"))


FILE_RUNS_SQL = """(SELECT event_id AS runid, event_type AS flupldref, ts AS strttm,
  CASE event_id % 10 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'PARTIAL' ELSE 'SUCCESS' END AS stts,
  CASE user_id % 3 WHEN 0 THEN 'INSERT' WHEN 1 THEN 'TRUNCATE_LOAD' ELSE 'UPSERT' END AS ldmde,
  'loaded ' || props AS mssg FROM events)"""


def load_config(spark, sf_dir):
    """One load configuration per file reference."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("flupldref")).agg(F.min("ts").alias("crtdt")).select(
        "flupldref", F.concat(F.upper("flupldref"), F.lit(".csv")).alias("flnm"),
        F.when(F.col("flupldref").isin("click", "view"), "Y").otherwise("N").alias("trnctflg"), "crtdt")


CONFIG_SQL = """(SELECT event_type AS flupldref, upper(event_type) || '.csv' AS flnm,
  CASE WHEN event_type IN ('click', 'view') THEN 'Y' ELSE 'N' END AS trnctflg, min(ts) AS crtdt
  FROM events GROUP BY event_type)"""
