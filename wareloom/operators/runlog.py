"""Run-log analytics (AG-1 … AG-17) over the process-log / job-log / error tables.

Expected columns (FIXTURES §3):
  process log ``proc``: prcid, jobid, mapref, sessionid, strtdt, enddt, status, msg
  job log ``log``:      joblogid, prcdt, mapref, jobid, srcrows, trgrows, errrows, prcid, sessionid
  job errors ``err``:   errid, prcid, sessionid, mapref, jobid, errtyp, errmsg, dberrmsg
Every operator is a grouped aggregate (partial aggregation map-side) or a key join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import day_label, micros_between, seconds_between, ts_lit
from .filters import in_period

# Process status codes.
OK, FAILED, RUNNING, STOPPED = "PC", "FL", "IP", "ST"
RUN_KEYS = ["sessionid", "prcid"]


def duration_us(start="strtdt", end="enddt") -> Column:
    return micros_between(start, end)


def runs_with_process(log: DataFrame, proc: DataFrame) -> DataFrame:
    """JN-2: job log ⋈ process log on session and process id, with run seconds."""
    p = proc.select(*RUN_KEYS, "strtdt", "enddt", "status", duration_us().alias("_dur_us"))
    return log.join(p, RUN_KEYS, "inner").withColumn("run_seconds", F.col("_dur_us") / F.lit(1e6))


def mapping_totals(maps: DataFrame, jobs: DataFrame, flows: DataFrame, scheds: DataFrame) -> DataFrame:
    """AG-1 over JN-3: mappings with their jobs, flows and schedules, counted along the left-join chain. Every
    level is counted below its parent first (schedules per flow, flows per job, jobs per mapping), so
    the chain's rows are never formed: each count is multiplied up instead."""
    s = scheds.where("curflg = 'Y'").groupBy("jobflwid").agg(F.count(F.lit(1)).alias("n_s"))
    f = (flows.where("curflg = 'Y'").select("jobid", "jobflwid").join(s, "jobflwid", "left")
         .groupBy("jobid").agg(F.sum(F.coalesce("n_s", F.lit(1))).alias("rows_f"), F.sum(F.coalesce("n_s", F.lit(0))).alias("with_s")))
    j = (jobs.where("curflg = 'Y'").select("mapref", "jobid", "stflg").join(f, "jobid", "left")
         .withColumn("rows_j", F.coalesce("rows_f", F.lit(1)))
         .groupBy("mapref").agg(F.sum("rows_j").alias("rows_j"), F.sum(F.when(F.col("stflg") == "A", F.col("rows_j")).otherwise(0)).alias("active_j"),
                                F.sum(F.coalesce("rows_f", F.lit(0))).alias("with_f"), F.sum(F.coalesce("with_s", F.lit(0))).alias("with_s")))
    m = maps.where("curflg = 'Y'").join(j, "mapref", "left").withColumn("r", F.coalesce("rows_j", F.lit(1)))

    def total(value, when=None):
        v = F.coalesce(value, F.lit(0))
        return F.coalesce(F.sum(v if when is None else F.when(when, v).otherwise(0)), F.lit(0)).cast("long")
    r = F.col("r")
    return m.agg(total(r, F.col("mapref").isNotNull()).alias("mapping_rows"), total(r, F.col("lgvrfyflg") == "Y").alias("verified_rows"),
                 total(r, F.col("stflg") == "A").alias("active_rows"), total(F.col("rows_j")).alias("job_rows"),
                 total(F.col("active_j")).alias("active_job_rows"), total(F.col("with_f")).alias("flow_rows"),
                 total(F.col("with_s")).alias("schedule_rows"))


def job_overview(log: DataFrame, proc: DataFrame) -> DataFrame:
    """AG-2: per job: runs, average source rows, CEIL(average target rows) (FN-22), max / min seconds."""
    x = runs_with_process(log, proc)
    return x.groupBy("mapref").agg(
        F.count("mapref").alias("times_processed"),
        F.avg("srcrows").alias("average_src_rows_processed"),
        F.ceil(F.avg("trgrows")).cast("long").alias("average_trg_rows_processed"),
        (F.max("_dur_us") / F.lit(1e6)).alias("max_job_duration"),
        (F.min("_dur_us") / F.lit(1e6)).alias("min_job_duration"))


def rows_per_day(log: DataFrame, period: str, as_of) -> DataFrame:
    """AG-3: per job and day (``yyyy-MM-dd``): total source and target rows within a period."""
    x = in_period(log, "prcdt", period, as_of)
    return x.groupBy("mapref", day_label("prcdt").alias("time_group")).agg(
        F.sum("srcrows").cast("long").alias("total_srcrows"), F.sum("trgrows").cast("long").alias("total_trgrows"))


def duration_series(log: DataFrame, proc: DataFrame, period: str, as_of) -> DataFrame:
    """AG-4: run date and duration in seconds of every run in the period."""
    x = in_period(runs_with_process(log, proc), "prcdt", period, as_of)
    return x.select("prcdt", "mapref", F.col("run_seconds").alias("run_durations"))


def avg_duration(log: DataFrame, proc: DataFrame) -> DataFrame:
    """AG-5: average run seconds per job (averaged on exact microseconds)."""
    x = runs_with_process(log, proc)
    return x.groupBy(F.col("mapref").alias("job_name")).agg((F.avg("_dur_us") / F.lit(1e6)).alias("avg_seconds"))


def success_failed(proc: DataFrame) -> DataFrame:
    """AG-6: failed and succeeded runs per job (status PC / FL only)."""
    x = proc.filter(F.col("status").isin(OK, FAILED))
    return x.groupBy(F.col("mapref").alias("job_name_prefix")).agg(
        F.count_if(F.col("status") == FAILED).alias("failed_count"),
        F.count_if(F.col("status") == OK).alias("succeeded_count"))


def success_rate(proc: DataFrame) -> DataFrame:
    """AG-7: 100 · succeeded / (succeeded + failed) over all runs, 0 when there are none."""
    a = proc.agg(F.count_if(F.col("status") == OK).alias("ok"), F.count_if(F.col("status") == FAILED).alias("failed"))
    return a.select("ok", "failed",
                    F.when(F.col("ok") + F.col("failed") > 0,
                           F.lit(100.0) * F.col("ok") / (F.col("ok") + F.col("failed"))).otherwise(F.lit(0.0))
                    .alias("success_rate"))


def job_stats(runs: DataFrame) -> DataFrame:
    """AG-8: per job: runs, counts by status, latest status and date, average of non-zero
    durations (0 when none), has-failures. ``runs`` has mapref, prcdt, status, run_seconds, prcid."""
    valid = F.when(F.col("run_seconds").isNotNull() & (F.col("run_seconds") != 0), F.col("_dur_us"))
    latest = F.struct(F.col("prcdt"), F.col("prcid"))
    return runs.groupBy(F.col("mapref").alias("job_name")).agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.count_if(F.col("status") == OK).alias("successful_runs"),
        F.count_if(F.col("status") == FAILED).alias("failed_runs"),
        F.count_if(F.col("status") == RUNNING).alias("in_progress_runs"),
        F.count_if(F.col("status") == STOPPED).alias("stopped_runs"),
        F.max_by("status", latest).alias("latest_status"),
        F.max("prcdt").alias("last_run_date"),
        F.coalesce(F.avg(valid) / F.lit(1e6), F.lit(0.0)).alias("avg_duration"),
        (F.count_if(F.col("status") == FAILED) > 0).alias("has_failed_logs"))


def job_log_flat(log: DataFrame) -> DataFrame:
    """AG-9 flat: every log row with its position in the job's newest-first list."""
    from .windows import number_within_groups
    x = log.select(F.col("mapref").alias("job_name"), "joblogid", "prcdt", "srcrows", "trgrows")
    return number_within_groups(x, ["job_name"], [F.col("prcdt").desc(), F.col("joblogid").desc()], col="log_seq")


def job_log_nested(log: DataFrame, page_rows: int = 100) -> DataFrame:
    """AG-9: each job's log as lists, newest first: one row per (job, page) with the next ``page_rows`` log rows. Rows are numbered
    inside their job over a range partitioning, so a job's history spans many tasks and no list is longer than a page."""
    x = job_log_flat(log).withColumn("page", F.expr(f"(log_seq - 1) div {page_rows} + 1"))
    entry = F.struct("log_seq", "joblogid", "prcdt", "srcrows", "trgrows")
    return x.groupBy("job_name", "page").agg(F.sort_array(F.collect_list(entry)).alias("log"))


REQUEST_STATES = ("NEW", "QUEUED", "PROCESSING", "CLAIMED")


def requests_by_type(req: DataFrame) -> DataFrame:
    """AG-10: active requests by type (from the reference prefix) and upper-cased status."""
    prefix = F.split_part("mapref", F.lit(":"), F.lit(1))
    kind = F.when(~F.contains("mapref", F.lit(":")), "JOBS").when(prefix == "FLUPLD", "FILE_UPLOAD").when(prefix == "REPORT", "REPORT").otherwise("JOBS")
    open_ = req.withColumn("state", F.upper("status")).where(F.col("state").isin(*REQUEST_STATES))
    return open_.groupBy(kind.alias("kind"), "state").agg(F.count(F.lit(1)).alias("requests"))


def schedule_rollup(scheds: DataFrame, flows: DataFrame, value_cols: list[str], max_cols: list[str] = ()) -> DataFrame:
    """AG-11: per flow: MIN ids, value of an enabled schedule else MIN (``value_cols``) or else
    MAX (``max_cols``), MAX(flag)."""
    live = scheds.where("curflg = 'Y'").join(flows.where("curflg = 'Y'").select("jobflwid"), "jobflwid", "left_semi")
    on = F.col("schflg") == "Y"
    pick = [F.coalesce(F.max(F.when(on, F.col(c))), fallback(c)).alias(c) for cs, fallback in ((value_cols, F.min), (max_cols, F.max)) for c in cs]
    return live.groupBy(F.col("jobflwid").alias("flow")).agg(
        F.min("jobschid").alias("first_schedule"), F.min("dpnd_jobschid").alias("first_dependency"), *pick,
        F.when(F.bool_or(on), "Y").otherwise("N").alias("enabled"))


def usage_counts(cat: DataFrame, used: DataFrame, key: str, used_key: str, name: str) -> DataFrame:
    """AG-12: usage count per catalogue entry including zero (left join + COUNT(right))."""
    u = used.select(F.col(used_key).alias("_k"))
    agg = u.groupBy("_k").agg(F.count(F.lit(1)).alias("usage_count"))
    j = cat.join(agg, cat[key] == agg["_k"], "left")
    return j.select(F.col(key), F.col(name), F.coalesce("usage_count", F.lit(0)).cast("long").alias("usage_count"))


def counts_and_top(df: DataFrame, group: str, item: str, weight: str, tie: str) -> DataFrame:
    """AG-13: per group the number of items and the most used item (ties: smallest ``tie``)."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("items"),
                                 F.max_by(item, F.struct(F.col(weight), -F.col(tie))).alias("most_used"))


def distinct_concat(df: DataFrame, by: str | list[str], col: str, sep: str = ", ", out: str = "values") -> DataFrame:
    """AG-14: ``string_agg(DISTINCT x, sep ORDER BY x)`` (set built map-side)."""
    by = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*by).agg(F.array_join(F.sort_array(F.collect_set(col)), sep).alias(out))


def run_totals(parts: DataFrame) -> DataFrame:
    """AG-15: rows processed / successful / failed, parts succeeded / failed."""
    return parts.agg(F.sum("rows_processed").cast("long").alias("rows_processed"),
                     F.sum("rows_successful").cast("long").alias("rows_successful"),
                     F.sum("rows_failed").cast("long").alias("rows_failed"),
                     F.count_if(F.col("error").isNull()).alias("parts_succeeded"),
                     F.count_if(F.col("error").isNotNull()).alias("parts_failed"))


def is_running(proc: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """AG-16: per job the number of runs in progress started within ``hours`` before ``as_of``."""
    lo = ts_lit(as_of) - F.make_dt_interval(F.lit(0), F.lit(hours))
    x = proc.filter(F.col("status").isin(RUNNING, "CLAIMED") & (F.col("strtdt") >= lo))
    return x.groupBy("mapref").agg(F.count(F.lit(1)).alias("running_count"))


def group_order_keys(details: DataFrame) -> DataFrame:
    """AG-17: per combination and SCD type: MIN key sequence (NULL -> 9999), MAX exec sequence."""
    return details.groupBy("mapcmbcd", F.coalesce(F.col("scdtyp"), F.lit(1)).alias("scdtyp")).agg(
        F.min(F.coalesce(F.col("trgkeyseq"), F.lit(9999))).alias("kseq"), F.max("excseq").alias("maxexcseq"))


def seconds(start="strtdt", end="enddt") -> Column:
    """FN-21"""
    return seconds_between(start, end)


ERROR_KEYS = ["sessionid", "prcid", "mapref", "jobid"]


def log_with_errors(proc: DataFrame, log: DataFrame, err: DataFrame) -> DataFrame:
    """JN-4: process log ⟕ job log ⟕ errors, each on (job, session, process, mapping); a failed
    run fans out to one row per error."""
    keys = ["jobid", "sessionid", "prcid", "mapref"]
    lg = log.select(*keys, *[c for c in log.columns if c not in keys])
    return proc.join(lg, keys, "left").join(err, ERROR_KEYS, "left")


def job_history(log: DataFrame, proc: DataFrame, err: DataFrame) -> DataFrame:
    """JN-5: job log ⋈ process log ⟕ errors. A run is identified by (job, session, process); the
    job id alone would pair every run of a job with every other run of it."""
    return log.join(proc, ["jobid", "sessionid", "prcid"]).join(err, ERROR_KEYS, "left")


def runs_with_config(runs: DataFrame, cfg: DataFrame, key: str = "flupldref") -> DataFrame:
    """JN-10: file-load runs ⟕ their load configuration (filters applied afterwards, FLT-3)."""
    return runs.join(cfg, key, "left")
