"""Report composition and dashboard widgets (RP-1 … RP-9, WD-1 … WD-5).

A report is a field list over a base DataFrame (or SQL). Expressions are Spark SQL text
(``F.expr``), so a report compiles to one Catalyst plan: projection, optional GROUP BY with
partial aggregation, ORDER BY, and a LIMIT only for previews.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import field_alias, json_safe
from ..session import local_rows

PREVIEW_MIN, PREVIEW_MAX = 1, 1000          # fixed values: preview row clamp
EXPORT_MIN, EXPORT_MAX, EXPORT_DEFAULT = 1, 2000, 500
SERIES_ROWS, LABEL_CHARS = 20, 24


class ReportError(ValueError):
    pass


@dataclass
class Field:
    fieldName: str | None = None
    fieldAlias: str | None = None
    sourceColumn: str | None = None
    inlineFormula: str | None = None
    panelType: str | None = "DETAIL"
    isVisible: bool = True
    isGroupBy: bool = False
    orderBySeq: int | None = None
    orderByDir: str | None = None


def _fields(fields) -> list[Field]:
    return [f if isinstance(f, Field) else Field(**f) for f in fields]


def check_group_rule(fields) -> None:
    """RP-4: in a grouped report every non-grouped field needs a formula."""
    fs = [f for f in _fields(fields) if (f.panelType or "DETAIL").upper() == "DETAIL"]
    if any(f.isGroupBy for f in fs):
        bad = [f.fieldAlias or f.fieldName or f.sourceColumn for f in fs
               if not f.isGroupBy and not f.inlineFormula and (f.sourceColumn or f.inlineFormula)]
        if bad:
            raise ReportError("fields must be grouped or aggregated: " + ", ".join(map(str, bad)))


def report(base: DataFrame, fields, limit: int | None = None) -> DataFrame:
    """RP-1 / RP-2 / RP-3 / RP-5: DETAIL fields; expression = inline formula or source column;
    alias = field alias, else name, else COLUMN_n; grouped when any field is group-by;
    ordered by positive ``orderBySeq``; ``limit`` (preview) clamped to 1…1000."""
    check_group_rule(fields)
    detail = [f for f in _fields(fields) if (f.panelType or "DETAIL").upper() == "DETAIL"]
    sel, groups, orders = [], [], []
    for i, f in enumerate(detail):
        text = f.inlineFormula or f.sourceColumn
        if not text:
            continue
        alias = field_alias(f.fieldAlias, f.fieldName, i + 1)
        sel.append((alias, F.expr(text)))
        if f.isGroupBy:
            groups.append((alias, F.expr(text)))
        try:
            seq = int(f.orderBySeq) if f.orderBySeq is not None else None
        except (TypeError, ValueError):
            seq = None
        if seq and seq > 0:
            d = (f.orderByDir or "ASC").upper()
            orders.append((seq, F.col(alias).desc() if d == "DESC" else F.col(alias).asc()))
    if not sel:
        raise ReportError("report has no fields with an expression")
    if groups:
        gnames = {a for a, _ in groups}
        out = base.groupBy(*[c.alias(a) for a, c in groups]).agg(*[c.alias(a) for a, c in sel if a not in gnames])
        out = out.select(*[a for a, _ in sel])
    else:
        out = base.select(*[c.alias(a) for a, c in sel])
    if orders:
        out = out.orderBy(*[c for _, c in sorted(orders, key=lambda x: x[0])])
    if limit is not None:
        out = out.limit(max(PREVIEW_MIN, min(PREVIEW_MAX, int(limit))))
    return out


def describe_query(spark: SparkSession, sql: str, args: dict | None = None, count_rows: bool = False) -> DataFrame:
    """RP-6: column names and types of a query without running it (analysis only); with
    ``count_rows`` the number of result rows is added (one aggregate over the query)."""
    q = spark.sql(sql, args=args)
    schema = q.schema
    rows = []
    for i, f in enumerate(schema.fields):
        p = f.dataType.precision if isinstance(f.dataType, T.DecimalType) else None
        s = f.dataType.scale if isinstance(f.dataType, T.DecimalType) else None
        rows.append((i + 1, f.name, f.dataType.simpleString(), p, s, f.nullable))
    desc = local_rows(spark, rows, "position int, name string, type string, precision int, scale int, nullable boolean")
    if not count_rows:
        return desc
    # one aggregate row joined on a constant key (a single-row broadcast, not a cross product)
    n = q.agg(F.count(F.lit(1)).alias("result_rows")).withColumn("_k", F.lit(1))
    return desc.withColumn("_k", F.lit(1)).join(F.broadcast(n), "_k").drop("_k")


def snapshot(df: DataFrame, path: str) -> str:
    """RP-7: store a preview copy."""
    df.write.mode("overwrite").parquet(path)
    return path


def list_runs(runs: DataFrame, n: int, report_col: str = "report_id", report=None, id_col: str = "run_id") -> DataFrame:
    """RP-8: latest ``n`` runs by run id, optionally of one report."""
    x = runs.filter(F.col(report_col) == F.lit(report)) if report is not None else runs
    return x.orderBy(F.col(id_col).desc()).limit(n)


def list_reports(defs: DataFrame, scheds: DataFrame, key: str = "report_id", sched_id: str = "schedule_id",
                 status: str = "status", search_cols: list[str] | None = None, text: str | None = None) -> DataFrame:
    """RP-9: report definitions with their latest non-inactive schedule (WN-3) and the count of
    active schedules (JN-6), optionally text-filtered (FLT-4)."""
    from .filters import search
    from .joins import with_count
    from .windows import latest_per_group
    live = scheds.filter(F.upper(F.col(status)) != "INACTIVE")
    latest = latest_per_group(live.select(key, sched_id, status), key, sched_id) \
        .select(key, F.col(sched_id).alias("latest_schedule_id"), F.col(status).alias("latest_status"))
    out = with_count(defs, scheds, key, F.upper(F.col(status)) == "ACTIVE", out="active_count")
    out = out.join(latest, key, "left")
    if text and search_cols:
        out = search(out, search_cols, text)
    return out


def widget_table(spark: SparkSession, sql: str, n: int | None = None, export: bool = False) -> DataFrame:
    """WD-1: rows of a widget query, limited (1…1000 preview, 1…2000 export, default 500)."""
    if export:
        lim = EXPORT_DEFAULT if n is None else max(EXPORT_MIN, min(EXPORT_MAX, int(n)))
    else:
        lim = max(PREVIEW_MIN, min(PREVIEW_MAX, int(n if n is not None else PREVIEW_MAX)))
    return json_safe(spark.sql(sql).limit(lim))


_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def first_numeric_column(df: DataFrame, candidates: list) -> str | None:
    """The first column that holds numbers: a numeric type, or text of which at least one value reads as a
    number. One aggregate over the whole query; one row reaches the driver."""
    texts = [f.name for f in candidates if isinstance(f.dataType, T.StringType)]
    readable = {}
    if texts:
        r = df.agg(*[F.max(F.col(f"`{c}`").try_cast("double").isNotNull()).alias(f"c{i}")
                     for i, c in enumerate(texts)]).first()
        readable = {c: bool(r[f"c{i}"]) for i, c in enumerate(texts)}
    for f in candidates:
        if isinstance(f.dataType, _NUMERIC) or readable.get(f.name):
            return f.name
    return None


def widget_series(df: DataFrame, limit: int | None = SERIES_ROWS) -> DataFrame:
    """WD-2: label = first column as text (24 chars), value = first numeric column after it
    (non-numeric or NULL -> 0). ``limit``: how many rows of the query's order a chart shows (None: all)."""
    fields = df.schema.fields
    label = fields[0].name
    rest = fields[1:] if len(fields) > 1 else fields
    num = first_numeric_column(df, rest)
    if num is None:
        raise ReportError("widget query has no numeric column")
    val = F.coalesce(F.col(f"`{num}`").try_cast("double"), F.lit(0.0))
    rows = df if limit is None else df.limit(limit)
    return rows.select(F.substring(F.col(f"`{label}`").cast("string"), 1, LABEL_CHARS).alias("label"), val.alias("value"))


def widget_kpi(series: DataFrame) -> DataFrame:
    """WD-3: sum of the series values (pass the whole series)."""
    return series.agg(F.sum("value").alias("kpi"))


def widget_share(series: DataFrame) -> DataFrame:
    """WD-4: each value's share of the total of the whole series (a one-row aggregate joined back)."""
    total = series.agg(F.sum("value").alias("_total"))
    return series.join(F.broadcast(total)).withColumn("share", F.try_divide(F.col("value"), F.col("_total"))).drop("_total")


def dashboard(spark: SparkSession, widgets: list[dict]) -> dict[str, DataFrame]:
    """WD-5: every widget with SQL becomes a DataFrame (TABLE -> rows, others -> series; KPI and PIE total the
    whole query); empty SQL is skipped; no widget with SQL is an error."""
    out = {}
    for w in widgets:
        sql = (w.get("adhocSql") or "").strip()
        if not sql:
            continue
        kind = (w.get("widgetType") or "TABLE").upper()
        df = widget_table(spark, sql) if kind == "TABLE" else widget_series(spark.sql(sql), None if kind in ("KPI", "PIE") else SERIES_ROWS)
        if kind == "KPI":
            df = widget_kpi(df)
        elif kind == "PIE":
            df = widget_share(df)
        out[w.get("widgetName") or f"widget_{len(out) + 1}"] = df
    if not out:
        raise ReportError("dashboard has no widget with a query")
    return out
