"""Column mapping, defaults, derivations, audit stamps and typed conversion (PRJ-1 … PRJ-9)."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import ts_lit
from ..types import ColumnSpec


def _lookup(df: DataFrame) -> dict[str, str]:
    return {c.upper(): c for c in df.columns}


def map_columns(df: DataFrame, mapping: dict[str, str], target_cols: list[str]) -> DataFrame:
    """PRJ-1: each target column takes its mapped source column, else the same-named column,
    else NULL; names match case-insensitively and the fallback is per value (a NULL mapped
    value falls through to the target-named column)."""
    up = _lookup(df)
    m = {k.upper(): v for k, v in mapping.items()}
    out = []
    for t in target_cols:
        cands = []
        s = m.get(t.upper(), t)
        if s.upper() in up:
            cands.append(F.col(up[s.upper()]))
        if t.upper() in up and up[t.upper()] not in [up.get(s.upper())]:
            cands.append(F.col(up[t.upper()]))
        if not cands:
            out.append(F.lit(None).cast("string").alias(t))
        elif len(cands) == 1:
            out.append(cands[0].alias(t))
        else:
            out.append(F.coalesce(*cands).alias(t))
    return df.select(*out)


def clean_text(c: Column) -> Column:
    """Strip white space of any kind at both ends and turn empty text into NULL (file values)."""
    return F.nullif(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(""))


def map_file_columns(df: DataFrame, spec: list[ColumnSpec], keep_source: bool = False) -> DataFrame:
    """PRJ-2: only mapped source columns survive (renamed to the target); text trimmed and
    empty text -> NULL; a source column missing from the file gives NULL."""
    up = _lookup(df)
    out = []
    for c in spec:
        if c.source and c.source.upper() in up:
            src = F.col(up[c.source.upper()])
            out.append(clean_text(src).alias(c.target) if isinstance(df.schema[up[c.source.upper()]].dataType, T.StringType)
                       else src.alias(c.target))
        elif not c.audit:
            out.append(F.lit(None).cast("string").alias(c.target))
    if keep_source:
        tgt = {c.target.upper() for c in spec}
        out += [F.col(x) for x in df.columns if x.upper() not in tgt]
    return df.select(*out)


def apply_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """PRJ-3: defaults fill NULLs (applied after formulas)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({k: F.coalesce(F.col(k), F.lit(v).cast(types[k])) for k, v in defaults.items()
                           if k in types})


@contextmanager
def _errors_as_null(spark):
    """Casts, divisions and look-ups that are put together inside give NULL for a value they cannot take, as their ``try_`` forms
    do. An expression keeps the form it was analysed with; the session's setting is the same afterwards."""
    key = "spark.sql.ansi.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def derive(df: DataFrame, formulas: dict[str, Column | Callable], defaults: dict | None = None) -> DataFrame:
    """PRJ-4: all formulas are evaluated against the same (un-derived) row in one step. A formula that yields NULL or fails on
    a row (a text that is no number, a division by zero) takes the column's default when one is given, else NULL; the row
    goes on. (The operators of ``functions.formulas`` also give NULL on an overflow, a plain ``+`` wraps.)"""
    defaults = defaults or {}
    cols = {}
    with _errors_as_null(df.sparkSession):
        for k, f in formulas.items():
            c = f(df) if callable(f) and not isinstance(f, Column) else f
            if k in defaults:
                c = F.coalesce(c, F.lit(defaults[k]).cast(df.select(c.alias("c")).schema["c"].dataType))
            cols[k] = c
        return df.withColumns(cols)


def project_fields(df: DataFrame, fields: list[dict]) -> DataFrame:
    """PRJ-5: fields ``{"alias", "expr" (SQL text), "visible"=True}`` applied in order, each
    seeing the aliases of earlier fields; a field whose expression does not resolve is NULL.
    Resolution is checked by analysis only (no job runs)."""
    out = df
    visible = []
    for f in fields:
        alias, text = f["alias"], f.get("expr") or f.get("source")
        try:
            out.select(F.expr(text)).schema  # analysis only
            c = F.expr(text)
        except AnalysisException:
            c = F.lit(None)
        out = out.withColumn(alias, c)
        if f.get("visible", True):
            visible.append(alias)
    return out.select(*visible)


AUDIT_USER = ("CRTDBY", "CREATED_BY", "UPDTBY", "UPDATED_BY")
AUDIT_TIME = ("CRTDDT", "CREATED_DATE", "UPDTDT", "UPDATED_DATE")


def stamp_audit(df: DataFrame, columns: list[str], user: str | None, ts) -> DataFrame:
    """PRJ-6 at transform time: audit columns are added or only their NULLs filled.
    ``user`` defaults to SYSTEM; ``ts`` is the run time (a parameter)."""
    user = user or "SYSTEM"
    t_now = ts_lit(ts)
    up = _lookup(df)
    cols = {}
    for c in columns:
        name = up.get(c.upper(), c)
        val = F.lit(user) if c.upper() in AUDIT_USER else t_now
        cols[name] = F.coalesce(F.col(name), val) if c.upper() in up else val
    return df.withColumns(cols)


# Text formats tried, in order, for DATE / TIMESTAMP targets.
TIMESTAMP_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS",
                     "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "dd-MMM-yyyy", "yyyy/MM/dd")


def parse_timestamp(c: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(fmt)) for fmt in TIMESTAMP_FORMATS]).cast("timestamp_ntz")


def convert(c: Column, src_type: T.DataType, dtype: T.DataType) -> Column:
    """PRJ-7 for one value: text in DATE/TIMESTAMP columns is parsed over a format list;
    everything else goes through ``try_cast`` so a bad value becomes NULL (see DQ-5)."""
    if isinstance(src_type, T.StringType) and isinstance(dtype, T.StringType):
        return c
    if isinstance(src_type, T.StringType):
        c = clean_text(c)
        c = F.when(~F.lower(c).isin("nan", "none", "null"), c)
        if isinstance(dtype, T.DateType):
            return F.to_date(parse_timestamp(c))
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            return parse_timestamp(c)
    if isinstance(src_type, (T.DoubleType, T.FloatType)):
        c = F.when(~F.isnan(c), c)
    return c.try_cast(dtype)


def cast_to_spec(df: DataFrame, types: dict[str, T.DataType]) -> DataFrame:
    """PRJ-7"""
    src = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({k: convert(F.col(k), src[k], t) for k, t in types.items() if k in src})


def json_safe(df: DataFrame) -> DataFrame:
    """PRJ-8: decimals -> double, timestamps / dates -> ISO text (with the microseconds when there are any), intervals -> seconds
    (year-month intervals: months), also inside structs, arrays and maps (their keys become text)."""
    return df.select(*[_portable(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def _iso(c: Column) -> Column:
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(c, "SSSSSS") == "000000", whole).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def _portable(c: Column, t: T.DataType) -> Column:
    if isinstance(t, T.DecimalType):
        return c.cast("double")
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return _iso(c)
    if isinstance(t, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(t, T.DayTimeIntervalType):       # whole length, whatever fields the interval has
        zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", zero, zero + c) / F.lit(1e6)
    if isinstance(t, T.YearMonthIntervalType):
        zero = F.lit("1970-01-01").cast("date")
        return F.months_between(zero + c, zero).cast("long")
    if isinstance(t, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_portable(c[f.name], f.dataType).alias(f.name) for f in t.fields]))
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _portable(x, t.elementType))
    if isinstance(t, T.MapType):
        return F.transform_keys(F.transform_values(c, lambda k, v: _portable(v, t.valueType)), lambda k, v: _portable(k, t.keyType).cast("string"))
    return c


def field_alias(alias: str | None, name: str | None, position: int) -> str:
    """PRJ-9: alias, else field name, else COLUMN_<n> (1-based)."""
    return alias or name or f"COLUMN_{position}"


def transform_file(df: DataFrame, spec: list[ColumnSpec], user: str | None = None, ts=None) -> DataFrame:
    """File-load transform in one projection (PRJ-2, PRJ-4, PRJ-3, PRJ-6).

    Every spec column takes, in this order: its formula (``ColumnSpec.formula`` is a function of
    a context that maps the upper-cased source *and* target names to the raw source values),
    else the mapped source value (trimmed, empty text -> NULL), else NULL; then its default
    fills a NULL. Audit columns are stamped last (only NULLs filled)."""
    up = _lookup(df)
    ctx: dict[str, Column] = {}
    for c in spec:
        if c.source and c.source.upper() in up:
            raw = F.col(up[c.source.upper()])
            ctx[c.source.upper()] = raw
            ctx[c.target.upper()] = raw
    cols = []
    for c in spec:
        if c.audit:
            continue
        if c.formula is not None:
            v = c.formula(ctx) if callable(c.formula) and not isinstance(c.formula, Column) else c.formula
        elif c.source and c.source.upper() in up:
            src = up[c.source.upper()]
            v = clean_text(F.col(src)) if isinstance(df.schema[src].dataType, T.StringType) else F.col(src)
        else:
            v = F.lit(None).cast("string")
        if c.default is not None:
            v = F.coalesce(v, F.lit(c.default))
        cols.append(v.alias(c.target))
    with _errors_as_null(df.sparkSession):      # a formula that fails on a row gives its default, else NULL
        out = df.select(*cols)
    audit = [c.target for c in spec if c.audit]
    return stamp_audit(out, audit, user, ts) if audit and ts is not None else out
