"""Row filters (FLT-1 … FLT-7)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ts_lit
from .changes import current  # noqa: F401  (FLT-1)

# Period codes and the number of days they reach back (today counts as day 0).
PERIOD_DAYS = {"DAY": 0, "WEEK": 6, "MONTH": 29}


def filter_runs(df: DataFrame, equals: dict | None = None, contains: tuple[list[str], str] | None = None,
                date_col: str | None = None, start=None, end=None) -> DataFrame:
    """FLT-3: optional equality filters (upper-cased), a case-insensitive contains over several
    columns, and an inclusive date range on ``date_col``."""
    conds: list[Column] = []
    for k, v in (equals or {}).items():
        if v is not None:
            conds.append(F.upper(F.col(k)) == F.lit(str(v).upper()))
    if contains and contains[1]:
        cols, text = contains
        conds.append(reduce(lambda a, b: a | b,
                            [F.coalesce(F.lower(F.col(c)).contains(text.lower()), F.lit(False)) for c in cols]))
    if date_col and start is not None:
        conds.append(F.to_date(F.col(date_col)) >= F.lit(str(start)).cast("date"))
    if date_col and end is not None:
        conds.append(F.to_date(F.col(date_col)) <= F.lit(str(end)).cast("date"))
    return df.filter(reduce(lambda a, b: a & b, conds)) if conds else df


def search(df: DataFrame, cols: list[str], text: str) -> DataFrame:
    """FLT-4: upper-case contains over any of ``cols``."""
    if not text:
        return df
    t = text.upper()
    return df.filter(reduce(lambda a, b: a | b, [F.coalesce(F.upper(F.col(c)).contains(t), F.lit(False))
                                                  for c in cols]))


def in_period(df: DataFrame, ts_col: str, period: str | None, as_of, days: int | None = None) -> DataFrame:
    """FLT-5: DAY / WEEK / MONTH back from the day of ``as_of`` (ALL = no filter), or the
    last ``days`` days from ``as_of``."""
    if days is not None:
        return df.filter(F.col(ts_col) >= ts_lit(as_of) - F.make_dt_interval(F.lit(days)))
    p = (period or "ALL").upper()
    if p not in PERIOD_DAYS:
        return df
    day = F.to_date(ts_lit(as_of))
    return df.filter(F.col(ts_col) >= F.date_sub(day, PERIOD_DAYS[p]).cast("timestamp_ntz"))


def filter_status(df: DataFrame, col: str, values: list[str]) -> DataFrame:
    """FLT-7"""
    return df.filter(F.upper(F.col(col)).isin([v.upper() for v in values]))


def after_tuple(cols: list[str], values: list) -> Column:
    """FLT-6: ``(c1, …, cn) > (v1, …, vn)`` in lexicographic order, expanded to
    ``c1 > v1 OR (c1 = v1 AND (c2 > v2 OR …))`` so the leading comparison reaches the scan."""
    vals = [v if isinstance(v, Column) else F.lit(v) for v in values]
    cond = None
    for i in reversed(range(len(cols))):
        gt = F.col(cols[i]) > vals[i]
        cond = gt if cond is None else gt | ((F.col(cols[i]) == vals[i]) & cond)
    return cond
