"""Scalar helpers used by the run-log analytics and load steps (FN-20 … FN-32)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

HIGH_DATE = "9999-12-31 00:00:00"


def ts_lit(ts) -> Column:
    """A timestamp literal without time zone; ``ts`` is a datetime or ISO text.

    Time is always a parameter of a job (never ``current_timestamp()`` inside), so
    reruns give the same result.
    """
    if isinstance(ts, _dt.datetime):
        ts = ts.strftime("%Y-%m-%d %H:%M:%S.%f")
    elif isinstance(ts, _dt.date):
        ts = ts.strftime("%Y-%m-%d 00:00:00")
    return F.lit(str(ts)).cast("timestamp_ntz")


def day_label(ts) -> Column:
    """FN-20"""
    return F.date_format(_c(ts), "yyyy-MM-dd")


def seconds_between(start, end) -> Column:
    """FN-21: fractional seconds from ``start`` to ``end``."""
    return micros_between(start, end) / F.lit(1e6)


def micros_between(start, end) -> Column:
    """Exact microseconds from ``start`` to ``end`` on wall-clock timestamps (no time-zone or
    daylight-saving shift, whatever the session time zone)."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end))


EPOCH = "1970-01-01 00:00:00"


def epoch_micros(ts) -> Column:
    """Microseconds since 1970-01-01 of a wall-clock timestamp."""
    return micros_between(F.lit(EPOCH).cast("timestamp_ntz"), ts)


def add_seconds(ts, seconds) -> Column:
    """Timestamp plus a (fractional) number of seconds, microsecond precision."""
    return F.timestamp_add("MICROSECOND", F.round(_c(seconds) * 1e6).cast("long"), _c(ts))


def error_code(msg) -> Column:
    """FN-28: first ``ABC-123`` style code in a message, else NULL."""
    return F.nullif(F.regexp_extract(_c(msg), r"([A-Z]+-[0-9]+)", 1), F.lit(""))


def row_json(*cols) -> Column:
    """FN-31: a row as JSON text, timestamps ISO."""
    return F.to_json(F.struct(*[_c(c) for c in cols]), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"})


def bounded(v, n: int) -> Column:
    """FN-32: keep at most ``n`` characters."""
    return F.substring(_c(v).cast("string"), 1, n)


def newline_join(a, b) -> Column:
    """FN-27: ``a || '\\n' || b`` (NULL if either is NULL)."""
    return F.concat(_c(a), F.lit("\n"), _c(b))


def norm_upper(v) -> Column:
    """FN-25"""
    return F.upper(F.trim(_c(v)))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def label_case(c, mapping: dict, default=None) -> Column:
    """FN-23: ``CASE WHEN c = k THEN v …`` labels / flags from a mapping."""
    out = F.lit(default)
    for k, v in reversed(list(mapping.items())):
        out = F.when(_c(c) == F.lit(k), F.lit(v)).otherwise(out)
    return out


def nvl(*cols) -> Column:
    """FN-24: first non-NULL value (``COALESCE`` / ``NVL``)."""
    return F.coalesce(*[_c(c) for c in cols])


def day_of(ts) -> Column:
    """FN-26: date part of a timestamp (``DATE(ts)`` / ``TRUNC(ts)``)."""
    return F.to_date(_c(ts))


def md5_text(v) -> Column:
    """FN-29: MD5 of text (hex)."""
    return F.md5(_c(v).cast("string"))


def sha256_of(v) -> Column:
    """FN-30: SHA-256 of bytes or text (hex)."""
    return F.sha2(_c(v), 256)
