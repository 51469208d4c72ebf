"""Resume after a checkpoint and high-water marks (INC-1 … INC-6)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import after_tuple

SEP = "|"


def _typed(df: DataFrame, col: str, value):
    """Checkpoint text cast to the column's type (driver-side literal)."""
    return F.lit(value).cast(df.schema[col].dataType)


def resume_after(df: DataFrame, keys: list[str], value) -> DataFrame:
    """INC-1 / INC-2: rows after the stored key. A composite value is ``a|b``; a value with the
    wrong number of parts means start afresh (all rows). Catalyst pushes the predicate into
    the scan (Parquet row-group skipping on the first key)."""
    if value is None:
        return df
    parts = str(value).split(SEP) if len(keys) > 1 else [value]
    if len(parts) != len(keys):
        return df
    if len(keys) == 1:
        return df.filter(F.col(keys[0]) > _typed(df, keys[0], parts[0]))
    return df.filter(after_tuple(keys, [_typed(df, k, p) for k, p in zip(keys, parts)]))


PIVOTS = 32                 # places an interval is cut at in one round
SORTED_AT_ONCE = 50_000     # an interval of so many rows is sorted


def resume_after_rows(df: DataFrame, n: int, order_by) -> DataFrame:
    """INC-3: skip the first ``n`` rows of an explicit order (column names, ascending, NULLs first), without sorting the rows: the
    n-th row's key is found by counting the rows between pivots, and the rest is a filter on the scan. Rows equal to that key
    are interchangeable; as many of them are skipped as belong to the first ``n``."""
    if not n:
        return df
    cols = [order_by] if isinstance(order_by, str) else list(order_by)
    found = nth_key(df, cols, n)
    if found is None:
        return df.limit(0)
    key, upto = found
    me, mark = F.struct(*cols), _key(df, cols, key)
    later = me > mark
    if key[0] is not None:
        later = (F.col(cols[0]) >= F.lit(key[0]).cast(df.schema[cols[0]].dataType)) & later     # reaches the scan
    rest = df.where(later)
    return rest.unionByName(df.where(me == mark).limit(upto - n)) if upto > n else rest


def _key(df: DataFrame, cols: list[str], values) -> Column:
    return F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(cols, values)])


def nth_key(df: DataFrame, cols: list[str], n: int) -> tuple[tuple, int] | None:
    """(key, rows up to and with that key) of the ``n``-th row in the order of ``cols``; None when there are fewer rows.

    Every round draws pivots out of the open interval and counts its rows between them in one narrow scan (at most ``PIVOTS``
    counts reach the driver), so an interval shrinks to about a ``PIVOTS``-th; a short one is sorted."""
    me = F.struct(*cols)
    keys = df.select(*cols)
    low, below = None, 0                                     # rows up to ``low`` are before the interval
    high = None
    total = keys.count()
    if n > total:
        return None
    size = total
    while True:
        inside = keys
        if low is not None:
            inside = inside.where(me > _key(df, cols, low))
        if high is not None:
            inside = inside.where(me <= _key(df, cols, high))
        if size <= SORTED_AT_ONCE:
            row = inside.orderBy(*cols).offset(n - below - 1).limit(1).first()
            return tuple(row), below + inside.where(me <= _key(df, cols, row)).count()
        drawn = inside.select(*cols, F.rand(17).alias("_r")).orderBy("_r").limit(PIVOTS).select(*cols).distinct().orderBy(*cols).collect()
        top = high if high is not None else tuple(inside.agg(F.max(me).alias("m")).first()["m"])
        pivots = [*[tuple(r) for r in drawn if tuple(r) != top], top]
        if len(pivots) == 1:
            least = tuple(inside.agg(F.min(me).alias("m")).first()["m"])
            if least == top:                                 # one key only
                return top, below + size
            pivots = [least, top]
        counts = inside.agg(*[F.count_if(me <= _key(df, cols, p)).alias(f"c{i}") for i, p in enumerate(pivots)]).first()
        at = next(i for i, c in enumerate(counts) if below + c >= n)
        before = counts[at - 1] if at else 0
        low, below, high, size = pivots[at - 1] if at else low, below + before, pivots[at], counts[at] - before


def high_water(df: DataFrame, keys: list[str]) -> DataFrame:
    """INC-5: the greatest key processed, as checkpoint text (``a|b`` for composite keys).
    One aggregate row; the comparison is on typed values, not text."""
    if len(keys) == 1:
        return df.agg(F.max(keys[0]).cast("string").alias("mark"))
    m = df.agg(F.max(F.struct(*keys)).alias("_m"))
    return m.select(F.concat_ws(SEP, *[F.col("_m." + k).cast("string") for k in keys]).alias("mark"))


@dataclass
class ResumeState:
    """INC-4 / INC-6 state row: strategy, stored value, status."""
    strategy: str = "AUTO"          # AUTO, KEY, ROWS, NONE
    value: str | None = None
    rows_done: int = 0
    status: str | None = None       # COMPLETED resets the next run


def resume(df: DataFrame, keys: list[str] | None, state: ResumeState, order_by=None) -> DataFrame:
    """INC-4: AUTO -> KEY when key columns are given, else ROWS; NONE reads everything;
    a COMPLETED state (INC-6) starts afresh."""
    if state.status == "COMPLETED" or state.strategy.upper() == "NONE":
        return df
    strat = state.strategy.upper()
    if strat == "AUTO":
        strat = "KEY" if keys else "ROWS"
    if strat == "KEY" and keys:
        return resume_after(df, keys, state.value)
    return resume_after_rows(df, state.rows_done, order_by or df.columns)
