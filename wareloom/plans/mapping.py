"""Mapping runs over several source combinations, truncate-then-merge, and daily backfill
(SCD-6, LD-5, INC-7)."""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import merge as M
from ..session import cut_lineage


@dataclass
class Combination:
    source: DataFrame
    scd_type: int = 1
    exec_seq: int = 0
    has_key: bool = True
    order_by: list[str] | None = None
    hook: object | None = None      # UD-1: DataFrame -> DataFrame applied to the source before the merge


@dataclass
class Mapping:
    keys: list[str]
    kind: str = M.DIM
    combinations: list[Combination] = field(default_factory=list)


def combination_order(combs: list[Combination]) -> list[Combination]:
    """Key-bearing combinations first, then by highest execution sequence, then SCD type
    descending."""
    return sorted(combs, key=lambda c: (0 if c.has_key else 1, c.exec_seq, -c.scd_type))


def run_mapping(mapping: Mapping, tgt: DataFrame, ts, truncate: bool = False,
                materialise: bool = True) -> tuple[DataFrame, list[DataFrame]]:
    """SCD-6 / LD-5: fold the merges of all combinations over the target (UD-1 hooks applied
    to each combination's source as ``DataFrame.transform``).

    Between steps the intermediate snapshot is written to the shared checkpoint folder so the
    next merge reads a short lineage (and a lost executor recomputes from there).
    Returns the final snapshot and one summary per combination.
    """
    if truncate:
        tgt = tgt.limit(0)
    summaries = []
    ordered = combination_order(mapping.combinations)
    for i, comb in enumerate(ordered):
        src = comb.source.transform(comb.hook) if comb.hook is not None else comb.source
        res = M.scd_merge(src, tgt, mapping.keys, ts, scd_type=comb.scd_type, kind=mapping.kind,
                          order_by=comb.order_by)
        summaries.append(res.summary)
        tgt = res.target
        if materialise and i < len(ordered) - 1:
            tgt = cut_lineage(tgt)
    return tgt, summaries


def backfill_dates(start, end) -> list[_dt.date]:
    d0 = _dt.date.fromisoformat(str(start)[:10])
    d1 = _dt.date.fromisoformat(str(end)[:10])
    return [d0 + _dt.timedelta(days=i) for i in range((d1 - d0).days + 1)]


def backfill_param(d: _dt.date) -> str:
    """Slice parameter text ``DD-Mon-YYYY``."""
    return d.strftime("%d-%b-%Y")


def backfill(df: DataFrame, ts_col: str, start, end) -> DataFrame:
    """INC-7 for append loads in one pass: every row in [start, end] tagged with its slice date
    and the slice parameter; equal to running one slice per day and appending the results
    (the first slice's truncate leaves only what the slices load)."""
    day = F.to_date(F.col(ts_col))
    return (df.filter((day >= F.lit(str(start)[:10]).cast("date")) & (day <= F.lit(str(end)[:10]).cast("date")))
              .withColumn("run_date", day)
              .withColumn("run_param", F.date_format(day, "dd-MMM-yyyy")))


def backfill_slices(run_slice, start, end, truncate: bool = False):
    """INC-7, general form: call ``run_slice(param, truncate_flag)`` once per day in order;
    only the first call may truncate. Used when each slice is a full merge."""
    out = []
    for i, d in enumerate(backfill_dates(start, end)):
        out.append(run_slice(backfill_param(d), truncate and i == 0))
    return out
