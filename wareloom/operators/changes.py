"""Lookup of the current target row and change classification (JN-1, HSH-3, HSH-4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEW, CHANGED, UNCHANGED = "NEW", "CHANGED", "UNCHANGED"


def current(df: DataFrame, flag: str = "CURFLG") -> DataFrame:
    """FLT-1: rows flagged current (tables without the flag are all current)."""
    if flag in df.columns:
        return df.filter(F.col(flag) == F.lit("Y"))
    return df


def lookup_current(src: DataFrame, tgt: DataFrame, keys: list[str], cols: list[str] | None = None,
                   prefix: str = "t_", unique: bool = False) -> DataFrame:
    """JN-1: source rows with the matching current target row (left join on the business key).

    Only ``cols`` of the target are carried, so the scan reads just those columns; AQE turns
    the join into a broadcast when the target side proves small at run time. ``unique``: the target is known to have one
    current row per key, so none has to be picked (and the target is not aggregated).
    """
    t = current(tgt)
    cols = cols if cols is not None else [c for c in t.columns if c not in keys]
    t = (t if unique else first_current(t, keys, cols)).select(*keys, *[F.col(c).alias(prefix + c) for c in cols])
    return src.join(t, keys, "left")


def first_current(rows: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """One row per key of a table that may hold several current rows for it: the first hit (smallest SKEY,
    else the smallest row). The aggregate shuffles on the key the lookup joins on, so it adds no exchange."""
    first = [F.col("SKEY")] if "SKEY" in rows.columns else []
    rest = [F.col(c) for c in cols if c != "SKEY"]
    return (rows.groupBy(*keys).agg(F.min(F.struct(*first, *rest)).alias("_f"))
            .select(*keys, *[F.col("_f." + c).alias(c) for c in cols]) if first or rest else rows.select(*keys).distinct())


def classify(src: DataFrame, tgt: DataFrame, keys: list[str], hash_col: str = "RWHKEY",
             out: str = "change", unique: bool = False) -> DataFrame:
    """HSH-3: NEW when no current target row, CHANGED when the hashes differ (a NULL
    target hash counts as ''), else UNCHANGED. Carries ``t_SKEY`` and ``t_<hash_col>``."""
    tcols = [c for c in ("SKEY", hash_col) if c in tgt.columns]
    j = lookup_current(src, tgt, keys, tcols, unique=unique)
    th = F.coalesce(F.col("t_" + hash_col), F.lit(""))
    present = F.col("t_SKEY").isNotNull() if "SKEY" in tgt.columns else F.col("t_" + hash_col).isNotNull()
    return j.withColumn(out, F.when(~present, F.lit(NEW))
                              .when(F.col(hash_col) != th, F.lit(CHANGED))
                              .otherwise(F.lit(UNCHANGED)))


def changed(cols: list[str], left: str = "s", right: str = "t") -> Column:
    """HSH-4: any of ``cols`` differs between two aliased sides (NULL-safe)."""
    conds = [~F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in cols]
    return reduce(lambda a, b: a | b, conds, F.lit(False))
