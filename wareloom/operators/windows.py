"""Ranking, latest-per-group, top-k, ordering and paging (WN-1 … WN-5, ST-1 … ST-3).

* One row per group (WN-1, WN-3, WN-5) is an aggregate ``max_by`` with a map-side partial
  step, so a group holding a third of all rows is reduced before the shuffle.
* Top-k per group (WN-4) is ``row_number() <= k``; Spark plans a partial
  ``WindowGroupLimit`` before the exchange, so at most k rows per group leave each map task.
* Numbering inside groups (``number_within_groups``) range-partitions on (group, order) so a
  hot group is spread over many tasks, then adds per-(partition, group) offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_POS_MASK = (1 << 33) - 1


def _cols(xs):
    if isinstance(xs, (str, Column)):
        xs = [xs]
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def first_per_group(df: DataFrame, keys: list[str], rank: Column, descending: bool = True) -> DataFrame:
    """Row with the greatest (``descending``) or least ``rank`` per key, as an aggregate.
    ``rank`` should be unique within a key (add a tie-breaker column) for a deterministic row."""
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in rest])
    agg = F.max_by(packed, rank) if descending else F.min_by(packed, rank)
    return df.groupBy(*keys).agg(agg.alias("_r")).select(*keys, *[F.col("_r." + c).alias(c) for c in rest]) \
             .select(*df.columns)


def preferred_row(df: DataFrame, key: str | list[str], prefer: Column, tie: list[str] | None = None) -> DataFrame:
    """WN-1: per key the row where ``prefer`` holds (e.g. database = x), else another row;
    ``tie`` columns decide among equals (smallest first)."""
    keys = [key] if isinstance(key, str) else list(key)
    rank = F.struct(F.when(prefer, 0).otherwise(1).alias("_p"), *[F.col(t) for t in (tie or [])])
    return first_per_group(df, keys, rank, descending=False)


def latest_per_group(df: DataFrame, key: str | list[str], order: str | list[str], exclude: Column | None = None) -> DataFrame:
    """WN-3 / WN-5: newest row per key (``order`` descending), optionally ignoring rows."""
    keys = [key] if isinstance(key, str) else list(key)
    d = df.filter(~exclude) if exclude is not None else df
    orders = [order] if isinstance(order, str) else list(order)
    return first_per_group(d, keys, F.struct(*[F.col(o) for o in orders]), descending=True)


def top_k(df: DataFrame, key: str | list[str], order, k: int, col: str = "rank") -> DataFrame:
    """WN-4: k rows per key in ``order`` (Columns with asc/desc); rank 1..k."""
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*_cols(order))
    return df.withColumn(col, F.row_number().over(w)).filter(F.col(col) <= k)


def number_within_groups(df: DataFrame, keys: list[str], order, col: str = "seq",
                         num_partitions: int | None = None) -> DataFrame:
    """1-based ordinal inside each group in ``order`` without sorting a group in one task."""
    order = _cols(order)
    kcols = [F.col(k) for k in keys]
    ranged = df.repartitionByRange(num_partitions, *kcols, *order) if num_partitions else \
        df.repartitionByRange(*kcols, *order)
    tagged = (ranged.sortWithinPartitions(*kcols, *order)
                .withColumn("_wl_pid", F.spark_partition_id())
                .withColumn("_wl_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_POS_MASK))))
    tagged = cut_lineage(tagged)
    per = tagged.groupBy("_wl_pid", *keys).agg(F.count(F.lit(1)).alias("_wl_n"), F.min("_wl_pos").alias("_wl_first"))
    # at most one row per (partition, group): the offsets of a group span only the partitions it touches
    w = Window.partitionBy(*keys).orderBy("_wl_pid").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_wl_off", F.coalesce(F.sum("_wl_n").over(w), F.lit(0)))
    per = per.select(F.col("_wl_pid").alias("_wl_p"), *[F.col(k).alias(f"_wl_k{i}") for i, k in enumerate(keys)], "_wl_off", "_wl_first")
    same = F.col("_wl_pid") == F.col("_wl_p")
    for i, k in enumerate(keys):                       # a NULL group is a group
        same = same & F.col(k).eqNullSafe(F.col(f"_wl_k{i}"))
    out = tagged.join(per, same).drop("_wl_p", *[f"_wl_k{i}" for i in range(len(keys))])
    return out.withColumn(col, (F.col("_wl_off") + F.col("_wl_pos") - F.col("_wl_first") + 1).cast("long")) \
              .drop("_wl_pid", "_wl_pos", "_wl_off", "_wl_first")


def order_nulls_last(df: DataFrame, cols: list[str], descending: bool = True) -> DataFrame:
    """ST-1"""
    return df.orderBy(*[F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last() for c in cols])


def top_n(df: DataFrame, order, n: int) -> DataFrame:
    """ST-2: ``orderBy().limit()`` plans as TakeOrderedAndProject (per-task top-n, then merge)."""
    return df.orderBy(*_cols(order)).limit(n)


def page(df: DataFrame, order, limit: int, offset: int = 0) -> DataFrame:
    """ST-3: LIMIT / OFFSET over an explicit order."""
    return df.orderBy(*_cols(order)).offset(offset).limit(limit)
