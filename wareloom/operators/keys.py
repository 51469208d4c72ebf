"""Dense numbering and surrogate keys (KEY-1, KEY-2, WN-2, INC-3).

A global ``ROW_NUMBER() OVER (ORDER BY k)`` pulls every row into one task. Here the rows are
range-partitioned on the order, sorted inside each partition, materialised once in the
shared checkpoint folder (so the numbering cannot change if a task is re-run), counted per
partition and numbered as ``start + offset(partition) + position``. The counts (one row per
partition) are summed and joined inside Spark; nothing reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_POS_MASK = (1 << 33) - 1   # monotonically_increasing_id keeps the row position in the low 33 bits


def _cols(order_by) -> list[Column]:
    if isinstance(order_by, (str, Column)):
        order_by = [order_by]
    return [F.col(c) if isinstance(c, str) else c for c in order_by]


def number_rows(df: DataFrame, order_by, col: str = "rn", start: int = 1,
                num_partitions: int | None = None, after_max_of: tuple[DataFrame, str] | None = None) -> DataFrame:
    """Add ``col`` = start, start+1, … in the given order (ties broken by the sort; pass a
    unique order for a deterministic result). With ``after_max_of=(table, column)`` numbering
    starts after the table's maximum, read in the same job as the per-partition counts."""
    order = _cols(order_by)
    # without an explicit count AQE may merge small neighbouring ranges (order is kept)
    ranged = df.repartitionByRange(num_partitions, *order) if num_partitions else df.repartitionByRange(*order)
    tagged = (ranged
                .sortWithinPartitions(*order)
                .withColumn("_wl_pid", F.spark_partition_id())
                .withColumn("_wl_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_POS_MASK))))
    tagged = cut_lineage(tagged)
    return _add_offsets(tagged, col, start, after_max_of)


def _add_offsets(tagged: DataFrame, col: str, start: int, after_max_of) -> DataFrame:
    """Number rows that carry their partition id and position: the running total over the per-partition
    counts is a window over one row per partition, joined back by partition id."""
    per = tagged.groupBy("_wl_pid").agg(F.count(F.lit(1)).alias("_wl_n"))
    if after_max_of is not None:
        t, c = after_max_of
        start = 1
        per = per.unionByName(t.agg(F.coalesce(F.max(c), F.lit(0)).cast("long").alias("_wl_n"))
                               .select(F.lit(-1).alias("_wl_pid"), "_wl_n"))
    before = Window.orderBy("_wl_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = per.select("_wl_pid", (F.coalesce(F.sum("_wl_n").over(before), F.lit(0)) + start).alias("_wl_off"))
    # one row per range partition, so broadcasting it is bounded
    return (tagged.join(F.broadcast(off), "_wl_pid")
                  .withColumn(col, (F.col("_wl_off") + F.col("_wl_pos")).cast("long"))
                  .drop("_wl_pid", "_wl_pos", "_wl_off"))


def assign_skey(new_rows: DataFrame, start: int | None, order_by, col: str = "SKEY",
                target: DataFrame | None = None) -> DataFrame:
    """KEY-1: next values of the table's key sequence for rows being inserted, in key order;
    with ``start=None`` the sequence continues after ``target``'s maximum (KEY-2)."""
    if start is None:
        return number_rows(new_rows, order_by, col=col, after_max_of=(target, col))
    return number_rows(new_rows, order_by, col=col, start=start)


def slices(df: DataFrame, order_by, size: int, col: str = "slice_id") -> DataFrame:
    """WN-2: row number over an order and the slice it falls in (``floor((rn-1)/size)``)."""
    out = number_rows(df, order_by, col="rn")
    return out.withColumn(col, F.floor((F.col("rn") - 1) / F.lit(size)).cast("long"))
