"""Join operators (JN-2 … JN-13) beyond the key lookup of ``changes``.

All are equi-joins on keys; the shuffle-vs-broadcast choice is left to AQE, which switches
to a broadcast only when the runtime size of a side is under the threshold.
The interval join (JN-9) adds a time bucket to the equi-key so that candidates are only the
rows of neighbouring buckets, never all pairs of a key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import epoch_micros


def with_count(df: DataFrame, child: DataFrame, key: str | list[str], cond: Column | None = None,
               child_key: str | list[str] | None = None, out: str = "cnt") -> DataFrame:
    """JN-6: scalar count subquery as aggregate (map-side partial) + left join, 0 when none."""
    keys = [key] if isinstance(key, str) else list(key)
    ckeys = keys if child_key is None else ([child_key] if isinstance(child_key, str) else list(child_key))
    c = child.filter(cond) if cond is not None else child
    agg = c.groupBy(*[F.col(ck).alias(k) for ck, k in zip(ckeys, keys)]).agg(F.count(F.lit(1)).alias(out))
    return df.join(agg, keys, "left").withColumn(out, F.coalesce(F.col(out), F.lit(0)).cast("long"))


def children_of(df: DataFrame, id_col: str, parent_col: str, child_filter: Column | None = None,
                current: Column | None = None) -> DataFrame:
    """JN-7: every (parent, child) where the child's dependency id equals the parent's id,
    both current, child passing ``child_filter`` (self join on the id)."""
    p = df.filter(current) if current is not None else df
    c = df.filter(current) if current is not None else df
    if child_filter is not None:
        c = c.filter(child_filter)
    return p.alias("p").join(c.alias("c"), F.col(f"c.{parent_col}") == F.col(f"p.{id_col}"))


def missing_keys(a: DataFrame, b: DataFrame, keys: list[str], b_keys: list[str] | None = None) -> DataFrame:
    """JN-8: rows of ``a`` whose key does not occur in ``b`` (left anti join)."""
    if b_keys is None or b_keys == keys:
        return a.join(b.select(*keys), keys, "left_anti")
    cond = reduce(lambda x, y: x & y, [a[k] == b[bk] for k, bk in zip(keys, b_keys)])
    return a.join(b, cond, "left_anti")


def keep_ids(df: DataFrame, ids: DataFrame, key: str, ids_key: str | None = None) -> DataFrame:
    """JN-13: rows whose id is in a set of ids (left semi join; duplicates in ``ids`` do not multiply rows)."""
    ik = ids_key or key
    return df.join(ids.select(F.col(ik).alias(key)), key, "left_semi")


def match_within(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str,
                 seconds: int = 3600, right_key: str | None = None) -> DataFrame:
    """JN-9: pairs with equal key and ``|right_ts - left_ts| <= seconds``.

    Both sides get a bucket ``floor(epoch / seconds)``; the left side is repeated into the
    three buckets that can hold a match, so the join key is (key, bucket) and a hot key is
    split across buckets instead of producing all pairs of the key.
    """
    rk = right_key or key
    us = seconds * 1_000_000

    def epoch(c):
        return epoch_micros(F.col(c))
    lb = left.withColumn("_b0", F.floor(epoch(left_ts) / F.lit(us)))
    lb = lb.withColumn("_b", F.explode(F.array(F.col("_b0") - 1, F.col("_b0"), F.col("_b0") + 1))).drop("_b0")
    rb = right.withColumn("_b", F.floor(epoch(right_ts) / F.lit(us)))
    j = lb.alias("l").join(rb.alias("r"), (F.col(f"l.{key}") == F.col(f"r.{rk}")) & (F.col("l._b") == F.col("r._b")))
    gap = F.abs(epoch(f"r.{right_ts}") - epoch(f"l.{left_ts}"))
    return j.filter(gap <= F.lit(us)).drop(F.col("l._b")).drop(F.col("r._b"))
