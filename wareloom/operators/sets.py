"""Set operations (UN-1 … UN-3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union_parts(*dfs: DataFrame) -> DataFrame:
    """UN-1: union by column name; columns missing in a part are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def distinct_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """UN-2: distinct rows (of ``cols``); partial de-duplication happens map-side."""
    return (df.select(*cols) if cols else df).distinct()


def key_difference(a: DataFrame, b: DataFrame, key: str, b_key: str | None = None) -> DataFrame:
    """UN-3: distinct keys of ``a`` absent from ``b``."""
    bk = b.select(b[b_key or key].alias(key))
    return a.select(key).distinct().join(bk, key, "left_anti")
