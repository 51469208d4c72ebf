"""Access to the supplied tables and the shared bindings used by the query catalogue."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Run times used by every bound query (deterministic reruns).
T0 = "2024-01-01 00:00:00"        # first load of a target
TS = "2024-01-30 00:00:00"        # the run being evaluated (= as_of of the run-log queries)
NEW_KEY_OFFSET = 1_000_000_000_000  # supplier keys re-used as brand-new customer keys


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def portable(df: DataFrame) -> DataFrame:
    """Decimals -> double for result sets handed out (PRJ-8's numeric rule only)."""
    return df.select(*[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType)
                       else F.col(f.name) for f in df.schema.fields])


# ------------------------------------------------------------------ customer dimension binding

CUSTOMER_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def customer_mapped(spark, sf_dir) -> DataFrame:
    """Customers in the declared target types (money as DECIMAL(18,2))."""
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", "c_name", "c_nationkey",
                    F.col("c_acctbal").cast("decimal(18,2)").alias("c_acctbal"), "c_mktsegment")


def customer_changes(spark, sf_dir) -> DataFrame:
    """Source batch at TS: every tenth customer's balance raised by 100, plus suppliers
    arriving as new customers."""
    c = table(spark, sf_dir, "customer")
    s = table(spark, sf_dir, "supplier")
    changed = c.select("c_custkey", "c_name", "c_nationkey",
                       F.when(F.col("c_custkey") % 10 == 0, F.col("c_acctbal") + 100)
                        .otherwise(F.col("c_acctbal")).cast("decimal(18,2)").alias("c_acctbal"),
                       "c_mktsegment")
    new = s.select((F.col("s_suppkey") + F.lit(NEW_KEY_OFFSET)).alias("c_custkey"), F.col("s_name").alias("c_name"),
                   F.col("s_nationkey").alias("c_nationkey"),
                   F.col("s_acctbal").cast("decimal(18,2)").alias("c_acctbal"),
                   F.lit("SUPPLIER").alias("c_mktsegment"))
    return changed.unionByName(new)


# --------------------------------------------------------------- SQL fragments for the oracle

def sql_hash(cols: list[str], decimals: dict | None = None, timestamps=()) -> str:
    """DuckDB text of the row hash over ``cols`` (same canonical forms as functions.hashing)."""
    decimals = decimals or {}
    parts = []
    for c in cols:
        if c in timestamps:
            e = f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
        elif c in decimals:
            e = f"CAST(CAST({c} AS {decimals[c]}) AS VARCHAR)"
        else:
            e = f"CAST({c} AS VARCHAR)"
        parts.append(f"COALESCE({e}, '<NULL>')")
    return "md5(concat_ws('|', " + ", ".join(parts) + "))"


SQL_CUSTOMER_MAPPED = """
  SELECT c_custkey, c_name, c_nationkey, CAST(c_acctbal AS DECIMAL(18,2)) AS c_acctbal, c_mktsegment FROM customer
"""

SQL_CUSTOMER_CHANGES = f"""
  SELECT c_custkey, c_name, c_nationkey,
         CAST(CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 100 ELSE c_acctbal END AS DECIMAL(18,2)) AS c_acctbal,
         c_mktsegment FROM customer
  UNION ALL
  SELECT s_suppkey + {NEW_KEY_OFFSET} AS c_custkey, s_name AS c_name, s_nationkey AS c_nationkey,
         CAST(s_acctbal AS DECIMAL(18,2)) AS c_acctbal, 'SUPPLIER' AS c_mktsegment FROM supplier
"""
