"""Bound queries: column mapping, formulas, projections, row hash, change detection
(PRJ-*, FN-*, HSH-*, JN-1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formulas as fx
from ..functions.hashing import row_hash
from ..operators import changes as C
from ..operators import columns as P
from ..sources.readers import number_in_file_order
from ..types import ColumnSpec
from .q_merges import _TGT_SQL, KEYS, customer_dimension
from .registry import query
from .tables import (CUSTOMER_COLS, SQL_CUSTOMER_CHANGES, SQL_CUSTOMER_MAPPED, TS, customer_changes,
                     customer_mapped, sql_hash, table)


@query("map_columns_fallback", """
SELECT c_custkey,
       COALESCE(CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE upper(c_name) END, c_name) AS cust_name,
       c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS note
FROM customer""")
def map_columns_fallback(spark, sf_dir):
    """PRJ-1: mapped column, per-value fallback to the target-named column, NULL when absent
    (FLT-1 current-row filter and FLT-2 null-key split are part of every merge query)."""
    c = table(spark, sf_dir, "customer")
    src = c.select("c_custkey", F.col("c_name").alias("CUST_NAME"),
                   F.when(F.col("c_custkey") % 7 == 0, F.lit(None)).otherwise(F.upper("c_name")).alias("alt_name"),
                   "c_mktsegment")
    return P.map_columns(src, {"cust_name": "ALT_NAME", "segment": "c_mktsegment"},
                         ["c_custkey", "cust_name", "segment", "note"])


def _part_file(spark, sf_dir, numbered: str | None = None):
    """``part`` as a delimited file would arrive: every value text, padded, some blanks; ``numbered`` adds the row's
    position in the file."""
    p = table(spark, sf_dir, "part")
    if numbered:
        p = number_in_file_order(p, numbered)
    return p.select(*([numbered] if numbered else []),
                    F.col("p_partkey").cast("string").alias("PARTKEY"),
                    F.concat(F.lit("  "), F.col("p_name"), F.lit(" ")).alias("Name"),
                    F.when(F.col("p_size") < 10, F.lit("")).otherwise(F.col("p_brand")).alias("brand"),
                    F.col("p_type").alias("TYPE"),
                    F.col("p_retailprice").cast("decimal(18,2)").cast("string").alias("PRICE"))


_PART_SPEC = [ColumnSpec("part_id", "BIGINT", "partkey", key_seq=1), ColumnSpec("part_name", "String50", "NAME"),
              ColumnSpec("brand", "String20", "BRAND", default="UNKNOWN"), ColumnSpec("price", "DECIMAL", "price"),
              ColumnSpec("colour", "String20", "COLOUR")]


@query("file_map_trim_default", f"""
SELECT NULLIF(trim(CAST(p_partkey AS VARCHAR)), '') AS part_id,
       NULLIF(trim('  ' || p_name || ' '), '') AS part_name,
       COALESCE(NULLIF(trim(CASE WHEN p_size < 10 THEN '' ELSE p_brand END), ''), 'UNKNOWN') AS brand,
       NULLIF(trim(CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR)), '') AS price,
       CAST(NULL AS VARCHAR) AS colour,
       'SYSTEM' AS CRTDBY, TIMESTAMP '{TS}' AS CRTDDT
FROM part""")
def file_map_trim_default(spark, sf_dir):
    """PRJ-2 + PRJ-3 + PRJ-6: map file columns, trim / blank -> NULL, defaults, audit stamps."""
    f = P.map_file_columns(_part_file(spark, sf_dir), _PART_SPEC)
    f = P.apply_defaults(f, {c.target: c.default for c in _PART_SPEC if c.default is not None})
    return P.stamp_audit(f, ["CRTDBY", "CRTDDT"], None, TS)


@query("formula_text", """
SELECT p_partkey,
       COALESCE(p_name, '') || '-' || COALESCE(p_brand, '') || '-' || COALESCE(CAST(p_size AS VARCHAR), '') AS f_concat,
       COALESCE(NULLIF(CASE WHEN p_size < 10 THEN '' ELSE p_brand END, ''), NULLIF(p_type, '')) AS f_coalesce,
       string_split(p_name, ' ')[2] AS f_split1, string_split(p_name, ' ')[3] AS f_split2,
       string_split(p_name, ' ')[-1] AS f_split_last,
       upper(p_name) AS f_upper, lower(p_brand) AS f_lower,
       regexp_replace('  ' || p_type || chr(9), '^\\s+|\\s+$', '', 'g') AS f_trim,
       COALESCE(length(p_name), 0) AS f_len,
       COALESCE(length(CASE WHEN p_size < 10 THEN NULL ELSE p_brand END), 0) AS f_len_null,
       substring(p_name, 3, 4) AS f_sub, substring(p_name, 7) AS f_sub_tail,
       replace(p_brand, 'Brand#', 'B-') AS f_replace
FROM part""")
def formula_text(spark, sf_dir):
    """FN-1 CONCAT, FN-2 COALESCE, FN-3 SPLIT, FN-4 UPPER, FN-5 LOWER, FN-6 TRIM, FN-9 LEN,
    FN-10 SUBSTRING, FN-11 REPLACE as Column builders (UD-3: looked up by name in the catalogue)."""
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey",
        fx.concat("p_name", F.lit("-"), "p_brand", F.lit("-"), "p_size").alias("f_concat"),
        fx.coalesce(F.when(F.col("p_size") < 10, F.lit("")).otherwise(F.col("p_brand")), "p_type").alias("f_coalesce"),
        fx.split("p_name", " ", 1).alias("f_split1"), fx.split("p_name", " ", 2).alias("f_split2"),
        fx.split("p_name", " ", -1).alias("f_split_last"),
        fx.upper("p_name").alias("f_upper"), fx.lower("p_brand").alias("f_lower"),
        fx.trim(F.concat(F.lit("  "), F.col("p_type"), F.lit("\t"))).alias("f_trim"),
        fx.len_("p_name").alias("f_len"),
        fx.len_(F.when(F.col("p_size") >= 10, F.col("p_brand"))).alias("f_len_null"),
        fx.substring("p_name", 2, 4).alias("f_sub"), fx.substring("p_name", 6).alias("f_sub_tail"),
        fx.call("replace", "p_brand", "Brand#", "B-").alias("f_replace"))


_DIV = "((l_orderkey % 7) - 3)"


@query("formula_numeric", f"""
SELECT l_orderkey, l_linenumber,
       abs(l_extendedprice - 50000.0) AS n_abs,
       CAST(round_even(CAST(l_extendedprice AS DECIMAL(18,2)), 1) AS DOUBLE) AS n_round,
       l_quantity + l_tax AS n_plus, l_extendedprice - l_quantity AS n_minus,
       l_quantity * l_extendedprice AS n_times,
       CASE WHEN l_tax = 0 THEN NULL ELSE l_extendedprice / l_tax END AS n_div,
       CASE WHEN {_DIV} = 0 THEN NULL ELSE ((l_linenumber % {_DIV}) + {_DIV}) % {_DIV} END AS n_mod,
       -l_quantity AS n_neg
FROM lineitem""")
def formula_numeric(spark, sf_dir):
    """FN-7 ABS, FN-8 ROUND (decimal ties), FN-12 plus, FN-13 minus / times, FN-14 divide,
    FN-15 floored modulo, FN-16 unary minus, FN-17 constants and names."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber",
        fx.abs_(F.col("l_extendedprice") - F.lit(50000.0)).alias("n_abs"),
        fx.round_(F.col("l_extendedprice").cast("decimal(18,2)"), 1, as_double=False).cast("double").alias("n_round"),
        fx.plus("l_quantity", "l_tax").alias("n_plus"), fx.minus("l_extendedprice", "l_quantity").alias("n_minus"),
        fx.times("l_quantity", "l_extendedprice").alias("n_times"),
        fx.divide("l_extendedprice", "l_tax").alias("n_div"),
        fx.modulo("l_linenumber", (F.col("l_orderkey") % 7) - 3).alias("n_mod"),
        fx.neg("l_quantity").alias("n_neg"))


_FIELDS = [
    {"alias": "order_key", "expr": "l_orderkey"},
    {"alias": "price", "expr": "l_extendedprice"},
    {"alias": "disc_price", "expr": "price * (1 - l_discount)"},
    {"alias": "with_tax", "expr": "disc_price * (1 + l_tax)"},
    {"alias": "ghost", "expr": "no_such_field + 1"},
    {"alias": "hidden", "expr": "l_partkey", "visible": False},
    {"alias": "hidden_twice", "expr": "hidden * 2"},
]


@query("project_fields_chained", """
SELECT l_orderkey AS order_key, l_extendedprice AS price, l_extendedprice * (1 - l_discount) AS disc_price,
       l_extendedprice * (1 - l_discount) * (1 + l_tax) AS with_tax, CAST(NULL AS VARCHAR) AS ghost,
       l_partkey * 2 AS hidden_twice
FROM lineitem""")
def project_fields_chained(spark, sf_dir):
    """PRJ-5: each field sees earlier aliases; unresolvable -> NULL; hidden fields dropped."""
    out = P.project_fields(table(spark, sf_dir, "lineitem"), _FIELDS)
    return out.withColumn("ghost", F.col("ghost").cast("string"))


@query("json_safe_orders", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
       strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate, o_orderpriority,
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS total_dec
FROM orders""")
def json_safe_orders(spark, sf_dir):
    """PRJ-8: decimals -> double, timestamps -> ISO text."""
    o = table(spark, sf_dir, "orders")
    return P.json_safe(o.withColumn("total_dec", F.col("o_totalprice").cast("decimal(18,2)")))


_BY_NAME = sorted(CUSTOMER_COLS)


@query("row_hash_customer", f"SELECT c_custkey, {sql_hash(CUSTOMER_COLS)} AS RWHKEY FROM ({SQL_CUSTOMER_MAPPED}) m")
def row_hash_customer(spark, sf_dir):
    """HSH-1: MD5 over values in execution order."""
    m = customer_mapped(spark, sf_dir)
    return m.select("c_custkey", row_hash(m, order=CUSTOMER_COLS).alias("RWHKEY"))


@query("row_hash_by_name", f"SELECT c_custkey, {sql_hash(_BY_NAME)} AS RWHKEY FROM ({SQL_CUSTOMER_MAPPED}) m")
def row_hash_by_name(spark, sf_dir):
    """HSH-2: MD5 over values in column-name order."""
    m = customer_mapped(spark, sf_dir)
    return m.select("c_custkey", row_hash(m, by_name=True).alias("RWHKEY"))


_CH = sql_hash(CUSTOMER_COLS)


@query("classify_changes", f"""
WITH tgt AS ({_TGT_SQL}),
src AS (SELECT *, {_CH} AS RWHKEY FROM ({SQL_CUSTOMER_CHANGES}) x)
SELECT s.c_custkey, t.SKEY AS t_SKEY,
       CASE WHEN t.SKEY IS NULL THEN 'NEW' WHEN s.RWHKEY <> COALESCE(t.RWHKEY, '') THEN 'CHANGED'
            ELSE 'UNCHANGED' END AS change
FROM src s LEFT JOIN tgt t ON s.c_custkey = t.c_custkey AND t.CURFLG = 'Y'""")
def classify_changes(spark, sf_dir):
    """HSH-3 over JN-1: NEW / CHANGED / UNCHANGED per source row."""
    src = customer_changes(spark, sf_dir)
    src = src.withColumn("RWHKEY", row_hash(src, order=CUSTOMER_COLS))
    return C.classify(src, customer_dimension(spark, sf_dir), KEYS).select("c_custkey", "t_SKEY", "change")


@query("columnwise_changes", f"""
SELECT s.c_custkey,
       (s.c_name IS DISTINCT FROM t.c_name) OR (s.c_acctbal IS DISTINCT FROM t.c_acctbal)
       OR (s.c_mktsegment IS DISTINCT FROM t.c_mktsegment) AS changed
FROM ({SQL_CUSTOMER_CHANGES}) s JOIN ({SQL_CUSTOMER_MAPPED}) t ON s.c_custkey = t.c_custkey""")
def columnwise_changes(spark, sf_dir):
    """HSH-4: NULL-safe column-by-column compare of matched rows."""
    s = customer_changes(spark, sf_dir).alias("s")
    t = customer_mapped(spark, sf_dir).alias("t")
    return s.join(t, F.col("s.c_custkey") == F.col("t.c_custkey")).select(
        F.col("s.c_custkey").alias("c_custkey"),
        C.changed(["c_name", "c_acctbal", "c_mktsegment"]).alias("changed"))
