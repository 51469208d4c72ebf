"""Bound queries: SCD merges, loads, versions, incremental reads (SCD-*, LD-*, VER-*, INC-*, KEY-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge as M
from ..session import cut_lineage
from .registry import query
from .tables import (CUSTOMER_COLS, SQL_CUSTOMER_CHANGES, SQL_CUSTOMER_MAPPED, T0, TS, customer_changes, table,
                     customer_mapped, portable, sql_hash)

KEYS = ["c_custkey"]
HIGH = "TIMESTAMP '9999-12-31 00:00:00'"
_CUST_HASH = sql_hash(CUSTOMER_COLS)


def customer_dimension(spark, sf_dir):
    """Target at T0: every customer loaded once into a type-2 dimension, written as a table
    (a merge reads its target from storage, not from the lineage that produced it)."""
    return cut_lineage(M.initial_load(customer_mapped(spark, sf_dir), KEYS, T0, kind=M.DIM).target, "customer_dim")


def _sql_dim_at_t0(base: str, cols: list[str], key: str, hash_expr: str, kind: str = "DIM") -> str:
    validity = f"'Y' AS CURFLG, TIMESTAMP '{T0}' AS FROMDT, {HIGH} AS TODT, " if kind == "DIM" else ""
    return (f"SELECT CAST(row_number() OVER (ORDER BY {key}) AS BIGINT) AS SKEY, {', '.join(cols)}, "
            f"{hash_expr} AS RWHKEY, {validity}TIMESTAMP '{T0}' AS RECCRDT, TIMESTAMP '{T0}' AS RECUPDT "
            f"FROM ({base}) b")


def sql_scd(src: str, tgt: str, cols: list[str], key: str, hash_expr: str, scd_type: int, kind: str = "DIM") -> str:
    """Oracle text of a merge, written independently of the DataFrame code."""
    dim = kind == "DIM"
    cur = "AND t.CURFLG = 'Y'" if dim else ""
    ts = f"TIMESTAMP '{TS}'"
    nonkey = [c for c in cols if c != key]
    head = f"""WITH tgt AS ({tgt}),
src AS (SELECT *, {hash_expr} AS RWHKEY FROM ({src}) x),
cls AS (SELECT s.*, t.SKEY AS t_skey, COALESCE(t.RWHKEY, '') AS t_hash
        FROM src s LEFT JOIN tgt t ON s.{key} = t.{key} {cur}),
chg AS (SELECT * FROM cls WHERE t_skey IS NOT NULL AND t_hash <> RWHKEY)"""
    need = "t_skey IS NULL OR t_hash <> RWHKEY" if (scd_type == 2 and dim) else "t_skey IS NULL"
    validity_new = f", 'Y' AS CURFLG, {ts} AS FROMDT, {HIGH} AS TODT" if dim else ""
    ins = (f"SELECT (SELECT COALESCE(max(SKEY), 0) FROM tgt) + row_number() OVER (ORDER BY {key}) AS SKEY, "
           f"{', '.join(cols)}, RWHKEY{validity_new}, {ts} AS RECCRDT, {ts} AS RECUPDT FROM cls WHERE {need}")
    hist = "SELECT * FROM tgt WHERE CURFLG IS DISTINCT FROM 'Y' UNION ALL " if dim else ""
    curf = "WHERE t.CURFLG = 'Y'" if dim else ""
    hit = "x.{k} IS NOT NULL".format(k=key)
    if scd_type == 2 and dim:
        kept = (f"SELECT t.SKEY, {', '.join('t.' + c for c in cols)}, t.RWHKEY, "
                f"CASE WHEN {hit} THEN 'N' ELSE t.CURFLG END AS CURFLG, t.FROMDT, "
                f"CASE WHEN {hit} THEN {ts} ELSE t.TODT END AS TODT, t.RECCRDT, "
                f"CASE WHEN {hit} THEN {ts} ELSE t.RECUPDT END AS RECUPDT "
                f"FROM tgt t LEFT JOIN chg x ON t.{key} = x.{key} {curf}")
    else:
        sets = ", ".join(f"CASE WHEN {hit} THEN x.{c} ELSE t.{c} END AS {c}" for c in nonkey)
        validity = "t.CURFLG, t.FROMDT, t.TODT, " if dim else ""
        kept = (f"SELECT t.SKEY, t.{key}, {sets}, CASE WHEN {hit} THEN x.RWHKEY ELSE t.RWHKEY END AS RWHKEY, "
                f"{validity}t.RECCRDT, CASE WHEN {hit} THEN {ts} ELSE t.RECUPDT END AS RECUPDT "
                f"FROM tgt t LEFT JOIN chg x ON t.{key} = x.{key} {curf}")
    return f"{head}\nSELECT * FROM ({hist}{kept} UNION ALL {ins}) r"


def _money(sql: str, cols=("c_acctbal",)) -> str:
    rep = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) q"


_TGT_SQL = _sql_dim_at_t0(SQL_CUSTOMER_MAPPED, CUSTOMER_COLS, "c_custkey", _CUST_HASH)


@query("scd2_customer", _money(sql_scd(SQL_CUSTOMER_CHANGES, _TGT_SQL, CUSTOMER_COLS, "c_custkey", _CUST_HASH, 2)))
def scd2_customer(spark, sf_dir):
    """SCD-2 + HSH-1 + JN-1 + HSH-3 + KEY-1 (new keys from KEY-2 max + 1) on customer."""
    tgt = customer_dimension(spark, sf_dir)
    return portable(M.scd2_merge(customer_changes(spark, sf_dir), tgt, KEYS, TS).target)


@query("scd1_customer", _money(sql_scd(SQL_CUSTOMER_CHANGES, _TGT_SQL, CUSTOMER_COLS, "c_custkey", _CUST_HASH, 1)))
def scd1_customer(spark, sf_dir):
    """SCD-1: changed rows overwritten in place (same SKEY, RECCRDT kept)."""
    tgt = customer_dimension(spark, sf_dir)
    return portable(M.scd1_merge(customer_changes(spark, sf_dir), tgt, KEYS, TS).target)


@query("scd3_alias", _money(sql_scd(SQL_CUSTOMER_CHANGES, _TGT_SQL, CUSTOMER_COLS, "c_custkey", _CUST_HASH, 1)))
def scd3_alias(spark, sf_dir):
    """SCD-3: accepted and executed as type 1."""
    tgt = customer_dimension(spark, sf_dir)
    return portable(M.scd_merge(customer_changes(spark, sf_dir), tgt, KEYS, TS, scd_type=3).target)


# ----------------------------------------------------------------- counters (SCD-5)

def _counter_source(spark, sf_dir):
    """The change batch plus a resend: nation 3 customers without key (errors), nation 4
    customers again with a lower-cased name (duplicates; the resend wins by ``batch_seq``)."""
    c = customer_mapped(spark, sf_dir)
    base = customer_changes(spark, sf_dir).withColumn("batch_seq", F.lit(1))
    err = c.filter(F.col("c_nationkey") == 3).withColumn("c_custkey", F.lit(None).cast("long")) \
           .withColumn("batch_seq", F.lit(2))
    dup = c.filter(F.col("c_nationkey") == 4).withColumn("c_name", F.lower("c_name")).withColumn("batch_seq", F.lit(2))
    return base.unionByName(err).unionByName(dup)


_SQL_COUNTER_SRC = f"""
SELECT * FROM (
  SELECT *, 1 AS batch_seq FROM ({SQL_CUSTOMER_CHANGES}) a
  UNION ALL SELECT NULL AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, 2 FROM ({SQL_CUSTOMER_MAPPED}) b
            WHERE c_nationkey = 3
  UNION ALL SELECT c_custkey, lower(c_name), c_nationkey, c_acctbal, c_mktsegment, 2 FROM ({SQL_CUSTOMER_MAPPED}) c
            WHERE c_nationkey = 4) u"""


@query("scd_counters", f"""
WITH tgt AS ({_TGT_SQL}),
raw AS ({_SQL_COUNTER_SRC}),
ok AS (SELECT * FROM raw WHERE c_custkey IS NOT NULL
       QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY batch_seq DESC) = 1),
src AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, {_CUST_HASH} AS RWHKEY FROM ok),
cls AS (SELECT s.*, CASE WHEN t.SKEY IS NULL THEN 'NEW' WHEN s.RWHKEY <> COALESCE(t.RWHKEY, '') THEN 'CHANGED'
                         ELSE 'UNCHANGED' END AS change
        FROM src s LEFT JOIN tgt t ON s.c_custkey = t.c_custkey AND t.CURFLG = 'Y')
SELECT 'source_rows' AS metric, (SELECT count(*) FROM raw) AS value
UNION ALL SELECT 'inserted', count(*) FILTER (WHERE change IN ('NEW', 'CHANGED')) FROM cls
UNION ALL SELECT 'updated', 0
UNION ALL SELECT 'expired', count(*) FILTER (WHERE change = 'CHANGED') FROM cls
UNION ALL SELECT 'unchanged', count(*) FILTER (WHERE change = 'UNCHANGED') FROM cls
UNION ALL SELECT 'new_keys', count(*) FILTER (WHERE change = 'NEW') FROM cls
UNION ALL SELECT 'duplicates', (SELECT count(*) FROM raw WHERE c_custkey IS NOT NULL) - (SELECT count(*) FROM ok)
UNION ALL SELECT 'target_rows', count(*) FILTER (WHERE change IN ('NEW', 'CHANGED')) FROM cls
UNION ALL SELECT 'error_rows', (SELECT count(*) FROM raw WHERE c_custkey IS NULL)""")
def scd_counters(spark, sf_dir):
    """SCD-5: source / inserted / updated / expired / error counters of a type-2 merge
    (null keys rejected, in-batch duplicates resolved last-by-order)."""
    tgt = customer_dimension(spark, sf_dir)
    res = M.scd2_merge(_counter_source(spark, sf_dir), tgt, KEYS, TS, order_by=["batch_seq"])
    return res.summary


# ----------------------------------------------------------------- fact load (SCD-4)

ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_ORDER_HASH = sql_hash(ORDER_COLS, timestamps=("o_orderdate",))
_SQL_ORDERS_MAPPED = """SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice,
  o_orderdate, o_orderpriority FROM orders"""
_SQL_ORDERS_BATCH = f"""
  SELECT o_orderkey, o_custkey, 'F' AS o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice, o_orderdate,
         o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION ALL
  SELECT o_orderkey + 1000000000000, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)), o_orderdate,
         o_orderpriority FROM orders WHERE o_orderpriority = '5-LOW'"""


def _orders_mapped(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"),
                    "o_orderdate", "o_orderpriority")


def _orders_batch(spark, sf_dir):
    m = _orders_mapped(spark, sf_dir)
    upd = m.filter(F.col("o_orderpriority") == "1-URGENT").withColumn("o_orderstatus", F.lit("F"))
    new = m.filter(F.col("o_orderpriority") == "5-LOW").withColumn("o_orderkey", F.col("o_orderkey") + F.lit(10**12))
    return upd.unionByName(new)


@query("fact_merge_orders", _money(sql_scd(_SQL_ORDERS_BATCH,
                                           _sql_dim_at_t0(_SQL_ORDERS_MAPPED, ORDER_COLS, "o_orderkey", _ORDER_HASH, "FCT"),
                                           ORDER_COLS, "o_orderkey", _ORDER_HASH, 1, "FCT"), ("o_totalprice",)))
def fact_merge_orders(spark, sf_dir):
    """SCD-4: fact table merged by key (no validity columns, no CURFLG filter)."""
    tgt = cut_lineage(M.initial_load(_orders_mapped(spark, sf_dir), ["o_orderkey"], T0, kind=M.FCT).target, "orders_fct")
    return portable(M.fact_merge(_orders_batch(spark, sf_dir), tgt, ["o_orderkey"], TS).target)


# ----------------------------------------------------------------- combinations (SCD-6)

_SQL_ACCT_UPDATE = """
  SELECT c_custkey, c_name, c_nationkey,
         CAST(CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 100 ELSE c_acctbal END AS DECIMAL(18,2)) AS c_acctbal,
         c_mktsegment FROM customer"""
_SQL_NEW_FROM_SUPPLIER = """
  SELECT s_suppkey + 1000000000000 AS c_custkey, s_name AS c_name, s_nationkey AS c_nationkey,
         CAST(s_acctbal AS DECIMAL(18,2)) AS c_acctbal, 'SUPPLIER' AS c_mktsegment FROM supplier"""
_AFTER_A = sql_scd(_SQL_ACCT_UPDATE, _TGT_SQL, CUSTOMER_COLS, "c_custkey", _CUST_HASH, 1)


@query("mapping_two_sources", _money(sql_scd(_SQL_NEW_FROM_SUPPLIER, _AFTER_A, CUSTOMER_COLS, "c_custkey",
                                             _CUST_HASH, 2)))
def mapping_two_sources(spark, sf_dir):
    """SCD-6: two combinations into one target, applied in rule order (key-bearing, exec
    sequence, SCD type desc): balance corrections as type 1, then suppliers as type 2."""
    from .mapping import Combination, Mapping, run_mapping
    changes = customer_changes(spark, sf_dir)
    corrections = changes.filter(F.col("c_mktsegment") != "SUPPLIER")
    newcomers = changes.filter(F.col("c_mktsegment") == "SUPPLIER")
    mp = Mapping(KEYS, M.DIM, [Combination(newcomers, scd_type=2, exec_seq=2),
                              Combination(corrections, scd_type=1, exec_seq=1)])
    out, _ = run_mapping(mp, customer_dimension(spark, sf_dir), TS)
    return portable(out)


@query("truncate_then_merge", _money(f"""
SELECT CAST(row_number() OVER (ORDER BY c_custkey) AS BIGINT) AS SKEY, *, {_CUST_HASH} AS RWHKEY, 'Y' AS CURFLG,
       TIMESTAMP '{TS}' AS FROMDT, {HIGH} AS TODT, TIMESTAMP '{TS}' AS RECCRDT, TIMESTAMP '{TS}' AS RECUPDT
FROM ({SQL_CUSTOMER_CHANGES}) s"""))
def truncate_then_merge(spark, sf_dir):
    """LD-5: the job's truncate flag empties the target before the merge."""
    from .mapping import Combination, Mapping, run_mapping
    mp = Mapping(KEYS, M.DIM, [Combination(customer_changes(spark, sf_dir), scd_type=2)])
    out, _ = run_mapping(mp, customer_dimension(spark, sf_dir), TS, truncate=True)
    return portable(out)


# ----------------------------------------------------------------- file loads (LD-*)

PART_TARGET_SQL = f"""
  SELECT p_partkey, p_name, p_brand, p_type, p_size, CAST(p_retailprice AS DECIMAL(18,2)) AS p_retailprice,
         'LOADER' AS CRTDBY, TIMESTAMP '{T0}' AS CRTDDT, 'LOADER' AS UPDTBY, TIMESTAMP '{T0}' AS UPDTDT
  FROM part WHERE p_size <= 25"""
PART_INCOMING_SQL = f"""
  SELECT p_partkey, p_name, p_brand, p_type, p_size, CAST(p_retailprice * 1.1 AS DECIMAL(18,2)) AS p_retailprice,
         'SYSTEM' AS CRTDBY, TIMESTAMP '{TS}' AS CRTDDT, 'SYSTEM' AS UPDTBY, TIMESTAMP '{TS}' AS UPDTDT
  FROM part WHERE p_size > 20"""


def part_target(spark, sf_dir):
    """Target of the file loads at T0: parts up to size 25 loaded by LOADER."""
    p = table(spark, sf_dir, "part").filter(F.col("p_size") <= 25)
    t = p.select("p_partkey", "p_name", "p_brand", "p_type", "p_size",
                 F.col("p_retailprice").cast("decimal(18,2)").alias("p_retailprice"),
                 F.lit("LOADER").alias("CRTDBY"), F.lit(T0).cast("timestamp_ntz").alias("CRTDDT"),
                 F.lit("LOADER").alias("UPDTBY"), F.lit(T0).cast("timestamp_ntz").alias("UPDTDT"))
    return t


def part_incoming(spark, sf_dir):
    """Incoming file: parts above size 20 with prices raised by 10 % (sizes 21–25 overlap)."""
    p = table(spark, sf_dir, "part").filter(F.col("p_size") > 20)
    return p.select("p_partkey", "p_name", "p_brand", "p_type", "p_size",
                    (F.col("p_retailprice") * 1.1).cast("decimal(18,2)").alias("p_retailprice"))


_LOAD_DOCS = {
    "INSERT": "LD-1 append (LD-6 column alignment, audit stamps overwritten at load).",
    "TRUNCATE_LOAD": "LD-2 truncate-load: the target is replaced by the file.",
    "UPSERT": "LD-3 upsert by key over JN-12 full merge join: matched rows take the file's non-key values, "
              "created-by / created-date kept; LD-4: without a key the upsert appends.",
    "IF_ABSENT": "LD-7 insert if absent: only keys missing from the target are added (anti join).",
}


def _load(mode, keys=None):
    def run(spark, sf_dir):
        return portable(M.load(part_incoming(spark, sf_dir), part_target(spark, sf_dir), mode, keys=keys,
                               user="SYSTEM", ts=TS))
    run.__doc__ = _LOAD_DOCS[mode] + (" (no key given)" if mode == "UPSERT" and not keys else "")
    return run


def _money_p(sql):
    return _money(sql, ("p_retailprice",))


query("load_append", _money_p(f"{PART_TARGET_SQL} UNION ALL {PART_INCOMING_SQL}"))(_load("INSERT"))
query("load_truncate", _money_p(PART_INCOMING_SQL))(_load("TRUNCATE_LOAD"))
query("load_upsert_nokey", _money_p(f"{PART_TARGET_SQL} UNION ALL {PART_INCOMING_SQL}"))(_load("UPSERT"))
query("insert_if_absent", _money_p(f"""{PART_TARGET_SQL} UNION ALL
  SELECT * FROM ({PART_INCOMING_SQL}) i WHERE p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)"""))(
    _load("IF_ABSENT", ["p_partkey"]))
query("load_upsert", _money_p(f"""
WITH t AS ({PART_TARGET_SQL}), s AS ({PART_INCOMING_SQL})
SELECT COALESCE(s.p_partkey, t.p_partkey) AS p_partkey,
       CASE WHEN s.p_partkey IS NOT NULL THEN s.p_name ELSE t.p_name END AS p_name,
       CASE WHEN s.p_partkey IS NOT NULL THEN s.p_brand ELSE t.p_brand END AS p_brand,
       CASE WHEN s.p_partkey IS NOT NULL THEN s.p_type ELSE t.p_type END AS p_type,
       CASE WHEN s.p_partkey IS NOT NULL THEN s.p_size ELSE t.p_size END AS p_size,
       CASE WHEN s.p_partkey IS NOT NULL THEN s.p_retailprice ELSE t.p_retailprice END AS p_retailprice,
       CASE WHEN t.p_partkey IS NOT NULL THEN t.CRTDBY ELSE s.CRTDBY END AS CRTDBY,
       CASE WHEN t.p_partkey IS NOT NULL THEN t.CRTDDT ELSE s.CRTDDT END AS CRTDDT,
       CASE WHEN s.p_partkey IS NOT NULL THEN s.UPDTBY ELSE t.UPDTBY END AS UPDTBY,
       CASE WHEN s.p_partkey IS NOT NULL THEN s.UPDTDT ELSE t.UPDTDT END AS UPDTDT
FROM t FULL OUTER JOIN s ON t.p_partkey = s.p_partkey"""))(_load("UPSERT", ["p_partkey"]))


# ----------------------------------------------------------------- versions (VER-*)

_SQL_VER_T0 = f"""
  SELECT CAST(row_number() OVER (ORDER BY p_partkey) AS BIGINT) AS id, CAST(p_partkey AS VARCHAR) AS code,
         p_brand, p_type, CAST(p_retailprice AS DECIMAL(18,2)) AS p_retailprice, 'Y' AS curflg,
         TIMESTAMP '{T0}' AS reccrdt, TIMESTAMP '{T0}' AS recupdt FROM part"""
_SQL_VER_SRC = """
  SELECT CAST(p_partkey AS VARCHAR) AS code, p_brand,
         CASE WHEN p_size > 45 THEN p_type || '-X' ELSE p_type END AS p_type,
         CAST(p_retailprice AS DECIMAL(18,2)) AS p_retailprice FROM part"""
_SQL_VER = f"""
WITH t AS ({_SQL_VER_T0}), s AS ({_SQL_VER_SRC}),
n AS (SELECT s.* FROM s LEFT JOIN t ON s.code = t.code AND t.curflg = 'Y'
      WHERE t.code IS NULL OR s.p_brand IS DISTINCT FROM t.p_brand OR s.p_type IS DISTINCT FROM t.p_type
         OR s.p_retailprice IS DISTINCT FROM t.p_retailprice)
SELECT t.id, t.code, t.p_brand, t.p_type, t.p_retailprice,
       CASE WHEN n.code IS NOT NULL THEN 'N' ELSE t.curflg END AS curflg, t.reccrdt,
       CASE WHEN n.code IS NOT NULL THEN TIMESTAMP '{TS}' ELSE t.recupdt END AS recupdt
FROM t LEFT JOIN n ON t.code = n.code
UNION ALL
SELECT (SELECT max(id) FROM t) + row_number() OVER (ORDER BY code), code, p_brand, p_type, p_retailprice, 'Y',
       TIMESTAMP '{TS}', TIMESTAMP '{TS}' FROM n"""


def _versions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    from ..operators.keys import number_rows
    t0 = number_rows(p.select(F.col("p_partkey").cast("string").alias("code"), "p_brand", "p_type",
                              F.col("p_retailprice").cast("decimal(18,2)").alias("p_retailprice"),
                              F.col("p_partkey")), "p_partkey", col="id")
    t0 = t0.select("id", "code", "p_brand", "p_type", "p_retailprice", F.lit("Y").alias("curflg"),
                   F.lit(T0).cast("timestamp_ntz").alias("reccrdt"), F.lit(T0).cast("timestamp_ntz").alias("recupdt"))
    src = p.select(F.col("p_partkey").cast("string").alias("code"), "p_brand",
                   F.when(F.col("p_size") > 45, F.concat("p_type", F.lit("-X"))).otherwise(F.col("p_type")).alias("p_type"),
                   F.col("p_retailprice").cast("decimal(18,2)").alias("p_retailprice"))
    return M.versioned_upsert(src, t0, "code", ["p_brand", "p_type", "p_retailprice"], TS)


@query("versioned_upsert", _money(_SQL_VER, ("p_retailprice",)))
def versioned_upsert(spark, sf_dir):
    """VER-1: changed codes get their current version closed and a new version with the next id."""
    return portable(_versions(spark, sf_dir))


@query("version_history", _money(f"SELECT * FROM ({_SQL_VER}) v WHERE curflg = 'N'", ("p_retailprice",)))
def version_history(spark, sf_dir):
    """VER-2: closed versions (every code), newest first per code."""
    v = _versions(spark, sf_dir)
    return portable(M.version_history(v, "code", None))


# ----------------------------------------------------------------- incremental reads (INC-*)

@query("resume_single", "SELECT * FROM orders WHERE o_orderkey > 7500")
def resume_single(spark, sf_dir):
    """INC-1: orders after the stored key 7500 (checkpoint text cast to the key type)."""
    from ..operators.incremental import resume_after
    return resume_after(table(spark, sf_dir, "orders"), ["o_orderkey"], "7500")


@query("resume_composite", """
SELECT * FROM lineitem WHERE l_orderkey > 5000 OR (l_orderkey = 5000 AND l_linenumber > 3)""")
def resume_composite(spark, sf_dir):
    """INC-2: lineitem after the composite key ``5000|3`` (FLT-6 tuple comparison, pushed to the scan)."""
    from ..operators.incremental import resume_after
    return resume_after(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "5000|3")


@query("resume_rows", "SELECT * FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey) > 1000")
def resume_rows(spark, sf_dir):
    """INC-3: skip the first 1000 rows in key order (distributed numbering)."""
    from ..operators.incremental import resume_after_rows
    return resume_after_rows(table(spark, sf_dir, "orders"), 1000, ["o_orderkey"])


@query("high_water", """
SELECT (SELECT CAST(max(o_orderkey) AS VARCHAR) FROM orders) AS single_mark,
       (SELECT CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) FROM lineitem
        ORDER BY l_orderkey DESC, l_linenumber DESC LIMIT 1) AS composite_mark""")
def high_water(spark, sf_dir):
    """INC-5: maximum key processed (typed comparison, stored as text)."""
    from ..operators.incremental import high_water as hw
    a = hw(table(spark, sf_dir, "orders"), ["o_orderkey"]).withColumnRenamed("mark", "single_mark")
    b = hw(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]).withColumnRenamed("mark", "composite_mark")
    # two one-row aggregates side by side: both sides have exactly one row
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")


@query("backfill_daily", """
SELECT CAST(ts AS DATE) AS run_date, strftime(CAST(ts AS DATE), '%d-%b-%Y') AS run_param,
       count(*) AS rows_loaded, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value_total
FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-20'
GROUP BY 1, 2""")
def backfill_daily(spark, sf_dir):
    """INC-7: daily slices 2024-01-03 … 2024-01-20 with ``DD-Mon-YYYY`` parameters, in one pass
    (append load); per slice the rows loaded."""
    from .mapping import backfill
    e = table(spark, sf_dir, "events")
    b = backfill(e, "ts", "2024-01-03", "2024-01-20")
    return b.groupBy("run_date", "run_param").agg(
        F.count(F.lit(1)).alias("rows_loaded"),
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value_total"))
