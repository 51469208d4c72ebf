"""Bound queries: operators on rows that do not fit - short and long lines, NULL keys, bad values, repeated keys,
several current rows - and the registration hooks."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..functions import formulas as fx
from ..operators import changes as CH
from ..operators import columns as P
from ..operators import merge as M
from ..operators import windows as W
from ..sources import readers as RD
from ..sources import sinks as SK
from . import mapping as MP
from .registry import query
from .tables import TS, table


def _write_with_header(spark, sf_dir, sep=","):
    """``part`` as text files that each start with the header line: every 7th line has two fields, every 11th two too many."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    full = F.concat_ws(sep, k.cast("string"), "p_name", "p_brand", F.col("p_size").cast("string"))
    line = (F.when(k % 11 == 0, F.concat(full, F.lit(f"{sep}x{sep}y"))).when(k % 7 == 0, F.concat_ws(sep, k.cast("string"), "p_name"))
            .otherwise(full))
    path = os.path.join(SK.scratch_dir(spark, "lines"), "in.csv")
    header = sep.join(["p_partkey", "p_name", "p_brand", "p_size"])
    p.select(line.alias(header)).write.option("header", "true").option("quote", "").option("sep", "\u0001").csv(path)
    return path


@query("read_short_lines", """
SELECT p_partkey, p_name, CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS p_brand,
       CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_size AS VARCHAR) END AS p_size
FROM part WHERE p_partkey % 11 <> 0""")
def read_short_lines(spark, sf_dir):
    """SRC-1: lines with too few fields are kept with NULLs, lines with too many are left out."""
    rows, _ = RD.read_delimited_checked(spark, _write_with_header(spark, sf_dir))
    return rows.select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name", "p_brand", "p_size")


@query("read_long_lines", """
SELECT CAST(p_partkey AS VARCHAR) || ',' || p_name || ',' || p_brand || ',' || CAST(p_size AS VARCHAR) || ',x,y' AS line
FROM part WHERE p_partkey % 11 = 0""")
def read_long_lines(spark, sf_dir):
    """SRC-1: the lines with too many fields, set aside whole."""
    return RD.read_delimited_checked(spark, _write_with_header(spark, sf_dir))[1]


def _batch(spark, sf_dir):
    """A mixed batch for a (p_partkey, p_name, p_size) target: text sizes of which every 9th is no number, every 5th key NULL,
    every 6th row twice."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    b = p.select(F.when(k % 5 != 0, k).alias("p_partkey"), F.concat(F.lit("new "), "p_name").alias("p_name"),
                 F.when(k % 9 == 0, F.lit("n/a")).otherwise(F.col("p_size").cast("string")).alias("p_size"), k.alias("src"))
    return b.unionByName(b.where("src % 6 = 0")).drop("src")


def _target(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select("p_partkey", F.concat(F.lit("old "), "p_name").alias("p_name"),
                                                                          F.col("p_size").cast("int").alias("p_size"))


_BATCH_SQL = """(SELECT CASE WHEN p_partkey % 5 <> 0 THEN p_partkey END AS p_partkey, 'new ' || p_name AS p_name,
  CASE WHEN p_partkey % 9 = 0 THEN 'n/a' ELSE CAST(p_size AS VARCHAR) END AS p_size,
  unnest(CASE WHEN p_partkey % 6 = 0 THEN [1, 2] ELSE [1] END) AS copy FROM part)"""
_TGT_SQL = "(SELECT p_partkey, 'old ' || p_name AS p_name, CAST(p_size AS INTEGER) AS p_size FROM part WHERE p_partkey % 2 = 0)"
_GOOD_SQL = f"(SELECT DISTINCT p_partkey, p_name, CAST(p_size AS INTEGER) AS p_size FROM {_BATCH_SQL} b WHERE p_partkey IS NOT NULL AND p_size <> 'n/a')"


@query("load_rejects", f"""
SELECT p_partkey, p_name, p_size, concat_ws('; ', CASE WHEN p_size = 'n/a' THEN 'p_size: not int' END,
       CASE WHEN p_partkey IS NULL THEN 'p_partkey: NULL key' END) AS reject_reason
FROM {_BATCH_SQL} b WHERE p_size = 'n/a' OR p_partkey IS NULL""")
def load_rejects(spark, sf_dir):
    """LD-3 / DQ: a bad value or a NULL key costs its row, with the reason, not the load."""
    return M.load_checked(_batch(spark, sf_dir), _target(spark, sf_dir), "UPSERT", ["p_partkey"]).rejected


@query("load_insert_rejects", f"""
SELECT p_partkey, p_name, p_size FROM {_TGT_SQL} t
UNION ALL SELECT p_partkey, p_name, CAST(p_size AS INTEGER) FROM {_BATCH_SQL} b WHERE p_size <> 'n/a'""")
def load_insert_rejects(spark, sf_dir):
    """LD-1: the rows that fit are appended (an append has no key, so NULL keys are rows like others)."""
    return M.load_checked(_batch(spark, sf_dir), _target(spark, sf_dir), "INSERT").target


@query("load_summary", f"""
SELECT 'source_rows' AS metric, count(*) AS value FROM {_BATCH_SQL} b
UNION ALL SELECT 'rejected_rows', count(*) FROM {_BATCH_SQL} b WHERE p_size = 'n/a' OR p_partkey IS NULL
UNION ALL SELECT 'accepted_rows', count(*) FROM {_GOOD_SQL} g
UNION ALL SELECT 'duplicates', (SELECT count(*) FROM {_BATCH_SQL} b WHERE p_size <> 'n/a' AND p_partkey IS NOT NULL) - (SELECT count(*) FROM {_GOOD_SQL} g)""")
def load_summary(spark, sf_dir):
    """LD-*: what a load read, accepted, rejected and found twice."""
    return M.load_checked(_batch(spark, sf_dir), _target(spark, sf_dir), "UPSERT", ["p_partkey"]).summary


@query("load_into_counts", f"""
SELECT 'loaded_rows' AS metric, count(*) AS value FROM {_GOOD_SQL} g
UNION ALL SELECT 'duplicates', (SELECT count(*) FROM {_BATCH_SQL} b WHERE p_size <> 'n/a' AND p_partkey IS NOT NULL) - (SELECT count(*) FROM {_GOOD_SQL} g)
UNION ALL SELECT 'table_rows', (SELECT count(*) FROM (SELECT p_partkey FROM {_TGT_SQL} t UNION SELECT p_partkey FROM {_GOOD_SQL} g) x)
UNION ALL SELECT 'rejected_rows', count(*) FROM {_BATCH_SQL} b WHERE p_size = 'n/a' OR p_partkey IS NULL""")
def load_into_counts(spark, sf_dir):
    """LD-3 / DQ-8 / SS-1: a load into a versioned table, delivered twice; the counts are those its one write took."""
    t = SK.SnapshotTable(spark, os.path.join(SK.scratch_dir(spark, "load-into"), "part"))
    t.commit(_target(spark, sf_dir), 0)
    M.load_into(t, _batch(spark, sf_dir), 1, "UPSERT", ["p_partkey"])
    return M.load_into(t, _batch(spark, sf_dir), 1, "UPSERT", ["p_partkey"])


@query("upsert_null_keys", f"""
SELECT coalesce(g.p_partkey, t.p_partkey) AS p_partkey, CASE WHEN g.p_partkey IS NULL THEN t.p_name ELSE g.p_name END AS p_name,
       CASE WHEN g.p_partkey IS NULL THEN t.p_size ELSE g.p_size END AS p_size
FROM {_TGT_SQL} t FULL JOIN {_GOOD_SQL} g ON g.p_partkey = t.p_partkey""")
def upsert_null_keys(spark, sf_dir):
    """LD-3: rows without a key are set aside, not merged into one."""
    return M.load(_batch(spark, sf_dir), _target(spark, sf_dir), "UPSERT", ["p_partkey"])


@query("if_absent_repeated", f"""
SELECT p_partkey, p_name, p_size FROM {_TGT_SQL} t
UNION ALL SELECT * FROM {_GOOD_SQL} g WHERE p_partkey % 2 <> 0""")
def if_absent_repeated(spark, sf_dir):
    """LD-7: a new key that the batch holds twice is inserted once."""
    return M.load(_batch(spark, sf_dir), _target(spark, sf_dir), "IF_ABSENT", ["p_partkey"])


@query("if_absent_counts", f"""
SELECT 'created' AS metric, count(DISTINCT p_partkey) FILTER (WHERE p_partkey % 2 <> 0) AS value FROM {_GOOD_SQL} g
UNION ALL SELECT 'skipped', count(DISTINCT p_partkey) FILTER (WHERE p_partkey % 2 = 0) FROM {_GOOD_SQL} g""")
def if_absent_counts(spark, sf_dir):
    """LD-7: keys created and skipped."""
    target = _target(spark, sf_dir)
    good, _ = M.split_castable(_batch(spark, sf_dir), target.schema, ["p_partkey"])
    return M.load_counts(good, target, ["p_partkey"])


@query("lookup_two_current", """
SELECT o.o_custkey AS custkey, o.first_key AS t_SKEY, c.c_name FROM customer c
LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS first_key FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey
WHERE o.o_custkey IS NOT NULL""")
def lookup_two_current(spark, sf_dir):
    """JN-1 where the target holds several current rows of a key: one source row gives one row, with the first hit."""
    src = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), "c_name")
    tgt = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("SKEY"), F.lit("Y").alias("CURFLG"))
    return CH.lookup_current(src, tgt, ["custkey"], ["SKEY"]).where("t_SKEY IS NOT NULL").select("custkey", "t_SKEY", "c_name")


@query("derive_defaults", """
SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN p_size * 2 END, -1) AS doubled, upper(p_name) AS p_name,
       p_brand || '/' || p_name AS label FROM part""")
def derive_defaults(spark, sf_dir):
    """PRJ-4: formulas over the un-derived row (``label`` sees the raw name), a default of another type cast to the formula's."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", F.col("p_size").cast("long").alias("p_size"))
    out = P.derive(p, {"doubled": F.when(F.col("p_size") > 25, F.col("p_size") * 2), "p_name": lambda d: F.upper("p_name"),
                       "label": F.concat("p_brand", F.lit("/"), "p_name")}, {"doubled": "-1"})
    return out.select("p_partkey", "doubled", "p_name", "label")


@query("page_rows", "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40")
def page_rows(spark, sf_dir):
    """ST-3: the third page of twenty."""
    c = table(spark, sf_dir, "customer")
    return W.page(c, [F.col("c_acctbal").desc(), F.col("c_custkey")], 20, 40).select("c_custkey", "c_name")


@query("registered_reader", "SELECT p_partkey, p_name FROM part")
def registered_reader(spark, sf_dir):
    """UD-2: a reader registered for an extension is the one that ``read_any`` takes."""
    path = os.path.join(SK.scratch_dir(spark, "registered"), "part.psv")
    table(spark, sf_dir, "part").select("p_partkey", "p_name").write.option("header", "true").option("sep", "~").csv(path)
    RD.register_reader(".psv", lambda s, p: RD.read_delimited(s, p, sep="~"))
    return RD.read_any(spark, path).select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name")


@query("registered_formula", """
SELECT p_partkey, reverse(p_brand) AS reversed, p_name || p_brand AS joined, p_size + p_partkey AS added, CAST(p_size + 5 AS BIGINT) AS with_const,
       coalesce(CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) END, p_name) AS first_text FROM part""")
def registered_formula(spark, sf_dir):
    """UD-3, FN-17 and FN-12 / FN-2 over types: a registered function is found by name, ``a + b`` joins texts and adds numbers, the first
    non-empty value of different types is text."""
    p = table(spark, sf_dir, "part")
    fx.register_formula("REVERSED", lambda c: F.reverse(c))
    return p.select("p_partkey", fx.call("reversed", F.col("p_brand")).alias("reversed"),
                    fx.plus_typed(p.schema, "p_name", "p_brand").alias("joined"),
                    fx.plus_typed(p.schema, "p_size", "p_partkey").cast("long").alias("added"),
                    fx.plus(fx.pos(fx.ref("p_size")), fx.const(5)).cast("long").alias("with_const"),
                    fx.coalesce_text(F.when(F.col("p_size") > 25, F.col("p_size")), "p_name").alias("first_text"))


@query("mapping_hook", """
SELECT c_custkey, upper(c_name) AS c_name, row_number() OVER (ORDER BY c_custkey) AS SKEY FROM customer WHERE c_acctbal > 0""")
def mapping_hook(spark, sf_dir):
    """UD-1: a combination's hook changes and filters its source before the merge."""
    src = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    comb = MP.Combination(source=src, hook=lambda d: d.where("c_acctbal > 0").withColumn("c_name", F.upper("c_name")).drop("c_acctbal"))
    empty = M.empty_target(spark, src.drop("c_acctbal").schema)
    out, _ = MP.run_mapping(MP.Mapping(keys=["c_custkey"], combinations=[comb]), empty, TS)
    return out.select("c_custkey", "c_name", "SKEY")


@query("backfill_merge", """
SELECT user_id, arg_max(event_type, (CAST(ts AS DATE), event_id)) AS last_type FROM events
WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-07' GROUP BY user_id""")
def backfill_merge(spark, sf_dir):
    """INC-7 with a merge per day: the first day's slice truncates the target, every day's last event per user overwrites."""
    from ..session import cut_lineage
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("last_type"), "event_id", "ts")
    state = {"t": M.empty_target(spark, e.select("user_id", "last_type").schema, M.FCT)}

    def one_day(param, truncate):
        tgt = state["t"].limit(0) if truncate else state["t"]
        day = e.where(F.date_format("ts", "dd-MMM-yyyy") == param).select("user_id", "last_type", "event_id")
        res = M.fact_merge(day, tgt, ["user_id"], TS, order_by=["event_id"])
        state["t"] = cut_lineage(res.target, "backfill")
        return res.summary

    MP.backfill_slices(one_day, "2024-01-05", "2024-01-07", truncate=True)
    return state["t"].select("user_id", "last_type")
