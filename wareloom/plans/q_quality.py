"""Bound queries: data quality and error rows (DQ-*)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import quality as Q
from ..operators.keys import number_rows
from .registry import query
from .tables import table

_USER_KEY = "CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id END"


def _events_keys(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.expr(_USER_KEY).alias("user_key"), "event_type")


@query("reject_null_keys", f"""
SELECT event_id, {_USER_KEY} AS user_key, event_type, 'NULL_KEY' AS errcode,
       'business key is NULL: user_key, event_type' AS errmsg
FROM events WHERE {_USER_KEY} IS NULL OR event_type IS NULL""")
def reject_null_keys(spark, sf_dir):
    """DQ-1: rows with a NULL business key set aside with a reason."""
    _, bad = Q.validate(_events_keys(spark, sf_dir), Q.key_rules(["user_key", "event_type"]))
    return bad


_PROPS = "CASE WHEN value < 5 THEN NULL ELSE props END"


@query("reject_required", f"""
SELECT event_id, event_type, {_PROPS} AS props, 'REQUIRED' AS errcode,
       'required column props is NULL' AS errmsg
FROM events WHERE event_type IS NULL OR {_PROPS} IS NULL""")
def reject_required(spark, sf_dir):
    """DQ-2: required columns must not be NULL."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.expr(_PROPS).alias("props"))
    _, bad = Q.validate(e, Q.required_rules(["event_type", "props"]))
    return bad


@query("reject_precision", """
SELECT c_custkey, c_acctbal, 'OVERFLOW' AS errcode,
       'value of c_acctbal exceeds decimal(5,2): ' || CAST(c_acctbal AS VARCHAR) AS errmsg
FROM customer WHERE TRY_CAST(c_acctbal AS DECIMAL(5,2)) IS NULL""")
def reject_precision(spark, sf_dir):
    """DQ-3: values that do not fit the declared DECIMAL(5,2)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    _, bad = Q.validate(c, Q.precision_rules({"c_acctbal": T.DecimalType(5, 2)}))
    return bad


_LEN_SQL = """SELECT *, 'TOO_LONG' AS errcode, 'length of p_name exceeds 10: ' || CAST(length(p_name) AS VARCHAR) AS errmsg
FROM part WHERE length(p_name) > 10"""


@query("reject_length", _LEN_SQL)
def reject_length(spark, sf_dir):
    """DQ-4: text longer than the declared String10."""
    _, bad = Q.validate(table(spark, sf_dir, "part"), Q.length_rules({"p_name": 10}))
    return bad


_NUM_TXT = "CASE WHEN lang = 'en' THEN CAST(n_chars AS VARCHAR) ELSE lang END"
_DAY_TXT = "'2024-01-' || lpad(CAST(doc_id % 40 AS VARCHAR), 2, '0')"


@query("reject_parse", f"""
SELECT doc_id, num_txt, day_txt,
       CASE WHEN TRY_CAST(trim(num_txt) AS BIGINT) IS NULL THEN 'PARSE' ELSE 'PARSE' END AS errcode,
       CASE WHEN TRY_CAST(trim(num_txt) AS BIGINT) IS NULL THEN 'cannot read num_txt as bigint: ' || num_txt
            ELSE 'cannot read day_txt as date: ' || day_txt END AS errmsg
FROM (SELECT doc_id, {_NUM_TXT} AS num_txt, {_DAY_TXT} AS day_txt FROM documents) d
WHERE TRY_CAST(trim(num_txt) AS BIGINT) IS NULL OR TRY_STRPTIME(day_txt, '%Y-%m-%d') IS NULL""")
def reject_parse(spark, sf_dir):
    """DQ-5: text that cannot be read as the declared number / date."""
    d = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(F.col("lang") == "en", F.col("n_chars").cast("string")).otherwise(F.col("lang")).alias("num_txt"),
        F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 40).cast("string"), 2, "0")).alias("day_txt"))
    _, bad = Q.validate(d, Q.parse_rules(d, {"num_txt": T.LongType(), "day_txt": T.DateType()}))
    return bad


def _part_checked(spark, sf_dir):
    p = number_rows(table(spark, sf_dir, "part"), "p_partkey", col="rwndx")
    return Q.validate(p, Q.length_rules({"p_name": 10}))


@query("error_rows_json", """
SELECT 1 AS runid, rwndx,
       CAST(json_object('p_partkey', p_partkey, 'p_name', p_name, 'p_brand', p_brand, 'p_type', p_type,
                        'p_size', p_size, 'p_retailprice', p_retailprice) AS VARCHAR) AS rwdtjsn,
       'TOO_LONG' AS rrcd, 'length of p_name exceeds 10: ' || CAST(length(p_name) AS VARCHAR) AS rrmssg
FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) AS rwndx FROM part) p WHERE length(p_name) > 10""")
def error_rows_json(spark, sf_dir):
    """DQ-6 / DQ-7: error records with row index over the whole input, row JSON (FN-31), code and
    bounded message."""
    _, bad = _part_checked(spark, sf_dir)
    return Q.error_rows(bad, 1, ["p_partkey"], ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"])


@query("run_status", """
WITH n AS (SELECT *, row_number() OVER (ORDER BY p_partkey) AS rwndx FROM part)
SELECT count(*) AS rows_processed, count(*) FILTER (WHERE length(p_name) <= 10) AS rows_successful,
       count(*) FILTER (WHERE length(p_name) > 10) AS rows_failed,
       CASE WHEN count(*) FILTER (WHERE length(p_name) > 10) = 0 THEN 'SUCCESS'
            WHEN count(*) FILTER (WHERE length(p_name) <= 10) = 0 THEN 'FAILED' ELSE 'PARTIAL' END AS status,
       arg_min(CASE WHEN length(p_name) > 10 THEN 'length of p_name exceeds 10: ' || CAST(length(p_name) AS VARCHAR) END,
               CASE WHEN length(p_name) > 10 THEN rwndx END) AS message
FROM n""")
def run_status(spark, sf_dir):
    """DQ-8: SUCCESS / PARTIAL / FAILED with the first error message."""
    ok, bad = _part_checked(spark, sf_dir)
    return Q.run_summary(ok, bad)


@query("duplicate_keys", """
SELECT l_orderkey, l_linenumber, count(*) AS cnt FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_keys(spark, sf_dir):
    """DQ-9: key combinations occurring more than once."""
    return Q.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def _spec_from_part(spark, sf_dir):
    """A column-specification table derived from ``part``: three candidate identifiers and a
    table kind per row."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.col("p_name").alias("col_a"), F.col("p_brand").alias("col_b"),
                    F.concat(F.col("p_size").cast("string"), F.col("p_type")).alias("col_c"),
                    F.when(F.col("p_type").isin("STANDARD", "ECONOMY"), "DIM")
                     .when(F.col("p_type") == "MEDIUM", "fct").otherwise(F.col("p_type")).alias("kind"))


_SPEC_SQL = """(SELECT p_partkey, p_name AS col_a, p_brand AS col_b, CAST(p_size AS VARCHAR) || p_type AS col_c,
  CASE WHEN p_type IN ('STANDARD', 'ECONOMY') THEN 'DIM' WHEN p_type = 'MEDIUM' THEN 'fct' ELSE p_type END AS kind
  FROM part)"""


def _rule_sql(c):
    return f"""
SELECT p_partkey, '{c}' AS "column", 'BLANK' AS rule FROM {_SPEC_SQL} s WHERE {c} IS NULL OR trim({c}) = ''
UNION ALL SELECT p_partkey, '{c}', 'SPACE' FROM {_SPEC_SQL} s WHERE contains({c}, ' ')
UNION ALL SELECT p_partkey, '{c}', 'LEADING_DIGIT' FROM {_SPEC_SQL} s WHERE regexp_matches({c}, '^[0-9]')
UNION ALL SELECT p_partkey, '{c}', 'BAD_CHARACTER' FROM {_SPEC_SQL} s
  WHERE NOT regexp_matches({c}, '^[A-Za-z_][A-Za-z0-9_]*$') AND NOT contains({c}, ' ')
    AND NOT regexp_matches({c}, '^[0-9]') AND trim({c}) <> ''"""


@query("spec_checks", " UNION ALL ".join(_rule_sql(c) for c in ("col_a", "col_b", "col_c")) + f"""
UNION ALL SELECT p_partkey, 'kind', 'NOT_IN_SET' FROM {_SPEC_SQL} s
  WHERE kind IS NULL OR upper(kind) NOT IN ('NRM', 'DIM', 'FCT', 'MRT')""")
def spec_checks(spark, sf_dir):
    """DQ-12: identifier rules and code sets over a specification table, one row per violation."""
    v = Q.check_spec(_spec_from_part(spark, sf_dir), ["col_a", "col_b", "col_c"], {"kind": Q.TABLE_KINDS})
    return v.select("p_partkey", "column", "rule")


@query("key_sequence", """
WITH spec AS (SELECT p_brand AS mapref, CASE WHEN p_size > 45 THEN 'Y' ELSE 'N' END AS key_flag,
                     p_size % 3 AS key_seq FROM part),
k AS (SELECT mapref, count(*) FILTER (WHERE key_flag = 'Y') AS key_columns FROM spec GROUP BY 1),
d AS (SELECT mapref, count(*) AS repeated_sequences FROM
        (SELECT mapref, key_seq FROM spec WHERE key_flag = 'Y' GROUP BY 1, 2 HAVING count(*) > 1) x GROUP BY 1)
SELECT k.mapref, k.key_columns, COALESCE(d.repeated_sequences, 0) AS repeated_sequences,
       CASE WHEN k.key_columns = 0 THEN 'NO_KEY' WHEN COALESCE(d.repeated_sequences, 0) > 0 THEN 'DUPLICATE_SEQ'
            ELSE 'OK' END AS verdict
FROM k LEFT JOIN d ON k.mapref = d.mapref""")
def key_sequence(spark, sf_dir):
    """DQ-10: per mapping at least one key column and no repeated key sequence."""
    p = table(spark, sf_dir, "part")
    spec = p.select(F.col("p_brand").alias("mapref"),
                    F.when(F.col("p_size") > 45, "Y").otherwise("N").alias("key_flag"),
                    (F.col("p_size") % 3).alias("key_seq"))
    return Q.check_key_sequence(spec, "mapref", "key_flag", "key_seq")
