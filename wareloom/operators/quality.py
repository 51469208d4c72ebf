"""Data-quality checks and error rows (DQ-1 … DQ-12).

Each check returns the rows that fail it with ``errcode`` / ``errmsg``; ``validate`` runs
several checks in one pass and splits a frame into accepted and rejected rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import bounded, error_code, row_json
from .columns import convert
from .keys import number_rows
from .merge import split_null_keys  # noqa: F401  (DQ-1)

# Bounded text lengths of an error record.
ERRTYPE_LEN, ERRMSG_LEN, DBERRMSG_LEN, KEYVALUE_LEN = 10, 1000, 4000, 1000
RUN_MESSAGE_LEN = 1000


def _reasons(rules: list[tuple[Column, str, Column]]) -> tuple[Column, Column]:
    """First failing rule decides code and message."""
    code = F.lit(None).cast("string")
    msg = F.lit(None).cast("string")
    for cond, c, m in reversed(rules):
        code = F.when(cond, F.lit(c)).otherwise(code)
        msg = F.when(cond, m).otherwise(msg)
    return code, msg


def key_rules(keys: list[str]):
    """DQ-1"""
    anynull = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return [(anynull, "NULL_KEY", F.lit("business key is NULL: " + ", ".join(keys)))]


def required_rules(cols: list[str]):
    """DQ-2"""
    return [(F.col(c).isNull(), "REQUIRED", F.lit(f"required column {c} is NULL")) for c in cols]


def precision_rules(types: dict[str, T.DecimalType]):
    """DQ-3: the value does not fit the declared precision (try_cast NULL while input is not)."""
    return [(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(), "OVERFLOW",
             F.concat(F.lit(f"value of {c} exceeds {t.simpleString()}: "), F.col(c).cast("string")))
            for c, t in types.items()]


def length_rules(lengths: dict[str, int]):
    """DQ-4: text longer than declared."""
    return [(F.length(F.col(c)) > n, "TOO_LONG",
             F.concat(F.lit(f"length of {c} exceeds {n}: "), F.length(F.col(c)).cast("string")))
            for c, n in lengths.items()]


def parse_rules(df: DataFrame, types: dict[str, T.DataType]):
    """DQ-5: value cannot be read as the declared type."""
    src = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for c, t in types.items():
        conv = convert(F.col(c), src[c], t)
        blank = F.trim(F.col(c).cast("string")) == F.lit("")
        out.append((F.col(c).isNotNull() & ~F.coalesce(blank, F.lit(False)) & conv.isNull(), "PARSE",
                    F.concat(F.lit(f"cannot read {c} as {t.simpleString()}: "), F.col(c).cast("string"))))
    return out


def validate(df: DataFrame, rules: list) -> tuple[DataFrame, DataFrame]:
    """Split rows into (accepted, rejected+errcode+errmsg) in one projection."""
    code, msg = _reasons(rules)
    tagged = df.withColumn("errcode", code).withColumn("errmsg", msg)
    return tagged.filter(F.col("errcode").isNull()).drop("errcode", "errmsg"), tagged.filter(F.col("errcode").isNotNull())


def error_rows(bad: DataFrame, run_id, order_by: list[str], data_cols: list[str] | None = None) -> DataFrame:
    """DQ-6 / DQ-7: run id, row index over the whole input (explicit order), row JSON, error
    code (``ABC-123`` pattern in the message, else the rule code) and bounded message."""
    data_cols = data_cols or [c for c in bad.columns if c not in ("errcode", "errmsg", "rwndx")]
    if "rwndx" not in bad.columns:
        bad = number_rows(bad, order_by, col="rwndx")
    return bad.select(
        F.lit(run_id).alias("runid"),
        F.col("rwndx").cast("long").alias("rwndx"),
        row_json(*data_cols).alias("rwdtjsn"),
        F.coalesce(error_code(F.col("errmsg")), bounded(F.col("errcode"), ERRTYPE_LEN)).alias("rrcd"),
        bounded(F.col("errmsg"), ERRMSG_LEN).alias("rrmssg"))


def run_summary(ok: DataFrame, bad: DataFrame, order_col: str = "rwndx") -> DataFrame:
    """DQ-8: SUCCESS without failures, FAILED without successes, else PARTIAL; first error
    message (by row index) kept, bounded to 1000 characters."""
    tagged = ok.select(F.lit(True).alias("_ok"), F.lit(None).cast("long").alias("_ix"),
                       F.lit(None).cast("string").alias("_msg")) \
        .unionByName(bad.select(F.lit(False).alias("_ok"), F.col(order_col).cast("long").alias("_ix"),
                                F.col("errmsg").alias("_msg")))
    agg = tagged.agg(F.count(F.lit(1)).alias("rows_processed"), F.count_if("_ok").alias("rows_successful"),
                     F.count_if(~F.col("_ok")).alias("rows_failed"),
                     F.min_by("_msg", F.col("_ix")).alias("_first"))
    return agg.select("rows_processed", "rows_successful", "rows_failed",
                      F.when(F.col("rows_failed") == 0, "SUCCESS").when(F.col("rows_successful") == 0, "FAILED")
                       .otherwise("PARTIAL").alias("status"),
                      bounded(F.col("_first"), RUN_MESSAGE_LEN).alias("message"))


def duplicates(df: DataFrame, cols: list[str]) -> DataFrame:
    """DQ-9: value combinations that occur more than once (partial aggregation map-side)."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("cnt")).filter(F.col("cnt") > 1)


def check_key_sequence(spec: DataFrame, group: str, key_flag: str, key_seq: str) -> DataFrame:
    """DQ-10: per mapping, at least one key column and no key sequence used twice."""
    per_seq = spec.filter(F.col(key_flag) == "Y").groupBy(group, key_seq).agg(F.count(F.lit(1)).alias("n"))
    dup = per_seq.filter(F.col("n") > 1).groupBy(group).agg(F.count(F.lit(1)).alias("repeated_sequences"))
    keys = spec.groupBy(group).agg(F.count_if(F.col(key_flag) == "Y").alias("key_columns"))
    j = keys.join(dup, group, "left").fillna({"repeated_sequences": 0})
    return j.select(group, "key_columns", F.col("repeated_sequences").cast("long").alias("repeated_sequences"),
                    F.when(F.col("key_columns") == 0, "NO_KEY").when(F.col("repeated_sequences") > 0, "DUPLICATE_SEQ")
                     .otherwise("OK").alias("verdict"))


# Allowed identifier shape and code sets of mapping specifications.
IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_]*$"
TABLE_KINDS = ("NRM", "DIM", "FCT", "MRT")


def check_spec(spec: DataFrame, name_cols: list[str], code_sets: dict[str, tuple] | None = None) -> DataFrame:
    """DQ-12: identifier rules (no blanks, only ``[A-Za-z0-9_]``, not starting with a digit) and
    code sets; one row per violation (``column``, ``rule``)."""
    code_sets = code_sets or {}
    viol = []
    for c in name_cols:
        v = F.col(c)
        viol.append(F.when(v.isNull() | (F.trim(v) == ""), F.struct(F.lit(c).alias("column"), F.lit("BLANK").alias("rule"))))
        viol.append(F.when(v.contains(" "), F.struct(F.lit(c).alias("column"), F.lit("SPACE").alias("rule"))))
        viol.append(F.when(v.rlike("^[0-9]"), F.struct(F.lit(c).alias("column"), F.lit("LEADING_DIGIT").alias("rule"))))
        viol.append(F.when(~v.rlike(IDENTIFIER) & ~v.contains(" ") & ~v.rlike("^[0-9]") & (F.trim(v) != ""),
                           F.struct(F.lit(c).alias("column"), F.lit("BAD_CHARACTER").alias("rule"))))
    for c, allowed in code_sets.items():
        viol.append(F.when(~F.upper(F.col(c)).isin(list(allowed)) | F.col(c).isNull(),
                           F.struct(F.lit(c).alias("column"), F.lit("NOT_IN_SET").alias("rule"))))
    arr = F.filter(F.array(*viol), lambda x: x.isNotNull())
    keep = [x for x in spec.columns]
    return spec.select(*keep, F.explode(arr).alias("_v")).select(*keep, "_v.column", "_v.rule")


def browse_errors(df: DataFrame, runid=None, code: str | None = None, text: str | None = None,
                  limit: int = 50, offset: int = 0) -> DataFrame:
    """DQ-11: filter by run, code and message text; ordered by row index; one page."""
    out = df
    if runid is not None:
        out = out.filter(F.col("runid") == F.lit(runid))
    if code:
        out = out.filter(F.upper(F.col("rrcd")) == code.upper())
    if text:
        out = out.filter(F.lower(F.col("rrmssg")).contains(text.lower()))
    return out.orderBy("rwndx").offset(offset).limit(limit)


def mapping_error_rows(bad: DataFrame, keys: list[str], errtyp: str = "TARGET_LOAD", dberrmsg=None) -> DataFrame:
    """DQ-7: mapping error records: error type (10 chars), message (1000), database message
    (4000) and the row's key value(s) joined with ``|`` (1000)."""
    keyval = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("<NULL>")) for k in keys])
    db = dberrmsg if dberrmsg is not None else F.col("errcode")
    return bad.select(bounded(F.lit(errtyp), ERRTYPE_LEN).alias("errtyp"),
                      bounded(F.col("errmsg"), ERRMSG_LEN).alias("errmsg"),
                      bounded(db, DBERRMSG_LEN).alias("dberrmsg"),
                      bounded(keyval, KEYVALUE_LEN).alias("keyvalue"))
