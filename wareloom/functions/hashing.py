"""Row hash (HSH-1, HSH-2).

MD5 over the values joined with ``|``; NULL is written ``<NULL>``; timestamps as
``yyyy-MM-dd HH:mm:ss`` (sub-second dropped); dates ISO; everything else in Spark's text
form. Doubles hash in Spark's text form, so declare a decimal type for money columns
(the load casts to the declared type before hashing) to get a stable text.
The separator is not escaped: ``('a|b','c')`` and ``('a','b|c')`` hash alike. This is kept
on purpose so stored hashes stay comparable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# System columns never taken into the row hash.
AUDIT_COLUMNS = ("SKEY", "RWHKEY", "RECCRDT", "RECUPDT", "CURFLG", "FROMDT", "TODT", "VALDFRM", "VALDTO")
NULL_TEXT = "<NULL>"
SEP = "|"


def canon(c: Column, dtype: T.DataType) -> Column:
    """Canonical text of one value."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    if isinstance(dtype, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    return c.cast("string")


def hash_columns(schema: T.StructType, order: list[str] | None = None, by_name: bool = False,
                 exclude=AUDIT_COLUMNS) -> list[str]:
    names = schema.fieldNames()
    if order is not None:
        lower = {n.lower(): n for n in names}
        names = [lower[o.lower()] for o in order if o.lower() in lower]
    ex = {e.upper() for e in exclude}
    names = [n for n in names if n.upper() not in ex]
    if by_name:
        names = sorted(names, key=str.upper)
    return names


def row_hash(df: DataFrame, order: list[str] | None = None, by_name: bool = False,
             exclude=AUDIT_COLUMNS) -> Column:
    """HSH-1 (given/execution order) and HSH-2 (``by_name=True``) as one Column."""
    schema = df.schema
    cols = hash_columns(schema, order, by_name, exclude)
    parts = [F.coalesce(canon(F.col(n), schema[n].dataType), F.lit(NULL_TEXT)) for n in cols]
    return F.md5(F.concat_ws(SEP, *parts))
