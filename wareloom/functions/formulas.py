"""Formula catalogue (FN-1 … FN-17) as Column builders.

Every builder returns a Spark ``Column``; a derived field is therefore one Catalyst
expression evaluated inside whole-stage codegen, never a per-row Python call.
Arguments may be column names or Columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def _s(x) -> Column:
    return _c(x).cast("string")


def concat(*vals) -> Column:
    """FN-1: values as text, NULL as empty text."""
    return F.concat(*[F.coalesce(_s(v), F.lit("")) for v in vals])


def coalesce(*vals) -> Column:
    """FN-2: first value that is neither NULL nor empty text; NULL when none. Arguments of one type
    keep it; ``coalesce_text`` takes mixed types."""
    return F.coalesce(*[F.when(_s(v) != F.lit(""), _c(v)) for v in vals])


def coalesce_any(*vals) -> Column:
    """FN-2 as the catalogue names it: ``coalesce`` where every argument is a constant of one type, else as text, since the types of
    columns are not known before the formula meets a table (the column's declared type is restored by ``cast_to_spec``)."""
    kinds = {type(v) for v in vals if v is not None}
    return coalesce(*vals) if len(kinds) == 1 and kinds <= {int, float, bool} else coalesce_text(*vals)


def coalesce_text(*vals) -> Column:
    """FN-2 over arguments of different types: the first value that is neither NULL nor empty, as text."""
    return F.coalesce(*[F.nullif(_s(v), F.lit("")) for v in vals])


def split(v, delim: str, index: int = 0) -> Column:
    """FN-3: literal delimiter, 0-based index, negative counts from the end, out of range -> NULL."""
    parts = F.split(_s(v), _quote(delim), -1)
    if index >= 0:
        return F.get(parts, index)
    return F.when(F.size(parts) >= -index, F.element_at(parts, index))


def _quote(delim: str) -> str:
    return "\\Q" + delim.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def upper(v) -> Column:
    """FN-4"""
    return F.upper(_s(v))


def lower(v) -> Column:
    """FN-5"""
    return F.lower(_s(v))


def trim(v) -> Column:
    """FN-6: strip every kind of whitespace at both ends."""
    return F.regexp_replace(_s(v), r"^\s+|\s+$", "")


def abs_(v) -> Column:
    """FN-7: absolute value as a float."""
    return F.abs(_c(v).cast("double"))


def round_(v, n: int = 0, as_double: bool = True) -> Column:
    """FN-8: half-even rounding. Spark rounds a double by its shortest decimal text, so
    ``2.675`` gives 2.68 where Python's binary rounding gives 2.67 (known difference, T8);
    values that are decimals (``as_double=False``) round exactly half-even."""
    c = _c(v).cast("double") if as_double else _c(v)
    return F.bround(c, n)


def len_(v) -> Column:
    """FN-9: text length, NULL counts as 0."""
    return F.coalesce(F.length(_s(v)), F.lit(0))


def substring(v, start: int, length: int | None = None) -> Column:
    """FN-10: 0-based start; NULL in -> NULL out."""
    s = _s(v)
    if length is None:
        return F.substring(s, start + 1, 2147483647)
    return F.substring(s, start + 1, length)


def replace(v, old: str, new: str) -> Column:
    """FN-11: literal replacement."""
    return F.replace(_s(v), F.lit(old), F.lit(new))


def plus(a, b, text: bool = False) -> Column:
    """FN-12: text operands concatenate (NULL -> ''), numeric operands add (NULL -> 0, overflow -> NULL)."""
    if text:
        return concat(a, b)
    return F.try_add(F.coalesce(_c(a), F.lit(0)), F.coalesce(_c(b), F.lit(0)))


def plus_typed(schema: T.StructType, a: str, b: str) -> Column:
    """FN-12 with the operand types read from a schema (analysis only, no job)."""
    def is_text(name):
        return name in schema.fieldNames() and isinstance(schema[name].dataType, T.StringType)
    return plus(a, b, text=is_text(a) or is_text(b))


def minus(a, b) -> Column:
    """FN-13 (overflow -> NULL)"""
    return F.try_subtract(F.coalesce(_c(a), F.lit(0)), F.coalesce(_c(b), F.lit(0)))


def times(a, b) -> Column:
    """FN-13 (overflow -> NULL)"""
    return F.try_multiply(F.coalesce(_c(a), F.lit(0)), F.coalesce(_c(b), F.lit(0)))


def divide(a, b) -> Column:
    """FN-14: true division; divisor NULL or 0 -> NULL; dividend NULL -> 0."""
    return F.try_divide(F.coalesce(_c(a), F.lit(0)).cast("double"), _c(b).cast("double"))


def modulo(a, b) -> Column:
    """FN-15: floored modulo (sign of the divisor); divisor NULL or 0 -> NULL."""
    x = F.coalesce(_c(a), F.lit(0))
    y = _c(b)
    return F.when(y.isNotNull() & (y != 0), ((x % y) + y) % y)


def neg(v) -> Column:
    """FN-16"""
    return -_c(v)


def pos(v) -> Column:
    """FN-16"""
    return _c(v)


def const(v) -> Column:
    """FN-17"""
    return F.lit(v)


def ref(name: str) -> Column:
    """FN-17"""
    return F.col(name)


# Name lookup as in the formula catalogue; unknown names give NULL (see ``call``).
CATALOGUE = {
    "CONCAT": concat, "COALESCE": coalesce_any, "SPLIT": split, "UPPER": upper, "LOWER": lower,
    "TRIM": trim, "ABS": abs_, "ROUND": round_, "LEN": len_, "SUBSTRING": substring, "REPLACE": replace,
}
# Report formulas are the same list without TRIM, SUBSTRING and REPLACE.
REPORT_CATALOGUE = {k: v for k, v in CATALOGUE.items() if k not in ("TRIM", "SUBSTRING", "REPLACE")}


def register_formula(name: str, fn, report: bool = False) -> None:
    """UD-3: add a Column-returning function to the catalogue (looked up case-insensitively)."""
    CATALOGUE[name.upper()] = fn
    if report:
        REPORT_CATALOGUE[name.upper()] = fn


def call(name: str, *args, catalogue: dict | None = None) -> Column:
    fn = (catalogue or CATALOGUE).get(str(name).upper())
    if fn is None:
        return F.lit(None)
    return fn(*args)
