"""Generic type codes -> Spark types (TY-1) and column specifications.

A target column is declared with a generic type code. ``spark_type`` resolves the code,
``max_length`` gives the declared text length (Spark strings have none, so the length is
checked by ``operators.quality.check_length``).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

# Generic codes and their Spark rendering, as declared by the type matrix
# of the loaded system (code -> (type, declared text length or None)).
_FIXED = {
    "INT": (T.IntegerType(), None),
    "BIGINT": (T.LongType(), None),
    "DECIMAL": (T.DecimalType(18, 2), None),
    "VARCHAR": (T.StringType(), 255),
    "VARCHAR_LARGE": (T.StringType(), None),
    "BOOLEAN": (T.BooleanType(), None),
    "FLOAT": (T.DoubleType(), None),
    "JSON": (T.StringType(), None),
    "DATE": (T.DateType(), None),
    "TIMESTAMP": (T.TimestampNTZType(), None),
    "TEXT": (T.StringType(), None),
    "CLOB": (T.StringType(), None),
    "NUMBER": (T.DecimalType(18, 2), None),
}
# Sized string, numeric and money families.
STRING_SIZES = (1, 3, 5, 10, 20, 30, 50, 100, 250, 4000)
NUMERIC_SIZES = (1, 3, 5, 10, 20, 30)
MONEY_SIZES = (10, 12, 18, 28)
MONEY_SCALE = 6
_DEFAULT_TEXT_LENGTH = 255


@dataclass(frozen=True)
class TypeInfo:
    dtype: T.DataType
    length: int | None = None


def resolve(code: str | None) -> TypeInfo:
    """TY-1: resolve a generic type code (case-insensitive) to a ``TypeInfo``."""
    if code is None or not str(code).strip():
        return TypeInfo(T.StringType(), _DEFAULT_TEXT_LENGTH)
    raw = str(code).strip()
    up = raw.upper()
    if up in _FIXED:
        t, n = _FIXED[up]
        return TypeInfo(t, n)
    m = re.fullmatch(r"STRING(\d+)", up)
    if m:
        return TypeInfo(T.StringType(), int(m.group(1)))
    m = re.fullmatch(r"NUMERIC(\d+)", up)
    if m:
        return TypeInfo(T.DecimalType(int(m.group(1)), 0))
    m = re.fullmatch(r"MONEY(\d+)", up)
    if m:
        return TypeInfo(T.DecimalType(int(m.group(1)), MONEY_SCALE))
    m = re.fullmatch(r"(?:INTEGER|INT)\s*(?:\(\s*(\d+)\s*\))?", up) or re.fullmatch(r"INTEGER(\d+)", up)
    if m:
        n = int(m.group(1)) if m.group(1) else 10
        return TypeInfo(T.LongType() if n > 9 else T.IntegerType())
    m = re.fullmatch(r"DECIMAL\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?", up) or \
        re.fullmatch(r"DECIMAL(\d+)(?:_(\d+))?", up)
    if m:
        p = int(m.group(1)) if m.group(1) else 18
        s = int(m.group(2)) if m.group(2) else (2 if not m.group(1) else 0)
        return TypeInfo(T.DecimalType(min(p, 38), min(s, p)))
    m = re.fullmatch(r"VARCHAR2?\s*\(\s*(\d+)\s*\)", up)
    if m:
        return TypeInfo(T.StringType(), int(m.group(1)))
    if up in ("VARCHAR2",):
        return TypeInfo(T.StringType(), _DEFAULT_TEXT_LENGTH)
    return TypeInfo(T.StringType(), _DEFAULT_TEXT_LENGTH)


def spark_type(code: str | None) -> T.DataType:
    return resolve(code).dtype


def max_length(code: str | None) -> int | None:
    return resolve(code).length


def known_codes() -> list[str]:
    """All generic codes the resolver knows by name (used by the catalogue operators)."""
    return (list(_FIXED) + [f"String{n}" for n in STRING_SIZES] + [f"Numeric{n}" for n in NUMERIC_SIZES]
            + [f"Money{n}" for n in MONEY_SIZES])


@dataclass
class ColumnSpec:
    """One target column of a file load or mapping (FIXTURES §5, file column spec)."""
    target: str
    type_code: str | None = None
    source: str | None = None
    key_seq: int | None = None          # position in the business key, None = not a key
    formula: object | None = None       # Column builder: fn(row_columns: dict[str, Column]) -> Column, or a Column
    default: object | None = None
    required: bool = False
    audit: str | None = None            # CREATED_BY / CREATED_DATE / UPDATED_BY / UPDATED_DATE
    exec_seq: int = 0

    @property
    def dtype(self) -> T.DataType:
        return spark_type(self.type_code)

    @property
    def length(self) -> int | None:
        return max_length(self.type_code)


@dataclass
class TableSpec:
    columns: list[ColumnSpec] = field(default_factory=list)

    @property
    def keys(self) -> list[str]:
        ks = [c for c in self.columns if c.key_seq is not None]
        return [c.target for c in sorted(ks, key=lambda c: c.key_seq)]

    def schema(self) -> T.StructType:
        return schema_from_spec(self.columns)


def schema_from_spec(columns: list[ColumnSpec]) -> T.StructType:
    """Regular columns first in execution order, audit columns last (SNK-1 ordering)."""
    regular = [c for c in sorted(columns, key=lambda c: c.exec_seq) if not c.audit]
    audit = [c for c in columns if c.audit]
    return T.StructType([T.StructField(c.target, c.dtype, not (c.required or c.key_seq is not None))
                         for c in regular + audit])
