"""Type catalogue operators (TY-2 … TY-9).

The catalogue is a table ``(prtyp, prcd, prdesc, prval, dbtyp, curflg)``: generic type codes
(``dbtyp = 'GENERIC'``) and their per-database renderings. All operators are joins and
aggregates over it; the per-database default matrix is a small fixed lookup (below), joined
by broadcast because its size is fixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import MONEY_SCALE, MONEY_SIZES, NUMERIC_SIZES, STRING_SIZES, ColumnSpec, schema_from_spec
from ..session import local_rows

GENERIC = "GENERIC"
# Default rendering of the core generic codes per database
# (code: ORACLE, POSTGRESQL, MYSQL, SQLSERVER, SNOWFLAKE, GENERIC).
MATRIX_DATABASES = ("ORACLE", "POSTGRESQL", "MYSQL", "SQLSERVER", "SNOWFLAKE", "GENERIC")
MATRIX = {
    "INT": ("NUMBER(10,0)", "INTEGER", "INT", "INT", "NUMBER(10,0)", "INT"),
    "BIGINT": ("NUMBER(19,0)", "BIGINT", "BIGINT", "BIGINT", "NUMBER(19,0)", "BIGINT"),
    "DECIMAL": ("NUMBER", "NUMERIC", "DECIMAL", "DECIMAL", "DECIMAL", "DECIMAL"),
    "VARCHAR": ("VARCHAR2(255)", "VARCHAR(255)", "VARCHAR(255)", "VARCHAR(255)", "VARCHAR(255)", "VARCHAR"),
    "VARCHAR_LARGE": ("VARCHAR2(2000)", "VARCHAR(4000)", "TEXT", "VARCHAR(MAX)", "VARCHAR(16777216)", "VARCHAR_LARGE"),
    "BOOLEAN": ("CHAR(1)", "BOOLEAN", "BOOLEAN", "BIT", "BOOLEAN", "BOOLEAN"),
    "FLOAT": ("FLOAT", "FLOAT8", "FLOAT", "FLOAT", "FLOAT", "FLOAT"),
    "JSON": ("CLOB", "JSON", "JSON", "NVARCHAR(MAX)", "VARIANT", "JSON"),
    "DATE": ("DATE", "DATE", "DATE", "DATE", "DATE", "DATE"),
    "TIMESTAMP": ("TIMESTAMP", "TIMESTAMP", "DATETIME", "DATETIME2", "TIMESTAMP_NTZ", "TIMESTAMP"),
}
# The sized families follow one rule each (length, or precision and scale).
for _code in ("Date", "DATE"):
    MATRIX[_code] = MATRIX["DATE"]
for _code in ("timestamp", "Timestamp"):
    MATRIX[_code] = MATRIX["TIMESTAMP"]
for _n in STRING_SIZES:
    MATRIX[f"String{_n}"] = ((f"VARCHAR2({_n})",) + (f"VARCHAR({_n})",) * 5 if _n < 4000 else
                             ("VARCHAR2(4000)", "VARCHAR(4000)", "TEXT", "VARCHAR(MAX)", "VARCHAR(4000)", "VARCHAR(4000)"))
for _n in NUMERIC_SIZES:
    MATRIX[f"Numeric{_n}"] = (f"NUMBER({_n})", f"NUMERIC({_n})", f"DECIMAL({_n},0)", f"DECIMAL({_n},0)", f"NUMBER({_n},0)", f"NUMERIC({_n})")
for _n in MONEY_SIZES:
    _ps = f"({_n},{MONEY_SCALE})"
    MATRIX[f"Money{_n}"] = (f"NUMBER{_ps}", f"NUMERIC{_ps}", f"DECIMAL{_ps}", f"DECIMAL{_ps}", f"NUMBER{_ps}", f"NUMERIC{_ps}")
# Suggestion confidence for the two long-supported databases, and otherwise.
CONFIDENCE_HIGH, CONFIDENCE_OTHER = 0.98, 0.85
HIGH_PRIORITY_CODES = ("INT", "VARCHAR", "DATE")

CATALOGUE_SCHEMA = "prtyp string, prcd string, prdesc string, prval string, dbtyp string, curflg string"


def matrix_frame(spark: SparkSession) -> DataFrame:
    rows = [(code, db, vals[i]) for code, vals in MATRIX.items() for i, db in enumerate(MATRIX_DATABASES)]
    return local_rows(spark, rows, "prcd string, dbtyp string, matrix_value string")


def catalogue_for(cat: DataFrame, db: str) -> DataFrame:
    """TY-2: per code the row of database ``db`` when present, else the GENERIC row."""
    from .windows import preferred_row
    rows = cat.filter((F.col("curflg") == "Y") & F.upper("dbtyp").isin(db.upper(), GENERIC))
    return preferred_row(rows, "prcd", F.upper("dbtyp") == db.upper())


def lookup_ranked(df: DataFrame, cat: DataFrame, code_col: str, db_col: str, out: str = "prval") -> DataFrame:
    """JN-11: each row's type code resolved for its database, specific row first, else GENERIC.
    Two equi-joins on the (small) catalogue instead of a per-row ranking."""
    cur = cat.filter(F.col("curflg") == "Y")
    spec = cur.filter(F.upper("dbtyp") != GENERIC).select(F.col("prcd").alias("_c"), F.upper("dbtyp").alias("_d"),
                                                           F.col("prval").alias("_sv"))
    gen = cur.filter(F.upper("dbtyp") == GENERIC).select(F.col("prcd").alias("_c2"), F.col("prval").alias("_gv"))
    x = df.join(spec, (df[code_col] == spec["_c"]) & (F.upper(df[db_col]) == spec["_d"]), "left") \
          .join(gen, df[code_col] == gen["_c2"], "left")
    return x.withColumn(out, F.coalesce("_sv", "_gv")) \
            .withColumn("resolved_from", F.when(F.col("_sv").isNotNull(), "SPECIFIC")
                                          .when(F.col("_gv").isNotNull(), GENERIC)) \
            .drop("_c", "_d", "_sv", "_c2", "_gv")


def clone_catalogue(cat: DataFrame, db: str, overrides: dict[str, str] | None = None,
                    matrix: DataFrame | None = None) -> DataFrame:
    """TY-3: GENERIC rows copied to ``db`` with value = override, else matrix, else the generic
    value; codes the database already has are reported as SKIPPED."""
    spark = cat.sparkSession
    dbu = db.upper()
    matrix = matrix if matrix is not None else matrix_frame(spark)
    gen = cat.filter((F.upper("dbtyp") == GENERIC) & (F.col("curflg") == "Y"))
    have = cat.filter((F.upper("dbtyp") == dbu) & (F.col("curflg") == "Y")).select("prcd").distinct() \
              .withColumn("_have", F.lit(True))
    m = matrix.filter(F.col("dbtyp") == dbu).select(F.col("prcd").alias("_mc"), "matrix_value")
    ov = local_rows(spark, list((overrides or {}).items()), "_oc string, override_value string")
    x = gen.join(have, "prcd", "left").join(F.broadcast(m), F.col("prcd") == F.col("_mc"), "left") \
           .join(F.broadcast(ov), F.col("prcd") == F.col("_oc"), "left")
    return x.select("prtyp", "prcd", "prdesc",
                    F.coalesce("override_value", "matrix_value", "prval").alias("prval"),
                    F.lit(dbu).alias("dbtyp"), F.lit("Y").alias("curflg"),
                    F.when(F.col("_have").isNotNull(), "SKIPPED").otherwise("CREATED").alias("action"))


def missing_types(cat: DataFrame, db: str) -> DataFrame:
    """TY-4: GENERIC codes without a row of database ``db`` (compared with the database's own
    rows, not with the GENERIC fallback view), with priority."""
    cur = cat.filter(F.col("curflg") == "Y")
    gen = cur.filter(F.upper("dbtyp") == GENERIC).select("prcd", "prval")
    own = cur.filter(F.upper("dbtyp") == db.upper()).select("prcd")
    miss = gen.join(own, "prcd", "left_anti")
    return miss.withColumn("priority", F.when(F.upper("prcd").isin(*HIGH_PRIORITY_CODES), "HIGH").otherwise("MEDIUM"))


def suggest_types(cat: DataFrame, db: str, matrix: DataFrame | None = None) -> DataFrame:
    """TY-5: for every GENERIC code known to the matrix, the suggested rendering and confidence."""
    dbu = db.upper()
    matrix = matrix if matrix is not None else matrix_frame(cat.sparkSession)
    gen = cat.filter((F.upper("dbtyp") == GENERIC) & (F.col("curflg") == "Y")).select("prcd", F.col("prval").alias("generic_value"))
    m = matrix.filter(F.col("dbtyp") == dbu).select("prcd", F.col("matrix_value").alias("suggested_value"))
    conf = CONFIDENCE_HIGH if dbu in ("ORACLE", "POSTGRESQL") else CONFIDENCE_OTHER
    return gen.join(F.broadcast(m), "prcd").withColumn("confidence", F.lit(conf))


def check_compat(cat: DataFrame, matrix: DataFrame | None = None) -> DataFrame:
    """TY-6: every database-specific row against the matrix: compatible when the code and
    database are known; ``matches`` when the value equals the recommendation (case-insensitive)."""
    matrix = matrix if matrix is not None else matrix_frame(cat.sparkSession)
    rows = cat.filter((F.upper("dbtyp") != GENERIC) & (F.col("curflg") == "Y"))
    m = matrix.select(F.col("prcd").alias("_mc"), F.col("dbtyp").alias("_md"), F.col("matrix_value").alias("suggested_value"))
    x = rows.join(F.broadcast(m), (F.col("prcd") == F.col("_mc")) & (F.upper("dbtyp") == F.col("_md")), "left")
    return x.select("prcd", "dbtyp", "prval", "suggested_value",
                    F.col("suggested_value").isNotNull().alias("compatible"),
                    F.coalesce(F.upper("prval") == F.upper("suggested_value"), F.lit(False)).alias("matches"))


def type_impact(details: DataFrame, codes: DataFrame, code_col: str = "trgcldtyp") -> DataFrame:
    """TY-7: per code the number of mapping columns using it and the impact level
    (LOW 0, MEDIUM 1–10, HIGH above 10)."""
    used = details.groupBy(F.col(code_col).alias("prcd")).agg(F.count(F.lit(1)).alias("columns_using"))
    x = codes.select("prcd").distinct().join(used, "prcd", "left") \
             .withColumn("columns_using", F.coalesce("columns_using", F.lit(0)).cast("long"))
    return x.withColumn("impact", F.when(F.col("columns_using") == 0, "LOW")
                                    .when(F.col("columns_using") <= 10, "MEDIUM").otherwise("HIGH"))


def _string_code(n: Column) -> Column:
    out = F.lit("VARCHAR_LARGE")
    for s in reversed(STRING_SIZES):
        out = F.when(n <= s, F.lit(f"String{s}")).otherwise(out)
    return F.when(n.isNull(), F.lit("String1")).otherwise(out)


def _digits(c: Column) -> tuple[Column, Column]:
    """Digits before and after the point of a number, counted in its exact decimal text ``ddd.dddE±x`` (NULL for NULL, infinity
    and not-a-number): the point stands ``x`` digits further right, zeros at either end do not count."""
    text = c.cast("string")
    shape = r"^-?([0-9]+)(?:\.([0-9]+))?(?:E([-+]?[0-9]+))?$"
    part = [F.regexp_extract(text, shape, i) for i in (1, 2, 3)]
    digits = F.concat(part[0], part[1])
    point = F.length(part[0]) + F.coalesce(F.nullif(part[2], F.lit("")).cast("int"), F.lit(0))
    leading = F.length(digits) - F.length(F.regexp_replace(digits, "^0+", ""))
    last = F.length(F.regexp_replace(digits, "0+$", ""))
    some = F.when(text.rlike(shape), F.when(last == 0, F.lit(0)))        # zero has no digits
    return (F.coalesce(some, F.when(text.rlike(shape), F.greatest(point - leading, F.lit(0)))),
            F.coalesce(some, F.when(text.rlike(shape), F.greatest(last - point, F.lit(0)))))


def profile_types(df: DataFrame, table_name: str = "") -> DataFrame:
    """TY-8: nearest-fit type per column measured in one aggregate pass: smallest StringN that
    holds the longest text; integers up to 9 digits INTEGER, up to 18 BIGINT; decimals the
    smallest (p, s) that holds every value, DOUBLE beyond 38 digits; dates / timestamps by family."""
    aggs, plan = [], []
    for f in df.schema.fields:
        c, t, n = F.col(f.name), f.dataType, f.name
        if isinstance(t, T.StringType):
            aggs.append(F.max(F.length(c)).alias(f"{n}__len"))
            plan.append((n, "string"))
        elif isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            aggs.append(F.max(F.length(F.regexp_replace(c.cast("string"), "-", ""))).alias(f"{n}__int"))
            plan.append((n, "integer"))
        elif isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
            whole, frac = _digits(c)
            aggs += [F.max(frac).alias(f"{n}__scale"), F.max(whole).alias(f"{n}__int")]
            plan.append((n, "decimal"))
        elif isinstance(t, T.DateType):
            plan.append((n, "date"))
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            plan.append((n, "timestamp"))
        else:
            plan.append((n, "other"))
    a = df.agg(*aggs) if aggs else df.limit(1).select(F.lit(1).alias("_one"))
    rows = []
    for n, kind in plan:
        if kind == "string":
            L = F.col(f"{n}__len")
            rows.append(F.struct(F.lit(n).alias("column_name"), F.lit("string").alias("family"), L.cast("long").alias("max_length"),
                                 F.lit(None).cast("long").alias("int_digits"), F.lit(None).cast("long").alias("scale"),
                                 _string_code(L).alias("code")))
        elif kind == "integer":
            d = F.col(f"{n}__int")
            rows.append(F.struct(F.lit(n).alias("column_name"), F.lit("integer").alias("family"),
                                 F.lit(None).cast("long").alias("max_length"), d.cast("long").alias("int_digits"),
                                 F.lit(0).cast("long").alias("scale"),
                                 F.when(d <= 9, "INTEGER").when(d <= 18, "BIGINT").otherwise("DECIMAL(38,0)").alias("code")))
        elif kind == "decimal":
            d, s = F.coalesce(F.col(f"{n}__int"), F.lit(0)), F.coalesce(F.col(f"{n}__scale"), F.lit(0))
            p = F.greatest(d + s, F.lit(1))
            rows.append(F.struct(F.lit(n).alias("column_name"), F.lit("decimal").alias("family"),
                                 F.lit(None).cast("long").alias("max_length"), d.cast("long").alias("int_digits"),
                                 s.cast("long").alias("scale"),
                                 F.when(p > 38, F.lit("DOUBLE"))       # more digits than any decimal holds
                                 .otherwise(F.concat(F.lit("DECIMAL("), p.cast("string"), F.lit(","), s.cast("string"), F.lit(")"))).alias("code")))
        else:
            code = {"date": "DATE", "timestamp": "TIMESTAMP"}.get(kind, "VARCHAR")
            rows.append(F.struct(F.lit(n).alias("column_name"), F.lit(kind).alias("family"),
                                 F.lit(None).cast("long").alias("max_length"), F.lit(None).cast("long").alias("int_digits"),
                                 F.lit(None).cast("long").alias("scale"), F.lit(code).alias("code")))
    out = a.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out.select(F.lit(table_name).alias("table_name"), "*")


def evolve(tgt: DataFrame, spec: list[ColumnSpec], add_hash: bool = True) -> DataFrame:
    """TY-9: additive schema evolution: missing declared columns (and RWHKEY) are added as NULL
    of their type; nothing is dropped or retyped."""
    have = {c.lower() for c in tgt.columns}
    out = tgt
    for f in schema_from_spec(spec).fields:
        if f.name.lower() not in have:
            out = out.withColumn(f.name, F.lit(None).cast(f.dataType))
            have.add(f.name.lower())
    if add_hash and "rwhkey" not in have:
        out = out.withColumn("RWHKEY", F.lit(None).cast("string"))
    return out
