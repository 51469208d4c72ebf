"""Bound queries: type catalogue and schema operators (TY-*, JN-11).

The working catalogue is the sample catalogue (FIXTURES §4) plus sized-string codes derived
from the part sizes in ``part``; mapping-column specifications are derived from ``part`` rows,
so every query scans the supplied tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalogue as CT
from ..types import ColumnSpec
from .q_merges import PART_TARGET_SQL, part_target
from .registry import query
from .tables import portable, table
from ..session import local_rows

# Sample catalogue rows (code, value, database).
SAMPLE = [
    ("BIGINT", "BIGINT", "POSTGRESQL"), ("DATE", "DATE", "POSTGRESQL"), ("DECIMAL", "DECIMAL(18,2)", "POSTGRESQL"),
    ("INTEGER", "INTEGER", "POSTGRESQL"), ("JSON", "JSON", "POSTGRESQL"), ("TIMESTAMP", "TIMESTAMP", "POSTGRESQL"),
    ("VARCHAR", "VARCHAR(255)", "POSTGRESQL"), ("NUMBER", "NUMBER(10)", "ORACLE"), ("CLOB", "CLOB", "ORACLE"),
    ("VARCHAR2", "VARCHAR2(255)", "ORACLE"), ("DATE", "DATE", "GENERIC"), ("DECIMAL", "DECIMAL(18,2)", "GENERIC"),
    ("INTEGER", "INTEGER", "GENERIC"),
]


def _sample_sql() -> str:
    vals = ", ".join(f"('Datatype', '{c}', '{c} type', '{v}', '{d}', 'Y')" for c, v, d in SAMPLE)
    return f"SELECT * FROM (VALUES {vals}) v(prtyp, prcd, prdesc, prval, dbtyp, curflg)"


CAT_SQL = f"""({_sample_sql()}
UNION ALL SELECT DISTINCT 'Datatype', 'String' || CAST(p_size AS VARCHAR), 'String of ' || CAST(p_size * 10 AS VARCHAR),
  'VARCHAR(' || CAST(p_size * 10 AS VARCHAR) || ')', 'GENERIC', 'Y' FROM part
UNION ALL SELECT DISTINCT 'Datatype', 'String' || CAST(p_size AS VARCHAR), 'String of ' || CAST(p_size * 10 AS VARCHAR),
  'VARCHAR(' || CAST(p_size * 10 AS VARCHAR) || ')', 'POSTGRESQL', 'Y' FROM part WHERE p_size % 2 = 0
UNION ALL SELECT DISTINCT 'Datatype', 'String' || CAST(p_size AS VARCHAR), 'String of ' || CAST(p_size * 10 AS VARCHAR),
  'VARCHAR2(' || CAST(p_size * 10 AS VARCHAR) || ')', 'ORACLE', 'Y' FROM part WHERE p_size % 5 = 0)"""


def catalogue(spark, sf_dir):
    sample = local_rows(spark, [("Datatype", c, f"{c} type", v, d, "Y") for c, v, d in SAMPLE], CT.CATALOGUE_SCHEMA)
    sizes = table(spark, sf_dir, "part").select("p_size").distinct()
    code = F.concat(F.lit("String"), F.col("p_size").cast("string"))
    desc = F.concat(F.lit("String of "), (F.col("p_size") * 10).cast("string"))

    def rows(prefix, db, cond=None):
        s = sizes.filter(cond) if cond is not None else sizes
        return s.select(F.lit("Datatype").alias("prtyp"), code.alias("prcd"), desc.alias("prdesc"),
                        F.concat(F.lit(prefix + "("), (F.col("p_size") * 10).cast("string"), F.lit(")")).alias("prval"),
                        F.lit(db).alias("dbtyp"), F.lit("Y").alias("curflg"))
    return (sample.unionByName(rows("VARCHAR", "GENERIC"))
                  .unionByName(rows("VARCHAR", "POSTGRESQL", F.col("p_size") % 2 == 0))
                  .unionByName(rows("VARCHAR2", "ORACLE", F.col("p_size") % 5 == 0)))


_TYPE_CASE = """CASE p_type WHEN 'STANDARD' THEN 'VARCHAR' WHEN 'ECONOMY' THEN 'DECIMAL' WHEN 'MEDIUM' THEN 'INTEGER'
  WHEN 'PROMO' THEN 'DATE' WHEN 'LARGE' THEN 'String' || CAST(p_size AS VARCHAR) ELSE 'CLOB' END"""
_DB_CASE = "CASE p_size % 3 WHEN 0 THEN 'POSTGRESQL' WHEN 1 THEN 'ORACLE' ELSE 'MYSQL' END"
SPEC_SQL = f"(SELECT p_partkey, p_brand AS mapref, {_TYPE_CASE} AS trgcldtyp, {_DB_CASE} AS dbtyp FROM part)"


def column_specs(spark, sf_dir):
    """Mapping-column specifications derived from ``part``: one column per part row."""
    p = table(spark, sf_dir, "part")
    t = F.col("p_type")
    code = (F.when(t == "STANDARD", "VARCHAR").when(t == "ECONOMY", "DECIMAL").when(t == "MEDIUM", "INTEGER")
             .when(t == "PROMO", "DATE").when(t == "LARGE", F.concat(F.lit("String"), F.col("p_size").cast("string")))
             .otherwise("CLOB"))
    m = F.col("p_size") % 3
    db = F.when(m == 0, "POSTGRESQL").when(m == 1, "ORACLE").otherwise("MYSQL")
    return p.select("p_partkey", F.col("p_brand").alias("mapref"), code.alias("trgcldtyp"), db.alias("dbtyp"))


@query("catalogue_pref", f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY prcd ORDER BY CASE WHEN upper(dbtyp) = 'POSTGRESQL' THEN 0 ELSE 1 END) AS rn
  FROM {CAT_SQL} c WHERE curflg = 'Y' AND upper(dbtyp) IN ('POSTGRESQL', 'GENERIC')) x WHERE rn = 1""")
def catalogue_pref(spark, sf_dir):
    """TY-2 / WN-1: PostgreSQL rows preferred over GENERIC, one row per code."""
    return CT.catalogue_for(catalogue(spark, sf_dir), "POSTGRESQL")


@query("lookup_ranked", f"""
SELECT s.*, COALESCE(sp.prval, g.prval) AS prval,
       CASE WHEN sp.prval IS NOT NULL THEN 'SPECIFIC' WHEN g.prval IS NOT NULL THEN 'GENERIC' END AS resolved_from
FROM {SPEC_SQL} s
LEFT JOIN (SELECT * FROM {CAT_SQL} c WHERE curflg = 'Y' AND upper(dbtyp) <> 'GENERIC') sp
  ON sp.prcd = s.trgcldtyp AND upper(sp.dbtyp) = upper(s.dbtyp)
LEFT JOIN (SELECT * FROM {CAT_SQL} c WHERE curflg = 'Y' AND upper(dbtyp) = 'GENERIC') g ON g.prcd = s.trgcldtyp""")
def lookup_ranked(spark, sf_dir):
    """JN-11: every mapping column's type code resolved for its database, specific before GENERIC."""
    return CT.lookup_ranked(column_specs(spark, sf_dir), catalogue(spark, sf_dir), "trgcldtyp", "dbtyp")


def _matrix_sql() -> str:
    vals = ", ".join(f"('{code}', '{db}', '{vals[i]}')" for code, vals in CT.MATRIX.items()
                     for i, db in enumerate(CT.MATRIX_DATABASES))
    return f"(SELECT * FROM (VALUES {vals}) m(prcd, dbtyp, matrix_value))"


_OVERRIDES = {"DECIMAL": "NUMBER(18,2)"}


@query("catalogue_clone", f"""
SELECT g.prtyp, g.prcd, g.prdesc,
       COALESCE(CASE WHEN g.prcd = 'DECIMAL' THEN 'NUMBER(18,2)' END, m.matrix_value, g.prval) AS prval,
       'ORACLE' AS dbtyp, 'Y' AS curflg,
       CASE WHEN h.prcd IS NOT NULL THEN 'SKIPPED' ELSE 'CREATED' END AS action
FROM (SELECT * FROM {CAT_SQL} c WHERE upper(dbtyp) = 'GENERIC' AND curflg = 'Y') g
LEFT JOIN (SELECT DISTINCT prcd FROM {CAT_SQL} c WHERE upper(dbtyp) = 'ORACLE' AND curflg = 'Y') h ON h.prcd = g.prcd
LEFT JOIN (SELECT * FROM {_matrix_sql()} x WHERE dbtyp = 'ORACLE') m ON m.prcd = g.prcd""")
def catalogue_clone(spark, sf_dir):
    """TY-3: GENERIC rows cloned to ORACLE (override, else matrix, else generic value);
    codes Oracle already has are SKIPPED."""
    return CT.clone_catalogue(catalogue(spark, sf_dir), "ORACLE", _OVERRIDES)


@query("catalogue_missing", f"""
SELECT g.prcd, g.prval, CASE WHEN upper(g.prcd) IN ('INT', 'VARCHAR', 'DATE') THEN 'HIGH' ELSE 'MEDIUM' END AS priority
FROM (SELECT * FROM {CAT_SQL} c WHERE upper(dbtyp) = 'GENERIC' AND curflg = 'Y') g
WHERE g.prcd NOT IN (SELECT prcd FROM {CAT_SQL} c WHERE upper(dbtyp) = 'ORACLE' AND curflg = 'Y')""")
def catalogue_missing(spark, sf_dir):
    """TY-4: GENERIC codes Oracle has no row for, with priority."""
    return CT.missing_types(catalogue(spark, sf_dir), "ORACLE")


@query("type_suggest", f"""
SELECT g.prcd, g.prval AS generic_value, m.matrix_value AS suggested_value, CAST(0.85 AS DOUBLE) AS confidence
FROM (SELECT * FROM {CAT_SQL} c WHERE upper(dbtyp) = 'GENERIC' AND curflg = 'Y') g
JOIN (SELECT * FROM {_matrix_sql()} x WHERE dbtyp = 'MYSQL') m ON m.prcd = g.prcd""")
def type_suggest(spark, sf_dir):
    """TY-5: MySQL suggestions for the GENERIC codes known to the matrix."""
    return CT.suggest_types(catalogue(spark, sf_dir), "MYSQL")


@query("type_compat", f"""
SELECT c.prcd, c.dbtyp, c.prval, m.matrix_value AS suggested_value, m.matrix_value IS NOT NULL AS compatible,
       COALESCE(upper(c.prval) = upper(m.matrix_value), false) AS matches
FROM (SELECT * FROM {CAT_SQL} c WHERE upper(dbtyp) <> 'GENERIC' AND curflg = 'Y') c
LEFT JOIN {_matrix_sql()} m ON m.prcd = c.prcd AND m.dbtyp = upper(c.dbtyp)""")
def type_compat(spark, sf_dir):
    """TY-6: database rows checked against the recommended rendering."""
    return CT.check_compat(catalogue(spark, sf_dir))


@query("type_impact", f"""
SELECT c.prcd, COALESCE(u.n, 0) AS columns_using,
       CASE WHEN COALESCE(u.n, 0) = 0 THEN 'LOW' WHEN COALESCE(u.n, 0) <= 10 THEN 'MEDIUM' ELSE 'HIGH' END AS impact
FROM (SELECT DISTINCT prcd FROM {CAT_SQL} c) c
LEFT JOIN (SELECT trgcldtyp, count(*) AS n FROM {SPEC_SQL} s GROUP BY 1) u ON u.trgcldtyp = c.prcd""")
def type_impact(spark, sf_dir):
    """TY-7: mapping columns per catalogue code and the impact level of changing it."""
    return CT.type_impact(column_specs(spark, sf_dir), catalogue(spark, sf_dir))


def _profile_sql(tbl, cols):
    parts = []
    for name, kind in cols:
        if kind == "string":
            L = f"(SELECT max(length({name})) FROM {tbl})"
            code = "CASE " + " ".join(f"WHEN {L} <= {s} THEN 'String{s}'" for s in CT.STRING_SIZES) + \
                   " ELSE 'VARCHAR_LARGE' END"
            parts.append(f"SELECT '{tbl}' AS table_name, '{name}' AS column_name, 'string' AS family, "
                         f"CAST({L} AS BIGINT) AS max_length, CAST(NULL AS BIGINT) AS int_digits, "
                         f"CAST(NULL AS BIGINT) AS scale, {code} AS code")
        elif kind == "integer":
            d = f"(SELECT max(length(CAST(abs({name}) AS VARCHAR))) FROM {tbl})"
            parts.append(f"SELECT '{tbl}' AS table_name, '{name}' AS column_name, 'integer' AS family, "
                         f"CAST(NULL AS BIGINT) AS max_length, CAST({d} AS BIGINT) AS int_digits, CAST(0 AS BIGINT) AS scale, "
                         f"CASE WHEN {d} <= 9 THEN 'INTEGER' WHEN {d} <= 18 THEN 'BIGINT' ELSE 'DECIMAL(38,0)' END AS code")
        else:
            txt = f"CAST(CAST({name} AS DECIMAL(38,10)) AS VARCHAR)"
            frac = f"regexp_replace(regexp_extract({txt}, '\\.(\\d+)$', 1), '0+$', '')"
            whole = f"regexp_replace(regexp_extract({txt}, '^-?(\\d+)', 1), '^0+', '')"
            s = f"COALESCE((SELECT max(length({frac})) FROM {tbl}), 0)"
            d = f"COALESCE((SELECT max(length({whole})) FROM {tbl}), 0)"
            parts.append(f"SELECT '{tbl}' AS table_name, '{name}' AS column_name, 'decimal' AS family, "
                         f"CAST(NULL AS BIGINT) AS max_length, CAST({d} AS BIGINT) AS int_digits, CAST({s} AS BIGINT) AS scale, "
                         f"'DECIMAL(' || CAST(greatest({d} + {s}, 1) AS VARCHAR) || ',' || CAST({s} AS VARCHAR) || ')' AS code")
    return " UNION ALL ".join(parts)


_CUST_KINDS = [("c_custkey", "integer"), ("c_name", "string"), ("c_nationkey", "integer"), ("c_acctbal", "decimal"),
               ("c_mktsegment", "string")]
_PART_KINDS = [("p_partkey", "integer"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
               ("p_size", "integer"), ("p_retailprice", "decimal")]


@query("profile_types", _profile_sql("customer", _CUST_KINDS) + " UNION ALL " + _profile_sql("part", _PART_KINDS))
def profile_types(spark, sf_dir):
    """TY-8: nearest-fit generic type of every customer and part column, one pass per table."""
    a = CT.profile_types(table(spark, sf_dir, "customer"), "customer")
    b = CT.profile_types(table(spark, sf_dir, "part"), "part")
    return a.unionByName(b)


_EVOLVE_SPEC = [ColumnSpec("p_partkey", "BIGINT", key_seq=1), ColumnSpec("p_name", "String50"),
                ColumnSpec("p_comment", "String100"), ColumnSpec("p_weight", "DECIMAL(10,3)")]


@query("evolve_schema", f"""
SELECT * REPLACE (CAST(p_retailprice AS DOUBLE) AS p_retailprice), CAST(NULL AS VARCHAR) AS p_comment,
       CAST(NULL AS DOUBLE) AS p_weight, CAST(NULL AS VARCHAR) AS RWHKEY
FROM ({PART_TARGET_SQL}) t""")
def evolve_schema(spark, sf_dir):
    """TY-9: declared columns missing from the target are added (NULL), plus RWHKEY."""
    from ..operators.catalogue import evolve
    return portable(evolve(part_target(spark, sf_dir), _EVOLVE_SPEC))
