"""Readers (SRC-1 … SRC-12).

Files are read by Spark's own data sources, values as text (the spec casts them, so rejects
stay visible); only the first line of a file is looked at on the driver (delimiter sniffing,
header names). Per-file line positions for header/footer skipping are computed from the
file path and split offset, so a large file is still read by many tasks.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from ..session import local_rows
from .splits import fields_of, json_array_elements, line_fields, quoted_records

# Delimiters tried in order on the first line; default when none occurs.
DELIMITERS = ("\t", ",", ";", "|")
DEFAULT_DELIMITER = ","


def first_line(spark: SparkSession, path: str, encoding: str = "utf-8") -> str | None:
    row = spark.read.option("encoding", encoding).text(path).limit(1).first()
    return row["value"] if row else None


def sniff_delimiter(line: str | None) -> str:
    for d in DELIMITERS:
        if line and d in line:
            return d
    return DEFAULT_DELIMITER


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, quote: str = '"',
                   encoding: str = "utf-8", header: bool = True, null_value: str | None = None) -> DataFrame:
    """SRC-1: delimiter sniffed from the first line (tab, ``,``, ``;``, ``|``, else ``,``);
    header row; every value read as text. A record with too few fields is kept with NULLs; one with
    too many is left out (``read_delimited_checked`` returns those)."""
    return read_delimited_checked(spark, path, sep, quote, encoding, header, null_value)[0]


def read_delimited_checked(spark: SparkSession, path: str, sep: str | None = None, quote: str = '"', encoding: str = "utf-8",
                           header: bool = True, null_value: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): rejects holds the records with too many fields as ``line``, however many there are (empty fields at the end
    carry nothing and are ignored), and the lines after a quote that is never closed. Quoted fields may hold separators, doubled
    quotes and line breaks; a large file is read by many tasks either way (``splits``). Empty values are NULL, and those equal to
    ``null_value``. Repeated header names are numbered: ``a``, ``a.1``."""
    sep = sep or sniff_delimiter(first_line(spark, path, encoding))
    lines = spark.read.option("encoding", encoding).text(path)
    if lines.where(F.contains("value", F.lit(quote))).isEmpty():
        return _read_unquoted(spark, path, lines, sep, encoding, header, null_value)
    records, unclosed = quoted_records(spark, path, sep, quote, encoding)
    first = records.where("head").select("fields").first()
    if first is None:
        return local_rows(spark, [], "value string"), unclosed.select(F.col("value").alias("line"))
    names = header_names(first["fields"], header)
    body = records.where("NOT head") if header else records
    rows, long = _fit(body, names, null_value)
    return rows, long.unionByName(unclosed.select(F.col("value").alias("line")))


def header_names(fields: list[str], header: bool = True) -> list[str]:
    """Column names of a header record; a repeated name gets a number, a missing one its place."""
    if not header:
        return [f"_c{i}" for i in range(len(fields))]
    out, seen = [], {}
    for i, f in enumerate(fields):
        name = f.strip() or f"Unnamed: {i}"
        n = seen.get(name, 0)
        seen[name] = n + 1
        out.append(f"{name}.{n}" if n else name)
    return out


def _fit(records: DataFrame, names: list[str], null_value: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, too long) of records with ``value`` and ``fields``."""
    beyond = F.exists(F.slice("fields", F.lit(len(names) + 1), F.size("fields")), lambda x: x != "")

    def value(i):
        v = F.nullif(F.get("fields", F.lit(i)), F.lit(""))
        return F.nullif(v, F.lit(null_value)) if null_value else v
    return (records.where(~beyond).select(*[value(i).alias(n) for i, n in enumerate(names)]),
            records.where(beyond).select(F.col("value").alias("line")))


def _read_unquoted(spark, path, lines, sep, encoding, header, null_value):
    """Files without a quote: Spark's own reader, which keeps a line whose number of fields differs from the header's."""
    plain = {"sep": sep, "header": str(header).lower(), "quote": "", "encoding": encoding}
    if null_value is not None:
        plain["nullValue"] = null_value
    top = lines.where("value <> ''").first()
    if top is None:
        return local_rows(spark, [], "value string"), lines.limit(0).select(F.col("value").alias("line"))
    names = header_names(top["value"].split(sep), header)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_wl_line"]])
    raw = (spark.read.options(**plain).schema(schema).option("mode", "PERMISSIVE").option("enforceSchema", "true")
           .option("columnNameOfCorruptRecord", "_wl_line").option("columnPruning", "false").csv(path))

    def too_long(c):
        parts = F.split(c, "\\Q" + sep + "\\E", -1)
        return F.exists(F.slice(parts, F.lit(len(names) + 1), F.size(parts)), lambda x: x != "")
    some = F.coalesce(F.length(F.col(f"`{names[0]}`")), F.lit(0)) >= 0        # Spark reads the line text only beside a column
    rows = raw.where(some & F.coalesce(~too_long(F.col("_wl_line")), F.lit(True))).select(*[F.col(f"`{n}`") for n in names])
    return rows, lines.where(too_long(F.col("value"))).select(F.col("value").alias("line"))


def _ddl(schema: T.StructType) -> str:
    """Schema text with quoted names (a header may hold blanks and punctuation)."""
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs become ``a.b`` columns (recursively); arrays and maps stay as they are. Where a nested value and a plain
    column come to the same name, they are one column: the nested value, where there is one, else the plain one."""
    found: dict[str, list] = {}

    def walk(dt: T.StructType, prefix: list[str]):
        for f in dt.fields:
            path = prefix + [f.name]
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, path)
            else:
                found.setdefault(sep.join(path), []).append((len(path), F.col(".".join(f"`{p}`" for p in path)), f.dataType))
    walk(df.schema, [])

    def one(parts):
        if len(parts) == 1:
            return parts[0][1]
        deepest = sorted(parts, key=lambda p: -p[0])
        same = len({p[2].simpleString() for p in parts}) == 1
        return F.coalesce(*[c if same else c.cast("string") for _, c, _ in deepest])
    return df.select(*[one(parts).alias(name) for name, parts in found.items()])


def read_json_flat(spark: SparkSession, path: str, multiline: bool | None = None) -> DataFrame:
    """SRC-2: a list of objects, one object, or JSON lines; nested objects flattened. Files that hold a list are read by many tasks
    (``read_json_array``); ``multiline`` forces Spark's own reader with or without whole files."""
    if multiline is None:
        top = spark.read.option("lineSep", "}").text(path).where(F.trim(F.col("value"), F.lit(" \t\r\n")) != "").first()
        if top is not None and top["value"].lstrip().startswith("["):
            return flatten(read_json_array(spark, path))
        line = (first_line(spark, path) or "").strip()
        multiline = not (line.startswith("{") and line.endswith("}"))
    return flatten(spark.read.option("multiLine", str(multiline).lower()).json(path))


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """The objects of JSON array files, cut out of the splits by many tasks, stored as JSON lines and read with Spark's reader."""
    from .sinks import scratch_dir
    out = scratch_dir(spark, "json-elements")
    json_array_elements(spark, path).write.text(out)
    return spark.read.json(out)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """SRC-3: column subset pruned at the scan."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def detect_row_tag(spark: SparkSession, path: str) -> str:
    """SRC-5 (one scan): the most frequent element that holds child elements (ties: smaller name).

    Leaf elements are counted separately (``<t>text</t>`` or ``<t/>``) and left out, so a flat
    record element wins over its own fields (which repeat just as often)."""
    lines = spark.read.text(path)
    tags = F.concat(
        F.transform(F.regexp_extract_all("value", F.lit(r"<([A-Za-z_][\w.-]*)"), 1), lambda t: F.struct(t.alias("tag"), F.lit(1).alias("n"))),
        F.transform(F.regexp_extract_all("value", F.lit(r"<([A-Za-z_][\w.-]*)(?:\s[^>]*)?(?:/>|>[^<]*</\1\s*>)"), 1),
                    lambda t: F.struct(t.alias("tag"), F.lit(-1).alias("n"))))
    x = lines.select(F.explode(tags).alias("t")).groupBy("t.tag").agg(F.sum("t.n").alias("inner"))
    best = x.filter(F.col("inner") > 1).orderBy(F.col("inner").desc(), F.col("tag")).first()
    return best["tag"] if best else "row"


def read_xml(spark: SparkSession, path: str, row_tag: str | None = None, attribute_mode: bool = False,
             columns: dict[str, str] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """SRC-4 (with a ``schema`` no inference pass runs): one row per ``row_tag`` element; columns are child elements, or attributes in
    attribute mode, or an explicit column -> ``child/sub`` path map. Values as text."""
    tag = row_tag or detect_row_tag(spark, path)
    r = spark.read.format("xml") if schema is None else spark.read.format("xml").schema(schema)
    df = (r.option("rowTag", tag).option("inferSchema", "false")
               .option("attributePrefix", "_").option("valueTag", "_VALUE").load(path))
    if columns:
        return df.select(*[F.col(".".join(f"`{p}`" for p in p_.split("/"))).alias(c) for c, p_ in columns.items()])
    if attribute_mode:
        return df.select(*[F.col(f"`{c}`").alias(c[1:]) for c in df.columns if c.startswith("_") and c != "_VALUE"])
    return df.select(*[c for c in df.columns if not c.startswith("_")])


_READERS: dict[str, Callable] = {}


def register_reader(ext: str, fn: Callable) -> None:
    """UD-2: add a reader for a file extension."""
    _READERS[ext.lower().lstrip(".")] = fn


def read_any(spark: SparkSession, path: str, **opts) -> DataFrame:
    """SRC-6: route by extension (.csv .tsv .txt delimited; .json; .xml; .parquet .parq)."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower().lstrip(".")
    if ext in _READERS:
        return _READERS[ext](spark, path, **opts)
    if ext in ("csv", "tsv", "txt"):
        return read_delimited(spark, path, **opts)
    if ext == "json":
        return read_json_flat(spark, path, **opts)
    if ext == "xml":
        return read_xml(spark, path, **opts)
    if ext in ("parquet", "parq"):
        return read_parquet(spark, path, **opts)
    raise ValueError(f"no reader for extension {ext!r}")


def numbered_lines(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """Text lines with ``file``, 1-based ``line_no`` and ``lines_in_file`` per file.

    A split of a file is read in order by one task; the position inside the split comes from
    the row id, the split's offset among the splits of its file from a small per-split table.
    """
    raw = (spark.read.option("encoding", encoding).text(path)
                .select("value", F.col("_metadata.file_path").alias("file"),
                        F.col("_metadata.file_block_start").alias("block"),
                        F.monotonically_increasing_id().alias("_mid")))
    per = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    w = Window.partitionBy("file").orderBy("block")
    per = (per.withColumn("_off", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .withColumn("lines_in_file", F.sum("_n").over(Window.partitionBy("file"))))
    j = raw.join(per, ["file", "block"])      # one row per file split; broadcast only if it proves small
    return j.select("value", "file", (F.col("_off") + F.col("_mid") - F.col("_first") + 1).alias("line_no"),
                    "lines_in_file")


def number_in_file_order(df: DataFrame, col: str = "row_index") -> DataFrame:
    """1-based position of every row over all input files (files in path order, rows in file
    order), without sorting the data: ``df`` must be a file scan (it reads ``_metadata``). Only a
    per-split table (one row per file split) is aggregated and joined.

    This is the row index the error records of a file load refer to."""
    raw = df.select("*", F.col("_metadata.file_path").alias("_wl_file"),
                    F.col("_metadata.file_block_start").alias("_wl_block"),
                    F.monotonically_increasing_id().alias("_wl_mid"))
    per = raw.groupBy("_wl_file", "_wl_block").agg(F.count(F.lit(1)).alias("_wl_n"), F.min("_wl_mid").alias("_wl_first"))
    w = Window.orderBy("_wl_file", "_wl_block").rowsBetween(Window.unboundedPreceding, -1)
    # one row per split: the running total over splits is a small single-task window
    per = per.withColumn("_wl_off", F.coalesce(F.sum("_wl_n").over(w), F.lit(0)))
    j = raw.join(per.select("_wl_file", "_wl_block", "_wl_off", "_wl_first"), ["_wl_file", "_wl_block"])
    return j.withColumn(col, (F.col("_wl_off") + F.col("_wl_mid") - F.col("_wl_first") + 1).cast("long")) \
            .drop("_wl_file", "_wl_block", "_wl_mid", "_wl_off", "_wl_first")


def skip_rows(lines: DataFrame, header: int = 0, footer: int = 0) -> DataFrame:
    """SRC-7: drop the first ``header`` and last ``footer`` lines of every file."""
    return lines.filter((F.col("line_no") > header) & (F.col("line_no") <= F.col("lines_in_file") - footer))


def skip_matching(lines: DataFrame, header_pattern: str | None = None, footer_pattern: str | None = None) -> DataFrame:
    """SRC-8: drop lines matching the header / footer patterns (title, rule, total, page lines)."""
    out = lines
    for p in (header_pattern, footer_pattern):
        if p:
            out = out.filter(~F.col("value").rlike(p))
    return out


def parse_lines(lines: DataFrame, sep: str | None = None, header: bool = True, quote: str = '"') -> DataFrame:
    """Lines left after skipping -> columns (``parse_lines_checked`` also returns the lines with too many fields)."""
    return parse_lines_checked(lines, sep, header, quote)[0]


def parse_lines_checked(lines: DataFrame, sep: str | None = None, header: bool = True, quote: str = '"') -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) as in ``read_delimited_checked``, of records on one line each. The header is the first remaining line of the
    first file (one line reaches the driver); header lines are removed from every file."""
    numbered = "line_no" in lines.columns
    first = lines.orderBy("file", "line_no").select("value").first() if numbered else lines.select("value").first()
    if first is None:
        return local_rows(lines.sparkSession, [], "value string"), local_rows(lines.sparkSession, [], "line string")
    text = first["value"]
    sep = sep or sniff_delimiter(text)
    names = header_names(fields_of(text, sep, quote), header)
    body = lines
    if header:      # the first line left of every file is its header; an equal line further down is data
        body = lines.filter(F.col("value") != F.lit(text))
        if numbered:
            heads = lines.groupBy("file").agg(F.min("line_no").alias("_wl_head"))
            body = lines.join(heads, "file").where("line_no <> _wl_head").drop("_wl_head")
    return _fit(body.where("value <> ''").select("value", line_fields(F.col("value"), sep, quote).alias("fields")), names)


def sql_source(spark: SparkSession, query: str, params: dict | None = None) -> DataFrame:
    """SRC-9: SELECT / WITH query over registered views, named parameters bound (``:name``)."""
    return spark.sql(query, args=params or None)


def jdbc_source(spark: SparkSession, url: str, table: str, key: str | None = None, n: int | None = None,
                properties: dict | None = None) -> DataFrame:
    """SRC-10: external table read in ``n`` key ranges; bounds come from a MIN/MAX query pushed
    to the database (one row)."""
    props = dict(properties or {})
    if not key or not n:
        return spark.read.jdbc(url, table, properties=props)
    b = spark.read.jdbc(url, f"(SELECT MIN({key}) AS lo, MAX({key}) AS hi FROM {table}) b", properties=props).first()
    if b is None or b["lo"] is None:
        return spark.read.jdbc(url, table, properties=props)
    return spark.read.jdbc(url, table, column=key, lowerBound=int(b["lo"]), upperBound=int(b["hi"]) + 1,
                           numPartitions=n, properties=props)


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    """SRC-11"""
    return df.limit(n)


def table_info(df: DataFrame) -> DataFrame:
    """SRC-12: row count, column count and column names as one row."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count", F.lit(len(df.columns)).alias("column_count"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"))

