"""wareloom: warehouse loading and reporting as Spark DataFrame jobs.

Sub-packages
------------
functions   Column builders (formulas, scalar helpers, row hashing)
operators   DataFrame -> DataFrame operators (mapping, merges, quality, analytics, reports)
sources     readers and writers (delimited, JSON, XML, Parquet, SQL, JDBC)
plans       multi-step jobs (mapping runs, backfill) and the bound query catalogue
streaming   Structured Streaming ingest and merge
"""

__version__ = "0.1.0"
