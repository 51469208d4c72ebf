"""Sharding by proportional stratified interleaving: every shard is a small copy of the corpus' mixture of sources.

Rows are shuffled inside their source by a seeded hash and ranked there; the r-th of n rows has the fractional rank
(2r - 1) / 2n. Sorted by fractional rank, every stretch of the order holds each source in proportion, so the order is cut into
``shards`` stretches whose row counts differ by one at most (law ``rows``). A shard holds its share of every source, one row more
or less; copies of a text spread like any other rows of their source.

Both orders are dense numberings over a range shuffle of narrow rows (no text): a source with a third of all rows spans many
partitions, its rank is its place in the partition plus an offset. Shard and slot follow from the position by arithmetic, so no
shard is ever one group. ``shard_documents`` joins them to the documents by row id, ``write_shards`` writes a folder per shard.

Defined cases: a NULL or empty text has 16 bytes and the CRC of no bytes (0); a NULL source is a source, the last one; a NULL doc_id
is shuffled by the row's size and CRC; repeated rows are rows of their own (equal ones are interchangeable); a very long text is one
row; fewer rows than shards leave the later shards empty; an empty table gives no rows; further columns pass through
``shard_documents`` whatever their names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wareloom.operators.keys import number_rows
from wareloom.operators.windows import number_within_groups

from .common import cut_lineage, shielded_names, table, with_row_ids
from .op12_importance import SQL_STEPS, sql_crc32

SHARDS, OVERHEAD, SEED = 40, 16, "20240613"
SOURCES_BROADCAST = 100_000


def narrow(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """What sharding has to know of a row: doc_id, source, size, text_crc32 and its seeded shuffle key (and ``rid``, if it has one)."""
    data = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(*[c for c in docs.columns if c == "rid"], "doc_id", F.col("source").cast("string").alias("source"),
                       (F.octet_length(data) + OVERHEAD).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    text = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "text_crc32")
    return rows.withColumn("shuffled", F.md5(text))


def assign(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``narrow`` rows with law, shard, slot, grown_shard (NULL: another shard count is another cut of the same order)."""
    by = ["shuffled", F.asc_nulls_last("doc_id"), *[c for c in rows.columns if c == "rid"]]
    ranked = cut_lineage(number_within_groups(rows, ["source"], by, col="place"), "shards-ranked")
    sources = cut_lineage(ranked.groupBy("source").agg(F.count(F.lit(1)).alias("of")).withColumnRenamed("source", "_s"), "shards-sources")
    n_sources, total = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("of"), F.lit(0))).first()
    if n_sources <= SOURCES_BROADCAST:                 # a checked size: one row per source
        sources = F.broadcast(sources)
    mixed = ranked.join(sources, F.col("source").eqNullSafe(F.col("_s"))).withColumn("fraction", (F.col("place") * 2.0 - 1.0) / (F.col("of") * 2.0))
    order = ["fraction", F.asc_nulls_last("source"), *by]
    placed = number_rows(mixed.drop("_s", "of", "place"), order, col="at", start=0)
    total = max(1, total)
    return (placed.withColumn("shard", F.expr(f"cast((at * {shards}) div {total} as int)"))
            .withColumn("slot", F.expr(f"at - (shard * {total}L + {shards - 1}) div {shards}"))
            .withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int")).drop("at", "fraction", "shuffled"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """The documents, all columns as they came, with ``shard`` and ``slot`` (existing columns of these names are replaced)."""
    hidden, back = shielded_names(docs, replaced=("shard", "slot"))
    numbered = with_row_ids(hidden)
    placed = assign(narrow(numbered, seed), shards).select("rid", "shard", "slot")
    return numbered.join(placed, "rid").select(*back, "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: str = SEED) -> None:
    """A folder ``shard=<k>`` per shard, its files in the order of ``slot``; a shard of many rows is written by several tasks."""
    out = shard_documents(docs, shards, seed)
    (out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.mode("overwrite").partitionBy("shard").parquet(path))


def op13_shard_documents(spark, sf_dir) -> DataFrame:
    return assign(narrow(table(spark, sf_dir, "documents"))).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "source")


SQL = f"""
WITH st AS {SQL_STEPS},
t AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents),
c AS (SELECT text, {sql_crc32('text')} AS crc FROM t, st),
d AS (SELECT doc_id, source, octet_length(encode(c.text)) + {OVERHEAD} AS size, crc FROM documents JOIN c ON coalesce(documents.text, '') = c.text),
k AS (SELECT *, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size || ':' || crc) AS h FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY source) AS o,
      count(*) OVER () AS n FROM k),
p AS (SELECT *, row_number() OVER (ORDER BY (place::DOUBLE * 2 - 1) / (o::DOUBLE * 2), source NULLS LAST, h, doc_id NULLS LAST) - 1 AS pos FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'rows' AS law, CAST(pos * {SHARDS} // n AS INTEGER) AS shard,
       CAST(pos - ((pos * {SHARDS} // n) * n + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, source FROM p
"""
