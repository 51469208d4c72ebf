"""Source divergence audit: how the words of every source of a language differ from its other sources, and which of them stand out.

Method (count-cell ranking). A term's value depends on two counts only, so terms are never scored one by one:

1. One scan counts terms per (lang, source); a task adds up its own documents before anything is shuffled.
2. The kept terms of a language (in at least ``min_docs`` of its documents) are stored with their language count and their
   counts per source, and grouped by exactly these counts: a *profile* with its multiplicity.
3. Cells: terms of a group with the same (group count, lang count) are one cell. ``f`` is evaluated once per cell; cells of equal
   value are merged, ranked by value, and the cumulative multiplicity gives every merged cell its first rank.
4. Only cells that start at or before rank ``top`` are expanded to their terms, in UTF-8 order.

Two sources are compared the same way, by cells (count in one, count in the other). Only cells with both counts above zero come
from profiles; the cells with a zero follow from the totals (all terms with count c less those that the other source has too, and
so on), so no term is ever paired with a source that lacks it. Sums are exact: longs, and decimals where a product may pass 2^63.

Skew: a frequent term reaches the shuffle as one row per task, source and language; a hot source is a key of counts only. A profile
holds at most one entry per source of the language; the result itself has one row per pair of these. Nothing is collected or broadcast.

Defined cases: NULL text, lang or source count as ''; a group without a term still has its pairs, and no term rows; a language
without kept terms has pairs of value 0; repeated rows are documents of their own; very long texts are counted whole, term by
term; equal values rank by the UTF-8 order of the item; an empty table gives no rows; further columns are not read."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, table

MIN_DOCS, TOP = 3, 200
SCALE = 1_000_000_000
ENTRIES_AT_ONCE, BYTES_AT_ONCE = 200_000, 64 << 20
TERMS_AT_ONCE, ROWS_AT_ONCE = 500_000, 50_000

#: Terms are runs of letters: A-Z, a-z and everything past ASCII. Every byte of a character past ASCII is above 0x7F, so the
#: split of the UTF-8 bytes is the split of the code points.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_COUNTS = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("docs", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def _count(batches):
    """One row per (lang, term) of the documents a task reads: in how many of them, and how often by source. Given out whenever the
    counts held reach a bound; the row without a term has the number of documents by source."""
    docs, occurrences, groups, size = defaultdict(Counter), defaultdict(Counter), Counter(), 0

    def rows():
        for lang in dict.fromkeys(lang for lang, _ in groups):
            mine = [source for other, source in groups if other == lang]
            place = {t: i for i, t in enumerate(docs[lang])}
            last = len(place)                                    # of the row without a term
            term = pa.array([*place, None], pa.binary())
            seen = np.append(np.fromiter(docs[lang].values(), np.int64, last), 0)
            at, of, n = [], [], []
            for k, source in enumerate(mine):
                c = occurrences[lang, source]
                at += [np.fromiter(map(place.__getitem__, c), np.int64, len(c)), [last]]
                n += [np.fromiter(c.values(), np.int64, len(c)), [groups[lang, source]]]
                of.append(np.full(len(c) + 1, k))
            at, of, n = (np.concatenate(x) for x in (at, of, n))
            order = np.argsort(at, kind="stable")
            ends = np.append(0, np.cumsum(np.bincount(at, minlength=last + 1)))
            names = pa.array(mine, pa.string()).take(pa.array(of[order]))
            for i in range(0, last + 1, ROWS_AT_ONCE):
                j = min(i + ROWS_AT_ONCE, last + 1)
                lo, hi, ends_here = ends[i], ends[j], pa.array(ends[i:j + 1] - ends[i], pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * (j - i), pa.string()), term.slice(i, j - i), pa.array(seen[i:j]),
                    pa.ListArray.from_arrays(ends_here, names.slice(lo, hi - lo)), pa.ListArray.from_arrays(ends_here, pa.array(n[order[lo:hi]]))], schema=_COUNTS)
        docs.clear(), occurrences.clear(), groups.clear()

    for b in batches:
        langs, sources, texts = (b.column(c) for c in ("lang", "source", "text"))
        for i in range(b.num_rows):
            lang, source, t = langs[i].as_py(), sources[i].as_py(), texts[i].as_py()
            found = terms_of(t)
            groups[lang, source] += 1
            occurrences[lang, source].update(found)
            docs[lang].update(set(found))
            size += len(t)
            if size > BYTES_AT_ONCE or i % 64 == 63 and sum(map(len, occurrences.values())) > TERMS_AT_ONCE:
                yield from rows()
                size = 0
    yield from rows()


def term_table(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, n, profile): the kept terms with their count in the language and, by source, their counts above zero. The row
    without a term lists every source of the language (with its number of documents)."""
    d = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")],
                    F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    counted = (d.mapInArrow(_count, "lang string, term binary, docs long, sources array<string>, counts array<long>")
               .withColumn("term", F.col("term").cast("string")))
    # already added up per task, so one exchange by (lang, term) serves both aggregates
    by_source = (counted.repartition("lang", "term").select("lang", "term", "docs", F.posexplode("sources").alias("i", "source"), "counts")
                 .groupBy("lang", "term", "source").agg(F.sum(F.expr("if(i = 0, docs, 0)")).alias("docs"), F.sum(F.expr("counts[i]")).alias("n")))
    whole = (by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"),
                                                   F.sort_array(F.collect_list(F.struct("source", F.col("n").alias("c")))).alias("profile")))
    return cut_lineage(whole.where((F.col("docs") >= min_docs) | F.col("term").isNull()).select("lang", "term", "n", "profile"), "divergence-terms")


def _p(count: str, total: str, kept: str):
    """1 + floor(SCALE * (count + 1) / (total + kept)), exact."""
    return F.expr(f"1L + (cast({SCALE} as decimal(10,0)) * cast({count} + 1 as decimal(20,0))) div cast({total} + {kept} as decimal(20,0))")


_F = "((p - q) * (p - q)) div q"


_SHARED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("x", pa.int64()), ("y", pa.int64()), ("m", pa.int64())])


def _shared_cells(batches):
    """Cells (count in one source, count in another) with both above zero, of the profiles a task reads. Held are at most
    ``ENTRIES_AT_ONCE`` counts and one batch; every pair of sources is given in one direction, smaller name first."""
    held, entries = [], 0

    def flush():
        lang = pa.chunked_array([b.column("lang") for b in held]).combine_chunks().dictionary_encode()
        m = np.concatenate([b.column("m").to_numpy() for b in held])
        profile = pa.chunked_array([b.column("profile") for b in held]).combine_chunks()
        length = profile.value_lengths().to_numpy()
        flat = profile.flatten()
        names, source = np.unique(flat.field("source").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        values, count = np.unique(flat.field("c").to_numpy(), return_inverse=True)
        start = np.cumsum(length) - length
        row = np.repeat(np.arange(len(length)), length)
        of_lang = lang.indices.to_numpy()
        rank = np.argsort(np.argsort([n.encode() for n in names.tolist()])) if len(names) else names     # order of the UTF-8 bytes
        for g, name in enumerate(lang.dictionary.to_pylist()):
            for s in np.unique(source[of_lang[row] == g]):
                at = np.flatnonzero((source == s) & (of_lang[row] == g))              # this source's counts: one per profile
                n = length[row[at]]
                whole = np.repeat(start[row[at]] - (np.cumsum(n) - n), n) + np.arange(n.sum())    # all counts of those profiles
                mine = np.repeat(at, n)
                later = rank[source[whole]] > rank[s]
                whole, mine = whole[later], mine[later]
                key = (source[whole] * len(values) + count[mine]) * len(values) + count[whole]
                cell, first, back = np.unique(key, return_index=True, return_inverse=True)
                if len(cell):
                    total = np.zeros(len(cell), np.int64)
                    np.add.at(total, back, m[row[whole]])
                    yield pa.RecordBatch.from_arrays([
                        pa.array([name] * len(cell)), pa.array([names[s]] * len(cell)), pa.array(names[source[whole[first]]].tolist()),
                        pa.array(values[count[mine[first]]]), pa.array(values[count[whole[first]]]), pa.array(total)], schema=_SHARED)

    for b in batches:
        held.append(b)
        entries += len(b.column("profile").flatten())
        if entries >= ENTRIES_AT_ONCE:
            yield from flush()
            held, entries = [], 0
    if held:
        yield from flush()


class Cells:
    """The kept terms of a corpus by their counts."""

    def __init__(self, terms: DataFrame):
        self.terms = terms.where("term IS NOT NULL")
        self.profiles = cut_lineage(self.terms.groupBy("lang", "n", "profile").agg(F.count(F.lit(1)).alias("m")), "divergence-profiles")
        of_lang = self.profiles.groupBy("lang").agg(F.sum("m").alias("kept"), F.sum(F.col("m") * F.col("n")).alias("lang_total"))
        #: (lang, source, c, n, m): how many kept terms have count c in the source and n in the language
        self.cells = cut_lineage(self.profiles.select("lang", "n", "m", F.explode("profile").alias("e"))
                                 .groupBy("lang", F.col("e.source").alias("source"), F.col("e.c").alias("c"), "n").agg(F.sum("m").alias("m")), "divergence-cells")
        of_group = self.cells.groupBy("lang", "source").agg(F.sum(F.col("c") * F.col("m")).alias("total"))
        groups = terms.where("term IS NULL").select("lang", F.explode("profile").alias("e")).select("lang", "e.source")
        #: one row per occurring group: its total, the number of kept terms and the total of its language
        self.groups = cut_lineage(groups.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
                                  .na.fill(0, ["total", "kept", "lang_total"]), "divergence-groups")

    def standing_out(self, top: int = TOP) -> DataFrame:
        """Part ``term``: lang, source, item, value, rank."""
        cells = (self.cells.join(self.groups, ["lang", "source"]).withColumn("p", _p("c", "total", "kept")).withColumn("q", _p("n", "lang_total", "kept"))
                 .where("p > q").select("lang", "source", "c", "n", "m", F.expr(_F).alias("value")))
        merged = cells.groupBy("lang", "source", "value").agg(F.sum("m").alias("m"))
        best = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
        # every merged cell has a term, so later ones than the first ``top`` cannot reach rank ``top``
        merged = (merged.withColumn("r", F.row_number().over(best)).where(F.col("r") <= top)
                  .withColumn("before", F.sum("m").over(best.rowsBetween(Window.unboundedPreceding, 0)) - F.col("m"))
                  .where(F.col("before") < top).select("lang", "source", "value", "before"))
        chosen = cells.join(merged, ["lang", "source", "value"]).select("lang", "source", "c", "n", "value", "before")
        expanded = (self.terms.select("lang", "term", "n", F.explode("profile").alias("e"))
                    .select("lang", F.col("e.source").alias("source"), F.col("e.c").alias("c"), "n", F.col("term").alias("item"))
                    .join(chosen, ["lang", "source", "c", "n"]))
        inside = Window.partitionBy("lang", "source", "value").orderBy("item")
        return (expanded.withColumn("r", F.row_number().over(inside)).where(F.col("r") <= top)
                .withColumn("rank", (F.col("before") + F.col("r")).cast("int")).where(F.col("rank") <= top)
                .select("lang", "source", "item", "value", "rank"))

    def between_sources(self) -> DataFrame:
        """Part ``pair``: lang, source, item (the other source), value, rank."""
        g = self.groups
        other = g.select("lang", F.col("source").alias("item"), F.col("total").alias("item_total"))
        pairs = g.select("lang", "source", "total", "kept").join(other, "lang").where("source <> item")
        shared = (self.profiles.where("size(profile) > 1").select("lang", "m", "profile").mapInArrow(_shared_cells, "lang string, source string, item string, x long, y long, m long")
                  .groupBy("lang", "source", "item", "x", "y").agg(F.sum("m").alias("m")))
        both = shared.unionByName(shared.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("y").alias("x"), F.col("x").alias("y"), "m"))

        def spread(df, *cells):
            """(x, y, m) rows out of each row: signed counts of terms per cell."""
            made = F.array(*[F.struct(*[F.expr(v).cast("long").alias(k) for k, v in zip("xym", c)]) for c in cells])
            return df.select("lang", "source", "item", F.explode(made).alias("d")).select("lang", "source", "item", "d.*")

        alone = self.cells.groupBy("lang", "source", "c").agg(F.sum("m").alias("m"))
        keys = pairs.select("lang", "source", "item", "kept")
        signed = (spread(both, ("x", "y", "m"), ("x", "0", "-m"), ("0", "y", "-m"), ("0", "0", "m"))
                  .unionByName(spread(keys.join(alone, ["lang", "source"]), ("c", "0", "m"), ("0", "0", "-m")))
                  .unionByName(spread(keys.join(alone.withColumnRenamed("source", "item"), ["lang", "item"]), ("0", "c", "m"), ("0", "0", "-m")))
                  .unionByName(spread(keys, ("0", "0", "kept"))))
        cells = signed.groupBy("lang", "source", "item", "x", "y").agg(F.sum("m").alias("m")).where("m > 0")
        summed = (cells.join(pairs, ["lang", "source", "item"]).withColumn("p", _p("x", "total", "kept")).withColumn("q", _p("y", "item_total", "kept"))
                  .groupBy("lang", "source", "item").agg(F.sum(F.expr(f"cast({_F} as decimal(19,0)) * cast(m as decimal(19,0))")).cast("long").alias("value")))
        by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return (keys.join(summed, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("long")))
                .withColumn("rank", F.row_number().over(by_value)).select("lang", "source", "item", "value", "rank"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair | term), item, value, rank."""
    cells = Cells(term_table(docs, min_docs))
    cols = ("lang", "source", "part", "item", "value", "rank")
    return (cells.between_sources().withColumn("part", F.lit("pair")).select(*cols)
            .unionByName(cells.standing_out(top).withColumn("part", F.lit("term")).select(*cols)))


def op11_source_divergence(spark, sf_dir) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT rid) >= {MIN_DOCS}),
lt AS (SELECT lang, count(*) AS v, sum(n) AS nl FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
gc AS (SELECT lang, source, term, count(*) AS c FROM o GROUP BY lang, source, term),
f AS (SELECT g.lang, g.source, k.term, k.n, coalesce(gc.c, 0) AS c FROM g JOIN kept k ON g.lang = k.lang
      LEFT JOIN gc ON gc.lang = g.lang AND gc.source = g.source AND gc.term = k.term),
gt AS (SELECT lang, source, sum(c) AS ng FROM f GROUP BY lang, source),
s AS (SELECT f.lang, f.source, f.term, f.c, 1 + (CAST({SCALE} AS HUGEINT) * (f.c + 1)) // (gt.ng + lt.v) AS p,
        1 + (CAST({SCALE} AS HUGEINT) * (f.n + 1)) // (lt.nl + lt.v) AS q
      FROM f JOIN gt ON f.lang = gt.lang AND f.source = gt.source JOIN lt ON f.lang = lt.lang),
pv AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
       FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pr AS (SELECT a.lang, a.source, b.source AS item, coalesce(pv.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
       LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
t AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM s WHERE c > 0 AND p > q),
r AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pr
      UNION ALL
      SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM t)
      WHERE rank <= {TOP})
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r
"""
