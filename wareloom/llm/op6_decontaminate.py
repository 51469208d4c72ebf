"""Benchmark decontamination with a distributed positional inverted index.

1. Index: one scan of the corpus stores, for every term of the benchmark, its postings - document and position of every
   occurrence - as one row per term and block of documents (a segment of the index); a block holds a bounded number of words.
2. The benchmark's windows (13 consecutive words, or a whole shorter item) are looked up from their rarest terms: the four rarest
   of each window are its seeds. Their posting lists, shifted by the term's place in the item, are intersected by grouping on
   (document, item, offset). An exact occurrence puts all seeds of its window at one offset.
3. Offsets with enough seeds are verified against the postings of all terms of the item: a term counts where the document has it
   at its place, or up to ``SLACK`` words away (proximity). Runs of words in place that cover a window are exact
   phrase matches; windows of which enough words are near their place are proximity matches.

Two of four seeds at one offset make a candidate, so a window with one word inserted, removed or replaced is always looked at,
whichever word it is: three seeds are left at least, two of them on one side of the edit. With more edits a proximity match may be missed, an exact one never.

The benchmark is taken in groups of items of bounded size (``group_words`` words); terms, seeds and words of one group are what a task
holds and what is broadcast, so memory does not grow with the benchmark; each group is one pass over the corpus. Rows carry
the row id of their place in the file, so no text is copied; the index is deleted once the matches are stored.

Defined cases: NULL or empty text has no words and no hits; a document is a row (rows sharing a doc_id are judged apart, identical rows
alike); a very long text is indexed whole; a benchmark row with a NULL id or NULL text is skipped; repeated item ids count once;
an empty benchmark gives no hits, an empty corpus no rows; further columns are not read, and pass through the pipeline form whatever
their names."""

from __future__ import annotations

import re
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROWS_AT_ONCE, WORD, cut_lineage, map_columns, scratch_tables, shielded, small_table, table, with_row_ids

TOKEN = re.compile(WORD)
WINDOW = 13
SEEDS, SLACK = 4, 2
WORDS_AT_ONCE = 1_000_000


def words_of(text) -> list[str]:
    if not text:
        return []
    return TOKEN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))  # A-Z only


POSTINGS = "term int, rids array<long>, at array<int>"
_POSTINGS = pa.schema([("term", pa.int32()), ("rids", pa.list_(pa.int64())), ("at", pa.list_(pa.int32()))])


def _postings(ids, batches):
    """Postings of a block of documents: per term the documents and positions of its occurrences. Term -1 has the number of words
    of every document."""
    def block(rids, words):
        size = np.fromiter(map(len, words), np.int64, len(words))
        code = np.fromiter((c for w in words for c in map(ids.get, w, repeat(-1))), np.int32, int(size.sum()))
        at = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
        doc = np.repeat(rids, size)
        known = np.flatnonzero(code >= 0)
        known = known[np.argsort(code[known], kind="stable")]
        term, first = np.unique(code[known], return_index=True)
        offsets = pa.array(np.r_[0, len(rids) + np.r_[first, len(known)]].astype(np.int32))
        return pa.RecordBatch.from_arrays([
            pa.array(np.r_[-1, term].astype(np.int32)),
            pa.ListArray.from_arrays(offsets, pa.array(np.r_[rids, doc[known]].astype(np.int64))),
            pa.ListArray.from_arrays(offsets, pa.array(np.r_[size, at[known]].astype(np.int32)))], schema=_POSTINGS)

    for b in batches:
        rids, texts = b.column("rid").to_numpy(zero_copy_only=False), b.column("text")
        start, words, n = 0, [], 0
        for i in range(b.num_rows):
            words.append(words_of(texts[i].as_py()))
            n += len(words[-1])
            if n >= WORDS_AT_ONCE or len(words) == ROWS_AT_ONCE:
                yield block(rids[start:i + 1], words)
                start, words, n = i + 1, [], 0
        if words:
            yield block(rids[start:], words)


def seed_positions(words: list, occurrences: dict, window: int = WINDOW, seeds: int = SEEDS) -> list[int]:
    """Positions of the ``seeds`` rarest terms of every window. Terms that no document holds have no postings and are no seeds (a
    window with one has no exact match, but may have a proximity match)."""
    k = min(window, len(words))
    rank = [(occurrences.get(w, 0), w, i) for i, w in enumerate(words)]
    return sorted({r[2] for s in range(len(words) - k + 1) for r in sorted(x for x in rank[s:s + k] if x[0])[:seeds]})


def _runs(window, near, cols):
    """Exact and proximity matches of one (document, item, offset): ``found`` has the item's places that the document has, each with
    its distance from the place the offset gives it."""
    out = {k: [] for k in ("rid", "item_id", "first", "last", "exact", "agree")}

    def match(rid, item, first, last, exact, agree):
        for c, v in zip(out, (rid, item, first, last, exact, agree)):
            out[c].append(v)

    for rid, item, off, n, found in zip(*(cols[c].to_pylist() for c in ("rid", "item_id", "off", "n", "found"))):
        k = min(window, n)
        places = {f["j"]: f["d"] for f in found}
        run = exact = 0
        for j in range(n + 1):
            if places.get(j) == 0:
                run += 1
                continue
            if run >= k:
                match(rid, item, off + j - run, off + j - 1, True, run)
                exact += 1
            run = 0
        if not exact and k > 1:
            here = np.zeros(n + 1, np.int64)
            here[[j + 1 for j in places]] = 1
            total = np.cumsum(here)
            agree = int((total[k:] - total[:len(total) - k]).max())
            if agree >= max(2, -(-near * k // window)):
                match(rid, item, None, None, False, agree)
    return out


MATCHES = "rid long, item_id string, first long, last long, exact boolean, agree long"


def _groups(items: list, group_words: int):
    group, size = [], 0
    for i, w in items:
        if group and size + len(w) > group_words:
            yield group
            group, size = [], 0
        group.append((i, w))
        size += len(w)
    if group:
        yield group


def _group_matches(docs: DataFrame, group: list, window: int, near: int) -> tuple[DataFrame, DataFrame]:
    """(index, matches) of one group of items over documents with a row id."""
    spark = docs.sparkSession
    terms = sorted({w for _, ws in group for w in ws})
    ids = {w: i for i, w in enumerate(terms)}
    index = cut_lineage(docs.select("rid", "text").mapInArrow(partial(_postings, ids), POSTINGS), "positional-index")
    lists = index.where("term >= 0")
    occurrences = {r["term"]: r["n"] for r in lists.groupBy("term").agg(F.sum(F.size("rids")).alias("n")).collect()}   # one row per term of the group
    coded = [(n, i, [ids[w] for w in ws]) for n, (i, ws) in enumerate(sorted({(i, tuple(ws)) for i, ws in group}))]
    words = small_table(spark, [(n, j, t) for n, _, ws in coded for j, t in enumerate(ws)], "item int, j int, term int")
    seeds = small_table(spark, [(n, j, ws[j]) for n, _, ws in coded for j in seed_positions(ws, occurrences, window)], "item int, j int, term int")
    items = small_table(spark, [(n, i, len(ws), min(2, window, len(ws))) for n, i, ws in coded], "item int, item_id string, n int, least int")

    # a group's terms, seeds and items are bounded by its number of words
    aligned = (lists.join(F.broadcast(seeds), "term").select("item", "j", F.explode(F.arrays_zip("rids", "at")).alias("p"))
               .groupBy(F.col("p.rids").alias("rid"), "item", (F.col("p.at") - F.col("j")).alias("off")).agg(F.count(F.lit(1)).alias("seeds")))
    candidates = cut_lineage(aligned.join(F.broadcast(items), "item").where("seeds >= least").select("rid", "item", "item_id", "n", "off"), "offsets")
    wanted = (candidates.join(F.broadcast(words), "item")
              .select("rid", "item", "off", "j", "term", F.explode(F.sequence(F.lit(-SLACK), F.lit(SLACK))).alias("d"))
              .withColumn("at", F.col("off") + F.col("j") + F.col("d")))
    there = (lists.select("term", F.explode(F.arrays_zip("rids", "at")).alias("p")).select("term", F.col("p.rids").alias("rid"), F.col("p.at").alias("at"))
             .join(candidates.select("rid").distinct(), "rid", "left_semi"))
    found = (wanted.join(there, ["rid", "term", "at"]).groupBy("rid", "item", "off", "j").agg(F.min(F.abs("d")).alias("d"))
             .groupBy("rid", "item", "off").agg(F.collect_list(F.struct("j", "d")).alias("found")))           # at most one entry per word of the item
    full = found.join(candidates, ["rid", "item", "off"]).select("rid", "item_id", "off", "n", "found")
    return index, cut_lineage(map_columns(full, partial(_runs, window, near), MATCHES), "matches", keep=True)


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, near_words: int = 9,
                 group_words: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """(documents, matches). documents: rid, n_words - one row per document row (``docs`` has the row id ``rid``).
    matches: rid, item_id, first, last (words, for exact ones), exact, agree (words in place, or near it)."""
    spark = docs.sparkSession
    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string"), "text")
    items = ((r["item_id"], words_of(r["text"])) for r in rows.orderBy("item_id", "text").toLocalIterator())
    first, found = None, small_table(spark, [], MATCHES)
    for group in _groups((x for x in items if x[1]), group_words):
        with scratch_tables(spark):
            index, matches = _group_matches(docs, group, window, near_words)
            first = first if first is not None else _sizes(index)
        found = found.unionByName(matches)
    if first is None:
        with scratch_tables(spark):
            first = _sizes(docs.select("rid", "text").mapInArrow(partial(_postings, {}), POSTINGS))
    return first, found


def _sizes(index: DataFrame) -> DataFrame:
    sizes = index.where("term = -1").select(F.explode(F.arrays_zip("rids", "at")).alias("p"))
    return cut_lineage(sizes.select(F.col("p.rids").alias("rid"), F.col("p.at").cast("long").alias("n_words")), "document-words", keep=True)


def judged(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document row of ``docs`` (with row id): rid and what ``contamination`` says of it."""
    rows, matches = find_matches(docs, benchmark, **options)
    exact = matches.where("exact")
    hit = (exact.groupBy("rid").agg(F.collect_set(F.struct("first", "last")).alias("runs"), F.collect_set("item_id").alias("items"))
           .select("rid", "items", F.size(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["last"])))))
                   .cast("long").alias("n_hit")))
    near = matches.where("NOT exact").groupBy("rid").agg(F.collect_set("item_id").alias("near"))
    none = F.array().cast("array<string>")
    out = rows.join(hit, "rid", "left").join(near, "rid", "left")
    items = F.array_sort(F.coalesce("items", none))
    return out.select(
        "rid", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) * 20 >= F.greatest(F.col("n_words"), F.lit(1))).alias("contaminated"),
        items.alias("items"), F.array_except(F.array_sort(F.coalesce("near", none)), items).alias("near_items"))


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, near_items."""
    numbered = with_row_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return numbered.select("rid", "doc_id").join(judged(numbered, benchmark, **options), "rid").drop("rid")


def keep_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Pipeline form: document rows that are not contaminated, columns as they came. Rows are judged apart, whatever their doc_id."""
    def step(d):
        numbered = with_row_ids(d)
        with scratch_tables(d.sparkSession):
            bad = cut_lineage(judged(numbered, benchmark, **options).where("contaminated").select("rid"), "contaminated", keep=True)
        return numbered.join(bad, "rid", "left_anti")

    return shielded(docs, step)


def op6_decontaminate(spark, sf_dir) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_TOKENS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
           r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TOKENS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_TOKENS} AS w FROM benchmark WHERE item_id IS NOT NULL),
g AS (SELECT item_id, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS t FROM g),
ks AS (SELECT DISTINCT k FROM win),
dp AS (SELECT rid, k, unnest(range(1, len(w) - k + 2)) AS s, w FROM d, ks WHERE len(w) >= k),
m AS (SELECT rid, item_id, s, win.k FROM (SELECT rid, k, s, array_to_string(w[s:s + k - 1], ' ') AS t FROM dp) x JOIN win ON x.t = win.t AND x.k = win.k),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + k)) AS p FROM m) GROUP BY rid),
i AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)) AS contaminated
FROM d LEFT JOIN h ON d.rid = h.rid LEFT JOIN i ON d.rid = i.rid
"""
