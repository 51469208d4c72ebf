"""Line dedup: exact reference counts screened by sharded cuckoo filters, reversible.

State of an index: ``members`` (key, doc_id) - one row per document row and distinct line key -
``refs`` (key, n_docs, last_doc) - the exact reference counts - and ``filters`` - one cuckoo
filter per shard over the keys of ``refs`` that reach ``min_docs``. Inserting documents adds
references; deleting documents takes them away again and removes keys that fall below the
threshold from the filters, so insert followed by delete restores the former state.

The filters answer "can this line be a repeated one?"; positive lines are settled against the exact counts (a false positive
drops nothing). Filters of ``max_filter_bytes`` in all at most go to the map tasks that hold the texts, so documents
without a positive line never move: the step that screens them finishes them. A task has one Python step, so an executor keeps as many
Python workers as it has cores. Larger ones stay where they are: the 16-byte keys of the lines come to the filters, sorted by
shard, and a task holds one filter at a time (``_screen_sorted``); a hot shard is dealt over ``SALTS`` tasks. Either way nothing that
grows with the corpus reaches the driver.

Defined cases: NULL or empty text is one empty line and keeps ``""``; a document is a row (told by its place in the file), so two
rows of one doc_id count twice and both keep the line when that doc_id is the largest; a NULL
doc_id sorts below every id (if only NULL ids hold a line, all of them keep it); a very long text is split whole; equal rows get equal
results; an empty table gives no rows. Other columns pass through, whatever their names."""

from __future__ import annotations

import hashlib
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, cut_lineage, fields, map_columns, shielded, with_row_ids

BLANK = b" \t\n\x0b\x0c\r"
SLOTS = 4               # entries per cuckoo bucket
KEYS_PER_SHARD = 40_000  # keys a shard is sized for; the number of shards follows the key count
MAX_KICKS = 500
SALTS = 16
RID = "_wl_rid"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128-bit key of a line: blanks stripped at both ends, A-Z lower-cased; None if too short."""
    k = line.strip(BLANK).lower()      # bytes.lower() changes A-Z only
    if len(k) < min_chars or (len(k) < 4 * min_chars and len(k.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(k)


def _lines(text) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def _member_rows(min_chars, cols):
    ids, keys = [], []
    for d, t in zip(cols["doc_id"].to_pylist(), cols["text"].to_pylist()):
        found = {line_key(x, min_chars) for x in _lines(t)}
        found.discard(None)
        ids += [d] * len(found)
        keys += found
    return {"doc_id": ids, "key": keys}


def members(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """(doc_id, key): the distinct line keys of every document row."""
    return map_columns(docs.select(F.col("doc_id").cast("long"), F.col("text")), partial(_member_rows, min_chars),
                       "doc_id long, key binary")


def ref_counts(member_rows: DataFrame) -> DataFrame:
    """(key, n_docs, last_doc): counted with a map-side partial step, so a hot line is one row per task."""
    return member_rows.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))


# ------------------------------------------------------------------ cuckoo filter of one shard

class CuckooFilter:
    """16-bit fingerprints, two candidate buckets of four slots, partial-key displacement."""

    def __init__(self, buckets: int, slots: np.ndarray | None = None):
        self.n = buckets                       # a power of two
        self.slots = np.zeros((buckets, SLOTS), np.uint16) if slots is None else slots

    @classmethod
    def for_keys(cls, n: int) -> "CuckooFilter":
        return cls(1 << max(4, int(np.ceil(np.log2(max(1, n) / (SLOTS * 0.85))))))

    @staticmethod
    def parts(keys: np.ndarray):
        """keys: (n, 2) uint64 -> first bucket hash and fingerprint (never 0)."""
        fp = (keys[:, 1] >> np.uint64(48)).astype(np.uint16)
        fp[fp == 0] = 1
        return (keys[:, 0] >> np.uint64(16)) & np.uint64(0xFFFFFFFF), fp

    def _other(self, bucket, fp):
        with np.errstate(over="ignore"):
            h = np.uint64(fp) * np.uint64(0x5BD1E995)
        return (np.uint64(bucket) ^ (h & np.uint64(self.n - 1))) & np.uint64(self.n - 1)

    def _both(self, keys):
        h, fp = self.parts(keys)
        a = h & np.uint64(self.n - 1)
        b = (a ^ ((fp.astype(np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(self.n - 1))) & np.uint64(self.n - 1)
        return a.astype(np.int64), b.astype(np.int64), fp

    def contains(self, keys: np.ndarray) -> np.ndarray:
        a, b, fp = self._both(keys)
        return ((self.slots[a] == fp[:, None]) | (self.slots[b] == fp[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """False when a key found no place (the caller then builds a larger filter)."""
        rng = np.random.default_rng(len(keys))
        for i, j, fp in zip(*self._both(keys)):
            for at in (i, j):
                free = np.flatnonzero(self.slots[at] == 0)
                if len(free):
                    self.slots[at, free[0]] = fp
                    break
            else:
                at, cur = (i, j)[rng.integers(2)], fp
                for _ in range(MAX_KICKS):
                    s = rng.integers(SLOTS)
                    cur, self.slots[at, s] = self.slots[at, s], cur
                    at = int(self._other(at, cur))
                    free = np.flatnonzero(self.slots[at] == 0)
                    if len(free):
                        self.slots[at, free[0]] = cur
                        break
                else:
                    return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """Remove one copy of each key's fingerprint; only keys that were inserted may be removed."""
        for i, j, fp in zip(*self._both(keys)):
            for at in (i, j):
                hit = np.flatnonzero(self.slots[at] == fp)
                if len(hit):
                    self.slots[at, hit[0]] = 0
                    break

    @classmethod
    def build(cls, keys: np.ndarray) -> "CuckooFilter":
        f = cls.for_keys(len(keys))
        while not f.insert(keys):
            f = cls(f.n * 2)
        return f


def _as_pairs(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), dtype=">u8").reshape(-1, 2).astype(np.uint64)


def _shard_of(pairs: np.ndarray, shards: int) -> np.ndarray:
    return (pairs[:, 0] >> np.uint64(48)) % np.uint64(shards)


def _tag_shard(shards, cols):
    keys = cols["key"].to_pylist()
    return {"key": cols["key"], "shard": _shard_of(_as_pairs(keys), shards).astype(np.int32) if keys else []}


def _build_shard(pdf):
    import pandas as pd
    f = CuckooFilter.build(_as_pairs(list(pdf["key"])))
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "buckets": [f.n], "slots": [f.slots.tobytes()]})


def build_filters(keys: DataFrame, n_keys: int, keys_per_shard: int = KEYS_PER_SHARD) -> tuple[DataFrame, int]:
    """One filter row (shard, buckets, slots) per shard; shards are sized so that each group is bounded."""
    shards = max(1, -(-n_keys // keys_per_shard))
    tagged = map_columns(keys.select("key"), partial(_tag_shard, shards), "key binary, shard int")
    return tagged.groupBy("shard").applyInPandas(_build_shard, "shard int, buckets int, slots binary"), shards


class LineIndex:
    """Reversible index: exact references plus the cuckoo filters over repeated keys.

    ``insert`` and ``delete`` return a new index; the tables of the old one stay valid. Only keys
    whose count crosses ``min_docs`` touch a filter."""

    def __init__(self, member_rows: DataFrame, min_docs: int = 5, min_chars: int = 40, filters=None):
        self.members, self.min_docs, self.min_chars = member_rows, min_docs, min_chars
        self.repeated = cut_lineage(ref_counts(member_rows).where(F.col("n_docs") >= min_docs), "line-refs")
        self.n_repeated = self.repeated.count()
        table, self.shards = filters or build_filters(self.repeated, self.n_repeated)
        self.filters = table if filters else cut_lineage(table, "line-filters")

    @classmethod
    def of(cls, docs: DataFrame, min_docs: int = 5, min_chars: int = 40, keep_members: bool = True) -> "LineIndex":
        """``keep_members`` writes the references once, so that later inserts and deletes do not read the texts again."""
        rows = members(docs, min_chars)
        return cls(cut_lineage(rows, "line-members") if keep_members else rows, min_docs, min_chars)

    def _changed(self, rows: DataFrame) -> "LineIndex":
        rows = cut_lineage(rows, "line-members")
        new = ref_counts(rows).where(F.col("n_docs") >= self.min_docs).select("key")
        old = self.repeated.select("key")
        moved = (map_columns(new.join(old, "key", "left_anti"), partial(_tag_shard, self.shards), "key binary, shard int")
                 .withColumn("added", F.lit(True))
                 .unionByName(map_columns(old.join(new, "key", "left_anti"), partial(_tag_shard, self.shards),
                                          "key binary, shard int").withColumn("added", F.lit(False))))
        filters = moved.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(
            _update_shard, "shard int, buckets int, slots binary")
        return LineIndex(rows, self.min_docs, self.min_chars, (cut_lineage(filters, "line-filters"), self.shards))

    def insert(self, docs: DataFrame) -> "LineIndex":
        return self._changed(self.members.unionByName(members(docs, self.min_chars)))

    def delete(self, doc_ids: DataFrame) -> "LineIndex":
        """``doc_ids``: a frame with a doc_id column; all rows of these ids leave the index."""
        return self._changed(self.members.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti"))

    def small_filters(self, max_bytes: int) -> dict | None:
        """shard -> filter, if all of them take ``max_bytes`` at most; else None."""
        size = self.filters.agg(F.sum(F.col("buckets").cast("long") * (SLOTS * 2)).alias("b")).first()["b"] or 0
        if size > max_bytes:
            return None
        return {r["shard"]: CuckooFilter(r["buckets"], np.frombuffer(r["slots"], np.uint16).reshape(-1, SLOTS)) for r in self.filters.collect()}


def _update_shard(moved, table):
    import pandas as pd
    if len(table) == 0:
        f = CuckooFilter.build(_as_pairs(list(moved["key"][moved["added"]])))
        return pd.DataFrame({"shard": [int(moved["shard"].iloc[0])], "buckets": [f.n], "slots": [f.slots.tobytes()]})
    r = table.iloc[0]
    f = CuckooFilter(int(r["buckets"]), np.frombuffer(r["slots"], np.uint16).reshape(-1, SLOTS).copy())
    if len(moved):
        gone, added = list(moved["key"][~moved["added"]]), list(moved["key"][moved["added"]])
        if gone:
            f.delete(_as_pairs(gone))
        kept = f.slots.copy()
        if added and not f.insert(_as_pairs(added)):
            f = _grown(kept, _as_pairs(added))
    return pd.DataFrame({"shard": [int(r["shard"])], "buckets": [f.n], "slots": [f.slots.tobytes()]})


def _grown(slots, pairs):
    """A filter that can take more keys: twice the buckets, each old entry kept in both of the
    buckets it may now belong to (more false positives, never a false negative)."""
    n = len(slots) * 2
    while True:
        big = np.zeros((n, SLOTS), np.uint16)
        for k in range(n // len(slots)):
            big[k * len(slots):(k + 1) * len(slots)] = slots
        f = CuckooFilter(n, big)
        if f.insert(pairs):
            return f
        n *= 2


# ------------------------------------------------------------------ applying an index to texts

def _screen(filters, shards, min_chars, cols) -> list[list[bytes]]:
    """Keys of each text that its shard's filter knows."""
    per, flat = [], []
    for t in cols["text"].to_pylist():
        found = {line_key(x, min_chars) for x in _lines(t)}
        found.discard(None)
        per.append(len(found))
        flat += found
    hit = np.zeros(len(flat), bool)
    if flat:
        pairs = _as_pairs(flat)
        shard = _shard_of(pairs, shards)
        for s in np.unique(shard):
            if int(s) in filters:
                at = np.flatnonzero(shard == s)
                hit[at] = filters[int(s)].contains(pairs[at])
    out, k = [], 0
    for n in per:
        out.append([flat[k + i] for i in range(n) if hit[k + i]])
        k += n
    return out


def _candidates(screen, cols):
    """(rid, doc_id, key) of the positive lines."""
    found = screen(cols)
    at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]).astype(np.int64))
    return {"rid": cols[RID].take(at), "doc_id": cols["doc_id"].take(at), "key": [k for x in found for k in x]}


def _rows_with(positive, screen, cols):
    """The rows that have a positive line, or those that have none."""
    at = pa.array(np.flatnonzero([bool(x) is positive for x in screen(cols)]), pa.int64())
    return {name: c.take(at) for name, c in cols.items()}


def _still(screen, min_chars, cols):
    """The rows without a positive line and what ``_apply`` says of them."""
    rows = _rows_with(False, screen, cols)
    return rows | _apply(min_chars, rows)


def _rid_keys(shards, min_chars, cols):
    """The distinct line keys of every row, with their shard; a row's keys go to the salt its number picks."""
    out = {k: [] for k in ("rid", "doc_id", "key")}
    for r, d, t in zip(*(cols[c].to_pylist() for c in (RID, "doc_id", "text"))):
        found = {line_key(x, min_chars) for x in _lines(t)}
        found.discard(None)
        out["rid"] += [r] * len(found)
        out["doc_id"] += [d] * len(found)
        out["key"] += found
    shard = _shard_of(_as_pairs(out["key"]), shards).astype(np.int32) if out["key"] else np.zeros(0, np.int32)
    return out | {"shard": shard, "salt": (np.array(out["rid"], np.int64) % SALTS).astype(np.int32)}


_SCREENED = "rid long, doc_id long, key binary"


def _screen_sorted(batches):
    """Keys their shard's filter knows, out of rows sorted by shard and salt with the filter first."""
    at, f = None, None
    for b in batches:
        shard, salt, slots = b.column("shard").to_numpy(), b.column("salt").to_numpy(), b.column("slots")
        start, keep = 0, []
        place = np.stack([shard, salt], 1)
        cuts = np.r_[np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1, len(shard)]
        for end in cuts.tolist():
            if end == start:
                continue
            if (shard[start], salt[start]) != at:
                at, f = (shard[start], salt[start]), None
            while start < end and slots[start].is_valid:
                f = CuckooFilter(b.column("buckets")[start].as_py(), np.frombuffer(slots[start].as_buffer(), np.uint16).reshape(-1, SLOTS))
                start += 1
            if start < end and f is not None:
                known = f.contains(_as_pairs(b.column("key").slice(start, end - start).to_pylist()))
                keep += (np.flatnonzero(known) + start).tolist()
            start = end
        rows = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(c).take(rows) for c in ("rid", "doc_id", "key")], names=["rid", "doc_id", "key"])


def screen_by_shard(docs: DataFrame, index: "LineIndex") -> DataFrame:
    """(rid, doc_id, key) of the lines the filters know, with the keys brought to the filters."""
    keys = map_columns(docs.select(RID, "doc_id", "text"), partial(_rid_keys, index.shards, index.min_chars), "rid long, doc_id long, key binary, shard int, salt int")
    tables = index.filters.select(*[F.lit(None).cast(t).alias(c) for c, t in (("rid", "long"), ("doc_id", "long"), ("key", "binary"))], "shard",
                                  F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "buckets", "slots")
    both = keys.select("*", F.lit(None).cast("int").alias("buckets"), F.lit(None).cast("binary").alias("slots")).unionByName(tables)
    return (both.repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("slots").isNull())
            .mapInArrow(_screen_sorted, _SCREENED))


def _apply(min_chars, cols):
    """Drop the lines whose key is in ``_wl_drop`` (none without that column); count lines and hash what stays."""
    n, dropped, text, sha = [], [], [], []
    for t, drop in zip(cols["text"].to_pylist(), cols["_wl_drop"].to_pylist() if "_wl_drop" in cols else repeat(None)):
        lines = _lines(t)
        gone = set(drop or ())
        keep = [x for x in lines if line_key(x, min_chars) not in gone] if gone else lines
        body = b"\n".join(keep)
        n.append(len(lines))
        dropped.append(len(lines) - len(keep))
        text.append(None if t is None else body.decode("utf-8", "replace"))
        sha.append(hashlib.sha256(body).hexdigest())
    return {"n_lines": n, "n_dropped": dropped, "kept_text": text, "kept_sha256": sha}


RESULT = "n_lines long, n_dropped long, kept_text string, kept_sha256 string"


def dedup_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, index: LineIndex | None = None,
                max_filter_bytes: int = 32 << 20) -> DataFrame:
    """``docs`` with n_lines, n_dropped, kept_text and kept_sha256.

    A line whose key (>= ``min_chars`` code points) is held by ``min_docs`` documents or more stays
    only in the largest doc_id holding it. Without an ``index`` the documents themselves are
    indexed."""
    docs = with_row_ids(docs.select(*[c for c in docs.columns if c.lower() not in ("_wl_cand", "_wl_drop", "_wl_id")]).withColumn("doc_id", F.col("doc_id").cast("long")), RID)
    index = index or LineIndex.of(docs.select("doc_id", "text"), min_docs, min_chars, keep_members=False)
    near = index.small_filters(max_filter_bytes)
    if near is None:
        moving, candidates = docs, screen_by_shard(docs, index)
    else:
        screen = partial(_screen, near, index.shards, index.min_chars)
        moving = map_columns(docs, partial(_rows_with, True, screen), docs.schema)
        candidates = map_columns(docs.select(RID, "doc_id", "text"), partial(_candidates, screen), _SCREENED)
    drops = (candidates.join(index.repeated, "key")
             .where(F.col("last_doc").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") < F.col("last_doc"))))
             .groupBy(F.col("rid").alias("_wl_id")).agg(F.collect_set("key").alias("_wl_drop")))       # a document's own lines
    # sorted and merged however few the drops are: a broadcast of them would put two Python steps into one task
    out = moving.join(drops.hint("merge"), F.col(RID) == F.col("_wl_id"), "left").drop("_wl_id")
    out = add_columns(out, partial(_apply, index.min_chars), RESULT).drop("_wl_drop", RID)
    if near is None:
        return out
    new = fields(RESULT)
    rest = docs.select(*[c for c in docs.columns if c.lower() not in {f.name for f in new}])
    still = map_columns(rest, partial(_still, screen, index.min_chars), T.StructType(rest.schema.fields + new.fields))
    return out.unionByName(still.drop(RID))


def drop_lines(docs: DataFrame, **options) -> DataFrame:
    """Pipeline form: every document with its repeated lines dropped, columns as they came; n_chars follows the text. No document
    goes: one of which nothing is left keeps an empty text."""
    def step(d):
        new = F.when(F.col("n_dropped") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
        return dedup_lines(d, **options).withColumn("n_chars", new).withColumn("text", F.col("kept_text"))

    return shielded(docs, step)


def op7_line_dedup(spark, sf_dir) -> DataFrame:
    from .common import table
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d),
k AS (SELECT rid, doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, count(DISTINCT rid) AS n, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key),
x AS (SELECT k.*, (r.key IS NOT NULL AND r.n >= 5 AND r.last IS NOT NULL AND coalesce(k.doc_id < r.last, true)) AS gone
      FROM k LEFT JOIN r ON k.key = r.key AND length(k.key) >= 40)
SELECT min(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM x GROUP BY rid
"""
