"""Target-distribution importance resampling: draw the documents whose words look most like those of a target (the benchmark).

A feature is a run of 1 to ``longest`` words; its bucket is the CRC-32 of its UTF-8 bytes modulo ``buckets``. The log ratio of the
smoothed bucket frequencies in the target and in the corpus is the bucket's gain, a document's weight the sum of its features'
gains, and a Gumbel number from the seeded hash of the doc_id makes the highest scores a draw without replacement.

Method (length-bucketed CRC matrices): the distinct features of a block of documents are grouped by their length in bytes; a group is
a two-dimensional uint8 array whose CRCs are all advanced together, one column after the other, and the buckets are scattered
back to the features. Features are never hashed one at a time.

Passes: one scan for the bucket counts (a task adds them up in one array and gives out at most ``buckets`` rows), one scan for the
weights, then a range shuffle of narrow rows to rank the eligible documents. What reaches the driver are the ``buckets`` gains and
a row count. Blocks are cut by bytes, so a very long text is a block of its own; nothing depends on how sources or copies are spread.

Defined cases: a NULL or empty text has no features, weight 0, a score, and no rank; a NULL doc_id is hashed as an empty text and
comes last among ties; repeated rows are documents of their own (equal rows are interchangeable); ties go to the smaller doc_id; an
empty corpus gives no rows; an empty benchmark counts as T = 0; further columns are not read."""

from __future__ import annotations

from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wareloom.operators.keys import number_rows

from .common import cut_lineage, map_columns, table

BUCKETS, LONGEST, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, "2024"
POLYNOMIAL = 0xEDB88320
BYTES_AT_ONCE = 8 << 20

#: A-Z to lower case, what is no word byte to a blank; bytes of characters past ASCII are all above 0x7F.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def crc_steps() -> np.ndarray:
    """What a byte does to a CRC-32: eight shifts of the polynomial for each of the 256 values."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & np.uint32(1), (t >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), t >> np.uint32(1))
    return t


STEPS = crc_steps()


def crcs(features: list[bytes]) -> np.ndarray:
    """CRC-32 of every feature, worked out length by length over uint8 matrices."""
    out = np.zeros(len(features), np.uint32)
    length = np.fromiter(map(len, features), np.int64, len(features))
    order = np.argsort(length, kind="stable")
    cuts = np.flatnonzero(np.diff(length[order])) + 1
    for at in np.split(order, cuts) if len(order) else []:
        n = int(length[at[0]])
        matrix = np.frombuffer(b"".join([features[i] for i in at]), np.uint8).reshape(len(at), n)
        columns = np.ascontiguousarray(matrix.T)
        crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
        for column in columns:
            crc = (crc >> np.uint32(8)) ^ STEPS[(crc ^ column) & np.uint32(0xFF)]
        out[at] = ~crc
    return out


def features_of(text: bytes | None, longest: int = LONGEST) -> tuple[int, list[bytes]]:
    """(number of words, features)"""
    w = (text or b"").translate(_WORDS).split()
    if longest == 1:
        return len(w), w
    return len(w), [b" ".join(w[i:i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def _blocks(texts):
    """Lists of texts of some megabytes at most (or of one text)."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or b"")
        if size >= BYTES_AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


def _bucket_counts(buckets, longest, batches):
    """How often each bucket is met by a task's documents."""
    total = np.zeros(buckets, np.int64)
    for b in batches:
        for block in _blocks(b.column("text").to_pylist()):
            n = Counter()
            for t in block:
                n.update(features_of(t, longest)[1])
            np.add.at(total, crcs(list(n)) % np.uint32(buckets), np.fromiter(n.values(), np.int64, len(n)))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n) of all features of a table with a ``text`` column."""
    t = texts.select(F.col("text").cast("binary").alias("text"))
    return t.mapInArrow(partial(_bucket_counts, buckets, longest), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, gain) for every bucket: floor(1000 * ln of the ratio of smoothed frequencies)."""
    s = bucket_counts(corpus, buckets, longest).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    t = bucket_counts(target, buckets, longest).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))
    every = corpus.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    counts = cut_lineage(s.unionByName(t).unionByName(every).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "importance-buckets")
    all_s, all_t = (float(x) for x in counts.agg(F.sum("s"), F.sum("t")).first())
    ratio = ((F.col("t") + 1.0) * (all_s + buckets)) / ((F.col("s") + 1.0) * (all_t + buckets))
    return counts.select("bucket", F.floor(F.log(ratio) * 1000.0).cast("long").alias("gain"))


def _weigh(gain, longest, cols):
    """Number of words, of features, and the sum of their gains."""
    words, count, weight = [], [], []
    for block in _blocks(cols["text"].to_pylist()):
        made = [features_of(t, longest) for t in block]
        distinct = list(set().union(*[f for _, f in made]))
        of = dict(zip(distinct, gain[crcs(distinct) % np.uint32(len(gain))].tolist()))
        for n, f in made:
            words.append(n)
            count.append(len(f))
            weight.append(sum(map(of.__getitem__, f)))
    return {"doc_id": cols["doc_id"], "n_words": words, "n_features": count, "weight": weight}


def weighed(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score per document row, as a table in the shared folder."""
    found = gains(docs, target, buckets, longest).collect()            # ``buckets`` rows, whatever the corpus
    gain = np.zeros(buckets, np.int64)
    for r in found:
        gain[r["bucket"]] = r["gain"]
    rows = map_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")),
                       partial(_weigh, gain, longest), "doc_id long, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000.0).cast("long")
    return cut_lineage(rows.withColumn("score", F.col("weight") + noise), "importance-scores")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, **options) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank: 1, 2, ... for the ``percent`` % highest scores among documents of at
    least ``min_words`` words, NULL for the others."""
    rows = weighed(docs, target, **options)
    eligible = rows.where(F.col("n_words") >= min_words)
    drawn = percent * eligible.count() // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight"]
    ranked = number_rows(eligible, order, col="rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = rows.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest)


def op12_importance_resample(spark, sf_dir) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


_TOKENS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
           r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

#: CRC-32 in SQL: ``crc_steps`` as a list, then one step per byte (two hexadecimal digits) of the text.
SQL_STEPS = (f"(SELECT list(v ORDER BY i) AS steps FROM (SELECT i, list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, {POLYNOMIAL}::BIGINT) "
             "ELSE a >> 1 END, i::BIGINT) AS v FROM range(256) r(i)))")


def sql_crc32(text: str) -> str:
    """CRC-32 (unsigned) of a VARCHAR expression, where ``steps`` is in scope."""
    return (f"xor(list_reduce(list_transform(range(octet_length(encode({text}))), lambda k: ('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::BIGINT), "
            "lambda a, b: xor(a >> 8, steps[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)")


SQL = f"""
WITH st AS {SQL_STEPS},
d AS (SELECT row_number() OVER () AS rid, doc_id, {_TOKENS} AS w FROM documents),
b AS (SELECT {_TOKENS} AS w FROM benchmark),
dw AS (SELECT rid, term, count(*) AS n FROM (SELECT rid, unnest(w) AS term FROM d) GROUP BY rid, term),
bw AS (SELECT term, count(*) AS n FROM (SELECT unnest(w) AS term FROM b) GROUP BY term),
bk AS (SELECT term, {sql_crc32('term')} % {BUCKETS} AS bucket FROM (SELECT term FROM dw UNION SELECT term FROM bw), st),
sc AS (SELECT bucket, sum(n) AS s FROM dw JOIN bk ON dw.term = bk.term GROUP BY bucket),
tc AS (SELECT bucket, sum(n) AS t FROM bw JOIN bk ON bw.term = bk.term GROUP BY bucket),
tot AS (SELECT (SELECT coalesce(sum(s), 0) FROM sc) AS s_all, (SELECT coalesce(sum(t), 0) FROM tc) AS t_all),
gain AS (SELECT k.bucket, CAST(floor(1000.0::DOUBLE * ln(((coalesce(t, 0)::DOUBLE + 1) * (s_all::DOUBLE + {BUCKETS})) /
           ((coalesce(s, 0)::DOUBLE + 1) * (t_all::DOUBLE + {BUCKETS})))) AS BIGINT) AS gain
         FROM (SELECT DISTINCT bucket FROM bk) k LEFT JOIN sc ON k.bucket = sc.bucket LEFT JOIN tc ON k.bucket = tc.bucket, tot),
w AS (SELECT rid, sum(n * gain) AS weight FROM dw JOIN bk ON dw.term = bk.term JOIN gain ON bk.bucket = gain.bucket GROUP BY rid),
x AS (SELECT d.rid, doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
        ('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT::DOUBLE AS h
      FROM d LEFT JOIN w ON d.rid = w.rid),
y AS (SELECT rid, doc_id, n_features, weight, weight + CAST(floor(-1000.0::DOUBLE * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM x),
r AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id ASC NULLS LAST, n_features, weight) AS r,
        count(*) OVER () AS n FROM y WHERE n_features >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN r <= {PERCENT} * n // 100 THEN r END AS rank FROM y LEFT JOIN r ON y.rid = r.rid
"""
