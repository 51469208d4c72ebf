import hashlib
import math
import random
import zlib
from collections import Counter

from llm_fixtures import docs, prose, with_clashing, words

from wareloom.llm import op12_importance as op


def brute(rows, target, buckets=10_000, longest=1, percent=10, min_words=20):
    def feats(t):
        w = words(t)
        return [" ".join(w[i:i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(map(bucket, feats(x)))
    for x in target:
        t.update(map(bucket, feats(x)))
    S, T = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))

    out = []
    for i, x in rows:
        f = feats(x)
        weight = sum(gain(bucket(w)) for w in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words(x)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    for n, r in enumerate(able[:percent * len(able) // 100]):
        r[5] = n + 1
    return sorted(map(tuple, out), key=str)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=str)


def bench(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


def fixture():
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randrange(0, 60), 80 + i)) for i in range(200)]
    rows += [(None, prose(rng, 40)), (None, None), (5, ""), (6, "!!"), (7, "Größe ÜBER 中文 " * 30), (9, prose(rng, 20)), (9, rows[9][1]), (9, rows[9][1]),
             (301, "w" * 70_000), (302, prose(rng, 30_000)), (303, "tail " * 20), (303, "tail " * 20)]
    return rows, [prose(rng, 40, 90), "Größe über alles", None, ""]


def test_crcs_of_all_lengths():
    rng = random.Random(1)
    features = [rng.randbytes(rng.randrange(0, 40)) for _ in range(3000)] + [b"", b"a", b"a" * 5000, rng.randbytes(5000), "straße".encode()]
    assert op.crcs(features).tolist() == [zlib.crc32(f) for f in features]
    assert op.crcs([]).tolist() == []


def test_against_brute_force(spark):
    rows, target = fixture()
    assert got(op.resample(docs(spark, rows), bench(spark, target))) == brute(rows, target)


def test_longer_runs_buckets_and_share(spark):
    rows, target = fixture()
    found = op.resample(docs(spark, rows), bench(spark, target), percent=35, min_words=5, buckets=97, longest=3)
    assert got(found) == brute(rows, target, 97, 3, 35, 5)


def test_empty_tables_and_clashing_columns(spark):
    rows, target = fixture()
    d, b = docs(spark, rows), bench(spark, target)
    assert got(op.resample(d.limit(0), b)) == []
    assert got(op.resample(d, b.limit(0))) == brute(rows, [])
    assert got(op.resample(with_clashing(d, "bucket", "weight", "rank", "score", "n_words"), with_clashing(b, "doc_id", "bucket"))) == brute(rows, target)


def test_blocks_are_cut_by_bytes(monkeypatch):
    monkeypatch.setattr(op, "BYTES_AT_ONCE", 10)
    assert list(op._blocks([b"abc", None, b"defghijkl", b"m", b"x" * 100])) == [[b"abc", None, b"defghijkl"], [b"m", b"x" * 100]]
