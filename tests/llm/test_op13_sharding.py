import hashlib
import random
import zlib
from collections import Counter, defaultdict

from llm_fixtures import docs, prose, with_clashing

from wareloom.llm import op13_sharding as op


def brute(rows, shards=40):
    per = defaultdict(list)
    for i, text, _, source in rows:
        data = (text or "").encode()
        size, crc = len(data) + 16, zlib.crc32(data)
        h = hashlib.md5(f"{op.SEED}:{'' if i is None else i}:{size}:{crc}".encode()).hexdigest()
        per[source].append((h, i is None, i or 0, i, size, crc))
    line = []
    for s, found in per.items():
        for r, x in enumerate(sorted(found, key=lambda x: x[:3])):
            line.append(((r * 2 + 1) / (len(found) * 2), s is None, s or "", x[:3], x[3], x[4], x[5], s))
    line.sort(key=lambda x: x[:4])
    out, slots = [], Counter()
    for at, x in enumerate(line):
        k = at * shards // len(line)
        out.append((x[4], x[5], x[6], "rows", k, slots[k], None, x[7]))
        slots[k] += 1
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "source").collect()), key=str)


def fixture(n=300):
    rng = random.Random(13)
    rows = [(i if i % 3 else None, prose(rng, rng.randrange(12)), "en", "hot" if i % 3 == 0 else rng.choice(["a", "b", None, "é"])) for i in range(n)]
    return rows + [(7, None, None, None), (8, "", None, "a"), (9, "é" * 30_000, None, "b")] + [(10, "copy", "en", "hot")] * 90


def test_against_brute_force(spark):
    rows = fixture()
    for shards in (40, 7, 1, 1000):
        assert got(op.assign(op.narrow(docs(spark, rows)), shards)) == brute(rows, shards)


def test_every_shard_matches_the_mixture(spark):
    rows = fixture(2000)
    found = op.assign(op.narrow(docs(spark, rows, 5)), 16).collect()
    of, mix = Counter(r["source"] for r in found), defaultdict(Counter)
    for r in found:
        mix[r["shard"]][r["source"]] += 1
    counts = [sum(c.values()) for c in mix.values()]
    assert len(mix) == 16 and max(counts) - min(counts) <= 1
    assert all(abs(c[s] - n / 16) <= 2 for c in mix.values() for s, n in of.items())
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_documents_keep_their_columns_and_files_hold_the_shards(spark, tmp_dir):
    rows = fixture()
    d = with_clashing(docs(spark, rows), "rid", "fraction", "place", "shuffled", "at", "of")
    out = op.shard_documents(d, 5)
    assert out.columns == [*d.columns, "shard", "slot"]
    want = Counter((r[0], (r[1] or ""), r[4]) for r in [(i, t, None, None, None) for i, t, _, _ in rows])
    assert Counter((r["doc_id"], r["text"] or "", None) for r in out.collect()) == want
    op.write_shards(d, f"{tmp_dir}/shards", 5)
    back = spark.read.parquet(f"{tmp_dir}/shards")
    assert sorted((r["shard"], r["slot"], str(r["doc_id"])) for r in back.collect()) == sorted((r["shard"], r["slot"], str(r["doc_id"])) for r in out.collect())


def test_empty_table_and_few_rows(spark):
    assert got(op.assign(op.narrow(docs(spark, fixture()).limit(0)))) == []
    rows = fixture(3)[:2]
    assert got(op.assign(op.narrow(docs(spark, rows)))) == brute(rows)


def test_row_ids_are_the_same_however_files_are_split(spark, tmp_dir):
    from wareloom.llm.common import with_row_ids
    docs(spark, fixture(), 4).write.parquet(f"{tmp_dir}/d")
    once = with_row_ids(spark.read.parquet(f"{tmp_dir}/d")).select("rid", "doc_id", "text").collect()
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        again = with_row_ids(spark.read.parquet(f"{tmp_dir}/d")).where("doc_id IS NOT NULL OR doc_id IS NULL").select("rid", "doc_id", "text").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len({r["rid"] for r in once}) == len(once) and sorted(map(str, once)) == sorted(map(str, again))
