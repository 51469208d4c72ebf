"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source is laid out as one line of words: its documents in a seeded random order, repeated
until the source's target is met (so a document is used in full once per pass over the source, and
the last document of the last pass is cut where the target ends). The line is cut into blocks of
``block_words`` words; the exact number of blocks each source owes is the root of a splitting tree
whose leaves are the output shards. A node hands its left half ``n * left / all`` blocks, drawn from
its own block counts without replacement (multivariate hypergeometric), and the rest to the right:
leaf quotas therefore add up to the root exactly and every shard holds a random, fair composition.
A leaf walks from the root with one seeded draw per level, so shards are worked out independently of
each other in parallel, and takes the blocks ``[first, first + quota)`` of each source's permuted
block order (a seeded affine map, one to one): disjoint by construction. The copies of a shard are then shuffled: ``place`` is a
copy's place in its shard, by a seeded hash, numbered over a range partitioning of narrow rows.

Weights: sources by code point (NULL last) weigh 1, 2, 3, 1, 2, 3, ... and share all words of the
corpus; a source never exceeds ``max_epochs`` times its size, the excess goes to the others by
weight until no source is above.

What reaches the driver is one row per source (name, size). Document positions are prefix sums in
two levels (buckets of a source by a hash of doc_id and text, then documents of a bucket), so a source with a third of all
rows, or rows without a doc_id, are spread over thousands of groups.

Defined cases: a NULL text has size 0; documents of size 0 are returned with taken 0; rows sharing a
doc_id are separate documents, equal rows are interchangeable; a NULL source is the last source; a very long text spans blocks like any
other; an empty table gives an empty mix; further columns are not read."""

from __future__ import annotations

from functools import partial
from math import gcd

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wareloom.operators.windows import number_within_groups

from .common import cut_lineage, map_columns, scratch_tables, small_table, table

SIZE = r"[^\x20\x09-\x0D]+"
BUCKET_BITS = 12          # 4,096 hash buckets per source
MAX_EPOCHS = 3
SEED = 20240131


def weights_to_targets(sizes: list[int], weights: list[int], max_epochs: int = MAX_EPOCHS) -> list[float]:
    """Share sum(sizes) by weight; cap each at max_epochs * size and share the excess again."""
    total, target, free = float(sum(sizes)), [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    while free:
        rest = total - sum(max_epochs * sizes[i] for i in range(len(sizes)) if i not in set(free))
        per = rest / sum(weights[i] for i in free)
        over = {i for i in free if per * weights[i] > max_epochs * sizes[i]}
        if not over:
            for i in free:
                target[i] = per * weights[i]
            break
        free = [i for i in free if i not in over]
    return [t if i in set(free) else float(max_epochs * sizes[i]) for i, t in enumerate(target)]


def block_order(blocks: int, seed) -> tuple[int, int]:
    """(step, shift) of a seeded order of ``blocks`` blocks: block b stands at (step * b + shift) % blocks. The step has no factor in common
    with the number of blocks, so every place is taken once, and is no plain rotation where another step exists."""
    rng = np.random.default_rng(seed)
    top = min(max(blocks, 1), 1 << 31)
    steps = [int(x) for x in rng.integers(1, top + 1, 200) if gcd(int(x), max(blocks, 1)) == 1]
    good = [x for x in steps if x % max(blocks, 1) not in (1, blocks - 1)] or steps or [1]
    return good[0], int(rng.integers(0, max(blocks, 1)))


def split_leaf(shard: int, shards: int, quotas: np.ndarray, seed: int):
    """(first, quota) of every source for one leaf, by walking down from the root."""
    lo, hi, q, first = 0, shards, np.array(quotas, np.int64), np.zeros(len(quotas), np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = int(q.sum()) * (mid - lo) // (hi - lo)
        draw = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(q, left, method="marginals")
        if shard < mid:
            q, hi = draw, mid
        else:
            q, first, lo = q - draw, first + draw, mid
    return first, q


def _leaf_rows(shards, quotas, seed, cols):
    out = {"shard": [], "src": [], "first": [], "quota": []}
    for s in cols["id"].to_pylist():
        first, q = split_leaf(s, shards, quotas, seed)
        for i in np.flatnonzero(q):
            for k, v in (("shard", s), ("src", int(i)), ("first", int(first[i])), ("quota", int(q[i]))):
                out[k].append(v)
    return out


def draw_mix(docs: DataFrame, block_words: int = 32_768, shard_words: int = 4_000_000, max_epochs: int = MAX_EPOCHS,
             seed: int = SEED) -> DataFrame:
    """One row per document and pass that draws from it: doc_id, source, size, source_size, target, row key
    (src, bucket, nth), epoch, words, shard, place (from 1, in the shard). Documents that are not drawn have one row with words 0."""
    spark = docs.sparkSession
    h = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    base = cut_lineage(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(SIZE)), F.lit(0)).cast("long").alias("size"), h.alias("h"))
        .withColumn("bucket", F.shiftrightunsigned("h", 64 - BUCKET_BITS).cast("int")), "mix-base")
    per = base.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sources = sorted(((r["source"], r["words"]) for r in per.groupBy("source").agg(F.sum("words").alias("words")).collect()),
                     key=lambda x: (x[0] is None, x[0] or ""))           # one row per source
    sizes = [s for _, s in sources]
    targets = weights_to_targets(sizes, [i % 3 + 1 for i in range(len(sources))], max_epochs)
    owed = [min(round(t), max_epochs * s) for t, s in zip(targets, sizes)]
    blocks = [-(-w // block_words) for w in owed]
    shards = max(1, -(-sum(owed) // shard_words))
    plan = small_table(
        spark, [(n, i, s, t, w, b, *block_order(b, [seed, i])) for i, ((n, s), t, w, b) in enumerate(zip(sources, targets, owed, blocks))],
        "source string, src int, source_size long, target double, owed long, blocks long, step long, shift long")

    by_source = Window.partitionBy("src").orderBy("bucket")
    starts = (per.join(plan, per["source"].eqNullSafe(plan["source"])).drop(per["source"])
              .withColumn("offset", F.sum("words").over(by_source) - F.col("words")).drop("words"))
    in_bucket = Window.partitionBy("src", "bucket").orderBy("h", "doc_id", "size")
    starts = starts.withColumnRenamed("source", "_s").withColumnRenamed("bucket", "_b")
    placed = (base.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b"))).drop("_s", "_b")
              .withColumn("nth", F.row_number().over(in_bucket))
              .withColumn("start", F.col("offset") + F.sum("size").over(in_bucket.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")))

    def one_pass(e):
        words = F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), F.col("owed") - e * F.col("source_size")) - F.col("start"))
        at = e * F.col("source_size") + F.col("start")
        return F.struct(F.lit(e).alias("epoch"), F.when(F.col("size") > 0, words).otherwise(0).cast("long").alias("words"),
                        F.expr(f"({e} * source_size + start) div {block_words}").alias("block"), at.alias("at"))

    drawn = (placed.withColumn("d", F.filter(F.array(*[one_pass(e) for e in range(max_epochs)]), lambda x: x["words"] > 0))
             .select("doc_id", "source", "size", "source_size", "target", "src", "bucket", "nth", "blocks", "step", "shift", F.explode_outer("d").alias("d"))
             .select("*", "d.epoch", F.coalesce("d.words", F.lit(0)).cast("long").alias("words"), F.col("d.at").alias("at"),
                     F.expr("(d.block * step + shift) % blocks").alias("pos")).drop("d", "blocks", "step", "shift"))
    leaves = map_columns(spark.range(shards, numPartitions=min(shards, 200)), partial(_leaf_rows, shards, blocks, seed),
                         "shard long, src int, first long, quota long") if any(blocks) else small_table(
                             spark, [], "shard long, src int, first long, quota long")
    taken_blocks = leaves.select("src", "shard", F.explode(F.expr("sequence(first, first + quota - 1)")).alias("pos"))
    placed = cut_lineage(drawn.join(taken_blocks, ["src", "pos"], "left").withColumn("key", F.xxhash64(F.lit(seed), "shard", "src", "at")).drop("at", "pos"), "mix-drawn")
    in_shard = number_within_groups(placed.where("shard IS NOT NULL"), ["shard"], ["key", "src", "bucket", "nth", "epoch"], col="place")
    return in_shard.unionByName(placed.where("shard IS NULL").withColumn("place", F.lit(None).cast("long"))).drop("key")


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, copies, shards (of its copies) and places (of the same
    copies, each in its shard's shuffled order). The tables in between are deleted."""
    with scratch_tables(docs.sparkSession):
        d = draw_mix(docs, **options)
        copy = F.when(F.col("shard").isNotNull(), F.struct("shard", "place"))
        out = (d.groupBy("src", "bucket", "nth", "doc_id", "source", "size", "source_size", "target")
               .agg(F.sum(F.when(F.col("shard").isNotNull(), F.col("words")).otherwise(0)).cast("long").alias("taken"),
                    F.count("shard").alias("copies"), F.sort_array(F.collect_list(copy)).alias("c"))
               .select("doc_id", "source", "size", "source_size", "target", "taken", "copies", F.col("c.shard").alias("shards"), F.col("c.place").alias("places")))
        return cut_lineage(out, "mix", keep=True)


def op3_mix_sources(spark, sf_dir) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies", "shards", "places")
