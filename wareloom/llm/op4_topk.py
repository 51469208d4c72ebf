"""Exact top-k inner products: norm-sorted blocks, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Vectors become integers ``floor(64 * x)``. They are range-partitioned by descending length and packed
into blocks of ``block_rows`` in that order, so a block knows the longest vector it and all later ones
hold. A rotation (right singular vectors of a bounded sample) gathers most of a vector's length in
its first coordinates; rotation keeps inner products, so for any query and row

    score <= first ``head`` coordinates' inner product + |query rest| * |row rest|      (Cauchy-Schwarz)

Blocks are taken in rounds of 1, 1, 2, 4, 8, ... blocks, the longest first. Every round tightens each query's lower bound, its k-th
score so far. Before a round, query blocks none of whose queries can reach its bound with the round's longest row
(``|query| * longest``) leave for good, so their vectors are not moved to any later block; the search ends when none is left. Within a
block only queries and rows whose bound reaches are scored exactly, in integers. The rotation only
decides what is skipped, never a score: results are exact whatever the sample was.

Queries are a stated set (``vec_id % query_every = 0``) taken in blocks against the blocks of all rows, joined on the block's number.
Partial top-k lists (k rows per query and block) are merged by a partial-limit window after each round.

Defined cases: vectors that are NULL, hold a NULL or a non-finite component take no part; a shorter
vector counts as followed by zeros; rows sharing a vec_id are separate rows (each excludes itself
only); equal scores go to the smaller vec_id; fewer than k candidates give all of them; an empty table
gives an empty result; repeated rows are rows of their own; further columns are not read. Scores must fit a long."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, map_columns, table

K, EVERY, SCALE = 20, 20, 64
BLOCK_ROWS, QUERY_ROWS, HEAD, SAMPLE = 8192, 512, 16, 4096
BROADCAST = 4 << 20        # bytes of repeated query blocks that the driver may get
BLOCK = "block long, longest double, n int, dim int, ids binary, rids binary, vectors binary"


def usable(vectors: DataFrame) -> DataFrame:
    """rid, vec_id, v (array of long), norm, dim - for rows that take part."""
    ok = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    x = F.transform("embedding", lambda x: F.floor(F.lit(SCALE) * x.cast("double")))
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
            .where(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False))).select("vec_id", x.alias("v"))
            .withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, y: s + y.cast("double") * y.cast("double"))))
            .withColumn("dim", F.size("v")))


def _pack(rows, batches):
    """Blocks of ``rows`` vectors in the order they come."""
    import pyarrow as pa
    held, part = [], None

    def block(x):
        dim = max(len(v) for _, _, v, _ in x)
        m = np.zeros((len(x), dim), np.int64)
        for i, (_, _, v, _) in enumerate(x):
            m[i, :len(v)] = v
        order = np.argsort([a for _, a, _, _ in x], kind="stable")            # by vec_id: ties go to the first
        ids, rids = np.array([a for _, a, _, _ in x], np.int64)[order], np.array([r for r, _, _, _ in x], np.int64)[order]
        return pa.RecordBatch.from_pylist([{
            "longest": max(n for _, _, _, n in x), "n": len(x), "dim": dim, "ids": ids.tobytes(), "rids": rids.tobytes(),
            "vectors": m[order].tobytes()}],
            schema=pa.schema([("longest", pa.float64()), ("n", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("rids", pa.binary()), ("vectors", pa.binary())]))

    for b in batches:
        held += list(zip(*(b.column(c).to_pylist() for c in ("rid", "vec_id", "v", "norm"))))
        while len(held) >= rows:
            yield block(held[:rows])
            held = held[rows:]
    if held:
        yield block(held)


def blocks(rows: DataFrame, size: int) -> DataFrame:
    return (rows.select("rid", "vec_id", "v", "norm")
            .mapInArrow(partial(_pack, size), "longest double, n int, dim int, ids binary, rids binary, vectors binary"))


def sampled(rows: DataFrame, n: int, sample: int = SAMPLE) -> DataFrame:
    """About ``sample`` of the ``n`` rows by the hash of their ids, fewer than twice as many but for chance: each task sends its own share of
    them. (A sorted limit sends ``sample`` rows of every task to the driver.)"""
    return rows.where(F.pmod(F.xxhash64("vec_id", "rid"), F.lit(max(1, n // sample))) == 0).select("v")


def rotation(rows: DataFrame, n: int, sample: int = SAMPLE) -> np.ndarray:
    """Right singular vectors of a sample of the rows, those of the largest singular values first; any orthogonal matrix would give the same results."""
    got = sampled(rows, n, sample).toArrow().column("v").combine_chunks()
    size = np.diff(got.offsets.to_numpy()).astype(int)
    m = np.zeros((max(1, len(size)), int(size.max(initial=1))))
    m[np.arange(m.shape[1]) < np.pad(size, (0, len(m) - len(size)))[:, None]] = got.flatten().to_numpy()
    return np.linalg.eigh(m.T @ m)[1][:, ::-1]              # without the left vectors, a square of the sample's size


def _matrix(buf, n, dim):
    return np.frombuffer(buf, np.int64).reshape(n, dim)


def _pad(a, dim):
    return a if a.shape[1] == dim else np.pad(a, ((0, 0), (0, dim - a.shape[1])))


def _rotate(m, rot, head):
    """First coordinates and rest length of rows; dimensions the sample did not have stay in the rest."""
    d = min(m.shape[1], rot.shape[0])
    x = m[:, :d].astype(float) @ rot[:d]
    sq = (m.astype(float) ** 2).sum(axis=1)
    h = x[:, :head] if d == rot.shape[0] else np.zeros((len(m), 0))
    return h, np.sqrt(np.maximum(sq - (h ** 2).sum(axis=1), 0))


def _exact(q, c):
    """Integer inner products; float64 products are exact while every partial sum stays below 2**53."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    return np.rint(q.astype(float) @ c.T.astype(float)).astype(np.int64) if top < 2 ** 52 else q @ c.T


def search_block(q, q_rid, bound, c, c_rid, k, rot, head):
    """(query row, candidate row, score) of the k best candidates per query that reach its bound. Candidates are in vec_id order."""
    dim = max(q.shape[1], c.shape[1])
    q, c = _pad(q, dim), _pad(c, dim)
    (qh, qr), (ch, cr) = _rotate(q, rot, head), _rotate(c, rot, head)
    if qh.shape[1] != ch.shape[1]:
        qh, ch = qh[:, :0], ch[:, :0]
        qr, cr = np.sqrt((q.astype(float) ** 2).sum(1)), np.sqrt((c.astype(float) ** 2).sum(1))
    upper = qh @ ch.T + np.outer(qr, cr)
    alive = upper * (1 + 1e-9) + 1e-6 >= bound[:, None]
    out = []
    rows = np.flatnonzero(alive.any(axis=1))
    cols = np.flatnonzero(alive.any(axis=0))
    if not len(rows) or not len(cols):
        return out
    s = _exact(q[rows], c[cols])
    ok = alive[np.ix_(rows, cols)] & (s >= bound[rows][:, None]) & (q_rid[rows][:, None] != c_rid[cols][None, :])
    for i, r in enumerate(rows):
        at = np.flatnonzero(ok[i])
        if len(at) > k:                                  # the k best, ties to the smaller vec_id
            v = s[i, at]
            kth = np.partition(v, len(v) - k)[len(v) - k]
            over, tie = at[v > kth], at[v == kth]
            at = np.concatenate([over, tie[:k - len(over)]])
        out += [(int(r), int(cols[j]), int(s[i, j])) for j in at]
    return out


def _search(k, rot, head, cols):
    out = {x: [] for x in ("query_rid", "query_id", "vec_id", "score")}
    names = list(cols)
    for row in zip(*(cols[x].to_pylist() for x in names)):
        r = dict(zip(names, row))
        q, c = _matrix(r["q_vectors"], r["q_n"], r["q_dim"]), _matrix(r["vectors"], r["n"], r["dim"])
        q_rid, q_id = np.frombuffer(r["q_rids"], np.int64), np.frombuffer(r["q_ids"], np.int64)
        c_rid, c_id = np.frombuffer(r["rids"], np.int64), np.frombuffer(r["ids"], np.int64)
        bound = np.frombuffer(r["bound"], np.float64) if r["bound"] else np.full(len(q), -np.inf)
        norm = np.sqrt((q.astype(float) ** 2).sum(axis=1))
        near = np.flatnonzero(norm * r["longest"] * (1 + 1e-9) + 1e-6 >= bound)
        for lo in range(0, len(near), QUERY_ROWS):
            at = near[lo:lo + QUERY_ROWS]
            for i, j, s in search_block(q[at], q_rid[at], bound[at], c, c_rid, k, rot, head):
                out["query_rid"].append(int(q_rid[at[i]])), out["query_id"].append(int(q_id[at[i]]))
                out["vec_id"].append(int(c_id[j])), out["score"].append(s)
    return out


FOUND = "query_rid long, query_id long, vec_id long, score long"


def _bounds(cols):
    """Per query block the k-th best score so far of its rows (-inf with fewer), and the least length of a row that can still reach
    one of them."""
    bounds, least = [], []
    for rids, best, v, n, dim in zip(*(cols[c].to_pylist() for c in ("q_rids", "best", "q_vectors", "q_n", "q_dim"))):
        b = {x["query_rid"]: x["kth"] for x in best or []}
        bound = np.array([b.get(int(r), -np.inf) for r in np.frombuffer(rids, np.int64)], np.float64)
        norm = np.sqrt((_matrix(v, n, dim).astype(float) ** 2).sum(axis=1))
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(norm > 0, (bound - 1e-6) / (norm * (1 + 1e-9)), np.where(bound <= 1e-6, -np.inf, np.inf))
        bounds.append(bound.tobytes())
        least.append(float(need.min(initial=np.inf)))
    return {c: cols[c] for c in QUERY_BLOCK} | {"bound": bounds, "least": least}


QUERY_BLOCK = ("qb", "q_n", "q_dim", "q_ids", "q_rids", "q_vectors")


def top_k(vectors: DataFrame, k: int = K, query_every: int = EVERY, block_rows: int = BLOCK_ROWS, head: int = HEAD) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every query row."""
    rows = cut_lineage(usable(vectors).withColumn("rid", F.monotonically_increasing_id()), "topk-rows")
    n = rows.count()
    rot = rotation(rows, n)
    parts = max(1, -(-n // (4 * block_rows)))
    packed = blocks(rows.repartitionByRange(parts, F.desc("norm"), "rid").sortWithinPartitions(F.desc("norm"), "rid"), block_rows)
    packed = cut_lineage(packed.withColumn("at", F.monotonically_increasing_id()), "topk-blocks")
    numbers = packed.select("at").withColumn("block", F.row_number().over(Window.orderBy("at")) - 1)  # one number per block of vectors
    base = packed.join(numbers, "at").drop("at")
    n_blocks = packed.count()
    q = blocks(rows.where(F.col("vec_id") % query_every == 0).repartitionByRange(max(1, -(-n // (query_every * 8 * QUERY_ROWS))), F.desc("norm"), "rid")
               .sortWithinPartitions(F.desc("norm"), "rid"), QUERY_ROWS)
    q = cut_lineage(q.select(F.monotonically_increasing_id().alias("qb"), F.col("n").alias("q_n"), F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"),
                             F.col("rids").alias("q_rids"), F.col("vectors").alias("q_vectors")), "topk-queries")
    find = lambda x: map_columns(x, partial(_search, k, rot, head), FOUND)
    by_query = Window.partitionBy("query_rid").orderBy(F.desc("score"), "vec_id")

    rid_of = cut_lineage(map_columns(q.select("qb", "q_rids"), _query_rids, "qb long, query_rid long"), "topk-query-rows")
    best, lo, size = None, 0, 1
    while lo < n_blocks:
        hi = min(n_blocks, lo + size)
        if best is None:
            kth = rid_of.select("qb", "query_rid", F.lit(None).cast("double").alias("kth")).limit(0)
        else:
            kth = (best.groupBy("query_rid").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("kth")).where(F.col("c") >= k)
                   .select("query_rid", F.col("kth").cast("double").alias("kth")).join(rid_of, "query_rid"))
        per = kth.groupBy("qb").agg(F.collect_list(F.struct("query_rid", "kth")).alias("best"))          # one entry per query of a block
        bounded = map_columns(q.join(per, "qb", "left"), _bounds, "qb long, q_n int, q_dim int, q_ids binary, q_rids binary, q_vectors binary, bound binary, least double")
        longest = base.where(F.col("block") == lo).select("longest").first()["longest"]
        live = cut_lineage(bounded.where(F.col("least") <= longest).drop("least"), "topk-live")
        held = live.agg(F.sum(F.col("q_n").cast("long") * F.col("q_dim") * 8)).first()[0]
        if held is None:
            break
        q = live.select(*QUERY_BLOCK)                     # the others cannot be reached by shorter blocks either
        pairs = live.withColumn("block", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1))))
        if held * (hi - lo) > BROADCAST:                  # the stored size of ``live`` says nothing of its rows repeated for each block
            pairs = pairs.hint("merge")
        found = find(pairs.join(base.where(F.col("block").between(lo, hi - 1)), "block"))
        every = found if best is None else best.unionByName(found)
        best = cut_lineage(every.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).drop("rank"), "topk-best")
        lo, size = hi, hi
    if best is None:
        best = map_columns(rid_of.limit(0), lambda cols: {c: [] for c in ("query_rid", "query_id", "vec_id", "score")}, FOUND)
    return (best.withColumn("rank", F.row_number().over(by_query))
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def _query_rids(cols):
    qb, rid = [], []
    for b, r in zip(cols["qb"].to_pylist(), cols["q_rids"].to_pylist()):
        ids = np.frombuffer(r, np.int64).tolist()
        qb += [b] * len(ids)
        rid += ids
    return {"qb": qb, "query_rid": rid}


def op4_topk(spark, sf_dir) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id AS vec_id,
             CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) AS BIGINT) AS score
      FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, coalesce(score, 0) AS score FROM r WHERE rank <= 20
"""
