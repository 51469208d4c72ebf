"""Near-duplicate documents by BagMinHash signatures, banding and exact multiset overlap.

A document is the multiset of its runs of five words (a shorter text is one run); two documents are
linked when the weighted Jaccard similarity of their multisets is 0.8 or more, and classes are the
connected components of all links.

Signatures (weighted MinHash over Poisson processes): the weight axis is cut into dyadic intervals
``[0,1) [1,2) [2,4) [4,8) ...``. Every (run, interval) has its own Poisson process, seeded by the run,
whose rate is the interval's length; its points carry a signature component and a position
inside the interval, and a run of weight ``w`` sees the points below ``w``. Component ``k`` of the
signature is the smallest point time with mark ``k``; two documents agree in it with probability equal
to their weighted Jaccard similarity. Points come in ascending order, so a process stops as soon
as its next point is later than every component's minimum.

Classes: exact copies (equal words) are collapsed first. ``BANDS`` bands of ``ROWS`` components give buckets;
a pair at 0.8 meets in none of them with probability 3e-6. Members of a bucket are compared with the bucket's hub (the
member that shares most buckets: of a group of edited copies the least edited one), not with each other. Two members that are not
both linked to the hub can only be linked if they share an element that the hub does not have, or if one is markedly shorter
than the hub (``_left_over``); only such members go on, in groups by the rarest elements that could make up a link. In a group the
members beside the largest component meet all members of other components that their sizes and the elements still to come leave
open (``_group_pairs``), and the group is done if these are at most ``HUBS`` for each member; in any other group the members meet the ``HUBS`` first
ones (smallest components first), twice as many at each level, and so on until no group is left. A group of n edited copies costs n comparisons, texts that merely share a passage drop out before the second. Every
comparison is the exact multiset overlap, classes are connected components by contraction, and tables are deleted level by level,
so nothing that grows with the corpus is broadcast or collected.

Defined cases: NULL texts and texts without a word have no runs and form classes of their own; rows sharing a doc_id are separate
documents; equal rows are copies of each other; the class id is the smallest doc_id of the class, NULL when it has none; the row that
stays is the one with the smallest doc_id, then the first one; a very long text is compared whole; an empty table gives no rows;
further columns pass through the pipeline form whatever their names."""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, map_columns, scratch_tables, shielded, table, with_row_ids
from .op6_decontaminate import words_of

SHINGLE, BANDS, ROWS = 5, 24, 4
M = BANDS * ROWS
GAMMA = np.uint64(0x9E3779B97F4A7C15)
TOKENS_AT_ONCE = 200_000
BITMAP_BITS = 1 << 23
HUBS = 64
PART = 512
SIZE_STEP = 1 << 36         # above every weight


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective, vectorised)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """word -> 64-bit hash, remembered per task."""

    def __missing__(self, w):
        if len(self) > 100_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


def runs(words: list[str], known: WordHash) -> np.ndarray:
    """Hashes of all runs of five words (one run for a shorter text)."""
    if not words:
        return np.zeros(0, np.uint64)
    t = np.array(list(map(known.__getitem__, words)), np.uint64)
    k = min(SHINGLE, len(t))
    n = len(t) - k + 1
    h = np.full(n, len(t) if len(t) < SHINGLE else SHINGLE, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = mix(h * GAMMA + t[i:i + n])
    return h


def multiset(h: np.ndarray) -> np.ndarray:
    """The multiset as a sorted set: the j-th occurrence of a run gets an element of its own."""
    s = np.sort(h)
    if len(s) > 1 and (s[1:] == s[:-1]).any():
        new = np.r_[True, s[1:] != s[:-1]]
        nth = np.arange(len(s)) - np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
        with np.errstate(over="ignore"):
            s = np.sort(np.where(nth > 0, mix(s + nth.astype(np.uint64) * GAMMA), s))
    return s


def signatures(doc: np.ndarray, run: np.ndarray, weight: np.ndarray, n_docs: int) -> np.ndarray:
    """BagMinHash signatures (n_docs, M) of documents given as (document, run, weight) elements."""
    parts = [(doc, run, np.zeros(len(doc)), np.ones(len(doc)), np.ones(len(doc)))]
    big = weight > 1
    level = 1
    d, r, w = doc[big], run[big], weight[big].astype(float)
    while len(d):                                  # dyadic interval [2^(level-1), 2^level)
        lo = 2.0 ** (level - 1)
        with np.errstate(over="ignore"):
            parts.append((d, mix(r + np.uint64(level) * GAMMA), np.full(len(d), lo), np.full(len(d), lo), w))
        more = w > 2 * lo
        d, r, w = d[more], r[more], w[more]
        level += 1
    doc, seed, lo, rate, limit = (np.concatenate(x) for x in zip(*parts))
    whole = bool((limit >= lo + rate).all())
    h = np.full(n_docs * M, np.inf)
    x, state = np.zeros(len(doc)), seed.copy()
    doc = doc.astype(np.int64)
    while len(doc):
        with np.errstate(over="ignore"):
            state += GAMMA
        a = mix(state)
        b = mix(a ^ GAMMA)
        x = x - np.log(((a >> np.uint64(11)).astype(float) + 1) * 2.0 ** -53) / rate
        at = doc * M + ((b >> np.uint64(32)) % np.uint64(M)).astype(np.int64)
        if whole:
            np.minimum.at(h, at, x)
        else:
            seen = lo + rate * ((b & np.uint64(0xFFFFFFFF)).astype(float) * 2.0 ** -32) < limit
            np.minimum.at(h, at[seen], x[seen])
        alive = x < h.reshape(n_docs, M).max(axis=1)[doc]
        doc, x, state, rate = doc[alive], x[alive], state[alive], rate[alive]
        if not whole:
            lo, limit = lo[alive], limit[alive]
    return h.reshape(n_docs, M)


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """(n_docs, BANDS) bucket keys; the band's number is part of the key."""
    v = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), BANDS)).copy()
    with np.errstate(over="ignore"):
        for i in range(ROWS):
            h = mix(h * GAMMA + v[:, :, i])
    return h.view(np.int64)


def _sign(cols):
    n_words, digest, bands = [], [], []
    known = WordHash()
    held, size = [], 0

    def flush():
        nonlocal held, size
        at = [i for i, h in enumerate(held) if len(h)]
        out = [None] * len(held)
        if at:
            el = [np.unique(held[i], return_counts=True) for i in at]
            doc = np.repeat(np.arange(len(at)), [len(u) for u, _ in el])
            b = band_hashes(signatures(doc, np.concatenate([u for u, _ in el]), np.concatenate([c for _, c in el]), len(at)))
            for i, row in zip(at, b):
                out[i] = row
        bands.extend(out)
        held, size = [], 0

    for t in cols["text"].to_pylist():
        w = words_of(t)
        n_words.append(len(w))
        digest.append(xxhash.xxh3_128_digest(" ".join(w)) if w else None)
        held.append(runs(w, known))
        size += len(w)
        if size >= TOKENS_AT_ONCE:
            flush()
    flush()
    return {"n_words": n_words, "digest": digest, "bands": bands}


def signed(docs: DataFrame) -> DataFrame:
    """rid, doc_id, n_words, digest (equal for equal words) and bands of documents that have a row id; no texts."""
    d = docs.select("rid", "doc_id", "text")
    return cut_lineage(map_columns(d, lambda cols: {"rid": cols["rid"], "doc_id": cols["doc_id"]} | _sign(cols),
                                   T.StructType([d.schema["rid"], d.schema["doc_id"]]
                                                + T.StructType.fromDDL("n_words long, digest binary, bands array<long>").fields)), "near-signed")


# ------------------------------------------------------------------ links

def _in_bitmap(bits, cols):
    keys = cols["rid"].to_numpy(zero_copy_only=False).astype(np.uint64)
    p = mix(keys + GAMMA) % np.uint64(BITMAP_BITS)
    hit = (bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return hit


def _bit_words(cols):
    p = mix(cols["rid"].to_numpy(zero_copy_only=False).astype(np.uint64) + GAMMA) % np.uint64(BITMAP_BITS)
    return {"word": (p >> np.uint64(5)).astype(np.int32), "bit": (np.uint64(1) << (p & np.uint64(31))).astype(np.int64)}


def bitmap(rids: DataFrame) -> np.ndarray:
    """Bitmap of fixed size (1 MB) that holds at least the given rids."""
    words = (map_columns(rids.select("rid"), _bit_words, "word int, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits"))).collect()
    bits = np.zeros(BITMAP_BITS // 32, np.uint32)
    for r in words:
        bits[r["word"]] = r["bits"]
    return bits.view(np.uint8)


def _runs_of(bits, batches):
    schema = pa.schema([("rid", pa.int64()), ("elements", pa.binary())])
    known = WordHash()
    for b in batches:
        hit = np.flatnonzero(_in_bitmap(bits, {"rid": b.column("rid")}))
        for i in range(0, len(hit), 500):
            at = pa.array(hit[i:i + 500])
            texts = b.column("text").take(at).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("rid").take(at), pa.array([multiset(runs(words_of(t), known)).tobytes() for t in texts], pa.binary())],
                                             schema=schema)


def _inside(a, b):
    """The two element lists, and which elements of the first are in the second."""
    x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
    return x, y, y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


def _overlap(cols):
    """Overlap of the two multisets, and whether it makes a link."""
    out = {k: [] for k in ("common", "na", "nb", "linked")}
    for a, b in zip(cols["ea"], cols["eb"]):
        x, y, inside = _inside(a, b)
        o = int(inside.sum())
        for k, v in (("common", o), ("na", len(x)), ("nb", len(y)), ("linked", 9 * o >= 4 * (len(x) + len(y)))):
            out[k].append(v)                              # o / (na + nb - o) >= 0.8, in integers
    return {k: cols[k] for k in ("a", "b", "last")} | out


COMPARED = "a long, b long, last boolean, common long, na long, nb long, linked boolean"


def _with_elements(pairs: DataFrame, elements: DataFrame) -> DataFrame:
    ea, eb = elements.select(F.col("rid").alias("a"), F.col("elements").alias("ea")), elements.select(F.col("rid").alias("b"), F.col("elements").alias("eb"))
    return pairs.join(ea, "a").join(eb, "b")


def _elements_of(elements: DataFrame, *pairs: DataFrame) -> DataFrame:
    """The elements of the members that are in a pair (a, b), stored: the joins that follow move these alone, not all elements."""
    ends = reduce(DataFrame.unionByName, [p.select(F.explode(F.array("a", "b")).alias("rid")) for p in pairs]).distinct()
    return cut_lineage(elements.join(ends, "rid", "left_semi"), "near-used")


def compare(pairs: DataFrame, elements: DataFrame) -> DataFrame:
    """Pairs (a, b) with the exact overlap of their multisets; ``linked``: weighted Jaccard similarity of at least 0.8."""
    if "last" not in pairs.columns:
        pairs = pairs.withColumn("last", F.lit(False))
    both = _with_elements(pairs.select("a", "b", "last"), elements).select("a", "b", "last", "ea", "eb")
    return cut_lineage(map_columns(both, _overlap, COMPARED), "near-compared")


def _fingerprint(edges: DataFrame) -> tuple:
    """Number of edges and the sum of their hashes: equal for equal sets, one small job."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node of the connected component. Large-star / small-star rounds; every round is a
    table in the shared folder, so a lost executor costs one round at most."""
    e = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    state = _fingerprint(e)
    for _ in range(max_rounds if state[0] else 0):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))      # neighbours above meet the minimum
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        e = cut_lineage(small.select("e.*").where("a <> b").distinct(), "links")
        now = _fingerprint(e)
        if now == state:
            break
        state = now
    else:
        if state[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")


def _rooted(df: DataFrame, roots: DataFrame, col: str, out: str) -> DataFrame:
    """``df`` with the component of the node in ``col`` (itself when it has no link)."""
    r = roots.select(F.col("node").alias(col), F.col("root").alias(out))
    return df.join(r, col, "left").withColumn(out, F.coalesce(out, col))


def _linked(compared: DataFrame) -> DataFrame:
    return compared.where("linked").select("a", "b")


def _hub_pairs(groups: DataFrame, weight: DataFrame, hubs: int) -> DataFrame:
    """Every member of a group (key, node, root) with the group's hubs that come before it, the ``hubs`` members that share most buckets
    (of equals the smallest). ``last``: the hub is the last one of a group, so the member met all of them; only the last hub is also
    met by members of its own component, which need no link to it but their overlap. Groups with ``na``, ``inside`` and ``remain`` meet the
    other hubs only where a link is open (see ``_group_pairs``)."""
    w = groups.join(weight, "node")
    bounds = [c for c in ("na", "inside", "remain") if c in groups.columns]
    still = F.expr("least(remain, hub_remain) >= greatest((4 * (na + hub_na) + 8) div 9 - least(inside, hub_inside), 1) AND 5 * least(na, hub_na) >= 4 * greatest(na, hub_na)") if bounds else F.lit(True)
    best = Window.partitionBy("key").orderBy(F.desc("weight"), "node")
    top = (w.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= hubs)
           .withColumn("last", F.col("nth") == F.max("nth").over(Window.partitionBy("key")))
           .select("key", F.col("node").alias("b"), F.col("weight").alias("wb"), F.col("root").alias("rb"), "last", *[F.col(c).alias(f"hub_{c}") for c in bounds]))
    before = F.struct(-F.col("wb"), F.col("b")) < F.struct(-F.col("weight"), F.col("node"))
    meets = (w.alias("w").join(top.alias("t"), (F.col("w.key") == F.col("t.key")) & before & (F.col("last") | (F.col("root") != F.col("rb")) & still)))
    return meets.groupBy(F.col("node").alias("a"), "b").agg(F.bool_or("last").alias("last"))


def _outside(cols):
    """The elements by which a member of a hub can still meet another member: those inside the hub where all they share is there
    (``whole``), else those the hub lacks."""
    out = []
    for a, b, whole in zip(cols["ea"], cols["eb"], cols["whole"].to_pylist()):
        x, _, inside = _inside(a, b)
        out.append(x[inside if whole else ~inside].view(np.int64))
    return {k: cols[k] for k in ("hub", "node", "root", "whole", "least", "na", "inside")} | {"e": out}


def _left_over(compared: DataFrame, roots: DataFrame, elements: DataFrame) -> DataFrame:
    """(key, node, root, rest, big, na, inside, remain): groups that hold every pair of members of one (last) hub that can still be linked, after each was compared with it.

    Let x and y be members of different components, so at least one is in another component than the hub ("away", and so not linked to
    it). A link needs an overlap of ``most`` = 4/9 (|x| + |y|), where |y| is 4/5 |x| and the shortest possible partner at least. What x
    and y share inside the hub is at most common(x, hub) and at most common(y, hub); a member at home only meets those away. Two cases:

    * they share an element that the hub lacks. Of x's elements outside the hub they share ``least`` = ``most`` less what
      they can share inside the hub, or more (1 at least);
    * all they share is in the hub, at most common(y, hub) for the y that is away: then |y| <= 5/4 of that, and
      |x| <= 9/4 common(y, hub) - |y|. This is only possible in a hub with such a short y, among members up to that length that
      can share ``most`` elements inside the hub; of x's elements inside the hub they share ``least`` = ``most`` or more.

    In either case, with the elements in one order (rarest first), a member need only show the first ``n - least + 1`` of its
    n elements (prefix filtering). Elements that no member of another component has come first and are left out; a member
    whose other elements are fewer than ``least`` shows none. Groups of equal members are one group. ``big`` is the group's
    component of most members, ``rest`` the number of its members in other ones. ``na`` is the member's own size, ``inside`` the most it can
    share inside the hub (0 where that is what is shown) and ``remain`` how many of its elements come at the group's element or
    later: two members whose first shared element this is share no more than the smaller ``remain``."""
    g = compared.where("last").select(F.col("a").alias("node"), F.col("b").alias("hub"), "common", "na")
    g = _rooted(_rooted(g, roots, "node", "root"), roots, "hub", "home").withColumn("away", F.col("root") != F.col("home")).drop("home")
    reach = F.when(F.col("away") & (4 * F.col("na") <= 5 * F.col("common")), F.greatest(F.expr("(9 * common) div 4 - na"), F.col("na")))
    mixed = (g.groupBy("hub").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.max(reach).alias("reach"), F.min("na").alias("shortest"),
                                  F.min(F.when(F.col("away"), F.col("na"))).alias("shortest_away"), F.max(F.when(F.col("away"), F.col("common"))).alias("common_away"))
             .where("r0 <> r1").drop("r0", "r1"))
    g = cut_lineage(g.join(mixed, "hub").withColumn("partner", F.when(F.col("away"), F.col("shortest")).otherwise(F.col("shortest_away")))
                    .withColumn("most", F.expr("(4 * (na + greatest((4 * na + 4) div 5, partner)) + 8) div 9"))
                    .withColumn("inside", F.when(F.col("away"), F.col("common")).otherwise(F.least("common", "common_away")))
                    .select("hub", "node", "root", "away", "na", "reach", "most", "inside"), "near-mixed")
    cases = (g.select("hub", "node", "root", F.lit(False).alias("whole"), F.greatest(F.col("most") - F.col("inside"), F.lit(1)).cast("long").alias("least"), "na", "inside")
             .unionByName(g.where("na <= reach AND inside >= most").select("hub", "node", "root", F.lit(True).alias("whole"), F.col("most").cast("long").alias("least"),
                                                                           "na", F.lit(0).cast("long").alias("inside"))))
    cases = cases.withColumn("a", F.col("node")).withColumn("b", F.col("hub"))
    both = _with_elements(cases, _elements_of(elements, g.select(F.col("node").alias("a"), F.col("hub").alias("b"))))
    shown = cut_lineage(map_columns(both.select("hub", "node", "root", "whole", "least", "na", "inside", "ea", "eb"), _outside,
                                    "hub long, node long, root long, whole boolean, least long, na long, inside long, e array<long>").where("size(e) >= least"), "near-outside")

    # exploded rows carry the key and the member's number alone; the members stand in a table of one row each
    member = F.xxhash64("hub", "whole", "node")
    members = shown.select(member.alias("member"), "node", "root", "least", "na", "inside")
    parts = shown.select(member.alias("member"), "root", "hub", "whole", F.explode("e").alias("e")).select("member", "root", F.xxhash64("hub", "whole", "e").alias("key"))
    shared = parts.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("holders")).where("r0 <> r1").select("key", "holders")
    of_member = Window.partitionBy("member")
    rare = (parts.select("key", "member").join(shared, "key").withColumn("n", F.count(F.lit(1)).over(of_member))
            .withColumn("nth", F.row_number().over(of_member.orderBy("holders", "key"))).join(members, "member")
            .withColumn("remain", F.col("n") - F.col("nth") + 1).where("remain >= least"))
    kept = cut_lineage(rare.select("key", "node", "root", "na", "inside", "remain"), "near-groups")
    # elements of one passage or one edit make groups of the same members: one of those groups stands for all, with the widest bounds
    by_root = kept.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("h0"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("h1"))
    same = ["members", "h0", "h1", "rest", "big"]
    sets = (by_root.groupBy("key").agg(F.sum("n").alias("members"), F.max(F.struct("n", "root")).alias("top"), F.bit_xor("h0").alias("h0"), F.bit_xor("h1").alias("h1"))
            .withColumn("rest", F.col("members") - F.col("top.n")).where("rest > 0").withColumn("big", F.col("top.root")).select("key", *same))
    still = sets.join(sets.groupBy(same).agg(F.min("key").alias("first")), same).select("key", "first", "rest", "big")
    return cut_lineage(kept.join(still, "key").groupBy(F.col("first").alias("key"), "node", "root", "rest", "big")
                       .agg(F.max("na").alias("na"), F.max("inside").alias("inside"), F.max("remain").alias("remain")), "near-groups")


def _open_pairs(batches):
    """Rows of a task by part of a group: the pairs of a part that can still be linked, or one row without a pair where they are more than its ``most``."""
    schema = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
    held = None

    def pairs(rows):
        x, y = ({c: v[at] for c, v in rows.items()} for at in (~rows["beside"], rows["beside"]))
        x = {c: v[:, None] for c, v in x.items()}
        needed = np.maximum((4 * (x["na"] + y["na"]) + 8) // 9 - np.minimum(x["inside"], y["inside"]), 1)
        i, j = np.nonzero((x["root"] != y["root"]) & (x["home"] | (x["node"] > y["node"])) & (np.minimum(x["remain"], y["remain"]) >= needed)
                          & (5 * np.minimum(x["na"], y["na"]) >= 4 * np.maximum(x["na"], y["na"])))
        if len(i) > rows["most"][0]:
            return [None], [None]
        ends = x["node"][i, 0], y["node"][j]
        return np.maximum(*ends), np.minimum(*ends)

    def done(rows, cuts):
        out = [[], [], []]
        for lo, hi in zip(cuts, cuts[1:]):
            a, b = pairs({c: v[lo:hi] for c, v in rows.items()})
            for into, x in zip(out, ([rows["key"][lo]] * len(a), a, b)):
                into.extend(x)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], schema=schema)

    for batch in batches:
        new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        held = new if held is None else {c: np.concatenate([held[c], new[c]]) for c in new}
        at = np.flatnonzero((held["key"][1:] != held["key"][:-1]) | (held["part"][1:] != held["part"][:-1])) + 1
        if len(at):
            yield done(held, [0, *at])
            held = {c: v[at[-1]:] for c, v in held.items()}
    if held is not None and len(held["key"]):
        yield done(held, [0, len(held["key"])])


def _group_pairs(groups: DataFrame) -> DataFrame:
    """(key, a, b): the pairs of different components that can still be linked, group by group; a and b are NULL where a group has more of
    them than ``HUBS`` for each member. One of a pair is always among the members beside the largest component.

    A group makes a pair once, and only where the group's element can be the first one the two share: of the overlap that a link of these
    two sizes needs, the part that cannot lie inside the hub must be found among the elements that remain of both (positional
    filter). Groups without ``na``, ``inside`` and ``remain`` make all pairs. Members are split evenly into parts of about ``PART``, and every part
    meets every part of those beside the largest component by itself, so neither a task nor the rows moved grow with the square of a group."""
    bounds = [F.col(c) if c in groups.columns else F.lit(v).cast("long").alias(c) for c, v in (("na", 1), ("inside", 0), ("remain", 1))]
    size = (groups.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.max("rest").alias("rest"))
            .select("key", "members", F.ceil(F.col("members") / PART).alias("parts"), F.greatest(F.ceil(F.col("rest") / PART), F.lit(1)).alias("apart")))
    spread = F.xxhash64(F.lit(2), "node")
    rows = (groups.select("key", "node", "root", (F.col("root") == F.col("big")).alias("home"), *bounds).join(size, "key")
            .withColumn("most", F.expr(f"members * {HUBS} * if(parts * apart > 1, 2, 1) div (parts * apart)")))
    # a part is known by the number of the members' part and that of the part beside; each side goes to all parts of the other
    all_ = rows.withColumn("other", F.explode(F.expr("sequence(0L, apart - 1)"))).withColumn("part", F.col("other") * F.col("parts") + F.pmod(spread, "parts"))
    beside = rows.where("NOT home").withColumn("other", F.explode(F.expr("sequence(0L, parts - 1)"))).withColumn("part", F.pmod(spread, "apart") * F.col("parts") + F.col("other"))
    columns = ["key", "part", "beside", "node", "root", "home", "na", "inside", "remain", "most"]
    both = all_.withColumn("beside", F.lit(False)).select(*columns).unionByName(beside.withColumn("beside", F.lit(True)).select(*columns))
    return both.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_open_pairs, "key long, a long, b long")


def _few_pairs(groups: DataFrame) -> DataFrame:
    """The different pairs of ``_group_pairs``."""
    return _group_pairs(groups).where("a IS NOT NULL").select("a", "b").distinct()


def _small_first(weight: DataFrame, roots: DataFrame) -> DataFrame:
    """``weight`` with the members of smaller components before those of larger ones: only they can be linked to all others, so a
    group runs out of them first."""
    size = roots.where("node <> root").groupBy("root").agg((F.count(F.lit(1)) + 1).alias("size"))
    of = _rooted(weight, roots, "node", "root").join(size, "root", "left")
    return of.select("node", (F.col("weight") - F.coalesce("size", F.lit(1)) * F.lit(SIZE_STEP)).alias("weight"))


def classes(table_: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of a ``signed`` table over ``docs`` (rid, text). nodes: digest, node (rid of the first row of equal words), root,
    first_doc; links: the verified (a, b) between different texts that hold the classes together."""
    spark = table_.sparkSession
    texts = cut_lineage(table_.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min("rid").alias("node"), F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies")), "near-texts")
    rows = (table_.where("digest IS NOT NULL").select("rid", "bands").join(texts.select(F.col("node").alias("rid")), "rid")
            .select(F.col("rid").alias("node"), F.explode("bands").alias("key")))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    buckets = cut_lineage(rows.join(shared, "key"), "near-buckets")
    weight = cut_lineage(buckets.groupBy("node").agg(F.sum("members").alias("weight")), "near-weight")
    bits = bitmap(weight.select(F.col("node").alias("rid")))
    elements = cut_lineage(docs.select("rid", "text").mapInArrow(partial(_runs_of, bits), "rid long, elements binary"), "near-elements")

    # members of a bucket with the bucket's hub; then, as long as some can be linked past a hub, members of finer groups with the
    # hubs of those. A hub comes before all members of its groups in (component's size, weight, node), so groups run out.
    links, roots, few, tried, hubs = [], None, None, [], HUBS
    pairs = _hub_pairs(buckets.select("key", "node", F.col("node").alias("root")), weight, 1)
    while True:
        with scratch_tables(spark):
            used = elements if few is None else _elements_of(elements, pairs, few)
            found = compare(pairs, used)
            new = _linked(found)
            if few is not None:
                new = new.unionByName(_linked(compare(few, used)))
            links.append(cut_lineage(new.distinct(), "near-links", keep=True))
            roots = cut_lineage(components(links[-1]) if roots is None else _joined(roots, links[-1]), "near-roots", keep=True)
            groups = _left_over(found, roots, used)
            made = cut_lineage(_group_pairs(groups), "near-made")
            few = made.where("a IS NOT NULL").select("a", "b").distinct()
            for t in tried:                                      # pairs of few groups are tried once
                few = few.join(t, ["a", "b"], "left_anti")
            few = cut_lineage(few, "near-few", keep=True)
            tried.append(few)
            large = groups.join(made.where("a IS NULL").select("key").distinct(), "key", "left_semi").select("key", "node", "root", "na", "inside", "remain")
            pairs = cut_lineage(_hub_pairs(large, _small_first(weight, roots), hubs), "near-pairs", keep=True)
            hubs *= 2
        if pairs.isEmpty():
            break
    if not few.isEmpty():
        with scratch_tables(spark):
            links.append(cut_lineage(_linked(compare(few, _elements_of(elements, few))), "near-links", keep=True))
            roots = cut_lineage(_joined(roots, links[-1]), "near-roots", keep=True)
    links = reduce(DataFrame.unionByName, links)
    return texts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), links


def _joined(roots: DataFrame, new: DataFrame) -> DataFrame:
    """(node, root) after ``new`` links: the links are contracted to the roots they connect, and only those components are
    worked out."""
    to_root = roots.withColumnRenamed("root", "r")
    between = new
    for end in ("a", "b"):
        between = between.join(to_root.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("r", end)).drop("r")
    tops = components(between).select(F.col("node").alias("root"), F.col("root").alias("top"))
    # a root that comes under another one moves as well, whether or not it is an end of a new link itself
    alone = new.unionByName(between).select(F.explode(F.array("a", "b")).alias("node")).withColumn("root", F.col("node"))
    known = roots.unionByName(alone).groupBy("node").agg(F.min("root").alias("root"))     # a root is the smallest node it stands for
    return known.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs, rows). docs: the documents with a row id. rows: rid, n_words, class_id and keep - whether it is the one row of its
    class that stays (smallest doc_id, then first row). All tables in between are deleted."""
    docs = with_row_ids(docs)
    with scratch_tables(docs.sparkSession):
        t = signed(docs)
        nodes, _ = classes(t, docs)
        ids = cut_lineage(t.select("rid", "doc_id", "n_words", "digest").join(nodes.select("digest", "root", "first_doc"), "digest", "left"), "near-rows")
        best = (ids.where("root IS NOT NULL").groupBy("root")
                .agg(F.min("first_doc").alias("class_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("k")).select("root", "class_id", F.col("k.rid").alias("kept")))
        out = ids.join(best, "root", "left").select(
            "rid", "n_words", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
            F.coalesce(F.col("kept") == F.col("rid"), F.lit(True)).alias("keep"))
        return docs, cut_lineage(out, "near-result", keep=True)


def op10_near_duplicates(spark, sf_dir) -> DataFrame:
    docs, out = grouped(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("rid", "doc_id").join(out, "rid").select("doc_id", "class_id", F.col("keep").alias("representative"), "n_words")


def keep_documents(docs: DataFrame) -> DataFrame:
    """Pipeline form: one document of each class, columns as they came."""
    def step(d):
        numbered, out = grouped(d)
        return numbered.join(out.where("NOT keep").select("rid"), "rid", "left_anti")

    return shielded(docs, step)
