import random
from collections import Counter

import numpy as np
import pytest
from llm_fixtures import docs, prose, with_clashing, words

from wareloom.llm import op10_near_duplicates as op


def shingles(text):
    w = words(text)
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def linked(a, b):
    o = sum((a & b).values())
    return 9 * o >= 4 * (sum(a.values()) + sum(b.values()))


def brute(rows):
    """Class of each row: the smallest doc_id over the connected component."""
    s = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and linked(s[i], s[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for g in groups.values():
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        out += [(rows[i][0], min(ids) if ids else None) for i in g]
    return sorted(out, key=str)


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(1000)}"
    return " ".join(w)


def fixture():
    rng = random.Random(11)
    rows = []
    for g in range(12):
        base = prose(rng, rng.choice([30, 120, 300]), 5000)
        for _ in range(rng.choice([1, 2, 5])):
            rows.append((len(rows), edited(rng, base, rng.randrange(4))))
    base = prose(rng, 200, 5000)
    rows += [(len(rows) + 500 + k, edited(rng, base, k % 5)) for k in range(60)]                 # one large group of near copies
    chain = prose(rng, 100, 5000)
    for k in range(5):                                                                            # a chain: neighbours similar, ends not
        rows.append((2000 + k, chain))
        chain = edited(rng, chain, 1)
    rows += [(3000, None), (3001, ""), (3002, "!!!"), (3003, "!!!"), (3004, "two words"), (3005, "Two, words."), (3006, "one"), (3004, "two words"), (None, "two words"), (None, prose(rng, 40)),
             (3007, "rep " * 400), (3008, "rep " * 420), (3009, "rep " * 100), (3010, prose(rng, 5000, 9000))]
    passage = prose(rng, 60, 5000)
    rows += [(4000 + k, passage + " " + prose(rng, 60, 5000)) for k in range(20)]                 # a shared passage is not a near copy
    return rows


def test_classes_against_brute_force(spark):
    rows = fixture()
    t, out = op.grouped(docs(spark, rows))
    got = [(r["doc_id"], r["class_id"]) for r in t.join(out, "rid").collect()]
    assert sorted(got, key=str) == brute(rows)


def test_pipeline_form_keeps_one_of_each_class(spark):
    rows = fixture()
    out = op.keep_documents(with_clashing(docs(spark, rows), "digest", "rid"))
    assert out.columns[-2:] == ["digest", "rid"]
    kept = [r["doc_id"] for r in out.where("digest = 'extra' AND rid = 'extra'").collect()]
    want = {}
    for i, c in brute(rows):
        want.setdefault(c if c is not None else object(), i)
    empty = [i for i, t, *_ in rows if not words(t)]
    assert len(kept) == len(set(want) | set()) and set(empty) <= set(kept)


def test_links_between_outliers_of_a_group(spark):
    """Copies edited in the same places are linked to each other, though not to the original they come from; also shorter ones."""
    rng = random.Random(21)
    base = prose(rng, 150, 5000).split()
    rows = [(0, " ".join(base))]
    for k in range(40):
        w = list(base)
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(len(w))] = f"q{rng.randrange(10 ** 6)}"
        rows.append((k + 1, " ".join(w)))
        if k % 3 == 0:
            v = list(w)
            v[rng.randrange(len(v))] = f"r{k}"
            rows.append((100 + k, " ".join(v)))
        if k % 4 == 0:
            rows += [(200 + k, " ".join(base[:150 - 5 * k // 2])), (300 + k, " ".join(base[:149 - 5 * k // 2]))]
    t, out = op.grouped(docs(spark, rows))
    assert sorted(((r["doc_id"], r["class_id"]) for r in t.join(out, "rid").collect()), key=str) == brute(rows)


def members_of(monkeypatch):
    """Notes how many comparisons are made."""
    made = []
    plain = op.compare

    def counted(pairs, elements):
        out = plain(pairs, elements)
        made.append(out.count())
        return out
    monkeypatch.setattr(op, "compare", counted)
    return made


def test_texts_of_shared_passages_meet_few_times(spark, monkeypatch):
    """Texts put together from passages that hundreds share fall into the same buckets, though hardly any are linked."""
    made = members_of(monkeypatch)
    rng = random.Random(8)
    passages = [prose(rng, 30, 5000) for _ in range(6)]
    rows = [(k, " ".join([*rng.sample(passages, 4), prose(rng, rng.randrange(1, 45), 5000)])) for k in range(400)]
    d, out = op.grouped(docs(spark, rows))
    got = [(r["doc_id"], r["class_id"]) for r in d.join(out, "rid").collect()]
    assert sorted(got, key=str) == brute(rows)
    assert sum(made) < 50 * len(rows)              # all pairs would be 200 a row


def test_excerpts_of_one_text_against_brute_force(spark, monkeypatch):
    """Excerpts lie wholly inside the longest of them and can only be told apart by their own elements."""
    made = members_of(monkeypatch)
    rng = random.Random(31)
    base = prose(rng, 1500, 9000).split()
    rows = [(0, " ".join(base))]
    for k in range(500):
        at, n = rng.randrange(1400), rng.randrange(60, 120)
        rows.append((k + 1, " ".join(base[at:at + n])))
    d, out = op.grouped(docs(spark, rows))
    got = [(r["doc_id"], r["class_id"]) for r in d.join(out, "rid").collect()]
    assert sorted(got, key=str) == brute(rows)
    assert sum(made) < 60 * len(rows)


def test_components_raise_when_they_do_not_settle(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r["root"] for r in op.components(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        op.components(chain, max_rounds=1)


def test_a_root_moves_with_its_component(spark):
    roots = spark.createDataFrame([(12, 11), (13, 11), (3, 2)], "node long, root long")
    new = spark.createDataFrame([(13, 3), (30, 20)], "a long, b long")
    got = {r["node"]: r["root"] for r in op._joined(roots, new).collect()}
    assert {n: got.get(n, n) for n in (2, 3, 11, 12, 13, 20, 30)} == {2: 2, 3: 2, 11: 2, 12: 2, 13: 2, 20: 20, 30: 20}


def test_tables_in_between_are_deleted(spark):
    import os
    base = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(f"{base}/wareloom-stages")) if os.path.exists(f"{base}/wareloom-stages") else set()
    op.grouped(docs(spark, fixture()[:40]))
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(f"{base}/wareloom-stages")) - before}
    assert left <= {"near-result", "numbered-rows"}


def test_empty_and_clashing(spark):
    d = docs(spark, fixture())
    t, out = op.grouped(d.limit(0))
    assert out.count() == 0
    t, out = op.grouped(with_clashing(d, "rid", "digest", "bands", "node", "root", "class_id", "a", "b"))
    got = [(r["doc_id"], r["c"]) for r in t.join(out.withColumnRenamed("class_id", "c"), "rid").collect()]
    assert sorted(got, key=str) == brute(fixture())


@pytest.mark.parametrize("common,mine,other", [(60, 20, 20), (30, 70, 70), (90, 5, 5)])
def test_signature_agreement_is_unbiased(common, mine, other):
    """Share of equal components against the weighted Jaccard similarity, weights up to 9."""
    rng = np.random.default_rng(common)
    est, true = [], None
    for trial in range(30):
        keys = rng.integers(1, 2 ** 62, common + mine + other).astype(np.uint64)
        w1, w2 = rng.integers(1, 10, len(keys)), rng.integers(1, 10, len(keys))
        w1[common + mine:] = 0
        w2[common:common + mine] = 0
        doc = np.r_[np.zeros((w1 > 0).sum(), int), np.ones((w2 > 0).sum(), int)]
        sig = op.signatures(doc, np.r_[keys[w1 > 0], keys[w2 > 0]], np.r_[w1[w1 > 0], w2[w2 > 0]], 2)
        est.append((sig[0] == sig[1]).mean() - np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum())
    assert abs(np.mean(est)) < 4 * 0.5 / np.sqrt(30 * op.M)


def test_multiset_counts_occurrences():
    h = np.array([5, 7, 5, 5], np.uint64)
    g = np.array([5, 5, 9], np.uint64)
    a, b = op.multiset(h), op.multiset(g)
    assert len(set(a)) == 4 and len(set(a) & set(b)) == 2


def test_members_of_one_component_meet_the_last_hub_alone(spark):
    """A hub that is not the last of its group is met by members of other components only (before: by every member)."""
    weight = spark.createDataFrame([(i, 1000 - i) for i in range(90)], "node long, weight long")
    root = {i: 7 if i in (3, 80) else 0 for i in range(90)}
    groups = spark.createDataFrame([(1, i, r) for i, r in root.items()], "key long, node long, root long")
    got = {(r.a, r.b): r.last for r in op._hub_pairs(groups, weight, 64).collect()}
    want = {(a, b): b == 63 for b in range(64) for a in range(b + 1, 90) if b == 63 or root[a] != root[b]}
    assert got == want and len(got) < 200


def test_only_elements_of_compared_members_are_moved(spark):
    elements = spark.createDataFrame([(i, b"x") for i in range(50)], "rid long, elements binary")
    pairs = spark.createDataFrame([(3, 1), (4, 1)], "a long, b long")
    more = spark.createDataFrame([(9, 3)], "a long, b long")
    assert sorted(r.rid for r in op._elements_of(elements, pairs, more).collect()) == [1, 3, 4, 9]


def test_a_group_of_near_copies_with_a_few_outliers_is_done_at_once(spark, monkeypatch):
    """Nearly all members of the group are one component: the few others meet all members (before: 64 hubs a level, many levels)."""
    made = members_of(monkeypatch)
    rng = random.Random(77)
    base = prose(rng, 150, 5000).split()
    rows = [(0, " ".join(base))]
    for k in range(300):
        w = list(base)
        for at in rng.sample(range(10, 140, 5), rng.choice([1, 2, 3, 3, 5] if k % 20 else [7, 8, 9])):
            w[at] = f"q{rng.randrange(2)}"                       # few places and few words: many copies share an edit
        rows.append((k + 1, " ".join(w)))
    d, out = op.grouped(docs(spark, rows))
    got = [(r["doc_id"], r["class_id"]) for r in d.join(out, "rid").collect()]
    assert sorted(got, key=str) == brute(rows)
    assert len(set(c for _, c in got)) > 2 and len(made) <= 3


def test_few_beside_the_largest_component_meet_all(spark):
    """One of a pair is always beside the largest component; a group with more than HUBS of those forms no pairs."""
    root = {i: i if i in (5, 90, 200) else 0 for i in range(300)}
    few = [(1, i, r, 3, 0) for i, r in root.items()]
    many = [(2, i, i if i > op.HUBS else 0, 300 - op.HUBS - 1, 0) for i in range(300)]
    groups = spark.createDataFrame(few + many, "key long, node long, root long, rest long, big long")
    got = {(r.a, r.b) for r in op._few_pairs(groups).collect()}
    assert got == {(max(a, b), min(a, b)) for a in (5, 90, 200) for b in range(300) if a != b}


def test_members_of_a_small_component_are_hubs_first(spark):
    weight = spark.createDataFrame([(i, 100 - i) for i in range(6)], "node long, weight long")
    roots = spark.createDataFrame([(1, 0), (2, 0), (4, 3)], "node long, root long")
    ranked = sorted(op._small_first(weight, roots).collect(), key=lambda r: -r.weight)
    assert [r.node for r in ranked][0] == 5 and {r.node for r in ranked[:3]} == {3, 4, 5}


def test_only_members_that_can_link_inside_the_hub_show_those_elements(spark):
    """A member of 100 elements that has 60 in common with the hub shares too few of them with any other member (before: all it has
    was shown)."""
    def member(inside, own):
        return np.r_[np.arange(inside), np.arange(own.start, own.stop)].astype(np.uint64).tobytes()
    sets = {0: member(100, range(0)), 1: member(85, range(1000, 1000)), 2: member(60, range(2000, 2040)), 3: member(79, range(0)),
            4: member(60, range(2030, 2070)), 5: member(78, range(0)), 6: member(83, range(6000, 6017))}
    elements = spark.createDataFrame([(k, v) for k, v in sets.items()], "rid long, elements binary")
    n = {k: len(v) // 8 for k, v in sets.items()}
    common = {k: len(set(np.frombuffer(v, np.uint64)) & set(range(100))) for k, v in sets.items()}
    linked = {k: 9 * common[k] >= 4 * (n[k] + 100) for k in sets}
    found = spark.createDataFrame([(k, 0, True, common[k], n[k], 100, linked[k]) for k in sets if k], op.COMPARED)
    roots = spark.createDataFrame([(k, 0) for k in sets if k and linked[k]] or [(9, 9)], "node long, root long")
    groups = op._left_over(found, roots, elements).collect()
    by_key = {}
    for r in groups:
        by_key.setdefault(r.key, set()).add(r.node)
    links = {(a, b) for a in sets for b in sets if 0 < a < b and linked[a] != linked[b]
             and 9 * len(set(np.frombuffer(sets[a], np.uint64)) & set(np.frombuffer(sets[b], np.uint64))) >= 4 * (n[a] + n[b])}
    assert links and all(any({a, b} <= m for m in by_key.values()) for a, b in links)
    assert not any({2, k} <= m for m in by_key.values() for k in (1, 3, 5, 6))


def left_of(spark, hub, members):
    """Pairs of groups after members (sets of numbers; each its own component unless linked to the hub) met the hub 0, and the true links
    between different components."""
    sets = {0: set(hub)} | {k + 1: set(m) for k, m in enumerate(members)}
    elements = spark.createDataFrame([(k, np.array(sorted(v), np.uint64).tobytes()) for k, v in sets.items()], "rid long, elements binary")

    def link(a, b):
        return 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))
    found = spark.createDataFrame([(k, 0, True, len(sets[k] & sets[0]), len(sets[k]), len(sets[0]), link(k, 0)) for k in sets if k], op.COMPARED)
    home = [k for k in sets if link(k, 0)]
    roots = spark.createDataFrame([(k, 0) for k in home], "node long, root long")
    groups = op._left_over(found, roots, elements).cache()
    assert groups.where(f"rest > {op.HUBS}").isEmpty()
    got = [(r.a, r.b) for r in op._few_pairs(groups).collect()]
    assert len(got) == len(set(got))
    return set(got), {(a, b) for a in sets for b in sets if a > b > 0 and not (a in home and b in home) and link(a, b)}


def test_members_that_share_a_passage_too_short_for_a_link_make_no_pairs(spark):
    """Members of a group that share a passage the hub lacks, too short for a link, make no pair (before: all pairs of the group, the
    square of its members)."""
    for n in (20, 40):
        passage, own = range(1000, 1012), [range(2000 + 100 * k, 2028 + 100 * k) for k in range(n)]
        members = [{*range(k, 150 + k), *passage, *own[k]} for k in range(n)]
        members += [{*members[0]} - {2000} | {7000}, {*members[5]} - {2500} | {7001}]
        got, links = left_of(spark, range(200), members)
        assert {(n + 1, 1), (n + 2, 6)} <= links <= got and len(got) <= n


def test_pairs_of_groups_hold_every_link(spark):
    """Members of many sizes, some inside the hub alone, some with passages of all lengths that the hub lacks, against brute force."""
    rng = random.Random(17)
    for _ in range(3):
        hub, beside = list(range(300)), [rng.sample(range(1000, 1120), 60) for _ in range(3)]
        cores = [rng.sample(hub, rng.choice([90, 200, 225])) for _ in range(4)]
        members = []
        for _ in range(48):
            core, more = rng.choice(cores), rng.choice(beside)
            members.append({*rng.sample(core, len(core) - rng.randrange(12)), *rng.sample(more, rng.choice([0, 3, 30, 50, 56]))})
        got, links = left_of(spark, hub, members)
        assert len(links) > 20 and links <= got


def rows_of_groups(rng, n):
    """Members of two groups, sizes and bounds such that some pairs stay open; a component of 40 members in the first."""
    return [(g, i, 0 if g == 1 and i < 40 else i, n - 40 if g == 1 else n - 1, 0, rng.randrange(60, 120), rng.randrange(0, 20), rng.randrange(20, 70))
            for g in (1, 2) for i in range(n)]


GROUPS = "key long, node long, root long, rest long, big long, na long, inside long, remain long"


def still_open(x, y):
    (_, _, rx, _, _, nx, ix, mx), (_, _, ry, _, _, ny, iy, my) = x, y
    return rx != ry and 5 * min(nx, ny) >= 4 * max(nx, ny) and min(mx, my) >= max((4 * (nx + ny) + 8) // 9 - min(ix, iy), 1)


@pytest.mark.parametrize("part", [512, 50])
def test_a_group_with_many_beside_the_largest_component_makes_its_open_pairs(spark, monkeypatch, part):
    """More members than HUBS are beside the largest component, though few pairs are open: all of them are made at once, also when the
    group is dealt out in parts (before: none, the group went on with 64 hubs a level)."""
    monkeypatch.setattr(op, "PART", part, raising=False)
    rows = rows_of_groups(random.Random(5), 300)
    assert min(r[3] for r in rows) > op.HUBS
    groups = spark.createDataFrame([(k, k * 1000 + i, k * 1000 + r, rest, k * 1000 + big, *more) for k, i, r, rest, big, *more in rows], GROUPS)
    made = op._few_pairs(groups).collect()
    want = {(x[0] * 1000 + max(x[1], y[1]), x[0] * 1000 + min(x[1], y[1])) for x in rows for y in rows if x[0] == y[0] and x[1] > y[1] and still_open(x, y)}
    assert len(made) == len(want) > 1000 and {(r.a, r.b) for r in made} == want


def test_a_group_of_mostly_open_pairs_goes_to_the_hubs(spark, monkeypatch):
    """Such a group makes no more than ``HUBS`` pairs a member, and hubs meet only members that a link to them is open to."""
    monkeypatch.setattr(op, "PART", 100)
    rows = [(1, i, i, 599, 0, 100 + 30 * (i % 4 == 0), 0, 100) for i in range(600)]
    made = op._group_pairs(spark.createDataFrame(rows, GROUPS)).collect()
    assert any(r.a is None for r in made) and len(made) < 2 * op.HUBS * 600
    weight = spark.createDataFrame([(i, 1000 - i) for i in range(600)], "node long, weight long")
    got = {(r.a, r.b): r.last for r in op._hub_pairs(spark.createDataFrame(rows, GROUPS), weight, 64).collect()}
    assert got == {(a, b): b == 63 for b in range(64) for a in range(b + 1, 600) if b == 63 or still_open(rows[a], rows[b])}
