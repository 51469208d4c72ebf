import random
import re
from collections import Counter, defaultdict

import pytest
from llm_fixtures import AZ, docs, prose, with_clashing

from wareloom.llm import op11_divergence as op

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, min_docs=3, top=200):
    """rows: (doc_id, text, lang, source). Term by term, as the definition says."""
    groups, seen, count = set(), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        g = (lang or "", source or "")
        w = TERM.findall((text or "").translate(AZ))
        groups.add(g)
        seen[g[0]].update(set(w))
        count[g].update(w)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in seen[lang].items() if n >= min_docs]
        mine = sorted(s for x, s in groups if x == lang)

        def p_of(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        whole = Counter()
        for s in mine:
            whole.update(count[lang, s])
        q = p_of(whole)
        ps = {s: p_of(count[lang, s]) for s in mine}
        for s in mine:
            pairs = [(sum((ps[s][t] - ps[o][t]) ** 2 // ps[o][t] for t in kept), o) for o in mine if o != s]
            terms = [((ps[s][t] - q[t]) ** 2 // q[t], t) for t in kept if count[lang, s][t] and ps[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(found[:limit])]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


def fixture():
    rng = random.Random(11)
    rows = []
    for i in range(160):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["a", "b", "b", "b", "c", None])
        words = " ".join(f"{rng.choice('xyz')}{'abcdefghij'[rng.randrange(10)]}{'klmnop'[rng.randrange(6) if source == 'b' else 0]}" for _ in range(rng.randrange(0, 40)))
        rows.append((i if i % 9 else None, words, lang, source))
    rows += [(1, None, "en", "a"), (2, "", "fr", "only"), (3, None, "fr", None), (4, "123 !! _", "en", "d"), (5, "x" * 50_000 + " Äpfel äpfel ÄPFEL", "en", "a")]
    rows += [(6, "Äpfel same same 中文 x1y", "en", "c")] * 5
    return rows


def test_against_brute_force(spark):
    rows = fixture()
    assert got(op.audit(docs(spark, rows))) == brute(rows)


def test_merged_cells_cut_at_a_rank(spark):
    rows = fixture()
    for top in (1, 3, 7):
        assert got(op.audit(docs(spark, rows), top=top)) == brute(rows, top=top)


def test_counts_given_out_in_pieces(spark, monkeypatch):
    rows = fixture()
    text = op._count
    monkeypatch.setattr(op, "BYTES_AT_ONCE", 500)
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"lang": [r[2] or "" for r in rows], "source": [r[3] or "" for r in rows], "text": [(r[1] or "").encode() for r in rows]})
    parts = [b.to_pylist() for b in text([batch])]
    assert len(parts) > 5
    n = Counter()
    for r in (r for p in parts for r in p):
        for source, c in zip(r["sources"], r["counts"]):
            n[r["lang"], source, r["term"] and r["term"].decode()] += c
    want = Counter()
    for _, t, lang, s in rows:
        want.update((lang or "", s or "", w) for w in TERM.findall((t or "").translate(AZ)))
    assert {k: v for k, v in n.items() if k[2] is not None} == want


def test_empty_table_clashing_columns_and_one_hot_source(spark):
    rng = random.Random(5)
    assert got(op.audit(docs(spark, fixture()).limit(0))) == []
    rows = fixture()
    assert got(op.audit(with_clashing(docs(spark, rows), "term", "n", "profile", "c", "m", "docs"))) == brute(rows)
    hot = [(i, prose(rng, 12, 60), "en", "hot" if i % 3 else f"s{i % 5}") for i in range(300)]
    assert got(op.audit(docs(spark, hot, 7))) == brute(hot)


@pytest.mark.parametrize("m", [1, 10**13])
def test_probabilities_are_exact_past_longs(spark, m):
    c, total, kept = 3 * m + 1, 10 * m, 7
    got_ = spark.range(1).selectExpr(f"{c}L AS c", f"{total}L AS total", f"{kept}L AS kept").select(op._p("c", "total", "kept")).first()[0]
    assert got_ == 1 + 10**9 * (c + 1) // (total + kept)


def test_a_task_gives_a_term_out_once_up_to_its_bound():
    """300,000 terms in two sources are counted in one go and given out in short batches (before: again after every 200,000 entries)."""
    import pyarrow as pa

    def word(i):
        return b"".join(bytes([97 + i // 26 ** k % 26]) for k in range(4))
    texts = [b" ".join(word(i) for i in range(s, s + 500)) for s in range(0, 300_000, 500)]
    t = pa.table({"lang": ["en"] * 1200, "source": ["a"] * 600 + ["b"] * 600, "text": texts + [x.split()[0] for x in texts]})
    batches = list(op._count(t.to_batches(max_chunksize=100)))
    rows = [r for b in batches for r in b.to_pylist()]
    assert len(rows) == 300_001 and max(b.num_rows for b in batches) <= op.ROWS_AT_ONCE
    got = {r["term"]: (r["docs"], dict(zip(r["sources"], r["counts"]))) for r in rows}
    assert got[None] == (0, {"a": 600, "b": 600})
    assert got[word(0)] == (2, {"a": 1, "b": 1}) and got[word(1)] == (1, {"a": 1})
    assert sum(d for d, _ in got.values()) == 300_600
