import hashlib
import random
import re

from llm_fixtures import docs, with_clashing

from wareloom.llm import op5_pii as op

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    text, out = text or "", []
    out += [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 12 <= len(d := re.sub("[^0-9]", "", m.group())) <= 19 and luhn(d)]
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], op.KINDS.index(s[0])))


def brute(rows):
    out = []
    for r in rows:
        b = base(r[1])
        out.append((r[0], *[sum(k == s[0] for s in b) for k in op.KINDS[:4]],
                    hashlib.sha256(",".join(f"{k}:{a}:{e}" for k, a, e in b).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect()), key=str)


ROWS = [
    (1, "Write to a.b+c@mail.example.com, or x@y.z. Not @home.com, not a@b. é😀 c@d.ef_g@h.ij"), (2, "host 10.0.0.1, 256.1.1.1, 1.2.3.4.5.6.7.8 and 001.002.0003.255, 1.2.3"),
    (3, "card 4111 1111 1111 1111, 4111-1111-1111-1112, 4242424242424242; 12345678901234567890123"), (4, "+1 (017) 555-7713 or +49 30 1234567890123456, +1, +12, call +12345678."),
    (5, None), (6, ""), (None, "null id +1 (017) 555-7713"), (7, "1" * 60_000), (8, "a" * 60_000 + "@"), (9, ("+1 (017) 555-7713 10.0.0.1 " * 400)), (10, "9" * 13 + " " * 3 + "4111111111111111"),
    (1, "Write to a.b+c@mail.example.com, or x@y.z. Not @home.com, not a@b. é😀 c@d.ef_g@h.ij"), (11, "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" phone 555-123-4567 ssn 123-45-6789"),
    (12, "x+4111111111111111+4111111111111111@a.b.c 4111  1111 1111 1111"), (13, "1-2 3-4 5 6--7 8 4111 1111-1111 1111 -4"),
]


def test_base_spans_against_brute_force(spark):
    assert got(op.find_personal_data(docs(spark, ROWS))) == brute(ROWS)


def test_random_strings(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("0123456789..  --+@aZ_()é") for _ in range(rng.randrange(400)))) for i in range(300)]
    rows += [(1000 + i, "".join(rng.choice("0123 -") for _ in range(300))) for i in range(100)]
    assert got(op.find_personal_data(docs(spark, rows))) == brute(rows)


def test_added_spans_do_not_touch_base_spans(spark):
    for r in op.find_personal_data(docs(spark, ROWS)).collect():
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r["spans"].split(",") if x)]
        assert [s[1] for s in spans] == sorted(s[1] for s in spans)
        text = next((t for i, t in ROWS if i == r["doc_id"]), None)
        if r["doc_id"] not in (1,):
            assert set(base(text)) <= set(spans)
        if r["doc_id"] == 11:
            assert {s[0] for s in spans} >= {"secret"}


def test_empty_and_clashing(spark):
    d = docs(spark, ROWS)
    assert op.find_personal_data(d.limit(0)).count() == 0
    assert got(op.find_personal_data(docs(spark, [(1, None)]))) == brute([(1, None)])
    assert got(op.find_personal_data(with_clashing(d, "kind", "rid", "start", "m", "p", "features", "base"))) == brute(ROWS)


def test_reliabilities_favour_agreeing_labelers():
    pats = [("x", (1, 1, 0, 0, 1), 80), ("x", (-1, 0, -1, 0, -1), 60), ("x", (1, 0, 0, 0, -1), 5)]
    m = op.reliabilities(pats)
    assert m[("x", (1, 1, 0, 0, 1))] > 0.9 and m[("x", (-1, 0, -1, 0, -1))] < 0.1


def test_no_python_in_the_plan(spark):
    plan = op.find_personal_data(docs(spark, ROWS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
