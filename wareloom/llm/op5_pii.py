"""Personal data by weak supervision (DataFrame functions only).

1. Candidates: the contract's base patterns and a few looser ones (numbers without ``+``, written-out
   addresses, identity numbers, long hexadecimal tokens). Positions come from the texts between the
   matches: ``split`` and ``regexp_extract_all`` walk the same leftmost matches, so a running sum of
   their lengths is the start in code points. The patterns are the contract's, written so that
   no start is tried twice inside one run of characters (linear on very long texts).
2. Labelers vote on each candidate (1 personal, -1 not, 0 abstain): the pattern rule, a gazetteer of
   cue words before the span, a gazetteer of counter cues, a checksum and a shape rule.
3. Expectation-maximisation over the counts of vote patterns estimates for each kind how reliable the
   labelers are. Only pattern counts (at most kinds x 3^labelers rows) reach the driver.
4. The posterior of each pattern weights its spans in a naive-Bayes span classifier over the span's
   own features (kind, length, distinct characters, cue, neighbouring characters); the classifier
   decides which looser candidates are added. Base spans always stay, and an added span never
   overlaps one.

Defined cases: NULL text is empty: no spans, hash of the empty string; rows sharing a doc_id are
judged apart, equal rows get equal results; a very long text is scanned whole; an empty table gives an empty result and trains
nothing; further columns are not read."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, table

#: Fixed order of the kinds (contract), then kinds of the method.
KINDS = ["email", "ip", "card", "phone", "secret", "identity"]

# The contract's patterns. Equal matches, linear time: a run is entered at its first character only
# (or where the last match ended, \G), and classes that cannot give back a character are possessive.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
IP = r"[0-9](?<![0-9]{2})[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Looser candidates of the method
LOOSE_PHONE = r"(?<![0-9A-Za-z+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])"
LOOSE_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]{1,64}(?:\x20?(?:\.|\[dot\]|\(dot\))\x20?[A-Za-z0-9-]{2,24}){1,4}"
SECRET = r"(?<![0-9A-Za-z])[0-9a-f]{32,64}(?![0-9A-Za-z])"
IDENTITY = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

#: Cue words of the gazetteers.
CUES = r"(?i)(?:e-?mail|mail|contact|write|phone|tel|call|mobile|fax|card|visa|iban|account|host|addr|ip|token|key|secret|password|ssn|passport)\W{0,4}\w{0,6}\W{0,4}$"
COUNTER_CUES = r"(?i)(?:version|release|isbn|issn|order|invoice|build|page|section|chapter|figure|v)\W{0,3}$"
LABELERS = ["v_rule", "v_cue", "v_counter", "v_check", "v_shape"]


def _pieces(text: Column, kind: str, pattern: str, base: bool, guard: Column) -> Column:
    """Array of (kind, base, nth, gap before, match, text after) for one pattern; empty when the guard rules it out."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.when(guard, F.transform(F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("g"), F.slice(gaps, 2, F.size(found) + 1).alias("n")),
                                     lambda x, i: F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), i.alias("nth"),
                                                           F.length(x["g"]).alias("gap"), x["m"].alias("m"),
                                                           F.right(x["g"], F.lit(32)).alias("before"), F.left(x["n"], F.lit(8)).alias("after"))))
    return F.coalesce(rows, F.array().cast("array<struct<kind:string,base:boolean,nth:int,gap:int,m:string,before:string,after:string>>"))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))
    n = F.length(d)
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda s, i: s + F.when(
        i % 2 == 1, F.substring(d, i, F.lit(1)).cast("int")).otherwise(
        F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substring(d, i, F.lit(1)).cast("int") + 1)))
    return total % 10 == 0


def candidates(docs: DataFrame) -> DataFrame:
    """rid, doc_id and per candidate kind, base, valid, start, end, m, before, after; a document without any has one
    row with NULL kind. ``valid``: a base pattern's match that passes its rule."""
    t = F.col("text")
    digit = F.col("has_digit")
    base = [_pieces(t, "email", EMAIL, True, F.contains(t, F.lit("@"))), _pieces(t, "ip", IP, True, digit),
            _pieces(t, "card", CARD, True, digit), _pieces(t, "phone", PHONE, True, F.contains(t, F.lit("+"))),
            _pieces(t, "phone", LOOSE_PHONE, False, digit),
            _pieces(t, "email", LOOSE_EMAIL, False, F.contains(t, F.lit("at]")) | F.contains(t, F.lit("at)"))),
            _pieces(t, "secret", SECRET, False, digit), _pieces(t, "identity", IDENTITY, False, digit)]
    rows = (docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("rid", F.monotonically_increasing_id())
            .withColumn("has_digit", F.col("text").rlike("[0-9]"))
            .select("rid", "doc_id", F.explode_outer(F.concat(*base)).alias("c")).select("rid", "doc_id", "c.*"))
    w = Window.partitionBy("rid", "kind", "base").orderBy("nth")
    end = F.sum(F.col("gap") + F.length("m")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    n_digits = F.length(_digits(F.col("m")))
    octets = F.forall(F.split("m", r"\."), lambda p: F.coalesce(p.try_cast("decimal(38,0)") <= 255, F.lit(False)))
    valid = (F.when(F.col("kind") == "email", F.lit(True)).when(F.col("kind") == "ip", octets)
             .when(F.col("kind") == "card", n_digits.between(12, 19) & _luhn(F.col("m")))
             .when(F.col("kind") == "phone", n_digits.between(9, 15)))
    return (rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("m")).drop("gap", "nth")
            .withColumn("valid", F.col("base") & F.coalesce(valid, F.lit(False))))


def with_votes(cand: DataFrame) -> DataFrame:
    """The labelers' votes and the classifier's features for every candidate."""
    m, kind = F.col("m"), F.col("kind")
    distinct = F.size(F.array_distinct(F.split(F.regexp_replace("m", "[^0-9A-Za-z]", ""), "")))
    cue, counter = F.col("before").rlike(CUES), F.col("before").rlike(COUNTER_CUES)
    return (cand.withColumn("v_rule", F.when(F.col("valid"), 1).when(F.col("base"), -1).otherwise(0))
            .withColumn("v_cue", F.when(cue, 1).otherwise(0)).withColumn("v_counter", F.when(counter, -1).otherwise(0))
            .withColumn("v_check", F.when(kind == "card", F.when(_luhn(m), 1).otherwise(-1))
                        .when(kind == "identity", F.when(m.rlike("^(?:000|666|9)|-00-|-0000$"), -1).otherwise(1))
                        .when(kind == "phone", F.when(F.length(_digits(m)).between(9, 15), 1).otherwise(-1)).otherwise(0))
            .withColumn("v_shape", F.when(distinct <= 2, -1).when(distinct >= 5, 1).otherwise(0))
            .withColumn("features", F.array(
                F.concat_ws("|", kind, F.lit("len"), F.least(F.length("m"), F.lit(64)).cast("string")),
                F.concat_ws("|", kind, F.lit("distinct"), F.least(distinct, F.lit(16)).cast("string")),
                F.concat_ws("|", kind, F.lit("cue"), (F.col("v_cue") - F.col("v_counter") * 2).cast("string")),
                F.concat_ws("|", kind, F.lit("prev"), F.regexp_replace(F.regexp_replace(F.right("before", F.lit(1)), r"\p{L}", "a"), r"[^a\s\p{Punct}]", "u")),
                F.concat_ws("|", kind, F.lit("next"), F.regexp_replace(F.regexp_replace(F.left("after", F.lit(1)), r"\p{L}", "a"), r"[^a\s\p{Punct}]", "u")))))


def reliabilities(patterns: list, rounds: int = 30) -> dict:
    """EM over vote-pattern counts. patterns: (kind, votes tuple, count).
    Returns {(kind, votes): posterior} and, under the key kind, the estimated accuracy of each labeler."""
    out = {}
    for kind in {k for k, _, _ in patterns}:
        rows = [(v, n) for k, v, n in patterns if k == kind]
        acc, prior = [0.8] * len(LABELERS), 0.5
        for _ in range(rounds):
            post = []
            for votes, _ in rows:
                z = math.log(prior / (1 - prior)) + sum(v * math.log(a / (1 - a)) for v, a in zip(votes, acc))
                post.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            total = sum(n for _, n in rows)
            prior = min(0.95, max(0.05, sum(p * n for p, (_, n) in zip(post, rows)) / total))
            for j in range(len(acc)):
                right = sum(n * (p if v[j] > 0 else 1 - p) for p, (v, n) in zip(post, rows) if v[j])
                seen = sum(n for v, n in rows if v[j])
                acc[j] = min(0.99, max(0.51, (right + 8) / (seen + 10)))     # labelers are better than chance
        out[kind] = acc
        out.update({(kind, v): p for (v, _), p in zip(rows, post)})
    return out


def _lookup(pairs: dict, key: Column, default: float) -> Column:
    """Value of a small driver-side dict for a key column (a literal map)."""
    if not pairs:
        return F.lit(default)
    m = F.map_from_arrays(F.array(*[F.lit(k) for k in pairs]), F.array(*[F.lit(float(v)) for v in pairs.values()]))
    return F.coalesce(F.try_element_at(m, key), F.lit(default))


def classified(cand: DataFrame) -> DataFrame:
    """Candidates with ``posterior`` (label model) and ``p`` (span classifier)."""
    voted = with_votes(cand)
    key = F.concat_ws(",", "kind", *LABELERS)
    real = voted.where("kind IS NOT NULL")
    counts = real.groupBy("kind", *LABELERS).agg(F.count(F.lit(1)).alias("n")).collect()
    model = reliabilities([(r["kind"], tuple(r[x] for x in LABELERS), r["n"]) for r in counts])
    post = {",".join([k[0], *map(str, k[1])]): v for k, v in model.items() if isinstance(k, tuple)}
    voted = voted.withColumn("posterior", _lookup(post, key, 0.0))
    real = voted.where("kind IS NOT NULL")
    stats = (real.select("kind", "posterior", F.explode("features").alias("f")).groupBy("f")
             .agg(F.sum("posterior").alias("yes"), F.sum(1 - F.col("posterior")).alias("no")).collect())
    kinds = {r["kind"]: (r["yes"], r["no"]) for r in real.groupBy("kind").agg(
        F.sum("posterior").alias("yes"), F.sum(1 - F.col("posterior")).alias("no")).collect()}
    prior = {k: math.log((y + 1) / (n + 1)) for k, (y, n) in kinds.items()}
    weight = {}
    for r in stats:
        y, n = kinds[r["f"].split("|")[0]]
        weight[r["f"]] = math.log((r["yes"] + 1) / (y + 20)) - math.log((r["no"] + 1) / (n + 20))
    z = F.aggregate("features", _lookup(prior, F.col("kind"), 0.0), lambda s, f: s + _lookup(weight, f, 0.0))
    return voted.withColumn("p", 1 / (1 + F.exp(-z)))


def find_personal_data(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, added (array of spans
    the method adds with their probability)."""
    cand = classified(cut_lineage(candidates(docs), "pii-candidates"))
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    span = F.struct("start", order.alias("o"), "end", "kind", "p")
    grouped = cand.groupBy("rid", "doc_id").agg(
        *[F.count(F.when(F.col("valid") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS[:4]],
        F.array_sort(F.collect_list(F.when(F.col("valid"), span))).alias("b"),
        F.array_sort(F.collect_list(F.when(~F.col("base") & (F.col("p") >= threshold), span))).alias("x"))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    free = F.filter("x", lambda e: ~F.exists("b", lambda b: (b["start"] < e["end"]) & (e["start"] < b["end"])))
    return (grouped.withColumn("added", free)
            .withColumn("base_sha256", F.sha2(text(F.col("b")), 256))
            .withColumn("spans", text(F.array_sort(F.concat("b", "added")))).drop("b", "x", "rid"))


def op5_pii(spark, sf_dir) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
