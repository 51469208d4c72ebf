"""The SCD truth table of FIXTURES §1, hand-built, for type 1 and type 2."""

from pyspark.sql import functions as F

from wareloom.operators import merge as M

T0, TS = "2024-01-01 00:00:00", "2024-01-30 00:00:00"
SCHEMA = "ID long, NAME string"


def _target(spark):
    # (1,'a') current, (2,'x') current target-only, (3,'c') closed only
    src = spark.createDataFrame([(1, "a"), (2, "x"), (3, "c")], SCHEMA)
    tgt = M.initial_load(src, ["ID"], T0).target
    return tgt.withColumn("CURFLG", F.when(F.col("ID") == 3, "N").otherwise(F.col("CURFLG")))


def _source(spark):
    rows = [(1, "b"), (5, "new"), (None, "z"), (3, "c"), (4, "p"), (4, "q")]
    return spark.createDataFrame([(r[0], r[1], i) for i, r in enumerate(rows)], SCHEMA + ", seq int")


def test_type2(spark):
    res = M.scd2_merge(_source(spark), _target(spark), ["ID"], TS, order_by=["seq"])
    rows = {(r.ID, r.NAME, r.CURFLG): r for r in res.target.collect()}
    assert ("a" in [k[1] for k in rows if k[0] == 1 and k[2] == "N"])
    assert rows[(1, "b", "Y")].SKEY > 3                       # new version, new key
    assert str(rows[(1, "a", "N")].TODT) == "2024-01-30 00:00:00"
    assert rows[(1, "b", "Y")].FROMDT == rows[(1, "a", "N")].TODT   # periods meet
    assert (2, "x", "Y") in rows                                # target only kept
    assert (3, "c", "N") in rows and (3, "c", "Y") in rows     # closed only -> new current row
    assert (4, "q", "Y") in rows and (4, "p", "Y") not in rows # duplicate in batch: last by order
    assert (5, "new", "Y") in rows
    c = res.counters()
    assert c["error_rows"] == 1 and c["duplicates"] == 1 and c["source_rows"] == 6
    assert c["expired"] == 1 and c["inserted"] == 4
    skeys = [r.SKEY for r in res.target.collect()]
    assert len(skeys) == len(set(skeys))
    assert res.errors.count() == 1
    assert [(r.ID, r.NAME) for r in res.duplicates.collect()] == [(4, "p")]


def test_type1(spark):
    res = M.scd1_merge(_source(spark), _target(spark), ["ID"], TS, order_by=["seq"])
    rows = res.target.collect()
    one = [r for r in rows if r.ID == 1]
    assert len(one) == 1 and one[0].NAME == "b" and one[0].SKEY == 1
    assert str(one[0].RECCRDT) == "2024-01-01 00:00:00" and str(one[0].RECUPDT) == "2024-01-30 00:00:00"
    assert one[0].CURFLG == "Y"                                  # system columns never rewritten
    assert {r.NAME for r in rows if r.ID == 3} == {"c"} and len([r for r in rows if r.ID == 3]) == 2
    assert [r.NAME for r in rows if r.ID == 4] == ["q"]
    c = res.counters()
    assert c["updated"] == 1 and c["inserted"] == 3 and c["target_rows"] == 4


def test_unchanged_is_untouched(spark):
    tgt = _target(spark)
    res = M.scd2_merge(spark.createDataFrame([(1, "a")], SCHEMA), tgt, ["ID"], TS)
    assert sorted(map(tuple, res.target.collect())) == sorted(map(tuple, tgt.collect()))
    assert res.counters()["unchanged"] == 1


def test_fact_merge_has_no_validity(spark):
    src = spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA)
    tgt = M.initial_load(src, ["ID"], T0, kind=M.FCT).target
    assert "CURFLG" not in tgt.columns
    out = M.fact_merge(spark.createDataFrame([(2, "c"), (3, "d")], SCHEMA), tgt, ["ID"], TS).target
    got = sorted((r.ID, r.NAME, r.SKEY) for r in out.collect())
    assert got == [(1, "a", 1), (2, "c", 2), (3, "d", 3)]


def test_type2_keeps_columns_the_source_does_not_map(spark):
    tgt = M.initial_load(spark.createDataFrame([(1, "a", "keep")], "ID long, NAME string, NOTE string"), ["ID"], T0).target
    res = M.scd2_merge(spark.createDataFrame([(1, "b"), (2, "c")], SCHEMA), tgt, ["ID"], TS)
    rows = {(r.ID, r.CURFLG): r for r in res.target.collect()}
    assert rows[(1, "Y")].NAME == "b" and rows[(1, "Y")].NOTE == "keep"
    assert rows[(2, "Y")].NOTE is None and rows[(1, "N")].NOTE == "keep"


def test_two_current_rows_of_a_key_do_not_multiply(spark):
    tgt = _target(spark)
    tgt = tgt.unionByName(tgt.filter("ID = 1").withColumn("SKEY", F.lit(90).cast("long")))
    for merge in (M.scd1_merge, M.scd2_merge):
        res = merge(spark.createDataFrame([(1, "b")], SCHEMA), tgt, ["ID"], TS)
        c = res.counters()
        assert c["source_rows"] == 1 and c["new_keys"] == 0
        assert res.target.filter("ID = 1 AND NAME = 'b'").count() == (2 if merge is M.scd1_merge else 1)
