import datetime as dt

from pyspark.sql import functions as F

from wareloom.functions import formulas as fx
from wareloom.functions.hashing import row_hash


def test_text_functions(spark):
    df = spark.createDataFrame([("a b c", None, "  x\t", "")], "s string, n string, p string, e string")
    r = df.select(
        fx.concat("s", "n", F.lit(1)).alias("c"), fx.coalesce("e", "n", "s").alias("co"),
        fx.split("s", " ", 1).alias("s1"), fx.split("s", " ", 5).alias("s5"), fx.split("s", " ", -1).alias("sl"),
        fx.split(F.lit("a.b"), ".", 1).alias("lit_delim"),
        fx.trim("p").alias("t"), fx.len_("n").alias("ln"), fx.substring("n", 0, 2).alias("sub_null"),
        fx.substring("s", 2, 3).alias("sub"), fx.replace("s", " ", "_").alias("rep"),
        fx.call("unknown", "s").alias("unk")).first()
    assert r.c == "a b c1" and r.co == "a b c" and r.s1 == "b" and r.s5 is None and r.sl == "c"
    assert r.lit_delim == "b" and r.t == "x" and r.ln == 0 and r.sub_null is None and r.sub == "b c"
    assert r.rep == "a_b_c" and r.unk is None


def test_numeric_functions(spark):
    df = spark.createDataFrame([(7, -3, 0, None, 2.675)], "a int, b int, z int, n int, d double")
    r = df.select(fx.modulo("a", "b").alias("m"), fx.modulo(F.lit(-7), F.lit(3)).alias("m2"),
                  fx.modulo("a", "z").alias("mz"), fx.divide("a", "z").alias("dz"), fx.divide("n", "b").alias("dn"),
                  fx.plus("a", "n").alias("p"), fx.times("a", "n").alias("t"), fx.round_("d", 2).alias("r"),
                  fx.round_(F.lit(2.5), 0).alias("r2"), fx.abs_("b").alias("ab")).first()
    assert r.m == -2 and r.m2 == 2 and r.mz is None and r.dz is None and r.dn == 0.0
    assert r.p == 7 and r.t == 0 and r.r == 2.68 and r.r2 == 2.0 and r.ab == 3.0


def test_row_hash_matches_python_rule(spark):
    import hashlib
    df = spark.createDataFrame([(1, "a", None, dt.datetime(2024, 1, 2, 3, 4, 5, 678))],
                               "ID long, NAME string, X string, TS timestamp_ntz")
    got = df.select(row_hash(df).alias("h")).first().h
    want = hashlib.md5("1|a|<NULL>|2024-01-02 03:04:05".encode()).hexdigest()
    assert got == want
    df2 = df.withColumn("RWHKEY", F.lit("x")).withColumn("SKEY", F.lit(9))
    assert df2.select(row_hash(df2).alias("h")).first().h == want      # system columns excluded


def test_widget_series_detects_numeric_text(spark):
    from wareloom.operators.reports import widget_series
    df = spark.createDataFrame([("a", "x", "12.5", 3), ("b", "y", "n/a", 4)], "l string, t string, v string, n int")
    rows = widget_series(df).collect()
    assert [(r.label, r.value) for r in rows] == [("a", 12.5), ("b", 0.0)]
