"""Column operators on values that a plain cast or trim gets wrong."""

import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F

from wareloom.functions import formulas as fx
from wareloom.operators import catalogue as CT
from wareloom.operators import columns as P
from wareloom.operators import reports as RP
from wareloom.sources.sinks import SnapshotTable


def test_any_white_space_is_stripped(spark):
    df = spark.createDataFrame([("\tab\n",), ("\t",), ("\u00a0x ",)], "v string")
    assert [r["v"] for r in df.select(P.clean_text(F.col("v")).alias("v")).collect()] == ["ab", None, "x"]


def test_intervals_and_nested_values_are_portable(spark):
    df = spark.createDataFrame([(dt.timedelta(seconds=150), (decimal.Decimal("1.50"), dt.date(2024, 1, 2)), [decimal.Decimal("2.5")])],
                               "i interval day to second, s struct<a:decimal(10,2),d:date>, l array<decimal(5,1)>")
    r = P.json_safe(df).first()
    assert r["i"] == 150.0 and tuple(r["s"]) == (1.5, "2024-01-02") and r["l"] == [2.5]


def test_mixed_types_in_coalesce_and_derive(spark):
    df = spark.createDataFrame([(None, "x"), (3, "y")], "n int, t string")
    assert [r["v"] for r in df.select(fx.coalesce_text("n", "t").alias("v")).collect()] == ["x", "3"]
    assert [r["d"] for r in P.derive(df, {"d": F.col("n") * 2}, {"d": "7"}).collect()] == [7, 6]


def test_type_matrix_covers_sized_families(spark):
    cat = spark.createDataFrame([("Datatype", c, c, c, "GENERIC", "Y") for c in ("Money12", "Date", "String4000", "Numeric5", "timestamp")], CT.CATALOGUE_SCHEMA)
    got = {r["prcd"]: r["prval"] for r in CT.clone_catalogue(cat, "ORACLE").collect()}
    assert got == {"Money12": "NUMBER(12,6)", "Date": "DATE", "String4000": "VARCHAR2(4000)", "Numeric5": "NUMBER(5)", "timestamp": "TIMESTAMP"}
    assert CT.suggest_types(cat, "MYSQL").count() == 5


def test_widgets_read_the_whole_query(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("label"), F.when(F.col("id") > 2000, "1").otherwise("x").alias("v"))
    assert RP.widget_kpi(RP.widget_series(df, None)).first()["kpi"] == 999.0
    assert RP.widget_series(df).count() == 20


def test_unreadable_state_is_an_error(spark, tmp_dir):
    t = SnapshotTable(spark, tmp_dir + "/t")
    assert t.latest_version() is None
    t.commit(spark.range(3), 1)
    t.log = "nosuchfs://x/log"                  # cannot be read, which is not the same as absent
    with pytest.raises(Exception):
        t.versions().collect()


def test_local_rows_stay_one_literal(spark):
    from wareloom.session import local_rows
    df = local_rows(spark, [(i, f"n{i}'\"", None) for i in range(5000)], "a long, b string, c int")
    assert df.count() == 5000 and df.where("a = 7").first()["b"] == "n7'\""
