"""Small hand-built cases for operators whose catalogue queries bind them to the supplied tables."""

import datetime as dt

from pyspark.sql import functions as F

from wareloom.operators import catalogue as CT
from wareloom.operators import filters as FL
from wareloom.operators import incremental as INC
from wareloom.operators import joins as J
from wareloom.operators import quality as Q
from wareloom.operators import reports as RP
from wareloom.types import resolve


def test_type_codes():
    assert resolve("String50").length == 50 and resolve("Numeric5").dtype.simpleString() == "decimal(5,0)"
    assert resolve("Money18").dtype.simpleString() == "decimal(18,6)"
    assert resolve("INTEGER(12)").dtype.simpleString() == "bigint" and resolve("INTEGER").dtype.simpleString() == "bigint"
    assert resolve("INTEGER(5)").dtype.simpleString() == "int"
    assert resolve("DECIMAL(10,3)").dtype.simpleString() == "decimal(10,3)"
    assert resolve(None).length == 255 and resolve("timestamp").dtype.simpleString() == "timestamp_ntz"


def test_catalogue_preference_and_missing(spark):
    rows = [("Datatype", "DATE", "", "DATE", "POSTGRESQL", "Y"), ("Datatype", "DATE", "", "DATE", "GENERIC", "Y"),
            ("Datatype", "INT", "", "INT", "GENERIC", "Y"), ("Datatype", "JSON", "", "JSONB", "POSTGRESQL", "N")]
    cat = spark.createDataFrame(rows, CT.CATALOGUE_SCHEMA)
    pref = {r.prcd: r.dbtyp for r in CT.catalogue_for(cat, "postgresql").collect()}
    assert pref == {"DATE": "POSTGRESQL", "INT": "GENERIC"}
    miss = {r.prcd: r.priority for r in CT.missing_types(cat, "POSTGRESQL").collect()}
    assert miss == {"INT": "HIGH"}
    clone = {r.prcd: (r.prval, r.action) for r in CT.clone_catalogue(cat, "POSTGRESQL").collect()}
    assert clone == {"DATE": ("DATE", "SKIPPED"), "INT": ("INTEGER", "CREATED")}


def test_resume_strategies(spark):
    df = spark.range(1, 11).select(F.col("id").alias("k"), (F.col("id") % 3).alias("j"))
    assert INC.resume_after(df, ["k"], "7").count() == 3
    assert INC.resume_after(df, ["k", "j"], "7|0").count() == 4          # (7,1) and 8, 9, 10
    assert INC.resume_after(df, ["k", "j"], "7").count() == 10           # wrong part count: all
    assert INC.resume(df, ["k"], INC.ResumeState("AUTO", "7", status="COMPLETED")).count() == 10
    assert INC.resume(df, None, INC.ResumeState("AUTO", rows_done=4), order_by=["k"]).agg(F.min("k")).first()[0] == 5
    assert INC.high_water(df, ["j", "k"]).first()["mark"] == "2|8"


def test_periods_and_filters(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, d, 12),) for d in (1, 24, 29, 30)], "ts timestamp_ntz")
    as_of = "2024-01-30 08:00:00"
    assert FL.in_period(df, "ts", "DAY", as_of).count() == 1
    assert FL.in_period(df, "ts", "WEEK", as_of).count() == 3
    assert FL.in_period(df, "ts", "ALL", as_of).count() == 4
    assert FL.in_period(df, "ts", None, as_of, days=1).count() == 2


def test_interval_join_edges(spark):
    left = spark.createDataFrame([(1, "j", dt.datetime(2024, 1, 1, 10, 0))], "rid int, k string, t timestamp_ntz")
    right = spark.createDataFrame([(i, "j", dt.datetime(2024, 1, 1, 9, 0) + dt.timedelta(minutes=30 * i)) for i in range(6)]
                                  + [(9, "x", dt.datetime(2024, 1, 1, 10, 0))], "pid int, k string, s timestamp_ntz")
    got = sorted(r.pid for r in J.match_within(left, right, "k", "t", "s", 3600).collect())
    assert got == [0, 1, 2, 3, 4]            # 09:00 … 11:00 inclusive, other key excluded


def test_report_group_rule():
    import pytest
    with pytest.raises(RP.ReportError):
        RP.check_group_rule([{"fieldName": "a", "sourceColumn": "a", "isGroupBy": True},
                             {"fieldName": "b", "sourceColumn": "b"}])


def test_run_summary_statuses(spark):
    ok = spark.createDataFrame([(1,)], "x int")
    bad = spark.createDataFrame([(2, "second"), (1, "first")], "rwndx long, errmsg string")
    r = Q.run_summary(ok, bad).first()
    assert (r.status, r.rows_failed, r.message) == ("PARTIAL", 2, "first")
    assert Q.run_summary(ok.limit(0), bad).first().status == "FAILED"
    assert Q.run_summary(ok, bad.limit(0)).first().status == "SUCCESS"
