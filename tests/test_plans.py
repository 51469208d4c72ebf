"""Physical-plan properties the operators rely on at scale."""

from pyspark.sql import functions as F

from conftest import SF001

import __spark_entry__ as E


def _plan(df) -> str:
    jvm = df.sparkSession._jvm
    return df._jdf.queryExecution().explainString(
        jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_resume_predicate_reaches_the_scan(spark):
    p = _plan(E.queries()["resume_composite"](spark, SF001))
    assert "PushedFilters: [Or(GreaterThan(l_orderkey,5000),And(EqualTo(l_orderkey,5000),GreaterThan(l_linenumber,3)))]" in p


def test_target_lookup_reads_three_columns_and_current_rows(spark):
    p = _plan(E.queries()["classify_changes"](spark, SF001))
    assert "ReadSchema: struct<SKEY:bigint,c_custkey:bigint,RWHKEY:string,CURFLG:string>" in p
    assert "EqualTo(CURFLG,Y)" in p


def test_topk_limits_before_the_shuffle(spark):
    p = _plan(E.queries()["topk_per_group"](spark, SF001))
    assert p.count("WindowGroupLimit") >= 2 and "Partial" in p


def test_dedup_is_a_partial_aggregate(spark):
    from wareloom.operators.merge import dedup_last
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"), F.lit("x").alias("s"))
    p = _plan(dedup_last(df, ["k"], ["v"]))
    assert "partial_max" in p


def test_no_python_udfs_in_catalogue_queries(spark):
    q = E.queries()
    for name in ["scd2_customer", "job_overview", "report_grouped", "load_upsert", "formula_text", "exact_duplicates"]:
        p = _plan(q[name](spark, SF001))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name


def test_interval_join_is_an_equi_join_on_bucket(spark):
    p = _plan(E.queries()["interval_match"](spark, SF001))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
