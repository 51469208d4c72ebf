"""Records that cross lines and file splits: against the csv module and Spark's own whole-file JSON reader."""

import csv
import json
import os
import random

import pytest

from wareloom.sources import readers as RD
from wareloom.sources import splits as SP

KEY = "spark.sql.files.maxPartitionBytes"


@pytest.fixture()
def small_splits(spark):
    before = spark.conf.get(KEY)
    spark.conf.set(KEY, "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set(KEY, before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def write_csv(path, rows, header):
    with open(path, "w", newline="") as f:
        w = csv.writer(f, lineterminator="\n")
        w.writerow(header)
        w.writerows(rows)


def some_value(rng):
    return rng.choice(["plain", "a,b", 'say ""x""', 'in "quotes" twice', "two\nlines", "\n\n", '"', '""', 'x,"\n,"y', "", "é\n中", " lead", "5 \" wide", "z" * 300 + "\n" + "q" * 900])


def test_quoted_records_against_the_csv_module(spark, tmp_dir, small_splits):
    rng = random.Random(3)
    os.makedirs(f"{tmp_dir}/in")
    want = []
    for n in range(3):
        rows = [(str(n * 1000 + i), some_value(rng), some_value(rng)) for i in range(150)]
        write_csv(f"{tmp_dir}/in/{n}.csv", rows, ["id", "a,\n1", "b"])
        want += [tuple(v or None for v in r) for r in rows]
    rows, rejects = RD.read_delimited_checked(spark, f"{tmp_dir}/in")
    assert rows.columns == ["id", "a,\n1", "b"]
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(want, key=str) and rejects.count() == 0
    assert SP.split_rows(spark, f"{tmp_dir}/in").rdd.getNumPartitions() > 20


def test_excess_fields_and_unclosed_quotes(spark, tmp_dir, small_splits):
    path = f"{tmp_dir}/x.csv"
    with open(path, "w") as f:
        f.write('\na,a,"b\nc"\n1,2\n3,4,5\n\n6,7,8,,,,,,,,,,,,,,,,,9\n10,11,12,,,,,\n"13",14,15,"16\n17"\n18," 19",20\n21,"never closed\n22,23,24\n')
    rows, rejects = RD.read_delimited_checked(spark, path)
    assert rows.columns == ["a", "a.1", "b\nc"]
    assert sorted(map(tuple, rows.collect())) == sorted([("1", "2", None), ("3", "4", "5"), ("10", "11", "12"), ("18", " 19", "20")])
    assert sorted(r["line"] for r in rejects.collect()) == sorted(['6,7,8,,,,,,,,,,,,,,,,,9', '"13",14,15,"16\n17"', '21,"never closed', '22,23,24'])


def test_without_quotes_the_scan_stays_a_file_scan(spark, tmp_dir):
    path = f"{tmp_dir}/y.csv"
    with open(path, "w") as f:
        f.write("k,v\n1,2\n3\n4,5,\n6,7,,,,,,,,,,,,x\n")
    rows, rejects = RD.read_delimited_checked(spark, path)
    assert sorted((r["k"], r["v"]) for r in RD.number_in_file_order(rows).collect()) == [("1", "2"), ("3", None), ("4", "5")]
    assert [r["line"] for r in rejects.collect()] == ["6,7,,,,,,,,,,,,x"]


def test_empty_and_header_only_files(spark, tmp_dir):
    for name, text in (("e.csv", ""), ("h.csv", '"a",b\n'), ("p.csv", "a,b\n")):
        with open(f"{tmp_dir}/{name}", "w") as f:
            f.write(text)
    assert RD.read_delimited(spark, f"{tmp_dir}/e.csv").count() == 0
    for name in ("h.csv", "p.csv"):
        rows = RD.read_delimited(spark, f"{tmp_dir}/{name}")
        assert rows.columns == ["a", "b"] and rows.count() == 0


def test_parse_lines_with_a_quoted_header(spark):
    lines = spark.createDataFrame([('"a,b",c',), ("1,2",), ('"x,y",3',), ("1,2,3",), ("4",)], "value string").coalesce(1)
    rows, rejects = RD.parse_lines_checked(lines, sep=",")
    assert rows.columns == ["a,b", "c"]
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([("1", "2"), ("x,y", "3"), ("4", None)], key=str)
    assert [r["line"] for r in rejects.collect()] == ["1,2,3"]


@pytest.mark.parametrize("indent", [None, 2])
def test_json_arrays_against_whole_files(spark, tmp_dir, small_splits, indent):
    rng = random.Random(5)
    os.makedirs(f"{tmp_dir}/j")
    for n in range(2):
        rows = [{"id": n * 1000 + i, "t": rng.choice(["}{", '"]["', "back\\", "\\\"}", "ü\n}", "", "x" * rng.randrange(900)]),
                 "o": {"p": [{"q": "}", "n": i}], "r": {"s": None if i % 3 else "{"}}, "l": []} for i in range(120)]
        with open(f"{tmp_dir}/j/{n}.json", "w") as f:
            json.dump(rows, f, indent=indent, ensure_ascii=n == 0)
    got, want = RD.read_json_array(spark, f"{tmp_dir}/j"), spark.read.option("multiLine", "true").json(f"{tmp_dir}/j")
    assert got.schema == want.schema
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    one = SP.split_rows(spark, f"{tmp_dir}/j/0.json", lineSep="}")
    assert one.rdd.getNumPartitions() > 10                        # one array file, read by many tasks
    assert sorted(RD.read_json_flat(spark, f"{tmp_dir}/j").columns) == ["id", "l", "o.p", "o.r.s", "t"]


def test_clashing_flattened_names(spark, tmp_dir):
    with open(f"{tmp_dir}/c.json", "w") as f:
        f.write('{"a":{"b":1},"a.b":2}\n{"a.b":3}\n')
    assert sorted(r[0] for r in RD.read_json_flat(spark, f"{tmp_dir}/c.json").collect()) == [1, 3]


def test_the_number_of_splits_does_not_grow_with_the_files(spark, tmp_dir):
    """Files of 20 times the size are cut into as many splits (before: splits of 4096 bytes at any size)."""
    from wareloom.plans import q_files
    before, n = spark.conf.get(KEY), {}
    for m in (10_000, 200_000):
        path = f"{tmp_dir}/{m}"
        spark.range(m).selectExpr("format_string('%039d', id)").repartition(2).write.text(path)
        with q_files._many_splits(spark, path):
            n[m] = SP.split_rows(spark, path).select("file", "block").distinct().count()
        assert spark.conf.get(KEY) == before
    assert 20 <= n[10_000] <= 40 and 20 <= n[200_000] <= 40
