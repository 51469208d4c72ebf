import json
import os

from wareloom.sources import readers as RD
from wareloom.sources import sinks as SK


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_delimiter_sniffing_and_bad_lines(spark, tmp_dir):
    for sep in ["\t", ",", ";", "|"]:
        p = _write(os.path.join(tmp_dir, f"f{ord(sep)}.csv"), f"a{sep}b\n1{sep} x \n2{sep}\n3{sep}y{sep}extra\n")
        df = RD.read_delimited(spark, p)
        rows = sorted(tuple(r) for r in df.collect())
        assert df.columns == ["a", "b"]
        assert rows == [("1", " x "), ("2", None)] and df.count() == 2     # the line with three fields is set aside
        assert [r["line"] for r in RD.read_delimited_checked(spark, p)[1].collect()] == [f"3{sep}y{sep}extra"]


def test_short_lines_are_kept_whatever_is_read(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "s.csv"), 'k,Net Price,n\n1,2,3\n4\n5,6,7,8,9\n"a,b",1,2\n')
    df = RD.read_delimited(spark, p)
    assert df.count() == 3 and sorted(r["k"] for r in df.select("k").collect()) == ["1", "4", "a,b"]
    assert sorted((r["k"], r["n"]) for r in df.collect()) == [("1", "3"), ("4", None), ("a,b", "2")]


def test_header_names_with_blanks_and_data_equal_to_the_header(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "h.txt"), "T\nk,Net Price\n1,2\nk,Net Price\n")
    df = RD.parse_lines(RD.skip_rows(RD.numbered_lines(spark, p), header=1))
    assert df.columns == ["k", "Net Price"] and sorted(tuple(r) for r in df.collect()) == [("1", "2"), ("k", "Net Price")]


def test_json_flatten(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "n.json"), json.dumps([{"k": 1, "a": {"b": 2, "c": {"d": "x"}}, "l": [1, 2]}]))
    df = RD.read_json_flat(spark, p)
    assert sorted(df.columns) == ["a.b", "a.c.d", "k", "l"]
    r = df.first()
    assert r["a.b"] == 2 and r["a.c.d"] == "x" and list(r["l"]) == [1, 2]
    one = _write(os.path.join(tmp_dir, "o.json"), '{\n "k": 1,\n "a": {"b": 2}\n}\n')
    assert RD.read_json_flat(spark, one).first()["a.b"] == 2


def test_xml_modes(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "r.xml"),
               '<Report><Row id="1"><name>a</name><v><w>9</w></v></Row><Row id="2"><name>b</name><v><w>8</w></v></Row></Report>')
    assert RD.detect_row_tag(spark, p) == "Row"
    assert sorted(r["name"] for r in RD.read_xml(spark, p).collect()) == ["a", "b"]
    assert sorted(r["id"] for r in RD.read_xml(spark, p, attribute_mode=True).collect()) == ["1", "2"]
    assert sorted(r["w"] for r in RD.read_xml(spark, p, "Row", columns={"w": "v/w"}).collect()) == ["8", "9"]


def test_header_footer_skip_per_file(spark, tmp_dir):
    d = os.path.join(tmp_dir, "rep")
    for i in range(3):
        _write(os.path.join(d, f"p{i}.txt"), f"TITLE {i}\n=====\nk,v\n{i},a\n{i},b\nTotal: 2\nPage {i}\n")
    lines = RD.skip_rows(RD.numbered_lines(spark, d), header=2, footer=2)
    df = RD.parse_lines(lines)
    assert sorted(tuple(r) for r in df.collect()) == [(str(i), x) for i in range(3) for x in "ab"]
    pat = RD.skip_matching(RD.numbered_lines(spark, d), r"^(TITLE \d|=+)$", r"^(Total:|Page ).*")
    assert RD.parse_lines(pat).count() == 6


def test_export_and_manifest(spark, tmp_dir):
    df = spark.createDataFrame([(1, "a b", None)], "id int, `the name` string, n string")
    out = SK.export(df, ["csv", "XML", "Csv", "json", "txt", "parquet"], os.path.join(tmp_dir, "exp"))
    assert list(out) == ["CSV", "XML", "JSON", "TXT", "PARQUET"]
    xml = "".join(open(os.path.join(out["XML"], f)).read() for f in os.listdir(out["XML"]) if f.startswith("part"))
    assert "<Report>" in xml and "<the_name>a b</the_name>" in xml
    m = SK.manifest(spark, os.path.join(tmp_dir, "exp")).collect()
    assert {r.format for r in m} == {"CSV", "XML", "JSON", "TXT", "PARQUET"}
    assert all(len(r.sha256) == 64 and r.bytes > 0 for r in m)


def test_snapshot_table_idempotent(spark, tmp_dir):
    t = SK.SnapshotTable(spark, os.path.join(tmp_dir, "snap"))
    assert t.commit(spark.range(3), 0) is True
    assert t.commit(spark.range(5), 0) is False
    assert t.commit(spark.range(7), 1) is True
    assert t.latest_version() == 1 and t.read().count() == 7 and t.read(0).count() == 3


def test_number_in_file_order(spark, tmp_dir):
    d = os.path.join(tmp_dir, "many")
    for i in range(3):
        _write(os.path.join(d, f"f{i}.csv"), "k\n" + "".join(f"{i}-{j}\n" for j in range(4)))
    df = spark.read.option("header", "true").csv(d)
    got = sorted((r.row_index, r.k) for r in RD.number_in_file_order(df).collect())
    assert [g[0] for g in got] == list(range(1, 13))
    assert [g[1] for g in got] == [f"{i}-{j}" for i in range(3) for j in range(4)]
