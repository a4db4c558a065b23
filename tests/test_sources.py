from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from marketloom.sources.lines import append_new, packet_blocks, read_json_lines, read_packets, write_json_lines
from marketloom.sources.pages import dom_rows

SCHEMA = StructType([StructField("a", IntegerType()), StructField("b", StringType())])


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": "x"}\n\n[1]\n{"a": \n{"a": 2}\n')
    good, broken = read_json_lines(spark, str(tmp_path / "x.jsonl"), SCHEMA)
    assert {tuple(r) for r in good.collect()} == {(1, "x"), (2, None)}
    assert {r["line"] for r in broken.collect()} == {"[1]", '{"a": '}


def test_write_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, None)], "a int, b string")
    report = write_json_lines(rows, str(tmp_path / "out"))
    assert report["rows"] == 1 and report["state"] == "PASS" and report["digest"]
    with pytest.raises(Exception, match="exist"):
        write_json_lines(rows, str(tmp_path / "out"))


def test_append_only(spark, tmp_path):
    rows = spark.createDataFrame([("k", 2), ("k", 1), ("j", 3)], "k string, v int")
    path = str(tmp_path / "t")
    assert append_new(rows, path, "k") == 2 and append_new(rows, path, "k") == 0
    assert {tuple(r) for r in spark.read.parquet(path).select("k", "v").collect()} == {("k", 1), ("j", 3)}


def test_packets_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("1X2", 'a\n"b"', None)], "f string, s string, l string")
    block = packet_blocks(rows, "ODD", {"FAMILY": "f", "SELECTION": "s", "LINE": "l"}).first()["block"]
    (tmp_path / "p.txt").write_text(f"MATCH: A - B\nCOUNT: 1\n\n{block}\nUNRESOLVED{{\n  A=\"1\";\n  A=\"2\";\n}}\n")
    headers, blocks = read_packets(spark, str(tmp_path / "p.txt"))
    assert headers.first()["fields"] == {"MATCH": "A - B", "COUNT": "1"}
    got = [(r["position"], r["name"], r["fields"]) for r in blocks.orderBy("position").collect()]
    assert got == [(1, "ODD", {"FAMILY": "1X2", "SELECTION": "a\\n'b'", "LINE": ""}), (2, "UNRESOLVED", {"A": "2"})]


def test_priced_buttons(spark):
    page = "<main><h2>Total &amp; goals</h2><div><button>Over 2.5 <b>1,85</b></button><button hidden>Under 2.5 2.05</button><button>More</button></div><p></main><button>x 3.10"
    rows = spark.createDataFrame([(1, page), (2, None), (3, "")], "id int, html string")
    got = [tuple(r) for r in dom_rows(rows, "id", "html").orderBy("id", "at").collect()]
    assert [(r[0], r[1], r[3], r[4], r[5], r[6]) for r in got] == [(1, 0, "Total & goals", "Over 2.5", "1.85", True), (1, 1, "Total & goals", "Under 2.5", "2.05", False)]
    assert got[0][2] == "main[0]>div[0]>button[0]"


def test_reads_a_scan_as_pruned_and_pushed(spark, tmp_path):
    spark.range(10).select("id", F.lit("x").alias("s")).write.parquet(str(tmp_path / "q"))
    plan = spark.read.parquet(str(tmp_path / "q")).where("id > 3").select("id")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,3)]" in plan and "ReadSchema: struct<id:bigint>" in plan
