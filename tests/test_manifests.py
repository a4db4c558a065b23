from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.operators import manifests

SCHEMA = "run string, id string, at int, raw string"
ROWS = [("r", "a", 1, "x"), ("r", "b", 2, "x"), ("r", "b", 2, "x"), ("q", "a", 1, None), (None, "a", 1, "y")]


def built(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return manifests.run_manifests(manifests.fingerprinted(df, ["raw"], ["id", "at"]), "run", "at")


def test_counts_and_order(spark):
    got = {r["run"]: r for r in built(spark, ROWS).collect()}
    r = got["r"]
    assert (r["stored"], r["occurrences"], r["contents"], r["repeated_contents"], r["cutoff"]) == (3, 2, 1, 1, 2)
    again = {x["run"]: x["digest"] for x in built(spark, ROWS[::-1]).repartition(3).collect()}
    assert again == {k: v["digest"] for k, v in got.items()}
    assert built(spark, ROWS).where("false").count() == 0


def test_tampering_is_found(spark):
    known = built(spark, ROWS[:4])
    assert manifests.altered(known, built(spark, ROWS[:4]), "run").count() == 0
    changed = built(spark, [("r", "a", 1, "X"), *ROWS[1:3], ("new", "a", 1, "x")])
    assert {tuple(r) for r in manifests.altered(known, changed, "run").collect()} == {("r", "altered"), ("q", "missing"), ("new", "unknown")}


def test_containment_and_exactly_one(spark):
    a = spark.createDataFrame([("g", "1"), ("g", "2"), ("h", "1"), ("i", None)], "g string, m string")
    b = spark.createDataFrame([("x", "1"), ("x", "2"), ("y", "1"), ("y", "1")], "o string, m string")
    assert {tuple(r) for r in manifests.contained(a, b, "g", "o", "m").collect()} == {("g", "x"), ("h", "x"), ("h", "y")}
    one, several = manifests.exactly_one(b, "o")
    assert one.count() == 0 and {r["o"]: r["n"] for r in several.collect()} == {"x": 2, "y": 2}


def test_artifacts_and_nested_values(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    assert manifests.artifact_hashes(spark, str(tmp_path / "*.bin")).first()["sha256"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    rows = spark.range(1).select(F.array(F.struct(F.lit(1).alias("x"), F.lit("old").alias("h"))).alias("e"), F.lit("new").alias("hash"))
    assert manifests.with_nested_value(rows, "e", "h", "hash").first()["e"][0]["h"] == "new"
