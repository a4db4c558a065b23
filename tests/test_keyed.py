from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from marketloom.operators import keyed

SCHEMA = "k string, at int, raw_record_id string, odds double, capture string, tab string, instance string, visible boolean"


def plain_fold(rows):
    """The fold in plain Python, row by row."""
    kept: dict = {}
    for k, at, rid, odds, cap, tab, inst, vis in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        new = {"at": at, "id": rid, "odds": odds, "cap": cap, "tab": tab, "inst": inst, "vis": vis, "ids": [rid], "n": 1}
        if k not in kept:
            kept[k] = new | {"conflicts": 0}
            continue
        s = kept[k]
        if odds == s["odds"]:
            ids, n = list(dict.fromkeys([*s["ids"], rid])), s["n"] + 1
            kept[k] = ((new if at > s["at"] else s) | {"ids": ids, "n": n, "conflicts": s["conflicts"]})
        elif inst and inst == s["inst"] and vis != s["vis"]:
            kept[k] = new | {"conflicts": s["conflicts"]} if vis else s
        elif (cap and s["cap"] and cap != s["cap"]) or (not cap and not s["cap"] and tab != s["tab"]):
            kept[k] = new | {"conflicts": s["conflicts"]} if at > s["at"] else s
        else:
            kept[k] = s | {"conflicts": s["conflicts"] + 1}
    return {k: (s["id"], s["odds"], s["ids"], s["n"], s["conflicts"]) for k, s in kept.items()}


def test_fold_against_plain_python_in_any_order(spark):
    rng = random.Random(5)
    rows = [(f"k{rng.randrange(40)}", rng.randrange(6), f"r{i}", rng.choice([1.5, 2.0, 2.5]), rng.choice(["", "F", "O"]), rng.choice("AB"), rng.choice(["", "i1"]), rng.random() < 0.7) for i in range(600)]
    want = plain_fold(rows)
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = keyed.fold_observations(spark.createDataFrame(rows, SCHEMA).repartition(3), ["k"], "at").collect()
        assert {r["k"]: (r["raw_record_id"], r["odds"], r["lineage"], r["representations"], r["conflicts"]) for r in got} == want


def test_first_latest_and_ties(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", None, "z"), (None, 2, "n")], "k string, o int, v string")
    assert {(r["k"], r["v"]) for r in keyed.latest_by(rows, ["k"], ["o", "v"], ["v"]).collect()} == {("a", "y"), (None, "n")}
    assert {(r["k"], r["v"]) for r in keyed.first_by(rows, ["k"], ["o", "v"], ["v"]).collect()} == {("a", "z"), (None, "n")}


def test_division_gaps_bijection_and_algebra(spark):
    rows = spark.createDataFrame([("g", "m1", "k"), ("g", "m2", "k"), ("g", "m2", "j")], "g string, m string, s string")
    assert [r["s"] for r in keyed.common_keys(rows, "g", "m", "s").collect()] == ["k"]
    timeline = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("c", None)], "k string, n int")
    assert {r["k"]: r["complete"] for r in keyed.gapless(timeline, "k", "n").collect()} == {"a": True, "b": False, "c": False}
    pairs = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "l int, r string")
    assert [tuple(r) for r in keyed.not_one_to_one(pairs, "l", "r").collect()] == [("l", "1", 2)]
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "i string")
    got = keyed.id_algebra(ids("1", "2", "3"), ids("1", "2"), ids("2", "9"), "i").first()
    assert tuple(got) == (3, 2, 2, 1, 1, 1)
    assert tuple(keyed.id_algebra(*[spark.createDataFrame([], "i string")] * 3, "i").first()) == (0,) * 6


def test_occurrences_and_supersession(spark):
    left = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("j", 1, "c")], "k string, o int, x string")
    right = spark.createDataFrame([("k", 5, "A"), ("k", 4, "B")], "k string, p int, y string")
    assert {(r["x"], r["y"]) for r in keyed.nth_occurrence_join(left, right, ["k"], ["o"], ["p"]).collect()} == {("a", "B"), ("b", "A")}
    rows = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "i int, s int")
    assert [r["i"] for r in keyed.active_rows(rows, "i", "s").collect()] == [3]


def test_lineage_of_another_run_is_an_error(spark):
    rows = [("k", 1, "a", 2.0, "", "A", "", True, "r1"), ("k", 2, "b", 2.0, "", "A", "", True, "r2")]
    df = spark.createDataFrame(rows, SCHEMA + ", run string")
    assert keyed.fold_observations(df, ["k"], "at").first()["lineage"] == ["a", "b"]
    with pytest.raises(Exception, match="lineage of another run"):
        keyed.fold_observations(df, ["k"], "at", ["run"]).collect()
    same = df.withColumn("run", F.when(F.col("raw_record_id") == "a", F.col("run")))
    assert keyed.fold_observations(same, ["k"], "at", ["run"]).first()["lineage"] == ["a", "b"]


def test_hot_keys_are_numbered_in_ranges(spark, monkeypatch):
    rows = spark.createDataFrame([("hot" if i % 3 else None, (i * 37) % 101, i) for i in range(400)] + [("cool", 1, 9_000)], "k string, o int, x int")
    plain = {(r["x"], r["n"]) for r in keyed.numbered(rows, ["k"], ["o", "x"], "n").collect()}
    monkeypatch.setattr(keyed, "HOT_ROWS", 50)
    assert {(r["x"], r["n"]) for r in keyed.numbered(rows, ["k"], ["o", "x"], "n").collect()} == plain
    everywhere = sorted((r["o"], r["x"], r["n"]) for r in keyed.numbered(rows, [], ["o", "x"], "n").collect())
    assert [n for *_, n in everywhere] == list(range(1, 402))


def test_chains_of_any_length_and_cycles(spark):
    rows = [(i, i - 1 if i else None) for i in range(300)] + [(1_000, 1_001), (1_001, 1_000), (1_002, 1_000), (2_000, 5_555)]
    got = {r["row"]: r for r in keyed.chain_ends(spark.createDataFrame(rows, "i int, b int"), "i", "b").collect()}
    assert all(got[i]["root"] == 0 and got[i]["steps"] == i and not got[i]["cyclic"] for i in range(300))
    assert got[1_000]["cyclic"] and got[1_002]["cyclic"] and not got[2_000]["cyclic"] and got[2_000]["root"] == 2_000


def test_values_told_by_evidence(spark):
    rows = spark.createDataFrame([(1, "a", None, "r"), (2, "a", "FT", "r"), (3, "b", None, "r"), (4, "c", "H1", "r"), (5, None, None, "r"), (6, "d", "UNKNOWN", None), (7, "a", None, "q")], "i int, link string, p string, run string")
    told = spark.createDataFrame([("a", "FT", "r"), ("a", "FT", "r"), ("a", "H1", "x"), ("b", "FT", "r"), ("b", "H1", "r"), ("c", "FT", "r"), ("d", "H1", None), ("d", None, None), (None, "FT", "r"), ("d", "UNKNOWN", None)], "link string, p string, run string")
    got = {r["i"]: (r["p"], r["state"], r["foreign"]) for r in keyed.resolved_by_evidence(rows, told, "i", "link", "p", ["run"], "UNKNOWN").collect()}
    assert got == {
        1: ("FT", "RESOLVED", 1), 2: ("FT", "PRESERVED", 1), 3: ("UNKNOWN", "EVIDENCE_CONFLICT", 0), 4: ("H1", "CONFLICT", 0), 5: ("UNKNOWN", "NO_EVIDENCE", 0), 6: ("H1", "RESOLVED", 0), 7: ("UNKNOWN", "NO_EVIDENCE", 3),
    }
    assert keyed.resolved_by_evidence(rows.where("false"), told, "i", "link", "p", ["run"], "UNKNOWN").count() == 0
