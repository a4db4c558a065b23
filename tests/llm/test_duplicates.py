from __future__ import annotations

import random

from pyspark.sql import functions as F

from marketloom.llm import duplicates
from marketloom.llm.duplicates import copy_counts, duplicate_groups, plain
from marketloom.operators.packed import HEADING_PATH

SCHEMA = "obs_id bigint, run_id string, market string, selection string, odds string, heading_path string, keep_id string"


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in duplicate_groups(df, "obs_id", "run_id", ["market", "selection"], ["odds"], {"heading_path": HEADING_PATH}).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_formatting_is_hidden_and_meaning_is_not(spark):
    rows = [
        (1, "r", "Suma  bramek", "Over -1.5", "2.50", "A > B", None), (2, "r", "(SUMA BRAMEK)!", "over  -1,5", "2,5", '"B" | A', None), (3, "r", "Suma bramek", "Over +1.5", "2.5", "A > B", None),
        (4, "r", "Suma bramek", "Over 1.5", "2.5", "A > B", None), (5, "r", "Suma bramek", "Over 15", "2.5", "A > B", None), (6, "q", "Suma bramek", "Over -1.5", "2.5", "A > B", None),
        (7, "r", "Suma bramek", "Over -1.5", "2.51", "A > B", None), (8, "r", "Suma bramek", "Over -1.5", "2.5", "A > B > B", None), (9, "r", "Suma-bramek", "Over (-1.5)", " 2.500 ", "b » a »", None),
        (10, None, None, "", None, None, "x"), (11, "", "  ", None, "", "> ", "y"), (12, "r", "x", "-", "n/a", None, None), (13, "r", "X", "", "N A", "", None),
    ]
    assert found(spark, rows) == {(1, 2), (1, 9), (10, 11), (12, 13)}


def test_hot_group_long_text_and_empty(spark):
    rng = random.Random(1)
    rows = [(i, "r", rng.choice(["Hot!", "hot", " HOT "]), "s", "2.0", "A > B", None) for i in range(300)] + [(1000 + i, "r", "m" * 50_000 + "." * i, "s", "2.0", " > ".join(f"h{j}" for j in range(300)), None) for i in range(2)]
    got = found(spark, rows)
    assert got == {(0, i) for i in range(1, 300)} | {(1000, 1001)}
    assert {r["copies"] for r in copy_counts(spark.createDataFrame(list(got), "keep_id bigint, copy_id bigint")).collect()} == {300, 2}
    assert found(spark, [(None, "r", "a", "b", "1", "c", None)] * 2) == set()


def test_equal_fingerprints_of_unequal_fields_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "_sum_of", lambda name, values, seed: F.lit(0).cast("bigint"))
    rows = [(1, "r", "m", "s", "2", "A", None), (2, "r", "m", "s", "2", "B", None), (3, "r", "m", "s", "2", "b", None), (4, "r", "m", "s", "2", "A", None)]
    assert found(spark, rows) == {(1, 4), (2, 3)}


def test_plain(spark):
    rows = spark.createDataFrame([("2. połowa – 1.5, x",), ("A³ +2 4+ 2-3",), (None,)], "t string")
    got = [r["p"] for r in rows.select(plain(F.col("t")).alias("p")).collect()]
    assert got[0].replace("", ".") == "2połowa1.5x" and got[2] == ""
    assert got[1].replace("", "+") == "a³+2423"


def test_hot_groups_are_dealt_and_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "HOT_MEMBERS", 7)
    monkeypatch.setattr(duplicates, "BROADCAST_ROWS", 0)
    rows = [(i, "r", "Hot!" if i % 2 else "hot", "s", "2.0", " > ".join(f"h{(j + i) % 150}" for j in range(150)), None) for i in range(60)] + [(100 + i, "r", f"m{i}", "s", "2.0", "A", None) for i in range(5)]
    assert found(spark, rows) == {(0, i) for i in range(1, 60)}
    assert found(spark, [(1, "r", "m", "s", "2", "A", None)] * 2 + [(2, "r", "m", "s", "2", "A", None)]) == {(1, 2)}
