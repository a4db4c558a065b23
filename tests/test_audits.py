"""Edge cases of accounting, price comparison and ledgers: nulls, ties, empty tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marketloom.operators import accounting, ledgers, pricing
from marketloom.sources import lines, pages

PRICES = "e string, s string, r string, m string, c string, o double, i int"


def better(spark, rows):
    df = spark.createDataFrame(rows, PRICES)
    return sorted((x["s"], x["r"], x["best_odds"], x["copy_no"], x["o"]) for x in pricing.better_prices(df, "e", "s", "r", "m", "c", "o", "i", "EXACT").collect())


def test_better_prices(spark):
    group = [("e", "a", "EXACT", "m1", "c", 2.0, 1), ("e", "a", "EXACT", "m2", "c", 1.9, 2), ("e", "a", "EXACT", "m3", "c", None, 3), ("e", "a", "EXACT", "m2", "c", 1.9, 4)]
    assert better(spark, group) == [("a", "EXACT", 2.0, 1, 1.9), ("a", "EXACT", 2.0, 2, 1.9)]
    again = [(e, "b", "WIN", m, c, o, i) for e, _, _, m, c, o, i in group]
    assert better(spark, group + again) == better(spark, group)  # the very same rows under a later signature
    far = [("e", "z", "EXACT", "m1", "c", 9.0, 1), ("e", "z", "EXACT", "m2", "c", 2.0, 2), ("e", "y", "WIN", "m1", "c", 9.0, 8), ("e", "y", "WIN", "m2", "c", 2.0, 9)]
    assert [x[0] for x in better(spark, far)] == ["y"]
    assert better(spark, []) == [] and better(spark, group[:1]) == []


def test_fitted_rates(spark):
    rows = [("k", 2.0, 1.0, "a"), ("k", 2.2, 1.0, "b"), ("k", 9.0, 0.05, "c"), ("k", None, 1.0, "d"), ("one", 3.0, 1.0, "a"), ("none", None, 1.0, "a")]
    got = {x["k"]: x for x in pricing.fitted_rates(spark.createDataFrame(rows, "k string, rate double, w double, t string"), "k", "rate", "w", ["t"]).collect()}
    assert set(got) == {"k", "one"} and got["k"]["rate"] == 2.2 and abs(got["k"]["dispersion"] - 0.2) < 1e-9 and got["k"]["confidence"] == "MEDIUM"
    assert got["one"]["confidence"] == "LOW" and got["one"]["residual"] == 0


def test_shares_states_and_errors(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert [one(accounting.share(F.lit(a), F.lit(b))) for a, b in ((1, 0), (-3, 4), (9, 4), (1, 3))] == [100.0, 0.0, 100.0, 33.3]
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    state = lambda s, m, e, n: one(accounting.whole_state(arr(*s), arr(*m), F.lit(e), F.lit(n)))
    assert [state([], [], 0, 0), state(["PASS"], [], 1, 1), state(["PASS"], ["t"], 2, 1), state(["PASS", "FAIL"], ["t"], 2, 2), state(["PASS"], [], 3, 1), state(["PARTIAL"], [], 1, 1)] == ["FAIL", "PASS", "PARTIAL", "FAIL", "PARTIAL", "PARTIAL"]
    rows = spark.createDataFrame([("k", "A:1:x"), ("k", "A:2:x"), ("k", "A:3"), ("k", "B:1"), ("k", "B:1"), ("k", None), ("k", "A")], "k string, e string")
    assert sorted(x["e"] for x in accounting.collapsed_errors(rows, "k", "e", ["A"]).collect()) == ["A", "A:COUNT=1", "A:x:COUNT=2", "B:1"]


def test_appends_and_revisions(spark):
    schema = "id int, t string, up int"
    old = spark.createDataFrame([(1, "a", None), (2, "a", 1), (5, "c", 6), (6, "c", 5)], schema)
    new = spark.createDataFrame([(3, "a", 2), (4, "a", None), (2, "a", 2), (7, "b", None), (8, "x", None), (9, "b", 1), (10, "a", 99), (11, "c", 5)], schema)
    got = {x["id"]: x["fault"] for x in ledgers.append_faults(old, new, spark.createDataFrame([("a",), ("b",), ("c",)], "t string"), "id", "t", "up").collect()}
    assert got == {3: "", 4: "ACTIVE_DECISION", 2: "EXISTS", 7: "", 8: "UNKNOWN_TARGET", 9: "BAD_SUPERSESSION", 10: "BAD_SUPERSESSION", 11: "CYCLE"}
    rows = [("k", 1, "h1", None), ("k", 2, "h2", "h1"), ("k", 3, "h3", "zz"), ("k", 5, "h5", "h4"), ("j", 1, "h", "x"), ("j", 0, "h", None), ("i", 1, "h", None), ("i", 1, "g", None), ("h", 2, "h", None)]
    faults = {(x["k"], x["n"]): x["fault"] for x in ledgers.revision_faults(spark.createDataFrame(rows, "k string, n int, h string, s string"), "k", "n", "h", "s").collect()}
    assert faults == {("k", 1): "", ("k", 2): "", ("k", 3): "PRIOR_MISMATCH", ("k", 5): "PRIOR_MISSING", ("j", 1): "INITIAL_SUPERSEDES", ("j", 0): "INVALID", ("i", 1): "REPEATED", ("h", 2): "PRIOR_UNNAMED"}


def test_timelines(spark):
    outcomes = spark.createDataFrame([("a",), ("b",), ("c",), ("c",), ("d",)], "k string")
    events = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 3), ("c", 1), ("z", 1)], "k string, n int")
    got = {x["k"]: x["fault"] for x in ledgers.timeline_faults(outcomes, events, "k", "n").collect()}
    assert got == {"a": "", "b": "SEQUENCE_GAP", "c": "REPEATED_OUTCOME", "d": "", "z": "FOREIGN_EVENTS"}


def test_lines_and_ledgers_on_disk(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    assert lines.write_json_lines(rows, str(tmp_path / "l"))["state"] == "PASS"
    with pytest.raises(Exception, match="already exists"):
        lines.write_json_lines(rows, str(tmp_path / "l"))
    assert lines.write_json_lines(rows.where("false"), str(tmp_path / "e"))["rows"] == 0
    assert lines.read_ledger(spark, str(tmp_path / "absent"), rows.schema).count() == 0
    assert sorted(map(tuple, lines.read_ledger(spark, str(tmp_path / "l"), rows.schema).collect())) == [(1, "a"), (2, None)]
    (tmp_path / "bad.jsonl").write_text('{"i": 1}\n[1]\n')
    with pytest.raises(ValueError, match="no object"):
        lines.read_ledger(spark, str(tmp_path / "bad.jsonl"), rows.schema)
    path = str(tmp_path / "artifacts")
    assert [lines.append_artifacts(rows, path, "x") for _ in range(2)] == [2, 0] and lines.altered_artifacts(spark, path, "x").count() == 0


def test_pages_without_state_and_with_several():
    match = '{"matchId": 5, "contestants": [{"name": "A", "shortName": "a"}, {"name": "B"}]}'
    page = lambda body: f'<script id="ng-state">{body}</script>'
    assert pages.sides_of(page(match), "A", "B") == ("5", "a", "B") and pages.sides_of(page(match), "B", "A") is None
    assert pages.sides_of(page(f"[{match}, {match}]"), "A", "B") == ("5", "a", "B")
    assert pages.sides_of(page(f"[{match}, {match.replace('5', '6')}]"), "A", "B") is None and pages.sides_of(page(f"[{match}, {match.replace('5', '6')}]"), "A", "B", "6") == ("6", "a", "B")
    assert [pages.sides_of(p, "A", "B") for p in (None, "", page("{"), page(match).replace("ng-state", "other"), page('{"matchId": 1, "contestants": [1, 2]}'))] == [None] * 5
