from __future__ import annotations

import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marketloom.operators import packed
from marketloom.operators.packed import DOM_PATH, HEADING_PATH, RECORD_IDS, Packing, _posteriors, _viterbi, arcs, atoms, spelled, split_packed

HOW = {"h": HEADING_PATH, "d": DOM_PATH, "r": RECORD_IDS}


def pieces(spark, rows, how=HOW):
    df = spark.createDataFrame(rows, "kind string, record_id bigint, text string")
    out: dict = {}
    for r in split_packed(df, how).orderBy("kind", "record_id", "pos").collect():
        out.setdefault((r["kind"], r["record_id"]), []).append(r["piece"])
    return out


def test_values_with_positions(spark):
    got = pieces(spark, [
        ("h", 1, 'A - x > "B > C"; D, e | f / g »'), ("h", 2, None), ("h", 3, "  "), ("h", 4, '> "Rynek ""Ekstra"" > s" → Gole'),
        ("h", 5, 'a "b > c" d > e'), ("h", 6, '"never closed > x'), ("h", 7, "A > A > A"),
        ("d", 1, 'x[#1]>y[a.b#0]/z[label="q / r"#0]|w'), ("d", 2, "x[#1]>y[a.b#0] > w"), ("d", 3, "x[#1]/w"),
        ("r", 1, '["run_1:2", "run_1:3"]'), ("r", 2, "run_1:2 run_1:3,run_1:2; run_1:9;"), ("r", 3, '"run_1:2";"run_1:3"'), ("r", 4, "[]"), ("r", 5, "run_1:2"),
    ])
    assert got == {
        ("h", 1): ["A - x", "B > C", "D, e", "f / g"], ("h", 4): ['Rynek "Ekstra" > s', "Gole"], ("h", 5): ['a "b > c" d', "e"],
        ("h", 6): ['"never closed', "x"], ("h", 7): ["A", "A", "A"],
        ("d", 1): ["x[#1]", "y[a.b#0]", 'z[label="q / r"#0]', "w"], ("d", 2): ["x[#1]", "y[a.b#0]", "w"], ("d", 3): ["x[#1]", "w"],
        ("r", 1): ["run_1:2", "run_1:3"], ("r", 2): ["run_1:2", "run_1:3", "run_1:2", "run_1:9"], ("r", 3): ["run_1:2", "run_1:3"], ("r", 5): ["run_1:2"],
    }


def test_long_text_and_empty_table(spark):
    text = " > ".join(f"v{i}" for i in range(20_000))
    assert len(pieces(spark, [("h", 1, text)])["h", 1]) == 20_000
    assert len(pieces(spark, [("h", 1, text), ("h", 2, '"v3 > v4"')])["h", 1]) == 19_999
    assert pieces(spark, [("h", 1, '"' + "x > " * 50_000 + '"')])["h", 1] == [("x > " * 50_000).strip()]
    assert pieces(spark, [("h", 1, None)]) == {}


def test_repeated_rows_and_repeated_ids(spark):
    assert pieces(spark, [("r", 1, "a b"), ("r", 1, "a b"), ("r", 2, "a")])["r", 1] == ["a", "a", "b", "b"]
    twice = pieces(spark, [("r", 1, "a b"), ("r", 1, "a b"), ("r", 2, '"a b"')])["r", 1]
    assert twice == ["a b", "a b"]


SINGLE = ["London", "Paris", "Wien", "Oslo", "Roma", "Bern", "Kyiv"]
JOINED = ["New York", "Los Angeles", "San Juan de Puerto Rico", "Rio de Janeiro", "Val di Fassa e di Fiemme"]


@pytest.mark.parametrize("others", [0, 3_000])
def test_separators_that_belong_to_values(spark, others):
    """A planted column: some values hold separators; they are quoted now and then, and else stand bare among the others."""
    rng, rows, want = random.Random(4), [], {}
    for i in range(600):
        values = rng.choices(SINGLE + JOINED, k=rng.randrange(1, 6))
        quote = lambda v: f'"{v}"' if " " in v and rng.random() < 0.1 else v
        rows.append(("c", i, " ".join(quote(v) for v in values)))
        want["c", i] = values
    rows += [("c", 1_000 + i, f"x{i} y{i}") for i in range(others)]
    got = pieces(spark, rows, {"c": Packing(" ")})
    joined = [k for k, v in want.items() if any(" " in x for x in v)]
    assert len(joined) > 300 and sum(got[k] == want[k] for k in joined) >= 0.9 * len(joined)
    assert all(got[k] == want[k] for k in want if k not in joined)
    assert all(len(got["c", 1_000 + i]) == 2 for i in range(others))


def test_atoms_that_are_values_of_their_own_part(spark):
    rows = [("h", i, "Gole > Kartki") for i in range(5)] + [("h", 10 + i, t) for i, t in enumerate(["Gole"] * 30 + ["Kartki > Rożne"] * 30 + ['"Gole > Kartki"'])]
    assert pieces(spark, rows)["h", 0] == ["Gole", "Kartki"]
    rows = [("h", 0, "Mecz > Rynek > Ekstra | Gole"), ("h", 1, '"Rynek > Ekstra" > Gole'), ("h", 2, "Mecz"), ("h", 3, "Gole")]
    assert pieces(spark, rows)["h", 0] == ["Mecz", "Rynek > Ekstra", "Gole"]


def lattice(counts, text, how):
    known = {spelled(v, how) for v in counts if len(atoms(v, how)) > 1}
    return [{"i": i, "j": j, "span": spelled(s, how), "said": s, "c": counts.get(spelled(s, how), 0.0)} for i, j, s in arcs(text, known, how)]


def best(spans):
    return list(next(_viterbi(iter([pd.DataFrame({"kind": ["r"], "id": ["x"], "parting": [0.9], "spans": [spans]})])))["values"][0])


@pytest.mark.parametrize("times", [1.0, 1e3, 1e11])
def test_size_of_the_column_has_no_part(times):
    seen = {"New York": 3 * times, "Paris": 40 * times, "London": 2 * times, "Paris London": times}
    assert best(lattice(seen, "Paris New York Paris London Wien", Packing(" "))) == ["Paris", "New York", "Paris", "London", "Wien"]
    assert best(lattice({"id1": 0.0}, "id1 id2 id3", RECORD_IDS)) == ["id1", "id2", "id3"]


def test_expectations_sum_to_the_atoms_of_the_text():
    spans = lattice({"a b": 9.0, "b c": 2.0, "a": 1.0, "a b c": 1.0}, "a b c d", Packing(" "))
    frame = pd.DataFrame({"kind": ["r"], "times": [7.0], "parting": [0.9], "spans": [spans]})
    got = next(_posteriors(iter([frame])))
    assert abs(got["c"].sum() + got["inside"].sum() - 28) < 1e-9 and got.loc[got["span"].isin(["a", "a b", "a b c"]), "c"].idxmax() == got.index[got["span"] == "a b"][0]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sampled_from(["a", "bc", '"q r"', "d1"]), min_size=1, max_size=6), st.sampled_from([" ", "  ", "\t", ", "]))
def test_atoms_round_trip(values, mark):
    text = mark.join(values)
    assert [text[i:j] for i, j in atoms(text, RECORD_IDS)] == values


def test_joined_by_shuffle_as_by_broadcast(spark, monkeypatch):
    rows = [("c", i, t) for i, t in enumerate(["London New York Paris", '"New York" Oslo', "Paris", "New York", "Oslo London", None, "New Paris"])]
    want = pieces(spark, rows, {"c": Packing(" ")})
    monkeypatch.setattr(packed, "BROADCAST_ROWS", 0)
    assert pieces(spark, rows, {"c": Packing(" ")}) == want and want["c", 0] == ["London", "New York", "Paris"] and want["c", 6] == ["New", "Paris"]
