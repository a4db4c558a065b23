from __future__ import annotations

import pytest

from marketloom.llm import names
from marketloom.llm.names import alignment, cleaned, given_of, link_names, linked_pairs, parse

SCHEMA = "record bigint, run string, names array<string>, scorer boolean"


@pytest.mark.parametrize(
    ("typed", "scorer", "want"),
    [
        ("Kowalkowski, Jan", False, ("player", "kowalkowski", "jan")),
        ("KOWALKOWSKI Jan", False, ("player", "kowalkowski", "jan")),
        ("[Tomek K. Kowalkowski trafi do siatki]…", True, ("player", "kowalkowski", "tomasz")),
        ("Kasia Wiśniarowska (GKS Foo)", True, ("player", "wisniarowska", "katarzyna")),
        ("(Bob Langstromer trafi do siatki)", True, ("player", "langstromer", "robert")),
        ("R.Langstromer", True, ("player", "langstromer", "r.")),
        ("Atl. Bradribratisza B", False, ("club", "bradribratisza", "")),
        ("Klub Sportowy Orkan Zawarakoice", False, ("club", "zawarakoice", "")),
        ("Zawarakoice", False, ("club", "zawarakoice", "")),
        ("Langstromer R", False, ("open", "langstromer", "r.")),
    ],
)
def test_parse(typed, scorer, want):
    got = parse(typed, scorer)
    assert (got["kind"], got["core"], got["with"]) == want


def test_sides_decoration_and_nothing():
    assert parse("FC Foobargrad U19", False)["side"] == "u19" and parse("Foobargrad (K)", False)["side"] == "k"
    assert cleaned("  * 'Foo  Bar'!… ") == "foo bar"
    assert parse("...", False) is None and parse("()", True) is None


def test_given_names():
    assert given_of("kstarzyna") == "katarzyna" and given_of("beto") == "roberto" and given_of("bob") == "robert" and given_of("langstromer") is None


def test_alignment_permits_initials_short_forms_and_any_order():
    assert alignment(["bob", "langstromer"], ["langstromer", "robert", "k"]) < 0.05
    assert alignment(["r.", "langstromer"], ["robert", "langstromer"]) < 0.1
    assert alignment(["robert", "langstromer"], ["anna", "langstromer"]) == 0.5


def classes(spark, rows):
    return {r["record"]: r["name_class"] for r in link_names(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_variants_link_and_namesakes_do_not(spark):
    players = [["Robert Langstromer", "R. Langstromer"], ["Langstromer, Bob", None], ["Rob Langstromer", "Langstromer R"], ["Robert Langstrmoer", "R.Langstromer"], ["Anna Langstromer", "A. Langstromer"]]
    rows = [(i, f"run{i}", n, False) for i, n in enumerate(players)]
    rows += [(10, "r1", ["robert langstromer trafi do siatki"], True), (11, "r2", ["R. Langstromer (FC X)"], True)]
    clubs = [["FC Meteor Wawerograd", "Wawerograd"], ["Wawergorad", None], ["Football Club Meteor Wawerograd II", "Wawerograd II"], ["Wawerograd (K)", None], ["Wawerograd", "FC Wawerograd"]]
    rows += [(20 + i, f"c{i}", n, False) for i, n in enumerate(clubs)]
    rows += [(30, "n", [None, None], False), (31, "n", ["", "…"], False), (32, "n", ["x" * 5000], False)]
    got = classes(spark, rows)
    assert len({got[i] for i in (0, 1, 2, 3, 10, 11)}) == 1
    assert got[4] != got[0]
    assert got[20] == got[21] == got[24] and len({got[20], got[22], got[23]}) == 3
    assert not {30, 31} & got.keys() and 32 in got


def test_given_names_that_no_list_has(spark):
    typed = ["Zinedin Belkadi", "Zinedine Belkadi", "Belkadi Zinedine", "Belkadi, Zinedine", "Sinedine Belkadi", "Z. Belkadi", "Ousmane Belkadi"]
    got = classes(spark, [(i, f"run{i}", [n], True) for i, n in enumerate(typed)])
    assert len({got[i] for i in range(6)}) == 1 and got[6] != got[0]
    got = classes(spark, [(0, "a", ["Michal Langstromer"], True), (1, "b", ["Michael Langstromer"], True), (2, "c", ["Zinedine Belkadi", "Belkadi Zinedine"], True), (3, "d", ["Belkadi Zinedine"], True)])
    assert got[0] != got[1] and got[2] == got[3]


def test_all_tokens_are_aligned(spark):
    got = classes(spark, [(i, f"run{i}", [n], True) for i, n in enumerate(["Ousmane Garrido Lopetegui", "Ousmane Lopetegui", "Ousmane Garrido Bentancur"])])
    assert got[0] == got[1] != got[2]
    assert alignment(["a", "bc", "def", "gh"], ["gh", "def", "x", "bc", "a"]) == 0


@pytest.mark.parametrize("times", [1, 5])
def test_size_of_the_table_has_no_part(spark, times):
    runs = {"Robert Kowalsky": 1, "Robert Kowalski": 2, "Ousmane Barelak": 12, "Ousmane Barelik": 1, "Ousmane Barylik": 12}
    typed = [n for n, k in runs.items() for _ in range(k * times)]
    got = classes(spark, [(i, f"run{i}", [n], True) for i, n in enumerate(typed)])
    of = {n: {got[i] for i, t in enumerate(typed) if t == n} for n in runs}
    assert of["Robert Kowalsky"] == of["Robert Kowalski"] and of["Ousmane Barelak"] != of["Ousmane Barylik"]


def test_order_of_rows_has_no_part(spark):
    rows = [(i, f"run{i}", [n], False) for i, n in enumerate(["Bob Langstromer", "Robert Langstromer", "Langstromer R", "Robert Langstormer", "Wawerograd", "FC Wawerograd"])]
    assert classes(spark, rows) == classes(spark, rows[::-1])


def test_all_pairs_of_a_hot_class_and_of_none(spark, monkeypatch):
    monkeypatch.setattr(names, "PIECE", 7)
    rows = spark.createDataFrame([(i, 1 if i % 3 else i) for i in range(60)], "record bigint, name_class bigint")
    hot = [i for i in range(60) if i % 3]
    want = {(a, b) for a in hot for b in hot if a < b}
    got = [tuple(r) for r in linked_pairs(rows).collect()]
    assert set(got) == want and len(got) == len(want)
    assert linked_pairs(rows.where("false")).count() == 0
    assert classes(spark, [(1, "r", [None], False)]) == {}


PAIRS = [("Stefan Nowak", "Nowak Stefan"), ("Giovanni Rossi", "Gianni Rossi"), ("Hendrik Janssen", "Henk Janssen"), ("Stefan Nowak", "Stefan Novak"), ("Borussia Dortmund", "BV Borussia Dortmund"), ("Zinedine " + "Bel" * 400, "Zinedine " + "Bel" * 400 + "x")]


@pytest.mark.parametrize("pair", PAIRS)
def test_names_that_no_list_has_link_alone(spark, pair):
    for scorer in (False, True):
        assert len(set(classes(spark, [(i, f"run{i}", [n], scorer) for i, n in enumerate(pair * 3)]).values())) == 1


def paired(words, clubs):
    """Records with paired spellings, from which words are learned: players by given name and core, clubs by word and core."""
    rows = []
    for i, (name, short) in enumerate(words):
        for k in range(4):
            core = f"{'bdfgk'[k]}{'aeiou'[i % 5]}rlo{'mnprst'[i % 6]}ewicz"
            rows += [[f"{name.title()} {core.title()}", f"{name[0].upper()}. {core.title()}"], [f"{short.title()} {core.title()}", f"{name.title()} {core.title()}"]]
    for i, word in enumerate(clubs):
        rows += [[f"{word.title()} {core.title()}", core.title()] for core in (f"{c}ontag{'aeiou'[i % 5]}rad" for c in "bdfk")]
    return [(i, f"run{i}", n, False) for i, n in enumerate(rows)]


def test_words_are_learned_from_paired_spellings(spark):
    lexicon = names.learned_lexicon(spark.createDataFrame(paired([("barnabas", "barney"), ("chiara", "kiki")], ["sparta", "lokomotiv"]), SCHEMA), names.Lexicon({}, frozenset()))
    assert {"sparta", "lokomotiv"} <= lexicon.clubs and lexicon.given_of("barney") == lexicon.given_of("barnabas") and lexicon.given_of("barnabsa") == lexicon.given_of("barnabas") != lexicon.given_of("chiara")
    assert names.learned_lexicon(spark.createDataFrame([], SCHEMA), names.LISTED).given == names.GIVEN


def test_links_without_lists(spark, monkeypatch):
    monkeypatch.setattr(names, "LISTED", names.Lexicon({}, frozenset()))
    learned = paired([("barnabas", "barney"), ("chiara", "kiki"), ("torvald", "toto")], ["sparta", "lokomotiv"])
    typed = [["Barney Zelenograbski", None], ["Zelenograbski, Barnabas", None], ["B. Zelenograbski", None], ["Barnabas Zelenograbksi", None], ["Torvald Zelenograbski", None], ["FK Sparta Zelenohrad", "Zelenohrad"], ["Sparta Zelenohrad", None], ["Zelenohrad", None], ["Zelenohrad U19", None]]
    got = classes(spark, learned + [(1_000 + i, f"t{i}", n, False) for i, n in enumerate(typed)])
    assert len({got[1_000 + i] for i in (0, 1, 2, 3)}) == 1 and got[1_004] != got[1_000]
    assert got[1_005] == got[1_006] == got[1_007] != got[1_008]


def test_pointers_are_followed_to_the_end(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "node bigint, parent bigint")
    nodes = spark.createDataFrame([(i, 100 + i) for i in range(42)], "node bigint, told bigint")
    got = {r["node"]: (r["root"], r["told"]) for r in names._followed(nodes, 42, chain).collect()}
    assert got == {i: (40, 140) for i in range(41)} | {41: (41, 141)}


def test_small_tables_joined_by_shuffle_as_by_broadcast(spark, monkeypatch):
    rows = [(i, f"run{i}", [n, None], False) for i, n in enumerate(["Bob Langstromer", "Robert Langstromer", "Langstromer R", "Robert Langstormer", "Wawerograd", "FC Wawerograd", "Wawergorad"])]
    want = classes(spark, rows)
    monkeypatch.setattr(names, "BROADCAST_ROWS", 0)
    assert classes(spark, rows) == want and len(set(want.values())) == 2


def test_family_names_are_not_short_forms(spark):
    got = classes(spark, [(i, f"run{i}", [n], True) for i, n in enumerate(["Ousmane Barelak", "Ousmane Barelakowski", "Zinedine Belkadi", "Zinedine Bekai"] * 3)])
    assert got[0] != got[1] and got[2] != got[3] and got[0] == got[4] == got[8]
