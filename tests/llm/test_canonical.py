from __future__ import annotations

import random

from marketloom.llm.canonical import map_to_reference
from marketloom.llm.spelling import deletions, near_pairs, osa

LABELS = [
    ("M", 1, "Zwycięzca spotkania"), ("M", 1, "Match winner"), ("M", 2, "Bramki gości powyżej/poniżej"), ("M", 3, "Bramki gospodarzy powyżej/poniżej"),
    ("M", 4, "Handicap azjatycki meczu"), ("M", 5, "Liczba rzutów rożnych"), ("M", 6, "1. połowa - suma bramek"), ("M", 7, "2. połowa - suma bramek"),
    ("F", 9, "1X2"), ("F", 8, "EXACT_GOALS"), ("F", 7, "HANDICAP_ASIAN"),
]


def mapped(spark, values, labels=LABELS):
    reference = spark.createDataFrame(labels, "kind string, ref_id bigint, label string")
    rows = map_to_reference(spark.createDataFrame(values, "kind string, text string"), reference).collect()
    assert len(rows) == len({(r["kind"], r["text"]) for r in rows})
    return {(r["kind"], r["text"]): r["ref_id"] for r in rows}


def test_spellings_abbreviations_and_strangers(spark):
    want = {
        ("M", "zwyciezca  SPOTKANIA!"): 1, ("M", "Zwycięzca spotk."): 1, ("M", "Mathc winner"): 1, ("M", "Bramki gości +/-"): 2, ("M", "gospodarzy powyżej/poniżej Bramki"): 3,
        ("M", "hcp azjatycki meczu"): 4, ("M", "l. rz. roż."): 5, ("M", "1. połoowa - suma brmaek"): 6, ("M", "2. poł. - suma bramek"): 7,
        ("M", "Barwa koszulki sędziego"): 0, ("M", "???"): 0, ("M", "Bramki"): 0,
        ("F", "1x2 "): 9, ("F", "exactgoals"): 8, ("F", "EXACT_GAOLS"): 8, ("F", "handicap-asian"): 7, ("F", "Zwycięzca spotkania"): 0, ("X", "1X2"): 0,
    }
    got = mapped(spark, [*want, *want, ("M", None), ("M", "  "), ("F", "y" * 100_000)])
    assert {k: v for k, v in got.items() if len(k[1]) < 1000} == want and got["F", "y" * 100_000] == 0


def test_empty_tables(spark):
    assert mapped(spark, [("M", None)]) == {}
    assert mapped(spark, [("M", "a")], [("M", 1, None)]) == {("M", "a"): 0}


def test_distance_and_index_against_brute_force(spark):
    assert [osa("abcd", x) for x in ("abcd", "abdc", "abd", "xbcd", "abcde", "dcba")] == [0, 1, 1, 1, 1, 3]
    words = ["spotkania", "spotkanai", "spokania", "sptkana", "bramki", "bramka", "barmki", "ab", "a"]
    df = spark.createDataFrame([("k", w) for w in words], "kind string, word string")
    got = {(r["a"], r["b"], r["edits"]) for r in near_pairs(df, df, "word", "kind", two_from=7).collect()}
    allowed = lambda a, b: 2 if len(a) >= 7 and len(b) >= 7 else 1
    assert got == {(a, b, osa(a, b)) for a in words for b in words if osa(a, b) <= allowed(a, b)}
    from pyspark.sql import functions as F

    assert sorted(df.where("word = 'ab'").select(deletions(F.col("word"), F.lit(False)).alias("d")).first()["d"]) == ["a", "ab", "b"]


def test_words_run_together_and_broken(spark):
    reference = spark.createDataFrame([("F", 1, "GOALS_OU"), ("F", 2, "GOAL_RANGE"), ("F", 3, "HALF_FULL_RESULT"), ("F", 4, "TEAM_TOTALS_AWAY"), ("F", 5, "TEAM_TOTALS_HOME")], "kind string, ref_id bigint, label string")
    typed = {"goalsou": 1, "GOAL_SOU": 1, "GOALSOOU": 1, "halffullresult": 3, "half ull result": 3, "TEAM_TOTALS_AAY": 4, "teamtotalshome": 5, "TEAM TOTALS": 0, "goal": 0}
    values = spark.createDataFrame([("F", t) for t in typed], "kind string, text string")
    assert {r["text"]: r["ref_id"] for r in map_to_reference(values, reference).collect()} == typed


def test_long_words_meet_by_segments(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcd", k=n)) for n in (20, 23, 24, 25, 26, 30, 64, 90, 200) for _ in range(4)]
    typed = []
    for w in words:
        for _ in range(6):
            x = list(w)
            for _ in range(rng.randrange(0, 4)):
                i = rng.randrange(len(x) - 1)
                match rng.randrange(4):
                    case 0: x[i : i + 1] = []
                    case 1: x.insert(i, "e")
                    case 2: x[i] = "f"
                    case _: x[i], x[i + 1] = x[i + 1], x[i]
            typed.append("".join(x))
    frame = lambda xs: spark.createDataFrame([("b", x) for x in sorted(set(xs))], "block string, word string")
    got = {(r["a"], r["b"]): r["edits"] for r in near_pairs(frame(typed), frame(words), "word", "block").collect()}
    want = {(a, b): osa(a, b, 2) for a in set(typed) for b in set(words) if osa(a, b, 2) <= 2}
    assert got == want and len({e for e in got.values()}) == 3
