from __future__ import annotations

import random
import re

from marketloom.llm import leakage
from marketloom.llm.leakage import leaked_passages, names_of, reparameterised_passages, words

ITEM = "Benchmark query G545: given that captain Giuseppe Zumowatadan left at 2 to 1, decide whether ticket rananagoar with stake 7209 pays"


def leaks(spark, docs, items=((1, ITEM),)):
    d = spark.createDataFrame([(i, t, 0, 0) for i, t in docs], "doc_id bigint, text string, item_id int, verbatim int")
    got = leaked_passages(d, "doc_id", "text", spark.createDataFrame(list(items), "item_id bigint, item_text string"), "item_id", "item_text").collect()
    return {(r["doc_id"], r["item_id"]): (r["verbatim"], r["consistent"]) for r in got}


def test_passages(spark):
    w = ITEM.split()
    docs = [
        (1, "Intro. " + ITEM + " Outro."), (2, "x " + " ".join(w[3:15]).upper().replace(" ", "  \n> ") + " y"), (3, " ".join(w[3:14])), (4, None), (5, ""), (6, "z " * 50_000 + ITEM),
        (7, ITEM.replace("2 to 1", "4 to 3").replace("Giuseppe", "giuseppe")), (8, " ".join(reversed(w))), (9, ITEM.replace("2 to 1", "4 to 4")),
    ]
    got = leaks(spark, [*docs, docs[0]])
    assert {d for (d, _), (verbatim, _) in got.items() if verbatim} == {1, 2, 6}
    assert got[7, 1] == (False, True)
    assert 3 not in {d for d, _ in got} and 8 not in {d for d, _ in got}


def test_repeated_items_and_empty_tables(spark):
    assert leaks(spark, [(1, ITEM)], [(1, ITEM), (2, ITEM), (3, None), (4, "short")]) == {(1, 1): (True, True), (1, 2): (True, True)}
    assert leaks(spark, [(1, None)]) == {}


def test_names_and_words(spark):
    items = spark.createDataFrame([(ITEM,)], "t string")
    assert {"giuseppe", "zumowatadan"} <= set(names_of(items, "t")) and "benchmark" not in names_of(items, "t")
    from pyspark.sql import functions as F

    assert items.select(words(F.lit("Łódź-2, x_y")).alias("w")).first()["w"] == ["łódź", "2", "x", "y"]


def test_exchanged_names_and_numbers(spark):
    """Planted: passages whose names and numbers were exchanged, each by one renaming; and passages where one name became two,
    or where another word changed, which are none."""
    rng = random.Random(7)
    first, last = ["Ana", "Óscar", "Willy", "Grażyna", "Ole"], ["Barbudo", "Ćwik", "Drosselmeyer", "Ågren", "Quist"]
    items, docs, want = [], [], set()
    for n in range(24):
        kit, town = rng.choice(["clock", "banner", "whistle", "locker"]), "".join(rng.choices("abcdeiou", k=7))
        text = f"Question: when {town}el keeper {first[n % 5]} {last[n % 4]} of Motor {town.title()} lost the {kit} near {town}ak after 12 minutes, did {last[n % 4]} still owe the {town}or fee of 340 crowns to the league"
        items.append((n, text))
        new = {w: f"{rng.choice(first)[0]}{'abcdefgh'[i]}{''.join(rng.choices('aeioulmn', k=5))}" for i, w in enumerate((first[n % 5], last[n % 4]))}
        swapped = re.sub("|".join(map(re.escape, new)), lambda m: new[m[0]], text).replace("12", "77").replace("340", "98")
        docs.append((n, f"Some notes. {swapped.removeprefix('Question: ')}. More notes."))
        want.add((n, n))
        twice = text.replace(last[n % 4], "Vole", 1).replace(last[n % 4], "Marten", 1)
        docs.append((100 + n, twice))
        docs.append((200 + n, re.sub(r" (lost|near|did|owe|fee|to) ", " other ", text)))
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = reparameterised_passages(d, "doc_id", "text", spark.createDataFrame(items, "item_id bigint, item_text string"), "item_id", "item_text")
    found = {(r["doc_id"], r["item_id"]) for r in got.where("consistent and not verbatim").collect()}
    assert len(found & want) >= 0.9 * len(want) and len(found & want) >= 0.9 * len(found), sorted(found - want)[:5]


def test_names_that_are_exchanged_need_words_around_them(spark):
    item = [(1, "one Abc Def Ghi Jkl Mno Pqr Stu Vwx two three Yza Bcd")]
    docs = [(1, "one Qwe Rty Uio Pas Dfg Hjk Lzx Cvb two three Nmq Wer"), (2, None), (3, "")]
    got = reparameterised_passages(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text", spark.createDataFrame(item, "item_id bigint, item_text string"), "item_id", "item_text")
    assert got.count() == 0


def test_joined_by_shuffle_as_by_broadcast(spark, monkeypatch):
    docs = [(1, "Intro. " + ITEM), (2, ITEM.replace("2 to 1", "4 to 3")), (3, "short"), (1, "another text " * 20)]
    want = leaks(spark, docs)
    monkeypatch.setattr(leakage, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(leakage, "BROADCAST_DOCS", 0)
    monkeypatch.setattr(leakage, "MOST_NAMES", 0)
    got = leaks(spark, docs)
    assert {k for k, v in got.items() if v[0]} == {k for k, v in want.items() if v[0]} == {(1, 1)} and got[2, 1] == (False, True)


def test_names_beyond_a_task_are_placeholders_too(spark, monkeypatch):
    """Names of one item in another's place, in any case, behind numbers, in repeated rows and ids, in long texts: the same by join as in a task."""
    other = "Another one asks whether Zumowatadan, Grażyna and Óscar met captain Brul behind the gate of Motor after 7 Kroner were paid in vain"
    swapped = ITEM.replace("Giuseppe Zumowatadan", "grażyna ÓSCAR").replace("7209", "11")
    docs = [
        (1, "Intro. " + ITEM), (2, swapped), (2, "another text of this id, " + other.replace("Brul", "motor").replace("7 Kroner", "9 Motor")), (2, swapped), (3, "z 5 Motor x " * 20_000 + swapped),
        (4, ITEM.replace("Giuseppe", "Nobody")), (5, None), (6, ""), (7, "Motor"), (None, swapped), (8, "no such word here " * 10), (9, ITEM.replace("Giuseppe Zumowatadan", "Brul Brul")),
    ]
    items = [(1, ITEM), (2, other), (2, other), (3, None), (None, ITEM)]
    want = leaks(spark, docs, items)
    assert want[2, 1] == want[3, 1] == (False, True) and want[1, 1] == (True, True) and want[9, 1] == (True, False) and (2, 2) in want
    monkeypatch.setattr(leakage, "MOST_NAMES", 3)
    assert leaks(spark, docs, items) == want
    monkeypatch.setattr(leakage, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(leakage, "BROADCAST_DOCS", 0)
    assert leaks(spark, docs, items) == want
