from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketloom.operators.nested import Members, _content, nested_nodes, ordinal, parent_label, parse_deep, walk


def test_labels_name_parents():
    doc = {"a": [{"b": 1}, {"b": [2, {"c": None}]}], "d": {}}
    nodes = {label: (path, name, value) for label, path, name, value in walk(_content(json.dumps(doc)))}
    assert nodes[0, 1, 0, 1, 0] == ("a[].b[].c", "c", None)
    assert all(label[:-1] in nodes or len(label) == 1 for label in nodes)


def test_tables_by_schema_path(spark):
    docs = [
        ("p1", json.dumps([{"key": "k0", "selections": {"A": 1, "B": 2}}, {"key": "k1", "selections": [{"name": "C"}]}])),
        ("p2", json.dumps(json.dumps([{"key": "k2"}]))),
        ("p3", '[{"key": "broken"'), ("p4", None), ("p5", ""), ("p6", "17"), ("p7", "[" * 5000),
    ]
    df = spark.createDataFrame([(p, t, "clash") for p, t in docs], "p string, t string, dewey string")
    nodes = nested_nodes(df, "p", ["t"], {"t": {"[].selections"}}, {"t": {"[]": "key", "[].selections[]": "name"}})
    got = {(r["p"], r["schema_path"], r["name"], tuple(r["up"]), r["last"]) for r in nodes.where("kind <> 'string'").select("p", "schema_path", "name", parent_label(F.col("dewey")).alias("up"), ordinal(F.col("dewey")).alias("last")).collect()}
    assert ("p1", "[].selections{}", "B", (0, 0, 1), 1) in got
    assert ("p1", "[].selections[]", "C", (0, 1, 1), 0) in got
    assert ("p2", "[]", "k2", (0,), 0) in got
    assert {p for p, *_ in got} == {"p1", "p2"}


def test_no_depth_no_digits_and_no_wrapping_is_too_much(spark):
    wrapped = json.dumps([{"key": "deep inside"}])
    for _ in range(12):
        wrapped = json.dumps(wrapped)
    deep = "[" * 20_000 + "1" + "]" * 20_000
    docs = [("digits", "[" + "7" * 6_000 + "]"), ("wrapped", wrapped), ("nan", "[NaN]"), ("inf", '{"a": Infinity}'), ("twice", '{"a": 1, "a": 2}')]
    df = spark.createDataFrame(docs, "p string, t string")
    nodes = nested_nodes(df, "p", ["t"], item_names={"t": {"[]": "key"}})
    counts = {r["p"]: r["count"] for r in nodes.groupBy("p").count().collect()}
    assert counts == {"digits": 1, "wrapped": 2, "twice": 2}
    assert nodes.where("p = 'digits'").first()["value"] == "7" * 6_000 and nodes.where("p = 'wrapped' and schema_path = '[]'").first()["name"] == "deep inside"
    depth, inner = 0, _content(deep)
    while isinstance(inner, list):
        depth, inner = depth + 1, inner[0]
    assert depth == 20_000 and inner == 1
    rows = spark.createDataFrame([("d", deep)], "p string, t string")
    assert nested_nodes(rows, "p", ["t"], paths={"t": {"[]", "[]" * 20_000}}).count() == 2


@settings(max_examples=100, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(), x, max_size=4)))
def test_the_parser_without_recursion_reads_what_the_other_reads(value):
    def plain(node):
        return {k: plain(v) for k, v in node} if isinstance(node, Members) else [plain(v) for v in node] if isinstance(node, list) else node

    text = json.dumps(value, indent=1)
    assert plain(parse_deep(f" {text}\n")) == value
    for broken in (text[:-1], text + "x", text.replace(",", ",,", 1)):
        try:
            json.loads(broken)
        except ValueError:
            with pytest.raises(ValueError):
                parse_deep(broken)


def test_empty_table(spark):
    assert nested_nodes(spark.createDataFrame([], "p string, t string"), "p", ["t"]).count() == 0
