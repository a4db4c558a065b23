"""Deeply nested JSON to related flat tables, by Dewey labels.

Every node of a document gets the ordinals on its way from the root as its label; the label without its
last ordinal is its parent's, so no link is stored and none can be wrong. Nodes with the same schema path
(member names, ``[]`` for array items, ``{}`` for members that are data) make one table. A document is
walked once, without recursion, in an Arrow batch of its own executor; no node leaves it for another.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODES = "`{key}` {key_type}, field string, dewey array<int>, schema_path string, name string, kind string, value string"
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:(\.\d+)?([eE][-+]?\d+)?)", re.ASCII)
_BLANK = re.compile(r"[ \t\r\n]*")
_WORDS = {"true": True, "false": False, "null": None}


class Members(list):
    """The members of an object as (name, value), repeated names and all, in their order."""


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


_LOADS = json.JSONDecoder(object_pairs_hook=Members, parse_constant=_no_constant).decode


def parse_deep(text: str):
    """The value of a JSON text of any depth, without recursion. Raises ValueError for what is no JSON."""
    at = _BLANK.match(text).end()
    stack: list[tuple[list, str]] = []  # open containers, and the name that waits for its value
    name, result = "", None

    def char() -> str:
        return text[at : at + 1]

    def named() -> str:
        nonlocal at
        if char() != '"':
            raise ValueError(f"a member's name is missing at {at}")
        found, at = scanstring(text, at + 1)
        at = _BLANK.match(text, at).end()
        if char() != ":":
            raise ValueError(f"a colon is missing at {at}")
        at = _BLANK.match(text, at + 1).end()
        return found

    while True:
        opened = char()
        if opened in ("{", "["):
            box = Members() if opened == "{" else []
            at = _BLANK.match(text, at + 1).end()
            if char() != ("}" if opened == "{" else "]"):
                stack.append((box, name))
                name = named() if opened == "{" else ""
                continue
            at, value = at + 1, box
        elif opened == '"':
            value, at = scanstring(text, at + 1)
        elif (word := next((w for w in _WORDS if text.startswith(w, at)), None)) is not None:
            at, value = at + len(word), _WORDS[word]
        elif (number := _NUMBER.match(text, at)) is not None:
            at, value = number.end(), float(number[0]) if number[1] or number[2] else int(number[0])
        else:
            raise ValueError(f"a value is missing at {at}")
        # The value is whole: it goes to its container, and so do containers that it closes.
        while True:
            at = _BLANK.match(text, at).end()
            if not stack:
                result = value
                break
            box, outer = stack[-1]
            box.append((name, value) if isinstance(box, Members) else value)
            if char() == ",":
                at = _BLANK.match(text, at + 1).end()
                name = named() if isinstance(box, Members) else ""
                break
            if char() != ("}" if isinstance(box, Members) else "]"):
                raise ValueError(f"a container is not closed at {at}")
            at += 1
            stack.pop()
            value, name = box, outer
        if not stack:
            if at < len(text):
                raise ValueError(f"text is left at {at}")
            return result


def read_json(text: str):
    """The value of a JSON text: lists, ``Members`` and scalars. Raises ValueError for what is no JSON."""
    try:
        return _LOADS(text)
    except RecursionError:
        return parse_deep(text)


def _content(text: str | None):
    """The JSON value of a text, or None: JSON within a JSON string counts as its content, however often it is wrapped."""
    try:
        value = read_json(text)
        while isinstance(value, str):
            value = read_json(value)
        return value
    except (TypeError, ValueError):
        return None


def _plain(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool | float):
        return json.dumps(value)
    return str(value) if isinstance(value, int) else None


def _kind(value) -> str:
    if isinstance(value, Members):
        return "object"
    if isinstance(value, list):
        return "array"
    return "null" if value is None else "string" if isinstance(value, str) else "boolean" if isinstance(value, bool) else "number"


def _member(node, name: str | None):
    """The last member of that name, as readers of JSON take it."""
    return next((v for k, v in reversed(node) if k == name), None) if name and isinstance(node, Members) else None


def walk(document, data_members: frozenset[str] = frozenset(), item_names: dict[str, str] | None = None):
    """(dewey, schema path, name, value) of each node but the root, parents before their children.

    document: lists, ``Members`` and scalars. A member's name is its own; an array item's is that of its member
    ``item_names[path]``, else empty.
    """
    item_names = item_names or {}
    stack = [((), "", document)]
    while stack:
        label, path, node = stack.pop()
        if isinstance(node, Members):
            if path in data_members:
                below = [((*label, i), f"{path}{{}}", k, v) for i, (k, v) in enumerate(node)]
            else:
                begin = f"{path}." if path else ""
                below = [((*label, i), begin + k, k, v) for i, (k, v) in enumerate(node)]
        elif isinstance(node, list):
            under = f"{path}[]"
            named = item_names.get(under)
            below = [((*label, i), under, (_plain(_member(v, named)) if isinstance(v, Members) else "") if named else "", v) for i, v in enumerate(node)]
        else:
            continue
        yield from below
        stack.extend([(d, p, v) for d, p, _, v in reversed(below) if isinstance(v, list)])


def nested_nodes(
    docs: DataFrame, key: str, fields: list[str], data_members: dict[str, set[str]] | None = None, item_names: dict[str, dict[str, str]] | None = None, paths: dict[str, set[str]] | None = None
) -> DataFrame:
    """(key, field, dewey, schema_path, name, kind, value) of every node of the JSON texts in ``fields``.

    Null, empty and broken or incomplete texts give no nodes, and so do those with NaN or Infinity, which are no JSON; a document
    that is a lone value gives none either. Depth, length of numbers and times that a document is wrapped in a JSON string
    are not bounded. Repeated members are nodes of their own. ``data_members``: for each field the schema paths of
    objects whose member names are data, not schema. ``item_names``: for each field the member that names the items of an
    array, by the items' schema path. ``paths``: for each field the schema paths whose nodes are wanted; all, where it is
    not given. Repeated documents give repeated nodes. ``dewey[0]`` is the ordinal of the field.
    """
    if key in ("field", "dewey", "schema_path", "name", "kind", "value"):
        raise ValueError(f"the key column must not be named {key}")
    naming = item_names or {}
    known = {f: frozenset(p) for f, p in (data_members or {}).items()}

    def flatten(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sys.set_int_max_str_digits(0)
        for frame in frames:
            for begin in range(0, len(frame), 200):  # one document may have very many nodes
                part = frame.iloc[begin : begin + 200]
                out = []
                for ordinal, field in enumerate(fields):
                    members, names, wanted = known.get(field, frozenset()), naming.get(field), paths.get(field, ()) if paths else None
                    for doc, text in zip(part[key], part[field], strict=True):
                        content = _content(text)
                        if isinstance(content, list):
                            out += [(doc, field, [ordinal, *d], p, n, _kind(v), _plain(v)) for d, p, n, v in walk(content, members, names) if wanted is None or p in wanted]
                yield pd.DataFrame(out, columns=["key", "field", "dewey", "schema_path", "name", "kind", "value"]).rename(columns={"key": key})

    kind = dict(docs.dtypes)[key]
    return docs.select(key, *fields).mapInPandas(flatten, NODES.format(key=key, key_type=kind))


def parent_label(dewey: Column) -> Column:
    """The parent's label: the own one without its last ordinal."""
    return F.slice(dewey, 1, F.size(dewey) - 1)


def ordinal(dewey: Column, back: int = 0) -> Column:
    """The last ordinal of a label, or the one ``back`` levels above it."""
    return F.get(dewey, F.size(dewey) - 1 - back)
