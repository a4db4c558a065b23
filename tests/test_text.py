from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from marketloom.functions import hashing, text, transport


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(build(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("build", "value", "want"),
    [
        (text.ascii_folded, "  Łódź  Ślęza ", "odz sleza"),
        (text.ascii_folded, None, ""),
        (text.contract_text, "Łódź", "lodz"),
        (text.collapsed, " A \t b\n", "a b"),
        (text.collapsed, None, ""),
        (text.spaced_ampersands, "A&B  & c", "a & b & c"),
        (text.team_name, "Foo 12 ", "Foo"),
        (text.team_name, "Schalke04", "Schalke04"),
        (text.without_repeated_words, "Foo foo Bar foo", "Foo Bar foo"),
        (text.column_role, "x|column:Home|y", "Home"),
        (text.column_role, None, ""),
        (text.line_value, "Over 2,5 goals", "2.5"),
        (text.line_value, "Home (-1)", "-1"),
        (text.line_value, "Away +1", "+1"),
        (text.line_value, "3 goals", "3"),
        (text.line_value, "none", None),
        (text.player_line, "Powyżej 1,5 strzału", "1.5"),
        (text.general_number, "3.0", "3"),
        (text.general_number, "-0", "0"),
        (text.general_number, "NaN", None),
        (text.general_number, "12345678", "1.23457e+07"),
        (text.general_number, "0.00001234", "1.234e-05"),
        (text.general_number, "1 250,50", "1250.5"),
        (text.line_class, "2.25", "QUARTER"),
        (text.line_class, "x", "INVALID"),
        (text.teams_of, "A - B - C", ["A", "B - C"]),
        (text.teams_of, "A", None),
        (text.clock, "at 9:05 and 10:00", "9:05"),
        (text.clock, "25:99", None),
        (text.packet_text, "﻿a  \r\nb\rc", "a\nb\nc"),
        (text.file_name, " Ta b/1 ", "Ta_b_1"),
        (text.canonical_utc, "2025-01-01T01:00:00+01:00", "2025-01-01T00:00:00.000000Z"),
        (text.canonical_utc, "2025-01-01T01:00:00", None),
        (lambda c: text.only_value(c, r"id=(\d+)"), "id=5 id=5", "5"),
        (lambda c: text.only_value(c, r"id=(\d+)"), "id=5 id=6", None),
        (lambda c: text.signature(c, F.lit(None), F.lit("z")), "a", "a||z"),
        (transport.safe_url, "https://h/p?a=1&token=abc&B=2#frag", "https://h/p?a=1&token=%3Credacted%3E&B=2"),
        (transport.safe_url, "https://h/p?Client-Secret=x&id_token=y&q=a b~*&e=&api-key=1", "https://h/p?Client-Secret=%3Credacted%3E&id_token=%3Credacted%3E&q=a+b~%2A&e=&api-key=%3Credacted%3E"),
        (transport.safe_url, None, ""),
        (lambda c: transport.safe_message(F.lit("E"), c), "bad x-client-secret: abc, Bearer zz", "E: bad x-client-secret=<redacted>, Bearer <redacted>"),
        (lambda c: transport.safe_message(F.lit("E"), c), None, "E"),
        (transport.is_framed, "Application/grpc-web+proto; x", True),
        (transport.media_type, "Application/JSON; charset=x", "application/json"),
        (hashing.is_sha256, "ab" * 32, True),
        (hashing.is_sha256, None, False),
    ],
)
def test_scalar(spark, build, value, want):
    assert one(spark, value, build) == want


def test_assignments_last_wins(spark):
    assert one(spark, 'A="1";\nB="x "y"";\nA="2";\nbad', text.assignments) == {"A": "2", "B": 'x "y"'}


def test_headers(spark):
    assert one(spark, {"Cookie": "s", "Accept": "a"}, transport.safe_headers, "map<string,string>") == {"accept": "a"}


def test_canonical_hash_is_order_and_form_free(spark):
    a, b = '{"b": 1, "a": "é"}', '{"a": "e\\u0301", "b": 1}'
    assert one(spark, a, hashing.canonical_sha256) == one(spark, b, hashing.canonical_sha256)
    form = ["object", [["a", ["str", "é"]], ["b", ["int", "1"]]]]
    assert one(spark, a, hashing.canonical_sha256) == hashlib.sha256(json.dumps(form, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    assert one(spark, "[1]", hashing.canonical_sha256) != one(spark, "[1.0]", hashing.canonical_sha256) != one(spark, '["1"]', hashing.canonical_sha256)
    assert one(spark, '{"a": 1, "a": 1}', hashing.canonical_sha256) is None
    assert one(spark, "{", hashing.canonical_sha256) is None and one(spark, "[NaN]", hashing.canonical_sha256) is None
    assert one(spark, '{"e\\u0301": 1, "é": 2}', hashing.canonical_sha256) is None  # keys collide


def test_sources_hash_is_order_free(spark):
    digest = lambda names, sums: spark.range(1).select(hashing.sources_sha256(F.array(*map(F.lit, names)), F.array(*map(F.lit, sums))).alias("h")).first()["h"]
    assert digest("ab", "12") == digest("ba", "21") != digest("ab", "21")


def frame(flag: int, message: bytes) -> bytes:
    return bytes([flag]) + len(message).to_bytes(4, "big") + message


def test_request_numbers():
    assert transport.request_number(frame(0, b"\x08\x96\x01") + frame(128, b"x")) == "150"
    assert [transport.request_number(b) for b in (None, b"", frame(1, b"\x08\x05"), frame(0, b"\x10\x05"), frame(0, b"\x08\x00"), frame(0, b"\x08" + b"\xff" * 12), frame(0, b"\x08\x05") * 2)] == [None] * 7


def test_frames_and_varints(spark):
    body = frame(0, b"\x08\x96\x01") + frame(128, b"")
    assert transport.frames_of(body) == [(0, b"\x08\x96\x01"), (128, b"")]
    assert transport.frames_of(body[:-1]) is None and transport.frames_of(b"") == []
    assert transport.varint_field(b"\x08\x96\x01", 1) == 150
    assert transport.varint_field(b"\x12\x02ab\x08\x05", 1) == 5
    assert transport.varint_field(b"\x08\x05\x08\x06", 1) is None and transport.varint_field(b"\x08", 1) is None
    rows = spark.createDataFrame([("a", body), ("b", body[:3]), ("c", None)], "k string, b binary")
    got = {(r["k"], r["at"], r["flag"]) for r in transport.message_frames(rows, "k", "b").collect()}
    assert got == {("a", 0, 0), ("a", 1, 128), ("b", -1, None), ("c", -1, None)}
