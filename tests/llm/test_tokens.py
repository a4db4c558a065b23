from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")
from marketloom.llm.tokens import boundaries, decode, default_vocabulary, encode_corpus, encoding, pieces_of, stitch  # noqa: E402


def encoded(spark, rows, **size):
    df = spark.createDataFrame([(*r, "clash", 1, None) for r in rows], "no bigint, part string, ids string, doc int, body string")
    return {r["no"]: list(r["ids"]) for r in encode_corpus(df, "no", "part", **size).collect()}


def test_long_texts_are_stitched_exactly(spark):
    rng = random.Random(2)
    words = ["gół", " Łódź", "  ", "\n\n", "123", "don't", "😀", "—", " x", "aaaaaaaa", "'s", "\r\n", " \t"]
    rows = [(i, "".join(rng.choice(words) for _ in range(900))) for i in range(6)]
    rows += [(10, "b" * 3000), (11, " " * 3000), (12, "short text"), (13, "a " * 1500), (14, "x" * 500 + " " + "y z " * 400)]
    got = encoded(spark, rows, chunk=300, overlap=60)
    known = encoding(default_vocabulary())
    for i, text in rows:
        assert got[i] == known.encode_ordinary(text), i
        assert decode(got[i]) == text


def test_null_empty_special_and_empty_table(spark):
    got = encoded(spark, [(1, None), (2, ""), (3, "<|endoftext|>"), (4, "\u0000a�")])
    assert got[1] == [] and got[2] == [] and len(got[3]) > 1 and decode(got[3]) == "<|endoftext|>" and decode(got[4]) == "\u0000a�"
    assert encoded(spark, [(1, None)])[1] == []


def test_against_the_other_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    other = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    other.encode_special_tokens = True
    texts = ["Zażółć gęślą jaźń, 12.5%\n\n> don't", " leading", "trailing  ", "日本語 text", "<|endoftext|>"]
    got = encoded(spark, list(enumerate(texts)))
    assert [got[i] for i in range(len(texts))] == [other.encode(t, add_special_tokens=False).ids for t in texts]


def test_boundaries_meet():
    import public_tokenizers

    text = "one two three four five"
    whole, tail = boundaries(text, public_tokenizers.PATTERN), [5 + x for x in boundaries(text[5:], public_tokenizers.PATTERN)]
    assert stitch(whole, tail) == 7 and stitch([1], [2]) is None


TEXTS = st.text(st.sampled_from("ab cż1 \n\n\t.'’sS日本🙂\u0301-\x1c\x85\u3000"), min_size=0, max_size=400)


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(5, 60), st.integers(3, 40))
def test_stitched_pieces_give_the_ids_of_the_whole(text, chunk, overlap):
    pattern = public_tokenizers.PATTERN
    pieces = pieces_of(text, pattern, chunk, overlap)
    assert "".join(pieces) == text
    known = encoding(default_vocabulary())
    assert [i for p in pieces for i in known.encode_ordinary(p)] == known.encode_ordinary(text)


def test_most_long_texts_are_cut():
    text = "Suma bramek w meczu 2.5, powyżej albo poniżej. " * 100
    assert len(pieces_of(text, public_tokenizers.PATTERN, 1_000, 120)) >= 4
    assert pieces_of("x" * 5_000, public_tokenizers.PATTERN, 1_000, 120) == ["x" * 5_000]
