"""Encoding of a corpus with a byte-level BPE tokenizer.

A text longer than a chunk is cut into chunks that overlap: short chunks within a task, and for texts longer than a
long chunk also long ones, each a row of its own. Chunks are pre-tokenised by themselves, each from its own start; where a chunk and its predecessor first agree on a boundary inside their overlap, both go on
alike, so there they are stitched. The pieces between two stitches are encoded in parallel and
concatenated. A text in which some overlap holds no common boundary (one word longer than an overlap) is
pre-tokenised whole. Vocabulary files are read where they are installed, never copied.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.session import materialize

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters of a chunk and of its overlap with the next one, where all chunks of a text are of one task.
CHUNK_CHARS, OVERLAP_CHARS = 1_000, 120
#: The same where each chunk is a row of its own, for texts longer than such a chunk.
SPREAD_CHARS, SPREAD_OVERLAP = 100_000, 2_000


def default_vocabulary() -> str:
    """Path of the installed vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(VOCABULARY))


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer of a ranks file, without special tokens."""
    import public_tokenizers
    import tiktoken

    with Path(path).open("rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(Path(path).stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def boundaries(text: str, pattern: str) -> list[int]:
    """Starts of the pre-tokens of a text, and its end. Blanks are those of Unicode, as the tokenizer has them."""
    import regex

    exact = pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
    return [m.start() for m in regex.finditer(exact, text)] + [len(text)]


def proven(text: str, at: list[int], whole: bool) -> list[int]:
    """The boundaries at which a text may be parted: not behind a blank, as blanks are grouped by what follows them, and
    not the last two of a text that is cut off, as its last pre-tokens may go on."""
    return [x for x in (at if whole else at[:-2]) if x and not text[x - 1].isspace()]


def stitch(before: list[int], after: list[int]) -> int | None:
    """The first boundary that two lists share, or None."""
    known = set(before)
    return next((x for x in after if x in known), None)


def pieces_of(text: str, pattern: str, chunk: int, overlap: int) -> list[str]:
    """The pieces of a text between the places where its chunks are stitched; the text itself where some do not meet again."""
    overlap = min(overlap, chunk)
    cuts, before = [0], proven(text, boundaries(text[: chunk + overlap], pattern), chunk + overlap >= len(text))
    for start in range(chunk, len(text), chunk):
        part = text[start : start + chunk + overlap]
        tails = [x for x in before if x >= start]
        after = [start + x for x in boundaries(part, pattern)]
        met = stitch(tails, [x for x in after if x < start + overlap])
        if met is None:
            if start + overlap >= len(text):
                break  # the part before holds all that is left
            return [text]
        cuts.append(met)
        before = proven(text, after, start + chunk + overlap >= len(text))
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]


def encode_text(text: str | None, path: str, pattern: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    """Ids of one text, by overlapping chunks."""
    known = encoding(path)
    if not text or len(text) <= chunk:
        return known.encode_ordinary(text) if text else []
    return [i for piece in pieces_of(text, pattern, chunk, overlap) for i in known.encode_ordinary(piece)]


def decode(ids: list[int], path: str | None = None) -> str:
    """The text of ids: their raw bytes, joined and read as UTF-8."""
    known = encoding(path or default_vocabulary())
    return b"".join(known.decode_single_token_bytes(i) for i in ids).decode("utf-8")


def encode_corpus(docs: DataFrame, doc_id: str, text: str, vocabulary: str | None = None, chunk: int = SPREAD_CHARS, overlap: int = SPREAD_OVERLAP) -> DataFrame:
    """(doc_id, ids) of each row, without special tokens and without changing the text.

    Null and empty texts give the empty list. Rows that repeat an id are equal to each other or else, where
    the text is longer than ``chunk``, undefined. Characters that UTF-8 cannot hold do not occur in Spark strings. Texts
    longer than ``CHUNK_CHARS`` are cut and stitched within a task, those longer than ``chunk`` over many.
    """
    import public_tokenizers

    path, pattern = vocabulary or default_vocabulary(), public_tokenizers.PATTERN
    rows = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("body"))
    kind = dict(rows.dtypes)["doc"]

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc": frame["doc"], "ids": [encode_text(t, path, pattern) for t in frame["body"]]})

    long = F.coalesce(F.char_length("body"), F.lit(0)) > chunk
    short = rows.where(~long).mapInPandas(whole, f"doc {kind}, ids array<int>")
    encoded = short.unionByName(_encode_long(rows.where(long), "doc", "body", path, chunk, overlap, kind))
    return encoded.select(F.col("doc").alias(doc_id), "ids")


def _encode_long(rows: DataFrame, doc_id: str, text: str, path: str, chunk: int, overlap: int, kind: str) -> DataFrame:
    import public_tokenizers

    pattern = public_tokenizers.PATTERN

    def zones(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            heads, tails = [], []
            for no, part, last in zip(frame["no"], frame["part"], frame["last"], strict=True):
                at = boundaries(part, pattern)
                heads.append([no * chunk + x for x in at if x < overlap])
                tails.append([no * chunk + x for x in proven(part, at, last) if x >= chunk])
            yield frame.assign(heads=heads, tails=tails)

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids = [encode_text(part[int(a) : int(b)], path, pattern) for part, a, b in zip(frame["part"], frame["a"], frame["b"], strict=True)]
            yield pd.DataFrame({doc_id: frame[doc_id], "no": frame["no"], "ids": ids})

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = encoding(path)
        for frame in frames:
            yield pd.DataFrame({doc_id: frame[doc_id], "ids": [known.encode_ordinary(t) for t in frame[text]]})

    count = F.ceil(F.char_length(text) / F.lit(chunk)).cast("int")
    parts = rows.distinct().withColumn("chunks", count).select(doc_id, "chunks", text, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("no"))
    parts = parts.select(doc_id, "no", (F.col("no") == F.col("chunks") - 1).alias("last"), F.substr(F.col(text), F.col("no") * chunk + 1, F.lit(chunk + overlap)).alias("part"))
    schema = f"{doc_id} {kind}, no int, last boolean, part string, heads array<int>, tails array<int>"
    zoned = materialize(parts.repartition(doc_id, "no").mapInPandas(zones, schema))
    in_order = Window.partitionBy(doc_id).orderBy("no")
    marks = zoned.select(doc_id, "no", "last", "heads", F.lag("tails").over(in_order).alias("tails"))
    common = F.array_min(F.array_intersect("tails", "heads"))
    starts = marks.select(doc_id, "no", "last", F.when(F.col("no") == 0, 0).otherwise(common).alias("start"))
    spans = starts.withColumn("end", F.lead("start").over(in_order))
    broken = spans.where(F.col("start").isNull()).select(doc_id).distinct()
    found = zoned.select(doc_id, "no", "part", "last").join(spans.select(doc_id, "no", "start", "end"), [doc_id, "no"]).join(broken, doc_id, "left_anti")
    cut = found.select(doc_id, "no", "part", (F.col("start") - F.col("no") * chunk).alias("a"), F.when(F.col("last"), F.char_length("part")).otherwise(F.col("end") - F.col("no") * chunk).alias("b"))
    encoded = cut.mapInPandas(pieces, f"{doc_id} {kind}, no int, ids array<int>")
    joined = encoded.groupBy(doc_id).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", "ids"))), lambda x: x["ids"])).alias("ids"))
    return joined.unionByName(rows.join(broken, doc_id, "left_semi").distinct().mapInPandas(whole, f"{doc_id} {kind}, ids array<int>"))
