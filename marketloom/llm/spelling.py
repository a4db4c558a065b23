"""Spelling distance, folding, and the symmetric-delete neighbourhood index."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Latin letters with marks, and the letters without.
_MARKED = "àáâãäåāăąçćĉčďđèéêëēĕėęěĝğġģĥħìíîïĩīĭįıĵķĺļľłñńņňòóôõöøōŏőŕŗřśŝşšţťŧùúûüũūŭůűųŵýÿŷźżž"
_PLAIN = "aaaaaaaaacccc" + "dd" + "eeeeeeeee" + "gggg" + "hh" + "iiiiiiiii" + "j" + "k" + "llll" + "nnnn" + "ooooooooo" + "rrr" + "ssss" + "ttt" + "uuuuuuuuuu" + "w" + "yyy" + "zzz"
FOLD = str.maketrans(_MARKED, _PLAIN)


def folded(text: Column) -> Column:
    """Lower case, letters without their marks, ß as ss; null stays null."""
    return F.regexp_replace(F.replace(F.translate(F.lower(text), _MARKED, _PLAIN), F.lit("ß"), F.lit("ss")), r"\p{M}+", "")


def fold(text: str) -> str:
    """As ``folded``, of one text."""
    return text.lower().translate(FOLD).replace("ß", "ss")


def osa(a: str, b: str, most: int = 3) -> int:
    """Edits (insert, delete, replace, swap of neighbours) from a to b; ``most`` + 1 if there are more.

    Only the band of places that so many edits can reach is looked at, so long words cost no more than their length.
    """
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    before: dict[int, int] = {}
    last = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        now = {0: i} if i <= most else {}
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            y = b[j - 1]
            cost = min(last.get(j, far) + 1, now.get(j - 1, far) + 1, last.get(j - 1, far) + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before.get(j - 2, far) + 1)
            now[j] = cost
        if not now or min(now.values()) > most:
            return far
        before, last = last, now
    return min(last.get(len(b), far), far)


def _without_one(word: Column) -> Column:
    at = F.sequence(F.lit(1), F.char_length(word))
    return F.transform(at, lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))


def deletions(word: Column, two: Column) -> Column:
    """The word, it without any one letter and, where ``two``, without any two letters; each once."""
    one = F.when(F.char_length(word) > 1, _without_one(word)).otherwise(F.array().cast("array<string>"))
    twice = F.when(two & (F.char_length(word) > 2), F.flatten(F.transform(one, _without_one))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(word), one, twice))


#: Letters from which words meet by segments: their deletions would be too many.
LONG = 24
#: Segments of a long word. Two edits, each of them a swap over a border at worst, leave one of five as it is.
SEGMENTS = 5


def _segment(word: Column, length: Column, number: Column, by: Column) -> Column:
    """(length, number, text) of a segment of words that long, read ``by`` places further on."""
    begin, end = F.floor(length * number / SEGMENTS), F.floor(length * (number + 1) / SEGMENTS)
    text = F.substr(word, F.greatest(begin + 1 + by, F.lit(1)).cast("int"), (end - begin).cast("int"))
    return F.struct(length.alias("n"), number.alias("i"), text.alias("t"))


def _segments(word: Column) -> Column:
    """(length, number, text) of each segment of a long word."""
    return F.transform(F.sequence(F.lit(0), F.lit(SEGMENTS - 1)), lambda i: _segment(word, F.char_length(word), i, F.lit(0)))


def _probes(word: Column) -> Column:
    """(length, number, text) of each segment that a word at most two edits away may have left as it is: lengths and places
    differ from the word's own by up to two."""
    ways = F.sequence(F.lit(0), F.lit(25 * SEGMENTS - 1))  # one small expression, not one for each way
    number = lambda x, size, of: F.pmod(F.floor(x / of), F.lit(size)).cast("int")
    return F.array_distinct(F.transform(ways, lambda x: _segment(word, F.char_length(word) + number(x, 5, 1) - 2, number(x, SEGMENTS, 25), number(x, 5, 5) - 2)))


def near_pairs(left: DataFrame, right: DataFrame, word: str, block: str, two_from: int = 8) -> DataFrame:
    """(block, a, b, edits) of the words of ``left`` and ``right`` that are near: at most one edit apart, or two
    from ``two_from`` letters on. Both sides: distinct (block, word). Words meet by the hash of block and deletion, long ones
    by the hash of block and segment, so that no list of words is compared with another. As words are distinct, only so many
    can share a deletion as the alphabet allows: no key is hot. Words of any length are near to others.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def keyed(df: DataFrame, name: str, probes: bool) -> DataFrame:
        w = F.col(word)
        # A fixed number of parts: words are few bytes, and their keys are many.
        spread = df.select(block, word).repartition(parts, word)
        short = spread.where(F.char_length(w) < LONG + 2).select(block, w.alias(name), F.explode(deletions(w, F.char_length(w) >= two_from)).alias("d")).select(block, name, F.xxhash64(F.lit(0), block, "d").alias("d"))
        met = F.explode(_probes(w) if probes else _segments(w)).alias("d")
        long = spread.where(F.char_length(w) >= LONG).select(block, w.alias(name), met).select(block, name, F.xxhash64(F.lit(1), block, "d").alias("d"))
        return short.unionByName(long)

    met = keyed(left, "a", True).join(keyed(right, "b", False), [block, "d"]).select(block, "a", "b").distinct()

    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            edits = [osa(a, b, 2) for a, b in zip(frame["a"], frame["b"], strict=True)]
            yield frame.assign(edits=edits)

    found = met.mapInPandas(measured, f"{block} string, a string, b string, edits int")
    allowed = F.when((F.char_length("a") >= two_from) & (F.char_length("b") >= two_from), 2).otherwise(1)
    return found.where(F.col("edits") <= allowed)
