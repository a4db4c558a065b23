"""Scalar text functions. All are column expressions, but for the exact Unicode folds, which are Arrow UDFs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


@F.pandas_udf(StringType())
def ascii_folded(texts: pd.Series) -> pd.Series:
    """Compatibility decomposition without what is not ASCII, case folded, blanks collapsed: ``ł`` vanishes. Null is empty."""
    return texts.map(lambda t: " ".join(unicodedata.normalize("NFKD", t or "").encode("ascii", "ignore").decode().casefold().split()))


def contract_text(text: Column) -> Column:
    """As ``ascii_folded``, but ``ł`` is ``l``."""
    return ascii_folded(F.translate(text, "łŁ", "lL"))


def collapsed(text: Column) -> Column:
    """Trimmed, blanks collapsed, lower case; null is empty."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def spaced_ampersands(text: Column) -> Column:
    """As ``collapsed``, each ``&`` standing alone."""
    return collapsed(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s*&\s*", " & "))


def team_name(text: Column) -> Column:
    """A name without a number that stands at its end by itself: digits that belong to the last word stay."""
    return F.trim(F.regexp_replace(F.trim(text), r"\s+\d+$", ""))


def without_repeated_words(text: Column) -> Column:
    """Consecutive equal words once, whatever their case; the first spelling stays."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    kept = F.filter(words, lambda w, i: (i == 0) | (F.lower(w) != F.lower(F.get(words, i - 1))))
    return F.array_join(kept, " ")


def column_role(instance: Column) -> Column:
    """What stands behind ``|column:`` in an instance id; empty if nothing does."""
    return F.regexp_extract(F.coalesce(instance, F.lit("")), r"\|column:([^|]+)", 1)


def line_value(text: Column) -> Column:
    """The line that a text names, as text with its sign: a decimal, else a signed integer, else an integer; null if none."""
    found = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    return F.coalesce(F.replace(found(r"([+-]?\d+[.,]\d+)"), F.lit(","), F.lit(".")), found(r"([+-]\d+)"), found(r"\b(\d+)\b"))


def player_line(text: Column) -> Column:
    """The threshold behind a word for more or less, its decimal mark a point; null if none."""
    said = F.regexp_extract(text, r"(?iu)(?:powyżej|poniżej|over|under)\s+([0-9]+[.,]?[0-9]*)\b", 1)
    return F.nullif(F.replace(said, F.lit(","), F.lit(".")), F.lit(""))


def general_number(value: Column) -> Column:
    """A number in its shortest form of six significant digits (C's ``%g``); minus zero is zero; blanks inside and a decimal
    comma are read; what is no finite number is null."""
    number = F.replace(F.replace(F.trim(value.cast("string")), F.lit(" "), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    finite = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), F.when(number == 0, 0.0).otherwise(number))
    digits = F.format_string("%.5e", finite)
    power = F.regexp_extract(digits, r"e([+-]\d+)$", 1).try_cast("int")
    plain = F.regexp_replace(digits.try_cast("decimal(30,12)").cast("string"), r"\.?0+$", "")
    scientific = F.regexp_replace(digits, r"\.?0+e", "e")
    return F.when(finite.isNull(), None).when(finite == 0, "0").when(power.between(-4, 5), plain).otherwise(scientific)


def line_class(line: Column) -> Column:
    """INTEGER, HALF, QUARTER or OTHER of an exact decimal; INVALID if it is none."""
    part = F.abs(line.try_cast("decimal(10,4)")) % 1
    return F.when(part.isNull(), "INVALID").when(part == 0, "INTEGER").when(part == 0.5, "HALF").when(part.isin(0.25, 0.75), "QUARTER").otherwise("OTHER")


@F.pandas_udf(StructType([StructField("name", StringType()), StructField("state", StringType())]))
def _alias(said: pd.Series, names: pd.Series, least: pd.Series) -> pd.DataFrame:
    compact = lambda t: "".join(c for c in unicodedata.normalize("NFKD", (t or "").casefold()) if c.isalnum())

    def found(text: str | None, known: list, fewest: int) -> tuple[str | None, str]:
        own, others = compact(text), [(n, compact(n)) for n in (() if known is None else known)]
        met = [n for n, c in others if own and own == c] or [n for n, c in others if len(own) >= fewest and (c.endswith(own) or own.endswith(c))]
        return (met[0], "ALIAS") if len(met) == 1 else (text, "AMBIGUOUS" if met else "")

    return pd.DataFrame([found(*x) for x in zip(said, names, least, strict=True)], columns=["name", "state"])


def alias_of(said: Column, names: Column, least: int = 6) -> Column:
    """struct(name, state): the only one of the array ``names`` that is the same but for blanks, case and marks or, where none is
    and the text has ``least`` letters, that ends in the text or in which the text ends, with state ``ALIAS``; the text
    itself with ``AMBIGUOUS`` if several are, and with an empty state if none is."""
    return _alias(said, names, F.lit(least))


def signature(*parts: Column) -> Column:
    """Parts with ``|`` between them; null is empty, so that no part is skipped."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def teams_of(match: Column) -> Column:
    """The two sides of a match text, or null."""
    sides = F.split(match, r"\s+-\s+|\s+vs\.?\s+|\s+v\s+", 2)
    return F.when(F.size(sides) == 2, F.transform(sides, lambda s: F.trim(s)))


def clock(text: Column) -> Column:
    """The first time of day, HH:MM, in a text; null if none."""
    return F.nullif(F.regexp_extract(text, r"(?<!\d)([01]?\d|2[0-3]):([0-5]\d)(?!\d)", 0), F.lit(""))


def only_value(text: Column, pattern: str, group: int = 1) -> Column:
    """What the pattern finds, if all it finds is the same; else null."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), group))
    return F.when(F.size(found) == 1, F.get(found, 0))


def packet_text(text: Column) -> Column:
    """Text without byte order mark, with bare line feeds and without blanks at line ends."""
    lines = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), r"\r\n?", "\n")
    return F.regexp_replace(lines, r"(?m)[ \t]+$", "")


def assignments(text: Column) -> Column:
    """The map of ``KEY="value";`` lines; a key given twice has its last value."""
    keys = F.regexp_extract_all(text, F.lit(r'(?m)^\s*([A-Z][A-Z0-9_]*)\s*=\s*"(.*)"\s*;\s*$'), 1)
    values = F.regexp_extract_all(text, F.lit(r'(?m)^\s*([A-Z][A-Z0-9_]*)\s*=\s*"(.*)"\s*;\s*$'), 2)
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(keys, i + 2, F.size(keys)), lambda k: k == p["k"]))
    return F.map_from_entries(last)


def file_name(text: Column, index: Column | None = None) -> Column:
    """A text as part of a file name: each other character an underscore; ``TAB_`` and the index where nothing is left of it."""
    name = F.regexp_replace(F.regexp_replace(text, r"[^0-9A-Za-z_-]", "_"), r"^_+|_+$", "")
    return name if index is None else F.when(F.coalesce(name, F.lit("")) == "", F.concat(F.lit("TAB_"), index.cast("string"))).otherwise(name)


def canonical_utc(text: Column) -> Column:
    """A zoned RFC 3339 time as UTC text with microseconds; null without an offset, or if unreadable."""
    zoned = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:[Zz]|[+-]\d{2}:\d{2})$")
    return F.when(zoned, F.date_format(F.to_utc_timestamp(text.try_cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
