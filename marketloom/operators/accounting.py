"""Accounting: layers that must add up, shares of completeness, states of parts and of their whole, and collapsed errors.

All are one aggregate per group and column expressions over its counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def layers(raw: Column, representatives: Column, exported: Column, accepted: Column, quarantined: Column) -> dict[str, Column]:
    """Rows suppressed as duplicates, and whether what was exported is what was accepted and quarantined."""
    return {"duplicates_suppressed": F.greatest(F.lit(0), raw - representatives), "consistent": exported == accepted + quarantined}


def share(good: Column, total: Column) -> Column:
    """Percent with one digit, ties to even, of ``good`` within 0 and ``total``; 100 of nothing."""
    held = F.greatest(F.lit(0), F.least(good, total))
    return F.when(total <= 0, F.lit(100.0)).otherwise(F.bround(held * F.lit(100.0) / total, 1))


def completeness(detected: Column, scanned: Column, raw: Column, parsed: Column, unknown: Column, incomplete: Column, excluded: Column, unaccounted: Column) -> dict[str, Column]:
    """Five shares and their mean: parts scanned, rows parsed, rows placed, whole instances, rows kept. Rows that nothing
    accounts for make the first share zero."""
    parts = {
        "coverage": F.when(unaccounted > 0, F.lit(0.0)).otherwise(share(scanned, detected)),
        "parse": share(parsed, raw),
        "placed": share(F.greatest(F.lit(0), parsed - unknown), parsed),
        "instances": share(F.greatest(F.lit(0), parsed - incomplete), parsed),
        "kept": share(F.greatest(F.lit(0), raw - excluded), raw),
    }
    total = parts["coverage"] + parts["parse"] + parts["placed"] + parts["instances"] + parts["kept"]
    return {**parts, "score": F.bround(total / 5, 1)}


def whole_state(states: Column, missing: Column, expected: Column, seen: Column) -> Column:
    """PASS, PARTIAL or FAIL of a whole from the array of its parts' states, the array of parts that are missing, and the
    numbers of parts expected (0: not known) and seen. A whole without parts fails."""
    failed = F.array_contains(states, "FAIL")
    partial = (F.size(missing) > 0) | ((expected > 0) & (expected != seen)) | F.array_contains(states, "PARTIAL")
    return F.when((F.size(states) == 0) & (F.size(missing) == 0), "FAIL").when(failed, "FAIL").when(partial, "PARTIAL").otherwise("PASS")


def collapsed_errors(errors: DataFrame, key: str, error: str, prefixes: list[str]) -> DataFrame:
    """(key, error) with the errors of a record as one: ``PREFIX:record:detail`` becomes ``PREFIX:detail:COUNT=n`` for the
    prefixes given; all others come once. Null is no error."""
    parts = F.split(error, ":", 3)
    grouped = errors.where(F.col(error).isNotNull()).select(F.col(key), F.col(error).alias("__e"), parts.alias("__p"))
    known = F.col("__p")[0].isin(*prefixes) & (F.size("__p") >= 2)
    said = F.when(known, F.col("__p")[0]), F.when(known, F.coalesce(F.get("__p", F.lit(2)), F.lit("")))
    counted = grouped.groupBy(key, said[0].alias("__prefix"), said[1].alias("__detail"), F.when(~known, F.col("__e")).alias("__other")).agg(F.count("*").alias("__n"))
    text = F.when(F.col("__other").isNotNull(), F.col("__other")).otherwise(
        F.concat("__prefix", F.lit(":"), F.when(F.col("__detail") != "", F.concat("__detail", F.lit(":"))).otherwise(""), F.lit("COUNT="), F.col("__n").cast("string"))
    )
    return counted.select(key, text.alias(error)).distinct()


def set_difference(rows: DataFrame, keys: list[str], value: str, known: list[str]) -> DataFrame:
    """(keys, value): the sorted distinct values of each key that are not among the known ones; keys without any are left out."""
    return rows.where(F.col(value).isNotNull() & ~F.col(value).isin(*known)).groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias(value))


def still_open(seen: Column, active: Column, done: Column) -> Column:
    """Of what was seen, what is active and not done: arrays in, a sorted array out; what is no longer active is dropped."""
    return F.array_sort(F.array_except(F.array_intersect(seen, active), done))
