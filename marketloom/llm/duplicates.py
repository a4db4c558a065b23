"""Duplicates hidden by formatting: one record each, and the number of its copies.

Each (field name, normalised value) pair is hashed by itself and the hashes are added up, so the order of
the pairs, and of the values of a packed field, has no part in the fingerprint. Records meet by
fingerprint; the least id of each group is found by a partial aggregate, so that a group that holds a third of
all rows is no hot task; every other member is then compared with it field by field. Members that only
share the fingerprint are grouped again by their exact fields.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from marketloom.operators.packed import BLANKS, Packing, blocks, unquoted
from marketloom.session import materialize

# Stand-ins for the marks that carry meaning, from the private use area.
_MARK, _MINUS, _PLUS = "\ue001", "\ue002", "\ue003"


def plain(text: Column) -> Column:
    """Text without blanks, letter case and punctuation; null is empty.

    Kept are a sign directly before a number that no letter or digit precedes, and the mark inside a number
    (comma or point, which are equal).
    """
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, r"(?<=\p{N})[.,](?=\p{N})", _MARK)
    out = F.regexp_replace(out, r"(?<![\p{L}\p{N}])[-−](?=\p{N})", _MINUS)
    out = F.regexp_replace(out, r"(?<![\p{L}\p{N}])\+(?=\p{N})", _PLUS)
    return F.regexp_replace(out, "[^\\p{L}\\p{N}\\p{M}\ue001-\ue003]+", "")


def plain_number(text: Column) -> Column:
    """A number text in one spelling; what is no number as ``plain`` text; null is empty."""
    number = F.regexp_replace(F.btrim(text, F.lit(BLANKS)), ",", ".").try_cast("decimal(38,12)")
    return F.coalesce(F.concat(F.lit("#"), F.format_number(number, 12)), plain(text))


def plain_values(text: Column, how: Packing) -> Column:
    """The values of a packed text, each as ``plain`` text, without the empty ones; null gives none."""
    values = F.transform(blocks(F.coalesce(text, F.lit("")), how), lambda b: plain(unquoted(b)))
    return F.filter(values, lambda v: v != "")


def _sum_of(name: str, values: Column, seed: int) -> Column:
    # 44 bits of each hash: half a million values do not overflow the sum.
    one = lambda v: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(name), v), 20)
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda s, v: s + one(v))


@F.pandas_udf(BooleanType())
def _counted_alike(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([Counter(x) == Counter(y) for x, y in zip(a, b, strict=True)], dtype=bool)


#: Values from which two lists are counted in one pass each; shorter ones are compared inside the JVM. The result is the same.
LONG_LIST = 100


def _same_multiset(a: Column, b: Column) -> Column:
    """Equal as multisets, by counting: neither list is sorted."""
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    counted = F.forall(a, lambda x: times(a, x) == times(b, x))
    return (F.size(a) == F.size(b)) & F.when(a == b, True).otherwise(counted)


#: Members of a group from which they are dealt to several tasks.
HOT_MEMBERS = 100_000
#: Most ids or groups that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 500_000


def _small(df: DataFrame, count: int) -> DataFrame:
    return F.broadcast(df) if count <= BROADCAST_ROWS else df


def duplicate_groups(rows: DataFrame, row_id: str, key: str, texts: list[str], numbers: list[str], packed: dict[str, Packing]) -> DataFrame:
    """(keep_id, copy_id) of each surplus copy, with the least id of its group.

    Copies agree in ``key`` (exactly; null is empty) and, apart from blanks, case and punctuation, in all of
    ``texts``; as numbers in ``numbers``; as multisets of values in ``packed``. Null equals empty in
    every field, so rows of which all fields are empty are copies of each other. Rows without an id are
    left out. An empty table gives no rows; so does one without copies.

    The fields of all rows are normalised once, for the fingerprints, which are kept without them; those of rows whose fingerprint
    comes several times are normalised once more, to be verified.
    """
    fields = {key: F.coalesce(F.col(key).cast("string"), F.lit(""))} | {c: plain(F.col(c)) for c in texts} | {c: plain_number(F.col(c)) for c in numbers}
    lists = {c: plain_values(F.col(c), how) for c, how in packed.items()}

    def fingerprint(seed: int) -> Column:
        total = F.lit(0).cast("bigint")
        for i, name in enumerate(fields):
            total = total + F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(name), F.col("f")[f"s{i}"]), 20)
        for i, name in enumerate(lists):
            total = total + _sum_of(name, F.col("f")[f"v{i}"], seed)
        return total

    def hashed(some: DataFrame) -> DataFrame:
        ready = some.select(F.col(row_id).alias("id"), F.struct(*[v.alias(f"s{i}") for i, v in enumerate(fields.values())], *[v.alias(f"v{i}") for i, v in enumerate(lists.values())]).alias("f"))
        # The array of a generator is a barrier: the fields are computed once, not once for each use.
        return ready.select("id", F.explode(F.array("f")).alias("f")).select("id", "f", fingerprint(1).alias("h1"), fingerprint(2).alias("h2"))

    given = rows.where(F.col(row_id).isNotNull()).select(row_id, key, *texts, *numbers, *packed)
    prints = materialize(hashed(given).select("id", "h1", "h2"))
    groups = materialize(prints.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").withColumn("cuts", F.ceil(F.col("n") / HOT_MEMBERS).cast("int")))
    size = groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("members")).first()
    wanted = prints.join(_small(groups.select("h1", "h2"), size["groups"]), ["h1", "h2"], "left_semi").select(F.col("id").alias(row_id)).distinct()
    members = hashed(given.join(_small(wanted, size["members"]), row_id, "left_semi"))
    members = materialize(members.join(_small(groups.select("h1", "h2", "cuts"), size["groups"]), ["h1", "h2"]))
    least = members.groupBy("h1", "h2").agg(F.min_by("f", "id").alias("kept"), F.min("id").alias("keep_id"), F.max("cuts").alias("cuts"))
    # Of a hot group every piece of its members meets a copy of the kept row.
    least = least.select("h1", "h2", "kept", "keep_id", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"))
    met = members.withColumn("cut", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")).join(least, ["h1", "h2", "cut"]).where(F.col("id") > F.col("keep_id"))
    same, long = F.lit(True), F.lit(False)
    for i in range(len(fields)):
        same = same & (F.col("f")[f"s{i}"] == F.col("kept")[f"s{i}"])
    for i in range(len(lists)):
        a, b = F.col("f")[f"v{i}"], F.col("kept")[f"v{i}"]
        same = same & ((F.size(a) > LONG_LIST) | _same_multiset(a, b))
        long = long | (F.size(a) > LONG_LIST)
    verified = met.withColumns({"same": same, "long": long})
    by_count = verified.where("same and long")
    for i in range(len(lists)):
        by_count = by_count.withColumn("same", F.col("same") & _counted_alike(F.col("f")[f"v{i}"], F.col("kept")[f"v{i}"]))
    judged = materialize(verified.where("not (same and long)").unionByName(by_count).select("id", "keep_id", "same", F.when(~F.col("same"), F.col("f")).alias("f")))
    # Equal fingerprints of unequal fields: the exact fields decide among those that differ from the kept one.
    exact = F.struct(*[F.col("f")[f"s{i}"] for i in range(len(fields))], *[F.array_sort(F.col("f")[f"v{i}"]) for i in range(len(lists))])
    others = judged.where(~F.col("same")).select("id", exact.alias("x"))
    firsts = others.groupBy("x").agg(F.min("id").alias("keep_id"))
    rest = others.join(firsts, "x").where(F.col("id") > F.col("keep_id")).select("keep_id", F.col("id").alias("copy_id"))
    return judged.where("same").select("keep_id", F.col("id").alias("copy_id")).unionByName(rest)


def copy_counts(pairs: DataFrame) -> DataFrame:
    """(keep_id, copies): the copies of each kept record, itself among them."""
    return pairs.groupBy("keep_id").agg((F.count("*") + 1).alias("copies"))
