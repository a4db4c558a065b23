"""Keyed relational kernels: best, first and latest rows, folds with lineage, positional and divided joins.

All of them state a total order, so that neither partitioning nor arrival order shows in a result. First and
latest rows are partial aggregates (min_by, max_by), not windows: they combine before the shuffle, and
a hot key is no hot partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.session import materialize


def latest_by(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """One row per key: the values of its greatest row by ``order``. Null is the least value of an order."""
    kept = F.max_by(F.struct(*values), F.struct(*order)).alias("kept")
    return rows.groupBy(*keys).agg(kept).select(*keys, *[F.col("kept")[v].alias(v) for v in values])


def first_by(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """One row per key: the values of its least row by ``order``. Null is the least value of an order."""
    kept = F.min_by(F.struct(*values), F.struct(*order)).alias("kept")
    return rows.groupBy(*keys).agg(kept).select(*keys, *[F.col("kept")[v].alias(v) for v in values])


def merged_representations(rows: DataFrame, keys: list[str], record_id: str, order: list[str], values: list[str]) -> DataFrame:
    """Rows of a key as one: the values of its first row, the sorted distinct ids, and how many they were.

    The ids of one key are one value of the result, so they are gathered; all else combines before the shuffle.
    """
    kept = F.min_by(F.struct(*values), F.struct(*order)).alias("kept")
    ids = F.array_sort(F.collect_set(record_id)).alias("lineage")
    return rows.groupBy(*keys).agg(kept, ids, F.count("*").alias("representations")).select(*keys, *[F.col("kept")[v].alias(v) for v in values], "lineage", "representations")


def fold_observations(rows: DataFrame, keys: list[str], order: str, context: list[str] | None = None) -> DataFrame:
    """The survivor of each key after reading its rows in order, and the conflicts on the way.

    rows: keys, order, odds, capture, tab, instance, visible, raw_record_id. Each row meets the survivor:
    equal odds merge lineage and the later one survives; of a hidden and a visible row of one instance the
    visible one; of rows from different captures (tabs, where neither has a capture) the later one; all else is a
    conflict, and the survivor stays. Equal rows in order are read by id. The rows of a key are few: they are
    the sightings of one offer in one event. ``context``: columns (run, event, source) that rows which merge lineage must
    agree in where both have them; rows that do not are an error, as their lineage would name another source.
    """
    own_context = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in context or []], F.lit("").alias("_"))
    seen = F.struct(F.col(order).alias("at"), "raw_record_id", "odds", "capture", "tab", "instance", "visible", own_context.alias("context"))
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(seen)).alias("seen"))
    first = F.col("seen")[0]

    def state(x: Column, lineage: Column, count: Column, conflicts: Column) -> Column:
        return F.struct(x["at"].alias("at"), x["raw_record_id"].alias("id"), x["odds"].alias("odds"), x["capture"].alias("capture"), x["tab"].alias("tab"), x["instance"].alias("instance"), x["visible"].alias("visible"), x["context"].alias("context"), lineage.alias("lineage"), count.alias("n"), conflicts.alias("conflicts"))

    def kept(s: Column, lineage: Column, count: Column, conflicts: Column) -> Column:
        return F.struct(*[s[c].alias(c) for c in ("at", "id", "odds", "capture", "tab", "instance", "visible", "context")], lineage.alias("lineage"), count.alias("n"), conflicts.alias("conflicts"))

    def meet(s: Column, x: Column) -> Column:
        both = F.array_distinct(F.concat(s["lineage"], F.array(x["raw_record_id"])))
        for c in context or []:
            foreign = (s["context"][c] != "") & (x["context"][c] != "") & (s["context"][c] != x["context"][c])
            both = F.when(foreign, F.raise_error(F.lit(f"lineage of another {c} must not merge")).cast("array<string>")).otherwise(both)
        later = x["at"] > s["at"]
        own = F.array(x["raw_record_id"])
        one = F.lit(1)
        same = F.when(later, state(x, both, s["n"] + 1, s["conflicts"])).otherwise(kept(s, both, s["n"] + 1, s["conflicts"]))
        one_instance = (x["instance"] != "") & (x["instance"] == s["instance"]) & (x["visible"] != s["visible"])
        shown = F.when(x["visible"], state(x, own, one, s["conflicts"])).otherwise(s)
        moved = ((x["capture"] != "") & (s["capture"] != "") & (x["capture"] != s["capture"])) | ((x["capture"] == "") & (s["capture"] == "") & (x["tab"] != s["tab"]))
        newest = F.when(later, state(x, own, one, s["conflicts"])).otherwise(s)
        clash = kept(s, s["lineage"], s["n"], s["conflicts"] + 1)
        return F.when(x["odds"].eqNullSafe(s["odds"]), same).when(one_instance, shown).when(moved, newest).otherwise(clash)

    start = state(first, F.array(first["raw_record_id"]), F.lit(1), F.lit(0))
    folded = listed.withColumn("s", F.aggregate(F.slice("seen", 2, F.greatest(F.size("seen") - 1, F.lit(0))), start, meet))
    return folded.select(*keys, F.col("s.id").alias("raw_record_id"), F.col("s.odds").alias("odds"), F.col("s.lineage").alias("lineage"), F.col("s.n").alias("representations"), F.col("s.conflicts").alias("conflicts"))


#: Rows of a key from which they are numbered in several tasks.
HOT_ROWS = 1_000_000


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Add the number of each row among those of its key, by order, from 1. Null is a key like any other.

    The rows of a hot key are cut into ranges of their order: each range is numbered by itself and begins where the
    ranges before it end. Equal rows in order stand together, and which of them comes first is not defined.
    """
    number = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint")
    hot = materialize(rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") >= HOT_ROWS)) if keys else None
    if hot is not None and hot.isEmpty():
        return rows.withColumn(name, number(keys))
    named = hot.select(F.struct(*keys).alias("__key")) if keys else None
    marked = rows.withColumn("__key", F.struct(*keys) if keys else F.lit(0))
    cool = marked.join(named, "__key", "left_anti").drop("__key").withColumn(name, number(keys)) if keys else None
    warm = marked.join(named, "__key", "left_semi") if keys else marked
    # The ranges are pinned by a checkpoint: a range of another sampling would be another one.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(warm.repartitionByRange(parts, "__key", *order).withColumn("__range", F.spark_partition_id()))
    sizes = placed.groupBy("__key", "__range").agg(F.count("*").alias("__n"))
    begins = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy("__key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = placed.withColumn(name, number(["__key", "__range"])).join(F.broadcast(begins.drop("__n")), ["__key", "__range"])
    out = out.withColumn(name, F.col(name) + F.col("__before")).drop("__key", "__range", "__before")
    return out if cool is None else cool.unionByName(out)


def nth_occurrence_join(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """The n-th row of a key on the left with the n-th of it on the right; rows without a partner are dropped."""
    return numbered(left, keys, left_order, "occurrence").join(numbered(right, keys, right_order, "occurrence"), [*keys, "occurrence"])


def chain_ends(rows: DataFrame, row_id: str, before: str) -> DataFrame:
    """(row, root, steps, cyclic) of each row of a chain: where its pointers to the row before end, and how many they are.

    By pointer doubling: chains of n rows take log2(n) rounds, whatever their length. A pointer to a row that does not
    exist ends there. Rows on a cycle, and those that lead to one, are ``cyclic``: after so many doublings that no chain of
    the table could be longer they still have a pointer.
    """
    known = rows.select(F.col(row_id).alias("row"), F.col(before).alias("up"))
    exists = known.select(F.col("row").alias("up"), F.lit(True).alias("there"))
    now = known.join(exists, "up", "left").select("row", F.when(F.col("there"), F.col("up")).alias("up"), F.when(F.col("there"), 1).otherwise(0).cast("bigint").alias("steps"))
    now = materialize(now.withColumn("root", F.coalesce("up", "row")))
    total, length = now.count(), 1
    while length <= total and not now.where("up is not null").isEmpty():
        ahead = now.select(F.col("row").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"), F.col("root").alias("end"))
        met = now.join(ahead, "up", "left")
        now = materialize(met.select("row", F.col("next").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.coalesce("end", "root").alias("root")))
        length *= 2
    return now.select("row", "root", "steps", F.col("up").isNotNull().alias("cyclic"))


def common_keys(rows: DataFrame, group: str, member: str, key: str) -> DataFrame:
    """(group, key) of the keys that every member of a group has: relational division."""
    members = rows.groupBy(group).agg(F.count_distinct(member).alias("members"))
    held = rows.groupBy(group, key).agg(F.count_distinct(member).alias("holders"))
    return held.join(members, group).where("holders = members").select(group, key)


def gapless(rows: DataFrame, key: str, number: str) -> DataFrame:
    """(key, n, complete): whether a key's numbers are 1..n, each once."""
    got = rows.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(number).alias("d"), F.min(number).alias("lo"), F.max(number).alias("hi"))
    return got.select(key, "n", F.coalesce((F.col("n") == F.col("d")) & (F.col("lo") == 1) & (F.col("hi") == F.col("n")), F.lit(False)).alias("complete"))


def not_one_to_one(rows: DataFrame, left: str, right: str) -> DataFrame:
    """(side, value, partners) of every value that has several partners."""
    sides = [rows.groupBy(F.col(a).cast("string").alias("value")).agg(F.count_distinct(b).alias("partners")).withColumn("side", F.lit(a)) for a, b in ((left, right), (right, left))]
    return sides[0].unionByName(sides[1]).where("partners > 1").select("side", "value", "partners")


def active_rows(rows: DataFrame, row_id: str, supersedes: str) -> DataFrame:
    """Rows that no row supersedes."""
    replaced = rows.where(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias(row_id)).distinct()
    return rows.join(replaced, row_id, "left_anti")


def id_algebra(raw: DataFrame, accepted: DataFrame, quarantined: DataFrame, row_id: str) -> DataFrame:
    """Counts of ids in one pass: raw, accepted, quarantined, in both, in neither, and unknown to raw."""
    parts = None
    for name, df in (("r", raw), ("a", accepted), ("q", quarantined)):
        part = df.select(row_id, *[F.lit(int(name == n)).alias(n) for n in "raq"])
        parts = part if parts is None else parts.unionByName(part)
    flags = parts.groupBy(row_id).agg(*[F.max(n).alias(n) for n in "raq"])
    count = lambda cond: F.coalesce(F.sum(F.expr(f"CASE WHEN {cond} THEN 1 ELSE 0 END")), F.lit(0)).cast("bigint")
    return flags.agg(count("r = 1").alias("raw"), count("a = 1").alias("accepted"), count("q = 1").alias("quarantined"), count("a = 1 AND q = 1").alias("overlap"), count("r = 1 AND a = 0 AND q = 0").alias("unaccounted"), count("r = 0").alias("foreign_ids"))


def resolved_by_evidence(rows: DataFrame, evidence: DataFrame, row_id: str, link: str, value: str, context: list[str], unknown: str) -> DataFrame:
    """(row_id, value, state, foreign) of each row: its value, told by evidence that is linked to it where it is unknown.

    rows: row_id, link, value, context; evidence: link, value, context, each of them once or often. Evidence counts where it
    agrees with the row in every column of the context, null being empty; other evidence of the same link is foreign and only
    counted. State: PRESERVED, or CONFLICT where the evidence says otherwise; RESOLVED where all evidence of an unknown row says
    the same; EVIDENCE_CONFLICT where it does not; NO_EVIDENCE. Null, and ``unknown``, is an unknown value. Evidence combines by
    link, context and value before the join, so a link that is met very often is no hot key.
    """
    same = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    told = evidence.where(F.col(value).isNotNull() & (F.col(value) != unknown) & F.col(link).isNotNull())
    told = told.groupBy(F.col(link).alias("__link"), F.struct(*[same(c).alias(c) for c in context]).alias("__context")).agg(F.count("*").alias("__n"), F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    own = rows.select(row_id, F.col(link).alias("__link"), F.col(value).alias("__value"), F.struct(*[same(c).alias(c) for c in context]).alias("__own"))
    met = own.join(told, "__link", "left").withColumn("__valid", F.col("__own") == F.col("__context"))
    one = lambda c: F.max(F.when(F.col("__valid"), F.col(c))).alias(c)
    foreign = F.coalesce(F.sum(F.when(~F.col("__valid"), F.col("__n"))), F.lit(0)).alias("foreign")
    got = met.groupBy(row_id, "__value").agg(one("__lo"), one("__hi"), foreign)
    known = F.col("__value").isNotNull() & (F.col("__value") != unknown)
    lo, hi = F.col("__lo"), F.col("__hi")
    state = F.when(known & (lo.isNull() | ((lo == F.col("__value")) & (hi == F.col("__value")))), "PRESERVED").when(known, "CONFLICT").when(lo.isNull(), "NO_EVIDENCE").when(lo == hi, "RESOLVED").otherwise("EVIDENCE_CONFLICT")
    return got.select(row_id, F.when(~known & (lo == hi), lo).when(known, F.col("__value")).otherwise(unknown).alias(value), state.alias("state"), "foreign")
