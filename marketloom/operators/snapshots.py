"""What changed between full snapshots, by content-defined chunks.

Rows of a snapshot are sorted by key inside a bucket that the key's hash names; a row whose own hash says
so begins a new chunk, so the same rows fall into the same chunks in every snapshot, whatever was added or
removed elsewhere. Chunks of consecutive snapshots with equal digests are discarded unread; only the rows
of the others meet by key. Everything after the one shuffle by bucket happens in place: the chunk digests,
the comparison and the classification are all clustered by the bucket. Buckets are by hash, so that no
event, market or selection can be hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.keyed import numbered
from marketloom.session import materialize

#: One row in so many begins a chunk.
CHUNK_ROWS = 64
#: Rows a bucket should hold, of all snapshots together.
BUCKET_ROWS = 20_000
#: Most snapshots whose numbers are put in order in one task and broadcast; more are numbered in ranges and joined by shuffle.
BROADCAST_SNAPSHOTS = 100_000


def _neighbours(sizes: DataFrame, count: int) -> DataFrame:
    """(no, prev, next) of each snapshot number."""
    if count <= BROADCAST_SNAPSHOTS:
        in_order = Window.orderBy("no")
        return F.broadcast(sizes.select("no").withColumn("prev", F.lag("no").over(in_order)).withColumn("next", F.lead("no").over(in_order)))
    placed = numbered(sizes.select("no"), [], ["no"], "place")
    beside = lambda step, name: placed.select((F.col("place") + step).alias("place"), F.col("no").alias(name))
    return placed.join(beside(1, "prev"), "place", "left").join(beside(-1, "next"), "place", "left").drop("place")


def snapshot_changes(rows: DataFrame, number: str, keys: list[str], value: str) -> DataFrame:
    """(prev_<number>, <number>, keys..., change_kind) against the next lower number present.

    change_kind is ``added``, ``removed`` or ``changed`` (the value differs, also to or from null). Null is a
    key value like any other; rows without a number belong to no snapshot. Repeated rows count once; if
    they disagree in value, the least value counts and null before any other. Nothing comes of the first
    snapshot, of a single one, or of an empty table.
    """
    placed = rows.where(F.col(number).isNotNull()).select(F.col(number).alias("no"), F.struct(*[F.col(k) for k in keys]).alias("key"), F.col(value).alias("value"))
    spark = rows.sparkSession
    sizes = materialize(placed.groupBy("no").agg(F.count("*").alias("rows")))
    found = sizes.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count("*").alias("numbers")).first()
    # More than the shuffle's partitions, else some of them would stay empty and others hold two.
    buckets = max(1, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), found["rows"] // BUCKET_ROWS)
    numbers = _neighbours(sizes, found["numbers"])
    placed = placed.withColumn("h", F.xxhash64("key")).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    placed = placed.repartition("bucket")
    single = placed.groupBy("bucket", "no", "key", "h").agg(F.min(F.struct(F.col("value").isNotNull().alias("given"), F.col("value").alias("value"))).alias("v"))
    in_order = Window.partitionBy("bucket", "no").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = F.pmod(F.shiftrightunsigned("h", 20), F.lit(CHUNK_ROWS)) == 0
    # A chunk is named by the key that begins it; the first of a bucket by null.
    chunked = single.withColumn("anchor", F.last(F.when(begins, F.col("key")), ignorenulls=True).over(in_order))
    chunks = chunked.groupBy("bucket", "no", "anchor").agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("key", "v").cast("decimal(20,0)")).alias("d1"),
        F.sum(F.xxhash64(F.lit(7), "v", "key").cast("decimal(20,0)")).alias("d2"),
        F.collect_list(F.struct("key", F.col("v.value").alias("value"))).alias("rows"),
    )
    chunks = chunks.join(numbers, "no")
    by_place = Window.partitionBy("bucket", "anchor").orderBy("no")
    digest = F.struct("no", "n", "d1", "d2")
    before, after = F.lag(digest).over(by_place), F.lead(digest).over(by_place)
    same = lambda other, no: other["no"].eqNullSafe(F.col(no)) & (other["n"] == F.col("n")) & (other["d1"] == F.col("d1")) & (other["d2"] == F.col("d2"))
    marked = chunks.withColumns({"b": before, "a": after})
    roles = F.array_compact(F.array(
        F.when(F.col("prev").isNotNull() & ~F.coalesce(same(F.col("b"), "prev"), F.lit(False)), F.struct(F.col("no").alias("of"), F.lit(True).alias("new"))),
        F.when(F.col("next").isNotNull() & ~F.coalesce(same(F.col("a"), "next"), F.lit(False)), F.struct(F.col("next").alias("of"), F.lit(False).alias("new"))),
    ))
    left = marked.withColumn("roles", roles).where(F.size("roles") > 0)
    sides = left.select("bucket", F.explode("roles").alias("role"), "rows").select("bucket", "role.*", F.explode("rows").alias("row")).select("bucket", "of", "new", "row.*")
    side = lambda new: F.max(F.when(F.col("new") == new, F.struct(F.col("value"))))
    met = sides.groupBy("bucket", "of", "key").agg(side(True).alias("now"), side(False).alias("was"))
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(~F.col("now.value").eqNullSafe(F.col("was.value")), "changed")
    out = met.withColumn("change_kind", kind).where("change_kind is not null").join(numbers, F.col("of") == F.col("no"))
    return out.select(F.col("prev").alias(f"prev_{number}"), F.col("of").alias(number), *[F.col("key")[k].alias(k) for k in keys], "change_kind")
