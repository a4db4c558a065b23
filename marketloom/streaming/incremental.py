"""Incremental forms. Each takes a streaming or a batch frame and gives what the batch form gives, once all is read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_time(rows: DataFrame, column: str) -> DataFrame:
    """The column as an instant: event time without a zone takes no watermark."""
    return rows.withColumn(column, F.col(column).cast("timestamp"))


def first_seen(rows: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """Each key once, as its first sighting within the delay; the state of older keys is dropped."""
    timed = event_time(rows, at)
    return timed.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys) if timed.isStreaming else timed.dropDuplicates(keys)


def windowed_counts(rows: DataFrame, at: str, length: str, keys: list[str], delay: str, slide: str | None = None) -> DataFrame:
    """(window_start, keys, n) by tumbling or sliding windows of event time."""
    timed = event_time(rows, at)
    timed = timed.withWatermark(at, delay) if timed.isStreaming else timed
    frame = F.window(at, length, slide) if slide else F.window(at, length)
    return timed.groupBy(frame.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def session_counts(rows: DataFrame, at: str, gap: str, key: str, delay: str) -> DataFrame:
    """(key, session_start, session_end, n): runs of rows of a key with no gap as long as ``gap``."""
    timed = event_time(rows, at)
    timed = timed.withWatermark(at, delay) if timed.isStreaming else timed
    got = timed.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return got.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def latest_values(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, value, ticks): the value of the greatest row by order, and how many rows there were."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value), F.count("*").alias("ticks"))


def flagged_late(rows: DataFrame, at: str, until: str) -> DataFrame:
    """Add ``in_time``: late rows are kept and flagged before any state, never dropped. Null times are not in time."""
    return rows.withColumn("in_time", F.coalesce(F.col(at) < F.col(until), F.lit(False)))


def correlated(requests: DataFrame, ends: DataFrame, key: str, at: str, end_at: str, wait: str, delay: str) -> DataFrame:
    """Each request with its end within the wait; without one after it, the end is null (pending).

    Time is cut into spans as long as the wait; an end meets the requests of its own span and the one before. So a
    hot key meets itself span by span, in as many tasks as it has spans, and not all of it with all.
    """
    left, right = event_time(requests, at), event_time(ends, end_at).withColumnRenamed(key, "__end_key")
    if left.isStreaming:
        left, right = left.withWatermark(at, delay), right.withWatermark(end_at, delay)
    long = F.expr(f"CAST(INTERVAL {wait} AS INTERVAL SECOND)").cast("bigint")
    span = lambda c: F.floor(F.unix_micros(F.col(c)) / (long * 1_000_000)).cast("bigint")
    left = left.withColumn("__span", span(at))
    right = right.withColumn("__end_span", F.explode(F.array(span(end_at), span(end_at) - 1)))
    near = (F.col(key) == F.col("__end_key")) & (F.col("__span") == F.col("__end_span")) & (F.col(end_at) >= F.col(at)) & (F.col(end_at) <= F.col(at) + F.expr(f"INTERVAL {wait}"))
    return left.join(right, near, "left_outer").drop("__end_key", "__span", "__end_span")


def run_available(spark: SparkSession, folder: str, like: DataFrame, build: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Read a folder of parquet files as a stream, to its present end, into a parquet table; return the table.

    A second run goes on from the checkpoint and reads only what is new. ``complete`` and ``update`` results are
    written by batch, the last one wins.
    """
    stream = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 8).parquet(folder)
    writer = build(stream).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", target).outputMode("append").start()
    else:
        query = writer.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(target)).start()
    query.awaitTermination()
    return spark.read.parquet(target)
