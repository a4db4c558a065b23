from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.streaming import incremental


def table(spark, rows):
    return spark.createDataFrame(rows, "k string, ts string, v int").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


ROWS = [("a", "2025-01-01 00:10:00", 1), ("a", "2025-01-01 00:50:00", 2), ("b", "2025-01-01 03:00:00", 3), ("a", "2025-01-01 09:00:00", 4)]


def test_stream_equals_batch_and_goes_on(spark, tmp_path):
    folder, target, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    rows = table(spark, ROWS)
    rows.limit(2).write.parquet(folder)
    build = lambda s: incremental.first_seen(s, ["k"], "ts", "30 days").select("k")
    assert sorted(r["k"] for r in incremental.run_available(spark, folder, rows, build, target, progress).collect()) == ["a"]
    rows.where("v >= 3").write.mode("append").parquet(folder)
    assert sorted(r["k"] for r in incremental.run_available(spark, folder, rows, build, target, progress).collect()) == ["a", "b"]


def test_windows_stream_and_batch(spark, tmp_path):
    rows = table(spark, ROWS)
    rows.write.parquet(str(tmp_path / "in"))
    build = lambda s: incremental.windowed_counts(s, "ts", "1 hour", ["k"], "1 day")
    got = incremental.run_available(spark, str(tmp_path / "in"), rows, build, str(tmp_path / "out"), str(tmp_path / "c"), "complete")
    want = build(rows)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and want.count() == 3


def test_sessions_late_rows_and_pending(spark):
    rows = table(spark, ROWS)
    assert sorted((r["k"], r["n"]) for r in incremental.session_counts(rows, "ts", "1 hour", "k", "1 day").collect()) == [("a", 1), ("a", 2), ("b", 1)]
    late = rows.withColumn("until", F.when(F.col("v") != 3, F.lit("2025-01-01 00:30:00").cast("timestamp_ntz")))
    assert [r["in_time"] for r in incremental.flagged_late(late, "ts", "until").orderBy("v").collect()] == [True, False, False, False]
    ends = rows.where("v = 2").select("k", F.col("ts").alias("end_ts"))
    got = incremental.correlated(rows.where("v in (1, 3)"), ends, "k", "ts", "end_ts", "1 HOUR", "1 day").orderBy("v").collect()
    assert [r["end_ts"] is None for r in got] == [False, True]


def test_stream_stream_correlation(spark, tmp_path):
    rows = table(spark, ROWS)
    rows.where("v in (1, 3)").write.parquet(str(tmp_path / "a"))
    rows.where("v = 2").select("k", F.col("ts").alias("end_ts")).write.parquet(str(tmp_path / "b"))
    left = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "a"))
    right = spark.readStream.schema("k string, end_ts timestamp_ntz").parquet(str(tmp_path / "b"))
    joined = incremental.correlated(left, right, "k", "ts", "end_ts", "1 HOUR", "1 hour")
    query = joined.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = [r for r in spark.read.parquet(str(tmp_path / "o")).collect() if r["end_ts"] is not None]
    assert [(r["k"], r["v"]) for r in got] == [("a", 1)]
