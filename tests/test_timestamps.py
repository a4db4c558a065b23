from __future__ import annotations

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marketloom.functions.timestamps import utc_micros


def micros(*parts) -> int:
    return int((datetime(*parts, tzinfo=UTC) - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1))


CASES = [
    ("2025-02-01T20:39:03+01:00", None, micros(2025, 2, 1, 19, 39, 3)),
    ("2025-02-01T20:39:29+01:00[Europe/Warsaw]", None, micros(2025, 2, 1, 19, 39, 29)),
    ("2025-02-01 20:38:03.537760 +0100", None, micros(2025, 2, 1, 19, 38, 3, 537760)),
    ("2025-02-01 19:39:20,905 UTC", None, micros(2025, 2, 1, 19, 39, 20, 905000)),
    ("20250203T054456Z", None, micros(2025, 2, 3, 5, 44, 56)),
    ("2025/04/01 05:22:05 CEST", None, micros(2025, 4, 1, 3, 22, 5)),
    ("Sat, 11 Oct 2025 06:43:17 GMT", None, micros(2025, 10, 11, 6, 43, 17)),
    ("1738438730", None, 1738438730_000000),
    ("1738944168.28", None, 1738944168_280000),
    ("1738810561763", None, 1738810561763_000),
    ("1738810620104717", None, 1738810620104717),
    ("1.02.25 20:38", "Europe/Warsaw", micros(2025, 2, 1, 19, 38)),
    ("15.10.2025, 02:03", "Europe/Warsaw", micros(2025, 10, 15, 0, 3)),
    ("10 paź 2025 godz. 20:07", "Asia/Tokyo", micros(2025, 10, 10, 11, 7)),
    ("Oct 3, 2025 4:05 PM", "UTC", micros(2025, 10, 3, 16, 5)),
    ("1/15/2026 5:40 AM", "America/New_York", micros(2026, 1, 15, 10, 40)),
    ("12/15/2026 12:40 AM", "UTC", micros(2026, 12, 15, 0, 40)),
    ("12/15/2026 12:40 PM", "UTC", micros(2026, 12, 15, 12, 40)),
    ("2025-10-26 02:30", "Europe/Warsaw", micros(2025, 10, 26, 0, 30)),  # shown twice: the first
    ("2025-03-30 02:30:00", "Europe/Warsaw", None),  # skipped by the clocks
    ("2024-02-29 00:00", "UTC", micros(2024, 2, 29)),
    ("2025-02-29 00:00", "UTC", None),
    ("31.06.2026 20:00", "UTC", None),
    ("2025-02-03 24:01", "UTC", None),
    ("2025-02-03 13:00 PM", "UTC", None),
    ("0000-00-00 00:00:00", "UTC", None),
    ("2025-02-03 01:51", "Nowhere/X", None),
    ("2025-02-03 01:51", None, None),
    ("2025-02-03 01:51 XYZ", "UTC", None),
    ("TBD", "UTC", None),
    ("", "UTC", None),
    (None, "UTC", None),
    ("x" * 200_000, "UTC", None),
]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_cases(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)  # the session's zone has no part in it
    try:
        rows = spark.createDataFrame([(i, t, z) for i, (t, z, _) in enumerate(CASES)], "i int, t string, z string")
        got = {r["i"]: r["u"] for r in rows.select("i", utc_micros(F.col("t"), F.col("z")).alias("u")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [got[i] for i in range(len(CASES))] == [want for _, _, want in CASES]


def test_every_day_of_four_hundred_years(spark):
    days = spark.range(0, 146097, 37).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    got = days.select(utc_micros(F.date_format("d", "yyyy-MM-dd"), F.lit("UTC")).alias("u"), (F.unix_date("d").cast("bigint") * 86_400_000_000).alias("want"))
    assert got.where("u is null or u <> want").count() == 0
