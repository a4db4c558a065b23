"""The offers view: price observations derived from the star schema, so that every kernel has input.

One expression per column, in both engines: the SQL text is the oracle's, the DataFrame is the engine's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OFFERS_SQL = """
offer_keys AS (SELECT *, CAST(floor(l_orderkey / 16) AS BIGINT) AS event_id, l_orderkey % 16 AS place, l_orderkey % 6 AS fam,
             CAST(floor(l_orderkey / 6) AS BIGINT) % 2 AS tw FROM lineitem),
offer_kinds AS (SELECT *, CASE fam WHEN 0 THEN '1X2' WHEN 1 THEN 'DNB' WHEN 2 THEN 'GOALS_OU' WHEN 3 THEN 'BTTS'
                         WHEN 4 THEN 'HANDICAP_EUROPEAN' ELSE 'PLAYER_PROP' END AS family,
             CASE WHEN fam = 0 OR (fam = 4 AND tw = 0) THEN 3 ELSE 2 END AS n_out FROM offer_keys),
offers AS (SELECT event_id, CAST(l_orderkey AS BIGINT) AS market_id, CAST(l_linenumber AS BIGINT) AS source_index, family,
  CASE WHEN place BETWEEN 6 AND 11 THEN '1ST_HALF' ELSE 'FULL_TIME' END AS period,
  CASE WHEN fam = 4 THEN CASE WHEN tw = 0 THEN 'THREE_WAY' ELSE 'TWO_WAY' END ELSE '' END AS handicap_kind,
  CASE WHEN fam IN (0, 1, 3) THEN '' WHEN fam = 4 THEN CASE l_orderkey % 5 WHEN 0 THEN '-1.5' WHEN 1 THEN '-0.5' WHEN 2 THEN '0.5' WHEN 3 THEN '1.5' ELSE '-2.5' END
       ELSE '2.5' END AS line,
  CASE WHEN n_out = 3 THEN CASE l_linenumber % 3 WHEN 0 THEN 'AWAY' WHEN 1 THEN 'HOME' ELSE 'DRAW' END
       WHEN fam IN (2, 5) THEN CASE l_linenumber % 2 WHEN 1 THEN 'OVER' ELSE 'UNDER' END
       WHEN fam = 3 THEN CASE l_linenumber % 2 WHEN 1 THEN 'YES' ELSE 'NO' END
       ELSE CASE l_linenumber % 2 WHEN 1 THEN 'HOME' ELSE 'AWAY' END END AS selection,
  l_returnflag AS tab, l_linestatus AS capture,
  concat_ws(':', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS raw_record_id,
  1.25e0 + (CAST(floor(l_extendedprice) AS BIGINT) % 24) * 0.25e0 AS odds FROM offer_kinds)
"""


def offers(lineitem: DataFrame) -> DataFrame:
    """Price observations: one row per line, with event, market, period, line, selection and odds."""
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    fam, two_way = key % 6, F.floor(key / 6) % 2 == 1
    handicap, three = fam == 4, (fam == 0) | ((fam == 4) & ~two_way)
    odd = line % 2 == 1
    return lineitem.select(
        F.floor(key / 16).alias("event_id"),
        key.cast("bigint").alias("market_id"),
        line.cast("bigint").alias("source_index"),
        F.element_at(F.array(*map(F.lit, ("1X2", "DNB", "GOALS_OU", "BTTS", "HANDICAP_EUROPEAN", "PLAYER_PROP"))), (fam + 1).cast("int")).alias("family"),
        F.when((key % 16).between(6, 11), "1ST_HALF").otherwise("FULL_TIME").alias("period"),
        F.when(handicap, F.when(two_way, "TWO_WAY").otherwise("THREE_WAY")).otherwise("").alias("handicap_kind"),
        F.when(fam.isin(0, 1, 3), "").when(handicap, F.element_at(F.array(*map(F.lit, ("-1.5", "-0.5", "0.5", "1.5", "-2.5"))), (key % 5 + 1).cast("int"))).otherwise("2.5").alias("line"),
        F.when(three, F.element_at(F.array(*map(F.lit, ("AWAY", "HOME", "DRAW"))), (line % 3 + 1).cast("int")))
        .when(fam.isin(2, 5), F.when(odd, "OVER").otherwise("UNDER"))
        .when(fam == 3, F.when(odd, "YES").otherwise("NO"))
        .otherwise(F.when(odd, "HOME").otherwise("AWAY"))
        .alias("selection"),
        F.col("l_returnflag").alias("tab"),
        F.col("l_linestatus").alias("capture"),
        F.concat_ws(":", key.cast("string"), line.cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("raw_record_id"),
        (F.lit(1.25) + (F.floor("l_extendedprice") % 24) * F.lit(0.25)).alias("odds"),
    )
