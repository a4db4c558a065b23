"""Prices that mean the same compared, rates fitted to several markets, and markets linked in chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.keyed import numbered

#: Least gain, in percent, of a better price, and most relative gap of prices that are copies and not a collision.
LEAST_GAIN, MOST_GAP = 0.01, 0.5


def better_prices(rows: DataFrame, scope: str, signature: str, rule: str, market: str, category: str, odds: str, index: str, exact_rule: str) -> DataFrame:
    """(scope, signature, rule, best_market, best_category, best_odds, copy_no, market, category, odds, gain_percent).

    rows: one for every signature under which a price means the same as others, and the rule that says so. Of groups with the
    very same rows the first by signature and rule counts. Under ``exact_rule`` a group whose prices lie further apart
    than ``MOST_GAP`` is a collision and gives nothing. Copies are numbered from the best; null prices are none.

    Groups are told apart by a sum of row hashes, which combines before the shuffle: no group is gathered.
    """
    rows = rows.where(F.col(odds).isNotNull())
    group = [scope, signature, rule]
    marks = [F.sum(F.xxhash64(F.lit(i), index, market, category, odds).cast("decimal(20,0)")).alias(f"h{i}") for i in (1, 2)]
    best = F.min_by(F.struct(market, category), F.struct((-F.col(odds)).alias("o"), F.col(market).alias("m"), F.col(category).alias("c"), F.col(index).alias("i"))).alias("b")
    groups = rows.groupBy(*group).agg(F.count("*").alias("n"), *marks, best, F.max(odds).alias("best_odds"), F.min(odds).alias("low"))
    first = groups.groupBy(scope, "n", "h1", "h2").agg(F.min_by(F.struct(signature, rule, "b", "best_odds", "low"), F.struct(signature, rule)).alias("g"))
    alerts = first.where((F.col("g.low") < F.col("g.best_odds")) & ((F.col(f"g.{rule}") != exact_rule) | (F.col("g.best_odds") / F.col("g.low") - 1 <= MOST_GAP)))
    alerts = alerts.select(scope, f"g.{signature}", f"g.{rule}", F.col(f"g.b.{market}").alias("best_market"), F.col(f"g.b.{category}").alias("best_category"), "g.best_odds")
    copies = rows.select(*group, market, category, odds, index).join(alerts, group).withColumn("gain", (F.col("best_odds") / F.col(odds) - 1) * 100)
    copies = copies.where((F.col(odds) < F.col("best_odds")) & (F.col("gain") >= LEAST_GAIN)).withColumn("down", -F.col(odds))
    found = numbered(copies, group, ["down", market, category, index], "copy_no")
    return found.select(*group, "best_market", "best_category", "best_odds", "copy_no", market, category, odds, F.round("gain", 6).alias("gain_percent"))


def fitted_rates(rows: DataFrame, key: str, rate: str, weight: str, ties: list[str]) -> DataFrame:
    """(key, rate, residual, dispersion, markets, confidence): the weighted median of a key's rates and how well they agree.

    residual: root of the weighted mean square distance from it; dispersion: median distance. Fixed values: HIGH confidence
    from three rates on with a residual of at most 0.35, MEDIUM from two, LOW of one. Rows without a rate do not count.
    """
    given = rows.where(F.col(rate).isNotNull())
    run = F.sum(weight).over(Window.partitionBy(key).orderBy(rate, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    half = F.sum(weight).over(Window.partitionBy(key)) / 2
    marked = given.withColumns({"__run": run, "__half": half})
    middle = marked.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("__run") >= F.col("__half"), F.col(rate))), F.max(rate)).alias("__fit"))
    off = F.col(rate) - F.col("__fit")
    got = given.join(middle, key).groupBy(key, "__fit").agg(
        F.sqrt(F.sum(F.col(weight) * off * off) / F.sum(weight)).alias("residual"), F.percentile(F.abs(off), 0.5).alias("dispersion"), F.count("*").alias("markets")
    )
    confidence = F.when((F.col("markets") >= 3) & (F.col("residual") <= 0.35), "HIGH").when(F.col("markets") >= 2, "MEDIUM").otherwise("LOW")
    return got.select(key, F.col("__fit").alias(rate), "residual", "dispersion", "markets", confidence.alias("confidence"))


def market_chains(markets: DataFrame, scope: str, market: str, family: str, chains: dict[str, list[str]]) -> DataFrame:
    """(scope, chain, markets): the sorted markets of each chain of families, where there are two or more."""
    links = F.array_compact(F.array(*[F.when(F.col(family).isin(*families), F.lit(chain)) for chain, families in chains.items()]))
    each = markets.select(scope, market, F.explode(links).alias("chain")).groupBy(scope, "chain").agg(F.array_sort(F.collect_set(market)).alias("markets"))
    return each.where(F.size("markets") >= 2)
