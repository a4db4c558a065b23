"""Queries of the relational kernels over the offers view and the star schema, with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import keyed, numeric
from marketloom.operators.offers import OFFERS_SQL, offers
from marketloom.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
# The complete outcomes of each family of markets.
COMPLETE = {"1X2": ("AWAY", "DRAW", "HOME"), "DNB": ("AWAY", "HOME"), "GOALS_OU": ("OVER", "UNDER"), "BTTS": ("NO", "YES"), "PLAYER_PROP": ("OVER", "UNDER"), "HANDICAP_EUROPEAN:THREE_WAY": ("AWAY", "DRAW", "HOME"), "HANDICAP_EUROPEAN:TWO_WAY": ("AWAY", "HOME")}
_KEY = ["event_id", "family", "period", "handicap_kind", "line"]


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query and its oracle; ``@offers`` in the oracle is the offers view."""

    def register(build: Query) -> Query:
        QUERIES[name] = build
        if oracle:
            ORACLES[name] = oracle.replace("@offers", OFFERS_SQL)
        return build

    return register


def _offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers(table(spark, sf_dir, "lineitem"))


@query("offers_view", "WITH @offers SELECT event_id, market_id, source_index, family, period, handicap_kind, line, selection, tab, capture, raw_record_id, odds FROM offers")
def offers_view(spark, sf_dir):
    """The projection that all kernels read."""
    return _offers(spark, sf_dir)


@query("implied_overround", "WITH @offers SELECT market_id, ROUND(SUM(1 / odds), 6) AS overround, COUNT(*) AS prices FROM offers GROUP BY market_id")
def implied_overround(spark, sf_dir):
    """Sum of implied probabilities of each market."""
    return _offers(spark, sf_dir).groupBy("market_id").agg(F.round(F.sum(1 / F.col("odds")), 6).alias("overround"), F.count("*").alias("prices"))


_BEST = "best AS (SELECT event_id, family, period, handicap_kind, line, selection, MAX(odds) AS odds FROM offers GROUP BY ALL)"


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offers(spark, sf_dir).groupBy(*_KEY, "selection").agg(F.max("odds").alias("odds"))


@query(
    "best_price_per_selection",
    "WITH @offers SELECT event_id, family, period, handicap_kind, line, selection, odds, raw_record_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id, family, period, handicap_kind, line, selection ORDER BY odds DESC, source_index, raw_record_id) AS rn FROM offers) WHERE rn = 1",
)
def best_price_per_selection(spark, sf_dir):
    """The row with the best price of each selection; ties go to the earliest."""
    rows = _offers(spark, sf_dir).withColumn("worse", -F.col("odds"))
    return keyed.first_by(rows, [*_KEY, "selection"], ["worse", "source_index", "raw_record_id"], ["odds", "raw_record_id"])


def _complete_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete markets with their selections and best prices, in the order of the selections' names."""
    want = F.create_map(*[x for k, v in COMPLETE.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    got = _best(spark, sf_dir).groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("selection", "odds"))).alias("best"))
    kind = F.when(F.col("handicap_kind") == "", F.col("family")).otherwise(F.concat_ws(":", "family", "handicap_kind"))
    return got.where(F.col("best.selection") == want[kind])


_FULL = _BEST + ", priced AS (SELECT *, COUNT(*) OVER m AS n, SUM(1 / odds) OVER m AS total FROM best WINDOW m AS (PARTITION BY event_id, family, period, handicap_kind, line)), complete AS (SELECT * FROM priced WHERE n = CASE WHEN family = '1X2' OR handicap_kind = 'THREE_WAY' THEN 3 ELSE 2 END)"


@query("complete_markets", f"WITH @offers, {_FULL} SELECT event_id, family, period, handicap_kind, line, STRING_AGG(selection, '|' ORDER BY selection) AS selections FROM complete GROUP BY ALL")
def complete_markets(spark, sf_dir):
    """Markets of which every outcome has a price: relational division by the family's outcomes."""
    return _complete_markets(spark, sf_dir).select(*_KEY, F.array_join("best.selection", "|").alias("selections"))


@query("devig_multiplicative", f"WITH @offers, {_FULL} SELECT event_id, family, period, handicap_kind, line, selection, ROUND(1 / odds / total, 6) AS probability FROM complete")
def devig_multiplicative(spark, sf_dir):
    """Proportional shares of complete markets."""
    rows = _complete_markets(spark, sf_dir).withColumn("total", F.aggregate("best", F.lit(0.0), lambda s, b: s + 1 / b["odds"]))
    return rows.select(*_KEY, "total", F.explode("best").alias("b")).select(*_KEY, "b.selection", F.round(1 / F.col("b.odds") / F.col("total"), 6).alias("probability"))


def _solved(spark: SparkSession, sf_dir: str, where: str, method: str) -> DataFrame:
    markets = _complete_markets(spark, sf_dir).where(where).select(F.concat_ws("|", *_KEY).alias("market"), F.col("best.odds").alias("prices"))
    return numeric.devigged(markets, "market", "prices", method)


@query(
    "fair_market_power",
    f"""WITH RECURSIVE @offers, {_FULL},
    m AS (SELECT concat_ws('|', event_id, family, period, handicap_kind, line) AS market, MIN(CASE WHEN selection IN ('AWAY', 'NO', 'OVER') THEN 1 / odds END) AS a, MIN(CASE WHEN selection NOT IN ('AWAY', 'NO', 'OVER') THEN 1 / odds END) AS b FROM complete WHERE n = 2 GROUP BY ALL),
    s AS (SELECT market, a, b, 0.01e0 AS lo, 100e0 AS hi, 0 AS i FROM m UNION ALL
          SELECT market, a, b, CASE WHEN pow(a, (lo + hi) / 2) + pow(b, (lo + hi) / 2) > 1 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN pow(a, (lo + hi) / 2) + pow(b, (lo + hi) / 2) > 1 THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM s WHERE i < 60)
    SELECT market, ROUND((lo + hi) / 2, 5) AS exponent, ROUND(pow(a, (lo + hi) / 2), 5) AS first_probability FROM s WHERE i = 60""",
)
def fair_market_power(spark, sf_dir):
    """Power method on markets with two outcomes."""
    got = _solved(spark, sf_dir, "size(best) = 2", "power")
    return got.select("market", F.round("parameter", 5).alias("exponent"), F.round(F.get("probabilities", F.lit(0)), 5).alias("first_probability"))


_SHIN = "list_sum(list_transform(q, lambda x: (sqrt({z} * {z} + 4 * (1 - {z}) * x * x / t) - {z}) / (2 * (1 - {z}))))"


@query(
    "fair_market_shin",
    f"""WITH RECURSIVE @offers, {_FULL},
    m AS (SELECT concat_ws('|', event_id, family, period, handicap_kind, line) AS market, list(1 / odds ORDER BY selection) AS q, MAX(total) AS t FROM complete WHERE n = 3 GROUP BY ALL HAVING MAX(total) > 1),
    s AS (SELECT market, q, t, 0e0 AS lo, 0.999999999e0 AS hi, 0 AS i FROM m UNION ALL
          SELECT market, q, t, CASE WHEN {_SHIN.format(z="((lo + hi) / 2)")} > 1 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_SHIN.format(z="((lo + hi) / 2)")} > 1 THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM s WHERE i < 60),
    z AS (SELECT market, (lo + hi) / 2 AS z, list_transform(q, lambda x: (sqrt(((lo + hi) / 2) * ((lo + hi) / 2) + 4 * (1 - (lo + hi) / 2) * x * x / t) - (lo + hi) / 2) / (2 * (1 - (lo + hi) / 2))) AS p FROM s WHERE i = 60)
    SELECT market, ROUND(z, 5) AS insiders, ROUND(p[1], 5) AS p0, ROUND(p[2], 5) AS p1, ROUND(p[3], 5) AS p2 FROM z""",
)
def fair_market_shin(spark, sf_dir):
    """Shin's method on markets with three outcomes and a margin."""
    got = _solved(spark, sf_dir, "size(best) = 3", "shin").where("parameter is not null")
    return got.select("market", F.round("parameter", 5).alias("insiders"), *[F.round(F.get("probabilities", F.lit(i)), 5).alias(f"p{i}") for i in range(3)])


_OVER = f"{_FULL}, over AS (SELECT event_id, period, 1 / odds / total AS p, total FROM complete WHERE family = 'GOALS_OU' AND selection = 'OVER')"


def _over(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _complete_markets(spark, sf_dir).where("family = 'GOALS_OU'").withColumn("total", F.aggregate("best", F.lit(0.0), lambda s, b: s + 1 / b["odds"]))
    return rows.select("event_id", "period", (1 / F.col("best")[0]["odds"] / F.col("total")).alias("p"), "total")


_RATE = """rate AS (SELECT event_id, period, p, total, 1e-4 AS lo, 12e0 AS hi, 0 AS i FROM over UNION ALL
  SELECT event_id, period, p, total, CASE WHEN 1 - exp(-(lo + hi) / 2) * (1 + (lo + hi) / 2 + pow((lo + hi) / 2, 2) / 2) < p THEN (lo + hi) / 2 ELSE lo END,
         CASE WHEN 1 - exp(-(lo + hi) / 2) * (1 + (lo + hi) / 2 + pow((lo + hi) / 2, 2) / 2) < p THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM rate WHERE i < 60),
  rates AS (SELECT event_id, period, total, (lo + hi) / 2 AS rate FROM rate WHERE i = 60)"""


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numeric.poisson_rates(_over(spark, sf_dir).withColumn("goals", F.lit(2.5)), "goals", "p", "rate")


@query("poisson_invert_rate", f"WITH RECURSIVE @offers, {_OVER}, {_RATE} SELECT event_id, period, ROUND(rate, 5) AS rate FROM rates")
def poisson_invert_rate(spark, sf_dir):
    """The goal rate at which a total above 2.5 is as likely as the market says."""
    return _rates(spark, sf_dir).select("event_id", "period", F.round("rate", 5).alias("rate"))


@query(
    "rate_weighted_median",
    f"""WITH RECURSIVE @offers, {_OVER}, {_RATE}, r AS (SELECT event_id, period, ROUND(rate, 5) AS rate, ROUND(greatest(0.05e0, 1 / greatest(1, total)), 6) AS weight FROM rates),
    w AS (SELECT *, SUM(weight) OVER (PARTITION BY event_id ORDER BY rate, period ROWS UNBOUNDED PRECEDING) AS run, SUM(weight) OVER (PARTITION BY event_id) / 2 AS half FROM r)
    SELECT event_id, MIN(rate) AS median FROM w WHERE run >= half GROUP BY event_id""",
)
def rate_weighted_median(spark, sf_dir):
    """Weighted median of an event's rates, tight markets weighing more."""
    weight = F.round(F.greatest(F.lit(0.05), 1 / F.greatest(F.lit(1.0), "total")), 6)
    rows = _rates(spark, sf_dir).select("event_id", "period", F.round("rate", 5).alias("rate"), weight.alias("weight"))
    return numeric.weighted_median(rows, "event_id", "rate", "weight", ["period"])


@query(
    "top_scores_grid",
    "WITH r AS (SELECT n_nationkey AS nation, 0.5e0 + (n_nationkey % 7) * 0.25e0 AS home, 0.4e0 + (n_nationkey % 5) * 0.3e0 AS away FROM nation), f AS (SELECT CAST(range AS BIGINT) AS k, exp(SUM(ln(greatest(range, 1))) OVER (ORDER BY range)) AS fact FROM range(8)), g AS (SELECT nation, h.k AS h, a.k AS a, exp(-home) * pow(home, h.k) / h.fact * exp(-away) * pow(away, a.k) / a.fact AS p FROM r, f h, f a) SELECT nation, h AS home_goals, a AS away_goals, ROUND(p, 6) AS p FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY nation ORDER BY ROUND(p, 9) DESC, h, a) AS rn FROM g) WHERE rn <= 6",
)
def top_scores_grid(spark, sf_dir):
    """The six likeliest scores of an 8 x 8 grid for each pair of rates; the grid is an array, not a join."""
    n = F.col("n_nationkey")
    rates = table(spark, sf_dir, "nation").select(n.alias("nation"), (F.lit(0.5) + n % 7 * F.lit(0.25)).alias("home"), (F.lit(0.4) + n % 5 * F.lit(0.3)).alias("away"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.struct(F.floor(i / 8).alias("h"), (i % 8).cast("bigint").alias("a")))
    pmf = lambda rate, k: F.exp(-rate) * F.pow(rate, k) / F.factorial(k.cast("int"))
    scored = F.transform(grid, lambda g: F.struct((-F.round(pmf(F.col("home"), g["h"]) * pmf(F.col("away"), g["a"]), 9)).alias("minus"), g["h"].alias("home_goals"), g["a"].alias("away_goals")))
    top = rates.select("nation", F.explode(F.slice(F.array_sort(scored), 1, 6)).alias("s"))
    return top.select("nation", "s.home_goals", "s.away_goals", F.round(-F.col("s.minus"), 6).alias("p"))


@query("collision_count", "WITH @offers SELECT family, COUNT(*) AS collisions FROM (SELECT event_id, family, period, handicap_kind, line, selection FROM offers GROUP BY ALL HAVING MAX(odds) / MIN(odds) - 1 > 0.5) GROUP BY family")
def collision_count(spark, sf_dir):
    """Selections whose prices lie more than half apart."""
    spread = _offers(spark, sf_dir).groupBy(*_KEY, "selection").agg((F.max("odds") / F.min("odds") - 1).alias("gap"))
    return spread.where("gap > 0.5").groupBy("family").agg(F.count("*").alias("collisions"))


@query(
    "price_gap_alerts",
    "WITH @offers, g AS (SELECT *, MAX(odds) OVER w AS top, MIN(odds) OVER w AS low FROM offers WINDOW w AS (PARTITION BY event_id, family, period, handicap_kind, line, selection)) SELECT event_id, family, period, handicap_kind, line, selection, COUNT(*) AS worse_rows, MAX(top) AS best_odds, MAX(CASE WHEN odds < top THEN odds END) AS next_odds FROM g WHERE top > low AND top / low - 1 <= 0.5 AND odds < top GROUP BY ALL",
)
def price_gap_alerts(spark, sf_dir):
    """Selections with a better and a worse price, no further than half apart. Rows combine by price before the
    shuffle; of the distinct prices of a selection only the two best are ranked."""
    from pyspark.sql import Window

    prices = _offers(spark, sf_dir).groupBy(*_KEY, "selection", "odds").agg(F.count("*").alias("n"))
    down = Window.partitionBy(*_KEY, "selection").orderBy(F.desc("odds"))
    second = prices.withColumn("rank", F.row_number().over(down)).where("rank = 2").select(*_KEY, "selection", F.col("odds").alias("next_odds"))
    spread = prices.groupBy(*_KEY, "selection").agg(F.max("odds").alias("best_odds"), F.min("odds").alias("low"), F.sum("n").alias("rows"), F.max(F.struct("odds", "n")).alias("top"))
    alerts = spread.where("best_odds > low and best_odds / low - 1 <= 0.5").join(second, [*_KEY, "selection"])
    return alerts.select(*_KEY, "selection", (F.col("rows") - F.col("top.n")).alias("worse_rows"), "best_odds", "next_odds")


_SIGNATURES = """keys AS (SELECT event_id, raw_record_id, odds, concat_ws('|', 'exact', family, period, handicap_kind, line, selection) AS signature FROM offers UNION ALL
  SELECT event_id, raw_record_id, odds, concat_ws('|', 'win', period, selection) FROM offers WHERE (family = '1X2' AND selection <> 'DRAW') OR (handicap_kind = 'TWO_WAY' AND line = '-0.5'))"""


def _signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row once for every signature under which it means the same as others."""
    win = ((F.col("family") == "1X2") & (F.col("selection") != "DRAW")) | ((F.col("handicap_kind") == "TWO_WAY") & (F.col("line") == "-0.5"))
    exact = F.concat_ws("|", F.lit("exact"), "family", "period", "handicap_kind", "line", "selection")
    both = F.array_compact(F.array(exact, F.when(win, F.concat_ws("|", F.lit("win"), "period", "selection"))))
    return _offers(spark, sf_dir).select("event_id", "raw_record_id", "odds", F.explode(both).alias("signature"))


@query("equivalence_groups", f"WITH @offers, {_SIGNATURES} SELECT event_id, signature, COUNT(*) AS copies, MAX(odds) AS best, ROUND((MAX(odds) / MIN(odds) - 1) * 100, 4) AS gap FROM keys GROUP BY ALL HAVING COUNT(*) >= 2")
def equivalence_groups(spark, sf_dir):
    """Rows of one meaning, two or more, with their best price and spread."""
    groups = _signatures(spark, sf_dir).groupBy("event_id", "signature").agg(F.count("*").alias("copies"), F.max("odds").alias("best"), F.round((F.max("odds") / F.min("odds") - 1) * 100, 4).alias("gap"))
    return groups.where("copies >= 2")


@query(
    "equivalence_division",
    f"WITH @offers, {_SIGNATURES}, s AS (SELECT DISTINCT k.event_id, k.signature, o.tab FROM keys k JOIN offers o USING (event_id, raw_record_id)), t AS (SELECT event_id, COUNT(DISTINCT tab) AS n FROM offers GROUP BY event_id) SELECT s.event_id, s.signature FROM s JOIN t USING (event_id) GROUP BY s.event_id, s.signature, t.n HAVING COUNT(*) = t.n",
)
def equivalence_division(spark, sf_dir):
    """Signatures that every tab of an event shows."""
    rows = _offers(spark, sf_dir)
    win = ((F.col("family") == "1X2") & (F.col("selection") != "DRAW")) | ((F.col("handicap_kind") == "TWO_WAY") & (F.col("line") == "-0.5"))
    exact = F.concat_ws("|", F.lit("exact"), "family", "period", "handicap_kind", "line", "selection")
    both = F.array_compact(F.array(exact, F.when(win, F.concat_ws("|", F.lit("win"), "period", "selection"))))
    return keyed.common_keys(rows.select("event_id", "tab", F.explode(both).alias("signature")), "event_id", "tab", "signature")


@query(
    "dedupe_source_fast",
    "WITH @offers SELECT event_id, family, period, handicap_kind, line, selection, MAX(odds) AS odds, arg_max(raw_record_id, (source_index, raw_record_id)) AS raw_record_id, COUNT(*) AS representations FROM offers GROUP BY ALL HAVING COUNT(DISTINCT odds) = 1",
)
def dedupe_source_fast(spark, sf_dir):
    """Keys with one price: the last row, and how many it stands for."""
    got = _offers(spark, sf_dir).groupBy(*_KEY, "selection").agg(F.max("odds").alias("odds"), F.min("odds").alias("low"), F.max_by("raw_record_id", F.struct("source_index", "raw_record_id")).alias("raw_record_id"), F.count("*").alias("representations"))
    return got.where("odds = low").drop("low")


_SAME, _ONE = "r.odds = f.odds", "(r.odds <> f.odds AND r.inst <> '' AND r.inst = f.inst AND r.vis <> f.vis)"
_MOVED = f"(r.odds <> f.odds AND NOT {_ONE} AND ((r.capture <> '' AND f.capture <> '' AND r.capture <> f.capture) OR (r.capture = '' AND f.capture = '' AND r.tab <> f.tab)))"
_TAKEN = f"(({_SAME} AND r.seen_at > f.seen_at) OR ({_ONE} AND r.vis) OR ({_MOVED} AND r.seen_at > f.seen_at))"
_FOLDED = ", ".join(f"CASE WHEN {_TAKEN} THEN r.{c} ELSE f.{c} END" for c in ("seen_at", "id", "odds", "capture", "tab", "inst", "vis"))


@query(
    "dedupe_source_fold",
    f"""WITH RECURSIVE @offers, r AS (SELECT event_id, family, period, handicap_kind, line, selection, concat_ws('/', event_id, family, period, handicap_kind, line, selection) AS k, source_index AS seen_at, raw_record_id AS id, odds, capture, tab, CAST(market_id AS VARCHAR) AS inst, source_index % 2 = 1 AS vis,
      ROW_NUMBER() OVER (PARTITION BY event_id, family, period, handicap_kind, line, selection ORDER BY source_index, raw_record_id, odds) AS rn FROM offers),
    f AS (SELECT k, rn, seen_at, id, odds, capture, tab, inst, vis, [id] AS lineage, 1 AS n, 0 AS conflicts FROM r WHERE rn = 1 UNION ALL
      SELECT r.k, r.rn, {_FOLDED}, CASE WHEN {_SAME} THEN CASE WHEN list_contains(f.lineage, r.id) THEN f.lineage ELSE list_append(f.lineage, r.id) END WHEN {_TAKEN} THEN [r.id] ELSE f.lineage END,
      CASE WHEN {_SAME} THEN f.n + 1 WHEN {_TAKEN} THEN 1 ELSE f.n END, CASE WHEN {_SAME} OR {_ONE} OR {_MOVED} THEN f.conflicts ELSE f.conflicts + 1 END FROM f JOIN r ON r.k = f.k AND r.rn = f.rn + 1),
    e AS (SELECT k, MAX(rn) AS rn, any_value(event_id) AS event_id, any_value(family) AS family, any_value(period) AS period, any_value(handicap_kind) AS handicap_kind, any_value(line) AS line, any_value(selection) AS selection FROM r GROUP BY k)
    SELECT event_id, family, period, handicap_kind, line, selection, id AS raw_record_id, odds, array_to_string(lineage, ',') AS lineage, n AS representations, conflicts FROM e JOIN f USING (k, rn)""",
)
def dedupe_source_fold(spark, sf_dir):
    """The ordered fold of every key."""
    rows = _offers(spark, sf_dir).withColumns({"instance": F.col("market_id").cast("string"), "visible": F.col("source_index") % 2 == 1})
    got = keyed.fold_observations(rows, [*_KEY, "selection"], "source_index")
    return got.withColumn("lineage", F.array_join("lineage", ","))


@query(
    "dedupe_export",
    "WITH @offers SELECT event_id, family, period, handicap_kind, line, selection, odds, MIN(raw_record_id) AS raw_record_id, STRING_AGG(DISTINCT raw_record_id, ',' ORDER BY raw_record_id) AS lineage, COUNT(*) AS representations FROM offers GROUP BY ALL",
)
def dedupe_export(spark, sf_dir):
    """Rows equal in meaning and price as one, with their lineage."""
    got = keyed.merged_representations(_offers(spark, sf_dir), [*_KEY, "selection", "odds"], "raw_record_id", ["raw_record_id"], ["raw_record_id"])
    return got.withColumn("lineage", F.array_join("lineage", ","))


@query("union_first_seen", "WITH @offers SELECT event_id, family, selection, tab, raw_record_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id, family, selection ORDER BY capture, source_index, raw_record_id) AS rn FROM offers) WHERE rn = 1")
def union_first_seen(spark, sf_dir):
    """The first sighting of each selection over the union of two captures."""
    rows = _offers(spark, sf_dir)
    union = rows.where("capture = 'F'").unionByName(rows.where("capture <> 'F'"))
    return keyed.first_by(union, ["event_id", "family", "selection"], ["capture", "source_index", "raw_record_id"], ["tab", "raw_record_id"])


@query("lineage_normalise", "SELECT odd_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split_regex(regexp_replace(source_raw_record_ids, '[\\[\\]\"]', '', 'g'), '[,;|\\s]+'), lambda x: trim(x)), lambda x: x <> ''))), ',') AS ids FROM odd_records WHERE source_raw_record_ids IS NOT NULL")
def lineage_normalise(spark, sf_dir):
    """Packed lineage as sorted distinct ids."""
    bare = F.regexp_replace("source_raw_record_ids", r'[\[\]"]', "")
    ids = F.array_sort(F.array_distinct(F.filter(F.split(bare, r"[,;|\s]+"), lambda x: x != "")))
    return table(spark, sf_dir, "odd_records").where("source_raw_record_ids is not null").select("odd_id", F.array_join(ids, ",").alias("ids"))


@query(
    "handicap_pairs",
    "WITH @offers, i AS (SELECT event_id, market_id, CAST(line AS DOUBLE) AS line, COUNT(DISTINCT selection) AS sides, COUNT(*) AS n FROM offers WHERE handicap_kind = 'TWO_WAY' GROUP BY ALL) SELECT event_id, abs(line) AS distance, COUNT(*) AS instances, SUM(CASE WHEN sides = 2 THEN 1 ELSE 0 END)::BIGINT AS paired, SUM(n)::BIGINT AS n FROM i GROUP BY ALL",
)
def handicap_pairs(spark, sf_dir):
    """Handicap markets by distance, and those that have both sides: a group of groups."""
    line = F.col("line").cast("double")
    one = _offers(spark, sf_dir).where("handicap_kind = 'TWO_WAY'").groupBy("event_id", "market_id", line.alias("line")).agg(F.count_distinct("selection").alias("sides"), F.count("*").alias("n"))
    return one.groupBy("event_id", F.abs("line").alias("distance")).agg(F.count("*").alias("instances"), F.count_if(F.expr("sides = 2")).alias("paired"), F.sum("n").alias("n"))


@query(
    "curve_breaks",
    f"WITH @offers, {_FULL}, p AS (SELECT event_id, period, selection, CAST(line AS DOUBLE) AS line_at, ROUND(1 / odds / total, 6) AS p FROM complete WHERE handicap_kind = 'TWO_WAY' AND selection = 'HOME'), l AS (SELECT *, LAG(line_at) OVER w AS prev_at, LAG(p) OVER w AS prev_value FROM p WINDOW w AS (PARTITION BY event_id, period, selection ORDER BY line_at, p)) SELECT event_id, period, selection, prev_at, line_at, prev_value, p AS value FROM l WHERE prev_at < line_at AND p < prev_value - 0.035",
)
def curve_breaks(spark, sf_dir):
    """Handicap curves that fall where they should rise."""
    rows = devig_multiplicative(spark, sf_dir).where("handicap_kind = 'TWO_WAY' and selection = 'HOME'")
    points = rows.select("event_id", "period", "selection", F.col("line").cast("double").alias("line_at"), F.col("probability").alias("value"))
    return numeric.curve_breaks(points, ["event_id", "period", "selection"], "line_at", "value", 0.035)


@query("market_relations", f"WITH @offers, {_FULL}, m AS (SELECT DISTINCT event_id, family, line, period FROM complete) SELECT event_id, family, line, STRING_AGG(DISTINCT period, '|' ORDER BY period) AS periods FROM m GROUP BY ALL HAVING COUNT(DISTINCT period) >= 2")
def market_relations(spark, sf_dir):
    """Complete markets of one family and line over several periods."""
    got = _complete_markets(spark, sf_dir).groupBy("event_id", "family", "line").agg(F.array_sort(F.collect_set("period")).alias("p"))
    return got.where("size(p) >= 2").select("event_id", "family", "line", F.array_join("p", "|").alias("periods"))


@query(
    "period_resolution",
    "WITH @offers, e AS (SELECT raw_record_id, period AS evidence FROM offers WHERE source_index % 3 = 0), c AS (SELECT event_id, market_id, family, CASE WHEN source_index % 2 = 0 THEN period END AS known, raw_record_id FROM offers) SELECT c.market_id, COUNT(*) AS n, COUNT(c.known) AS known, COUNT(e.evidence) AS evidence, CASE WHEN COUNT(DISTINCT coalesce(c.known, e.evidence)) = 1 THEN MIN(coalesce(c.known, e.evidence)) WHEN COUNT(DISTINCT coalesce(c.known, e.evidence)) = 0 THEN 'UNKNOWN' ELSE 'CONFLICT' END AS period FROM c LEFT JOIN e USING (raw_record_id) GROUP BY c.market_id",
)
def period_resolution(spark, sf_dir):
    """Unknown periods of markets, told by evidence that joins by lineage."""
    rows = _offers(spark, sf_dir)
    evidence = rows.where("source_index % 3 = 0").select("raw_record_id", F.col("period").alias("evidence"))
    known = rows.select("market_id", F.when(F.col("source_index") % 2 == 0, F.col("period")).alias("known"), "raw_record_id")
    told = F.coalesce("known", "evidence")
    got = known.join(evidence, "raw_record_id", "left").groupBy("market_id").agg(F.count("*").alias("n"), F.count("known").alias("known"), F.count("evidence").alias("evidence"), F.min(told).alias("lo"), F.max(told).alias("hi"))
    period = F.when(F.col("lo").isNull(), "UNKNOWN").when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("CONFLICT")
    return got.select("market_id", "n", "known", "evidence", period.alias("period"))


@query("evidence_without_canonical", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def evidence_without_canonical(spark, sf_dir):
    """Orders without a returned line."""
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(returned, "o_orderkey", "left_anti")


@query("unsafe_anti_join", "WITH @offers SELECT raw_record_id, event_id FROM offers o WHERE NOT EXISTS (SELECT 1 FROM offers u WHERE u.event_id = o.event_id AND u.source_index = o.source_index AND u.odds > 6.75)")
def unsafe_anti_join(spark, sf_dir):
    """Rows whose place in the event no unsafe row shares."""
    rows = _offers(spark, sf_dir)
    return rows.join(rows.where("odds > 6.75").select("event_id", "source_index").distinct(), ["event_id", "source_index"], "left_anti").select("raw_record_id", "event_id")


@query("supported_semi_join", f"WITH @offers, {_FULL} SELECT raw_record_id FROM offers o WHERE EXISTS (SELECT 1 FROM complete c WHERE c.event_id = o.event_id AND c.family = o.family AND c.period = o.period)")
def supported_semi_join(spark, sf_dir):
    """Rows whose family and period have a complete market."""
    return _offers(spark, sf_dir).join(_complete_markets(spark, sf_dir).select("event_id", "family", "period"), ["event_id", "family", "period"], "left_semi").select("raw_record_id")


@query(
    "lineage_audit",
    "WITH @offers, a AS (SELECT raw_record_id, COUNT(*) AS n FROM offers WHERE tab <> 'R' GROUP BY ALL), b AS (SELECT raw_record_id, COUNT(*) AS n FROM offers WHERE capture = 'O' GROUP BY ALL) SELECT SUM(CASE WHEN a.n IS NOT NULL AND b.n IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS common_ids, SUM(CASE WHEN b.n IS NULL THEN 1 ELSE 0 END)::BIGINT AS only_left, SUM(CASE WHEN a.n IS NULL THEN 1 ELSE 0 END)::BIGINT AS only_right, SUM(CASE WHEN a.n > 1 OR b.n > 1 THEN 1 ELSE 0 END)::BIGINT AS repeated FROM a FULL OUTER JOIN b USING (raw_record_id)",
)
def lineage_audit(spark, sf_dir):
    """Ids of two sides: common, on one side only, repeated."""
    rows = _offers(spark, sf_dir)
    a = rows.where("tab <> 'R'").groupBy("raw_record_id").agg(F.count("*").alias("a"))
    b = rows.where("capture = 'O'").groupBy("raw_record_id").agg(F.count("*").alias("b"))
    return a.join(b, "raw_record_id", "full_outer").agg(F.count_if(F.expr("a is not null and b is not null")).alias("common_ids"), F.count_if(F.expr("b is null")).alias("only_left"), F.count_if(F.expr("a is null")).alias("only_right"), F.count_if(F.expr("a > 1 or b > 1")).alias("repeated"))


@query(
    "nth_occurrence_join",
    "WITH @offers, f AS (SELECT event_id, family, selection, raw_record_id AS f_id, ROW_NUMBER() OVER (PARTITION BY event_id, family, selection ORDER BY source_index, raw_record_id) AS occurrence FROM offers WHERE capture = 'F'), o AS (SELECT event_id, family, selection, raw_record_id AS o_id, ROW_NUMBER() OVER (PARTITION BY event_id, family, selection ORDER BY source_index, raw_record_id) AS occurrence FROM offers WHERE capture = 'O') SELECT event_id, family, selection, occurrence, f_id, o_id FROM f JOIN o USING (event_id, family, selection, occurrence)",
)
def nth_occurrence_join(spark, sf_dir):
    """The n-th sighting in one capture with the n-th in the other."""
    rows = _offers(spark, sf_dir).select("event_id", "family", "selection", "source_index", "raw_record_id", "capture")
    f = rows.where("capture = 'F'").select("event_id", "family", "selection", "source_index", F.col("raw_record_id").alias("f_id"))
    o = rows.where("capture = 'O'").select("event_id", "family", "selection", F.col("source_index").alias("o_index"), F.col("raw_record_id").alias("o_id"))
    got = keyed.nth_occurrence_join(f, o, ["event_id", "family", "selection"], ["source_index", "f_id"], ["o_index", "o_id"])
    return got.select("event_id", "family", "selection", "occurrence", "f_id", "o_id")


@query(
    "recovered_cells",
    "WITH @offers, t AS (SELECT market_id, arg_min(raw_record_id, (source_index, raw_record_id)) AS template FROM offers WHERE capture = 'F' GROUP BY market_id) SELECT o.raw_record_id, t.template FROM offers o JOIN t USING (market_id) WHERE o.capture = 'O' AND NOT EXISTS (SELECT 1 FROM offers x WHERE x.capture = 'F' AND x.market_id = o.market_id AND x.selection = o.selection)",
)
def recovered_cells(spark, sf_dir):
    """Cells that only one capture has, with the first row of their market in the other."""
    rows = _offers(spark, sf_dir)
    f = rows.where("capture = 'F'")
    templates = keyed.first_by(f, ["market_id"], ["source_index", "raw_record_id"], ["raw_record_id"]).withColumnRenamed("raw_record_id", "template")
    new = rows.where("capture = 'O'").join(f.select("market_id", "selection").distinct(), ["market_id", "selection"], "left_anti")
    return new.join(templates, "market_id").select("raw_record_id", "template")


_FAULTS = "faulty AS (SELECT raw_record_id, family, CASE WHEN source_index = 1 AND market_id % 4 = 0 THEN NULL WHEN source_index = 2 THEN replace(CAST(odds AS VARCHAR), '.', ',') WHEN source_index = 3 THEN 'x' ELSE CAST(odds AS VARCHAR) END AS odds_text FROM offers)"


@query(
    "row_validation",
    f"WITH @offers, {_FAULTS} SELECT family, CASE WHEN odds_text IS NULL THEN 'MISSING' WHEN TRY_CAST(replace(odds_text, ',', '.') AS DOUBLE) IS NULL THEN 'INVALID_NUMBER' WHEN TRY_CAST(replace(odds_text, ',', '.') AS DOUBLE) <= 1.5 THEN 'TOO_LOW' ELSE '' END AS reason, COUNT(*) AS n FROM faulty GROUP BY ALL",
)
def row_validation(spark, sf_dir):
    """Rows by their first fault: one reason column, and accepted rows are those without one."""
    odds = F.col("odds").cast("string")
    i = F.col("source_index")
    text = F.when((i == 1) & (F.col("market_id") % 4 == 0), None).when(i == 2, F.replace(odds, F.lit("."), F.lit(","))).when(i == 3, "x").otherwise(odds)
    number = F.replace("text", F.lit(","), F.lit(".")).try_cast("double")
    reason = F.when(F.col("text").isNull(), "MISSING").when(number.isNull(), "INVALID_NUMBER").when(number <= 1.5, "TOO_LOW").otherwise("")
    return _offers(spark, sf_dir).withColumn("text", text).groupBy("family", reason.alias("reason")).agg(F.count("*").alias("n"))


@query("scope_counts", "WITH @offers SELECT event_id, SUM(CASE WHEN family = 'PLAYER_PROP' THEN 1 ELSE 0 END)::BIGINT AS player, SUM(CASE WHEN family = 'HANDICAP_EUROPEAN' THEN 1 ELSE 0 END)::BIGINT AS handicap, SUM(CASE WHEN family NOT IN ('PLAYER_PROP', 'HANDICAP_EUROPEAN') THEN 1 ELSE 0 END)::BIGINT AS match FROM offers GROUP BY event_id")
def scope_counts(spark, sf_dir):
    """Rows of each event by scope: a pivot with fixed columns."""
    scope = F.when(F.col("family") == "PLAYER_PROP", "player").when(F.col("family") == "HANDICAP_EUROPEAN", "handicap").otherwise("match")
    return _offers(spark, sf_dir).withColumn("scope", scope).groupBy("event_id").pivot("scope", ["player", "handicap", "match"]).count().na.fill(0)


@query(
    "ledger_summary",
    "WITH @offers, l AS (SELECT market_id, tab, CASE WHEN odds > 6 THEN 'QUARANTINED' ELSE 'ACCEPTED' END AS state, source_index, raw_record_id FROM offers), f AS (SELECT market_id, arg_min(state, (source_index, raw_record_id)) AS state, arg_min(tab, (source_index, raw_record_id)) AS tab, COUNT(DISTINCT state) AS states FROM l GROUP BY market_id) SELECT tab, COUNT(*) AS entries, SUM(CASE WHEN state = 'ACCEPTED' THEN 1 ELSE 0 END)::BIGINT AS accepted, SUM(CASE WHEN states > 1 THEN 1 ELSE 0 END)::BIGINT AS conflicts FROM f GROUP BY tab",
)
def ledger_summary(spark, sf_dir):
    """Entries by the tab of their first row; a conflict is an entry with several states."""
    state = F.when(F.col("odds") > 6, "QUARANTINED").otherwise("ACCEPTED")
    rows = _offers(spark, sf_dir).withColumn("state", state)
    one = rows.groupBy("market_id").agg(F.min_by(F.struct("state", "tab"), F.struct("source_index", "raw_record_id")).alias("f"), (F.min("state") != F.max("state")).alias("conflict"))
    return one.groupBy("f.tab").agg(F.count("*").alias("entries"), F.count_if(F.expr("f.state = 'ACCEPTED'")).alias("accepted"), F.count_if(F.expr("conflict")).alias("conflicts"))


@query(
    "id_algebra",
    "WITH @offers, r AS (SELECT DISTINCT raw_record_id FROM offers WHERE source_index <= 5), a AS (SELECT DISTINCT raw_record_id FROM offers WHERE odds < 6), q AS (SELECT DISTINCT raw_record_id FROM offers WHERE odds > 5.5) SELECT (SELECT COUNT(*) FROM r) AS raw, (SELECT COUNT(*) FROM a) AS accepted, (SELECT COUNT(*) FROM q) AS quarantined, (SELECT COUNT(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM q)) AS overlap, (SELECT COUNT(*) FROM (SELECT * FROM r EXCEPT (SELECT * FROM a UNION SELECT * FROM q))) AS unaccounted, (SELECT COUNT(*) FROM ((SELECT * FROM a UNION SELECT * FROM q) EXCEPT SELECT * FROM r)) AS foreign_ids",
)
def id_algebra(spark, sf_dir):
    """Union, intersection and difference of three sets of ids, in one aggregate."""
    rows = _offers(spark, sf_dir)
    return keyed.id_algebra(rows.where("source_index <= 5"), rows.where("odds < 6"), rows.where("odds > 5.5"), "raw_record_id")


@query("stable_snapshot", "WITH @offers, n AS (SELECT event_id, tab, capture, COUNT(*) AS n FROM offers GROUP BY ALL), m AS (SELECT event_id, capture, MAX(n) AS want FROM n GROUP BY ALL) SELECT n.event_id, n.capture, MAX(n.tab) AS tab, MAX(n.n) AS n FROM n JOIN m USING (event_id, capture) WHERE n.n = m.want GROUP BY ALL")
def stable_snapshot(spark, sf_dir):
    """The last tab that shows as many rows as any does."""
    counts = _offers(spark, sf_dir).groupBy("event_id", "tab", "capture").agg(F.count("*").alias("n"))
    return keyed.latest_by(counts, ["event_id", "capture"], ["n", "tab"], ["tab", "n"])


@query(
    "interval_gate",
    "SELECT o_orderkey, COUNT(*) AS lines, SUM(CASE WHEN l_shipdate < o_orderdate + INTERVAL 60 DAY THEN 1 ELSE 0 END)::BIGINT AS in_time, strftime(MAX(l_shipdate), '%Y-%m-%d') AS cutoff, MAX(l_shipdate) < o_orderdate + INTERVAL 60 DAY AS whole FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate",
)
def interval_gate(spark, sf_dir):
    """Lines before a limit of their order: an equi join with a residual inequality, then one aggregate."""
    joined = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate"), "o_orderkey")
    limit = F.col("o_orderdate") + F.expr("INTERVAL 60 DAY")
    got = joined.groupBy("o_orderkey", "o_orderdate").agg(F.count("*").alias("lines"), F.count_if(F.col("l_shipdate") < limit).alias("in_time"), F.max("l_shipdate").alias("last"))
    return got.select("o_orderkey", "lines", "in_time", F.date_format("last", "yyyy-MM-dd").alias("cutoff"), (F.col("last") < limit).alias("whole"))


@query("duplicate_content", "SELECT l_suppkey, l_quantity, l_discount, COUNT(*) AS copies FROM lineitem GROUP BY ALL HAVING COUNT(*) > 1")
def duplicate_content(spark, sf_dir):
    """Contents that occur several times."""
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_quantity", "l_discount").agg(F.count("*").alias("copies")).where("copies > 1")


@query(
    "bridge_bijection",
    "WITH p AS (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer JOIN orders ON o_custkey = c_custkey) SELECT 'c_nationkey' AS side, CAST(c_nationkey AS VARCHAR) AS value, COUNT(*) AS partners FROM p GROUP BY c_nationkey HAVING COUNT(*) > 1 UNION ALL SELECT 'c_mktsegment', c_mktsegment, COUNT(*) FROM p GROUP BY c_mktsegment HAVING COUNT(*) > 1",
)
def bridge_bijection(spark, sf_dir):
    """Values that break a one-to-one relation, of either side."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    pairs = table(spark, sf_dir, "customer").join(orders, "c_custkey", "left_semi").select("c_nationkey", "c_mktsegment")
    return keyed.not_one_to_one(pairs, "c_nationkey", "c_mktsegment")


@query("gapless_timeline", "SELECT l_orderkey, COUNT(*) AS n, COUNT(*) = COUNT(DISTINCT l_linenumber) AND MIN(l_linenumber) = 1 AND MAX(l_linenumber) = COUNT(*) AS complete FROM lineitem GROUP BY l_orderkey")
def gapless_timeline(spark, sf_dir):
    """Orders whose line numbers are 1..n, each once."""
    return keyed.gapless(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("active_annotations", "SELECT event_id, event_type FROM events WHERE event_id NOT IN (SELECT event_id - 7 FROM events WHERE event_id % 3 = 0)")
def active_annotations(spark, sf_dir):
    """Rows that no later row supersedes."""
    rows = table(spark, sf_dir, "events").withColumn("supersedes", F.when(F.col("event_id") % 3 == 0, F.col("event_id") - 7))
    return keyed.active_rows(rows, "event_id", "supersedes").select("event_id", "event_type")


@query(
    "supersession_chains",
    "WITH RECURSIVE e AS (SELECT event_id, CASE WHEN event_id % 40 <> 0 THEN event_id - 1 END AS before FROM events), c AS (SELECT event_id AS root, event_id AS at, 1 AS n FROM e WHERE before IS NULL OR before NOT IN (SELECT event_id FROM events) UNION ALL SELECT root, e.event_id, n + 1 FROM c JOIN e ON e.before = c.at) SELECT root, MAX(n)::BIGINT AS revisions FROM c GROUP BY root",
)
def supersession_chains(spark, sf_dir):
    """Lengths of supersession chains, by pointer doubling."""
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 40 != 0, F.col("event_id") - 1).alias("before"))
    return keyed.chain_ends(rows, "event_id", "before").groupBy("root").agg((F.max("steps") + 1).alias("revisions"))


@query("latest_revision", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, COUNT(*) AS revisions FROM events GROUP BY user_id")
def latest_revision(spark, sf_dir):
    """The last row of each user, and how many there were."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.count("*").alias("revisions"))


@query("running_totals", "SELECT event_id, user_id, ROUND(SUM(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS running, LAG(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events")
def running_totals(spark, sf_dir):
    """Running sums and the row before, along each user's time."""
    from pyspark.sql import Window

    along = Window.partitionBy("user_id").orderBy("ts", "event_id")
    total = F.round(F.sum("value").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)), 4)
    return table(spark, sf_dir, "events").select("event_id", "user_id", total.alias("running"), F.lag("event_type").over(along).alias("before"))


@query(
    "unchanged_runs",
    "WITH s AS (SELECT user_id, ts, event_id, event_type, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island FROM events) SELECT user_id, event_type, COUNT(*) AS length FROM s GROUP BY user_id, event_type, island HAVING COUNT(*) >= 2",
)
def unchanged_runs(spark, sf_dir):
    """Runs of equal rows along each user's time: gaps and islands."""
    from pyspark.sql import Window

    along, same = Window.partitionBy("user_id").orderBy("ts", "event_id"), Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", (F.row_number().over(along) - F.row_number().over(same)).alias("island"))
    return rows.groupBy("user_id", "event_type", "island").agg(F.count("*").alias("length")).where("length >= 2").drop("island")


@query(
    "boundary_accounting",
    "WITH @offers SELECT coalesce(tab, '*') AS tab, coalesce(family, '*') AS family, COUNT(*) AS n, SUM(CASE WHEN period = 'FULL_TIME' THEN 1 ELSE 0 END)::BIGINT AS full_time FROM offers GROUP BY ROLLUP (tab, family)",
)
def boundary_accounting(spark, sf_dir):
    """Counts at several levels in one pass."""
    got = _offers(spark, sf_dir).rollup("tab", "family").agg(F.count("*").alias("n"), F.count_if(F.expr("period = 'FULL_TIME'")).alias("full_time"))
    return got.na.fill("*", ["tab", "family"])


@query(
    "anomaly_union",
    f"WITH @offers, {_FULL} SELECT 'LOW_MARGIN' AS kind, concat_ws('|', event_id, family, period, handicap_kind, line) AS evidence FROM complete WHERE total < 0.7 GROUP BY ALL UNION ALL SELECT 'HIGH_PRICE', raw_record_id FROM offers WHERE odds >= 7 UNION ALL SELECT 'MANY_ROWS', CAST(market_id AS VARCHAR) FROM offers GROUP BY market_id HAVING COUNT(*) >= 7",
)
def anomaly_union(spark, sf_dir):
    """Findings of several kinds in one table."""
    rows = _offers(spark, sf_dir)
    total = F.aggregate("best", F.lit(0.0), lambda s, b: s + 1 / b["odds"])
    low = _complete_markets(spark, sf_dir).where(total < 0.7).select(F.lit("LOW_MARGIN").alias("kind"), F.concat_ws("|", *_KEY).alias("evidence"))
    high = rows.where("odds >= 7").select(F.lit("HIGH_PRICE").alias("kind"), F.col("raw_record_id").alias("evidence"))
    many = rows.groupBy("market_id").count().where("count >= 7").select(F.lit("MANY_ROWS").alias("kind"), F.col("market_id").cast("string").alias("evidence"))
    return low.unionByName(high).unionByName(many)


@query("offer_lines", "WITH @offers SELECT raw_record_id, concat('ODD{FAMILY=\"', family, '\"; SELECTION=\"', selection, '\"; LINE=\"', line, '\";}') AS block FROM offers")
def offer_lines(spark, sf_dir):
    """Rows as packet text."""
    return _offers(spark, sf_dir).select("raw_record_id", F.format_string('ODD{FAMILY="%s"; SELECTION="%s"; LINE="%s";}', "family", "selection", "line").alias("block"))
