"""Queries of accounting, price comparison, fitted rates and ledgers, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import accounting, keyed, ledgers, numeric, pricing
from marketloom.operators.nested import nested_nodes
from marketloom.operators.offers import OFFERS_SQL
from marketloom.plans.relational import _FULL, _KEY, _OVER, _RATE, Query, _complete_markets, _offers, _rates
from marketloom.session import table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str):
    """Register a query and its oracle; ``@offers`` in the oracle is the offers view."""

    def register(build: Query) -> Query:
        QUERIES[name], ORACLES[name] = build, oracle.replace("@offers", OFFERS_SQL)
        return build

    return register


@query(
    "better_prices",
    """WITH @offers, k AS (SELECT event_id, market_id AS market, tab AS category, odds, source_index, concat_ws('|', family, period, handicap_kind, line, selection) AS signature, 'EXACT' AS rule FROM offers UNION ALL
      SELECT event_id, market_id, tab, odds, source_index, concat_ws('|', 'win', period, selection), 'WIN' FROM offers WHERE (family = '1X2' AND selection <> 'DRAW') OR (handicap_kind = 'TWO_WAY' AND line = '-0.5')),
    g AS (SELECT event_id, signature, rule, string_agg(concat_ws(':', source_index, market, category, odds), ',' ORDER BY source_index, market, category, odds) AS print, MAX(odds) AS best_odds, MIN(odds) AS low,
      arg_min({m: market, c: category}, (-odds, market, category, source_index)) AS b FROM k GROUP BY ALL),
    f AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id, print ORDER BY signature, rule) AS place FROM g),
    a AS (SELECT * FROM f WHERE place = 1 AND low < best_odds AND (rule <> 'EXACT' OR best_odds / low - 1 <= 0.5))
    SELECT a.event_id, a.signature, a.rule, b.m AS best_market, b.c AS best_category, best_odds, ROW_NUMBER() OVER (PARTITION BY a.event_id, a.signature, a.rule ORDER BY k.odds DESC, k.market, k.category, k.source_index) AS copy_no, k.market, k.category, k.odds, ROUND((best_odds / k.odds - 1) * 100, 6) AS gain_percent
    FROM a JOIN k USING (event_id, signature, rule) WHERE k.odds < best_odds AND (best_odds / k.odds - 1) * 100 >= 0.01""",
)
def better_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices worse than another one of the same meaning, from the best on; equal groups count once."""
    win = ((F.col("family") == "1X2") & (F.col("selection") != "DRAW")) | ((F.col("handicap_kind") == "TWO_WAY") & (F.col("line") == "-0.5"))
    exact = F.struct(F.concat_ws("|", "family", "period", "handicap_kind", "line", "selection").alias("signature"), F.lit("EXACT").alias("rule"))
    wins = F.struct(F.concat_ws("|", F.lit("win"), "period", "selection").alias("signature"), F.lit("WIN").alias("rule"))
    means = F.explode(F.array_compact(F.array(exact, F.when(win, wins)))).alias("k")
    rows = _offers(spark, sf_dir).select("event_id", F.col("market_id").alias("market"), F.col("tab").alias("category"), "odds", "source_index", means).select("*", "k.*")
    return pricing.better_prices(rows, "event_id", "signature", "rule", "market", "category", "odds", "source_index", "EXACT")


@query(
    "fitted_rates",
    f"""WITH RECURSIVE @offers, {_OVER}, {_RATE}, r AS (SELECT CAST(floor(event_id / 4) AS BIGINT) AS round, event_id, period, ROUND(rate, 5) AS rate, ROUND(greatest(0.05e0, 1 / greatest(1, total)), 6) AS weight FROM rates),
    w AS (SELECT *, SUM(weight) OVER (PARTITION BY round ORDER BY rate, event_id, period ROWS UNBOUNDED PRECEDING) AS run, SUM(weight) OVER (PARTITION BY round) / 2 AS half FROM r),
    m AS (SELECT round, MIN(rate) AS fit FROM w WHERE run >= half GROUP BY round)
    SELECT round, fit AS rate, ROUND(sqrt(SUM(weight * (rate - fit) * (rate - fit)) / SUM(weight)), 6) AS residual, ROUND(median(abs(rate - fit)), 6) AS dispersion, COUNT(*) AS markets,
    CASE WHEN COUNT(*) >= 3 AND sqrt(SUM(weight * (rate - fit) * (rate - fit)) / SUM(weight)) <= 0.35 THEN 'HIGH' WHEN COUNT(*) >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM r JOIN m USING (round) GROUP BY round, fit""",
)
def fitted_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate that several markets agree on, with its residual, dispersion and confidence."""
    weight = F.round(F.greatest(F.lit(0.05), 1 / F.greatest(F.lit(1.0), "total")), 6)
    rows = _rates(spark, sf_dir).select(F.floor(F.col("event_id") / 4).alias("round"), "event_id", "period", F.round("rate", 5).alias("rate"), weight.alias("weight"))
    got = pricing.fitted_rates(rows, "round", "rate", "weight", ["event_id", "period"])
    return got.select("round", "rate", F.round("residual", 6).alias("residual"), F.round("dispersion", 6).alias("dispersion"), "markets", "confidence")


_POWER = "list_sum(list_transform(q, lambda x: pow(x, (lo + hi) / 2)))"
_Z = "((lo + hi) / 2)"
_SHARE = f"(sqrt({_Z} * {_Z} + 4 * (1 - {_Z}) * x * x / t) - {_Z}) / (2 * (1 - {_Z}))"


@query(
    "fair_markets",
    f"""WITH RECURSIVE @offers, {_FULL},
    m AS (SELECT concat_ws('|', event_id, family, period, handicap_kind, line) AS market, list(1 / odds ORDER BY selection) AS q, MAX(total) AS t, CASE WHEN MIN(family) = '1X2' THEN 'SHIN' ELSE 'POWER' END AS method FROM complete GROUP BY ALL),
    s AS (SELECT market, q, t, method, CASE WHEN method = 'SHIN' THEN 0e0 ELSE 0.01e0 END AS lo, CASE WHEN method = 'SHIN' THEN 0.999999999e0 ELSE 100e0 END AS hi, 0 AS i FROM m UNION ALL
          SELECT market, q, t, method, CASE WHEN (CASE WHEN method = 'SHIN' THEN list_sum(list_transform(q, lambda x: {_SHARE})) ELSE {_POWER} END) > 1 THEN (lo + hi) / 2 ELSE lo END,
          CASE WHEN (CASE WHEN method = 'SHIN' THEN list_sum(list_transform(q, lambda x: {_SHARE})) ELSE {_POWER} END) > 1 THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM s WHERE i < 70),
    z AS (SELECT market, CASE WHEN method = 'SHIN' AND t <= 1 THEN 'MULTIPLICATIVE_FALLBACK' ELSE method END AS method, CASE WHEN method = 'SHIN' AND t <= 1 THEN list_transform(q, lambda x: x / t) WHEN method = 'SHIN' THEN list_transform(q, lambda x: {_SHARE})
          ELSE list_transform(q, lambda x: pow(x, {_Z})) END AS p FROM s WHERE i = 70)
    SELECT market, method, array_to_string(list_transform(p, lambda x: printf('%.6f', x)), ',') AS probabilities FROM z""",
)
def fair_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fair probabilities of every complete market: Shin's method for three outcomes of a match, power for the rest, plain shares
    where the method has no answer."""
    markets = _complete_markets(spark, sf_dir).select(F.concat_ws("|", *_KEY).alias("market"), F.col("best.odds").alias("prices"), F.when(F.col("family") == "1X2", "SHIN").otherwise("POWER").alias("preferred"))
    got = numeric.devigged_or_shares(markets, "market", "prices", "preferred")
    return got.select("market", "method", F.array_join(F.transform("probabilities", lambda p: F.format_string("%.6f", p)), ",").alias("probabilities"))


_CHAINS = {"RESULT_CHAIN": ["1X2", "DNB", "HANDICAP_EUROPEAN"], "GOAL_CHAIN": ["GOALS_OU", "BTTS"]}


@query(
    "market_chains",
    f"""WITH @offers, {_FULL}, m AS (SELECT DISTINCT event_id, family, concat_ws('|', family, period, handicap_kind, line) AS market FROM complete),
    c AS (SELECT event_id, market, CASE WHEN family IN ('1X2', 'DNB', 'HANDICAP_EUROPEAN') THEN 'RESULT_CHAIN' WHEN family IN ('GOALS_OU', 'BTTS') THEN 'GOAL_CHAIN' END AS chain FROM m)
    SELECT event_id, chain, string_agg(market, ',' ORDER BY market) AS markets FROM c WHERE chain IS NOT NULL GROUP BY ALL HAVING COUNT(*) >= 2""",
)
def market_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete markets of an event that are about the result, and about goals."""
    markets = _complete_markets(spark, sf_dir).select("event_id", "family", F.concat_ws("|", "family", "period", "handicap_kind", "line").alias("market"))
    got = pricing.market_chains(markets, "event_id", "market", "family", _CHAINS)
    return got.select("event_id", "chain", F.array_join("markets", ",").alias("markets"))


@query(
    "ordered_findings",
    f"""WITH @offers, {_FULL}, h AS (SELECT event_id, period, selection, CAST(line AS DOUBLE) * CASE WHEN selection = 'HOME' THEN 1 ELSE -1 END AS line_at, ROUND(1 / odds / total, 6) AS p FROM complete WHERE handicap_kind = 'TWO_WAY'),
    l AS (SELECT *, LAG(p) OVER w AS before, LAG(line_at) OVER w AS at_before FROM h WINDOW w AS (PARTITION BY event_id, period, selection ORDER BY line_at, p)),
    f AS (SELECT 'CURVE_FALLS' AS kind, concat_ws('|', event_id, period, selection, printf('%.1f', line_at)) AS evidence FROM l WHERE at_before < line_at AND p < before - 0.035
      UNION ALL SELECT 'INCOMPLETE_MARKET', concat_ws('|', event_id, family, period, handicap_kind, line) FROM priced GROUP BY event_id, family, period, handicap_kind, line, n HAVING n <> CASE WHEN family = '1X2' OR handicap_kind = 'THREE_WAY' THEN 3 ELSE 2 END
      UNION ALL SELECT 'SUSPICIOUS_LINE', raw_record_id FROM offers WHERE line <> '' AND abs(TRY_CAST(line AS DOUBLE)) > CASE WHEN period = '1ST_HALF' THEN 1.5 ELSE 2 END)
    SELECT kind, evidence, ROW_NUMBER() OVER (ORDER BY kind, evidence) AS place FROM f""",
)
def ordered_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of several kinds, numbered by kind and evidence over the whole table, range by range."""
    rows = _offers(spark, sf_dir)
    total = F.aggregate("best", F.lit(0.0), lambda s, b: s + 1 / b["odds"])
    sides = _complete_markets(spark, sf_dir).where("handicap_kind = 'TWO_WAY'").select("event_id", "period", "line", total.alias("total"), F.explode("best").alias("b"))
    at = F.col("line").cast("double") * F.when(F.col("b.selection") == "HOME", 1).otherwise(-1)
    points = sides.select("event_id", "period", "b.selection", at.alias("line_at"), F.round(1 / F.col("b.odds") / F.col("total"), 6).alias("value"))
    falls = numeric.curve_breaks(points, ["event_id", "period", "selection"], "line_at", "value", 0.035)
    falls = falls.select(F.lit("CURVE_FALLS").alias("kind"), F.concat_ws("|", "event_id", "period", "selection", F.format_string("%.1f", "line_at")).alias("evidence"))
    outcomes = rows.groupBy(*_KEY).agg(F.count_distinct("selection").alias("n"))
    short = outcomes.where(F.col("n") != F.when((F.col("family") == "1X2") | (F.col("handicap_kind") == "THREE_WAY"), 3).otherwise(2)).select(F.lit("INCOMPLETE_MARKET").alias("kind"), F.concat_ws("|", *_KEY).alias("evidence"))
    far = F.abs(F.col("line").try_cast("double")) > F.when(F.col("period") == "1ST_HALF", 1.5).otherwise(2)
    lines = rows.where((F.col("line") != "") & far).select(F.lit("SUSPICIOUS_LINE").alias("kind"), F.col("raw_record_id").alias("evidence"))
    return keyed.numbered(falls.unionByName(short).unionByName(lines), [], ["kind", "evidence"], "place")


@query("sequence_numbers", "SELECT obs_id, run_id, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY captured_at, obs_id) AS number FROM headerless_rows")
def sequence_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a run numbered as they were captured."""
    return keyed.numbered(table(spark, sf_dir, "headerless_rows").select("obs_id", "run_id", "captured_at"), ["run_id"], ["captured_at", "obs_id"], "number").drop("captured_at")


@query(
    "accounting_layers",
    """WITH d AS (SELECT DISTINCT snapshot_no, event_id, market_instance, selection, odds FROM odd_records), r AS (SELECT snapshot_no, COUNT(*) AS raw FROM odd_records GROUP BY snapshot_no)
    SELECT d.snapshot_no, raw, COUNT(*) AS representatives, COUNT(*) FILTER (odds IS NOT NULL) AS accepted, COUNT(*) FILTER (odds IS NULL) AS quarantined, greatest(0, raw - COUNT(*)) AS duplicates_suppressed, COUNT(*) = COUNT(*) FILTER (odds IS NOT NULL) + COUNT(*) FILTER (odds IS NULL) AS consistent FROM d JOIN r USING (snapshot_no) GROUP BY d.snapshot_no, raw""",
)
def accounting_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each snapshot holds, layer by layer, and whether the layers add up."""
    one = table(spark, sf_dir, "odd_records").groupBy("snapshot_no", "event_id", "market_instance", "selection", "odds").agg(F.count("*").alias("n"))
    got = one.groupBy("snapshot_no").agg(F.sum("n").alias("raw"), F.count("*").alias("representatives"), F.count_if(F.col("odds").isNotNull()).alias("accepted"), F.count_if(F.col("odds").isNull()).alias("quarantined"))
    return got.withColumns(accounting.layers(F.col("raw"), F.col("representatives"), F.col("representatives"), F.col("accepted"), F.col("quarantined")))


def _pct(good: str, total: str) -> str:
    return f"CASE WHEN {total} <= 0 THEN 100e0 ELSE round_even(greatest(0, least({good}, {total})) * 100e0 / {total}, 1) END"


_RUN_COUNTS = """c AS (SELECT run_id, COUNT(DISTINCT tab_name) AS detected, COUNT(DISTINCT CASE WHEN visibility = 'VISIBLE' THEN tab_name END) AS scanned, COUNT(*) AS raw, COUNT(TRY_CAST(replace(trim(odds), ',', '.') AS DOUBLE)) AS parsed,
  COUNT(*) FILTER (period IS NULL OR period NOT IN ('FULL_TIME', '1ST_HALF', '2ND_HALF')) AS unknown, COUNT(DISTINCT CASE WHEN selection IS NULL OR market IS NULL THEN market_instance_id END) AS incomplete, COUNT(*) FILTER (market IS NULL) AS excluded, COUNT(*) FILTER (raw_record_id IS NULL) AS unaccounted FROM headerless_rows GROUP BY run_id)"""


@query(
    "completeness_scores",
    f"""WITH {_RUN_COUNTS}, s AS (SELECT run_id, CASE WHEN unaccounted > 0 THEN 0e0 ELSE {_pct("scanned", "detected")} END AS coverage, {_pct("parsed", "raw")} AS parse, {_pct("greatest(0, parsed - unknown)", "parsed")} AS placed,
    {_pct("greatest(0, parsed - incomplete)", "parsed")} AS instances, {_pct("greatest(0, raw - excluded)", "raw")} AS kept FROM c) SELECT *, round_even((coverage + parse + placed + instances + kept) / 5, 1) AS score FROM s""",
)
def completeness_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How complete each run is: five shares and their mean."""
    number = F.replace(F.trim("odds"), F.lit(","), F.lit(".")).try_cast("double")
    got = table(spark, sf_dir, "headerless_rows").groupBy("run_id").agg(
        F.count_distinct("tab_name").alias("detected"), F.count_distinct(F.when(F.col("visibility") == "VISIBLE", F.col("tab_name"))).alias("scanned"), F.count("*").alias("raw"), F.count(number).alias("parsed"),
        F.count_if(~F.coalesce(F.col("period").isin("FULL_TIME", "1ST_HALF", "2ND_HALF"), F.lit(False))).alias("unknown"), F.count_distinct(F.when(F.col("selection").isNull() | F.col("market").isNull(), F.col("market_instance_id"))).alias("incomplete"),
        F.count_if(F.col("market").isNull()).alias("excluded"), F.count_if(F.col("raw_record_id").isNull()).alias("unaccounted"),
    )
    parts = accounting.completeness(*[F.col(c) for c in ("detected", "scanned", "raw", "parsed", "unknown", "incomplete", "excluded", "unaccounted")])
    return got.select("run_id", *[c.alias(n) for n, c in parts.items()])


@query(
    "quality_report",
    """SELECT snapshot_no, round_even(COUNT(odds) * 100e0 / COUNT(*), 1) AS accepted_share, COUNT(*) - COUNT(odds) AS quarantined,
    CASE coalesce(MAX(CASE WHEN odds IS NULL THEN CASE WHEN upper(family) IN ('1X2', 'BTTS', 'GOALS_OU') THEN 2 WHEN upper(family) IN ('PLAYER_PROP', 'GOALSCORER') THEN 0 ELSE 1 END END), 0) WHEN 2 THEN 'MATERIAL' WHEN 1 THEN 'LOW' ELSE 'NONE' END AS impact FROM odd_records GROUP BY snapshot_no""",
)
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each snapshot that is accepted, and how much what is not accepted matters."""
    family = F.upper("family")
    weight = F.when(family.isin("1X2", "BTTS", "GOALS_OU"), 2).when(family.isin("PLAYER_PROP", "GOALSCORER"), 0).otherwise(1)
    got = table(spark, sf_dir, "odd_records").groupBy("snapshot_no").agg(F.count("odds").alias("a"), F.count("*").alias("n"), F.max(F.when(F.col("odds").isNull(), weight)).alias("w"))
    impact = F.when(F.col("w") == 2, "MATERIAL").when(F.col("w") == 1, "LOW").otherwise("NONE")
    return got.select("snapshot_no", accounting.share(F.col("a"), F.col("n")).alias("accepted_share"), (F.col("n") - F.col("a")).alias("quarantined"), impact.alias("impact"))


@query(
    "quarantine_reasons",
    r"""WITH raw AS (SELECT DISTINCT packet_id, quarantined_rows AS t FROM context_packets), once AS (SELECT packet_id, CASE WHEN json_valid(t) THEN CASE WHEN json_type(t) = 'VARCHAR' THEN json_extract_string(t, '$') ELSE t END END AS t FROM raw),
    it AS (SELECT packet_id, unnest(json_extract(CAST(t AS JSON), '$[*]')) AS x FROM once WHERE json_valid(t)),
    r AS (SELECT packet_id, unnest(CASE WHEN json_type(x, '$.reasons') = 'VARCHAR' THEN [json_extract_string(x, '$.reasons')] ELSE json_extract_string(x, '$.reasons[*]') END) AS reason FROM it)
    SELECT reason, COUNT(*) AS rows, COUNT(DISTINCT packet_id) AS packets FROM r GROUP BY reason""",
)
def quarantine_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each reason stands in the packets' nested rows."""
    packets = table(spark, sf_dir, "context_packets").select("packet_id", "quarantined_rows").distinct()
    nodes = nested_nodes(packets, "packet_id", ["quarantined_rows"], paths={"quarantined_rows": {"[].reasons[]", "[].reasons"}}).where("kind = 'string'")
    return nodes.groupBy(F.col("value").alias("reason")).agg(F.count("*").alias("rows"), F.count_distinct("packet_id").alias("packets"))


@query(
    "run_states",
    """WITH t AS (SELECT run_id, event_id, tab_name, CASE WHEN COUNT(TRY_CAST(replace(trim(odds), ',', '.') AS DOUBLE)) = COUNT(*) THEN 'PASS' WHEN COUNT(TRY_CAST(replace(trim(odds), ',', '.') AS DOUBLE)) > 0 THEN 'PARTIAL' ELSE 'FAIL' END AS state FROM headerless_rows WHERE tab_name IS NOT NULL GROUP BY ALL),
    d AS (SELECT event_id, COUNT(DISTINCT tab_name) AS n, list(DISTINCT tab_name) AS tabs FROM t GROUP BY event_id),
    r AS (SELECT run_id, event_id, list(state) AS states, list(tab_name) AS seen FROM t GROUP BY ALL)
    SELECT run_id, r.event_id, array_to_string(list_sort(list_filter(tabs, lambda x: NOT list_contains(seen, x))), ',') AS missing, CASE WHEN list_contains(states, 'FAIL') THEN 'FAIL' WHEN n <> len(seen) OR list_contains(states, 'PARTIAL') THEN 'PARTIAL' ELSE 'PASS' END AS state FROM r JOIN d USING (event_id)""",
)
def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each run from those of its tabs, and the tabs of its event that it lacks."""
    number = F.replace(F.trim("odds"), F.lit(","), F.lit(".")).try_cast("double")
    tabs = table(spark, sf_dir, "headerless_rows").where("tab_name is not null").groupBy("run_id", "event_id", "tab_name").agg(F.count(number).alias("good"), F.count("*").alias("n"))
    tabs = tabs.withColumn("state", F.when(F.col("good") == F.col("n"), "PASS").when(F.col("good") > 0, "PARTIAL").otherwise("FAIL"))
    runs = tabs.groupBy("run_id", "event_id").agg(F.collect_set("state").alias("states"), F.collect_set("tab_name").alias("seen"))
    known = tabs.groupBy("event_id").agg(F.collect_set("tab_name").alias("tabs"))
    met = runs.join(known, "event_id").withColumn("lacks", F.array_sort(F.array_except("tabs", "seen")))
    return met.select("run_id", "event_id", F.array_join("lacks", ",").alias("missing"), accounting.whole_state(F.col("states"), F.col("lacks"), F.size("tabs"), F.size("seen")).alias("state"))


@query(
    "collapsed_errors",
    """WITH e AS (SELECT l_returnflag, CASE l_linenumber % 4 WHEN 1 THEN 'MISSING' WHEN 2 THEN 'REQUIRED' END AS prefix, CASE l_linenumber % 4 WHEN 1 THEN 'LINE' ELSE '' END AS detail, CASE l_linenumber % 4 WHEN 3 THEN concat('OTHER:', l_partkey % 5) END AS other FROM lineitem WHERE l_linenumber % 4 <> 0)
    SELECT l_returnflag, CASE WHEN other IS NOT NULL THEN other WHEN detail <> '' THEN concat(prefix, ':', detail, ':COUNT=', COUNT(*)) ELSE concat(prefix, ':COUNT=', COUNT(*)) END AS error FROM e GROUP BY l_returnflag, prefix, detail, other""",
)
def collapsed_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of single records as one with their count."""
    i, key = F.col("l_linenumber") % 4, F.col("l_orderkey").cast("string")
    error = F.when(i == 1, F.concat(F.lit("MISSING:"), key, F.lit(":LINE"))).when(i == 2, F.concat(F.lit("REQUIRED:"), key)).when(i == 3, F.concat(F.lit("OTHER:"), (F.col("l_partkey") % 5).cast("string")))
    return accounting.collapsed_errors(table(spark, sf_dir, "lineitem").select("l_returnflag", error.alias("error")), "l_returnflag", "error", ["MISSING", "REQUIRED"])


_KNOWN_FAMILIES = ("1X2", "BTTS", "GOALS_OU")


@query("unsupported_families", "SELECT snapshot_no, string_agg(DISTINCT family, ',' ORDER BY family) AS families FROM odd_records WHERE family NOT IN ('1X2', 'BTTS', 'GOALS_OU') GROUP BY snapshot_no")
def unsupported_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of each snapshot that are not among the known ones."""
    got = accounting.set_difference(table(spark, sf_dir, "odd_records"), ["snapshot_no"], "family", list(_KNOWN_FAMILIES))
    return got.select("snapshot_no", F.array_join("family", ",").alias("families"))


@query(
    "open_types",
    """WITH u AS (SELECT user_id, list(DISTINCT event_type) AS seen, list(DISTINCT event_type) FILTER (value > 20) AS active, list(DISTINCT event_type) FILTER (event_id % 3 = 0) AS done FROM events GROUP BY user_id)
    SELECT user_id, array_to_string(list_sort(list_filter(seen, lambda x: list_contains(coalesce(active, []), x) AND NOT list_contains(coalesce(done, []), x))), ',') AS still_open FROM u""",
)
def open_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of what each user was seen with, what is still active and not done."""
    kinds = lambda cond: F.collect_set(F.when(cond, F.col("event_type")))
    got = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("seen"), kinds(F.col("value") > 20).alias("active"), kinds(F.col("event_id") % 3 == 0).alias("done"))
    return got.select("user_id", F.array_join(accounting.still_open(F.col("seen"), F.col("active"), F.col("done")), ",").alias("still_open"))


@query(
    "container_counts",
    """WITH c AS (SELECT run_id, CASE WHEN market_instance_id LIKE '%|row#%' THEN split_part(market_instance_id, '|row#', 1) ELSE concat(coalesce(nullif(active_tab, ''), tab_name, ''), '|', coalesce(nullif(heading_path, ''), market, '')) END AS container FROM headerless_rows)
    SELECT run_id, COUNT(DISTINCT container) AS containers, COUNT(*) AS rows FROM c GROUP BY run_id""",
)
def container_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of each run: as the instance names them, else by tab and heading."""
    instance, given = F.col("market_instance_id"), lambda c: F.nullif(F.col(c), F.lit(""))
    container = F.when(instance.contains("|row#"), F.substring_index(instance, "|row#", 1)).otherwise(F.concat(F.coalesce(given("active_tab"), F.col("tab_name"), F.lit("")), F.lit("|"), F.coalesce(given("heading_path"), F.col("market"), F.lit(""))))
    return table(spark, sf_dir, "headerless_rows").groupBy("run_id").agg(F.count_distinct(container).alias("containers"), F.count("*").alias("rows"))


@query("price_bounds", "WITH n AS (SELECT obs_id, odds, TRY_CAST(replace(trim(odds), ',', '.') AS DOUBLE) AS x FROM headerless_rows) SELECT obs_id, CASE WHEN odds IS NULL OR trim(odds) = '' THEN 'MISSING' WHEN x IS NULL THEN 'NOT_NUMERIC' WHEN x < 1.01 THEN 'TOO_LOW' WHEN x > 1000 THEN 'TOO_HIGH' ELSE '' END AS fault FROM n")
def price_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices that are none, or outside their bounds (1.01 to 1000)."""
    x = F.replace(F.trim("odds"), F.lit(","), F.lit(".")).try_cast("double")
    fault = F.when(F.coalesce(F.trim("odds"), F.lit("")) == "", "MISSING").when(x.isNull(), "NOT_NUMERIC").when(x < 1.01, "TOO_LOW").when(x > 1000, "TOO_HIGH").otherwise("")
    return table(spark, sf_dir, "headerless_rows").select("obs_id", fault.alias("fault"))


@query("coverage_counts", "SELECT run_id, COUNT(DISTINCT active_tab) AS tabs, COUNT(DISTINCT market_instance_id) AS instances, COUNT(DISTINCT capture_id) AS captures, COUNT(DISTINCT raw_record_id) AS records, COUNT(DISTINCT CASE WHEN visibility = 'VISIBLE' THEN raw_record_id END) AS visible FROM headerless_rows GROUP BY run_id")
def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the sets that each run saw."""
    shown = F.when(F.col("visibility") == "VISIBLE", F.col("raw_record_id"))
    return table(spark, sf_dir, "headerless_rows").groupBy("run_id").agg(F.count_distinct("active_tab").alias("tabs"), F.count_distinct("market_instance_id").alias("instances"), F.count_distinct("capture_id").alias("captures"), F.count_distinct("raw_record_id").alias("records"), F.count_distinct(shown).alias("visible"))


@query(
    "append_faults",
    """WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN event_id - 9 END AS up FROM events WHERE event_id % 10 <> 0), n AS (SELECT CASE WHEN event_id % 70 = 0 THEN event_id + 1 ELSE event_id END AS id, user_id, CASE WHEN event_id % 20 = 0 THEN event_id - 1 END AS up FROM events WHERE event_id % 10 = 0),
    a AS (SELECT DISTINCT user_id FROM e WHERE event_id NOT IN (SELECT up FROM e WHERE up IS NOT NULL))
    SELECT n.id AS annotation, CASE WHEN user_id % 13 = 0 THEN 'UNKNOWN_TARGET' WHEN id IN (SELECT event_id FROM e) THEN 'EXISTS' WHEN n.up IS NOT NULL AND (SELECT MIN(e.user_id) FROM e WHERE e.event_id = n.up) IS DISTINCT FROM n.user_id THEN 'BAD_SUPERSESSION'
    WHEN n.up IS NULL AND user_id IN (SELECT user_id FROM a) THEN 'ACTIVE_DECISION' ELSE '' END AS fault FROM n""",
)
def append_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations that may not be appended to a ledger, and why."""
    rows, i = table(spark, sf_dir, "events"), F.col("event_id")
    old = rows.where(i % 10 != 0).select(i.alias("annotation"), "user_id", F.when(i % 3 == 0, i - 9).alias("supersedes"))
    new = rows.where(i % 10 == 0).select(F.when(i % 70 == 0, i + 1).otherwise(i).alias("annotation"), "user_id", F.when(i % 20 == 0, i - 1).alias("supersedes"))
    return ledgers.append_faults(old, new, rows.where("user_id % 13 <> 0"), "annotation", "user_id", "supersedes")


@query(
    "revision_faults",
    """WITH r AS (SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem WHERE (l_orderkey + l_linenumber) % 11 <> 0 GROUP BY ALL)
    SELECT r.l_orderkey, r.l_linenumber, CASE WHEN r.n > 1 THEN 'REPEATED' WHEN r.l_linenumber = 1 THEN CASE WHEN r.l_orderkey % 17 = 0 THEN 'INITIAL_SUPERSEDES' ELSE '' END WHEN r.l_linenumber = 5 THEN 'PRIOR_UNNAMED' WHEN p.n IS NULL THEN 'PRIOR_MISSING' WHEN r.l_linenumber = 4 THEN 'PRIOR_MISMATCH' ELSE '' END AS fault
    FROM r LEFT JOIN r p ON p.l_orderkey = r.l_orderkey AND p.l_linenumber = r.l_linenumber - 1""",
)
def revision_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions that do not name the one before them."""
    key, no = F.col("l_orderkey"), F.col("l_linenumber")
    digest = lambda n: F.sha2(F.concat_ws(":", key, n), 256)
    named = F.when((no == 1) & (key % 17 != 0), None).when(no == 5, None).when(no == 4, digest(no)).otherwise(digest(no - 1))
    rows = table(spark, sf_dir, "lineitem").where((key + no) % 11 != 0).select("l_orderkey", "l_linenumber", digest(no).alias("digest"), named.alias("supersedes"))
    return ledgers.revision_faults(rows, "l_orderkey", "l_linenumber", "digest", "supersedes")


@query(
    "timeline_faults",
    """WITH e AS (SELECT l_orderkey AS k, COUNT(*) AS n, COUNT(DISTINCT l_linenumber) AS d, MIN(l_linenumber) AS lo, MAX(l_linenumber) AS hi FROM lineitem WHERE (l_orderkey + l_linenumber) % 9 <> 0 GROUP BY l_orderkey), o AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 8 <> 0)
    SELECT coalesce(o.k, e.k) AS l_orderkey, coalesce(n, 0) AS events, CASE WHEN o.k IS NULL THEN 'FOREIGN_EVENTS' WHEN n IS NULL THEN '' WHEN d < n THEN 'REPEATED_SEQUENCE' WHEN lo <> 1 OR hi <> n THEN 'SEQUENCE_GAP' ELSE '' END AS fault FROM o FULL OUTER JOIN e ON o.k = e.k""",
)
def timeline_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes joined exactly to their events, and what is wrong with either."""
    outcomes = table(spark, sf_dir, "orders").where("o_orderkey % 8 <> 0").select(F.col("o_orderkey").alias("l_orderkey"))
    events = table(spark, sf_dir, "lineitem").where((F.col("l_orderkey") + F.col("l_linenumber")) % 9 != 0).select("l_orderkey", "l_linenumber")
    return ledgers.timeline_faults(outcomes, events, "l_orderkey", "l_linenumber")


@query("content_faults", "SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN 'ALTERED' WHEN s_suppkey % 7 = 0 THEN 'MISSING' ELSE '' END AS fault FROM supplier")
def content_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose stored digest is not that of their content."""
    from marketloom.functions.hashing import struct_sha256

    content, key = ["s_suppkey", "s_name", "s_nationkey"], F.col("s_suppkey")
    stored = table(spark, sf_dir, "supplier").withColumn("digest", F.when((key % 7 != 0) | (key % 9 == 0), struct_sha256(*content)))
    changed = stored.withColumn("s_name", F.when(key % 9 == 0, F.concat("s_name", F.lit("!"))).otherwise(F.col("s_name")))
    return changed.select("s_suppkey", ledgers.content_fault(content, F.col("digest")).alias("fault"))


@query(
    "observation_faults",
    """WITH d AS (SELECT DISTINCT run_id, observation_id, raw_record_id, observation_sequence, prematch_eligible, raw_observation.source_hash AS source FROM snapshot_observations), t AS (SELECT *, COUNT(*) OVER (PARTITION BY run_id, raw_record_id) AS n FROM d)
    SELECT run_id, CASE WHEN coalesce(observation_id, '') = '' THEN 'ID_MISSING' WHEN coalesce(raw_record_id, '') = '' THEN 'RAW_ID_MISSING' WHEN observation_sequence IS NULL OR observation_sequence < 1 THEN 'SEQUENCE_INVALID' WHEN n > 1 THEN 'RAW_ID_REPEATED' WHEN NOT coalesce(prematch_eligible, FALSE) THEN 'INELIGIBLE' WHEN coalesce(source, '') = '' THEN 'SOURCE_MISSING' ELSE '' END AS fault, COUNT(*) AS n FROM t GROUP BY ALL""",
)
def observation_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of each run by the first reason why they cannot enter its manifest."""
    one = table(spark, sf_dir, "snapshot_observations").select("run_id", "observation_id", "raw_record_id", "observation_sequence", "prematch_eligible", F.col("raw_observation.source_hash").alias("source")).distinct()
    times = one.groupBy("run_id", "raw_record_id").agg(F.count("*").alias("times"))
    met = one.join(times.withColumnsRenamed({"run_id": "r", "raw_record_id": "i"}), F.col("run_id").eqNullSafe(F.col("r")) & F.col("raw_record_id").eqNullSafe(F.col("i")))
    fault = ledgers.observation_fault(*[F.col(c) for c in ("observation_id", "raw_record_id", "observation_sequence", "prematch_eligible", "source", "times")])
    return met.groupBy("run_id", fault.alias("fault")).agg(F.count("*").alias("n"))


@query(
    "evidence_periods",
    """WITH e AS (SELECT unnest(period_evidence_candidates) AS c FROM headerless_rows), k AS (SELECT c.raw_record_id AS raw_record_id, coalesce(c.run_id, '') AS r, coalesce(c.event_id, '') AS v, coalesce(c.source_hash, '') AS h,
      CASE c.evidence_period WHEN 'FT' THEN 'FULL_TIME' WHEN 'P1' THEN '1ST_HALF' WHEN 'P2' THEN '2ND_HALF' WHEN 'FULL_TIME' THEN 'FULL_TIME' WHEN '1ST_HALF' THEN '1ST_HALF' WHEN '2ND_HALF' THEN '2ND_HALF' END AS p FROM e),
    o AS (SELECT obs_id, raw_record_id, CASE WHEN obs_id % 2 = 0 THEN period END AS period, coalesce(run_id, '') AS r, coalesce(event_id, '') AS v, coalesce(source_hash, '') AS h FROM headerless_rows),
    m AS (SELECT o.obs_id, any_value(o.period) AS own, MIN(k.p) FILTER (k.r = o.r AND k.v = o.v AND k.h = o.h) AS lo, MAX(k.p) FILTER (k.r = o.r AND k.v = o.v AND k.h = o.h) AS hi, COUNT(k.p) FILTER (NOT (k.r = o.r AND k.v = o.v AND k.h = o.h)) AS other FROM o LEFT JOIN k ON k.raw_record_id = o.raw_record_id AND k.p IS NOT NULL GROUP BY o.obs_id)
    SELECT obs_id, CASE WHEN coalesce(own, 'UNKNOWN') <> 'UNKNOWN' THEN own WHEN lo = hi THEN lo ELSE 'UNKNOWN' END AS period, CASE WHEN coalesce(own, 'UNKNOWN') <> 'UNKNOWN' THEN CASE WHEN lo IS NULL OR (lo = own AND hi = own) THEN 'PRESERVED' ELSE 'CONFLICT' END
      WHEN lo IS NULL THEN 'NO_EVIDENCE' WHEN lo = hi THEN 'RESOLVED' ELSE 'EVIDENCE_CONFLICT' END AS state, other AS "foreign" FROM m""",
)
def evidence_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown periods told by the evidence in the raw rows of the same run, event and source."""
    table_rows = table(spark, sf_dir, "headerless_rows")
    rows = table_rows.select("obs_id", "raw_record_id", F.when(F.col("obs_id") % 2 == 0, F.col("period")).alias("period"), "run_id", "event_id", "source_hash")
    # The periods that evidence names.
    named = {"FT": "FULL_TIME", "P1": "1ST_HALF", "P2": "2ND_HALF", "FULL_TIME": "FULL_TIME", "1ST_HALF": "1ST_HALF", "2ND_HALF": "2ND_HALF"}
    told = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])
    found = table_rows.select(F.explode("period_evidence_candidates").alias("c")).select("c.raw_record_id", "c.run_id", "c.event_id", "c.source_hash", F.try_element_at(told, F.col("c.evidence_period")).alias("period"))
    return keyed.resolved_by_evidence(rows, found, "obs_id", "raw_record_id", "period", ["run_id", "event_id", "source_hash"], "UNKNOWN")


@query(
    "axis_lines",
    "WITH @offers, a AS (SELECT event_id, period, family, line, CASE WHEN handicap_kind <> '' THEN printf('%g', CASE WHEN selection = 'AWAY' THEN -CAST(line AS DOUBLE) ELSE CAST(line AS DOUBLE) END) ELSE line END AS axis_line, selection, odds FROM offers) SELECT event_id, period, family, axis_line, COUNT(DISTINCT selection) AS sides, COUNT(*) AS n, MAX(odds) AS best FROM a GROUP BY event_id, period, family, axis_line",
)
def axis_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handicap lines on the home side's axis: an away line is its inverse."""
    from marketloom.functions.text import general_number

    line = F.col("line").try_cast("double")
    signed = general_number(F.when(F.col("selection") == "AWAY", -line).otherwise(line))
    rows = _offers(spark, sf_dir).withColumn("axis_line", F.when(F.col("handicap_kind") != "", signed).otherwise(F.col("line")))
    return rows.groupBy("event_id", "period", "family", "axis_line").agg(F.count_distinct("selection").alias("sides"), F.count("*").alias("n"), F.max("odds").alias("best"))


@query(
    "sidecar_states",
    "SELECT DISTINCT run_id, 'altered' AS state FROM snapshot_observations WHERE run_id LIKE '%7' UNION ALL SELECT DISTINCT run_id, 'missing' FROM snapshot_observations WHERE run_id LIKE '%3'",
)
def sidecar_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose observations, written as lines and read again, no longer give the manifest that they gave."""
    from marketloom.operators import manifests
    from marketloom.session import shared_folder
    from marketloom.sources import lines

    rows = table(spark, sf_dir, "snapshot_observations").select("run_id", "observation_id", "observation_sequence", "observed_at", "disposition", F.col("raw_observation.raw").alias("raw"))
    print_of = lambda df: manifests.run_manifests(manifests.fingerprinted(df, ["disposition", "raw"], ["observation_id", "observation_sequence", "observed_at"]), "run_id", "observation_sequence")
    path = shared_folder(spark, "sidecars")
    changed = rows.where("run_id not like '%3'").withColumn("raw", F.when(F.col("run_id").like("%7"), F.concat(F.coalesce("raw", F.lit("")), F.lit("!"))).otherwise(F.col("raw")))
    lines.write_json_lines(changed, path)
    read, _ = lines.read_json_lines(spark, path, rows.schema)
    return manifests.altered(print_of(rows), print_of(read), "run_id")
