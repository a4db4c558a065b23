"""Queries of sources and sinks: what is written and read again, pages and their state, append-only tables, with SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.plans.relational import Query
from marketloom.session import shared_folder, table
from marketloom.sources import lines, pages

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
HOSTS = ("www.example.org", "m.example.org")


def query(name: str, oracle: str):
    """Register a query and its oracle."""

    def register(build: Query) -> Query:
        QUERIES[name], ORACLES[name] = build, oracle
        return build

    return register


@query(
    "json_lines_round_trip",
    "SELECT DISTINCT observation_id, run_id, observation_sequence, observed_at, disposition_reason, prematch_eligible, array_to_string(source_raw_record_ids, ',') AS sources, raw_observation.raw AS raw FROM snapshot_observations",
)
def json_lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations as JSON lines, written once and read again."""
    rows = table(spark, sf_dir, "snapshot_observations").select("observation_id", "run_id", "observation_sequence", "observed_at", "disposition_reason", "prematch_eligible", "source_raw_record_ids", "raw_observation").distinct()
    path = shared_folder(spark, "lines")
    if lines.write_json_lines(rows, path)["state"] != "PASS":
        raise ValueError("the lines read are not those written")
    read, _ = lines.read_json_lines(spark, path, rows.schema)
    return read.select("observation_id", "run_id", "observation_sequence", "observed_at", "disposition_reason", "prematch_eligible", F.array_join("source_raw_record_ids", ",").alias("sources"), F.col("raw_observation.raw").alias("raw"))


#: Rows in one packet file: a file is read as a whole.
PACKET_ROWS = 20_000
_FIELDS = ("ODD_ID", "EVENT_ID", "CATEGORY", "FAMILY", "MARKET", "PERIOD", "OWNER", "SELECTION", "LINE", "HANDICAP_KIND", "SETTLEMENT", "ODDS", "MARKET_INSTANCE", "SOURCE_INDEX", "PARTICIPANT")


@query(
    "packet_round_trip",
    "SELECT " + ", ".join(f"replace(coalesce(CAST({f.lower()} AS VARCHAR), ''), '\"', '''') AS {f.lower()}" for f in _FIELDS if f != "ODDS") + ", odds FROM odd_records",
)
def packet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of every record as a block of packet text, written and parsed again."""
    rows = table(spark, sf_dir, "odd_records")
    path = shared_folder(spark, "packets")
    lines.packet_blocks(rows, "ODD", {f: f.lower() for f in _FIELDS}).write.option("maxRecordsPerFile", PACKET_ROWS).text(path)
    _, blocks = lines.read_packets(spark, f"{path}/part-*")
    fields = [F.try_element_at("fields", F.lit(f)).alias(f.lower()) for f in _FIELDS]
    return blocks.where("name = 'ODD'").select(*fields).withColumn("odds", F.col("odds").try_cast("double"))


@query(
    "page_offers",
    "WITH r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS n FROM lineitem) SELECT l_orderkey, CAST(n AS INTEGER) AS \"at\", concat('Order & ', l_orderkey) AS heading, concat('part <', l_partkey, '>') AS label, printf('%.2f', CAST(1 + l_linenumber AS DOUBLE)) AS odds, l_linenumber % 3 <> 0 AS visible, concat('html[0]>main[0]>section[0]>button[', n, ']') AS dom_path FROM r",
)
def page_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of saved pages: every button with a price, its heading and place, and whether it shows."""
    rows = table(spark, sf_dir, "lineitem")
    hidden = F.when(F.col("l_linenumber") % 3 == 0, ' aria-hidden="true"').otherwise("")
    button = F.format_string("<button%s>part &lt;%d&gt; <b>%.2f</b></button>", hidden, "l_partkey", (1 + F.col("l_linenumber")).cast("double"))
    # The buttons of an order are a page of the result's making; a page is one text.
    found = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", button.alias("b")))).alias("bs"))
    html = F.concat(F.format_string("<html><main><h2>Order &amp; %d</h2><section>", "l_orderkey"), F.array_join("bs.b", "\n"), F.lit("<button>no price</button></section></main>"))
    return pages.dom_rows(found.select("l_orderkey", html.alias("html")), "l_orderkey", "html")


@query(
    "native_sides",
    "SELECT name_id, CAST(name_id AS VARCHAR) AS event, coalesce(nullif(short_name, ''), full_name) AS home_short, 'Away' AS away_short FROM native_short_names WHERE full_name IS NOT NULL AND name_id % 10 <> 0",
)
def native_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short names out of JSON that stands as text within a page's state; pages that give two are left out."""
    side = lambda name, short: F.struct(name.alias("name"), short.alias("shortName"))
    match = lambda short: F.struct(F.col("name_id").alias("matchId"), F.array(side(F.col("full_name"), short), side(F.lit("Other"), F.lit("Away"))).alias("contestants"))
    inner = F.to_json(F.struct(F.array(match(F.col("short_name")), F.when(F.col("name_id") % 10 == 0, match(F.lit("another")))).alias("list")))
    state = F.to_json(F.struct(F.lit(1).alias("v"), F.struct(inner.alias("body")).alias("cache")))
    page = F.concat(F.lit('<html><script>var x = "{";</script><script id="ng-state" type="application/json">'), state, F.lit("</script></html>"))
    rows = table(spark, sf_dir, "native_short_names").where("full_name is not null").select("name_id", "full_name", F.lit("Other").alias("other"), page.alias("html"))
    return pages.native_sides(rows, "name_id", "html", "full_name", "other").drop("page_sha256")


@query(
    "page_identity",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS route, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS match_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS match_time, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 2 = 0 END AS is_live FROM orders",
)
def page_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number that an address names, and what the page behind it says of itself."""
    key = F.col("o_orderkey")
    host = F.element_at(F.array(F.lit("other.example.org"), F.lit("WWW.example.org"), F.lit("m.example.org:443")), (key % 3 + 1).cast("int"))
    url = F.concat(F.lit("https://"), host, F.lit("/sport/a-b-m"), key.cast("string"), F.lit("?x=-m5#-m7"))
    second = F.when(key % 4 == 0, ', "matchId" : "99999999999"').otherwise("")
    live = F.when(key % 5 == 0, '"isLive": true, "isLive": false').otherwise(F.concat(F.lit('"isLive": '), F.when(key % 2 == 0, "True").otherwise("false"), F.lit(', "isLive":'), F.when(key % 2 == 0, "true").otherwise("FALSE")))
    html = F.concat(F.lit('{"matchId":"'), key.cast("string"), F.lit('"'), second, F.lit(', "matchDateUtc": "'), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('", '), live, F.lit("}"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", url.alias("url"), html.alias("html"))
    return rows.select("o_orderkey", pages.route_number(F.col("url"), HOSTS).alias("route"), *[c.alias(n) for n, c in pages.embedded_info(F.col("html")).items()])


@query("append_once", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal, (SELECT COUNT(*) FROM supplier WHERE s_suppkey % 2 = 0) AS first_run, (SELECT COUNT(*) FROM supplier WHERE s_suppkey % 2 <> 0) AS second_run, 0::BIGINT AS third_run FROM supplier")
def append_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that grows by what it does not have yet, and by nothing the third time."""
    rows, path = table(spark, sf_dir, "supplier"), shared_folder(spark, "appended")
    counts = [lines.append_new(part, path, "s_suppkey") for part in (rows.where("s_suppkey % 2 = 0"), rows.unionByName(rows), rows)]
    return spark.read.parquet(path).select("*", *[F.lit(n).cast("bigint").alias(f"{name}_run") for name, n in zip(("first", "second", "third"), counts, strict=True)])


@query("stored_artifacts", "SELECT n_nationkey, n_name, n_regionkey, concat('nation:', sha256(concat('{\"n_name\":\"', n_name, '\",\"n_nationkey\":', n_nationkey, ',\"n_regionkey\":', n_regionkey, '}'))) AS artifact_id, 0::BIGINT AS altered FROM nation")
def stored_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows stored under the digest of their content, and how many do not have it."""
    rows, path = table(spark, sf_dir, "nation"), shared_folder(spark, "artifacts")
    for _ in range(2):
        lines.append_artifacts(rows, path, "nation")
    altered = lines.altered_artifacts(spark, path, "nation").count()
    return spark.read.parquet(path).withColumn("altered", F.lit(altered).cast("bigint"))
