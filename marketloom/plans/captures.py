"""Queries over the capture tables and the event stream, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions import hashing, text
from marketloom.operators import keyed, manifests
from marketloom.plans.relational import Query
from marketloom.session import shared_folder, table
from marketloom.streaming import incremental

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query and its oracle."""

    def register(build: Query) -> Query:
        QUERIES[name] = build
        if oracle:
            ORACLES[name] = oracle
        return build

    return register


@query(
    "observation_texts",
    r"""SELECT obs_id, lower(trim(regexp_replace(coalesce(market, ''), '\s+', ' ', 'g'))) AS market, regexp_extract(coalesce(market_instance_id, ''), '\|column:([^|]+)', 1) AS column_role,
    TRY_CAST(replace(odds, ',', '.') AS DOUBLE) AS odds FROM headerless_rows""",
)
def observation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised texts of the raw observations."""
    rows = table(spark, sf_dir, "headerless_rows")
    return rows.select("obs_id", text.collapsed(F.col("market")).alias("market"), text.column_role(F.col("market_instance_id")).alias("column_role"), F.replace(F.col("odds"), F.lit(","), F.lit(".")).try_cast("double").alias("odds"))


_FOLD = r"trim(regexp_replace(lower(regexp_replace(strip_accents(coalesce({}, '')), '[^\x00-\x7F]', '', 'g')), '\s+', ' ', 'g'))"


@query("folded_names", f"SELECT name_id, {_FOLD.format('full_name')} AS dropped, {_FOLD.format("replace(replace(full_name, 'ł', 'l'), 'Ł', 'L')")} AS mapped FROM native_short_names")
def folded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names folded to ASCII, in both ways."""
    rows = table(spark, sf_dir, "native_short_names")
    return rows.select("name_id", text.ascii_folded(F.col("full_name")).alias("dropped"), text.contract_text(F.col("full_name")).alias("mapped"))


@query("packet_hashes")
def packet_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical hashes of the packets' JSON texts (tested against plain Python)."""
    rows = table(spark, sf_dir, "context_packets")
    return rows.select("packet_id", *[hashing.canonical_sha256(F.col(c)).alias(f"{c}_sha256") for c in ("fair_markets", "market_graph", "quarantined_rows")])


@query(
    "tab_counts",
    "SELECT run_id, tab_name, COUNT(*) AS n, COUNT(DISTINCT raw_record_id) AS records, SUM(CASE WHEN market IS NULL OR market = '' THEN 1 ELSE 0 END)::BIGINT AS without_market FROM headerless_rows GROUP BY ALL",
)
def tab_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of each run and tab."""
    return table(spark, sf_dir, "headerless_rows").groupBy("run_id", "tab_name").agg(F.count("*").alias("n"), F.count_distinct("raw_record_id").alias("records"), F.count_if(F.col("market").isNull() | (F.col("market") == "")).alias("without_market"))


@query(
    "disposition_accounting",
    "WITH o AS (SELECT run_id, COUNT(DISTINCT observation_id) AS seen, COUNT(*) AS stored, COUNT(DISTINCT CASE WHEN prematch_eligible THEN observation_id END) AS eligible FROM snapshot_observations GROUP BY run_id), m AS (SELECT run_id, MAX(observation_count) AS declared FROM snapshot_manifest GROUP BY run_id) SELECT m.run_id, coalesce(seen, 0) AS seen, coalesce(stored, 0) AS stored, coalesce(eligible, 0) AS eligible, CAST(declared AS BIGINT) AS declared FROM m LEFT JOIN o USING (run_id)",
)
def disposition_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each run stored against what its manifest declares."""
    own = table(spark, sf_dir, "snapshot_observations").groupBy("run_id").agg(F.count_distinct("observation_id").alias("seen"), F.count("*").alias("stored"), F.count_distinct(F.when(F.col("prematch_eligible"), F.col("observation_id"))).alias("eligible"))
    runs = table(spark, sf_dir, "snapshot_manifest").groupBy("run_id").agg(F.max("observation_count").cast("bigint").alias("declared"))
    return runs.join(own, "run_id", "left").na.fill(0, ["seen", "stored", "eligible"])


@query(
    "lineage_join",
    "WITH ids AS (SELECT DISTINCT run_id, observation_id, unnest(source_raw_record_ids) AS raw_record_id FROM snapshot_observations), raw AS (SELECT raw_record_id, COUNT(*) AS n FROM headerless_rows GROUP BY raw_record_id) SELECT i.run_id, COUNT(*) AS ids, COUNT(raw.n) AS found, COUNT(*) - COUNT(raw.n) AS missing, coalesce(SUM(raw.n), 0)::BIGINT AS raw_rows FROM ids i LEFT JOIN raw USING (raw_record_id) GROUP BY i.run_id",
)
def lineage_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations to the raw rows that their lineage names; the raw side combines before it is joined."""
    ids = table(spark, sf_dir, "snapshot_observations").select("run_id", "observation_id", F.explode("source_raw_record_ids").alias("raw_record_id")).distinct()
    raw = table(spark, sf_dir, "headerless_rows").groupBy("raw_record_id").agg(F.count("*").alias("n"))
    got = ids.join(raw, "raw_record_id", "left").groupBy("run_id").agg(F.count("*").alias("ids"), F.count("n").alias("found"), F.coalesce(F.sum("n"), F.lit(0)).alias("raw_rows"))
    return got.withColumn("missing", F.col("ids") - F.col("found"))


@query(
    "stored_once",
    "SELECT run_id, tab_name, selection, odds, MIN(obs_id) AS obs_id, COUNT(*) AS sightings FROM headerless_rows GROUP BY run_id, tab_name, selection, odds",
)
def stored_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal quotes of a run as one, the first kept."""
    return table(spark, sf_dir, "headerless_rows").groupBy("run_id", "tab_name", "selection", "odds").agg(F.min("obs_id").alias("obs_id"), F.count("*").alias("sightings"))


@query(
    "late_rows",
    "SELECT tab_name, COUNT(*) AS n, SUM(CASE WHEN ingested_at < captured_at + INTERVAL 1 DAY THEN 1 ELSE 0 END)::BIGINT AS in_time FROM headerless_rows GROUP BY tab_name",
)
def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that arrive a day late are kept and counted."""
    rows = table(spark, sf_dir, "headerless_rows").withColumn("until", F.col("captured_at") + F.expr("INTERVAL 1 DAY"))
    return incremental.flagged_late(rows, "ingested_at", "until").groupBy("tab_name").agg(F.count("*").alias("n"), F.count_if(F.expr("in_time")).alias("in_time"))


@query("sequence_gaps", "WITH d AS (SELECT DISTINCT run_id, observation_id, observation_sequence FROM snapshot_observations) SELECT run_id, COUNT(*) AS n, coalesce(COUNT(*) = COUNT(DISTINCT observation_sequence) AND MIN(observation_sequence) = 1 AND MAX(observation_sequence) = COUNT(*), FALSE) AS complete FROM d GROUP BY run_id")
def sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose observations are numbered without a gap."""
    rows = table(spark, sf_dir, "snapshot_observations").select("run_id", "observation_id", "observation_sequence").distinct()
    return keyed.gapless(rows, "run_id", "observation_sequence")


@query("match_sides", r"SELECT DISTINCT event_id, trim(string_split_regex(event_id, '\|')[1]) AS home, trim(string_split_regex(event_id, '\|')[2]) AS away FROM headerless_rows WHERE event_id LIKE '%|%'")
def match_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two sides that an event id names."""
    sides = F.split("event_id", r"\|")
    return table(spark, sf_dir, "headerless_rows").where("event_id like '%|%'").select("event_id", F.trim(sides[0]).alias("home"), F.trim(sides[1]).alias("away")).distinct()


@query("property_values", "SELECT event_type, COUNT(*) AS n, CAST(SUM(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type")
def property_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A member of JSON texts, summed."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k"))


def _streamed(spark: SparkSession, sf_dir: str, build, mode: str) -> DataFrame:
    like = table(spark, sf_dir, "events")
    # The glob finds the table as one file and as a folder of files.
    return incremental.run_available(spark, f"{sf_dir}/events.parquet*", like, build, shared_folder(spark, "stream"), shared_folder(spark, "progress"), mode)


@query("stream_first_seen", "SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user and type once, from the stream."""
    return _streamed(spark, sf_dir, lambda s: incremental.first_seen(s, ["user_id", "event_type"], "ts", "3650 days").select("user_id", "event_type"), "append")


@query("stream_window_counts", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, COUNT(*) AS n FROM events GROUP BY ALL")
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by hour and type, from the stream."""
    got = _streamed(spark, sf_dir, lambda s: incremental.windowed_counts(s, "ts", "1 hour", ["event_type"], "1 day"), "complete")
    return got.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("stream_latest", "SELECT user_id, arg_max(value, (ts, event_id)) AS value, COUNT(*) AS ticks FROM events GROUP BY user_id")
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value of each user, from the stream."""
    return _streamed(spark, sf_dir, lambda s: incremental.latest_values(s, "user_id", ["ts", "event_id"], "value"), "complete")


@query(
    "session_counts",
    "WITH s AS (SELECT *, CASE WHEN ts - LAG(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS no FROM s) SELECT user_id, strftime(MIN(ts), '%Y-%m-%d %H:%M:%S') AS session_start, COUNT(*) AS n FROM g GROUP BY user_id, no",
)
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user, apart by six hours."""
    got = incremental.session_counts(table(spark, sf_dir, "events"), "ts", "6 hours", "user_id", "1 day")
    return got.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")


@query(
    "correlated_ends",
    "SELECT a.event_id, MIN(b.event_id) AS end_id FROM (SELECT * FROM events WHERE event_type = 'click') a LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 12 HOUR GROUP BY a.event_id",
)
def correlated_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks with the purchases of their user within half a day; those without are pending."""
    rows = table(spark, sf_dir, "events")
    clicks = rows.where("event_type = 'click'").select("event_id", "user_id", "ts")
    ends = rows.where("event_type = 'purchase'").select(F.col("event_id").alias("end_id"), "user_id", F.col("ts").alias("end_ts"))
    got = incremental.correlated(clicks, ends, "user_id", "ts", "end_ts", "12 HOURS", "1 day")
    return got.groupBy("event_id").agg(F.min("end_id").alias("end_id"))


def _fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "snapshot_observations").select("run_id", "observation_id", "observation_sequence", "observed_at", "disposition", F.col("raw_observation.source_hash").alias("source_hash"), F.col("raw_observation.raw").alias("raw"))
    return manifests.fingerprinted(rows, ["disposition", "raw", "source_hash"], ["observation_id", "observation_sequence", "observed_at"])


@query(
    "run_manifests",
    """WITH o AS (SELECT run_id, observation_id, observation_sequence, observed_at, disposition, raw_observation.source_hash AS source_hash, raw_observation.raw AS raw, COUNT(*) AS stored FROM snapshot_observations GROUP BY ALL),
    c AS (SELECT run_id, disposition, source_hash, raw, COUNT(*) AS n FROM o GROUP BY ALL), k AS (SELECT run_id, COUNT(*) AS contents, SUM(CASE WHEN n > 1 THEN 1 ELSE 0 END)::BIGINT AS repeated_contents FROM c GROUP BY run_id)
    SELECT run_id, SUM(stored)::BIGINT AS stored, COUNT(*) AS occurrences, contents, repeated_contents FROM o JOIN k USING (run_id) GROUP BY run_id, contents, repeated_contents""",
)
def run_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each run's manifest; the digests are tested for order and tampering."""
    got = manifests.run_manifests(_fingerprints(spark, sf_dir), "run_id", "observation_sequence")
    return got.select("run_id", "stored", "occurrences", "contents", "repeated_contents")


@query(
    "run_digests",
    """WITH o AS (SELECT DISTINCT run_id, sha256(CAST(json_object('disposition', disposition, 'observation_id', observation_id, 'observation_sequence', observation_sequence, 'observed_at', observed_at, 'raw', raw_observation.raw, 'source_hash', raw_observation.source_hash) AS VARCHAR)) AS h FROM snapshot_observations),
    p AS (SELECT run_id, substr(h, 1, 2) AS part, sha256(string_agg(h, chr(10) ORDER BY h)) AS d FROM o GROUP BY ALL)
    SELECT run_id, sha256(string_agg(concat(part, ':', d), chr(10) ORDER BY part)) AS digest FROM p GROUP BY run_id""",
)
def run_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of each run."""
    return manifests.run_manifests(_fingerprints(spark, sf_dir), "run_id", "observation_sequence").select("run_id", "digest")


@query(
    "contained_lineage",
    "WITH o AS (SELECT DISTINCT observation_id, unnest(source_raw_record_ids) AS id FROM snapshot_observations), r AS (SELECT DISTINCT run_id, raw_record_id AS id FROM headerless_rows WHERE raw_record_id IS NOT NULL), s AS (SELECT observation_id, COUNT(*) AS n FROM o WHERE id IS NOT NULL GROUP BY observation_id) SELECT o.observation_id, r.run_id FROM o JOIN r USING (id) JOIN s USING (observation_id) GROUP BY o.observation_id, r.run_id, s.n HAVING COUNT(*) = s.n",
)
def contained_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations and the runs that hold all raw rows of their lineage."""
    a = table(spark, sf_dir, "snapshot_observations").select("observation_id", F.explode("source_raw_record_ids").alias("id"))
    b = table(spark, sf_dir, "headerless_rows").select("run_id", F.col("raw_record_id").alias("id"))
    return manifests.contained(a, b, "observation_id", "run_id", "id")
