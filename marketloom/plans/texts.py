"""Queries of the scalar functions: lines, names, clocks, packets, addresses, digests and frames, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions import hashing, text, transport
from marketloom.plans.relational import Query
from marketloom.session import table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str):
    """Register a query and its oracle."""

    def register(build: Query) -> Query:
        QUERIES[name], ORACLES[name] = build, oracle
        return build

    return register


_NUMBER = "TRY_CAST(replace(replace(trim(line), ' ', ''), ',', '.') AS DOUBLE)"


@query(
    "line_texts",
    f"""SELECT odd_id, CASE WHEN {_NUMBER} = 0 THEN '0' ELSE printf('%g', {_NUMBER}) END AS number,
    CASE WHEN TRY_CAST(line AS DECIMAL(10, 4)) IS NULL THEN 'INVALID' WHEN abs(TRY_CAST(line AS DECIMAL(10, 4))) % 1 = 0 THEN 'INTEGER' WHEN abs(TRY_CAST(line AS DECIMAL(10, 4))) % 1 = 0.5 THEN 'HALF'
         WHEN abs(TRY_CAST(line AS DECIMAL(10, 4))) % 1 IN (0.25, 0.75) THEN 'QUARTER' ELSE 'OTHER' END AS line_class, printf('%g', odds * 1000003) AS long_number FROM odd_records""",
)
def line_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in their shortest form and by class; and numbers of more than six digits."""
    rows = table(spark, sf_dir, "odd_records")
    return rows.select("odd_id", text.general_number(F.col("line")).alias("number"), text.line_class(F.col("line")).alias("line_class"), text.general_number(F.col("odds") * 1000003).alias("long_number"))


@query(
    "market_lines",
    r"""WITH f AS (SELECT obs_id, concat_ws(' ', market, selection) AS t FROM headerless_rows),
    g AS (SELECT obs_id, replace(regexp_extract(t, '([+-]?\d+[.,]\d+)', 1), ',', '.') AS a, regexp_extract(t, '([+-]\d+)', 1) AS b, regexp_extract(t, '\b(\d+)\b', 1) AS c, replace(regexp_extract(t, '(?i)(?:powyżej|poniżej|over|under)\s+([0-9]+[.,]?[0-9]*)\b', 1), ',', '.') AS p FROM f)
    SELECT obs_id, CASE WHEN a <> '' THEN a WHEN b <> '' THEN b WHEN c <> '' THEN c END AS line, nullif(p, '') AS player_line FROM g""",
)
def market_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and thresholds that titles and selections name, with their signs."""
    said = F.concat_ws(" ", "market", "selection")
    return table(spark, sf_dir, "headerless_rows").select("obs_id", text.line_value(said).alias("line"), text.player_line(said).alias("player_line"))


@query(
    "name_texts",
    r"""WITH w AS (SELECT name_id, full_name, list_filter(string_split_regex(concat(full_name, ' ', full_name, ' 12'), '\s+'), lambda x: x <> '') AS ws FROM native_short_names WHERE full_name IS NOT NULL)
    SELECT name_id, array_to_string(list_filter(ws, lambda x, i: i = 1 OR lower(x) <> lower(ws[i - 1])), ' ') AS said_once, trim(regexp_replace(trim(concat(full_name, ' 12')), '\s+\d+$', '')) AS without_number,
    lower(trim(regexp_replace(regexp_replace(concat(full_name, '&x'), '\s*&\s*', ' & ', 'g'), '\s+', ' ', 'g'))) AS spaced FROM w""",
)
def name_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with repeated words, numbers behind them, and signs."""
    name = F.col("full_name")
    said_once = text.without_repeated_words(F.concat(name, F.lit(" "), name, F.lit(" 12")))
    return table(spark, sf_dir, "native_short_names").where("full_name is not null").select(
        "name_id", said_once.alias("said_once"), text.team_name(F.concat(name, F.lit(" 12"))).alias("without_number"), text.spaced_ampersands(F.concat(name, F.lit("&x"))).alias("spaced")
    )


@query(
    "name_aliases",
    r"""WITH p AS (SELECT name_id, full_name, short_name FROM native_short_names WHERE full_name IS NOT NULL AND short_name IS NOT NULL),
    c AS (SELECT *, regexp_replace(replace(lower(strip_accents(short_name)), 'ß', 'ss'), '[^\p{L}\p{N}]', '', 'g') AS s, regexp_replace(replace(lower(strip_accents(full_name)), 'ß', 'ss'), '[^\p{L}\p{N}]', '', 'g') AS f FROM p)
    SELECT name_id, CASE WHEN s <> '' AND s = f THEN full_name WHEN s <> f AND length(s) >= 6 AND (suffix(f, s) OR suffix(s, f)) THEN full_name ELSE short_name END AS canonical,
    CASE WHEN s <> '' AND s = f OR length(s) >= 6 AND (suffix(f, s) OR suffix(s, f)) THEN 'ALIAS' ELSE '' END AS state FROM c""",
)
def name_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short names that are the full name but for blanks and marks, or its end."""
    rows = table(spark, sf_dir, "native_short_names").where("full_name is not null and short_name is not null")
    found = text.alias_of(F.col("short_name"), F.array("full_name"))
    return rows.select("name_id", found["name"].alias("canonical"), found["state"].alias("state"))


@query(
    "clocks",
    r"""SELECT run_id, regexp_extract(kickoff_at, '(?:^|\D)((?:[01]?\d|2[0-3]):[0-5]\d)(?:\D|$)', 1) AS clock,
    CASE WHEN regexp_full_match(kickoff_at, '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?([Zz]|[+-]\d{2}:\d{2})') AND TRY_CAST(substr(kickoff_at, 1, 16) AS TIMESTAMP) IS NOT NULL THEN
      strftime(CAST(regexp_replace(regexp_replace(kickoff_at, '([Zz]|[+-]\d{2}:\d{2})$', ''), 'T', ' ') AS TIMESTAMP) - to_minutes(CASE WHEN regexp_matches(kickoff_at, '[Zz]$') THEN 0 ELSE
        (CASE WHEN substr(kickoff_at, length(kickoff_at) - 5, 1) = '-' THEN -1 ELSE 1 END) * (TRY_CAST(substr(kickoff_at, length(kickoff_at) - 4, 2) AS INTEGER) * 60 + TRY_CAST(substr(kickoff_at, length(kickoff_at) - 1, 2) AS INTEGER)) END), '%Y-%m-%dT%H:%M:%S.%fZ') END AS utc
    FROM snapshot_manifest WHERE kickoff_at IS NOT NULL""",
)
def clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time of day that a kickoff text shows, and its UTC form where the text is explicit."""
    rows = table(spark, sf_dir, "snapshot_manifest").where("kickoff_at is not null")
    return rows.select("run_id", F.coalesce(text.clock(F.col("kickoff_at")), F.lit("")).alias("clock"), text.canonical_utc(F.col("kickoff_at")).alias("utc"))


@query("event_sides", r"SELECT DISTINCT event_id, CASE WHEN event_id LIKE '%|%' THEN trim(split_part(event_id, '|', 1)) END AS home, CASE WHEN event_id LIKE '%|%' THEN trim(substr(event_id, strpos(event_id, '|') + 1)) END AS away FROM odd_records")
def event_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two sides of a match text."""
    sides = text.teams_of(F.replace(F.col("event_id"), F.lit("|"), F.lit(" - ")))
    return table(spark, sf_dir, "odd_records").select("event_id", F.get(sides, F.lit(0)).alias("home"), F.get(sides, F.lit(1)).alias("away")).distinct()


@query("file_names", r"SELECT DISTINCT tab_name, tab_index, CASE WHEN trim(regexp_replace(concat('/', tab_name), '[^0-9A-Za-z_-]', '_', 'g'), '_') = '' THEN concat('TAB_', tab_index) ELSE trim(regexp_replace(concat('/', tab_name), '[^0-9A-Za-z_-]', '_', 'g'), '_') END AS file_name FROM headerless_rows WHERE tab_name IS NOT NULL")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of tabs as parts of file names."""
    rows = table(spark, sf_dir, "headerless_rows").where("tab_name is not null").select("tab_name", "tab_index").distinct()
    return rows.withColumn("file_name", text.file_name(F.concat(F.lit("/"), "tab_name"), F.col("tab_index")))


@query("packet_assignments", "SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS last_a, p_name AS b, 2::BIGINT AS fields, concat('A=\"old\";', chr(10), 'B=\"', p_name, '\";', chr(10), 'A=\"', p_partkey, '\";', chr(10), 'no field') AS normal FROM part")
def packet_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments in packet texts with byte order marks, mixed line ends and blanks: the last one of a key counts."""
    typed = F.concat(F.lit('﻿A="old";  \r\nB="'), F.col("p_name"), F.lit('";\r'), F.lit('A="'), F.col("p_partkey").cast("string"), F.lit('";\t\nno field'))
    rows = table(spark, sf_dir, "part").select("p_partkey", text.packet_text(typed).alias("normal"))
    fields = rows.withColumn("f", text.assignments(F.col("normal")))
    return fields.select("p_partkey", F.try_element_at("f", F.lit("A")).alias("last_a"), F.try_element_at("f", F.lit("B")).alias("b"), F.size("f").cast("bigint").alias("fields"), "normal")


@query("safe_addresses", "SELECT c_custkey, concat('https://host/p?id=', c_custkey, '&Client-Secret=%3Credacted%3E&q=a+b~%2A&x-api-key=%3Credacted%3E&empty=') AS url, concat('Timeout: lost token=<redacted>; Bearer <redacted> of ', c_name) AS message FROM customer")
def safe_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses and errors without the secrets in them."""
    key = F.col("c_custkey").cast("string")
    url = F.concat(F.lit("https://host/p?id="), key, F.lit("&Client-Secret=s"), key, F.lit("&q=a b~*&x-api-key=k"), key, F.lit("&empty=#part"))
    message = F.concat(F.lit("lost token: "), key, F.lit("; bearer "), key, F.lit(" of "), F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", transport.safe_url(url).alias("url"), transport.safe_message(F.lit("Timeout"), message).alias("message"))


@query("safe_header_maps", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'application/grpc-web+proto; v=1' ELSE 'text/html' END AS content_type, CASE WHEN c_custkey % 2 = 0 THEN concat('req-', c_custkey) ELSE concat('trace-', c_custkey) END AS request_name, c_custkey % 3 = 0 AS framed, 'content-type,traceparent,x-request-id' AS kept FROM customer")
def safe_header_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers without secrets, what names the request, and whether the answer is framed."""
    key = F.col("c_custkey")
    pairs: list[Column] = [F.lit("Content-Type"), F.when(key % 3 == 0, "application/grpc-web+proto; v=1").otherwise("text/html"), F.lit("Authorization"), F.lit("secret"), F.lit("ID_Token"), F.lit("secret")]
    pairs += [F.lit("X-Request-Id"), F.when(key % 2 == 0, F.concat(F.lit("req-"), key.cast("string"))).otherwise(""), F.lit("traceparent"), F.concat(F.lit("trace-"), key.cast("string"))]
    kept = table(spark, sf_dir, "customer").select("c_custkey", F.create_map(*pairs).alias("headers"))
    safe = transport.safe_headers(F.col("headers"))
    return kept.select("c_custkey", safe["content-type"].alias("content_type"), transport.request_name(F.col("headers")).alias("request_name"), transport.is_framed(safe["content-type"]).alias("framed"), F.array_join(F.array_sort(F.map_keys(safe)), ",").alias("kept"))


@query("source_digests", "SELECT n_regionkey, sha256(string_agg(concat(n_name, chr(0), sha256(n_name), chr(10)), '' ORDER BY n_name)) AS digest, COUNT(*) AS sources, bool_and(regexp_full_match(sha256(n_name), '[0-9a-f]{64}')) AS digests_are_valid FROM nation GROUP BY n_regionkey")
def source_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest of the named sources of each group, whatever their order."""
    rows = table(spark, sf_dir, "nation").withColumn("sha", F.sha2("n_name", 256))
    got = rows.groupBy("n_regionkey").agg(F.collect_list(F.struct("n_name", "sha")).alias("s"), F.count("*").alias("sources"), F.bool_and(hashing.is_sha256(F.col("sha"))).alias("digests_are_valid"))
    return got.select("n_regionkey", hashing.sources_sha256(F.col("s.n_name"), F.col("s.sha")).alias("digest"), "sources", "digests_are_valid")


def _hex(number: Column) -> Column:
    return F.lpad(F.hex(number), 2, "0")


@query(
    "framed_messages",
    'SELECT o_orderkey, "at", CASE WHEN "at" = 1 AND o_orderkey % 5 <> 0 THEN 128 ELSE 0 END AS flag, CASE WHEN "at" = 1 AND o_orderkey % 5 <> 0 THEN 0 ELSE 6 END::BIGINT AS size, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS number FROM orders, (VALUES (0), (1)) f ("at")',
)
def framed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of bodies, and the number that a request's only message begins with; of two messages none is read."""
    key = F.col("o_orderkey")
    varint = F.concat(F.lit("08"), *[_hex(F.shiftright(key, 7 * i).bitwiseAND(127) + 128) for i in range(4)], _hex(F.shiftright(key, 28).bitwiseAND(127)))
    message = F.concat(F.lit("0000000006"), varint)
    body = F.unhex(F.concat(message, F.when(key % 5 == 0, message).otherwise("8000000000")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", body.alias("body"))
    numbers = rows.select("o_orderkey", transport.request_numbers(F.col("body")).alias("number"))
    frames = transport.message_frames(rows, "o_orderkey", "body").select("o_orderkey", "at", "flag", F.length("message").cast("bigint").alias("size"))
    return frames.join(numbers, "o_orderkey")


@query(
    "capture_decisions",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'REJECTED_CONTENT_TYPE' WHEN user_id % 7 = 0 THEN 'REJECTED_EVENT_UNKNOWN' WHEN user_id % 5 = 0 THEN 'REJECTED_OTHER_EVENT' WHEN value IS NULL OR value < 5 THEN 'REJECTED_PENDING' WHEN value < 10 THEN 'REJECTED_BODY_LOST'
    WHEN event_id % 11 = 0 THEN 'REJECTED_BROKEN_FRAMES' ELSE 'ACCEPTED' END AS state FROM events""",
)
def capture_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason against each captured answer."""
    user, value = F.col("user_id"), F.col("value")
    declared = F.when(F.col("event_type") == "error", "text/html").otherwise("Application/grpc-web; q=1")
    own = F.when(user % 7 != 0, F.when(user % 5 == 0, "other").otherwise("this"))
    state = transport.captured_state(declared, F.col("event_id") % 11 != 0, own, F.lit("this"), value >= 5, value < 10, F.lit(1))
    return table(spark, sf_dir, "events").select("event_id", state.alias("state"))
