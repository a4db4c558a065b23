"""Queries of the general data-quality operators over the whole tables of the test data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.timestamps import utc_micros
from marketloom.operators.nested import nested_nodes, ordinal
from marketloom.operators.packed import DOM_PATH, HEADING_PATH, RECORD_IDS, split_packed
from marketloom.operators.snapshots import snapshot_changes
from marketloom.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each observed_at and kickoff_at as one UTC instant in microseconds."""
    texts = None
    for name, field, key in (("snapshot_observations", "observed_at", "observation_id"), ("snapshot_manifest", "kickoff_at", "run_id")):
        part = table(spark, sf_dir, name).select(F.lit(field).alias("field_name"), F.col(key).alias("record_key"), F.col(field).alias("written"), "feed_tz")
        texts = part if texts is None else texts.unionByName(part)
    # Exploding the compacted array, and not a filter, drops the nulls: a filter would compute them twice.
    instant = F.array_compact(F.array(utc_micros(F.col("written"), F.col("feed_tz"))))
    return texts.select("field_name", "record_key", F.explode(instant).alias("utc_us")).distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value of the three packed columns with its position."""
    observed = table(spark, sf_dir, "headerless_rows")
    packed = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("text")) for c in ("heading_path", "dom_path")])
    rows = observed.select(F.col("obs_id").alias("record_id"), F.explode(packed).alias("p")).select("p.kind", "record_id", "p.text")
    odds = table(spark, sf_dir, "odd_records").select(F.lit("source_raw_record_ids").alias("kind"), F.col("odd_id").alias("record_id"), F.col("source_raw_record_ids").alias("text"))
    how = {"heading_path": HEADING_PATH, "dom_path": DOM_PATH, "source_raw_record_ids": RECORD_IDS}
    return split_packed(rows.unionByName(odds), how).withColumnRenamed("kind", "field_name")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records added, removed or changed in odds between consecutive snapshots."""
    return snapshot_changes(table(spark, sf_dir, "odd_records"), "snapshot_no", ["event_id", "market_instance", "selection"], "odds")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The children of every packet, with the position of their parent."""
    own, none = ordinal(F.col("dewey")), F.lit(-1)
    named = F.when(F.col("kind") == "object", F.col("name")).otherwise(F.col("value"))
    tables: list[tuple[str, str, str, Column, Column, Column]] = [
        ("fair_market", "fair_markets", "[]", none, own, F.col("name")),
        ("fair_selection", "fair_markets", "[].selections{}", ordinal(F.col("dewey"), 2), none, F.col("name")),
        ("fair_selection", "fair_markets", "[].selections[]", ordinal(F.col("dewey"), 2), none, named),
        ("graph_node", "market_graph", "nodes[]", none, own, named),
        ("relation", "market_graph", "relations[]", none, own, F.col("name")),
        ("relation_node", "market_graph", "relations[].nodes[]", ordinal(F.col("dewey"), 2), own, named),
        ("quarantined_row", "quarantined_rows", "[]", none, own, F.col("name")),
        ("quarantine_reason", "quarantined_rows", "[].reasons[]", ordinal(F.col("dewey"), 2), own, named),
        ("quarantine_reason", "quarantined_rows", "[].reasons", ordinal(F.col("dewey"), 1), F.lit(0), F.when(F.col("kind") == "string", F.col("value"))),
        ("original_field", "quarantined_rows", "[].original_fields{}", ordinal(F.col("dewey"), 2), none, F.col("name")),
    ]
    wanted: dict[str, set[str]] = {}
    for _, field, path, *_ in tables:
        wanted.setdefault(field, set()).add(path)
    nodes = nested_nodes(
        table(spark, sf_dir, "context_packets"),
        "packet_id",
        ["fair_markets", "market_graph", "quarantined_rows"],
        {"fair_markets": {"[].selections"}, "quarantined_rows": {"[].original_fields"}},
        {"fair_markets": {"[]": "key", "[].selections[]": "name"}, "market_graph": {"nodes[]": "id", "relations[]": "type", "relations[].nodes[]": "id"}, "quarantined_rows": {"[]": "source_record_id", "[].reasons[]": "reason"}},
        wanted,
    )
    child = F.lit(None).cast("struct<child_kind: string, parent_pos: int, pos: int, item_key: string>")
    for kind, field, path, parent, pos, key in reversed(tables):
        row = F.struct(F.lit(kind).alias("child_kind"), parent.alias("parent_pos"), pos.alias("pos"), key.alias("item_key"))
        child = F.when((F.col("field") == field) & (F.col("schema_path") == path), row).otherwise(child)
    lone = (F.col("schema_path") != "[].reasons") | (F.col("kind") == "string")
    found = nodes.where(lone).select("packet_id", child.alias("c")).where("c is not null")
    return found.select("packet_id", "c.*").distinct()


QUERIES = {"p2_found": p2_found, "p5_found": p5_found, "p6_found": p6_found, "p7_found": p7_found}
#: DuckDB SQL of the queries that SQL can express; time zone rules cannot be counted on there.
ORACLES: dict[str, str] = {
    "p5_found": r"""
WITH t AS (
  SELECT 'heading_path' AS field_name, obs_id AS record_id, regexp_extract_all(heading_path, '((?:"(?:[^"]|"")*"|[^">»→|;])+)', 1) AS parts FROM headerless_rows
  UNION ALL SELECT 'dom_path', obs_id, regexp_extract_all(dom_path, '((?:"(?:[^"]|"")*"|[^">|/])+)', 1) FROM headerless_rows
  UNION ALL SELECT 'source_raw_record_ids', odd_id, regexp_extract_all(regexp_replace(source_raw_record_ids, '^\s*\[(.*)\]\s*$', '\1'), '((?:"(?:[^"]|"")*"|[^",;|\s])+)', 1) FROM odd_records),
e AS (SELECT field_name, record_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM t),
u AS (SELECT field_name, record_id, i, CASE WHEN regexp_full_match(trim(part), '"(?:[^"]|"")*"') THEN trim(replace(substr(trim(part), 2, length(trim(part)) - 2), '""', '"')) ELSE trim(part) END AS piece FROM e)
SELECT DISTINCT field_name, record_id, CAST(ROW_NUMBER() OVER (PARTITION BY field_name, record_id ORDER BY i) AS INTEGER) AS pos, piece FROM u WHERE piece <> ''""",
    "p6_found": """
WITH s AS (SELECT DISTINCT snapshot_no FROM odd_records WHERE snapshot_no IS NOT NULL),
n AS (SELECT snapshot_no AS no, LAG(snapshot_no) OVER (ORDER BY snapshot_no) AS prev FROM s),
r AS (SELECT snapshot_no, event_id, market_instance, selection, MIN(odds) AS odds FROM odd_records GROUP BY ALL),
c AS (SELECT n.prev, n.no, r.* FROM r JOIN n ON r.snapshot_no = n.no WHERE n.prev IS NOT NULL),
p AS (SELECT n.prev, n.no, r.* FROM r JOIN n ON r.snapshot_no = n.prev)
SELECT coalesce(c.prev, p.prev) AS prev_snapshot_no, coalesce(c.no, p.no) AS snapshot_no, coalesce(c.event_id, p.event_id) AS event_id,
  coalesce(c.market_instance, p.market_instance) AS market_instance, coalesce(c.selection, p.selection) AS selection,
  CASE WHEN p.no IS NULL THEN 'added' WHEN c.no IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM c FULL OUTER JOIN p ON c.no = p.no AND c.event_id = p.event_id AND c.market_instance = p.market_instance AND c.selection = p.selection
WHERE p.no IS NULL OR c.no IS NULL OR c.odds IS DISTINCT FROM p.odds""",
    "p7_found": r"""
WITH raw AS (SELECT DISTINCT packet_id, f, t FROM (SELECT packet_id, 'fm' AS f, fair_markets AS t FROM context_packets UNION ALL SELECT packet_id, 'mg', market_graph FROM context_packets UNION ALL SELECT packet_id, 'qr', quarantined_rows FROM context_packets)),
once AS (SELECT packet_id, f, CASE WHEN json_valid(t) THEN CASE WHEN json_type(t) = 'VARCHAR' THEN json_extract_string(t, '$') ELSE t END END AS t FROM raw),
j AS (SELECT packet_id, f, CAST(t AS JSON) AS t FROM once WHERE json_valid(t)),
arr AS (SELECT packet_id, f, json_extract(t, '$[*]') AS items FROM j WHERE f <> 'mg'),
it AS (SELECT packet_id, f, unnest(items) AS x, generate_subscripts(items, 1) - 1 AS pos FROM arr),
nodes AS (SELECT packet_id, json_extract(t, '$.nodes[*]') AS items FROM j WHERE f = 'mg'),
rels AS (SELECT packet_id, json_extract(t, '$.relations[*]') AS items FROM j WHERE f = 'mg'),
rel AS (SELECT packet_id, unnest(items) AS x, generate_subscripts(items, 1) - 1 AS pos FROM rels),
reason AS (SELECT packet_id, pos, CASE WHEN json_type(x, '$.reasons') = 'VARCHAR' THEN [json_extract_string(x, '$.reasons')] ELSE json_extract_string(x, '$.reasons[*]') END AS items FROM it WHERE f = 'qr'),
o AS (
SELECT packet_id, 'fair_market' AS child_kind, -1 AS parent_pos, pos, json_extract_string(x, '$.key') AS item_key FROM it WHERE f = 'fm'
UNION ALL SELECT packet_id, 'fair_selection', pos, -1, unnest(json_keys(x, '$.selections')) FROM it WHERE f = 'fm' AND json_type(x, '$.selections') = 'OBJECT'
UNION ALL SELECT packet_id, 'fair_selection', pos, -1, unnest(json_extract_string(x, '$.selections[*].name')) FROM it WHERE f = 'fm' AND json_type(x, '$.selections') = 'ARRAY'
UNION ALL SELECT packet_id, 'graph_node', -1, generate_subscripts(items, 1) - 1, json_extract_string(unnest(items), '$.id') FROM nodes
UNION ALL SELECT packet_id, 'relation', -1, pos, json_extract_string(x, '$.type') FROM rel
UNION ALL SELECT packet_id, 'relation_node', pos, generate_subscripts(json_extract(x, '$.nodes[*]'), 1) - 1, unnest(json_extract_string(x, '$.nodes[*]')) FROM rel
UNION ALL SELECT packet_id, 'quarantined_row', -1, pos, json_extract_string(x, '$.source_record_id') FROM it WHERE f = 'qr'
UNION ALL SELECT packet_id, 'quarantine_reason', pos, generate_subscripts(items, 1) - 1, unnest(items) FROM reason
UNION ALL SELECT packet_id, 'original_field', pos, -1, unnest(json_keys(x, '$.original_fields')) FROM it WHERE f = 'qr' AND json_type(x, '$.original_fields') = 'OBJECT')
SELECT DISTINCT packet_id, child_kind, CAST(parent_pos AS INTEGER) AS parent_pos, CAST(pos AS INTEGER) AS pos, item_key FROM o""",
}
