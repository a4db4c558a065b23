"""JSON lines, packet texts and append-only tables: scans that reject what is broken, writes that never replace."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from marketloom.functions.hashing import struct_sha256
from marketloom.functions.text import assignments, packet_text
from marketloom.session import materialize

_BROKEN = "_broken"


def read_json_lines(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, broken lines) of JSON lines. Blank lines are neither; a line that is no object is broken."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", StructType([f for f in schema.fields if f.name != _BROKEN] + [StructField(_BROKEN, StringType())]), {"columnNameOfCorruptRecord": _BROKEN}).alias("j"))
    bad = F.col("j").isNull() | F.col(f"j.{_BROKEN}").isNotNull() | ~F.trim("value").startswith("{")
    good = parsed.where(~bad).select("j.*").drop(_BROKEN)
    return good, parsed.where(bad).select(F.col("value").alias("line"))


def read_ledger(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of a ledger of JSON lines; none where it does not exist yet. A broken line is an error."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    rows, broken = read_json_lines(spark, path, schema)
    first = broken.first()
    if first is not None:
        raise ValueError(f"a line of the ledger is no object: {first['line'][:200]}")
    return rows


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or anything that a glob names, exists in its file system."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def _digest_of(lines: DataFrame) -> tuple[int, str]:
    """Number of lines and a digest of them in which their order has no part, in one partial aggregate."""
    parts = lines.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(F.xxhash64(F.lit(i), "value").cast("decimal(20,0)")), F.lit(0).cast("decimal(38,0)")).alias(f"d{i}") for i in (1, 2)]).first()
    return parts["n"], f"{parts['d1']}:{parts['d2']}"


def write_json_lines(rows: DataFrame, path: str) -> dict[str, int | str]:
    """Write once (an existing target is an error), read again and compare: rows, digest and state (PASS or FAIL).

    What is written is counted and digested on its way to the files, so the rows are computed once.
    """
    lines = rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))
    seen = Observation()
    hashes = [F.coalesce(F.sum(F.xxhash64(F.lit(i), "value").cast("decimal(20,0)")), F.lit(0).cast("decimal(38,0)")).alias(f"d{i}") for i in (1, 2)]
    lines.observe(seen, F.count("*").alias("n"), *hashes).write.mode("errorifexists").text(path)
    wanted = (seen.get["n"], f"{seen.get['d1']}:{seen.get['d2']}")
    written = _digest_of(rows.sparkSession.read.text(path))
    return {"rows": written[0], "digest": written[1], "state": "PASS" if written == wanted else "FAIL"}


def append_new(rows: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the table does not have, each key once; return how many they were.

    Of rows with the same key the least by all columns is taken, so that a second run adds nothing.
    """
    spark = rows.sparkSession
    columns = sorted(rows.columns)
    single = rows.groupBy(key).agg(F.min(F.struct(*columns)).alias("row")).select("row.*")
    if exists(spark, path):
        single = single.join(spark.read.parquet(path).select(key), key, "left_anti")
    fresh = materialize(single.select(*columns))  # read before the table changes
    count = fresh.count()
    if count:
        fresh.write.mode("append").parquet(path)
    return count


def append_artifacts(rows: DataFrame, path: str, prefix: str) -> int:
    """Append rows under the digest of their content (``artifact_id``); return how many were new.

    Nothing is ever replaced: a row whose digest the table has is the same row and is not written again.
    """
    return append_new(rows.withColumn("artifact_id", F.concat(F.lit(f"{prefix}:"), struct_sha256(*rows.columns))), path, "artifact_id")


def altered_artifacts(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """The rows of a table of artifacts whose content does not have the digest under which it is stored."""
    rows = spark.read.parquet(path)
    content = [c for c in rows.columns if c != "artifact_id"]
    return rows.where(F.col("artifact_id") != F.concat(F.lit(f"{prefix}:"), struct_sha256(*content)))


def read_packets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(headers, blocks) of packet texts, one file each: (packet, fields) and (packet, position, name, fields).

    Header lines stand before the first block; a block is ``NAME{`` … ``}``. Positions count all blocks from 1. A
    field given twice has its last value. A line that is no assignment is skipped.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("packet"), packet_text(F.col("value")).alias("text"))
    pattern = r"(?ms)^([A-Z_]+)\s*\{(.*?)^\s*\}"
    head = F.regexp_replace("text", r"(?ms)^[A-Z_]+\s*\{.*\z", "")
    # A header line is "KEY: value" or KEY="value";
    headers = files.select("packet", assignments(F.regexp_replace(head, r'(?m)^\s*([A-Z_]+)\s*[:=]\s*"?(.*?)"?;?\s*$', '$1="$2";')).alias("fields"))
    names, bodies = (F.regexp_extract_all("text", F.lit(pattern), i) for i in (1, 2))
    zipped = F.arrays_zip(names.alias("name"), bodies.alias("body"))
    blocks = files.select("packet", F.posexplode(zipped).alias("position", "b"))
    return headers, blocks.select("packet", (F.col("position") + 1).alias("position"), "b.name", assignments(F.col("b.body")).alias("fields"))


def packet_blocks(rows: DataFrame, name: str, fields: dict[str, str]) -> DataFrame:
    """Each row as the text of one block; null is empty, and line feeds and quotes within values are escaped."""
    escape = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit("'"))
    parts = [F.concat(F.lit(f'  {field}="'), escape(column), F.lit('";\n')) for field, column in fields.items()]
    return rows.select(F.concat(F.lit(f"{name}{{\n"), *parts, F.lit("}")).alias("block"))
