"""Run manifests: content fingerprints of observations, one digest for each run, and proof that nothing was altered.

Fingerprints are per row; a run's digest is over its sorted fingerprints, so that the order of rows and files
has no part in it. A run is verified by building its manifest again and comparing, null-safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.hashing import struct_sha256


def fingerprinted(rows: DataFrame, content: list[str], place: list[str]) -> DataFrame:
    """Add ``content_hash`` (equal contents, wherever they stand) and ``occurrence_hash`` (content and place). Nulls count."""
    return rows.withColumns({"content_hash": struct_sha256(*content), "occurrence_hash": struct_sha256(*content, *place)})


def run_manifests(rows: DataFrame, run: str, at: str) -> DataFrame:
    """(run, stored, occurrences, contents, repeated_contents, cutoff, digest) of rows with fingerprints.

    Exact repeats of an occurrence count as stored and else once. The digest is over the run's distinct occurrence
    hashes in order; they are 64 letters each, and the only thing gathered for a run. Of a hot run they are
    first gathered by the hash's leading letters: digests of 256 parts, then one digest of those.
    """
    single = rows.groupBy(run, "occurrence_hash").agg(F.first("content_hash").alias("content_hash"), F.max(at).alias("at"), F.count("*").alias("stored"))
    parts = single.groupBy(run, F.substring("occurrence_hash", 1, 2).alias("part")).agg(
        F.count("*").alias("n"), F.sum("stored").alias("stored"), F.max("at").alias("cutoff"), F.sha2(F.array_join(F.array_sort(F.collect_list("occurrence_hash")), "\n"), 256).alias("digest")
    )
    whole = parts.groupBy(run).agg(
        F.sum("stored").alias("stored"), F.sum("n").alias("occurrences"), F.max("cutoff").alias("cutoff"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("part", F.lit(":"), "digest"))), "\n"), 256).alias("digest")
    )
    contents = single.groupBy(run, "content_hash").agg(F.count("*").alias("n")).groupBy(run).agg(F.count("*").alias("contents"), F.count_if(F.col("n") > 1).alias("repeated_contents"))
    return whole.join(contents, run)


def altered(known: DataFrame, rebuilt: DataFrame, run: str) -> DataFrame:
    """(run, state) of the runs whose manifests differ: ``missing``, ``unknown`` or ``altered``. Columns of both are compared."""
    columns = [c for c in known.columns if c in rebuilt.columns and c != run]
    a = known.select(run, F.struct(*columns).alias("a"))
    b = rebuilt.select(run, F.struct(*columns).alias("b"))
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unknown").when(~F.col("a").eqNullSafe(F.col("b")), "altered")
    return a.join(b, run, "full_outer").select(run, state.alias("state")).where("state is not null")


def contained(left: DataFrame, right: DataFrame, group: str, other: str, member: str) -> DataFrame:
    """(group, other): groups of ``left`` of which every member is in the group ``other`` of ``right``.

    By counting the members that they share: no group is compared with one that shares none. Null members are none.
    """
    a = left.where(F.col(member).isNotNull()).select(group, member).distinct()
    b = right.where(F.col(member).isNotNull()).select(other, member).distinct()
    sizes = a.groupBy(group).agg(F.count("*").alias("size"))
    shared = a.join(b, member).groupBy(group, other).agg(F.count("*").alias("shared"))
    return shared.join(sizes, group).where("shared = size").select(group, other)


def exactly_one(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of the keys that come once, keys that come several times)."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    return rows.join(counts.where("n = 1").select(key), key, "left_semi"), counts.where("n > 1")


def artifact_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of the files under a path or glob."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def with_nested_value(rows: DataFrame, array: str, field: str, value: str) -> DataFrame:
    """Every struct of an array with one field set to a column's value."""
    return rows.withColumn(array, F.transform(array, lambda x: x.withField(field, F.col(value))))
