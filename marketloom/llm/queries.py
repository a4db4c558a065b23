"""Queries of this subpackage over the whole tables of the test data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.canonical import map_to_reference
from marketloom.llm.duplicates import copy_counts, duplicate_groups
from marketloom.llm.leakage import leaked_passages, reparameterised_passages
from marketloom.llm.mojibake import restored_texts
from marketloom.llm.names import link_names, linked_pairs
from marketloom.llm.tokens import encode_corpus
from marketloom.operators.packed import BLANKS, HEADING_PATH
from marketloom.session import table


def _named_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = table(spark, sf_dir, "native_short_names").select(F.col("name_id").alias("record"), F.col("run_id").alias("run"), F.array("full_name", "short_name").alias("names"), F.lit(False).alias("scorer"))
    scorers = table(spark, sf_dir, "headerless_rows").where("tab_name = 'Strzelcy' and selection is not null")
    return typed.unionByName(scorers.select(F.col("obs_id").alias("record"), F.col("run_id").alias("run"), F.array("selection").alias("names"), F.lit(True).alias("scorer")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of records that name the same player or club."""
    return linked_pairs(link_names(_named_records(spark, sf_dir)))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record with the class of its name and the number of records that it is linked to."""
    classes = link_names(_named_records(spark, sf_dir))
    sizes = classes.groupBy("name_class").agg((F.count("*") - 1).alias("links"))
    return classes.join(sizes, "name_class").select("record", "name_class", "links")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each typed market title and family with the entry of the reference list that it means, or 0."""
    entries = table(spark, sf_dir, "canon_reference")
    verbatim = F.broadcast(entries.select("kind", F.col("canonical_value").alias("text")).distinct())  # part of the fixed reference list
    parts = (("headerless_rows", "obs_id", "market", "MARKET"), ("odd_records", "odd_id", "family", "FAMILY"))
    typed = None
    for name, key, field, kind in parts:
        part = table(spark, sf_dir, name).select(F.lit(field).alias("field_name"), F.col(key).alias("record_id"), F.lit(kind).alias("kind"), F.col(field).alias("text"))
        typed = part if typed is None else typed.unionByName(part)
    typed = typed.where(F.length(F.btrim("text", F.lit(BLANKS))) > 0).join(verbatim, ["kind", "text"], "left_anti")
    labels = entries.select("kind", "ref_id", F.explode(F.array("canonical_value", "label_pl", "label_en")).alias("label"))
    return typed.join(map_to_reference(typed, labels), ["kind", "text"]).select("field_name", "record_id", "ref_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each surplus copy of a quote with the least obs_id of its group."""
    pairs = duplicate_groups(table(spark, sf_dir, "headerless_rows"), "obs_id", "run_id", ["market", "selection"], ["odds"], {"heading_path": HEADING_PATH})
    return pairs.select(F.col("keep_id").alias("keep_obs_id"), F.col("copy_id").alias("obs_id"))


def p4_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kept quote with the number of its copies, itself among them."""
    return copy_counts(p4_found(spark, sf_dir).select(F.col("keep_obs_id").alias("keep_id"), F.col("obs_id").alias("copy_id"))).select(F.col("keep_id").alias("keep_obs_id"), "copies")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def _leaks(spark: SparkSession, sf_dir: str, find) -> DataFrame:
    items = table(spark, sf_dir, "eval_items").select("item_id", F.col("text").alias("item_text"))
    return find(table(spark, sf_dir, "documents"), "doc_id", "text", items, "item_id", "item_text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold twelve or more consecutive words of an item."""
    return _leaks(spark, sf_dir, leaked_passages).where("verbatim").select("doc_id", "item_id")


def p9_reparameterised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item's passage only with other numbers, names or units."""
    return _leaks(spark, sf_dir, reparameterised_passages).where("consistent and not verbatim").select("doc_id", "item_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled documents with the MD5 of the restored text, empty where characters are lost for good."""
    found = restored_texts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", F.coalesce(F.md5("restored"), F.lit("")).alias("restored_md5")).distinct()


QUERIES = {"p1_found": p1_found, "p1_classes": p1_classes, "p3_found": p3_found, "p4_found": p4_found, "p4_copies": p4_copies, "p8_ids": p8_ids, "p9_found": p9_found, "p9_reparameterised": p9_reparameterised, "p10_found": p10_found}
