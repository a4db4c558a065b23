"""Append-only ledgers: what may be appended, revisions that name the one before, and timelines that join exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.hashing import struct_sha256
from marketloom.operators.keyed import chain_ends


def append_faults(existing: DataFrame, new: DataFrame, targets: DataFrame, row_id: str, target: str, supersedes: str) -> DataFrame:
    """(row_id, fault) of each new annotation: the first reason why it may not be appended, empty if it may.

    UNKNOWN_TARGET: its target is not in ``targets``; EXISTS: its id is in the ledger; BAD_SUPERSESSION: what it supersedes is not
    in the ledger or has another target; ACTIVE_DECISION: it supersedes nothing although its target has an active row;
    CYCLE: the ledger's rows of its target supersede one another in a circle. Each new row is judged by itself.
    """
    old = existing.select(F.col(row_id).alias("__o_id"), F.col(target).alias("__o_target"), F.col(supersedes).alias("__o_up"))
    replaced = old.where("__o_up is not null").select(F.col("__o_up").alias("__o_id")).distinct()
    active = old.join(replaced, "__o_id", "left_anti").select("__o_target").distinct().withColumn("__active", F.lit(True))
    cyclic = chain_ends(old, "__o_id", "__o_up").where("cyclic").select(F.col("row").alias("__o_id")).join(old, "__o_id").select("__o_target").distinct().withColumn("__cyclic", F.lit(True))
    prior = old.select(F.col("__o_id").alias("__p_id"), F.col("__o_target").alias("__p_target")).distinct()
    known = targets.select(F.col(target).alias("__t_target")).distinct().withColumn("__known", F.lit(True))
    ids = old.select(F.col("__o_id").alias("__e_id")).distinct().withColumn("__exists", F.lit(True))
    rows = new.select(row_id, target, supersedes)
    met = rows.join(known, rows[target] == known["__t_target"], "left").join(ids, rows[row_id] == ids["__e_id"], "left").join(prior, rows[supersedes] == prior["__p_id"], "left")
    met = met.join(active, met[target] == active["__o_target"], "left").drop("__o_target").join(cyclic, rows[target] == cyclic["__o_target"], "left")
    fault = (
        F.when(F.col("__known").isNull(), "UNKNOWN_TARGET").when(F.col("__exists").isNotNull(), "EXISTS")
        .when(F.col(supersedes).isNotNull() & ~F.col("__p_target").eqNullSafe(F.col(target)), "BAD_SUPERSESSION")
        .when(F.col(supersedes).isNull() & F.col("__active").isNotNull(), "ACTIVE_DECISION").when(F.col("__cyclic").isNotNull(), "CYCLE").otherwise("")
    )
    return met.select(row_id, fault.alias("fault"))


def revision_faults(rows: DataFrame, key: str, revision: str, digest: str, supersedes: str) -> DataFrame:
    """(key, revision, fault) of each revision: the first names none before it, every other one the digest of the one before.

    INVALID: the number is not above zero; REPEATED: the key has the number several times; INITIAL_SUPERSEDES; PRIOR_UNNAMED;
    PRIOR_MISSING: there is no revision before it; PRIOR_MISMATCH. Revisions meet the one before by number, so a key with
    very many is spread over as many tasks as it needs.
    """
    one = rows.groupBy(key, revision).agg(F.count("*").alias("__n"), F.min(digest).alias("__d"), F.min(supersedes).alias("__s"))
    before = one.select(F.col(key), (F.col(revision) + 1).alias(revision), F.col("__d").alias("__prior"), F.lit(True).alias("__there"))
    met = one.join(before, [key, revision], "left")
    r = F.col(revision)
    fault = (
        F.when(r.isNull() | (r < 1), "INVALID").when(F.col("__n") > 1, "REPEATED").when((r == 1) & F.col("__s").isNotNull(), "INITIAL_SUPERSEDES").when(r == 1, "")
        .when(F.col("__s").isNull(), "PRIOR_UNNAMED").when(F.col("__there").isNull(), "PRIOR_MISSING").when(F.col("__s") != F.col("__prior"), "PRIOR_MISMATCH").otherwise("")
    )
    return met.select(key, revision, fault.alias("fault"))


def timeline_faults(outcomes: DataFrame, events: DataFrame, key: str, sequence: str) -> DataFrame:
    """(key, events, fault) of each outcome joined exactly to its events: FOREIGN_EVENTS (events of no outcome, by their own
    key), REPEATED_OUTCOME, REPEATED_SEQUENCE, SEQUENCE_GAP, or empty. An outcome without events is whole."""
    per = events.groupBy(key).agg(F.count("*").alias("__events"), F.count_distinct(sequence).alias("__d"), F.min(sequence).alias("__lo"), F.max(sequence).alias("__hi"))
    known = outcomes.groupBy(key).agg(F.count("*").alias("__outcomes"))
    met = known.join(per, key, "full_outer")
    n = F.col("__events")
    fault = (
        F.when(F.col("__outcomes").isNull(), "FOREIGN_EVENTS").when(F.col("__outcomes") > 1, "REPEATED_OUTCOME").when(n.isNull(), "").when(F.col("__d") < n, "REPEATED_SEQUENCE")
        .when((F.col("__lo") != 1) | (F.col("__hi") != n), "SEQUENCE_GAP").otherwise("")
    )
    return met.select(key, F.coalesce(n, F.lit(0)).alias("events"), fault.alias("fault"))


def content_fault(content: list[str], digest: Column) -> Column:
    """ALTERED where the digest stored with a row is not that of its content, MISSING without one, else empty."""
    return F.when(digest.isNull(), "MISSING").when(digest != struct_sha256(*content), "ALTERED").otherwise("")


def observation_fault(row_id: Column, raw_id: Column, sequence: Column, eligible: Column, source: Column, times: Column) -> Column:
    """The first reason why an observation cannot enter a manifest, empty if it can. times: how often its raw id comes in its run."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return (
        F.when(blank(row_id), "ID_MISSING").when(blank(raw_id), "RAW_ID_MISSING").when(sequence.isNull() | (sequence < 1), "SEQUENCE_INVALID").when(times > 1, "RAW_ID_REPEATED")
        .when(~F.coalesce(eligible, F.lit(False)), "INELIGIBLE").when(blank(source), "SOURCE_MISSING").otherwise("")
    )
