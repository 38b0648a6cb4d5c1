"""Finding memories by the identifiers a query names.

Direct references, subject aliases and values derived from old entity strings
form one index keyed by (place, scheme, value).  A query side of at most three
places per reference meets it in a single equi-join, so identifiers that are
common across owners never meet each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from palimpsest.functions import keys, payload as pl, scope as sc, text as tx
from palimpsest.operators.ordered import top_per
from palimpsest.operators.skew import salted_join
from palimpsest.session import cut_lineage

STAGE_DIRECT, STAGE_ALIAS, STAGE_LEGACY = 1, 2, 3


def reference_rows(memories: DataFrame) -> DataFrame:
    """Explicit identifiers of events, the most confident of each (scheme, value)."""
    events = memories.where(F.col("kind") == "event")
    refs = events.select("memory_id", F.explode(pl.best_references(F.col("payload.event.identifier_references"))).alias("r"))
    return refs.select("memory_id", "r.scheme", "r.normalized_value", F.col("r.value").alias("raw_value"),
                       "r.mention", "r.confidence")


def replace_references(references: DataFrame, changed: DataFrame) -> DataFrame:
    """Reference table after changed memories replace theirs."""
    kept = references.join(changed.select("memory_id"), "memory_id", "left_anti")
    return kept.unionByName(reference_rows(changed).select(*references.columns))


def eligible(memories: DataFrame, now) -> DataFrame:
    """Memories that may be shown at ``now``, with the place they are seen from."""
    placed = memories.where(sc.is_current(now)).withColumn("place", sc.record_key())
    return placed.where(F.col("place").isNotNull())


def direct_index(references: DataFrame, shown: DataFrame) -> DataFrame:
    rows = references.select("memory_id", "scheme", "normalized_value")
    return shown.select("memory_id", "place", "updated_at").join(rows, "memory_id").withColumn("stage", F.lit(STAGE_DIRECT))


def alias_index(subject_identifiers: DataFrame, shown: DataFrame) -> DataFrame:
    rows = subject_identifiers.select("subject_id", "scheme", "normalized_value")
    with_subject = shown.where(F.col("subject_id").isNotNull()).select("memory_id", "subject_id", "place", "updated_at")
    return with_subject.join(rows, "subject_id").drop("subject_id").withColumn("stage", F.lit(STAGE_ALIAS))


def legacy_index(references: DataFrame, shown: DataFrame) -> DataFrame:
    """Events without an explicit identifier, by the values their entity strings hold."""
    bare = shown.where(F.col("kind") == "event").join(references.select("memory_id").distinct(), "memory_id", "left_anti")
    return bare.select(
        "memory_id", "place", "updated_at", F.lit("external_reference").alias("scheme"),
        F.explode(tx.stable_identifiers(F.col("payload.event.entities"))).alias("normalized_value"),
        F.lit(STAGE_LEGACY).alias("stage"))


def query_references(queries: DataFrame) -> DataFrame:
    """(query, place, scheme, value) for the identifiers each query's text mentions."""
    found = queries.withColumn("r", F.explode(tx.identifier_mentions(F.col("text"))))
    return found.select("query_id", F.explode(sc.chat_keys()).alias("place"), "r.scheme", "r.normalized_value")


def matches(asked: DataFrame, index: DataFrame) -> DataFrame:
    """(query, memory, stage) with the number of distinct values that matched.

    An identifier that a large share of the memories holds is split over several tasks.
    """
    # the sketch of the identifiers and the join both read the index, which is made once
    hit = salted_join(asked.distinct(), cut_lineage(index), ["place", "scheme", "normalized_value"], "memory_id")
    return hit.groupBy("query_id", "memory_id", "stage").agg(
        F.count_distinct("normalized_value").alias("match_count"), F.max("updated_at").alias("updated_at"))


def candidates(asked: DataFrame, memories: DataFrame, references: DataFrame, subject_identifiers: DataFrame, now,
               limit: int) -> DataFrame:
    """Best ``limit`` memories per query: direct matches first, then aliases, then derived values."""
    shown = eligible(memories, now)
    columns = ["memory_id", "place", "updated_at", "scheme", "normalized_value", "stage"]
    index = direct_index(references, shown).select(*columns)
    index = index.unionByName(alias_index(subject_identifiers, shown).select(*columns))
    index = index.unionByName(legacy_index(references, shown).select(*columns))
    found = matches(asked, index).withColumn(
        "strength", F.when(F.col("stage") == STAGE_DIRECT, F.col("match_count")).otherwise(F.lit(0)))
    order = [F.col("stage"), F.col("strength").desc(), F.col("updated_at").desc(), F.col("memory_id")]
    first = top_per(found, ["query_id", "memory_id"], order)
    return top_per(first, ["query_id"], order, limit, "rank").drop("strength")


def comparable_pairs(events: DataFrame) -> DataFrame:
    """For each event the earliest earlier event of its domain that shares an identifier.

    Only that one decides about conflicts, so pairs within a group are never
    enumerated: the earliest holder of each identifier is found by aggregation.
    ``events`` needs ``memory_id``, ``created_at`` and the scope columns.
    """
    marked = events.select(
        "memory_id", keys.event_domain({n: F.col(n) for n in keys.SCOPE_COLUMNS}).alias("domain"),
        F.struct("created_at", "memory_id").alias("position"),
        F.explode(keys.event_identifiers(F.col("payload.event"))).alias("identifier"))
    holders = marked.groupBy("domain", "identifier").agg(F.min("position").alias("holder"))
    joined = marked.join(holders, ["domain", "identifier"]).where(F.col("holder") < F.col("position"))
    first = joined.groupBy("memory_id").agg(F.min("holder").alias("holder"))
    return first.select("memory_id", F.col("holder.memory_id").alias("existing_memory_id"))
