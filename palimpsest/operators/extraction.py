"""From supplied extraction candidates to records and lifecycle writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from palimpsest import constants as C
from palimpsest.functions import keys, payload as pl
from palimpsest.operators import lifecycle as lc, quality


def overlong_turns(candidates: DataFrame) -> DataFrame:
    """Turns with more candidates than a batch may hold; the whole batch is refused and the turn can be claimed again."""
    counts = candidates.groupBy("source_turn_id").agg(F.count("*").alias("candidates"))
    return counts.where(F.col("candidates") > C.MAX_EXTRACTED)


def numbered(candidates: DataFrame) -> DataFrame:
    """Candidates of the turns that are not refused, numbered in arrival order; a turn has no more than a batch may hold."""
    accepted = candidates.join(overlong_turns(candidates).select("source_turn_id"), "source_turn_id", "left_anti")
    in_turn = W.partitionBy("source_turn_id").orderBy("candidate_no")
    return accepted.withColumn("number", F.row_number().over(in_turn))


def valid_candidates(candidates: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(typed candidates with their turn, invalid ones).

    ``turns(source_turn_id, owner_id, session_id, project_id, project_scope,
    user_content, turn_refs, captured_at)``.
    """
    good, bad = quality.validate_candidates(numbered(candidates))
    joined = good.join(turns, "source_turn_id")
    refs = F.array_distinct(F.concat("evidence_refs", "turn_refs"))
    return joined.withColumn("evidence_refs", refs).drop("turn_refs"), bad


def as_records(candidates: DataFrame) -> DataFrame:
    """Memory records under the capture policy; the id follows from turn and number."""
    event, preference = F.col("payload.event"), F.col("payload.preference")
    decided = lc.capture_policy(candidates.withColumns({
        "consent": F.coalesce(preference["consent"], F.lit(False)), "temporal_scope": event["temporal_scope"]}))
    return decided.select(
        keys.uuid5(F.concat_ws(":", F.lit("extracted"), "source_turn_id", "number")).alias("memory_id"),
        "owner_id", "scope", "session_id", "project_id", "project_scope", "kind", "status", "confidence", "user_confirmed",
        "evidence_refs", "source_turn_id", F.col("captured_at").alias("valid_from"), "valid_to", "payload",
        F.col("captured_at").alias("created_at"), F.col("captured_at").alias("updated_at"), "event_type",
        F.col("reason").alias("policy_reason"))


def extract(candidates: DataFrame, turns: DataFrame, extractions: DataFrame, version: str) -> dict[str, DataFrame]:
    """Records of all turns that may be extracted: events for reconciliation, others to write.

    A turn that another run has claimed under the same version is left alone.
    """
    asked = turns.select("source_turn_id", F.lit(version).alias("extraction_version"))
    claimed = lc.claim_extractions(extractions, asked)
    open_turns = turns.join(claimed.select("source_turn_id"), "source_turn_id", "left_semi")
    valid, invalid = valid_candidates(candidates, open_turns)
    records = as_records(valid)
    asked = candidates.join(open_turns.select("source_turn_id"), "source_turn_id", "left_semi")
    refused = overlong_turns(asked).select("source_turn_id", F.lit(version).alias("extraction_version"), F.lit("failed").alias("status"),
                                           F.format_string("%d candidates", "candidates").alias("reason"))
    return {"claimed": claimed, "refused": refused, "events": records.where(F.col("kind") == "event"),
            "records": records.where(F.col("kind") != "event"), "invalid": invalid}


def target_updates(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """Candidates that materially update their turn's resolved target.

    ``targets(source_turn_id, target_payload)``.
    """
    joined = candidates.join(targets, "source_turn_id")
    return joined.where(pl.is_target_update(F.col("kind"), F.col("target_payload.event"), F.col("payload.event")))
