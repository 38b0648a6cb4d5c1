"""Shapes the flat fixture columns into the typed memory record."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from palimpsest import schemas
from palimpsest.functions import text as tx

FLAT_PREFIXES = ("know_", "pref_", "sol_", "ent_", "ev_")


def with_payload(memories: DataFrame, keep_flat: bool = False) -> DataFrame:
    """Memory records with the payload union in place of (or next to) the flat columns."""
    c = F.col
    none_map, none = F.create_map().cast("map<string,string>"), F.array().cast("array<string>")
    values = {
        "knowledge": F.struct(c("know_subject"), c("know_predicate"), c("know_object"), none_map, F.lit(None)),
        "preference": F.struct(c("pref_behavior"), c("pref_conditions"), F.lit(0.5), F.lit(False)),
        "solution": F.struct(c("sol_problem"), c("sol_environment"), c("sol_steps"), c("sol_outcome"), none),
        "entity": F.struct(c("ent_name"), c("ent_type"), c("ent_aliases"), none_map, none),
        "event": F.struct(tx.event_label(c("ev_type_raw")), c("ev_type_raw"), c("ev_summary"), c("ev_entities"),
                          c("ev_locations"), c("ev_time"), c("ev_refs"), c("ev_claims")),
    }
    payload = F.struct(*[
        F.when(c("kind") == kind, value.cast(f"struct<{schemas.PAYLOAD_BRANCHES[kind]}>")).alias(kind)
        for kind, value in values.items()])
    keep = [name for name in memories.columns if keep_flat or not name.startswith(FLAT_PREFIXES)]
    return memories.select(*keep, payload.alias("payload"))


def with_history(records: DataFrame) -> DataFrame:
    """The record columns the lifecycle operators write."""
    return records.withColumns({
        "subject_id": F.lit(None).cast("string"), "superseded_by": F.lit(None).cast("string"),
        "identity_key": F.lit(None).cast("string"), "extraction_model": F.lit(""), "extraction_version": F.lit("")})
