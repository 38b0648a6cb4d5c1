"""Row constraints, key checks, candidate validation and modality labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.functions import keys, payload as pl, text as tx
from palimpsest.operators.ordered import explode_computed

STORED_MODALITY = {"video_segment": "video", "audio_segment": "audio"}
RETRIEVAL_MODALITY = {"video": "video_segment", "audio": "audio_segment"}

EVIDENCE_HASH_FIELDS = ["asset_id", "modality", "representation", "content", "media_uri", "source_name", "locator",
                        "parent", "parser_backend", "parser_version", "retrieval_metadata"]


def _relabel(labels: dict, c: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])[c], c)


def stored_modality(c: Column) -> Column:
    """Label kept in the evidence table."""
    return _relabel(STORED_MODALITY, c)


def retrieval_modality(c: Column) -> Column:
    """Label shown in retrieval results."""
    return _relabel(RETRIEVAL_MODALITY, c)


def with_evidence_hash(evidence: DataFrame) -> DataFrame:
    """Add the provenance hash; fields the table lacks count as null."""
    source = {"parent": "parent_evidence_id", "locator": "locator" if "locator" in evidence.columns else "page"}
    fields = {}
    for name in EVIDENCE_HASH_FIELDS:
        column = source.get(name, name)
        fields[name] = F.col(column) if column in evidence.columns else F.lit(None).cast("string")
    return evidence.withColumn("content_hash", keys.evidence_hash(fields))


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*key).agg(F.count("*").alias("occurrences")).where("occurrences > 1")


def orphans(df: DataFrame, parent: DataFrame, key: list[str]) -> DataFrame:
    """Rows without a parent row."""
    return df.join(parent.select(*key), key, "left_anti")


def split(df: DataFrame, failed: Column) -> tuple[DataFrame, DataFrame]:
    """(rows without violations, rows with the list of violations)."""
    marked = df.withColumn("failed", failed)
    return marked.where(F.size("failed") == 0).drop("failed"), marked.where(F.size("failed") > 0)


def validate_candidates(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Normalise JSON payloads; (valid with typed payload, invalid as received).

    Payload and verdict are computed together, once per row: a filter on the
    verdict would otherwise parse the payload again for every field it tests.
    """
    kind = F.col("kind")
    verdict = tx.let(pl.normalise(kind, F.col("payload")), lambda typed: F.struct(
        typed.alias("typed"), F.coalesce(pl.payload_valid(kind, typed), F.lit(False)).alias("ok")))
    checked = explode_computed(candidates, candidates.columns, F.array(verdict), "checked_no", "checked")
    others = [name for name in candidates.columns if name != "payload"]
    return (checked.where("checked.ok").select(*others, F.col("checked.typed").alias("payload")),
            checked.where(~F.col("checked.ok")).select(*candidates.columns))
