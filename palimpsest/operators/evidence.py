"""Assets, bindings, ingestion runs, evidence rows and their vector points."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from palimpsest.functions import keys, scope as sc
from palimpsest.operators import quality
from palimpsest.operators.ordered import top_per

BINDING_KEY = ["asset_id", "owner_id", "scope", "session_id", "project_id"]


def _null_safe(left: str, right: str, names):
    on = F.lit(True)
    for name in names:
        on = on & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return on


def asset_violations(assets: DataFrame, incoming: DataFrame) -> DataFrame:
    """Asset ids that would carry more than one content hash."""
    both = assets.select("asset_id", "content_hash").unionByName(incoming.select("asset_id", "content_hash"))
    return (both.groupBy("asset_id").agg(F.min("content_hash").alias("low"), F.max("content_hash").alias("high"))
            .where("low <> high").select("asset_id"))


def new_assets(assets: DataFrame, incoming: DataFrame) -> DataFrame:
    """First arrival of every unknown, consistent asset."""
    bad = asset_violations(assets, incoming)
    fresh = (incoming.join(assets.select("asset_id"), "asset_id", "left_anti").join(bad, "asset_id", "left_anti"))
    return top_per(fresh, ["asset_id"], [F.col("created_at"), F.col("binding_id")])


def new_bindings(bindings: DataFrame, incoming: DataFrame) -> DataFrame:
    """One binding per asset and place, nulls being equal, unless it exists."""
    valid, _ = quality.split(incoming, sc.violations(sc.binding_checks()))
    first = top_per(valid, BINDING_KEY, [F.col("created_at"), F.col("binding_id")])
    return first.alias("n").join(bindings.alias("o"), _null_safe("n", "o", BINDING_KEY), "left_anti")


def visible_bindings(bindings: DataFrame, chats: DataFrame) -> DataFrame:
    """Bindings each chat may see: an equi-join on the place key."""
    placed = bindings.withColumn("place", sc.binding_key())
    asked = chats.select("query_id", F.explode(sc.evidence_chat_keys()).alias("place"))
    return placed.join(asked, "place").drop("place")


def bound_assets(bindings: DataFrame, assets: DataFrame, chats: DataFrame) -> DataFrame:
    details = assets.select("asset_id", "filename", "media_type", "raw_file_uri")
    return visible_bindings(bindings, chats).join(details, "asset_id")


def latest_runs(runs: DataFrame) -> DataFrame:
    return top_per(runs, ["binding_id"], [F.col("created_at").desc(), F.col("run_id").desc()])


def document_status(runs: DataFrame, bindings: DataFrame, chats: DataFrame) -> DataFrame:
    """Latest run of every binding a chat can see."""
    current = latest_runs(runs).select("binding_id", "run_id", "modality", "status", "chunk_count",
                                       F.coalesce("error", F.lit("")).alias("message"))
    return visible_bindings(bindings, chats).select("query_id", "binding_id", "asset_id").join(current, "binding_id")


def retryable(status: DataFrame) -> DataFrame:
    return status.where(~F.col("status").isin("processing", "done"))


def start_actions(bindings: DataFrame, runs: DataFrame, evidence: DataFrame) -> DataFrame:
    """What an upload has to do: nothing, project existing evidence again, or ingest."""
    current = latest_runs(runs).select("binding_id", "status", "run_id")
    present = evidence.select("asset_id").distinct().withColumn("present", F.lit(True))
    action = (F.when(F.col("status") == "done", "already_indexed").when(F.col("status") == "processing", "in_progress")
              .when(F.col("present"), "project_again").otherwise("ingest"))
    return (bindings.join(current, "binding_id", "left").join(present, "asset_id", "left")
            .select("binding_id", "asset_id", action.alias("action")))


def start_runs(actions: DataFrame, now) -> DataFrame:
    """Run rows for uploads that start work; the id is stable under retry at the same time."""
    started = actions.where(F.col("action").isin("project_again", "ingest"))
    return started.select(
        keys.uuid5(F.concat_ws(":", F.lit("run"), "binding_id", F.lit(str(now)))).alias("run_id"), "asset_id",
        "binding_id", F.lit("processing").alias("status"), F.lit(0).alias("chunk_count"), sc.at(now).alias("created_at"))


def complete_runs(runs: DataFrame, results: DataFrame, now) -> DataFrame:
    """Close runs with their outcome; ``results(run_id, chunks, failure)``."""
    done = results.select("run_id", "chunks", "failure")
    finished = F.col("chunks").isNotNull()
    return (runs.join(done, "run_id", "left")
            .withColumn("status", F.when(finished & F.col("failure").isNotNull(), "failed")
                        .when(finished, "done").otherwise(F.col("status")))
            .withColumn("chunk_count", F.when(finished, F.col("chunks")).otherwise(F.col("chunk_count")))
            .withColumn("completed_at", F.when(finished, sc.at(now)))
            .withColumn("error", F.coalesce("failure", "error")).drop("chunks", "failure"))


def upsert_evidence(evidence: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new snapshot, violations, projection requests).  Evidence never changes once written.

    An id with two contents, in the snapshot and the batch together, is a
    violation; nothing of it is written or projected.
    """
    hashes = evidence.select("evidence_id", "content_hash", F.lit(True).alias("old")).unionByName(
        incoming.select("evidence_id", "content_hash", F.lit(False).alias("old")))
    state = hashes.groupBy("evidence_id").agg(F.min("content_hash").alias("one"), F.max("content_hash").alias("other"), F.bool_or("old").alias("known"))
    checked = incoming.join(state, "evidence_id")
    violations = checked.where(F.col("one") != F.col("other")).select("evidence_id")
    accepted = checked.where(F.col("one") == F.col("other"))
    fresh = accepted.where(~F.col("known")).drop("one", "other", "known")
    first = top_per(fresh, ["evidence_id"], [F.col("content_hash")])
    return (evidence.unionByName(first.select(*evidence.columns)), violations.select("evidence_id"),
            accepted.select("evidence_id", "binding_id"))


def projection_inputs(evidence: DataFrame, bindings: DataFrame) -> DataFrame:
    """Evidence with every binding of its asset."""
    place = bindings.select("asset_id", "binding_id", "owner_id", "scope", "session_id", "project_id")
    return evidence.join(place, "asset_id")


def points_from(inputs: DataFrame) -> DataFrame:
    """Vector payload of each evidence row under each binding; blank text has no point."""
    shown = inputs.where(F.trim("content") != "")
    return shown.select(
        keys.point_id(F.col("evidence_id"), F.col("binding_id")).alias("point_id"),
        quality.retrieval_modality(F.col("modality")).alias("collection"),
        "evidence_id", F.col("asset_id").alias("doc_id"), "binding_id", "owner_id", "scope", "session_id", "project_id",
        "representation", "content", "source_name", "page", F.col("media_uri").alias("raw_file_uri"), "parser_backend",
        "created_at")


def length_mismatch(chunks: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Chunks without a vector and vectors without a chunk."""
    missing = chunks.join(vectors, key, "left_anti").select(key, F.lit("no vector").alias("problem"))
    extra = vectors.join(chunks, key, "left_anti").select(key, F.lit("no chunk").alias("problem"))
    return missing.unionByName(extra)


def revalidate(references: DataFrame, evidence: DataFrame, bindings: DataFrame, chats: DataFrame) -> DataFrame:
    """Authorised (query, evidence, binding) triples with the authority's content."""
    asked = references.select("query_id", "evidence_id", "binding_id").distinct()
    allowed = visible_bindings(bindings, chats).select("query_id", "binding_id", "asset_id")
    columns = ["evidence_id", "asset_id", "modality", "representation", "content", "source_name", "media_uri", "page"]
    return (asked.join(allowed, ["query_id", "binding_id"])
            .join(evidence.select(*columns), ["evidence_id", "asset_id"]))


def authorise(candidates: DataFrame, evidence: DataFrame, bindings: DataFrame, chats: DataFrame) -> DataFrame:
    """Candidates that the authority tables confirm, with the authority's columns, best rank of each evidence.

    Rank and score travel through the joins, so the candidates are computed once.
    """
    allowed = visible_bindings(bindings, chats).select("query_id", "binding_id", "asset_id")
    columns = ["evidence_id", "asset_id", "modality", "representation", "content", "source_name", "media_uri", "page"]
    merged = (candidates.select("query_id", "evidence_id", "binding_id", "rank", "score").join(allowed, ["query_id", "binding_id"])
              .join(evidence.select(*columns), ["evidence_id", "asset_id"]))
    first = top_per(merged, ["query_id", "evidence_id"], [F.col("rank"), F.col("binding_id")])
    return first.withColumn("modality", quality.retrieval_modality(F.col("modality")))


def merge_candidates(candidates: DataFrame, authorised: DataFrame) -> DataFrame:
    """Authority columns replace index columns; unauthorised and repeated evidence is dropped."""
    index = candidates.select("query_id", "evidence_id", "binding_id", "rank", "score")
    merged = index.join(authorised, ["query_id", "evidence_id", "binding_id"])
    first = top_per(merged, ["query_id", "evidence_id"], [F.col("rank"), F.col("binding_id")])
    return first.withColumn("modality", quality.retrieval_modality(F.col("modality")))


def sources(results: DataFrame) -> DataFrame:
    """Numbered citations; web addresses are linked as they are."""
    link = F.when(F.col("raw_file_uri").startswith("http"), F.col("raw_file_uri")).otherwise(
        F.format_string("/api/documents/bindings/%d/source?session_id=%s", "binding_id", "session_id"))
    return results.withColumn("source_index", F.col("rank")).withColumn("source_url", link)
