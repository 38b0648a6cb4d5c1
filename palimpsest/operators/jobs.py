"""Projection work queue: enqueue, claim, finish, and the projections themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest import constants as C
from palimpsest.functions import keys, payload as pl, scope as sc
from palimpsest.operators import evidence as ev, graph
from palimpsest.operators.keyed import delete, upsert

JOB_KEY = ["memory_id", "target"]


def enqueue(jobs: DataFrame, requests: DataFrame, key=tuple(JOB_KEY)) -> DataFrame:
    """Queue after the requests: one row per key, set back to pending, lock and error cleared.

    Repeated requests are folded by aggregation before the join.
    """
    wanted = requests.groupBy(*key).agg(F.max("updated_at").alias("asked_at"))
    joined = jobs.join(wanted, list(key), "full_outer")
    asked = F.col("asked_at").isNotNull()
    reset = lambda name, value: F.when(asked, value).otherwise(F.col(name)).alias(name)
    return joined.select(
        *key, F.coalesce("job_id", keys.uuid5(F.concat_ws(":", F.lit("job"), *key))).alias("job_id"),
        reset("status", F.lit("pending")), F.coalesce("attempts", F.lit(0)).alias("attempts"),
        reset("error", F.lit(None).cast("string")), reset("locked_at", F.lit(None).cast("timestamp")),
        reset("locked_by", F.lit(None).cast("string")), reset("updated_at", F.col("asked_at")))


def enqueue_all(ids: DataFrame, key: str, now: Column, targets=tuple(C.PROJECTION_TARGETS)) -> DataFrame:
    """A request for every id and target."""
    return ids.select(key, F.explode(F.array(*[F.lit(t) for t in targets])).alias("target"), now.alias("updated_at"))


def claimable(jobs: DataFrame, now, lease_seconds: int = C.LEASE_SECONDS, targets=None) -> DataFrame:
    """Pending jobs, and running ones whose lease has run out."""
    stale = F.col("locked_at") < sc.at(now) - F.make_dt_interval(secs=F.lit(lease_seconds))
    open_ = (F.col("status") == "pending") | ((F.col("status") == "running") & stale)
    return jobs.where(open_ & F.col("target").isin(list(targets))) if targets else jobs.where(open_)


def claim(jobs: DataFrame, now, limit: int, worker: str, lease_seconds: int = C.LEASE_SECONDS, targets=None) -> DataFrame:
    """The oldest claimable jobs, marked as running for ``worker``."""
    return take(claimable(jobs, now, lease_seconds, targets).orderBy("updated_at", "job_id").limit(limit), now, worker)


def take(picked: DataFrame, now, worker: str) -> DataFrame:
    """Jobs marked as running for ``worker``."""
    return picked.withColumns({
        "status": F.lit("running"), "attempts": F.col("attempts") + 1, "locked_at": sc.at(now),
        "locked_by": F.lit(worker), "updated_at": sc.at(now)})


def finish(jobs: DataFrame, results: DataFrame, worker: Column, now) -> DataFrame:
    """Queue after results ``(job_id, failure)``; only the worker's own running jobs change."""
    joined = jobs.join(results.withColumn("_done", F.lit(True)), "job_id", "left")
    mine = F.coalesce(F.col("_done") & (F.col("status") == "running") & (F.col("locked_by") == worker), F.lit(False))
    state = F.when(F.col("failure").isNull(), "completed").otherwise("failed")
    clear = lambda name, kind: F.when(~mine, F.col(name)).cast(kind)
    return (joined.withColumns({
        "error": F.when(mine, F.col("failure")).otherwise(F.col("error")), "locked_at": clear("locked_at", "timestamp"),
        "locked_by": clear("locked_by", "string"),
        "updated_at": F.when(mine, sc.at(now)).otherwise(F.col("updated_at")),
        "status": F.when(mine, state).otherwise(F.col("status"))}).drop("_done", "failure"))


def requeue_failed(jobs: DataFrame, now) -> DataFrame:
    failed = F.col("status") == "failed"
    return jobs.withColumns({
        "error": F.when(~failed, F.col("error")), "updated_at": F.when(failed, sc.at(now)).otherwise(F.col("updated_at")),
        "status": F.when(failed, "pending").otherwise(F.col("status"))})


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("target").agg(
        F.count_if(F.col("outcome") == "completed").alias("completed"),
        F.count_if(F.col("outcome") == "failed").alias("failed"), F.count_if(F.col("outcome") == "skipped").alias("skipped"))


def memory_points(memories: DataFrame) -> DataFrame:
    """Vector payload of every memory that may be searched."""
    return memories.where(sc.is_vector_eligible()).select(
        "memory_id", pl.memory_text(F.col("kind"), F.col("payload")).alias("memory_text"), "kind", "owner_id", "scope",
        "session_id", "project_id", "project_scope", "status", "confidence", "user_confirmed", "source_turn_id",
        "valid_from", "valid_to")


def sync_memory_points(points: DataFrame, changed: DataFrame) -> DataFrame:
    """Point table after projecting changed memories; ineligible ones are removed."""
    delta = memory_points(changed)
    gone = changed.join(delta.select("memory_id"), "memory_id", "left_anti")
    return upsert(delete(points, gone, ["memory_id"]), delta, ["memory_id"])


def sync_memories(claimed: DataFrame, memories: DataFrame, relationships: DataFrame, points: DataFrame,
                  node_table: DataFrame, edge_table: DataFrame, now) -> dict[str, DataFrame]:
    """Project claimed jobs: new points, nodes, edges, and one result per job."""
    known = claimed.join(memories.select("memory_id", F.lit(True).alias("known")), "memory_id", "left")
    results = known.select("job_id", "target", F.when(
        F.col("known").isNull(), F.lit("memory record no longer exists")).alias("failure"))
    of = lambda target: memories.join(claimed.where(F.col("target") == target).select("memory_id").distinct(),
                                      "memory_id", "left_semi")
    for_graph = of("graph")
    new_nodes, kept_edges = graph.sync_nodes(node_table, edge_table, for_graph, now)
    touched = for_graph.select("memory_id")
    changed_edges = graph.peers(relationships, touched).select(*relationships.columns).dropDuplicates(["relationship_id"])
    return {"results": results, "points": sync_memory_points(points, of("vector")), "nodes": new_nodes,
            "edges": graph.sync_edges(kept_edges, changed_edges, memories, now)}


def sync_evidence(claimed: DataFrame, evidence: DataFrame, bindings: DataFrame, points: DataFrame) -> dict[str, DataFrame]:
    """Project claimed evidence jobs into points; blank text completes without a point."""
    inputs = ev.projection_inputs(evidence, bindings)
    wanted = claimed.select("job_id", "evidence_id", "binding_id").join(inputs, ["evidence_id", "binding_id"], "left")
    outcome = (F.when(F.col("asset_id").isNull(), "failed").when(F.trim("content") == "", "skipped").otherwise("completed"))
    results = wanted.select("job_id", outcome.alias("outcome"), F.when(
        F.col("asset_id").isNull(), F.lit("evidence segment no longer exists")).alias("failure"))
    delta = ev.points_from(wanted.where(F.col("asset_id").isNotNull()).drop("job_id"))
    return {"results": results, "points": upsert(points, delta, ["point_id"])}
