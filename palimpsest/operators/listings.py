"""Read models: shaped rows and bounded listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from palimpsest.functions.temporal import iso_utc
from palimpsest.operators.ordered import top_per


def session_rows(sessions: DataFrame) -> DataFrame:
    return sessions.select("session_id", "owner_id", "title", "project_scope", "project_id",
                           F.col("project_scope").alias("project_name"), iso_utc(F.col("created_at")).alias("created_at"),
                           iso_utc(F.col("updated_at")).alias("updated_at"))


def conflicts(conflict_table: DataFrame, memories: DataFrame) -> DataFrame:
    """Conflicts with owner and project of the incoming record."""
    incoming = memories.select(F.col("memory_id").alias("incoming_memory_id"), "owner_id", "project_scope")
    return conflict_table.join(incoming, "incoming_memory_id")


def conflict_rows(joined: DataFrame) -> DataFrame:
    """Conflict rows as shown: details never null, owner left out."""
    return joined.withColumn("details", F.coalesce("details", F.lit("{}"))).drop("owner_id")


def jobs(job_table: DataFrame, memories: DataFrame, status: str | None = None, limit: int = 100) -> DataFrame:
    """Newest jobs of each owner."""
    wanted = job_table.where(F.col("status") == status) if status else job_table
    joined = wanted.join(memories.select("memory_id", "owner_id"), "memory_id")
    return top_per(joined, ["owner_id"], [F.col("updated_at").desc(), F.col("job_id")], limit)


def stage_totals(latency: DataFrame) -> DataFrame:
    return latency.groupBy("run_id", "stage").agg(F.round(F.sum("duration_ms"), 3).alias("total_ms"), F.count("*").alias("jobs"))
