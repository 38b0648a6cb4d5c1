"""Keyed writes as pure functions from snapshot and delta to a new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest import constants as C
from palimpsest.operators.ordered import top_per

# Columns of a memory that keep their first value on an update.
FIRST_VALUE_COLUMNS = ("kind", "valid_from", "created_at", "source_turn_id", "extraction_model", "extraction_version")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``."""
    return top_per(df, keys, order, 1)


def upsert(snapshot: DataFrame, delta: DataFrame, keys: list[str], keep_first=(), newest: list[Column] | None = None) -> DataFrame:
    """Insert new keys, overwrite the other columns of known keys; one shuffle by key.

    A key has one row in ``delta``; where it may have several, ``newest`` orders
    them and the first one counts.
    """
    delta = latest(delta, keys, newest) if newest else delta
    s, d = snapshot.withColumn("_old", F.lit(True)).alias("s"), delta.withColumn("_new", F.lit(True)).alias("d")
    both = s.join(d, keys, "full_outer")
    columns = []
    for name in snapshot.columns:
        if name in keys:
            columns.append(F.col(name))
        elif name not in delta.columns:
            columns.append(F.col(f"s.{name}").alias(name))
        elif name in keep_first:
            columns.append(F.when(F.col("_old"), F.col(f"s.{name}")).otherwise(F.col(f"d.{name}")).alias(name))
        else:
            columns.append(F.when(F.col("_new"), F.col(f"d.{name}")).otherwise(F.col(f"s.{name}")).alias(name))
    return both.select(*columns)


def repeated_keys(delta: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with several rows, for callers that have no order to choose by."""
    return delta.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def upsert_memories(snapshot: DataFrame, delta: DataFrame) -> DataFrame:
    """Upsert of memories; of several rows for one memory the last update counts."""
    return upsert(snapshot, delta, ["memory_id"], FIRST_VALUE_COLUMNS, [F.col("updated_at").desc()])


def delete(snapshot: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """Remove rows by key; unknown keys are ignored."""
    return snapshot.join(ids.select(*keys), keys, "left_anti")


def audit_rows(delta: DataFrame, event_type: Column, actor: Column, details: Column, now: Column) -> DataFrame:
    """One audit row per written memory."""
    return delta.select("memory_id", event_type.alias("event_type"), actor.alias("actor_id"),
                        details.alias("details"), now.alias("created_at"))


def job_rows(delta: DataFrame, now: Column, targets=tuple(C.PROJECTION_TARGETS)) -> DataFrame:
    """One projection request per written memory and target."""
    return delta.select("memory_id", F.explode(F.array(*[F.lit(t) for t in targets])).alias("target"),
                        now.alias("updated_at"))


def access_rows(selected: DataFrame, now: Column) -> DataFrame:
    """Two access events, retrieved and injected, per memory shown in a prompt."""
    kinds = F.array(F.lit("retrieved"), F.lit("injected"))
    return selected.withColumn("event_type", F.explode(kinds)).withColumn("created_at", now)


def log_lines(events: DataFrame) -> DataFrame:
    """Latency events as JSON lines, keys sorted, null fields left out."""
    ordered = events.withColumn("duration_ms", F.round("duration_ms", 3)).select(*sorted(events.columns))
    return ordered.select(F.to_json(F.struct(*ordered.columns)).alias("value"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of every table; the pre-flight of a reset."""
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
              for name, df in tables.items()]
    out = counts[0]
    for part in counts[1:]:
        out = out.unionByName(part)
    return out


def emptied(df: DataFrame) -> DataFrame:
    """The same schema without rows: content of a table after a reset."""
    return df.limit(0)


def reset(tables: dict[str, DataFrame], confirmed: bool) -> dict[str, DataFrame]:
    """Empty replacements for all tables; refuses without confirmation."""
    if not confirmed:
        raise ValueError("a reset must be confirmed")
    return {name: emptied(df) for name, df in tables.items()}
