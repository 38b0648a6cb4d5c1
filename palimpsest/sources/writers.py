"""Writes of snapshots, logs and vector points."""

from __future__ import annotations

from pyspark.sql import DataFrame

from palimpsest.operators.keyed import log_lines


def write_snapshot(df: DataFrame, path: str, cluster_by: list[str] | None = None) -> None:
    """Replace a snapshot; rows of one key range share files, so filters skip row groups."""
    ordered = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by) if cluster_by else df
    ordered.write.mode("overwrite").parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_log(events: DataFrame, path: str) -> None:
    log_lines(events).write.mode("append").text(path)


def write_points(points: DataFrame, path: str) -> None:
    """Vector points, one folder per collection; a large collection keeps many files."""
    points.write.mode("overwrite").partitionBy("collection").parquet(path)


