"""What the corpus operators share: Arrow batches, written tables, groups in a sorted stream, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.session import cut_lineage, shared_folder

#: Bounds of one Arrow batch, so that long texts do not pile up in a Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the cluster's shared folder: computed once, read by several plans, safe against lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/documents.parquet")


def as_text(column: Column) -> Column:
    """A text or value as a string that is never null."""
    return F.coalesce(column.cast("string"), F.lit(""))


def scan_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of the bytes below ``df``; used for numbers of partitions only, never for results."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(estimate, 1 << 50)


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow text column on end and the start of each row in them (one more than rows); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]], bounds - bounds[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of one do not pass ``most`` bytes, unless a single row does."""
    for batch in batches:
        _, bounds = text_buffer(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + most, side="right")) - 1)
            yield batch.slice(first, min(last, batch.num_rows) - first)
            first = last


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, Iterator[pa.RecordBatch]]]:
    """Runs of equal ``key`` in a sorted stream, one after another; a run is itself a stream and is never held whole here."""
    source = iter(batches)
    rest: list[pa.RecordBatch] = []

    def pull():
        if rest:
            return rest.pop()
        for batch in source:
            if batch.num_rows:
                return batch
        return None

    def run(value):
        while (batch := pull()) is not None:
            column = batch.column(key)
            if column[0].as_py() != value:
                rest.append(batch)
                return
            same = pc.equal(column, value)
            cut = pc.index(same, False).as_py()
            if cut < 0:
                yield batch
            else:
                rest.append(batch.slice(cut))
                yield batch.slice(0, cut)
                return

    while (batch := pull()) is not None:
        rest.append(batch)
        value = batch.column(key)[0].as_py()
        part = run(value)
        yield value, part
        for _ in part:  # what the caller left
            pass


def dealt(df: DataFrame, parts: int | None, *keys: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Rows with equal keys in one partition and together in it."""
    moved = df.repartition(parts, *keys) if parts else df.repartition(*keys)
    return moved.sortWithinPartitions(*keys, *order)


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``(node, component)``: the least node reachable over the undirected links, for every node that has a link.

    Minimum labels travel over the links and are shortcut by pointer jumping, so rounds grow with the logarithm of the
    diameter.  Every join reads a checkpoint, so a hub with very many links is split by the adaptive skew join.
    """
    pairs = links.select(F.col(left).alias("source"), F.col(right).alias("target")).where("source != target")
    both = cut_lineage(pairs.unionByName(pairs.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct())
    state = cut_lineage(both.groupBy(F.col("source").alias("node")).agg(F.min("target").alias("least"))
                        .select("node", F.least("node", "least").alias("component")))
    while True:
        heard = (both.join(state, F.col("source") == F.col("node")).groupBy("target").agg(F.min("component").alias("heard")))
        better = cut_lineage(state.join(heard, F.col("node") == F.col("target"))
                             .select("node", F.col("component").alias("old"), F.least("component", "heard").alias("component")))
        far = better.select(F.col("node").alias("owner"), F.col("component").alias("further"))
        jumped = cut_lineage(better.join(far, F.col("component") == F.col("owner"))
                             .select("node", "old", F.least("component", "further").alias("component")))
        state = jumped.select("node", "component")
        if jumped.where("old != component").isEmpty():
            return state


def arrow_map(df: DataFrame, work: Callable, schema: str) -> DataFrame:
    return prepare(df.sparkSession) and df.mapInArrow(work, schema)
