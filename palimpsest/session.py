"""Session settings and the shared checkpoint location."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings the library relies on for right results.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}

# Settings that only affect speed; sizes are left to the cluster's own values.
TUNING_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators need to an existing session."""
    for key, value in {**REQUIRED_CONF, **TUNING_CONF}.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared work folder, ``spark.checkpoint.dir``.

    Only a local session may go without; on a cluster a folder of one machine
    would be missing on the others.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(folder)
        current = context._jsc.sc().getCheckpointDir()
    return current.get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder; reliable checkpoints survive the loss of an executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files or rows that ``df`` reads, as Spark estimates them."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def dealt(df: DataFrame, bytes_per_task: int) -> DataFrame:
    """Deal rows out by their contents before work that is heavy per row, in as many tasks as the input's bytes ask for.

    A file is read by row groups, and a compact table has few of these however many
    rows it holds.  Unlike :func:`spread` this also deals large inputs, so the rows
    of a task do not grow with the table.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-input_bytes(df) // bytes_per_task)), *df.columns)


def spread(df: DataFrame, *order: str) -> DataFrame:
    """Deal the rows of a small input out to all cores before work that is heavy per row.

    With ``order`` the rows are dealt in ranges, so that neighbours stay together.

    A small table is read by fewer tasks than there are cores.  Inputs large
    enough to give every core a split of its own stay where they are, so nothing
    is shuffled at scale.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split_bytes = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    if input_bytes(df) >= cores * split_bytes:
        return df
    return df.repartitionByRange(cores, *order) if order else df.repartition(cores)
