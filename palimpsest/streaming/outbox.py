"""Continuous forms of the batch operators.

Each stream hands its micro-batches to the same set-oriented functions that the
batch jobs use, so a stream that has read everything gives the batch result.
Checkpoint and output folders are arguments and belong on shared storage.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest import constants as C, schemas
from palimpsest.operators import jobs, lifecycle as lc, listings
from palimpsest.operators.keyed import latest
from palimpsest.operators.ordered import ordinal
from palimpsest.streaming import state

logger = logging.getLogger(__name__)


def read_changes(spark: SparkSession, path: str, schema, files_per_trigger: int = 100, name_filter: str = "*") -> DataFrame:
    """Change rows as they are written to a folder, in bounded batches."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
            .option("pathGlobFilter", name_filter).parquet(path))


def read_log(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def run(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append",
        interval: str | None = None):
    """Start a stream into ``handler``; without ``interval`` it ends when everything is read."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(handler)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def into_folder(path: str, mode: str = "append") -> Callable[[DataFrame, int], None]:
    """Write every batch under its own number, so a repeated batch replaces itself."""
    def write(batch: DataFrame, number: int) -> None:
        target = f"{path}/batch={number}" if mode == "append" else path
        batch.write.mode("overwrite").parquet(target)
    return write


def current(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The keyed table that the batches below ``path`` amount to: for each key the row of the last batch that wrote it."""
    return latest(spark.read.parquet(path), keys, [F.col("batch").cast("long").desc()]).drop("batch")


# --- outbox -------------------------------------------------------------------------

def drain_jobs(requests: DataFrame, project: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, worker: str, now):
    """Drain projection requests in bounded batches until nothing is left.

    Every batch is queued (one job per key), taken by ``worker``, projected and
    finished.  ``project`` turns taken jobs into ``(job_id, failure)``; a failure
    stays with its job until it is asked for again.  A batch writes what it did to
    its jobs, one attempt each; :func:`drained_jobs` adds the batches up, so no
    batch reads the ones before it.
    """
    def handle(batch: DataFrame, number: int) -> None:
        taken = jobs.take(jobs.enqueue(batch.sparkSession.createDataFrame([], schemas.schema("memory_projection_jobs")), batch), now, worker)
        jobs.finish(taken, project(taken), F.lit(worker), now).write.mode("overwrite").parquet(f"{path}/batch={number}")
    return run(requests, handle, checkpoint)


def drained_jobs(spark: SparkSession, path: str) -> DataFrame:
    """The queue after all batches below ``path``: one row a job, as its last batch left it, with the attempts of all batches."""
    done = spark.read.parquet(path)
    rest = [c for c in done.columns if c not in (*jobs.JOB_KEY, "attempts", "batch")]
    last = F.max_by(F.struct(*rest), F.col("batch").cast("long"))
    return done.groupBy(*jobs.JOB_KEY).agg(last.alias("last"), F.sum("attempts").cast("int").alias("attempts")).select(*jobs.JOB_KEY, "last.*", "attempts")


# --- extraction, once per turn ---------------------------------------------------------

def once_per_turn(requests: DataFrame, delay: str = "1 day") -> DataFrame:
    """First request of each (turn, version); ``delay`` bounds how late a repeat may come.

    The reference keeps claims for ever; a stream needs a bound for its state.
    """
    return requests.withWatermark("requested_at", delay).dropDuplicatesWithinWatermark(["source_turn_id", "extraction_version"])


# --- expiry -----------------------------------------------------------------------------

def expiry_loop(ticks: DataFrame, sweep: Callable[[str], None], checkpoint: str, seconds: int | None = C.EXPIRY_SWEEP_SECONDS):
    """Sweep periodically; a sweep that fails is logged and the next one still runs.

    Without ``seconds`` the ticks that have come are worked off and the loop ends.
    """
    def handle(batch: DataFrame, _number: int) -> None:
        newest = batch.agg(F.max("timestamp").alias("now")).first()
        if newest is None or newest["now"] is None:
            return
        try:
            sweep(str(newest["now"]))
        except Exception:
            logger.exception("expiry sweep failed")
    return run(ticks, handle, checkpoint, interval=None if seconds is None else f"{max(seconds, C.EXPIRY_SWEEP_MIN_SECONDS)} seconds")


def expire_batches(now: str, path: str) -> Callable[[DataFrame, int], None]:
    """Handler that expires what is due in each batch of memory rows."""
    def handle(batch: DataFrame, number: int) -> None:
        lc.expire_due(batch, now).records.write.mode("overwrite").parquet(f"{path}/batch={number}")
    return handle


# --- capture -------------------------------------------------------------------------------

_RECORD_JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def _holder_rows(events: DataFrame, carry: bool) -> DataFrame:
    """One row for each key of an event: its identity, and its domain with each identifier; the first carries the event itself."""
    record = F.to_json(F.struct(*events.columns), _RECORD_JSON) if carry else F.lit(None).cast("string")
    marked = lc.marked_events(events.withColumn("record", record), 0, "record").select(
        "memory_id", F.unix_micros(F.col("position.created_at").cast("timestamp")).alias("created"), "identity_key", "domain", "identifiers", F.to_json("claims", {"ignoreNullFields": "false"}).alias("claims"), "record")
    key = lambda held, identifier, record: F.struct(held.alias("held"), identifier.alias("identifier"), record.alias("record"))
    nothing = F.lit(None).cast("string")
    own = F.array(key(F.concat(F.lit("identity:"), F.col("identity_key")), nothing, F.col("record")))
    named = F.transform("identifiers", lambda i: key(F.concat_ws(C.UNIT_SEPARATOR, F.lit("identifier"), F.col("domain"), i), i, nothing))
    return (marked.withColumn("k", F.explode(F.concat(own, F.coalesce(named, F.array().cast("array<struct<held string, identifier string, record string>>")))))
            .select("k.held", "created", "memory_id", "domain", "k.identifier", "claims", "k.record"))


def _known_events(rows: DataFrame, time_type) -> DataFrame:
    """The holders that a batch met, as the known events of :func:`lifecycle.judge_events`: each with the keys it holds."""
    identity = F.when(F.col("held").startswith("identity:"), F.substring("held", len("identity:") + 1, 1 << 20))
    return (rows.groupBy("memory_id").agg(
        F.min("created").alias("created"), F.max(identity).alias("identity"), F.max("domain").alias("domain"), F.collect_set("identifier").alias("identifiers"), F.max("claims").alias("claims"))
        .select("memory_id", F.lit(0).alias("arrival"), F.struct(F.lit(0).alias("arrival"), F.timestamp_micros("created").cast(time_type).alias("created_at"), F.col("memory_id")).alias("position"),
                # an event met by its identifiers only is nobody's original
                F.coalesce("identity", F.concat(F.lit("other:"), "memory_id")).alias("identity_key"), "domain", "identifiers", F.from_json("claims", "map<string,string>").alias("claims")))


def capture_stream(events: DataFrame, snapshot: DataFrame, live_path: str, outcome_path: str, checkpoint: str):
    """Capture arriving events against the live ones of ``snapshot`` and of all earlier batches; one writer.

    The state holds who came first with each identity and with each identifier of
    a domain.  A batch asks it for the keys of its own events only, and
    :func:`lifecycle.judge_events` gives every event the outcome of arrival
    order, so no domain has to be processed by a single task and no batch
    reads what earlier ones wrote.
    """
    schema = events.schema
    live = snapshot.where((F.col("kind") == "event") & F.col("status").isin(C.LIVE_STATUSES))
    met = state.first_holders(_holder_rows(events, True), _holder_rows(live, False))

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # the state is asked once; everything else reads the answer
        batch.write.mode("overwrite").parquet(f"{live_path}-met/batch={number}")
        answer = spark.read.schema(state.HOLDER_ROWS).parquet(f"{live_path}-met/batch={number}")
        new = answer.where(F.col("record").isNotNull()).select(F.from_json("record", schema, _RECORD_JSON).alias("r")).select("r.*")
        outcomes = lc.judge_events(_known_events(answer.where(F.col("record").isNull()), schema["created_at"].dataType).unionByName(lc.marked_events(new, 1)))
        outcomes.write.mode("overwrite").parquet(f"{outcome_path}/batch={number}")
        written = spark.read.parquet(f"{outcome_path}/batch={number}")
        lc.captured_records(new, written).select(*snapshot.columns).write.mode("overwrite").parquet(f"{live_path}/batch={number}")
    return run(met, handle, checkpoint)


# --- turn indexes -----------------------------------------------------------------------------

def number_turns(messages: DataFrame, path: str, checkpoint: str, span_seconds: int = 3600):
    """Gapless turn index per chat as messages arrive.

    A counter per chat is all the state there is.  Messages of a batch are
    numbered by time and id on top of it; a message that arrives in a later batch
    than one sent after it gets the later index, so lateness is bounded by the
    length of a batch.
    """
    counted = state.count_before(messages.select("session_id", "message_id", "created_at"), F.col("session_id"))

    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}-counted/batch={number}")
        own = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}-counted/batch={number}")
        bucket = F.floor(F.unix_timestamp("created_at") / span_seconds)
        rows = ordinal(own, ["session_id"], [F.col("created_at"), F.col("message_id")], bucket, "own")
        rows.select("session_id", "message_id", (F.col("before") + F.col("own")).alias("turn_index")).write.mode("overwrite").parquet(f"{path}/batch={number}")
    return run(counted, handle, checkpoint)


# --- ingestion status and latency ---------------------------------------------------------------

def latest_status(runs: DataFrame) -> DataFrame:
    """Newest run of each binding, updated as runs change; :func:`current` over the binding reads what was written."""
    newest = F.max_by(F.struct("run_id", "status"), F.struct("created_at", "run_id"))
    return runs.groupBy("binding_id").agg(newest.alias("r")).select("binding_id", "r.run_id", "r.status")


def stage_totals(events: DataFrame) -> DataFrame:
    return listings.stage_totals(events)
