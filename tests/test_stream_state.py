"""Streams on keyed state: many batches, replays, hot keys, timers."""

import hashlib
import time
from datetime import datetime, timedelta

import pandas as pd
import pytest
from helpers import claim, event, records, ref, values
from pyspark.sql import functions as F

from palimpsest.operators import jobs, lifecycle as lc
from palimpsest.sources import readers
from palimpsest.streaming import outbox, state

NOW = "2024-01-20 00:00:00"
START = datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def one_partition(spark):
    """Many small batches are about time a batch, not about parallelism."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def in_batches(df, path, column, count):
    """``df`` as a stream of ``count`` files in the order of ``column``."""
    for part in range(count):
        df.where(F.col(column) == part).drop(column).coalesce(1).write.mode("append").parquet(str(path))
    return outbox.read_changes(df.sparkSession, str(path), df.drop(column).schema, files_per_trigger=1)


def arrivals(spark, count, per_batch):
    """Events of two domains, one of them hot, with repeats and changed claims."""
    rows = [{"memory_id": f"m{i:04}", "owner_id": "hot" if i % 3 else f"o{i % 5}", "created_at": START + timedelta(minutes=i),
             "payload": event(refs=[ref(f"A-{i % 7}"), ref(f"B-{i % 4}")] if i % 6 else [], claims=[claim("state", str(i % 3))], time=["Friday", None][i % 2])} for i in range(count)]
    return records(spark, rows).withColumn("batch", (F.substring("memory_id", 2, 4).cast("int") / per_batch).cast("int"))


def test_many_batches_of_captures_equal_the_batch_and_stay_even(spark, tmp_path):
    rows = arrivals(spark, 60, 8).cache()
    old = records(spark, [{"memory_id": "known", "owner_id": "hot", "payload": event(refs=[ref("A-1")], claims=[claim("state", "9")])}])
    stream = in_batches(rows, tmp_path / "in", "batch", 8)
    query = outbox.capture_stream(stream, old, str(tmp_path / "live"), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    took = [p["durationMs"]["triggerExecution"] for p in query.recentProgress if p["numInputRows"]]
    want = values(lc.capture_events(old, rows), "memory_id", "outcome", "existing_memory_id", "changed_claims")
    assert {o for _, o, _, _ in want} == {"created", "duplicate", "conflict"}
    assert values(spark.read.parquet(str(tmp_path / "out")), "memory_id", "outcome", "existing_memory_id", "changed_claims") == want
    assert len(took) == 8 and sorted(took[5:])[1] < 2 * sorted(took[1:4])[1]
    live = spark.read.parquet(str(tmp_path / "live"))
    assert values(live, "memory_id", "status", "user_confirmed", "payload") == values(lc.captured_records(rows.drop("batch"), lc.capture_events(old, rows)), "memory_id", "status", "user_confirmed", "payload")


def test_turns_of_a_hot_chat_go_on_over_batches(spark, tmp_path):
    sent = [("hot" if i % 3 else f"c{i % 4}", f"m{i:03}", START + timedelta(minutes=7 * i), i // 20) for i in range(120)]
    rows = spark.createDataFrame(sent, "session_id string, message_id string, created_at timestamp, batch int")
    outbox.number_turns(in_batches(rows, tmp_path / "in", "batch", 6), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    want = sorted((s, m, sum(1 for x in sent if x[0] == s and x[2] <= at)) for s, m, at, _ in sent)
    assert values(outbox.current(spark, str(tmp_path / "out"), ["message_id"]), "session_id", "message_id", "turn_index") == want


def test_memories_expire_as_the_clock_reaches_them(spark, tmp_path):
    at = lambda hours: START + timedelta(hours=hours)
    sent = [("a", "active", at(5), at(0), 0), ("b", "active", at(9), at(1), 0), ("open", "active", None, at(1), 0), ("draft", "candidate", at(2), at(1), 0),
            ("b", "superseded", at(9), at(4), 1), ("moved", "active", at(6), at(4), 1), (None, "tick", None, at(5), 1),
            ("moved", "active", at(20), at(6), 2), ("late", "active", at(3), at(6), 2), (None, "tick", None, at(10), 2), (None, "tick", None, at(11), 3), (None, "tick", None, at(11), 4)]
    rows = spark.createDataFrame(sent, "memory_id string, status string, valid_to timestamp, at timestamp, batch int")
    fired = state.expire_on_time(in_batches(rows, tmp_path / "in", "batch", 5))
    outbox.run(fired, outbox.into_folder(str(tmp_path / "out")), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("memory_id", "status", F.timestamp_millis("valid_to").alias("valid_to"))
    assert values(got, "memory_id", "status", "valid_to") == [("a", "expired", at(5)), ("late", "expired", at(3))]


def test_attempts_add_up_over_batches_and_a_failed_job_can_be_asked_again(spark, tmp_path):
    sent = [("m1", 0), ("m2", 0), ("m1", 1), ("m1", 1), ("bad", 1), ("m1", 2), ("bad", 3)]
    rows = spark.createDataFrame([(m, "graph", START, b) for m, b in sent], "memory_id string, target string, updated_at timestamp, batch int")
    project = lambda taken: taken.select("job_id", F.when(F.col("memory_id") == "bad", "no record").alias("failure"))
    outbox.drain_jobs(in_batches(rows, tmp_path / "in", "batch", 4), project, str(tmp_path / "out"), str(tmp_path / "cp"), "w", NOW).awaitTermination()
    done = outbox.drained_jobs(spark, str(tmp_path / "out"))
    assert set(done.columns) == {*jobs.JOB_KEY, "job_id", "status", "attempts", "error", "locked_at", "locked_by", "updated_at"}
    assert values(done, "memory_id", "status", "attempts", "error") == [("bad", "failed", 2, "no record"), ("m1", "completed", 3, None), ("m2", "completed", 1, None)]


def test_expiry_loop_without_an_interval_works_off_what_has_come(spark, tmp_path):
    ticks = spark.createDataFrame([(START + timedelta(hours=i), i) for i in range(3)], "timestamp timestamp, batch int")
    seen = []

    def sweep(now):
        seen.append(now)
        if len(seen) == 2:
            raise ValueError("second sweep fails")

    began = time.time()
    outbox.expiry_loop(in_batches(ticks, tmp_path / "in", "batch", 3), sweep, str(tmp_path / "cp"), seconds=None).awaitTermination()
    assert seen == [f"2024-01-01 0{i}:00:00" for i in range(3)] and time.time() - began < 30


def test_timers_of_many_memories_share_a_slot(spark, tmp_path, monkeypatch):
    """One group of state a memory would be 200 of them; ends that move or come at once stay with their memory."""
    monkeypatch.setattr(state, "TIMER_SLOTS", 2)
    at = lambda hours: START + timedelta(hours=hours)
    sent = [(f"m{i:03}", "active", at(10 + i % 50), at(i % 5), 0) for i in range(200)]
    sent += [(f"m{i:03}", "rejected" if i % 4 == 0 else "active", at(200 + i), at(6), 1) for i in range(0, 200, 2)]
    sent += [(None, "tick", None, at(30), 1), (None, "tick", None, at(31), 2), ("past", "active", at(12), at(31), 2), (None, "tick", None, at(70), 3), (None, "tick", None, at(301), 4), (None, "tick", None, at(301), 5)]
    rows = spark.createDataFrame(sent, "memory_id string, status string, valid_to timestamp, at timestamp, batch int")
    query = outbox.run(state.expire_on_time(in_batches(rows, tmp_path / "in", "batch", 6)), outbox.into_folder(str(tmp_path / "out")), str(tmp_path / "cp"))
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) < 20
    got = spark.read.parquet(str(tmp_path / "out")).select("memory_id", "status", F.timestamp_millis("valid_to").alias("valid_to"))
    want = [(f"m{i:03}", "expired", at(10 + i % 50)) for i in range(1, 200, 2)] + [(f"m{i:03}", "expired", at(200 + i)) for i in range(2, 102, 4)] + [("past", "expired", at(12))]
    assert values(got, "memory_id", "status", "valid_to") == sorted(want, key=repr)


def test_arrivals_bounded_by_bytes_take_few_batches(spark, tmp_path):
    for i in range(30):
        (tmp_path / "in" / f"d{i % 3}").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / f"d{i % 3}" / f"f{i}.pdf").write_text(f"content {i % 20:03}")
    files = readers.read_arrivals(spark, str(tmp_path / "in"), bytes_per_trigger=11 * 10)
    query = outbox.run(readers.arriving_assets(files).select("asset_id", "length"), outbox.into_folder(str(tmp_path / "out")), str(tmp_path / "cp"))
    query.awaitTermination()
    read = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert sum(read) == 30 and 3 <= len(read) <= 4
    got = values(spark.read.parquet(str(tmp_path / "out")), "asset_id", "length")
    assert got == sorted((hashlib.sha256(f"content {i:03}".encode()).hexdigest(), 11) for i in range(20))


class CountedMap:
    """Map state in memory that counts its calls."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def getMapState(self, *_):
        return self

    def getValue(self, key):
        self.calls += 1
        return self.held.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = value


def test_first_holders_ask_the_state_by_blocks_of_keys():
    names = [column.split()[0] for column in state.HOLDER_ROWS.split(", ")]
    row = lambda n, created, memory, record=None: (f"identifier\x1fé{n}", created, memory, None, f"i{n}", None, record)
    frame = lambda rows: pd.DataFrame(rows, columns=names)
    stored, first = CountedMap(), state.FirstHolders()
    first.init(stored)
    first.handleInitialState((0,), frame([row(n, 5, "old") for n in range(6000)] + [(None, 1, "none", None, None, None, None)]), None)
    # a later chunk of the same group holds an earlier event of one key
    first.handleInitialState((0,), frame([row(7, 4, "older"), row(8, 6, "newer")]), None)
    assert stored.calls <= 2 * state.BLOCKS + 4

    def batch(*chunks):
        parts = list(first.handleInputRows((0,), iter([frame(chunk) for chunk in chunks]), None))
        out = pd.concat(parts) if parts else frame([])
        return sorted(out[out["record"].notna()]["record"]), {r.held: (r.created, r.memory_id, r.identifier) for r in out[out["record"].isna()].itertuples()}

    carried, met = batch([row(n, 9, "a", f"r{n}") for n in range(5000, 9000)], [row(6000, 8, "b"), row(7, 9, "b", "seven"), row(8, 9, "b")], [(None, 9, "c", None, None, None, "null key")])
    assert carried == sorted([f"r{n}" for n in range(5000, 9000)] + ["seven", "null key"])
    assert met == {f"identifier\x1fé{n}": (5, "old", f"i{n}") for n in [8, *range(5000, 6000)]} | {"identifier\x1fé7": (4, "older", "i7"), None: (1, "none", None)}
    carried, met = batch([row(6000, 1, "late"), row(8999, 1, "late"), row(9000, 1, "late", "new")])
    assert carried == ["new"]
    assert met == {"identifier\x1fé6000": (8, "b", "i6000"), "identifier\x1fé8999": (9, "a", "i8999")}
    assert stored.calls <= 5 * state.BLOCKS
