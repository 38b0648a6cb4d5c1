"""Keyed state of the streams: who was first, how far a chat has counted, what is due when.

The processors keep only what a decision needs, in RocksDB state that Spark checkpoints with the stream, so the time of a batch
depends on its own rows and never on how many batches came before.  Keys are dealt to ``SLOTS`` groups and looked up in
map state, once a batch and distinct key, so neither many small keys nor one hot key makes a group expensive.  First holders
are looked up by blocks of keys: a state call costs far more than the keys of a block, and a batch makes at most two a block.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SLOTS = 64
# A slot of timers keeps its pending ends as one value, so there are more of these.
TIMER_SLOTS = 1024
# A slot of first holders keeps them in so many blocks; a block is one value, read and written whole.
BLOCKS = 1024
# Holders that are handed on at once.
ROWS_OUT = 10_000


def with_state(spark: SparkSession) -> None:
    """Map state and timers need the RocksDB provider; streams that start from here on use it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def slot(*key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


# --- first holders ---------------------------------------------------------------------------

_HELD = "held string, created bigint, memory_id string, domain string, identifier string, claims string"
#: Rows of :class:`FirstHolders`: events as they came, and for each key of the batch who held it before.
HOLDER_ROWS = _HELD + ", record string"


class FirstHolders(StatefulProcessor):
    """The first event that came with each key; within a batch the earliest by time and id.

    Input rows are ``HOLDER_ROWS``: one for each key of an event, of which one carries the event itself as ``record``.  Rows with a
    record pass through; for every key that an earlier batch or the snapshot already holds, one row names the holder.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getMapState("first", "block int", "holders string")

    @staticmethod
    def _gather(part: pd.DataFrame, found: dict[int, dict[str, tuple]]) -> dict[int, dict[str, tuple]]:
        """The earliest event of each key, by block, added to ``found``."""
        earliest = part.sort_values(["created", "memory_id"]).drop_duplicates("held")
        for held, created, *rest in earliest[[c.split()[0] for c in _HELD.split(", ")]].itertuples(index=False, name=None):
            held, *rest = (None if pd.isna(v) else v for v in (held, *rest))
            block, value = found.setdefault(zlib.crc32((held or "").encode("utf-8", "surrogatepass")) % BLOCKS, {}), (int(created), *rest)
            block[held] = min(block[held], value, key=lambda v: v[:2]) if held in block else value
        return found

    def _holders(self, block: int) -> dict[str, tuple]:
        stored = self.first.getValue((block,))
        return {held: tuple(value) for held, *value in json.loads(stored[0])} if stored is not None else {}

    def _keep(self, block: int, holders: dict[str, tuple]) -> None:
        self.first.updateValue((block,), (json.dumps([(held, *value) for held, value in holders.items()]),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in HOLDER_ROWS.split(", ")]
        asked: dict[int, dict[str, tuple]] = {}
        for part in rows:
            carriers = part[part["record"].notna()]
            if len(carriers):
                yield carriers[names]
            self._gather(part, asked)
        met: list[tuple] = []
        for block, own in asked.items():
            known = self._holders(block)
            met += [(held, *known[held], None) for held in own if held in known]
            new = {held: value for held, value in own.items() if held not in known}
            if new:
                self._keep(block, known | new)
            if len(met) >= ROWS_OUT:
                yield pd.DataFrame(met, columns=names)
                met = []
        if met:
            yield pd.DataFrame(met, columns=names)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for block, own in self._gather(initialState, {}).items():
            known = self._holders(block)
            known.update({held: value for held, value in own.items() if held not in known or value[:2] < known[held][:2]})
            self._keep(block, known)

    def close(self) -> None:
        pass


def first_holders(rows: DataFrame, snapshot: DataFrame) -> DataFrame:
    """``rows`` of a stream (``HOLDER_ROWS``) with the holders that their keys have so far; ``snapshot`` holds keys from the start."""
    with_state(rows.sparkSession)
    dealt = lambda df: df.withColumn("slot", slot(F.col("held"))).groupBy("slot")
    return dealt(rows).transformWithStateInPandas(FirstHolders(), HOLDER_ROWS, "Append", "None", dealt(snapshot))


# --- counters --------------------------------------------------------------------------------

class Counters(StatefulProcessor):
    """Adds to each row how many rows its ``counted`` key had in earlier batches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getMapState("total", "counted string", "rows bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before: dict[str, int] = {}
        own: dict[str, int] = {}
        for part in rows:
            for counted, number in part["counted"].value_counts().items():
                if counted not in before:
                    found = self.total.getValue((counted,))
                    before[counted] = int(found[0]) if found else 0
                own[counted] = own.get(counted, 0) + int(number)
            yield part.assign(before=part["counted"].map(before)).drop(columns="slot")
        for counted, number in own.items():
            self.total.updateValue((counted,), (before[counted] + number,))

    def close(self) -> None:
        pass


def count_before(rows: DataFrame, key: Column) -> DataFrame:
    """``rows`` of a stream with ``counted`` (the key as text) and ``before``, the rows of that key in all earlier batches."""
    with_state(rows.sparkSession)
    keyed = rows.withColumn("counted", key.cast("string"))
    schema = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in keyed.schema)
    return keyed.withColumn("slot", slot(F.col("counted"))).groupBy("slot").transformWithStateInPandas(Counters(), f"{schema}, before bigint", "Append", "None")


# --- timers ----------------------------------------------------------------------------------

class ValidityTimers(StatefulProcessor):
    """The ends of validity that a slot of active memories still waits for, and a timer at the next of them.

    A memory's end is moved or dropped when the memory changes.  The state holds pending ends only, so it does not grow with what
    has expired.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "ends string, timer bigint")

    @staticmethod
    def _newest(part: pd.DataFrame) -> pd.DataFrame:
        return part.sort_values(["changed", "status"]).drop_duplicates("memory_id", keep="last")

    def _load(self) -> tuple[dict[str, int], int | None]:
        found = self.pending.get()
        return (json.loads(found[0]), int(found[1])) if found is not None else ({}, None)

    def _store(self, ends: dict[str, int], timer: int | None) -> None:
        """Keep ``ends``; ``timer`` is the one that is set."""
        due = min(ends.values(), default=None)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if ends:
            self.pending.update((json.dumps(ends), due))
        elif timer is not None:
            self.pending.clear()

    @staticmethod
    def _expired(due: list[tuple[str, int]]) -> Iterator[pd.DataFrame]:
        if due:
            yield pd.DataFrame({"memory_id": [m for m, _ in due], "status": "expired", "valid_to": [end for _, end in due]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [self._newest(part[part["memory_id"].notna()]) for part in rows]
        newest = self._newest(pd.concat(parts, ignore_index=True)) if parts else None
        if newest is None or not len(newest):
            return
        ends, timer = self._load()
        clock, due = timerValues.getCurrentWatermarkInMs(), []
        for memory_id, status, valid_to in newest[["memory_id", "status", "valid_to"]].itertuples(index=False, name=None):
            ends.pop(memory_id, None)
            if status == "active" and not pd.isna(valid_to):
                if int(valid_to) <= clock:  # came when it was due already
                    due.append((memory_id, int(valid_to)))
                else:
                    ends[memory_id] = int(valid_to)
        self._store(ends, timer)
        yield from self._expired(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ends, _ = self._load()
        clock = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        due = [(memory_id, end) for memory_id, end in ends.items() if end <= clock]
        for memory_id, _ in due:
            del ends[memory_id]
        if ends:  # Spark drops the timer that fired
            following = min(ends.values())
            self.handle.registerTimer(following)
            self.pending.update((json.dumps(ends), following))
        else:
            self.pending.clear()
        yield from self._expired(due)

    def close(self) -> None:
        pass


def expire_on_time(changes: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """``memory_id, status, valid_to`` (milliseconds) of memories as their validity ends.

    ``changes(memory_id, status, valid_to, at)`` are memory rows as they are written, ``at`` the time of the write; the latest row of a
    memory counts.  Rows without a memory are ticks that only move the clock.  A memory expires when the clock, less ``delay``,
    has reached its ``valid_to``, rounded up to milliseconds; no snapshot is read.
    """
    with_state(changes.sparkSession)
    millis = lambda column: F.ceil(F.unix_micros(column) / 1000)
    rows = changes.withWatermark("at", delay).select("memory_id", "status", millis(F.col("valid_to")).alias("valid_to"), F.unix_micros("at").alias("changed"), "at")
    dealt = rows.withColumn("slot", slot(F.col("memory_id"), slots=TIMER_SLOTS))
    return (dealt.groupBy("slot").transformWithStateInPandas(ValidityTimers(), "memory_id string, status string, valid_to bigint", "Append", "EventTime")
            .where(F.col("memory_id").isNotNull()))
