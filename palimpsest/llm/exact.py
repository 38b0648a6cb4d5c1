"""Exact deduplication by Grace hashing: partition, spill, and compare complete contents in open-addressing tables.

1. Every scan task folds its own rows: equal contents in a task become one entry, so a text that a third of all rows
   share leaves a task once, not once a row.
2. Spark partitions the entries by content hash.  A task puts its entries into an open-addressing table that compares
   complete contents.  When the table passes its memory bound, the partition is split by further hash bits into spill
   files in the task's own Spark scratch folder, and each file is treated the same way.
3. Decisions go back to the rows over the entries' numbers; an entry has no more rows than one task read.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import as_text, prepare, text_buffer, written

BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes of contents that a table may hold before its partition is split.
TABLE_BYTES = 48 << 20
FAN_OUT_BITS = 4


class Table:
    """Open addressing with linear probing over complete contents; each entry has a content and a mutable value."""

    def __init__(self):
        self.slots = np.full(1 << 10, -1, np.int64)
        self.keys: list[int] = []
        self.contents: list[bytes] = []
        self.values: list[list] = []
        self.bytes = 0

    def place(self, key: int, content: bytes) -> tuple[int, int]:
        """The entry with this content or -1, and the slot where the search ended."""
        mask = len(self.slots) - 1
        slot = key & mask
        while (entry := self.slots[slot]) >= 0:
            if self.keys[entry] == key and self.contents[entry] == content:
                return entry, slot
            slot = (slot + 1) & mask
        return -1, slot

    def add(self, slot: int, key: int, content: bytes, value: list) -> int:
        entry = len(self.keys)
        self.slots[slot] = entry
        self.keys.append(key)
        self.contents.append(content)
        self.values.append(value)
        self.bytes += len(content) + 200
        if 2 * len(self.keys) > len(self.slots):
            self.slots = np.full(2 * len(self.slots), -1, np.int64)
            mask = len(self.slots) - 1
            for number, other in enumerate(self.keys):
                slot = other & mask
                while self.slots[slot] >= 0:
                    slot = (slot + 1) & mask
                self.slots[slot] = number
        return entry


def content_key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little")


def better(a: tuple, b: tuple) -> bool:
    """Whether a row with rank ``a`` stays rather than one with ``b``: more code points, then the smaller id, null ids last."""
    return (-a[0], a[1] is None, a[1] if a[1] is not None else 0, a[2]) < (-b[0], b[1] is None, b[1] if b[1] is not None else 0, b[2])


def merge(values: list[list], entry: int, new: list) -> None:
    """Of equal contents the better rank and its row stay; counts and entry numbers add up."""
    old = values[entry]
    winner = new if better(new[0], old[0]) else old
    values[entry] = [winner[0], old[1] + new[1], winner[2], old[3] + new[3]]


def grace(records: Iterator[tuple], table_bytes: int, folder: str, depth: int = 0) -> Iterator[Table]:
    """Tables that together hold every distinct content of ``records`` (key, content, value) once.

    ``value`` is ``[rank, count, row, entries]``, see ``merge``.
    """
    table, files = Table(), None
    shift = 64 - FAN_OUT_BITS * (depth + 1)

    def spill(key, content, value):
        pickle.dump((key, content, value), files[(key >> shift) & (2 ** FAN_OUT_BITS - 1)], protocol=5)

    try:
        for key, content, value in records:
            if files is not None:
                spill(key, content, value)
                continue
            entry, slot = table.place(key, content)
            if entry >= 0:
                merge(table.values, entry, value)
                continue
            table.add(slot, key, content, value)
            if table.bytes > table_bytes and shift >= 0 and len(table.keys) > 1:
                files = [tempfile.TemporaryFile(dir=folder) for _ in range(2 ** FAN_OUT_BITS)]
                for row in zip(table.keys, table.contents, table.values, strict=True):
                    spill(*row)
                table = Table()
        if files is None:
            yield table
            return
        for file in files:
            file.seek(0)
            yield from grace(_read(file), table_bytes, folder, depth + 1)
            file.close()
    finally:
        for file in files or ():
            file.close()


def _read(file) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def scratch() -> str | None:
    """Spark's own scratch folder of this executor, for files that live no longer than the task."""
    return next((d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(d)), None)


def _numbers() -> int:
    """Where this task's row numbers begin; a retried task repeats them."""
    context = TaskContext.get()
    return (context.partitionId() if context else 0) << 40


def _contents(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, tuple]]:
    """Position, normalised content and (code points, id) of each row."""
    points = pc.utf8_length(batch.column("text")).to_pylist()
    data, bounds = text_buffer(batch.column("text"))
    data, bounds = data.tobytes(), bounds.tolist()
    for at, id_ in enumerate(batch.column("id").to_pylist()):
        yield at, data[bounds[at]:bounds[at + 1]].translate(None, BLANKS), (points[at], id_)


def _fold_rows(table_bytes: int):
    """Step 1 for decisions: a row for each input row, with the content where the row is its entry's best."""

    def work(batches):
        number, start = _numbers(), 0
        table, rows, ids, entries = Table(), [], [], []

        def out(id_type):
            best = {value[0][2]: entry for entry, value in enumerate(table.values)}
            digests = [hashlib.sha256(content).hexdigest() for content in table.contents]
            for first in range(0, len(rows), 2000):
                span = slice(first, first + 2000)
                picked = [best.get(row) for row in rows[span]]
                values = [None if e is None else table.values[e] for e in picked]
                yield pa.RecordBatch.from_pydict({
                    "row": pa.array(rows[span], pa.int64()), "id": pa.array(ids[span], id_type),
                    "entry": pa.array([table.values[e][0][2] for e in entries[span]], pa.int64()),
                    "digest": pa.array([digests[e] for e in entries[span]], pa.string()),
                    "points": pa.array([v and v[0][0] for v in values], pa.int64()), "copies": pa.array([v and v[1] for v in values], pa.int64()),
                    "content": pa.array([None if e is None else table.contents[e] for e in picked], pa.binary())})

        kind = None
        for batch in batches:
            kind = batch.schema.field("id").type
            for _, content, (points, id_) in _contents(batch):
                number += 1
                key = content_key(hashlib.sha256(content).digest())
                value = [(points, id_, number), 1, None, []]
                entry, slot = table.place(key, content)
                if entry < 0:
                    entry = table.add(slot, key, content, value)
                else:
                    merge(table.values, entry, value)
                rows.append(number)
                ids.append(id_)
                entries.append(entry)
                if table.bytes + 100 * len(rows) > table_bytes:
                    yield from out(kind)
                    table, rows, ids, entries = Table(), [], [], []
        if kind is not None:
            yield from out(kind)

    return work


def _settle_entries(table_bytes: int):
    """Step 2 for decisions: a row for each entry with the row of its content that stays."""

    def records(batches):
        for batch in batches:
            for row in batch.to_pylist():
                content = row["content"]
                yield content_key(hashlib.sha256(content).digest()), content, [(row["points"], row["id"], row["row"]), row["copies"], None, [row["row"]]]

    def work(batches):
        first = next(batches, None)
        if first is None:
            return
        kind = first.schema.field("id").type
        with tempfile.TemporaryDirectory(dir=scratch()) as folder:
            for table in grace(records(_chain(first, batches)), table_bytes, folder):
                flat = [(entry, value) for value in table.values for entry in value[3]]
                for at in range(0, len(flat), 10_000):
                    part = flat[at:at + 10_000]
                    yield pa.RecordBatch.from_pydict({
                        "settled": pa.array([e for e, _ in part], pa.int64()), "keep_id": pa.array([v[0][1] for _, v in part], kind),
                        "keep_row": pa.array([v[0][2] for _, v in part], pa.int64()), "group_size": pa.array([v[1] for _, v in part], pa.int64())})

    return work


def _chain(first, rest):
    yield first
    yield from rest


def _keep_rows(table_bytes: int, final: bool):
    """Steps 1 and 2 for whole rows: the best row of each content, of a task or of all."""

    def records(batches):
        number = _numbers()
        for batch in batches:
            wholes = batch.column("whole").to_pylist()
            numbers = batch.column("number").to_pylist()
            for at, content, (points, id_) in _contents(batch):
                number += 1
                yield (content_key(hashlib.sha256(content).digest()), content,
                       [(points, id_, numbers[at] if final else number), 1, (wholes[at], batch.schema.field("whole").type), []])

    def out(table, kinds):
        step = 500
        for first in range(0, len(table.values), step):
            values = table.values[first:first + step]
            yield pa.RecordBatch.from_pydict({
                "id": pa.array([v[0][1] for v in values], kinds[0]), "text": pa.array([v[2][0]["text"] for v in values], pa.string()),
                "number": pa.array([v[0][2] for v in values], pa.int64()),
                "key": pa.array([k - (1 << 63) for k in table.keys[first:first + step]], pa.int64()),
                "whole": pa.array([v[2][0] for v in values], kinds[1])})

    def work(batches):
        first = next(batches, None)
        if first is None:
            return
        kinds = (first.schema.field("id").type, first.schema.field("whole").type)
        stream = records(_chain(first, batches))
        if final:
            with tempfile.TemporaryDirectory(dir=scratch()) as folder:
                for table in grace(stream, table_bytes, folder):
                    yield from out(table, kinds)
            return
        table = Table()
        for key, content, value in stream:
            entry, slot = table.place(key, content)
            if entry < 0:
                table.add(slot, key, content, value)
                table.bytes += len(content)
            else:
                merge(table.values, entry, value)
            if table.bytes > table_bytes:
                yield from out(table, kinds)
                table = Table()
        yield from out(table, kinds)

    return work


def exact_groups(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row for each input row: ``id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when the bytes left after deleting blanks (0x20, 0x09-0x0D) are equal; null and empty texts and those of
    blanks alone are one group.  The row with the most code points stays, then the smallest id (null ids last); of rows that
    also repeat the id exactly one stays.  An empty table gives an empty result.  Other columns are ignored.
    """
    prepare(df.sparkSession)
    kind = dict(df.dtypes)[id_column]
    rows = df.select(F.col(id_column).alias("id"), as_text(F.col(text_column)).alias("text"))
    folded = written(rows.mapInArrow(_fold_rows(table_bytes), f"row bigint, id {kind}, entry bigint, digest string, points bigint, copies bigint, content binary"), "exact-rows")
    entries = folded.where("content is not null").select("row", "id", "digest", "points", "copies", "content").repartition("digest").drop("digest")
    settled = entries.mapInArrow(_settle_entries(table_bytes), f"settled bigint, keep_id {kind}, keep_row bigint, group_size bigint")
    return (folded.select("row", "id", "entry", "digest").join(settled, F.col("entry") == F.col("settled"), "left")
            .select("id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("digest").alias("text_sha256")))


def drop_exact_copies(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows of ``df`` that stay by the rule of ``exact_groups``, whole and with all their columns, whatever these are called."""
    prepare(df.sparkSession)
    kind = dict(df.dtypes)[id_column]
    others = [c for c in df.columns if c != text_column]
    # inside, columns have positions for names, so that no name of the input can clash
    whole = F.struct(F.col(text_column).cast("string").alias("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    rows = df.select(F.col(id_column).alias("id"), as_text(F.col(text_column)).alias("text"), F.lit(0).cast("long").alias("number"), whole.alias("whole"))
    schema = T.StructType([T.StructField("id", T._parse_datatype_string(kind)), T.StructField("text", T.StringType()), T.StructField("number", T.LongType()),
                           T.StructField("key", T.LongType()), T.StructField("whole", rows.schema["whole"].dataType)])
    own = rows.mapInArrow(_keep_rows(table_bytes, False), schema)
    kept = own.withColumn("text", as_text(F.col("text"))).repartition("key").drop("key").mapInArrow(_keep_rows(table_bytes, True), schema)
    place = {c: f"c{i}" for i, c in enumerate(others)}
    return kept.select(*[F.col("whole.text" if c == text_column else f"whole.{place[c]}").alias(c) for c in df.columns])
