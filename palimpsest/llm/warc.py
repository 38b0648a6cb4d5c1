"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing stays in Spark's text writer: the two line ends that close a WARC record are its line separator.  Reading uses the
text reader with the record magic as separator, so large uncompressed archives are split like any text file and compressed
ones are read by one task each:

1. Every task turns each piece between two magics into a candidate: its place in the split, the place where its header says the
   next record begins, and the digest of its payload.
2. Sizes of splits, summed along each file, give all places as offsets of the file.
3. Inside a split, chains of candidates are contracted: each candidate learns where its chain leaves the split and an interval
   that tells which candidates lie on the chain of which.
4. Pointer jumping over the places where chains enter splits, from the start of every file, keeps what a reader from the
   start would meet.  A magic inside a payload is a candidate too, but no chain from the start reaches it.
5. A record whose payload holds a magic lies in several pieces; those of kept records are put together again by offset.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.common import as_text, dealt, grouped, prepare, written
from palimpsest.session import cut_lineage

MAGIC = b"WARC/1.0\r\n"
RECORD_END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Payloads below this many bytes are always written in full.
LEAST_REVISIT_BYTES = 100
RECORDS_PER_FILE = 200_000


def _id_uri(column: Column) -> Column:
    return F.concat(F.lit("<urn:row:"), as_text(column), F.lit(">"))


def write_archives(df: DataFrame, path: str, id_column: str = "page_id", uri_column: str = "url", payload_column: str = "html",
                   compression: str = "gzip", least_revisit_bytes: int = LEAST_REVISIT_BYTES) -> None:
    """One record for each row of ``df`` in archives below ``path``.

    A null payload is empty.  Of rows with equal payloads of at least ``least_revisit_bytes`` bytes the smallest id is written as
    response, rows with another id as revisit of it without payload.  Rows that repeat both id and payload are all
    written alike.  A null id never is the one that others revisit unless all ids of the payload are null.  Control characters
    and blanks in URIs are written as %20.  An empty table writes no record.
    """
    prepare(df.sparkSession)
    payload = as_text(F.col(payload_column))
    rows = df.select(F.col(id_column).alias("id"), as_text(F.col(uri_column)).alias("uri"), payload.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("digest"))
    sized = rows.select("id", "size", "digest").where(F.col("size") >= least_revisit_bytes)
    shared = sized.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first")
    refers = (sized.join(shared, "digest").where(~F.col("id").eqNullSafe(F.col("first")))
              .select(F.col("id").alias("own"), F.col("digest").alias("own_digest"), "first").distinct())
    told = rows.join(refers, F.col("id").eqNullSafe(F.col("own")) & (F.col("digest") == F.col("own_digest")), "left")
    revisit = F.col("first").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    block = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    record = F.concat(
        F.lit(MAGIC.decode()), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _id_uri(F.col("id"))), line("WARC-Target-URI", F.regexp_replace("uri", r"[\x00-\x20\x7f]", "%20")), line("WARC-Date", F.lit(DATE)),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", _id_uri(F.col("first"))))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), line("X-Payload-Length", F.col("size").cast("string")),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block)
    (told.select(record.alias("value")).write.option("lineSep", RECORD_END).option("compression", compression)
     .option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


_FIELD = re.compile(rb"(?im)^([A-Za-z0-9-]+):[ \t]*(.*?)[ \t]*\r?$")
_HEAD = ("type", "record_id", "uri", "refers_to", "digest", "payload_length")
_NAMES = {b"warc-type": "type", b"warc-record-id": "record_id", b"warc-target-uri": "uri", b"warc-refers-to": "refers_to",
          b"warc-payload-digest": "digest", b"x-payload-length": "payload_length"}
_CANDIDATE = ("file string, split bigint, number bigint, size bigint, length bigint, head bigint, "
              + ", ".join(f"{c} string" for c in _HEAD) + ", sha256 string, content binary")


def _segments(spark: SparkSession, path: str) -> DataFrame:
    text = prepare(spark).read.option("lineSep", MAGIC.decode()).option("recursiveFileLookup", "true").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("value"))


def _parse(value: bytes) -> tuple[int, int, dict] | None:
    """Bytes of the header with its blank line, content length and fields; None if this is no header."""
    stop = value.find(b"\r\n\r\n")
    if stop < 0:
        return None
    fields, length = {}, None
    for name, told in _FIELD.findall(value, 0, stop + 2):
        name = name.lower()
        if name == b"content-length" and told.isdigit():
            length = int(told)
        elif name in _NAMES:
            fields[_NAMES[name]] = told.decode("utf-8", "replace")
    return None if length is None or length >= 1 << 60 else (stop + 4, length, fields)


def _candidate_task(with_content: bool):
    """A row for each piece; its digest if the whole payload lies in it. ``length`` is null where there is no header."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, number = None, 0
        for batch in batches:
            rows = []
            for file, split, value in zip(batch.column("file").to_pylist(), batch.column("split").to_pylist(), batch.column("value"), strict=True):
                if (file, split) != place:
                    place, number = (file, split), 0
                value = value.as_py()
                found = None if split == 0 and number == 0 else _parse(value)
                row = {"file": file, "split": split, "number": number, "size": len(value) + len(MAGIC)}
                if found:
                    head, length, fields = found
                    row |= {"head": head, "length": length, **fields}
                    if head + length <= len(value):
                        payload = value[head:head + length]
                        row["sha256"] = hashlib.sha256(payload).hexdigest()
                        if with_content:
                            row["content"] = payload
                rows.append(row)
                number += 1
            kinds = [(c, pa.int64()) for c in ("split", "number", "size", "length", "head")]
            schema = pa.schema([("file", pa.string()), *kinds, *[(c, pa.string()) for c in (*_HEAD, "sha256")], ("content", pa.binary())])
            yield pa.RecordBatch.from_pylist(rows, schema)

    return work


_LINKED = "file string, split bigint, number bigint, at bigint, leaves bigint, low bigint, high bigint"


def _contract_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split: where each candidate's chain leaves it, and intervals with ``low`` of x in [low, high) of y iff y lies on x's chain."""
    for split, stream in grouped(batches, "group"):
        table = pa.Table.from_batches(list(stream))
        number, at, to = (table.column(c).to_numpy() for c in ("number", "at", "next"))
        file, split = table.column("file")[0].as_py(), table.column("split")[0].as_py()
        where = np.searchsorted(at, to)
        inside = (where < len(at)) & (at[np.minimum(where, len(at) - 1)] == to)
        leaves, sizes = to.copy(), np.ones(len(at), np.int64)
        where, inside = where.tolist(), inside.tolist()
        for i in range(len(at) - 1, -1, -1):
            if inside[i]:
                leaves[i] = leaves[where[i]]
        for i in range(len(at)):
            if inside[i]:
                sizes[where[i]] += sizes[i]
        low, free, top = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), 0
        for i in range(len(at) - 1, -1, -1):
            if inside[i]:
                low[i] = free[where[i]]
                free[where[i]] += sizes[i]
            else:
                low[i], top = top, top + sizes[i]
            free[i] = low[i] + 1
        yield pa.RecordBatch.from_pydict({"file": [file] * len(at), "split": [split] * len(at), "number": number, "at": at, "leaves": leaves,
                                          "low": low, "high": low + sizes})


def _by_merge(df: DataFrame) -> DataFrame:
    """``df`` for a join in which both sides can have a row for each record.

    Spark's estimate goes by the bytes of the written tables.  They are compressed to a fiftieth or so, mostly by the paths of
    files, and one below the broadcast threshold can be more than the driver holds.
    """
    return df.hint("merge")


def reachable(linked: DataFrame) -> DataFrame:
    """Pointer jumping from offset 0 of every file: ``file, at`` of the candidates where a kept chain enters a split."""
    entered = linked.select("file", F.col("leaves").alias("at")).distinct()
    links = linked.select("file", "at", "leaves")
    steps = cut_lineage(links.where("at = 0").unionByName(links.where("at > 0").join(_by_merge(entered), ["file", "at"], "left_semi")))
    nodes = steps.select("file", F.col("at").alias("leaves"))
    reached = cut_lineage(steps.where("at = 0").select("file", "at"))
    while True:
        # steps lead 2**k chain links on; those that end in a node reach it from reached nodes
        landed = cut_lineage(steps.join(_by_merge(nodes), ["file", "leaves"], "left_semi").select("file", "at", "leaves"))
        if landed.isEmpty():
            return reached
        more = reached.join(_by_merge(landed), ["file", "at"]).select("file", F.col("leaves").alias("at"))
        reached = cut_lineage(reached.unionByName(more).distinct())
        far = steps.select("file", F.col("at").alias("leaves"), F.col("leaves").alias("further"))
        steps = cut_lineage(landed.join(_by_merge(far), ["file", "leaves"]).select("file", "at", F.col("further").alias("leaves")))


def read_archives(spark: SparkSession, path: str, with_content: bool = False) -> DataFrame:
    """The records that a reader from the start of each file below ``path`` meets.

    ``file, offset, type, record_id, uri, refers_to, digest`` (as the header has it), ``payload_length`` (header), ``length``,
    ``sha256`` of the block's bytes and, if asked for, ``content``.  A file that does not begin with a record, and what
    follows a damaged record, has no reachable record.  Empty archives give an empty table.
    """
    pieces = _segments(spark, path)
    found = written(pieces.mapInArrow(_candidate_task(False), _CANDIDATE).drop("content"), "warc-candidates")
    blocks = found.groupBy("file", "split").agg(F.sum("size").alias("bytes"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "split", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("file", "split").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    placed = (found.select("file", "split", "number", "size", "length", "head")
              .withColumn("own", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(_by_merge(blocks), ["file", "split"])
              .select("file", "split", "number", "size", "length", "head", (F.col("base") + F.col("own")).alias("begin")))
    placed = written(placed, "warc-offsets")
    candidates = placed.where("length is not null").select(
        "file", "split", "number", (F.col("begin") - len(MAGIC)).alias("at"),
        (F.col("begin") + F.col("head") + F.col("length") + len(RECORD_END)).alias("next"), F.concat_ws("#", "split", "file").alias("group"))
    linked = cut_lineage(dealt(candidates, None, "group", order=("number",)).mapInArrow(_contract_task, _LINKED))
    entry = linked.join(_by_merge(reachable(linked)), ["file", "at"]).select("file", "split", F.col("low").alias("entry"))
    kept = (linked.join(_by_merge(entry), ["file", "split"]).where("entry >= low and entry < high")
            .select("file", "split", "number", F.col("at").alias("offset")))
    columns = ["file", "offset", *_HEAD, "length", "sha256"]
    if with_content:
        source = pieces.mapInArrow(_candidate_task(True), _CANDIDATE)
        columns.append("content")
    else:
        source = found
    records = source.join(_by_merge(kept), ["file", "split", "number"])
    scattered = cut_lineage(found.where("length is not null and sha256 is null").join(_by_merge(kept), ["file", "split", "number"])
                            .join(_by_merge(placed.select("file", "split", "number", "begin")), ["file", "split", "number"])
                            .select("file", "offset", (F.col("begin") + F.col("head")).alias("from"), (F.col("begin") + F.col("head") + F.col("length")).alias("to")))
    whole = records.where("sha256 is not null").select(*columns)
    if scattered.isEmpty():
        return whole
    # pieces of a record lie one after another, so their number is bounded by its length
    parts = (pieces.mapInArrow(_raw_task, "file string, split bigint, number bigint, value binary")
             .join(_by_merge(placed.select("file", "split", "number", "begin")), ["file", "split", "number"]).join(scattered, "file")
             .where("begin < to and begin + octet_length(value) >= from"))
    joined = dealt(parts.select(F.concat_ws("#", "offset", "file").alias("group"), "file", "offset", "from", "to", "begin", "value"), None, "group", order=("begin",))
    mended = joined.mapInArrow(_mend_task, "file string, offset bigint, sha256 string, content binary")
    mended = mended if with_content else mended.drop("content")
    rest = (records.where("sha256 is null").drop("sha256", "content").join(mended, ["file", "offset"], "left").select(*columns))
    return whole.unionByName(rest)


def _raw_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, number = None, 0
    for batch in batches:
        numbers = []
        for now in zip(batch.column("file").to_pylist(), batch.column("split").to_pylist(), strict=True):
            if now != place:
                place, number = now, 0
            numbers.append(number)
            number += 1
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("split"), pa.array(numbers, pa.int64()), batch.column("value")],
                                         names=["file", "split", "number", "value"])


def _mend_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, stream in grouped(batches, "group"):
        content, last = bytearray(), None
        for batch in stream:
            for row in batch.to_pylist():
                if last is not None:
                    content += MAGIC
                skip = max(0, row["from"] - row["begin"])
                content += row["value"][skip:row["to"] - row["begin"]]
                last = row
        content = bytes(content[:last["to"] - last["from"]])
        short = len(content) < last["to"] - last["from"]
        if short and last["to"] - last["from"] - len(content) <= len(MAGIC):  # the payload ends inside a magic
            content += MAGIC[:last["to"] - last["from"] - len(content)]
        yield pa.RecordBatch.from_pydict({"file": [last["file"]], "offset": [last["offset"]], "sha256": [hashlib.sha256(content).hexdigest()], "content": [content]})
