"""Near-duplicate documents by Order MinHash, verified by banded alignment.

1. A task cuts each text into shingles of five words and labels the occurrences of equal ones.  Under each of ``SKETCHES``
   hash functions it takes the ``TAKEN`` least labelled shingles and hashes them in the order of the text.  Rows of a
   task with the same words become one entry, and equal entries of all tasks one class, so copies are compared once.
2. Classes that share a sketch are a bucket.  Every member is verified against the bucket's first member, never against
   all others, and links join classes to components.
3. Only where a bucket still holds several components are members of different components compared: numbers of common
   shingles come from products of presence rows, block by block, and pairs with enough of them are aligned until all
   that link are joined.  So no link inside a bucket is lost, and no pair leaves a task but the few that join components.

The alignment matches labelled shingles in order within a band of positions; with m matched of a and b shingles the
similarity is m / (a + b - m).
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import words as W
from palimpsest.llm.common import as_text, components, dealt, grouped, pieces, prepare, text_buffer, written

SHINGLE, SIMILARITY = 5, 0.8
SKETCHES, TAKEN = 16, 3
#: Members of a bucket that are compared at once, their shingles, and shingles of a block of presence rows.
BLOCK_ROWS, BLOCK_SHINGLES, _COLUMNS = 600, 1_500_000, 8192
_STEP = 1 << 15
_LAST = np.uint64(2 ** 64 - 1)


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Labelled shingle hashes of a text's word hashes in order; a text of fewer words is one shingle."""
    if not len(words):
        return words
    found = W.window_hashes(words, min(size, len(words)))
    order = np.argsort(found, kind="stable")
    along = found[order]
    new = np.r_[True, along[1:] != along[:-1]]
    if new.all():
        return found
    places = np.arange(len(along))
    labels = places - np.maximum.accumulate(np.where(new, places, 0))
    out = np.empty_like(found)
    out[order] = np.where(labels > 0, W.mixed(along + labels.astype(np.uint64) * np.uint64(W.SECOND_BASE)), along)
    return out


_FACTORS = W.mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def sketch(found: np.ndarray, count: int = SKETCHES, taken: int = TAKEN) -> list[int]:
    """For each hash function the hash of the ``taken`` least shingles in text order."""
    if not len(found):
        return []
    least, where = [], []
    for first in range(0, len(found), _STEP):
        part = found[first:first + _STEP]
        values = part[None, :] * _FACTORS[:count, None]
        values ^= values >> np.uint64(31)
        values *= np.uint64(W.BYTE_BASE)
        for _ in range(min(taken, len(part))):
            at = values.argmin(1)
            least.append(values[np.arange(count), at].copy())
            where.append(at + first)
            values[np.arange(count), at] = _LAST
    least, where = np.array(least), np.array(where)
    best = np.argsort(least, axis=0, kind="stable")[:taken]
    where = np.sort(np.take_along_axis(where, best, 0), axis=0)
    value = W.mixed(np.arange(count, dtype=np.uint64))
    for row in where:
        value = W.mixed(value * np.uint64(W.WINDOW_BASE) + found[row])
    return value.view(np.int64).tolist()


def band(a: int, b: int, similarity: float) -> int:
    """How far apart positions of a match may lie if the alignment reaches ``similarity``."""
    return max(a, b) - math.ceil(similarity * (a + b) / (1 + similarity) - 1e-9)


def matched(a: np.ndarray, b: np.ndarray, width: int) -> int:
    """Length of the longest common sequence of labelled shingles with matches at most ``width`` positions apart."""
    if width < 0:
        return 0
    _, at, to = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    order = np.argsort(at)
    at, to = at[order], to[order]
    to = to[np.abs(at - to) <= width]
    if len(to) < 2 or (to[1:] > to[:-1]).all():
        return len(to)
    ends: list[int] = []
    for value in to.tolist():
        place = bisect_left(ends, value)
        if place == len(ends):
            ends.append(value)
        else:
            ends[place] = value
    return len(ends)


def _text_shingles(blob: bytes, size: int) -> np.ndarray:
    data = np.frombuffer(_restore(blob), np.uint8)
    starts, ends, _ = W.spans(data, np.array([0, len(data)]))
    return shingles(W.hashes(data, starts, ends), size)


def _squeeze(raw) -> bytes:
    return np.array([len(raw)], "<u8").tobytes() + pa.compress(raw, "zstd", asbytes=True) if len(raw) else b""


def _restore(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], decompressed_size=int(np.frombuffer(blob[:8], "<u8")[0]), codec="zstd", asbytes=True) if blob else b""


#: Rows that a task folds at once.
FOLDED_ROWS = 10_000


def _sketch_task(size: int, count: int, taken: int):
    def out(rows, entries, rest):
        best = [entries[r[2]] for r in rows]
        own = [r[0] == e[1] for r, e in zip(rows, best)]
        columns = {
            "row": pa.array([r[0] for r in rows], pa.int64()), "id": pa.array([r[1] for r in rows], pa.int64()), "entry": pa.array([e[1] for e in best], pa.int64()),
            "words": pa.array([r[2] if o else None for r, o in zip(rows, own)], pa.binary()), "sketches": pa.array([e[2] if o else None for e, o in zip(best, own)], pa.list_(pa.int64())),
            "size": pa.array([e[3] if o else None for e, o in zip(best, own)], pa.int64()), "text": pa.array([r[3] if o else None for r, o in zip(rows, own)], pa.binary())}
        if rest:
            columns["rest"] = pa.concat_arrays(rest)
        yield pa.RecordBatch.from_pydict(columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 40
        rows, entries, rest, held = [], {}, [], 0
        for batch in pieces(batches, "text"):
            data, bounds = text_buffer(batch.column("text"))
            starts, ends, first = W.spans(data, bounds)
            hashed = W.hashes(data, starts, ends)
            view, bounds, first = memoryview(np.ascontiguousarray(data)), bounds.tolist(), first.tolist()
            if "rest" in batch.schema.names:
                rest.append(batch.column("rest"))
            for at, id_ in enumerate(batch.column("id").to_pylist()):
                number += 1
                own = hashed[first[at]:first[at + 1]]
                same = xxhash.xxh3_128_digest(own.tobytes())
                rank = (id_ is None, 0 if id_ is None else id_, number)
                known = entries.get(same)
                if known is None:
                    found = shingles(own, size)
                    entries[same] = (rank, number, sketch(found, count, taken), len(found))
                elif rank < known[0]:
                    entries[same] = (rank, number, known[2], known[3])
                rows.append((number, id_, same, _squeeze(view[bounds[at]:bounds[at + 1]])))
                held += len(rows[-1][3])
            if len(rows) >= FOLDED_ROWS or held > 12 << 20:
                yield from out(rows, entries, rest)
                rows, entries, rest, held = [], {}, [], 0
        if rows:
            yield from out(rows, entries, rest)

    return work


def _align_task(size: int, similarity: float):
    """The pairs that link."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blob = kept = None
        for batch in batches:
            linked = []
            for a, b in zip(batch.column("text").to_pylist(), batch.column("other_text").to_pylist(), strict=True):
                if b != blob:
                    blob, kept = b, _text_shingles(b, size)
                own = _text_shingles(a, size)
                same = matched(own, kept, band(len(own), len(kept), similarity))
                linked.append(same > 0 and same >= similarity * (len(own) + len(kept) - same))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("other")], names=["node", "other"]).filter(pa.array(linked, pa.bool_()))

    return work


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Numbers of common labelled shingles of all pairs, as products of blocks of presence rows."""
    out = np.zeros((len(a), len(b)), np.float32)
    sides = [(np.concatenate(side) if side else np.zeros(0, np.uint64), np.repeat(np.arange(len(side)), [len(x) for x in side])) for side in (a, b)]
    common = np.intersect1d(np.unique(sides[0][0]), np.unique(sides[1][0]), assume_unique=True)
    if a is b:  # what one text alone holds is in no pair
        every, count = np.unique(sides[0][0], return_counts=True)
        common = every[count > 1]
    for first in range(0, len(common), _COLUMNS):
        part = common[first:first + _COLUMNS]
        rows = []
        for (values, owners), side in zip(sides, (a, b)):
            at = np.minimum(np.searchsorted(part, values), len(part) - 1)
            hit = part[at] == values
            presence = np.zeros((len(side), len(part)), np.float32)
            presence[owners[hit], at[hit]] = 1
            rows.append(presence)
        out += rows[0] @ rows[1].T
    return out


def _compare_task(size: int, similarity: float):
    """Links between members of a bucket that belong to different components, enough to join all that link."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, stream in grouped(batches, "meeting"):
            sides: tuple[list, list] = ([], [])
            alone = True
            for batch in stream:
                for node, label, second, own, text in zip(*[batch.column(c).to_pylist() for c in ("node", "label", "second", "alone", "text")]):
                    sides[int(second)].append((node, label, _text_shingles(text, size)))
                    alone = own
            a, b = sides if not alone else (sides[0], sides[0])
            grams = [[x[2] for x in side] for side in (a, b)]
            common = overlaps(grams[0], grams[0] if alone else grams[1])
            labels = [np.array([x[1] for x in side], np.int64) for side in (a, b)]
            sums = np.array([len(x) for x in grams[0]])[:, None] + np.array([len(x) for x in grams[1]])[None, :]
            # enough common shingles, in whatever order, is necessary; the alignment decides
            fit = (common + 0.5 >= similarity * (sums - common)) & (labels[0][:, None] != labels[1][None, :])
            if alone:
                fit = np.triu(fit, 1)
            x, y = np.nonzero(fit)
            order = np.argsort(-common[x, y] / np.maximum(sums[x, y] - common[x, y], 1), kind="stable")
            root: dict[int, int] = {}

            def find(label):
                while root.get(label, label) != label:
                    label = root[label]
                return label

            links = []
            for i, j in zip(x[order].tolist(), y[order].tolist()):
                one, two = find(a[i][1]), find(b[j][1])
                if one == two:
                    continue
                same = matched(a[i][2], b[j][2], band(len(a[i][2]), len(b[j][2]), similarity))
                if same and same >= similarity * (int(sums[i, j]) - same):
                    root[max(one, two)] = min(one, two)
                    links.append((a[i][0], b[j][0]))
            if links:
                yield pa.RecordBatch.from_pydict({"node": pa.array([n for n, _ in links], pa.int64()), "other": pa.array([n for _, n in links], pa.int64())})

    return work


def _aligned(pairs: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs ``node, other`` that link; skewed sides are split by the adaptive join."""
    own = pairs.join(texts, "node").select("node", "other", "text")
    both = own.join(texts.select(F.col("node").alias("other"), F.col("text").alias("other_text")), "other").select("node", "other", "text", "other_text")
    return both.mapInArrow(_align_task(size, similarity), "node bigint, other bigint")


def _folded(df: DataFrame, id_column: str, text_column: str, size: int, count: int, taken: int, carry: bool) -> tuple[DataFrame, list[str]]:
    prepare(df.sparkSession)
    others = [c for c in df.columns if c != text_column]
    rest = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)], F.col(text_column).isNull().alias("blank"))
    rows = df.select(F.col(id_column).cast("long").alias("id"), as_text(F.col(text_column)).alias("text"), *([rest.alias("rest")] if carry else []))
    fields = [("row", T.LongType()), ("id", T.LongType()), ("entry", T.LongType()), ("words", T.BinaryType()), ("sketches", T.ArrayType(T.LongType())), ("size", T.LongType()),
              ("text", T.BinaryType())]
    schema = T.StructType([*[T.StructField(*f) for f in fields], *([rows.schema["rest"]] if carry else [])])
    return written(rows.mapInArrow(_sketch_task(size, count, taken), schema), "near-rows"), others


def _classes(folded: DataFrame, size: int, similarity: float) -> DataFrame:
    """``entry, class_row, class_id`` for every entry: the row that stays of its class and that row's id."""
    rank = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))
    entries = folded.where("words is not null")
    same = entries.groupBy("words").agg(F.min(rank).alias("first"))
    owners = written(entries.select("entry", "words").join(same, "words").select("entry", F.col("first.row").alias("node"), F.col("first.none").alias("none"), F.col("first.id").alias("id")), "near-entries")
    nodes = owners.where("entry = node").select("node", "none", "id")
    texts = entries.select(F.col("entry").alias("node"), "text")
    about = nodes.join(entries.select(F.col("entry").alias("node"), "sketches", "size"), "node")
    member = written(about.select("node", "none", "id", "size", F.explode("sketches").alias("bucket")), "near-buckets")
    heads = member.groupBy("bucket").agg(F.min(F.struct("none", "id", "node", "size")).alias("head"), F.count("*").alias("members")).where("members > 1").select("bucket", "head")
    led = written(member.select("bucket", "node", "size").join(heads, "bucket").select("bucket", "node", "size", F.col("head.node").alias("other"), F.col("head.size").alias("other_size")), "near-led")
    share = (1 - similarity) / (1 + similarity)  # two texts link if they are at most this share of their shingles apart
    fits = lambda a, b: F.abs(F.col(a) - F.col(b)) <= share * (F.col(a) + F.col(b)) + 1e-6
    first = led.where("node <> other").where(fits("size", "other_size")).select("node", "other").distinct()
    links = written(_aligned(first, texts, size, similarity), "near-first")
    joined = components(links, "node", "other").withColumnRenamed("component", "label")

    # buckets that still hold several components; buckets with the same members count once
    state = led.join(joined, "node", "left").select("bucket", "node", "size", F.coalesce("label", "node").alias("label"))
    mixed = (state.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("members"), F.sum("size").alias("held"),
                                         F.sum(F.shiftright(F.xxhash64("node"), 20)).alias("mark"))
             .where("low <> high and members > 2").groupBy("members", "held", "mark").agg(F.min("bucket").alias("bucket"))
             .select("bucket", F.ceil(F.greatest(F.col("members") / BLOCK_ROWS, F.col("held") / BLOCK_SHINGLES)).alias("blocks")))
    own = state.join(mixed, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    # a bucket beyond one block meets itself block by block
    placed = own.withColumn("against", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    meeting = F.xxhash64("bucket", F.least("block", "against"), F.greatest("block", "against"))
    met = placed.select(meeting.alias("meeting"), (F.col("block") > F.col("against")).alias("second"), (F.col("block") == F.col("against")).alias("alone"), "node", "label").join(texts, "node")
    again = written(dealt(met, None, "meeting").mapInArrow(_compare_task(size, similarity), "node bigint, other bigint"), "near-second")
    final = components(links.unionByName(again), "node", "other")
    grouped = nodes.join(final, "node", "left").select("node", "none", "id", F.coalesce("component", "node").alias("component"))
    heads = grouped.groupBy("component").agg(F.min(F.struct("none", "id", "node")).alias("head"))
    named = grouped.join(heads, "component").select("node", F.col("head.node").alias("class_row"), F.col("head.id").alias("class_id"))
    return owners.select("entry", "node").join(named, "node").select("entry", "class_row", "class_id")


def near_classes(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY,
                 sketches: int = SKETCHES, taken: int = TAKEN) -> DataFrame:
    """``id, class_id, kept`` of each row.

    Texts of a class are joined by links of at least ``similarity``; texts with the same words link.  The smallest id of a class
    names it and its row stays (null ids last; of rows that repeat the id exactly one stays).  Texts without words are copies of one
    another.  An empty table gives an empty result; other columns are ignored.
    """
    folded, _ = _folded(df, id_column, text_column, size, sketches, taken, False)
    classes = _classes(folded, size, similarity)
    return (folded.select("row", "id", "entry").join(classes, "entry")
            .select("id", "class_id", (F.col("row") == F.col("class_row")).alias("kept")))


def _unpack_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([_restore(b) for b in batch.column("text").to_pylist()], pa.string()), batch.column("rest")], names=["text", "rest"])


def drop_near_copies(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY,
                     sketches: int = SKETCHES, taken: int = TAKEN) -> DataFrame:
    """The rows of ``df`` that stay by the rule of ``near_classes``, whole and with all their columns, whatever these are called."""
    folded, others = _folded(df, id_column, text_column, size, sketches, taken, True)
    stay = _classes(folded, size, similarity).select(F.col("class_row").alias("row")).distinct()
    kept = folded.where("words is not null").select("row", "text", "rest").join(stay, "row", "left_semi").drop("row")
    schema = T.StructType([T.StructField("text", T.StringType()), folded.schema["rest"]])
    rows = kept.mapInArrow(_unpack_task, schema)
    place = {c: f"rest.c{i}" for i, c in enumerate(others)}
    return rows.select(*[F.when(F.col("rest.blank"), None).otherwise(F.col("text")).alias(c) if c == text_column else F.col(place[c]).alias(c) for c in df.columns])
