"""Substring deduplication: Rabin-Karp hashes of every window of ``width`` words, counted over the whole corpus.

1. A task hashes all windows of its documents twice.  The second hash names a bucket, the first one is the window's key
   there.  Of equal windows inside a chunk of documents only the earliest goes on, so a passage that very many documents
   share leaves a chunk once; the others are known to repeat.  A chunk packs what goes on by bucket, sorted by key.
2. Each bucket finds the keys that occur more than once; every occurrence but the earliest (smallest id, then earliest
   start) is marked.  A large bucket is worked off in ranges of keys, so memory stays bounded.
3. Marks meet their document, overlapping windows merge into maximal intervals, and the covered words go.

Two windows count as equal when 64 bits of the key and the bucket's bits agree; the number of buckets grows with the input,
and with it the number of compared bits.
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import words as W
from palimpsest.llm.common import as_text, dealt, grouped, pieces, prepare, scan_bytes, text_buffer
from palimpsest.llm.exact import scratch

WIDTH = 20
#: Windows that a task packs at once, and windows of a bucket that are compared at once.
CHUNK_WINDOWS, RANGE_WINDOWS = 1 << 20, 2 << 20
MOST_BUCKETS = 1 << 16
_NULL_ID = (1 << 63) - 1
_ZSTD = "zstd"
_ROW = "bucket int, kind int, id bigint, tag bigint, size int, windows binary, content binary, gone boolean"
_PLACE = np.dtype([("doc", "<u4"), ("start", "<u4")])
_DOC = np.dtype([("id", "<i8"), ("tag", "<i8")])


def _packed(array: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, which compress well."""
    return np.ascontiguousarray(array.view(np.uint8).reshape(len(array), -1).T).tobytes()


def _unpacked(data: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(dtype).reshape(-1)


def _pack(keys: np.ndarray, places: np.ndarray, docs: np.ndarray) -> bytes:
    used, local = np.unique(places["doc"], return_inverse=True)
    places = places.copy()
    places["doc"] = local
    steps = np.diff(keys, prepend=np.uint64(0))
    raw = (np.array([len(keys), len(used)], "<u4").tobytes() + _packed(steps) + _packed(places["doc"].copy()) + _packed(places["start"].copy())
           + docs[used].tobytes())
    return _squeeze(raw)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = _restore(blob)
    n, d = np.frombuffer(raw[:8], "<u4").tolist()
    at = 8
    keys = np.cumsum(_unpacked(raw[at:at + 8 * n], "<u8"), dtype=np.uint64)
    doc = _unpacked(raw[at + 8 * n:at + 12 * n], "<u4")
    start = _unpacked(raw[at + 12 * n:at + 16 * n], "<u4")
    docs = np.frombuffer(raw[at + 16 * n:], _DOC)
    assert len(docs) == d
    return keys, docs["id"][doc], docs["tag"][doc], start


def _sorted(keys: np.ndarray, *then: np.ndarray) -> np.ndarray:
    """Order by key, and by the further arrays where keys are equal (few are, so only those are compared)."""
    order = np.argsort(keys)
    in_order = keys[order]
    tied = np.zeros(len(keys), bool)
    same = in_order[1:] == in_order[:-1]
    tied[1:] |= same
    tied[:-1] |= same
    some = order[tied]
    order[tied] = some[np.lexsort((*[a[some] for a in reversed(then)], keys[some]))]
    return order


def _squeeze(raw: bytes) -> bytes:
    return np.array([len(raw)], "<u8").tobytes() + pa.compress(raw, _ZSTD, asbytes=True)


def _restore(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], decompressed_size=int(np.frombuffer(blob[:8], "<u8")[0]), codec=_ZSTD, asbytes=True)


def _homes(ids: np.ndarray, tags: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket in which a document meets its marks."""
    return (W.mixed(W.mixed(ids.astype(np.uint64)) ^ tags.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def _marks(ids, tags, starts, buckets: int) -> Iterator[pa.RecordBatch]:
    """Marked windows packed by the bucket of their document."""
    if not len(ids):
        return
    homes = _homes(ids, tags, buckets)
    order = np.lexsort((starts, tags, ids, homes))
    homes, ids, tags, starts = homes[order], ids[order].astype("<i8"), tags[order].astype("<i8"), starts[order].astype("<u4")
    first = np.flatnonzero(np.r_[True, homes[1:] != homes[:-1]])
    for at in range(0, len(first), 512):
        part, last = first[at:at + 512], np.r_[first, len(ids)][at + 1:at + 513]
        blobs = [_squeeze(np.array([b - a], "<u8").tobytes() + _packed(ids[a:b]) + _packed(tags[a:b]) + _packed(starts[a:b])) for a, b in zip(part, last)]
        yield _batch(len(part), bucket=homes[part], kind=np.ones(len(part), np.int32), windows=blobs)


def _unmark(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = _restore(blob)
    n = int(np.frombuffer(raw[:8], "<u8")[0])
    return _unpacked(raw[8:8 + 8 * n], "<i8"), _unpacked(raw[8 + 8 * n:8 + 16 * n], "<i8"), _unpacked(raw[8 + 16 * n:], "<u4")


def _batch(n: int, **columns) -> pa.RecordBatch:
    kinds = {"bucket": pa.int32(), "kind": pa.int32(), "id": pa.int64(), "tag": pa.int64(), "size": pa.int32(), "windows": pa.binary(), "content": pa.binary(), "gone": pa.bool_()}
    columns.setdefault("kind", np.zeros(n, np.int32))
    return pa.RecordBatch.from_arrays([columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], kind) if c in columns
                                       else pa.nulls(n, kind) for c, kind in kinds.items()], names=list(kinds))


def _identify(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids (null last), a checksum of each text that tells rows with one id apart, and which ids are null."""
    gone = np.asarray(batch.column("id").is_null())
    ids = batch.column("id").fill_null(_NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)
    data, bounds = text_buffer(batch.column("text"))
    view = memoryview(np.ascontiguousarray(data))
    bounds = bounds.tolist()
    return ids, np.array([zlib.crc32(view[a:b]) for a, b in zip(bounds, bounds[1:])], np.int64), gone


def _window_task(width: int, buckets: int):
    bits = buckets.bit_length() - 1

    def flush(parts, docs):
        keys, names, places = (np.concatenate([p[i] for p in parts]) for i in range(3))
        docs = np.concatenate(docs)
        rank = np.empty(len(docs), np.int64)
        rank[np.lexsort((docs["tag"], docs["id"]))] = np.arange(len(docs))
        order = _sorted(keys, names, rank[places["doc"]], places["start"])
        keys, names, places = keys[order], names[order], places[order]
        again = np.zeros(len(keys), bool)
        again[1:] = (keys[1:] == keys[:-1]) & (names[1:] == names[:-1])
        # a row that repeats both id and text is the same occurrence, not a later one
        head = np.maximum.accumulate(np.where(again, 0, np.arange(len(keys))))
        own, lead = places[again], places[head[again]]
        twin = (docs[own["doc"]] == docs[lead["doc"]]) & (own["start"] == lead["start"])
        own = own[~twin]
        yield from _marks(docs["id"][own["doc"]], docs["tag"][own["doc"]], own["start"], buckets)
        keys, names, places = keys[~again], names[~again], places[~again]
        order = np.argsort(names, kind="stable")
        keys, names, places = keys[order], names[order], places[order]
        first = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
        rows = []
        for a, b in zip(first, np.r_[first[1:], len(names)]):
            rows.append((int(names[a]), b - a, _pack(keys[a:b], places[a:b], docs)))
            if len(rows) == 256:
                yield _batch(len(rows), bucket=[r[0] for r in rows], size=[r[1] for r in rows], windows=[r[2] for r in rows])
                rows = []
        if rows:
            yield _batch(len(rows), bucket=[r[0] for r in rows], size=[r[1] for r in rows], windows=[r[2] for r in rows])

    def work(batches):
        parts, docs, held, seen = [], [], 0, 0
        for batch in pieces(batches, "text"):
            ids, tags, _ = _identify(batch)
            data, bounds = text_buffer(batch.column("text"))
            starts, ends, first = W.spans(data, bounds)
            counts = np.maximum(np.diff(first) - width + 1, 0)
            if counts.sum():
                hashed = W.hashes(data, starts, ends)
                doc = np.repeat(np.arange(len(counts)), counts)
                start = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
                at = first[doc] + start
                # whole documents at once would need several arrays of their length; blocks of words overlap by one window
                keys, names = np.empty(len(hashed), np.uint64), np.empty(len(hashed), np.uint16 if bits <= 16 else np.uint32)
                for a in range(0, len(hashed) - width + 1, 1 << 18):
                    block = hashed[a:a + (1 << 18) + width - 1]
                    key, name = W.window_hashes(block, width), W.window_hashes(block, width, W.SECOND_BASE, 0x5851F42D4C957F2D)
                    keys[a:a + len(key)] = key
                    names[a:a + len(key)] = name >> np.uint64(64 - bits) if bits else 0
                place = np.empty(len(doc), _PLACE)
                place["doc"], place["start"] = doc + seen, start
                parts.append((keys[at], names[at], place))
                held += len(doc)
            pair = np.empty(len(ids), _DOC)
            pair["id"], pair["tag"] = ids, tags
            docs.append(pair)
            seen += len(ids)
            if held >= CHUNK_WINDOWS:
                yield from flush(parts, docs)
                parts, docs, held, seen = [], [], 0, 0
        if held:
            yield from flush(parts, docs)

    return work


def _repeat_task(buckets: int):
    """Per bucket: marks of every occurrence but the earliest of each key; marks of the chunks pass through."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, stream in grouped(batches, "bucket"):
            yield from bucket(stream)

    def bucket(stream):
        with tempfile.TemporaryFile(dir=scratch()) as file:
            sizes, total = [], 0
            for batch in stream:
                known = batch.filter(pc.equal(batch.column("kind"), 1))
                if known.num_rows:
                    yield known
                for blob, size in zip(batch.column("windows"), batch.column("size").to_pylist(), strict=True):
                    if size is not None:
                        sizes.append(file.write(blob.as_buffer()))
                        total += size
            ranges = max(1, -(-total // RANGE_WINDOWS))
            for number in range(ranges):
                low, high = (number << 64) // ranges, ((number + 1) << 64) // ranges
                file.seek(0)
                parts = []
                for size in sizes:
                    keys, ids, tags, starts = _unpack(file.read(size))
                    a, b = (0, len(keys)) if ranges == 1 else (np.searchsorted(keys, np.uint64(low)), len(keys) if high >> 64 else np.searchsorted(keys, np.uint64(high)))
                    parts.append((keys[a:b], ids[a:b], tags[a:b], starts[a:b]))
                if not parts:
                    continue
                keys, ids, tags, starts = (np.concatenate([p[i] for p in parts]) for i in range(4))
                order = _sorted(keys, ids, tags, starts)
                keys = keys[order]
                again = np.zeros(len(keys), bool)
                again[1:] = keys[1:] == keys[:-1]
                later, head = order[again], order[np.maximum.accumulate(np.where(again, 0, np.arange(len(keys))))[again]]
                twin = (ids[later] == ids[head]) & (tags[later] == tags[head]) & (starts[later] == starts[head])
                later = later[~twin]
                yield from _marks(ids[later], tags[later], starts[later], buckets)

    return work


def _content_task(buckets: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            ids, tags, gone = _identify(batch)
            data, bounds = text_buffer(batch.column("text"))
            view, bounds = memoryview(np.ascontiguousarray(data)), bounds.tolist()
            rows = [_squeeze(view[a:b]) if b > a else b"" for a, b in zip(bounds, bounds[1:])]
            yield _batch(len(ids), bucket=_homes(ids, tags, buckets), kind=np.full(len(ids), 2, np.int32), id=ids, tag=tags, content=rows, gone=gone)

    return work


def intervals(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal runs of words covered by windows that begin at ``starts``: first word and the word after the last."""
    starts = np.unique(starts)
    if not len(starts):
        return []
    heads = np.flatnonzero(np.r_[True, starts[1:] > starts[:-1] + width])
    tails = np.r_[heads[1:] - 1, len(starts) - 1]
    return list(zip(starts[heads].tolist(), (starts[tails] + width).tolist()))


def _cut_task(width: int):
    def out(rows):
        cut = pa.array([[{"first": a, "after": b} for a, b in r[2]] for r in rows], pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())])))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), cut,
                                           pa.array([r[3] for r in rows], pa.string())], names=["id", "n_words", "removed", "kept"])

    def work(batches):
        rows, held = [], 0
        for _, stream in grouped(batches, "bucket"):
            blobs, marks = [], None
            for batch in stream:
                kinds = batch.column("kind").to_pylist()
                blobs += [batch.column("windows")[at].as_py() for at, kind in enumerate(kinds) if kind == 1]
                contents = batch.column("content")
                for at, (kind, id_, tag, gone) in enumerate(zip(kinds, *[batch.column(c).to_pylist() for c in ("id", "tag", "gone")], strict=True)):
                    if kind == 1:
                        continue
                    if marks is None:  # marks sort before contents
                        marks, blobs = _by_document(blobs), []
                    blob = contents[at].as_py()
                    text = _restore(blob) if blob else b""
                    found, cut = text.split(), []
                    kept = found
                    if (id_, tag) in marks:
                        cut, kept, last = intervals(marks[id_, tag], width), [], 0
                        for a, b in cut:
                            kept += found[last:a]
                            last = b
                        kept += found[last:]
                    text = b" ".join(kept)
                    rows.append((None if gone else id_, len(found), cut, text))
                    held += len(text)
                    if held > 4 << 20 or len(rows) >= 1000:
                        yield out(rows)
                        rows, held = [], 0
        if rows:
            yield out(rows)

    return work


def _by_document(blobs: list[bytes]) -> dict[tuple[int, int], np.ndarray]:
    if not blobs:
        return {}
    parts = [_unmark(blob) for blob in blobs]
    ids, tags, starts = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((tags, ids))
    ids, tags, starts = ids[order], tags[order], starts[order]
    first = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])])
    last = np.r_[first[1:], len(ids)]
    return {(i, t): starts[a:b] for i, t, a, b in zip(ids[first].tolist(), tags[first].tolist(), first.tolist(), last.tolist())}


def drop_repeated_passages(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH) -> DataFrame:
    """One row for each row: ``id, n_words, removed, kept``.

    ``removed`` lists the maximal intervals of words (first, word after the last) covered by windows of ``width`` words
    that also start earlier: at a smaller id (null ids last) or earlier in the same document.  Windows are judged on
    the input.  ``kept`` is the text of the other words, joined by single spaces.  Null, empty and short texts have no window
    and lose nothing.  Rows that repeat an id are told apart by their text; rows that repeat both are one document, so
    neither loses words to the other.  An empty table gives an empty result; other columns are ignored.
    """
    prepare(df.sparkSession)
    rows = df.select(F.col(id_column).cast("long").alias("id"), as_text(F.col(text_column)).alias("text"))
    # about a million windows a bucket: compressed text has a word for every four bytes
    buckets = min(MOST_BUCKETS, 1 << max(4, (scan_bytes(rows) // (4 << 20)).bit_length()))
    windows = rows.mapInArrow(_window_task(width, buckets), _ROW)
    marks = dealt(windows, None, "bucket").mapInArrow(_repeat_task(buckets), _ROW)
    contents = rows.mapInArrow(_content_task(buckets), _ROW)
    needed = ["bucket", "kind", "id", "tag", "windows", "content", "gone"]
    met = dealt(contents.select(needed).unionByName(marks.select(needed)), None, "bucket", order=("kind",))
    return met.mapInArrow(_cut_task(width), "id bigint, n_words bigint, removed array<struct<first:bigint,after:bigint>>, kept string")
