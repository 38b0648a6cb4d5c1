"""Alignment of two tokenizers over distinct texts.

Rows are shuffled by their full text, so each distinct text is tokenised and aligned once and carries the number of its copies.  Where a
token of either tokenizer ends at the same byte, the text is cut; tokens between two cuts form a group and all A-B pairs of a group are
linked.  A task keeps the distinct pairs of a block of texts with the documents that hold them, so what is counted corpus-wide and
what comes back to a block is one row a block and pair, never one an occurrence, and a pair that every text holds is no hot key.
Measures of a text are joined to the documents that hold it by the SHA-256 of the text.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.common import grouped, pieces, prepare, text_buffer
from palimpsest.session import shared_folder

#: Bytes of text aligned at once; distinct pairs of a block, about; words whose ids a worker keeps.
STEP_BYTES, BLOCK_PAIRS, KEPT_WORDS = 2 << 20, 1 << 19, 200_000
#: Groups with more links are counted by distinct ids instead of being listed.
LISTED_LINKS = 4096
# assigned white space, letters, digits and signs that have had one class in every Unicode version the two splitters may follow
_OTHER = re.compile("[^\t-\r -~¡-ɏ‐-‧]")

_MARK = ("kind int, block bigint, digest binary, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
         "pairs array<bigint>, weights array<bigint>")
_MEASURE = "digest binary, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _paths(byte_tokenizer: str | None, piece_tokenizer: str | None, byte_ranks: str | None) -> tuple[str, str, str]:
    import public_tokenizers as public
    return (byte_tokenizer or public.path("byte_bpe_50k.json"), piece_tokenizer or public.path("piece_bpe_32k.model"), byte_ranks or public.path("byte_bpe_50k.tiktoken"))


def _letter_bytes() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for their own byte, the other bytes are numbered on from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


class ByteTokens:
    """A: ids of a byte-level vocabulary, and the bytes of each id.

    The same vocabulary as ranks gives the same ids several times faster where both split the text alike; texts with characters that
    they may class differently go to the tokenizer itself.
    """

    def __init__(self, path: str, ranks: str):
        import public_tokenizers as public
        import tiktoken
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters = _letter_bytes()
        self.bytes = [b""] * self.tokenizer.get_vocab_size(with_added_tokens=True)
        for token, number in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.bytes[number] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        with open(ranks, "rb") as lines:
            known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.ranked = tiktoken.Encoding("ranks", pat_str=public.PATTERN, mergeable_ranks=known, special_tokens={})
        probe = " One two's, three.\n\té ÀSS ß1_2! don't  42%   ñ***x\n\n <|endoftext|> “a” – 12345 "
        self.alike = all(self.bytes[n] == b for b, n in known.items()) and self.whole(probe) == self.ranked.encode_ordinary(probe)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> list[int]:
        return self.ranked.encode_ordinary(text) if self.alike and not _OTHER.search(text) else self.whole(text)


class PieceTokens:
    """B: ids of a sentence-piece model, which puts a space before the text, and the bytes of each id.

    If no piece holds a space behind another character, no piece crosses a space that ends a word, and ids are kept by word.
    """

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(name[3:5], 16)]) if self.model.is_byte(i) else name.replace("▁", " ").encode() for i, name in enumerate(names)]
        self.known: dict[str, list[int]] = {}
        probe = "One two's, three.\n\té ÀSS ß1_2! don't 42% ñ***x"
        self.by_word = not any("▁" in name.lstrip("▁") for name in names) and sum(map(self.model.encode, probe.split(" ")), []) == self.model.encode(probe)

    def ids(self, text: str) -> list[int]:
        words = text.split(" ")
        if not self.by_word or "" in words or "▁" in text:
            return self.model.encode(text, num_threads=1)
        out, known = [], self.known
        for word in words:
            if (found := known.get(word)) is None:
                if len(known) >= KEPT_WORDS:
                    known.clear()
                found = self.model.encode(word, num_threads=1)
                if len(word) < 64:
                    known[word] = found
            out += found
        return out


@functools.cache
def _tokens(byte_path: str, piece_path: str, ranks: str) -> tuple[ByteTokens, PieceTokens]:
    return ByteTokens(byte_path, ranks), PieceTokens(piece_path)


def _steps(sizes: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each n in ``sizes``, one after another."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Aligned:
    """Groups and links of a run of texts; only texts that both tokenizers give back byte for byte take part."""

    def __init__(self, texts: list[bytes], a: ByteTokens, b: PieceTokens):
        ids_a, ids_b, ends, self.good = [], [], [], []
        for number, raw in enumerate(texts):
            text = raw.decode("utf-8", "replace")
            full = b" " + raw
            own_a, own_b = a.ids(" " + text), b.ids(text)
            if raw and b"".join([a.bytes[i] for i in own_a]) == full and b"".join([b.bytes[i] for i in own_b]) == full:
                ids_a.append(own_a)
                ids_b.append(own_b)
                ends.append(len(full))
                self.good.append(number)
        count = len(self.good)
        self.n_a, self.n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        self.a, self.b = (np.fromiter((i for x in ids for i in x), np.int64, int(n.sum())) for ids, n in ((ids_a, self.n_a), (ids_b, self.n_b)))
        ends_a, ends_b = (np.cumsum(np.array([len(t) for t in table], np.int64)[ids]) if len(ids) else np.zeros(0, np.int64) for table, ids in ((a.bytes, self.a), (b.bytes, self.b)))
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        self.group_a, self.group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        self.in_a, self.in_b = np.bincount(self.group_a, minlength=len(cuts)), np.bincount(self.group_b, minlength=len(cuts))
        self.text = np.searchsorted(np.cumsum(ends), cuts) if count else np.zeros(0, np.int64)
        self.n_groups = np.bincount(self.text, minlength=count)
        self.n_links = np.bincount(self.text, self.in_a * self.in_b, count).astype(np.int64)
        self.wide = len(b.bytes)

    def digests(self, names: list[bytes]) -> list[str]:
        """SHA-256 of each text's groups, the ids in decimal; ``names`` from :func:`_names`."""
        last_a = np.r_[self.group_a[1:] != self.group_a[:-1], True] if len(self.a) else np.zeros(0, bool)
        last_b = np.r_[self.group_b[1:] != self.group_b[:-1], True] if len(self.b) else np.zeros(0, bool)
        before_b, upto_a = np.cumsum(self.in_b) - self.in_b, np.cumsum(self.in_a)
        order = np.empty(len(self.a) + len(self.b), np.int64)
        order[np.arange(len(self.a)) + before_b[self.group_a]] = self.a * 2 + last_a
        base = len(names) - 2 * self.wide
        order[np.arange(len(self.b)) + upto_a[self.group_b]] = base + self.b * 2 + last_b
        bounds = np.r_[0, np.cumsum(self.n_a + self.n_b)].tolist()
        return [hashlib.sha256(b"".join([names[i] for i in order[s:e].tolist()])[:-1]).hexdigest() for s, e in zip(bounds, bounds[1:])]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, pair and number of links of each text's distinct pairs, sorted."""
        links = self.in_a * self.in_b
        first_a, first_b = np.cumsum(self.in_a) - self.in_a, np.cumsum(self.in_b) - self.in_b
        few = np.flatnonzero(links <= LISTED_LINKS)
        each = links[few]
        step, wide = _steps(each), np.repeat(self.in_b[few], each)
        a, b = self.a[np.repeat(first_a[few], each) + step // wide], self.b[np.repeat(first_b[few], each) + step % wide]
        text, pair, weight = np.repeat(self.text[few], each), a * self.wide + b, np.ones(len(a), np.int64)
        for group in np.flatnonzero(links > LISTED_LINKS):
            (own_a, times_a), (own_b, times_b) = (np.unique(ids[f[group]:f[group] + n[group]], return_counts=True) for ids, f, n in ((self.a, first_a, self.in_a), (self.b, first_b, self.in_b)))
            text = np.r_[text, np.full(len(own_a) * len(own_b), self.text[group])]
            pair = np.r_[pair, (own_a[:, None] * self.wide + own_b[None, :]).ravel()]
            weight = np.r_[weight, (times_a[:, None] * times_b[None, :]).ravel()]
        if (weight == 1).all():  # the usual case needs one sort of one number
            top = int(pair.max(initial=0)) + 1
            both, weight = np.unique(text * top + pair, return_counts=True)
            return both // top, both % top, weight
        order = np.lexsort((pair, text))
        text, pair, weight = text[order], pair[order], weight[order]
        new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (pair[1:] != pair[:-1])])
        return text[new], pair[new], np.add.reduceat(weight, new)


def _names(a: int, b: int) -> list[bytes]:
    """Decimal ids with what follows them: of A inside and at the end of its side, then of B likewise."""
    return [f"{i}{end}".encode() for count, ends in ((a, ",|"), (b, ",;")) for i in range(count) for end in ends]


def _sum_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(values, new) if len(keys) else values


def _lists(bounds: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int64()))


def _mark_task(paths: tuple[str, str, str], block_pairs: int):
    """Rows of kind 1 for texts and, for each block of them, rows of kind 0 with its distinct pairs and the documents that hold them."""
    names = [c.split()[0] for c in _MARK.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _tokens(*paths)
        decimal = _names(len(a.bytes), len(b.bytes))
        block = TaskContext.get().partitionId() << 32
        keys, held = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def dictionary():
            # a few rows, so that no list grows long
            bounds = np.r_[np.arange(0, len(keys), 4096), len(keys)]
            rows = len(bounds) - 1
            return pa.RecordBatch.from_arrays([pa.array([0] * rows, pa.int32()), pa.array([block] * rows, pa.int64()), pa.nulls(rows, pa.binary()), *[pa.nulls(rows, pa.int64())] * 4,
                                               pa.nulls(rows, pa.string()), _lists(bounds, keys), _lists(bounds, held)], names=names)

        for batch in pieces(batches, "text", STEP_BYTES):
            data, bounds = text_buffer(batch.column("text"))
            data, bounds = data.tobytes(), bounds.tolist()
            found = Aligned([data[s:e] for s, e in zip(bounds, bounds[1:])], a, b)
            if not found.good:
                continue
            text, pair, weight = found.pairs()
            copies = batch.column("copies").to_numpy()[found.good]
            keys, held = _sum_by(np.r_[keys, pair], np.r_[held, copies[text]])
            rows = len(found.good)
            cuts = np.searchsorted(text, np.arange(rows + 1))
            yield pa.RecordBatch.from_arrays([
                pa.array([1] * rows, pa.int32()), pa.array([block] * rows, pa.int64()), batch.column("digest").take(pa.array(found.good)),
                *[pa.array(x, pa.int64()) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)], pa.array(found.digests(decimal)), _lists(cuts, pair), _lists(cuts, weight)], names=names)
            if len(keys) >= block_pairs:
                yield dictionary()
                block, keys, held = block + 1, keys[:0], held[:0]
        if len(keys):
            yield dictionary()

    return work


def _measure_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the links of each text; a block's pairs with their counts come before its texts."""
    for _, stream in grouped(batches, "block"):
        held, table = [], None
        for batch in stream:
            kind = batch.column("kind").to_numpy()
            if (kind == 0).any():
                own = batch.filter(pa.array(kind == 0))
                held.append([own.column(c).to_numpy() for c in ("pair", "count", "best")])
            batch = batch.filter(pa.array(kind == 1))
            if not batch.num_rows:
                continue
            if table is None:
                table = [np.concatenate(c) for c in zip(*held)]
                order = np.argsort(table[0])
                table = [c[order] for c in table]
                held.clear()
            sizes = np.asarray(batch.column("pairs").value_lengths())
            place = np.searchsorted(table[0], batch.column("pairs").flatten().to_numpy())
            weight = batch.column("weights").flatten().to_numpy()
            text = np.repeat(np.arange(len(sizes)), sizes)
            total, best = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            np.add.at(total, text, weight * table[1][place])
            np.add.at(best, text, weight * (table[1][place] == table[2][place]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("digest", "n_a", "n_b", "n_groups", "n_links")], pa.array(best), pa.array(total), batch.column("groups_sha256")],
                                             names=[c.split()[0] for c in _MEASURE.split(", ")])


def alignments(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", byte_tokenizer: str | None = None, piece_tokenizer: str | None = None,
               byte_ranks: str | None = None, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of each row.

    A encodes a space and the text, B the text, before which it puts a space itself.  ``count_sum`` adds the counts of a text's links, where the
    count of a pair of ids is the number of rows that hold it linked; ``n_best`` are the links whose count is the highest of all
    pairs of their A id, ties included.  Null and empty texts, and texts that either tokenizer does not give back byte for byte, have zeros
    and an empty digest.  Rows that repeat an id or a text count each.  Texts of any length are read whole.  An empty table gives an empty
    result; other columns are ignored.
    """
    spark = prepare(df.sparkSession)
    paths = _paths(byte_tokenizer, piece_tokenizer, byte_ranks)
    rows = df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")
    texts = rows.where(F.octet_length("text") > 0).groupBy("text").agg(F.count("*").alias("copies")).select("text", "copies", digest)
    folder = f"{shared_folder(spark).rstrip('/')}/alignment-{uuid.uuid4().hex}"
    texts.mapInArrow(_mark_task(paths, block_pairs), _MARK).write.option("compression", "zstd").partitionBy("kind").parquet(folder)
    found = spark.read.schema(_MARK).parquet(folder)
    in_block = found.where("kind = 0").select("block", F.explode(F.arrays_zip("pairs", "weights")).alias("p")).select("block", F.col("p.pairs").alias("pair"), F.col("p.weights").alias("held"))
    counts = in_block.groupBy("pair").agg(F.sum("held").alias("count"))
    # a window holds the pairs of one A id, at most as many as B has ids
    counts = counts.withColumn("best", F.max("count").over(Window.partitionBy(F.floor(F.col("pair") / F.lit(_pieces_of(paths))))))
    back = in_block.select("block", "pair").join(counts, "pair").select("block", F.lit(0).alias("kind"), "pair", "count", "best")
    marks = found.where("kind = 1").drop("kind").withColumn("kind", F.lit(1))
    both = back.unionByName(marks, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "kind")
    measures = both.mapInArrow(_measure_task, _MEASURE)
    zero = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    return (rows.select("id", F.when(F.octet_length("text") > 0, digest).alias("digest")).join(measures, "digest", "left")
            .select("id", *map(zero, ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")))


def _pieces_of(paths: tuple[str, str, str]) -> int:
    return len(_tokens(*paths)[1].bytes)
