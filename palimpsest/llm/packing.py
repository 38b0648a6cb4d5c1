"""Lexical retrieval packing: sequences of related documents, filled from BM25 neighbours.

Documents are dealt to shards by hash; each shard tokenises its texts, indexes them and packs them on its own, so
neither an index nor a decision ever covers more than one shard's bounded part of the corpus.  In a shard the next
unused document seeds a sequence.  The inverted index returns its unused neighbours by BM25 score, and they fill the
window greedily; the last one is cut, and its rest seeds the next sequence.  What is left at the end of a shard is cut
into sequences whose lengths are powers of two, so nothing is padded.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import as_text, grouped, pieces, prepare, text_buffer

WINDOW, END_ID = 4096, 2
#: Bytes of text in a shard, about; the number of shards follows from the bytes of the whole table.
SHARD_BYTES = 24 << 20
#: Tasks at most; with more shards a task packs several, one after another.
MOST_TASKS = 1 << 16
#: Terms a seed asks with, the rarest first; None: all that another document holds.
QUERY_TERMS = None
#: Terms that more than one in so many documents hold have a dense row of weights.
DENSE = 8
#: Best neighbours that are sorted first; more are sorted when these do not fill the window.
FIRST = 64
K1, B = 1.2, 0.75
#: Bytes of text that are encoded at once.
ENCODED_BYTES = 1 << 20
# white space, printable ASCII and the bytes of the letters from U+00C0 to U+023F, which are their own composed form
_PLAIN_BYTES = bytes([*range(0x09, 0x0E), *range(0x20, 0x7F), *range(0x80, 0xC0), *range(0xC3, 0xC9)])
# runs of such texts in lower case; letters reach to U+02AF then, and two lie beyond
_RUNS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u02af\u2c65\u2c66]+|[0-9]|(?:[^\\w\\s\0]|_)+|\0")
_SPACE, _LETTER, _DIGIT, _SIGN, _BETWEEN = range(5)
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[[*range(0x09, 0x0E), 0x20]] = _SPACE
_CLASS[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = _LETTER
_CLASS[ord("0"):ord("9") + 1] = _DIGIT
_CLASS[0] = _BETWEEN
# characters of several bytes that are no letters
_ODD = ("\u00d7".encode(), "\u00f7".encode(), "\u0307".encode())


def runs_apart(text: bytes) -> str:
    """A plain Latin text in lower case with a space after each run; zero bytes between texts are runs of their own."""
    if any(odd in text for odd in _ODD):
        return " ".join(_RUNS.findall(text.decode())) + " "
    data = np.frombuffer(text, np.uint8)
    kind = _CLASS[data]
    start = np.zeros(len(data) + 3, bool)
    last, this = kind[:-1], kind[1:]
    start[1:len(data)] = ((this != last) & (this != _SPACE) & (last != _SPACE)) | ((this == last) & ((this == _DIGIT) | (this == _BETWEEN)))
    # an apostrophe that begins a run of signs may begin a contraction instead
    mark = np.flatnonzero(data == ord("'"))
    mark = mark[(mark == 0) | (kind[mark - 1] != _SIGN)]
    after = np.append(data, np.zeros(2, np.uint8))
    first, second = after[mark + 1], after[mark + 2]
    short = np.isin(first, np.frombuffer(b"stmd", np.uint8))
    long = (((first == ord("r")) | (first == ord("v"))) & (second == ord("e"))) | ((first == ord("l")) & (second == ord("l")))
    start[mark[short | long] + 1] = False
    kinds = np.append(kind, np.zeros(3, np.uint8))
    ends = np.concatenate([mark[short] + 2, mark[long] + 3])
    start[ends[kinds[ends] == _LETTER]] = True
    spaced = np.insert(np.where(kind == _SPACE, np.uint8(0x20), data), np.flatnonzero(start[:len(data)]), np.uint8(0x20))
    return spaced.tobytes().decode() + " "


_END_OF_RUN = "</w>"


def _byte_letters() -> dict[str, int]:
    """The byte of each letter of the byte-level alphabet: printable Latin-1 bytes stand for themselves, the others are numbered on from 256."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in plain)
    return {**{chr(b): b for b in plain}, **{chr(256 + n): b for n, b in enumerate(others)}}


_encoders: dict[str, WordEncoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of a text by the public word tokenizer, exactly as ``tokenizers`` gives them for the whole text.

    That tokenizer drops white space, lower-cases, splits words into runs of letters, single digits and runs of other signs, and
    encodes each alone.  Runs of plain Latin texts are encoded by ranks of byte strings, many texts at once: a run ends in a space, and last byte and space form the first merge, as the end-of-word mark does.  Merging
    by the rank of the joined string equals merging by listed pairs if a token's own string encodes to it, since merges inside a token's span
    depend on that span only; tokens that do not encode to themselves are never made and have no rank.  In other texts the words beyond
    plain Latin letters go to the whole tokenizer.  Texts that hold a special token's string go there whole and, with another tokenizer
    that does not work like this, all texts do.  Nothing is kept from one call to the next.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as file:
            self.ranked = self._ranks(json.load(file)["model"])
        probe = "One two's, three.\n\té ÀSS ß1_2! don't 42% ñ***x".encode()
        self.by_word = self.ranked is not None and self.whole(probe) == self.ranked_ids([probe])[0]

    def _ranks(self, model: dict):
        """(ranked encoder, id of each rank, rank of a zero byte's run), or None where the model is of another kind."""
        if model.get("type") != "BPE" or model.get("end_of_word_suffix") != _END_OF_RUN or model.get("continuing_subword_prefix"):
            return None
        from tokenizers.models import BPE
        letters, vocabulary = _byte_letters(), model["vocab"]

        def raw(token: str) -> bytes:
            ends = token.endswith(_END_OF_RUN)
            return bytes([letters[c] for c in (token[:-len(_END_OF_RUN)] if ends else token)]) + (b" " if ends else b"")

        firsts = [c + end for end in ("", _END_OF_RUN) for c in letters]
        if any(token not in vocabulary for token in firsts):
            return None
        ids = {raw(token): vocabulary[token] for token in firsts}
        pairs = [tuple(pair if isinstance(pair, list) else pair.split(" ")) for pair in model["merges"]]
        open_ended = BPE(vocab=vocabulary, merges=pairs)  # without an end mark
        for token in map("".join, pairs):
            ends = token.endswith(_END_OF_RUN)
            own = self.tokenizer.model.tokenize(token.removesuffix(_END_OF_RUN)) if ends else open_ended.tokenize(token)
            if [t.id for t in own] == [vocabulary[token]]:
                ids.setdefault(raw(token), vocabulary[token])
        ranks = {token: rank for rank, token in enumerate(ids)}
        core = tiktoken.Encoding("runs", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        return core, np.fromiter(ids.values(), "<u4", len(ids)), ranks[b"\0 "]

    def whole(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def ranked_ids(self, texts: list[bytes]) -> list[bytes]:
        """Ids of plain Latin texts."""
        core, ids, between = self.ranked
        blob = b"\0".join([*texts, b""]).decode().lower().encode()
        found = np.array(core.encode_ordinary(runs_apart(blob)), np.int64)
        ends = np.flatnonzero(found == between) * 4
        data = ids[found].tobytes()
        return [data[a:b] for a, b in zip([0, *(ends[:-1] + 4).tolist()], ends.tolist())]

    def mixed(self, text: bytes) -> bytes:
        """Ids of a text with other characters, each distinct word encoded once."""
        words = text.split()  # of bytes: at 0x20 and 0x09-0x0D only
        distinct = set(words)
        plain = [w for w in distinct if not w.translate(None, _PLAIN_BYTES)]
        own = dict(zip(plain, self.ranked_ids(plain))) if plain else {}
        own.update((w, self.whole(w)) for w in distinct if w not in own)
        return b"".join(map(own.__getitem__, words))

    def many(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        cut = [self.by_word and not any(s in t for s in self.special) for t in texts]
        plain = [n for n, t in enumerate(texts) if cut[n] and not t.translate(None, _PLAIN_BYTES)]
        ranked = dict(zip(plain, self.ranked_ids([texts[n] for n in plain]))) if plain else {}
        return [ranked[n] if n in ranked else self.mixed(t) if cut[n] else self.whole(t) for n, t in enumerate(texts)]

    def ids(self, text: bytes) -> bytes:
        return self.many([text])[0]


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class Index:
    """BM25 over the documents of one shard: for each term the documents that hold it with their weights."""

    def __init__(self, docs: list[np.ndarray]):
        sizes = np.array([len(d) for d in docs], np.int64)
        average = max(sizes.mean(), 1.0) if len(docs) else 1.0
        terms, owners, counts = [], [], []
        for number, doc in enumerate(docs):
            term, count = np.unique(doc[:-1], return_counts=True)
            terms.append(term)
            counts.append(count)
            owners.append(np.full(len(term), number, np.int32))
        self.own = terms
        term, owner, count = (np.concatenate(x) if docs else np.zeros(0, np.int64) for x in (terms, owners, counts))
        order = np.argsort(term, kind="stable")
        self.owner = owner[order]
        self.starts = np.searchsorted(term[order], np.arange(int(term.max()) + 2 if len(term) else 1))
        held = np.diff(self.starts)
        self.rarity = np.log(1 + (len(docs) - held + 0.5) / (held + 0.5)).astype(np.float32)
        self.held = held
        count = count[order].astype(np.float32)
        norm = (K1 * (1 - B + B * sizes / average)).astype(np.float32)
        self.weight = count * np.float32(K1 + 1) / (count + norm[self.owner]) * np.repeat(self.rarity, held)
        common = np.flatnonzero(held * DENSE > max(len(docs), 64))
        self.row = np.full(len(held), -1, np.int64)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), len(docs)), np.float32)
        for row, t in zip(self.dense, common):
            span = slice(self.starts[t], self.starts[t + 1])
            row[self.owner[span]] = self.weight[span]

    def scores(self, number: int, size: int) -> np.ndarray | None:
        """BM25 of all documents for all terms of the seed that another document holds."""
        terms = self.own[number]
        terms = terms[self.held[terms] > 1]  # the others are the seed's alone
        if QUERY_TERMS is not None and len(terms) > QUERY_TERMS:
            terms = terms[np.lexsort((terms, self.held[terms]))[:QUERY_TERMS]]
        if not len(terms):
            return None
        rows = self.row[terms]
        asked = np.zeros(len(self.dense), np.float32)
        asked[rows[rows >= 0]] = 1
        total = (asked @ self.dense).astype(np.float64)
        terms = terms[rows < 0]
        if len(terms):
            held = self.held[terms]
            shift = np.cumsum(held) - held
            place = np.repeat(self.starts[terms] - shift, held) + np.arange(int(held.sum()))
            total += np.bincount(self.owner[place], self.weight[place], size)
        return total

    def neighbours(self, number: int, used: np.ndarray) -> Iterator[int]:
        """Unused documents that share a term with the seed, best score over all of its terms first, then by position."""
        total = self.scores(number, len(used))
        if total is None:
            return
        found = np.flatnonzero((total > 0) & ~used)
        value = total[found]
        if len(found) > FIRST:
            least = np.partition(value, len(found) - FIRST)[len(found) - FIRST]
            best = np.flatnonzero(value >= least)
            yield from found[best[np.argsort(-value[best], kind="stable")]].tolist()
            found, value = found[value < least], value[value < least]
        yield from found[np.argsort(-value, kind="stable")].tolist()


def pack(docs: list[np.ndarray], window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` that hold every id of ``docs`` once.

    All sequences have ``window`` ids but the last ones, whose lengths are powers of two.  Documents with equal ids come into different
    sequences while others are left.
    """
    index, used = Index(docs), np.zeros(len(docs), bool)
    left, sequence, filled = int(sum(len(d) for d in docs)), 0, 0
    room = min(window, 1 << (left.bit_length() - 1)) if left else 0
    queue: list[tuple[int, int]] = []
    content = [hashlib.blake2b(d.tobytes(), digest_size=16).digest() for d in docs]
    waiting: dict[bytes, list[int]] = {}
    for number in range(len(docs) - 1, -1, -1):
        waiting.setdefault(content[number], []).append(number)
    waiting = dict(reversed(waiting.items()))  # groups of equal documents, each in its order from the end
    inside: set[bytes] = set()

    def take(number: int) -> tuple[int, int]:
        key = content[number]
        used[number] = True
        inside.add(key)
        own = waiting[key]
        while own and used[own[-1]]:
            own.pop()
        if not own:
            del waiting[key]
        return number, 0

    while left:
        if not queue:
            key = next((k for k in waiting if k not in inside), None) or next(iter(waiting))
            queue = [take(waiting[key][-1])]
        number, start = queue.pop()
        taken = min(len(docs[number]) - start, room - filled)
        yield number, start, taken, sequence, filled
        seed, left, filled = number, left - taken, filled + taken
        if start + taken < len(docs[number]):
            queue.append((number, start + taken))
        if filled == room:
            sequence, filled = sequence + 1, 0
            room = min(window, 1 << (left.bit_length() - 1)) if left else 0
            inside = {content[n] for n, _ in queue}
        elif not queue:
            need, chosen = room - filled, []
            for other in index.neighbours(seed, used):
                if content[other] in inside:
                    continue
                chosen.append(take(other))
                need -= len(docs[other])
                if need <= 0:
                    break
            queue = chosen[::-1]


_PIECE = ("id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")


def _pack_task(path: str, window: int, end_id: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for shard, stream in grouped(batches, "shard"):
            ids, docs, kind = [], [], None
            for batch in stream:
                kind = batch.schema.field("id").type
                for part in pieces(iter([batch]), "text", ENCODED_BYTES):
                    ids += part.column("id").to_pylist()
                    data, bounds = text_buffer(part.column("text"))
                    data, bounds = data.tobytes(), bounds.tolist()
                    docs += [np.frombuffer(x + end, "<u4") for x in encode.many([data[a:b] for a, b in zip(bounds, bounds[1:])])]
            rows = list(pack(docs, window))
            for first in range(0, len(rows), 10_000):
                part = rows[first:first + 10_000]
                number, start, length, sequence, offset = (list(c) for c in zip(*part))
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[n] for n in number], kind), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                    pa.array([zlib.crc32(docs[n][a:a + c]) for n, a, c in zip(number, start, length)], pa.int64()),
                    pa.array([len(docs[n]) for n in number], pa.int64()), pa.array([(shard << 32) + s for s in sequence], pa.int64()),
                    pa.array(offset, pa.int64())], names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return work


def retrieval_packs(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, end_id: int = END_ID,
                    tokenizer: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Pieces of all rows: ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A row's ids are those of its text (null: none) and ``end_id``; each lies in exactly one piece.  Sequences have ``window`` ids, or a
    power of two where a shard ends.  Rows that repeat an id or all columns are packed each.  An empty table gives an empty
    result; other columns are ignored.  Shards are drawn by hash of id and text, so copies of a text under one id share a shard
    and others are dealt evenly.
    """
    prepare(df.sparkSession)
    kind = dict(df.dtypes)[id_column]
    rows = df.select(F.col(id_column).alias("id"), as_text(F.col(text_column)).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long") + 64)).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    place = F.pmod(F.xxhash64("id", F.length("text")), F.lit(shards))
    order = F.xxhash64("id", "text")
    shard = rows.withColumns({"shard": place, "order": order})
    # a task takes whole shards, and all tasks alike many
    tasks = min(shards, MOST_TASKS)
    return (shard.repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int")).sortWithinPartitions("shard", "order", "id").drop("order")
            .mapInArrow(_pack_task(tokenizer or default_tokenizer(), window, end_id), _PIECE.format(kind=kind)))


def lengths_of(pieces_of: DataFrame) -> DataFrame:
    """Ids in each sequence, for reports of padding."""
    return pieces_of.groupBy("sequence_id").agg(F.sum("length").alias("length"))
