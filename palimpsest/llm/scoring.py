"""Document scores by masked pseudo-likelihood.

A window network predicts every token from the ``REACH`` tokens on both sides of it.  Position-specific embeddings of the
neighbours add up to a hidden layer; a two-level softmax gives the class of the token and the token in its class.  The sum
of the log-probabilities of all tokens of a text, each given its neighbours, is the text's score.

1. Words of all documents are counted; the most frequent ones are the vocabulary, ordered by count and dealt to
   classes of equal size.  Its size grows with the root of the number of distinct words.  Rarer words share slots by their
   last letters and length, and a rare word has its share of its slot's count as its probability in the slot.
2. The network is trained in numpy, data-parallel over the whole corpus: in each round every task walks over its own
   documents from the common state and returns its parameters; these are averaged in Spark, slice by slice, weighted
   by trained positions.  A round trains every ``ROUNDS``-th position of every document, the next one each round, so that
   the rounds together train every position once.
3. Every token of every document is scored.  Counts of the most frequent words are at hand in every task; the others are
   joined to the documents that hold them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import words as W
from palimpsest.llm.common import as_text, grouped, pieces, prepare, text_buffer, written

#: Least size of the network's output; both grow with the vocabulary.
CLASSES, MEMBERS = 32, 32
#: Slots of the vocabulary for rare words; slot 0 of all is the border of a text.
RARE = 128
REACH, HIDDEN = 3, 32
ROUNDS = 2
#: Words whose counts every task holds.
KNOWN = 1 << 20
#: Words of a shard, about: what one local model of a round learns from.  Their number follows from the counted words.
SHARD_WORDS = 5_000_000
#: Tasks of a round at most; with more shards a task trains several, one after another.
MOST_TASKS = 1 << 16
BATCH, RATE = 2048, 5.0
#: Longest step of a batch in the class layer, and in the bias of the hidden layer.  Longer ones come only before training runs away.
LONGEST = 4.0
SCORED = 8192
_SLICE = 16384


class Network:
    """Parameters in one flat array: neighbour embeddings, class layer, member layers; the last row of a layer is its bias."""

    def __init__(self, flat: np.ndarray | None = None, classes: int = CLASSES, members: int = MEMBERS):
        self.classes, self.members = classes, members
        shapes = self.shapes(classes, members)
        if flat is None:
            flat = np.random.default_rng(5).standard_normal(sum(map(math.prod, shapes.values()))).astype(np.float32) * np.float32(0.1)
            layers = flat[-math.prod(shapes["inner"]):]  # drawn before all their biases
            weights, biases = np.split(layers, [-classes * members])
            layers[:] = np.concatenate([weights.reshape(classes, HIDDEN, members), biases.reshape(classes, 1, members)], 1).ravel()
        self.flat, at = flat, 0
        for name, shape in shapes.items():
            size = math.prod(shape)
            setattr(self, name, flat[at:at + size].reshape(shape))
            at += size
        self.group, self.group_bias, self.member, self.member_bias = self.outer[:-1], self.outer[-1], self.inner[:, :-1], self.inner[:, -1]

    @staticmethod
    def shapes(classes: int, members: int) -> dict[str, tuple[int, ...]]:
        return {"near": (2 * REACH, classes * members, HIDDEN), "bias": (HIDDEN,), "outer": (HIDDEN + 1, classes), "inner": (classes, HIDDEN + 1, members)}

    def hidden(self, around: np.ndarray) -> np.ndarray:
        total, part = np.repeat(self.bias[None, :], len(around), 0), np.empty((len(around), HIDDEN), np.float32)
        for near, token in zip(self.near, around.T):
            total += near.take(token, 0, out=part, mode="clip")
        return np.tanh(total, out=total)

    def _by_class(self, target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
        """An order of the positions by the class of their token, and the places of each class that occurs in it."""
        group = (target // self.members).astype(np.uint16)
        bounds = [0, *np.cumsum(np.bincount(group, minlength=self.classes)).tolist()]
        return np.argsort(group, kind="stable"), [(c, slice(a, b)) for c, (a, b) in enumerate(zip(bounds, bounds[1:])) if a < b]  # a radix sort

    def _own(self, input: np.ndarray, held: list[tuple[int, slice]]) -> np.ndarray:
        """Outputs of the member layers for positions in the order of :meth:`_by_class`."""
        own = np.empty((len(input), self.members), np.float32)
        for c, rows in held:
            np.matmul(input[rows], self.inner[c], out=own[rows])
        return own

    def log_probabilities(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        order, held = self._by_class(target)
        target, out = target[order], np.empty(len(target))
        input = _with_one(self.hidden(around.T.take(order, 1).T))
        out[order] = _log_softmax(input @ self.outer, target // self.members) + _log_softmax(self._own(input, held), target % self.members)
        return out

    def train(self, around: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One step of gradient ascent on the mean log-probability of a batch."""
        order, held = self._by_class(target)
        around, target, rate = around.T.take(order, 1).T, target[order], np.float32(rate / len(target))
        hidden = self.hidden(around)
        input = _with_one(hidden)
        wrong = _wrong(input @ self.outer, target // self.members, rate)
        back = wrong @ self.group.T
        step = input.T @ wrong
        self.outer -= step * _shrink(step)
        own, part = _wrong(self._own(input, held), target % self.members, rate), np.empty_like(back)
        for c, rows in held:
            layer, mine = self.inner[c], own[rows]
            np.matmul(mine, layer[:-1].T, out=part[rows])
            layer -= input[rows].T @ mine
        back += part
        hidden *= hidden
        np.subtract(1, hidden, out=hidden)
        back *= hidden
        step = np.ones(len(back), np.float32) @ back
        if (shrink := _shrink(step)) < 1:
            back *= shrink
        self.bias -= step * shrink
        # pairs of floats, added up as complex numbers, take half as many additions
        pairs, width = back.view(np.complex64).ravel(), HIDDEN // 2
        places = np.arange(self.near.shape[1] * width).reshape(-1, width)
        for near, token in zip(self.near, around.T):
            np.subtract.at(near.reshape(-1).view(np.complex64), places.take(token, 0).ravel(), pairs)


Network.SIZE = sum(map(math.prod, Network.shapes(CLASSES, MEMBERS).values()))


def side_for(distinct: int) -> int:
    """Classes, and members of a class, for a corpus with so many distinct words."""
    return max(CLASSES, MEMBERS, math.isqrt(RARE + math.isqrt(distinct) - 1) + 1)


def _shrink(step: np.ndarray) -> np.float32:
    """What a step is multiplied by, so that it is no longer than allowed; 1 for all others."""
    return np.float32(min(1.0, LONGEST / max(float(np.linalg.norm(step)), 1e-30)))


def _with_one(hidden: np.ndarray) -> np.ndarray:
    """Hidden units and, for the biases, a one."""
    out = np.empty((len(hidden), HIDDEN + 1), np.float32)
    out[:, :-1], out[:, -1] = hidden, 1
    return out


def _near_zero(values: np.ndarray) -> bool:
    """Whether all values are near zero; if not, the greatest of its row is taken off each."""
    near = not len(values) or bool(values.max() < 40 and values.min() > -40)
    if not near:
        values -= values.max(1, keepdims=True)
    return near


def _exp(values: np.ndarray, near: bool) -> np.ndarray:
    """In place, the exponentials; returned are the sums of rows.  Arithmetic on numbers too small for a normal float takes many times as long."""
    if not near:
        np.maximum(values, -40, out=values)
    np.exp(values, out=values)
    return values @ np.ones(values.shape[1], np.float32)


def _flat(values: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Places of the chosen value of each row."""
    return np.arange(0, values.size, values.shape[1]) + chosen


def _wrong(values: np.ndarray, chosen: np.ndarray, rate: np.float32) -> np.ndarray:
    """In place, ``rate`` times the softmax of each row less one at the chosen value."""
    values *= (rate / _exp(values, _near_zero(values)))[:, None]
    values.reshape(-1)[_flat(values, chosen)] -= rate
    return values


def _log_softmax(values: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    near = _near_zero(values)
    picked = values.take(_flat(values, chosen)).astype(np.float64)
    return picked - np.log(_exp(values, near).astype(np.float64))


def _rare_slot(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Slots 1 .. RARE - 1 for rare words, by their last two bytes and length."""
    last, before = data[ends - 1].astype(np.uint32), data[np.maximum(ends - 2, starts)].astype(np.uint32)
    shape = (last * np.uint32(257) + before) * np.uint32(31) + np.minimum(ends - starts, 12).astype(np.uint32) // np.uint32(4)
    return ((shape * np.uint32(0x9E3779B1)) >> np.uint32(8)) % np.uint32(RARE - 1) + 1


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        data, bounds = text_buffer(batch.column("text"))
        starts, ends, _ = W.spans(data, bounds)
        if not len(starts):
            continue
        word, one, count = np.unique(W.hashes(data, starts, ends), return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(_rare_slot(data, starts[one], ends[one]).astype(np.int32)),
                                          pa.array(count.astype(np.int64))], names=["word", "slot", "held"])


class Vocabulary:
    """What the counts of all words give: the frequent words and their slots, counts at hand, and the rare slots' totals.

    ``counts`` is the table of all words; ``least`` the count from which words are at hand, all if 0.
    """

    def __init__(self, rows: DataFrame, known: int = KNOWN):
        counted = rows.mapInArrow(_count_task, "word bigint, slot int, held bigint").groupBy("word").agg(F.min("slot").alias("slot"), F.sum("held").alias("held"))
        self.counts = written(counted, "words")
        levels = sorted(((r["held"], r["count"]) for r in self.counts.groupBy("held").count().collect()), reverse=True)
        distinct, self.least, reached = sum(n for _, n in levels), 0, 0
        self.total = sum(held * number for held, number in levels)
        for held, number in levels:
            reached += number
            if reached > known:
                self.least = held + 1
                break
        self.side = side_for(distinct)
        top = self.counts.orderBy(F.desc("held"), "word").limit(self.side ** 2 - RARE).collect()
        words = np.array([r["word"] for r in top], np.int64).view(np.uint64)
        order = np.argsort(words)
        self.words, self.slots = words[order], (np.arange(len(words)) + RARE)[order].astype(np.int32)
        self.totals = np.zeros(RARE, np.int64)
        for r in self.counts.groupBy("slot").agg(F.sum("held").alias("held")).collect():
            self.totals[r["slot"]] = r["held"]
        for r in top:
            self.totals[r["slot"]] -= r["held"]
        at_hand = self.counts.where(F.col("held") >= self.least).select("word", "held").toArrow()
        words = at_hand.column("word").to_numpy().view(np.uint64)
        order = np.argsort(words)
        self.known, self.held = words[order], at_hand.column("held").to_numpy()[order]


def _tokens(batch: pa.RecordBatch, words: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a batch with borders around every row, places of the real ones, and each row's first."""
    return _lines(batch, words, slots)[:3]


def _lines(batch: pa.RecordBatch, words: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``_tokens``, and the hashes of the words."""
    data, bounds = text_buffer(batch.column("text"))
    starts, ends, first = W.spans(data, bounds)
    hashed = W.hashes(data, starts, ends)
    found = _rare_slot(data, starts, ends).astype(np.int32) if len(starts) else np.zeros(0, np.int32)
    if len(words):
        at = np.minimum(np.searchsorted(words, hashed), len(words) - 1)
        known = words[at] == hashed
        found[known] = slots[at[known]]
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    place = np.arange(len(found)) + (row + 1) * REACH
    line = np.zeros(len(found) + len(first) * REACH, np.int32)
    line[place] = found
    return line, place, first, hashed


def _around(line: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Neighbours of the tokens at ``place``, a row each; each neighbour's column lies together in memory."""
    return line.take(place + np.array([*range(-REACH, 0), *range(1, REACH + 1)])[:, None]).T


def _turn(first: np.ndarray, number: int) -> np.ndarray:
    """Tokens whose place in their own text is due in this round."""
    inside = np.arange(first[-1]) - np.repeat(first[:-1], np.diff(first))
    return np.flatnonzero((inside + number) % ROUNDS == 0)


def _line_task(words, slots):
    """Tokens of each text, without borders, as little-endian 32-bit slots."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            line, place, first = _tokens(batch, words, slots)
            data, bounds = line[place].astype("<i4").tobytes(), (first * 4).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("key"), pa.array([data[a:b] for a, b in zip(bounds, bounds[1:])], pa.binary())],
                                             names=["shard", "key", "line"])

    return work


def _bordered(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of the texts of a batch of lines with borders around every text, places of the real ones, and each text's first."""
    data, bounds = text_buffer(batch.column("line"))
    first, found = bounds // 4, np.frombuffer(data.tobytes(), "<i4")
    place = np.arange(len(found)) + (np.repeat(np.arange(len(first) - 1), np.diff(first)) + 1) * REACH
    line = np.zeros(len(found) + len(first) * REACH, np.int32)
    line[place] = found
    return line, place, first


def _train_task(flat: bytes, number: int, side: int = CLASSES):
    """A local model of each shard, in slices."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, stream in grouped(batches, "shard"):
            network, trained = Network(np.frombuffer(flat, np.float32).copy(), side, side), 0
            for batch in pieces(stream, "line"):
                line, place, first = _bordered(batch)
                chosen = place[_turn(first, number)]
                # neighbours in a batch come from all over the block of texts
                chosen = np.random.default_rng(len(line)).permutation(chosen)
                for first in range(0, len(chosen), BATCH):
                    part = chosen[first:first + BATCH]
                    network.train(_around(line, part), line[part], RATE * (1 if len(part) == BATCH else len(part) / BATCH))
                trained += len(chosen)
            if trained:
                for at in range(0, len(network.flat), _SLICE):
                    yield pa.RecordBatch.from_pydict({
                        "slice": pa.array([at // _SLICE], pa.int32()), "shard": pa.array([shard], pa.int64()), "weight": pa.array([trained], pa.int64()),
                        "values": pa.array([network.flat[at:at + _SLICE].tobytes()], pa.binary())})

    return work


def _average_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, list] = {}
    for batch in batches:
        for row in batch.to_pylist():
            values = np.frombuffer(row["values"], np.float32).astype(np.float64) * row["weight"]
            known = total.setdefault(row["slice"], [0, 0.0])
            known[0] += row["weight"]
            known[1] = known[1] + values
    for at, (weight, values) in total.items():
        yield pa.RecordBatch.from_pydict({"slice": pa.array([at], pa.int32()), "weight": pa.array([weight], pa.int64()),
                                          "values": pa.array([(values / weight).astype(np.float32).tobytes()], pa.binary())})


def fit(rows: DataFrame, known: int = KNOWN, shard_words: int = SHARD_WORDS) -> tuple[Vocabulary, bytes]:
    """Vocabulary and parameters learnt from all of ``rows`` (columns ``id`` and ``text``).

    Texts are dealt to shards by hash of id and text and keep the order of that hash in them, so the model does not depend on how
    the table is split.  Each round trains a local model a shard and averages them.
    """
    found = Vocabulary(rows.select("text"), known)
    shards = max(1, -(-found.total // shard_words))
    tasks = min(shards, MOST_TASKS)
    keyed = rows.withColumn("key", F.xxhash64("id", "text"))
    lines = written(keyed.select(F.pmod("key", F.lit(shards)).alias("shard"), "key", "text")
                    .mapInArrow(_line_task(found.words, found.slots), "shard bigint, key bigint, line binary"), "lines")
    dealt_lines = (lines.repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int")).sortWithinPartitions("shard", "key", "line"))
    flat = Network(None, found.side, found.side).flat.tobytes()
    for number in range(ROUNDS):
        parts = dealt_lines.mapInArrow(_train_task(flat, number, found.side), "slice int, shard bigint, weight bigint, values binary")
        # a slice is added up in the order of shards; the network's size does not depend on their number, so what comes back does not either
        merged = (parts.repartition("slice").sortWithinPartitions("slice", "shard")
                  .mapInArrow(_average_task, "slice int, weight bigint, values binary").collect())
        if not merged:
            break
        flat = b"".join(bytes(r["values"]) for r in sorted(merged, key=lambda r: r["slice"]))
    return found, flat


def _score_task(words, slots, flat: bytes, side: int, totals: np.ndarray, counts):
    """``counts``: a broadcast of the words at hand and their counts.  Column ``rare`` has the rare words of a text that are not at hand."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network(np.frombuffer(flat, np.float32).copy(), side, side)
        known, held = counts.value
        shares = -np.log(np.maximum(totals, 1))
        for batch in pieces(batches, "text", 1 << 20):
            line, place, first, hashed = _lines(batch, words, slots)
            sums = np.zeros(len(place) + 1)
            for at in range(0, len(place), SCORED):
                part = place[at:at + SCORED]
                sums[at + 1:at + 1 + len(part)] = network.log_probabilities(_around(line, part), line[part])
            rare = np.flatnonzero(line[place] < RARE)
            sums[rare + 1] += shares[line[place[rare]]]
            word, back = np.unique(hashed[rare], return_inverse=True)
            number, found = np.zeros(len(word)), np.zeros(len(word), bool)
            if len(known):
                at = np.minimum(np.searchsorted(known, word), len(known) - 1)
                found = known[at] == word
                number[found] = np.log(held[at[found]])
            sums[rare + 1] += number[back]
            rare = rare[~found[back]]
            np.cumsum(sums, out=sums)
            count = np.diff(first)
            score = sums[first[1:]] - sums[first[:-1]]
            rest = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, first).astype(np.int32)), pa.array(hashed[rare].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(count.astype(np.int64)), pa.array(score), rest], names=["id", "n_tokens", "score", "rare"])

    return work


def pseudo_likelihoods(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", known: int = KNOWN,
                       shard_words: int = SHARD_WORDS) -> DataFrame:
    """``id, n_tokens, score, mean_score`` of each row: the sum of its tokens' conditional log-probabilities, and that over their number.

    Null and empty texts and those of blanks alone have no token, score 0 and no mean.  Rows that repeat are scored each.  An
    empty table gives an empty result; other columns are ignored.  Counts of at most ``known`` words are held in a task; the
    result does not depend on it, nor on the partitions of ``df``.
    """
    spark = prepare(df.sparkSession)
    kind = dict(df.dtypes)[id_column]
    rows = df.select(F.col(id_column).alias("id"), as_text(F.col(text_column)).alias("text"))
    found, flat = fit(rows, known, shard_words)
    task = _score_task(found.words, found.slots, flat, found.side, found.totals, spark.sparkContext.broadcast((found.known, found.held)))
    scored = rows.mapInArrow(task, f"id {kind}, n_tokens bigint, score double, rare array<bigint>")
    if found.least:
        kept = written(scored.withColumn("row", F.monotonically_increasing_id()), "scores")
        others = found.counts.where(F.col("held") < found.least).select("word", "held")
        more = (kept.select("row", F.explode("rare").alias("word")).join(others, "word").groupBy("row").agg(F.sum(F.log("held")).alias("more")))
        scored = kept.join(more, "row", "left").withColumn("score", F.col("score") + F.coalesce("more", F.lit(0.0)))
    return scored.select("id", "n_tokens", "score").withColumn("mean_score", F.when(F.col("n_tokens") > 0, F.col("score") / F.col("n_tokens")))
