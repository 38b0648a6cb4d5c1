"""Hard negatives from Hilbert-ordered blocks with zone maps.

The rows are ordered by label and, within a label, along a Hilbert curve through the dimensions of largest variance, and written as
Parquet blocks of neighbours.  Each block keeps a zone map: least and greatest value of each dimension, of the label and of the id.  Interval
arithmetic on a zone map bounds the inner products of all rows of a block with an anchor from both sides, so a block is read for an
anchor only if its bounds meet the anchor's window and can still beat the rows that the anchor already has.

Anchors travel in groups of neighbours.  A search reads the blocks that look best first; the k-th row found is a floor, and the second
reading takes the remaining blocks whose bound reaches it.  Positives are such a search with an open window over rows of the
same label, negatives one over rows of other labels with a window for each positive.  Scores are exact integers and floors are compared
with their ids, so the result is that of comparing every anchor with every row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.common import grouped, prepare, written

BLOCK_ROWS = 256
#: Anchors in a group; dimensions and bits of the curve; zone maps held at once; blocks a search reads first for each window.
GROUP_ROWS, CURVE_DIMENSIONS, CURVE_BITS, SLICE_BLOCKS, FIRST_BLOCKS = 128, 8, 7, 256, 2
#: Groups that pass one slice of zone maps in a task, and blocks that one task reads for a group, about.
PASSING, READ_TOGETHER = 64, 64
OPEN_LOW, OPEN_HIGH = -(1 << 63), (1 << 63) - 1

_ASK = "array<struct<row int, low bigint, high bigint, floor bigint, floor_id bigint>>"
_GROUP = "group bigint, size int, ids binary, labels binary, q binary, names array<bigint>"
_BLOCK = "block bigint, size int, rows int, low_label bigint, high_label bigint, first_id bigint, low binary, high binary, ids binary, labels binary, q binary"


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of each point (rows of unsigned integers below ``2**bits``) along the Hilbert curve of its dimensions."""
    x = points.astype(np.int64).copy()
    top, dims = 1 << (bits - 1), x.shape[1]
    step = top
    while step > 1:
        for i in range(dims):
            hit = (x[:, i] & step) != 0
            swap = np.where(hit, 0, (x[:, 0] ^ x[:, i]) & (step - 1))
            x[:, 0] ^= np.where(hit, step - 1, swap)
            x[:, i] ^= swap
        step >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    turn, step = np.zeros(len(x), np.int64), top
    while step > 1:
        turn ^= np.where(x[:, -1] & step, step - 1, 0)
        step >>= 1
    x ^= turn[:, None]
    place = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            place = (place << 1) | ((x[:, i] >> bit) & 1)
    return place


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; those beyond the range of long are cut to it."""
    largest = [max(-int(m.min(initial=0)), int(m.max(initial=0)), 1) for m in (a, b)]
    if largest[0] * largest[1] * max(a.shape[1], 1) < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, OPEN_LOW, OPEN_HIGH).astype(np.int64)


def interval(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each anchor with any vector between ``low`` and ``high`` (one row a block)."""
    both = np.hstack([np.maximum(anchors, 0), np.minimum(anchors, 0)])
    return products(both, np.hstack([low, high])), products(both, np.hstack([high, low]))


def _longs(value: bytes, width: int = 0) -> np.ndarray:
    flat = np.frombuffer(value, "<i8")
    return flat.reshape(-1, width) if width else flat


def _asks(column, row: int) -> dict[str, np.ndarray]:
    part = column[row].values
    return {name: part.field(name).to_numpy(zero_copy_only=False) for name in ("row", "low", "high", "floor", "floor_id")}


def _matrix(column) -> np.ndarray:
    """An Arrow list column of equal lengths as rows of longs."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def _spread_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each length and dimension the least and greatest value, count, sum and sum of squares of a task's rows."""
    found: dict[int, list] = {}
    for batch in batches:
        size = batch.column("size").to_numpy()
        for one in np.unique(size).tolist():
            x = _matrix(batch.column("q").filter(pa.array(size == one))).astype(np.float64)
            new = [x.min(0), x.max(0), np.full(one, float(len(x))), x.sum(0), (x * x).sum(0)]
            old = found.get(one)
            found[one] = new if old is None else [np.minimum(old[0], new[0]), np.maximum(old[1], new[1]), *[o + n for o, n in zip(old[2:], new[2:])]]
    for one, parts in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([one] * one, pa.int32()), pa.array(range(one), pa.int32()), *[pa.array(p) for p in parts]],
                                         names=["size", "dimension", "low", "high", "held", "total", "squares"])


def _place_task(curve: dict[int, list[tuple[int, float, float]]]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, place = batch.column("size").to_numpy(), np.zeros(batch.num_rows, np.int64)
            for one in np.unique(size).tolist():
                own, axes = size == one, curve[one]
                x = _matrix(batch.column("q").filter(pa.array(own)))[:, [d for d, _, _ in axes]].astype(np.float64)
                low, width = np.array([a for _, a, _ in axes]), np.array([max(b - a, 1.0) for _, a, b in axes])
                place[own] = hilbert(np.clip((x - low) / width * (1 << CURVE_BITS), 0, (1 << CURVE_BITS) - 1), CURVE_BITS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=[*batch.schema.names, "place"])

    return work


def _pack_task(most: int, with_zones: bool):
    """Runs of rows of one length as packed records; numbers are unique over all tasks."""

    def record(number: int, held: list[pa.RecordBatch]):
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        ids, labels, q = table.column("id").to_numpy(), table.column("label").to_numpy(), _matrix(table.column("q"))
        packed = [ids.astype("<i8").tobytes(), labels.astype("<i8").tobytes(), q.astype("<i8").tobytes()]
        if not with_zones:
            return [number, q.shape[1], *packed, ids.tolist()]
        return [number, q.shape[1], len(ids), int(labels.min()), int(labels.max()), int(ids.min()), q.min(0).astype("<i8").tobytes(), q.max(0).astype("<i8").tobytes(), *packed]

    names = [c.split()[0] for c in (_BLOCK if with_zones else _GROUP).split(", ")]
    kinds = [{"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}[c.split()[1]] for c in (_BLOCK if with_zones else _GROUP).split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for _, stream in grouped(batches, "size"):
            held, rows = [], 0
            for batch in stream:
                while batch.num_rows:
                    part = batch.slice(0, most - rows)
                    batch = batch.slice(part.num_rows)
                    held.append(part)
                    rows += part.num_rows
                    if rows == most:
                        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(record(number, held), kinds)], names=names)
                        number, held, rows = number + 1, [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(record(number, held), kinds)], names=names)
                number += 1

    return work


def _choose_task(same: bool, first: int):
    """Blocks that each ask of a group must read, from the zone maps of a slice.

    With ``first`` only that many blocks of each ask: those whose middle lies closest to the upper end of the window.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, stream in grouped(batches, "meeting"):
            held, zones = [], None
            for batch in stream:
                for n, kind in enumerate(batch.column("kind").to_pylist()):
                    if kind == 0:
                        held.append(batch.slice(n, 1))
                        continue
                    if zones is None:
                        table = pa.Table.from_batches(held)
                        size = table.column("size").to_numpy()
                        zones = {one: (table.column("block").to_numpy()[size == one], table.column("low_label").to_numpy()[size == one], table.column("high_label").to_numpy()[size == one],
                                       table.column("first_id").to_numpy()[size == one], *[np.vstack([_longs(v.as_py()) for v, s in zip(table.column(c), size) if s == one]) for c in ("low", "high")])
                                 for one in np.unique(size).tolist()} if held else {}
                    one = batch.column("size")[n].as_py()
                    if one not in zones:
                        continue
                    block, low_label, high_label, first_id, low, high = zones[one]
                    asks = _asks(batch.column("asks"), n)
                    if not len(asks["row"]):
                        continue
                    labels, q = _longs(batch.column("labels")[n].as_py()), _longs(batch.column("q")[n].as_py(), one)
                    least, most = (m[asks["row"]] for m in interval(q, low, high))
                    own = labels[asks["row"]][:, None]
                    may = (low_label <= own) & (own <= high_label) if same else (low_label != own) | (high_label != own)
                    top = np.minimum(most, asks["high"][:, None])
                    may &= (least <= asks["high"][:, None]) & (most >= asks["low"][:, None])
                    # a floor with the smaller id wins a tie
                    may &= (top > asks["floor"][:, None]) | ((top == asks["floor"][:, None]) & (first_id[None, :] < asks["floor_id"][:, None]))
                    if first:
                        middle = least / 2 + most / 2
                        away = np.where(may, np.abs(middle - np.minimum(asks["high"].astype(np.float64), most.max(1))[:, None]), np.inf)
                        picked = np.argsort(away, axis=1, kind="stable")[:, :first]
                        a, b = np.repeat(np.arange(len(away)), picked.shape[1]), picked.ravel()
                        good = np.isfinite(away[a, b])
                        a, b = a[good], b[good]
                        order = np.argsort(b, kind="stable")
                        a, b, rank = a[order], b[order], away[a, b][order]
                    else:
                        b, a = np.nonzero(may.T)
                        rank = np.zeros(len(a))
                    if not len(a):
                        continue
                    cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1], True])
                    group = batch.column("group")[n].as_py()
                    yield pa.RecordBatch.from_arrays([
                        pa.array([group] * (len(cuts) - 1), pa.int64()), pa.array(block[b[cuts[:-1]]]),
                        pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(a, pa.int32())),
                        pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(rank, pa.float64()))], names=["group", "block", "asks", "away"])

    return work


def _read_task(same: bool, most: int):
    """The best ``most`` rows of each ask among the blocks of a chunk: one product for each block and the anchors that read it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, stream in grouped(batches, "meeting"):
            group = None
            for batch in stream:
                for n, kind in enumerate(batch.column("kind").to_pylist()):
                    ids, labels = _longs(batch.column("ids")[n].as_py()), _longs(batch.column("labels")[n].as_py())
                    q = _longs(batch.column("q")[n].as_py(), batch.column("size")[n].as_py())
                    if kind == 0:
                        group, asks = batch.column("group")[n].as_py(), _asks(batch.column("asks"), n)
                        own_ids, own_labels, anchors = ids, labels, q
                        best_score, best_id = (np.full((len(asks["row"]), most), x) for x in (OPEN_LOW, OPEN_HIGH))
                        continue
                    wanted = batch.column("asked")[n].values.to_numpy(zero_copy_only=False)
                    rows, place = np.unique(asks["row"][wanted], return_inverse=True)
                    scores = products(anchors[rows], q)
                    fits = own_labels[rows][:, None] == labels[None, :]
                    fits = fits & (own_ids[rows][:, None] != ids[None, :]) if same else ~fits
                    scores = scores[place]
                    least = np.maximum(asks["low"], np.maximum(asks["floor"], best_score[:, -1]))[wanted]
                    a, r = np.nonzero(fits[place] & (scores >= least[:, None]) & (scores <= asks["high"][wanted][:, None]))
                    if not len(a):
                        continue
                    hit = np.unique(wanted[a])
                    ask = np.r_[wanted[a], np.repeat(hit, most)]
                    score, other = np.r_[scores[a, r], best_score[hit].ravel()], np.r_[ids[r], best_id[hit].ravel()]
                    order = np.lexsort((other, ~score, ask))
                    ask, score, other = ask[order], score[order], other[order]
                    rank = np.arange(len(ask)) - np.searchsorted(ask, ask)
                    ask, score, other, rank = (x[rank < most] for x in (ask, score, other, rank))
                    best_score[ask, rank], best_id[ask, rank] = score, other
            if group is not None:
                ask, rank = np.nonzero((best_score > OPEN_LOW) | (best_id < OPEN_HIGH))
                yield pa.RecordBatch.from_arrays([pa.array([group] * len(ask), pa.int64()), pa.array(ask, pa.int32()), pa.array(best_score[ask, rank]), pa.array(best_id[ask, rank])],
                                                 names=["group", "ask", "score", "other"])

    return work


class _Blocks:
    """The written blocks, the slices of their zone maps, and how many there are."""

    def __init__(self, blocks: DataFrame):
        self.blocks = blocks
        self.count = blocks.count()
        self.slices = max(1, -(-self.count // SLICE_BLOCKS))
        self.zones = blocks.select("block", "size", "low_label", "high_label", "first_id", "low", "high").withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(self.slices)))

    def choose(self, groups: DataFrame, same: bool, first: int) -> DataFrame:
        parts = max(1, -(-groups.count() // PASSING))
        meeting = lambda df: df.withColumn("meeting", F.col("slice") * parts + F.col("part"))
        zones = meeting(self.zones.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))))
        anchors = meeting(groups.withColumn("part", F.pmod(F.xxhash64("group"), F.lit(parts))).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(self.slices - 1)))))
        both = (zones.select("meeting", F.lit(0).alias("kind"), "size", "block", "low_label", "high_label", "first_id", "low", "high", F.lit(None).cast("bigint").alias("group"),
                             F.lit(None).cast("binary").alias("labels"), F.lit(None).cast("binary").alias("q"), F.lit(None).cast(_ASK).alias("asks"))
                .unionByName(anchors.select("meeting", F.lit(1).alias("kind"), "size", "group", "labels", "q", "asks"), allowMissingColumns=True))
        return _by_meeting(both).mapInArrow(_choose_task(same, first), "group bigint, block bigint, asks array<int>, away array<double>")

    def read(self, groups: DataFrame, chosen: DataFrame, same: bool, most: int) -> DataFrame:
        chunks = max(1, -(-self.count // READ_TOGETHER))
        chosen = chosen.select("group", "block", F.col("asks").alias("asked")).withColumn("meeting", F.xxhash64("group", F.pmod(F.xxhash64("block"), F.lit(chunks))))
        met = chosen.select("group", "meeting").distinct().join(groups, "group").select("meeting", F.lit(0).alias("kind"), "group", "size", "ids", "labels", "q", "asks", F.lit(None).cast("array<int>").alias("asked"))
        payload = chosen.join(self.blocks.select("block", "size", "ids", "labels", "q"), "block").select("meeting", F.lit(1).alias("kind"), "group", "size", "ids", "labels", "q", F.lit(None).cast(_ASK).alias("asks"), "asked")
        return _by_meeting(met.unionByName(payload)).mapInArrow(_read_task(same, most), "group bigint, ask int, score bigint, other bigint")

    def search(self, groups: DataFrame, same: bool, most: int, report: list | None = None) -> DataFrame:
        """``group, ask, rank, score, other``: the ``most`` best rows of each ask."""
        looks = written(self.choose(groups, same, FIRST_BLOCKS), "looks")
        # every slice named its own; the best of all slices remain
        each = looks.select("group", "block", F.explode(F.arrays_zip("asks", "away")).alias("x")).select("group", "block", F.col("x.asks").alias("ask"), "x.away")
        order = Window.partitionBy("group", "ask").orderBy("away", "block")
        chosen = each.withColumn("n", F.row_number().over(order)).where(F.col("n") <= FIRST_BLOCKS).groupBy("group", "block").agg(F.collect_list("ask").alias("asks"))
        chosen = written(chosen, "first")
        found = written(self.read(groups, chosen, same, most), "found")
        floors = (_ranked(found, most).where(F.col("rank") == most).groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("ask", F.struct("score", "other")))).alias("floors")))
        with_floor = lambda a, i: F.struct(
            a["row"].alias("row"), a["low"].alias("low"), a["high"].alias("high"),
            F.coalesce(F.col("floors")[i]["score"], a["floor"]).alias("floor"), F.coalesce(F.col("floors")[i]["other"], a["floor_id"]).alias("floor_id"))
        raised = written(groups.join(floors, "group", "left").withColumn("asks", F.transform("asks", with_floor).cast(_ASK)).drop("floors"), "floors")
        rest = self.choose(raised, same, 0)
        # blocks an ask has read already are not read for it again
        seen = chosen.select("group", "block", F.col("asks").alias("seen"))
        rest = rest.join(seen, ["group", "block"], "left").select("group", "block", F.array_except("asks", F.coalesce("seen", F.array().cast("array<int>"))).alias("asks")).where(F.size("asks") > 0)
        rest = written(rest, "rest")
        if report is not None:
            read = chosen.unionByName(rest).agg(F.sum(F.size("asks"))).first()[0] or 0
            report.append((int(read), self.count * (groups.agg(F.sum(F.size("asks"))).first()[0] or 0)))
        return _ranked(found.unionByName(self.read(raised, rest, same, most)), most)


def _by_meeting(df: DataFrame) -> DataFrame:
    return df.repartition("meeting").sortWithinPartitions("meeting", "kind")


def _ranked(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("group", "ask").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(df: DataFrame, anchor: Column, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", scale: float = 256,
                   positives: int = 5, negatives: int = 10, low_percent: int = 30, high_percent: int = 90, block_rows: int = BLOCK_ROWS, report: list | None = None) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for each anchor and each of its positives.

    A component x counts as floor(scale * x), a score is an integer inner product; higher scores come first, ties by smaller id.  The
    positives of an anchor are its first ``positives`` other rows of the same label; of the rows of other labels whose score lies between
    ``low_percent`` and ``high_percent`` of the positive's score, the first ``negatives`` are returned with their rank.

    Rows with a null id or label, a null or empty vector, or a null or non-finite component take no part.  Vectors meet vectors of their own
    length only.  Components and scores beyond the range of long are cut to it.  Rows that repeat an id are rows of their own, but
    never each other's positives; an anchor without positives or a positive without fitting rows gives none.  An empty table gives an
    empty result; other columns are ignored.  ``report`` gets, for either search, pairs of an ask and a block that were read, and all.
    """
    spark = prepare(df.sparkSession)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("long").alias("label"), anchor.alias("anchor"), F.col(vector_column).cast("array<double>").alias("vector"))
    rows = (rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0) & F.forall("vector", finite))
            .select("id", "label", "anchor", F.size("vector").alias("size"), F.transform("vector", lambda x: F.floor(x * F.lit(float(scale)))).alias("q")))
    rows = written(rows, "rows")
    spread = (rows.select("size", "q").mapInArrow(_spread_task, "size int, dimension int, low double, high double, held double, total double, squares double")
              .groupBy("size", "dimension").agg(F.min("low").alias("low"), F.max("high").alias("high"), (F.sum("squares") / F.sum("held") - F.pow(F.sum("total") / F.sum("held"), 2)).alias("variance")))
    widest = Window.partitionBy("size").orderBy(F.desc("variance"), "dimension")
    # one row a length and curve dimension, so its size does not follow the rows
    axes = spread.withColumn("n", F.row_number().over(widest)).where(F.col("n") <= CURVE_DIMENSIONS).orderBy("size", "n").collect()
    curve: dict[int, list] = {}
    for axis in axes:
        curve.setdefault(axis["size"], []).append((axis["dimension"], axis["low"], axis["high"]))
    placed = written(rows.mapInArrow(_place_task(curve), "id bigint, label bigint, anchor boolean, size int, q array<bigint>, place bigint"), "placed")
    order = ["size", "label", "place", "id"]
    packed = lambda part, most, zones: (part.repartitionByRange(*order).sortWithinPartitions(*order).select("size", "id", "label", "q")
                                        .mapInArrow(_pack_task(most, zones), _BLOCK if zones else _GROUP))
    store = _Blocks(written(packed(placed, block_rows, True), "blocks"))
    named = written(packed(placed.where("anchor"), GROUP_ROWS, False), "anchors")
    anchors = named.drop("names")
    count = (F.octet_length("ids") / 8).cast("int")
    ask = lambda row, low, high: F.struct(row.alias("row"), low.alias("low"), high.alias("high"), F.lit(OPEN_LOW).cast("long").alias("floor"), F.lit(OPEN_HIGH).alias("floor_id"))
    open_asks = anchors.withColumn("asks", F.transform(F.sequence(F.lit(0), count - 1), lambda i: ask(i, F.lit(OPEN_LOW).cast("long"), F.lit(OPEN_HIGH))).cast(_ASK))
    best = written(store.search(open_asks, True, positives, report), "positives")
    share = lambda percent: F.col("score").cast("decimal(20,0)") * F.lit(percent) / F.lit(100)
    asked = best.withColumns({"low": F.ceil(share(low_percent)).cast("long"), "high": F.floor(share(high_percent)).cast("long")})
    windows = (asked.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("ask", "rank", "low", "high", F.col("other").alias("positive_id"), "score"))).alias("windows")))
    windowed = written(anchors.join(windows, "group").withColumn("asks", F.transform("windows", lambda w: ask(w["ask"], w["low"], w["high"])).cast(_ASK)), "windows")
    result = store.search(windowed.drop("windows"), False, negatives, report)
    # the ask's number is its place in the group's windows; ids of anchors are read off the packed column
    named = named.select("group", F.posexplode("names").alias("row", "anchor_id"))
    pairs = windowed.select("group", F.posexplode("windows").alias("ask", "w")).select("group", "ask", F.col("w.ask").alias("row"), F.col("w.positive_id").alias("positive_id"), F.col("w.score").alias("positive_score"))
    return (result.join(pairs, ["group", "ask"]).join(named, ["group", "row"])
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
