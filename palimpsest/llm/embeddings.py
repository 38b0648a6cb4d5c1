"""Embedding near-duplicates by counting collisions in one-dimensional projections.

Equal vectors of a label are folded first and travel as one vector with a weight.  The distinct vectors of a label are
ordered along a leading projection and cut into blocks; two blocks meet only if no projection that all vectors share rules out every
pair (a pair with cosine c lies at most sqrt(2 - 2c) apart along any unit direction).  Where two blocks meet, both are
sorted along many random projections, and a window centred on each query in each order counts its collisions.  A pair
with enough collisions is verified by its cosine in double precision.

The window and the count are calibrated: along one random projection a pair at the threshold collides with known
probability, so the count that it misses with probability at most ``MISSES`` is a quantile of the binomial distribution.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.common import components, dealt, grouped, prepare, written

THRESHOLD = 0.93
PROJECTIONS, MISSES = 48, 1e-6
#: Half width of a window in standard deviations of the projected distance of a pair at the threshold.
REACH = 2.0
BLOCK_ROWS = 1024
#: Directions along which blocks keep their ranges.
RANGES = 16


def quantile(trials: int, chance: float, misses: int | float) -> int:
    """The largest count k with P(fewer than k of ``trials``) at most ``misses``."""
    below, k = 0.0, 0
    while k < trials:
        below += math.comb(trials, k) * chance ** k * (1 - chance) ** (trials - k)
        if below > misses:
            break
        k += 1
    return k


def directions(dimension: int, count: int, seed: int = 7) -> np.ndarray:
    """Random directions with independent normal components (dimension x count), the same in every task."""
    return np.random.default_rng(seed).standard_normal((dimension, count))


@functools.cache
def shared(dimension: int) -> np.ndarray:
    """The unit directions along which blocks keep their ranges; blocks are ordered along the first."""
    free = directions(dimension, RANGES, 11)
    return free / np.sqrt((free ** 2).sum(0))


def _unit_task(ids_kind):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for id_, label, vector in zip(batch.column("id").to_pylist(), batch.column("label").to_pylist(), batch.column("vector").to_pylist(), strict=True):
                unit = None
                if id_ is not None and label is not None and vector and None not in vector:
                    x = np.array(vector, np.float64)
                    with np.errstate(over="ignore"):
                        x = x / np.abs(x).max() if np.isfinite(x).all() and np.abs(x).max() > 0 else None
                    if x is not None:
                        unit = (x / np.sqrt(x @ x)).tobytes()
                lead = None if unit is None else float(np.frombuffer(unit, np.float64) @ shared(len(unit) // 8)[:, 0])
                rows.append((id_, label, unit, None if unit is None else xxhash.xxh3_128_digest(unit + label.to_bytes(8, "little", signed=True)), lead))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (ids_kind, pa.int64(), pa.binary(), pa.binary(), pa.float64()))],
                                             names=["id", "label", "unit", "same", "lead"])

    return work


def collisions(queries: np.ndarray, others: np.ndarray, half: float) -> np.ndarray:
    """For each pair of projected vectors, how many of the query's windows the other lies in."""
    count = np.zeros((len(queries), len(others)), np.uint8)
    place = np.empty(len(others), np.int32)
    for j in range(queries.shape[1]):
        order = np.argsort(others[:, j], kind="stable")
        along = others[order, j]
        place[order] = np.arange(len(others), dtype=np.int32)
        low = np.searchsorted(along, queries[:, j] - half, "left").astype(np.int32)
        width = (np.searchsorted(along, queries[:, j] + half, "right") - low).astype(np.uint32)
        # one comparison for both ends of the window: places before its begin wrap around
        count += (place[None, :] - low[:, None]).view(np.uint32) < width[:, None]
    return count


def _spanning(a: np.ndarray, b: np.ndarray, size: int) -> list[int]:
    """Numbers of links that join different trees: enough links for the same components."""
    root = list(range(size))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for n, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(n)
    return kept


_FOUND = "id bigint, links bigint, other bigint"


def _pair_task(threshold: float, projections: int, reach: float, misses: float):
    spread = math.sqrt(2 - 2 * threshold)
    half = reach * spread
    enough = quantile(projections, math.erf(reach / math.sqrt(2)), misses)

    def block(batches):
        table = pa.Table.from_batches(batches)
        ids, weight = table.column("id").to_numpy(), table.column("weight").to_numpy()
        units = np.frombuffer(b"".join(table.column("unit").to_pylist()), np.float64).reshape(len(ids), -1)
        return ids, weight, units, units @ directions(units.shape[1], projections)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, stream in grouped(batches, "meeting"):
            sides: dict[int, list] = {0: [], 1: []}
            for batch in stream:
                side = batch.column("side").to_numpy()
                for which in (0, 1):
                    if (side == which).any():
                        sides[which].append(batch.filter(pa.array(side == which)))
            a = block(sides[0])
            alone = not sides[1]
            b = a if alone else block(sides[1])
            x, y = np.nonzero(collisions(a[3], b[3], half) >= enough)
            if alone:
                x, y = x[x < y], y[x < y]
            cosine = np.concatenate([np.einsum("ij,ij->i", a[2][x[s:s + 65536]], b[2][y[s:s + 65536]]) for s in range(0, len(x), 65536)] or [np.zeros(0)])
            x, y = x[cosine >= threshold], y[cosine >= threshold]
            links = [np.bincount(x, b[1][y], len(a[0])), np.bincount(y, a[1][x], len(b[0]))]
            for ids, count in zip((a[0], b[0]), links):
                some = count > 0
                if some.any():
                    yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(count[some].astype(np.int64)), pa.nulls(int(some.sum()), pa.int64())],
                                                     names=["id", "links", "other"])
            kept = _spanning(x, y if alone else y + len(a[0]), len(a[0]) + (0 if alone else len(b[0])))
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(a[0][x[kept]]), pa.nulls(len(kept), pa.int64()), pa.array(b[0][y[kept]])], names=["id", "links", "other"])

    return work


def _range_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least and greatest value of a part of a block along each shared direction."""
    for batch in batches:
        if not batch.num_rows:
            continue
        label, number = batch.column("label").to_pylist(), batch.column("block").to_pylist()
        units = batch.column("unit").to_pylist()
        found: dict[tuple, list] = {}
        for key, unit in zip(zip(label, number), units):
            found.setdefault(key, []).append(unit)
        rows = []
        for (own, at), part in found.items():
            matrix = np.frombuffer(b"".join(part), np.float64).reshape(len(part), -1)
            values = matrix @ shared(matrix.shape[1])
            rows.append({"label": own, "block": at, "low": values.min(0).tolist(), "high": values.max(0).tolist()})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("label", pa.int64()), ("block", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))]))


def near_vectors(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", threshold: float = THRESHOLD,
                 projections: int = PROJECTIONS, reach: float = REACH, misses: float = MISSES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``id, n_links, component_id, kept`` of each row.

    Vectors of one label (and one length) link when their cosine is at least ``threshold``.  A null id or label, null, empty or zero
    vectors and vectors with null or non-finite components link with nothing.  Rows that repeat a vector under a label
    link with each other.  Ids are integers; rows that repeat an id with other vectors share its component and the links of all of them.
    An empty table gives an empty result; other columns are ignored.
    """
    spark = prepare(df.sparkSession)
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("long").alias("label"), F.col(vector_column).cast("array<double>").alias("vector"))
    units = written(rows.mapInArrow(_unit_task(pa.int64()), "id bigint, label bigint, unit binary, same binary, lead double"), "units")
    # one representative for equal vectors; the partial maximum leaves one row a task and vector
    folded = (units.where("same is not null and id is not null").groupBy("same").agg(F.min(F.struct("id", "label", "lead", "unit")).alias("one"), F.count("*").alias("weight"))
              .select("same", "weight", "one.*").withColumn("size", F.length("unit")))
    folded = written(folded, "vectors")
    # blocks of neighbours along the leading projection, of about block_rows vectors each: equal-frequency cells per label and length
    cells = (folded.groupBy("label", "size", F.floor(F.col("lead") * 4096).alias("cell")).agg(F.count("*").alias("held")))
    before = Window.partitionBy("label", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("base", F.coalesce(F.sum("held").over(before), F.lit(0)))
    inside = Window.partitionBy("label", "size", "cell").orderBy("lead", "id")
    placed = (folded.withColumn("cell", F.floor(F.col("lead") * 4096)).join(cells.select("label", "size", "cell", "base"), ["label", "size", "cell"])
              .withColumn("rank", F.col("base") + F.row_number().over(inside) - 1)
              .select("label", "size", "id", "weight", "unit", "same", (F.col("size") * (1 << 40) + F.floor(F.col("rank") / block_rows)).alias("block")))
    placed = written(placed, "blocks")
    parts = placed.select("label", "block", "unit").mapInArrow(_range_task, "label bigint, block bigint, low array<double>, high array<double>")
    ranges = parts.groupBy("label", "block").agg(*[F.min(F.col("low")[j]).alias(f"l{j}") for j in range(RANGES)], *[F.max(F.col("high")[j]).alias(f"h{j}") for j in range(RANGES)])
    ranges = written(ranges, "ranges")
    left = ranges.select("label", F.col("block").alias("first"), *[F.col(f"{s}{j}").alias(f"a{s}{j}") for s in "lh" for j in range(RANGES)])
    right = ranges.withColumnRenamed("block", "second")
    gap = math.sqrt(2 - 2 * threshold) + 1e-9
    near = F.lit(True)
    for j in range(RANGES):
        near = near & (F.col(f"l{j}") <= F.col(f"ah{j}") + gap) & (F.col(f"al{j}") <= F.col(f"h{j}") + gap)
    # cells as wide as the gap along the first direction make it an equi-join
    slot = lambda name, by=0: F.floor(F.col(name) / gap) + by
    left = left.withColumn("slot", F.explode(F.sequence(slot("al0", -1), slot("ah0", 1))))
    right = right.withColumn("slot", F.explode(F.sequence(slot("l0"), slot("h0"))))
    meetings = (left.join(right, ["label", "slot"]).where((F.col("first") <= F.col("second")) & (F.shiftright("first", 40) == F.shiftright("second", 40)) & near)
                .select("label", "first", "second").distinct())
    meetings = written(meetings.withColumn("meeting", F.xxhash64("label", "first", "second")), "meetings")
    sides = (meetings.select("meeting", "label", F.col("first").alias("block"), F.lit(0).alias("side"))
             .unionByName(meetings.where("first < second").select("meeting", "label", F.col("second").alias("block"), F.lit(1).alias("side"))))
    met = dealt(sides.join(placed.select("label", "block", "id", "weight", "unit"), ["label", "block"]).select("meeting", "side", "id", "weight", "unit"), None, "meeting")
    found = written(met.mapInArrow(_pair_task(threshold, projections, reach, misses), _FOUND), "found")
    links = found.where("links is not null").groupBy(F.col("id").alias("one")).agg(F.sum("links").alias("links"))
    joined = components(found.where("other is not null").select("id", "other"), "id", "other")
    classes = (placed.select("same", F.col("id").alias("one"), "weight").join(links, "one", "left").join(joined.withColumnRenamed("node", "one"), "one", "left")
               .select("same", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "one").alias("component_id")))
    return (units.select("id", "same").join(classes, "same", "left")
            .select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))))
