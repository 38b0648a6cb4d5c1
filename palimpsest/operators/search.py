"""Exact dense and sparse top-k for many queries at once.

Queries and corpus meet in the places that both may see.  A place is cut into
buckets by the bytes of its documents and its queries into parts; both sides are
shuffled once on (place, part, bucket) and stream through a task bucket by
bucket, the queries before the documents.  There is one plan for all sizes; many
small places share a task, and a large one is split over many.

Inside a bucket, documents form blocks with a bound on the score that any of
their rows can have with a query, and a query skips the blocks whose bound does
not reach its k-th best row.  Results are exact:

* sparse: an inverted index.  Documents keep only the terms that some query of
  their place has, so those without one never leave the scan; blocks are ordered
  by impact, and the block maxima of a query's terms add up to its bound;
* dense: vectors gather around pivots, and the triangle inequality of angles
  bounds the cosine from the pivot's angle and the radius of its ball.

A task keeps the best ``k`` of each query over all its buckets and emits these at
the end, so scored pairs are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from palimpsest import constants as C
from palimpsest.functions import text as tx
from palimpsest.operators.ordered import explode_computed, top_per
from palimpsest.session import spread

# Bytes and rows of a bucket and queries of a part, about; rows of a block; results a task holds before it lets them go.
BUCKET_BYTES = 4 << 20
BUCKET_ROWS = 20_000
QUERY_ROWS = 256
BLOCK_ROWS = 512
HELD_RESULTS = 500_000
# Up to so many query terms, some 10 MB, go to the documents; more meet them in a shuffle, where large terms are split as skewed.
BROADCAST_TERMS = 100_000
EVERYWHERE = "all"
# Scores are rounded to so many digits before they are ranked.
DIGITS = 6


def term_counts(terms: Column) -> Column:
    """Counts of sorted terms as runs: (term, n), without a shuffle.  ``terms`` must be a sorted array column."""
    size = F.size(terms)
    ends = F.filter(F.sequence(F.lit(1), size), lambda i: (i == size) | (F.get(terms, i - 1) != F.get(terms, i)))
    return F.when(size > 0, ends).otherwise(F.array().cast("array<int>"))


def encode_terms(df: DataFrame, text: str, k1: float | None = None, b: float = 0.75, mean_terms: float | None = None) -> DataFrame:
    """Add ``terms`` and ``weights``: the sparse vector of a text.

    Plain counts by default; with ``k1`` the counts saturate, and with
    ``mean_terms`` long texts are toned down.
    """
    sorted_terms = df.withColumn("_sorted", F.array_sort(tx.search_terms(F.col(text))))
    runs = sorted_terms.withColumn("_ends", term_counts(F.col("_sorted")))
    out = runs.withColumn("terms", F.transform("_ends", lambda e: F.get("_sorted", e - 1))).withColumn(
        "weights", F.transform("_ends", lambda e, i: (e - F.when(i == 0, 0).otherwise(F.get("_ends", i - 1))).cast("double")))
    if k1 is not None:
        norm = F.lit(1.0) if mean_terms is None else 1 - b + b * F.size("_sorted") / F.lit(float(mean_terms))
        out = out.withColumn("weights", F.transform("weights", lambda n: n * (k1 + 1) / (n + k1 * norm)))
    return out.drop("_sorted", "_ends")


def _unit(vectors) -> np.ndarray:
    matrix = np.stack([np.asarray(v, dtype=np.float32) for v in vectors]).astype(np.float64)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


class _DenseBucket:
    """Vectors of a bucket in balls around pivots."""

    positive = False

    def __init__(self, queries: pd.DataFrame):
        self.names, self.queries = queries["query_id"].to_numpy(), _unit(queries["vector"])

    def load(self, rows: pd.DataFrame, most: int) -> list[np.ndarray]:
        self.ids, self.rows, self.most = rows["id"].to_numpy(), _unit(rows["vector"]), most
        count = -(-len(rows) // self.most)
        pivots = self.rows[np.linspace(0, len(rows) - 1, count).astype(np.int64)]
        near = self.rows @ pivots.T
        own = near.argmax(1)
        order = np.argsort(own, kind="stable")
        cuts = np.flatnonzero(np.diff(own[order])) + 1
        blocks = [part for ball in np.split(order, cuts) for part in np.split(ball, range(self.most, len(ball), self.most))]
        angle = np.arccos(np.clip(near[np.arange(len(rows)), own], -1, 1))
        # a vector of no length has no angle; its ball is the whole sphere
        angle[~self.rows.any(1)] = np.pi
        radius = np.array([angle[b].max() for b in blocks])
        away = np.arccos(np.clip(self.queries @ pivots[[own[b[0]] for b in blocks]].T, -1, 1))
        self.bounds = np.cos(np.maximum(away - radius, 0))
        return blocks

    def scores(self, asked: np.ndarray, block: np.ndarray) -> np.ndarray:
        return self.queries[asked] @ self.rows[block].T


class _SparseBucket:
    """Postings of a bucket; a row of ``queries`` for each query, a column for each of their terms."""

    positive = True

    def __init__(self, queries: pd.DataFrame):
        self.names, owners = np.unique(queries["query_id"].to_numpy(), return_inverse=True)
        self.terms, column = np.unique(queries["term"].to_numpy(), return_inverse=True)
        self.queries = np.zeros((len(self.names), len(self.terms)))
        self.queries[owners, column] = queries["weight"].to_numpy()

    def load(self, rows: pd.DataFrame, most: int) -> list[np.ndarray]:
        self.most = most
        self.ids, owner = np.unique(rows["id"].to_numpy(), return_inverse=True)
        weight, count = rows["weight"].to_numpy(), len(self.ids)
        column = np.searchsorted(self.terms, rows["term"].to_numpy())
        hit = (column < len(self.terms)) & (self.terms[np.minimum(column, len(self.terms) - 1)] == rows["term"].to_numpy())
        owner, weight, column = owner[hit], weight[hit], column[hit]
        # the heaviest documents first: they set the floor that the others have to reach
        order = np.argsort(-np.bincount(owner, weight, count), kind="stable")
        place = np.empty(count, np.int64)
        place[order] = np.arange(count)
        by_place = np.argsort(place[owner], kind="stable")
        self.column, self.place, self.weight = column[by_place], place[owner][by_place], weight[by_place]
        blocks = np.split(order, range(most, count, most))
        self.cuts = np.searchsorted(self.place, np.arange(len(blocks) + 1) * most)
        peaks = np.zeros((len(blocks), len(self.terms)))
        np.maximum.at(peaks, (self.place // most, self.column), self.weight)
        self.bounds = self.queries @ peaks.T
        self.number = {int(b[0]): n for n, b in enumerate(blocks)}
        return blocks

    def scores(self, asked: np.ndarray, block: np.ndarray) -> np.ndarray:
        number = self.number[int(block[0])]
        own = slice(self.cuts[number], self.cuts[number + 1])
        used, column = np.unique(self.column[own], return_inverse=True)
        matrix = np.zeros((len(used), len(block)))
        matrix[column, self.place[own] - number * self.most] = self.weight[own]
        return self.queries[np.ix_(asked, used)] @ matrix


def _bucket_best(bucket, rows: pd.DataFrame, k: int, block_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """(query, row, score) of the best ``k`` rows of each query, and the pairs of a query and a block that were read, and all."""
    blocks = bucket.load(rows, block_rows)
    ids = bucket.ids
    rank = np.empty(len(ids), np.int64)
    rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    count = len(bucket.queries)
    score, row = np.full((count, k), -np.inf), np.full((count, k), -1)
    bounds, read = np.round(bucket.bounds, DIGITS) + 10.0 ** -DIGITS, 0
    for number in np.argsort(-bounds.mean(0), kind="stable"):
        block = blocks[number]
        # a bound equal to the floor may still hold a smaller id
        asked = np.flatnonzero((bounds[:, number] >= score[:, -1]) & ((bounds[:, number] > 10.0 ** -DIGITS) | (not bucket.positive)))
        if not len(asked):
            continue
        read += len(asked)
        found = np.round(bucket.scores(asked, block), DIGITS)
        floor = score[asked, -1]
        if len(block) > k:
            floor = np.maximum(floor, np.partition(found, len(block) - k, axis=1)[:, len(block) - k])
        good = found >= floor[:, None]
        if bucket.positive:
            good &= found > 0
        q, r = np.nonzero(good)
        hit = np.unique(q)
        every = np.concatenate([asked[q], np.repeat(asked[hit], k)])
        scored, at = np.concatenate([found[q, r], score[asked[hit]].ravel()]), np.concatenate([block[r], row[asked[hit]].ravel()])
        order = np.lexsort((np.where(at >= 0, rank[at], len(ids)), -scored, every))
        every, scored, at = every[order], scored[order], at[order]
        nth = np.arange(len(every)) - np.searchsorted(every, every)
        score[every[nth < k], nth[nth < k]], row[every[nth < k], nth[nth < k]] = scored[nth < k], at[nth < k]
    query, nth = np.nonzero(row >= 0)
    return query, row[query, nth], score[query, nth], read, count * len(blocks)


class _Best:
    """The best ``k`` documents of each (query, collection) over the buckets of a task."""

    def __init__(self, k: int):
        self.k, self.found, self.held = k, {}, 0

    def add(self, query, collection, ids: np.ndarray, scores: np.ndarray) -> None:
        old = self.found.get((query, collection))
        if old is not None:
            self.held -= len(old[0])
            scores, ids = np.concatenate([old[0], scores]), np.concatenate([old[1], ids])
            # a row that a query sees from two places counts once
            order = np.lexsort((np.unique(ids, return_inverse=True)[1], -scores))
            _, first = np.unique(ids[order], return_index=True)
            order = order[np.sort(first)][:self.k]
            scores, ids = scores[order], ids[order]
        self.found[query, collection] = (scores, ids)
        self.held += len(ids)

    def frames(self) -> Iterator[pd.DataFrame]:
        if self.found:
            sizes = [len(ids) for _, ids in self.found.values()]
            yield pd.DataFrame({"query_id": np.repeat(np.array([q for q, _ in self.found], dtype=object), sizes),
                                "collection": np.repeat(np.array([c for _, c in self.found], dtype=object), sizes),
                                "id": np.concatenate([ids for _, ids in self.found.values()]),
                                "score": np.concatenate([scores for scores, _ in self.found.values()])})
        self.found, self.held = {}, 0


def _runs(values: list[np.ndarray]) -> list[tuple[int, int]]:
    """Stretches of equal neighbouring rows."""
    changed = np.zeros(len(values[0]), bool)
    changed[0] = True
    for column in values:
        changed[1:] |= column[1:] != column[:-1]
    starts = np.flatnonzero(changed)
    return list(zip(starts, [*starts[1:], len(changed)]))


def _sizes(corpus: DataFrame, width: Column) -> DataFrame:
    """Buckets of each place, from the bytes of what is stored there."""
    return corpus.groupBy("place").agg(F.greatest(F.ceil(F.sum(width) / BUCKET_BYTES), F.ceil(F.count("*") / BUCKET_ROWS), F.lit(1)).cast("int").alias("buckets"))


def _met(queries: DataFrame, corpus: DataFrame, vector: list[str], sizes: DataFrame) -> DataFrame:
    """Both sides in one stream: for each (place, part, bucket) its queries, then its documents by collection."""
    id_type = corpus.schema["id"].dataType
    parts = queries.groupBy("place").agg(F.ceil(F.count_distinct("query_id") / QUERY_ROWS).cast("int").alias("parts"))
    met = sizes.join(parts, "place")
    upto = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    q = queries.select("place", "query_id", *vector).join(met, "place").withColumns({"part": F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int"), "bucket": upto("buckets")})
    d = corpus.select("place", "collection", "id", *vector).join(met, "place").withColumns({"bucket": F.pmod(F.xxhash64("id"), F.col("buckets")).cast("int"), "part": upto("parts")})
    nothing = F.lit(None)
    both = (q.select("place", "part", "bucket", F.lit(0).alias("side"), "query_id", nothing.cast("string").alias("collection"), nothing.cast(id_type).alias("id"), *vector)
            .unionByName(d.select("place", "part", "bucket", F.lit(1).alias("side"), nothing.cast(queries.schema["query_id"].dataType).alias("query_id"), "collection", "id", *vector)))
    return both.repartition("place", "part", "bucket").sortWithinPartitions("place", "part", "bucket", "side", "collection")


def _buckets(batches: Iterator[pd.DataFrame], kind) -> Iterator[tuple]:
    """``(bucket, collection, its rows)`` of a stream of :func:`_met`; a bucket's rows are bounded."""
    columns = ("place", "part", "bucket", "side", "collection")
    here, asked, ready, held, collection = None, [], None, [], None

    def flush():
        nonlocal held, ready
        if held and asked:
            if ready is None:
                rows = pd.concat(asked, ignore_index=True)
                ready = kind(rows)
            yield ready, collection, pd.concat(held, ignore_index=True)
        held = []

    for batch in batches:
        if not len(batch):
            continue
        values = [batch[name].to_numpy() for name in columns]
        for start, end in _runs(values):
            key, side, own = tuple(v[start] for v in values[:3]), values[3][start], values[4][start]
            if key != here or own != collection:
                yield from flush()
            if key != here:
                here, asked, ready = key, [], None
            collection = own
            (held if side else asked).append(batch.iloc[start:end])
    yield from flush()


def _top(queries: DataFrame, corpus: DataFrame, vector: list[str], sizes: DataFrame, kind, k: int, order_name: str) -> DataFrame:
    id_type, block_rows, most_held = corpus.schema["id"].dataType, BLOCK_ROWS, HELD_RESULTS
    schema = T.StructType([T.StructField("query_id", T.StringType()), T.StructField("collection", T.StringType()),
                           T.StructField("id", id_type), T.StructField("score", T.DoubleType())])

    def best_of_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = _Best(k)
        for bucket, collection, rows in _buckets(batches, kind):
            query, row, score, _, _ = _bucket_best(bucket, rows, k, block_rows)
            names, ids = bucket.names, bucket.ids
            ids = ids if id_type == T.StringType() else ids.astype(np.int64)
            cuts = np.flatnonzero(np.diff(query)) + 1
            for part in np.split(np.arange(len(query)), cuts):
                if len(part):
                    best.add(names[query[part[0]]], collection, ids[row[part]], score[part])
            if best.held > most_held:
                yield from best.frames()
        yield from best.frames()

    found = _met(queries, corpus, vector, sizes).mapInPandas(best_of_task, schema)
    # The same row can be visible from two places of one query.
    once = found.groupBy("query_id", "collection", "id").agg(F.max("score").alias("score"))
    return top_per(once, ["query_id", "collection"], [F.col("score").desc(), F.col("id")], k, order_name)


def _shares(queries: DataFrame, corpus: DataFrame, vector: list[str], sizes: DataFrame, kind, k: int) -> DataFrame:
    block_rows = BLOCK_ROWS

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = every = 0
        for bucket, _, rows in _buckets(batches, kind):
            own = _bucket_best(bucket, rows, k, block_rows)
            read, every = read + own[3], every + own[4]
        yield pd.DataFrame({"blocks_read": [read], "blocks": [every]})

    return _met(queries, corpus, vector, sizes).mapInPandas(counted, "blocks_read bigint, blocks bigint").agg(F.sum("blocks_read").alias("blocks_read"), F.sum("blocks").alias("blocks"))


def _dense(queries: DataFrame, corpus: DataFrame) -> tuple:
    has = F.col("vector").isNotNull()
    return queries.where(has), corpus.where(has), ["vector"], _sizes(corpus.where(has), F.size("vector") * 4), _DenseBucket


def dense_top(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Best ``k`` of each collection by cosine, with ``dense_rank``.

    ``queries(query_id, place, vector)``, ``corpus(id, place, collection, vector)``; rows without a vector take no part.
    """
    return _top(*_dense(queries, corpus), k, "dense_rank")


def _sparse(queries: DataFrame, corpus: DataFrame, k1: float | None, b: float, mean_terms: float | None) -> tuple:
    """Postings of both sides, only those of terms that the place's queries have, as 64-bit hashes.

    The join that drops all other terms compares the terms themselves; two terms of
    one place's queries would have to share a hash to be taken for each other.
    """
    def postings(df: DataFrame, key: list[str]) -> DataFrame:
        encoded = encode_terms(df, "text", k1, b, mean_terms)
        return explode_computed(encoded, key, F.arrays_zip("terms", "weights"), "n", "p").select(*key, F.col("p.terms").alias("term"), F.col("p.weights").alias("weight"))

    asked = postings(queries, ["place", "query_id"])
    wanted = asked.select("place", "term").distinct()
    if wanted.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        wanted = F.broadcast(wanted)
    hashed = lambda df, key: df.select(*key, F.xxhash64("term").alias("term"), "weight")
    own = ["place", "collection", "id"]
    kept = hashed(postings(spread(corpus), own).join(wanted, ["place", "term"], "left_semi"), own)
    return hashed(asked, ["place", "query_id"]), kept, ["term", "weight"], _sizes(corpus, F.octet_length("text")), _SparseBucket


def sparse_top(queries: DataFrame, corpus: DataFrame, k: int, k1: float | None = None, b: float = 0.75, mean_terms: float | None = None) -> DataFrame:
    """Best ``k`` of each collection by shared term weights, with ``sparse_rank``; no overlap, no hit.

    ``queries(query_id, place, text)``, ``corpus(id, place, collection, text)``.
    """
    return _top(*_sparse(queries, corpus, k1, b, mean_terms), k, "sparse_rank")


def dense_shares(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """``blocks_read, blocks``: pairs of a query and a block that :func:`dense_top` scores, and all."""
    return _shares(*_dense(queries, corpus), k)


def sparse_shares(queries: DataFrame, corpus: DataFrame, k: int, k1: float | None = None, b: float = 0.75, mean_terms: float | None = None) -> DataFrame:
    """As :func:`dense_shares`, for :func:`sparse_top`."""
    return _shares(*_sparse(queries, corpus, k1, b, mean_terms), k)
