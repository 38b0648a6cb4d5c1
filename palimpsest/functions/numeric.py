"""Vector and score expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest import constants as C


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def rank_term(rank: Column, k: int = C.RRF_K) -> Column:
    """Reciprocal-rank term; a list that misses the item adds nothing."""
    return F.coalesce(F.lit(1.0) / (F.lit(k) + rank), F.lit(0.0))


def map_lookup(mapping: dict, key: Column, default) -> Column:
    literal = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(literal[key], F.lit(default))


def collection_weight(collection: Column) -> Column:
    return map_lookup(C.COLLECTION_WEIGHTS, collection, 1.0)


def floored_ratio(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def points_bbox(points: Column) -> Column:
    """One box around all (x, y) points; null without points."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.when(F.size(points) > 0, F.struct(
        F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"),
        F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")))


def hashed_buckets(terms: Column, dimension: int = 64) -> Column:
    """Hash bucket of every term."""
    return F.transform(terms, lambda t: F.conv(F.substring(F.md5(F.encode(t, "UTF-8")), 1, 4), 16, 10).cast("int") % dimension)


def hashed_embedding(df: DataFrame, keys: list[str], terms: Column, dimension: int = 64) -> DataFrame:
    """Built-in encoder as sparse rows: counts of terms per hash bucket.  Plug in a model for real use."""
    return df.select(*keys, F.explode(hashed_buckets(terms, dimension)).alias("bucket")).groupBy(*keys, "bucket").agg(F.count("*").alias("n"))
