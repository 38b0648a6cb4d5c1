"""Joins on keys of which a few hold a large share of the rows, and cuts of a table to the keys that are asked for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest import constants as C
from palimpsest.session import cut_lineage

# A key with more than this share of the rows is split; so many keys at most can have it, and the sketch tracks a multiple of them.
SHARE = 1 / 64
TRACKED = 4096
# Up to so many keys, some 10 MB, go to the other side; more meet it in a shuffle.
BROADCAST_KEYS = 100_000


def packed_key(keys: list[str]) -> Column:
    return F.concat_ws(C.UNIT_SEPARATOR, *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])


def heavy_keys(df: DataFrame, keys: list[str], share: float = SHARE) -> DataFrame:
    """``heavy, salts``: keys with more than ``share`` of the rows, and how many parts each is worth.

    A frequent-items sketch finds them in one pass.  It tracks far more keys than can
    reach the share, so none is missed; a count that is a little high only means one part more.
    """
    most = int(1 / share)
    sketch = df.select(packed_key(keys).alias("key")).agg(F.expr(f"approx_top_k(key, {most}, {TRACKED})").alias("items"), F.count("*").alias("total"))
    found = sketch.select("total", F.explode("items").alias("i")).where(F.col("i.count") > F.col("total") * share)
    return found.select(F.col("i.item").alias("heavy"), F.ceil(F.col("i.count") / (F.col("total") * share)).cast("int").alias("salts"))


def salted_join(asked: DataFrame, index: DataFrame, keys: list[str], spread_by: str, share: float = SHARE) -> DataFrame:
    """Inner join on ``keys``; rows of ``index`` with a heavy key are dealt by ``spread_by`` and the rows that ask for it go to each part.

    The list of heavy keys has at most ``1 / share`` rows, so it is broadcast whatever the tables.
    """
    heavy = F.broadcast(heavy_keys(index, keys, share))
    tagged = lambda df: df.withColumn("_key", packed_key(keys)).join(heavy, F.col("_key") == F.col("heavy"), "left").drop("_key", "heavy")
    part = F.coalesce(F.pmod(F.xxhash64(spread_by), F.col("salts")), F.lit(0)).cast("int")
    dealt = tagged(index).withColumn("_part", part).drop("salts")
    every = tagged(asked).withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return every.join(dealt, [*keys, "_part"]).drop("_part")


def wanted(keys: DataFrame) -> DataFrame:
    """The distinct rows of ``keys``, written once; few are sent to the tables that :func:`among` cuts, many meet them in a shuffle."""
    made = cut_lineage(keys.distinct())
    return F.broadcast(made) if made.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else made


def among(df: DataFrame, keys: DataFrame, *columns: Column) -> DataFrame:
    """Rows of ``df``, each as often as it is there, of which one of ``columns`` is among ``keys``, as :func:`wanted` makes them.

    A null is among keys that hold one.
    """
    if len(columns) == 1:
        return df.join(keys.toDF("_key"), columns[0].eqNullSafe(F.col("_key")), "left_semi")
    found = df
    for number, column in enumerate(columns):
        found = found.join(keys.select(F.col(keys.columns[0]).alias(f"_key{number}"), F.lit(True).alias(f"_has{number}")), column.eqNullSafe(F.col(f"_key{number}")), "left")
    has = [F.coalesce(F.col(f"_has{number}"), F.lit(False)) for number in range(len(columns))]
    return found.where(reduce(Column.__or__, has)).select(*df.columns)
