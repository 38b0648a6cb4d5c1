"""Order-dependent operators that do not put a whole group into one task.

A running value over a group is computed in two levels.  The group is cut into
buckets by a non-decreasing function of its first order column; each bucket is
handled on its own, and only one summary row per bucket is ordered within the
group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank_as: str | None = None) -> DataFrame:
    """First ``n`` rows per key.  Spark cuts each task's input to ``n`` rows a key before the shuffle."""
    name = rank_as or "_rank"
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return ranked if rank_as else ranked.drop(name)


def ordinal(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, name: str) -> DataFrame:
    """1-based position of each row in its group."""
    cut = df.withColumn("_bucket", bucket)
    local = cut.withColumn("_local", F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(*order)))
    sizes = cut.groupBy(*keys, "_bucket").agg(F.count("*").alias("_size"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return (local.join(offsets, [*keys, "_bucket"])
            .withColumn(name, (F.col("_offset") + F.col("_local")).cast("long"))
            .drop("_bucket", "_local", "_offset"))


def last_before(df: DataFrame, keys: list[str], order: list[Column], bucket: Column,
                value: Column, name: str, last_in_bucket: Column) -> DataFrame:
    """Last non-null ``value`` strictly before each row.

    ``last_in_bucket`` orders the rows of one bucket, so that its last value can
    be taken by aggregation.
    """
    cut = df.withColumn("_bucket", bucket).withColumn("_value", value)
    earlier_rows = W.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = cut.withColumn("_local", F.last("_value", ignorenulls=True).over(earlier_rows))
    tails = cut.groupBy(*keys, "_bucket").agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), last_in_bucket)).alias("_tail"))
    earlier_buckets = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = tails.select(*keys, "_bucket", F.last("_tail", ignorenulls=True).over(earlier_buckets).alias("_carried"))
    return (local.join(carried, [*keys, "_bucket"])
            .withColumn(name, F.coalesce("_local", "_carried")).drop("_bucket", "_value", "_local", "_carried"))


def recent(df: DataFrame, keys: list[str], position: str, item: Column, n: int, name: str,
           span: int = 1000) -> DataFrame:
    """The up to ``n`` items before each row, oldest first, by dense ``position``.

    ``position`` must be gapless within a group, as :func:`ordinal` makes it.  Each
    row also goes to every later bucket of ``span`` positions that it is within
    ``n`` positions of, where it only serves as context.
    """
    position_col = F.col(position)
    own = F.floor(position_col / span)
    copies = F.sequence(own, F.floor((position_col + n) / span))
    spread = df.withColumn("_item", item).withColumn("_own", own).withColumn("_bucket", F.explode(copies))
    frame = W.partitionBy(*keys, "_bucket").orderBy(position).rowsBetween(-n, -1)
    return (spread.withColumn(name, F.collect_list("_item").over(frame))
            .where(F.col("_own") == F.col("_bucket")).drop("_item", "_own", "_bucket"))


def joined_in_order(df: DataFrame, keys: list[str], order: list[Column], text: Column, separator: str,
                    name: str) -> DataFrame:
    """Texts of a bounded group (a document's blocks, a prompt's sources) joined in order."""
    rows = F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], text.alias("text"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["text"]), separator).alias(name))


def explode_computed(df: DataFrame, keep: list, array: Column, position: str, item: str) -> DataFrame:
    """One row per element of an array that is costly to compute.

    A plain explode makes the optimiser test the array for emptiness first,
    which computes it again; the outer form computes it once.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(position, item))
    return rows.where(F.col(position).isNotNull())
