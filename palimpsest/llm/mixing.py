"""Temperature mixing of sources with DataFrame functions only.

A source's weight is its share of tokens raised to an exponent between 0 (all sources alike) and 1 (as they are), normalised.  The
exponent is bisected so that the weights reach a target entropy, or lie as near to it as a limit on repetitions allows.
The weights become token budgets, and a budget is realised as whole epochs and the first part of one more epoch.
An epoch is a permutation of the source's blocks and of the rows in each block, both by hash, so a row's copies follow
from its own columns and four numbers of its source: no text moves, and a large source is never in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.common import as_text, written

TARGET_ENTROPY, MOST_REPEATS = 0.95, 2.0
#: Tokens of a block, about, and blocks of a small source.
BLOCK_TOKENS, LEAST_BLOCKS = 1_000_000, 256
#: Exponents tried in one round, and rounds; each round narrows the exponent by that factor.
TRIED, ROUNDS = 32, 6
#: More sources than these are joined by shuffle.
BROADCAST_SOURCES = 50_000
_DRAWN = 1 << 31


def _source(column: Column) -> Column:
    return F.when(column.isNull(), F.lit("none")).otherwise(F.concat(F.lit("="), column.cast("string")))


def _draw(id_column: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), as_text(id_column)), F.lit(_DRAWN))


def _mark(*parts: Column) -> Column:
    """A number of 62 bits that orders blocks or rows of an epoch."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 2)


def tokens_of(text: Column) -> Column:
    return F.regexp_count(as_text(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def exponent(totals: DataFrame, target_entropy: float | None, most_repeats: float | None, budget: float | None) -> float:
    """The least exponent in 0 .. 1 whose weights are not above the target entropy (a share of the greatest possible one)
    and repeat no source more than ``most_repeats`` times; 1 if none does."""
    whole = totals.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    if not whole["t"] or whole["n"] < 2:
        return 1.0
    most = math.log(whole["n"])
    shares = totals.select((F.col("tokens") / whole["t"]).alias("p"))
    low, high = 0.0, 1.0

    def holds(row) -> bool:
        entropy = math.log(row["z"]) - row["x"] * row["s"] / row["z"]
        if target_entropy is not None and entropy > target_entropy * most + 1e-12:
            return False
        # a source's epochs are its budget over its tokens; without a budget the least repeated source has one epoch
        epochs = row["top"] / row["least"] if budget is None else row["top"] / row["z"] * budget / whole["t"]
        return most_repeats is None or epochs <= most_repeats + 1e-12

    for _ in range(ROUNDS):
        step = (high - low) / TRIED
        tried = shares.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(TRIED)))).withColumn("x", F.lit(low) + F.col("x") * F.lit(step))
        power = F.pow("p", F.col("x"))
        rows = tried.groupBy("x").agg(F.sum(power).alias("z"), F.sum(power * F.log("p")).alias("s"), F.max(power / F.col("p")).alias("top"), F.min(power / F.col("p")).alias("least")).collect()
        good = sorted(r["x"] for r in rows if holds(r))
        bad = [r["x"] for r in rows if not holds(r)]
        if not good:
            return 1.0
        high, low = good[0], max([x for x in bad if x < good[0]], default=good[0])
        if low == high:
            break
    return high


def quotas(sized: DataFrame, target_entropy: float | None = TARGET_ENTROPY, most_repeats: float | None = MOST_REPEATS, budget: float | None = None,
           block_tokens: int = BLOCK_TOKENS, seed: int = 0) -> DataFrame:
    """For each source ``source, tokens, weight, goal`` (its token budget), ``full`` epochs, number of ``blocks`` and where the last epoch
    ends: ``cut_block`` and ``cut_row``.  ``sized`` has ``id, source, tokens, draw``."""
    totals = written(sized.groupBy("source").agg(F.sum("tokens").alias("tokens")), "mix-totals")
    some = totals.where("tokens > 0")
    power = exponent(some, target_entropy, most_repeats, budget)
    whole = some.agg(F.sum("tokens").alias("t"), F.sum(F.pow("tokens", F.lit(power))).alias("z"), F.max(F.pow("tokens", F.lit(1 - power))).alias("most")).first()
    goal = F.pow("tokens", F.lit(power)) * F.lit((budget / whole["z"] if budget is not None else whole["most"]) if whole["z"] else 0.0)
    planned = totals.select("source", "tokens", F.when(F.col("tokens") > 0, F.pow("tokens", F.lit(power)) / F.lit(whole["z"] or 1.0)).otherwise(0.0).alias("weight"),
                            F.when(F.col("tokens") > 0, goal).otherwise(F.lit(0.0)).alias("goal"), F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.col("tokens") / block_tokens)).cast("long").alias("blocks"))
    # a source without tokens costs nothing and is taken once; a hair below a whole epoch counts as one
    planned = planned.withColumn("full", F.when(F.col("tokens") > 0, F.floor(F.col("goal") / F.col("tokens") + 1e-9)).otherwise(1).cast("long"))
    planned = written(planned.withColumn("rest", F.greatest(F.lit(0.0), F.col("goal") - F.col("full") * F.col("tokens"))), "mix-plan")
    last = _in_epoch(_with_sources(sized, planned), F.col("full") + 1, seed).where("rest > 0")
    blocks = last.groupBy("source", "block_mark").agg(F.sum("tokens").alias("held"), F.first("rest").alias("rest"))
    before = Window.partitionBy("source").orderBy("block_mark").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0)))
    # the block in which the budget ends, one for each source
    ends = written(blocks.where("before <= rest and before + held > rest").groupBy("source").agg(F.max(F.struct("block_mark", "before")).alias("end"))
                   .select("source", F.col("end.block_mark").alias("cut_block"), F.col("end.before").alias("before")), "mix-ends")
    inside = last.join(ends, "source").where("block_mark = cut_block")
    running = Window.partitionBy("source").orderBy("row_mark").rangeBetween(Window.unboundedPreceding, 0)
    cuts = inside.withColumn("sum", F.sum("tokens").over(running)).where("before + sum <= rest").groupBy("source").agg(F.max("row_mark").alias("cut_row"))
    return written(planned.join(ends.drop("before"), "source", "left").join(cuts, "source", "left")
                   .select("source", F.col("tokens").alias("source_tokens"), "weight", "goal", "full", "blocks", "rest", "cut_block", F.coalesce("cut_row", F.lit(-1)).alias("cut_row")), "mix-quotas")


def _with_sources(rows: DataFrame, table: DataFrame) -> DataFrame:
    extra = table.drop("tokens") if "tokens" in rows.columns else table
    small = table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(extra) if small else extra, "source")


def _in_epoch(rows: DataFrame, epoch: Column, seed: int) -> DataFrame:
    """The block of each row, the block's place and the row's place in it in one epoch."""
    block = F.floor(F.col("draw") / F.lit(float(_DRAWN)) * F.col("blocks"))
    return (rows.withColumn("block", block).withColumn("block_mark", _mark(F.lit(seed), F.lit("block"), F.col("source"), F.col("block"), epoch))
            .withColumn("row_mark", _mark(F.lit(seed), F.lit("row"), F.col("draw"), as_text(F.col("id")), epoch)))


def copies(rows: DataFrame, table: DataFrame, seed: int) -> DataFrame:
    """``rows`` (id, source, draw, ...) with their number of ``copies`` and their source's quota."""
    placed = _in_epoch(_with_sources(rows, table), F.col("full") + 1, seed)
    part = (F.col("rest") > 0) & (F.col("cut_block").isNull() | (F.col("block_mark") < F.col("cut_block"))
                                  | ((F.col("block_mark") == F.col("cut_block")) & (F.col("row_mark") <= F.col("cut_row"))))
    return placed.withColumn("copies", F.col("full") + part.cast("long"))


def mixture(df: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", seed: int = 0, **goals) -> DataFrame:
    """One row for each copy of each row that the mixture holds: ``id, source, n_tokens, epoch, block, place``.

    ``place`` in 0 .. 1 orders the mixture so that every stretch of it has about the weights; within a source it follows the
    permutation of blocks.  Goals are those of ``quotas``; without a budget every row is there at least once.  A null source is
    a source of its own; null and empty texts have no tokens and go with their block.  Rows that repeat id and source share their
    fate.  An empty table gives an empty result; other columns are ignored.
    """
    sized = written(df.select(F.col(id_column).alias("id"), F.col(source_column).alias("name"), _source(F.col(source_column)).alias("source"),
                              tokens_of(F.col(text_column)).alias("tokens"), _draw(F.col(id_column), seed).alias("draw")), "mix-sizes")
    table = quotas(sized, seed=seed, **goals)
    taken = copies(sized, table, seed).where("copies > 0").drop("block_mark", "row_mark", "block").withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    placed = _in_epoch(taken, F.col("epoch"), seed)
    share = (F.col("epoch") - 1 + F.col("block_mark") / F.lit(float(1 << 62))) / F.greatest(F.lit(1.0), F.col("goal") / F.greatest(F.col("source_tokens"), F.lit(1)))
    return placed.select("id", F.col("name").alias("source"), F.col("tokens").alias("n_tokens"), "epoch", F.col("block").cast("long").alias("block"), F.least(share, F.lit(1.0)).alias("place"))


def mix_rows(df: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", seed: int = 0, **goals) -> DataFrame:
    """The rows of ``df`` as often as the mixture holds them, whole and with all their columns, whatever these are called."""
    keys = {"id": F.col(id_column), "source": _source(F.col(source_column)), "draw": _draw(F.col(id_column), seed)}
    sized = written(df.select(*[c.alias(n) for n, c in keys.items()], tokens_of(F.col(text_column)).alias("tokens")), "mix-sizes")
    table = quotas(sized, seed=seed, **goals)
    whole = df.select(*[c.alias(n) for n, c in keys.items()], F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]).alias("whole"))
    taken = copies(whole, table, seed).select("whole", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return taken.select(*[F.col(f"whole.c{i}").alias(c) for i, c in enumerate(df.columns)])
