"""Token-bounded chunks with overlap, and section blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest import constants as C
from palimpsest.functions import keys, text as tx
from palimpsest.operators.ordered import explode_computed
from palimpsest.session import spread


def units(text: Column, max_tokens: int) -> Column:
    """Text pieces with their token cost: paragraphs, else sentences, else words."""
    counted = lambda piece: F.struct(piece.alias("text"), tx.token_count(piece).cast("int").alias("tokens"))
    word = lambda w: F.struct(w.alias("text"), tx.token_count(F.concat(w, F.lit(" "))).cast("int").alias("tokens"))
    pieces = F.flatten(F.transform(F.transform(tx.paragraphs(text), counted), lambda p: F.when(
        p["tokens"] <= max_tokens, F.array(p)).otherwise(F.transform(tx.sentences(p["text"]), counted))))
    return F.flatten(F.transform(pieces, lambda s: F.when(
        s["tokens"] <= max_tokens, F.array(s)).otherwise(F.transform(tx.words(s["text"]), word))))


def tail(text: Column, count: int) -> Column:
    """The last ``count`` tokens of a text, or all of it."""
    found = tx.tokens(text)
    return F.when(F.size(found) <= count, text).otherwise(F.array_join(F.slice(found, -count, count), ""))


STATE = "struct<chunks:array<string>,parts:array<string>,used:int,carry:string>"


def chunk(pieces: Column, max_tokens: int, overlap: int) -> Column:
    """Fold units into chunks; each new chunk starts with the tail of the one before."""
    strings = "array<string>"
    start = F.struct(F.array().cast(strings).alias("chunks"), F.array().cast(strings).alias("parts"),
                     F.lit(0).alias("used"), F.lit("").alias("carry")).cast(STATE)
    whole = lambda acc: tx.strip_blanks(F.concat(acc["carry"], F.lit(" "), F.array_join(acc["parts"], " ")))

    def carried(found, text):
        """(carry, its tokens) given the tokens of a closed chunk."""
        kept = F.slice(found, -F.least(F.size(found), F.lit(overlap)), F.lit(overlap))
        return F.struct(F.when(F.size(found) <= overlap, text).otherwise(F.array_join(kept, "")).alias("carry"),
                        F.least(F.size(found), F.lit(overlap)).alias("used"))

    def step(acc, unit):
        full = (acc["used"] + unit["tokens"] > max_tokens) & (F.size(acc["parts"]) > 0)
        close = lambda text: tx.let(tx.let(tx.tokens(text), lambda found: carried(found, text)), lambda tail_: F.struct(
            F.concat(acc["chunks"], F.array(text)).alias("chunks"), F.array(unit["text"]).alias("parts"),
            (tail_["used"] + unit["tokens"]).alias("used"), tail_["carry"].alias("carry")))
        grow = F.struct(acc["chunks"].alias("chunks"), F.concat(acc["parts"], F.array(unit["text"])).alias("parts"),
                        (acc["used"] + unit["tokens"]).alias("used"), acc["carry"].alias("carry"))
        return F.when(full, tx.let(whole(acc), close)).otherwise(grow).cast(STATE)

    return F.aggregate(pieces, start, step, lambda acc: F.when(
        F.size(acc["parts"]) > 0, F.concat(acc["chunks"], F.array(whole(acc)))).otherwise(acc["chunks"]))


def split_text(df: DataFrame, text: str = "content", max_tokens: int = C.CHUNK_TOKENS, overlap: int = C.OVERLAP_TOKENS) -> DataFrame:
    """Add ``chunks``, the chunk texts of each row."""
    pieces = spread(df).withColumn("_units", units(F.col(text), max_tokens))
    return pieces.withColumn("chunks", chunk(F.col("_units"), max_tokens, overlap)).drop("_units")


def chunk_rows(blocks: DataFrame, max_tokens: int = C.CHUNK_TOKENS, overlap: int = C.OVERLAP_TOKENS) -> DataFrame:
    """One row per chunk.  Blocks that fit keep their id and text; others get child ids."""
    split = split_text(blocks, "content", max_tokens, overlap)
    fits = (F.size("chunks") == 1) & (tx.token_count(F.get("chunks", F.lit(0))) <= max_tokens)
    kept = [name for name in split.columns if name not in ("chunks", "content", "chunk_id")]
    parts = explode_computed(split.withColumn("_fits", fits), [
        *kept, F.col("chunk_id").alias("parent_id"), F.col("content").alias("_whole"), "_fits"], F.col("chunks"), "position", "_part")
    return parts.select(
        *[name for name in parts.columns if not name.startswith("_")],
        F.when(F.col("_fits"), F.col("parent_id")).otherwise(keys.child_id(F.col("parent_id"), F.col("position"))).alias("chunk_id"),
        F.when(F.col("_fits"), F.col("_whole")).otherwise(F.col("_part")).alias("content"))


BLOCK = "struct<page:int,content:string>"


def section_blocks(items: Column, limit: int = C.SECTION_CHARS) -> Column:
    """Layout items of one document, in reading order, joined into blocks.

    A heading or a new page closes the open block, as does reaching ``limit``
    characters.  A short upper-case heading opens a top section, others nest.
    """
    state = F.struct(F.array().cast(f"array<{BLOCK}>").alias("done"), F.array().cast("array<string>").alias("lines"),
                     F.lit(0).alias("chars"), F.lit(None).cast("int").alias("page"), F.lit("").alias("top"), F.lit("").alias("section"))

    def closed(acc):
        block = F.struct(acc["page"].alias("page"), F.concat(
            tx.section_prefix(acc["top"], acc["section"]), F.array_join(acc["lines"], "\n")).alias("content"))
        return F.when(F.size(acc["lines"]) > 0, F.concat(acc["done"], F.array(block))).otherwise(acc["done"])

    def step(acc, item):
        heading = item["item_type"] == "SectionHeaderItem"
        top_heading = heading & (F.upper(item["text"]) == item["text"]) & item["text"].rlike(r"\p{Lu}") & (F.length(item["text"]) <= C.TOP_HEADING_CHARS)
        turned = acc["page"].isNotNull() & item["page"].isNotNull() & (item["page"] != acc["page"])
        cut = heading | turned
        lines = F.when(cut, F.array().cast("array<string>")).otherwise(acc["lines"])
        added = (F.when(top_heading, F.array().cast("array<string>")).when(heading, F.array(F.concat(F.lit("## "), item["text"])))
                 .otherwise(F.array(item["text"])))
        grown = F.concat(lines, added)
        chars = F.when(cut, 0).otherwise(acc["chars"]) + F.length(F.array_join(added, ""))
        page = F.when(heading | acc["page"].isNull() | turned, item["page"]).otherwise(acc["page"])
        top = F.when(top_heading, item["text"]).otherwise(acc["top"])
        section = F.when(heading, item["text"]).otherwise(acc["section"])
        done = F.when(cut, closed(acc)).otherwise(acc["done"])
        full = ~heading & (chars >= limit)
        after = F.struct(done.alias("done"), grown.alias("lines"), page.alias("page"), top.alias("top"), section.alias("section"))
        return F.struct(
            F.when(full, closed(after)).otherwise(done).cast(f"array<{BLOCK}>").alias("done"),
            F.when(full, F.array().cast("array<string>")).otherwise(grown).alias("lines"),
            F.when(full, 0).otherwise(chars).alias("chars"), page.alias("page"), top.alias("top"), section.alias("section"))

    return F.aggregate(items, state, step, closed)


def section_rows(items: DataFrame, key: str) -> DataFrame:
    """Section blocks of every document; a document's own items are folded in order."""
    row = F.struct("seq", "item_type", "text", F.col("page").cast("int").alias("page"))
    grouped = items.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("items"))
    blocks = explode_computed(grouped, [key], section_blocks(F.col("items")), "seq", "b")
    return blocks.select(key, "seq", "b.page", "b.content")
