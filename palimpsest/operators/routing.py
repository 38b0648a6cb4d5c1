"""Page routing, page and image evidence, and chunk/evidence row shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest import constants as C
from palimpsest.functions import keys, numeric, text as tx
from palimpsest.operators import quality
from palimpsest.session import spread


def accepted_ocr(lines: Column) -> Column:
    """Recognised lines of enough confidence, in order, one per line."""
    kept = F.filter(lines, lambda l: (tx.strip_blanks(l["text"]) != "") & (l["confidence"] >= C.OCR_LINE_CONFIDENCE))
    return F.array_join(F.transform(kept, lambda l: tx.strip_blanks(l["text"])), "\n")


def preflight(pages: DataFrame, min_chars: int = C.NATIVE_MIN_CHARS) -> DataFrame:
    """First route of each page: native, blank, ocr or uncertain."""
    usable = tx.usable_native_text(tx.text_metrics(F.col("native_text")), min_chars)
    route = (F.when(F.col("read_failed"), "uncertain").when(usable, "native")
             .when(F.col("visual_ratio") < C.BLANK_VISUAL_RATIO, "blank").otherwise("ocr"))
    return spread(pages).withColumn("route", route)


def fallback_measures(pages: DataFrame) -> DataFrame:
    """Share of pages without native text, and whether any page is uncertain."""
    is_ = lambda route: F.col("route") == route
    weak = F.count_if(is_("ocr") | is_("uncertain"))
    return pages.groupBy("asset_id").agg(
        F.count_if(~is_("blank")).alias("nonblank"), weak.alias("weak"),
        numeric.floored_ratio(weak, F.count_if(~is_("blank"))).alias("fallback_ratio"),
        F.bool_or(is_("uncertain")).alias("any_uncertain"), F.bool_or(is_("ocr")).alias("any_ocr"))


def settle_ocr(pages: DataFrame) -> DataFrame:
    """An ocr page whose recognised text is unusable only shows a picture."""
    usable = tx.usable_ocr(tx.text_metrics(F.coalesce("ocr_text", F.lit(""))))
    return pages.withColumn("route", F.when((F.col("route") == "ocr") & ~usable, "visual_only").otherwise(F.col("route")))


def route_counts(pages: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("route") == name).alias(f"pages_{name}") for name in ("native", "ocr", "blank", "visual_only", "uncertain")]
    return pages.groupBy("asset_id").agg(F.count("*").alias("pages_total"), *counts)


def page_blocks(pages: DataFrame) -> DataFrame:
    """One evidence block per native or ocr page, with a stable id."""
    native = F.col("route") == "native"
    content = tx.strip_blanks(F.when(native, F.col("native_text")).otherwise(F.coalesce("ocr_text", F.lit(""))))
    representation = F.when(native, "text").otherwise("ocr")
    return pages.where(F.col("route").isin("native", "ocr")).select(
        "asset_id", "page", content.alias("content"), representation.alias("representation"),
        F.when(native, "pdf-native").otherwise("pdf-ocr").alias("parser_backend"),
        keys.block_id(F.col("asset_id"), F.concat_ws(":", F.lit("pdf"), F.col("page"), representation, F.lit("0"))).alias("chunk_id"))


def quality_gate(pages: DataFrame) -> DataFrame:
    """Expected pages are all represented and hold enough text."""
    blocks = page_blocks(pages).groupBy("asset_id").agg(
        F.count_distinct("page").alias("represented"), F.sum(F.length("content")).alias("chars"))
    expected = pages.groupBy("asset_id").agg(F.count_if(F.col("route").isin("native", "ocr")).alias("expected"))
    joined = expected.join(blocks, "asset_id", "left").fillna(0, ["represented", "chars"])
    ok = (F.col("represented") == F.col("expected")) & ((F.col("expected") == 0) | (F.col("chars") >= C.QUALITY_MIN_CHARS))
    return joined.withColumn("quality_ok", ok)


def document_routes(pages: DataFrame, ratio: float = C.FALLBACK_PAGE_RATIO, min_chars: int = C.NATIVE_MIN_CHARS) -> DataFrame:
    """Strategy per document: native or mixed text, or a full parse with its reason.

    Pages shrink to their routes and lengths before the one aggregation.
    """
    first = preflight(pages, min_chars).withColumn("first_route", F.col("route"))
    native = F.col("route") == "native"
    held = F.length(tx.strip_blanks(F.when(native, F.col("native_text")).otherwise(F.coalesce("ocr_text", F.lit("")))))
    slim = settle_ocr(first).select("asset_id", "page", "first_route", "route", held.alias("chars"))
    was, used = (lambda *names: F.col("first_route").isin(*names)), F.col("route").isin("native", "ocr")
    measured = slim.groupBy("asset_id").agg(
        F.count_if(~was("blank")).alias("nonblank"), F.count_if(was("ocr", "uncertain")).alias("weak"),
        F.bool_or(was("uncertain")).alias("any_uncertain"), F.bool_or(was("ocr")).alias("any_ocr"), F.count_if(used).alias("expected"),
        F.count_distinct(F.when(used, F.col("page"))).alias("represented"), F.sum(F.when(used, F.col("chars")).otherwise(0)).alias("chars"))
    passed = (F.col("represented") == F.col("expected")) & ((F.col("expected") == 0) | (F.col("chars") >= C.QUALITY_MIN_CHARS))
    reason = (F.when(F.col("any_uncertain"), "uncertain_page")
              .when((F.col("nonblank") > 0) & (numeric.floored_ratio(F.col("weak"), F.col("nonblank")) >= ratio), "low_native_coverage")
              .when(~passed, "post_extract_quality_failure"))
    strategy = F.when(reason.isNotNull(), "full_parse").when(F.col("any_ocr"), "mixed").otherwise("native")
    return measured.select("asset_id", strategy.alias("strategy"), reason.alias("reason"))


def image_evidence(images: DataFrame, keep: list[str]) -> DataFrame:
    """Caption and recognised text of an image as separate evidence rows."""
    part = lambda name, body: F.when(body.isNotNull() & (body != ""), F.struct(F.lit(name).alias("representation"), body.alias("body")))
    parts = F.filter(F.array(part("caption", F.col("caption")), part("ocr", F.col("ocr_text"))), lambda p: p.isNotNull())
    rows = images.select(*keep, "filename", F.explode(parts).alias("p"))
    return rows.select(*keep, "p.representation", tx.image_header(F.col("filename"), F.col("p.body"), F.col("p.representation")).alias("content"))


CHUNK_NAMES = {"evidence_id": "chunk_id", "asset_id": "doc_id", "media_uri": "raw_file_uri"}


def evidence_to_chunks(evidence: DataFrame) -> DataFrame:
    """Stored evidence rows as chunks with retrieval labels."""
    return (evidence.withColumnsRenamed(CHUNK_NAMES).withColumn("modality", quality.retrieval_modality(F.col("modality")))
            .withColumn("content", F.coalesce("content", F.lit(""))))


def chunks_to_evidence(chunks: DataFrame) -> DataFrame:
    """Chunks as evidence rows with stored labels."""
    return (chunks.withColumnsRenamed({new: old for old, new in CHUNK_NAMES.items()})
            .withColumn("modality", quality.stored_modality(F.col("modality"))))
