"""Timed segments: repeated cues and merging into windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest import constants as C
from palimpsest.functions import text as tx
from palimpsest.operators.ordered import explode_computed

SEGMENTS = "array<struct<start:double,end:double,text:string>>"


def without_repeats(cues: Column) -> Column:
    """Neighbouring cues with equal text count once, the first stays."""
    return F.filter(cues, lambda q, i: (i == 0) | ~q["text"].eqNullSafe(F.get(cues, i - 1)["text"]))


def merge(segments: Column, max_words: int = C.SEGMENT_WORDS, max_seconds: float = C.SEGMENT_SECONDS) -> Column:
    """Adjacent segments joined while the window stays within words and seconds.

    One fold over the ordered segments of a recording; the open window is the
    state, closed windows are appended.
    """
    window = "struct<start:double,end:double,texts:array<string>,words:int>"
    state = F.struct(F.array().cast(SEGMENTS).alias("done"), F.lit(None).cast(window).alias("open"))

    def closed(w):
        return F.array(F.struct(w["start"].alias("start"), w["end"].alias("end"), F.array_join(w["texts"], " ").alias("text")))

    def step(acc, seg):
        w, words = acc["open"], F.size(tx.words(seg["text"]))
        fits = (w["words"] + words <= max_words) & (seg["end"] - w["start"] <= max_seconds)
        fresh = F.struct(seg["start"].alias("start"), seg["end"].alias("end"), F.array(seg["text"]).alias("texts"), words.alias("words"))
        grown = F.struct(w["start"].alias("start"), seg["end"].alias("end"),
                         F.concat(w["texts"], F.array(seg["text"])).alias("texts"), (w["words"] + words).alias("words"))
        keep = w.isNotNull() & fits
        return F.struct(
            F.when(w.isNull() | keep, acc["done"]).otherwise(F.concat(acc["done"], closed(w))).cast(SEGMENTS).alias("done"),
            F.when(keep, grown).otherwise(fresh).cast(window).alias("open"))

    return F.aggregate(segments.cast(SEGMENTS), state, step, lambda acc: F.when(
        acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], closed(acc["open"]))))


def merged_rows(recordings: DataFrame, key: str, name: Column) -> DataFrame:
    """One evidence block per merged window, with its time range in the header."""
    windows = explode_computed(recordings, [key, name.alias("name")], merge(F.col("segments")), "seq", "w")
    return windows.select(key, "seq", "w.start", "w.end", tx.segment_header(
        F.col("name"), F.col("w.start"), F.col("w.end"), F.col("w.text")).alias("content"))
