"""Language identification with string kernels.

The kernel of two texts is the number of character n-grams (n = 1 .. ``LONGEST``, blended spectrum, presence only, hashed
to ``SLOTS``) that both hold, over the root of the product of their numbers.  A bounded labelled sample, balanced over
languages, is compared with landmarks drawn from it (Nyström), and one kernel ridge regression a language is
fitted against the rest.  The landmarks' weights fold into one vector a language over the n-grams, so texts are
scored in batches by one matrix product of their presence rows.

Where rows are dropped by language, the best raw value decides as well: it has to reach a floor of its length class that is
calibrated over the sample, each half of it scored by a model of the other half.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from palimpsest.llm.common import as_text, pieces, prepare

LONGEST, SLOTS = 4, 1 << 15
#: Bounds of the fit: labelled rows, languages (the most frequent), landmarks.
SAMPLE_ROWS, MOST_LANGUAGES, LANDMARKS = 2400, 200, 300
RIDGE, SHARPNESS = 1e-4, 2.0
#: Floors of the best raw value: this share of this quantile of the labelled texts of a class, for classes with so many of them.
FLOOR_SHARE, FLOOR_QUANTILE, FLOOR_ROWS = 0.2, 0.01, 30
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_STEP = 1 << 19


def presence(text: str, row: np.ndarray) -> None:
    """Sets the slots of all n-grams of a whole text in ``row``."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    for first in range(0, len(codes), _STEP):
        part = codes[first:first + _STEP + LONGEST - 1]
        grams = np.zeros(len(part), np.uint32)
        for n in range(1, min(LONGEST, len(part)) + 1):
            grams = grams[:len(part) - n + 1] * np.uint32(0x01000193) + part[n - 1:]
            row[((grams + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(17)] = 1


def _bits_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        bits = []
        for text in batch.column("text").to_pylist():
            row = np.zeros(SLOTS, np.uint8)
            presence(text, row)
            bits.append(np.packbits(row).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("lang"), pa.array(bits, pa.binary())], names=["id", "lang", "bits"])


def fit(bits: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple[list[str], np.ndarray]:
    """Languages and their weights (slots x languages) from the packed presence rows of the sample."""
    names = sorted(set(labels))
    targets = np.where(np.array(labels)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    chosen = np.linspace(0, len(labels) - 1, min(landmarks, len(labels))).astype(int)
    marks = np.unpackbits(bits[chosen], axis=1).astype(np.float32)
    sizes = np.sqrt(marks.sum(1))
    marks /= np.maximum(sizes, 1)[:, None]
    kernel = np.empty((len(labels), len(chosen)))
    for first in range(0, len(labels), 256):
        rows = np.unpackbits(bits[first:first + 256], axis=1).astype(np.float32)
        kernel[first:first + 256] = rows @ marks.T / np.maximum(np.sqrt(rows.sum(1)), 1)[:, None]
    own = kernel[chosen]
    system = kernel.T @ kernel + ridge * len(labels) * own + 1e-6 * np.eye(len(chosen))
    weights = np.linalg.solve(system, kernel.T @ targets)
    return names, (marks.T @ weights.astype(np.float32)).astype(np.float32)


def values_of(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Raw value of each language (rows x languages) for presence rows: kernel values with the landmarks by their weights."""
    return rows @ weights / np.maximum(np.sqrt(rows.sum(1)), 1)[:, None]


def length_class(grams: np.ndarray) -> np.ndarray:
    """Class of a text with so many n-grams: the binary logarithm, rounded down."""
    return np.frexp(np.maximum(grams, 1))[1] - 1


def floors(bits: np.ndarray, labels: list[str]) -> np.ndarray:
    """Least best value by length class at which a text has a language; minus infinity where labelled texts give no bound.

    A class with too few labelled texts takes the floor of the next shorter one.
    """
    best, kinds = np.zeros(len(labels), np.float32), np.zeros(len(labels), np.int64)
    half = np.arange(len(labels)) % 2
    for own in (0, 1) if len(labels) > 1 else ():
        others = np.flatnonzero(half != own)
        _, weights = fit(bits[others], [labels[n] for n in others])
        mine = np.flatnonzero(half == own)
        for first in range(0, len(mine), 256):
            part = mine[first:first + 256]
            rows = np.unpackbits(bits[part], axis=1).astype(np.float32)
            best[part], kinds[part] = values_of(rows, weights).max(1), length_class(rows.sum(1))
    out = np.full(SLOTS.bit_length(), -np.inf)
    for kind in range(len(out)):
        known = best[kinds == kind]
        if len(known) >= FLOOR_ROWS:
            low = np.quantile(known, FLOOR_QUANTILE)
            out[kind] = low * FLOOR_SHARE if low > 0 else -np.inf
        elif kind:
            out[kind] = out[kind - 1]
    return out


def held_out(id_column: Column) -> Column:
    """Rows that the fit never sees: crc32 of the id as text leaves 1 modulo 3; null ids count as an empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % 3 == 1


def labelled_sample(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", sample_rows: int = SAMPLE_ROWS,
                    most_languages: int = MOST_LANGUAGES) -> tuple[np.ndarray, list[str]] | None:
    """Packed presence rows and labels of a balanced sample of at most ``sample_rows`` labelled rows that are not held out; None without any."""
    prepare(df.sparkSession)
    rows = df.select(F.col(id_column).cast("string").alias("id"), F.col(lang_column).cast("string").alias("lang"), F.col(text_column).cast("string").alias("text"))
    rows = rows.where(~held_out(F.col("id")) & F.col("id").isNotNull() & F.col("lang").isNotNull() & (F.col("lang") != UNDETERMINED))
    counts = rows.where("text is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    if not counts:
        return None
    each = max(1, sample_rows // len(counts))
    # about twice the rows wanted pass a draw first, so that no task ranks more than that of a language
    drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chance = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, (2 * each + 50) / r["count"])))])
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    picked = (rows.where("text is not null").select("id", "lang").where(drawn < chance[F.col("lang")]).distinct()
              .withColumn("place", F.row_number().over(order)).where(F.col("place") <= each).select("id", "lang"))
    texts = rows.join(F.broadcast(picked), ["id", "lang"], "left_semi").where(as_text(F.col("text")).rlike(r"\p{L}"))  # at most sample_rows ids
    sample = texts.mapInArrow(_bits_task, "id string, lang string, bits binary").dropDuplicates(["id", "lang"]).collect()
    if not sample:
        return None
    sample.sort(key=lambda r: (hash_order(r["id"]), r["id"]))
    return np.array([np.frombuffer(r["bits"], np.uint8) for r in sample]), [r["lang"] for r in sample]


def learn(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", **bounds) -> tuple[list[str], np.ndarray] | None:
    """A model from the labelled sample; None without any labelled row."""
    sample = labelled_sample(df, id_column, text_column, lang_column, **bounds)
    return sample and fit(*sample)


def hash_order(text: str) -> int:
    import zlib
    return zlib.crc32(b"order " + text.encode())


def _score_task(languages: list[str], weights: np.ndarray, least: np.ndarray | None = None):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((64, SLOTS), np.float32)
        for batch in pieces(batches, "text"):
            texts = batch.column("text")
            for first in range(0, batch.num_rows, len(table)):
                part = texts.slice(first, len(table)).to_pylist()
                table[:len(part)] = 0
                lettered = [text is not None and _LETTER.search(text) is not None for text in part]
                for row, text, use in zip(table, part, lettered):
                    if use:
                        presence(text, row)
                block = table[:len(part)]
                values = values_of(block, weights)
                if least is not None:
                    enough = values.max(1) >= least[length_class(block.sum(1))]
                    lettered = [use and bool(e) for use, e in zip(lettered, enough)]
                odds = np.exp(SHARPNESS * (values - values.max(1, keepdims=True)))
                best = values.argmax(1)
                score = 1.0 / odds.sum(1, dtype=np.float64)
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(c).slice(first, len(part)) for c in batch.schema.names if c != "text"],
                    pa.array([languages[b] if use else UNDETERMINED for b, use in zip(best, lettered)], pa.string()),
                    pa.array([float(s) if use else 0.0 for s, use in zip(score, lettered)], pa.float64())],
                    names=[*[c for c in batch.schema.names if c != "text"], "lang_pred", "score"])

    return work


def identify(df: DataFrame, found: tuple[list[str], np.ndarray] | None, text_column: str = "text", least: np.ndarray | None = None) -> DataFrame:
    """``whole`` (the row as a struct), ``lang_pred`` and ``score`` in 0 .. 1 for every row; only the text is looked at.

    A text that is null or has no letter is undetermined with score 0, and so is every text without a model and, with floors
    ``least`` by length class, every text whose best raw value is below its floor.
    """
    prepare(df.sparkSession)
    rows = df.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns) if c != text_column] or [F.lit(0)]).alias("whole"),
                     F.col(text_column).cast("string").alias("text"))
    if found is None:
        return rows.select("whole", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    schema = T.StructType([rows.schema["whole"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_score_task(*found, least), schema)


def predict_languages(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", **bounds) -> DataFrame:
    """``id, held_out, lang_pred, score`` of every row, by a model learnt from the labelled rows that are not held out.

    Rows that repeat are each scored; an empty table gives an empty result; other columns are ignored.
    """
    found = learn(df, id_column, text_column, lang_column, **bounds)
    scored = identify(df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), found)
    return scored.select(F.col("whole.c0").alias("id"), held_out(F.col("whole.c0")).alias("held_out"), "lang_pred", "score")


def keep_identified(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", **bounds) -> DataFrame:
    """The rows of ``df`` whose language is determined, whole and with all their columns, whatever these are called.

    Texts without a letter go, and those whose best raw value is below the floor of their length class.  Without any labelled row
    to learn from nothing can be rejected but texts without a letter.
    """
    sample = labelled_sample(df, id_column, text_column, lang_column, **bounds)
    found, least = (fit(*sample), floors(*sample)) if sample else ((["any"], np.zeros((SLOTS, 1), np.float32)), None)
    whole = df.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]).alias("kept"), F.col(text_column).cast("string").alias("text"))
    scored = identify(whole, found, least=least).where(F.col("lang_pred") != UNDETERMINED)
    return scored.select(*[F.col(f"whole.c0.c{i}").alias(c) for i, c in enumerate(df.columns)])
