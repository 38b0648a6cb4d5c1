"""Scans of authority tables, uploads, delimited files, captions, logs and fixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palimpsest import constants as C, schemas
from palimpsest.functions import keys, text as tx
from palimpsest.operators.ordered import explode_computed


def read_table(spark: SparkSession, table: str, path: str) -> DataFrame:
    """One authority table from Parquet with its declared schema."""
    return spark.read.schema(schemas.schema(table)).parquet(path)


def read_jdbc(spark: SparkSession, table: str, url: str, partition_column: str | None = None,
              bounds: tuple | None = None, partitions: int = 1, **options) -> DataFrame:
    """The same table over JDBC; give a partition column for parallel reads."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition_column and bounds:
        reader = reader.options(partitionColumn=partition_column, lowerBound=bounds[0], upperBound=bounds[1],
                                numPartitions=partitions)
    return reader.load()


def decode_json(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Parse JSON text columns with the given DDL types."""
    return df.withColumns({name: F.from_json(F.col(name), ddl) for name, ddl in columns.items()})


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+)$", 1)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded files with their bytes."""
    return spark.read.format("binaryFile").load(path).select("path", "content", "modificationTime", "length")


def identify_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assets identified by their content, files of unsupported types)."""
    named = files.withColumn("extension", extension(F.col("path")))
    allowed = F.col("extension").isin(C.UPLOAD_EXTENSIONS)
    assets = named.where(allowed).select(
        keys.content_id(F.col("content")).alias("asset_id"), "path", file_name(F.col("path")).alias("filename"),
        F.col("extension").alias("modality"), *[F.col(name) for name in ("length",) if name in files.columns])
    return assets, named.where(~allowed).select("path", "extension")


BINARY_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def read_arrivals(spark: SparkSession, path: str, files_per_trigger: int = 100, bytes_per_trigger: int | None = None) -> DataFrame:
    """Uploaded files as they arrive in a folder, with their bytes.

    A batch is bounded by its files or, if given, by their bytes: every batch has
    its own state tasks, which for many small files outweigh the files.
    """
    bound = ("maxFilesPerTrigger", files_per_trigger) if bytes_per_trigger is None else ("maxBytesPerTrigger", bytes_per_trigger)
    return (spark.readStream.format("binaryFile").schema(BINARY_FILES).option(*bound)
            .option("recursiveFileLookup", True).load(path))


def arriving_assets(files: DataFrame) -> DataFrame:
    """Assets of a stream of files, each content once however often and under whatever name it arrives.

    The state keeps one row an asset, never a content.
    """
    lengths = files.select("path", "length", "content")
    return identify_files(lengths)[0].dropDuplicates(["asset_id"])


def dispatch(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files with the parser that reads them, files nothing reads)."""
    parser = F.create_map(*[F.lit(x) for pair in C.PARSER_BY_EXTENSION.items() for x in pair])
    routed = files.withColumn("parser", parser[F.lower("modality")])
    return routed.where(F.col("parser").isNotNull()), routed.where(F.col("parser").isNull()).drop("parser")


def read_delimited(spark: SparkSession, path: str, ddl: str | None = None) -> DataFrame:
    """Delimited file with a header; rows without any value are dropped."""
    reader = spark.read.option("header", True)
    reader = reader.schema(ddl) if ddl else reader.option("inferSchema", True)
    return reader.csv(path).dropna(how="all")


def parse_delimited(lines: DataFrame, ddl: str, keep: list[str]) -> DataFrame:
    """Delimited ``value`` lines already in a table."""
    parsed = lines.select(*keep, F.from_csv(F.col("value"), ddl).alias("row")).select(*keep, "row.*")
    return parsed.dropna(how="all", subset=[name for name in parsed.columns if name not in keep])


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def parse_captions(files: DataFrame, key: str = "path") -> DataFrame:
    """Cues of caption files: start, end, text without tags, repeated neighbours dropped."""
    lines = F.split(F.regexp_replace("value", "\r\n?", "\n"), "\n")
    blocks = F.split(F.array_join(F.transform(lines, tx.strip_blanks), "\n"), r"\n{2,}")
    # A time line may stand inside a block, after a cue label; the cue text runs to the block's end.
    stamp = lambda block, i: F.regexp_extract(block, C.CUE_TIMES, i)
    cue_lines = lambda block: F.filter(F.transform(
        F.split(F.regexp_replace(block, rf"^(?s:.*?){C.CUE_TIMES}[^\n]*\n?", ""), "\n"),
        lambda line: tx.strip_blanks(F.regexp_replace(line, "<[^>]+>", ""))), lambda line: line != "")
    cues = F.transform(F.filter(blocks, lambda b: b.rlike(rf"(?m)^{C.CUE_TIMES}")), lambda b: F.struct(
        tx.seconds(*[stamp(b, i) for i in (1, 2, 3, 4)]).alias("start"),
        tx.seconds(*[stamp(b, i) for i in (5, 6, 7, 8)]).alias("end"), F.array_join(cue_lines(b), " ").alias("text")))
    spoken = files.select(key, F.filter(cues, lambda q: q["text"] != "").alias("cues"))
    changed = F.filter("cues", lambda q, i: (i == 0) | ~q["text"].eqNullSafe(F.get("cues", i - 1)["text"]))
    return explode_computed(spoken, [key], changed, "seq", "cue").select(key, "seq", "cue.*")


def read_latency(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.schema("latency_log")).json(path)


def parse_latency(lines: DataFrame) -> DataFrame:
    return lines.select(F.from_json("value", schemas.schema("latency_log")).alias("e")).select("e.*")


def trace(events: DataFrame, run_id: str | None = None, trace_id: str | None = None) -> DataFrame:
    """Latency events of one run or one trace."""
    return events.where((F.col("run_id") == run_id) | (F.col("trace_id") == trace_id))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Multi-line JSON list of conversation cases."""
    return spark.read.option("multiLine", True).schema(schemas.schema("conversation_cases")).json(path)


def case_turns(cases: DataFrame) -> DataFrame:
    return cases.select("id", F.posexplode("turns").alias("turn", "t")).select("id", "turn", "t.role", "t.content")


def text_blocks(items: DataFrame) -> DataFrame:
    """Layout items that carry text, reading order kept in ``seq``."""
    trimmed = items.withColumn("text", tx.strip_blanks(F.col("text")))
    return trimmed.where(F.col("item_type").isin(C.LAYOUT_ITEM_TYPES) & (F.col("text") != ""))
