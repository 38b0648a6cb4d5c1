"""Row-group chunks of tables, header repeated in each."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from palimpsest import constants as C
from palimpsest.functions import text as tx
from palimpsest.operators.ordered import ordinal


def row_groups(rows: DataFrame, keys: list[str], order: str, size: int = C.TABLE_ROWS, span: int = 10_000) -> DataFrame:
    """Row position and group of ``size`` rows; ``order`` is a non-negative number."""
    numbered = ordinal(rows, keys, [F.col(order)], F.floor(F.col(order) / span), "row")
    return numbered.withColumn("row_group", F.floor((F.col("row") - 1) / size))


def column_letters(count: int) -> str:
    """Spreadsheet letters of the last of ``count`` columns."""
    letters = ""
    while count > 0:
        count, rest = divmod(count - 1, 26)
        letters = chr(ord("A") + rest) + letters
    return letters


def table_chunks(rows: DataFrame, sheet: str, order: str, columns: list[str], size: int = C.TABLE_ROWS) -> DataFrame:
    """Tab-separated text of every row group, header first; empty rows do not count."""
    kept = rows.dropna(how="all", subset=columns)
    line = F.concat_ws("\t", *[F.coalesce(F.col(name).cast("string"), F.lit("nan")) for name in columns])
    grouped = row_groups(kept, [sheet], order, size).withColumn("line", line)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda r: r["line"]), "\n")
    chunks = grouped.groupBy(sheet, "row_group").agg(
        F.min("row").alias("first_row"), F.max("row").alias("last_row"), body.alias("body"))
    text = F.concat(F.lit("\t".join(columns) + "\n"), F.col("body"))
    return chunks.select(
        sheet, "row_group", "first_row", "last_row",
        tx.sheet_header(F.col(sheet), F.col("first_row"), F.col("last_row"), text).alias("content"),
        F.format_string(f"%s!A%d:{column_letters(len(columns))}%d", F.col(sheet), F.col("first_row"), F.col("last_row")).alias("cell_range"))
