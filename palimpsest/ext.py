"""Extension points: what a user plugs in, as plain functions over DataFrames.

* parser: file rows -> block rows
* encoder: texts -> vectors of a fixed dimension
* pair scorer: (question, passage) -> score
* decisions: supplied tables with a declared schema (see ``schemas``)
* semantic retriever: queries -> ranked memories
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from palimpsest import schemas

BLOCKS = "path string, seq int, content string, page int"


def parse_files(files: DataFrame, make_parser: Callable[[], Callable[[str, bytes], list[tuple[str, int | None]]]]) -> DataFrame:
    """Blocks of every file; the parser is made once per task and sees one file at a time."""
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = make_parser()
        for batch in batches:
            rows = [(path, seq, text, page) for path, content in zip(batch["path"], batch["content"])
                    for seq, (text, page) in enumerate(parser(path, bytes(content)))]
            yield pd.DataFrame(rows, columns=["path", "seq", "content", "page"])
    return files.select("path", "content").mapInPandas(parse, BLOCKS)


def parser_table(make_parser: Callable[[], Callable[[str, bytes], list[tuple[str, int | None]]]]):
    """A table function over a parser, for ``files.lateralJoin(table(col("path").outer(), col("content").outer()))``.

    Blocks come out beside the columns of their file, so nothing has to be joined back.
    """
    class Parser:
        def __init__(self):
            self.parse = make_parser()

        def eval(self, path: str, content: bytes):
            for seq, (text, page) in enumerate(self.parse(path, bytes(content))):
                yield seq, text, page
    return F.udtf(Parser, returnType="seq int, content string, page int")


def form_feed_pages(path: str, content: bytes) -> list[tuple[str, int | None]]:
    """Built-in parser of paged text: a form feed ends a page, blank lines end a block; pages count from 1."""
    return [(block.strip(" \t\r\n"), number) for number, page in enumerate(content.decode("utf-8", "replace").split("\f"), 1)
            for block in page.split("\n\n") if block.strip(" \t\r\n")]


def encoder(make_model: Callable[[], Callable[[list[str]], np.ndarray]], dimension: int) -> Callable[[Column], Column]:
    """Column function over a text encoder; vectors are cut to ``dimension``."""
    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make_model()
        for texts in batches:
            vectors = np.asarray(model(texts.fillna("").tolist()), dtype=np.float32)[:, :dimension]
            yield pd.Series(list(vectors))
    return encode


def pair_scorer(make_model: Callable[[], Callable[[list[tuple[str, str]]], np.ndarray]]) -> Callable[[Column, Column], Column]:
    """Column function over a (question, passage) scorer, for ``hybrid.rerank``."""
    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make_model()
        for questions, passages in batches:
            yield pd.Series(np.asarray(model(list(zip(questions, passages))), dtype=np.float64))
    return score


def decisions(rows: DataFrame, table: str) -> DataFrame:
    """Supplied decisions cast to the declared schema of ``table``; unknown columns are dropped."""
    declared = schemas.schema(table)
    return rows.select(*[F.col(field.name).cast(field.dataType).alias(field.name) for field in declared])
