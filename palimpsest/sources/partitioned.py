"""Snapshots dealt to folders by key, so that a keyed write touches only the folders of its keys."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from palimpsest.session import shared_folder

PART = "key_part"


class KeyedTable:
    """A Parquet table with ``parts`` folders, a row's folder following from its key.

    A write reads the folders that its keys fall into, applies a pure function of (rows there, delta) and replaces these
    folders; all others keep their files.  The new rows are staged first, so a write that fails leaves the table as it was and a
    repeated one gives the same table.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], parts: int = 64):
        self.spark, self.path, self.keys, self.parts = spark, path, keys, parts

    def _dealt(self, df: DataFrame) -> DataFrame:
        return df.withColumn(PART, F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int"))

    def _write(self, dealt: DataFrame, **options) -> None:
        dealt.repartition(PART).write.mode("overwrite").options(**options).partitionBy(PART).parquet(self.path)

    def create(self, df: DataFrame) -> None:
        self._write(self._dealt(df))
        self.schema = df.schema

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def apply(self, delta: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Replace the folders of ``delta``'s keys by ``change(rows there, delta)``; the number of folders touched."""
        staged = f"{shared_folder(self.spark).rstrip('/')}/delta-{uuid.uuid4().hex}"
        delta.write.parquet(f"{staged}/in")
        delta = self.spark.read.schema(delta.schema).parquet(f"{staged}/in")
        # at most one number a folder
        touched = sorted(r[PART] for r in self._dealt(delta).select(PART).distinct().collect())
        if not touched:
            return 0
        stored = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(PART, T.IntegerType())])).parquet(self.path)
        there = stored.where(F.col(PART).isin(touched)).drop(PART)
        self._dealt(change(there, delta).select(*self.schema.names)).write.parquet(f"{staged}/out")
        self._write(self.spark.read.parquet(f"{staged}/out"), partitionOverwriteMode="dynamic")
        return len(touched)
