"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.common import documents
from palimpsest.llm.exact import drop_exact_copies
from palimpsest.llm.language import keep_identified
from palimpsest.llm.mixing import mix_rows
from palimpsest.llm.near import drop_near_copies
from palimpsest.llm.packing import retrieval_packs
from palimpsest.session import shared_folder


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay: those with a letter whose kernel value reaches the floor of their length."""
    return keep_identified(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal contents stays."""
    return drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of small sources are repeated towards the target weights; every document stays at least once."""
    return mix_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences."""
    return retrieval_packs(docs).withColumnRenamed("id", "doc_id")


STAGES = [("language ID", identified), ("exact dedup", exact_copies), ("near dedup", near_copies), ("mixing", mixed), ("packing", packed)]

#: Kernel classes, alignment and tokenisation have no SQL form; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what lies between two stages is a Parquet table in the cluster's shared folder."""
    docs = documents(spark, sf_dir)
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{number}")
            docs = spark.read.parquet(f"{folder}/{number}")
    return docs
