"""The registered queries of the corpus operators and their oracle statements."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.alignment import alignments
from palimpsest.llm.common import documents, prepare
from palimpsest.llm.embeddings import near_vectors
from palimpsest.llm.exact import exact_groups
from palimpsest.llm.language import predict_languages
from palimpsest.llm.mixing import mixture
from palimpsest.llm.near import near_classes
from palimpsest.llm.negatives import hard_negatives
from palimpsest.llm.packing import retrieval_packs
from palimpsest.llm.private import personal_data
from palimpsest.llm.scoring import pseudo_likelihoods
from palimpsest.llm.substrings import drop_repeated_passages
from palimpsest.llm.token_counts import token_counts
from palimpsest.llm.warc import read_archives, write_archives
from palimpsest.session import shared_folder


def op1_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Pseudo-likelihood of every document under a window network trained on all of them."""
    return pseudo_likelihoods(documents(spark, folder)).withColumnRenamed("id", "doc_id")


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into windows of 4096 ids with their BM25 neighbours."""
    return retrieval_packs(documents(spark, folder)).withColumnRenamed("id", "doc_id")


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written to WARC archives in the shared folder and read back along their boundary chains."""
    path = f"{shared_folder(spark).rstrip('/')}/archives-{uuid.uuid4().hex}"
    write_archives(prepare(spark).read.parquet(f"{folder}/pages.parquet"), path)
    records = read_archives(spark, path)
    row_id = lambda name: F.regexp_extract(name, "<urn:row:(.*)>", 1).cast("long")
    revisit = F.col("type") == "revisit"
    return records.select(
        row_id("record_id").alias("page_id"), F.when(revisit, F.col("payload_length").cast("long")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(revisit, F.substring_index("digest", ":", -1)).otherwise(F.col("sha256")).alias("payload_digest"),
        F.col("type").alias("record_type"), F.when(revisit, row_id("refers_to")).alias("refers_to"))


SQL_OP3 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to FROM p LEFT JOIN g USING (payload_digest)
"""


def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all documents without the passages of 20 words that also start earlier."""
    cut = drop_repeated_passages(documents(spark, folder))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda total, part: total + part["after"] - part["first"])
    return cut.select(F.col("id").alias("doc_id"), "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


# Sequences of a document are compared as the 20 words in one string; words hold no blank, so the string is unambiguous.
SQL_OP4 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(generate_series(1, len(words) - 19)) AS start, words FROM d WHERE len(words) >= 20),
h AS (SELECT doc_id, start, array_to_string(words[start:start + 19], ' ') AS seq FROM w),
r AS (SELECT doc_id, start, row_number() OVER (PARTITION BY seq ORDER BY doc_id, start) AS nth FROM h),
x AS (SELECT DISTINCT doc_id, unnest(generate_series(start, start + 19)) AS place FROM r WHERE nth > 1),
g AS (SELECT doc_id, list(place) AS places FROM x GROUP BY doc_id),
k AS (SELECT d.doc_id, len(words) AS n_words, coalesce(len(places), 0) AS n_removed,
    CASE WHEN places IS NULL THEN words ELSE list_filter(words, lambda v, i: NOT list_contains(places, i)) END AS kept FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""


def op5_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate classes of all documents by Order MinHash and alignment."""
    return near_classes(documents(spark, folder)).withColumnRenamed("id", "doc_id")


def op6_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Copies of all documents in a temperature mixture of their sources."""
    return mixture(documents(spark, folder)).withColumnRenamed("id", "doc_id")


def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Grace hash deduplication of all documents: one row a document with the row that stays."""
    return exact_groups(documents(spark, folder)).withColumnRenamed("id", "doc_id")


SQL_OP7 = r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS raw, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size, first(doc_id ORDER BY length(raw) DESC, doc_id) AS keep_id FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256 FROM n JOIN g USING (norm)
"""


def op8_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of one label with cosine 0.93 or more, linked and grouped."""
    return near_vectors(prepare(spark).read.parquet(f"{folder}/embeddings.parquet")).withColumnRenamed("id", "vec_id")


SQL_OP8 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL),
u AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), d AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT c.a AS vec_id, coalesce(n_links, 0) AS n_links, component_id, c.a = component_id AS kept FROM c LEFT JOIN d USING (a)
"""


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """String-kernel language of every document."""
    return predict_languages(documents(spark, folder)).withColumnRenamed("id", "doc_id")


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document under the unigram model of a public piece vocabulary."""
    return token_counts(documents(spark, folder)).withColumnRenamed("id", "doc_id")


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector and each of its five positives; every seventh vector has the next label."""
    vectors = prepare(spark).read.parquet(f"{folder}/embeddings.parquet")
    moved = F.when(F.pmod("vec_id", F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), F.pmod("vec_id", F.lit(100)) == 0)


# All anchors meet all rows here; scores are whole numbers far below 2^53, so the sums of doubles are exact.
SQL_OP11 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id))::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 10
"""


def op12_cross_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Alignment of a byte-level and a piece tokenizer over all documents."""
    return alignments(documents(spark, folder)).withColumnRenamed("id", "doc_id")


def op13_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in all documents: the fixed patterns' spans and those that weak supervision adds."""
    return personal_data(documents(spark, folder)).withColumnRenamed("id", "doc_id")


def queries() -> dict:
    return {"op1_lm_scoring": op1_lm_scoring, "op2_packing": op2_packing, "op3_warc": op3_warc, "op4_substring_dedup": op4_substring_dedup, "op5_near_dedup": op5_near_dedup, "op6_source_mixing": op6_source_mixing, "op7_exact_dedup": op7_exact_dedup,
            "op8_embedding_dedup": op8_embedding_dedup, "op9_language_id": op9_language_id, "op10_token_counts": op10_token_counts,
            "op11_hard_negatives": op11_hard_negatives, "op12_cross_alignment": op12_cross_alignment, "op13_personal_data": op13_personal_data}


def oracle_sql() -> dict:
    return {"op3_warc": SQL_OP3, "op4_substring_dedup": SQL_OP4, "op7_exact_dedup": SQL_OP7, "op8_embedding_dedup": SQL_OP8, "op11_hard_negatives": SQL_OP11}
