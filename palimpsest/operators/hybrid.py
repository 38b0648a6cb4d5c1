"""Reciprocal-rank fusion, collections, re-authorised retrieval and reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest import constants as C
from palimpsest.functions import numeric, scope as sc, text as tx
from palimpsest.operators import evidence as ev, search
from palimpsest.operators.ordered import joined_in_order, top_per


def first_hits(hits: DataFrame, keys: list[str]) -> DataFrame:
    """First hit per identity, in rank order."""
    return top_per(hits, keys, [F.col("rank")])


def fuse(dense: DataFrame, sparse: DataFrame, k: int) -> DataFrame:
    """One list per (query, collection) from two ranked ones.

    Union and one aggregation instead of a full outer join.  Ties keep the dense
    order, then the sparse order.
    """
    both = dense.select("query_id", "collection", "id", F.col("dense_rank"), F.lit(None).cast("int").alias("sparse_rank")).unionByName(
        sparse.select("query_id", "collection", "id", F.lit(None).cast("int").alias("dense_rank"), "sparse_rank"))
    merged = both.groupBy("query_id", "collection", "id").agg(
        F.min("dense_rank").alias("dense_rank"), F.min("sparse_rank").alias("sparse_rank"))
    scored = merged.withColumn("score", numeric.rank_term(F.col("dense_rank")) + numeric.rank_term(F.col("sparse_rank")))
    order = [F.round("score", 9).desc(), F.col("dense_rank").asc_nulls_last(), F.col("sparse_rank").asc(), F.col("id")]
    return top_per(scored, ["query_id", "collection"], order, k, "rank")


def search_collections(queries: DataFrame, corpus: DataFrame, k: int, **sparse_options) -> DataFrame:
    """Hybrid top ``k`` of every collection.  Both sides carry ``place``, ``text`` and ``vector``."""
    return fuse(search.dense_top(queries, corpus, k), search.sparse_top(queries, corpus, k, **sparse_options), k)


def across_collections(hits: DataFrame, k: int) -> DataFrame:
    """Weighted union of the collections, best ``k`` per query; ties keep collection order."""
    position = F.array_position(tx.lit_array(C.COLLECTIONS), F.col("collection"))
    weighted = hits.withColumn("score", F.col("score") * numeric.collection_weight(F.col("collection")))
    order = [F.round("score", 9).desc(), position, F.col("rank"), F.col("id")]
    return top_per(weighted.withColumnRenamed("rank", "collection_rank").withColumn("rank", F.col("collection_rank")),
                   ["query_id"], order, k, "position").drop("rank").withColumnRenamed("position", "rank")


def placed_queries(queries: DataFrame) -> DataFrame:
    """Query text without web addresses, once per place the chat can see."""
    return queries.select("query_id", tx.without_urls(F.col("text")).alias("text"), F.col("embedding").alias("vector"),
                          F.explode(sc.evidence_chat_keys()).alias("place"))


def placed_points(points: DataFrame) -> DataFrame:
    return points.select(F.col("point_id").alias("id"), "collection", F.col("content").alias("text"),
                         F.col("embedding").alias("vector"), sc.binding_key().alias("place"))


def retrieve_candidates(queries: DataFrame, points: DataFrame, k: int = C.HYBRID_CANDIDATES, document: str | None = None) -> DataFrame:
    """Hybrid candidates that the asking chat may see, with their evidence identity."""
    corpus = points.where(F.col("doc_id") == document) if document else points
    hits = across_collections(search_collections(placed_queries(queries), placed_points(corpus), k), k)
    identity = points.select(F.col("point_id").alias("id"), "evidence_id", "binding_id")
    return hits.join(identity, "id")


def overlap_score(query: Column, passage: Column) -> Column:
    """Built-in pair score: distinct query terms that occur in the passage."""
    return F.size(F.array_intersect(tx.search_terms(query), tx.search_terms(passage))).cast("double")


def rerank(queries: DataFrame, candidates: DataFrame, n: int = C.RERANK_TOP_N, scorer=overlap_score) -> DataFrame:
    """Best ``n`` candidates by pair score against the original question; ties keep their order."""
    asked = queries.select("query_id", tx.without_urls(F.col("text")).alias("question"))
    scored = candidates.join(asked, "query_id").withColumn("rerank_score", scorer(F.col("question"), F.col("content")))
    order = [F.round("rerank_score", 6).desc(), F.col("rank"), F.col("evidence_id")]
    return top_per(scored.drop("question").withColumnRenamed("rank", "candidate_rank").withColumn("rank", F.col("candidate_rank")),
                   ["query_id"], order, n, "position").drop("rank").withColumnRenamed("position", "rank")


def context(results: DataFrame) -> DataFrame:
    """Prompt context per query: numbered sources with their page."""
    label = F.when(F.col("page") > 0, F.format_string(" (page %d)", "page")).otherwise("")
    part = F.concat(F.lit("[Source "), F.col("rank"), label, F.lit("]\n"), F.col("content"))
    return joined_in_order(results, ["query_id"], [F.col("rank")], part, "\n\n", "context")


def retrieve(queries: DataFrame, points: DataFrame, evidence: DataFrame, bindings: DataFrame, k: int = C.HYBRID_CANDIDATES,
             n: int = C.RERANK_TOP_N, scorer=overlap_score) -> DataFrame:
    """Candidates, re-authorised against the authority tables, reranked and cut."""
    candidates = retrieve_candidates(queries, points, k)
    return rerank(queries, ev.authorise(candidates, evidence, bindings, queries), n, scorer)


def sub_questions(queries: DataFrame, plans: DataFrame) -> DataFrame:
    """Two or three sub-queries per compound question; with a plan of any other length the question itself."""
    joined = queries.join(plans.select("query_id", "subqueries"), "query_id", "left")
    valid = tx.valid_subqueries(F.coalesce("subqueries", F.array().cast("array<string>")), F.col("text"))
    use = tx.is_compound(F.col("text")) & F.size("subqueries").between(2, C.MAX_SUBQUERIES) & (F.size(valid) >= 2)
    parts = joined.withColumn("part", F.explode(F.transform(F.when(F.coalesce(use, F.lit(False)), valid).otherwise(F.array("text")), lambda s, i: F.struct(
        i.alias("number"), s.alias("text")))))
    return parts.withColumn("text", F.col("part.text")).withColumn("number", F.col("part.number")).drop("part", "subqueries")


def numbered_questions(parts: DataFrame) -> DataFrame:
    """Sub-questions as queries of their own: the id of the question after the number and a stroke."""
    return parts.withColumn("query_id", F.concat_ws("|", F.format_string("%03d", "number"), "query_id"))


def whole_questions(hits: DataFrame, k: int) -> DataFrame:
    """Hits of sub-questions as hits of their question, those of an earlier sub-question first; ids may hold any sign."""
    return hits.withColumns({"rank": question_number() * k + F.col("rank"), "query_id": question_id()})


def question_number() -> Column:
    return F.substring_index("query_id", "|", 1).cast("int")


def question_id() -> Column:
    return F.expr("substring(query_id, locate('|', query_id) + 1)")


def retrieve_decomposed(queries: DataFrame, plans: DataFrame, points: DataFrame, evidence: DataFrame, bindings: DataFrame,
                        k: int = C.HYBRID_CANDIDATES, n: int = C.RERANK_TOP_N, scorer=overlap_score) -> DataFrame:
    """Candidates of all sub-queries, first hit of each evidence, one rerank against the question."""
    parts = numbered_questions(sub_questions(queries, plans))
    whole = whole_questions(retrieve_candidates(parts, points, k), k)
    unique = first_hits(whole, ["query_id", "evidence_id", "binding_id"])
    return rerank(queries, ev.authorise(unique, evidence, bindings, queries), n, scorer)
