"""Derived memory graph: nodes, edges, listing, one-hop expansion, rebuild."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from palimpsest import constants as C
from palimpsest.functions import scope as sc
from palimpsest.operators.keyed import delete, upsert
from palimpsest.operators.ordered import top_per
from palimpsest.operators.skew import among, wanted
from palimpsest.session import cut_lineage

END_COLUMNS = ["owner_id", "scope", "session_id", "project_id", "project_scope", "status", "user_confirmed",
               "valid_from", "valid_to"]


def nodes(memories: DataFrame, now) -> DataFrame:
    """One node per memory; ``is_active`` is its state at projection time."""
    return memories.select(
        "memory_id", "owner_id", "scope", "session_id", "project_id", "project_scope", "kind", "status", "confidence",
        "user_confirmed", "valid_from", "valid_to", "source_turn_id", sc.is_projectable(now).alias("is_active"))


def with_ends(relationships: DataFrame, memories: DataFrame) -> DataFrame:
    """Relationships joined to both records, ends prefixed ``s_`` and ``t_``."""
    def side(prefix, id_column):
        return memories.select(F.col("memory_id").alias(id_column), *[
            F.col(name).alias(prefix + name) for name in END_COLUMNS])
    known = relationships.where(F.col("relationship_type").isin(C.RELATIONSHIP_TYPES))
    return known.join(side("s_", "from_memory_id"), "from_memory_id").join(side("t_", "to_memory_id"), "to_memory_id")


def edges(relationships: DataFrame, memories: DataFrame, now) -> DataFrame:
    """Relationships that may be projected, labelled in upper case."""
    joined = with_ends(relationships, memories).where(sc.is_projectable_edge(now, "s_", "t_"))
    return joined.select("relationship_id", F.upper("relationship_type").alias("label"), "from_memory_id",
                         "to_memory_id", F.col("s_owner_id").alias("owner_id"), "created_at")


def list_nodes(node_table: DataFrame, asked: DataFrame, active: bool | None = True) -> DataFrame:
    """Nodes of each asking owner; a project id in the request outranks a project name.

    ``asked(query_id, owner_id, want_scope, want_project_id, want_project_scope)``, nulls meaning any.
    """
    joined = node_table.join(asked, "owner_id")
    keep = F.coalesce(F.col("scope") == F.col("want_scope"), F.col("want_scope").isNull())
    by_project = (F.when(F.col("want_project_id").isNotNull(), F.col("project_id") == F.col("want_project_id"))
                  .when(F.col("want_project_scope").isNotNull(), F.col("project_scope") == F.col("want_project_scope"))
                  .otherwise(F.lit(True)))
    state = F.lit(True) if active is None else F.col("is_active") == active
    return joined.where(keep & F.coalesce(by_project, F.lit(False)) & state)


def live_edges(edge_table: DataFrame, node_table: DataFrame) -> DataFrame:
    """Edges into live nodes from live nodes, or from any node for lineage."""
    source = node_table.select(F.col("memory_id").alias("from_memory_id"), F.col("is_active").alias("source_active"),
                               "scope", "project_id", "project_scope")
    target = node_table.where("is_active").select(F.col("memory_id").alias("to_memory_id"))
    joined = edge_table.join(target, "to_memory_id").join(source, "from_memory_id")
    return joined.where(F.col("source_active") | (F.col("label") == "SUPERSEDED_BY")).drop("source_active")


def expand(seeds: DataFrame, edge_table: DataFrame, node_table: DataFrame, chats: DataFrame,
           limit: int = C.GRAPH_NEIGHBOURS) -> DataFrame:
    """Live neighbours over RELATED edges, one hop, visible to the asking chat.

    ``seeds(query_id, memory_id, position)``.
    """
    start = top_per(seeds.dropDuplicates(["query_id", "memory_id"]), ["query_id"],
                    [F.col("position"), F.col("memory_id")], C.GRAPH_SEEDS)
    start = start.select("query_id", F.col("memory_id").alias("seed_memory_id"))
    related = edge_table.where(F.col("label") == "RELATED").select(
        "relationship_id", "created_at", F.explode(F.array(
            F.struct(F.col("from_memory_id").alias("seed_memory_id"), F.col("to_memory_id").alias("memory_id")),
            F.struct(F.col("to_memory_id").alias("seed_memory_id"), F.col("from_memory_id").alias("memory_id")))
        ).alias("hop")).select("relationship_id", "created_at", "hop.*")
    hops = related.join(start, "seed_memory_id")
    fresh = hops.join(start.withColumnRenamed("seed_memory_id", "memory_id"), ["query_id", "memory_id"], "left_anti")
    placed = node_table.where("is_active").select("memory_id", sc.record_key().alias("place"))
    places = chats.select("query_id", F.explode(sc.chat_keys()).alias("place"))
    visible = fresh.join(placed, "memory_id").join(places, ["query_id", "place"])
    newest = [F.col("created_at").desc(), F.col("relationship_id").desc(), F.col("seed_memory_id")]
    once = top_per(visible, ["query_id", "memory_id"], newest)
    return top_per(once, ["query_id"], newest, limit, "graph_rank").drop("place")


def around(seeds: DataFrame, relationships: DataFrame, memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relationships, memories) that :func:`expand` can reach from ``seeds(memory_id)``: relationships with an end among them, and their ends."""
    ends = [F.col("from_memory_id"), F.col("to_memory_id")]
    near = cut_lineage(among(relationships, wanted(seeds.select("memory_id")), *ends))
    return near, among(memories, wanted(near.select(F.explode(F.array(*ends)).alias("memory_id"))), F.col("memory_id"))


def sync_nodes(node_table: DataFrame, edge_table: DataFrame, changed: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after projecting changed memories; inactive nodes lose their edges."""
    delta = nodes(changed, now)
    inactive = delta.where(~F.col("is_active")).select("memory_id")
    kept = edge_table
    for end in ("from_memory_id", "to_memory_id"):
        kept = kept.join(inactive.withColumnRenamed("memory_id", end), end, "left_anti")
    return upsert(node_table, delta, ["memory_id"]), kept.select(*edge_table.columns)


def sync_edges(edge_table: DataFrame, relationships: DataFrame, memories: DataFrame, now) -> DataFrame:
    """Edges after projecting changed relationships; those not projectable any more go."""
    kept = delete(edge_table, relationships, ["relationship_id"])
    return kept.unionByName(edges(relationships, memories, now).select(*edge_table.columns))


def rebuild(memories: DataFrame, relationships: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """Both graph tables from the authority alone."""
    return nodes(memories, now), edges(relationships, memories, now)


def peers(relationships: DataFrame, asked: DataFrame) -> DataFrame:
    """Relationships of each asked memory with the memory at the other end."""
    ends = relationships.withColumn("memory_id", F.explode(F.array_distinct(F.array("from_memory_id", "to_memory_id"))))
    peer = F.when(F.col("from_memory_id") == F.col("memory_id"), F.col("to_memory_id")).otherwise(F.col("from_memory_id"))
    return ends.join(asked.select("memory_id"), "memory_id").withColumn("peer_memory_id", peer)
