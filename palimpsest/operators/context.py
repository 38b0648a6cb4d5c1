"""Memory context of a chat turn: continuity, candidates, plan validation, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from palimpsest import constants as C
from palimpsest.functions import payload as pl, scope as sc
from palimpsest.operators import graph, hybrid, identifiers as ids
from palimpsest.operators.ordered import explode_computed, joined_in_order, last_before, top_per
from palimpsest.operators.skew import among, wanted
from palimpsest.session import cut_lineage


def candidate_rows(found: DataFrame) -> DataFrame:
    return found.withColumn("memory_text", pl.memory_text(F.col("kind"), F.col("payload"))).drop("payload")


def reconciliation_details() -> Column:
    """Durable metadata of a decision as JSON, keys sorted."""
    return F.to_json(F.struct(
        F.col("changed_claims"), F.col("source_turn_id").alias("incoming_source_turn_id"), "outcome",
        F.col("confidence").alias("reconciliation_confidence"), F.col("reason").alias("reconciliation_reason")))


def unique_best(df: DataFrame, keys: list[str], score: str, pick: str) -> DataFrame:
    """The best row per key, none when the best score is shared.  Plain aggregation, no ordering of a group."""
    best = df.groupBy(*keys).agg(F.max(score).alias(score))
    top = df.join(best, [*keys, score]).groupBy(*keys).agg(F.count("*").alias("ties"), F.first(pick).alias(pick))
    return top.where("ties = 1").drop("ties")


def rehydrate(hits: DataFrame, memories: DataFrame, chats: DataFrame, now) -> DataFrame:
    """Hits whose record exists, is current and may be seen by the asking chat."""
    shown = ids.eligible(memories, now).select("memory_id", "place")
    places = chats.select("query_id", F.explode(sc.chat_keys()).alias("place"))
    return hits.join(shown, "memory_id").join(places, ["query_id", "place"]).drop("place")


def in_sight(memories: DataFrame, chats: DataFrame) -> DataFrame:
    """Ids of the memories that the index finds in a place of some chat; the others cannot become a candidate of one.

    Tables cut to these ids by :func:`among` give the chats the same candidates, so that texts, vectors and identifiers of
    memories that no chat sees are not made.
    """
    places = wanted(chats.select(F.explode(sc.chat_keys()).alias("place")))
    placed = explode_computed(memories, ["memory_id"], sc.index_keys(), "n", "place")
    return wanted(among(placed, places, F.col("place")).select("memory_id"))


def previous_answers(messages: DataFrame, span: int = 1000) -> DataFrame:
    """Messages with the trace of the last assistant answer before them."""
    answer = F.when(F.col("role") == "assistant", F.col("trace_id"))
    return last_before(messages, ["session_id"], [F.col("turn_index")], F.floor(F.col("turn_index") / span), answer,
                       "previous_trace", F.col("turn_index"))


def injected_memories(access: DataFrame, keys: list[str]) -> DataFrame:
    """Injected memories once each, at their first place in the prompt."""
    shown = access.where(F.col("event_type") == "injected")
    return top_per(shown, [*keys, "memory_id"], [F.col("rank"), F.col("access_event_id")])


def continuity(turns: DataFrame, messages: DataFrame, access: DataFrame, memories: DataFrame, now) -> DataFrame:
    """Events injected into the previous answer that the chat may still see."""
    before = previous_answers(messages).where(F.col("previous_trace").isNotNull()).select(
        F.col("message_id").alias("query_id"), "session_id", F.col("previous_trace").alias("trace_id"))
    asked = before.join(turns.select("query_id"), "query_id")
    injected = injected_memories(access, ["trace_id", "session_id"]).select("trace_id", "session_id", "memory_id", "rank", "access_event_id")
    hits = asked.join(injected, ["trace_id", "session_id"]).select("query_id", "memory_id", "rank", "access_event_id")
    events = memories.where(F.col("kind") == "event")
    return rehydrate(hits, events, turns, now)


def place_hits(queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """Hybrid top ``k`` of every place a chat can see; ``number`` is the place's turn."""
    places = queries.select("query_id", "text", "vector", F.explode(F.transform(sc.chat_keys(), lambda p, i: F.struct(
        p.alias("place"), i.alias("number")))).alias("p"))
    asked = hybrid.numbered_questions(places.select("query_id", "p.number", "text", "vector", "p.place"))
    corpus = points.select(F.col("memory_id").alias("id"), F.lit("memories").alias("collection"), F.col("memory_text").alias("text"),
                           "vector", F.explode(sc.index_keys()).alias("place"))
    hits = hybrid.search_collections(asked, corpus, k)
    return hits.select(hybrid.question_id().alias("query_id"), hybrid.question_number().alias("number"), F.col("id").alias("memory_id"), "rank", "score")


def merged_places(hits: DataFrame) -> DataFrame:
    """One hit per memory; the one from the later place stands."""
    return top_per(hits, ["query_id", "memory_id"], [F.col("number").desc()])


def search_memories(queries: DataFrame, points: DataFrame, now, k: int = C.MEMORY_TOP_K) -> DataFrame:
    """Best memories over all places of a chat; expired ones drop out before the cut to ``k``."""
    once = merged_places(place_hits(queries, points, 2 * k)).withColumnRenamed("rank", "hit_rank")
    valid = points.where(sc.within_validity(F.col("valid_from"), F.col("valid_to"), now)).select("memory_id", "kind", "scope", "memory_text")
    order = [F.round("score", 9).desc(), F.col("number"), F.col("hit_rank"), F.col("memory_id")]
    return top_per(once.join(valid, "memory_id"), ["query_id"], order, k, "rank")


def reconciliation_candidates(exact: DataFrame, hints: DataFrame, memories: DataFrame, chats: DataFrame, now) -> DataFrame:
    """Exact identifier candidates, then visible hinted events not among them."""
    events = memories.where(F.col("kind") == "event")
    fresh = hints.select("query_id", "memory_id").distinct().join(exact.select("query_id", "memory_id"), ["query_id", "memory_id"], "left_anti")
    seen = rehydrate(fresh, events, chats, now)
    return (exact.select("query_id", "memory_id", F.lit("exact_identifier").alias("candidate_source"))
            .unionByName(seen.select("query_id", "memory_id", F.lit("injected_context").alias("candidate_source"))))


def memory_context(selected: DataFrame) -> DataFrame:
    """Prompt text of ranked memories: label, kind and scope above each."""
    part = F.format_string("[M%d | %s | %s]\n%s", "rank", "kind", "scope", "memory_text")
    return joined_in_order(selected, ["query_id"], [F.col("rank")], part, "\n\n", "context")


def assemble(queries: DataFrame, exact: DataFrame, previous: DataFrame, semantic: DataFrame, memories: DataFrame, now) -> DataFrame:
    """Candidates of a turn in precedence order: exact, previous answer, semantic.

    A turn that names identifiers takes nothing from the previous answer, also
    not when vector search finds it again.  At most ten remain before the graph.
    """
    naming = queries.where(F.size("references") > 0).select("query_id")
    part = lambda df, stage, minor, score: df.select(
        "query_id", "memory_id", F.lit(stage).alias("stage"), F.col("rank").alias("position"), minor.cast("long").alias("minor"),
        score.cast("double").alias("score"))
    none = F.lit(None)
    before = previous.join(naming, "query_id", "left_anti")
    known = previous.join(naming, "query_id", "left_semi").select("query_id", "memory_id")
    found = rehydrate(semantic, memories, queries, now).join(known, ["query_id", "memory_id"], "left_anti")
    union = (part(exact, 1, none, none)
             .unionByName(part(before, 2, F.col("access_event_id"), none))
             .unionByName(part(found, 3, none, F.col("score"))))
    order = [F.col("stage"), F.col("position"), F.col("minor"), F.col("memory_id")]
    first = top_per(union, ["query_id", "memory_id"], order)
    limit = C.EXACT_CANDIDATES + C.SEMANTIC_CANDIDATES
    # Each stage was cut before, so a turn's candidates are few.
    turn = W.partitionBy("query_id")
    ranked = first.withColumn("candidate_rank", F.row_number().over(turn.orderBy(*order))).withColumn(
        "_before", F.count_if(F.col("stage") < 3).over(turn))
    # Only semantic candidates are subject to the limit, and the first of them always stays.
    allowed = (F.col("stage") < 3) | (F.col("candidate_rank") <= F.greatest(F.lit(limit), F.col("_before") + 1))
    return ranked.where(allowed).drop("_before", "minor")


STAGE_NAMES = {1: C.STAGE_EXACT, 2: C.STAGE_PREVIOUS, 3: C.STAGE_SEMANTIC, 4: C.STAGE_GRAPH}


def with_graph(candidates: DataFrame, queries: DataFrame, memories: DataFrame, node_table: DataFrame, edge_table: DataFrame,
               now, limit: int = C.GRAPH_NEIGHBOURS) -> DataFrame:
    """Candidates followed by their live one-hop neighbours.

    The few candidates of a turn are read three times, so they are written once.
    """
    candidates = cut_lineage(candidates)
    seeds = candidates.select("query_id", "memory_id", F.col("candidate_rank").alias("position"))
    near = graph.expand(seeds, edge_table, node_table, queries, limit)
    checked = rehydrate(near.select("query_id", "memory_id", "graph_rank"), memories, queries, now)
    rows = candidates.select("query_id", "memory_id", "stage", F.col("candidate_rank").cast("long").alias("position"), "score")
    hops = checked.select("query_id", "memory_id", F.lit(4).alias("stage"), F.col("graph_rank").cast("long").alias("position"),
                          F.lit(None).cast("double").alias("score"))
    name = F.create_map(*[F.lit(x) for pair in STAGE_NAMES.items() for x in pair])
    return rows.unionByName(hops).withColumn("source", name[F.col("stage")])


def candidate_counts(candidates: DataFrame) -> DataFrame:
    """Candidates per turn and source, all four sources present."""
    return candidates.groupBy("query_id").pivot("source", list(STAGE_NAMES.values())).count().fillna(0)


def validate_plans(plans: DataFrame, candidates: DataFrame) -> DataFrame:
    """Plans with ``problem``, null when they may be used.

    A plan must select candidates only, each once, describe only what it selects
    with known relations and confidences from 0 to 1, and stay within the bounds
    of both lists; a plan beyond them is not cut but not used at all.  ``plans(query_id, selected_memory_ids, relationships)``.
    """
    picked = plans.select("query_id", F.explode(F.array_distinct("selected_memory_ids")).alias("memory_id"))
    outside = picked.join(candidates.select("query_id", "memory_id"), ["query_id", "memory_id"], "left_anti")
    strangers = outside.select("query_id", F.lit(True).alias("outside")).distinct()
    hinted = F.transform("relationships", lambda h: h["memory_id"])
    odd = F.exists("relationships", lambda h: ~F.coalesce(h["relation"].isin(C.PLAN_RELATIONS) & h["confidence"].between(0, 1), F.lit(False)))
    problem = (F.when((F.size("selected_memory_ids") > C.MAX_PLANNED) | (F.size("relationships") > C.MAX_PLANNED), "too long")
               .when(odd, "unknown relation or confidence")
               .when(F.size(F.array_distinct("selected_memory_ids")) < F.size("selected_memory_ids"), "selected twice")
               .when(F.col("outside"), "outside the candidates")
               .when(F.size(F.array_except(hinted, F.col("selected_memory_ids"))) > 0, "relation of an unselected memory"))
    return plans.join(strangers, "query_id", "left").withColumn("problem", problem).drop("outside")


def selections(plans: DataFrame, candidates: DataFrame, memories: DataFrame) -> DataFrame:
    """Selected memories per turn: the valid plan's, otherwise confident exact matches.

    Turns whose plan is missing or invalid fall back.
    """
    valid = validate_plans(plans, candidates).where(F.col("problem").isNull())
    planned = valid.select("query_id", F.posexplode("selected_memory_ids").alias("order", "memory_id"), "relationships")
    hint = F.get(F.filter("relationships", lambda h: h["memory_id"] == F.col("memory_id")), F.lit(0))
    details = memories.select("memory_id", "kind", "scope", "confidence", "memory_text")
    by_plan = planned.join(details, "memory_id").select(
        "query_id", "memory_id", "order", "kind", "scope", "memory_text", F.lit("planner").alias("selection_source"),
        F.coalesce(hint["relation"], F.lit("related")).alias("selection_relation"),
        F.coalesce(hint["confidence"], "confidence").alias("selection_confidence"))
    exact = candidates.where(F.col("source") == C.STAGE_EXACT).join(valid.select("query_id"), "query_id", "left_anti")
    fallback = exact.join(details.where(F.col("confidence") >= C.EXACT_FALLBACK_CONFIDENCE), "memory_id").select(
        "query_id", "memory_id", F.col("position").cast("int").alias("order"), "kind", "scope", "memory_text",
        F.lit("exact_fallback").alias("selection_source"), F.lit("supports").alias("selection_relation"),
        F.col("confidence").alias("selection_confidence"))
    # Valid plans and exact candidates are few by their own rules, so ranking a turn needs no cut.
    in_turn = W.partitionBy("query_id").orderBy("order", "memory_id")
    return by_plan.unionByName(fallback).withColumn("rank", F.row_number().over(in_turn))


def update_targets(selected: DataFrame) -> DataFrame:
    """Per turn: confident updates, whether anything is uncertain, and the one target if unique."""
    update = F.col("selection_relation") == "updates"
    sure = update & (F.col("selection_confidence") >= C.UPDATE_CONFIDENCE)
    per_turn = selected.groupBy("query_id").agg(
        F.count_if(update).alias("updates"), F.count_if(sure).alias("sure"),
        F.bool_or(F.col("selection_relation") == "uncertain").alias("any_uncertain"), F.max(F.when(sure, F.col("memory_id"))).alias("one"))
    return per_turn.select("query_id", F.col("sure").alias("confident_updates"),
                           ((F.col("sure") != F.col("updates")) | F.col("any_uncertain")).alias("uncertain"),
                           F.when(F.col("sure") == 1, F.col("one")).alias("target_memory_id"))


def prompt_context(attachment: Column, sources: Column, memory: Column) -> Column:
    """Attachment, retrieved sources and confirmed memory, those that exist, in this order."""
    filled = lambda c, before="": F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(before), c))
    return F.concat_ws("\n\n", filled(attachment, "[Attached file]\n"), filled(sources), filled(memory, "CONFIRMED MEMORY CONTEXT\n"))
