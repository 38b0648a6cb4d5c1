"""Binding of identified events to stable subjects within one visibility scope."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from palimpsest.functions import keys
from palimpsest.session import cut_lineage

PLACE = ["owner_id", "scope", "scope_key"]
KEY = PLACE + ["scheme", "normalized_value"]


def identifier_rows(events: DataFrame) -> DataFrame:
    """(memory, place, scheme, value) of every explicit identifier, with the arrival position."""
    placed = events.where(F.col("kind") == "event").withColumn("scope_key", keys.subject_scope_key(
        F.col("scope"), F.col("session_id"), F.col("project_id"), F.col("project_scope")))
    rows = placed.select("memory_id", "created_at", *PLACE, F.explode("payload.event.identifier_references").alias("r"))
    return rows.select("memory_id", F.struct("created_at", "memory_id").alias("position"), *PLACE, "r.scheme", "r.normalized_value").distinct()


def known_subjects(events: DataFrame, subject_identifiers: DataFrame) -> DataFrame:
    """Number of known subjects that an event's identifiers reach, and the one if unique."""
    rows = identifier_rows(events)
    joined = rows.join(subject_identifiers.select(*KEY, "subject_id"), KEY, "left")
    return joined.groupBy("memory_id").agg(F.count_distinct("subject_id").alias("subjects"), F.min("subject_id").alias("subject_id"))


def new_subject_id(memory_id):
    return keys.uuid5(F.concat_ws(":", F.lit("subject"), memory_id))


def bind_once(events: DataFrame, subject_identifiers: DataFrame) -> DataFrame:
    """Binding of events that do not depend on each other.

    No known subject gives a new one, one is adopted, several leave the event
    unbound.
    """
    found = known_subjects(events, subject_identifiers)
    return found.select("memory_id", F.when(F.col("subjects") == 0, new_subject_id(F.col("memory_id")))
                        .when(F.col("subjects") == 1, F.col("subject_id")).alias("subject_id"), "subjects")


def _roots(pointers: DataFrame) -> tuple[DataFrame, int]:
    """``(memory_id, root)`` of a forest ``(memory_id, target)`` whose roots point at themselves, and the jumps it took.

    Every jump doubles the distance, so their number is the logarithm of the depth.
    """
    state, jumps = cut_lineage(pointers), 0
    while True:
        far = state.select(F.col("memory_id").alias("target"), F.col("target").alias("further"))
        jumped = cut_lineage(state.join(far, "target").select("memory_id", F.col("further").alias("target"), (F.col("further") != F.col("target")).alias("moved")))
        jumps += 1
        state = jumped.select("memory_id", "target")
        if jumped.where("moved").isEmpty():
            return state.withColumnRenamed("target", "root"), jumps


def bind_in_order(events: DataFrame, subject_identifiers: DataFrame, rounds: list | None = None) -> tuple[DataFrame, DataFrame]:
    """(event bindings, all subject identifiers) with events taking effect in arrival order.

    An identifier that is not registered yet will be by its earliest unsettled
    holder, unless that one stays unbound.  As if none did, every event follows
    the earliest of the events it depends on, and pointer jumping finds the
    subject at the root of this forest for all events at once.  An event that would then
    reach several subjects is in doubt.  All that an event without doubt depends
    on has its own subject, so it is right as long as it comes before the first
    event in doubt with that subject; an event in doubt is unbound for good once
    all it depends on is settled, and so is one that depends on no other event.
    What is settled registers its identifiers, and the rest starts over.

    A chain without doubt takes one round whatever its length, and the earliest
    unsettled event is always settled.  ``rounds`` gets the jumps of each round.
    """
    rows = cut_lineage(identifier_rows(events))
    registered = cut_lineage(subject_identifiers.select(*KEY, "subject_id"))
    bound = events.sparkSession.createDataFrame([], "memory_id string, subject_id string, subjects bigint")
    while not rows.isEmpty():
        state = rows.join(registered.withColumnRenamed("subject_id", "held"), KEY, "left")
        firsts = state.where(F.col("held").isNull()).groupBy(*KEY).agg(F.min("position").alias("first"))
        asked = cut_lineage(state.join(firsts, KEY, "left").withColumn("parent", F.when(F.col("first") != F.col("position"), F.col("first"))))
        own = cut_lineage(asked.groupBy("memory_id").agg(F.max("position").alias("position"), F.min("parent").alias("pointer"), F.min("held").alias("known")))
        roots, jumps = _roots(own.select("memory_id", F.coalesce("pointer.memory_id", "memory_id").alias("target")))
        if rounds is not None:
            rounds.append(jumps)
        at_root = own.where(F.col("pointer").isNull()).select(F.col("memory_id").alias("root"), F.coalesce("known", new_subject_id(F.col("memory_id"))).alias("label"))
        labels = cut_lineage(roots.join(at_root, "root").select("memory_id", "label"))
        links = asked.where(F.col("parent").isNotNull()).select("memory_id", F.col("parent.memory_id").alias("parent")).distinct()
        of_parents = links.join(labels.select(F.col("memory_id").alias("parent"), "label"), "parent")
        reached = of_parents.select("memory_id", "label").unionByName(asked.where(F.col("held").isNotNull()).select("memory_id", F.col("held").alias("label")))
        told = reached.groupBy("memory_id").agg(F.count_distinct("label").alias("subjects"))
        judged = cut_lineage(own.join(labels, "memory_id").join(told, "memory_id", "left").withColumn("subjects", F.coalesce("subjects", F.lit(0).cast("long"))))
        doubt = judged.where("subjects > 1").groupBy("label").agg(F.min("position").alias("doubtful"))
        before = F.col("doubtful").isNull() | (F.col("position") < F.col("doubtful"))
        right = cut_lineage(judged.where("subjects <= 1").join(doubt, "label", "left").where(F.col("pointer").isNull() | before).select("memory_id", F.col("label").alias("subject_id"), "subjects"))
        waiting = links.join(right.select(F.col("memory_id").alias("parent")), "parent", "left_anti").select("memory_id").distinct()
        unbound = judged.where("subjects > 1").join(waiting, "memory_id", "left_anti").select("memory_id", F.lit(None).cast("string").alias("subject_id"), "subjects")
        settled = cut_lineage(right.unionByName(unbound))
        if settled.isEmpty():
            raise RuntimeError("no event can be settled")
        bound = cut_lineage(bound.unionByName(settled))
        added = (asked.where(F.col("held").isNull() & (F.col("first") == F.col("position"))).select("memory_id", *KEY)
                 .join(right.select("memory_id", "subject_id"), "memory_id").select(*KEY, "subject_id"))
        registered = cut_lineage(registered.unionByName(added))
        rows = cut_lineage(rows.join(settled.select("memory_id"), "memory_id", "left_anti"))
    return bound, registered


def new_identifiers(events: DataFrame, bindings: DataFrame, subject_identifiers: DataFrame) -> DataFrame:
    """Identifiers that bound events add; a known identifier keeps its subject."""
    rows = identifier_rows(events).join(bindings.where(F.col("subject_id").isNotNull()).select("memory_id", "subject_id"), "memory_id")
    fresh = rows.join(subject_identifiers.select(*KEY), KEY, "left_anti")
    return fresh.groupBy(*KEY).agg(F.min_by("subject_id", "position").alias("subject_id"))


def unbound_live_events(memories: DataFrame) -> DataFrame:
    """Live events without a subject, the input of a backfill."""
    return memories.where((F.col("kind") == "event") & F.col("subject_id").isNull() & F.col("status").isin("candidate", "active"))


def bind_given(events: DataFrame, subjects: DataFrame, subject_identifiers: DataFrame) -> dict[str, DataFrame]:
    """Events that already name their subject: accepted bindings, subjects that move, and rejects.

    ``subjects(subject_id, owner_id, scope, scope_key)``.  A subject that is not
    known yet is accepted.  A known one must belong to the event's owner, scope and
    place; a project's subject moves to the event's place instead, with all its
    identifiers.  An identifier that another subject holds in that place rejects the event.
    """
    named = events.where((F.col("kind") == "event") & F.col("subject_id").isNotNull()).withColumn("scope_key", keys.subject_scope_key(
        F.col("scope"), F.col("session_id"), F.col("project_id"), F.col("project_scope")))
    known = subjects.select("subject_id", *[F.col(name).alias("known_" + name) for name in PLACE])
    held = (identifier_rows(named).join(subject_identifiers.select(*KEY, F.col("subject_id").alias("holder")), KEY)
            .join(named.select("memory_id", "subject_id"), "memory_id").where(F.col("holder") != F.col("subject_id")).select("memory_id", F.lit(True).alias("taken")).distinct())
    joined = named.select("memory_id", "subject_id", "created_at", *PLACE).join(known, "subject_id", "left").join(held, "memory_id", "left")
    home = (F.col("owner_id") == F.col("known_owner_id")) & (F.col("scope") == F.col("known_scope"))
    away = F.col("scope_key") != F.col("known_scope_key")
    moves = home & away & (F.col("scope") == "project")
    reason = (F.when(F.col("known_scope").isNotNull() & ~moves & (~home | away), "memory subject belongs to another visibility scope")
              .when(F.col("taken"), "event identifier already belongs to another subject"))
    decided = joined.withColumns({"reason": reason, "moves": F.coalesce(moves, F.lit(False))})
    accepted = decided.where(F.col("reason").isNull())
    # of several events that move one subject the last one stands
    moved = accepted.where("moves").groupBy("subject_id").agg(F.max_by("scope_key", F.struct("created_at", "memory_id")).alias("scope_key"))
    return {"bindings": accepted.select("memory_id", "subject_id"), "moved": moved, "rejects": decided.where(F.col("reason").isNotNull()).select("memory_id", "reason")}


def move_places(rows: DataFrame, moved: DataFrame) -> DataFrame:
    """Subjects or identifiers with the places of moved subjects replaced."""
    new = moved.select("subject_id", F.col("scope_key").alias("new_key"))
    return rows.join(new, "subject_id", "left").withColumn("scope_key", F.coalesce("new_key", "scope_key")).drop("new_key").select(*rows.columns)
