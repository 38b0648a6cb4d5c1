"""Memory lifecycle: batches of commands applied to a snapshot of records.

Every operator joins commands to records by key and returns the changed records
together with audit rows and rejected commands.  ``Changes.records`` is a delta
for :func:`palimpsest.operators.keyed.upsert_memories`.
"""

from __future__ import annotations

from collections import namedtuple

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest import constants as C
from palimpsest.functions import keys, payload as pl, scope as sc, temporal
from palimpsest.operators import keyed
from palimpsest.operators.ordered import top_per

Changes = namedtuple("Changes", "records audit rejects")

REVIEW_STATUS = {"confirm": "active", "reject": "rejected", "expire": "expired"}
RESOLUTIONS = ["supersede_existing", "keep_existing", "expire_existing"]


def _addressed(snapshot: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(commands joined to the record they own, commands that find nothing)."""
    on_key = commands.withColumnRenamed("actor_id", "owner_id")
    found = snapshot.join(on_key, ["memory_id", "owner_id"])
    missing = on_key.join(snapshot.select("memory_id", "owner_id"), ["memory_id", "owner_id"], "left_anti")
    return found, missing.select("memory_id", F.lit("not found").alias("reason"))


def _changes(accepted: DataFrame, columns: list[str], event_type: Column, rejects: DataFrame,
             details: Column = None) -> Changes:
    audit = accepted.select("memory_id", event_type.alias("event_type"), F.col("owner_id").alias("actor_id"),
                            (details if details is not None else F.lit("{}")).alias("details"),
                            F.col("updated_at").alias("created_at"))
    return Changes(accepted.select(*columns), audit, rejects)


def list_memories(memories: DataFrame, now=None, limit: int | None = None, **filters) -> DataFrame:
    """Newest records that match every given filter; filters reach the scan."""
    kept = memories
    for name, value in filters.items():
        if value is not None:
            kept = kept.where(F.col(name) == value)
    newest = kept.orderBy(F.col("updated_at").desc(), "memory_id")
    return newest.limit(limit) if limit else newest


def with_identity(events: DataFrame) -> DataFrame:
    return events.withColumn("identity_key", keys.event_identity(F.col("payload.event")))


def capture_events(snapshot: DataFrame, incoming: DataFrame) -> DataFrame:
    """Outcome of every incoming event, in arrival order: duplicate, conflict or created.

    An event is a duplicate when an earlier live one has the same identity.  All
    others become live, so the event to compare with is simply the earliest live
    one that shares an identifier in the same domain; both are minima over keys,
    and no group is walked in order.
    """
    live = snapshot.where((F.col("kind") == "event") & F.col("status").isin(C.LIVE_STATUSES))
    return judge_events(marked_events(live, 0).unionByName(marked_events(incoming, 1)))


def marked_events(events: DataFrame, arrival: int, *keep: str) -> DataFrame:
    """What capture compares: position, identity, domain, identifiers and claims; ``arrival`` is 0 for known events, 1 for new ones."""
    return events.select(
        "memory_id", F.lit(arrival).alias("arrival"), F.struct(F.lit(arrival).alias("arrival"), "created_at", "memory_id").alias("position"),
        keys.event_identity(F.col("payload.event")).alias("identity_key"),
        keys.event_domain({n: F.col(n) for n in keys.SCOPE_COLUMNS}).alias("domain"),
        keys.event_identifiers(F.col("payload.event")).alias("identifiers"),
        pl.claim_map(F.col("payload.event")).alias("claims"), *keep)


def judge_events(marked: DataFrame) -> DataFrame:
    """Outcomes of the new ones among :func:`marked_events`; of the known ones only first holders matter."""
    originals = marked.groupBy("identity_key").agg(F.min("position").alias("original"))
    known = marked.join(originals, "identity_key")
    # Live records of the snapshot stay live even when two of them share an identity.
    alive = known.where((F.col("arrival") == 0) | (F.col("position") == F.col("original")))
    tagged = alive.select("memory_id", "arrival", "position", "domain", F.explode_outer("identifiers").alias("identifier"))
    holders = tagged.where(F.col("identifier").isNotNull()).groupBy("domain", "identifier").agg(F.min("position").alias("holder"))
    first = (tagged.where((F.col("arrival") == 1) & F.col("identifier").isNotNull()).join(holders, ["domain", "identifier"])
             .where(F.col("holder") < F.col("position")).groupBy("memory_id").agg(F.min("holder").alias("holder")))
    fresh = known.where(F.col("arrival") == 1).join(first, "memory_id", "left")
    other = marked.select(F.col("memory_id").alias("other_id"), F.col("claims").alias("other_claims"))
    compared = (fresh.withColumn("other_id", F.col("holder.memory_id")).join(other, "other_id", "left")
                .withColumn("differences", pl.claim_differences(F.col("other_claims"), F.col("claims"))))
    duplicate = F.col("position") != F.col("original")
    conflict = ~duplicate & F.col("other_id").isNotNull() & (F.size("differences") > 0)
    return compared.select(
        "memory_id", "identity_key",
        F.when(duplicate, "duplicate").when(conflict, "conflict").otherwise("created").alias("outcome"),
        F.when(duplicate, F.col("original.memory_id")).when(conflict, F.col("other_id")).alias("existing_memory_id"),
        F.when(conflict, pl.differences_text(F.col("differences"))).alias("changed_claims"))


def captured_records(incoming: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Records to write after :func:`capture_events`; conflicts become unconfirmed candidates."""
    joined = incoming.drop("identity_key").join(outcomes.where("outcome <> 'duplicate'").select(
        "memory_id", "identity_key", "outcome"), "memory_id")
    conflict = F.col("outcome") == "conflict"
    return joined.withColumns({
        "status": F.when(conflict, "candidate").otherwise(F.col("status")),
        "user_confirmed": F.when(conflict, F.lit(False)).otherwise(F.col("user_confirmed"))}).drop("outcome")


def capture_writes(incoming: DataFrame, outcomes: DataFrame, now, event_type: str = "captured") -> dict[str, DataFrame]:
    """Everything that :func:`capture_events` leads to: records, open conflicts, audit rows and projection requests.

    A duplicate only leaves an audit row at the record it repeats; a conflict is
    written as a candidate, opens a conflict and is noted at both records.
    Conflict ids follow from the two records, so a repeated batch repeats them.
    """
    records = captured_records(incoming, outcomes)
    told = outcomes.join(incoming.select("memory_id", "owner_id", "source_turn_id"), "memory_id")
    conflict = F.col("outcome") == "conflict"
    conflict_id = F.xxhash64("memory_id", "existing_memory_id")
    conflicts = told.where(conflict).select(
        conflict_id.alias("conflict_id"), F.col("memory_id").alias("incoming_memory_id"), "existing_memory_id", F.lit("claim_mismatch").alias("conflict_type"),
        F.lit("open").alias("status"), F.to_json(F.struct("changed_claims")).alias("details"), sc.at(now).alias("created_at"))
    row = lambda memory, name, details: F.struct(memory.alias("memory_id"), F.lit(name).alias("event_type"), details.alias("details"))
    seen = row(F.col("existing_memory_id"), "duplicate_detected", F.to_json(F.struct("identity_key", "source_turn_id")))
    own = row(F.col("memory_id"), "conflict_candidate_created", F.lit("{}"))
    other = row(F.col("existing_memory_id"), "conflict_detected",
                F.to_json(F.struct("changed_claims", conflict_id.alias("conflict_id"), F.col("memory_id").alias("incoming_memory_id"))))
    created = row(F.col("memory_id"), event_type, F.lit("{}"))
    rows = F.when(F.col("outcome") == "duplicate", F.array(seen)).when(conflict, F.array(own, other)).otherwise(F.array(created))
    audit = told.select("owner_id", F.explode(rows).alias("r")).select(
        "r.memory_id", "r.event_type", F.col("owner_id").alias("actor_id"), "r.details", sc.at(now).alias("created_at"))
    return {"records": records, "conflicts": conflicts, "audit": audit, "jobs": keyed.job_rows(records, sc.at(now))}


def latest_conflicts(conflicts: DataFrame) -> DataFrame:
    """Newest conflict of each (incoming, existing) pair."""
    return top_per(conflicts, ["incoming_memory_id", "existing_memory_id"], [F.col("conflict_id").desc()])


def apply_reconciliation(snapshot: DataFrame, incoming: DataFrame, conflicts: DataFrame) -> dict[str, DataFrame]:
    """Apply supplied outcomes.

    ``incoming`` is event records plus ``outcome`` and ``existing_memory_id``.
    Returns results, records to write, conflicts to open, links and rejects.
    """
    target = snapshot.select(F.col("memory_id").alias("existing_memory_id"), F.col("owner_id").alias("existing_owner"),
                             F.col("subject_id").alias("existing_subject"))
    prior = latest_conflicts(conflicts).select(F.col("incoming_memory_id").alias("memory_id"), "existing_memory_id",
                                               F.col("conflict_id").alias("prior_conflict"))
    joined = incoming.join(target, "existing_memory_id", "left").join(prior, ["memory_id", "existing_memory_id"], "left")
    needs_existing = F.col("outcome").isin("duplicate", "update", "related")
    reason = (F.when(F.col("kind") != "event", "not an event")
              .when(~F.col("outcome").isin(C.RECONCILIATION_OUTCOMES), "unknown outcome")
              .when(needs_existing & F.col("existing_memory_id").isNull(), "no existing memory given")
              .when(F.col("existing_memory_id").isNotNull() & F.col("existing_owner").isNull(), "existing memory not found")
              .when(F.col("existing_owner") != F.col("owner_id"), "existing memory of another owner"))
    judged = joined.withColumn("reason", reason)
    good = judged.where(F.col("reason").isNull())
    retry = (F.col("outcome") == "update") & F.col("prior_conflict").isNotNull()
    result = (F.when(F.col("outcome") == "duplicate", "duplicate").when(F.col("outcome") == "update", "conflict")
              .when(F.col("outcome") == "uncertain", "uncertain").otherwise("created"))
    held = F.col("outcome").isin("update", "uncertain")
    written = good.where((F.col("outcome") != "duplicate") & ~retry).withColumns({
        "subject_id": F.when(F.col("outcome").isin("update", "related"), F.coalesce("existing_subject", "subject_id"))
        .otherwise(F.col("subject_id")),
        "status": F.when(held, "candidate").otherwise(F.col("status")),
        "user_confirmed": F.when(held, F.lit(False)).otherwise(F.col("user_confirmed")),
        "event_type": F.when(F.col("outcome") == "update", "conflict_candidate_created").otherwise(
            F.concat(F.lit("reconciliation_"), F.when(F.col("outcome") == "new", "created").otherwise(F.col("outcome"))))})
    opened = good.where((F.col("outcome") == "update") & ~retry)
    return {
        "results": good.select("memory_id", result.alias("result"), "existing_memory_id",
                               F.when(retry, F.col("prior_conflict")).alias("conflict_id")),
        "records": written.select(*snapshot.columns, "event_type"),
        "conflicts": opened.select(F.col("memory_id").alias("incoming_memory_id"), "existing_memory_id",
                                   F.lit("claim_mismatch").alias("conflict_type"), F.lit("open").alias("status")),
        "links": good.where(F.col("outcome") == "related").select(
            F.col("memory_id").alias("from_memory_id"), F.col("existing_memory_id").alias("to_memory_id"),
            F.lit("related").alias("relationship_type"), F.lit("reconciliation").alias("source")),
        "rejects": judged.where(F.col("reason").isNotNull()).select("memory_id", "reason")}


def propose_claim_changes(snapshot: DataFrame, proposals: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """(records ready for reconciliation, rejects).

    ``proposals`` is event records plus ``target_memory_id``, the asking chat's
    ``session_id``, ``project_id``, ``project_scope`` and ``chat_owner``.  The
    target's visibility is inherited; it is checked against the authority first.
    """
    target = snapshot.withColumn("place", sc.record_key()).select(
        F.col("memory_id").alias("target_memory_id"), F.col("owner_id").alias("t_owner"), F.col("kind").alias("t_kind"),
        F.col("subject_id").alias("t_subject"), F.col("scope").alias("t_scope"), F.col("session_id").alias("t_session"),
        F.col("project_id").alias("t_project"), F.col("project_scope").alias("t_project_scope"), "place",
        F.coalesce(sc.is_current(now), F.lit(False)).alias("t_current"), F.col("payload").alias("t_payload"))
    joined = proposals.withColumn("places", sc.chat_keys()).join(target, "target_memory_id", "left")
    seen = F.coalesce(F.array_contains("places", F.col("place")), F.lit(False)) & F.col("t_current")
    reason = (F.when(F.col("kind") != "event", "not an event")
              .when(F.col("owner_id") != F.col("chat_owner"), "owner does not match the request")
              .when(F.col("t_owner").isNull() | (F.col("t_owner") != F.col("owner_id")), "target not found")
              .when(F.col("t_kind") != "event", "target is not an event")
              .when(~seen, "target is not visible")
              .when(F.col("subject_id") != F.col("t_subject"), "target has another subject"))
    judged = joined.withColumn("reason", reason)
    differences = pl.claim_differences(pl.claim_map(F.col("t_payload.event")), pl.claim_map(F.col("payload.event")))
    good = judged.where(F.col("reason").isNull()).withColumn("differences", differences)
    ready = good.withColumns({
        "memory_id": F.coalesce(F.when(F.col("source_turn_id").isNotNull(), keys.proposal_id(
            F.col("source_turn_id"), F.col("target_memory_id"))), F.col("memory_id")),
        "subject_id": F.col("t_subject"), "scope": F.col("t_scope"), "session_id": F.col("t_session"),
        "project_id": F.col("t_project"), "project_scope": F.col("t_project_scope"),
        "outcome": F.when(F.size("differences") > 0, "update").otherwise("duplicate"),
        "existing_memory_id": F.col("target_memory_id"), "changed_claims": pl.differences_text(F.col("differences"))})
    helper = [name for name in ready.columns if name.startswith("t_")] + ["places", "place", "reason", "differences", "chat_owner"]
    return ready.drop(*helper), judged.where(F.col("reason").isNotNull()).select("memory_id", "reason")


def decision_problem() -> Column:
    """Why a supplied reconciliation decision is invalid; null when it is fine.

    Expects ``outcome``, ``existing_memory_id``, ``changed_count``, ``confidence``
    and ``candidate_source`` (null when the id is not among the candidates).
    """
    needs = F.col("outcome").isin("duplicate", "update", "related")
    return (F.when(needs & F.col("candidate_source").isNull(), "must select a supplied candidate")
            .when(~needs & F.col("existing_memory_id").isNotNull(), "cannot select an existing memory")
            .when((F.col("outcome") == "update") & (F.col("changed_count") == 0), "an update must describe changed claims")
            .when((F.col("candidate_source") == "injected_context") & (F.col("confidence") < C.UPDATE_CONFIDENCE),
                  "implicit context needs high confidence"))


def validate_decisions(decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Decisions with ``problem``; ``candidates(memory_id, candidate_id, candidate_source)``."""
    known = candidates.select("memory_id", F.col("candidate_id").alias("existing_memory_id"), "candidate_source")
    return decisions.join(known, ["memory_id", "existing_memory_id"], "left").withColumn("problem", decision_problem())


def decide(cases: DataFrame) -> DataFrame:
    """Decision cascade of an extracted event.

    ``cases`` carries, per event, the explicit target and whether it changes, the
    number of candidates, the context association and the supplied decision.
    """
    pick = lambda outcome, existing, confidence, reason: F.struct(
        F.lit(outcome).alias("outcome") if isinstance(outcome, str) else outcome.alias("outcome"),
        existing.cast("string").alias("existing_memory_id"), confidence.cast("double").alias("confidence"),
        F.lit(reason).alias("reason"))
    none = F.lit(None)
    decision = (
        F.when(F.col("update_target_id").isNotNull() & F.col("target_changes"),
               pick("update", F.col("update_target_id"), F.lit(1.0), "resolved target"))
        .when(F.col("candidate_count") == 0, pick("new", none, F.lit(1.0), "no candidate"))
        .when(F.col("associated_id").isNotNull() & F.col("association_changes"),
              pick("update", F.col("associated_id"), F.col("association_confidence"), "context association"))
        .when(F.col("supplied_outcome").isNotNull() & F.col("supplied_problem").isNull(),
              pick(F.col("supplied_outcome"), F.col("supplied_id"), F.col("supplied_confidence"), "supplied decision"))
        .otherwise(pick("uncertain", none, F.lit(0.0), "no usable decision")))
    return cases.select("memory_id", decision.alias("d")).select("memory_id", "d.*")


def associate_context(incoming: DataFrame, candidates: DataFrame) -> DataFrame:
    """The one candidate whose subject terms match best, or none on a tie.

    ``incoming(memory_id, entity_terms, summary_terms)``; ``candidates`` adds
    ``candidate_id``, its terms, ``candidate_source``, ``selection_relation`` and
    ``selection_confidence`` per incoming event.
    """
    usable = candidates.where((F.col("candidate_source") == "injected_context")
                              & (F.col("selection_relation") == "updates")
                              & (F.col("selection_confidence") >= C.UPDATE_CONFIDENCE))
    joined = incoming.join(usable, "memory_id")
    entity = F.array_intersect("entity_terms", "candidate_entity_terms")
    summary = F.array_intersect("summary_terms", "candidate_summary_terms")
    scored = joined.select(
        "memory_id", "candidate_id", F.col("selection_confidence").alias("confidence"),
        F.size(entity).alias("entities"), (3 * F.size(entity) + F.size(summary)).alias("score"),
        F.array_join(F.array_sort(F.array_union(entity, summary)), ", ").alias("terms")).where("entities > 0 AND score >= 3")
    best = scored.groupBy("memory_id").agg(F.max("score").alias("score"))
    top = scored.join(best, ["memory_id", "score"])
    alone = top.groupBy("memory_id").agg(F.count("*").alias("ties"), F.first("candidate_id").alias("candidate_id"),
                                         F.first("confidence").alias("confidence"), F.first("score").alias("score"),
                                         F.first("terms").alias("terms"))
    return alone.where("ties = 1").drop("ties")


def link(relationships: DataFrame, incoming: DataFrame) -> DataFrame:
    """Relationships to insert; symmetric ones are stored with sorted ends, known ones skipped."""
    swap = F.col("relationship_type") == "related"
    low, high = F.least("from_memory_id", "to_memory_id"), F.greatest("from_memory_id", "to_memory_id")
    sorted_ends = incoming.select(
        F.when(swap, low).otherwise(F.col("from_memory_id")).alias("from_memory_id"),
        F.when(swap, high).otherwise(F.col("to_memory_id")).alias("to_memory_id"), "relationship_type")
    key = ["from_memory_id", "to_memory_id", "relationship_type"]
    return sorted_ends.dropDuplicates(key).join(relationships.select(*key), key, "left_anti")


def resolve_conflicts(snapshot: DataFrame, conflicts: DataFrame, commands: DataFrame, now) -> dict[str, DataFrame]:
    """Close open conflicts; ``commands(conflict_id, action, actor_id)``."""
    legal = commands.where(F.col("action").isin(RESOLUTIONS))
    owner_of = lambda column, name: snapshot.select(F.col("memory_id").alias(column), F.col("owner_id").alias(name))
    open_ = (conflicts.where(F.col("status") == "open").join(legal, "conflict_id")
             .join(owner_of("incoming_memory_id", "in_owner"), "incoming_memory_id")
             .join(owner_of("existing_memory_id", "ex_owner"), "existing_memory_id")
             .where((F.col("in_owner") == F.col("actor_id")) & (F.col("ex_owner") == F.col("actor_id"))))
    keep = F.col("action") == "keep_existing"
    supersede = F.col("action") == "supersede_existing"
    none = F.lit(None).cast("string")
    change = lambda memory, status, event, replaced: F.struct(
        memory.alias("memory_id"), status.alias("new_status"), event.alias("event_type"), replaced.alias("new_superseded_by"))
    changes = open_.select("conflict_id", "actor_id", "action", F.explode(F.filter(F.array(
        change(F.col("incoming_memory_id"), F.when(keep, "rejected").otherwise("active"),
               F.when(keep, "conflict_rejected").otherwise("conflict_accepted"), none),
        F.when(~keep, change(F.col("existing_memory_id"), F.when(supersede, "superseded").otherwise("expired"),
                             F.when(supersede, "superseded").otherwise("expired"),
                             F.when(supersede, F.col("incoming_memory_id"))))),
        lambda x: x.isNotNull())).alias("c")).select("conflict_id", "actor_id", "action", "c.*")
    # Commands of one batch take effect in conflict order, so a record's last change stands.
    final = top_per(changes, ["memory_id"], [F.col("conflict_id").desc()])
    records = snapshot.join(final.drop("actor_id", "conflict_id"), "memory_id").withColumns({
        "status": F.col("new_status"),
        "superseded_by": F.coalesce("new_superseded_by", "superseded_by"),
        "user_confirmed": F.when(F.col("event_type") == "conflict_accepted", F.lit(True)).otherwise(F.col("user_confirmed")),
        "valid_to": F.when(F.col("event_type") == "expired", sc.at(now)).otherwise(F.col("valid_to")),
        "updated_at": sc.at(now)}).select(*snapshot.columns)
    lineage = open_.where(supersede).select(
        F.col("existing_memory_id").alias("from_memory_id"), F.col("incoming_memory_id").alias("to_memory_id"),
        F.lit("superseded_by").alias("relationship_type"), "conflict_id")
    replaced = open_.where(supersede).select(
        F.col("incoming_memory_id").alias("memory_id"), F.lit("replacement_linked").alias("event_type"), "actor_id", "conflict_id")
    audit = changes.select("memory_id", "event_type", "actor_id", "conflict_id").unionByName(replaced)
    closed = open_.select("conflict_id", F.lit("resolved").alias("status"), F.col("actor_id").alias("resolved_by"), "action")
    return {"records": records, "audit": audit, "relationships": lineage, "conflicts": closed,
            "rejects": commands.join(closed.select("conflict_id"), "conflict_id", "left_anti").select("conflict_id")}


def transition(snapshot: DataFrame, commands: DataFrame, now) -> Changes:
    """Set the status named by each command."""
    found, missing = _addressed(snapshot, commands)
    legal = found.where(F.col("new_status").isin(C.MEMORY_STATUSES))
    moved = legal.withColumns({"status": F.col("new_status"), "superseded_by": F.col("new_superseded_by"),
                               "updated_at": sc.at(now)})
    return _changes(moved, snapshot.columns, F.concat(F.lit("status_"), "status"), missing)


def review(snapshot: DataFrame, commands: DataFrame, now) -> Changes:
    """Confirm, reject or expire; only candidates and active memories can be reviewed."""
    found, missing = _addressed(snapshot, commands)
    reason = (F.when(~F.col("status").isin(C.LIVE_STATUSES), F.concat(F.lit("cannot review "), "status"))
              .when(~F.col("action").isin(list(REVIEW_STATUS)), "unsupported action"))
    judged = found.withColumn("reason", reason)
    status = F.create_map(*[F.lit(x) for pair in REVIEW_STATUS.items() for x in pair])[F.col("action")]
    accepted = judged.where(F.col("reason").isNull()).withColumns({
        "user_confirmed": (F.col("action") == "confirm") | F.col("user_confirmed"),
        "valid_to": F.when(F.col("action") == "expire", sc.at(now)).otherwise(F.col("valid_to")),
        "status": status, "updated_at": sc.at(now)})
    rejects = missing.unionByName(judged.where(F.col("reason").isNotNull()).select("memory_id", "reason"))
    return _changes(accepted, snapshot.columns, F.col("action"), rejects)


def forget(snapshot: DataFrame, commands: DataFrame, now) -> Changes:
    """Soft delete; deleting twice changes nothing."""
    found, missing = _addressed(snapshot, commands)
    gone = found.where(F.col("status") != "deleted").withColumns({"status": F.lit("deleted"), "updated_at": sc.at(now)})
    return _changes(gone, snapshot.columns, F.lit("deleted_by_user"), missing)


def promote(snapshot: DataFrame, commands: DataFrame, now) -> Changes:
    """Move memories into a project; ``commands(memory_id, actor_id, to_project, to_project_id)``."""
    found, missing = _addressed(snapshot, commands)
    reason = (F.when(F.coalesce("to_project", F.lit("")) == "", "project name required")
              .when(~F.col("status").isin(C.LIVE_STATUSES), F.concat(F.lit("cannot promote "), "status")))
    judged = found.withColumn("reason", reason).withColumn("from_scope", F.col("scope"))
    accepted = judged.where(F.col("reason").isNull()).withColumns({
        "scope": F.lit("project"), "project_scope": F.col("to_project"), "project_id": F.col("to_project_id"),
        "user_confirmed": F.lit(True), "status": F.lit("active"),
        "subject_id": F.when(F.col("kind") != "event", F.col("subject_id")), "updated_at": sc.at(now)})
    details = F.to_json(F.struct("from_scope", "project_scope", F.col("scope").alias("to_scope")))
    rejects = missing.unionByName(judged.where(F.col("reason").isNotNull()).select("memory_id", "reason"))
    return _changes(accepted, snapshot.columns, F.lit("promoted"), rejects, details)


def edit(snapshot: DataFrame, commands: DataFrame, now) -> tuple[Changes, DataFrame]:
    """(changes, lineage): each edit closes the old version and adds a new one.

    ``commands(memory_id, actor_id, new_payload)``; a memory is edited at most
    once per batch, the id of the new version follows from the old one.
    """
    found, missing = _addressed(snapshot, commands)
    legal = F.col("status").isin(C.LIVE_STATUSES)
    old = found.where(legal).withColumn("replacement_id", keys.uuid5(
        F.concat_ws(":", F.lit("edit"), "memory_id", F.lit(str(now)))))
    closed = old.withColumns({"status": F.lit("superseded"), "superseded_by": F.col("replacement_id"),
                              "updated_at": sc.at(now)})
    fresh = old.withColumns({"memory_id": F.col("replacement_id"), "payload": F.col("new_payload"),
                             "superseded_by": F.lit(None).cast("string"), "created_at": sc.at(now),
                             "updated_at": sc.at(now)})
    fresh = fresh.withColumn("identity_key", F.when(F.col("kind") == "event", keys.event_identity(F.col("payload.event"))))
    mark = lambda df, event: df.select(*snapshot.columns, F.lit(event).alias("event_type"))
    written = mark(fresh, "edited_replacement_created").unionByName(mark(closed, "superseded_by_edit"))
    lineage = old.select(F.col("memory_id").alias("from_memory_id"), F.col("replacement_id").alias("to_memory_id"),
                         F.lit("superseded_by").alias("relationship_type"), F.lit("manual_edit").alias("source"))
    rejects = missing.unionByName(found.where(~legal).select(
        "memory_id", F.concat(F.lit("cannot edit "), "status").alias("reason")))
    return _changes(written, snapshot.columns, F.col("event_type"), rejects), lineage


def supersede(snapshot: DataFrame, commands: DataFrame, now) -> tuple[Changes, DataFrame]:
    """(changes, lineage) for ``commands(memory_id, replacement_id, actor_id)``."""
    found, missing = _addressed(snapshot, commands)
    other = snapshot.select(F.col("memory_id").alias("replacement_id"), F.col("owner_id").alias("other_owner"))
    joined = found.join(other, "replacement_id", "left")
    reason = (F.when(F.col("memory_id") == F.col("replacement_id"), "a memory cannot supersede itself")
              .when(F.col("other_owner").isNull() | (F.col("other_owner") != F.col("owner_id")), "replacement not found"))
    judged = joined.withColumn("reason", reason)
    accepted = judged.where(F.col("reason").isNull()).withColumns({
        "status": F.lit("superseded"), "superseded_by": F.col("replacement_id"), "updated_at": sc.at(now)})
    lineage = accepted.select(F.col("memory_id").alias("from_memory_id"), F.col("replacement_id").alias("to_memory_id"),
                              F.lit("superseded_by").alias("relationship_type"), F.lit("manual_supersede").alias("source"))
    rejects = missing.unionByName(judged.where(F.col("reason").isNotNull()).select("memory_id", "reason"))
    return _changes(accepted, snapshot.columns, F.lit("superseded"), rejects), lineage


def due(snapshot: DataFrame, now) -> DataFrame:
    """Active memories past their validity; read in ``valid_to`` order."""
    return snapshot.where((F.col("status") == "active") & (F.col("valid_to") <= sc.at(now)))


def expire_due(snapshot: DataFrame, now) -> Changes:
    """Expire what is due; a second sweep at the same time finds nothing."""
    swept = due(snapshot, now).withColumns({"status": F.lit("expired"), "updated_at": sc.at(now)})
    details = F.to_json(F.struct(F.lit(str(now)).alias("expired_at"), "valid_to"))
    audit = swept.select("memory_id", F.lit("expired_by_sweep").alias("event_type"), F.lit("system").alias("actor_id"),
                         details.alias("details"), sc.at(now).alias("created_at"))
    return Changes(swept, audit, None)


def capture_policy(candidates: DataFrame) -> DataFrame:
    """Scope, status and validity of extracted candidates.

    ``candidates(kind, confidence, consent, project_scope, user_content, temporal_scope, captured_at, …)``.
    """
    in_project = F.coalesce("project_scope", F.lit("")) != ""
    event = in_project & (F.col("kind") == "event") & (F.col("confidence") >= C.EVENT_AUTO_CONFIDENCE)
    preference = (in_project & (F.col("kind") == "preference") & F.col("consent")
                  & (F.col("confidence") >= C.PREFERENCE_AUTO_CONFIDENCE))
    auto = F.coalesce(event | preference, F.lit(False))
    return candidates.withColumns({
        "scope": F.when(auto, "project").otherwise("session"), "status": F.when(auto, "active").otherwise("candidate"),
        "user_confirmed": auto,
        "valid_to": F.when(event, temporal.event_valid_to(F.col("user_content"), F.col("temporal_scope"), F.col("captured_at"))),
        "event_type": F.when(event, "auto_promoted_project_event").when(preference, "auto_promoted_project_preference")
        .otherwise("candidate_extracted"),
        "reason": F.when(~in_project, "no_project_scope").when(event, "high_confidence_user_stated_operational_event")
        .when(preference, "high_confidence_user_stated_project_preference").otherwise("requires_review")})


def claim_extractions(extractions: DataFrame, requests: DataFrame) -> DataFrame:
    """(turn, version) pairs this run may work on: new ones and failed ones, once each."""
    key = ["source_turn_id", "extraction_version"]
    known = extractions.select(*key, F.col("status").alias("known_status"))
    asked = requests.select(*key).distinct()
    return asked.join(known, key, "left").where(
        F.col("known_status").isNull() | (F.col("known_status") == "failed")).select(*key)


def complete_extractions(extractions: DataFrame, results: DataFrame, now) -> DataFrame:
    key = ["source_turn_id", "extraction_version"]
    done = results.select(*key, F.col("status").alias("new_status"), F.col("error").alias("new_error"))
    joined = extractions.join(done, key, "left")
    hit = F.col("new_status").isNotNull()
    return joined.withColumns({"error": F.when(hit, F.col("new_error")).otherwise(F.col("error")),
                               "updated_at": F.when(hit, sc.at(now)).otherwise(F.col("updated_at")),
                               "status": F.coalesce("new_status", "status")}).drop("new_status", "new_error")


def backfill_project_ids(snapshot: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with their project id, records whose project is unknown)."""
    from palimpsest.functions.text import name_key
    bare = snapshot.where((F.col("scope") == "project") & F.col("project_id").isNull() & F.col("project_scope").isNotNull())
    known = names.select("owner_id", "normalized_name", F.col("project_id").alias("found_id"))
    joined = bare.withColumn("normalized_name", name_key(F.col("project_scope"))).join(
        known, ["owner_id", "normalized_name"], "left")
    matched = joined.where(F.col("found_id").isNotNull()).withColumn("project_id", F.col("found_id"))
    return matched.select(*snapshot.columns), joined.where(F.col("found_id").isNull()).select(*snapshot.columns)


def turn_outcomes(turns: DataFrame, extractions: DataFrame, records: DataFrame, conflicts: DataFrame) -> DataFrame:
    """What each turn's memory work led to; ``turns(source_turn_id)``."""
    open_ = conflicts.where(F.col("status") == "open").select(F.col("incoming_memory_id").alias("memory_id")).distinct()
    flagged = records.select("memory_id", "source_turn_id", "status").join(
        open_.withColumn("has_conflict", F.lit(True)), "memory_id", "left")
    per_turn = flagged.groupBy("source_turn_id").agg(
        F.count("*").alias("memories"), F.bool_or(F.col("status") == "candidate").alias("has_candidate"),
        F.count_if(F.col("has_conflict")).alias("open_conflicts"))
    state = extractions.select("source_turn_id", F.col("status").alias("extraction"))
    joined = turns.select("source_turn_id").join(state, "source_turn_id", "left").join(per_turn, "source_turn_id", "left")
    memories = F.coalesce("memories", F.lit(0))
    outcome = (F.when(F.col("extraction").isNull() | (F.col("extraction") == "running"), "pending")
               .when(F.col("extraction") == "failed", "failed")
               .when((F.coalesce("open_conflicts", F.lit(0)) > 0) | F.coalesce("has_candidate", F.lit(False)), "review_required")
               .when(memories > 0, "memory_saved").otherwise("no_memory"))
    return joined.select("source_turn_id", F.coalesce("extraction", F.lit("queued")).alias("status"),
                         outcome.alias("outcome"), memories.alias("memories"),
                         F.coalesce("open_conflicts", F.lit(0)).alias("open_conflicts"))
