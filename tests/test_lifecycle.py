"""Lifecycle operators against literal cases and sequential brute force."""

import random
from datetime import datetime, timedelta

from helpers import NOW, claim, event, records, ref, table, values
from pyspark.sql import functions as F

from palimpsest.operators import evidence as ev, identifiers as ids, jobs, keyed, lifecycle as lc, sessions as ss, subjects
from palimpsest.functions import text as tx


def day(n):
    return datetime(2024, 1, n)


def test_capture_literal_cases(spark):
    friday = event(time="Friday", entities=["AC-42 carrier"])
    monday = event(time="Monday", entities=["AC-42 carrier"])
    live = records(spark, [{"memory_id": "a", "payload": friday}])
    incoming = records(spark, [
        {"memory_id": "b", "session_id": "s2", "payload": friday, "created_at": day(2)},
        {"memory_id": "c", "payload": monday, "created_at": day(3)},
        {"memory_id": "d", "project_id": "p2", "payload": monday, "created_at": day(4)}])
    out = lc.capture_events(live, incoming)
    assert values(out, "memory_id", "outcome", "existing_memory_id", "changed_claims") == [
        ("b", "duplicate", "a", None), ("c", "conflict", "a", "temporal_scope:Friday>Monday"), ("d", "created", None, None)]
    written = {r["memory_id"]: r["status"] for r in lc.captured_records(incoming, out).collect()}
    assert written == {"c": "candidate", "d": "active"}


def test_capture_equals_arrival_order(spark):
    rng = random.Random(11)
    rows = []
    for i in range(120):
        chosen = rng.sample(["A-1", "A-2", "A-3", "B-9"], rng.choice([0, 1, 1, 2]))
        claims = [claim("status", rng.choice(["open", "late"]))] if rng.random() < 0.7 else []
        rows.append({"memory_id": f"m{i:03d}", "project_id": rng.choice(["p1", "p2"]), "created_at": day(1) + timedelta(minutes=i // 2),
                     "payload": event(refs=[ref(v) for v in chosen], claims=claims, time=rng.choice(["Friday", None]))})

    def claims_of(payload):
        found = {c["attribute"]: c["value"] for c in payload["event"]["claims"]}
        return found or ({"temporal_scope": payload["event"]["temporal_scope"]} if payload["event"]["temporal_scope"] else {})

    def identity(row):
        e = row["payload"]["event"]
        claims = sorted((c["attribute"], c["normalized_value"]) for c in e["claims"]) or [("temporal_scope", (e["temporal_scope"] or "").lower())]
        return row["project_id"], tuple(sorted(r["normalized_value"] for r in e["identifier_references"])), tuple(claims)

    live, expected = [], []
    for n, row in enumerate(sorted(rows, key=lambda r: (r["created_at"], r["memory_id"]))):
        same = next((x for x in live if identity(x) == identity(row)), None)
        mine = {r["normalized_value"] for r in row["payload"]["event"]["identifier_references"]}
        other = next((x for x in live if x["project_id"] == row["project_id"]
                      and mine & {r["normalized_value"] for r in x["payload"]["event"]["identifier_references"]}), None)
        if same:
            expected.append((row["memory_id"], "duplicate", same["memory_id"]))
            continue
        conflict = other is not None and claims_of(other["payload"]) != claims_of(row["payload"])
        expected.append((row["memory_id"], "conflict" if conflict else "created", other["memory_id"] if conflict else None))
        live.append(row)
    everything = records(spark, rows)
    got = values(lc.capture_events(everything.limit(0), everything), "memory_id", "outcome", "existing_memory_id")
    assert got == sorted(expected, key=repr) and len({o for _, o, _ in expected}) == 3


def test_subjects_equal_arrival_order(spark):
    rng = random.Random(2)
    rows = [{"memory_id": f"m{i:02d}", "created_at": day(1) + timedelta(minutes=i),
             "payload": event(refs=[ref(v) for v in rng.sample(["A1", "B2", "C3", "D4", "E5", "F6"], rng.choice([1, 1, 2, 3]))])} for i in range(40)]
    known, expected = {"a1": "subject-a"}, {}
    for row in rows:
        mine = [r["normalized_value"] for r in row["payload"]["event"]["identifier_references"]]
        reached = {known[v] for v in mine if v in known}
        subject = None if len(reached) > 1 else next(iter(reached), "new-" + row["memory_id"])
        expected[row["memory_id"]] = subject
        for v in mine if subject else []:
            known.setdefault(v, subject)
    start = table(spark, "memory_subject_identifiers", [{"subject_id": "subject-a", "owner_id": "o", "scope": "project", "scope_key": "project:p1",
                                                         "scheme": "external_reference", "normalized_value": "a1"}])
    bound, registered = subjects.bind_in_order(records(spark, rows), start)
    named = {r["subject_id"]: "new-" + r["memory_id"] for r in records(spark, rows).select("memory_id", subjects.new_subject_id(F.col("memory_id")).alias("subject_id")).collect()}
    got = {r["memory_id"]: named.get(r["subject_id"], r["subject_id"]) for r in bound.collect()}
    assert got == expected
    assert {r["normalized_value"]: named.get(r["subject_id"], r["subject_id"]) for r in registered.collect()} == known


def test_expiry_is_idempotent(spark):
    rows = records(spark, [{"memory_id": "due", "valid_to": day(19)}, {"memory_id": "later", "valid_to": day(25)}, {"memory_id": "open"}])
    swept = lc.expire_due(rows, NOW)
    assert values(swept.records, "memory_id", "status") == [("due", "expired")]
    assert values(swept.audit, "memory_id", "event_type", "actor_id") == [("due", "expired_by_sweep", "system")]
    assert values(keyed.job_rows(swept.records, F.lit(NOW).cast("timestamp")), "memory_id", "target") == [("due", "graph"), ("due", "vector")]
    again = keyed.upsert_memories(rows, swept.records)
    assert lc.expire_due(again, NOW).records.isEmpty()


def test_review_edit_and_promote(spark):
    rows = records(spark, [{"memory_id": "a", "status": "candidate", "user_confirmed": False, "payload": event(refs=[ref("A1")])}, {"memory_id": "b", "status": "rejected"}])
    command = lambda extra, names: spark.createDataFrame(extra, names)
    out = lc.review(rows, command([("a", "o", "confirm"), ("b", "o", "confirm"), ("a", "x", "confirm")], "memory_id string, actor_id string, action string"), NOW)
    assert values(out.records, "memory_id", "status", "user_confirmed") == [("a", "active", True)]
    assert values(out.rejects, "memory_id", "reason") == [("a", "not found"), ("b", "cannot review rejected")]
    edits = rows.select("memory_id", F.lit("o").alias("actor_id"), F.col("payload").alias("new_payload"))
    changes, lineage = lc.edit(rows, edits, NOW)
    assert sorted(r["status"] for r in changes.records.collect()) == ["candidate", "superseded"] and lineage.count() == 1
    promoted = lc.promote(rows.withColumn("subject_id", F.lit("s")), command([("a", "o", "Beta", None)], "memory_id string, actor_id string, to_project string, to_project_id string"), NOW)
    assert values(promoted.records, "memory_id", "project_scope", "project_id", "subject_id", "status") == [("a", "Beta", None, None, "active")]


def test_context_association(spark):
    terms = lambda s: tx.subject_terms(F.lit(s))
    rows = spark.createDataFrame([("doctor", "visit with doctor"), ("manager", "call with manager"), ("time", "Friday")], "memory_id string, entities string")
    incoming = rows.select("memory_id", tx.subject_terms(F.col("entities")).alias("entity_terms"), terms("moved to Monday").alias("summary_terms"))
    targets = spark.createDataFrame([("d", "doctor"), ("m", "manager")], "candidate_id string, e string").select(
        "candidate_id", tx.subject_terms(F.col("e")).alias("candidate_entity_terms"), terms("moved to Monday").alias("candidate_summary_terms"),
        F.lit("injected_context").alias("candidate_source"), F.lit("updates").alias("selection_relation"), F.lit(0.95).alias("selection_confidence"))
    candidates = targets.join(rows.select("memory_id"))
    assert values(lc.associate_context(incoming, candidates), "memory_id", "candidate_id") == [("doctor", "d"), ("manager", "m")]
    tied = candidates.withColumn("candidate_entity_terms", terms("doctor"))
    assert lc.associate_context(incoming.where("memory_id = 'doctor'"), tied).isEmpty()


def test_identifier_candidates(spark):
    rows = records(spark, [
        {"memory_id": "explicit", "payload": event(refs=[ref("EK-420")]), "updated_at": day(2)},
        {"memory_id": "legacy", "payload": event(entities=["order EK420"]), "updated_at": day(9)},
        {"memory_id": "elsewhere", "project_id": "p2", "payload": event(refs=[ref("EK-420")])},
        {"memory_id": "expired", "valid_to": day(5), "payload": event(refs=[ref("EK-420")])},
        {"memory_id": "invoice", "payload": event(refs=[ref("EK-420", scheme="invoice_number")])},
        {"memory_id": "alias", "subject_id": "s9", "payload": event(refs=[ref("PO-99")])}])
    known = table(spark, "memory_subject_identifiers", [{"subject_id": "s9", "scheme": "external_reference", "normalized_value": v} for v in ("ek420", "po99")])
    queries = spark.createDataFrame([("q", "o", "s1", "p1", "Alpha", "Where is EK420?")], "query_id string, owner_id string, session_id string, project_id string, project_scope string, text string")
    found = ids.candidates(ids.query_references(queries), rows, ids.reference_rows(rows), known, NOW, 10)
    assert [r["memory_id"] for r in found.orderBy("rank").collect()] == ["explicit", "alias", "legacy"]


def test_jobs_are_claimed_once(spark):
    rows = [{"job_id": f"j{i}", "memory_id": f"m{i}", "target": "graph", "status": "pending", "attempts": 0, "updated_at": day(1) + timedelta(hours=i)} for i in range(4)]
    rows.append({"job_id": "stale", "memory_id": "m9", "target": "graph", "status": "running", "attempts": 1, "locked_at": day(1), "locked_by": "old", "updated_at": day(1)})
    queue = table(spark, "memory_projection_jobs", rows).select("job_id", "memory_id", "target", "status", "attempts", "error", "locked_at", "locked_by", "updated_at")
    first = jobs.claim(queue, NOW, 2, "w1")
    second = jobs.claim(keyed.upsert(queue, first, ["job_id"]), NOW, 9, "w2")
    assert not {r["job_id"] for r in first.collect()} & {r["job_id"] for r in second.collect()}
    assert {r["job_id"] for r in second.collect()} | {r["job_id"] for r in first.collect()} == {"j0", "j1", "j2", "j3", "stale"}
    results = first.select("job_id", F.lit("boom").alias("failure"))
    failed = jobs.finish(keyed.upsert(queue, first, ["job_id"]), results, F.lit("w1"), NOW)
    assert failed.where("status = 'failed'").count() == 2
    assert jobs.requeue_failed(failed, NOW).where("status = 'failed'").isEmpty()


def test_projects_titles_and_isolation(spark):
    requests = spark.createDataFrame([(1, "o", " Imports ", day(1)), (2, "o", "imports", day(2)), (3, "x", "imports", day(2)), (4, "o", "  ", day(3))],
                                     "request_id int, owner_id string, name string, requested_at timestamp")
    created, resolved = ss.resolve_projects(requests, table(spark, "projects", []))
    assert values(created, "owner_id", "name") == [("o", "Imports"), ("x", "imports")]
    ids_of = dict(values(resolved, "request_id", "project_id"))
    assert ids_of[1] == ids_of[2] != ids_of[3] and 4 not in ids_of
    chats = table(spark, "sessions", [{"session_id": "a", "owner_id": "o", "title": "New chat"}, {"session_id": "b", "owner_id": "o", "title": "Mine"}])
    titles = chats.select("session_id", "owner_id", F.lit(" A  plan ").alias("title"))
    assert values(ss.set_titles(chats, titles, NOW)[0], "session_id", "title") == [("a", "A plan"), ("b", "Mine")]
    assert ss.owned(chats, chats.withColumn("owner_id", F.lit("z")), "session_id").isEmpty()


def test_evidence_is_immutable(spark):
    stored = spark.createDataFrame([("e1", "h1")], "evidence_id string, content_hash string")
    incoming = spark.createDataFrame([("e1", "h2", 1), ("e2", "h3", 1), ("e2", "h3", 2)], "evidence_id string, content_hash string, binding_id int")
    kept, violations, requested = ev.upsert_evidence(stored, incoming)
    assert values(kept, "evidence_id", "content_hash") == [("e1", "h1"), ("e2", "h3")]
    assert values(violations, "evidence_id") == [("e1",)] and values(requested, "evidence_id", "binding_id") == [("e2", 1), ("e2", 2)]


def test_candidate_merge_takes_authority(spark):
    index = spark.createDataFrame([("q", "kept", 7, 1, 0.9), ("q", "rejected", 8, 2, 0.8), ("q", "kept", 9, 3, 0.7)],
                                  "query_id string, evidence_id string, binding_id long, rank int, score double")
    evidence = spark.createDataFrame([("kept", "a", "text", "text", "authority", "n", "u", 3), ("rejected", "b", "text", "text", "x", "n", "u", 1)],
                                     "evidence_id string, asset_id string, modality string, representation string, content string, source_name string, media_uri string, page int")
    bindings = spark.createDataFrame([(7, "a", "o", "session", "s", None), (8, "b", "other", "session", "s", None), (9, "a", "o", "project", None, "p")],
                                     "binding_id long, asset_id string, owner_id string, scope string, session_id string, project_id string")
    chats = spark.createDataFrame([("q", "o", "s", "p")], "query_id string, owner_id string, session_id string, project_id string")
    merged = ev.merge_candidates(index, ev.revalidate(index, evidence, bindings, chats))
    assert values(merged, "evidence_id", "binding_id", "content", "page") == [("kept", 7, "authority", 3)]


def test_events_that_name_their_subject(spark):
    row = lambda memory, subject, **more: {"memory_id": memory, "subject_id": subject, "payload": event(refs=[ref(more.pop("value", memory))]), **more}
    rows = records(spark, [row("new", "s-new"), row("same", "s1"), row("moved", "s2"), row("foreign", "s3"), row("session", "s4", scope="session"), row("taken", "s1", value="A-9")])
    place = rows.where("memory_id = 'same'").select(F.lit("x"), subjects.keys.subject_scope_key(F.col("scope"), F.col("session_id"), F.col("project_id"), F.col("project_scope")).alias("k")).first()["k"]
    known = spark.createDataFrame([("s1", "o", "project", place), ("s2", "o", "project", "project:old"), ("s3", "other", "project", place), ("s4", "o", "session", "session:old")],
                                  "subject_id string, owner_id string, scope string, scope_key string")
    held = spark.createDataFrame([("o", "project", place, "external_reference", "a9", "s9"), ("o", "project", place, "external_reference", "same", "s1"),
                                  ("o", "project", "project:old", "external_reference", "moved", "s2")],
                                 "owner_id string, scope string, scope_key string, scheme string, normalized_value string, subject_id string")
    out = subjects.bind_given(rows, known, held)
    assert values(out["bindings"], "memory_id") == [("moved",), ("new",), ("same",)]
    assert values(out["moved"], "subject_id", "scope_key") == [("s2", place)]
    assert values(out["rejects"], "memory_id", "reason") == [("foreign", "memory subject belongs to another visibility scope"),
                                                           ("session", "memory subject belongs to another visibility scope"),
                                                           ("taken", "event identifier already belongs to another subject")]
    assert values(subjects.move_places(held, out["moved"]).where("subject_id = 's2'"), "scope_key") == [(place,)]
