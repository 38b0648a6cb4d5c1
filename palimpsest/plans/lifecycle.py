"""Memory lifecycle queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import keys, payload as pl, scope as sc
from palimpsest.operators import extraction, identifiers as ids, keyed, lifecycle as lc, subjects
from palimpsest.plans import sqlparts as S
from palimpsest.plans.fixtures import NOW
from palimpsest.plans.records import with_history
from palimpsest.plans.registry import query
from palimpsest.plans.relational import NOW_SQL

c = F.col
LIVE = "status IN ('candidate', 'active')"


def ts(column):
    return F.coalesce(F.date_format(column, "yyyy-MM-dd HH:mm:ss"), F.lit(""))


def snapshot(t):
    return with_history(t.records)


def events_split(t):
    """Live events of the first half of the month, and all later events as arrivals."""
    late = c("created_at") >= "2024-01-15"
    events = t.records.where(c("kind") == "event")
    return events.where(~late), events.where(late)


CAPTURE = f"""e AS (SELECT *, created_at >= TIMESTAMP '2024-01-15' AS late, {S.identity()} AS ik, {S.domain()} AS dom, {S.event_ids()} AS idl, {S.claims()} AS cl FROM fx_memories WHERE kind = 'event'),
    a AS (SELECT * FROM e WHERE late OR {LIVE}),
    o AS (SELECT ik, min(struct_pack(l := late, t := created_at, m := memory_id)) AS org FROM a GROUP BY ik),
    k AS (SELECT a.*, o.org, struct_pack(l := late, t := created_at, m := a.memory_id) AS pos FROM a JOIN o USING (ik)),
    alive AS (SELECT * FROM k WHERE NOT late OR pos = org),
    h AS (SELECT dom, i, min(pos) AS hold FROM (SELECT dom, pos, unnest(idl) AS i FROM alive) GROUP BY dom, i),
    f AS (SELECT x.memory_id, min(h.hold) AS hold FROM (SELECT memory_id, dom, pos, unnest(idl) AS i FROM alive WHERE late) x JOIN h ON h.dom = x.dom AND h.i = x.i WHERE h.hold < x.pos GROUP BY 1),
    r AS (SELECT k.memory_id, k.pos <> k.org AS dup, k.org.m AS original, f.hold.m AS other, k.cl, z.cl AS ocl FROM k LEFT JOIN f ON f.memory_id = k.memory_id LEFT JOIN k z ON z.memory_id = f.hold.m WHERE k.late),
    cap AS (SELECT memory_id, CASE WHEN dup THEN 'duplicate' WHEN other IS NOT NULL AND {S.differences('ocl', 'cl')} <> '' THEN 'conflict' ELSE 'created' END AS outcome,
      coalesce(CASE WHEN dup THEN original WHEN other IS NOT NULL AND {S.differences('ocl', 'cl')} <> '' THEN other END, '') AS existing,
      coalesce(CASE WHEN NOT dup AND other IS NOT NULL THEN {S.differences('ocl', 'cl')} END, '') AS changed FROM r)"""


@query("lif1_capture_events", f"WITH {CAPTURE} SELECT * FROM cap")
def _(t):
    out = lc.capture_events(*events_split(t))
    return out.select("memory_id", "outcome", F.coalesce("existing_memory_id", F.lit("")).alias("existing"), F.coalesce("changed_claims", F.lit("")).alias("changed"))


@query("lif1_captured_records", f"""WITH {CAPTURE} SELECT m.memory_id, CASE WHEN outcome = 'conflict' THEN 'candidate' ELSE m.status END AS status,
    outcome <> 'conflict' AND m.user_confirmed AS confirmed FROM cap JOIN fx_memories m USING (memory_id) WHERE outcome <> 'duplicate'""")
def _(t):
    old, new = events_split(t)
    out = lc.captured_records(new, lc.capture_events(old, new))
    return out.select("memory_id", "status", c("user_confirmed").alias("confirmed"))


@query("lif1_conflicts", f"WITH {CAPTURE} SELECT memory_id AS incoming_memory_id, existing AS existing_memory_id, 'claim_mismatch' AS conflict_type, 'open' AS status, changed FROM cap WHERE outcome = 'conflict'")
def _(t):
    old, new = events_split(t)
    out = lc.capture_writes(new, lc.capture_events(old, new), NOW)["conflicts"]
    return out.select("incoming_memory_id", "existing_memory_id", "conflict_type", "status", F.get_json_object("details", "$.changed_claims").alias("changed"))


@query("lif1_audit", f"""WITH {CAPTURE}, m AS (SELECT cap.*, owner_id, source_turn_id FROM cap JOIN fx_memories USING (memory_id)), rows AS (
      SELECT existing AS memory_id, 'duplicate_detected' AS event_type, owner_id AS actor_id, source_turn_id AS told FROM m WHERE outcome = 'duplicate'
      UNION ALL SELECT memory_id, CASE WHEN outcome = 'conflict' THEN 'conflict_candidate_created' ELSE 'captured' END, owner_id, '' FROM m WHERE outcome <> 'duplicate'
      UNION ALL SELECT existing, 'conflict_detected', owner_id, memory_id FROM m WHERE outcome = 'conflict') SELECT memory_id, event_type, actor_id, told FROM rows""")
def _(t):
    old, new = events_split(t)
    out = lc.capture_writes(new, lc.capture_events(old, new), NOW)["audit"]
    field = lambda name: F.get_json_object("details", f"$.{name}")
    return out.select("memory_id", "event_type", "actor_id", F.coalesce(field("source_turn_id"), field("incoming_memory_id"), F.lit("")).alias("told"))


@query("lif1_jobs", f"WITH {CAPTURE} SELECT memory_id, unnest(['vector', 'graph']) AS target FROM cap WHERE outcome <> 'duplicate'")
def _(t):
    old, new = events_split(t)
    return lc.capture_writes(new, lc.capture_events(old, new), NOW)["jobs"].select("memory_id", "target")


@query("lif7_resolve_captured", f"""WITH {CAPTURE}, x AS (SELECT cap.memory_id, existing, a.owner_id = b.owner_id AS same, a.event_id % 2 = 0 AS keep FROM cap JOIN fx_memories a ON a.memory_id = cap.memory_id JOIN fx_memories b ON b.memory_id = cap.existing WHERE outcome = 'conflict')
    SELECT memory_id AS incoming_memory_id, CASE WHEN keep THEN 'keep_existing' ELSE 'supersede_existing' END AS action FROM x WHERE same""")
def _(t):
    """The conflicts that capture opened, resolved by their owners."""
    old, new = events_split(t)
    writes = lc.capture_writes(new, lc.capture_events(old, new), NOW)
    action = F.when(c("event_id") % 2 == 0, "keep_existing").otherwise("supersede_existing")
    commands = writes["conflicts"].join(t.memories.select(c("memory_id").alias("incoming_memory_id"), "owner_id", "event_id"), "incoming_memory_id").select(
        "conflict_id", action.alias("action"), c("owner_id").alias("actor_id"))
    after = keyed.upsert_memories(snapshot(t), writes["records"].select(*[n for n in snapshot(t).columns if n in writes["records"].columns]))
    closed = lc.resolve_conflicts(after, writes["conflicts"], commands, NOW)["conflicts"]
    return closed.join(writes["conflicts"].select("conflict_id", "incoming_memory_id"), "conflict_id").select("incoming_memory_id", "action")


OUTCOMES = ["new", "duplicate", "update", "related", "uncertain", "merge"]


def reconciliations(t):
    """A supplied outcome for every event; the existing memory is the next one in line."""
    events = snapshot(t).where(c("kind") == "event")
    outcome = F.array(*[F.lit(o) for o in OUTCOMES])[(c("event_id") % 6).cast("int")]
    other = t.relationships.select(c("from_memory_id").alias("memory_id"), c("to_memory_id").alias("existing_memory_id"))
    return events.join(other, "memory_id", "left").withColumn("outcome", outcome)


REC = f"""rec AS (SELECT m.*, r.to_memory_id AS existing, (['new','duplicate','update','related','uncertain','merge'])[CAST(m.event_id % 6 AS INT) + 1] AS outcome FROM fx_memories m
      LEFT JOIN fx_relationships r ON r.from_memory_id = m.memory_id WHERE m.kind = 'event'),
    prior AS (SELECT incoming_memory_id, existing_memory_id, max(conflict_id) AS cid FROM fx_conflicts GROUP BY 1, 2),
    j AS (SELECT rec.*, x.owner_id AS xo, p.cid, CASE WHEN outcome = 'merge' THEN 'unknown outcome' WHEN outcome IN ('duplicate','update','related') AND existing IS NULL THEN 'no existing memory given'
      WHEN existing IS NOT NULL AND x.owner_id IS NULL THEN 'existing memory not found' WHEN x.owner_id <> rec.owner_id THEN 'existing memory of another owner' ELSE '' END AS reason
      FROM rec LEFT JOIN fx_memories x ON x.memory_id = rec.existing LEFT JOIN prior p ON p.incoming_memory_id = rec.memory_id AND p.existing_memory_id = rec.existing)"""


@query("lif2_apply_reconciliation", f"""WITH {REC} SELECT memory_id, 'reject' AS what, reason AS detail FROM j WHERE reason <> ''
    UNION ALL SELECT memory_id, 'result', CASE outcome WHEN 'duplicate' THEN 'duplicate' WHEN 'update' THEN 'conflict' WHEN 'uncertain' THEN 'uncertain' ELSE 'created' END FROM j WHERE reason = ''
    UNION ALL SELECT memory_id, 'record', CASE WHEN outcome IN ('update', 'uncertain') THEN 'candidate' ELSE status END FROM j WHERE reason = '' AND outcome <> 'duplicate' AND NOT (outcome = 'update' AND cid IS NOT NULL)
    UNION ALL SELECT memory_id, 'conflict', existing FROM j WHERE reason = '' AND outcome = 'update' AND cid IS NULL
    UNION ALL SELECT memory_id, 'link', existing FROM j WHERE reason = '' AND outcome = 'related'""")
def _(t):
    out = lc.apply_reconciliation(snapshot(t), reconciliations(t), t.conflicts)
    row = lambda df, what, detail, key="memory_id": df.select(c(key).alias("memory_id"), F.lit(what).alias("what"), c(detail).alias("detail"))
    return (row(out["rejects"], "reject", "reason").unionByName(row(out["results"], "result", "result"))
            .unionByName(row(out["records"], "record", "status"))
            .unionByName(row(out["conflicts"], "conflict", "existing_memory_id", "incoming_memory_id"))
            .unionByName(row(out["links"], "link", "to_memory_id", "from_memory_id")))


@query("lif3_propose_claim_change", f"""WITH p AS (SELECT m.memory_id, m.owner_id, m.source_turn_id, m.scope, m.session_id, m.project_id, m.project_scope, r.to_memory_id AS target, {S.claims('m.')} AS cl,
      CASE WHEN m.event_id % 17 = 0 THEN 'someone' ELSE m.owner_id END AS chat_owner FROM fx_memories m JOIN fx_relationships r ON r.from_memory_id = m.memory_id WHERE m.kind = 'event'),
    j AS (SELECT p.*, CASE WHEN p.owner_id <> p.chat_owner THEN 'owner does not match the request' WHEN x.memory_id IS NULL OR x.owner_id <> p.owner_id THEN 'target not found' WHEN x.kind <> 'event' THEN 'target is not an event'
      WHEN NOT ({S.visible('x', 'p')} AND {S.current('x.')}) OR NOT coalesce({S.visible('x', 'p')}, false) THEN 'target is not visible' ELSE '' END AS reason, {S.claims('x.')} AS xcl FROM p LEFT JOIN fx_memories x ON x.memory_id = p.target)
    SELECT target, CASE WHEN reason <> '' THEN memory_id ELSE {S.uuid5("concat('memory:propose_event_claim_change:', source_turn_id, ':', target)")} END AS id,
      CASE WHEN reason <> '' THEN reason WHEN {S.differences('xcl', 'cl')} <> '' THEN 'update' ELSE 'duplicate' END AS outcome FROM j""")
def _(t):
    events = snapshot(t).where(c("kind") == "event").join(
        t.relationships.select(c("from_memory_id").alias("memory_id"), c("to_memory_id").alias("target_memory_id")), "memory_id")
    asked = events.withColumn("chat_owner", F.when(c("event_id") % 17 == 0, "someone").otherwise(c("owner_id")))
    ready, rejects = lc.propose_claim_changes(snapshot(t), asked, NOW)
    targets = asked.select("memory_id", c("target_memory_id").alias("target"))
    return ready.select(c("target_memory_id").alias("target"), c("memory_id").alias("id"), "outcome").unionByName(
        rejects.join(targets, "memory_id").select("target", c("memory_id").alias("id"), c("reason").alias("outcome")))


@query("lif4_decision_cascade", """SELECT memory_id, CASE WHEN k % 5 = 0 AND k % 2 = 0 THEN 'update' WHEN k % 3 = 0 THEN 'new' WHEN k % 7 = 0 THEN 'update' WHEN k % 4 < 2 THEN 'related' ELSE 'uncertain' END AS outcome,
    coalesce(CASE WHEN k % 5 = 0 AND k % 2 = 0 THEN 'target' WHEN k % 3 = 0 THEN NULL WHEN k % 7 = 0 THEN 'assoc' WHEN k % 4 < 2 THEN 'given' END, '') AS existing FROM fx_memories""")
def _(t):
    k = c("k")
    cases = t.memories.select(
        "memory_id", F.when(k % 5 == 0, "target").alias("update_target_id"), (k % 2 == 0).alias("target_changes"),
        F.when(k % 3 == 0, 0).otherwise(2).alias("candidate_count"), F.when(k % 7 == 0, "assoc").alias("associated_id"),
        F.lit(True).alias("association_changes"), F.lit(0.95).alias("association_confidence"),
        F.when(k % 4 < 3, "related").alias("supplied_outcome"), F.lit("given").alias("supplied_id"), F.lit(0.8).alias("supplied_confidence"),
        F.when(k % 4 == 2, "bad").alias("supplied_problem"))
    return lc.decide(cases).select("memory_id", "outcome", F.coalesce("existing_memory_id", F.lit("")).alias("existing"))


@query("lif5_decision_validation", """WITH d AS (SELECT memory_id, (['new','duplicate','update','related','uncertain'])[CAST(event_id % 5 AS INT) + 1] AS outcome, CASE WHEN k % 4 <> 0 THEN concat('c', k % 4) END AS e, k % 3 AS n, CASE WHEN k % 2 = 0 THEN 0.95 ELSE 0.7 END AS conf FROM fx_memories),
    j AS (SELECT *, CASE e WHEN 'c1' THEN 'exact_identifier' WHEN 'c2' THEN 'injected_context' END AS src FROM d)
    SELECT memory_id, CASE WHEN outcome IN ('duplicate','update','related') AND src IS NULL THEN 'must select a supplied candidate' WHEN outcome IN ('new','uncertain') AND e IS NOT NULL THEN 'cannot select an existing memory'
      WHEN outcome = 'update' AND n = 0 THEN 'an update must describe changed claims' WHEN src = 'injected_context' AND conf < 0.9 THEN 'implicit context needs high confidence' ELSE '' END AS problem FROM j""")
def _(t):
    outcome = F.array(*[F.lit(o) for o in OUTCOMES[:5]])[(c("event_id") % 5).cast("int")]
    d = t.memories.select("memory_id", outcome.alias("outcome"), F.when(c("k") % 4 != 0, F.concat(F.lit("c"), c("k") % 4)).alias("existing_memory_id"),
                          (c("k") % 3).alias("changed_count"), F.when(c("k") % 2 == 0, 0.95).otherwise(0.7).alias("confidence"))
    offered = F.explode(F.array(F.struct(F.lit("c1").alias("id"), F.lit("exact_identifier").alias("src")), F.struct(F.lit("c2").alias("id"), F.lit("injected_context").alias("src"))))
    candidates = t.memories.select("memory_id", offered.alias("x")).select("memory_id", c("x.id").alias("candidate_id"), c("x.src").alias("candidate_source"))
    return lc.validate_decisions(d, candidates).select("memory_id", F.coalesce("problem", F.lit("")).alias("problem"))


@query("lif6_link", """WITH i AS (SELECT DISTINCT CASE WHEN relationship_type = 'related' THEN least(from_memory_id, to_memory_id) ELSE from_memory_id END AS f, CASE WHEN relationship_type = 'related' THEN greatest(from_memory_id, to_memory_id) ELSE to_memory_id END AS t,
      relationship_type FROM fx_relationships) SELECT f AS from_memory_id, t AS to_memory_id, relationship_type FROM i WHERE NOT EXISTS (SELECT 1 FROM fx_relationships r WHERE r.relationship_id % 2 = 0 AND r.from_memory_id = f AND r.to_memory_id = t AND r.relationship_type = i.relationship_type)""")
def _(t):
    return lc.link(t.relationships.where(c("relationship_id") % 2 == 0), t.relationships)


ACTIONS = "(['supersede_existing','keep_existing','expire_existing','drop'])[CAST(conflict_id % 4 AS INT) + 1]"


def resolutions(t):
    action = F.array(*[F.lit(a) for a in ["supersede_existing", "keep_existing", "expire_existing", "drop"]])[(c("conflict_id") % 4).cast("int")]
    own = t.memories.select(c("memory_id").alias("incoming_memory_id"), c("owner_id").alias("actor_id"))
    return lists_pairs(t), action, own


def lists_pairs(t):
    """Conflicts between neighbouring memories of one owner."""
    near = t.relationships.join(t.memories.select(c("memory_id").alias("from_memory_id"), c("owner_id").alias("a")), "from_memory_id").join(
        t.memories.select(c("memory_id").alias("to_memory_id"), c("owner_id").alias("b")), "to_memory_id")
    return near.select(c("relationship_id").alias("conflict_id"), c("from_memory_id").alias("incoming_memory_id"), c("to_memory_id").alias("existing_memory_id"),
                       F.when(c("relationship_id") % 5 == 0, "resolved").otherwise("open").alias("status"))


RES = f"""cf AS (SELECT relationship_id AS conflict_id, from_memory_id AS inc, to_memory_id AS ex, CASE WHEN relationship_id % 5 = 0 THEN 'resolved' ELSE 'open' END AS st FROM fx_relationships),
    op AS (SELECT cf.*, {ACTIONS} AS action, a.owner_id AS actor FROM cf JOIN fx_memories a ON a.memory_id = inc JOIN fx_memories b ON b.memory_id = ex AND b.owner_id = a.owner_id WHERE st = 'open' AND {ACTIONS} <> 'drop'),
    ch AS (SELECT conflict_id, inc AS memory_id, CASE action WHEN 'keep_existing' THEN 'rejected' ELSE 'active' END AS ns, CASE action WHEN 'keep_existing' THEN 'conflict_rejected' ELSE 'conflict_accepted' END AS ev, NULL AS sb, 1 AS o FROM op
      UNION ALL SELECT conflict_id, ex, CASE action WHEN 'supersede_existing' THEN 'superseded' ELSE 'expired' END, CASE action WHEN 'supersede_existing' THEN 'superseded' ELSE 'expired' END, CASE action WHEN 'supersede_existing' THEN inc END, 2 FROM op WHERE action <> 'keep_existing')"""


@query("lif7_resolve_conflicts", f"""WITH {RES} SELECT memory_id AS id, 'record' AS what, ns AS detail FROM (SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY conflict_id DESC) = 1)
    UNION ALL SELECT memory_id, 'audit', ev FROM ch UNION ALL SELECT inc, 'audit', 'replacement_linked' FROM op WHERE action = 'supersede_existing' UNION ALL SELECT ex, 'lineage', inc FROM op WHERE action = 'supersede_existing'
    UNION ALL SELECT CAST(conflict_id AS STRING), 'closed', action FROM op UNION ALL SELECT CAST(conflict_id AS STRING), 'reject', '' FROM cf WHERE EXISTS (SELECT 1 FROM fx_memories m WHERE m.memory_id = inc) AND EXISTS (SELECT 1 FROM fx_memories m WHERE m.memory_id = ex) AND conflict_id NOT IN (SELECT conflict_id FROM op)""")
def _(t):
    conflicts, action, own = resolutions(t)
    commands = conflicts.join(own, "incoming_memory_id").select("conflict_id", action.alias("action"), "actor_id")
    out = lc.resolve_conflicts(snapshot(t), conflicts, commands, NOW)
    row = lambda df, what, key, detail: df.select(c(key).cast("string").alias("id"), F.lit(what).alias("what"), detail.alias("detail"))
    return (row(out["records"], "record", "memory_id", c("status")).unionByName(row(out["audit"], "audit", "memory_id", c("event_type")))
            .unionByName(row(out["relationships"], "lineage", "from_memory_id", c("to_memory_id")))
            .unionByName(row(out["conflicts"], "closed", "conflict_id", c("action"))).unionByName(row(out["rejects"], "reject", "conflict_id", F.lit(""))))


OWN = "fx_commands k JOIN fx_memories m ON m.memory_id = k.memory_id AND m.owner_id = k.actor_id"
MISSING = "SELECT k.memory_id, 'not found' AS outcome FROM fx_commands k JOIN fx_memories m ON m.memory_id = k.memory_id AND m.owner_id <> k.actor_id"


@query("lif8_transition", f"SELECT k.memory_id, CASE WHEN k.event_id % 2 = 0 THEN 'expired' ELSE 'superseded' END AS outcome FROM {OWN} UNION ALL {MISSING}")
def _(t):
    commands = t.commands.select("memory_id", "actor_id", F.when(c("event_id") % 2 == 0, "expired").otherwise("superseded").alias("new_status"),
                                 F.when(c("event_id") % 2 == 1, "other").alias("new_superseded_by"))
    out = lc.transition(snapshot(t), commands, NOW)
    return out.records.select("memory_id", c("status").alias("outcome")).unionByName(out.rejects.select("memory_id", c("reason").alias("outcome")))


@query("lif9_review", f"""SELECT k.memory_id, CASE WHEN m.status NOT IN ('candidate','active') THEN concat('cannot review ', m.status) WHEN k.action = 'archive' THEN 'unsupported action'
    ELSE CASE k.action WHEN 'confirm' THEN 'active' WHEN 'reject' THEN 'rejected' ELSE 'expired' END END AS outcome,
    coalesce(CASE WHEN m.status IN ('candidate','active') AND k.action <> 'archive' THEN {S.ts(f"CASE WHEN k.action = 'expire' THEN {NOW_SQL} ELSE m.valid_to END")} END, '') AS valid_to FROM {OWN}
    UNION ALL SELECT *, '' FROM ({MISSING})""")
def _(t):
    out = lc.review(snapshot(t), t.commands.select("memory_id", "actor_id", "action"), NOW)
    return out.records.select("memory_id", c("status").alias("outcome"), ts("valid_to").alias("valid_to")).unionByName(
        out.rejects.select("memory_id", c("reason").alias("outcome"), F.lit("").alias("valid_to")))


@query("lif10_forget", f"SELECT k.memory_id, 'deleted' AS outcome FROM {OWN} WHERE m.status <> 'deleted' UNION ALL {MISSING}")
def _(t):
    out = lc.forget(snapshot(t), t.commands.select("memory_id", "actor_id"), NOW)
    return out.records.select("memory_id", c("status").alias("outcome")).unionByName(out.rejects.select("memory_id", c("reason").alias("outcome")))


@query("lif11_promote", f"""SELECT k.memory_id, CASE WHEN k.event_id % 5 = 0 THEN 'project name required' WHEN m.status NOT IN ('candidate','active') THEN concat('cannot promote ', m.status) ELSE 'project:Shared' END AS outcome FROM {OWN} UNION ALL {MISSING}""")
def _(t):
    commands = t.commands.select("memory_id", "actor_id", F.when(c("event_id") % 5 != 0, "Shared").alias("to_project"), F.lit("p1").alias("to_project_id"))
    out = lc.promote(snapshot(t), commands, NOW)
    return out.records.select("memory_id", F.concat_ws(":", "scope", "project_scope").alias("outcome")).unionByName(
        out.rejects.select("memory_id", c("reason").alias("outcome")))


@query("lif12_edit", f"""WITH o AS (SELECT m.memory_id, {S.uuid5(f"concat('edit:', m.memory_id, ':{NOW}')")} AS rid FROM {OWN} WHERE m.status IN ('candidate','active'))
    SELECT memory_id AS id, 'superseded' AS status, rid AS other FROM o UNION ALL SELECT o.rid, m.status, '' FROM o JOIN fx_memories m USING (memory_id) UNION ALL SELECT concat('edge ', memory_id), 'superseded_by', rid FROM o
    UNION ALL SELECT k.memory_id, concat('cannot edit ', m.status), '' FROM {OWN} WHERE m.status NOT IN ('candidate','active') UNION ALL SELECT memory_id, outcome, '' FROM ({MISSING})""")
def _(t):
    records = snapshot(t)
    commands = t.commands.join(records.select("memory_id", c("payload").alias("new_payload")), "memory_id").select("memory_id", "actor_id", "new_payload")
    changes, lineage = lc.edit(records, commands, NOW)
    none = F.lit("").alias("other")
    return (changes.records.select(c("memory_id").alias("id"), "status", F.coalesce("superseded_by", F.lit("")).alias("other"))
            .unionByName(lineage.select(F.concat(F.lit("edge "), "from_memory_id").alias("id"), c("relationship_type").alias("status"), c("to_memory_id").alias("other")))
            .unionByName(changes.rejects.select(c("memory_id").alias("id"), c("reason").alias("status"), none)))


@query("lif13_supersede", f"""WITH j AS (SELECT k.memory_id, r.to_memory_id AS rid, x.owner_id = m.owner_id AS same FROM {OWN} JOIN fx_relationships r ON r.from_memory_id = k.memory_id LEFT JOIN fx_memories x ON x.memory_id = r.to_memory_id)
    SELECT memory_id, CASE WHEN memory_id = rid THEN 'a memory cannot supersede itself' WHEN NOT coalesce(same, false) THEN 'replacement not found' ELSE rid END AS outcome FROM j
    UNION ALL SELECT x.* FROM ({MISSING}) x JOIN fx_relationships r ON r.from_memory_id = x.memory_id""")
def _(t):
    commands = t.commands.join(t.relationships.select(c("from_memory_id").alias("memory_id"), c("to_memory_id").alias("replacement_id")), "memory_id").select("memory_id", "actor_id", "replacement_id")
    changes, _lineage = lc.supersede(snapshot(t), commands, NOW)
    return changes.records.select("memory_id", c("superseded_by").alias("outcome")).unionByName(changes.rejects.select("memory_id", c("reason").alias("outcome")))


@query("lif14_expire_due", f"SELECT memory_id, 'expired' AS status, 'expired_by_sweep' AS event_type, unnest(['vector', 'graph']) AS target FROM fx_memories WHERE status = 'active' AND valid_to <= {NOW_SQL}")
def _(t):
    swept = lc.expire_due(snapshot(t), NOW)
    work = keyed.job_rows(swept.records, sc.at(NOW))
    return swept.records.select("memory_id", "status").join(swept.audit.select("memory_id", "event_type"), "memory_id").join(work.select("memory_id", "target"), "memory_id")


@query("lif15_bind_subject", f"""WITH r AS (SELECT memory_id, owner_id, scope, {S.scope_key()} AS sk, unnest(ev_refs) AS x FROM fx_memories WHERE kind = 'event'),
    n AS (SELECT r.memory_id, count(DISTINCT s.subject_id) AS n, min(s.subject_id) AS s FROM r LEFT JOIN fx_subject_identifiers s ON s.owner_id = r.owner_id AND s.scope = r.scope AND s.scope_key = r.sk AND s.scheme = r.x.scheme AND s.normalized_value = r.x.normalized_value GROUP BY 1)
    SELECT memory_id, CASE WHEN n = 0 THEN {S.uuid5("concat('subject:', memory_id)")} WHEN n = 1 THEN s ELSE '' END AS subject_id FROM n""")
def _(t):
    return subjects.bind_once(t.records, t.subject_identifiers).select("memory_id", F.coalesce("subject_id", F.lit("")).alias("subject_id"))


def given_subjects(t):
    """Events that name their subject: their own, one of another place of their owner, or one that nobody knows yet."""
    others = t.subject_identifiers.groupBy("owner_id", "scope").agg(F.min("subject_id").alias("other"))
    own = t.records.where(c("kind") == "event").join(t.memory_subjects, "memory_id", "left").join(others, ["owner_id", "scope"], "left")
    e = c("event_id")
    return own.withColumn("subject_id", F.when(e % 10 == 0, F.concat(F.lit("fresh-"), e)).when(e % 7 == 0, c("other")).otherwise(c("subject_id")))


@query("lif15_given_subjects", f"""WITH o AS (SELECT owner_id, scope, min(subject_id) AS other FROM fx_subject_identifiers GROUP BY 1, 2),
    e AS (SELECT m.memory_id, m.created_at, m.owner_id, m.scope, {S.scope_key('m.')} AS sk, m.ev_refs, CASE WHEN m.event_id % 10 = 0 THEN concat('fresh-', m.event_id) WHEN m.event_id % 7 = 0 THEN o.other ELSE s.subject_id END AS subject_id
      FROM fx_memories m LEFT JOIN fx_memory_subjects s USING (memory_id) LEFT JOIN o ON o.owner_id = m.owner_id AND o.scope = m.scope WHERE m.kind = 'event'),
    k AS (SELECT DISTINCT subject_id, owner_id, scope, scope_key FROM fx_subject_identifiers),
    h AS (SELECT DISTINCT x.memory_id FROM (SELECT *, unnest(ev_refs) AS r FROM e WHERE subject_id IS NOT NULL) x JOIN fx_subject_identifiers i ON i.owner_id = x.owner_id AND i.scope = x.scope AND i.scope_key = x.sk
      AND i.scheme = x.r.scheme AND i.normalized_value = x.r.normalized_value AND i.subject_id <> x.subject_id),
    d AS (SELECT e.*, k.subject_id IS NOT NULL AND k.owner_id = e.owner_id AND k.scope = e.scope AS home, k.subject_id IS NOT NULL AS known, k.scope_key <> e.sk AS away, h.memory_id IS NOT NULL AS taken
      FROM e LEFT JOIN k USING (subject_id) LEFT JOIN h ON h.memory_id = e.memory_id WHERE e.subject_id IS NOT NULL),
    j AS (SELECT *, home AND away AND scope = 'project' AS moves, CASE WHEN known AND NOT (home AND away AND scope = 'project') AND (NOT home OR away) THEN 'memory subject belongs to another visibility scope'
      WHEN taken THEN 'event identifier already belongs to another subject' END AS reason FROM d)
    SELECT 'bound' AS what, memory_id AS id, subject_id AS value FROM j WHERE reason IS NULL UNION ALL SELECT 'rejected', memory_id, reason FROM j WHERE reason IS NOT NULL
    UNION ALL SELECT 'moved', subject_id, max_by(sk, struct_pack(a := created_at, b := memory_id)) FROM j WHERE reason IS NULL AND moves GROUP BY subject_id""")
def _(t):
    """Events with a given subject: bindings, rejects, and subjects that move to another place of their project."""
    known = t.subject_identifiers.select("subject_id", *subjects.PLACE).distinct()
    out = subjects.bind_given(given_subjects(t), known, t.subject_identifiers)
    row = lambda df, what, key, value: df.select(F.lit(what).alias("what"), c(key).alias("id"), c(value).alias("value"))
    return row(out["bindings"], "bound", "memory_id", "subject_id").unionByName(row(out["rejects"], "rejected", "memory_id", "reason")).unionByName(row(out["moved"], "moved", "subject_id", "scope_key"))


@query("lif16_replace_references", """SELECT memory_id, x.scheme AS scheme, CASE WHEN event_id % 2 = 0 THEN x.normalized_value ELSE concat('old-', x.normalized_value) END AS value FROM (SELECT memory_id, event_id, unnest(ev_refs) AS x FROM fx_memories WHERE kind = 'event')""")
def _(t):
    rows = ids.reference_rows(t.records)
    stale = rows.withColumn("normalized_value", F.concat(F.lit("old-"), "normalized_value"))
    out = ids.replace_references(stale, t.records.where(c("event_id") % 2 == 0))
    return out.select("memory_id", "scheme", c("normalized_value").alias("value"))


@query("lif17_capture_policy", f"""SELECT memory_id, CASE WHEN auto THEN 'project' ELSE 'session' END AS scope, CASE WHEN auto THEN 'active' ELSE 'candidate' END AS status,
    CASE WHEN np THEN 'no_project_scope' WHEN ev THEN 'high_confidence_user_stated_operational_event' WHEN pf THEN 'high_confidence_user_stated_project_preference' ELSE 'requires_review' END AS reason,
    coalesce(CASE WHEN ev THEN {S.ts('created_at + to_hours(CAST(216 AS INT))')} END, '') AS valid_to FROM (SELECT *, ev OR pf AS auto FROM (SELECT *, event_id % 7 = 0 AS np,
      event_id % 7 <> 0 AND kind = 'event' AND confidence >= 0.75 AS ev, event_id % 7 <> 0 AND kind = 'preference' AND k % 2 = 0 AND confidence >= 0.9 AS pf FROM fx_memories))""")
def _(t):
    candidates = t.memories.select("memory_id", "kind", "confidence", (c("k") % 2 == 0).alias("consent"), F.when(c("event_id") % 7 != 0, c("project_scope")).alias("project_scope"),
                                   F.lit("The carrier arrives in 2 days").alias("user_content"), c("ev_time").alias("temporal_scope"), c("created_at").alias("captured_at"))
    return lc.capture_policy(candidates).select("memory_id", "scope", "status", "reason", ts("valid_to").alias("valid_to"))


@query("lif18_claim_extractions", """WITH x AS (SELECT DISTINCT event_id % 997 AS g FROM events) SELECT concat('turn', g) AS source_turn_id FROM x WHERE g % 3 <> 0 OR g % 2 = 0""")
def _(t):
    known = t.events.select((c("event_id") % 997).alias("g")).distinct().where(c("g") % 3 == 0).select(
        F.concat(F.lit("turn"), "g").alias("source_turn_id"), F.lit("v1").alias("extraction_version"), F.when(c("g") % 2 == 0, "failed").otherwise("completed").alias("status"))
    asked = t.memories.select("source_turn_id", F.lit("v1").alias("extraction_version"))
    return lc.claim_extractions(known, asked).select("source_turn_id")


def in_turns(t):
    """Memories in turns of fifteen; every seventh turn has thirty, more than a batch may hold."""
    block = F.floor(c("event_id") / 15)
    return t.memories.withColumn("source_turn_id", F.concat(F.lit("turn"), F.when(block % 7 == 1, block - 1).otherwise(block)))


def supplied_candidates(memories):
    raw = F.when(c("kind") == "event", F.format_string('{"event_type":"%s","summary":"%s","identifier_refs":[{"value":"EV-%d"}],"event_claims":[{"attribute":"Status","value":"Open"}]}', "ev_type_raw", "ev_summary", c("k"))
                 ).when(c("kind") == "preference", F.format_string('{"phrase":"%s","consent":"yes","strength":"high"}', "pref_behavior")
                        ).when(c("kind") == "knowledge", F.format_string('{"subject":"%s","predicate":"","object":"x"}', "know_subject")
                               ).when(c("kind") == "entity", F.format_string('{"name":"%s","entity_type":"account"}', "ent_name")
                                      ).otherwise(F.format_string('{"problem_signature":"%s","steps":["a"]}', "sol_problem"))
    return memories.select("source_turn_id", c("event_id").alias("candidate_no"), "kind", "confidence", "evidence_refs", raw.alias("payload"))


def extraction_turns(memories):
    return memories.groupBy("source_turn_id").agg(F.min("owner_id").alias("owner_id"), F.min("session_id").alias("session_id"), F.min("project_id").alias("project_id"), F.min("project_scope").alias("project_scope"),
                                                    F.min("created_at").alias("captured_at")).withColumns({"user_content": F.lit("done in 2 days"), "turn_refs": F.array(F.lit("ev-1"))})


@query("lif19_extract", """WITH b AS (SELECT *, event_id // 15 AS block FROM fx_memories), m AS (SELECT * REPLACE (concat('turn', CASE WHEN block % 7 = 1 THEN block - 1 ELSE block END) AS source_turn_id) FROM b),
    n AS (SELECT *, row_number() OVER (PARTITION BY source_turn_id ORDER BY event_id) AS number, count(*) OVER (PARTITION BY source_turn_id) AS size FROM m)
    SELECT DISTINCT source_turn_id, 0 AS number, '' AS kind, 'refused' AS status FROM n WHERE size > 20 UNION ALL SELECT source_turn_id, number, kind, CASE WHEN kind = 'knowledge' THEN 'invalid' WHEN (kind = 'event' AND confidence >= 0.75) OR (kind = 'preference' AND confidence >= 0.9) THEN 'active' ELSE 'candidate' END AS status FROM n WHERE size <= 20""")
def _(t):
    memories = in_turns(t)
    nothing = t.memories.limit(0).select("source_turn_id", F.lit("v1").alias("extraction_version"), "status")
    out = extraction.extract(supplied_candidates(memories), extraction_turns(memories), nothing, "v1")
    numbers = extraction.numbered(supplied_candidates(memories)).select("source_turn_id", "kind", "number")
    keyed_numbers = numbers.withColumn("memory_id", keys.uuid5(F.concat_ws(":", F.lit("extracted"), "source_turn_id", "number")))
    records = out["events"].unionByName(out["records"]).select("memory_id", "status")
    good = keyed_numbers.join(records, "memory_id").select("source_turn_id", c("number").cast("long").alias("number"), "kind", "status")
    refused = out["refused"].select("source_turn_id", F.lit(0).cast("long").alias("number"), F.lit("").alias("kind"), F.lit("refused").alias("status"))
    return good.unionByName(out["invalid"].select("source_turn_id", c("number").cast("long").alias("number"), "kind", F.lit("invalid").alias("status"))).unionByName(refused)


@query("lif20_target_update", f"""SELECT a.memory_id, a.kind = 'event' AND len(list_intersect(list_transform(a.ev_claims, lambda c: trim(lower(c.attribute))), list_transform(b.ev_claims, lambda c: trim(lower(c.attribute))))) > 0
    AND {S.differences('b.cl', 'a.cl')} <> '' AS updates FROM (SELECT *, {S.claims()} AS cl FROM fx_memories WHERE kind = 'event') a JOIN fx_relationships r ON r.from_memory_id = a.memory_id JOIN (SELECT *, {S.claims()} AS cl FROM fx_memories WHERE kind = 'event') b ON b.memory_id = r.to_memory_id""")
def _(t):
    events = t.records.where(c("kind") == "event").select("memory_id", "kind", c("payload.event").alias("event"))
    other = events.select(c("memory_id").alias("to_memory_id"), c("event").alias("target"))
    pairs = t.relationships.join(events.withColumnRenamed("memory_id", "from_memory_id"), "from_memory_id").join(other, "to_memory_id")
    return pairs.select(c("from_memory_id").alias("memory_id"), pl.is_target_update(c("kind"), c("target"), c("event")).alias("updates"))


@query("lif21_merge_references", "SELECT memory_id, array_to_string(CASE WHEN concat('ref', k) = concat('ref', k % 3) THEN [concat('ref', k), 'ref1x'] ELSE [concat('ref', k), concat('ref', k % 3), 'ref1x'] END, '|') AS refs FROM fx_memories")
def _(t):
    merged = F.array_distinct(F.concat("evidence_refs", F.array(F.lit("ref1x"), c("evidence_refs")[0])))
    return t.memories.select("memory_id", F.array_join(merged, "|").alias("refs"))


BACKFILL = f"""WITH RECURSIVE e AS (SELECT memory_id, created_at, owner_id, scope, {S.scope_key()} AS sk, list_distinct(list_transform(ev_refs, lambda r: concat(r.scheme, ':', r.normalized_value))) AS ids
      FROM fx_memories WHERE kind = 'event' AND {LIVE} AND len(ev_refs) > 0),
    o AS (SELECT *, row_number() OVER (PARTITION BY owner_id, scope, sk ORDER BY created_at, memory_id) AS n FROM e),
    k AS (SELECT owner_id, scope, scope_key AS sk, map_from_entries(list(struct_pack(k := concat(scheme, ':', normalized_value), v := subject_id))) AS reg FROM fx_subject_identifiers GROUP BY 1, 2, 3),
    p AS (SELECT DISTINCT owner_id, scope, sk FROM o),
    r AS (SELECT p.owner_id, p.scope, p.sk, CAST(0 AS BIGINT) AS n, coalesce(k.reg, map_from_entries(CAST([] AS STRUCT(k VARCHAR, v VARCHAR)[]))) AS reg, '' AS memory_id, '' AS subject_id FROM p LEFT JOIN k ON k.owner_id = p.owner_id AND k.scope = p.scope AND k.sk = p.sk
      UNION ALL SELECT x.owner_id, x.scope, x.sk, x.n, CASE WHEN x.s = '' THEN x.reg ELSE map_concat(map_from_entries(list_transform(x.ids, lambda i: struct_pack(k := i, v := x.s))), x.reg) END, x.memory_id, x.s FROM (
        SELECT y.*, CASE len(y.found) WHEN 0 THEN {S.uuid5("concat('subject:', y.memory_id)")} WHEN 1 THEN y.found[1] ELSE '' END AS s FROM (
          SELECT o.owner_id, o.scope, o.sk, o.n, o.memory_id, o.ids, r.reg, list_distinct(list_filter(list_transform(o.ids, lambda i: r.reg[i]), lambda v: v IS NOT NULL)) AS found
          FROM r JOIN o ON o.owner_id = r.owner_id AND o.scope = r.scope AND o.sk = r.sk AND o.n = r.n + 1) y) x)
    SELECT memory_id, subject_id FROM r WHERE n > 0"""


@query("lif22_backfill_subjects", BACKFILL)
def _(t):
    """Arrival-order binding of all live events that have no subject yet."""
    live = subjects.unbound_live_events(snapshot(t))
    bound, _registered = subjects.bind_in_order(live, t.subject_identifiers)
    return bound.select("memory_id", F.coalesce("subject_id", F.lit("")).alias("subject_id"))
