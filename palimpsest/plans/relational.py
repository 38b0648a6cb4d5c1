"""Scans, keyed writes, filters, joins, aggregations, windows and sessions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from palimpsest import constants as C, schemas
from palimpsest.functions import keys, scope as sc, text as tx
from palimpsest.operators import (
    context, evidence as ev, graph, hybrid, identifiers as ids, jobs, keyed, lifecycle as lc, listings as lists, ordered, quality,
    routing, segments, sessions as ss, tables)
from palimpsest.plans import sqlparts as S
from palimpsest.plans.fixtures import NOW
from palimpsest.plans.registry import query
from palimpsest.session import shared_folder
from palimpsest.sources import readers
from palimpsest.sources.partitioned import KeyedTable
from palimpsest.streaming import outbox as ob

c = F.col
NOW_SQL = f"TIMESTAMP '{NOW}'"


def ts(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def text(column):
    return F.coalesce(c(column) if isinstance(column, str) else column, F.lit(""))


# --- scans ----------------------------------------------------------------------------

CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("src1_table_scan", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(t):
    declared = t.spark.read.schema(CUSTOMER).parquet(f"{t.folder}/customer.parquet")
    return declared.select("c_custkey", "c_name", "c_acctbal")


@query("src2_json_decode", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    return readers.decode_json(t.events, {"props": "struct<k:bigint>"}).select("event_id", "props.k")


EXT_SQL = "(['pdf','TXT','csv','exe','mp4','docx'])[CAST(doc_id % 6 AS INT) + 1]"


def uploads(t):
    ext = tx.lit_array(["pdf", "TXT", "csv", "exe", "mp4", "docx"])[(c("doc_id") % 6).cast("int")]
    return t.documents.select("doc_id", F.concat(F.lit("/in/doc"), "doc_id", F.lit("."), ext).alias("path"),
                              F.encode("text", "UTF-8").alias("content"))


@query("src3_file_ingest", f"""SELECT concat('/in/doc', doc_id, '.', e) AS path, CASE WHEN e IN ('TXT','exe') THEN '' ELSE sha256(text) END AS asset_id,
    lower(e) AS kind FROM (SELECT doc_id, text, {EXT_SQL} AS e FROM documents)""")
def _(t):
    assets, rejects = readers.identify_files(uploads(t))
    return assets.select("path", "asset_id", c("modality").alias("kind")).unionByName(
        rejects.select("path", F.lit("").alias("asset_id"), c("extension").alias("kind")))


@query("src3_file_arrival", """WITH g AS (SELECT doc_id // 16 AS g, concat(string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id), chr(10)) AS content FROM documents GROUP BY 1),
    a AS (SELECT sha256(content) AS asset_id, octet_length(encode(content)) AS bytes, count(*) AS files FROM g GROUP BY 1, 2)
    SELECT asset_id, CAST(bytes AS BIGINT) AS bytes FROM a""")
def _(t):
    """Files that arrive in two batches, half of them again under another name in the second; each content is one asset."""
    path = f"{shared_folder(t.spark)}/uploads-{uuid.uuid4().hex}"
    lines = t.documents.select(F.floor(c("doc_id") / 16).alias("file"), "doc_id", F.coalesce("text", F.lit("")).alias("value"))

    def put(rows, batch):
        dealt = rows.repartition("file").sortWithinPartitions("file", "doc_id").drop("doc_id")
        dealt.write.partitionBy("file").text(f"{path}/in/batch={batch}")

    put(lines.where(c("file") % 2 == 0), 0)
    put(lines, 1)
    # Spark names its text files .txt, an extension that uploads do not have
    files = readers.read_arrivals(t.spark, f"{path}/in", bytes_per_trigger=1 << 30).where(c("path").endswith(".txt"))
    named = files.withColumn("path", F.concat("path", F.lit(".pdf")))
    ob.run(readers.arriving_assets(named).select("asset_id", "length"), ob.into_folder(f"{path}/out"), f"{path}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{path}/out").select("asset_id", c("length").alias("bytes"))


@query("src4_delimited_rows", """SELECT c_custkey, c_name AS name, c_acctbal AS balance FROM customer WHERE c_custkey % 7 <> 0""")
def _(t):
    """Delimited files with a header and some rows without any value, written and read back."""
    blank = c("c_custkey") % 7 == 0
    path = f"{shared_folder(t.spark)}/delimited-{uuid.uuid4().hex}"
    t.customer.select(*[F.when(~blank, c(name)).alias(label) for name, label in (("c_custkey", "c_custkey"), ("c_name", "name"), ("c_acctbal", "balance"))]).write.option("header", True).csv(path)
    return readers.read_delimited(t.spark, path, "c_custkey bigint, name string, balance double")


def caption_files(t):
    """One caption file per conversation, one tagged cue per turn."""
    at = lambda half: F.format_string("%02d:%02d:%02d.%d00", F.lit(0), F.floor(c("turn") / 6).cast("int"),
                                      (c("turn") % 6 * 10).cast("int"), F.lit(half))
    cue = F.concat(at(0), F.lit(" --> "), at(5), F.lit("\n<v "), "role", F.lit(">"), "text", F.lit("\n\n"))
    cues = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", cue.alias("cue")))), lambda x: x["cue"]), "")
    return t.conversations.groupBy("conv_id").agg(F.concat(F.lit("WEBVTT\n\n"), cues).alias("value"))


CUES_SQL = f"""SELECT conv_id, turn, CAST(turn // 6 * 60 + turn % 6 * 10 AS DOUBLE) AS "start", turn // 6 * 60 + turn % 6 * 10 + 0.5 AS "end",
    array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')),
      lambda l: l <> ''), ' ') AS text FROM conversations"""


@query("src5_captions", f"""SELECT conv_id, CAST("start" AS DOUBLE) AS "start", CAST("end" AS DOUBLE) AS "end", text FROM ({CUES_SQL}) WHERE text <> ''""")
def _(t):
    return readers.parse_captions(caption_files(t), "conv_id").select("conv_id", "start", "end", "text")


@query("src6_latency_trace", """SELECT stage, pipeline, outcome, round(duration_ms, 3) AS duration_ms FROM fx_latency
    WHERE run_id = 'run7' OR trace_id = 't9'""")
def _(t):
    """The trace log as files of JSON lines, written and read back."""
    path = f"{shared_folder(t.spark)}/latency-{uuid.uuid4().hex}"
    keyed.log_lines(t.latency).write.text(path)
    return readers.trace(readers.read_latency(t.spark, path), "run7", "t9").select("stage", "pipeline", "outcome", "duration_ms")


@query("src7_conversation_cases", """SELECT concat('case', conv_id) AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn,
    role, length(text) AS chars FROM conversations""")
def _(t):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", c("text").alias("content"))))
    cases = t.conversations.groupBy("conv_id").agg(turns.alias("turns")).select(F.to_json(F.struct(
        F.concat(F.lit("case"), "conv_id").alias("id"), F.transform("turns", lambda x: x.dropFields("turn")).alias("turns"))).alias("value"))
    parsed = cases.select(F.from_json("value", schemas.schema("conversation_cases")).alias("j")).select("j.*")
    return readers.case_turns(parsed).select("id", c("turn").cast("long").alias("turn"), "role",
                                             F.length("content").cast("long").alias("chars"))


@query("src8_text_blocks", f"""SELECT doc_id, seq, item_type, s AS text FROM (SELECT *, regexp_replace(text, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS s
    FROM fx_layout_items) WHERE item_type <> 'PictureItem' AND s <> ''""")
def _(t):
    return readers.text_blocks(t.layout_items).select("doc_id", "seq", "item_type", "text")


@query("src9_parser_dispatch", f"""SELECT doc_id, CASE lower(e) WHEN 'pdf' THEN 'pdf' WHEN 'csv' THEN 'table' WHEN 'mp4' THEN 'video' WHEN 'docx' THEN 'docx'
    ELSE 'unsupported' END AS parser FROM (SELECT doc_id, {EXT_SQL} AS e FROM documents)""")
def _(t):
    files = uploads(t).select("doc_id", readers.extension(c("path")).alias("modality"))
    routed, nothing = readers.dispatch(files)
    return routed.select("doc_id", "parser").unionByName(nothing.select("doc_id", F.lit("unsupported").alias("parser")))


# --- keyed writes -----------------------------------------------------------------------

def memory_delta(t):
    """Changes to a third of the memories, and as many new ones."""
    changed = t.memories.where(c("event_id") % 3 == 0)
    new_id = F.when(c("event_id") % 2 == 0, c("memory_id")).otherwise(F.concat(F.lit("new-"), "memory_id"))
    return changed.withColumns({"memory_id": new_id, "status": F.lit("active"), "confidence": F.lit(1.0),
                                "kind": F.lit("event"), "valid_to": F.lit(None).cast("timestamp")})


UPSERTED = f"""WITH d AS (SELECT CASE WHEN event_id % 2 = 0 THEN memory_id ELSE concat('new-', memory_id) END AS memory_id
      FROM fx_memories WHERE event_id % 3 = 0)
    SELECT coalesce(m.memory_id, d.memory_id) AS memory_id, CASE WHEN d.memory_id IS NOT NULL THEN 'active' ELSE m.status END AS status,
      round(CASE WHEN d.memory_id IS NOT NULL THEN 1.0 ELSE m.confidence END, 6) AS confidence, coalesce(m.kind, 'event') AS kind,
      d.memory_id IS NULL AND m.valid_to IS NOT NULL AS bounded FROM fx_memories m FULL JOIN d ON d.memory_id = m.memory_id"""


@query("snk1_upsert_memories", UPSERTED)
def _(t):
    delta = memory_delta(t)
    # older rows for some of the same keys, which the newer ones override
    older = delta.where(c("event_id") % 9 == 0).withColumns({"status": F.lit("expired"), "confidence": F.lit(0.1), "updated_at": c("updated_at") - F.expr("INTERVAL 1 DAY")})
    out = keyed.upsert_memories(t.memories, older.unionByName(delta))
    return out.select("memory_id", "status", F.round("confidence", 6).alias("confidence"), "kind",
                      c("valid_to").isNotNull().alias("bounded"))


@query("snk1_partitioned_upsert", UPSERTED)
def _(t):
    """The same upsert into a snapshot dealt to folders by key; only the folders of the delta's keys are read and replaced."""
    table = KeyedTable(t.spark, f"{shared_folder(t.spark)}/memories-{uuid.uuid4().hex}", ["memory_id"])
    table.create(t.memories)
    table.apply(memory_delta(t), keyed.upsert_memories)
    return table.read().select("memory_id", "status", F.round("confidence", 6).alias("confidence"), "kind", c("valid_to").isNotNull().alias("bounded"))


@query("snk2_audit_and_jobs", """WITH d AS (SELECT CASE WHEN event_id % 2 = 0 THEN memory_id ELSE concat('new-', memory_id) END AS memory_id FROM fx_memories WHERE event_id % 3 = 0)
    SELECT memory_id, 'audit' AS out, 'updated' AS what FROM d UNION ALL SELECT memory_id, 'job', unnest(['vector', 'graph']) FROM d""")
def _(t):
    delta, now = memory_delta(t), sc.at(NOW)
    audit = keyed.audit_rows(delta, F.lit("updated"), c("owner_id"), F.lit("{}"), now)
    jobs = keyed.job_rows(delta, now)
    return audit.select("memory_id", F.lit("audit").alias("out"), c("event_type").alias("what")).unionByName(
        jobs.select("memory_id", F.lit("job").alias("out"), c("target").alias("what")))


def asset_uploads(t):
    """Uploads of every document; some reuse an asset id for other content."""
    spoil = F.when(c("binding_id") % 50 == 0, F.concat(F.lit("x"), "asset_id")).otherwise(c("asset_id"))
    return t.bindings.withColumn("content_hash", spoil)


@query("snk3_upsert_assets", """WITH known AS (SELECT asset_id FROM fx_assets WHERE first_doc % 2 = 0),
    up AS (SELECT *, CASE WHEN binding_id % 50 = 0 THEN concat('x', asset_id) ELSE asset_id END AS content_hash FROM fx_bindings),
    bad AS (SELECT asset_id FROM (SELECT asset_id, content_hash FROM up UNION ALL SELECT asset_id, asset_id FROM known) GROUP BY 1 HAVING count(DISTINCT content_hash) > 1)
    SELECT 'violation' AS what, asset_id AS id FROM bad
    UNION ALL SELECT DISTINCT 'asset', asset_id FROM up WHERE asset_id NOT IN (SELECT asset_id FROM known) AND asset_id NOT IN (SELECT asset_id FROM bad)
    UNION ALL SELECT 'binding', CAST(min(binding_id) AS STRING) FROM up u WHERE NOT EXISTS (SELECT 1 FROM fx_bindings b WHERE b.binding_id % 3 = 0
        AND b.asset_id = u.asset_id AND b.owner_id = u.owner_id AND b.scope = u.scope AND b.session_id IS NOT DISTINCT FROM u.session_id AND b.project_id IS NOT DISTINCT FROM u.project_id)
      GROUP BY asset_id, owner_id, scope, session_id, project_id""")
def _(t):
    known = t.assets.where(c("first_doc") % 2 == 0).select("asset_id", c("asset_id").alias("content_hash"))
    up = asset_uploads(t)
    out = ev.asset_violations(known, up).select(F.lit("violation").alias("what"), c("asset_id").alias("id"))
    out = out.unionByName(ev.new_assets(known, up).select(F.lit("asset").alias("what"), c("asset_id").alias("id")))
    fresh = ev.new_bindings(t.bindings.where(c("binding_id") % 3 == 0), up)
    return out.unionByName(fresh.select(F.lit("binding").alias("what"), c("binding_id").cast("string").alias("id")))


def hashed_evidence(t):
    return quality.with_evidence_hash(t.evidence)


@query("snk4_upsert_evidence", """WITH inc AS (SELECT e.evidence_id, b.binding_id, e.first_doc FROM fx_evidence e JOIN fx_bindings b USING (asset_id))
    SELECT 'stored' AS what, evidence_id AS id FROM fx_evidence WHERE first_doc % 10 <> 5
    UNION ALL SELECT 'violation', evidence_id FROM inc WHERE first_doc % 10 = 0
    UNION ALL SELECT 'violation', evidence_id FROM inc, range(2) WHERE first_doc % 10 = 5
    UNION ALL SELECT 'job', concat(evidence_id, '@', binding_id) FROM inc WHERE first_doc % 5 <> 0""")
def _(t):
    base = hashed_evidence(t)
    snapshot = base.where(c("first_doc") % 2 == 0)
    incoming = base.join(t.bindings.select("asset_id", "binding_id"), "asset_id").withColumn(
        "content_hash", F.when(c("first_doc") % 10 == 0, F.lit("other")).otherwise(c("content_hash")))
    # a second content for some new ids
    incoming = incoming.unionByName(incoming.where(c("first_doc") % 10 == 5).withColumn("content_hash", F.lit("second")))
    stored, violations, jobs = ev.upsert_evidence(snapshot, incoming)
    return (stored.select(F.lit("stored").alias("what"), c("evidence_id").alias("id"))
            .unionByName(violations.select(F.lit("violation").alias("what"), c("evidence_id").alias("id")))
            .unionByName(jobs.select(F.lit("job").alias("what"), F.concat("evidence_id", F.lit("@"), "binding_id").alias("id"))))


POINT_COLS = "evidence_id, binding_id"


@query("snk5_upsert_points", f"""SELECT {S.uuid5("concat('evidence:', e.evidence_id, ':', b.binding_id)")} AS point_id, CASE e.modality WHEN 'video' THEN 'video_segment' ELSE e.modality END AS collection,
    b.binding_id, b.owner_id, e.page, e.media_uri AS raw_file_uri FROM fx_evidence e JOIN fx_bindings b USING (asset_id) WHERE trim(e.content) <> ''""")
def _(t):
    old = ev.points_from(ev.projection_inputs(t.evidence, t.bindings.where(c("binding_id") % 2 == 0))).withColumn("owner_id", F.lit("stale"))
    new = ev.points_from(ev.projection_inputs(t.evidence, t.bindings))
    return keyed.upsert(old, new, ["point_id"]).select("point_id", "collection", "binding_id", "owner_id", "page", "raw_file_uri")


@query("snk6_length_agreement", """SELECT doc_id, 'no vector' AS problem FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 10 <> 0)
    UNION ALL SELECT vec_id, 'no chunk' FROM embeddings WHERE vec_id % 10 <> 0 AND vec_id NOT IN (SELECT doc_id FROM documents)""")
def _(t):
    vectors = t.embeddings.where(c("vec_id") % 10 != 0).select(c("vec_id").alias("doc_id"))
    return ev.length_mismatch(t.documents.select("doc_id"), vectors, "doc_id")


MEM_POINTS = "scope IN ('session','project') AND status = 'active' AND user_confirmed"


@query("snk7_upsert_memory_points", f"SELECT memory_id, {S.memory_text()} AS memory_text FROM fx_memories WHERE {MEM_POINTS}")
def _(t):
    memories = t.records
    stale = jobs.memory_points(memories.where(c("event_id") % 2 == 0).withColumns({"status": F.lit("active"), "user_confirmed": F.lit(True)}))
    return jobs.sync_memory_points(stale, memories).select("memory_id", "memory_text")


@query("snk8_delete_points", "SELECT point_id FROM fx_points WHERE point_id % 3 <> 0")
def _(t):
    gone = t.points.where(c("point_id") % 3 == 0).select("point_id").unionByName(t.points.select((c("point_id") + 10**9).alias("point_id")))
    return keyed.delete(t.points, gone, ["point_id"]).select("point_id")


PROJ = S.projectable()


@query("snk9_upsert_nodes", f"""WITH n AS (SELECT memory_id, event_id, {PROJ} AS live FROM fx_memories)
    SELECT 'node' AS what, memory_id AS id, live FROM n
    UNION ALL SELECT 'edge', CAST(r.relationship_id AS STRING), true FROM fx_relationships r JOIN n a ON a.memory_id = r.from_memory_id JOIN n b ON b.memory_id = r.to_memory_id
      WHERE (a.live OR a.event_id % 2 = 1) AND (b.live OR b.event_id % 2 = 1)""")
def _(t):
    stale = graph.nodes(t.memories, NOW).withColumn("is_active", F.lit(True))
    known = t.relationships.join(t.memories.select(c("memory_id").alias("to_memory_id")), "to_memory_id", "left_semi")
    edge_table = known.select("relationship_id", "from_memory_id", "to_memory_id")
    changed = t.memories.where(c("event_id") % 2 == 0)
    nodes, kept = graph.sync_nodes(stale, edge_table, changed, NOW)
    true_state = nodes.join(graph.nodes(t.memories, NOW).select("memory_id", c("is_active").alias("live")), "memory_id")
    return true_state.select(F.lit("node").alias("what"), c("memory_id").alias("id"), "live").unionByName(
        kept.select(F.lit("edge").alias("what"), c("relationship_id").cast("string").alias("id"), F.lit(True).alias("live")))


def same_part(a, b):
    return (f"({a}.owner_id = {b}.owner_id AND {a}.scope = {b}.scope AND CASE {a}.scope WHEN 'session' THEN {a}.session_id = {b}.session_id"
            f" WHEN 'project' THEN CASE WHEN {a}.project_id IS NOT NULL OR {b}.project_id IS NOT NULL THEN coalesce({a}.project_id = {b}.project_id, false)"
            f" ELSE coalesce({a}.project_scope = {b}.project_scope, false) END ELSE false END)")


EDGE_OK = (f"{same_part('s', 't')} AND CASE r.relationship_type WHEN 'superseded_by' THEN s.status = 'superseded' AND {S.projectable('t.')}"
           f" ELSE {S.projectable('s.')} AND {S.projectable('t.')} END")
EDGES_SQL = (f"SELECT r.relationship_id, upper(r.relationship_type) AS label, r.from_memory_id, r.to_memory_id, s.owner_id, r.created_at FROM fx_relationships r"
             f" JOIN fx_memories s ON s.memory_id = r.from_memory_id JOIN fx_memories t ON t.memory_id = r.to_memory_id WHERE {EDGE_OK}")


@query("snk10_upsert_edges", f"SELECT relationship_id, label FROM ({EDGES_SQL})")
def _(t):
    stale = graph.edges(t.relationships, t.memories, "2024-01-10 00:00:00")
    return graph.sync_edges(stale, t.relationships, t.memories, NOW).select("relationship_id", "label")


@query("snk11_delete_edges", f"SELECT relationship_id, label FROM ({EDGES_SQL}) WHERE relationship_id % 2 = 1")
def _(t):
    edge_table = graph.edges(t.relationships, t.memories, NOW)
    return keyed.delete(edge_table, t.relationships.where(c("relationship_id") % 2 == 0), ["relationship_id"]).select("relationship_id", "label")


@query("snk12_clear_graph", f"SELECT 'nodes' AS part, count(*) AS before, 0 AS after FROM fx_memories UNION ALL SELECT 'edges', count(*), 0 FROM ({EDGES_SQL})")
def _(t):
    tables = {"nodes": graph.nodes(t.memories, NOW), "edges": graph.edges(t.relationships, t.memories, NOW)}
    before = keyed.table_counts(tables)
    after = keyed.table_counts(keyed.reset(tables, confirmed=True)).withColumnRenamed("rows", "after")
    return before.join(after, "table_name").select(c("table_name").alias("part"), c("rows").alias("before"), "after")


GIVEN = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("snk13_reset_counts", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS rows FROM {n}" for n in GIVEN))
def _(t):
    return keyed.table_counts({name: t.table(name) for name in GIVEN})


@query("snk14_log_lines", """SELECT concat('{"duration_ms":', round(duration_ms, 3), ',"outcome":"', outcome, '","pipeline":"', pipeline, '","run_id":"', run_id,
    '","stage":"', stage, '"', CASE WHEN trace_id IS NOT NULL THEN concat(',"trace_id":"', trace_id, '"') ELSE '' END, '}') AS value FROM fx_latency""")
def _(t):
    return keyed.log_lines(t.latency)


@query("snk15_access_events", f"SELECT memory_id, trace_id, unnest(['retrieved', 'injected']) AS event_type, rank FROM fx_turn_access WHERE event_type = 'injected'")
def _(t):
    shown = t.turn_access.where(c("event_type") == "injected").drop("event_type")
    return keyed.access_rows(shown, sc.at(NOW)).select("memory_id", "trace_id", "event_type", "rank")


@query("snk16_audit_events", "SELECT memory_id, action AS event_type, actor_id FROM fx_commands")
def _(t):
    return keyed.audit_rows(t.commands, c("action"), c("actor_id"), F.lit("{}"), sc.at(NOW)).select("memory_id", "event_type", "actor_id")


# --- filters and projections ------------------------------------------------------------------

@query("flt1_dynamic_filter", """SELECT memory_id FROM fx_memories WHERE owner_id = 'u7' AND status = 'active' AND kind = 'event' ORDER BY updated_at DESC, memory_id LIMIT 100""")
def _(t):
    return lc.list_memories(t.memories, owner_id="u7", status="active", kind="event", session_id=None, limit=100).select("memory_id")


@query("flt2_owner_isolation", "SELECT c.memory_id, c.actor_id FROM fx_commands c JOIN fx_memories m ON m.memory_id = c.memory_id AND m.owner_id = c.actor_id")
def _(t):
    asked = t.commands.select("memory_id", c("actor_id").alias("owner_id"))
    return ss.owned(t.memories, asked, "memory_id").select("memory_id", c("owner_id").alias("actor_id"))


@query("flt3_applicable_scopes", """SELECT session_id AS chat, 'session' AS scope, 'session_id' AS field, session_id AS value FROM fx_sessions
    UNION ALL SELECT session_id, 'project', 'project_id', project_id FROM fx_sessions WHERE project_id <> ''
    UNION ALL SELECT session_id, 'project', 'project_scope', project_scope FROM fx_sessions WHERE project_scope <> ''""")
def _(t):
    scopes = t.sessions.select(c("session_id").alias("chat"), F.explode(sc.applicable_scopes()).alias("s"))
    return scopes.select("chat", c("s.visibility_scope").alias("scope"), c("s.constraint_field").alias("field"),
                         c("s.constraint_value").alias("value"))


@query("flt4_record_eligibility", f"SELECT q.session_id, r.memory_id FROM fx_sessions q JOIN fx_memories r ON {S.visible('r', 'q')} WHERE {S.current('r.')}")
def _(t):
    places = t.sessions.select("session_id", F.explode(sc.chat_keys()).alias("place"))
    return ids.eligible(t.memories, NOW).select("memory_id", "place").join(places, "place").select("session_id", "memory_id")


@query("flt5_candidate_scope", f"SELECT q.query_id, count(*) AS visible FROM fx_turns q JOIN fx_memories r ON {S.visible('r', 'q')} GROUP BY q.query_id")
def _(t):
    # Counts per place first: many chats share a place, and a busy place is counted once.
    sizes = t.memories.withColumn("place", sc.record_key()).groupBy("place").agg(F.count("*").alias("n"))
    places = t.turns.select("query_id", F.explode(sc.chat_keys()).alias("place"))
    return places.join(sizes, "place").groupBy("query_id").agg(F.sum("n").alias("visible"))


@query("flt6_evidence_visibility", f"SELECT q.query_id, p.point_id FROM fx_queries q JOIN fx_points p ON {S.evidence_visible('p', 'q')}")
def _(t):
    return ev.visible_bindings(t.points, t.queries).select("query_id", "point_id")


@query("flt7_memory_vector_filter", f"""SELECT q.query_id, count(*) AS hits FROM fx_turns q JOIN fx_memories r ON r.owner_id = q.owner_id AND {MEM_POINTS.replace('scope', 'r.scope').replace('status', 'r.status').replace('user_confirmed', 'r.user_confirmed')}
    AND ((r.scope = 'session' AND r.session_id = q.session_id) OR (r.scope = 'project' AND (r.project_id = q.project_id OR r.project_scope = q.project_scope))) GROUP BY q.query_id""")
def _(t):
    found = t.memories.where(sc.is_vector_eligible()).select("memory_id", F.explode(sc.index_keys()).alias("place"))
    chats = t.turns.select("query_id", "owner_id", "session_id", "project_id", "project_scope")
    asked = chats.select("owner_id", "session_id", "project_id", "project_scope").distinct()
    visible = asked.withColumn("place", F.explode(sc.chat_keys())).join(found, "place").drop("place").distinct()
    hits = visible.groupBy("owner_id", "session_id").agg(F.count("*").alias("hits"))
    return chats.join(hits, ["owner_id", "session_id"]).select("query_id", "hits")


@query("flt8_projectable_memory", f"SELECT memory_id, {PROJ} AS live FROM fx_memories")
def _(t):
    return t.memories.select("memory_id", sc.is_projectable(NOW).alias("live"))


@query("flt9_same_partition", f"SELECT r.relationship_id, {same_part('s', 't')} AS same FROM fx_relationships r JOIN fx_memories s ON s.memory_id = r.from_memory_id JOIN fx_memories t ON t.memory_id = r.to_memory_id")
def _(t):
    return graph.with_ends(t.relationships, t.memories).select("relationship_id", sc.same_partition("s_", "t_").alias("same"))


@query("flt10_projectable_edge", f"SELECT r.relationship_id, ({EDGE_OK}) AS ok FROM fx_relationships r JOIN fx_memories s ON s.memory_id = r.from_memory_id JOIN fx_memories t ON t.memory_id = r.to_memory_id")
def _(t):
    return graph.with_ends(t.relationships, t.memories).select("relationship_id", sc.is_projectable_edge(NOW, "s_", "t_").alias("ok"))


METRIC_SQL = """SELECT *, length(regexp_replace({x}, '[\\s\\p{{Z}}]', '', 'g')) AS vis, len(list_filter(regexp_split_to_array({x}, '[\\s\\p{{Z}}]+'), lambda w: w <> '')) AS nw,
    length(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS al, length({x}) - length(regexp_replace({x}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{{FFFD}}]', '', 'g')) AS bad, length({x}) AS n FROM {t}"""


@query("flt11_usable_native_text", f"SELECT asset_id, page, (vis >= 80 OR nw >= 15) AND al / greatest(vis, 1) >= 0.5 AND bad / greatest(n, 1) <= 0.01 AS usable FROM ({METRIC_SQL.format(x='native_text', t='fx_pdf_pages')})")
def _(t):
    return t.pdf_pages.select("asset_id", "page", tx.usable_native_text(tx.text_metrics(c("native_text"))).alias("usable"))


@query("flt12_usable_ocr", f"""SELECT asset_id, page, vis >= 20 AND al / greatest(vis, 1) >= 0.4 AS usable FROM ({METRIC_SQL.format(x='joined', t='''(SELECT asset_id, page,
      array_to_string(list_filter(list_transform(list_filter(list_transform(string_split(ocr_text, chr(10)), lambda l, i: struct_pack(l := l, i := i)), lambda s: s.i % 3 <> 0),
        lambda s: regexp_replace(s.l, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), lambda l: l <> ''), chr(10)) AS joined FROM fx_pdf_pages)''')})""")
def _(t):
    lines = t.pdf_pages.select("asset_id", "page", F.transform(F.split("ocr_text", "\n"), lambda l, i: F.struct(
        l.alias("text"), F.when((i + 1) % 3 == 0, 0.5).otherwise(0.9).alias("confidence"))).alias("lines"))
    joined = lines.select("asset_id", "page", routing.accepted_ocr(c("lines")).alias("ocr_text"))
    return joined.select("asset_id", "page", tx.usable_ocr(tx.text_metrics(c("ocr_text"))).alias("usable"))


@query("flt13_skip_blank", "SELECT evidence_id FROM (SELECT evidence_id, CASE WHEN first_doc % 9 = 0 THEN '  ' ELSE content END AS content FROM fx_evidence) WHERE trim(content) <> ''")
def _(t):
    spoiled = t.evidence.withColumn("content", F.when(c("first_doc") % 9 == 0, "  ").otherwise(c("content")))
    return ev.points_from(ev.projection_inputs(spoiled, t.bindings.join(t.assets.select(c("first_doc").alias("binding_id")), "binding_id"))).select("evidence_id")


@query("flt14_graph_nodes", f"""SELECT q.session_id AS query_id, r.memory_id FROM fx_sessions q JOIN fx_memories r ON r.owner_id = q.owner_id WHERE {S.projectable('r.')} AND r.scope = 'project'
    AND CASE WHEN q.project_id IS NOT NULL THEN r.project_id = q.project_id ELSE true END""")
def _(t):
    asked = t.sessions.select(c("session_id").alias("query_id"), "owner_id", F.lit("project").alias("want_scope"),
                              c("project_id").alias("want_project_id"), c("project_scope").alias("want_project_scope"))
    return graph.list_nodes(graph.nodes(t.memories, NOW), asked).select("query_id", "memory_id")


@query("flt15_conflict_listing", "SELECT x.conflict_id, m.owner_id FROM fx_conflicts x JOIN fx_memories m ON m.memory_id = x.incoming_memory_id WHERE x.status = 'open' AND m.project_scope = 'Project 1'")
def _(t):
    return lists.conflicts(t.conflicts, t.memories).where((c("status") == "open") & (c("project_scope") == "Project 1")).select("conflict_id", "owner_id")


@query("flt16_project_agreement", "SELECT r.request_id, p.project_id, lower(trim(regexp_replace(r.name, '  +', ' ', 'g'))) = p.normalized_name AS agrees FROM fx_project_requests r JOIN fx_projects p ON p.owner_id = r.owner_id")
def _(t):
    projects = t.projects.select("project_id", "owner_id", "normalized_name")
    joined = t.project_requests.join(projects, "owner_id")
    return joined.select("request_id", "project_id", (tx.name_key(c("name")) == c("normalized_name")).alias("agrees"))


@query("flt17_upload_scope", """SELECT m.session_id, m.turn_index, CASE WHEN m.turn_index % 4 = 3 THEN 'session not found' WHEN m.turn_index % 2 = 1 AND s.project_id IS NULL THEN 'project scope needs a project session' ELSE '' END AS reason,
    CASE WHEN m.turn_index % 4 = 3 THEN '' WHEN m.turn_index % 2 = 0 THEN m.session_id ELSE coalesce(s.project_id, '') END AS place FROM fx_messages m JOIN fx_sessions s USING (session_id)""")
def _(t):
    up = t.messages.select(c("session_id").alias("chat"), "turn_index", F.when(c("turn_index") % 4 == 3, "none").otherwise(c("session_id")).alias("session_id"),
                           F.when(c("turn_index") % 2 == 1, "project").otherwise("session").alias("scope"))
    good, bad = ss.upload_scopes(up, t.sessions)
    return good.select(c("chat").alias("session_id"), "turn_index", F.lit("").alias("reason"), F.coalesce("bound_session", "bound_project").alias("place")).unionByName(
        bad.select(c("chat").alias("session_id"), "turn_index", "reason", F.lit("").alias("place")))


LATEST_RUN = "(SELECT * FROM fx_runs QUALIFY row_number() OVER (PARTITION BY binding_id ORDER BY created_at DESC, run_id DESC) = 1)"


@query("flt18_retry_eligibility", f"SELECT q.query_id, r.binding_id, r.status FROM {LATEST_RUN} r JOIN fx_bindings b USING (binding_id) JOIN fx_queries q ON {S.evidence_visible('b', 'q')} WHERE r.status NOT IN ('processing', 'done')")
def _(t):
    return ev.retryable(ev.document_status(t.runs, t.bindings, t.queries)).select("query_id", "binding_id", "status")


@query("prj1_row_shapes", "SELECT session_id, owner_id, title, project_scope AS project_name, strftime(updated_at, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS updated_at FROM fx_sessions")
def _(t):
    return lists.session_rows(t.sessions).select("session_id", "owner_id", "title", "project_name", "updated_at")


@query("prj2_peer", """SELECT relationship_id, from_memory_id AS memory_id, to_memory_id AS peer_memory_id FROM fx_relationships
    UNION ALL SELECT relationship_id, to_memory_id, from_memory_id FROM fx_relationships r WHERE to_memory_id <> from_memory_id AND EXISTS (SELECT 1 FROM fx_memories m WHERE m.memory_id = r.to_memory_id)""")
def _(t):
    return graph.peers(t.relationships, t.memories).select("relationship_id", "memory_id", "peer_memory_id")


@query("prj3_conflict_shape", "SELECT conflict_id, details, x.status, m.project_scope FROM fx_conflicts x JOIN fx_memories m ON m.memory_id = x.incoming_memory_id")
def _(t):
    return lists.conflict_rows(lists.conflicts(t.conflicts, t.memories)).select("conflict_id", "details", "status", "project_scope")


@query("prj4_point_payload", """SELECT e.evidence_id, b.binding_id, e.asset_id AS doc_id, b.owner_id, b.scope, e.source_name, e.page, e.media_uri AS raw_file_uri,
    e.parser_backend FROM fx_evidence e JOIN fx_bindings b USING (asset_id) WHERE trim(e.content) <> ''""")
def _(t):
    return ev.points_from(ev.projection_inputs(t.evidence, t.bindings)).select(
        "evidence_id", "binding_id", "doc_id", "owner_id", "scope", "source_name", "page", "raw_file_uri", "parser_backend")


@query("prj5_graph_nodes", f"SELECT memory_id, owner_id, kind, round(confidence, 6) AS confidence, {PROJ} AS is_active FROM fx_memories")
def _(t):
    return graph.nodes(t.memories, NOW).select("memory_id", "owner_id", "kind", F.round("confidence", 6).alias("confidence"), "is_active")


@query("prj6_candidate_payload", f"SELECT memory_id, {S.memory_text()} AS memory_text, kind, scope, round(confidence, 6) AS confidence, 'semantic' AS candidate_source FROM fx_memories")
def _(t):
    found = t.records.withColumn("candidate_source", F.lit("semantic"))
    return context.candidate_rows(found).select("memory_id", "memory_text", "kind", "scope", F.round("confidence", 6).alias("confidence"), "candidate_source")


@query("prj8_image_evidence", """SELECT page_id, 'caption' AS representation, concat('[Image: ', page_id, '.png]', chr(10), url) AS content FROM pages
    UNION ALL SELECT page_id, 'ocr', concat('[Image: ', page_id, '.png]', chr(10), 'Text in image:', chr(10), html) FROM pages WHERE page_id % 2 = 0""")
def _(t):
    images = t.pages.select("page_id", F.concat("page_id", F.lit(".png")).alias("filename"), c("url").alias("caption"),
                            F.when(c("page_id") % 2 == 0, c("html")).alias("ocr_text"))
    return routing.image_evidence(images, ["page_id"]).select("page_id", "representation", "content")


@query("prj9_evidence_rows", "SELECT evidence_id, asset_id, CASE modality WHEN 'video' THEN 'video' ELSE modality END AS modality, source_name, media_uri FROM fx_evidence")
def _(t):
    chunks = routing.evidence_to_chunks(t.evidence)
    return routing.chunks_to_evidence(chunks).select("evidence_id", "asset_id", "modality", "source_name", "media_uri")


@query("prj10_chunk_rows", "SELECT evidence_id AS chunk_id, asset_id AS doc_id, CASE modality WHEN 'video' THEN 'video_segment' ELSE modality END AS modality, media_uri AS raw_file_uri FROM fx_evidence")
def _(t):
    return routing.evidence_to_chunks(t.evidence).select("chunk_id", "doc_id", "modality", "raw_file_uri")


@query("prj12_reconciliation_details", """SELECT memory_id, concat('{"changed_claims":"', k, '","incoming_source_turn_id":"', source_turn_id, '","outcome":"', 'update', '","reconciliation_confidence":0.9,"reconciliation_reason":"r"}') AS details FROM fx_memories""")
def _(t):
    d = t.memories.select("memory_id", "source_turn_id", F.lit("update").alias("outcome"), c("k").cast("string").alias("changed_claims"),
                          F.lit(0.9).alias("confidence"), F.lit("r").alias("reason"))
    return d.select("memory_id", context.reconciliation_details().alias("details"))


# --- joins --------------------------------------------------------------------------------------

@query("jn1_accessible_projects", "SELECT p.project_id, p.name, m.owner_id AS member_id FROM fx_projects p JOIN fx_memberships m USING (project_id) WHERE p.archived_at IS NULL")
def _(t):
    return ss.accessible_projects(t.projects, t.memberships).select("project_id", "name", "member_id")


FIRST_USER = "(SELECT * FROM fx_messages WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn_index) = 1)"


@query("jn2_first_user_message", f"SELECT s.session_id, m.content FROM fx_sessions s JOIN {FIRST_USER} m USING (session_id) WHERE s.title = 'New chat'")
def _(t):
    untitled = t.sessions.where(c("title") == C.DEFAULT_TITLE).select("session_id")
    return ss.first_user_messages(t.messages).join(untitled, "session_id").select("session_id", "content")


@query("jn3_bound_assets", f"SELECT q.query_id, b.binding_id, a.filename FROM fx_bindings b JOIN fx_assets a USING (asset_id) JOIN fx_queries q ON {S.evidence_visible('b', 'q')}")
def _(t):
    return ev.bound_assets(t.bindings, t.assets, t.queries).select("query_id", "binding_id", "filename")


@query("jn4_document_status", f"SELECT q.query_id, r.binding_id, r.run_id, r.status, r.chunk_count FROM {LATEST_RUN} r JOIN fx_bindings b USING (binding_id) JOIN fx_queries q ON {S.evidence_visible('b', 'q')}")
def _(t):
    return ev.document_status(t.runs, t.bindings, t.queries).select("query_id", "binding_id", "run_id", "status", "chunk_count")


@query("jn5_projection_input", "SELECT e.evidence_id, b.binding_id, b.owner_id, b.scope FROM fx_evidence e JOIN fx_bindings b USING (asset_id)")
def _(t):
    return ev.projection_inputs(t.evidence, t.bindings).select("evidence_id", "binding_id", "owner_id", "scope")


REFS_SQL = "SELECT DISTINCT q.query_id, p.evidence_id, p.binding_id FROM fx_queries q JOIN fx_points p ON p.owner_id = q.owner_id"
AUTH_SQL = f"""SELECT x.query_id, x.evidence_id, x.binding_id, e.source_name, e.page FROM ({REFS_SQL}) x JOIN fx_evidence e USING (evidence_id)
    JOIN fx_bindings b ON b.binding_id = x.binding_id AND b.asset_id = e.asset_id JOIN fx_queries q ON q.query_id = x.query_id AND {S.evidence_visible('b', 'q')}"""


def index_hits(t):
    """Hits of an index that only knows the owner, in point order."""
    hits = t.queries.select("query_id", "owner_id").join(t.points.select("owner_id", "evidence_id", "binding_id", "point_id"), "owner_id")
    return hits.select("query_id", "evidence_id", "binding_id", c("point_id").alias("rank"), (1 / (c("point_id") + 1)).alias("score"))


@query("jn6_revalidate", AUTH_SQL)
def _(t):
    return ev.revalidate(index_hits(t), t.evidence, t.bindings, t.queries).select("query_id", "evidence_id", "binding_id", "source_name", "page")


@query("jn7_candidate_merge", f"""SELECT query_id, evidence_id, binding_id, source_name FROM ({AUTH_SQL}) QUALIFY row_number() OVER (PARTITION BY query_id, evidence_id ORDER BY binding_id) = 1""")
def _(t):
    allowed = ev.revalidate(index_hits(t), t.evidence, t.bindings, t.queries)
    return ev.merge_candidates(index_hits(t), allowed).select("query_id", "evidence_id", "binding_id", "source_name")


@query("jn8_graph_relationships", f"SELECT relationship_id, label, from_memory_id, to_memory_id, owner_id FROM ({EDGES_SQL})")
def _(t):
    return graph.edges(t.relationships, t.memories, NOW).select("relationship_id", "label", "from_memory_id", "to_memory_id", "owner_id")


@query("jn12_conflicts_with_record", "SELECT x.conflict_id, m.owner_id, m.project_scope, x.status FROM fx_conflicts x JOIN fx_memories m ON m.memory_id = x.incoming_memory_id")
def _(t):
    return lists.conflicts(t.conflicts, t.memories).select("conflict_id", "owner_id", "project_scope", "status")


@query("jn13_jobs_with_records", "SELECT job_id, owner_id FROM (SELECT j.job_id, m.owner_id, j.updated_at FROM fx_jobs j JOIN fx_memories m USING (memory_id) WHERE j.status = 'failed') QUALIFY row_number() OVER (PARTITION BY owner_id ORDER BY updated_at DESC, job_id) <= 100")
def _(t):
    return lists.jobs(t.jobs, t.memories, status="failed", limit=100).select("job_id", "owner_id")


@query("jn14_live_edges", f"""SELECT r.relationship_id FROM fx_relationships r JOIN (SELECT memory_id, {PROJ} AS live FROM fx_memories) s ON s.memory_id = r.from_memory_id
    JOIN (SELECT memory_id, {PROJ} AS live FROM fx_memories) t ON t.memory_id = r.to_memory_id WHERE t.live AND (s.live OR r.relationship_type = 'superseded_by')""")
def _(t):
    labelled = t.relationships.withColumn("label", F.upper("relationship_type"))
    return graph.live_edges(labelled, graph.nodes(t.memories, NOW)).select("relationship_id")


@query("jn16_project_backfill", """SELECT m.memory_id, coalesce(p.project_id, '') AS project_id FROM fx_memories m LEFT JOIN (SELECT DISTINCT owner_id, lower(project_scope) AS n, project_id FROM fx_sessions WHERE project_scope IS NOT NULL) p
    ON p.owner_id = m.owner_id AND p.n = lower(m.project_scope) WHERE m.scope = 'project' AND m.project_id IS NULL""")
def _(t):
    names = t.sessions.where(c("project_scope").isNotNull()).select("owner_id", tx.name_key(c("project_scope")).alias("normalized_name"), "project_id").distinct()
    matched, unmatched = lc.backfill_project_ids(t.memories, names)
    return matched.select("memory_id", "project_id").unionByName(unmatched.select("memory_id", F.lit("").alias("project_id")))


@query("jn17_rehydrate", f"SELECT a.access_event_id, q.session_id FROM fx_turn_access a JOIN fx_sessions q USING (session_id) JOIN fx_memories r ON r.memory_id = a.memory_id AND {S.visible('r', 'q')} WHERE {S.current('r.')}")
def _(t):
    hits = t.turn_access.join(t.sessions.select("session_id"), "session_id").withColumn("query_id", c("session_id"))
    chats = t.sessions.withColumn("query_id", c("session_id"))
    return context.rehydrate(hits.select("query_id", "memory_id", "access_event_id"), t.memories, chats, NOW).select("access_event_id", c("query_id").alias("session_id"))


@query("jn18_open_conflict_semi_join", "SELECT conflict_id FROM fx_conflicts x WHERE status = 'open' AND EXISTS (SELECT 1 FROM fx_memories m WHERE m.memory_id = x.incoming_memory_id AND m.source_turn_id IS NOT NULL)")
def _(t):
    of_turn = t.memories.where(c("source_turn_id").isNotNull()).select(c("memory_id").alias("incoming_memory_id"))
    return t.conflicts.where(c("status") == "open").join(of_turn, "incoming_memory_id", "left_semi").select("conflict_id")


@query("jn20_comparable_events", f"""WITH ev AS (SELECT memory_id, created_at, {S.domain()} AS d, unnest({S.event_ids()}) AS i FROM fx_memories WHERE kind = 'event'),
    f AS (SELECT d, i, min(struct_pack(a := created_at, b := memory_id)) AS h FROM ev GROUP BY d, i)
    SELECT memory_id, min(h).b AS existing_memory_id FROM ev JOIN f USING (d, i) WHERE h.b <> memory_id GROUP BY memory_id""")
def _(t):
    return ids.comparable_pairs(t.records.where(c("kind") == "event"))


@query("jn21_reuse_for_binding", "SELECT b.binding_id, e.evidence_id FROM fx_bindings b JOIN fx_evidence e USING (asset_id) JOIN (SELECT asset_id, min(binding_id) AS mb FROM fx_bindings GROUP BY 1) f ON f.asset_id = b.asset_id AND b.binding_id > f.mb")
def _(t):
    first = t.bindings.groupBy("asset_id").agg(F.min("binding_id").alias("first_binding"))
    later = t.bindings.join(first, "asset_id").where("binding_id > first_binding")
    return ev.projection_inputs(t.evidence, later).select("binding_id", "evidence_id")


@query("jn22_rebuild_fan_out", "SELECT e.evidence_id, b.binding_id, 'vector' AS target FROM fx_evidence e JOIN fx_bindings b USING (asset_id)")
def _(t):
    return ev.projection_inputs(t.evidence, t.bindings).select("evidence_id", "binding_id", F.lit("vector").alias("target"))


# --- aggregations ---------------------------------------------------------------------------------

@query("agg2_next_turn", "SELECT session_id, max(turn_index) + 1 AS next_turn FROM fx_messages GROUP BY 1")
def _(t):
    return ss.next_turns(t.messages)


TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@query("agg7_table_counts", " UNION ALL ".join(f"SELECT '{name}' AS table_name, count(*) AS rows FROM {name}" for name in TABLES))
def _(t):
    return keyed.table_counts({name: t.table(name) for name in TABLES})


@query("agg8_collection_size", "SELECT collection, count(*) AS points FROM fx_points GROUP BY 1")
def _(t):
    return t.points.groupBy("collection").agg(F.count("*").alias("points"))


@query("agg10_stage_totals", "SELECT run_id, stage, round(sum(duration_ms), 3) AS total_ms, count(*) AS jobs FROM fx_latency GROUP BY 1, 2")
def _(t):
    return lists.stage_totals(t.latency)


@query("agg11_document_text", "SELECT asset_id, string_agg(native_text, chr(10) || chr(10) ORDER BY page) AS content FROM fx_pdf_pages GROUP BY 1")
def _(t):
    return ordered.joined_in_order(t.pdf_pages, ["asset_id"], [c("page")], c("native_text"), "\n\n", "content")


@query("agg13_text_totals", "SELECT source, count(*) AS blocks, CAST(sum(length(text)) AS BIGINT) AS chars, round(avg(length(text)), 4) AS mean_chars FROM documents GROUP BY 1")
def _(t):
    n = F.length("text")
    return t.documents.groupBy("source").agg(F.count("*").alias("blocks"), F.sum(n).alias("chars"), F.round(F.avg(n), 4).alias("mean_chars"))


TURN_STATE = "CASE event_id % 5 WHEN 0 THEN 'running' WHEN 1 THEN 'failed' ELSE 'completed' END"


@query("agg15_turn_outcome", f"""WITH turns AS (SELECT concat('turn', g) AS source_turn_id, g FROM (SELECT DISTINCT event_id % 1200 AS g FROM events)),
    x AS (SELECT source_turn_id, CASE g % 5 WHEN 0 THEN 'running' WHEN 1 THEN 'failed' ELSE 'completed' END AS st FROM turns WHERE g % 7 <> 0),
    r AS (SELECT m.source_turn_id, count(*) AS n, bool_or(m.status = 'candidate') AS cand, count(DISTINCT x.incoming_memory_id) AS oc FROM fx_memories m
      LEFT JOIN fx_conflicts x ON x.incoming_memory_id = m.memory_id AND x.status = 'open' GROUP BY 1)
    SELECT t.source_turn_id, coalesce(x.st, 'queued') AS status, CASE WHEN x.st IS NULL OR x.st = 'running' THEN 'pending' WHEN x.st = 'failed' THEN 'failed'
      WHEN coalesce(r.oc, 0) > 0 OR coalesce(r.cand, false) THEN 'review_required' WHEN coalesce(r.n, 0) > 0 THEN 'memory_saved' ELSE 'no_memory' END AS outcome,
      coalesce(r.n, 0) AS memories FROM turns t LEFT JOIN x USING (source_turn_id) LEFT JOIN r USING (source_turn_id)""")
def _(t):
    turns = t.events.select((c("event_id") % 1200).alias("g")).distinct().withColumn("source_turn_id", F.concat(F.lit("turn"), "g"))
    state = F.when(c("g") % 5 == 0, "running").when(c("g") % 5 == 1, "failed").otherwise("completed")
    extractions = turns.where(c("g") % 7 != 0).withColumn("status", state)
    return lc.turn_outcomes(turns, extractions, t.memories, t.conflicts).select("source_turn_id", "status", "outcome", "memories")


# --- windows ---------------------------------------------------------------------------------------

@query("win1_latest_run", f"SELECT binding_id, run_id, status FROM {LATEST_RUN}")
def _(t):
    return ev.latest_runs(t.runs).select("binding_id", "run_id", "status")


@query("win2_first_user_turn", f"SELECT session_id, message_id, turn_index FROM {FIRST_USER}")
def _(t):
    return ss.first_user_messages(t.messages).select("session_id", "message_id", "turn_index")


@query("win3_latest_conflict", """SELECT incoming, existing, max(conflict_id) AS conflict_id FROM (SELECT conflict_id, m.owner_id AS incoming, x.existing_memory_id AS existing
    FROM fx_conflicts x JOIN fx_memories m ON m.memory_id = x.incoming_memory_id) GROUP BY 1, 2""")
def _(t):
    by_owner = t.conflicts.join(t.memories.select(c("memory_id").alias("incoming_memory_id"), "owner_id"), "incoming_memory_id")
    pairs = by_owner.select("conflict_id", c("owner_id").alias("incoming_memory_id"), "existing_memory_id")
    return lc.latest_conflicts(pairs).select(c("incoming_memory_id").alias("incoming"), c("existing_memory_id").alias("existing"), "conflict_id")


@query("win4_previous_answer", """SELECT message_id, coalesce(last(CASE WHEN role = 'assistant' THEN trace_id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY turn_index
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS previous_trace FROM fx_messages""")
def _(t):
    return context.previous_answers(t.messages, span=4).select("message_id", text("previous_trace").alias("previous_trace"))


@query("win5_recent_messages", """SELECT message_id, coalesce(string_agg(content, chr(10)) OVER (PARTITION BY session_id ORDER BY turn_index ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS recent,
    count(*) OVER (PARTITION BY session_id ORDER BY turn_index ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS n FROM fx_messages""")
def _(t):
    out = ordered.recent(t.messages, ["session_id"], "turn_index", c("content"), 3, "items", span=4)
    return out.select("message_id", F.array_join("items", "\n").alias("recent"), F.size("items").cast("long").alias("n"))


@query("win6_repeated_neighbours", f"""SELECT conv_id, turn, role FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE before IS DISTINCT FROM role""")
def _(t):
    cues = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", c("role").alias("text")))).alias("cues"))
    kept = cues.select("conv_id", F.explode(segments.without_repeats(c("cues"))).alias("q"))
    return kept.select("conv_id", "q.turn", c("q.text").alias("role"))


@query("win7_labels", """SELECT query_id, point_id, concat('M', row_number() OVER (PARTITION BY query_id ORDER BY point_id)) AS label FROM (
    SELECT q.query_id, p.point_id FROM fx_queries q JOIN fx_points p ON p.owner_id = q.owner_id)""")
def _(t):
    hits = t.queries.select("query_id", "owner_id").join(t.points.select("owner_id", "point_id"), "owner_id")
    numbered = ordered.ordinal(hits, ["query_id"], [c("point_id")], F.floor(c("point_id") / 1000), "n")
    return numbered.select("query_id", "point_id", F.concat(F.lit("M"), "n").alias("label"))


@query("win8_unique_best", """SELECT l_orderkey, any_value(l_linenumber) AS best FROM (SELECT *, rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS r FROM lineitem) WHERE r = 1 GROUP BY 1 HAVING count(*) = 1""")
def _(t):
    return context.unique_best(t.lineitem, ["l_orderkey"], "l_quantity", "l_linenumber").select("l_orderkey", c("l_linenumber").alias("best"))


@query("win9_row_groups", """SELECT c_mktsegment, c_custkey, CAST((row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1) // 50 AS BIGINT) AS row_group FROM customer""")
def _(t):
    return tables.row_groups(t.customer, ["c_mktsegment"], "c_custkey").select("c_mktsegment", "c_custkey", "row_group")


@query("win10_block_ordinal", "SELECT doc_id, page, seq, row_number() OVER (PARTITION BY doc_id, page ORDER BY seq) - 1 AS block FROM fx_layout_items")
def _(t):
    numbered = ordered.ordinal(t.layout_items, ["doc_id", "page"], [c("seq")], F.floor(c("seq") / 1000), "n")
    return numbered.select("doc_id", "page", "seq", (c("n") - 1).alias("block"))


@query("win11_first_hit", """SELECT query_id, evidence_id, min(point_id) AS rank FROM (SELECT q.query_id, p.evidence_id, p.point_id FROM fx_queries q JOIN fx_points p ON p.owner_id = q.owner_id) GROUP BY 1, 2""")
def _(t):
    return hybrid.first_hits(index_hits(t), ["query_id", "evidence_id"]).select("query_id", "evidence_id", "rank")


@query("win12_last_hit", """SELECT trace_id, memory_id, max(access_event_id) AS access_event_id FROM fx_access GROUP BY 1, 2""")
def _(t):
    return keyed.latest(t.access, ["trace_id", "memory_id"], [c("access_event_id").desc()]).select("trace_id", "memory_id", "access_event_id")


# --- sorts and limits --------------------------------------------------------------------------------

@query("top1_newest_first", "SELECT owner_id, memory_id, rn AS position FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY updated_at DESC, memory_id) AS rn FROM fx_memories) WHERE rn <= 20")
def _(t):
    newest = [c("updated_at").desc(), c("memory_id")]
    return ordered.top_per(t.memories, ["owner_id"], newest, 20, "position").select("owner_id", "memory_id", c("position").cast("long").alias("position"))


@query("top2_activity_order", "SELECT owner_id, session_id, rn AS position FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY updated_at DESC, session_id) AS rn FROM fx_sessions)")
def _(t):
    newest = [c("updated_at").desc(), c("session_id")]
    numbered = ordered.ordinal(t.sessions, ["owner_id"], newest, -F.floor(F.unix_timestamp("updated_at") / 86400), "position")
    return numbered.select("owner_id", "session_id", "position")


@query("top3_access_history", "SELECT memory_id, access_event_id FROM fx_access QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY access_event_id DESC) <= 5")
def _(t):
    return ordered.top_per(t.access, ["memory_id"], [c("access_event_id").desc()], 5).select("memory_id", "access_event_id")


@query("top4_injected_ids", """SELECT trace_id, string_agg(memory_id, '|' ORDER BY f.r, f.a) AS ids FROM (SELECT trace_id, memory_id, min(struct_pack(r := rank, a := access_event_id)) AS f
    FROM fx_access WHERE event_type = 'injected' GROUP BY trace_id, memory_id) GROUP BY 1""")
def _(t):
    first = context.injected_memories(t.access, ["trace_id"])
    return ordered.joined_in_order(first, ["trace_id"], [c("rank"), c("access_event_id")], c("memory_id"), "|", "ids")


@query("top11_due_in_order", f"SELECT memory_id, {S.ts('valid_to')} AS valid_to FROM fx_memories WHERE status = 'active' AND valid_to <= {NOW_SQL} ORDER BY fx_memories.valid_to, memory_id")
def _(t):
    return lc.due(t.memories, NOW).orderBy("valid_to", "memory_id").select("memory_id", ts("valid_to").alias("valid_to"))


@query("top12_oldest_pending", "SELECT job_id FROM fx_jobs WHERE status = 'pending' ORDER BY updated_at, job_id LIMIT 100")
def _(t):
    return jobs.claim(t.jobs.where(c("status") == "pending"), NOW, 100, "w").select("job_id")


@query("top13_subject_history", f"SELECT k % 4 AS subject, memory_id, row_number() OVER (PARTITION BY owner_id, k % 4 ORDER BY created_at, memory_id) AS position FROM fx_memories WHERE kind = 'event'")
def _(t):
    events = t.memories.where(c("kind") == "event").withColumn("subject", c("k") % 4)
    out = ordered.ordinal(events, ["owner_id", "subject"], [c("created_at"), c("memory_id")], F.date_trunc("day", "created_at"), "position")
    return out.select("subject", "memory_id", "position")


# --- set operations ---------------------------------------------------------------------------------------

@query("set5_known_ids_excluded", "SELECT memory_id FROM fx_memories WHERE memory_id NOT IN (SELECT memory_id FROM fx_access)")
def _(t):
    return keyed.delete(t.memories, t.access, ["memory_id"]).select("memory_id")


@query("set6_distinct_owners", "SELECT DISTINCT owner_id, project_scope FROM fx_memories")
def _(t):
    return t.memories.select("owner_id", "project_scope").distinct()


# --- projects, chats, messages -------------------------------------------------------------------------------

NAME_SQL = "lower(trim(regexp_replace(name, '[\\s\\p{Z}]+', ' ', 'g')))"
CREATED_SQL = f"""SELECT owner_id, {NAME_SQL} AS nn, min(request_id) AS first_request FROM fx_project_requests r
    WHERE NOT EXISTS (SELECT 1 FROM fx_projects p WHERE p.owner_id = r.owner_id AND p.normalized_name = {NAME_SQL.replace('name', 'r.name')}) GROUP BY 1, 2"""


@query("ses1_resolve_projects", f"""WITH n AS ({CREATED_SQL})
    SELECT r.request_id, coalesce(p.project_id, 'new') AS project_id, n.first_request IS NOT NULL AS created FROM (SELECT *, {NAME_SQL} AS nn FROM fx_project_requests) r
    LEFT JOIN fx_projects p ON p.owner_id = r.owner_id AND p.normalized_name = r.nn LEFT JOIN n ON n.owner_id = r.owner_id AND n.nn = r.nn""")
def _(t):
    created, resolved = ss.resolve_projects(t.project_requests, t.projects)
    marked = resolved.join(created.select("project_id", F.lit(True).alias("is_new")), "project_id", "left")
    return marked.select("request_id", F.when(c("is_new"), "new").otherwise(c("project_id")).alias("project_id"),
                         F.coalesce("is_new", F.lit(False)).alias("created"))


@query("ses2_project_names", "SELECT owner_id, normalized_name, project_id FROM fx_projects WHERE archived_at IS NULL")
def _(t):
    return ss.project_names(t.projects).select("owner_id", "normalized_name", "project_id")


MOVE_SQL = f"""SELECT v.session_id, v.owner_id, coalesce(v.project_id, '') <> '' AND a.project_id IS NULL AS refused,
    CASE WHEN coalesce(v.project_id, '') <> '' THEN a.project_id WHEN nn <> '' THEN coalesce(p.project_id, {S.uuid5("concat('project:', v.owner_id, ':', nn)")}) END AS new_project
    FROM (SELECT *, {S.casefold(S.collapse("coalesce(project_name, '')"))} AS nn FROM fx_session_moves) v
    LEFT JOIN (SELECT DISTINCT p.project_id, m.owner_id FROM fx_projects p JOIN fx_memberships m USING (project_id) WHERE archived_at IS NULL) a ON a.project_id = v.project_id AND a.owner_id = v.owner_id
    LEFT JOIN fx_projects p ON p.owner_id = v.owner_id AND p.normalized_name = v.nn"""


@query("ses3_create_sessions", f"SELECT session_id, CASE WHEN refused THEN 'refused' ELSE coalesce(new_project, '') END AS project FROM ({MOVE_SQL})")
def _(t):
    made, refused = ss.create_sessions(t.session_moves, t.projects, t.memberships, NOW)
    return made.select("session_id", text("project_id").alias("project")).unionByName(refused.select("session_id", F.lit("refused").alias("project")))


@query("ses4_owned_session", "SELECT s.session_id, s.title FROM fx_sessions s JOIN (SELECT session_id, CASE WHEN conv_id % 3 = 0 THEN 'other' ELSE owner_id END AS o FROM fx_sessions) a ON a.session_id = s.session_id AND a.o = s.owner_id")
def _(t):
    asked = t.sessions.select("session_id", F.when(c("conv_id") % 3 == 0, "other").otherwise(c("owner_id")).alias("owner_id"))
    return ss.owned(t.sessions, asked, "session_id").select("session_id", "title")


@query("ses5_move_sessions", f"""SELECT s.session_id, coalesce(CASE WHEN v.refused THEN s.project_id ELSE v.new_project END, '') AS project,
    {S.ts(f'CASE WHEN v.refused THEN s.updated_at ELSE {NOW_SQL} END')} AS updated_at FROM fx_sessions s JOIN ({MOVE_SQL}) v USING (session_id)""")
def _(t):
    out = ss.move_sessions(t.sessions, t.session_moves, t.projects, t.memberships, NOW)
    return out.select("session_id", text("project_id").alias("project"), ts("updated_at").alias("updated_at"))


def split_messages(t):
    early = c("turn_index") < 3
    old, new = t.messages.where(early), t.messages.where(~early).drop("turn_index")
    owners = t.sessions.select("session_id", "owner_id")
    return old, new.join(owners, "session_id")


@query("ses6_append_messages", f"""SELECT m.message_id, CAST(coalesce(o.last_turn, 0) + row_number() OVER (PARTITION BY m.session_id ORDER BY m.created_at, m.message_id) AS INT) AS turn_index,
    {S.ts("greatest(s.updated_at, max(m.created_at) OVER (PARTITION BY m.session_id))")} AS active_at FROM fx_messages m JOIN fx_sessions s USING (session_id)
    LEFT JOIN (SELECT session_id, max(turn_index) AS last_turn FROM fx_messages WHERE turn_index < 3 GROUP BY 1) o USING (session_id) WHERE m.turn_index >= 3""")
def _(t):
    old, new = split_messages(t)
    appended, touched = ss.append_messages(t.sessions, old, new, F.date_trunc("minute", "created_at"))
    return appended.join(touched.select("session_id", "updated_at"), "session_id").select("message_id", "turn_index", ts("updated_at").alias("active_at"))


@query("ses7_set_titles", f"""SELECT s.session_id, CASE WHEN s.title = 'New chat' AND conv_id % 2 = 0 THEN concat('Plan ', conv_id) ELSE s.title END AS title FROM fx_sessions s""")
def _(t):
    long = F.concat(F.lit("Plan "), F.repeat(F.lit("x"), F.lit(60)))
    titles = t.sessions.select("session_id", "owner_id", F.when(c("conv_id") % 2 == 0, F.concat(F.lit(" Plan  "), "conv_id")).otherwise(long).alias("title"))
    return ss.set_titles(t.sessions, titles, NOW)[0].select("session_id", "title")


@query("ses8_backfill_titles", f"""SELECT session_id, CASE WHEN clean = '' THEN 'New chat' WHEN length(clean) > length(fit) THEN fit || '…' ELSE fit END AS title FROM (
    SELECT *, CASE WHEN length(head) > 48 THEN regexp_replace(rtrim(substr(head, 1, 48)), ' [^ ]*$', '') ELSE head END AS fit FROM (
      SELECT session_id, clean, array_to_string(string_split(clean, ' ')[1:7], ' ') AS head FROM (
        SELECT session_id, {S.collapse('m.content')} AS clean FROM fx_sessions s JOIN {FIRST_USER} m USING (session_id) WHERE s.title = 'New chat')))""")
def _(t):
    return ss.backfill_titles(t.sessions, t.messages).select("session_id", "title")


@query("ses9_backfill_session_projects", f"""WITH leg AS (SELECT session_id, owner_id, lower(project_scope) AS nn FROM fx_sessions WHERE project_scope IS NOT NULL AND conv_id % 2 = 1)
    SELECT l.session_id, {S.uuid5("concat('project:', l.owner_id, ':', l.nn)")} AS project_id FROM leg l""")
def _(t):
    legacy = t.sessions.withColumn("project_id", F.when(c("conv_id") % 2 == 0, c("project_id")))
    named = legacy.withColumn("project_scope", F.when((c("conv_id") % 2 == 1), c("project_scope")))
    return ss.backfill_session_projects(named, t.projects)[1].select("session_id", "project_id")


@query("ses10_history", "SELECT m.message_id, m.turn_index FROM fx_messages m JOIN fx_sessions s USING (session_id) WHERE s.conv_id % 3 <> 0")
def _(t):
    asked = t.sessions.select("session_id", F.when(c("conv_id") % 3 == 0, "other").otherwise(c("owner_id")).alias("owner_id"))
    return ss.history(t.messages, t.sessions, asked).select("message_id", "turn_index")


