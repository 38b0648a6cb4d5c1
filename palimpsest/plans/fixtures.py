"""Domain views over the given tables.

Each view re-reads whole tables, so work grows with them.  Derived attributes
(scope, session, project) are assigned by simple arithmetic on the row's id.
"""

from __future__ import annotations

import hashlib
import re

from palimpsest import schemas
from palimpsest.plans.dialect import OracleDialect, SparkDialect
from palimpsest.plans.records import FLAT_PREFIXES, with_payload
from palimpsest.session import dealt, path_exists, shared_folder

NOW = "2024-01-20 00:00:00"
EPOCH = "TIMESTAMP '2024-01-01 00:00:00'"
# A task derives the records of about so many bytes of events.
EVENT_BYTES = 1 << 20

VIEWS = {}


def view(fn):
    VIEWS[fn.__name__] = fn
    return fn


def _id(prefix, n):
    return f"concat('{prefix}', lpad(CAST({n} AS STRING), 9, '0'))"


def _modality(n):
    return f"(CASE {n} % 10 WHEN 7 THEN 'table' WHEN 8 THEN 'image' WHEN 9 THEN 'video' ELSE 'text' END)"


# --- documents: assets, bindings, evidence, vectors --------------------------

@view
def fx_assets(d):
    return f"""SELECT {d.sha256('text')} AS asset_id, min(doc_id) AS first_doc, min(source) AS owner_id,
        concat('doc', min(doc_id), '.txt') AS filename, 'text/plain' AS media_type, min(text) AS content,
        concat(CASE WHEN min(doc_id) % 4 = 0 THEN 'http://host/' ELSE 'file:///data/' END, min(doc_id)) AS raw_file_uri,
        {d.minutes(EPOCH, 'min(doc_id)')} AS created_at
        FROM {d.table('documents')} GROUP BY {d.sha256('text')}"""


@view
def fx_bindings(d):
    return f"""SELECT doc_id AS binding_id, {d.sha256('text')} AS asset_id, source AS owner_id,
        CASE WHEN doc_id % 2 = 0 THEN 'session' ELSE 'project' END AS scope,
        CASE WHEN doc_id % 2 = 0 THEN concat('s', doc_id % 5) END AS session_id,
        CASE WHEN doc_id % 2 = 1 THEN concat('p', doc_id % 3) END AS project_id,
        {d.minutes(EPOCH, 'doc_id')} AS created_at FROM {d.table('documents')}"""


@view
def fx_evidence(d):
    return f"""SELECT concat('ev-', first_doc) AS evidence_id, asset_id, first_doc, {_modality('first_doc')} AS modality,
        'text' AS representation, content, raw_file_uri AS media_uri, filename AS source_name,
        CAST(first_doc % 9 + 1 AS INT) AS page, 'native' AS parser_backend, '1' AS parser_version, created_at
        FROM fx_assets"""


@view
def fx_runs(d):
    """Up to three ingestion runs per binding."""
    return f"""SELECT concat('run-', doc_id, '-', n) AS run_id, asset_id, doc_id AS binding_id, 'pdf' AS modality,
        CASE (doc_id + n) % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' WHEN 2 THEN 'processing' ELSE 'pending' END AS status,
        CAST(n_chars % 17 AS INT) AS chunk_count, CAST(NULL AS STRING) AS error,
        {d.minutes(EPOCH, 'doc_id % 1000 * 10 + n')} AS created_at
        FROM (SELECT doc_id, n_chars, {d.sha256('text')} AS asset_id, {d.each_up_to('doc_id % 3')} AS n FROM {d.table('documents')}) b"""


@view
def fx_points(d):
    """Points: one per binding; those without an embedding are found by their terms only."""
    return f"""SELECT b.doc_id AS point_id, concat('ev-', a.first_doc) AS evidence_id, b.doc_id AS binding_id,
        b.source AS owner_id, CASE WHEN b.doc_id % 2 = 0 THEN 'session' ELSE 'project' END AS scope,
        CASE WHEN b.doc_id % 2 = 0 THEN concat('s', b.doc_id % 5) END AS session_id,
        CASE WHEN b.doc_id % 2 = 1 THEN concat('p', b.doc_id % 3) END AS project_id,
        CASE {_modality('b.doc_id')} WHEN 'video' THEN 'video_segment' ELSE {_modality('b.doc_id')} END AS collection,
        b.text AS content, v.embedding
        FROM {d.table('documents')} b JOIN fx_assets a ON a.asset_id = {d.sha256('b.text')}
        LEFT JOIN {d.table('embeddings')} v ON v.vec_id = b.doc_id"""


@view
def fx_queries(d):
    return f"""SELECT concat('q', q.item_id) AS query_id, q.item_id, q.text,
        concat('src', q.item_id % 20) AS owner_id, concat('s', q.item_id % 5) AS session_id,
        CASE WHEN q.item_id % 4 < 3 THEN concat('p', q.item_id % 3) END AS project_id, v.embedding
        FROM {d.table('benchmark')} q JOIN {d.table('embeddings')} v ON v.vec_id = q.item_id"""


# --- conversations: sessions, messages, turns --------------------------------

@view
def fx_sessions(d):
    return f"""SELECT concat('c', conv_id) AS session_id, concat('u', conv_id % 150) AS owner_id, conv_id,
        CASE WHEN conv_id % 3 = 0 THEN 'New chat' ELSE concat('Chat ', conv_id) END AS title,
        CASE WHEN conv_id % 4 < 3 THEN concat('p', conv_id % 3) END AS project_id,
        CASE WHEN conv_id % 4 < 3 THEN concat('Project ', conv_id % 3) END AS project_scope,
        {d.minutes(EPOCH, 'conv_id')} AS created_at, {d.minutes(EPOCH, 'conv_id * 7 % 5000')} AS updated_at
        FROM {d.table('conversations')} GROUP BY conv_id"""


@view
def fx_messages(d):
    return f"""SELECT concat('m', conv_id, '-', turn) AS message_id, concat('c', conv_id) AS session_id, conv_id,
        CAST(turn AS INT) AS turn_index, role, text AS content,
        CASE WHEN role = 'assistant' THEN concat('t', conv_id, '-', turn) END AS trace_id,
        {d.minutes(EPOCH, 'conv_id + turn')} AS created_at
        FROM {d.table('conversations')} WHERE role IN ('user', 'assistant')"""


@view
def fx_turns(d):
    """User turns with their chat's visibility; some name an identifier."""
    return f"""SELECT m.message_id AS query_id, m.session_id, m.turn_index, s.owner_id, s.project_id, s.project_scope,
        m.conv_id, concat(m.content, CASE WHEN m.conv_id % 4 <> 3 THEN concat(' Please check EV-', 100 + m.conv_id % 2, '.')
                                ELSE '' END) AS text
        FROM fx_messages m JOIN fx_sessions s ON s.session_id = m.session_id WHERE m.role = 'user'"""


# --- events: memories, relationships, access ----------------------------------

@view
def fx_memories(d):
    ref = lambda scheme, value, norm, conf: d.struct(
        scheme=scheme, value=value, normalized_value=norm, mention=value, confidence=conf)
    claim = lambda a, v, n: d.struct(attribute=a, value=v, normalized_value=n, confidence="0.75")
    none_ref, none_claim = d.empty(schemas.IDENTIFIER), d.empty(schemas.CLAIM)
    ext = ref("'external_reference'", "concat('EV-', 100 + k % 2)", "concat('ev', 100 + k % 2)", "0.9")
    inv = ref("'invoice_number'", "concat('INV-', k % 10)", "concat('inv', k % 10)", "0.8")
    return f"""SELECT {_id('mem-', 'event_id')} AS memory_id, event_id, user_id, k,
        concat('u', user_id) AS owner_id,
        CASE WHEN event_id % 23 = 0 THEN 'user' WHEN event_id % 5 < 2 THEN 'session' ELSE 'project' END AS scope,
        concat('c', user_id + 150 * (event_id % 3)) AS session_id,
        CASE WHEN event_id % 5 < 4 THEN concat('p', event_id % 3) END AS project_id,
        concat('Project ', event_id % 3) AS project_scope, kind,
        CASE event_id % 6 WHEN 0 THEN 'candidate' WHEN 4 THEN 'superseded'
             WHEN 5 THEN (CASE event_id % 4 WHEN 1 THEN 'rejected' WHEN 3 THEN 'expired' ELSE 'deleted' END)
             ELSE 'active' END AS status,
        value / (value + 5.0) AS confidence, event_id % 11 <> 0 AS user_confirmed,
        {d.array("concat('ref', k)", "concat('ref', k % 3)")} AS evidence_refs,
        concat('turn', event_id % 997) AS source_turn_id, ts AS valid_from,
        CASE WHEN event_id % 3 = 0 THEN {d.hours('ts', '168')} END AS valid_to,
        ts AS created_at, {d.hours('ts', 'k')} AS updated_at,
        concat('user ', user_id) AS know_subject, 'viewed' AS know_predicate, concat('item ', k) AS know_object,
        concat('style ', k % 7) AS pref_behavior,
        CASE WHEN k % 2 = 0 THEN {d.array("concat('cond ', k % 5)", "'weekday'")} ELSE {d.empty('string')} END AS pref_conditions,
        concat('problem ', k) AS sol_problem, {d.map("'os'", "concat('v', k % 3)")} AS sol_environment,
        {d.array("'open'", "concat('step ', k % 4)")} AS sol_steps,
        CASE WHEN k % 3 = 0 THEN 'fixed' END AS sol_outcome,
        concat('Account ', user_id) AS ent_name, 'account' AS ent_type, {d.array("concat('acct', user_id)")} AS ent_aliases,
        CASE k % 3 WHEN 0 THEN 'Delivery Delay' WHEN 1 THEN 'Shipment' ELSE 'price change' END AS ev_type_raw,
        concat('Order update ', k % 6, ' for the depot') AS ev_summary,
        {d.array("concat('order EV-', 100 + k % 2)", "concat('Carrier ', k % 3)")} AS ev_entities,
        {d.array("concat('Depot ', k % 2)")} AS ev_locations,
        CASE WHEN k % 5 < 4 THEN (CASE WHEN k % 2 = 0 THEN 'Friday' ELSE 'Monday' END) END AS ev_time,
        CASE WHEN event_id % 4 = 0 THEN {none_ref} WHEN event_id % 4 = 1 THEN {d.array(ext, inv)}
             ELSE {d.array(ext)} END AS ev_refs,
        CASE WHEN event_id % 6 < 4 THEN {d.array(
            claim("' Amount'", "concat('USD ', k % 3)", "concat('usd ', k % 3)"),
            claim("'Status'", "CASE WHEN k % 2 = 0 THEN 'Open' ELSE 'Late' END",
                  "CASE WHEN k % 2 = 0 THEN 'open' ELSE 'late' END"))}
             ELSE {none_claim} END AS ev_claims
        FROM (SELECT event_id, user_id, ts, value, {d.json_int('props', 'k')} AS k,
                CASE event_type WHEN 'error' THEN 'event' WHEN 'click' THEN 'preference' WHEN 'view' THEN 'knowledge'
                     WHEN 'signup' THEN 'entity' ELSE 'solution' END AS kind
              FROM {d.table('events')}) e"""


@view
def fx_relationships(d):
    """Edges to the next memory of the same place, and some arbitrary ones."""
    return f"""SELECT event_id AS relationship_id, memory_id AS from_memory_id,
        CASE WHEN event_id % 4 = 0 THEN {_id('mem-', 'CAST(floor((event_id * 7 + 3) / 10) AS BIGINT)')} ELSE next_id END AS to_memory_id,
        CASE event_id % 5 WHEN 3 THEN 'contradiction' WHEN 4 THEN 'superseded_by' ELSE 'related' END AS relationship_type,
        created_at FROM (
          SELECT event_id, memory_id, created_at, lead(memory_id) OVER (PARTITION BY owner_id, scope,
            CASE WHEN scope = 'session' THEN session_id ELSE coalesce(project_id, project_scope) END,
            project_id IS NULL ORDER BY event_id) AS next_id
          FROM fx_memories) r
        WHERE event_id % 4 = 0 OR next_id IS NOT NULL"""


@view
def fx_subject_identifiers(d):
    """Known identifiers of subjects, one subject per place and external reference."""
    return f"""SELECT concat('subj-', min(memory_id)) AS subject_id, owner_id, scope, scope_key,
        'external_reference' AS scheme, concat('ev', 100 + k % 2) AS normalized_value FROM (
          SELECT memory_id, owner_id, scope, k, CASE WHEN scope = 'session' THEN concat('session:', session_id)
              WHEN scope = 'project' AND project_id IS NOT NULL THEN concat('project:', project_id)
              WHEN scope = 'project' THEN concat('project-name:', lower(project_scope)) ELSE scope END AS scope_key
          FROM fx_memories WHERE kind = 'event' AND event_id % 4 <> 0 AND event_id % 3 <> 0) m
        GROUP BY owner_id, scope, scope_key, k % 2"""


@view
def fx_memory_vectors(d):
    return f"""SELECT m.memory_id, v.embedding FROM fx_memories m
        JOIN {d.table('embeddings')} v ON v.vec_id = m.event_id % 200"""


@view
def fx_turn_vectors(d):
    return f"""SELECT q.query_id, v.embedding FROM fx_turns q
        JOIN {d.table('embeddings')} v ON v.vec_id = (q.conv_id * 8 + q.turn_index) % 200"""


@view
def fx_memory_subjects(d):
    """Subject of each event; some events belong to the subject of another identifier."""
    return """SELECT m.memory_id, s.subject_id FROM (SELECT *, CASE WHEN scope = 'session' THEN concat('session:', session_id)
              WHEN scope = 'project' AND project_id IS NOT NULL THEN concat('project:', project_id)
              WHEN scope = 'project' THEN concat('project-name:', lower(project_scope)) ELSE scope END AS scope_key FROM fx_memories) m
        JOIN fx_subject_identifiers s ON s.owner_id = m.owner_id AND s.scope = m.scope AND s.scope_key = m.scope_key
          AND s.normalized_value = concat('ev', 100 + (m.k + m.event_id % 2) % 2)
        WHERE m.kind = 'event'"""


@view
def fx_access(d):
    """Access log: which memories were retrieved for and injected into an answer."""
    return f"""SELECT o.o_orderkey AS access_event_id, concat('t', o.o_orderkey % 997) AS trace_id,
        concat('c', o.o_custkey % 100) AS session_id, {_id('mem-', 'o.o_custkey')} AS memory_id,
        CASE WHEN o.o_orderstatus = 'P' THEN 'retrieved' ELSE 'injected' END AS event_type,
        CAST(o.o_orderkey % 5 + 1 AS INT) AS rank, o.o_totalprice / 1000000.0 AS score, o.o_orderdate AS created_at
        FROM {d.table('orders')} o"""


@view
def fx_turn_access(d):
    """Memories injected into each assistant answer of a chat."""
    return f"""SELECT r.event_id * 10 + m.turn_index AS access_event_id, m.trace_id, m.session_id,
        r.memory_id, CASE WHEN r.event_id % 5 = 0 THEN 'retrieved' ELSE 'injected' END AS event_type,
        CAST(r.event_id % 4 + 1 AS INT) AS rank, m.created_at
        FROM fx_messages m JOIN fx_sessions s ON s.session_id = m.session_id
        JOIN fx_memories r ON r.owner_id = s.owner_id AND r.k % 8 = m.turn_index % 8
        WHERE m.role = 'assistant'"""


@view
def fx_conflicts(d):
    return f"""SELECT event_id AS conflict_id, memory_id AS incoming_memory_id,
        {_id('mem-', 'CAST(floor((event_id * 7 + 3) / 10) AS BIGINT)')} AS existing_memory_id, 'claim_mismatch' AS conflict_type,
        CASE WHEN event_id % 3 = 0 THEN 'resolved' ELSE 'open' END AS status,
        concat('note ', k) AS details, created_at
        FROM fx_memories WHERE kind = 'event'"""


@view
def fx_latency(d):
    return f"""SELECT value AS duration_ms, CASE WHEN event_id % 13 = 0 THEN 'error' ELSE 'ok' END AS outcome,
        CASE WHEN user_id % 2 = 0 THEN 'projection' ELSE 'retrieval' END AS pipeline, event_type AS stage,
        concat('run', user_id % 40) AS run_id, CASE WHEN event_id % 3 = 0 THEN concat('t', event_id % 50) END AS trace_id
        FROM {d.table('events')}"""


@view
def fx_commands(d):
    """One owner command per memory."""
    return f"""SELECT memory_id, CASE WHEN event_id % 9 = 0 THEN 'u0' ELSE owner_id END AS actor_id, event_id,
        CASE event_id % 4 WHEN 0 THEN 'confirm' WHEN 1 THEN 'reject' WHEN 2 THEN 'expire' ELSE 'archive' END AS action
        FROM fx_memories"""


# --- customers: projects ------------------------------------------------------

@view
def fx_project_requests(d):
    return f"""SELECT c_custkey AS request_id, concat('u', c_custkey % 150) AS owner_id,
        CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN concat('  ', lower(c_mktsegment))
             ELSE concat(c_mktsegment, '  Team ') END AS name,
        {d.minutes(EPOCH, 'c_custkey')} AS requested_at FROM {d.table('customer')}"""


@view
def fx_projects(d):
    norm = "lower(trim(regexp_replace(name, '  +', ' '{g})))".replace("{g}", ", 'g'" if isinstance(d, OracleDialect) else "")
    return f"""SELECT concat('p', min(request_id)) AS project_id, owner_id, {norm} AS normalized_name,
        concat('Project of ', {norm}) AS name, min(requested_at) AS created_at, min(requested_at) AS updated_at,
        CASE WHEN min(request_id) % 10 = 0 THEN min(requested_at) END AS archived_at
        FROM fx_project_requests WHERE request_id % 2 = 0 GROUP BY owner_id, {norm}"""


@view
def fx_memberships(d):
    return """SELECT project_id, owner_id, 'owner' AS role FROM fx_projects
        UNION ALL SELECT project_id, concat('u', CAST(substr(project_id, 2) AS BIGINT) % 149), 'member' FROM fx_projects
        WHERE concat('u', CAST(substr(project_id, 2) AS BIGINT) % 149) <> owner_id"""


@view
def fx_session_moves(d):
    """Requests to put a chat into a project, by id or by name."""
    return f"""SELECT session_id, owner_id, conv_id,
        CASE WHEN conv_id % 3 = 0 THEN concat('p', conv_id * 2) END AS project_id,
        CASE WHEN conv_id % 3 = 1 THEN (CASE WHEN conv_id % 2 = 0 THEN ' Building' ELSE 'machinery ' END) END AS project_name
        FROM fx_sessions"""


# --- lineitem: job queue --------------------------------------------------------

@view
def fx_job_feed(d):
    """Enqueue requests; the same (memory, target) is requested many times."""
    return f"""SELECT {_id('mem-', 'l_orderkey')} AS memory_id,
        CASE WHEN l_linestatus = 'F' THEN 'graph' ELSE 'vector' END AS target,
        {d.hours('l_shipdate', 'l_partkey % 1000')} AS updated_at FROM {d.table('lineitem')}"""


@view
def fx_jobs(d):
    return f"""SELECT {d.sha256("concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)")} AS job_id,
        {_id('mem-', 'l_orderkey')} AS memory_id, CASE WHEN l_linestatus = 'F' THEN 'graph' ELSE 'vector' END AS target,
        CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'pending' ELSE 'running' END AS status,
        CAST(l_linenumber AS INT) AS attempts, CASE WHEN l_returnflag = 'R' THEN 'timeout' END AS error,
        CASE WHEN l_returnflag = 'N' THEN {d.hours('l_shipdate', 'l_partkey % 1000')} END AS locked_at,
        CASE WHEN l_returnflag = 'N' THEN concat('w', l_suppkey % 4) END AS locked_by, l_shipdate AS updated_at
        FROM {d.table('lineitem')}"""


# --- pages: layout items, routed pages, captions ---------------------------------

@view
def fx_layout_items(d):
    """Reading-order items of parsed pages, one per line of a document."""
    lines = ("posexplode(split(text, '\\n')) AS (seq, line)" if not isinstance(d, OracleDialect) else
             "unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq")
    return f"""SELECT doc_id, CAST(seq AS INT) AS seq, line AS text, CAST(floor(seq / 40) AS INT) + 1 AS page,
        CASE WHEN (doc_id + seq) % 11 = 0 THEN 'SectionHeaderItem' WHEN (doc_id + seq) % 7 = 0 THEN 'PictureItem'
             WHEN (doc_id + seq) % 5 = 0 THEN 'ListItem' ELSE 'TextItem' END AS item_type
        FROM (SELECT doc_id, {lines} FROM {d.table('documents')}) x"""


@view
def fx_pdf_pages(d):
    """Pages of ten-page files: native text, visual share, recognised text."""
    return f"""SELECT concat('pdf', CAST(floor(doc_id / 10) AS BIGINT)) AS asset_id, CAST(doc_id % 10 + 1 AS INT) AS page,
        CASE WHEN doc_id % 6 = 5 THEN concat('Page ', doc_id) ELSE text END AS native_text,
        CASE WHEN doc_id % 12 = 11 THEN 0.001 ELSE 0.2 END AS visual_ratio,
        doc_id % 97 = 96 AS read_failed,
        CASE WHEN doc_id % 18 = 5 THEN text ELSE concat('fig ', doc_id) END AS ocr_text
        FROM {d.table('documents')}"""


def _dependencies(sql: str) -> list[str]:
    return [name for name in dict.fromkeys(re.findall(r"\bfx_\w+", sql)) if name in VIEWS]


def _with_clause(sql: str, dialect, stored: dict[str, str] | None = None) -> str:
    """All views used by ``sql``, directly or not, as common table expressions.

    ``stored`` names views that are read from a written table instead.
    """
    ordered: dict[str, str] = {}

    def add(name):
        if name in ordered:
            return
        body = (stored or {}).get(name) or VIEWS[name](dialect)
        for needed in _dependencies(body):
            add(needed)
        ordered[name] = body

    for name in _dependencies(sql):
        add(name)
    return ", ".join(f"{name} AS ({body})" for name, body in ordered.items())


def oracle(sql: str) -> str:
    """Complete oracle statement: used views first, then the query."""
    views = _with_clause(sql, OracleDialect())
    body = sql.strip()
    if not views:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {views}, {body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {views}, {body[5:]}"
    return f"WITH {views} {body}"


_WRITTEN: dict[tuple[str, str], str] = {}


class Tables:
    """The given tables and the views over them, as DataFrames.

    Memory records are kept the way a deployment keeps them: as a Parquet
    snapshot with the declared schema, derived once per application from the
    events table.  Operators then read the columns they need.
    """

    def __init__(self, spark, folder: str):
        self.spark, self.folder, self._known = spark, folder.rstrip("/"), {}

    def table(self, name):
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name, stored=None):
        dialect = SparkDialect(self.folder)
        body = VIEWS[name](dialect)
        views = _with_clause(body, dialect, stored)
        return self.spark.sql(f"WITH {views} {body}" if views else body)

    def _snapshot(self) -> str:
        key = (self.spark.sparkContext.applicationId, self.folder)
        path = _WRITTEN.get(key)
        if path is None or not path_exists(self.spark, path + "/_SUCCESS"):
            path = f"{shared_folder(self.spark)}/memory-records-{hashlib.md5(self.folder.encode()).hexdigest()}"
            with_payload(self._derived_memories(), keep_flat=True).write.mode("overwrite").parquet(path)
            _WRITTEN[key] = path
        return path

    def _derived_memories(self):
        """``fx_memories`` over events dealt out first: a record takes far longer than its event, and few row groups hold all events."""
        dialect = SparkDialect(self.folder)
        name = f"dealt_events_{hashlib.md5(self.folder.encode()).hexdigest()}"
        dealt(self.table("events"), EVENT_BYTES).createOrReplaceTempView(name)
        return self.spark.sql(VIEWS["fx_memories"](dialect).replace(dialect.table("events"), name))

    def __getattr__(self, name):
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._known:
            self._known[name] = self._load(name)
        return self._known[name]

    def _load(self, name):
        if name == "memories":
            return self.spark.read.parquet(self._snapshot()).drop("payload")
        if name == "records":
            typed = self.spark.read.parquet(self._snapshot())
            return typed.select(*[column for column in typed.columns if not column.startswith(FLAT_PREFIXES)])
        view = "fx_" + name
        if view not in VIEWS:
            return self.table(name)
        uses_memories = "fx_memories" in _with_clause(VIEWS[view](SparkDialect(self.folder)), SparkDialect(self.folder))
        stored = {"fx_memories": f"SELECT * FROM parquet.`{self._snapshot()}`"} if uses_memories else None
        return self.view(view, stored)
