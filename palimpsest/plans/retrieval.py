"""Hybrid retrieval over documents and memories, and the memory context of a turn."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest import constants as C
from palimpsest.functions import keys, numeric, payload as pl, scope as sc, text as tx
from palimpsest.operators import context as cx, evidence as ev, graph, hybrid, identifiers as ids, jobs, lifecycle as lc, ordered, search, subjects
from palimpsest.operators.skew import among
from palimpsest.plans import sqlparts as S
from palimpsest.plans.fixtures import NOW
from palimpsest.plans.registry import query
from palimpsest.plans.relational import EDGES_SQL, MEM_POINTS
from palimpsest.session import cut_lineage, spread

c = F.col
TERM = "'[\\p{L}\\p{N}]+'"


# --- oracle building blocks --------------------------------------------------------------

def hybrid_sql(p, q, d, on, k, collection="d.collection"):
    """Common table expressions of a hybrid search; the fused list is ``{p}fu``."""
    return f"""{p}q AS ({q}), {p}d AS ({d}),
    {p}v AS (SELECT q.query_id, {collection} AS collection, d.id, q.v AS qv, d.v AS dv FROM {p}q q JOIN {p}d d ON {on}),
    {p}de AS (SELECT query_id, collection, id, score, row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, id) AS dense_rank FROM (
        SELECT query_id, collection, id, round(list_cosine_similarity(CAST(qv AS DOUBLE[]), CAST(dv AS DOUBLE[])), 6) AS score FROM {p}v WHERE dv IS NOT NULL) QUALIFY dense_rank <= {k}),
    {p}qt AS (SELECT query_id, term, count(*) AS w FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), {TERM})) AS term FROM {p}q) GROUP BY ALL),
    {p}dt AS (SELECT id, term, count(*) AS w FROM (SELECT id, unnest(regexp_extract_all(lower(text), {TERM})) AS term FROM {p}d) GROUP BY ALL),
    {p}dot AS (SELECT query_id, id, sum(a.w * b.w) AS score FROM {p}qt a JOIN {p}dt b USING (term) GROUP BY ALL),
    {p}sp AS (SELECT query_id, collection, id, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, id) AS sparse_rank
        FROM {p}v JOIN {p}dot USING (query_id, id) QUALIFY sparse_rank <= {k}),
    {p}fu AS (SELECT query_id, collection, id, score, row_number() OVER (PARTITION BY query_id, collection ORDER BY round(score, 9) DESC, dr ASC NULLS LAST, sr ASC NULLS LAST, id) AS rank FROM (
        SELECT query_id, collection, id, dr, sr, CASE WHEN dr IS NULL THEN 0 ELSE CAST(1 AS DOUBLE) / (60 + dr) END + CASE WHEN sr IS NULL THEN 0 ELSE CAST(1 AS DOUBLE) / (60 + sr) END AS score FROM (
          SELECT query_id, collection, id, min(dense_rank) AS dr, min(sparse_rank) AS sr FROM (SELECT query_id, collection, id, dense_rank, NULL AS sparse_rank FROM {p}de
            UNION ALL SELECT query_id, collection, id, NULL, sparse_rank FROM {p}sp) GROUP BY ALL)) QUALIFY rank <= {k})"""


WEIGHT = "CASE collection WHEN 'image' THEN 0.8 WHEN 'video_segment' THEN 0.7 ELSE 1.0 END"
POSITION = "list_position(['text', 'table', 'image', 'video_segment'], collection)"


def across_sql(p, k):
    return f"""{p}ac AS (SELECT query_id, collection, id, score, xr AS rank FROM (SELECT query_id, collection, id, score * CAST({WEIGHT} AS DOUBLE) AS score, row_number() OVER (PARTITION BY query_id
        ORDER BY round(score * CAST({WEIGHT} AS DOUBLE), 9) DESC, {POSITION}, rank, id) AS xr FROM {p}fu QUALIFY xr <= {k}))"""


# --- whole-corpus search ---------------------------------------------------------------------

ALL_Q = "SELECT query_id, text, embedding AS v FROM fx_queries"
ALL_D = "SELECT doc_id AS id, 'documents' AS collection, text, e.embedding AS v FROM documents LEFT JOIN embeddings e ON e.vec_id = doc_id"
ALL = hybrid_sql("g", ALL_Q, ALL_D, "true", 20)


def global_queries(t):
    return t.queries.select("query_id", tx.without_urls(c("text")).alias("text"), c("embedding").alias("vector"), F.lit(search.EVERYWHERE).alias("place"))


def global_vectors(t):
    of_documents = t.embeddings.join(t.documents.select(c("doc_id").alias("vec_id")), "vec_id", "left_semi")
    return of_documents.select(c("vec_id").alias("id"), F.lit("documents").alias("collection"), c("embedding").alias("vector"), F.lit(search.EVERYWHERE).alias("place"))


def global_texts(t):
    return t.documents.select(c("doc_id").alias("id"), F.lit("documents").alias("collection"), "text", F.lit(search.EVERYWHERE).alias("place"))


def global_fused(t, k):
    return hybrid.fuse(search.dense_top(global_queries(t), global_vectors(t), k), search.sparse_top(global_queries(t), global_texts(t), k), k)


@query("ret1_dense_knn", f"WITH {ALL} SELECT query_id, id, score, dense_rank AS rank FROM gde")
def _(t):
    return search.dense_top(global_queries(t), global_vectors(t), 20).select("query_id", "id", "score", c("dense_rank").cast("long").alias("rank"))


@query("ret2_sparse_encode", f"SELECT doc_id, term, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), {TERM})) AS term FROM documents) GROUP BY ALL")
def _(t):
    encoded = search.encode_terms(spread(t.documents), "text")
    return encoded.select("doc_id", F.explode(F.arrays_zip("terms", "weights")).alias("x")).select("doc_id", c("x.terms").alias("term"), c("x.weights").alias("weight"))


@query("ret2_sparse_saturated", f"""SELECT doc_id, term, round(n * 2.2 / (n + 1.2 * (1 - 0.75 + 0.75 * total / 100.0)), 6) AS weight FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total FROM (SELECT doc_id, term, CAST(count(*) AS DOUBLE) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), {TERM})) AS term FROM documents) GROUP BY doc_id, term))""")
def _(t):
    encoded = search.encode_terms(spread(t.documents), "text", k1=1.2, b=0.75, mean_terms=100)
    rows = encoded.select("doc_id", F.explode(F.arrays_zip("terms", "weights")).alias("x"))
    return rows.select("doc_id", c("x.terms").alias("term"), F.round("x.weights", 6).alias("weight"))


SCOPED_Q = "SELECT query_id, text, embedding AS v, owner_id, session_id, project_id FROM fx_queries"
SCOPED_D = "SELECT point_id AS id, collection, content AS text, embedding AS v, owner_id, scope, session_id, project_id FROM fx_points"
SCOPED = hybrid_sql("s", SCOPED_Q, SCOPED_D, S.evidence_visible("d", "q"), 20)


@query("ret3_sparse_dot", f"WITH {SCOPED} SELECT query_id, collection, id, score FROM ssp")
def _(t):
    return search.sparse_top(hybrid.placed_queries(t.queries), hybrid.placed_points(t.points), 20).select("query_id", "collection", "id", "score")


@query("ret4_rrf_fusion", f"WITH {ALL} SELECT query_id, id, round(score, 9) AS score, rank FROM gfu WHERE rank <= 6")
def _(t):
    fused = global_fused(t, 20).where(c("rank") <= 6)
    return fused.select("query_id", "id", F.round("score", 9).alias("score"), c("rank").cast("long").alias("rank"))


@query("ret5_collection_search", f"WITH {SCOPED}, {across_sql('s', 20)} SELECT query_id, collection, id, round(score, 9) AS score, rank FROM sac")
def _(t):
    hits = hybrid.search_collections(hybrid.placed_queries(t.queries), hybrid.placed_points(t.points), 20)
    out = hybrid.across_collections(hits, 20)
    return out.select("query_id", "collection", "id", F.round("score", 9).alias("score"), c("rank").cast("long").alias("rank"))


CAND = f"WITH {SCOPED}, {across_sql('s', 20)}, cand AS (SELECT a.query_id, p.evidence_id, p.binding_id, a.rank, a.score FROM sac a JOIN fx_points p ON p.point_id = a.id)"


@query("ret6_scoped_candidates", f"{CAND} SELECT query_id, evidence_id, binding_id, rank FROM cand")
def _(t):
    return hybrid.retrieve_candidates(t.queries, t.points).select("query_id", "evidence_id", "binding_id", c("rank").cast("long").alias("rank"))


def terms_of(x):
    return f"list_distinct(regexp_extract_all(lower({x}), {TERM}))"


RERANKED = f"""{CAND}, auth AS (SELECT x.*, e.content, e.page, e.source_name, e.media_uri, row_number() OVER (PARTITION BY x.query_id, x.evidence_id ORDER BY x.rank, x.binding_id) AS rn, q.text AS question FROM cand x
      JOIN fx_evidence e USING (evidence_id) JOIN fx_bindings b ON b.binding_id = x.binding_id AND b.asset_id = e.asset_id JOIN fx_queries q ON q.query_id = x.query_id AND {S.evidence_visible('b', 'q')}),
    rr AS (SELECT *, CAST(len(list_intersect({terms_of('question')}, {terms_of('content')})) AS DOUBLE) AS rerank_score FROM auth WHERE rn = 1),
    top AS (SELECT query_id, evidence_id, binding_id, content, page, source_name, media_uri, rerank_score, xr AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank, evidence_id) AS xr FROM rr) WHERE xr <= 6)"""


@query("ret7_retrieve", f"{RERANKED} SELECT query_id, string_agg(concat('[Source ', rank, ' (page ', page, ')]', chr(10), content), chr(10) || chr(10) ORDER BY rank) AS context FROM top GROUP BY 1")
def _(t):
    return hybrid.context(hybrid.retrieve(t.queries, t.points, t.evidence, t.bindings))


@query("top10_rerank", f"{RERANKED} SELECT query_id, evidence_id, rerank_score, rank FROM top")
def _(t):
    found = hybrid.retrieve(t.queries, t.points, t.evidence, t.bindings)
    return found.select("query_id", "evidence_id", "rerank_score", c("rank").cast("long").alias("rank"))


@query("prj11_sources", f"""{RERANKED} SELECT query_id, rank AS source_index, evidence_id, source_name, CASE WHEN media_uri LIKE 'http%' THEN media_uri
    ELSE concat('/api/documents/bindings/', binding_id, '/source?session_id=', (SELECT session_id FROM fx_queries z WHERE z.query_id = top.query_id)) END AS source_url FROM top""")
def _(t):
    found = hybrid.retrieve(t.queries, t.points, t.evidence, t.bindings).withColumnRenamed("media_uri", "raw_file_uri")
    cited = ev.sources(found.join(t.queries.select("query_id", "session_id"), "query_id"))
    return cited.select("query_id", c("source_index").cast("long").alias("source_index"), "evidence_id", "source_name", "source_url")


def subquery_plans(t):
    """Two halves of every question as its supplied sub-queries."""
    half = F.floor(F.length("text") / 2).cast("int")
    parts = F.array(F.substring(c("text"), F.lit(1), half), F.substring(c("text"), half + 1, F.length("text")))
    asked = t.queries.withColumn("text", F.concat("text", F.lit(" compare this? Why?")))
    # a plan of four is not a plan, so its question is asked as it is
    whole = F.when(c("item_id") % 4 == 3, F.concat(parts, parts)).otherwise(parts)
    return asked, t.queries.select("query_id", whole.alias("subqueries"))


DEC_Q = f"""SELECT concat(query_id, '#', i) AS query_id, query_id AS base, i, CASE WHEN item_id % 4 = 3 THEN part ELSE {S.collapse('part')} END AS text, embedding AS v, owner_id, session_id, project_id FROM (
    SELECT *, unnest(CASE WHEN item_id % 4 = 3 THEN [0] ELSE [0, 1] END) AS i, CASE WHEN item_id % 4 = 3 THEN concat(text, ' compare this? Why?') WHEN i = 0 THEN substr(text, 1, CAST(floor(length(text) / 2) AS INT)) ELSE substr(text, CAST(floor(length(text) / 2) AS INT) + 1) END AS part FROM fx_queries)"""
DEC = f"""WITH {hybrid_sql('s', DEC_Q, SCOPED_D, S.evidence_visible('d', 'q'), 20)}, {across_sql('s', 20)},
    cand0 AS (SELECT string_split(a.query_id, '#')[1] AS query_id, p.evidence_id, p.binding_id, CAST(string_split(a.query_id, '#')[2] AS INT) * 20 + a.rank AS rank, a.score FROM sac a JOIN fx_points p ON p.point_id = a.id),
    cand AS (SELECT * FROM cand0 QUALIFY row_number() OVER (PARTITION BY query_id, evidence_id, binding_id ORDER BY rank) = 1)"""


@query("ret8_decomposed", RERANKED.replace(CAND, DEC).replace("q.text AS question", "concat(q.text, ' compare this? Why?') AS question") + " SELECT query_id, evidence_id, rerank_score, rank FROM top")
def _(t):
    asked, plans = subquery_plans(t)
    found = hybrid.retrieve_decomposed(asked, plans, t.points, t.evidence, t.bindings)
    return found.select("query_id", "evidence_id", "rerank_score", c("rank").cast("long").alias("rank"))


@query("set4_subquery_union", f"{DEC} SELECT query_id, evidence_id, binding_id, CAST(rank AS BIGINT) AS rank FROM cand")
def _(t):
    asked, plans = subquery_plans(t)
    hits = hybrid.retrieve_candidates(hybrid.numbered_questions(hybrid.sub_questions(asked, plans)), t.points)
    merged = hybrid.whole_questions(hits, 20).withColumn("rank", c("rank").cast("long"))
    return hybrid.first_hits(merged, ["query_id", "evidence_id", "binding_id"]).select("query_id", "evidence_id", "binding_id", "rank")


@query("ret9_pair_score", f"SELECT q.query_id, p.point_id, CAST(len(list_intersect({terms_of('q.text')}, {terms_of('p.content')})) AS DOUBLE) AS score FROM fx_queries q JOIN fx_points p ON {S.evidence_visible('p', 'q')}")
def _(t):
    places = t.queries.select("query_id", "text", F.explode(sc.evidence_chat_keys()).alias("place"))
    pairs = t.points.withColumn("place", sc.binding_key()).join(places, "place")
    return pairs.select("query_id", "point_id", hybrid.overlap_score(c("text"), c("content")).alias("score"))


@query("ret10_hashed_embedding", f"""SELECT doc_id, b AS bucket, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, CAST('0x' || substr(md5(unnest(regexp_extract_all(lower(text), {TERM}))), 1, 4) AS INT) % 64 AS b FROM documents) GROUP BY ALL""")
def _(t):
    return numeric.hashed_embedding(t.documents, ["doc_id"], tx.search_terms(c("text")))


@query("top6_dense_top_k", f"WITH {SCOPED} SELECT query_id, collection, id, dense_rank FROM sde")
def _(t):
    return search.dense_top(hybrid.placed_queries(t.queries), hybrid.placed_points(t.points), 20).select("query_id", "collection", "id", c("dense_rank").cast("long").alias("dense_rank"))


@query("top7_sparse_top_k", f"WITH {ALL} SELECT query_id, id, score, sparse_rank FROM gsp")
def _(t):
    return search.sparse_top(global_queries(t), global_texts(t), 20).select("query_id", "id", "score", c("sparse_rank").cast("long").alias("sparse_rank"))


@query("top8_fused_top_k", f"WITH {SCOPED} SELECT query_id, collection, id, rank FROM sfu")
def _(t):
    hits = hybrid.search_collections(hybrid.placed_queries(t.queries), hybrid.placed_points(t.points), 20)
    return hits.select("query_id", "collection", "id", c("rank").cast("long").alias("rank"))


TEN = hybrid_sql("s", SCOPED_Q, SCOPED_D, S.evidence_visible("d", "q"), 5)


@query("top9_cross_collection", f"WITH {TEN}, {across_sql('s', 5)} SELECT query_id, collection, id, rank FROM sac")
def _(t):
    hits = hybrid.search_collections(hybrid.placed_queries(t.queries), hybrid.placed_points(t.points), 5)
    return hybrid.across_collections(hits, 5).select("query_id", "collection", "id", c("rank").cast("long").alias("rank"))


@query("set1_collection_union", f"WITH {TEN} SELECT query_id, collection, count(*) AS hits FROM sfu GROUP BY 1, 2")
def _(t):
    hits = hybrid.search_collections(hybrid.placed_queries(t.queries), hybrid.placed_points(t.points), 5)
    return hits.groupBy("query_id", "collection").agg(F.count("*").alias("hits"))


# --- memory search -------------------------------------------------------------------------------

PLACES = """SELECT query_id AS qid, concat(query_id, '#', n) AS query_id, text, v, n, owner_id, session_id, project_id, project_scope FROM (
    SELECT q.query_id, q.text, x.embedding AS v, unnest(CASE WHEN q.project_id IS NULL THEN [0] ELSE [0, 1, 2] END) AS n, q.owner_id, q.session_id, q.project_id, q.project_scope
    FROM fx_turns q JOIN fx_turn_vectors x USING (query_id))"""
MEM_D = f"""SELECT m.memory_id AS id, 'memories' AS collection, {S.memory_text('m.')} AS text, x.embedding AS v, m.owner_id, m.scope, m.session_id, m.project_id, m.project_scope
    FROM fx_memories m JOIN fx_memory_vectors x USING (memory_id) WHERE {MEM_POINTS}"""
MEM_ON = """q.owner_id = d.owner_id AND ((q.n = 0 AND d.scope = 'session' AND d.session_id = q.session_id) OR (q.n = 1 AND d.scope = 'project' AND d.project_id = q.project_id)
    OR (q.n = 2 AND d.scope = 'project' AND d.project_scope = q.project_scope))"""
MEM = f"""{hybrid_sql('m', PLACES, MEM_D, MEM_ON, 10)},
    once AS (SELECT string_split(query_id, '#')[1] AS query_id, CAST(string_split(query_id, '#')[2] AS INT) AS n, id AS memory_id, rank, score FROM mfu
      QUALIFY row_number() OVER (PARTITION BY string_split(query_id, '#')[1], id ORDER BY CAST(string_split(query_id, '#')[2] AS INT) DESC) = 1),
    sem0 AS (SELECT o.query_id, o.memory_id, o.score, r.kind, r.scope, {S.memory_text('r.')} AS memory_text, row_number() OVER (PARTITION BY o.query_id ORDER BY round(o.score, 9) DESC, o.n, o.rank, o.memory_id) AS xr
      FROM once o JOIN fx_memories r USING (memory_id) WHERE {S.valid_at('r.')}), sem AS (SELECT * EXCLUDE (xr), xr AS rank FROM sem0 WHERE xr <= 5)"""


def turn_queries(t):
    return t.turns.join(t.turn_vectors.withColumnRenamed("embedding", "vector"), "query_id").withColumn("references", tx.identifier_mentions(c("text")))


def memory_points(t, seen=None):
    """Points of the memories that some turn sees, with their vectors; a search reads them several times, so they are written once."""
    seen = seen or cx.in_sight(t.memories, t.turns)
    vectors = among(t.memory_vectors, seen, c("memory_id")).withColumnRenamed("embedding", "vector")
    return cut_lineage(jobs.memory_points(among(t.records, seen, c("memory_id"))).join(vectors, "memory_id"))


@query("ret11_memory_search", f"WITH {MEM} SELECT query_id, memory_id, round(score, 9) AS score, rank FROM sem")
def _(t):
    out = cx.search_memories(turn_queries(t), memory_points(t), NOW)
    return out.select("query_id", "memory_id", F.round("score", 9).alias("score"), c("rank").cast("long").alias("rank"))


@query("set2_place_union", f"WITH {MEM} SELECT query_id, memory_id, n AS number, rank FROM once")
def _(t):
    hits = cx.merged_places(cx.place_hits(turn_queries(t), memory_points(t), 10))
    return hits.select("query_id", "memory_id", "number", c("rank").cast("long").alias("rank"))


@query("ret12_memory_context", f"WITH {MEM} SELECT query_id, string_agg(concat('[M', rank, ' | ', kind, ' | ', scope, ']', chr(10), memory_text), chr(10) || chr(10) ORDER BY rank) AS context FROM sem GROUP BY 1")
def _(t):
    return cx.memory_context(cx.search_memories(turn_queries(t), memory_points(t), NOW))


# --- identifier candidates -----------------------------------------------------------------------------

REFS = r"""refs AS (SELECT query_id, owner_id, session_id, project_id, project_scope, unnest(list_distinct(list_transform(list_filter(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', '_', 'g'),
      '\b[A-Za-z0-9]+(?:[-_][A-Za-z0-9]+)*\b'), lambda x: (regexp_matches(x, '[A-Za-z]') AND regexp_matches(x, '[0-9]')) OR regexp_matches(x, '^[0-9]{3,}$')),
      lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')))) AS val FROM fx_turns)"""
VIS = f"vis AS (SELECT q.query_id, q.val, r.memory_id, r.updated_at, r.kind, r.ev_refs, r.ev_entities FROM refs q JOIN fx_memories r ON {S.visible('r', 'q')} WHERE {S.current('r.')})"
STAGES = f"""{REFS}, {VIS},
    st1 AS (SELECT query_id, memory_id, updated_at, count(DISTINCT val) AS n FROM (SELECT * FROM (SELECT query_id, val, memory_id, updated_at, unnest(ev_refs) AS r FROM vis WHERE kind = 'event')
      WHERE r.scheme = 'external_reference' AND r.normalized_value = val) GROUP BY 1, 2, 3),
    st2 AS (SELECT DISTINCT v.query_id, v.memory_id, v.updated_at FROM vis v JOIN fx_memory_subjects ms USING (memory_id) JOIN fx_subject_identifiers s ON s.subject_id = ms.subject_id AND s.normalized_value = v.val),
    st3 AS (SELECT DISTINCT query_id, memory_id, updated_at FROM vis WHERE kind = 'event' AND len(ev_refs) = 0 AND list_contains({S.stable_ids('ev_entities')}, val)),
    allst AS (SELECT query_id, memory_id, updated_at, 1 AS stage, n FROM st1 UNION ALL SELECT query_id, memory_id, updated_at, 2, 0 FROM st2 UNION ALL SELECT query_id, memory_id, updated_at, 3, 0 FROM st3),
    ex AS (SELECT query_id, memory_id, stage, row_number() OVER (PARTITION BY query_id ORDER BY stage, n DESC, updated_at DESC, memory_id) AS rank FROM (
      SELECT * FROM allst QUALIFY row_number() OVER (PARTITION BY query_id, memory_id ORDER BY stage) = 1) QUALIFY rank <= 5)"""


def full_memories(t):
    return t.records.join(t.memory_subjects, "memory_id", "left")


def exact_candidates(t, seen=None):
    seen = seen or cx.in_sight(t.memories, t.turns)
    records, subjects_of = (among(df, seen, c("memory_id")) for df in (t.records, t.memory_subjects))
    memories = records.join(subjects_of, "memory_id", "left")
    return ids.candidates(ids.query_references(t.turns), memories, ids.reference_rows(records), t.subject_identifiers, NOW, C.EXACT_CANDIDATES)


@query("ret13_identifier_candidates", f"WITH {STAGES} SELECT query_id, memory_id, stage, rank FROM ex")
def _(t):
    return exact_candidates(t).select("query_id", "memory_id", "stage", c("rank").cast("long").alias("rank"))


def stage_matches(t, build):
    memories = full_memories(t)
    return ids.matches(ids.query_references(t.turns), build(ids.reference_rows(memories), ids.eligible(memories, NOW)))


@query("jn9_direct_matches", f"WITH {STAGES} SELECT query_id, memory_id FROM st1")
def _(t):
    return stage_matches(t, ids.direct_index).select("query_id", "memory_id")


@query("agg1_match_counts", f"WITH {STAGES} SELECT query_id, memory_id, n AS match_count FROM st1")
def _(t):
    return stage_matches(t, ids.direct_index).select("query_id", "memory_id", "match_count")


@query("top5_match_ranking", f"WITH {STAGES} SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, updated_at DESC, memory_id) AS rank FROM st1 QUALIFY rank <= 10")
def _(t):
    order = [c("match_count").desc(), c("updated_at").desc(), c("memory_id")]
    out = ordered.top_per(stage_matches(t, ids.direct_index), ["query_id"], order, 10, "rank")
    return out.select("query_id", "memory_id", c("rank").cast("long").alias("rank"))


@query("jn10_subject_aliases", f"WITH {STAGES} SELECT query_id, memory_id FROM st2")
def _(t):
    return stage_matches(t, lambda refs, shown: ids.alias_index(t.subject_identifiers, shown)).select("query_id", "memory_id")


@query("jn11_legacy_values", f"WITH {STAGES} SELECT query_id, memory_id FROM st3")
def _(t):
    return stage_matches(t, ids.legacy_index).select("query_id", "memory_id")


@query("agg12_subject_counts", f"""SELECT m.memory_id, count(DISTINCT s.subject_id) AS subjects FROM (SELECT memory_id, owner_id, scope, {S.scope_key()} AS sk, unnest(ev_refs) AS r FROM fx_memories WHERE kind = 'event') m
    LEFT JOIN fx_subject_identifiers s ON s.owner_id = m.owner_id AND s.scope = m.scope AND s.scope_key = m.sk AND s.scheme = m.r.scheme AND s.normalized_value = m.r.normalized_value GROUP BY 1""")
def _(t):
    return subjects.known_subjects(t.records, t.subject_identifiers).select("memory_id", "subjects")


# --- graph expansion ---------------------------------------------------------------------------------------

CHAT_SEEDS = f"""seeds AS (SELECT q.session_id AS query_id, r.memory_id FROM fx_sessions q JOIN fx_memories r ON {S.visible('r', 'q')} WHERE {S.current('r.')} AND r.event_id // 6 % 2 = 0
    QUALIFY row_number() OVER (PARTITION BY q.session_id ORDER BY r.memory_id) <= 50)"""


def hops_sql(seeds, chats, chat_id, limit):
    return f"""edg AS ({EDGES_SQL}), hop AS (SELECT relationship_id, created_at, from_memory_id AS seed, to_memory_id AS memory_id FROM edg WHERE label = 'RELATED'
      UNION ALL SELECT relationship_id, created_at, to_memory_id, from_memory_id FROM edg WHERE label = 'RELATED'),
    near AS (SELECT s.query_id, h.memory_id, h.seed, h.relationship_id, h.created_at FROM {seeds} s JOIN hop h ON h.seed = s.memory_id JOIN fx_memories r ON r.memory_id = h.memory_id
      JOIN {chats} q ON q.{chat_id} = s.query_id AND {S.visible('r', 'q')} WHERE {S.projectable('r.')} AND NOT EXISTS (SELECT 1 FROM {seeds} z WHERE z.query_id = s.query_id AND z.memory_id = h.memory_id)
      QUALIFY row_number() OVER (PARTITION BY s.query_id, h.memory_id ORDER BY h.created_at DESC, h.relationship_id DESC, h.seed) = 1),
    nb AS (SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, relationship_id DESC, seed) AS rank FROM near QUALIFY rank <= {limit})"""


@query("jn15_graph_expansion", f"WITH {CHAT_SEEDS}, {hops_sql('seeds', 'fx_sessions', 'session_id', 4)} SELECT query_id, memory_id, rank FROM nb")
def _(t):
    chats = t.sessions.withColumn("query_id", c("session_id"))
    seeds = cx.rehydrate(chats.select("query_id", "owner_id").join(t.memories.where(F.floor(c("event_id") / 6) % 2 == 0).select("owner_id", "memory_id"), "owner_id")
                         .select("query_id", "memory_id"), t.memories, chats, NOW).withColumn("position", c("memory_id"))
    edges = graph.edges(t.relationships, t.memories, NOW)
    out = graph.expand(seeds, edges, graph.nodes(t.memories, NOW), chats)
    return out.select("query_id", "memory_id", c("graph_rank").cast("long").alias("rank"))


# --- the memory context of a turn ----------------------------------------------------------------------------

CONT = f"""prev AS (SELECT * FROM (SELECT message_id, session_id, last(CASE WHEN role = 'assistant' THEN trace_id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY turn_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS trace_id
      FROM fx_messages) WHERE trace_id IS NOT NULL),
    inj AS (SELECT * FROM fx_turn_access WHERE event_type = 'injected' QUALIFY row_number() OVER (PARTITION BY trace_id, session_id, memory_id ORDER BY rank, access_event_id) = 1),
    cont AS (SELECT q.query_id, r.memory_id, i.rank, i.access_event_id FROM fx_turns q JOIN prev p ON p.message_id = q.query_id JOIN inj i ON i.trace_id = p.trace_id AND i.session_id = p.session_id
      JOIN fx_memories r ON r.memory_id = i.memory_id AND {S.visible('r', 'q')} WHERE r.kind = 'event' AND {S.current('r.')})"""


def continuity(t, seen=None):
    memories = t.memories if seen is None else among(t.memories, seen, c("memory_id"))
    return cx.continuity(t.turns, t.messages, t.turn_access, memories, NOW)


@query("ret18_continuity", f"WITH {CONT} SELECT query_id, memory_id, rank, access_event_id FROM cont")
def _(t):
    return continuity(t).select("query_id", "memory_id", "rank", "access_event_id")


@query("jn19_context_candidates", f"WITH {CONT}, {STAGES} SELECT query_id, memory_id, 'exact_identifier' AS candidate_source FROM ex UNION ALL SELECT DISTINCT query_id, memory_id, 'injected_context' FROM cont WHERE (query_id, memory_id) NOT IN (SELECT (query_id, memory_id) FROM ex)")
def _(t):
    return cx.reconciliation_candidates(exact_candidates(t), continuity(t), t.memories, t.turns, NOW)


TURN_CANDS = f"""{MEM}, {STAGES}, {CONT}, naming AS (SELECT DISTINCT query_id FROM refs),
    semok AS (SELECT s.query_id, s.memory_id, s.rank, s.score FROM sem s JOIN fx_turns q USING (query_id) JOIN fx_memories r ON r.memory_id = s.memory_id AND {S.visible('r', 'q')}
      WHERE {S.current('r.')} AND NOT (s.query_id IN (SELECT query_id FROM naming) AND EXISTS (SELECT 1 FROM cont x WHERE x.query_id = s.query_id AND x.memory_id = s.memory_id))),
    u AS (SELECT query_id, memory_id, 1 AS stage, rank AS pos FROM ex UNION ALL SELECT query_id, memory_id, 2, CAST(rank AS BIGINT) * 1000000000 + access_event_id FROM cont WHERE query_id NOT IN (SELECT query_id FROM naming)
      UNION ALL SELECT query_id, memory_id, 3, rank FROM semok),
    f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query_id, memory_id ORDER BY stage, pos) = 1),
    g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY stage, pos, memory_id) AS candidate_rank, count(*) FILTER (stage < 3) OVER (PARTITION BY query_id) AS before FROM f),
    cands AS (SELECT query_id, memory_id, stage, candidate_rank FROM g WHERE stage < 3 OR candidate_rank <= greatest(10, before + 1)),
    cseeds AS (SELECT query_id, memory_id FROM cands QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY candidate_rank) <= 50), {hops_sql('cseeds', 'fx_turns', 'query_id', 4)},
    final AS (SELECT query_id, memory_id, stage, candidate_rank AS position FROM cands UNION ALL SELECT query_id, memory_id, 4, rank FROM nb)"""


def turn_candidates(t):
    seen = cx.in_sight(t.memories, t.turns)
    semantic = cx.search_memories(turn_queries(t), memory_points(t, seen), NOW)
    return cx.assemble(turn_queries(t), exact_candidates(t, seen), continuity(t, seen), semantic, among(t.memories, seen, c("memory_id")), NOW)


def turn_context(t):
    candidates = cut_lineage(turn_candidates(t))
    relationships, memories = graph.around(candidates, t.relationships, t.memories)
    return cx.with_graph(candidates, t.turns, memories, graph.nodes(memories, NOW), graph.edges(relationships, memories, NOW), NOW)


@query("set3_precedence_union", f"WITH {TURN_CANDS} SELECT query_id, memory_id, stage, candidate_rank FROM cands")
def _(t):
    return turn_candidates(t).select("query_id", "memory_id", "stage", c("candidate_rank").cast("long").alias("candidate_rank"))


@query("ret14_turn_candidates", f"WITH {TURN_CANDS} SELECT query_id, memory_id, stage, position FROM final")
def _(t):
    return turn_context(t).select("query_id", "memory_id", "stage", "position")


@query("agg3_candidate_counts", f"""WITH {TURN_CANDS} SELECT query_id, count(*) FILTER (stage = 1) AS exact_identifier, count(*) FILTER (stage = 2) AS previous_response, count(*) FILTER (stage = 3) AS semantic,
    count(*) FILTER (stage = 4) AS graph_related FROM final GROUP BY 1""")
def _(t):
    return cx.candidate_counts(turn_context(t))


def supplied_plans(t):
    """One plan per turn over its exact candidates; some are wrong on purpose."""
    picked = exact_candidates(t).groupBy("query_id").agg(F.array_sort(F.collect_list("memory_id")).alias("ids"))
    bad = F.pmod(F.length("text"), F.lit(5))
    asked = picked.join(t.turns.select("query_id", "text"), "query_id")
    selected = F.when(bad == 0, F.concat("ids", "ids")).when(bad == 1, F.array(F.lit("mem-unknown"))).otherwise(c("ids"))
    relation = F.when(bad == 2, "updates").otherwise("related")
    hint = lambda m: F.struct(m.alias("memory_id"), relation.alias("relation"), F.when(F.length("text") % 2 == 0, 0.95).otherwise(0.5).alias("confidence"))
    # one in five plans has more hints than a plan may have
    hints = F.array_repeat(hint(F.get("ids", F.lit(0))), F.when(bad == 3, 11).otherwise(1))
    return asked.select("query_id", selected.alias("selected_memory_ids"), hints.alias("relationships"))


PLANS = f"""{STAGES}, pl AS (SELECT query_id, list(memory_id ORDER BY memory_id) AS ids, any_value(length(text) % 5) AS bad, any_value(length(text) % 2) AS odd FROM ex JOIN (SELECT query_id, text FROM fx_turns) USING (query_id) GROUP BY query_id),
    sel AS (SELECT p.query_id, p.memory_id, p.i AS rank, 'planner' AS source, CASE WHEN p.i = 1 THEN CASE WHEN bad = 2 THEN 'updates' ELSE 'related' END ELSE 'related' END AS relation,
        CASE WHEN p.i = 1 THEN CASE WHEN odd = 0 THEN 0.95 ELSE 0.5 END ELSE NULL END AS hint FROM (SELECT query_id, bad, odd, unnest(ids) AS memory_id, generate_subscripts(ids, 1) AS i FROM pl WHERE bad IN (2, 4)) p
      UNION ALL SELECT e.query_id, e.memory_id, row_number() OVER (PARTITION BY e.query_id ORDER BY e.rank), 'exact_fallback', 'supports', NULL FROM ex e JOIN pl USING (query_id) JOIN fx_memories m ON m.memory_id = e.memory_id WHERE bad NOT IN (2, 4) AND m.confidence >= 0.8),
    sel2 AS (SELECT s.*, coalesce(hint, m.confidence) AS conf FROM sel s JOIN fx_memories m USING (memory_id))"""


def exact_as_candidates(t):
    return exact_candidates(t).withColumns({"source": F.lit(C.STAGE_EXACT), "position": c("rank")})


def selected_memories(t):
    texts = t.records.withColumn("memory_text", pl.memory_text(c("kind"), c("payload")))
    return cx.selections(supplied_plans(t), exact_as_candidates(t), texts)


@query("ret15_plan_selection", f"WITH {PLANS} SELECT query_id, memory_id, rank, source AS selection_source, relation AS selection_relation, round(conf, 6) AS selection_confidence FROM sel2")
def _(t):
    return selected_memories(t).select("query_id", "memory_id", c("rank").cast("long").alias("rank"), "selection_source", "selection_relation",
                                       F.round("selection_confidence", 6).alias("selection_confidence"))


@query("ret16_prompt_context", f"""WITH {PLANS}, mc AS (SELECT query_id, string_agg(concat('[M', rank, ' | ', m.kind, ' | ', m.scope, ']', chr(10), {S.memory_text('m.')}), chr(10) || chr(10) ORDER BY rank) AS ctx FROM sel2 JOIN fx_memories m USING (memory_id) GROUP BY 1)
    SELECT q.query_id, concat_ws(chr(10) || chr(10), CASE WHEN q.turn_index % 4 = 0 THEN concat('[Attached file]', chr(10), q.text) END, CASE WHEN q.turn_index % 3 = 0 THEN q.text END, CASE WHEN mc.ctx IS NOT NULL THEN concat('CONFIRMED MEMORY CONTEXT', chr(10), mc.ctx) END) AS prompt
    FROM fx_turns q LEFT JOIN mc USING (query_id)""")
def _(t):
    memory = cx.memory_context(selected_memories(t)).withColumnRenamed("context", "memory")
    joined = t.turns.join(memory, "query_id", "left")
    attachment = F.when(c("turn_index") % 4 == 0, c("text"))
    sources = F.when(c("turn_index") % 3 == 0, c("text"))
    return joined.select("query_id", cx.prompt_context(attachment, sources, c("memory")).alias("prompt"))


@query("ret17_update_hints", f"""WITH {PLANS} SELECT query_id, count(*) FILTER (relation = 'updates' AND conf >= 0.9) AS confident_updates,
    count(*) FILTER (relation = 'updates' AND conf >= 0.9) <> count(*) FILTER (relation = 'updates') AS uncertain,
    coalesce(CASE WHEN count(*) FILTER (relation = 'updates' AND conf >= 0.9) = 1 THEN max(CASE WHEN relation = 'updates' AND conf >= 0.9 THEN memory_id END) END, '') AS target FROM sel2 GROUP BY 1""")
def _(t):
    out = cx.update_targets(selected_memories(t))
    return out.select("query_id", "confident_updates", "uncertain", F.coalesce("target_memory_id", F.lit("")).alias("target"))


@query("jn23_context_association", """WITH p AS (SELECT from_memory_id AS a, to_memory_id AS b, relationship_id FROM fx_relationships UNION ALL SELECT to_memory_id, from_memory_id, relationship_id + 1 FROM fx_relationships),
    t AS (SELECT memory_id, list_distinct(list_filter(regexp_extract_all(lower(array_to_string(ev_entities, ' ')), '[a-z][a-z0-9]{1,}'), lambda x: NOT list_contains(['for','the'], x))) AS e,
      list_distinct(list_filter(regexp_extract_all(lower(ev_summary), '[a-z][a-z0-9]{1,}'), lambda x: NOT list_contains(['for','the'], x))) AS s FROM fx_memories WHERE kind = 'event'),
    sc AS (SELECT a, b, 3 * len(list_intersect(x.e, y.e)) + len(list_intersect(x.s, y.s)) AS score, len(list_intersect(x.e, y.e)) AS n FROM p JOIN t x ON x.memory_id = a JOIN t y ON y.memory_id = b WHERE relationship_id % 3 <> 0),
    best AS (SELECT *, rank() OVER (PARTITION BY a ORDER BY score DESC) AS r FROM sc WHERE n > 0 AND score >= 3)
    SELECT a AS memory_id, any_value(b) AS candidate_id, CAST(any_value(score) AS INT) AS score FROM best WHERE r = 1 GROUP BY a HAVING count(*) = 1""")
def _(t):
    events = t.records.where(c("kind") == "event").select(
        "memory_id", tx.subject_terms(F.array_join("payload.event.entities", " ")).alias("entity_terms"), tx.subject_terms(c("payload.event.summary")).alias("summary_terms"))
    r = t.relationships
    pairs = r.select(c("from_memory_id").alias("memory_id"), c("to_memory_id").alias("candidate_id"), "relationship_id").unionByName(
        r.select(c("to_memory_id").alias("memory_id"), c("from_memory_id").alias("candidate_id"), (c("relationship_id") + 1).alias("relationship_id")))
    other = events.select(c("memory_id").alias("candidate_id"), c("entity_terms").alias("candidate_entity_terms"), c("summary_terms").alias("candidate_summary_terms"))
    candidates = pairs.join(other, "candidate_id").withColumns({
        "candidate_source": F.lit("injected_context"), "selection_relation": F.lit("updates"),
        "selection_confidence": F.when(c("relationship_id") % 3 != 0, 0.95).otherwise(0.5)}).drop("relationship_id")
    return lc.associate_context(events, candidates).select("memory_id", "candidate_id", "score")
