"""Chunking, page routing and ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import keys, numeric, text as tx
from palimpsest.operators import chunking, evidence as ev, keyed, quality, routing, segments, tables
from palimpsest.operators.ordered import explode_computed
from palimpsest.plans import sqlparts as S
from palimpsest.plans.fixtures import NOW
from palimpsest.plans.registry import query

c = F.col
TOKEN = r"\s*[\p{L}\p{N}]+|\s*[^\s\p{L}\p{N}]|\s+"
EDGE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def toks(x):
    return f"len(regexp_extract_all({x}, '{TOKEN}'))"


def strip(x):
    return f"regexp_replace({x}, '{EDGE}', '', 'g')"


def units_sql(x, limit):
    paragraphs = f"list_filter(list_transform(regexp_split_to_array({x}, '\\n{{2,}}'), lambda p: {strip('p')}), lambda p: p <> '')"
    sentences = (f"list_filter(list_transform(string_split(regexp_replace(p, '([.!?])\\s+', '\\1' || chr(31), 'g'), chr(31)), lambda s: {strip('s')}), lambda s: s <> '')")
    pieces = f"flatten(list_transform({paragraphs}, lambda p: CASE WHEN {toks('p')} <= {limit} THEN [p] ELSE {sentences} END))"
    unit = "struct_pack(chunks := CAST([] AS VARCHAR[]), parts := CAST([] AS VARCHAR[]), used := CAST(0 AS BIGINT), carry := '', text := {t}, cost := CAST({n} AS BIGINT))"
    word_list = f"list_filter(regexp_split_to_array(s, '{S.B}'), lambda w: w <> '')"
    word_cost = toks("w || ' '")
    return (f"flatten(list_transform({pieces}, lambda s: CASE WHEN {toks('s')} <= {limit} THEN [{unit.format(t='s', n=toks('s'))}]"
            f" ELSE list_transform({word_list}, lambda w: {unit.format(t='w', n=word_cost)}) END))")


def chunks_sql(source, x, key, limit, overlap):
    """Chunk texts by a fold over units whose struct also carries the running state."""
    whole = strip("a.carry || ' ' || array_to_string(a.parts, ' ')")
    toklist = f"regexp_extract_all({whole}, '{TOKEN}')"
    carried = f"CASE WHEN len({toklist}) <= {overlap} THEN {whole} ELSE array_to_string({toklist}[-{overlap}:], '') END"
    full = f"(a.used + u.cost > {limit} AND len(a.parts) > 0)"
    step = (f"struct_pack(chunks := CASE WHEN {full} THEN list_append(a.chunks, {whole}) ELSE a.chunks END,"
            f" parts := CASE WHEN {full} THEN [u.text] ELSE list_append(a.parts, u.text) END,"
            f" used := CAST(CASE WHEN {full} THEN {toks(carried)} ELSE a.used END + u.cost AS BIGINT),"
            f" carry := CASE WHEN {full} THEN {carried} ELSE a.carry END, text := '', cost := CAST(0 AS BIGINT))")
    start = "struct_pack(chunks := CAST([] AS VARCHAR[]), parts := CAST([] AS VARCHAR[]), used := CAST(0 AS BIGINT), carry := '', text := '', cost := CAST(0 AS BIGINT))"
    return (f"SELECT {key}, CASE WHEN len(a.parts) > 0 THEN list_append(a.chunks, {whole}) ELSE a.chunks END AS chunks FROM ("
            f"SELECT {key}, list_reduce(list_concat([{start}], {units_sql(x, limit)}), lambda a, u: {step}) AS a FROM {source})")


def text_blocks(t):
    return t.documents.select("doc_id", F.concat(F.lit("blk-"), "doc_id").alias("chunk_id"), c("text").alias("content"), "lang")


@query("chk1_chunk_text", f"""SELECT doc_id, unnest(chunks) AS chunk, generate_subscripts(chunks, 1) - 1 AS pos FROM ({chunks_sql('documents', 'text', 'doc_id', 512, 50)})""")
def _(t):
    split = explode_computed(chunking.split_text(text_blocks(t)), ["doc_id"], c("chunks"), "pos", "chunk")
    return split.select("doc_id", c("pos").cast("long").alias("pos"), "chunk")


@query("chk2_overlap_tail", f"""SELECT doc_id, CASE WHEN {toks('text')} <= 50 THEN text ELSE array_to_string(regexp_extract_all(text, '{TOKEN}')[-50:], '') END AS tail FROM documents""")
def _(t):
    return t.documents.select("doc_id", chunking.tail(c("text"), 50).alias("tail"))


@query("chk3_chunk_rows", f"""WITH ch AS (SELECT d.doc_id, d.text, x.chunks, len(x.chunks) = 1 AND {toks('x.chunks[1]')} <= 128 AS fits FROM documents d
      JOIN ({chunks_sql('documents', 'text', 'doc_id', 128, 16)}) x USING (doc_id)),
    r AS (SELECT doc_id, text, fits, unnest(chunks) AS part, generate_subscripts(chunks, 1) - 1 AS pos FROM ch)
    SELECT doc_id, lang, CASE WHEN fits THEN concat('blk-', doc_id) ELSE {S.uuid5("concat('blk-', doc_id, ':', pos)")} END AS chunk_id,
      sha256(CASE WHEN fits THEN text ELSE part END) AS digest FROM r JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)""")
def _(t):
    rows = chunking.chunk_rows(text_blocks(t), 128, 16)
    return rows.select("doc_id", "lang", "chunk_id", F.sha2("content", 256).alias("digest"))


@query("chk4_section_blocks")
def _(t):
    from palimpsest.sources.readers import text_blocks as kept
    return chunking.section_rows(kept(t.layout_items), "doc_id")


@query("chk5_table_chunks", """WITH r AS (SELECT c_mktsegment AS sheet, c_custkey, concat_ws(chr(9), c_custkey, c_name, coalesce(nk, 'nan')) AS line,
      row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS row FROM (SELECT *, CASE WHEN c_custkey % 9 <> 0 THEN CAST(c_nationkey AS STRING) END AS nk FROM customer))
    SELECT sheet, CAST((row - 1) // 50 AS BIGINT) AS row_group, concat('[Sheet: ', sheet, ' rows ', min(row), '-', max(row), ']', chr(10), concat_ws(chr(9), 'key', 'name', 'nation'), chr(10),
      string_agg(line, chr(10) ORDER BY row)) AS content, concat(sheet, '!A', min(row), ':C', max(row)) AS cell_range FROM r GROUP BY sheet, 2""")
def _(t):
    rows = t.customer.select(c("c_mktsegment").alias("sheet"), "c_custkey", c("c_custkey").alias("key"), c("c_name").alias("name"),
                             F.when(c("c_custkey") % 9 != 0, c("c_nationkey")).alias("nation"))
    return tables.table_chunks(rows, "sheet", "c_custkey", ["key", "name", "nation"]).select("sheet", "row_group", "content", "cell_range")


def recordings(t):
    """Turns of a conversation as a timed recording of twenty-five second segments."""
    seg = F.struct((c("turn") * 25.0).alias("start"), (c("turn") * 25.0 + 20).alias("end"), c("text").alias("text"))
    return t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(seg)).alias("segments"))


SEG_STATE = ("struct_pack(done := {d}, s := {s}, e := {e}, w := CAST({w} AS BIGINT), txt := {t})")
NONE_DONE = "CAST([] AS STRUCT(s DOUBLE, e DOUBLE, txt VARCHAR)[])"
WORDS = f"len(list_filter(regexp_split_to_array(text, '{S.B}'), lambda w: w <> ''))"


@query("chk6_merge_segments", f"""WITH seg AS (SELECT conv_id, list({SEG_STATE.format(d=NONE_DONE, s='CAST(turn * 25 AS DOUBLE)', e='CAST(turn * 25 + 20 AS DOUBLE)', w=WORDS, t='text')} ORDER BY turn) AS l
      FROM conversations GROUP BY conv_id),
    red AS (SELECT conv_id, list_reduce(l, lambda a, x: CASE WHEN a.w + x.w <= 120 AND x.e - a.s <= 60 THEN {SEG_STATE.format(d='a.done', s='a.s', e='x.e', w='a.w + x.w', t="a.txt || ' ' || x.txt")}
      ELSE {SEG_STATE.format(d='list_append(a.done, struct_pack(s := a.s, e := a.e, txt := a.txt))', s='x.s', e='x.e', w='x.w', t='x.txt')} END) AS a FROM seg),
    o AS (SELECT conv_id, unnest(list_append(a.done, struct_pack(s := a.s, e := a.e, txt := a.txt))) AS r FROM red)
    SELECT conv_id, r.s AS "start", r.e AS "end", concat('[rec ', r.s, 's–', r.e, 's]', chr(10), r.txt) AS content FROM o""")
def _(t):
    return segments.merged_rows(recordings(t), "conv_id", F.lit("rec")).select("conv_id", "start", "end", "content")


METRICS = f"""length(regexp_replace({{x}}, '[\\s\\p{{Z}}]', '', 'g')) AS {{p}}vis, len(list_filter(regexp_split_to_array({{x}}, '{S.B}'), lambda w: w <> '')) AS {{p}}nw,
    length(regexp_replace({{x}}, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS {{p}}al, length({{x}}) - length(regexp_replace({{x}}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{{FFFD}}]', '', 'g')) AS {{p}}bad, length({{x}}) AS {{p}}n"""
METRICS = METRICS.replace("{FFFD}", "{{FFFD}}").replace("\\p{Z}", "\\p{{Z}}").replace("\\p{L}", "\\p{{L}}").replace("\\p{N}", "\\p{{N}}")


def metrics_sql(x, p):
    return METRICS.format(x=x, p=p)


ROUTED = f"""SELECT *, CASE WHEN read_failed THEN 'uncertain' WHEN (vis >= 80 OR nw >= 15) AND al / greatest(vis, 1) >= 0.5 AND bad / greatest(n, 1) <= 0.01 THEN 'native'
    WHEN visual_ratio < 0.005 THEN 'blank' ELSE 'ocr' END AS route, ovis >= 20 AND oal / greatest(ovis, 1) >= 0.4 AS ocr_ok
    FROM (SELECT *, {metrics_sql('native_text', '')}, {metrics_sql('ocr_text', 'o')} FROM fx_pdf_pages)"""
SETTLED = f"SELECT *, CASE WHEN route = 'ocr' AND NOT ocr_ok THEN 'visual_only' ELSE route END AS final FROM ({ROUTED})"


@query("chk7_page_routing", f"""WITH p AS ({SETTLED}), d AS (SELECT asset_id, bool_or(route = 'uncertain') AS unc, count(*) FILTER (route <> 'blank') AS nb, count(*) FILTER (route IN ('ocr', 'uncertain')) AS weak,
      bool_or(route = 'ocr') AS ocr, count(*) FILTER (final IN ('native','ocr')) AS expected,
      coalesce(sum(length({strip("CASE WHEN final = 'native' THEN native_text ELSE ocr_text END")})) FILTER (final IN ('native','ocr')), 0) AS chars FROM p GROUP BY asset_id)
    SELECT asset_id, CASE WHEN reason <> '' THEN 'full_parse' WHEN ocr THEN 'mixed' ELSE 'native' END AS strategy, reason FROM (
      SELECT *, CASE WHEN unc THEN 'uncertain_page' WHEN nb > 0 AND weak / greatest(nb, 1) >= 0.7 THEN 'low_native_coverage' WHEN expected > 0 AND chars < 40 THEN 'post_extract_quality_failure' ELSE '' END AS reason FROM d)""")
def _(t):
    return routing.document_routes(t.pdf_pages).select("asset_id", "strategy", F.coalesce("reason", F.lit("")).alias("reason"))


@query("agg4_route_counts", f"""SELECT asset_id, count(*) AS pages_total, count(*) FILTER (final = 'native') AS pages_native, count(*) FILTER (final = 'ocr') AS pages_ocr, count(*) FILTER (final = 'blank') AS pages_blank,
    count(*) FILTER (final = 'visual_only') AS pages_visual_only, count(*) FILTER (final = 'uncertain') AS pages_uncertain FROM ({SETTLED}) GROUP BY asset_id""")
def _(t):
    return routing.route_counts(routing.settle_ocr(routing.preflight(t.pdf_pages)))


@query("agg5_fallback_ratio", f"""SELECT asset_id, round(count(*) FILTER (route IN ('ocr', 'uncertain')) / greatest(count(*) FILTER (route <> 'blank'), 1), 6) AS fallback_ratio,
    bool_or(route = 'uncertain') AS any_uncertain FROM ({ROUTED}) GROUP BY asset_id""")
def _(t):
    return routing.fallback_measures(routing.preflight(t.pdf_pages)).select("asset_id", F.round("fallback_ratio", 6).alias("fallback_ratio"), "any_uncertain")


@query("agg6_quality_gate", f"""SELECT asset_id, count(*) FILTER (final IN ('native','ocr')) AS expected,
    CAST(coalesce(sum(length({strip("CASE WHEN final = 'native' THEN native_text ELSE ocr_text END")})) FILTER (final IN ('native','ocr')), 0) AS BIGINT) AS chars FROM ({SETTLED}) GROUP BY asset_id""")
def _(t):
    return routing.quality_gate(routing.settle_ocr(routing.preflight(t.pdf_pages))).select("asset_id", "expected", "chars")


@query("prj7_page_blocks", f"""SELECT asset_id, page, CASE final WHEN 'native' THEN 'text' ELSE 'ocr' END AS representation,
    {S.uuid5("concat(asset_id, ':pdf:', page, ':', CASE final WHEN 'native' THEN 'text' ELSE 'ocr' END, ':0')")} AS chunk_id,
    {strip("CASE WHEN final = 'native' THEN native_text ELSE ocr_text END")} AS content FROM ({SETTLED}) WHERE final IN ('native','ocr')""")
def _(t):
    return routing.page_blocks(routing.settle_ocr(routing.preflight(t.pdf_pages))).select("asset_id", "page", "representation", "chunk_id", "content")


@query("chk8_ingest")
def _(t):
    """Pages to routed blocks, chunks, evidence and vector points in one plan."""
    pages = routing.settle_ocr(routing.preflight(t.pdf_pages))
    chunks = chunking.chunk_rows(routing.page_blocks(pages))
    evidence = chunks.select(
        c("chunk_id").alias("evidence_id"), "asset_id", F.lit("text").alias("modality"), "representation", "content",
        F.concat(F.lit("file:///"), "asset_id").alias("media_uri"), c("asset_id").alias("source_name"), "page", "parser_backend",
        F.lit("1").alias("parser_version"), F.lit(NOW).cast("timestamp").alias("created_at"))
    hashed = quality.with_evidence_hash(evidence)
    owners = pages.select("asset_id").distinct().select("asset_id", F.crc32("asset_id").alias("binding_id"), F.lit("owner").alias("owner_id"),
                                                        F.lit("project").alias("scope"), F.lit(None).cast("string").alias("session_id"), F.lit("p0").alias("project_id"))
    points = ev.points_from(ev.projection_inputs(hashed, owners))
    return points.select("point_id", "evidence_id", "doc_id", "page", "content")


@query("chk9_start_action", f"""SELECT b.binding_id, CASE r.status WHEN 'done' THEN 'already_indexed' WHEN 'processing' THEN 'in_progress' ELSE
    CASE WHEN e.asset_id IS NOT NULL THEN 'project_again' ELSE 'ingest' END END AS action FROM fx_bindings b
    LEFT JOIN (SELECT * FROM fx_runs QUALIFY row_number() OVER (PARTITION BY binding_id ORDER BY created_at DESC, run_id DESC) = 1) r USING (binding_id)
    LEFT JOIN (SELECT DISTINCT asset_id FROM fx_evidence WHERE first_doc % 2 = 0) e ON e.asset_id = b.asset_id""")
def _(t):
    return ev.start_actions(t.bindings, t.runs, t.evidence.where(c("first_doc") % 2 == 0)).select("binding_id", "action")


@query("job10_run_lifecycle", """SELECT run_id, CASE WHEN chunk_count % 3 = 0 THEN status WHEN chunk_count % 3 = 1 THEN 'failed' ELSE 'done' END AS status,
    CASE WHEN chunk_count % 3 = 1 THEN 'parse error' ELSE '' END AS error, CASE WHEN chunk_count % 3 = 0 THEN chunk_count ELSE chunk_count + 1 END AS chunk_count FROM fx_runs""")
def _(t):
    k = c("chunk_count") % 3
    results = t.runs.where(k != 0).select("run_id", (c("chunk_count") + 1).alias("chunks"), F.when(k == 1, "parse error").alias("failure"))
    out = ev.complete_runs(t.runs, results, NOW)
    return out.select("run_id", "status", F.coalesce("error", F.lit("")).alias("error"), "chunk_count")
