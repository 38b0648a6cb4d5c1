"""Identity, text, date, numeric, array, map, JSON and constraint expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest import constants as C, schemas
from palimpsest.functions import keys, numeric, payload as pl, scope as sc, temporal, text as tx
from palimpsest.operators import quality
from palimpsest.plans import sqlparts as S
from palimpsest.plans.fixtures import NOW
from palimpsest.plans.records import with_payload
from palimpsest.plans.registry import query

c = F.col


def joined(column, sep="|"):
    return F.array_join(column, sep)


# --- identity ---------------------------------------------------------------------

@query("key1_content_id", "SELECT doc_id, sha256(text) AS asset_id FROM documents")
def _(t):
    return t.documents.select("doc_id", keys.content_id(c("text")).alias("asset_id"))


@query("key2_block_id", f"SELECT doc_id, {S.uuid5('''concat(sha256(text), ':', doc_id)''')} AS block_id FROM documents")
def _(t):
    return t.documents.select("doc_id", keys.block_id(keys.content_id(c("text")), c("doc_id")).alias("block_id"))


@query("key3_child_id", f"""SELECT doc_id, pos, {S.uuid5("concat('d', doc_id, ':', pos)")} AS child_id FROM (
    SELECT doc_id, unnest(range(CAST(n_chars % 4 + 1 AS BIGINT))) AS pos FROM documents)""")
def _(t):
    parts = t.documents.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), c("n_chars") % 4)).alias("pos"))
    return parts.select("doc_id", "pos", keys.child_id(F.concat(F.lit("d"), c("doc_id")), c("pos")).alias("child_id"))


@query("key4_point_id", f"SELECT point_id, {S.uuid5('''concat('evidence:', evidence_id, ':', binding_id)''')} AS id FROM fx_points")
def _(t):
    return t.points.select("point_id", keys.point_id(c("evidence_id"), c("binding_id")).alias("id"))


@query("key5_uuid_low_bits", f"""SELECT doc_id, CAST(('0x' || substr('01234567', (strpos('0123456789abcdef', substr(u, 20, 1)) - 1) % 8 + 1, 1)
    || substr(replace(u, '-', ''), 18, 15)) AS BIGINT) AS low_bits FROM (SELECT doc_id, {S.uuid5("concat('x:', doc_id)")} AS u FROM documents)""")
def _(t):
    return t.documents.select("doc_id", keys.uuid_low_bits(
        keys.uuid5(F.concat(F.lit("x:"), c("doc_id")))).alias("low_bits"))


@query("key6_evidence_hash", """SELECT evidence_id, length(content) > 0 AS has_text,
    count(*) OVER (PARTITION BY asset_id, modality, content, media_uri, source_name, page) AS same FROM fx_evidence""")
def _(t):
    hashed = quality.with_evidence_hash(t.evidence)
    same = hashed.groupBy("content_hash").agg(F.count("*").alias("same"))
    return hashed.join(same, "content_hash").select("evidence_id", (F.length("content") > 0).alias("has_text"), "same")


@query("key7_event_identity", f"SELECT memory_id, {S.identity()} AS identity_key FROM fx_memories WHERE kind = 'event'")
def _(t):
    events = t.records.where(c("kind") == "event")
    return events.select("memory_id", keys.event_identity(c("payload.event")).alias("identity_key"))


@query("key8_event_comparison", f"""SELECT memory_id, CASE WHEN len({S.event_ids()}) > 0 THEN
    concat_ws(chr(31), {S.domain()}, array_to_string({S.event_ids()}, chr(31))) END AS comparison_key
    FROM fx_memories WHERE kind = 'event'""")
def _(t):
    events = t.records.where(c("kind") == "event")
    return events.select("memory_id", keys.event_comparison_key(c("payload.event")).alias("comparison_key"))


@query("key9_subject_scope_key", f"SELECT memory_id, {S.scope_key()} AS scope_key FROM fx_memories")
def _(t):
    return t.memories.select("memory_id", keys.subject_scope_key(
        c("scope"), c("session_id"), c("project_id"), c("project_scope")).alias("scope_key"))


@query("key10_proposal_id", f"""SELECT memory_id, {S.uuid5("concat('memory:propose_event_claim_change:', source_turn_id, ':', memory_id)")} AS proposal_id
    FROM fx_memories""")
def _(t):
    return t.memories.select("memory_id", keys.proposal_id(c("source_turn_id"), c("memory_id")).alias("proposal_id"))


# --- text -----------------------------------------------------------------------------

PARAGRAPHED = "regexp_replace(text, '\\. ', '.' || chr(10) || chr(10) || ' ', 'g')"


def paragraphed(t):
    """Documents with a blank line after every full stop, so paragraphs exist."""
    return t.documents.withColumn("text", F.regexp_replace("text", r"\. ", ".\n\n "))


STRIP = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


@query("txt1_paragraphs", f"""SELECT doc_id, CAST(len(p) AS BIGINT) AS n, sha256(array_to_string(p, '|')) AS digest FROM (
    SELECT doc_id, list_filter(list_transform(regexp_split_to_array({PARAGRAPHED}, '\\n{{2,}}'),
      lambda x: regexp_replace(x, '{STRIP}', '', 'g')), lambda x: x <> '') AS p FROM documents)""")
def _(t):
    docs = paragraphed(t).select("doc_id", tx.paragraphs(c("text")).alias("p"))
    return docs.select("doc_id", F.size("p").cast("long").alias("n"), F.sha2(joined(c("p")), 256).alias("digest"))


@query("txt2_sentences", f"""SELECT doc_id, CAST(len(p) AS BIGINT) AS n, sha256(array_to_string(p, '|')) AS digest FROM (
    SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(31), 'g'), chr(31)),
      lambda x: regexp_replace(x, '{STRIP}', '', 'g')), lambda x: x <> '') AS p FROM documents)""")
def _(t):
    docs = t.documents.select("doc_id", tx.sentences(c("text")).alias("p"))
    return docs.select("doc_id", F.size("p").cast("long").alias("n"), F.sha2(joined(c("p")), 256).alias("digest"))


TOKEN_SQL = r"\s*[\p{L}\p{N}]+|\s*[^\s\p{L}\p{N}]|\s+"


@query("txt3_token_count", f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{TOKEN_SQL}')) AS BIGINT) AS tokens FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.token_count(c("text")).cast("long").alias("tokens"))


@query("txt4_words", f"""SELECT doc_id, CAST(len(w) AS BIGINT) AS n, sha256(array_to_string(w, '|')) AS digest FROM (
    SELECT doc_id, list_filter(regexp_split_to_array(text, '{S.B}'), lambda x: x <> '') AS w FROM documents)""")
def _(t):
    docs = t.documents.select("doc_id", tx.words(c("text")).alias("w"))
    return docs.select("doc_id", F.size("w").cast("long").alias("n"), F.sha2(joined(c("w")), 256).alias("digest"))


@query("txt5_without_urls", f"""SELECT page_id, CASE WHEN s = '' THEN q ELSE s END AS cleaned FROM (
    SELECT page_id, q, regexp_replace(regexp_replace(q, 'https?://\\S+', '', 'g'), '{STRIP}', '', 'g') AS s FROM (
      SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE concat('see ', url, ' page ', page_id) END AS q FROM pages))""")
def _(t):
    q = F.when(c("page_id") % 3 == 0, c("url")).otherwise(F.concat(F.lit("see "), "url", F.lit(" page "), "page_id"))
    return t.pages.select("page_id", tx.without_urls(q).alias("cleaned"))


@query("txt6_name_key", f"SELECT request_id, {S.casefold(S.collapse('name'))} AS name_key FROM fx_project_requests")
def _(t):
    return t.project_requests.select("request_id", tx.name_key(c("name")).alias("name_key"))


@query("txt7_event_label", """SELECT p_partkey, trim(regexp_replace(lower(concat(p_type, ' / ', p_name, '!')), '[^a-z0-9]+', '_', 'g'), '_') AS label
    FROM part""")
def _(t):
    return t.part.select("p_partkey", tx.event_label(F.concat("p_type", F.lit(" / "), "p_name", F.lit("!"))).alias("label"))


@query("txt8_identifier_key", """SELECT c_custkey, regexp_replace(lower(c_name), '[^\\p{L}\\p{N}]', '', 'g') AS id_key FROM customer""")
def _(t):
    return t.customer.select("c_custkey", tx.identifier_key(c("c_name")).alias("id_key"))


@query("txt9_claim_value_key", f"SELECT doc_id, sha256({S.casefold(S.collapse('text'))}) AS digest FROM documents")
def _(t):
    return t.documents.select("doc_id", F.sha2(tx.name_key(c("text")), 256).alias("digest"))


@query("txt10_loose_key", f"""SELECT doc_id, sha256(trim(regexp_replace(regexp_replace({S.casefold('text')}, '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) AS digest
    FROM documents""")
def _(t):
    return t.documents.select("doc_id", F.sha2(tx.loose_key(c("text")), 256).alias("digest"))


@query("txt11_stable_identifiers", f"""SELECT event_id, array_to_string(list_sort(list_distinct({S.stable_ids("[concat('order EV-', k, ' of ', k, 'kg'), concat('box_', user_id)]")})), '|') AS ids
    FROM fx_memories""")
def _(t):
    values = F.array(F.concat(F.lit("order EV-"), "k", F.lit(" of "), "k", F.lit("kg")), F.concat(F.lit("box_"), "user_id"))
    return t.memories.select("event_id", joined(F.array_sort(tx.stable_identifiers(values))).alias("ids"))


@query("txt12_identifier_mentions", r"""WITH toks AS (SELECT query_id, regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', '_', 'g'),
      '\b[A-Za-z0-9]+(?:[-_][A-Za-z0-9]+)*\b') AS v FROM fx_turns)
    SELECT query_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(v, lambda x:
      (regexp_matches(x, '[A-Za-z]') AND regexp_matches(x, '[0-9]')) OR regexp_matches(x, '^[0-9]{3,}$')),
      lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')))), '|') AS ids FROM toks""")
def _(t):
    found = F.transform(tx.identifier_mentions(c("text")), lambda r: r["normalized_value"])
    return t.turns.select("query_id", joined(F.array_sort(found)).alias("ids"))


@query("txt13_subject_terms", f"""SELECT memory_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(ev_summary), '[a-z][a-z0-9]{{1,}}')),
    lambda x: NOT list_contains({C.SUBJECT_STOP_TERMS!r}, x))), '|') AS terms FROM fx_memories""")
def _(t):
    return t.memories.select("memory_id", joined(F.array_sort(tx.subject_terms(c("ev_summary")))).alias("terms"))


def title_sql(x, column="title"):
    return f"""CASE WHEN clean = '' THEN 'New chat' WHEN length(clean) > length(fit) THEN fit || '…' ELSE fit END AS {column}"""


FIT = """CASE WHEN length(head) > 48 THEN regexp_replace(rtrim(substr(head, 1, 48)), ' [^ ]*$', '') ELSE head END"""


@query("txt14_message_title", f"""SELECT message_id, {title_sql('x')} FROM (SELECT *, {FIT} AS fit FROM (
    SELECT message_id, clean, array_to_string(string_split(clean, ' ')[1:7], ' ') AS head FROM (
      SELECT message_id, {S.collapse('content')} AS clean FROM fx_messages)))""")
def _(t):
    return t.messages.select("message_id", tx.title_from_message(c("content")).alias("title"))


@query("txt15_clean_title", f"""SELECT message_id, {FIT} AS title FROM (
    SELECT message_id, array_to_string(string_split(regexp_replace(regexp_replace({S.collapse("concat('\"', content, '\"')")},
      '^[''"`#*\\- ]+|[''"`#*\\- ]+$', '', 'g'), '[.!?:;, ]+$', ''), ' ')[1:7], ' ') AS head FROM fx_messages)""")
def _(t):
    return t.messages.select("message_id", tx.clean_title(F.concat(F.lit('"'), "content", F.lit('"'))).alias("title"))


@query("txt16_memory_text", f"SELECT memory_id, {S.memory_text()} AS memory_text FROM fx_memories")
def _(t):
    return t.records.select("memory_id", pl.memory_text(c("kind"), c("payload")).alias("memory_text"))


@query("txt17_text_metrics", f"""SELECT doc_id, CAST(vis AS BIGINT) AS char_count, CAST(nw AS BIGINT) AS word_count, round(al / greatest(vis, 1), 6) AS alnum_ratio,
    round(bad / greatest(n, 1), 6) AS bad_ratio FROM (SELECT doc_id, length(text) AS n,
      length(regexp_replace(text, '[\\s\\p{{Z}}]', '', 'g')) AS vis, len(list_filter(regexp_split_to_array(text, '{S.B}'), lambda x: x <> '')) AS nw,
      length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS al,
      length(text) - length(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{{FFFD}}]', '', 'g')) AS bad FROM documents)""")
def _(t):
    m = t.documents.select("doc_id", tx.text_metrics(c("text")).alias("m"))
    return m.select("doc_id", c("m.char_count").cast("long").alias("char_count"), c("m.word_count").cast("long").alias("word_count"),
                    F.round("m.alnum_ratio", 6).alias("alnum_ratio"), F.round("m.bad_char_ratio", 6).alias("bad_ratio"))


@query("txt18_headers", """SELECT message_id, concat('[', session_id, ' ', turn_index, '.5s–', turn_index + 2, '.0s]', chr(10), content) AS segment,
    concat('[Sheet: ', role, ' rows ', turn_index + 1, '-', turn_index + 50, ']', chr(10), message_id) AS sheet,
    concat('[Image: ', message_id, ']', chr(10), 'Text in image:', chr(10), role) AS image FROM fx_messages""")
def _(t):
    turn = c("turn_index")
    return t.messages.select(
        "message_id", tx.segment_header(c("session_id"), turn + 0.5, turn + 2.0, c("content")).alias("segment"),
        tx.sheet_header(c("role"), turn + 1, turn + 50, c("message_id")).alias("sheet"),
        tx.image_header(c("message_id"), c("role"), F.lit("ocr")).alias("image"))


@query("txt19_section_prefix", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN concat('[Section: ', p_brand, ']', chr(10))
    ELSE concat('[Section: ', p_brand, ' > ', p_type, ']', chr(10)) END AS prefix FROM part""")
def _(t):
    current = F.when(c("p_size") % 3 == 0, c("p_brand")).otherwise(c("p_type"))
    return t.part.select("p_partkey", tx.section_prefix(c("p_brand"), current).alias("prefix"))


@query("txt21_is_compound", """SELECT query_id, length(q) >= 80 AND (contains(lower(q), ' compare ') OR contains(lower(q), ' versus ')
    OR contains(lower(q), ' vs. ') OR contains(lower(q), ' and then ') OR contains(lower(q), ' followed by ')
    OR length(q) - length(replace(q, '?', '')) > 1) AS compound FROM (SELECT query_id, CASE item_id % 3 WHEN 0 THEN concat(text, ' Compare a versus b')
    WHEN 1 THEN concat(text, '? Why? ') ELSE text END AS q FROM fx_queries)""")
def _(t):
    return subquery_source(t).select("query_id", tx.is_compound(c("q")).alias("compound"))


def subquery_source(t):
    kind = c("item_id") % 3
    return t.queries.withColumn("q", F.when(kind == 0, F.concat("text", F.lit(" Compare a versus b")))
                                .when(kind == 1, F.concat("text", F.lit("? Why? "))).otherwise(c("text")))


@query("txt22_valid_subqueries", f"""WITH subs AS (SELECT query_id, lower(text) AS q, {S.collapse('x')} AS s, pos FROM (
      SELECT query_id, text, unnest(string_split(text, '. ')[1:3]) AS x, generate_subscripts(string_split(text, '. ')[1:3], 1) AS pos FROM fx_queries)),
    firsts AS (SELECT query_id, s, pos, row_number() OVER (PARTITION BY query_id, lower(s) ORDER BY pos) AS rn
      FROM subs WHERE length(s) >= 8 AND lower(s) <> q)
    SELECT q.query_id, coalesce(f.subs, '') AS subs FROM fx_queries q LEFT JOIN (SELECT query_id, string_agg(s, '|' ORDER BY pos) AS subs
      FROM firsts WHERE rn = 1 GROUP BY query_id) f USING (query_id)""")
def _(t):
    return t.queries.select("query_id", joined(
        tx.valid_subqueries(F.split("text", r"\. "), c("text"))).alias("subs"))


# --- dates and numbers ------------------------------------------------------------------

@query("dte1_event_valid_to", f"""SELECT memory_id, {S.ts('''ts + to_hours(CASE k % 4 WHEN 0 THEN 192 WHEN 1 THEN k * 24 + 168
    WHEN 2 THEN k * 30 * 24 + 168 ELSE 720 END)''')} AS valid_to FROM (SELECT memory_id, created_at AS ts, CAST(k AS INT) AS k FROM fx_memories)""")
def _(t):
    k = c("k")
    wording = (F.when(k % 4 == 0, F.lit("arrives Tomorrow")).when(k % 4 == 1, F.concat(F.lit("due in "), k, F.lit(" days")))
               .when(k % 4 == 2, F.concat(F.lit("review in "), k, F.lit(" months"))).otherwise(F.lit("some day")))
    out = temporal.event_valid_to(wording, c("ev_time"), c("created_at"))
    return t.memories.select("memory_id", F.date_format(out, "yyyy-MM-dd HH:mm:ss").alias("valid_to"))


@query("dte2_validity_window", f"SELECT memory_id, {S.valid_at()} AS valid FROM fx_memories")
def _(t):
    return t.memories.select("memory_id", sc.within_validity(c("valid_from"), c("valid_to"), NOW).alias("valid"))


@query("dte3_iso_utc", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS iso FROM events")
def _(t):
    return t.events.select("event_id", temporal.iso_utc(c("ts")).alias("iso"))


@query("dte4_cue_seconds", """SELECT event_id, user_id * 3600 + (event_id % 60) * 60 + event_id % 59 + (event_id % 1000) / 1000.0 AS seconds
    FROM events""")
def _(t):
    e = c("event_id")
    stamp = F.format_string("%02d:%02d:%02d.%03d", c("user_id"), e % 60, e % 59, e % 1000)
    part = lambda i: F.regexp_extract(stamp, r"(\d+):(\d{2}):(\d{2})\.(\d{3})", i)
    return t.events.select("event_id", tx.seconds(part(1), part(2), part(3), part(4)).alias("seconds"))


@query("mth1_cosine", """SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def _(t):
    a, b = t.embeddings, t.embeddings.select((c("vec_id") - 1).alias("vec_id"), c("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(numeric.cosine(c("embedding"), c("other")), 6).alias("cosine"))


@query("mth2_rank_term", """SELECT o_orderkey, round(1.0 / (60 + o_orderkey % 20 + 1) + CASE WHEN o_orderkey % 3 = 0 THEN 0
    ELSE 1.0 / (60 + o_custkey % 20 + 1) END, 9) AS score FROM orders""")
def _(t):
    second = F.when(c("o_orderkey") % 3 != 0, c("o_custkey") % 20 + 1)
    return t.orders.select("o_orderkey", F.round(
        numeric.rank_term(c("o_orderkey") % 20 + 1) + numeric.rank_term(second), 9).alias("score"))


@query("mth3_collection_weight", """SELECT point_id, round(CASE collection WHEN 'image' THEN 0.8 WHEN 'video_segment' THEN 0.7 ELSE 1.0 END / (point_id + 1), 9) AS weighted
    FROM fx_points""")
def _(t):
    return t.points.select("point_id", F.round(
        numeric.collection_weight(c("collection")) * (1 / (c("point_id") + 1)), 9).alias("weighted"))


@query("mth4_floored_ratio", "SELECT p_partkey, round(p_partkey / greatest(p_size % 5, 1), 6) AS ratio FROM part")
def _(t):
    return t.part.select("p_partkey", F.round(numeric.floored_ratio(c("p_partkey"), c("p_size") % 5), 6).alias("ratio"))


@query("mth5_union_bbox", """SELECT l_orderkey, min(l_quantity) AS x0, min(l_discount) AS y0, max(l_quantity) AS x1, max(l_discount) AS y1
    FROM lineitem GROUP BY l_orderkey""")
def _(t):
    # Corner points of one line are a bounded list; boxes of lines combine as plain minima and maxima.
    corners = F.array(F.struct(c("l_quantity").alias("x"), c("l_discount").alias("y")))
    boxes = t.lineitem.select("l_orderkey", numeric.points_bbox(corners).alias("b"))
    return boxes.groupBy("l_orderkey").agg(F.min("b.x0").alias("x0"), F.min("b.y0").alias("y0"),
                                           F.max("b.x1").alias("x1"), F.max("b.y1").alias("y1"))


# --- arrays, maps, JSON -------------------------------------------------------------------

@query("arr1_ordered_distinct", """SELECT doc_id, string_agg(w, '|' ORDER BY p) AS w FROM (
    SELECT doc_id, w, min(p) AS p FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS p FROM documents)
    GROUP BY doc_id, w) GROUP BY doc_id""")
def _(t):
    return t.documents.select("doc_id", joined(F.array_distinct(F.split("text", " "))).alias("w"))


@query("arr2_set_algebra", f"""SELECT memory_id, array_to_string(list_sort(list_intersect(a, b)), '|') AS both,
    array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), '|') AS only_a, list_has_all(b, a) AS subset
    FROM (SELECT memory_id, {S.event_ids()} AS a, [concat('ev', 100 + event_id % 4), 'inv3'] AS b FROM fx_memories)""")
def _(t):
    ids = with_payload(t.memories.withColumn("kind", F.lit("event"))).select(
        "memory_id", keys.event_identifiers(c("payload.event")).alias("a"),
        F.array(F.concat(F.lit("ev"), 100 + c("event_id") % 4), F.lit("inv3")).alias("b"))
    return ids.select("memory_id", joined(F.array_sort(F.array_intersect("a", "b"))).alias("both"),
                      joined(F.array_sort(F.array_except("a", "b"))).alias("only_a"),
                      (F.size(F.array_except("a", "b")) == 0).alias("subset"))


@query("arr3_best_reference", """WITH refs AS (SELECT memory_id, unnest(list_concat(ev_refs, [struct_pack(scheme := 'external_reference', value := 'again',
      normalized_value := concat('ev', 100 + k % 4), mention := 'again', confidence := CASE WHEN k % 3 = 0 THEN 0.95 ELSE 0.9 END)])) AS r,
      generate_subscripts(list_concat(ev_refs, [NULL]), 1) AS p FROM fx_memories)
    SELECT memory_id, r.scheme AS scheme, r.normalized_value AS normalized_value, r.value AS raw_value FROM refs
    QUALIFY row_number() OVER (PARTITION BY memory_id, r.scheme, r.normalized_value ORDER BY r.confidence DESC, p) = 1""")
def _(t):
    again = F.struct(F.lit("external_reference").alias("scheme"), F.lit("again").alias("value"),
                     F.concat(F.lit("ev"), 100 + c("k") % 4).alias("normalized_value"), F.lit("again").alias("mention"),
                     F.when(c("k") % 3 == 0, 0.95).otherwise(0.9).alias("confidence")).cast(schemas.IDENTIFIER)
    refs = t.memories.select("memory_id", F.explode(pl.best_references(
        F.concat(c("ev_refs").cast(f"array<{schemas.IDENTIFIER}>"), F.array(again)))).alias("r"))
    return refs.select("memory_id", "r.scheme", "r.normalized_value", c("r.value").alias("raw_value"))


@query("arr4_capped_list", "SELECT doc_id, array_to_string(string_split(text, ' ')[1:20], ' ') AS head, array_to_string(string_split(text, ' ')[-10:], ' ') AS tail FROM documents")
def _(t):
    w = F.split("text", " ")
    return t.documents.select("doc_id", F.array_join(F.slice(w, 1, 20), " ").alias("head"),
                              F.array_join(F.slice(w, -F.least(F.size(w), F.lit(10)), F.lit(10)), " ").alias("tail"))


@query("map1_claims", f"""SELECT memory_id, array_to_string(list_transform(list_sort(map_keys(m)), lambda k: concat(k, '=', m[k])), '|') AS claims
    FROM (SELECT memory_id, {S.claims()} AS m FROM fx_memories)""")
def _(t):
    m = with_payload(t.memories.withColumn("kind", F.lit("event"))).select("memory_id", pl.claim_map(c("payload.event")).alias("m"))
    return m.select("memory_id", joined(F.transform(F.array_sort(F.map_keys("m")),
                                                    lambda k: F.concat(k, F.lit("="), c("m")[k]))).alias("claims"))


@query("map2_claim_differences", f"""SELECT a.memory_id, {S.differences('a.m', 'b.m')} AS diff
    FROM (SELECT memory_id, event_id, {S.claims()} AS m FROM fx_memories) a JOIN (SELECT event_id, {S.claims()} AS m FROM fx_memories) b ON b.event_id = a.event_id + 1""")
def _(t):
    m = with_payload(t.memories.withColumn("kind", F.lit("event"))).select(
        "memory_id", "event_id", pl.claim_map(c("payload.event")).alias("m"))
    other = m.select((c("event_id") - 1).alias("event_id"), c("m").alias("n"))
    return m.join(other, "event_id").select("memory_id", pl.differences_text(pl.claim_differences(c("m"), c("n"))).alias("diff"))


@query("jsn1_sorted_json", """SELECT event_id, concat('{"event_id":', event_id, ',"event_type":"', event_type, '","props":', json(props), ',"user_id":', user_id, '}') AS js FROM events""")
def _(t):
    props = F.from_json("props", "struct<k:bigint>")
    return t.events.select("event_id", F.to_json(F.struct(
        "event_id", "event_type", props.alias("props"), "user_id")).alias("js"))


def raw_preference():
    return (
        F.when(c("k") % 3 == 0, F.format_string('{"preference":{"phrase":"use %d","strength":"High","consent":"yes"}}', "k"))
        .when(c("k") % 3 == 1, F.format_string('{"description":"use %d","strength":0.25,"applicability_conditions":"at work","consent":true}', "k"))
        .otherwise(F.format_string('{"preferred_behavior":"use %d","applicability_conditions":["a","b"],"strength":"weird"}', "k")))


@query("jsn2_payload_aliases", """SELECT event_id, concat('use ', k) AS behavior, CAST(CASE k % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.25 ELSE 0.5 END AS DOUBLE) AS strength,
    CASE k % 3 WHEN 1 THEN 'at work' WHEN 2 THEN 'a|b' ELSE '' END AS conditions, k % 3 <> 2 AS consent FROM fx_memories""")
def _(t):
    p = t.memories.select("event_id", pl.normalise(F.lit("preference"), raw_preference())["preference"].alias("p"))
    return p.select("event_id", c("p.preferred_behavior").alias("behavior"), c("p.strength").alias("strength"),
                    joined(c("p.applicability_conditions")).alias("conditions"), c("p.consent").alias("consent"))


@query("jsn3_candidate_validation", """SELECT event_id, k % 4 < 2 AS valid FROM fx_memories""")
def _(t):
    raw = (F.when(c("k") % 4 == 0, F.format_string('{"subject":"s%d","predicate":"is","object":"o"}', "k"))
           .when(c("k") % 4 == 1, F.format_string('{"knowledge":{"subject":"s%d","predicate":"is","object":"o"}}', "k"))
           .when(c("k") % 4 == 2, F.lit('{"subject":"","predicate":"is","object":"o"}')).otherwise(F.lit("not json")))
    good, bad = quality.validate_candidates(t.memories.select("event_id", F.lit("knowledge").alias("kind"), raw.alias("payload")))
    return good.select("event_id", F.lit(True).alias("valid")).unionByName(bad.select("event_id", F.lit(False).alias("valid")))


@query("dq1_field_constraints", """SELECT memory_id, array_to_string(list_filter([CASE WHEN event_id % 4 = 0 THEN 'confidence' END,
      CASE WHEN scope = 'session' AND event_id % 3 = 0 THEN 'session_id' END], lambda x: x IS NOT NULL), '|') AS failed FROM fx_memories""")
def _(t):
    spoiled = t.memories.withColumns({
        "confidence": F.when(c("event_id") % 4 == 0, c("confidence") + 1.5).otherwise(c("confidence")),
        "session_id": F.when(c("event_id") % 3 != 0, c("session_id"))})
    return spoiled.select("memory_id", joined(sc.violations(sc.memory_checks())).alias("failed"))


@query("dq2_unique_and_referential", """SELECT 'duplicate' AS problem, concat(l_orderkey, '-', l_linenumber) AS key FROM lineitem
    GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 UNION ALL
    SELECT 'orphan', CAST(o.o_orderkey AS STRING) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)""")
def _(t):
    twice = quality.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])
    orphans = quality.orphans(t.orders.withColumnRenamed("o_orderkey", "l_orderkey"), t.lineitem, ["l_orderkey"])
    return (twice.select(F.lit("duplicate").alias("problem"), F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("key"))
            .unionByName(orphans.select(F.lit("orphan").alias("problem"), c("l_orderkey").cast("string").alias("key"))))


@query("fld1_modality_relabel", """SELECT point_id, CASE collection WHEN 'video_segment' THEN 'video' ELSE collection END AS stored, collection AS shown FROM fx_points""")
def _(t):
    stored = quality.stored_modality(c("collection"))
    return t.points.select("point_id", stored.alias("stored"), quality.retrieval_modality(stored).alias("shown"))
