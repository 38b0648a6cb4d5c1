"""Job queue, projections, rebuilds, extension points and stream-shaped operators."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from palimpsest import ext
from palimpsest.functions import scope as sc
from palimpsest.operators import context as cx, evidence as ev, graph, jobs, keyed, lifecycle as lc
from palimpsest.plans import sqlparts as S
from palimpsest.plans.fixtures import NOW
from palimpsest.plans.lifecycle import CAPTURE, events_split
from palimpsest.plans.registry import query
from palimpsest.plans.relational import EDGES_SQL, MEM_POINTS, NOW_SQL, PROJ
from palimpsest.session import shared_folder
from palimpsest.streaming import outbox as ob, state

c = F.col
QUEUE_NOW = "2000-01-01 00:00:00"


def ts(column):
    return F.coalesce(F.date_format(column, "yyyy-MM-dd HH:mm:ss"), F.lit(""))


def queue(t):
    """Queue as left by an earlier run: one finished job per requested memory and target."""
    return jobs.enqueue(t.jobs.limit(0), t.job_feed.where(c("target") == "graph")).withColumns({
        "status": F.lit("completed"), "attempts": F.lit(3), "error": F.lit("old")})


@query("job1_enqueue", f"""SELECT memory_id, target, 'pending' AS status, CASE WHEN target = 'graph' THEN 3 ELSE 0 END AS attempts, {S.ts('max(updated_at)')} AS updated_at FROM fx_job_feed GROUP BY memory_id, target""")
def _(t):
    out = jobs.enqueue(queue(t), t.job_feed)
    return out.select("memory_id", "target", "status", "attempts", ts("updated_at").alias("updated_at"))


OPEN = f"(status = 'pending' OR (status = 'running' AND locked_at < TIMESTAMP '{QUEUE_NOW}' - INTERVAL 300 SECOND))"


@query("job2_claim", f"SELECT job_id, attempts + 1 AS attempts, 'running' AS status, 'w9' AS locked_by FROM fx_jobs WHERE {OPEN} AND target = 'graph' ORDER BY updated_at, job_id LIMIT 500")
def _(t):
    return jobs.claim(t.jobs, QUEUE_NOW, 500, "w9", targets=["graph"]).select("job_id", "attempts", "status", "locked_by")


@query("job2_claimable", f"SELECT job_id FROM fx_jobs WHERE {OPEN}")
def _(t):
    return jobs.claimable(t.jobs, QUEUE_NOW).select("job_id")


@query("job3_finish", """SELECT job_id, CASE WHEN mine THEN CASE WHEN attempts % 2 = 0 THEN 'failed' ELSE 'completed' END ELSE status END AS status, coalesce(CASE WHEN mine THEN CASE WHEN attempts % 2 = 0 THEN 'boom' END ELSE error END, '') AS error,
    coalesce(CASE WHEN NOT mine THEN locked_by END, '') AS locked_by FROM (SELECT *, status = 'running' AND coalesce(locked_by, '') = 'w1' AND attempts % 3 <> 0 AS mine FROM fx_jobs)""")
def _(t):
    results = t.jobs.where(c("attempts") % 3 != 0).select("job_id", F.when(c("attempts") % 2 == 0, "boom").alias("failure"))
    out = jobs.finish(t.jobs, results, F.lit("w1"), NOW)
    return out.select("job_id", "status", F.coalesce("error", F.lit("")).alias("error"), F.coalesce("locked_by", F.lit("")).alias("locked_by"))


@query("job4_requeue_failed", f"SELECT job_id, CASE WHEN status = 'failed' THEN 'pending' ELSE status END AS status, {S.ts(f'''CASE WHEN status = 'failed' THEN {NOW_SQL} ELSE updated_at END''')} AS updated_at FROM fx_jobs")
def _(t):
    return jobs.requeue_failed(t.jobs, NOW).select("job_id", "status", ts("updated_at").alias("updated_at"))


@query("job5_enqueue_all", "SELECT memory_id, unnest(['vector', 'graph']) AS target FROM fx_memories")
def _(t):
    return jobs.enqueue_all(t.memories.select("memory_id"), "memory_id", sc.at(NOW)).select("memory_id", "target")


@query("agg9_outcome_counts", "SELECT target, count(*) FILTER (status = 'pending') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'running') AS skipped FROM fx_jobs GROUP BY 1")
def _(t):
    outcome = F.when(c("status") == "pending", "completed").when(c("status") == "running", "skipped").otherwise(c("status"))
    return jobs.outcome_counts(t.jobs.select("target", outcome.alias("outcome")))


def memory_sync(t):
    """Claimed jobs for a third of the memories against projections that are out of date."""
    third = t.records.where(c("event_id") % 3 == 0)
    claimed = jobs.enqueue_all(third.select("memory_id"), "memory_id", sc.at(NOW)).withColumn("job_id", F.concat_ws("/", "memory_id", "target"))
    lost = claimed.unionByName(claimed.where(c("target") == "graph").withColumns({"memory_id": F.concat(F.lit("gone-"), "memory_id"), "job_id": F.concat(F.lit("gone-"), "job_id")}))
    nodes = graph.nodes(t.memories, NOW)
    edges = graph.edges(t.relationships, t.memories, NOW)
    return jobs.sync_memories(lost, t.records, t.relationships, jobs.memory_points(t.records), nodes, edges, NOW)


@query("job6_sync_memories", f"""SELECT 'failed' AS what, count(*) AS n FROM fx_memories WHERE event_id % 3 = 0 UNION ALL SELECT 'completed', 2 * count(*) FROM fx_memories WHERE event_id % 3 = 0
    UNION ALL SELECT 'points', count(*) FROM fx_memories WHERE {MEM_POINTS} UNION ALL SELECT 'nodes', count(*) FROM fx_memories UNION ALL SELECT 'edges', count(*) FROM ({EDGES_SQL})""")
def _(t):
    out = memory_sync(t)
    outcome = F.when(c("failure").isNull(), "completed").otherwise("failed")
    done = out["results"].groupBy(outcome.alias("what")).agg(F.count("*").alias("n"))
    sizes = keyed.table_counts({name: out[name] for name in ("points", "nodes", "edges")})
    return done.unionByName(sizes.select(c("table_name").alias("what"), c("rows").alias("n")))


@query("job6_synced_edges", f"SELECT relationship_id, label FROM ({EDGES_SQL})")
def _(t):
    """After a partial sync of consistent projections the edges equal a full rebuild."""
    return memory_sync(t)["edges"].select("relationship_id", "label")


@query("job7_sync_evidence", f"""SELECT concat(evidence_id, '/', binding_id) AS job_id, CASE WHEN first_doc % 4 = 0 THEN 'skipped' ELSE 'completed' END AS outcome FROM fx_evidence JOIN fx_bindings USING (asset_id)
    UNION ALL SELECT concat('gone-', binding_id), 'failed' FROM fx_bindings""")
def _(t):
    evidence = t.evidence.withColumn("content", F.when(c("first_doc") % 4 == 0, " ").otherwise(c("content")))
    pairs = ev.projection_inputs(evidence, t.bindings).select("evidence_id", "binding_id")
    claimed = pairs.withColumn("job_id", F.concat_ws("/", "evidence_id", "binding_id")).unionByName(
        t.bindings.select(F.lit("missing").alias("evidence_id"), "binding_id", F.concat(F.lit("gone-"), "binding_id").alias("job_id")))
    nothing = ev.points_from(ev.projection_inputs(evidence, t.bindings)).limit(0)
    return jobs.sync_evidence(claimed, evidence, t.bindings, nothing)["results"].select("job_id", "outcome")


@query("job8_rebuild_graph", f"SELECT memory_id AS id, 'node' AS part, {PROJ} AS live FROM fx_memories UNION ALL SELECT CAST(relationship_id AS STRING), 'edge', true FROM ({EDGES_SQL})")
def _(t):
    nodes, edges = graph.rebuild(t.memories, t.relationships, NOW)
    return nodes.select(c("memory_id").alias("id"), F.lit("node").alias("part"), c("is_active").alias("live")).unionByName(
        edges.select(c("relationship_id").cast("string").alias("id"), F.lit("edge").alias("part"), F.lit(True).alias("live")))


@query("job9_rebuild_all", f"SELECT 'point' AS part, memory_id AS id FROM fx_memories WHERE {MEM_POINTS} UNION ALL SELECT 'node', memory_id FROM fx_memories UNION ALL SELECT 'edge', CAST(relationship_id AS STRING) FROM ({EDGES_SQL})")
def _(t):
    nodes, edges = graph.rebuild(t.memories, t.relationships, NOW)
    part = lambda df, name, key: df.select(F.lit(name).alias("part"), c(key).cast("string").alias("id"))
    return part(jobs.memory_points(t.records), "point", "memory_id").unionByName(part(nodes, "node", "memory_id")).unionByName(part(edges, "edge", "relationship_id"))


# --- extension points -----------------------------------------------------------------------

@query("ext1_parser", """SELECT path, seq, line AS content FROM (SELECT concat('/in/', doc_id) AS path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents)""")
def _(t):
    files = t.documents.select(F.concat(F.lit("/in/"), "doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    make = lambda: lambda path, content: [(line, None) for line in content.decode("utf-8").split("\n")]
    return ext.parse_files(files, make).select("path", c("seq").cast("long").alias("seq"), "content")


@query("ext1_paged_parser", """SELECT concat('/in/', g) AS path, CAST(page AS INT) AS page, CAST(row_number() OVER (PARTITION BY g ORDER BY page, n) - 1 AS INT) AS seq, content FROM (SELECT *, generate_subscripts(parts, 1) AS n, unnest(parts) AS raw FROM (
    SELECT conv_id AS g, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page, string_split(coalesce(text, ''), chr(10) || chr(10)) AS parts FROM conversations)), LATERAL (SELECT trim(raw, concat(' ', chr(9), chr(10), chr(13))) AS content) WHERE content <> ''""")
def _(t):
    """Paged files, one a conversation with a page a turn, through a table function beside their own columns."""
    pages = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\f")
    files = t.conversations.groupBy("conv_id").agg(F.encode(pages, "UTF-8").alias("content")).select(F.concat(F.lit("/in/"), "conv_id").alias("path"), "content")
    parse = ext.parser_table(lambda: ext.form_feed_pages)
    blocks = files.withColumnRenamed("content", "bytes").lateralJoin(parse(c("path").outer(), c("bytes").outer()))
    return blocks.select("path", "page", "seq", "content")


@query("ext2_encoder", "SELECT doc_id, CAST(length(text) AS DOUBLE) AS first, CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS second FROM documents")
def _(t):
    encode = ext.encoder(lambda: lambda texts: np.array([[len(x), x.count("e"), 0.0] for x in texts]), 2)
    vectors = t.documents.select("doc_id", encode(c("text")).alias("v"))
    return vectors.select("doc_id", c("v")[0].cast("double").alias("first"), c("v")[1].cast("double").alias("second"))


@query("ext3_pair_scorer", f"SELECT q.query_id, p.point_id, CAST(length(q.text) - length(p.content) AS DOUBLE) AS score FROM fx_queries q JOIN fx_points p ON {S.evidence_visible('p', 'q')}")
def _(t):
    scorer = ext.pair_scorer(lambda: lambda pairs: np.array([len(a) - len(b) for a, b in pairs]))
    places = t.queries.select("query_id", "text", F.explode(sc.evidence_chat_keys()).alias("place"))
    pairs = t.points.withColumn("place", sc.binding_key()).join(places, "place")
    return pairs.select("query_id", "point_id", scorer(c("text"), c("content")).alias("score"))


@query("ext4_supplied_decisions", "SELECT memory_id, 'update' AS outcome, CAST(k AS DOUBLE) AS confidence FROM fx_memories")
def _(t):
    rows = t.memories.select("memory_id", F.lit("update").alias("outcome"), F.lit(None).alias("existing_memory_id"), F.array().alias("matched_identifier_values"),
                             F.lit(None).alias("changed_claims"), c("k").alias("confidence"), F.lit("r").alias("reason"), F.lit(1).alias("ignored"))
    return ext.decisions(rows, "reconciliation_decisions").select("memory_id", "outcome", "confidence")


@query("ext5_semantic_retriever", f"SELECT q.query_id, m.memory_id FROM fx_turns q JOIN (SELECT owner_id, min(memory_id) AS memory_id FROM fx_memories GROUP BY 1) m USING (owner_id) JOIN fx_memories r ON r.memory_id = m.memory_id AND {S.visible('r', 'q')} WHERE {S.current('r.')}")
def _(t):
    """Any function from queries to ranked memories can take the place of vector search."""
    def retriever(queries):
        first = t.memories.groupBy("owner_id").agg(F.min("memory_id").alias("memory_id"))
        return queries.join(first, "owner_id").select("query_id", "memory_id", F.lit(1).alias("rank"), F.lit(0.5).alias("score"))
    return cx.rehydrate(retriever(t.turns), t.memories, t.turns, NOW).select("query_id", "memory_id")


# --- streams, run until everything is read -----------------------------------------------------

def folder(t):
    return f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"


def stream_of(t, name):
    """The given table as a stream of its file."""
    return ob.read_changes(t.spark, t.folder, t.table(name).schema, name_filter=f"{name}.parquet")


def files_of(t, df, number):
    """``df`` as a stream of files in the order of ``number`` (0, 1, ...; null counts as 0), a number's files at once.

    Each number is written by as many tasks as there are cores.
    """
    path, number = folder(t), F.coalesce(number, F.lit(0))
    width = t.spark.sparkContext.defaultParallelism
    for part in range(FILES):
        df.where(number == part).repartition(width).write.mode("append").parquet(path)
    return ob.read_changes(t.spark, path, df.schema, files_per_trigger=width)


FILES = 4


def finished(t, started, path):
    started.awaitTermination()
    return t.spark.read.parquet(path)


@query("str1_outbox_drain", "SELECT concat('mem-', lpad(CAST(l_orderkey AS STRING), 9, '0')) AS memory_id, CASE WHEN l_linestatus = 'F' THEN 'graph' ELSE 'vector' END AS target, CASE WHEN bool_and(m.memory_id IS NULL) THEN 'failed' ELSE 'completed' END AS status, CASE WHEN bool_and(m.memory_id IS NULL) THEN 'no record' ELSE '' END AS error, CAST(count(DISTINCT coalesce(l_linenumber % 4, 0)) AS INT) AS attempts FROM lineitem LEFT JOIN fx_memories m ON m.memory_id = concat('mem-', lpad(CAST(l_orderkey AS STRING), 9, '0')) GROUP BY 1, 2")
def _(t):
    """Requests for one key come in several batches; the result has one finished job a key, with an attempt for each batch."""
    requests = t.lineitem.select(
        F.concat(F.lit("mem-"), F.lpad(c("l_orderkey").cast("string"), 9, "0")).alias("memory_id"),
        F.when(c("l_linestatus") == "F", "graph").otherwise("vector").alias("target"), c("l_shipdate").cast("timestamp").alias("updated_at"), "l_linenumber")
    stream = files_of(t, requests, F.pmod("l_linenumber", F.lit(FILES))).drop("l_linenumber")
    known = t.memories.select("memory_id", F.lit(True).alias("known"))
    project = lambda taken: taken.join(known, "memory_id", "left").select("job_id", F.when(c("known").isNull(), "no record").alias("failure"))
    out = folder(t)
    ob.drain_jobs(stream, project, out, out + "-checkpoint", "w1", NOW).awaitTermination()
    return ob.drained_jobs(t.spark, out).select("memory_id", "target", "status", F.coalesce("error", F.lit("")).alias("error"), "attempts")


@query("str2_once_per_turn", "SELECT DISTINCT concat('turn', event_id % 997) AS source_turn_id FROM events")
def _(t):
    requests = stream_of(t, "events").select(F.concat(F.lit("turn"), c("event_id") % 997).alias("source_turn_id"), F.lit("v1").alias("extraction_version"),
                                             c("ts").cast("timestamp").alias("requested_at"))
    out = folder(t)
    return finished(t, ob.run(ob.once_per_turn(requests, "60 days"), ob.into_folder(out), out + "-checkpoint"), out).select("source_turn_id")


@query("str3_expiry", f"SELECT event_id, 'expired' AS status FROM events WHERE event_id % 6 IN (1, 2, 3) AND event_id % 3 = 0 AND ts + INTERVAL 168 HOUR <= {NOW_SQL}")
def _(t):
    """Timers at the end of validity fire as the clock of arriving rows moves on; the last tick is NOW."""
    e = c("event_id")
    rows = t.events.where(c("ts") <= F.lit(NOW).cast("timestamp")).select(
        e.cast("string").alias("memory_id"), F.when((e % 6).isin(1, 2, 3), "active").otherwise("candidate").alias("status"),
        F.when(e % 3 == 0, c("ts") + F.make_dt_interval(hours=F.lit(168))).alias("valid_to"), c("ts").cast("timestamp").alias("at"))
    tick = t.spark.range(1).select(F.lit(None).cast("string").alias("memory_id"), F.lit("tick").alias("status"), F.lit(None).cast("timestamp").alias("valid_to"), F.lit(NOW).cast("timestamp").alias("at"))
    begin, end = (f"TIMESTAMP '{when}'" for when in ("2024-01-01 00:00:00", NOW))
    number = F.least(F.lit(FILES - 1), F.greatest(F.lit(0), F.floor((F.unix_timestamp("at") - F.unix_timestamp(F.expr(begin))) * (FILES - 1) / (F.unix_timestamp(F.expr(end)) - F.unix_timestamp(F.expr(begin))))))
    out = folder(t)
    stream = files_of(t, rows.unionByName(tick), number)
    fired = finished(t, ob.run(state.expire_on_time(stream), ob.into_folder(out), out + "-checkpoint"), out)
    return fired.select(c("memory_id").cast("long").alias("event_id"), "status")


@query("str3_expiry_loop", f"SELECT event_id, CAST(tick AS INT) AS tick FROM (SELECT event_id, min(CASE WHEN tick = 1 THEN 2 ELSE tick END) AS tick FROM events JOIN (SELECT unnest([0, 1, 2, 3]) AS tick) ON ts + INTERVAL 168 HOUR <= {NOW_SQL} + to_days(2 * tick) GROUP BY 1)")
def _(t):
    """Four ticks of the periodic sweep; the second sweep fails, and what it would have expired is expired by the third."""
    out, done = folder(t), []
    ticks = t.spark.range(FILES).select("id", (F.lit(NOW).cast("timestamp") + F.make_dt_interval(days=(c("id") * 2).cast("int"))).alias("timestamp"))
    rows = t.events.select(c("event_id"), c("event_id").cast("string").alias("memory_id"), F.lit("active").alias("status"), (c("ts") + F.make_dt_interval(hours=F.lit(168))).alias("valid_to"))

    def sweep(now):
        done.append(now)
        number = len(done) - 1
        if number == 1:
            raise RuntimeError("the projection store is away")
        earlier = t.spark.read.parquet(*[f"{out}/tick={n}" for n in range(number) if n != 1]).select("event_id") if number else rows.select("event_id").limit(0)
        lc.expire_due(rows.join(earlier, "event_id", "left_anti"), now).records.select("event_id").write.mode("overwrite").parquet(f"{out}/tick={number}")

    path = folder(t)
    for n in range(FILES):
        ticks.where(c("id") == n).drop("id").coalesce(1).write.mode("append").parquet(path)
    ob.expiry_loop(ob.read_changes(t.spark, path, ticks.drop("id").schema, files_per_trigger=1), sweep, out + "-checkpoint", seconds=None).awaitTermination()
    return t.spark.read.parquet(out).select("event_id", c("tick").cast("int").alias("tick"))


@query("str4_capture", f"WITH {CAPTURE} SELECT memory_id, outcome, existing FROM cap")
def _(t):
    """Events that arrive in several batches, captured against the live ones and earlier batches; equals the batch result."""
    old, new = events_split(t)
    new = new.withColumn("status", F.lit("candidate"))  # as events arrive
    bounds = new.select(F.percentile_approx("created_at", [i / FILES for i in range(1, FILES)]).alias("b")).first()["b"] or []
    number = sum([(c("created_at") > F.lit(b)).cast("int") for b in bounds], F.lit(0))
    out = folder(t)
    ob.capture_stream(files_of(t, new, number), old, out + "-live", out, out + "-checkpoint").awaitTermination()
    return ob.current(t.spark, out, ["memory_id"]).select("memory_id", "outcome", F.coalesce("existing_memory_id", F.lit("")).alias("existing"))


@query("str5_turn_index", "SELECT concat('c', conv_id) AS session_id, concat('m-', conv_id, '-', turn) AS message_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_index FROM conversations")
def _(t):
    messages = t.conversations.select(F.concat(F.lit("c"), "conv_id").alias("session_id"), F.concat_ws("-", F.lit("m"), "conv_id", "turn").alias("message_id"),
                                      F.timestamp_seconds(c("turn") * 60).alias("created_at"), "turn")
    stream = files_of(t, messages, F.least(F.floor(c("turn") / 3), F.lit(FILES - 1))).drop("turn")
    out = folder(t)
    ob.number_turns(stream, out, out + "-checkpoint", span_seconds=240).awaitTermination()
    return ob.current(t.spark, out, ["session_id", "message_id"]).select("session_id", "message_id", "turn_index")


@query("str6_latest_status", "SELECT o_custkey AS binding_id, max_by(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS run_id, max_by(o_orderstatus, struct_pack(a := o_orderdate, b := o_orderkey)) AS status FROM orders GROUP BY 1")
def _(t):
    runs = t.orders.select(c("o_custkey").alias("binding_id"), c("o_orderkey").alias("run_id"), c("o_orderstatus").alias("status"), c("o_orderdate").alias("created_at"))
    out = folder(t)
    stream = files_of(t, runs, F.pmod("run_id", F.lit(FILES)))
    ob.run(ob.latest_status(stream), ob.into_folder(out), out + "-checkpoint", "update").awaitTermination()
    return ob.current(t.spark, out, ["binding_id"]).select("binding_id", "run_id", "status")


@query("str7_latency_feed", "SELECT run_id, stage, round(sum(duration_ms), 3) AS total_ms, count(*) AS jobs FROM fx_latency GROUP BY 1, 2")
def _(t):
    log = stream_of(t, "events").select(c("value").alias("duration_ms"), c("event_type").alias("stage"), F.concat(F.lit("run"), c("user_id") % 40).alias("run_id"))
    out = folder(t)
    return finished(t, ob.run(ob.stage_totals(log), ob.into_folder(out, "complete"), out + "-checkpoint", "complete"), out)
