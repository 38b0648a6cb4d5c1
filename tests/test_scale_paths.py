"""The paths taken for large or skewed inputs give the plain result."""

import random
import re
import time
from datetime import datetime, timedelta

from helpers import event, records, ref, values
from pyspark.sql import Window as W, functions as F

import __spark_entry__ as entry
from palimpsest.operators import evidence, graph, hybrid, keyed, lifecycle as lc, ordered, quality, search, skew, subjects
from palimpsest.plans import fixtures
from palimpsest.sources import partitioned
from palimpsest.streaming import outbox

NOW_AT = datetime(2024, 1, 20)


def skewed(spark):
    """One group holds a third and more of all rows."""
    return spark.range(3000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"), F.col("id").alias("n"),
        F.when(F.col("id") % 7 == 0, F.concat(F.lit("v"), "id")).alias("v"))


def test_bucketed_windows_equal_plain_windows(spark):
    df, w = skewed(spark), W.partitionBy("key").orderBy("n")
    bucket = F.floor(F.col("n") / 100)
    plain = df.select("n", F.row_number().over(w).cast("long").alias("x"), F.last("v", True).over(w.rowsBetween(W.unboundedPreceding, -1)).alias("y"))
    numbered = ordered.ordinal(df, ["key"], [F.col("n")], bucket, "x")
    before = ordered.last_before(df, ["key"], [F.col("n")], bucket, F.col("v"), "y", F.col("n"))
    assert values(numbered, "n", "x") == values(plain, "n", "x")
    assert values(before, "n", "y") == values(plain, "n", "y")
    dense = numbered.withColumn("x", F.col("x") - 1)
    expected = dense.select("n", F.collect_list("n").over(W.partitionBy("key").orderBy("x").rowsBetween(-5, -1)).alias("items"))
    assert values(ordered.recent(dense, ["key"], "x", F.col("n"), 5, "items", span=40), "n", "items") == values(expected, "n", "items")


def test_split_search_equals_whole_search(spark, monkeypatch):
    corpus = spark.range(400).select(
        "id", F.lit("c").alias("collection"), F.when(F.col("id") % 3 < 2, "hot").otherwise("cold").alias("place"),
        F.array(*[F.sin(F.col("id") * (i + 1)).cast("float") for i in range(6)]).alias("vector"),
        F.concat_ws(" ", F.lit("common"), F.concat(F.lit("t"), F.col("id") % 9), F.concat(F.lit("u"), F.col("id") % 5)).alias("text"))
    queries = corpus.where("id < 20").select(F.concat(F.lit("q"), "id").alias("query_id"), "vector", "text", F.explode(F.array(F.lit("hot"), F.lit("cold"))).alias("place"))
    for top, name in ((search.dense_top, "dense_rank"), (search.sparse_top, "sparse_rank")):
        found = []
        for bucket, block, held in ((20_000, 1_000, 500_000), (50, 7, 1)):
            monkeypatch.setattr(search, "BUCKET_ROWS", bucket)
            monkeypatch.setattr(search, "BLOCK_ROWS", block)
            monkeypatch.setattr(search, "HELD_RESULTS", held)
            found.append(values(top(queries, corpus, 7), "query_id", "id", "score", name))
        assert found[0] == found[1] and len(found[0]) == 140


def test_scoring_lets_out_the_best_of_a_task_only(spark):
    """Many small places and a large one: rows that leave the scoring step do not grow with blocks or places."""
    corpus = spark.range(6000).select("id", F.lit("c").alias("collection"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 400)).alias("place"),
                                      F.array(*[F.sin(F.col("id") * (i + 1)).cast("float") for i in range(6)]).alias("vector"))
    queries = corpus.where("id < 40").select(F.concat(F.lit("q"), "id").alias("query_id"), "vector", "place")
    top = search.dense_top(queries, corpus, 5)
    assert top.count() == 40 * 5
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan.split("MapInPandas")[0]


def test_fusion_is_symmetric_and_keeps_dense_order(spark):
    ranked = lambda rows, name: spark.createDataFrame(rows, f"query_id string, collection string, id int, {name} int")
    dense = ranked([("q", "c", 1, 1), ("q", "c", 2, 2)], "dense_rank")
    sparse = ranked([("q", "c", 2, 1), ("q", "c", 3, 2)], "sparse_rank")
    fused = [r["id"] for r in hybrid.fuse(dense, sparse, 10).orderBy("rank").collect()]
    assert fused == [2, 1, 3]
    tied = hybrid.fuse(dense.where("id = 1"), ranked([("q", "c", 3, 1)], "sparse_rank"), 10)
    assert [r["id"] for r in tied.orderBy("rank").collect()] == [1, 3]


def test_expansion_is_one_visible_hop(spark):
    now = "2024-01-20 00:00:00"
    rows = records(spark, [{"memory_id": m, "project_id": p, "status": s} for m, p, s in (
        ("a", "p1", "active"), ("b", "p1", "active"), ("c", "p1", "active"), ("d", "p2", "active"), ("old", "p1", "superseded"))])
    links = spark.createDataFrame([(1, "a", "b", "related"), (2, "b", "c", "related"), (3, "a", "d", "related"), (4, "old", "a", "superseded_by")],
                                  "relationship_id long, from_memory_id string, to_memory_id string, relationship_type string").withColumn("created_at", F.lit(now).cast("timestamp"))
    edges, nodes = graph.edges(links, rows, now), graph.nodes(rows, now)
    assert values(edges, "relationship_id", "label") == [(1, "RELATED"), (2, "RELATED"), (4, "SUPERSEDED_BY")]
    chats = spark.createDataFrame([("q", "o", "s1", "p1", "Alpha")], "query_id string, owner_id string, session_id string, project_id string, project_scope string")
    seeds = spark.createDataFrame([("q", "a", 1)], "query_id string, memory_id string, position int")
    assert values(graph.expand(seeds, edges, nodes, chats), "memory_id", "seed_memory_id") == [("b", "a")]
    new_nodes, kept = graph.sync_nodes(nodes, edges, rows.where("memory_id = 'b'").withColumn("status", F.lit("expired")), now)
    assert values(kept, "relationship_id") == [(4,)] and new_nodes.count() == 5


def replay_last_batch(checkpoint):
    """Forget that the last batch was committed, as a crash after its output would."""
    commits = sorted((p for p in (checkpoint / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    commits[-1].unlink()
    (checkpoint / "commits" / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    return len(commits)


def test_capture_stream_over_batches_and_a_replay_equals_batch(spark, tmp_path):
    rows = records(spark, [{"memory_id": f"m{i:02}", "payload": event(refs=[ref(f"A-{i % 3}")], time=["Friday", "Monday"][i % 2])} for i in range(12)])
    for part in range(4):
        rows.where(f"int(substr(memory_id, 2)) between {part * 3} and {part * 3 + 2}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    arrivals = outbox.read_changes(spark, str(tmp_path / "in"), rows.schema, files_per_trigger=1)
    run = lambda: outbox.capture_stream(arrivals, rows.limit(0), str(tmp_path / "live"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    want = values(lc.capture_events(rows.limit(0), rows), "memory_id", "outcome")
    run()
    assert values(spark.read.parquet(str(tmp_path / "out")), "memory_id", "outcome") == want
    assert replay_last_batch(tmp_path / "cp") == 4
    run()
    assert values(spark.read.parquet(str(tmp_path / "out")), "memory_id", "outcome") == want


def test_turns_continue_over_batches_and_a_replay(spark, tmp_path):
    sent = [(f"c{i % 2}", f"m{i:02}", NOW_AT + timedelta(minutes=7 * i)) for i in range(20)]
    rows = spark.createDataFrame(sent, "session_id string, message_id string, created_at timestamp")
    for part in range(4):
        rows.where(f"int(substr(message_id, 2)) div 5 = {part}").repartition(3).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    messages = outbox.read_changes(spark, str(tmp_path / "in"), rows.schema, files_per_trigger=1)
    want = sorted((s, m, sum(1 for x in sent if x[0] == s and x[2] <= at)) for s, m, at in sent)
    for _ in range(2):
        outbox.number_turns(messages, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert values(outbox.current(spark, str(tmp_path / "out"), ["message_id"]), "session_id", "message_id", "turn_index") == want
        replay_last_batch(tmp_path / "cp")


def test_expiry_goes_on_after_a_failing_sweep(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(outbox.C, "EXPIRY_SWEEP_MIN_SECONDS", 1)
    ticks = spark.createDataFrame([(NOW_AT,)], "timestamp timestamp")
    seen = []

    def sweep(now):
        seen.append(now)
        if len(seen) == 1:
            raise ValueError("first sweep fails")

    ticks.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = outbox.expiry_loop(outbox.read_changes(spark, str(tmp_path / "in"), ticks.schema, files_per_trigger=1), sweep, str(tmp_path / "cp"), seconds=1)
    try:
        for wanted in (1, 2):
            until = time.time() + 60
            while len(seen) < wanted and time.time() < until:
                time.sleep(0.3)
            ticks.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 1 HOUR")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert seen[:2] == ["2024-01-20 00:00:00", "2024-01-20 01:00:00"] and query.isActive
    finally:
        query.stop()


def test_long_frames_reach_over_several_buckets(spark):
    rows = spark.range(1, 31).selectExpr("'g' as g", "id as position")
    got = ordered.recent(rows, ["g"], "position", F.col("position"), 10, "items", span=4)
    assert values(got.select("position", F.array_join("items", ",").alias("items")), "position", "items") == sorted(
        [(i, ",".join(str(j) for j in range(max(1, i - 10), i))) for i in range(1, 31)], key=repr)


def test_a_deep_chain_of_bindings_settles_and_none_is_empty(spark):
    rows = records(spark, [{"memory_id": f"m{i}", "created_at": NOW_AT + timedelta(minutes=i), "payload": event(refs=[ref(f"A-{i}"), ref(f"A-{i + 1}")])} for i in range(6)])
    known = spark.createDataFrame([], "owner_id string, scope string, scope_key string, scheme string, normalized_value string, subject_id string")
    bound, _ = subjects.bind_in_order(rows, known)
    assert bound.count() == 6 and bound.select("subject_id").distinct().count() == 1
    none, _ = subjects.bind_in_order(rows.limit(0), known)
    assert none.count() == 0


def test_two_contents_of_new_evidence_are_a_violation(spark):
    old = spark.createDataFrame([("e0", "h0")], "evidence_id string, content_hash string")
    new = spark.createDataFrame([("e1", "a", 1), ("e1", "b", 1), ("e2", "c", 1), ("e0", "h0", 2)], "evidence_id string, content_hash string, binding_id int")
    stored, violations, requests = evidence.upsert_evidence(old, new)
    assert values(stored, "evidence_id") == [("e0",), ("e2",)] and values(violations.distinct(), "evidence_id") == [("e1",)]
    assert values(requests, "evidence_id", "binding_id") == [("e0", 2), ("e2", 1)]


def test_repeated_keys_in_a_delta_fold_to_the_newest(spark):
    rows = records(spark, [{"memory_id": "a", "status": "active"}])
    delta = records(spark, [{"memory_id": "a", "status": "expired", "updated_at": NOW_AT}, {"memory_id": "a", "status": "rejected", "updated_at": NOW_AT - timedelta(days=1)}])
    assert values(keyed.upsert_memories(rows, delta), "memory_id", "status") == [("a", "expired")]
    assert values(keyed.repeated_keys(delta, ["memory_id"]), "memory_id", "rows") == [("a", 2)]


def test_plans_have_no_nested_loops(spark):
    """Visibility joins stay equi-joins, and large sides are never broadcast by hint."""
    for name in ("flt4_record_eligibility", "jn4_document_status", "ret13_identifier_candidates", "ret5_collection_search"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan), name


def test_pushdown_reaches_the_scan(spark):
    plan = entry.queries()["src1_table_scan"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string,c_acctbal:double>" in plan


def test_contract():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    rest = {name for name in set(queries) - set(oracles) if not re.match(r"op\d+_|pipeline$", name)}
    assert rest <= {"chk4_section_blocks", "chk8_ingest"}


def bound_one_by_one(rows, known):
    """Subjects of events taken in order: ``rows`` are (id, place, identifiers), ``known`` (place, identifier) -> subject."""
    known, out = dict(known), {}
    for memory, place, names in rows:
        found = {known[place, n] for n in names if (place, n) in known}
        out[memory] = memory if not found else found.pop() if len(found) == 1 else None
        if out[memory] is not None:
            for n in names:
                known.setdefault((place, n), out[memory])
    return out


def test_binding_in_order_equals_one_by_one(spark):
    random.seed(11)
    data = [(f"m{i:03}", random.choice(["p1", "p1", "p2"]), sorted({f"A-{random.randint(0, 25)}" for _ in range(random.choice([1, 1, 2, 2, 3]))})) for i in range(160)]
    rows = records(spark, [{"memory_id": m, "project_id": p, "created_at": NOW_AT + timedelta(minutes=i), "payload": event(refs=[ref(n) for n in names])} for i, (m, p, names) in enumerate(data)])
    held = [("p1", "A-3", "S1"), ("p1", "A-4", "S2"), ("p2", "A-3", "S1")]
    known = spark.createDataFrame([("o", "project", f"project:{p}", "external_reference", n.lower().replace("-", ""), s) for p, n, s in held],
                                  "owner_id string, scope string, scope_key string, scheme string, normalized_value string, subject_id string")
    rounds = []
    bound, _ = subjects.bind_in_order(rows, known, rounds)
    want = bound_one_by_one(data, {(p, n): s for p, n, s in held})
    name = {r["memory_id"]: r["id"] for r in rows.select("memory_id", subjects.new_subject_id(F.col("memory_id")).alias("id")).collect()}
    assert {r["memory_id"]: r["subject_id"] for r in bound.collect()} == {m: name.get(s, s) for m, s in want.items()}
    assert None in want.values() and len(rounds) < 30


def test_a_chain_of_ten_thousand_bindings_takes_few_rounds(spark):
    count = 10_000
    chain = spark.range(count).select(F.format_string("m%06d", "id").alias("memory_id"), (F.lit(NOW_AT) + F.make_dt_interval(secs=F.col("id"))).alias("created_at"), "id")
    blank = records(spark, [{"memory_id": "x", "payload": event(refs=[ref("A-1")])}])
    refs = F.transform(F.array(F.col("id"), F.col("id") + 1), lambda i: F.struct(F.lit("external_reference").alias("scheme"), i.cast("string").alias("value"), i.cast("string").alias("normalized_value"), i.cast("string").alias("mention"), F.lit(0.9).alias("confidence")))
    rows = (blank.drop("memory_id", "created_at").crossJoin(chain).withColumn("payload", F.col("payload").withField("event.identifier_references", refs)).select(*blank.columns))
    rounds = []
    known = spark.createDataFrame([], "owner_id string, scope string, scope_key string, scheme string, normalized_value string, subject_id string")
    bound, _ = subjects.bind_in_order(rows, known, rounds)
    assert bound.count() == count and bound.select("subject_id").distinct().count() == 1
    assert len(rounds) == 1 and sum(rounds) <= 20


def test_a_hot_identifier_is_split(spark):
    """One identifier held by half of all memories: the join's tasks stay even and the pairs are those of a plain join."""
    index = spark.range(40_000).select(F.lit("p").alias("place"), F.lit("s").alias("scheme"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("v"), F.col("id") % 5000)).alias("normalized_value"),
                                       F.concat(F.lit("m"), "id").alias("memory_id"))
    asked = spark.createDataFrame([("q1", "p", "s", "hot"), ("q2", "p", "s", "v7"), ("q3", "p", "s", "none")], "query_id string, place string, scheme string, normalized_value string")
    keys = ["place", "scheme", "normalized_value"]
    heavy = skew.heavy_keys(index, keys).collect()
    assert [r["heavy"].endswith("hot") for r in heavy] == [True] and heavy[0]["salts"] == 32
    joined = skew.salted_join(asked, index, keys, "memory_id")
    assert joined.columns == asked.join(index, keys).columns
    assert joined.count() == 20_000 + 8 and joined.distinct().count() == 20_008
    parts = joined.where("query_id = 'q1'").select(F.pmod(F.xxhash64("memory_id"), F.lit(32)).alias("part")).groupBy("part").count()
    sizes = sorted(r["count"] for r in parts.collect())
    assert len(sizes) == 32 and sizes[-1] <= 2 * sizes[16]


def test_a_keyed_write_leaves_other_folders_alone(spark, tmp_path):
    rows = records(spark, [{"memory_id": f"m{i}"} for i in range(200)])
    table = partitioned.KeyedTable(spark, str(tmp_path / "t"), ["memory_id"], parts=16)
    table.create(rows)
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "t").glob("*/*.parquet")}
    before = files()
    delta = records(spark, [{"memory_id": "m7", "status": "expired", "updated_at": NOW_AT}, {"memory_id": "new", "status": "candidate"}])
    assert table.apply(delta, keyed.upsert_memories) in (1, 2)
    after = files()
    assert len({n: t for n, t in after.items() if before.get(n) == t}) >= 14
    assert values(table.read(), "memory_id", "status") == values(keyed.upsert_memories(rows, delta), "memory_id", "status")
    assert table.apply(delta.limit(0), keyed.upsert_memories) == 0 and files() == after


def test_search_skips_blocks_and_stays_exact(spark, monkeypatch):
    """Clustered vectors and texts of one heavy group: few blocks are read, and the result is that of reading all."""
    monkeypatch.setattr(search, "BLOCK_ROWS", 25)
    random.seed(4)
    rows = []
    for i in range(1200):
        centre = [1.0 if d == i % 8 else 0.0 for d in range(8)]
        rows.append((i, "c", "p", [x + random.gauss(0, 0.02) for x in centre], " ".join(random.choices(["alpha", "beta", "gamma"], k=1 + (300 if i % 40 == 0 else 3)))))
    corpus = spark.createDataFrame(rows, "id long, collection string, place string, vector array<float>, text string")
    queries = corpus.where("id < 16").select(F.concat(F.lit("q"), "id").alias("query_id"), "place", "vector", "text")
    for top, shares, name in ((search.dense_top, search.dense_shares, "dense_rank"), (search.sparse_top, search.sparse_shares, "sparse_rank")):
        share = shares(queries, corpus, 10).first()
        assert 0 < share["blocks_read"] < 0.5 * share["blocks"]
        got = values(top(queries, corpus, 10), "query_id", "id", "score", name)
        with monkeypatch.context() as patch:
            patch.setattr(search, "BLOCK_ROWS", 5000)
            assert values(top(queries, corpus, 10), "query_id", "id", "score", name) == got
    lone = spark.createDataFrame([(5000, "c", "p", None, "unrelated words")], corpus.schema)
    assert search.sparse_top(queries, lone, 10).count() == 0 and search.dense_top(queries, lone, 10).count() == 0


def test_records_of_one_row_group_are_derived_by_many_tasks(spark, tmp_path, monkeypatch):
    kinds = F.element_at(F.array(*[F.lit(kind) for kind in ("error", "click", "view", "signup", "buy")]), (F.col("id") % 5 + 1).cast("int"))
    spark.range(3000).select(F.col("id").alias("event_id"), F.expr("timestamp_seconds(1704067200 + id * 600)").cast("timestamp_ntz").alias("ts"), (F.col("id") % 40).alias("user_id"), kinds.alias("event_type"),
                             (F.col("id") % 90 / 3).alias("value"), F.format_string('{"k": %d}', F.col("id") % 100).alias("props")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    tables = fixtures.Tables(spark, str(tmp_path))
    monkeypatch.setattr(fixtures, "EVENT_BYTES", 1 << 10)
    derived = tables._derived_memories()
    assert derived.rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism
    columns = [column for column in derived.columns if column != "sol_environment"]
    assert values(derived, *columns) == values(tables.view("fx_memories"), *columns)


def test_payload_is_parsed_once_for_all_fields_it_is_tested_for(spark):
    raw = [(1, "event", '{"event_type":"Shipment","summary":"s"}'), (2, "event", '{"event_type":"","summary":"s"}'),
           (3, "preference", '{"phrase":"short"}'), (4, None, "{}"), (5, "entity", None), (5, "entity", None)]
    good, bad = quality.validate_candidates(spark.createDataFrame(raw, "n int, kind string, payload string"))
    assert good.columns == bad.columns == ["n", "kind", "payload"]
    assert sorted(r["n"] for r in good.collect()) == [1, 3]
    assert sorted((r["n"], r["payload"]) for r in bad.collect() if r["n"] < 5) == [(2, raw[1][2]), (4, "{}")]
    assert [r["n"] for r in bad.where("n = 5").collect()] == [5, 5]
    for side in (good, bad):
        plan = side._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.splitlines() if re.match(r"\W*Filter\b", line) and "from_json" in line]
