"""Work of a turn's candidates follows the memories that some chat sees, and their results stay."""

from types import SimpleNamespace

from helpers import NOW, event, records, ref, values
from pyspark.sql import functions as F

from palimpsest.operators import context as cx, graph, identifiers as ids, jobs, skew
from palimpsest.plans import retrieval


def chats(spark):
    return spark.createDataFrame([("q1", "o", "s1", "p1", "Alpha", "Please check EV-101."), ("q2", "o", "s2", None, None, "hello")],
                                 "query_id string, owner_id string, session_id string, project_id string, project_scope string, text string")


def memories(spark):
    payload = event([ref("EV-101")], summary="Please check the depot")
    rows = [("id", {}), ("name", {"project_id": None}), ("both", {"project_id": "p9"}), ("session", {"scope": "session", "session_id": "s2"}),
            ("id", {}), ("id", {"owner_id": "x"}), ("owner", {"owner_id": "x"}), ("far", {"project_id": "p9", "project_scope": "Beta"}),
            ("user", {"scope": "user"}), ("off", {"scope": "session", "session_id": "s7"})]
    return records(spark, [{"memory_id": m, "payload": payload, **row} for m, row in rows])


def tables(spark):
    found = memories(spark)
    vector = F.array(F.lit(0.6), F.lit(0.8)).cast("array<float>")
    return SimpleNamespace(
        spark=spark, records=found.drop("subject_id"), memories=found, turns=chats(spark),
        memory_vectors=found.select("memory_id").distinct().withColumn("embedding", vector),
        memory_subjects=found.select("memory_id", F.lit("s").alias("subject_id")).where("memory_id IN ('session', 'far')"),
        subject_identifiers=spark.createDataFrame([("s", "external_reference", "ev101")], "subject_id string, scheme string, normalized_value string"))


def test_only_memories_in_sight_get_texts_and_vectors(spark):
    found = retrieval.memory_points(tables(spark))
    # every row of a seen id stays, as often as it is there
    assert [r[0] for r in values(found, "memory_id")] == ["both", "id", "id", "id", "name", "session"]


def test_seen_memories_give_the_hits_of_all(spark):
    t = tables(spark)
    vector = F.array(F.lit(0.6), F.lit(0.8)).cast("array<float>")
    every = jobs.memory_points(t.records).join(t.memory_vectors.withColumnRenamed("embedding", "vector"), "memory_id")
    asked = t.turns.withColumn("vector", vector)
    columns = ["query_id", "memory_id", "number", "rank", "score"]
    plain = values(cx.place_hits(asked, every, 10), *columns)
    assert values(cx.place_hits(asked, retrieval.memory_points(t), 10), *columns) == plain and len(plain) > 3


def test_seen_memories_give_the_exact_candidates_of_all(spark):
    t = tables(spark)
    full = t.records.join(t.memory_subjects, "memory_id", "left")
    columns = ["query_id", "memory_id", "stage", "rank"]
    plain = ids.candidates(ids.query_references(t.turns), full, ids.reference_rows(full), t.subject_identifiers, NOW, 5)
    assert values(retrieval.exact_candidates(t), *columns) == values(plain, *columns) != []


def test_keys_are_met_in_a_shuffle_when_many(spark, monkeypatch):
    df = spark.createDataFrame([(1, 2), (1, 2), (3, 4), (None, 5), (6, None)], "a int, b int")
    for most in (100, 0):
        monkeypatch.setattr(skew, "BROADCAST_KEYS", most)
        keys = skew.wanted(spark.createDataFrame([(1,), (1,), (4,)], "k int"))
        assert values(skew.among(df, keys, F.col("a")), "a", "b") == [(1, 2), (1, 2)]
        assert values(skew.among(df, keys, F.col("a"), F.col("b")), "a", "b") == [(1, 2), (1, 2), (3, 4)]
    none = skew.wanted(spark.createDataFrame([(None,)], "k int"))
    assert values(skew.among(df, none, F.col("a")), "a", "b") == [(None, 5)]


def test_expansion_reads_only_edges_around_the_seeds(spark):
    found = records(spark, [{"memory_id": m} for m in "abcdef"])
    edge = lambda n, a, b: (n, a, b, "related", found.first()["created_at"])
    links = spark.createDataFrame([edge(1, "a", "b"), edge(2, "c", "a"), edge(3, "d", "e"), edge(4, "e", "f"), edge(1, "a", "b")],
                                  "relationship_id int, from_memory_id string, to_memory_id string, relationship_type string, created_at timestamp")
    seeds = spark.createDataFrame([("q1", "a", 1)], "query_id string, memory_id string, position int")
    near, ends = graph.around(seeds, links, found)
    assert [r[0] for r in values(near, "relationship_id")] == [1, 1, 2] and [r[0] for r in values(ends, "memory_id")] == ["a", "b", "c"]
    expanded = lambda r, m: values(graph.expand(seeds, graph.edges(r, m, NOW), graph.nodes(m, NOW), chats(spark)), "query_id", "memory_id", "graph_rank")
    assert expanded(near, ends) == expanded(links, found) != []
