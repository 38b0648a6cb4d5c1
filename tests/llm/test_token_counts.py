import math
import random

from palimpsest.llm import token_counts as C


def plain(token, scores, byte_score):
    best = [(0.0, 0)]
    for end in range(1, len(token) + 1):
        found = []
        for begin in range(end):
            if token[begin:end] in scores:
                found.append((best[begin][0] + scores[token[begin:end]], -best[begin][1] - 1))
        if token[end - 1] not in scores:
            size = len(token[end - 1].encode())
            found.append((best[end - 1][0] + size * byte_score, -best[end - 1][1] - size))
        top = max(found)
        best.append((top[0], -top[1]))
    return best[-1][1]


def test_shared_walk_equals_plain_programming():
    random.seed(1)
    alphabet = "abcé"
    scores = {"".join(random.choice(alphabet) for _ in range(random.randrange(1, 4))): -random.random() * 5 for _ in range(25)}
    scores.pop("c", None)
    walk = C.Walk(C.suffixes(scores), -6.0)
    tokens = sorted({"".join(random.choice(alphabet + "z") for _ in range(random.randrange(0, 9))) for _ in range(400)})
    for token in tokens:
        assert walk.end(token) == plain(token, scores, -6.0), token


def test_whole_table_with_edges(spark, monkeypatch):
    monkeypatch.setattr(C, "KEPT_COUNTS", 5)
    long = "word " * 30000
    rows = [(1, "Hello world hello"), (2, None), (3, ""), (4, " \n"), (5, long), (1, "Hello world hello"), (None, "日本\x1c語 🙂"), (6, "x" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as n_tokens")
    got = C.token_counts(df).collect()
    known, byte_score = C.model(C.default_vocabulary())
    scores = {piece: score for piece, score in known.items() if score is not None}
    short = {r["id"]: r for r in got}
    assert len(got) == len(rows)
    for id_, text in rows:
        if id_ != 6:
            words = (text or "").encode().split()
            each = {w: plain(C.MARK + w.decode(), scores, byte_score) for w in set(words)}
            row = short[id_]
            assert (row["n_tokens"], row["n_words"], row["n_bytes"]) == (sum(each[w] for w in words), len(words), len((text or "").encode()))
    assert C.token_counts(df.limit(0)).count() == 0 and math.isfinite(byte_score)
