import hashlib
import random

import numpy as np
import pytest

from palimpsest.llm import substrings as S
from palimpsest.llm import words as W


def words_of(text):
    return [w for w in (text or "").encode().split()]


def expected(rows, width):
    first, docs = {}, sorted({(1 if i is None else 0, i or 0, t or "") for i, t in rows})
    for rank, (_, _, text) in enumerate(docs):
        found = words_of(text)
        for at in range(len(found) - width + 1):
            first.setdefault(tuple(found[at:at + width]), (rank, at))
    out = []
    for id_, text in rows:
        found, rank = words_of(text), docs.index((1 if id_ is None else 0, id_ or 0, text or ""))
        gone = set()
        for at in range(len(found) - width + 1):
            if first[tuple(found[at:at + width])] != (rank, at):
                gone |= set(range(at, at + width))
        out.append((id_, len(found), len(gone), b" ".join(w for n, w in enumerate(found) if n not in gone).decode()))
    return sorted(out, key=repr)


def data():
    random.seed(6)
    word = lambda: random.choice(["a", "b", "ç", "dd", "\x1cx"])
    passage = " ".join(f"p{n}" for n in range(30))
    rows = [(i, " ".join(word() for _ in range(random.randrange(0, 25)))) for i in range(60)]
    rows += [(100 + i, f"q{i} {passage}\n{passage} r{i}") for i in range(40)] + [(200, None), (201, ""), (202, "a " * 3000), (None, passage), (5, rows[5][1]), (5, passage), (7, " \t ")]
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize("width,small", [(4, False), (4, True), (20, False)])
def test_equals_brute_force(spark, monkeypatch, width, small):
    if small:
        monkeypatch.setattr(S, "CHUNK_WINDOWS", 50)
        monkeypatch.setattr(S, "RANGE_WINDOWS", 40)
    rows = data()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as kept", "'x' as bucket").repartition(4)
    got = S.drop_repeated_passages(df, width=width).collect()
    # rows with one id and different texts are ordered by a checksum; the data keep their passages apart
    assert sorted(((r["id"], r["n_words"], sum(p["after"] - p["first"] for p in r["removed"]), r["kept"]) for r in got if r["id"] != 5), key=repr) == \
        [e for e in expected(rows, width) if e[0] != 5]
    assert len(got) == len(rows)
    for r in got:
        assert all(a["after"] < b["first"] for a, b in zip(r["removed"], r["removed"][1:]))


def test_empty_table(spark):
    assert S.drop_repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_intervals():
    assert S.intervals(np.array([0, 1, 5, 30]), 20) == [(0, 25), (30, 50)] and S.intervals(np.array([0, 20]), 20) == [(0, 40)] and S.intervals(np.zeros(0, int), 20) == []


def test_word_and_window_hashes_depend_on_content_only(monkeypatch):
    texts = ["", "ab  c\tab", "c", "é\x0bé é", "x" * 50 + " ab"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.cumsum([0, *[len(t.encode()) for t in texts]])
    for step in (1 << 20, 8):
        monkeypatch.setattr(W, "STEP", step)
        starts, ends, first = W.spans(data, bounds)
        found = [data[a:b].tobytes() for a, b in zip(starts, ends)]
        assert found == [w for t in texts for w in t.encode().split()] and np.diff(first).tolist() == [len(t.split()) for t in texts]
        hashed = W.hashes(data, starts, ends)
        assert all((found[i] == found[j]) == (hashed[i] == hashed[j]) for i in range(len(found)) for j in range(len(found)) if len(found[i]) <= step and len(found[j]) <= step)
    line = np.array([1, 2, 3, 1, 2, 3, 9], np.uint64)
    windows = W.window_hashes(line, 3)
    assert windows[0] == windows[3] and len(set(windows.tolist())) == 4 and hashlib.sha256  # position does not matter
