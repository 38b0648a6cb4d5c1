import random

import numpy as np
import pytest

from palimpsest.llm import near as N
from palimpsest.llm import words as W


def labelled(text):
    words, seen, out = (text or "").encode().split(), {}, []
    size = min(N.SHINGLE, len(words))
    for at in range(len(words) - size + 1) if words else []:
        gram = tuple(words[at:at + size])
        seen[gram] = seen.get(gram, 0) + 1
        out.append((gram, seen[gram]))
    return out


def common(a, b):
    """Plain longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def edited(words, count):
    words = list(words)
    for _ in range(count):
        at = random.randrange(len(words))
        words[at:at + random.choice([0, 1, 1])] = [f"e{random.randrange(10 ** 6)}"]
    return " ".join(words)


def data(groups=12, hot=60):
    random.seed(8)
    rows, n = [], 0
    vocabulary = [f"w{i}" for i in range(400)]
    for _ in range(groups):
        base = [random.choice(vocabulary) for _ in range(random.randrange(60, 120))]
        for _ in range(random.randrange(1, 6)):
            rows.append((n, edited(base, random.randrange(0, 5))))
            n += 1
    base = [random.choice(vocabulary) for _ in range(100)]
    rows += [(n + i, edited(base, random.randrange(0, 3))) for i in range(hot)]
    rows += [(500 + i, rows[2][1]) for i in range(20)]
    rows += [(600, None), (601, ""), (602, "a b"), (603, "a  b"), (604, "b a"), (605, "x y " * 5000), (606, "x y " * 5001), (None, rows[2][1]), (3, rows[3][1]), (None, "only here")]
    random.shuffle(rows)
    return rows


def test_classes_equal_brute_force(spark):
    rows = data()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "2 as words", "'t' as entry").repartition(4)
    got = N.near_classes(df).collect()
    texts = sorted({t or "" for _, t in rows if not (t or "").startswith("x y")})
    grams = {t: labelled(t) for t in texts}
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[i + 1:]:
            if len(set(grams[a]) & set(grams[b])) * 1.8 >= 0.8 * (len(grams[a]) + len(grams[b])) - 1e-9 and grams[a]:
                same = common(grams[a], grams[b])
                if same >= 0.8 * (len(grams[a]) + len(grams[b]) - same):
                    root[max(find(a), find(b))] = min(find(a), find(b))
            elif grams[a] == grams[b]:
                root[max(find(a), find(b))] = min(find(a), find(b))
    key = lambda i: (i is None, i or 0)
    least = {}
    for id_, t in rows:
        if not (t or "").startswith("x y"):
            least[find(t or "")] = min(least.get(find(t or ""), (True, 1)), key(id_))
    want = sorted((key(i), least[find(t or "")]) for i, t in rows if not (t or "").startswith("x y"))
    assert sorted((key(r["id"]), key(r["class_id"])) for r in got if r["id"] not in (605, 606)) == want
    assert {r["class_id"] for r in got if r["id"] in (605, 606)} == {605}
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == len({find(t) for t in texts}) + 1
    assert all(r["id"] == r["class_id"] for r in got if r["kept"])


def test_whole_rows_with_clashing_columns(spark):
    rows = data(4, 10)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "doc_id as row", "array(text) as rest", "named_struct('c0', doc_id) as words").repartition(3)
    got = N.drop_near_copies(df)
    assert got.dtypes == df.dtypes
    kept = sorted((r["id"] is None, r["id"] or 0) for r in N.near_classes(df).where("kept").collect())
    got = got.collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == kept and all(r["rest"] == [r["text"]] and r["words"]["c0"] == r["doc_id"] for r in got)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_classes(empty).count() == 0 and N.drop_near_copies(empty).count() == 0


def test_alignment_equals_common_subsequence_and_bounds_hold():
    random.seed(2)
    for _ in range(200):
        base = [random.choice("abcdefgh") for _ in range(random.randrange(5, 40))]
        a, b = " ".join(base), edited(base, random.randrange(0, 6))
        x, y = labelled(a), labelled(b)
        hashed = [N.shingles(W.hashes(d, *W.spans(d, np.array([0, len(d)]))[:2])) for d in (np.frombuffer(t.encode(), np.uint8) for t in (a, b))]
        same = common(x, y)
        got = N.matched(*hashed, N.band(len(x), len(y), 0.8))
        assert got == same if same >= 0.8 * (len(x) + len(y) - same) else got <= same


@pytest.mark.parametrize("step", [1 << 15, 7])
def test_sketch_takes_the_least_shingles_in_text_order(monkeypatch, step):
    monkeypatch.setattr(N, "_STEP", step)
    found = W.mixed(np.arange(50, dtype=np.uint64))
    values = found[None, :] * N._FACTORS[:4, None]
    values ^= values >> np.uint64(31)
    values *= np.uint64(W.BYTE_BASE)
    want = []
    for i in range(4):
        value = W.mixed(np.array([i], np.uint64))
        for at in sorted(np.argsort(values[i])[:3]):
            value = W.mixed(value * np.uint64(W.WINDOW_BASE) + found[at])
        want.append(int(value.view(np.int64)[0]))
    assert N.sketch(found, 4, 3) == want
    assert N.sketch(found[::-1].copy(), 4, 3) != want and N.sketch(found[:0], 4, 3) == []
