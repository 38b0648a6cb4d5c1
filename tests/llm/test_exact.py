import hashlib
import random

import pytest

from palimpsest.llm import exact as E

BLANK = str.maketrans("", "", " \t\n\x0b\x0c\r")


def expected(rows):
    groups = {}
    for id_, text in rows:
        groups.setdefault((text or "").translate(BLANK), []).append((-len(text or ""), id_ is None, id_ or 0))
    out = []
    for id_, text in rows:
        norm = (text or "").translate(BLANK)
        best = min(groups[norm])
        out.append((id_, None if best[1] else best[2], len(groups[norm]), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def data():
    random.seed(4)
    texts = ["", None, " \n", "é a", "éa", "a b", "ab", "x" * 3000] + ["".join(random.choice("ab \t") for _ in range(random.randrange(12))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900 + i, "hot text") for i in range(300)] + [(5, texts[5]), (None, "hot  text"), (None, None)]
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize("table_bytes", [1 << 26, 4000])
def test_decisions_with_and_without_spilling(spark, table_bytes):
    rows = data()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "'x' as entry", "2 as digest").repartition(5)
    got = E.exact_groups(df, table_bytes=table_bytes).collect()
    assert sorted(((r["id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == expected(rows)
    digests = {r["text_sha256"] for r in got}
    assert sum(r["kept"] for r in got) == len(digests)
    assert all(r["id"] == r["keep_id"] for r in got if r["kept"])


@pytest.mark.parametrize("table_bytes", [1 << 26, 4000])
def test_whole_rows(spark, table_bytes):
    rows = data()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id + 1 as number", "array(doc_id) as whole", "named_struct('a', text) as key")
    got = E.drop_exact_copies(df.repartition(5), table_bytes=table_bytes)
    assert got.dtypes == df.dtypes
    got = got.collect()
    best = {}
    for id_, text in rows:
        norm = (text or "").translate(BLANK)
        best[norm] = min(best.get(norm, (1,)), (-len(text or ""), id_ is None, id_ or 0))
    assert sorted((r["text"] or "").translate(BLANK) for r in got) == sorted(best)
    for r in got:
        norm = (r["text"] or "").translate(BLANK)
        assert best[norm] == (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0) and r["key"]["a"] == r["text"] and r["whole"] == [r["doc_id"]]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert E.exact_groups(empty).count() == 0 and E.drop_exact_copies(empty).columns == empty.columns and E.drop_exact_copies(empty).count() == 0


def test_table_compares_contents_not_keys(tmp_path):
    rows = [(7, b"a", [(1, 1, 1), 1, None, [1]]), (7, b"b", [(1, 2, 2), 1, None, [2]]), (7, b"a", [(2, 3, 3), 1, None, [3]])]
    tables = list(E.grace(iter(rows), 1, str(tmp_path)))
    found = {c: v for t in tables for c, v in zip(t.contents, t.values)}
    assert found[b"a"][:2] == [(2, 3, 3), 2] and sorted(found[b"a"][3]) == [1, 3] and found[b"b"][1] == 1
