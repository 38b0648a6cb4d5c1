import math

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import mixing as M


def table(spark):
    rows = [(i, "big" if i % 10 < 6 else None if i % 10 == 6 else f"s{i % 10}", " ".join("w" * (i % 17)) if i % 23 else None) for i in range(3000)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as id", "2 as draw", "3 as copies", "4 as block")


def totals(df):
    return {r[0]: r[1] for r in df.groupBy("source").agg(F.sum(M.tokens_of(F.col("text")))).collect()}


def entropy(values):
    whole = sum(values)
    return -sum(v / whole * math.log(v / whole) for v in values if v)


def test_exponent_meets_entropy_or_repetition_limit(spark):
    df = table(spark)
    held = totals(df)
    frame = spark.createDataFrame([(str(k), v) for k, v in held.items()], "source string, tokens long")
    power = M.exponent(frame, 0.9, None, None)
    assert entropy([v ** power for v in held.values()]) == pytest.approx(0.9 * math.log(len(held)), abs=1e-6)
    power = M.exponent(frame, None, 2.0, None)
    assert (max(held.values()) / min(held.values())) ** (1 - power) == pytest.approx(2.0, abs=1e-6)
    assert M.exponent(frame, None, None, None) == 0.0 and M.exponent(frame, 0.01, None, None) == 1.0


@pytest.mark.parametrize("goals", [{}, {"budget": 9000.0, "most_repeats": None}, {"budget": 60000.0, "target_entropy": None, "most_repeats": 9.0}])
def test_budgets_are_met_by_block_permutations(spark, goals):
    df = table(spark)
    held = totals(df)
    got = M.mixture(df, block_tokens=100, **goals).collect()
    frame = spark.createDataFrame([(str(k), v) for k, v in held.items()], "source string, tokens long")
    power = M.exponent(frame, goals.get("target_entropy", M.TARGET_ENTROPY), goals.get("most_repeats", M.MOST_REPEATS), goals.get("budget"))
    weight = {k: v ** power / sum(x ** power for x in held.values()) for k, v in held.items()}
    budget = goals.get("budget") or max(held[k] / weight[k] for k in held)
    for source, tokens in held.items():
        taken = [r for r in got if r["source"] == source]
        goal = weight[source] * budget
        assert goal - 17 <= sum(r["n_tokens"] for r in taken) <= goal + 1e-6
        full = math.floor(goal / tokens + 1e-9)
        for epoch in range(1, full + 1):
            assert sum(r["n_tokens"] for r in taken if r["epoch"] == epoch) == tokens
        assert max(r["epoch"] for r in taken) <= full + 1
        last = [r for r in taken if r["epoch"] == full + 1]
        blocks = {r["block"] for r in last}
        own = {}
        for r in taken:
            if r["epoch"] == 1 and full:
                own.setdefault(r["block"], set()).add(r["id"])
        if full and blocks:  # every block but the last is taken whole
            assert sum({r["id"] for r in last if r["block"] == b} != own[b] for b in blocks) <= 1
    assert all(0 <= r["place"] <= 1 for r in got)


def test_whole_rows_repeat_as_often_as_the_mixture_says(spark):
    df = table(spark)
    rows = M.mix_rows(df)
    assert rows.dtypes == df.dtypes
    a = {r[0]: r[1] for r in rows.groupBy("doc_id").count().collect()}
    b = {r[0]: r[1] for r in M.mixture(df).groupBy("id").count().collect()}
    assert a == b and len(a) == 3000
    plan = rows._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_and_degenerate_tables(spark):
    df = table(spark)
    assert M.mixture(df.limit(0)).count() == 0 and M.mix_rows(df.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, "a", None), (1, "a", None), (None, None, "")], "doc_id long, source string, text string")
    assert M.mixture(blank).count() == 3 and M.mix_rows(blank).count() == 3
    one = spark.createDataFrame([(1, "a", "x y"), (1, "a", "x y"), (None, "a", "z")], "doc_id long, source string, text string")
    assert M.mix_rows(one).count() == 3
