import hashlib
import random
import re

import numpy as np

from palimpsest.llm import private as P

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    """The four patterns as they are stated."""
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            double = [sum(divmod(2 * int(d), 10)) if n % 2 else int(d) for n, d in enumerate(reversed(digits))]
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and sum(double) % 10 == 0, "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), list(PLAIN).index(kind), m.end()))
    return sorted(out)


def test_base_spans_equal_the_stated_patterns():
    random.seed(1)
    parts = ["a", "Z9", "@", ".", "-", "+", "1", "255", "256", "007", " ", "  ", "(", ")", "4111 1111 1111 1111", "x@y.z", "é", "🙂", "\n", "%", "_", "+49 (30) 1234-5678", "10.0.0.1", "1.2.3", "..", "@@", "-@-.-"]
    for _ in range(4000):
        text = "".join(random.choices(parts, k=random.randint(0, 14)))
        assert P.base_spans(text) == brute(text), repr(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000, "@" * 300_000, "a@" * 150_000, "+" + "1 " * 150_000, "12 345 " * 50_000, "ab:" * 100_000, "at " * 100_000, "1::" * 100_000, "x at y dot " * 30_000):
        base = P.base_spans(text)
        P.candidates(text, base)


def test_luhn_and_parts():
    assert P.luhn("4111111111111111") and not P.luhn("4111111111111112")
    assert P.base_spans("0000255.1.1.001 999.1.1.1") == [(0, P.IP, 15)]


def test_estimation_finds_good_labelers():
    random.seed(2)
    counts = {}
    for _ in range(4000):
        true = random.random() < 0.3
        say = lambda right: ("+" if true else "-") if random.random() < right else ("-" if true else "+")
        v = say(0.95) + say(0.9) + say(0.6) + (say(0.9) if random.random() < 0.3 else "0") + "00"
        counts[v] = counts.get(v, 0) + 1
    told, table, share = P.estimate(list(counts.items()))
    assert abs(share - 0.3) < 0.05
    assert table[1, 0, 2] > 0.9 and table[0, 0, 0] > 0.9 and 0.5 < table[1, 2, 2] < 0.7
    assert told["++++00"] > 0.95 and told["----00"] < 0.05


def corpus():
    random.seed(3)
    filler = ["the", "meeting", "was", "long", "and", "we", "left", "early", "with", "version", "page"]
    words = lambda k: " ".join(random.choices(filler, k=k))
    out = []
    for n in range(240):
        text = [f"write to mail user{n}@host{n % 9}.com please", f"call phone +1 (415) 555-{1000 + n} today", f"server ip 10.0.{n}.7 down", "card 4111-1111-1111-1111 visa", words(12)][n % 5]
        out.append((n, f"{words(5)} {text} {words(4)}"))
    return out


def test_added_spans_and_clean_documents(spark):
    masked = "contact by mail: jane.doe [at] host3 [dot] com please"
    loose = "call phone (415) 555-0123 today"
    extra = [(1000, masked), (1001, loose), (1002, "see version 10.20 30.40 50.60 page 12-13-14"), (1003, None), (1004, ""), (1005, "look at example.com and order number 1234567890123456"), (None, "no id")]
    data = corpus() + extra + extra[:2]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as id", "'x' as spans", "2 as kind", "3 as base")
    report = {}
    got = [r.asDict() for r in P.personal_data(df.repartition(5), report=report).collect()]
    assert len(got) == len(data) and set(report) == set(P.KINDS)
    texts = {}
    for i, t in data:
        texts[i] = t
    for row in got:
        base = brute(texts[row["id"]])
        names = [f"{P.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert [row[f"n_{k}"] for k in P.KINDS] == [sum(k == n for _, k, _ in base) for n in range(4)]
        assert row["base_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert set(names) <= set(filter(None, row["spans"].split(",")))
    spans = {r["id"]: r["spans"] for r in got}
    start = masked.index("jane")
    assert spans[1000] == f"email:{start}:{masked.index(' please')}"
    assert spans[1001] == f"phone:{loose.index('(')}:{loose.index(' today')}"
    assert spans[1002] == spans[1003] == spans[1004] == spans[1005] == ""
    again = {r["id"]: r["spans"] for r in P.personal_data(df.repartition(1)).collect()}
    assert again == spans


def test_training_does_not_depend_on_partitions(spark):
    random.seed(5)
    rows = [(sorted(random.sample(range(60), 5)), random.random()) for _ in range(300)]
    df = spark.createDataFrame(rows, "features array<int>, truth double")
    one, many = P.train(df.coalesce(1), 3), P.train(df.repartition(7), 3)
    assert np.array_equal(one, many)


def test_empty_table(spark):
    assert P.personal_data(spark.createDataFrame([], "doc_id string, text string")).count() == 0
