import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import negatives as N

NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, is_anchor, positives=5, negatives=10):
    """Every anchor against every row with Python's own integers."""
    cut = lambda n: max(-(1 << 63), min((1 << 63) - 1, n))
    part = [(i, label, [cut(math.floor(256 * x)) for x in v]) for i, v, label in rows
            if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, label, v) in enumerate(part):
        if not is_anchor(i):
            continue
        scored = sorted((-cut(sum(a * b for a, b in zip(v, w))), j, other) for m, (j, other, w) in enumerate(part) if len(w) == len(v) and m != n)
        for minus, j, _ in [s for s in scored if s[2] == label and s[1] != i][:positives]:
            fits = [s for s in scored if s[2] != label and 30 * -minus <= 100 * -s[0] <= 90 * -minus][:negatives]
            out += [(i, j, rank, other, -minus, -score) for rank, (score, other, _) in enumerate(fits, 1)]
    return sorted(out)


def rows():
    random = np.random.default_rng(5)
    out = []
    for n in range(600):
        centre = random.standard_normal(6) if n % 7 == 0 else centre  # noqa: F821
        out.append((n, (centre + random.standard_normal(6) * 0.4).tolist(), int(random.integers(0, 4))))
    out += [(1000 + n, out[0][1], n % 2) for n in range(120)]  # a hot vector, ties by id
    out += [(None, out[0][1], 0), (2000, None, 0), (2010, [], 0), (2020, [None] * 6, 0), (2030, [math.nan] * 6, 0), (2040, [math.inf] * 6, 0), (2050, out[0][1], None),
            (2060, [1.0, 2.0], 0), (2070, [1.0, 1.5], 1), (2080, [1.0, 1.7], 0), (2090, [0.0] * 6, 2), (2100, [1e30, -1e30, 1e18, 0.0, 0.0, 1.0], 2), (10, [0.5] * 6, 3)]
    return out


@pytest.mark.parametrize("block", [7, 256])
def test_equals_brute_force(spark, block):
    data = rows()
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' as id", "3 as size", "4 as q", "5 as `group`").repartition(3)
    report = []
    got = N.hard_negatives(df, F.col("vec_id") % 10 == 0, block_rows=block, report=report)
    assert got.columns == NAMES
    assert sorted(tuple(r) for r in got.collect()) == brute(data, lambda i: i % 10 == 0)
    assert all(0 < read <= total for read, total in report)


def test_bounds_skip_blocks_of_separate_clusters(spark):
    random = np.random.default_rng(8)
    centres = np.eye(8) * 4
    data = [(n, (centres[n % 8] + random.standard_normal(8) * 0.05).tolist(), n % 8 // 2) for n in range(2000)]
    report = []
    got = N.hard_negatives(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 50 == 0, block_rows=32, report=report)
    assert sorted(tuple(r) for r in got.collect()) == brute(data, lambda i: i % 50 == 0)
    assert report[0][0] < 0.5 * report[0][1]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert N.hard_negatives(df, F.col("vec_id") % 10 == 0).count() == 0
    lone = spark.createDataFrame([(0, [1.0, 2.0], 0)], "vec_id long, embedding array<float>, label int")
    assert N.hard_negatives(lone, F.lit(True)).count() == 0


def test_curve_visits_every_cell_once_by_steps_of_one():
    bits, dims = 3, 3
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    place = N.hilbert(cells, bits)
    assert sorted(place) == list(range(len(cells)))
    path = cells[np.argsort(place)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_bounds_hold():
    random = np.random.default_rng(2)
    block = random.integers(-9, 9, (50, 5))
    anchors = random.integers(-9, 9, (20, 5))
    least, most = N.interval(anchors, block.min(0)[None], block.max(0)[None])
    scores = anchors @ block.T
    assert (scores >= least).all() and (scores <= most).all()
