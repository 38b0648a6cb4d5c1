import math

import numpy as np
import pytest

from palimpsest.llm import embeddings as E


def rows():
    random = np.random.default_rng(3)
    out, n = [], 0
    for label in (0, 1, None, -4):
        for _ in range(6):
            centre = random.standard_normal(16)
            for _ in range(random.integers(1, 9)):
                out.append((n, (centre + random.standard_normal(16) * 0.15).tolist(), label))
                n += 1
    copy = out[0][1]
    out += [(1000 + i, copy, 0) for i in range(50)] + [(1100, [2 * x for x in copy], 0), (1101, copy, 1)]
    out += [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 16, 0), (2003, [None] + copy[1:], 0), (2004, [math.nan] + copy[1:], 0), (2005, [math.inf] + copy[1:], 0),
            (2006, copy[:8], 0), (2007, [1e-300] * 16, 0), (2008, [1e300] * 16, 0)]
    return out


@pytest.mark.parametrize("block", [4, 1024])
def test_equals_brute_force(spark, block):
    data = rows()
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as id", "2 as unit", "3 as links").repartition(4)
    got = {r["id"]: r for r in E.near_vectors(df, block_rows=block).collect()}
    unit = {}
    for id_, vector, label in data:
        if label is not None and vector and all(x is not None and math.isfinite(x) for x in vector) and any(vector):
            x = np.array(vector) / max(abs(v) for v in vector)
            unit[id_] = (label, x / np.linalg.norm(x))
    links = {i: [j for j in unit if j != i and unit[i][0] == unit[j][0] and len(unit[i][1]) == len(unit[j][1]) and unit[i][1] @ unit[j][1] >= 0.93] for i in unit}
    root = {i: i for i, _, _ in data}
    for i in links:
        todo, seen = [i], {i}
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        root[i] = min(seen)
    assert len(got) == len(data)
    for i, _, _ in data:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(links.get(i, [])), root[i], root[i] == i), i


def test_repeated_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (2, [0.0, 1.0], 0)], "vec_id long, embedding array<double>, label int")
    got = sorted((repr(r["id"]), r["n_links"], r["component_id"]) for r in E.near_vectors(df).collect())
    assert got == [("1", 1, 1), ("1", 1, 1), ("2", 0, 2), ("None", 0, None)]
    assert E.near_vectors(df.limit(0)).count() == 0


def test_calibrated_count_keeps_pairs_at_the_threshold():
    random = np.random.default_rng(9)
    spread = math.sqrt(2 - 2 * E.THRESHOLD)
    enough = E.quantile(E.PROJECTIONS, math.erf(E.REACH / math.sqrt(2)), E.MISSES)
    a = random.standard_normal((400, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    away = random.standard_normal((400, 64))
    away -= (away * a).sum(1)[:, None] * a
    away /= np.linalg.norm(away, axis=1)[:, None]
    b = E.THRESHOLD * a + math.sqrt(1 - E.THRESHOLD ** 2) * away
    lines = E.directions(64, E.PROJECTIONS)
    counts = E.collisions(a @ lines, b @ lines, E.REACH * spread)
    plain = (np.abs((a @ lines)[:, None, :] - (b @ lines)[None, :, :]) <= E.REACH * spread).sum(2)
    assert (counts == plain).mean() > 0.9999 and (np.diag(counts) >= enough).all()
    assert (counts >= enough).mean() < 0.05
