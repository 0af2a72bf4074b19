"""Nearest neighbours and components against brute force."""

import numpy as np
import pytest

from fieldsheet.llm import graph, neighbours


def _brute(rows, every, count):
    fine = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            fine[i] = np.array(v, float)
    out = []
    for q in sorted(fine):
        if q % every == 0:
            found = sorted(((-float(np.einsum("j,ij->i", fine[q], fine[o][None])[0]), o) for o in fine if o != q))[:count]
            out += [(q, k + 1, o, -s) for k, (s, o) in enumerate(found)]
    return out


@pytest.mark.parametrize("count", [3, 20, 200])
def test_nearest(spark, monkeypatch, count):
    monkeypatch.setattr(neighbours, "RUN", 32)
    rng = np.random.default_rng(2)
    rows = [(k, rng.standard_normal(6).tolist()) for k in range(120)]
    rows += [(k, rows[7][1]) for k in range(120, 160)]  # a common vector: ties
    rows += [(200, None), (201, [0.0] * 6), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (220, [float("nan")] + [1.0] * 5), (240, [float("inf")] + [1.0] * 5), (None, [1.0] * 6), (3, rows[3][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = [tuple(r) for r in neighbours.nearest(df, "vec_id", "embedding", 20, count, reach=8).orderBy("query_id", "rank").collect()]
    assert got == _brute(rows, 20, count)
    assert neighbours.nearest(df.limit(0), "vec_id", "embedding", 20, count).collect() == []


def test_curves_alone_find_near_ones(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 8))
    rows = [(k, (centres[k % 40] + 0.05 * rng.standard_normal(8)).tolist()) for k in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = {(q, o) for q, _, o, _ in _brute(rows, 20, 10)}
    got = {(r["query_id"], r["vec_id"]) for r in neighbours.nearest(df, "vec_id", "embedding", 20, 10, complete=False).collect()}
    assert len(want & got) >= 0.9 * len(want)


def test_components(spark):
    rng = np.random.default_rng(9)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(5001, 5200)] + [(None, 4), (7, 7)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x
    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in list(up)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []
