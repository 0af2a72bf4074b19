"""Shards of tables with any column names, and neighbours of vectors of several dimensions."""

import numpy as np
from pyspark.sql import functions as F

from fieldsheet.llm import neighbours, sharding

NAMES = ["_d0", "_d1", "_part", "_at", "_before", "_rank", "_curve", "row", "dim0", "tie0", "shard", "slot"]


def test_columns_of_any_name_stay(spark):
    rows = [(i, i % 7, f"l{i % 3}", f"s{i % 11}", *[f"{n}{i}" for n in NAMES]) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, n_chars long, lang string, source string, " + ", ".join(f"`{n}` string" for n in NAMES))
    out = sharding.shard(df, 8, ties=("doc_id",))
    assert sorted(out.columns) == sorted(df.columns)
    got = out.collect()
    assert all(r[n] == f"{n}{r['doc_id']}" for r in got for n in NAMES if n not in ("shard", "slot")) and len({r["doc_id"] for r in got}) == 500
    plain = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(df.select("doc_id", "n_chars", "lang", "source"), 8, ties=("doc_id",)).collect()}
    assert plain == {r["doc_id"]: (r["shard"], r["slot"]) for r in got}


def test_order_and_cuts_by_plain_loops(spark):
    rows = [(i, (i * 37) % 101, f"l{i % 3}", None if i % 10 == 0 else f"s{i % 5}") for i in range(203)]
    df = spark.createDataFrame(rows, "doc_id long, n_chars long, lang string, source string")
    keys = {r["doc_id"]: r["_curve"] for r in sharding.curve_keys(df, sharding.DIMENSIONS).collect()}
    order = sorted(keys, key=lambda i: (keys[i], i))
    starts = [s * len(order) // 8 for s in range(9)]
    want = {i: (s, k - starts[s]) for s in range(8) for k, i in list(enumerate(order))[starts[s]:starts[s + 1]]}
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(df, 8, ties=("doc_id",)).collect()} == want


def test_each_dimension_is_searched_by_itself(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(8 if i % 3 else 5)]) for i in range(240)] + [(None, [1.0] * 8), (500, [1.0, 2.0])]
    got = [tuple(r) for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", 20, 4, reach=8).orderBy("query_id", "rank").collect()]
    want = []
    for i, v in rows:
        if i is not None and i % 20 == 0:
            near = sorted((-float(np.einsum("j,ij->i", np.array(v), np.array([w]))[0]), k) for k, w in rows if k is not None and k != i and len(w) == len(v))[:4]
            want += [(i, r, k, -s) for r, (s, k) in enumerate(near, 1)]
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)] and np.allclose([g[3] for g in got], [w[3] for w in sorted(want)])
