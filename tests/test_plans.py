"""Plan helpers against brute force, with one key holding most rows."""

import random

from pyspark.sql import functions as F

from fieldsheet.operators import rules
from fieldsheet.plans import intervals, scans, skew


def _skewed(n=3000, seed=3):
    rng = random.Random(seed)
    return [(i, "hot" if rng.random() < 0.6 else f"k{rng.randrange(200)}" if rng.random() < 0.9 else None) for i in range(n)]


def test_join_on_hot_keys(spark):
    rows = _skewed()
    lookup = [("hot", 1), ("hot", 2), ("k1", 3), ("nobody", 4)]
    df, lk = spark.createDataFrame(rows, "i int, k string"), spark.createDataFrame(lookup, "k string, v int")
    want = sorted((i, v) for i, k in rows for kk, v in lookup if k == kk)
    got = skew.join_on_hot_keys(df, lk, ["k"], "inner")
    assert sorted((r.i, r.v) for r in got.collect()) == want
    assert got.rdd.getNumPartitions() >= 1
    left = skew.join_on_hot_keys(df, lk, ["k"], "left").count()
    assert left == sum(max(1, sum(k == kk for kk, _ in lookup)) for _, k in rows)
    assert skew.join_on_hot_keys(df, lk, ["k"], "left_anti").count() == sum(all(k != kk for kk, _ in lookup) for _, k in rows)


def test_repeated_keys_count_nulls_as_equal(spark):
    rows = _skewed()
    counts = {}
    for _, k in rows:
        counts[k] = counts.get(k, 0) + 1
    got = skew.rows_of_repeated_keys(spark.createDataFrame(rows, "i int, k string"), ["k"])
    assert sorted(r.i for r in got.collect()) == [i for i, k in rows if counts[k] > 1]


def test_scans_equal_single_pass(spark):
    rng = random.Random(5)
    rows = [("a" if rng.random() < 0.8 else "b", i, rng.randrange(9) if rng.random() < 0.2 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, pos long, v int")
    sums, last, nxt, want = {}, {}, {}, {}
    for g, p, v in rows:
        sums[g] = sums.get(g, 0) + (v or 0)
        last[g] = v if v is not None else last.get(g)
        want[p] = (sums[g], last[g])
    for g, p, v in reversed(rows):
        nxt[g] = v if v is not None else nxt.get(g)
        want[p] += (nxt[g],)
    for block in (7, 64, 10000):
        out = scans.running_sum(df, ["g"], "pos", {"s": F.col("v")}, block)
        out = scans.carry_last(out, ["g"], "pos", {"l": F.col("v")}, block)
        out = scans.carry_next(out, ["g"], "pos", "n", F.col("v"), block)
        assert {r.pos: (r.s, r.l, r.n) for r in out.collect()} == want


def test_intervals(spark):
    rng = random.Random(7)
    spans = [("g", i, a, a + rng.randrange(0, 60)) for i, a in ((i, rng.randrange(300)) for i in range(40))]
    points = [("g", p) for p in rng.sample(range(400), 150)]
    got = intervals.points_in_intervals(spark.createDataFrame(spans, "k string, i int, lo long, hi long"),
                                        spark.createDataFrame(points, "k string, p long"), ["k"], "lo", "hi", "p")
    assert sorted((r.i, r.p) for r in got.collect()) == sorted((i, p) for _, i, lo, hi in spans for _, p in points if lo <= p < hi)


def test_intervals_over_the_whole_range(spark):
    spans = [(1, 0, 1 << 31), (2, -(1 << 62), 1 << 62), (3, (1 << 53) + 1, (1 << 53) + 4), (4, -7, -2), (5, -3, 3), (6, 5, 5), (7, 9, 4)]
    points = [0, 1, 5, (1 << 31) - 1, 1 << 31, 1 << 53, (1 << 53) + 1, (1 << 53) + 3, (1 << 53) + 4, -1, -2, -3, -7, -8, -(1 << 62), (1 << 62) - 1, 1 << 62]
    got = intervals.points_in_intervals(spark.createDataFrame([("g", *s) for s in spans], "k string, i int, lo long, hi long"),
                                        spark.createDataFrame([("g", p) for p in points], "k string, p long"), ["k"], "lo", "hi", "p")
    assert sorted((r.i, r.p) for r in got.collect()) == sorted((i, p) for i, lo, hi in spans for p in points if lo <= p < hi)


def test_count_and_first(spark):
    rng = random.Random(9)
    rows = [("a" if rng.random() < 0.9 else None, i) for i in {rng.randrange(-(1 << 62), 1 << 62) for _ in range(2000)}]
    got = rules.count_and_first(spark.createDataFrame(rows, "k string, i long"), ["k"], "i", 30).collect()
    for k in ("a", None):
        ids = sorted(i for kk, i in rows if kk == k)
        r = next(r for r in got if r.k == k)
        assert (r.n, r.ids) == (len(ids), ids[:30])
