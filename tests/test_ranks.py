"""Numbers and slices of a sort order, with one key that holds most rows."""

import random

from pyspark.sql import functions as F

from fieldsheet.operators import search
from fieldsheet.plans import ranks


def test_numbers_of_a_hot_key(spark):
    rng = random.Random(2)
    rows = [(None if rng.random() < 0.05 else "hot" if rng.random() < 0.8 else f"k{rng.randint(0, 40)}", rng.randint(0, 300), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, o int, i int").repartition(7)
    got = ranks.numbered(df, ["k"], ["o", F.desc("i")])
    want, seen = set(), {}
    for k, o, i in sorted(rows, key=lambda r: (r[0] or "", r[0] is not None, r[1], -r[2])):
        seen[k] = seen.get(k, 0) + 1
        want.add((k, o, i, seen[k]))
    assert {tuple(r) for r in got.collect()} == want
    assert ranks.numbered(df.limit(0), ["k"], ["o"]).collect() == []


def test_no_window_or_limit_in_one_partition(spark):
    df = spark.range(5000).select(F.lit(1).alias("k"), F.col("id").alias("o"))
    text = ranks.numbered(df, ["k"], ["o"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in text and "row_number" not in text


def test_slices(spark):
    df = spark.range(2000).select((F.col("id") * 7919 % 2003).alias("row_id"), (F.col("id") % 13).alias("v"), F.lit("x").alias("_key"))
    rows = sorted((r["v"], r["row_id"]) for r in df.collect())
    for start, n in ((0, 5), (995, 300), (1990, 50), (5000, 10)):
        assert [(r["v"], r["row_id"]) for r in ranks.slice_of(df, ["v", "row_id"], start, n).collect()] == rows[start:start + n]
    down = sorted(rows, key=lambda r: (-r[0], r[1]))
    deep = search.page_table(df, "v", 30, 20, descending=True, shallow=100)
    assert [(r["v"], r["row_id"]) for r in deep.collect()] == down[600:620] and deep.columns == df.columns
