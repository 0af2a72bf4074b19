"""Profiles as sketches: merged parts say what one pass over all rows says."""

from collections import Counter

from pyspark.sql import functions as F

from fieldsheet.operators import profile
from fieldsheet.plans.scratch import materialize


def _table(spark, start, end):
    return spark.range(start, end).select((F.col("id") % 2).alias("dataset_id"), F.lit(1).alias("table_id"), F.col("id").alias("row_id"),
                                          F.concat(F.lit("v"), F.col("id") % 2500).alias("many"), F.when(F.col("id") % 5 > 0, (F.col("id") % 7).cast("string")).alias("few"), F.lit(None).cast("string").alias("none"))


def test_merged_parts_equal_one_pass(spark):
    cuts = [(0, 1000), (1000, 1001), (1001, 9000)]
    stored = [materialize(profile.profile_sketch(_table(spark, a, b)), "profile") for a, b in cuts]
    merged = {(r["dataset_id"], r["column"]): r for r in profile.profile_of(profile.merge_profiles(*stored)).collect()}
    exact = {(r["dataset_id"], r["column"]): r for r in profile.column_profile(_table(spark, 0, 9000)).collect()}
    whole = {(r["dataset_id"], r["column"]): r for r in profile.profile_of(profile.profile_sketch(_table(spark, 0, 9000))).collect()}
    assert merged.keys() == exact.keys() == whole.keys()
    for key, r in merged.items():
        want = exact[key]
        assert (r["nulls"], r["total"]) == (want["nulls"], want["total"]) == (whole[key]["nulls"], whole[key]["total"])
        for estimate in (r["distinct_values"], whole[key]["distinct_values"]):
            assert abs(estimate - want["distinct_values"]) <= 0.05 * want["distinct_values"]


def test_frequent_values(spark):
    parts = [profile.profile_sketch(_table(spark, a, b), ["few", "none"]) for a, b in ((0, 300), (300, 1000))]
    got = {(r["dataset_id"], r["column"]): [(v["value"], v["n"]) for v in r["top_values"]] for r in profile.profile_of(profile.merge_profiles(*parts), top=3).collect()}
    for d in (0, 1):
        counts = Counter(str(i % 7) for i in range(1000) if i % 2 == d and i % 5 > 0)
        assert got[d, "few"] == sorted(counts.items(), key=lambda e: (-e[1], e[0]))[:3] and got[d, "none"] == []
