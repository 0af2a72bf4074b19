"""Ranking that never gathers a whole group in one task."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def top_k(df: DataFrame, keys, order, k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of every key in ``order``, numbered from 1 in ``rank``.

    ``row_number() <= k`` is planned with a group limit below the shuffle, so each input
    partition sends at most ``k`` rows of a key, however large that key is.
    """
    window = W.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)
    return ranked.withColumn(rank, F.col(rank).cast("bigint"))


def first_per_key(df: DataFrame, keys, order) -> DataFrame:
    """The row with the smallest ``order`` of every key (an aggregate with map-side combine)."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_row"))
    return picked.select(*keys, "_row.*")


def last_per_key(df: DataFrame, keys, order) -> DataFrame:
    """The row with the largest ``order`` of every key."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_row"))
    return picked.select(*keys, "_row.*")


def joined_ranked(df: DataFrame, keys, rank: str, value: Column, sep: str, name: str) -> DataFrame:
    """Text of already ranked, bounded rows in rank order."""
    listed = df.select(*keys, F.struct(F.col(rank).alias("r"), value.alias("v")).alias("_e"))
    grouped = listed.groupBy(*keys).agg(F.sort_array(F.collect_list("_e")).alias("_l"))
    return grouped.select(*keys, F.array_join(F.col("_l.v"), sep).alias(name))
