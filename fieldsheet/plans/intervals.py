"""Point-in-interval joins as plain equi joins.

An interval [lo, hi) of 64-bit integers is the disjoint union of at most two aligned power-of-two
blocks per level. A point lies in exactly one block per level. Joining on (key, level, block)
yields each matching pair once and compares no other pairs.
"""

from pyspark.sql import Column, DataFrame, functions as F

from .skew import join_on_hot_keys

LEVELS = 63  # the whole range of a long


def _down(x: Column, k: Column) -> Column:
    """x / 2**k rounded down."""
    return F.call_function("shiftright", x, k)


def cover(lo: Column, hi: Column) -> Column:
    """Blocks (level, block) whose disjoint union is [lo, hi)."""
    lo, hi = lo.cast("long"), hi.cast("long")

    def at(k):
        left, right = -_down(-lo, k), _down(hi, k)
        odd = F.lit(1).cast("long")
        return F.array(
            F.when((left < right) & (left.bitwiseAND(odd) == 1), F.struct(k.alias("level"), left.alias("block"))),
            F.when((left < right) & (right.bitwiseAND(odd) == 1), F.struct(k.alias("level"), (right - 1).alias("block"))))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), at)))


def in_blocks(points: DataFrame, point: Column, blocks: DataFrame, level: str = "level", block: str = "block") -> DataFrame:
    """A row per point and level that occurs in ``blocks`` (at most 63), with the block that holds the point."""
    used = blocks.agg(F.collect_set(level)).scalar()
    return points.withColumn(level, F.explode(used)).withColumn(block, _down(point.cast("long"), F.col(level)))


def points_in_intervals(intervals: DataFrame, points: DataFrame, keys, lo: str, hi: str, point: str) -> DataFrame:
    """Pairs of rows with equal ``keys`` and ``lo <= point < hi``; nulls in the keys equal each other.

    Points go only to the levels some interval uses. A wide interval makes one block hold many
    points; such blocks are spread over tasks. Intervals may be as many as points and are not broadcast.
    """
    left = (intervals.withColumn("_b", F.explode(cover(F.col(lo), F.col(hi)))).withColumn("_key", F.struct(*keys)).drop(*keys)
            .withColumns({"_level": F.col("_b.level"), "_block": F.col("_b.block")}).drop("_b"))
    right = in_blocks(points.withColumn("_key", F.struct(*keys)), F.col(point), left, "_level", "_block")
    return join_on_hot_keys(right, left.hint("merge"), ["_key", "_level", "_block"], "inner", spread=[*keys, point]).drop("_key", "_level", "_block")
