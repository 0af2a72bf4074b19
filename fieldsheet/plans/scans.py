"""Running values along an ordered key, cut into blocks so that a long group uses many tasks.

Every group is split by ``floor(position / block)``. The running value is computed inside each
block, one summary row per block is scanned per group, and the carried value is joined back.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BLOCK = 65536


def _blocked(df, pos, block):
    return df.withColumn("_block", F.floor(F.col(pos) / F.lit(block)).cast("long"))


def _join_blocks(rows: DataFrame, values: DataFrame, keys) -> DataFrame:
    """Every row with the values of its group and block; null keys are groups like any other.

    There may be as many groups as rows, so the values are not broadcast.
    """
    on = F.lit(True)
    named = values.select(*[F.col(c).alias(f"_j{i}") if c in (*keys, "_block") else F.col(c) for i, c in enumerate(values.columns)])
    for i, c in enumerate(values.columns):
        if c in (*keys, "_block"):
            on = on & F.col(c).eqNullSafe(F.col(f"_j{i}"))
    return rows.join(named.hint("merge"), on)


def carry_last(df: DataFrame, keys, pos: str, values: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """Add columns holding the last non-null value at or before each row."""
    names = list(values)
    b = _blocked(df, pos, block).select("*", *[v.alias(f"_v{i}") for i, v in enumerate(values.values())])
    inner = W.partitionBy(*keys, "_block").orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    local = b.select("*", *[F.last(f"_v{i}", True).over(inner).alias(f"_l{i}") for i in range(len(names))])
    tails = b.groupBy(*keys, "_block").agg(
        *[F.max_by(f"_v{i}", F.when(F.col(f"_v{i}").isNotNull(), F.col(pos))).alias(f"_t{i}") for i in range(len(names))])
    outer = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = tails.select(*keys, "_block",
                           *[F.last(f"_t{i}", True).over(outer).alias(f"_c{i}") for i in range(len(names))])
    joined = _join_blocks(local, carried, keys)
    return joined.select(*[F.col(c) for c in df.columns if c not in names],
                         *[F.coalesce(f"_l{i}", f"_c{i}").alias(n) for i, n in enumerate(names)])


def carry_next(df: DataFrame, keys, pos: str, name: str, value: Column, block: int = BLOCK) -> DataFrame:
    """Add the first non-null value at or after each row.

    Read from the end: a frame up to the last row would be gone through again for every row.
    """
    b = _blocked(df, pos, block).withColumn("_v", value)
    inner = W.partitionBy(*keys, "_block").orderBy(F.col(pos).desc()).rowsBetween(W.unboundedPreceding, 0)
    local = b.withColumn("_l", F.last("_v", True).over(inner))
    heads = b.groupBy(*keys, "_block").agg(
        F.min_by("_v", F.when(F.col("_v").isNotNull(), F.col(pos))).alias("_h"))
    outer = W.partitionBy(*keys).orderBy(F.col("_block").desc()).rowsBetween(W.unboundedPreceding, -1)
    carried = heads.select(*keys, "_block", F.last("_h", True).over(outer).alias("_c"))
    return (_join_blocks(local, carried, keys)
            .select(*[F.col(c) for c in df.columns if c != name], F.coalesce("_l", "_c").alias(name)))


def running_sum(df: DataFrame, keys, pos: str, values: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """Add inclusive running sums (nulls count as zero)."""
    names = list(values)
    b = _blocked(df, pos, block).select(
        "*", *[F.coalesce(v, F.lit(0)).alias(f"_v{i}") for i, v in enumerate(values.values())])
    inner = W.partitionBy(*keys, "_block").orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    local = b.select("*", *[F.sum(f"_v{i}").over(inner).alias(f"_l{i}") for i in range(len(names))])
    totals = b.groupBy(*keys, "_block").agg(*[F.sum(f"_v{i}").alias(f"_t{i}") for i in range(len(names))])
    outer = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(*keys, "_block", *[
        F.coalesce(F.sum(f"_t{i}").over(outer), F.lit(0)).alias(f"_c{i}") for i in range(len(names))])
    joined = _join_blocks(local, carried, keys)
    return joined.select(*[F.col(c) for c in df.columns if c not in names],
                         *[(F.col(f"_l{i}") + F.col(f"_c{i}")).alias(n) for i, n in enumerate(names)])
