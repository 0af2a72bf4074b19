"""Places in a sort order without one task that holds a whole group.

Rows are dealt by range of (key, order), sorted in their partitions and written once. A row's place
in its partition is known; what is added to it is one number per key and partition.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .scratch import materialize

LOW = 33  # bits of a row's place within its partition


def _sorted(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows written in ``order``; ``_at`` holds the partition above ``LOW`` bits and the place in it below."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(dealt.withColumn("_at", F.monotonically_increasing_id()), name)


def numbered(df: DataFrame, keys, order, name: str = "rank") -> DataFrame:
    """Add the number (from 1) of each row within its key in the columns ``order``; null keys are keys like any other.

    A key with most of the rows lies in many partitions and is numbered by as many tasks. Rows that
    are equal in ``order`` get different numbers in any order.
    """
    placed = _sorted(df, [*[F.col(k) for k in keys], *[F.col(o) if isinstance(o, str) else o for o in order]], "numbered")
    placed = placed.withColumns({"_key": F.struct(*keys), "_part": F.call_function("shiftright", F.col("_at"), F.lit(LOW))})
    pieces = placed.groupBy("_key", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy("_key").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # as many rows as partitions hold the key
    pieces = pieces.select("_key", "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_add"))
    return placed.join(pieces.hint("merge"), ["_key", "_part"]).select(*df.columns, (F.col("_at") + F.col("_add")).cast("bigint").alias(name))


def slice_of(df: DataFrame, order, start: int, rows: int) -> DataFrame:
    """Rows number ``start`` to ``start + rows`` (from 0) of ``df`` in the columns ``order``, as stored in sorted files.

    The driver gets one row per partition, how many rows it has. Only the files and row groups of
    the slice are read, by the range of places they hold; the result is in order and has at most ``rows`` rows.
    """
    placed = _sorted(df, [F.col(o) if isinstance(o, str) else o for o in order], "sorted")
    part = F.call_function("shiftright", F.col("_at"), F.lit(LOW))
    sizes = sorted(placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    wanted, before = F.lit(False), 0
    for p, n in sizes:
        low, high = max(start - before, 0), min(start + rows - before, n)
        if low < high:
            wanted = wanted | F.col("_at").between((p << LOW) + low, (p << LOW) + high - 1)
        before += n
    return placed.filter(wanted).orderBy("_at").select(df.columns)
