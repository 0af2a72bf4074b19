"""Helpers the operators of this folder share."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.scratch import materialize

NO_ID = -(1 << 63)
HOT_SHARE = 1000


def id_key(column: Column) -> Column:
    """Document ids as a key without nulls: a null id counts as one id below all others."""
    return F.coalesce(column.cast("long"), F.lit(NO_ID))


def id_back(column: Column) -> Column:
    return F.when(column != NO_ID, column)


def digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def join_unique(left: DataFrame, right: DataFrame, key: str, copies: str) -> DataFrame:
    """``left`` with the columns of ``right``, whose ``key`` is unique, left outer, balanced on hot keys.

    ``copies`` (a column of ``right``) says how many left rows a key has. Keys with more than a
    thousandth of all of them are at most a thousand and are broadcast; their rows, and rows without a
    key, get a salt, so that the shuffle of the others spreads them. The left side is read once.
    """
    values = [c for c in right.columns if c != key]
    total, most = right.agg(F.sum(copies), F.max(copies)).first()
    some_hot = bool(most) and most * HOT_SHARE > total
    packed = right.select(F.col(key).alias("_ck"), F.struct(*values).alias("_cv"), (F.col(copies) * HOT_SHARE > (total or 0)).alias("_hot"))
    keep = [c for c in left.columns if c not in values]
    marked = left.select(*keep)
    if some_hot:
        hot = packed.filter("_hot").select(F.col("_ck").alias("_hk"), F.col("_cv").alias("_hv"))
        marked = marked.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left").withColumn("_apart", F.col("_hk").isNotNull() | F.col(key).isNull())
    else:
        marked = marked.withColumn("_apart", F.col(key).isNull())
    salt = F.when(F.col("_apart"), F.pmod(F.xxhash64(*[F.col(c) for c in keep]), F.lit(8191)).cast("int") + 1).otherwise(0)
    # key and salt are one value: as two, the constant salt of the right side would leave the shuffle
    marked = marked.select("*", F.struct(F.when(~F.col("_apart"), F.col(key)).alias("k"), salt.alias("s")).alias("_lk"))
    cold = packed.filter("not _hot").select("_cv", F.struct(F.col("_ck").alias("k"), F.lit(0).alias("s")).alias("_rk"))
    joined = marked.join(cold.hint("merge"), F.col("_lk") == F.col("_rk"), "left")
    value = F.coalesce("_hv", "_cv") if some_hot else F.col("_cv")
    return joined.select(*keep, *[value[c].alias(c) for c in values])


def ranked(df: DataFrame, order, name: str) -> DataFrame:
    """The rows with ``name``, their place (from 0) in the total order of the columns ``order``.

    Rows are dealt by range and sorted in their partitions; a row's place is its place in its
    partition plus the rows of the partitions before, one number per partition.
    """
    low = (1 << 33) - 1
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed, "ranked")
    part = F.call_function("shiftright", F.col("_at"), F.lit(33)).cast("int")
    sizes = sorted(placed.groupBy(part.alias("p")).count().collect())  # one row per partition
    before, rows = 0, []
    for p, n in sizes:
        rows.append((p, before))
        before += n
    offsets = df.sparkSession.createDataFrame(rows, "_part int, _before long")
    return (placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit(low))).drop("_part", "_before", "_at"))


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 20):
    """Parts of an Arrow batch with about ``most`` bytes of text each, so that work space stays small."""
    sizes = batch.column(column)
    lengths = pa.compute.fill_null(pa.compute.binary_length(sizes), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < len(lengths):
        yield batch.slice(start)
