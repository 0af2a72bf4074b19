"""Shards as runs of a Hilbert curve through the metadata, so that files prune on several columns."""

import bisect

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.scratch import materialize
from .common import ranked
from .hilbert import hilbert_index

BITS = 5
ACCURACY = 10000
DIMENSIONS = ("lang", "source", "n_chars", "doc_id")


def _running(batches):
    total = 0
    for batch in batches:
        upto = total + np.cumsum(batch.column(2).to_numpy())
        total = int(upto[-1]) if len(upto) else total
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(upto, pa.int64())], names=["part", "v", "upto"])


def _string_cuts(values: DataFrame, kind: str, cells: int) -> list:
    """The values (column ``v``) at which at most ``cells`` cells of about equal count end, by the order of whole values.

    Distinct values with their counts are dealt by range and added up in order; what comes to the
    driver is one count per partition and the cuts.
    """
    counts = values.filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    placed = counts.repartitionByRange("v").sortWithinPartitions("v").select(F.spark_partition_id().alias("part"), "v", "n")
    placed = materialize(placed.mapInArrow(_running, f"part int, v {kind}, upto long"), "values")
    ends = sorted(placed.groupBy("part").agg(F.max("upto").alias("n")).collect())  # one row per partition
    n, found = sum(r["n"] for r in ends), []
    for k in range(1, cells if n else 0):
        place = -(-k * n // cells)
        for r in ends:
            if place <= r["n"]:
                found.append(F.min(F.when((F.col("part") == r["part"]) & (F.col("upto") >= place), F.col("v"))).alias(f"c{k}"))
                break
            place -= r["n"]
    return sorted(set(placed.agg(*found).first())) if found else []


def _number(column, kind, values: DataFrame, cells: int):
    """A column as a number that keeps its order: strings by their cell among all whole values; nulls stay null."""
    if kind in ("string", "binary"):
        cuts = _string_cuts(values.select(column.alias("v")), kind, cells)
        return sum(((column > F.lit(c)).cast("long") for c in cuts), F.when(column.isNotNull(), F.lit(1).cast("long")))
    return column.cast("double") if kind in ("double", "float") or kind.startswith("decimal") else column.cast("long")


def curve_keys(df: DataFrame, dimensions, bits: int = BITS) -> DataFrame:
    """``df`` with ``_curve``, the Hilbert index of the quantised dimensions.

    Every dimension is cut at quantiles (``percentile_approx`` over all rows; strings by the rank of
    the whole value) into at most 2**bits - 1 cells of about equal count, nulls being a cell of their
    own; equal values share a cell.
    """
    kinds = dict(df.dtypes)
    for d in dimensions:
        if d not in kinds:
            raise ValueError(f"no column {d}")
    cells = (1 << bits) - 1
    marked = df.select("*", *[_number(F.col(d), kinds[d], df, cells).alias(f"_d{i}") for i, d in enumerate(dimensions)])
    shares = [k / cells for k in range(1, cells)]
    cuts = marked.agg(*[F.percentile_approx(f"_d{i}", shares, ACCURACY).alias(f"c{i}") for i in range(len(dimensions))]).first()
    cuts = [range(1, cells) if kinds[d] in ("string", "binary") else sorted(set(c or ())) for d, c in zip(dimensions, cuts)]  # at most 2**bits numbers per dimension

    @F.pandas_udf("long")
    def index(columns: pd.DataFrame) -> pd.Series:
        points = np.stack([np.where(columns[c].isna(), 0, 1 + np.searchsorted(np.array(cuts[i], float), columns[c].astype(float).fillna(0), side="left"))
                           for i, c in enumerate(columns)], axis=1)
        return pd.Series(hilbert_index(points, bits))

    key = index(F.struct(*[F.col(f"_d{i}") for i in range(len(dimensions))]))
    return marked.withColumn("_curve", key).drop(*[f"_d{i}" for i in range(len(dimensions))])


def shard(df: DataFrame, shards: int, dimensions=DIMENSIONS, ties=("text_crc32", "doc_id")) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (0 up to its shard's rows, without gaps).

    Rows are put in the order of a Hilbert curve through the quantised ``dimensions``, then of the
    columns ``ties``, and the order is cut into runs whose row counts are at most one apart. Rows
    that are equal in all of these take any order. Neighbours on the curve are near in all
    dimensions, so every shard has a short range in each. Any column may be null and have any name; columns
    named ``shard`` and ``slot`` are replaced by the new ones. An empty table
    gives no rows; with fewer rows than shards some shards stay empty.
    """
    for c in (*dimensions, *ties):
        if c not in df.columns:
            raise ValueError(f"no column {c}")
    named = [F.col(f"`{c}`").alias(f"{kind}{i}") for kind, columns in (("dim", dimensions), ("tie", ties)) for i, c in enumerate(columns)]
    rows = df.select(F.struct("*").alias("row"), *named)  # the caller's columns travel as one value
    order = ["_curve", *[f"tie{i}" for i in range(len(ties))]]
    placed = ranked(curve_keys(rows, [f"dim{i}" for i in range(len(dimensions))]), order, "_rank")
    n = placed.count()
    starts = [s * n // shards for s in range(shards)]

    rank = F.col("_rank")
    number = F.floor(((rank + 1) * shards - 1) / F.lit(max(n, 1))).cast("int")  # the last shard whose start is at most rank
    first = F.element_at(F.array(*[F.lit(s).cast("long") for s in starts]), number + 1)
    return placed.select(*[F.col("row")[c].alias(c) for c in df.columns if c not in ("shard", "slot")], number.alias("shard"), (rank - first).alias("slot"))


def shard_of(rank: int, n: int, shards: int) -> int:
    """The shard of one rank, for checks: the last one that starts at or before it."""
    return bisect.bisect_right([s * n // shards for s in range(shards)], rank) - 1


def write_shards(df: DataFrame, path: str, shards: int, dimensions=DIMENSIONS, ties=("doc_id",)) -> None:
    """Write ``df`` as one folder per shard, rows in slot order."""
    placed = shard(df, shards, dimensions, ties)
    placed.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
