"""Joins that stay balanced when one key holds a large share of the rows."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .scratch import materialize

SHARE = 1000
SALTS = 64
TRACKED = 10000  # keys a sketch keeps: a key with one row in a thousand is never missed


def hot_keys(rows: DataFrame, keys, share: int = SHARE) -> DataFrame:
    """The keys that hold more than one in ``share`` of all rows: fewer than ``share`` of them, so small enough to broadcast."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.agg(F.count(F.lit(1))).scalar()
    return counts.filter((F.col("_n") > 1) & (F.col("_n") * share > total)).select(*keys, F.lit(True).alias("_hot"))


def _hash(df: DataFrame, keys, other: DataFrame | None = None) -> Column:
    """One number per key; keys that a join takes as equal have the same, also where ``other`` has them in another type."""
    def alike(k):
        mine = df.schema[k].dataType
        theirs = mine if other is None else other.schema[k].dataType
        if mine == theirs:
            return F.col(k)
        return F.col(k).cast("double" if isinstance(mine, T.NumericType) and isinstance(theirs, T.NumericType) else "string")
    return F.xxhash64(*[alike(k) for k in keys])


def frequent_keys(rows: DataFrame, key: Column, share: int = SHARE) -> Column:
    """The numbers ``key`` of (at least) all keys with more than one in ``share`` of the rows, as one short array.

    One pass with a sketch of bounded size; a key too many does no harm.
    """
    top = rows.select(key.alias("h")).agg(F.call_function("approx_top_k", F.col("h"), F.lit(share), F.lit(TRACKED)).alias("top"), F.count(F.lit(1)).alias("n"))
    often = F.filter("top", lambda e: (e["count"] > 1) & (e["count"] * share > F.col("n")))
    return F.coalesce(top.select(F.transform(often, lambda e: e["item"])).scalar(), F.array().cast("array<bigint>"))


def join_on_hot_keys(rows: DataFrame, lookup: DataFrame, keys, how: str = "left", spread=None, hot: Column | None = None) -> DataFrame:
    """Join ``rows`` to ``lookup`` on ``keys``; rows of frequent keys are spread over many tasks.

    Rows of a hot key get a salt taken from ``spread`` (row columns), and the matching lookup rows
    are repeated once per salt. All other keys keep salt 0, so the lookup hardly grows. Null keys
    match nothing and are spread too. ``rows`` is read twice: for the hot keys and for the join.
    """
    mine, theirs = _hash(rows, keys, lookup), _hash(lookup, keys, rows)
    hot = frequent_keys(rows, mine) if hot is None else hot
    spread = spread or [c for c in rows.columns if c not in keys] or list(keys)
    empty = F.lit(False)
    for k in keys:
        empty = empty | F.col(k).isNull()
    salt = F.when(F.array_contains(hot, mine) | empty, F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    salts = F.when(F.array_contains(hot, theirs), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("_salt", salt).join(lookup.withColumn("_salt", F.explode(salts)), [*keys, "_salt"], how).drop("_salt")


def rows_of_repeated_keys(rows: DataFrame, keys) -> DataFrame:
    """All rows whose key occurs more than once; nulls in a key equal each other.

    The repeated keys are written once, so ``rows`` is read twice: to count keys and to pick rows.
    """
    safe = [f"_k{i}" for i in range(len(keys))]
    tagged = rows.select("*", *[F.struct(F.col(k)).alias(s) for k, s in zip(keys, safe)])
    repeated = materialize(tagged.groupBy(*safe).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "repeated-keys")
    hot = repeated.filter(F.col("_n") * SHARE > repeated.agg(F.sum("_n")).scalar())  # fewer than SHARE keys
    numbers = F.coalesce(hot.agg(F.collect_list(_hash(repeated, safe))).scalar(), F.array().cast("array<bigint>"))
    return join_on_hot_keys(tagged, repeated.drop("_n"), safe, "left_semi", spread=rows.columns, hot=numbers).drop(*safe)
