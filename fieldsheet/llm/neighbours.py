"""Nearest neighbours by inner product along shifted Hilbert curves."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..plans.scratch import materialize
from .common import ranked
from .hilbert import hilbert_index

CURVES, PLANES, BITS = 4, 4, 8
RUN = 2048
REACH = 128
QUERY_BLOCK = 1024
RESULT = "query_id long, rank int, vec_id long, score double"


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the vectors that are not null, not empty, not zero, without null or non-finite components, in double precision.

    Of rows that repeat an id and a vector one is kept.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.filter("id is not null and v is not null").filter(fine).dropDuplicates()


def _top(ids, scores, count):
    """Places of the ``count`` largest scores, ties to the smaller id."""
    if len(ids) > 4 * count:
        floor = np.partition(scores, -count)[-count]
        some = np.flatnonzero(scores >= floor)
        return some[np.lexsort((ids[some], -scores[some]))[:count]]
    return np.lexsort((ids, -scores))[:count]


def inner(q, block):
    """Inner products of one vector with the rows of a block, added up in one order for any block."""
    return np.einsum("j,ij->i", q, block)


def curve_order(points: DataFrame, dims: int, curve: int) -> DataFrame:
    """``points`` (id, v) with their place on one curve: a random projection, shifted, quantised and indexed."""
    rng = np.random.default_rng([17, curve])
    axes = rng.standard_normal((dims, PLANES)) / np.sqrt(dims)
    shift = rng.random(PLANES)
    spread = np.linalg.norm(axes, axis=0)

    @F.pandas_udf("long")
    def index(column: pd.Series) -> pd.Series:
        v = np.stack(column.to_numpy())
        v = v / np.linalg.norm(v, axis=1, keepdims=True)  # directions: lengths do not move a vector along the curve
        unit = np.clip(v @ axes / spread * np.sqrt(dims) / 8 + 0.5, 0, 1)
        cells = np.minimum((unit * 0.5 + shift * 0.5) * (1 << BITS), (1 << BITS) - 1).astype(np.int64)
        return pd.Series(hilbert_index(cells, BITS))

    return ranked(points.withColumn("_key", index("v")), ["_key", "id"], "place")


def _windows(every, count, reach):
    """Candidates of the queries of one run of a curve: at most ``reach`` places away."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place", ignore_index=True)
        ids, place = rows["id"].to_numpy(), rows["place"].to_numpy()
        v = np.stack(rows["v"].to_numpy())
        out = []
        for k in np.flatnonzero(rows["own"].to_numpy() & (ids % every == 0)):
            a, b = np.searchsorted(place, [place[k] - reach, place[k] + reach + 1])
            near = np.r_[a:k, k + 1:b]
            near = near[ids[near] != ids[k]]
            scores = inner(v[k], v[near])
            best = _top(ids[near], scores, count)
            out.append(pd.DataFrame({"query_id": ids[k], "vec_id": ids[near][best], "score": scores[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    return run


def _best(found: DataFrame, count: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


def _complete(count):
    """What a run of the curve adds for a block of queries: runs whose bound cannot reach a query's floor are left out."""
    def run(key, queries, rows):
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        if not len(queries) or not len(rows):
            return empty
        ids, v = rows["id"].to_numpy(), np.stack(rows["v"].to_numpy())
        q, floor = np.stack(queries["v"].to_numpy()), queries["floor"].to_numpy()
        centre = v.mean(axis=0)
        radius = np.sqrt(((v - centre) ** 2).sum(axis=1).max())
        bound = q @ centre + np.sqrt((q * q).sum(axis=1)) * radius
        out = []
        for k in np.flatnonzero(bound * (1 + 1e-12) + 1e-12 >= floor):
            scores = inner(q[k], v)
            good = np.flatnonzero((scores >= floor[k]) & (ids != queries["id"].iloc[k]))
            best = good[_top(ids[good], scores[good], count)]
            out.append(pd.DataFrame({"query_id": queries["id"].iloc[k], "vec_id": ids[best], "score": scores[best]}))
        return pd.concat(out) if out else empty
    return run


def nearest(vectors: DataFrame, key: str, vector: str, every: int, count: int = 20, curves: int = CURVES, reach: int = REACH, complete: bool = True) -> DataFrame:
    """The ``count`` nearest vectors, by largest inner product, of every vector whose id is divisible by ``every``.

    Vectors are put in the order of several Hilbert curves, each through its own random projection
    with its own shift, and dealt to runs by range. A query looks at the ``reach`` places before
    and after it on each curve; windows reach over the ends of runs. What the curves find is merged and
    ranked by the exact product, ties to the smaller id. With ``complete`` the query's last rank is then
    a floor: each run of the first curve whose centre and radius allow a product above it is ranked too, so
    nothing is missed. Returns query_id, rank, vec_id, score.

    Unusable vectors (see :func:`usable`) and rows without an id take no part. Vectors of different
    dimension have no product: each dimension is searched by itself. A vector is
    no candidate of its own id. A query without other vectors has no rows; an empty table gives none.
    """
    points = materialize(usable(vectors, key, vector), "vectors")
    sizes = sorted(r[0] for r in points.select(F.size("v")).distinct().collect())  # the dimensions that occur, as a rule one
    if not sizes:
        return vectors.sparkSession.createDataFrame([], RESULT)
    parts = [_of_one_dimension(points if len(sizes) == 1 else points.filter(F.size("v") == d), d, every, count, curves, reach, complete) for d in sizes]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    # an id may have vectors of several dimensions
    return found if len(sizes) == 1 else _best(found.drop("rank"), count).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _of_one_dimension(points: DataFrame, dims: int, every: int, count: int, curves: int, reach: int, complete: bool) -> DataFrame:
    total = points.count()
    schema = "query_id long, vec_id long, score double"
    found, first = None, None
    for c in range(curves):
        placed = materialize(curve_order(points, dims, c), "curve")
        first = placed if first is None else first
        at = F.floor(F.col("place") / RUN)
        over = F.array_distinct(F.array(at, F.floor((F.col("place") - reach) / RUN), F.floor((F.col("place") + reach) / RUN)))
        runs = placed.withColumn("run", F.explode(over)).withColumn("own", at == F.col("run")).drop("_key")
        some = runs.groupBy("run").applyInPandas(_windows(every, count, reach), schema)
        found = some if found is None else found.unionByName(some)
    found = materialize(_best(found.distinct(), count).drop("rank"), "window-results")
    if complete:
        floors = found.groupBy("query_id").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n"))
        queries = points.filter(F.col("id") % every == 0).join(floors, F.col("id") == F.col("query_id"), "left")
        queries = queries.select("id", "v", F.when(F.col("n") >= count, F.col("low")).otherwise(float("-inf")).alias("floor"))
        runs = 1 + (total - 1) // RUN if total else 0
        blocks = 1 + queries.count() // QUERY_BLOCK
        asked = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(max(runs - 1, 0)))))
        held = (first.select("id", "v", F.floor(F.col("place") / RUN).cast("int").alias("run"))
                .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
        more = asked.groupBy("run", "block").cogroup(held.groupBy("run", "block")).applyInPandas(_complete(count), schema)
        found = found.unionByName(more).distinct()
    return _best(found, count).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
