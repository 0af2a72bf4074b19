"""Packing of token runs into bins of several permitted lengths, by best fit."""

from bisect import bisect_left, insort
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.scratch import materialize

SIZES = (512, 1024, 2048, 4096)
OVERHEAD = 16
GROUP = 8192
WORDS = r"[^\x20\x09-\x0D]+"


def _fit(lengths, sizes, overhead):
    """Best fit, largest first, with bins of the given sizes: the bin and the place in it of every length."""
    order = np.argsort(-lengths, kind="stable")
    down = lengths[order]
    after = np.r_[np.cumsum(down[::-1])[::-1], 0]  # tokens from here on
    rooms, bins_of, used = [], {}, []  # open rooms in order, the bins that have each, tokens in each bin
    bin_of, at = np.zeros(len(down), np.int64), np.zeros(len(down), np.int64)
    for k, n in enumerate(down.tolist()):
        i = bisect_left(rooms, n)
        if i < len(rooms):  # the least room that holds it
            room = rooms[i]
            b = bins_of[room].pop()
            if not bins_of[room]:
                del bins_of[room], rooms[i]
        else:
            best = None
            for size in sizes:
                if size >= n:
                    fits = int(np.searchsorted(-down[k + 1:], n - size)) + k + 1  # the first that fits beside it
                    price = (size + overhead) / (n + min(size - n, int(after[fits])))
                    if best is None or price < best[0]:
                        best = (price, size)
            b, room = len(used), best[1]
            used.append(0)
        bin_of[order[k]], at[order[k]] = b, used[b]
        used[b] += n
        if room > n:
            if room - n not in bins_of:
                bins_of[room - n] = []
                insort(rooms, room - n)
            bins_of[room - n].append(b)
    return bin_of, at, np.array(used, np.int64)


def best_fit(lengths, sizes=SIZES, overhead: int = OVERHEAD):
    """Bins for ``lengths`` (each at most the largest size): bin of each, place in it, size of every bin.

    A bin costs its size and a fixed overhead. A length goes to the bin with the least room that
    holds it; else a new bin is opened, of the size with the least cost per token it can be expected
    to hold from what is left. At last every bin shrinks to the least permitted size that holds its
    contents. This is done for every choice of sizes that has the largest one, and the cheapest kept.
    """
    lengths, sizes = np.asarray(lengths, np.int64), np.array(sorted(sizes), np.int64)
    best = None
    for k in range(len(sizes)):
        for some in combinations(sizes[:-1].tolist(), k):
            bin_of, at, used = _fit(lengths, [*some, int(sizes[-1])], overhead)
            final = sizes[np.searchsorted(sizes, used)]
            cost = int(final.sum()) + overhead * len(final)
            if best is None or cost < best[0]:
                best = (cost, bin_of, at, final)
    return best[1:]


def word_count(text: Column) -> Column:
    """Words of a text, null having none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def pack(docs: DataFrame, length: Column, sizes=SIZES, overhead: int = OVERHEAD, group: int = GROUP) -> DataFrame:
    """Where the tokens of every document go: one row per document and piece of it.

    ``length`` counts a row's tokens (null or less than one: none). A document longer than the largest
    size is cut into pieces of that size and a rest. Pieces are dealt evenly, by a hash of the row and
    piece, to groups of about ``group``, which are packed on their own, so the number of groups grows with the
    table and none depends on a source or a length. Returns doc_id, piece (from 0), start and
    length in tokens, bin (unique), bin_size, bin_start (place in the bin). A document without tokens
    has one row with length 0 and no bin. Rows that repeat a doc_id are packed each on its own.
    """
    largest = max(sizes)
    rows = docs.select("doc_id", F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0)).alias("tokens"), F.monotonically_increasing_id().alias("_row"))
    pieces = rows.select("doc_id", "_row", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("tokens") / largest) - 1, F.lit(0)))).alias("piece"))
    pieces = pieces.select("doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * largest).alias("start"),
                           F.least(F.lit(largest).cast("long"), F.col("tokens") - F.col("piece") * largest).alias("length"),
                           F.xxhash64("doc_id", "_row", "piece").alias("_hash"))
    pieces = materialize(pieces, "pieces")
    groups = 1 + pieces.filter("length > 0").count() // group
    return (pieces.withColumn("_group", F.when(F.col("length") > 0, F.pmod(F.col("_hash"), F.lit(groups))).otherwise(-1 - F.pmod(F.col("_hash"), F.lit(groups))))
            .groupBy("_group").applyInPandas(_packer(tuple(sizes), overhead),
                                             "doc_id long, piece int, start long, length long, bin string, bin_size int, bin_start long"))


def _packer(sizes, overhead):
    def run(key, rows):
        if key[0] < 0:
            return rows[["doc_id", "piece", "start", "length"]].assign(bin=None, bin_size=None, bin_start=None)
        rows = rows.sort_values(["length", "doc_id", "piece", "_hash"], ignore_index=True)
        bins, at, final = best_fit(rows["length"].to_numpy(), sizes, overhead)
        return rows[["doc_id", "piece", "start", "length"]].assign(bin=[f"{key[0]}-{b}" for b in bins], bin_size=final[bins], bin_start=at)
    return run
