"""Exact similarity join of documents on the Jaccard similarity of their word shingles."""

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window as W, functions as F

from ..plans.scratch import materialize
from .common import id_back, id_key, join_unique, ranked, slices
from .graph import components
from .shingles import joined_bytes, mix, shingle_sets

TILE_SETS, TILE_ELEMENTS = 2048, 1 << 20
EMPTY_PART = 0x5EED


@dataclass(frozen=True)
class Threshold:
    """Link when 100 * intersection >= percent * union; shingles of ``words`` words."""

    words: int = 3
    percent: int = 90

    def links(self, x, y, common):
        return 100 * common >= self.percent * (x + y - common)

    def bands(self, size: int) -> list[int]:
        """Least sizes of the bands up to ``size``: a set can only link with sets of its band and of the two next to it."""
        out = [1]
        while out[-1] <= size:
            out.append(max(out[-1] + 1, out[-1] * 100 // self.percent))
        return out

    def parts(self, band_end: int) -> tuple[int, int]:
        """For pairs whose larger set is below ``band_end``: into how many parts sets are cut, and in how many at least a linked pair agrees.

        Linked sets differ in at most d elements, so with k parts they agree in k - d or more.
        """
        d = (100 - self.percent) * 2 * (band_end - 1) // (100 + self.percent)
        k = d + 1 + d // 7
        return k, k - d


def signatures(hashes: np.ndarray, rule: Threshold, bands: list[int]):
    """Signatures of a set such that linked sets share enough of one band, and a tag of each: twice that number, plus one for the next band.

    A set takes part in the band of its own size and, as the smaller one of a pair, in the next. For
    each band it is cut by hash range into parts; a part's signature is a hash of its elements. Empty
    parts give none; a set with so many that linked sets might agree in empty parts only gets a
    signature for that.
    """
    n, out, tags = len(hashes), [], []
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(hashes + np.uint64(1)), out=total[1:])
    own = bisect_right(bands, n) - 1
    for band in (own, own + 1):
        if band > own and 100 * n < rule.percent * bands[band]:
            continue
        end = bands[band + 1] if band + 1 < len(bands) else max(bands[band] + 1, bands[band] * 100 // rule.percent)
        k, agree = rule.parts(end)
        cuts = np.searchsorted(((hashes >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32), np.arange(k + 1))
        full = np.flatnonzero(cuts[1:] > cuts[:-1])
        tag = np.uint64((band << 32) * 0x9E3779B9 & 0xFFFFFFFFFFFFFFFF)
        sums = total[cuts[full + 1]] - total[cuts[full]]
        out.append(mix(mix(sums + tag) + full.astype(np.uint64)))
        spare = agree - (k - len(full))  # parts with elements in which a linked set agrees at least
        if spare < 1:
            out.append(mix(np.array([tag], np.uint64) + np.uint64(EMPTY_PART)))
            spare = 1
        tags.append(np.full(sum(map(len, out)) - sum(map(len, tags)), 2 * spare + (band - own), np.int32))
    return np.concatenate(out), np.concatenate(tags)


def _signature_rows(rule: Threshold):
    def run(batches):
        bands = rule.bands(1 << 12)
        for batch in batches:
            for part in slices(batch, 1):
                docs, sigs, tags, counts = part.column(0).to_numpy(), [], [], []
                for s in shingle_sets(*joined_bytes(part.column(1)), rule.words):
                    if len(s) >= bands[-2]:
                        bands = rule.bands(2 * len(s))
                    found, tag = signatures(s, rule, bands)
                    sigs.append(found)
                    tags.append(tag)
                    counts.append(len(found))
                yield pa.record_batch([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(docs, counts)), pa.array(np.concatenate(tags))],
                                      names=["sig", "doc", "tag"])
    return run


def _set_rows(rule: Threshold):
    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in slices(batch, 1):
                data, starts = joined_bytes(part.column(1))
                sets = shingle_sets(data, starts, rule.words)
                digests = [None if not len(s) else (int(mix(s).sum(dtype=np.uint64)) << 64 | int(mix(s ^ np.uint64(0xA5A5)).sum(dtype=np.uint64)))
                           .to_bytes(16, "big") for s in sets]
                packed = [pack.compress(data[a:b].tobytes()) if len(s) else None for a, b, s in zip(starts[:-1], starts[1:], sets)]
                yield pa.record_batch([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                                       pa.array(packed, pa.binary())], names=["doc", "n", "digest", "packed"])
    return run


class _Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n):
        self.up = list(range(n))

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x, y):
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def link_tiles(sets, tiles, weights, rule: Threshold, i: int, j: int):
    """Links between the sets of tile ``i`` and of tile ``j``: a root for every set, and how many documents it links with.

    Every set gets a bitmap that holds, per position, the parity of its elements there. Positions in
    which two bitmaps differ are at least one differing element each, so their count bounds the
    overlap from above; pairs within that bound are intersected exactly.
    """
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    bits = max(256, 1 << int(8 * sizes.max() - 1).bit_length())
    maps = np.empty((len(sets), bits // 64), np.uint64)
    for at, s in enumerate(order):
        odd = np.bincount((sets[s] & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        maps[at] = np.packbits(odd.astype(np.uint8)).view(np.uint64)
    n, tile = sizes[order], tiles[order]
    forest, links = _Forest(len(sets)), np.zeros(len(sets), np.int64)
    for a in range(len(order)):
        end = np.searchsorted(n, n[a] * 100 // rule.percent, side="right")
        near = np.arange(a + 1, end)
        if i != j:
            near = near[tile[near] != tile[a]]
        if not len(near):
            continue
        differ = np.concatenate([np.bitwise_count(maps[near[c:c + 256]] ^ maps[a]).sum(axis=1, dtype=np.int64) for c in range(0, len(near), 256)])
        most = (n[a] + n[near] - differ) // 2
        x = sets[order[a]]
        for b in near[rule.links(n[a], n[near], most)]:
            y = sets[order[b]]
            at = np.searchsorted(y, x)
            common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            if rule.links(len(x), len(y), common):
                forest.join(order[a], order[b])
                links[order[a]] += weights[order[b]]
                links[order[b]] += weights[order[a]]
    return [forest.find(k) for k in range(len(sets))], links


def _tile_pairs(rule: Threshold):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        unpack, out = zstandard.ZstdDecompressor(), []
        for (_, i, j), rows in group.groupby(["cluster", "i", "j"], sort=False):
            rows = rows.drop_duplicates("digest").sort_values("doc", ignore_index=True)
            texts = pa.array([unpack.decompress(p) for p in rows["packed"]], pa.binary())
            sets = shingle_sets(*joined_bytes(texts), rule.words)
            docs = rows["doc"].to_numpy()
            roots, links = link_tiles(sets, rows["tile"].to_numpy(), rows["copies"].to_numpy(), rule, i, j)
            out.append(pd.DataFrame({"digest": rows["digest"], "doc": docs, "root": docs[roots], "links": links}))
        return pd.concat(out)
    return run


def candidate_clusters(rows: DataFrame, rule: Threshold) -> DataFrame:
    """(doc, cluster): documents that share a signature that neither may leave out, directly or through others; linked ones always do.

    Linked sets share at least ``spare`` signatures of a band (the half of ``tag``). So each may leave
    out its most frequent ones, of whole frequencies and fewer than ``spare`` in all: the rarest of
    those that the two share then stays with both. Sets that share less, or only passages that
    many others have, drop out here.
    """
    shared = rows.mapInArrow(_signature_rows(rule), "sig long, doc long, tag int")
    one = W.partitionBy("sig")
    stars = shared.select("doc", "tag", F.min("doc").over(one).alias("lead"), F.count(F.lit(1)).over(one).alias("often")).filter("often > 1")
    held = materialize(stars.groupBy("doc", "tag", "often", "lead").agg(F.count(F.lit(1)).alias("n")), "shared")
    down = W.partitionBy("doc", "tag").orderBy(F.desc("often")).rangeBetween(W.unboundedPreceding, W.currentRow)  # a document's own
    kept = held.withColumn("so_far", F.sum("n").over(down)).filter(F.col("so_far") >= F.call_function("shiftright", F.col("tag"), F.lit(1)))
    edges = kept.filter("doc <> lead").select(F.col("lead").alias("a"), F.col("doc").alias("b")).distinct()
    return components(edges).select(F.col("node").alias("doc"), F.col("component").alias("cluster"))


def jaccard_components(docs: DataFrame, rule: Threshold = Threshold()) -> DataFrame:
    """Every document with the size of its shingle set, its component of links and its number of links.

    Exact: no link is lost. Signatures (pigeonhole over parts of the set) gather candidates into
    clusters. A cluster is sorted by set size and cut into tiles of bounded bytes and sizes within
    a factor of two; pairs of tiles whose sizes can link are compared by bitmap bound and then by
    intersection of sorted arrays, one group per pair. What comes out per
    pair of tiles is one row per distinct set; components are joined over these rows.

    Takes doc_id and text. A null text has an empty set, which links with nothing, as has a text
    without words. Equal sets are linked (copies are compared once). Rows that share a doc_id (null
    is an id too) are one document: its links are those of all its rows. An empty table gives no rows.
    Returns doc_id, n_shingles, component_id (least doc_id reachable; its own without links), n_links
    (rows linked with this one).
    """
    rows = docs.select(id_key(F.col("doc_id")).alias("doc"), F.encode(F.col("text"), "utf-8").alias("text"))
    clusters = candidate_clusters(rows, rule)
    sets = rows.mapInArrow(_set_rows(rule), "doc long, n long, digest binary, packed binary")
    sets = sets.join(clusters.hint("merge"), "doc", "left")
    sets = materialize(sets.select("doc", "n", "digest", "cluster", F.when(F.col("cluster").isNotNull(), F.col("packed")).alias("packed")), "sets")

    groups = (sets.filter("digest is not null").groupBy("digest")
              .agg(F.min("doc").alias("doc"), F.min("n").alias("n"), F.min("cluster").alias("cluster"), F.count(F.lit(1)).alias("copies")))
    groups = materialize(groups, "groups")

    octave = F.floor(F.log2("n")).cast("long")
    held = F.greatest(F.lit(1), F.least(F.lit(TILE_SETS), F.call_function("shiftright", F.lit(TILE_ELEMENTS), octave.cast("int") + 1)))
    members = ranked(groups.filter("cluster is not null"), ["cluster", "n", "doc", "digest"], "rank")
    members = materialize(members.withColumn("tile", F.call_function("shiftleft", octave, F.lit(48)) + F.floor(F.col("rank") / held)).drop("rank"), "members")
    spans = members.groupBy("cluster", "tile").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count(F.lit(1)).alias("held"))
    left, right = spans.alias("l"), spans.alias("r")
    pairs = left.join(right, (F.col("l.cluster") == F.col("r.cluster")) & (F.col("l.tile") <= F.col("r.tile"))
                      & (F.col("l.hi") * 100 >= F.col("r.lo") * rule.percent))
    pairs = pairs.select(F.col("l.cluster").alias("cluster"), F.col("l.tile").alias("i"), F.col("r.tile").alias("j"), F.col("l.held") + F.col("r.held"))
    pairs = pairs.toDF("cluster", "i", "j", "held").filter("i <> j or held > 2")  # a tile with one set has no pairs within
    pairs = materialize(pairs, "pairs")
    ends = pairs.select("cluster", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("tile"))
    packed = sets.filter("packed is not null").select("doc", "digest", "packed")
    dealt = (members.join(ends, ["cluster", "tile"]).join(packed, ["doc", "digest"])
             .select("cluster", "i", "j", "tile", "doc", "digest", "copies", "packed"))
    # small clusters share groups of about a tile; pairs of larger tiles are groups of their own
    shared = 1 + members.count() // TILE_SETS
    whole = pairs.groupBy("cluster").agg(F.count(F.lit(1)).alias("p"), F.sum("held").alias("s"))
    alone = (F.col("p") == 1) & (F.col("s") <= 64)
    dealt = dealt.join(whole, "cluster").withColumn("task", F.when(alone, F.pmod(F.xxhash64("cluster"), F.lit(shared))).otherwise(F.xxhash64("cluster", "i", "j")))
    linked = materialize(dealt.groupBy("task").applyInPandas(_tile_pairs(rule), "digest binary, doc long, root long, links long"), "links")

    ids = sets.filter("digest is not null").groupBy("doc").agg(F.min("digest").alias("d1"), F.max("digest").alias("d2")).filter("d1 <> d2")
    again = (sets.select("doc", "digest").join(ids.select("doc"), "doc").select(F.col("doc").alias("a"), "digest").distinct()
             .join(groups.select("digest", F.col("doc").alias("b")), "digest").select("a", "b"))
    joined = components(linked.select(F.col("doc").alias("a"), F.col("root").alias("b")).unionByName(again))
    counts = linked.groupBy("digest").agg(F.sum("links").alias("links"))
    labels = (groups.select("digest", "doc", "copies").join(joined, F.col("doc") == F.col("node"), "left").join(counts, "digest", "left")
              .select("digest", "copies", F.coalesce("component", "doc").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    out = join_unique(sets.select("doc", "n", "digest"), materialize(labels, "labels"), "digest", "copies")
    return out.select(id_back(F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"),
                      id_back(F.coalesce("component", "doc")).alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
