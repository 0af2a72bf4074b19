"""Removal of byte strings that occur earlier, by longest-previous-factor arrays over suffix order.

Every window of ``length`` bytes is keyed by the least hash of the 32-byte strings in it, so equal
windows always share a key. Neighbouring windows with one key are a block. Blocks meet by key: a block
that repeats an earlier one whole is decided by its hash, and only distinct blocks that share a key are
compared byte by byte, as the suffixes of a text made of them.
"""

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from ..plans.scratch import materialize
from .common import id_back, id_key, slices
from .shingles import joined_bytes, mix, range_hashes

LENGTH = 100
GRAM = 32
CHUNK = 1 << 21
MOST_BLOCKS = 8192
_OTHER = 0xD1342543DE82EF95
_LETTER = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


def _slide(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[:len(x) - (width - done)], x[width - done:]) if done < width else x


def window_blocks(data: np.ndarray, starts: np.ndarray, length: int = LENGTH):
    """Blocks of all windows inside the texts: key, first window, number of windows, hash of the bytes, whether a window may repeat inside.

    The low seven bits of a hash give way to the place, ascending or descending; where the two give
    different places the least hash occurs twice in a window.
    """
    n, width = len(data), length - GRAM + 1
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty.view(np.uint64), empty, empty, empty.view(np.uint64), empty.astype(bool)
    gram, size, factor = _LETTER[data], 1, 0x9E3779B97F4A7C15
    while size < GRAM:
        gram = gram[:-size] * np.uint64(pow(factor, size, 1 << 64)) + gram[size:]
        size *= 2
    gram = mix(gram) & ~np.uint64(127)
    place = (np.arange(len(gram)) & 127).astype(np.uint64)
    least = _slide(gram | place, width)
    twice = least != (_slide(gram | (np.uint64(127) - place), width) ^ np.uint64(127))
    inside = np.zeros(n + 1, np.int32)
    long = starts[1:] - starts[:-1] >= length
    np.add.at(inside, starts[:-1][long], 1)
    np.add.at(inside, starts[1:][long] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(inside[:n]))
    key = least[at] >> np.uint64(7)
    if not len(at):
        return empty.view(np.uint64), empty, empty, empty.view(np.uint64), empty.astype(bool)
    new = np.r_[True, (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)]
    run = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    new |= (np.arange(len(at)) - run) % width == 0  # a longer run is cut, so that blocks stay short
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(at)])
    again = np.add.reduceat(twice[at], first) > 0
    start = at[first]
    return key[first], start, count, range_hashes(data, start, start + count - 1 + length, _OTHER), again


BLOCK = "key long, hash long, doc long, start int, n short, whole boolean"
NAMES = ["key", "hash", "doc", "start", "n", "whole"]


def _later(key, hashes, doc, start):
    """Of rows in the order of key, hash and place: where a new block begins, and which rows come after the first copy of theirs."""
    new = np.r_[True, (key[1:] != key[:-1]) | (hashes[1:] != hashes[:-1])]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    return new, (doc != doc[first]) | (start != start[first])


def _block_rows(length):
    """Blocks of the texts; of equal blocks in one batch all but the first are decided (``whole``) before the shuffle."""
    def run(batches):
        for batch in batches:
            found = []
            for part in slices(batch, 1):
                data, starts = joined_bytes(part.column(1))
                key, start, count, hashes, again = window_blocks(data, starts, length)
                row = np.searchsorted(starts, start, side="right") - 1
                found.append((key.view(np.int64), hashes.view(np.int64), part.column(0).to_numpy()[row], (start - starts[row]).astype(np.int32),
                              np.where(again, -count, count).astype(np.int16)))
            cols = [np.concatenate(c) for c in zip(*found)]
            if len(cols) and len(cols[0]):
                order = np.lexsort(cols[3::-1])
                cols = [c[order] for c in cols]
                yield pa.record_batch([pa.array(c) for c in cols] + [pa.array(_later(*cols[:4])[1])], names=NAMES)
    return run


def _judge(batches):
    """Blocks in the order of key, hash and place: later copies (``whole``), and first copies that share their key with other blocks.

    Rows decided before pass through. One row is carried from batch to batch: the first copy of the
    block that the batch ended in.
    """
    held, sent, several = None, False, False
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
        done = cols.pop()
        yield pa.record_batch([pa.array(c[done]) for c in (*cols, done)], names=NAMES)
        cols = [c[~done] for c in cols]
        if held is not None:
            cols = [np.r_[h, c] for h, c in zip(held, cols)]
        key, hashes, doc, start, n = cols
        if not len(key):
            continue
        new, later = _later(key, hashes, doc, start)
        new_key = np.r_[True, key[1:] != key[:-1]]
        first = np.flatnonzero(new)
        run = np.cumsum(new_key) - 1
        kinds = np.bincount(run[first]) > 1
        kinds[0] |= several and held is not None
        send = new & (kinds[run] | (n < 0))
        if held is not None and sent:
            send[0] = False
        out = np.flatnonzero(later | send)
        last = first[-1]
        held = [c[last:last + 1] for c in cols]
        sent = bool(kinds[-1] or n[last] < 0)
        several = bool(kinds[-1])
        yield pa.record_batch([pa.array(c[out]) for c in cols] + [pa.array(later[out])], names=NAMES)


def suffix_order(text: np.ndarray, at: np.ndarray, length: int):
    """Order of the suffixes at ``at`` by their first ``length`` bytes (equal ones as given), and how many bytes neighbours share."""
    windows = np.lib.stride_tricks.sliding_window_view(text, length)[at]
    order = np.argsort(np.ascontiguousarray(windows).view(f"S{length}").ravel(), kind="stable")
    windows = windows[order]
    differ = windows[1:] != windows[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    return order, np.r_[0, shared]


def longest_previous(place: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Longest previous factors in suffix order: how many bytes each suffix shares with some suffix of a smaller place.

    The best match is the nearest smaller place before or after in suffix order. Pointers to it jump
    over places known to be larger, all at once, with the least shared length on the way.
    """
    n = len(place)
    best = np.zeros(n, np.int64)
    for v, common in ((place, shared), (place[::-1], np.r_[0, shared[:0:-1]])):
        to, least = np.arange(n) - 1, common.copy()
        open_ = np.flatnonzero((to >= 0) & (least > 0))
        while len(open_):
            open_ = open_[v[to[open_]] >= v[open_]]
            jump = to[open_]
            far, way = to[jump], np.minimum(least[open_], least[jump])
            to[open_], least[open_] = far, way
            open_ = open_[(far >= 0) & (way > 0)]
        found = np.where(to >= 0, least, 0)
        best = np.maximum(best, found if v is place else found[::-1])
    return best


def _runs(flags):
    """Runs of true values as start and length, start and length, ..."""
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    out = np.empty(len(edge), np.int32)
    out[0::2], out[1::2] = edge[0::2], edge[1::2] - edge[0::2]
    return out


def previous_windows(blocks, doc, start, n, length: int = LENGTH):
    """For blocks of bytes (in any order) the runs of windows of each that also start earlier in one of them."""
    size = np.array([len(b) for b in blocks])
    base = np.r_[0, np.cumsum(size)[:-1]]
    text = np.frombuffer(b"".join(blocks), np.uint8)
    of = np.repeat(np.arange(len(blocks)), n)
    offset = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    places = np.lexsort((start[of] + offset, doc[of]))
    d, s = doc[of][places], (start[of] + offset)[places]
    rank = np.empty(len(of), np.int64)
    rank[places] = np.cumsum(np.r_[False, (d[1:] != d[:-1]) | (s[1:] != s[:-1])])  # equal places are equal
    order, shared = suffix_order(text, base[of] + offset, length)
    previous = np.empty(len(of), np.int64)
    previous[order] = longest_previous(rank[order], shared)
    found = previous >= length
    ends = np.cumsum(n)
    return [_runs(found[e - c:e]) for e, c in zip(ends, n)]


COMPARED = "doc long, start int, n short, hash long, runs array<int>, w1 long, w2 long, place int"


def _compare(length):
    """Blocks in the order of their keys: decided in chunks of whole keys; a key with too many blocks leaves as windows."""
    def whole(rows):
        doc, start, n, hashes = (np.array([r[i] for r in rows]) for i in (1, 2, 3, 4))
        runs = previous_windows([r[5] for r in rows], doc, start.astype(np.int64), n.astype(np.int64), length)
        keep = [i for i, r in enumerate(runs) if len(r)]
        none = pa.nulls(len(keep), pa.int64())
        return pa.record_batch([pa.array(doc[keep], pa.int64()), pa.array(start[keep], pa.int32()), pa.array(n[keep], pa.int16()), pa.array(hashes[keep], pa.int64()),
                                pa.array([runs[i] for i in keep], pa.list_(pa.int32())), none, none, pa.nulls(len(keep), pa.int32())], names=OUT)

    def apart(rows):
        n = np.array([r[3] for r in rows])
        text = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
        base = np.cumsum([len(r[5]) for r in rows]) - [len(r[5]) for r in rows]
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(base, n) + offset
        w1, w2 = range_hashes(text, at, at + length), range_hashes(text, at, at + length, _OTHER)
        doc, start, hashes = (np.repeat(np.array([r[i] for r in rows]), n) for i in (1, 2, 4))
        return pa.record_batch([pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(np.repeat(n, n), pa.int16()), pa.array(hashes, pa.int64()),
                                pa.nulls(len(at), pa.list_(pa.int32())), pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)),
                                pa.array(offset, pa.int32())], names=OUT)

    OUT = ["doc", "start", "n", "hash", "runs", "w1", "w2", "place"]

    def run(batches):
        ready, held, key, hot, size = [], [], None, False, 0
        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(6)]):
                if row[0] != key:
                    if hot:
                        yield apart(held) if held else None
                    else:
                        ready += held
                        size += sum(len(r[5]) for r in held)
                        if size >= CHUNK:
                            yield whole(ready)
                            ready, size = [], 0
                    key, held, hot = row[0], [], False
                held.append(row)
                if len(held) >= MOST_BLOCKS:
                    hot = True
                    yield apart(held)
                    held = []
        if hot and held:
            yield apart(held)
        elif not hot:
            ready += held
        if ready:
            yield whole(ready)

    def filled(batches):
        return (b for b in run(batches) if b is not None)
    return filled


def _that_hold(text, blocks, length):
    """The blocks, each with whether the text has it: of rows that share a doc_id, another one may."""
    s = np.array([b["start"] for b in blocks], np.int64)
    e = s + np.array([b["n"] for b in blocks], np.int64) - 1 + length
    ok = e <= len(text)
    if ok.any():
        ok[ok] = range_hashes(np.frombuffer(text, np.uint8), s[ok], e[ok], _OTHER).view(np.int64) == np.array([b["hash"] for b in blocks])[ok]
    return zip(blocks, ok)


def _cut_blocks(length):
    """The bytes of the blocks named for each document."""
    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for packed, blocks in zip(batch.column(0), batch.column(1)):
                text = unpack.decompress(packed.as_py())
                blocks = blocks.as_py()
                out += [(b["key"], b["doc"], b["start"], b["n"], b["hash"], text[b["start"]:b["start"] + b["n"] - 1 + length])
                        for b, ok in _that_hold(text, blocks, length) if ok]
            cols = list(zip(*out)) or [()] * 6
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int64(), pa.binary()))],
                                  names=["key", "doc", "start", "n", "hash", "bytes"])
    return run


def _remove(length):
    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            cols = [[] for _ in range(5)]
            for packed, blocks in zip(batch.column(1), batch.column(2)):
                text = unpack.decompress(packed.as_py())
                gone = np.zeros(len(text) + 1, np.int32)
                for b, ok in _that_hold(text, blocks.as_py() or (), length):
                    if ok:
                        runs = np.array(b["runs"] if b["runs"] is not None else (0, b["n"]))
                        np.add.at(gone, b["start"] + runs[0::2], 1)
                        np.add.at(gone, b["start"] + runs[0::2] + runs[1::2] - 1 + length, -1)
                gone = np.cumsum(gone[:-1]) > 0
                spans = _runs(gone)
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                for col, value in zip(cols, (len(text), len(text) - len(kept), len(spans) // 2, spans, kept)):
                    col.append(value)
            yield pa.record_batch([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                                   pa.array(cols[3], pa.list_(pa.int32())), pa.array(cols[4], pa.binary())],
                                  names=["doc", "n_bytes", "n_removed", "n_spans", "spans", "kept"])
    return run


def _pack(batches):
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = [pack.compress(t.as_buffer() if t.is_valid else b"") for t in batch.column(1)]
        yield pa.record_batch([batch.column(0), pa.array(texts, pa.binary())], names=["doc", "packed"])


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Every document without the bytes that lie in a string of ``length`` bytes which also starts earlier.

    Takes doc_id and text, as UTF-8 bytes; null is empty. Earlier means a smaller doc_id (null is the
    smallest), or the same one and an earlier start; rows that share a doc_id count as one document,
    of which none comes before the other at equal starts. Strings are judged on the input and never
    cross documents; overlaps count. Texts shorter than ``length`` keep all. Returns doc_id, n_bytes,
    n_removed, n_spans (maximal removed runs), spans (start and length of each in turn), kept (the
    remaining bytes). An empty table gives no rows; other columns are not read.

    One shuffle carries the blocks (about one per 35 bytes, without text) to their keys; texts are
    shuffled compressed, and only distinct blocks that share a key carry bytes. A key with very many
    distinct blocks leaves the suffix order and is decided by the least place of each window's hash.
    """
    rows = docs.select(id_key(F.col("doc_id")).alias("doc"), F.encode(F.col("text"), "utf-8").alias("text"))
    blocks = rows.mapInArrow(_block_rows(length), BLOCK)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.when(F.col("whole"), F.xxhash64("doc", "start")).otherwise(F.col("key"))  # decided rows need not meet
    judged = blocks.repartition(n, place).sortWithinPartitions("key", "hash", "doc", "start").mapInArrow(_judge, BLOCK)
    judged = materialize(judged.withColumn("n", F.abs("n")), "blocks")
    packed = rows.mapInArrow(_pack, "doc long, packed binary")

    asked = judged.filter("not whole").groupBy("doc").agg(F.collect_list(F.struct("key", "doc", "start", "n", "hash")).alias("blocks"))
    cut = packed.join(asked.hint("merge"), "doc").select("packed", "blocks").mapInArrow(_cut_blocks(length), "key long, doc long, start int, n short, hash long, bytes binary")
    compared = materialize(cut.repartition(n, "key").sortWithinPartitions("key", "doc", "start").mapInArrow(_compare(length), COMPARED), "compared")

    windows = compared.filter("w1 is not null")
    place = F.struct("doc", (F.col("start") + F.col("place")).alias("at"))
    firsts = windows.groupBy("w1", "w2").agg(F.min(place).alias("f")).select("w1", "w2", "f.doc", F.col("f.at").alias("at"))
    repeated = (windows.withColumn("at", F.col("start") + F.col("place")).join(firsts.hint("merge"), ["w1", "w2", "doc", "at"], "left_anti")
                .groupBy("doc", "start", "n", "hash").agg(F.flatten(F.collect_list(F.array("place", F.lit(1)))).alias("runs")))
    found = (judged.filter("whole").select("doc", "start", "n", "hash", F.lit(None).cast("array<int>").alias("runs"))
             .unionByName(compared.filter("w1 is null").select("doc", "start", "n", "hash", "runs")).unionByName(repeated))
    found = found.groupBy("doc").agg(F.collect_list(F.struct("start", "n", "hash", "runs")).alias("blocks"))
    out = (packed.join(found.hint("merge"), "doc", "left").select("doc", "packed", "blocks")
           .mapInArrow(_remove(length), "doc long, n_bytes long, n_removed long, n_spans long, spans array<int>, kept binary"))
    return out.select(id_back(F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "spans", "kept")
