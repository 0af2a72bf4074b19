"""SentencePiece vocabularies: encoding by a streaming Viterbi search, and decoding."""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices
from .shingles import mix, powers

SPACE = "▁"
LANE = 32
CACHE = 300_000
UNKNOWN_PENALTY = 10.0
COMMIT_EVERY = 64
_BASE = 0x9E3779B97F4A7C15


class Vocabulary:
    """Pieces with scores, searched for the segmentation of the largest sum.

    Read from a model file whose normalizer keeps texts as they are. Unknown characters become byte
    pieces. Of equal sums the longer last piece wins.
    """

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("this model's normalizer changes texts")
        kind = sentencepiece_model_pb2.ModelProto.SentencePiece
        self.prefix = spec.add_dummy_prefix
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kind.NORMAL}
        self.scores = np.array([p.score for p in proto.pieces], float)
        self.bytes = [0] * 256
        for i, p in enumerate(proto.pieces):
            if p.type == kind.BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = i
        if not all(self.bytes):
            raise ValueError("this model has no byte pieces")
        self.texts = [p.piece.replace(SPACE, " ").encode() if p.type == kind.NORMAL else b"" for p in proto.pieces]
        for b, i in enumerate(self.bytes):
            self.texts[i] = bytes([b])
        self.longest = max(map(len, self.ids))
        self.unknown = min(self.scores[list(self.ids.values())]) - UNKNOWN_PENALTY
        # a space mark after another character is a boundary of every segmentation if no piece holds the two
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        keys = self._keys([np.array([ord(c) for c in p], np.uint64) for p in self.ids])
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array(list(self.ids.values()), np.int64)[order]
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces share a hash")

    def _keys(self, pieces):
        return np.array([mix((mix(p + np.uint64(1)) * powers(len(p), _BASE)).sum(dtype=np.uint64)[None] + np.uint64(len(p)))[0] for p in pieces], np.uint64)

    def stream(self, chars):
        """Ids of a stream of characters, given out as soon as they are certain.

        Scores are held for the boundaries a piece may still start at, at most the longest piece back.
        When the best paths to all of them run through one boundary, everything before it is settled.
        """
        best, back, tail, base, at = {0: 0.0}, {}, "", 0, 0
        for c in chars:
            at += 1
            tail = (tail + c)[-self.longest:]
            top = None
            for size in range(len(tail), 0, -1):
                i = self.ids.get(tail[-size:])
                score = best.get(at - size)
                if score is None:
                    continue
                if i is not None:
                    score += self.scores[i]
                elif size == 1:
                    score += self.unknown
                else:
                    continue
                if top is None or score > top[0]:
                    top = (score, at - size, tail[-size:])
            best[at], back[at] = top[0], top[1:]
            best.pop(at - self.longest, None)
            if at % COMMIT_EVERY == 0:
                ends = set(best)
                while len(ends) > 1:
                    last = max(ends)
                    ends.remove(last)
                    ends.add(back[last][0])
                meet = ends.pop()
                if meet > base:
                    yield from self._path(back, base, meet)
                    for k in range(base + 1, meet + 1):
                        del back[k]
                    base, low = meet, best[max(best)]
                    best = {k: v - low for k, v in best.items()}  # only differences matter: sums stay exact
        yield from self._path(back, base, at)

    def _path(self, back, base, end):
        out = []
        while end > base:
            end, piece = back[end]
            i = self.ids.get(piece)
            out.append([i] if i is not None else [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")])
        for ids in reversed(out):
            yield from ids

    def lanes(self, texts: list[str]) -> list[bytes]:
        """The same search for many short texts at once: ids of each as 32-bit numbers.

        All texts step through their characters together; substrings are looked up by hash.
        """
        sizes = np.array([len(t) for t in texts])
        order = np.argsort(-sizes, kind="stable")
        n, width = len(texts), int(sizes.max())
        codes = np.zeros((width, n), np.uint64)
        flat = np.frombuffer("".join(texts[i] for i in order).encode("utf-32-le", "surrogatepass"), np.uint32)
        live = [int((sizes >= k).sum()) for k in range(width + 2)]
        ends = np.cumsum(sizes[order])
        row = np.repeat(np.arange(n), sizes[order])
        codes[np.arange(len(flat)) - np.repeat(ends - sizes[order], sizes[order]), row] = flat
        up, down = powers(width + 1, _BASE), powers(width + 1, pow(_BASE, -1, 1 << 64))
        total = np.zeros((width + 1, n), np.uint64)
        np.cumsum(mix(codes + np.uint64(1)) * up[:width, None], axis=0, out=total[1:], dtype=np.uint64)
        best = np.full((width + 1, n), -np.inf)
        best[0] = 0
        size_of, piece_of = np.zeros((width + 1, n), np.int8), np.full((width + 1, n), -1, np.int32)
        for at in range(1, width + 1):
            m = live[at]
            for size in range(min(at, self.longest), 0, -1):
                key = mix((total[at, :m] - total[at - size, :m]) * down[at - size] + np.uint64(size))
                found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                known = self.keys[found] == key
                ids = self.key_ids[found]
                score = best[at - size, :m] + np.where(known, self.scores[ids], self.unknown if size == 1 else -np.inf)
                better = np.flatnonzero(score > best[at, :m])
                best[at, better] = score[better]
                size_of[at, better] = size
                piece_of[at, better] = np.where(known[better], ids[better], -1)
        end = sizes[order].copy()
        steps = []  # (text, end, piece) of all best paths, from their ends
        rows = np.arange(n)
        while len(rows):
            steps.append((rows, end[rows], piece_of[end[rows], rows]))
            end[rows] -= size_of[end[rows], rows]
            rows = rows[end[rows] > 0]
        r = np.concatenate([s[0] for s in steps])
        e = np.concatenate([s[1] for s in steps])
        p = np.concatenate([s[2] for s in steps])
        by = np.lexsort((e, r))
        r, e, p = r[by], e[by], p[by].astype("<i4")
        starts = np.searchsorted(r, np.arange(n + 1))
        odd = set(r[p < 0].tolist())
        packed, out = p.tobytes(), [b""] * n
        for k in range(n):
            a, b = starts[k], starts[k + 1]
            if k in odd:
                text = texts[order[k]]
                ids = [[x] if x >= 0 else [self.bytes[c] for c in text[q - 1].encode("utf-8", "surrogatepass")] for q, x in zip(e[a:b].tolist(), p[a:b].tolist())]
                out[order[k]] = np.array([i for x in ids for i in x], "<i4").tobytes()
            else:
                out[order[k]] = packed[4 * a:4 * b]
        return out

    def encode_many(self, texts, cache: dict) -> list[bytes]:
        """Ids of whole texts as 32-bit numbers. Stretches between sure boundaries are searched once per distinct one."""
        rows = []
        for t in texts:
            t = t.replace(" ", SPACE)
            t = SPACE + t if t and self.prefix else t
            rows.append(re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", t) if self.cuts else [t] if t else [])
        new = list({s for row in rows for s in row} - cache.keys())
        if len(cache) + len(new) > CACHE:
            cache.clear()
            new = list({s for row in rows for s in row})
        short = sorted((s for s in new if len(s) <= LANE), key=len)
        for i in range(0, len(short), 1 << 15):
            cache.update(zip(short[i:i + (1 << 15)], self.lanes(short[i:i + (1 << 15)])))
        for s in new:
            if len(s) > LANE:
                cache[s] = np.fromiter(self.stream(s), "<i4").tobytes()
        return [b"".join(map(cache.__getitem__, row)) for row in rows]

    def decode(self, ids) -> str:
        """The text of ids; bytes that are not UTF-8 become replacement characters."""
        out = b"".join(map(self.texts.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if self.prefix and out[:1] == " " else out


def load(path: str) -> Vocabulary:
    """The vocabulary of a model file, read by the driver; tasks get it with their code (about a megabyte)."""
    with open(path, "rb") as f:
        return Vocabulary(f.read())


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the column ``ids``; a null text has null ids, an empty one none.

    Texts are encoded whole, one by one: copies get equal ids. A column named as ``ids`` is replaced.
    """
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = {}
        for texts in columns:
            out = []
            for part in slices(pa.record_batch([texts], names=["t"]), 0):
                values = part.column(0).to_pylist()
                found = vocabulary.encode_many(["" if t is None else t for t in values], known)
                ends = np.cumsum([0] + [len(b) // 4 for b in found]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")),
                                                    mask=pa.array([t is None for t in values])))
            yield pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))

    return docs.withColumn(ids, F.arrow_udf(run, "array<int>")(F.col(text)))


def decode(rows: DataFrame, vocabulary: Vocabulary, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ids (null for null). Encoding turns U+2581 into a space; all else comes back."""
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in columns:
            yield pa.array([vocabulary.decode(i.values.to_numpy().tolist()) if i.is_valid else None for i in lists], pa.string())

    return rows.withColumn(text, F.arrow_udf(run, "string")(F.col(ids)))
