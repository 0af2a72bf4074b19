"""Language identification with hyperdimensional letter profiles."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import slices

DIMS = 512
UNIT = 1 << 20
MOST_LANGUAGES = 10000
BLOCK = 4096
TABLE = 16384
PART = 1 << 20
UNKNOWN = "und"
_BITS = 21
_LETTERS = {}
_ALPHA = np.zeros(0, bool)


def letter_vector(code: int) -> np.ndarray:
    """The random vector of +1 and -1 of a letter, the same on every machine; 0 stands for a word's edge."""
    if code not in _LETTERS:
        _LETTERS[code] = np.random.default_rng([31, code]).choice(np.array([-1, 1], np.int8), DIMS)
    return _LETTERS[code]


def grams(text: str):
    """Distinct letter trigrams of a text and how often each occurs; everything but letters is a word's edge."""
    global _ALPHA
    if not len(_ALPHA):
        _ALPHA = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.r_[0, np.where(_ALPHA[codes], codes, 0), 0].astype(np.uint64)
    codes = codes[np.r_[True, (codes[1:] != 0) | (codes[:-1] != 0)]]
    if len(codes) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    b = np.uint64(_BITS)
    return np.unique((codes[:-2] << (b + b)) | (codes[1:-1] << b) | codes[2:], return_counts=True)


def gram_vectors(keys: np.ndarray) -> np.ndarray:
    """One row per trigram: its letters' vectors, rotated by their place, multiplied."""
    mask, out = np.uint64((1 << _BITS) - 1), None
    for place in range(3):
        codes, at = np.unique((keys >> np.uint64(_BITS * (2 - place))) & mask, return_inverse=True)
        vectors = np.stack([np.roll(letter_vector(int(c)), 2 - place) for c in codes])[at]
        out = vectors if out is None else out * vectors
    return out


def bundle(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of weighted trigram vectors; whole numbers, so the order of adding does not matter."""
    total = np.zeros(DIMS, np.int64)
    for i in range(0, len(keys), BLOCK):
        total += np.rint(weights[i:i + BLOCK].astype(np.float64) @ gram_vectors(keys[i:i + BLOCK]).astype(np.float64)).astype(np.int64)
    return total


@dataclass(frozen=True)
class Profiles:
    """Prototype vectors of the languages learned, of length 1, in the order of their names."""

    names: tuple
    vectors: np.ndarray

    def predict(self, texts: list) -> list[tuple[str, float]]:
        """Of each text the language whose prototype is nearest by cosine (the first of equal ones), and that cosine, at least 0."""
        found = [grams(t or "") for t in texts]
        keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True) if found else (np.zeros(0, np.uint64), None)
        table = gram_vectors(keys).astype(np.float32) if 0 < len(keys) <= TABLE else None
        out, start = [], 0
        for grams_of, counts in found:
            n = len(grams_of)
            if not n or not self.names:
                out.append((UNKNOWN, 0.0))
                continue
            # sums of whole numbers below 2**24 are exact in 32 bits
            exact = table is not None and counts.sum() < 1 << 24
            vector = (counts.astype(np.float32) @ table[at[start:start + n]] if exact else bundle(grams_of, counts)).astype(np.float64)
            start += n
            length = np.sqrt(vector @ vector)
            cosines = self.vectors @ (vector / length) if length else np.zeros(len(self.names))
            best = int(cosines.argmax())
            out.append((self.names[best], min(1.0, max(0.0, float(cosines[best])))))
        return out


def _learn(batches):
    held = {}
    for batch in batches:
        for part in slices(batch, 1):
            found = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                keys, counts = grams(text)
                if len(keys):
                    weights = np.rint(counts * (UNIT / np.sqrt(float(counts @ counts)))).astype(np.int64)
                    found.setdefault(lang, []).append((keys, weights))
            for lang, pairs in found.items():  # bundling is linear: add up the weights first
                keys, at = np.unique(np.concatenate([k for k, _ in pairs]), return_inverse=True)
                weights = np.zeros(len(keys), np.int64)
                np.add.at(weights, at, np.concatenate([w for _, w in pairs]))
                held[lang] = held.get(lang, 0) + bundle(keys, weights)
    for lang, vector in held.items():
        yield pa.record_batch([pa.array([lang] * DIMS), pa.array(range(DIMS), pa.int32()), pa.array(vector, pa.int64())], names=["lang", "dim", "value"])


def learn(labelled: DataFrame) -> Profiles:
    """Profiles from ``lang`` and ``text``: every document adds its trigrams with length 1 to its language.

    Rows with a null in either, or without a letter, teach nothing. What comes to the driver is one
    vector per language; more than ten thousand languages are refused.
    """
    rows = labelled.select("lang", "text").filter("lang is not null and text is not null")
    sums = rows.mapInArrow(_learn, "lang string, dim int, value long").groupBy("lang", "dim").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    vectors = sums.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "value"))), lambda s: s["value"].cast("double")).alias("v"))
    found = sorted(tuple(r) for r in vectors.limit(MOST_LANGUAGES + 1).collect())
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    matrix = np.array([v for _, v in found], float).reshape(len(found), DIMS)
    lengths = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return Profiles(tuple(n for n, _ in found), matrix / np.where(lengths == 0, 1, lengths))


def guess(text: Column, profiles: Profiles) -> Column:
    """Struct of ``lang_pred`` and ``score`` (0 to 1) of a text; ``und`` with score 0 if it is null or has no letter."""
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in columns:
            found = []
            for part in slices(pa.record_batch([texts], names=["t"]), 0, PART):
                found += profiles.predict(part.column(0).to_pylist())
            yield pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                                             names=["lang_pred", "score"])

    return F.arrow_udf(run, "lang_pred string, score double")(text)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, from the text alone (see :func:`guess`).

    Rows are judged one by one: copies and repeated ids get the same answer; an empty table stays
    empty. Columns of ``docs`` with these two names are replaced.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(F.struct(*[F.col(c) for c in kept]).alias("row"), guess(F.col(text), profiles).alias("guess"))
    return rows.select("row.*", "guess.lang_pred", "guess.score")


def held_out(doc_id: Column) -> Column:
    """The third of documents that nothing is learned from; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1
