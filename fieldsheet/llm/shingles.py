"""Word shingles of whole texts as sorted arrays of 64-bit hashes, for many texts at once."""

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (the splitmix64 finish)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        held = _POWERS[base] = np.cumprod(steps, dtype=np.uint64)
    return held[:n]


def joined_bytes(column: pa.Array):
    """The bytes of an Arrow text or binary column end to end, and where each row starts (nulls are empty)."""
    if column.null_count:
        column = pa.compute.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    starts = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[starts[0]:starts[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, starts - starts[0]


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _BASE) -> np.ndarray:
    """64-bit hashes of data[start:end), from one running sum over ``data``."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data), base), out=total[1:])
    return mix((total[end] - total[start]) * powers(len(data) + 1, pow(base, -1, 1 << 64))[start] + (end - start).astype(np.uint64))


def shingle_sets(data: np.ndarray, starts: np.ndarray, words: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles of ``words`` words.

    Words are runs of bytes other than blanks (0x20, 0x09-0x0D), with A-Z lower-cased. A text with
    fewer words has one shingle, the whole sequence; one without words has none.
    """
    n = len(data)
    if not n:
        return [np.zeros(0, np.uint64) for _ in starts[:-1]]
    inside = ~_BLANK[data]
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    before = np.r_[False, inside[:-1]] & ~edge[:-1]
    first = np.flatnonzero(inside & ~before)
    after = np.r_[inside[1:], False] & ~edge[1:]
    last = np.flatnonzero(inside & ~after) + 1
    word = range_hashes(_LOWER[data], first, last)
    bounds = np.searchsorted(first, starts)
    factors = powers(words + 1, _INVERSE)
    total = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for k in range(words if len(total) else 0):
        total += word[k:k + len(total)] * factors[k + 1]
    total = mix(total)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(total[a:b - words + 1]))
        elif b > a:
            out.append(mix((word[a:b] * factors[1:1 + b - a]).sum(dtype=np.uint64)[None] + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
