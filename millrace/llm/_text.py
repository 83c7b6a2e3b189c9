"""Vectorised text kernels shared by the operators that read whole texts.

Texts are handled as one byte (or code point) buffer for many rows at a time,
so that the work per character is a few numpy passes. Rows are never split or
shortened; a slice only bounds how many rows are in memory at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * SLICE_BYTES)
            for name, base in (("up", _BASE), ("down", _BASE_INV)):
                steps = np.full(size, base, U64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes of text, or of one row."""
    flat = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
    lens = pa.compute.binary_length(flat).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lens)
    at, n, base = 0, len(ends), 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield at, to
        base, at = int(ends[to - 1]), to


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, and where each row begins (one more than rows)."""
    flat = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = flat.buffers()
    if not len(flat):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64, len(flat) + 1, flat.offset * 8)
    raw = np.frombuffer(data, np.uint8, int(offs[-1] - offs[0]), int(offs[0])) if offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each ASCII-lower-cased word, and where each row's words begin.

    Words are runs of bytes other than the six ASCII white-space characters. The
    hash is a 64-bit polynomial of the word's bytes, so that equal words have
    equal hashes wherever they stand.
    """
    raw, offs = utf8(texts)
    n = len(raw)
    if not n:
        return np.zeros(0, U64), np.zeros(len(offs), np.int64)
    inside = ~WHITE[raw]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = ~inside[:-1]
    starts = np.flatnonzero(inside & (before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = ~inside[1:]
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    up, down = _powers.upto(n)
    total = np.zeros(n + 1, U64)
    np.cumsum((LOWER[raw].astype(U64) + U64(1)) * up, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts]), np.searchsorted(starts, offs)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its `width`-word shingles.

    A row with fewer words has its whole sequence as one shingle; a row without
    words (or null) has none.
    """
    words, first = word_hashes(texts)
    factor = U64(0xD6E8FEB86659FD93)
    run = words.copy()
    for k in range(1, min(width, len(words))):
        run[: len(words) - k] = run[: len(words) - k] * factor + words[k:]
    run = mix(run)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(run[a : b - width + 1]))
        elif b > a:
            h = U64(b - a)
            for w in words[a:b]:
                with np.errstate(over="ignore"):
                    h = h * factor + w
            out.append(mix(np.array([h], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(points: np.ndarray, orders: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """For each order the bucket (below 2**bits) of every n-gram of code points."""
    acc = points * np.uint32(0x9E3779B1) + np.uint32(0x85EBCA6B)
    for n in range(1, max(orders) + 1):
        if n > 1:
            if len(points) < n:
                return
            acc = (acc[:-1] ^ (acc[:-1] >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + points[n - 1 :] * np.uint32(0x9E3779B1)
        if n in orders and len(acc):
            h = (acc ^ (acc >> np.uint32(16))) * np.uint32(0x297A2D39)
            yield (h ^ (h >> np.uint32(15))) >> np.uint32(32 - bits)
