"""Vectorised byte-level text primitives in numpy: words, word hashes, shingle hashes, over many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_STEP = _U(0xD6E8FEB86659FD93)
_powers = {"n": 0, "up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (a finalizer of the splitmix family)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            for key, factor in (("up", _BASE), ("down", _BASE_INVERSE)):
                p = np.full(size, factor, np.uint64)
                p[0] = 1
                _powers[key] = np.multiply.accumulate(p)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array end to end, and the n + 1 offsets of its rows; nulls have no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer row is a range of its own, whole."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the rows i..j of concatenated texts, lower-cased A-Z, with a 64-bit hash each."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool = True):
        self.raw = _LOWER[raw] if lower else raw
        self.offsets = offsets - offsets[0]
        n = len(raw)
        inside = ~_IS_SPACE[raw]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        begin = inside.copy()
        if n:
            begin[1:] &= ~inside[:-1] | edge[1:n]
        stop = inside.copy()
        if n:
            stop[:-1] &= ~inside[1:] | edge[1:n]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        #: bounds[k] .. bounds[k + 1] are the words of row k
        self.bounds = np.searchsorted(self.starts, self.offsets)

    def hashes(self) -> np.ndarray:
        n = len(self.raw)
        up, down = _powers_to(n + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE_CODE[self.raw] * up[:n], out=total[1:])
            return mix((total[self.ends] - total[self.starts]) * down[self.starts])


def shingle_sets(words: Words, size: int = 4) -> Iterator[np.ndarray]:
    """Per row, the sorted distinct 64-bit hashes of its shingles; a row of fewer words is one shingle, of none an empty set."""
    h = words.hashes()
    with np.errstate(over="ignore"):
        run = np.zeros(max(0, len(h) - size + 1), np.uint64)
        for k in range(size):
            run = run * _STEP + h[k : k + len(run)]
        run = mix(run)
        for a, b in zip(words.bounds[:-1], words.bounds[1:]):
            if b - a >= size:
                yield np.unique(run[a : b - size + 1])
            elif b > a:
                short = np.full(1, b - a, np.uint64)
                for x in h[a:b]:
                    short = short * _STEP + x
                yield mix(short + _STEP)
            else:
                yield np.zeros(0, np.uint64)


def each_slice(batch_texts: pa.Array, lower: bool = True) -> Iterator[tuple[int, int, Words]]:
    raw, offsets = text_bytes(batch_texts)
    for i, j in slices(offsets):
        yield i, j, Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1], lower)
