"""Text columns as byte buffers: zero-copy views of Arrow batches, word bounds and rolling hashes, all vectorised."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import TypeVar

import numpy as np
import pyarrow as pa

T = TypeVar("T")

#: Bytes of text that the vectorised steps take at once; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20

_B = 0x9E3779B97F4A7C15 | 1
_BINV = pow(_B, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: Lower case for ASCII; every other byte than letters, digits and UTF-8 parts is a separator (32).
WORD_LUT = np.full(256, 32, np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    WORD_LUT[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    WORD_LUT[_c] = _c + 32
WORD_LUT[128:] = np.arange(128, 256)


_HELD: dict[str, object] = {}


def held(key: str, make: Callable[[], T]) -> T:
    """``make()``, once in each worker process for a key; what was made for the key before is let go."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _B, np.uint64), np.full(n, _BINV, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(20, int(n).bit_length()))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first, last) document of runs that hold ``limit`` bytes at most, or one document."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def word_bounds(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document) of the words in ``low``, bytes that went through WORD_LUT; offsets begin at 0."""
    is_word = low != 32
    before = np.empty_like(is_word)
    before[:1] = False
    before[1:] = is_word[:-1]
    inner = offsets[:-1][offsets[:-1] < len(low)]
    before[inner] = False
    starts = np.flatnonzero(is_word & ~before)
    after = np.empty_like(is_word)
    after[-1:] = False
    after[:-1] = is_word[1:]
    lasts = offsets[1:] - 1
    after[lasts[lasts >= 0]] = False
    ends = np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], the same wherever the bytes stand."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
