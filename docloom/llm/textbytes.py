"""Whole texts of an Arrow column as one byte array, and rolling hashes over it (helpers used inside tasks)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
#: Two odd bases of rolling hashes: with both, a window is known by 128 bits.
BASE, SECOND = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), dtype=U)
    filled = 1
    while filled < n:
        step = min(filled, n - filled)
        out[filled : filled + step] = out[:step] * U(pow(base, filled, 1 << 64))
        filled += step
    return out


_cache: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """A cached prefix of the power table (it grows as longer inputs come)."""
    have = _cache.get(base)
    if have is None or len(have) < n:
        _cache[base] = have = _powers(base, max(n, 1 << 16))
    return have[:n]


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h + U(seed * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(29))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(32))


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """Polynomial hashes of values[starts[i]:ends[i]], mixed; values are 64-bit numbers."""
    n = len(values)
    total = np.zeros(n + 1, dtype=U)
    np.cumsum(values * powers(base, n), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(pow(base, -1, 1 << 64), n + 1)[starts])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words, some at a time: the byte values take eight times the text."""
    parts, at = [np.zeros(0, U)], 0
    while at < len(starts):
        low, upto = starts[at], max(at + 1, int(np.searchsorted(ends, starts[at] + 300_000, side="right")))
        parts.append(spans_hash(BYTE_VALUE[data[low : ends[upto - 1]]], starts[at:upto] - low, ends[at:upto] - low))
        at = upto
    return np.concatenate(parts)


def windows_hash(values: np.ndarray, width: int, base: int = BASE) -> np.ndarray:
    """Mixed hashes of every window of `width` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    total = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * powers(base, len(values)), out=total[1:])
    return mix((total[width:] - total[:-width]) * powers(pow(base, -1, 1 << 64), n))


def least_of_equals(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of 128-bit hashes: each one's number among the distinct, and the first index at which each of the distinct stands."""
    order = np.lexsort((second, first))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(fresh) - 1
    return number, order[fresh]


BYTE_VALUE = mix(np.arange(1, 257, dtype=U))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts end to end, offsets of length rows + 1); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes other than 0x20 and 0x09-0x0D, never across texts: starts, ends, text index of each."""
    n = len(data)
    ink = ~((data == 0x20) | ((data >= 9) & (data <= 13)))
    before = np.zeros(n, dtype=bool)
    before[1:] = ink[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    before[edges] = False
    starts = np.flatnonzero(ink & ~before)
    after = np.zeros(n, dtype=bool)
    after[:-1] = ink[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(ink & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def cover(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n cells lie in a window [s, s + width)."""
    step = np.zeros(n + width + 1, dtype=np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + width, -1)
    return np.cumsum(step)[:n] > 0


def doc_blocks(offsets: np.ndarray, size: int = 128_000):
    """Ranges (a, b) of consecutive texts of about `size` bytes together; a longer text is alone."""
    a, last = 0, len(offsets) - 1
    while a < last:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield a, b
        a = b
