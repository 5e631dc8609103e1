"""Array views of Arrow text columns, and hashes of many byte ranges at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Eight-byte blocks hashed in one go; bounds what the arrays below take.
SPAN = 250_000
#: What is kept of a block of which a range holds 0 to 8 bytes.
KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every input bit over all 64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


def blocks_of(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None):
    """Eight-byte blocks of ascending ranges, zero-filled at a range's end, in bounded portions.

    Yields (first range, blocks of each range from it on, number of each block in its
    range, blocks).  A long range may go on in the next portion.  ``fold`` maps bytes
    first (for lower-casing).
    """
    count = (ends - starts + 7) >> 3
    last = np.cumsum(count)
    first = last - count
    total = int(last[-1]) if len(last) else 0
    for low in range(0, total, SPAN):
        high = min(total, low + SPAN)
        i, j = int(np.searchsorted(first, low, "right")) - 1, int(np.searchsorted(first, high, "left"))
        here = np.minimum(last[i:j], high) - np.maximum(first[i:j], low)
        number = np.arange(low, high) - np.repeat(first[i:j], here)
        at = np.repeat(starts[i:j], here) + 8 * number
        left = np.minimum(np.repeat(ends[i:j], here) - at, 8)
        base, top = int(at[0]), min(int(at[-1]) + 8, len(buf))
        held = np.zeros(top - base + 8, np.uint8)
        held[: top - base] = buf[base:top] if fold is None else fold[buf[base:top]]
        words = np.ndarray((top - base + 1,), "<u8", held, 0, (1,))[at - base]
        yield i, here, number, words & KEEP[left]


def hash_ranges(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each range; ``starts`` ascend and ranges don't overlap.

    Every block goes through a bijection that depends on its place before they are summed,
    so no two texts of a few repeated letters cancel each other out, as they can in a
    polynomial modulo 2^64.
    """
    out = np.zeros(len(starts), np.uint64)
    for i, here, number, words in blocks_of(buf, starts, ends, fold):
        values = mix(words ^ mix((number.astype(np.uint64) + np.uint64(1)) * _ODD))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
        edge = np.concatenate([[0], np.cumsum(here)])
        out[i : i + len(here)] += sums[edge[1:]] - sums[edge[:-1]]
    return mix(out + (ends - starts).astype(np.uint64) * _ODD)
