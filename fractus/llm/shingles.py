"""Hashes of words and of runs of words over Arrow string columns, vectorised."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; a longer text is hashed in blocks that end between words.
BLOCK = 1 << 18
_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))
_CODES[65:91] = _CODES[97:123]  # A to Z count as a to z
#: Words are runs of bytes other than the space and U+0009 to U+000D.
BREAKS = np.zeros(256, bool)
BREAKS[[9, 10, 11, 12, 13, 32]] = True

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        up, down = np.full(size, _P, np.uint64), np.full(size, _P_INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _powers[0], _powers[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def word_hashes(column: pa.Array, breaks: np.ndarray = BREAKS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the number of words up to each text (a leading 0 first)."""
    (hashes,), ends = term_hashes(column, breaks, ())
    return hashes, ends


def term_hashes(column: pa.Array, breaks: np.ndarray, prefixes: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """As :func:`word_hashes`, with an array more for each prefix length in bytes; 0 stands where a word isn't longer."""
    data, offsets = buffers(column)
    hashes: list[list[np.ndarray]] = [[] for _ in range(1 + len(prefixes))]
    starts = []
    low, last = int(offsets[0]), int(offsets[-1])
    while low < last:
        high = min(low + BLOCK, last)
        if high < last:  # end the block at a text's end or behind a break
            text = int(offsets[np.searchsorted(offsets, high, "right") - 1])
            if text > low:
                high = text
            else:
                end = int(offsets[np.searchsorted(offsets, high, "left")])
                while high < end:
                    found = np.flatnonzero(breaks[data[high : min(high + 65536, end)]])
                    if len(found):
                        high += int(found[0]) + 1
                        break
                    high = min(high + 65536, end)
        part = data[low:high]
        inside = ~breaks[part]
        first = np.zeros(len(part), bool)
        edges = offsets[np.searchsorted(offsets, low, "left") : np.searchsorted(offsets, high, "left")] - low
        first[edges[edges < len(part)]] = True
        first[0] = True
        begin = np.flatnonzero(inside & (first | ~np.r_[False, inside[:-1]]))
        finish = np.flatnonzero(inside & (np.r_[first[1:], True] | ~np.r_[inside[1:], False])) + 1
        up, down = _power_tables(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_CODES[part] * up[: len(part)], out=total[1:], dtype=np.uint64)
        value = (total[finish] - total[begin]) * down[begin]
        hashes[0].append(mix(value + (finish - begin).astype(np.uint64) * np.uint64(0xD1342543DE82EF95)))
        for k, length in enumerate(prefixes, 1):
            longer = finish - begin > length
            value = (total[np.minimum(begin + length, len(part))] - total[begin]) * down[begin]
            hashes[k].append(np.where(longer, mix(value + np.uint64(length << 32 | 1)), np.uint64(0)))
        starts.append(begin + low)
        low = high
    together = [np.concatenate(h) if h else np.zeros(0, np.uint64) for h in hashes]
    all_starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return together, np.searchsorted(all_starts, offsets, "left")


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles of ``size`` words.

    A text of fewer words, but not none, has its whole sequence as one shingle.
    """
    words, ends = word_hashes(column)
    rolled = words.copy()
    n = len(words) - size + 1
    if n > 0:
        rolled = words[:n].copy()
        for k in range(1, size):
            rolled = rolled * np.uint64(_P) + words[k : k + n]
        rolled = mix(rolled)
    for low, high in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if high - low >= size:
            out = np.sort(rolled[low : high - size + 1])
            yield out[np.r_[True, out[1:] != out[:-1]]]
        elif high > low:
            value = high - low
            for w in words[low:high].tolist():
                value = (value * _P + w) & _MASK
            yield mix(np.array([value ^ 0xA5A5A5A5], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
