"""Vectorised words and word n-grams of Arrow string columns, as 64-bit hashes.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which in UTF-8
is the same as a maximal run of such code points. A-Z is lower-cased. All sums
are modulo 2**64, so the same text has the same hashes on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)
_EXACT = np.arange(256, dtype=np.uint64) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
CHUNK_BYTES = 1 << 21
#: Powers of the base that stay in memory: one for each byte of a word up to this length.
KEPT_POWERS = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> np.ndarray:
    """The first ``n`` powers of the base."""
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _BASE)]))


_POWERS = _power(KEPT_POWERS)


def text_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) in runs of about ``CHUNK_BYTES``; null reads as empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last - first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end byte of each word; first word of each text and the end)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    edge = np.ones(n + 1, bool)
    edge[1:n] = space[:-1]
    edge[offsets[offsets < n]] = True
    starts = np.flatnonzero(~space & edge[:n])
    stop = np.ones(n, bool)
    stop[:-1] = space[1:]
    inner = offsets[(offsets > 0) & (offsets <= n)]
    stop[inner - 1] = True
    ends = np.flatnonzero(~space & stop) + 1
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    inside = np.flatnonzero(~space).astype(np.int32 if n < 1 << 31 else np.int64)
    place = np.arange(len(inside), dtype=inside.dtype) - np.repeat(first.astype(inside.dtype), lengths)
    longest = int(lengths.max(initial=0))
    power = _POWERS if longest <= KEPT_POWERS else _power(longest)
    terms = (_LOWER if lower else _EXACT)[data[inside]] * power[place]
    total = np.add.reduceat(terms, first) if len(first) else np.zeros(0, np.uint64)
    hashes = mix(total + lengths.astype(np.uint64) * _STEP)
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def _rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sum over i of hashes[at + i] * step ** (k - 1 - i), by halves."""
    if k == 1:
        return hashes
    half = k // 2
    part = _rolled(hashes, half)
    out = part[:-half] * np.uint64(pow(int(_STEP), half, 1 << 64)) + part[half:] if len(part) > half else part[:0]
    return out[:-1] * _STEP + hashes[2 * half :] if k % 2 and len(out) else out


def grams(hashes: np.ndarray, first: np.ndarray, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the ``k`` words from each position, first gram of each text and the end).

    ``short``: a text of 1 to k-1 words has one gram, its whole sequence.
    """
    counts = np.diff(first)
    each = np.maximum(counts - k + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(each)])
    at = np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], each)
    out = mix(_rolled(hashes, k)[at] + np.uint64(k * pow(int(_STEP), k, 1 << 64) % (1 << 64))) if len(at) else np.zeros(0, np.uint64)
    if short and len(rows := np.flatnonzero((counts > 0) & (counts < k))):
        extra = np.array([np.uint64(counts[r]) for r in rows], np.uint64)
        for i in range(k - 1):
            inside = counts[rows] > i
            extra[inside] = extra[inside] * _STEP + hashes[first[rows[inside]] + i]
        out = np.insert(out, bounds[rows], mix(extra))
        each[rows] = 1
        bounds = np.concatenate([[0], np.cumsum(each)])
    return out, bounds


def gram_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct ``k``-grams of each text; short texts as in :func:`grams`."""
    for _, rows, data, offsets in text_chunks(column):
        hashes, _, _, first = words(data, offsets)
        found, bounds = grams(hashes, first, k, short=True)
        for i in range(rows):
            yield np.unique(found[bounds[i] : bounds[i + 1]])


def signed(x: np.ndarray) -> pa.Array:
    """As Spark's bigint."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))
