"""Word and shingle hashes of whole texts with NumPy, straight from the bytes of an Arrow string column.

Words are runs of other bytes than space, tab, line feed, vertical tab, form feed and carriage return, A-Z lower-cased.
A word's hash is a polynomial over random 64-bit values of its bytes, finished by a mixer; a shingle's is a mixed
combination of its words' hashes. Texts are taken in slices, so memory doesn't grow with the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
WINDOW = 5

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = _BYTE[_LOWER]
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _rng.integers(0, 1 << 64, WINDOW, dtype=np.uint64) | np.uint64(1)
_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(4095, _STEP, dtype=np.uint64)]), dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    while len(_POWERS) < n:
        _POWERS = np.concatenate([_POWERS, _POWERS * (_POWERS[-1] * _STEP)])
    return _POWERS


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the first byte's place of each word in ``data``."""
    blank = _BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).view(np.int8)))
    begin, end = edge[0::2], edge[1::2]
    if not len(begin):
        return np.empty(0, np.uint64), begin
    size = end - begin
    inside = np.flatnonzero(~blank)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    place = np.arange(len(inside)) - np.repeat(first, size)
    values = _VALUE[data[inside]] * _powers(int(size.max()))[place]
    return mix(np.add.reduceat(values, first) + size.astype(np.uint64)), begin


def texts_words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts: the first one's index, all their words' hashes and the words' bounds by text (one more than texts)."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, np.uint8)
    empty = ~np.asarray(column.is_valid()) if column.null_count else None
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, side="right")) - 1)
        j = min(j, n)
        bounds = offsets[i : j + 1]
        if j == i + 1:
            hashes = _long_text(data[bounds[0] : bounds[1]])
            counts = np.array([0, len(hashes)])
        else:  # a blank after each text keeps the last word of one from the first of the next
            ends = bounds[1:] - bounds[0] + np.arange(j - i)
            spaced = np.insert(data[bounds[0] : bounds[-1]], bounds[1:] - bounds[0], 32)
            hashes, begin = word_hashes(spaced)
            counts = np.concatenate([[0], np.searchsorted(begin, ends)])
        if empty is not None and empty[i:j].any():  # bytes under nulls don't count
            keep = np.repeat(~empty[i:j], np.diff(counts))
            counts = np.concatenate([[0], np.cumsum(np.diff(counts) * ~empty[i:j])])
            hashes = hashes[keep]
        yield i, hashes, counts
        i = j


def _long_text(data: np.ndarray) -> np.ndarray:
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + SLICE)
        while end < len(data) and not _BLANK[data[end - 1]]:  # on to the next blank
            more = np.flatnonzero(_BLANK[data[end : end + SLICE]])
            end = end + int(more[0]) + 1 if len(more) else min(len(data), end + SLICE)
        out.append(word_hashes(data[at:end])[0])
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the windows of five words; of fewer words, one hash of the whole sequence; of none, none."""
    n = len(words)
    if n < WINDOW:
        return mix((words * _PLACE[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(WINDOW - n)) if n else words[:0]
    total = words[: n - 4] * _PLACE[0]
    for k in range(1, WINDOW):
        total = total + words[k : n - 4 + k] * _PLACE[k]
    return np.unique(mix(total))


def texts_shingles(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Each text's index and shingle set."""
    for first, words, bounds in texts_words(column):
        for k in range(len(bounds) - 1):
            yield first + k, shingles(words[bounds[k] : bounds[k + 1]])
