"""Word and shingle hashes of Arrow text columns, with numpy, a slice of bounded size at a time.

Words are runs of bytes other than ASCII white space, with A-Z in lower case; a
shingle is five consecutive words, or the whole sequence of a text with fewer.
Hashes have 64 bits: different words or shingles are taken as different, which
fails with a chance of about n^2 / 2^65 for n of them in one comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
#: Bytes of text that are hashed at once; a longer text makes a slice of its own, which is hashed piece by piece.
SLICE_BYTES = 1 << 19
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Scatter 64-bit numbers over the whole range, one to one."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_slices(column: pa.Array, slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, byte offsets, bytes) of runs of rows; null texts are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + slice_bytes, "right")) - 1)
        end = min(end, len(column))
        yield row, offsets[row : end + 1] - offsets[row], data[offsets[row] : offsets[end]]
        row = end


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """data in pieces of about SLICE_BYTES that end before white space."""
    start = 0
    while start < len(data):
        end = start + SLICE_BYTES
        while end < len(data) and not len(gap := np.flatnonzero(IS_SPACE[data[end : end + SLICE_BYTES]])):
            end += SLICE_BYTES
        end = end + int(gap[0]) if end < len(data) else len(data)
        yield data[start:end]
        start = end


def word_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each row and the number of words at the end)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    if len(offsets) == 2 and len(data) > 2 * SLICE_BYTES:
        words = np.concatenate([_slice_hashes(np.array([0, len(x)]), x)[0] for x in _pieces(data)])
        return words, np.array([0, len(words)])
    return _slice_hashes(offsets, data)


def _slice_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = ~IS_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < len(data)]
    first[at] = inside[at]  # a word ends where its row ends
    starts = np.flatnonzero(first)
    rows = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), rows
    # A word is a polynomial in its bytes, with powers that start anew at each word.
    begin = np.zeros(len(data), np.int64)
    begin[starts] = starts
    np.maximum.accumulate(begin, out=begin)
    place = np.arange(len(data)) - begin
    longest = int(place[inside].max()) + 1
    powers = np.ones(longest, np.uint64)
    np.cumprod(np.full(longest - 1, _FACTOR), out=powers[1:])
    terms = (_LOWER[data].astype(np.uint64) + np.uint64(1)) * powers[np.minimum(place, longest - 1)]
    terms[~inside] = 0
    return mix(np.add.reduceat(terms, starts)), rows


def shingle_hashes(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle in order, first shingle of each row and the number of shingles at the end)."""
    if len(rows) == 2 and len(words) > SLICE_BYTES:
        out = np.zeros(len(words) - SHINGLE + 1, np.uint64)
        for a in range(0, len(out), SLICE_BYTES):
            b = min(a + SLICE_BYTES, len(out))
            for k in range(SHINGLE):
                out[a:b] = mix(out[a:b] * _FACTOR + words[a + k : b + k])
        return out, np.array([0, len(out)])
    count = np.diff(rows)
    per_row = np.where(count == 0, 0, np.maximum(count - SHINGLE + 1, 1))
    bounds = np.concatenate([[0], np.cumsum(per_row)])
    row = np.repeat(np.arange(len(count)), per_row)
    start = np.arange(bounds[-1]) - bounds[row] + rows[row]
    size = np.minimum(count[row], SHINGLE)
    out = np.zeros(len(start), np.uint64)
    for k in range(SHINGLE):
        there = size > k
        out[there] = mix(out[there] * _FACTOR + words[start[there] + k])
    return out, bounds


def distinct(shingles: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingles of each row."""
    return [np.unique(shingles[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
