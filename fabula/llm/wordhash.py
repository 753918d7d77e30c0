"""Word and line hashing over Arrow string columns, vectorised in numpy.

Works on the UTF-8 bytes of a whole batch at once.  A word is a maximal run of bytes other than
space and 0x09-0x0D, which are ASCII, so byte-level splitting equals code-point splitting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: dict[str, np.ndarray] = {}

#: Bytes of text hashed at once; longer single texts are hashed alone.
SLICE_BYTES = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        full = np.full(max(n, SLICE_BYTES + 2), base, dtype=np.uint64)
        full[0] = 1
        have = np.cumprod(full, dtype=np.uint64)
        if len(have) <= 4 * SLICE_BYTES:
            _powers[kind] = have
    return have[:n]


def slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets into them) of runs of rows; a null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """Words of a slice: ``start``/``end`` byte positions, ``row``, 64-bit ``hash``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        if lower:
            data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
        self.data, self.offsets, n = data, offsets, len(data)
        self.space = (data == 32) | ((data >= 9) & (data <= 13))
        solid = ~self.space
        cut = np.zeros(n + 1, dtype=bool)
        cut[offsets] = True
        begins = solid & cut[:n]
        begins[1:] |= solid[1:] & self.space[:-1]
        ends = solid & cut[1:]
        ends[:-1] |= solid[:-1] & self.space[1:]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_TABLE[data] * _power("base", _BASE, n), out=self.prefix[1:])
        self.hash = self.span_hash(self.start, self.end)
        self.row_start = np.searchsorted(self.row, np.arange(len(offsets)), side="left")

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of any byte spans; equal bytes hash alike wherever they stand."""
        back = _power("inverse", _INVERSE, len(self.data) + 1)
        return mix((self.prefix[end] - self.prefix[start]) * back[start] + (end - start).astype(np.uint64) * _STEP)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each run of ``size`` words within a row."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            total = total * _STEP + self.hash[k : k + n]
        first = np.flatnonzero(self.row[:n] == self.row[size - 1 :])
        return first, mix(total[first])

    def whole(self, row: int) -> np.uint64:
        """Hash of all words of a row as one sequence."""
        total = int(_BASE)
        for h in self.hash[self.row_start[row] : self.row_start[row + 1]].tolist():
            total = (total * int(_STEP) + h) & (2**64 - 1)
        return mix(np.array([total], dtype=np.uint64))[0]


def shingle_sets(words: Words, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes); rows of fewer words have their whole sequence, rows of none nothing."""
    first, hashes = words.windows(size)
    at = np.searchsorted(words.row[first], np.arange(len(words.offsets)), side="left")
    for row in range(len(words.offsets) - 1):
        own = hashes[at[row] : at[row + 1]]
        if len(own):
            yield row, np.unique(own)
        elif words.row_start[row + 1] > words.row_start[row]:
            yield row, np.array([words.whole(row)], dtype=np.uint64)
        else:
            yield row, own
