"""Vectorised words and word-window hashes over the byte buffer of an Arrow string column.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. They are hashed by a polynomial over
random byte values modulo 2**64, taken from prefix sums, so that one numpy pass hashes a whole batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_STEP = int(_rng.integers(1, 2**61)) * 8 + 3
_BACK = pow(_STEP, -1, 2**64)
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
IS_WORD = np.ones(256, bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)
#: A batch is cut into runs of whole texts of about this many bytes.
RUN_BYTES = 1 << 20


@lru_cache(maxsize=2)
def _powers_of(size: int) -> tuple[np.ndarray, np.ndarray]:
    def powers(base: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return powers(_STEP), powers(_BACK)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers_of(max(RUN_BYTES * 2, 1 << max(1, n).bit_length()))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


class Run:
    """Some whole texts: raw bytes, text borders, and where words start and end."""

    def __init__(self, first: int, raw: np.ndarray, borders: np.ndarray):
        self.first, self.raw, self.borders = first, raw, borders  # borders: n + 1 offsets into raw
        in_word = np.zeros(len(raw) + 2, bool)
        in_word[1:-1] = IS_WORD[raw]
        at = in_word[1:-1]
        begins, ends = at & ~in_word[:-2], at & ~in_word[2:]
        inner = borders[(borders > 0) & (borders < len(raw))]
        begins[inner] = at[inner]
        ends[inner - 1] = at[inner - 1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(ends) + 1
        #: word_at[i] .. word_at[i + 1] are the words of text i
        self.word_at = np.searchsorted(self.starts, borders)

    def hashes(self, fold: np.ndarray = LOWER) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        up, down = _powers(len(self.raw) + 1)
        sums = np.zeros(len(self.raw) + 1, np.uint64)
        np.cumsum(_BYTE[fold[self.raw]] * up[: len(self.raw)], out=sums[1:])
        length = (self.ends - self.starts).astype(np.uint64)
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + length * U(0x9E3779B97F4A7C15))


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width word hashes; the caller masks runs that cross a text border."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n] * _PLACE[0]
    for k in range(1, width):
        out += words[k : k + n] * _PLACE[k]
    return mix(out + U(width))


def shingle_sets(run: Run, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(index of the text, sorted distinct shingle hashes); fewer words than width make one shingle."""
    words = run.hashes()
    all_windows = windows(words, width)
    at = run.word_at
    for i in range(len(at) - 1):
        lo, hi = at[i], at[i + 1]
        n = hi - lo
        if n >= width:
            yield run.first + i, np.unique(all_windows[lo : hi - width + 1])
        elif n:
            yield run.first + i, windows(words[lo:hi], int(n))
        else:
            yield run.first + i, np.zeros(0, np.uint64)


def runs(column: pa.Array, limit: int = RUN_BYTES) -> Iterator[Run]:
    """The texts of a string column (null: empty) as runs of about limit bytes; a longer text is a run alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(i + 1, j))
        yield Run(i, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j
