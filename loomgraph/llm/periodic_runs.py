"""Periodic runs of words by bit-parallel lags.

The words of a text are numbered; bit i of the plane for binary digit b is that digit of word i's number, so a
text of n words is some log2(n) big integers of n bits. A plane shifted by a lag and XORed with itself has a 1
wherever words that far apart differ in that digit; the OR over all planes marks every mismatch. A run of that
period is a stretch of zeros: ANDing the matches with themselves, shifted by ever doubled distances, leaves
exactly the places where a stretch of the wanted length begins.

Every lag from 1 to a quarter of the text is tried. In texts of over SIEVE words most lags above NEAR are ruled
out beforehand by an exact test (see `_possible_lags`), which leaves out none that has a run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, tidy

#: A run has at least so many words, and so many times its period.
LEAST, TIMES = 6, 4
#: Words are runs of characters other than these.
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Texts of over SIEVE words try only possible lags above NEAR.
SIEVE, NEAR = 1 << 14, 64
#: Planes that are compared before the first look whether a stretch can be left.
FIRST_PLANES = 2
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])
#: Rows leave a task in batches of about so many characters.
OUT_CHARS = 1 << 22


def planes(numbers: np.ndarray) -> list[int]:
    """One big integer for each binary digit that the numbers need; the lowest digit first."""
    top = int(numbers.max()).bit_length() if len(numbers) else 0
    return [int.from_bytes(np.packbits((numbers >> b) & 1, bitorder="little").tobytes(), "little") for b in range(top)]


def _places(bits: int, n: int) -> np.ndarray:
    """The bits that are set, ascending."""
    if bits.bit_count() <= 64:
        out = []
        while bits:
            low = bits & -bits
            out.append(low.bit_length() - 1)
            bits ^= low
        return np.array(out, np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little"))


def _stretches(matches: int, k: int) -> int:
    """Where k ones in a row begin: each step doubles the length that is known to hold."""
    have = 1
    while have < k and matches:
        by = min(have, k - have)
        matches &= matches >> by
        have += by
    return matches


def _possible_lags(numbers: np.ndarray) -> Iterator[int]:
    """All lags above NEAR that can have a run, ascending.

    In a run of smallest period p, a window of k words, p <= k < 2p, comes again next after exactly p words: an
    earlier return would be a period of the run, too. A run of 4p words has over p such windows in a row. Windows of
    doubled widths are numbered by their two halves; the distances to their next equal ones are counted.
    """
    ranks, width = numbers.astype(np.int64), 1
    n = len(ranks)
    while width <= n // 2:
        pairs = ranks[: n - 2 * width + 1] * (int(ranks.max()) + 1) + ranks[width : n - width + 1]
        ranks = np.unique(pairs, return_inverse=True)[1]
        width *= 2
        if width <= NEAR:
            continue
        order = np.argsort(ranks, kind="stable")
        again = ranks[order[1:]] == ranks[order[:-1]]
        far = np.zeros(len(ranks), np.int64)
        far[order[:-1][again]] = (order[1:] - order[:-1])[again]
        lags, counts = np.unique(far[(far > max(NEAR, width // 2)) & (far <= width)], return_counts=True)
        yield from lags[counts > lags].tolist()


def find_runs(numbers: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every maximal run of max(LEAST, TIMES * period) words at least, by start, then period."""
    n = len(numbers)
    if n < LEAST:
        return []
    digits = planes(numbers)
    most = n // TIMES
    lags = range(1, most + 1) if n <= SIEVE else [*range(1, NEAR + 1), *(p for p in _possible_lags(numbers) if p <= most)]
    found: dict[tuple[int, int], int] = {}
    for p in lags:
        k = max(LEAST, TIMES * p) - p  # matches in a row that make a run
        inside = (1 << (n - p)) - 1
        differ, begins = 0, 1
        for b in range(0, max(1, len(digits)), FIRST_PLANES):
            for plane in digits[b : b + FIRST_PLANES]:
                differ |= plane ^ (plane >> p)
            if b == 0 or b + FIRST_PLANES >= len(digits):
                begins = _stretches(~differ & inside, k)
                if not begins:
                    break
        if begins:
            firsts, lasts = _places(begins & ~(begins << 1), n), _places(begins & ~(begins >> 1), n)
            for start, last in zip(firsts.tolist(), lasts.tolist()):
                # a multiple of a run's smallest period gives the same stretch again
                found.setdefault((start, last + k + p), p)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The text without what any run repeats: of each run its first period is left."""
    if not runs:
        return " ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return " ".join(w for w, held in zip(words, np.cumsum(edge[:-1]).tolist()) if not held)


def _number(words: list[str]) -> np.ndarray:
    seen: dict[str, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rows, held = [], [], 0

        def table() -> pa.RecordBatch:
            columns = [pa.array(ids, pa.int64()), pa.array([r[0] for r in rows], pa.int64())]
            columns.append(pa.array([[{"start": s, "length": x, "period": p} for s, x, p in r[1]] for r in rows], pa.list_(_RUN)))
            return pa.RecordBatch.from_arrays([*columns, pa.array([r[2] for r in rows], pa.string())], schema=_SCHEMA)

        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = _WORD.findall(text.as_py())
            runs = find_runs(_number(words))
            ids.append(doc)
            rows.append((len(words), runs, collapse(words, runs)))
            held += len(rows[-1][2]) + 24 * len(runs)
            if held > OUT_CHARS:
                yield table()
                ids, rows, held = [], [], 0
        if ids:
            yield table()


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words, by start, then period) and collapsed (the text without repetitions) of each row.

    A run is a maximal stretch of words with smallest period q that has max(LEAST, TIMES * q) words or more; words are
    runs of characters other than 0x20, 0x09-0x0D, compared exactly. Null and empty texts have no words, no runs and collapse
    to ''. Repeated rows come repeated; null ids stay null; extra columns are left out; an empty table gives no rows.
    A text is one task's work, whatever its length: n words take n / 8 bytes a digit.
    """
    return id_text(docs, id_col, text_col).mapInArrow(tidy(_scan), SCHEMA)
