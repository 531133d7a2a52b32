"""Byte-level BPE over overlapping chunks, and back.

Texts of up to CHUNK characters are encoded where they are. Longer ones are cut into chunks that run on
OVERLAP characters into the next; chunks are dealt out and pre-tokenised in parallel. The pre-tokeniser
has no memory beyond where a match begins: once two neighbours have a pre-token border in common they
agree on all later ones. The first common border in their overlap is the seam; the pieces between seams
are encoded one by one. Where an overlap has no common border the two chunks are one piece, whatever its
length, so that the ids are those of the whole text in every case.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import rank_encoding
from .common import id_text, tidy

CHUNK = 1 << 15
OVERLAP = 256
OUT = "doc_id long, n_tokens long, ids array<int>, decoded binary"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])
#: Rows leave a task in batches of about so many ids.
BATCH_IDS = 1 << 18


@lru_cache(maxsize=2)
def _patterns(pattern: str):
    import regex

    return regex.compile(pattern), regex.compile(r"\p{Cn}")


def borders(text: str, pattern: str, first: int, last: int) -> tuple[list[int], list[int]]:
    """Pre-token starts up to first, and from last on.

    None for a text with code points unassigned in this pattern engine's Unicode tables: the encoder's
    may be newer, and class such characters otherwise.
    """
    split, unassigned = _patterns(pattern)
    if not text.isascii() and unassigned.search(text):
        return [], []
    starts = [m.start() for m in split.finditer(text)]
    return [x for x in starts if x <= first], [x for x in starts if x >= last]


def _encode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = rank_encoding(path, pattern)
        for batch in batches:
            docs, ids, decoded, held = [], [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = codec.encode_ordinary(text.as_py())
                docs.append(doc)
                ids.append(np.array(x, np.int32))
                decoded.append(codec.decode_bytes(x))
                held += len(x)
                if held >= BATCH_IDS:
                    yield _rows(docs, ids, decoded)
                    docs, ids, decoded, held = [], [], [], 0
            if docs:
                yield _rows(docs, ids, decoded)

    return run


def _rows(docs: list, ids: list[np.ndarray], decoded: list[bytes]) -> pa.RecordBatch:
    n = np.array([len(x) for x in ids], np.int64)
    offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(n), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids))), pa.array(decoded, pa.binary())], schema=_OUT)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """copy tells equal rows apart: their number within the task, so that it is the same in whatever order a task reads."""
    task = TaskContext.get().partitionId() << 32
    met: dict[tuple[int | None, str], int] = {}
    for batch in batches:
        for doc, key, text in zip(batch.column(0), batch.column(1), batch.column(2)):
            text = text.as_py()
            n = -(-len(text) // CHUNK)
            row = doc.as_py(), key.as_py()
            met[row] = met.get(row, -1) + 1
            yield pa.record_batch(
                {
                    "doc_id": pa.array([doc.as_py()] * n, pa.int64()),
                    "key": pa.array([key.as_py()] * n, pa.string()),
                    "copy": pa.array([task + met[row]] * n, pa.int64()),
                    "k": pa.array(range(n), pa.int64()),
                    "chunk": pa.array([text[i * CHUNK : (i + 1) * CHUNK + OVERLAP] for i in range(n)], pa.string()),
                }
            )


def _pretokenised(pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [borders(x.as_py(), pattern, OVERLAP, CHUNK) for x in batch.column("chunk")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x[0] for x in both], pa.list_(pa.int64())), pa.array([x[1] for x in both], pa.list_(pa.int64()))], [*batch.schema.names, "head", "tail"]
            )

    return run


def stitch(chunks: list[str], heads: list[list[int]], tails: list[list[int]]) -> Iterator[str]:
    """The pieces between seams; together they are the text."""
    held: list[str] = []
    begin = 0
    for k, chunk in enumerate(chunks):
        seam = None
        if k + 1 < len(chunks):
            right = set(heads[k + 1])
            # a seam must not lie before where this chunk itself starts to count
            seam = next((x for x in tails[k] if x - CHUNK in right and x >= begin), None)
        if seam is not None:
            yield "".join([*held, chunk[begin:seam]])
            held, begin = [], seam - CHUNK
        else:
            held.append(chunk[begin:CHUNK])
            begin = 0
    yield "".join(held)


def _stitched(path: str, pattern: str):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        codec = rank_encoding(path, pattern)
        k = t.column("k").to_numpy()
        order = np.argsort(k)
        take = lambda c: [t.column(c)[int(i)].as_py() for i in order]
        ids, decoded = [], []
        for piece in stitch(take("chunk"), take("head"), take("tail")):
            x = codec.encode_ordinary(piece)
            ids.append(np.array(x, np.int32))
            decoded.append(codec.decode_bytes(x))
        row = _rows([key[0].as_py()], [np.concatenate(ids)], [b"".join(decoded)])
        return pa.Table.from_batches([row])

    return run


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every whole text encoded by a rank file and a split pattern, without special tokens, and decoded.

    Returns one row per input row: doc_id, n_tokens, ids, decoded (the bytes of the ids' tokens in order).
    Null and empty texts have no ids and no bytes. Repeated rows come repeated, rows with a null doc_id
    with a null one. Extra columns are left out; an empty table gives no rows. Only texts longer than
    CHUNK characters are shuffled; their chunks are the unit of pre-tokenising, the text that of encoding: no
    task group holds more than one row, however often it is repeated.
    """
    d = id_text(docs, id_col, text_col)
    short = d.where(F.length("text") <= CHUNK).mapInArrow(tidy(_encode(ranks_path, pattern)), OUT)
    long = d.where(F.length("text") > CHUNK).select("doc_id", F.sha2("text", 256).alias("key"), "text")
    chunks = long.mapInArrow(tidy(_chunks), "doc_id long, key string, copy long, k long, chunk string").repartition("key", "copy", "k")
    cut = chunks.mapInArrow(tidy(_pretokenised(pattern)), "doc_id long, key string, copy long, k long, chunk string, head array<long>, tail array<long>")
    return short.union(cut.groupBy("doc_id", "key", "copy").applyInArrow(_stitched(ranks_path, pattern), OUT))
