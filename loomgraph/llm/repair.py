"""Token ids in binary files compressed by Re-Pair grammars, one grammar a shard.

Within a shard the most frequent pairs of adjacent ids are replaced by new symbols (nonterminals), again
and again, until no pair is worth its rule or the numbers of the file's width run out. Each round ranks all pairs that occur often enough and replaces every occurrence whose rank
beats those it overlaps with, so a round stands for many single Re-Pair steps. A shard's row holds its
rules, the number of ids each nonterminal expands to, and what is left of the sequence; with these any
id range is decoded without touching the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import segment_ids, slices
from .common import BROADCAST_ROWS, id_text, shared_dir, tidy

#: A shard closes with the first document that brings it to so many ids.
SHARD_IDS = 1 << 19
#: A pair becomes a rule if it occurs so often in the shard: a rule takes 6 or 8 bytes and saves 2 an occurrence.
MIN_COUNT = 6
#: Rounds go on while one leaves less than this share of the sequence; a rule refers to rules of earlier rounds only.
GAIN = 0.998

FILE_SCHEMA = "part int, seq int, doc_ids array<long>, n_tokens array<long>, n_ids long, base int, width int, rules binary, lengths binary, symbols binary, offsets binary"
#: The files keep where every so manyth symbol of a shard begins.
EVERY = 1 << 10


def compress(ids: np.ndarray, base: int, max_rules: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules as pairs, expansion lengths); nonterminal k is written base + k."""
    word, half = (np.uint32, np.uint32(16)) if base + max_rules <= 1 << 16 else (np.uint64, np.uint64(32))
    seq = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    lengths = np.zeros(0, np.int64)
    n_rules = 0
    while True:
        room = max_rules - n_rules
        if room <= 0 or len(seq) < 2 * MIN_COUNT:
            break
        key = (seq[:-1].astype(word) << half) | seq[1:]
        # counted by a sort of bare numbers, and only those that occur often are looked up
        held = np.sort(key)
        heads = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
        counts = np.diff(heads, append=len(held))
        order = np.flatnonzero(counts >= MIN_COUNT)
        pairs, counts = held[heads[order]], counts[order]
        pairs = pairs[np.lexsort((pairs, -counts))][:room]
        none = len(pairs)
        if not none:
            break
        rank = np.full(len(key) + 2, none, np.int32)  # shifted by one, so that every place has neighbours
        rank[1:-1] = pc.index_in(pa.array(key), value_set=pa.array(pairs)).fill_null(none).to_numpy()
        mine = rank[1:-1]
        best = (mine < rank[:-2]) & (mine <= rank[2:])
        # of a run of equal ranks (equal ids) every second place, from its second on if a better pair stands before it
        again = np.flatnonzero((mine == rank[:-2]) & (mine < none))
        if len(again):
            heads = np.flatnonzero(np.diff(again, prepend=-2) > 1)
            first = np.repeat(again[heads] - 1, np.diff(heads, append=len(again)))
            later = again - first - (rank[first] < mine[again])
            best[again] = (later % 2 == 0) & (mine[again] <= rank[again + 2])
        chosen = np.flatnonzero(best)
        if not len(chosen):
            break
        is_used = np.zeros(none, bool)
        is_used[mine[chosen]] = True
        used, symbol = np.flatnonzero(is_used), (np.cumsum(is_used) - 1)[mine[chosen]]
        pair = pairs[used]
        left, right = (pair >> half).astype(np.uint32), (pair & ((word(1) << half) - word(1))).astype(np.uint32)

        def length(s: np.ndarray, known: np.ndarray = lengths) -> np.ndarray:
            return np.where(s < base, 1, known[np.maximum(s.astype(np.int64) - base, 0)] if len(known) else 1)

        lengths = np.concatenate([lengths, length(left) + length(right)])
        rules.append(np.stack([left, right], 1))
        seq[chosen] = (base + n_rules + symbol).astype(np.uint32)
        keep = np.ones(len(seq), bool)
        keep[chosen + 1] = False
        n_before = len(seq)
        seq = seq[keep]
        n_rules += len(used)
        if len(seq) > GAIN * n_before:
            break
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), lengths


class Grammar:
    """A shard's sequence, decoded whole or by range."""

    def __init__(self, base: int, width: int, rules: bytes, lengths: bytes, symbols: bytes, offsets: bytes):
        self.base = base
        self.rules = np.frombuffer(rules, f"<u{width}").reshape(-1, 2)
        self.lengths = np.frombuffer(lengths, f"<u{len(lengths) // max(1, len(self.rules))}" if lengths else "<u4")
        self.symbols = np.frombuffer(symbols, f"<u{width}")
        #: where every EVERYth symbol begins, and the shard ends
        self.offsets = np.frombuffer(offsets, "<i8")

    def _length(self, s: np.ndarray) -> np.ndarray:
        out = np.ones(len(s), np.int64)
        deep = s >= self.base
        out[deep] = self.lengths[s[deep].astype(np.int64) - self.base]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        symbols = symbols.astype(np.int64)
        while len(deep := np.flatnonzero(symbols >= self.base)):
            size = np.ones(len(symbols), np.int64)
            size[deep] = 2
            out = np.repeat(symbols, size)
            at = np.cumsum(size)[deep] - 1
            pair = self.rules[symbols[deep] - self.base]
            out[at - 1], out[at] = pair[:, 0], pair[:, 1]
            symbols = out
        return symbols.astype(np.uint32)

    def all_ids(self) -> np.ndarray:
        """The whole shard: every rule is expanded once, and what the symbols stand for is gathered from there."""
        n = len(self.rules)
        table = np.concatenate([np.arange(self.base, dtype=np.uint32), self.expand(np.arange(self.base, self.base + n))])
        ends = np.cumsum(self.lengths, dtype=np.int64)
        starts = np.concatenate([np.arange(self.base), self.base + ends - self.lengths])
        size = self._length(self.symbols)
        at = np.repeat(starts[self.symbols] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return table[at]

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """ids start .. stop of the shard; of a range only the symbols that reach into it are expanded, and at most EVERY beside them are measured."""
        total = int(self.offsets[-1])
        stop = total if stop is None else min(stop, total)
        if start >= stop:
            return np.zeros(0, np.uint32)
        if start <= 0 and stop == total:
            return self.all_ids()
        block = int(np.searchsorted(self.offsets, start, "right")) - 1
        last_block = int(np.searchsorted(self.offsets, stop, "left"))
        near = self.symbols[block * EVERY : last_block * EVERY]
        ends = int(self.offsets[block]) + np.cumsum(self._length(near))
        first, last = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left"))
        begin = int(ends[first - 1]) if first else int(self.offsets[block])
        return self.expand(near[first : last + 1])[start - begin : stop - begin]


def sampled_offsets(symbols: np.ndarray, base: int, lengths: np.ndarray) -> np.ndarray:
    """Where symbols 0, EVERY, 2 * EVERY, ... begin, and where the last one ends."""
    size = np.ones(len(symbols), np.int64)
    deep = symbols >= base
    size[deep] = lengths[symbols[deep].astype(np.int64) - base]
    ends = np.concatenate([[0], np.cumsum(size)])
    return np.concatenate([ends[:-1][::EVERY], ends[-1:]])


def _shards(path: str, end_id: int, base: int):
    width = 2 if base < 1 << 16 else 4
    max_rules = ((1 << 16) if width == 2 else (1 << 31)) - base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        encode = segment_ids(path)
        docs: list[int | None] = []
        counts: list[int] = []
        blobs: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            symbols, rules, lengths = compress(np.concatenate(blobs), base, max_rules)
            return pa.record_batch(
                {
                    "part": pa.array([part], pa.int32()),
                    "seq": pa.array([seq], pa.int32()),
                    "doc_ids": pa.array([docs], pa.list_(pa.int64())),
                    "n_tokens": pa.array([counts], pa.list_(pa.int64())),
                    "n_ids": pa.array([held], pa.int64()),
                    "base": pa.array([base], pa.int32()),
                    "width": pa.array([width], pa.int32()),
                    "rules": pa.array([rules.astype(f"<u{width}").tobytes()], pa.binary()),
                    "lengths": pa.array([lengths.astype("<u2" if not len(lengths) or lengths.max() < 1 << 16 else "<u4").tobytes()], pa.binary()),
                    "symbols": pa.array([symbols.astype(f"<u{width}").tobytes()], pa.binary()),
                    "offsets": pa.array([sampled_offsets(symbols, base, lengths).astype("<i8").tobytes()], pa.binary()),
                }
            )

        for batch in batches:
            names, at = batch.column(0).to_pylist(), 0
            for texts in slices(batch.column(1)):
                ids, n_tokens = encode.per_column(texts, end_id)
                stops = np.cumsum(n_tokens)
                done = 0
                while done < len(texts):
                    # the document that brings the shard to SHARD_IDS closes it
                    before = int(stops[done - 1]) if done else 0
                    upto = min(len(texts), int(np.searchsorted(stops, before + SHARD_IDS - held)) + 1)
                    docs += names[at + done : at + upto]
                    counts += n_tokens[done:upto].tolist()
                    blobs.append(ids[before : int(stops[upto - 1])])
                    held += len(blobs[-1])
                    done = upto
                    if held >= SHARD_IDS:
                        yield close()
                        docs, counts, blobs, held, seq = [], [], [], 0, seq + 1
                at += len(texts)
        if docs:
            yield close()

    return run


def write_token_files(docs: DataFrame, out: str, tokenizer_path: str, end_id: int, base: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append end_id, and write the grammar files to out in ascending doc_id order.

    base: the first number that is no token id (the vocabulary's size, or more). Rows come in order of
    (doc_id, text), null doc_ids first; null texts are empty and hold end_id alone; equal rows are all
    written; an empty table makes files without rows. Extra columns are left out. Documents are dealt by
    doc_id range, so a task has a bounded share however long single texts are; a text is never cut.
    """
    d = id_text(docs, id_col, text_col)
    # within an id, as of rows without one there may be very many, by how the text begins, which is in the order of the texts
    ranged = d.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 32))
    ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(tidy(_shards(tokenizer_path, end_id, base)), FILE_SCHEMA).write.parquet(out)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = Grammar(row["base"], row["width"], row["rules"], row["lengths"], row["symbols"], row["offsets"]).ids().astype("<u4")
            ends = np.cumsum(np.array(row["n_tokens"], np.int64))
            starts = ends - np.array(row["n_tokens"], np.int64)
            n = len(ends)
            yield pa.record_batch(
                {
                    "part": pa.array(np.full(n, row["part"], np.int32)),
                    "seq": pa.array(np.full(n, row["seq"], np.int32)),
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "at": pa.array(starts),
                    "n_tokens": pa.array(row["n_tokens"], pa.int64()),
                    "ids": pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                }
            )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document decoded; ids are little-endian unsigned 32-bit integers,
    start is the number of ids of all documents before it. Offsets need the shards' sizes alone, which are
    summed per part first, so that one task sees one row a part."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    sizes = files.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    inside = sizes.withColumn("inside", F.sum("n_ids").over(W.partitionBy("part").orderBy("seq")) - F.col("n_ids"))
    starts = inside.join(parts, "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("first"))
    # a row a shard: to every task while there are few
    if starts.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    docs = files.mapInArrow(tidy(_documents), "part int, seq int, doc_id long, at long, n_tokens long, ids binary")
    return docs.join(starts, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids")


def read_id_range(spark: SparkSession, path: str, part: int, seq: int, start: int, stop: int) -> np.ndarray:
    """ids start .. stop of one shard, by its expansion lengths."""
    row = spark.read.schema(FILE_SCHEMA).parquet(path).where((F.col("part") == part) & (F.col("seq") == seq)).select("base", "width", "rules", "lengths", "symbols", "offsets").first()
    return np.zeros(0, np.uint32) if row is None else Grammar(*row).ids(start, stop)


def repair_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, base: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files to the shared folder and return what they hold: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    out = shared_dir(spark, "token-files")
    write_token_files(docs, out, tokenizer_path, end_id, base, id_col, text_col)
    return read_token_files(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
