"""Quality of texts by how well they compress with dictionaries of good and of bad text.

Labelled texts are cut into pieces; those of a class, a sample of bounded size, train a zstandard dictionary. A text
is compressed piece by piece with the dictionary of either class: the difference of the two sizes by the larger one
says which class it resembles. That is done twice, on the bytes as they are and on their outline, which keeps the
kinds of characters and where a word comes twice in a row. There are FOLDS pairs of dictionaries for each, of which
each has not seen one fold of the labelled texts: on that fold its differences are as on new text, and a logistic
curve through them makes a score of the mean differences of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, tidy, written
from .textkernel import SAME, Run, runs

#: Bytes of a piece of a text and of its outline, and of a dictionary of either.
PIECES, DICTIONARIES = (1 << 10, 1 << 9), (1 << 15, 1 << 14)
LEVEL = 3
FOLDS = 3
#: A class with fewer pieces to learn from has them as its dictionary as they are.
LEAST_PIECES = 64
#: In outlines: a word that repeats the one before it.
AGAIN = 1
_KIND = np.arange(256, dtype=np.uint8)
_KIND[97:123] = ord("a")
_KIND[65:91] = ord("A")
_KIND[128:] = ord("a")


def outlines(run: Run) -> list[bytes]:
    """Of each text of the run: letters by their case, bytes beyond ASCII as lower case, other characters as they are, repeated words as AGAIN."""
    words = run.hashes(SAME)
    again = np.flatnonzero(words[1:] == words[:-1]) + 1
    firsts = np.zeros(len(words) + 1, bool)
    firsts[run.word_at] = True  # the first word of a text repeats none
    again = again[~firsts[again]]
    kinds = _KIND[run.raw]
    kinds[run.starts[again]] = AGAIN
    gone = np.zeros(len(kinds) + 1, np.int64)
    np.add.at(gone, run.starts[again] + 1, 1)
    np.add.at(gone, run.ends[again], -1)
    kept = np.cumsum(gone[:-1]) == 0
    at = np.concatenate([[0], np.cumsum(kept)])[run.borders]
    left = kinds[kept].tobytes()
    return [left[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def views(texts: pa.Array) -> Iterator[tuple[bytes, bytes]]:
    """Each text (null: empty) and its outline."""
    for r in runs(texts):
        raw = r.raw.tobytes()
        yield from zip((raw[a:b] for a, b in zip(r.borders[:-1].tolist(), r.borders[1:].tolist())), outlines(r))


def pieces(text: bytes, size: int) -> list[bytes]:
    return [text[i : i + size] for i in range(0, len(text), size)]


@dataclass
class Model:
    """For each view the pairs of dictionaries (bad, good), none where a class is unknown; the curve's offset and slopes."""

    pairs: list[list[tuple[bytes, bytes]]]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 + len(PIECES)))

    def score(self, differences: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + differences @ self.weights[1:], -30, 30)))


class Compressors:
    def __init__(self, model: Model):
        self.pairs = [[tuple(self._of(d) for d in pair) for pair in pairs] for pairs in model.pairs]

    @staticmethod
    def _of(dictionary: bytes) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(dictionary)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)

    def differences(self, text: tuple[bytes, bytes], fold: int | None = None) -> list[float]:
        """Of each view, by how much the bad dictionary leaves it larger than the good one does, as a share of the larger size: of all pairs
        the mean, or that of one; 0 of no text."""
        out = []
        for view, size, pairs in zip(text, PIECES, self.pairs):
            cut, total = pieces(view, size), 0.0
            chosen = pairs if fold is None else pairs[fold : fold + 1]
            for pair in chosen if cut else ():
                bad, good = (sum(len(c.compress(x)) for x in cut) for c in pair)
                total += (bad - good) / max(bad, good)
            out.append(total / max(1, len(chosen)))
        return out


def dictionary(samples: list[bytes], size: int) -> bytes:
    """Trained on the samples; where they are too few or too alike for that, the samples themselves."""
    if len(samples) >= LEAST_PIECES:
        try:
            return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            pass
    # plain content must not begin like a trained dictionary
    return (b" " * 8 + b"".join(samples))[:size]


def curve(differences: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Offset and slopes of the logistic curve of least log loss, with a slight pull of the slopes towards 0 (Newton's method)."""
    x = np.column_stack([np.ones(len(good)), differences])
    w = np.zeros(x.shape[1])
    w[0] = np.log((good.sum() + 1) / ((~good).sum() + 1))
    pull = np.full(len(w), 1e-3)
    pull[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (p - good) + pull * w)
        w = w - step * min(1.0, 20 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, good, fold in zip(views(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            for v, (view, size) in enumerate(zip(text, PIECES)):
                if cut := pieces(view, size):
                    yield pa.record_batch({"view": pa.array([v] * len(cut), pa.int32()), "piece": pa.array(cut, pa.binary()), "good": pa.array([good] * len(cut), pa.int32()), "fold": pa.array([fold] * len(cut), pa.int32())})


def _held_out(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Compressors(model)
        for batch in batches:
            x = [c.differences(t, f) for t, f in zip(views(batch.column(0)), batch.column(2).to_pylist())]
            yield pa.record_batch({"differences": pa.array(x, pa.list_(pa.float64())), "good": batch.column(1)})

    return run


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 16_000, most_pieces: int = 6_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model from at most most_rows labelled rows, and at most most_pieces pieces of each view and class of these: those of least hash.

    These pieces (of up to 1 KB) and two numbers a row are all that is collected. Equal texts, and equal pieces, train
    once; of texts that bear both labels both count. Null labels and null texts say nothing. Without rows of both
    labels nothing is compressed, and every text scores the share of good ones among the labels, 0.5 without any.
    """
    chosen = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("good")).where("doc_id is not null and good in (0, 1)").distinct()
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "good").limit(most_rows)
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null").join(F.broadcast(chosen), "doc_id")
    known = known.select("text", "good", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"))
    known = written(known.dropDuplicates(["text", "good"]), "labelled")
    counts = {r["good"]: r["count"] for r in known.groupBy("good").count().collect()}
    if len(counts) < 2:
        model = Model([])
        model.weights[0] = np.log((counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 0.5))
        return model
    cut = written(known.mapInArrow(tidy(_cut), "view int, piece binary, good int, fold int").dropDuplicates(["view", "piece", "good"]), "pieces")
    pairs: list[list[tuple[bytes, bytes]]] = []
    for v, size in enumerate(DICTIONARIES):
        samples = [list(cut.where((F.col("view") == v) & (F.col("good") == g)).orderBy(F.xxhash64("piece"), "piece").limit(most_pieces).toLocalIterator()) for g in (0, 1)]
        pairs.append([tuple(dictionary([bytes(r["piece"]) for r in rows if r["fold"] != k], size) for rows in samples) for k in range(FOLDS)])
    model = Model(pairs)
    got = known.mapInArrow(tidy(_held_out(model)), "differences array<double>, good int").toPandas()
    model.weights = curve(np.array(got["differences"].tolist()), got["good"].to_numpy() == 1)
    return model


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Compressors(model)
        for batch in batches:
            x = np.zeros((batch.num_rows, len(PIECES)))
            if model.pairs:
                x[:] = [c.differences(t) for t in views(batch.column(1))]
            yield pa.record_batch({"doc_id": batch.column(0), "differences": pa.array(x.tolist(), pa.list_(pa.float64())), "score": pa.array(model.score(x), pa.float64())})

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, differences (of text and outline) and score (0 to 1, higher: good likelier) of every row, from its whole text alone.

    Null and empty texts have differences of 0. Repeated rows score alike; null ids stay null; extra columns are left
    out; an empty table gives no rows. The model has a fixed size (FOLDS pairs of DICTIONARIES bytes).
    """
    return id_text(docs, id_col, text_col).mapInArrow(tidy(_scored(model)), "doc_id long, differences array<double>, score double")
