"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its distinct words and word beginnings, folded and hashed into BUCKETS. Buckets that
tell the labels apart in the training rows become the machine's inputs; each has a weight and a vector,
and the score adds the vectors' inner products over all pairs of terms present to the weights, so that
two terms together count for more or less than each alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, tidy
from .textkernel import LOWER, Run, U, mix, runs

BUCKETS = 1 << 18
#: Bytes of a word that make its beginning, a term of its own.
STEM = 5
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True
#: ASCII punctuation parts words as white space does: texts are folded so before they are cut.
_FOLD = LOWER.copy()
_FOLD[_PUNCTUATION] = 32


def terms(run: Run) -> tuple[np.ndarray, np.ndarray]:
    """(text index within the run, bucket) of all words and beginnings, repeats included."""
    folded = Run(run.first, _FOLD[run.raw], run.borders)
    n = len(folded.starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = folded.hashes()
    text = np.repeat(np.arange(len(run.borders) - 1), np.diff(folded.word_at))
    long = folded.ends - folded.starts > STEM
    if long.any():
        full = folded.ends
        folded.ends = np.minimum(full, folded.starts + STEM)
        begin = mix(folded.hashes()[long] + U(1))
        folded.ends = full
        whole, text = np.concatenate([whole, begin]), np.concatenate([text, text[long]])
    return text, (whole & U(BUCKETS - 1)).astype(np.int64)


@dataclass
class Machine:
    input_of: np.ndarray  # bucket -> input, -1 for none
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def logits(self, text: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        """For n texts with these terms."""
        at = self.input_of[bucket]
        text, at = text[at >= 0], at[at >= 0]
        key = np.unique(text * len(self.weights) + at) if len(at) else np.zeros(0, np.int64)
        return self.of_inputs(*np.divmod(key, max(1, len(self.weights))), n)

    def of_inputs(self, text: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        out = np.full(n, self.bias)
        out += np.bincount(text, self.weights[at], n)[:n] if len(at) else 0
        for f in range(self.vectors.shape[1]):
            v = self.vectors[at, f]
            if len(v):
                s, q = np.bincount(text, v, n), np.bincount(text, v * v, n)
                out += 0.5 * (s * s - q)
        return out


def train(rows: list[np.ndarray], label: np.ndarray, inputs: int = 4096, factors: int = 4, epochs: int = 30, rate: float = 0.1, decay: float = 3e-4, seed: int = 3) -> Machine:
    """rows: distinct buckets of each training text. AdaGrad on the log loss, both labels weighing alike."""
    n = len(rows)
    sizes = np.array([len(x) for x in rows], np.int64)
    text, bucket = np.repeat(np.arange(n), sizes), np.concatenate(rows) if n else np.zeros(0, np.int64)
    positive, total = label.sum(), n
    has = np.bincount(bucket, minlength=BUCKETS)
    with_label = np.bincount(bucket, label[text].astype(float), BUCKETS)
    expected = has * positive / max(1, total)
    chi = np.where(has >= 5, (with_label - expected) ** 2 / np.maximum(expected * (1 - positive / max(1, total)), 1e-9), 0)
    chosen = np.sort(np.argsort(-chi, kind="stable")[:inputs])
    chosen = chosen[chi[chosen] > 10.83]
    input_of = np.full(BUCKETS, -1, np.int64)
    input_of[chosen] = np.arange(len(chosen))
    r = np.random.default_rng(seed)
    m = Machine(input_of, float(np.log((positive + 1) / (total - positive + 1))), np.zeros(len(chosen)), r.normal(0, 0.02, (len(chosen), factors)))
    if not len(chosen):
        return m
    at = input_of[bucket]
    text, at = text[at >= 0], at[at >= 0]
    starts = np.searchsorted(text, np.arange(n + 1))
    weight = np.where(label, 0.5 * total / max(1, positive), 0.5 * total / max(1, total - positive))
    g_bias, g_w, g_v = 1e-6, np.full(len(chosen), 1e-6), np.full(m.vectors.shape, 1e-6)
    for _ in range(epochs):
        order = r.permutation(n)
        for lo in range(0, n, 256):
            batch = order[lo : lo + 256]
            length = starts[batch + 1] - starts[batch]
            row = np.repeat(np.arange(len(batch)), length)
            x = at[np.repeat(starts[batch] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())]
            z = m.of_inputs(row, x, len(batch))
            error = weight[batch] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[batch]) / len(batch)
            d = error.sum()
            g_bias += d * d
            m.bias -= rate * d / np.sqrt(g_bias)
            grad = np.bincount(x, error[row], len(chosen)) + decay * m.weights / 10
            g_w += grad * grad
            m.weights -= rate * grad / np.sqrt(g_w)
            for f in range(m.vectors.shape[1]):
                v = m.vectors[x, f]
                s = np.bincount(row, v, len(batch))
                grad = np.bincount(x, error[row] * (s[row] - v), len(chosen)) + decay * m.vectors[:, f]
                g_v[:, f] += grad * grad
                m.vectors[:, f] -= rate * grad / np.sqrt(g_v[:, f])
    return m


def _training_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in runs(batch.column(0)):
            text, bucket = terms(r)
            n = len(r.borders) - 1
            key = np.unique(text * BUCKETS + bucket)
            cut = np.searchsorted(key, np.arange(n + 1) * BUCKETS)
            yield pa.record_batch({"terms": pa.array([(key[a:b] % BUCKETS).astype("<u4").tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()), "toxic": batch.column(1).slice(r.first, n)})


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 16_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """A machine from at most most_rows labelled rows: those with the least hash of their id.

    most_rows bounds what is collected: the distinct hashed terms of these rows. Equal texts train once.
    Null labels say nothing; without labels of both kinds the machine knows the base rate alone.
    """
    chosen = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").orderBy(F.xxhash64("doc_id"), "toxic").limit(most_rows)
    some = id_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    got = some.mapInArrow(tidy(_training_terms), "terms binary, toxic int").toPandas().drop_duplicates().sort_values(["terms", "toxic"])
    return train([np.frombuffer(x, "<u4").astype(np.int64) for x in got["terms"]], got["toxic"].to_numpy() == 1)


def _scored(m: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in runs(batch.column(1)):
                n = len(r.borders) - 1
                z = m.logits(*terms(r), n)
                yield pa.record_batch({"doc_id": batch.column(0).slice(r.first, n), "score": pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))})

    return run


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: toxic likelier) of every row, from its whole text alone.

    Null and empty texts score by the machine's bias. Repeated rows score alike; null doc_ids stay null;
    extra columns are left out; an empty table gives no rows. The machine has a fixed size (2 MB).
    """
    return id_text(docs, id_col, text_col).mapInArrow(tidy(_scored(machine)), "doc_id long, score double")


def _kept(m: Machine, at: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = [m.logits(*terms(r), len(r.borders) - 1) for r in runs(batch.column(at))]
            if z:
                p = 1 / (1 + np.exp(-np.clip(np.concatenate(z), -30, 30)))
                yield batch.filter(pa.array(p < threshold))

    return run


def drop_toxic(docs: DataFrame, machine: Machine, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs without the rows that score at least threshold; all columns, nulls and repeats of the others stay."""
    d = docs.withColumn(text_col, F.col(text_col).cast("string"))
    return d.mapInArrow(tidy(_kept(machine, d.columns.index(text_col), threshold)), d.schema)


def held_out(id_col: str = "doc_id"):
    """Rows that are never learnt from: crc32 of the id as text, modulo 5, is 0; and those without id, which labels cannot name."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))
