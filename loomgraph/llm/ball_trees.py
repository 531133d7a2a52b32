"""Centroid clustering over ball trees.

Vectors of whole numbers are packed, partition by partition, into blocks of up to BLOCK vectors, each a binary
metric tree: a ball knows its count, the exact sum of its vectors and a radius around their mean. The trees are
written once to the shared folder; every round reads them. A ball that by the triangle inequality lies nearer to
one centroid than to any other goes there whole, with its count and sum; a centroid that is too far from a ball to
be the nearest of any of its vectors is dropped for all below it; leaves compare exactly with what is left. All
that comes to the driver in a round are the sums of the K centroids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy, written

#: Vectors of a tree, and of a leaf.
BLOCK, LEAF = 1 << 12, 32
#: Components up to here have all products and sums of 64 of them exact in doubles; larger ones are compared in 64-bit integers.
EXACT = 1 << 22
#: Slack of the triangle inequality, as a share of the longest vector: doubles err by far less.
SLACK = 1e-6
TREES = "ids array<long>, dims int, vectors binary, spans binary, sums binary, radii binary"
_TREES = pa.schema([("ids", pa.list_(pa.int64())), ("dims", pa.int32()), ("vectors", pa.binary()), ("spans", pa.binary()), ("sums", pa.binary()), ("radii", pa.binary())])
OUTPUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"


@dataclass
class Tree:
    """vectors in the order of the leaves; of each ball: first, last + 1, left and right child (-1: a leaf), sum, radius around the mean."""

    ids: list[int | None]
    vectors: np.ndarray
    spans: np.ndarray
    sums: np.ndarray
    radii: np.ndarray

    @classmethod
    def of(cls, ids: list[int | None], vectors: np.ndarray) -> Tree:
        """Splits at the median along the line between two far vectors, down to LEAF; a ball of equal vectors is a leaf."""
        order = np.arange(len(vectors))
        spans: list[list[int]] = []
        sums, radii = [], []

        def ball(lo: int, hi: int) -> int:
            own = vectors[order[lo:hi]]
            total = own.sum(0)
            away = ((own - total / (hi - lo)) ** 2).sum(1)
            at = len(spans)
            spans.append([lo, hi, -1, -1])
            sums.append(total)
            radii.append(np.sqrt(away.max()))
            if hi - lo > LEAF and (own != own[0]).any():
                a = own[np.argmax(away)]
                b = own[np.argmax(((own - a).astype(np.float64) ** 2).sum(1))]
                along = own.astype(np.float64) @ (b - a).astype(np.float64)
                order[lo:hi] = order[lo:hi][np.argsort(along, kind="stable")]
                middle = (lo + hi) // 2
                spans[at][2], spans[at][3] = ball(lo, middle), ball(middle, hi)
            return at

        ball(0, len(vectors))
        return cls([ids[i] for i in order], vectors[order], np.array(spans, np.int64), np.array(sums, np.int64), np.array(radii))

    def row(self) -> list:
        return [self.ids, self.vectors.shape[1], self.vectors.astype("<i4").tobytes(), self.spans.astype("<i4").tobytes(), self.sums.astype("<i8").tobytes(), self.radii.astype("<f8").tobytes()]

    @classmethod
    def read(cls, ids: list[int | None], dims: int, vectors: bytes, spans: bytes, sums: bytes, radii: bytes) -> Tree:
        v = np.frombuffer(vectors, "<i4").reshape(len(ids), dims).astype(np.int64)
        return cls(ids, v, np.frombuffer(spans, "<i4").reshape(-1, 4).astype(np.int64), np.frombuffer(sums, "<i8").reshape(-1, dims), np.frombuffer(radii, "<f8"))

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(balls that go whole, their centroids, places of the other vectors, their centroids)."""
        counts = self.spans[:, 1] - self.spans[:, 0]
        longest = np.sqrt(max(float((centroids.astype(np.float64) ** 2).sum(1).max()), float((self.vectors.astype(np.float64) ** 2).sum(1).max())))
        whole, whole_to, leaves, left = [], [], [], []
        at, can = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
        while len(at):
            far = np.where(can, _apart(self.sums[at] / counts[at, None], centroids), np.inf)
            nearest = far.min(1, keepdims=True)
            can = far <= nearest + (2 * self.radii[at] + SLACK * longest)[:, None]
            one, leaf = can.sum(1) == 1, self.spans[at, 2] < 0
            whole.append(at[one])
            whole_to.append(far[one].argmin(1))
            leaves.append(at[~one & leaf])
            left.append(can[~one & leaf])
            down = ~one & ~leaf
            at, can = self.spans[at[down], 2:4].reshape(-1), np.repeat(can[down], 2, axis=0)
        spans, can = self.spans[np.concatenate(leaves), :2], np.concatenate(left)
        places = np.concatenate([np.zeros(0, np.int64), *(np.arange(lo, hi) for lo, hi in spans)])
        apart = squared(self.vectors[places], centroids)
        apart[~np.repeat(can, spans[:, 1] - spans[:, 0], axis=0)] = np.iinfo(np.int64).max
        return np.concatenate(whole), np.concatenate(whole_to), places, apart.argmin(1) if len(places) else places


def _apart(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Distances in doubles, right to some 1e-8 of the longest vector."""
    c = centroids.astype(np.float64)
    return np.sqrt(np.maximum((points**2).sum(1)[:, None] + (c**2).sum(1) - 2 * points @ c.T, 0))


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, points by centroids."""
    if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT and points.shape[1] <= 64:
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        return ((p**2).sum(1)[:, None] + (c**2).sum(1) - 2 * p @ c.T).astype(np.int64)
    out = np.empty((len(points), len(centroids)), np.int64)
    for k, c in enumerate(centroids):
        out[:, k] = ((points - c) ** 2).sum(1)
    return out


def _plant(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tree(ids: list, parts: list[np.ndarray]) -> pa.RecordBatch:
            row = Tree.of(ids, np.concatenate(parts)).row()
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _TREES)], schema=_TREES)

        ids, parts, held = [], [], 0
        for batch in batches:
            vectors = batch.column(1).flatten().to_numpy().reshape(-1, dims)
            own, lo = batch.column(0).to_pylist(), 0
            while lo < len(own):
                hi = min(len(own), lo + BLOCK - held)
                ids += own[lo:hi]
                parts.append(vectors[lo:hi])
                held, lo = held + hi - lo, hi
                if held == BLOCK:
                    yield tree(ids, parts)
                    ids, parts, held = [], [], 0
        if held:
            yield tree(ids, parts)

    return run


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[Tree]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Tree.read(*(batch.column(k)[i].as_py() for k in range(len(_TREES))))


def _sums(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for t in _trees(batches):
            balls, to, places, near = t.assign(centroids)
            np.add.at(counts, to, t.spans[balls, 1] - t.spans[balls, 0])
            np.add.at(sums, to, t.sums[balls])
            np.add.at(counts, near, 1)
            np.add.at(sums, near, t.vectors[places])
        some = np.flatnonzero(counts)
        yield pa.record_batch({"cluster": pa.array(some, pa.int32()), "n": pa.array(counts[some]), "sums": pa.array(sums[some].tolist(), pa.list_(pa.int64()))})

    return run


def _rows(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _trees(batches):
            balls, to, places, near = t.assign(centroids)
            cluster = np.empty(len(t.ids), np.int64)
            for (lo, hi), c in zip(t.spans[balls, :2], to):
                cluster[lo:hi] = c
            cluster[places] = near
            distance = ((t.vectors - centroids[cluster]) ** 2).sum(1)
            yield pa.record_batch({"vec_id": pa.array(t.ids, pa.int64()), "cluster": pa.array(cluster, pa.int32()), "distance": pa.array(distance)})

    return run


def whole_vectors(df: DataFrame, dims: int = 64, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id long, vector array<long>): floor(scale * x) of each component, of the rows that have dims components, none null, NaN or infinite.

    A component so large that squared distances might not fit in 64 bits (2**27 and more, of 64) raises an error.
    """
    most = 1 << ((62 - (dims - 1).bit_length()) // 2 - 1)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))

    def number(x: Column) -> Column:
        too_large = F.raise_error(F.concat(F.lit(f"a component times {scale} is beyond {most}: "), x.cast("string"))).cast("long")
        return F.when(F.abs(x * scale) < most, F.floor(x * scale)).otherwise(too_large)

    vectors = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return vectors.where(F.col("v").isNotNull() & (F.size("v") == dims) & finite).select("vec_id", F.transform("v", number).alias("vector"))


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, tag: str = "2", dims: int = 64, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia and inertia (distances summed), centroid (its components) of each usable vector.

    Centroids begin as the k vectors whose sha256 of `tag:id` is least (equal ones, and those without id, which come last,
    by vector), and move to the floor of their vectors' mean in each round; ties go to the smaller number; a centroid
    without vectors stays where it is. With fewer than k vectors there are as many centroids. Rows with other numbers of
    components, null, NaN or infinite ones are left out; repeated rows come repeated; null ids stay null; other columns
    are left out; an empty table gives no rows.
    """
    spark = df.sparkSession
    vectors = whole_vectors(df, dims, scale, id_col, vector_col)
    first = vectors.orderBy(F.sha2(F.concat(F.lit(f"{tag}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "vector").limit(k).collect()
    if not first:
        return spark.createDataFrame([], OUTPUT)
    centroids = np.array([r["vector"] for r in first], np.int64)
    trees = written(vectors.mapInArrow(tidy(_plant(dims)), TREES), "ball-trees")
    for _ in range(rounds):
        parts = trees.mapInArrow(tidy(_sums(centroids)), "cluster int, n long, sums array<long>")
        total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(dims))).alias("sums"))
        moved = centroids.copy()
        for r in total.collect():
            moved[r["cluster"]] = [s // r["n"] for s in r["sums"]]
        centroids = moved
    rows = written(trees.mapInArrow(tidy(_rows(centroids)), "vec_id long, cluster int, distance long"), "clusters")
    own = {r["cluster"]: r["inertia"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    known = spark.createDataFrame([(c, i, sum(own.values()), centroids[c].tolist()) for c, i in own.items()], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return rows.join(F.broadcast(known), "cluster").select(*(f.split()[0] for f in OUTPUT.split(", ")))
