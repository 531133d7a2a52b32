"""Graphs that are tables of edges: what is reached, levels and order, cycles, all paths.

Work goes in rounds, a join a round over the edges that are left, and each round's rows are files of the shared
folder, so that plans stay as short in the last round as in the first. A graph as deep as a chain of ten thousand
edges would need as many rounds; where no more than LOCAL_EDGES edges are left (they are counted), what remains is
bounded, and one task walks it to its end. Only counts come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_dir, written

#: So many edges (some tens of MB in a task) are walked in one task.
LOCAL_EDGES = 200_000
#: Nodes of a round go to every task up to so many (some 30 MB); more are joined by a shuffle.
BROADCAST_ROWS = 300_000


def _edges(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Distinct (s, d) as texts; an edge without one of its ends is none."""
    return written(edges.select(F.col(src).cast("string").alias("s"), F.col(dst).cast("string").alias("d")).where("s is not null and d is not null").distinct(), "edges")


_ROW = pa.schema([("s", pa.string()), ("d", pa.string()), ("depth", pa.int32())])


@dataclass
class _Walk:
    """Rows (s, d, depth) of a task with nodes as numbers: to[first[n] : first[n + 1]] are the targets of node n."""

    names: pa.Array
    first: np.ndarray
    to: np.ndarray
    #: the rows without target: their node and depth
    alone: np.ndarray
    depth: np.ndarray

    @classmethod
    def of(cls, batches: Iterator[pa.RecordBatch]) -> _Walk:
        rows = pa.Table.from_batches([b.cast(_ROW) for b in batches], _ROW).combine_chunks()
        ends = pa.chunked_array([*rows["s"].chunks, *rows["d"].chunks], pa.string()).combine_chunks().dictionary_encode()
        numbers = ends.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        s, d = numbers[: len(rows)], numbers[len(rows) :]
        real = np.flatnonzero(d >= 0)
        real = real[np.argsort(s[real], kind="stable")]
        names = ends.dictionary
        depth = rows["depth"].fill_null(-1).to_numpy()
        return cls(names, np.searchsorted(s[real], np.arange(len(names) + 1)), d[real], s[d < 0], depth[d < 0])

    def targets(self, nodes: np.ndarray) -> np.ndarray:
        size = self.first[nodes + 1] - self.first[nodes]
        return self.to[np.repeat(self.first[nodes] - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def _reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the nodes without target, all of one depth, on: (node, depth) of what is met."""
    w = _Walk.of(batches)
    depth = np.full(len(w.names), -1, np.int32)
    depth[w.alone] = w.depth
    began, front = depth >= 0, np.unique(w.alone)
    while len(front):
        at = depth[front[0]] + 1
        front = np.unique(w.targets(front))
        front = front[depth[front] < 0]
        depth[front] = at
    met = np.flatnonzero((depth >= 0) & ~began)
    yield pa.record_batch({"node": w.names.take(pa.array(met)), "depth": pa.array(depth[met])})


def _peel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, level) of all nodes; levels count from the depth of the rows without target."""
    w = _Walk.of(batches)
    waits = np.bincount(w.to, minlength=len(w.names))
    level = np.full(len(w.names), -1, np.int64)
    front, k = np.flatnonzero(waits == 0), int(w.depth[0]) if len(w.depth) else 0
    while len(front):
        level[front] = k
        hit = w.targets(front)
        np.subtract.at(waits, hit, 1)
        hit = np.unique(hit)
        front, k = hit[waits[hit] == 0], k + 1
    yield pa.record_batch({"node": w.names, "level": pa.array(level, mask=level < 0)})


def closure(edges: DataFrame, start: str, src: str = "src", dst: str = "dst", stop: DataFrame | None = None) -> DataFrame:
    """(node, depth) of all that is reached from start, itself included, by the fewest edges. Cycles end where they close; loops,
    repeated edges and edges without an end change nothing; a start without edges reaches itself. stop (its first column):
    nodes that are not gone into. With src and dst exchanged it is what start depends on."""
    spark = edges.sparkSession
    left = _edges(edges, src, dst)
    if stop is not None:
        left = left.join(stop.select(F.col(stop.columns[0]).cast("string").alias("d")), "d", "left_anti")
    seen = last = written(spark.createDataFrame([(start, 0)], "node string, depth int"), "reached")
    while not last.isEmpty():
        # edges into what is reached already lead nowhere new
        left = written(left.join(seen.select(F.col("node").alias("d")), "d", "left_anti").select("s", "d"), "edges-left")
        if left.count() <= LOCAL_EDGES:
            walked = left.withColumn("depth", F.lit(None).cast("int")).union(last.select("node", F.lit(None).cast("string"), "depth"))
            return seen.union(written(walked.repartition(1).mapInArrow(_reach, "node string, depth int"), "reached"))
        next_ = left.join(last.select(F.col("node").alias("s"), "depth"), "s").groupBy(F.col("d").alias("node")).agg((F.min("depth") + 1).alias("depth"))
        last = written(next_, "reached")
        seen = written(seen.union(last), "reached-all")
    return seen


def levels(edges: DataFrame, nodes: DataFrame | None = None, src: str = "src", dst: str = "dst", node: str = "node") -> DataFrame:
    """(node, level) of every node: 0 where nothing leads, else one more than the highest level that leads there; null on cycles and behind them.

    nodes adds some without edges. Rows in the order of (level, node) are a topological order. Kahn's peeling: a round
    takes the nodes that wait for no edge, and those that their edges lead to wait for so many less. Only the numbers of
    nodes that still wait are written anew each round; the edges stay where they are until fewer than half of them are left.
    """
    spark = edges.sparkSession
    left = _edges(edges, src, dst)
    waiting = left.select(F.col("d").alias("node"), F.lit(1).cast("long").alias("waits")).union(left.select("s", F.lit(0).cast("long")))
    if nodes is not None:
        waiting = waiting.union(nodes.select(F.col(node).cast("string"), F.lit(0).cast("long")).where(F.col(node).isNotNull()))
    folder, done = shared_dir(spark, "levels"), []
    k, n_written = 0, None
    while True:
        path = f"{folder}/{k}"
        counted = waiting.groupBy("node").agg(F.sum("waits").alias("waits")).withColumn("level", F.lit(k).cast("long"))
        counted.withColumn("ready", F.col("waits") == 0).write.partitionBy("ready").parquet(path)
        state = spark.read.schema("node string, waits long, level long, ready boolean").parquet(path)
        n_left, n_ready = state.agg(F.coalesce(F.sum("waits"), F.lit(0)), F.count_if("ready")).first()
        n_written = n_left if n_written is None else n_written
        waiting, ready = state.where("not ready").select("node", "waits"), state.where("ready").select("node")
        if n_ready:
            done.append(f"{path}/ready=true")
        known = spark.read.schema("node string, level long").parquet(*done) if done else spark.createDataFrame([], "node string, level long")
        if not n_ready or not n_left:
            return known.union(waiting.select("node", F.lit(None).cast("long")))
        if n_left <= LOCAL_EDGES or 2 * n_left < n_written:
            left, n_written = written(left.join(state.select(F.col("node").alias("s")), "s", "left_semi").select("s", "d"), "edges-left"), n_left
        if n_left <= LOCAL_EDGES:
            # one row says where levels stand
            at = left.limit(1).select("s", F.lit(None).cast("string").alias("d"), F.lit(k).alias("depth"))
            peeled = left.withColumn("depth", F.lit(None).cast("int")).union(at).repartition(1).mapInArrow(_peel, "node string, level long")
            # the walk begins with the nodes of this level, which are known
            return known.union(written(peeled, "levels").where(F.col("level").isNull() | (F.col("level") > k)))
        first = F.broadcast(ready) if n_ready <= BROADCAST_ROWS else ready
        met = left.join(first.select(F.col("node").alias("s")), "s", "left_semi").select(F.col("d").alias("node"), F.lit(-1).cast("long").alias("waits"))
        waiting = waiting.union(met)
        k += 1


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def cyclic(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node) of every node on a cycle, or on a way from one cycle to another: what peeling leaves from either side."""
    stuck = levels(edges, None, src, dst).where("level is null").select("node")
    e = edges.select(F.col(src).cast("string").alias("s"), F.col(dst).cast("string").alias("d"))
    # what is left, turned around
    inner = e.join(stuck.select(F.col("node").alias("s")), "s", "left_semi").join(stuck.select(F.col("node").alias("d")), "d", "left_semi")
    return levels(inner, None, "d", "s").where("level is null").select("node")


def has_cycle(edges: DataFrame, src: str = "src", dst: str = "dst") -> bool:
    return not levels(edges, None, src, dst).where("level is null").isEmpty()


def paths(edges: DataFrame, start: str, end: str, src: str = "src", dst: str = "dst", most: int | None = None) -> DataFrame:
    """(path) every way from start to end that passes no node twice, as the list of its nodes; from a node to itself the node alone.

    Only nodes that start reaches and that reach end are walked. most: shorter ways first, rounds stop with the one in
    which so many are known, of which these are put out. As many rows as there are ways, which may be exponentially many.
    """
    spark = edges.sparkSession
    e = _edges(edges, src, dst)
    after = closure(e, start, "s", "d").select("node")
    near = closure(e, end, "d", "s").select("node").join(after, "node")
    inner = e.join(near.select(F.col("node").alias("s")), "s", "left_semi").join(near.select(F.col("node").alias("d")), "d", "left_semi")
    inner = written(inner.where(F.col("s") != end), "edges-between")
    last = written(spark.createDataFrame([([start],)], "path array<string>"), "paths")
    found: list[DataFrame] = []
    known = 0
    while not last.isEmpty():
        ended = F.element_at("path", -1) == end
        arrived = last.where(ended)
        if (n := arrived.count()) > 0:
            found, known = [written(union([*found, arrived]), "paths-found")], known + n
        if most is not None and known >= most:
            break
        step = last.where(~ended).join(inner, F.element_at("path", -1) == F.col("s")).where(~F.array_contains("path", F.col("d")))
        last = written(step.select(F.array_append("path", F.col("d")).alias("path")), "paths")
    out = found[0] if found else spark.createDataFrame([], "path array<string>")
    return out if most is None else out.orderBy(F.size("path"), "path").limit(most)
