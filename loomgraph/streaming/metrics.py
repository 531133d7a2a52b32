"""What each node of a running graph does, batch by batch: rows, rows skipped, nulls and errors, as Spark counts them on the way.

The counts are observed in the job that computes the outputs, so they cost no pass of their own and are there as soon
as a batch, or a micro-batch of a stream, ends.
"""

from __future__ import annotations

import threading
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..plans.runtime import Engine, Run

NODE_METRICS = "batch long, node_id string, type string, rows long, skipped long, nulls long, errors long, batch_ms double"
_COUNTS = ("rows", "skipped", "nulls", "errors")


def _counts(run: Run) -> list:
    """A count for each node and thing that is counted, named node|what."""
    c, out = run.compiled, []
    held = lambda name: F.col("`" + name.replace("`", "``") + "`")
    for n in c.order:
        ports = [x for (m, p), x in c.columns.items() if m == n and not p.startswith("$")]
        runs = F.coalesce(held(c.guards[n]), F.lit(False)) if n in c.guards else F.lit(True)
        error = held(c.errors[n]).isNotNull() if c.errors and n in c.errors else F.lit(False)
        null = held(ports[0]).isNull() if ports else F.lit(False)
        for what, test in zip(_COUNTS, (runs, ~runs, runs & null, error)):
            out.append(F.count_if(test).alias(f"{n}|{what}"))
    return out


def _rows(run: Run, got: dict[str, Any], batch: int, ms: float | None) -> list[tuple]:
    return [(batch, n, run.graph.nodes[n].type, *(int(got.get(f"{n}|{what}") or 0) for what in _COUNTS), ms) for n in run.compiled.order]


class NodeMetrics(StreamingQueryListener):
    """Collects the counts of a graph's micro-batches while its stream runs; add it to spark.streams, and remove it when done.

    The last `most` batches are kept.
    """

    def __init__(self, run: Run, name: str, most: int = 1000):
        self.run, self.name, self.most = run, name, most
        self._batches: dict[int, list[tuple]] = {}
        self._lock = threading.Lock()

    def onQueryStarted(self, event: Any) -> None:
        pass

    def onQueryProgress(self, event: Any) -> None:
        p = event.progress
        if (got := p.observedMetrics.get(self.name)) is None:
            return
        with self._lock:
            self._batches[p.batchId] = _rows(self.run, got.asDict(), p.batchId, float(p.batchDuration))
            while len(self._batches) > self.most:
                self._batches.pop(min(self._batches))

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        pass

    def rows(self) -> list[tuple]:
        with self._lock:
            return [r for k in sorted(self._batches) for r in self._batches[k]]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), NODE_METRICS)


def _observed(engine: Engine, payload: dict[str, Any], source: DataFrame, name: str | Observation, options: dict[str, Any] | None) -> tuple[DataFrame, Run]:
    run = engine.compile(payload, source, options)
    engine.forget(run)
    return replace(run.compiled, frame=run.compiled.frame.observe(name, *_counts(run))).select(run.graph), run


def watch_stream(engine: Engine, payload: dict[str, Any], stream: DataFrame, name: str = "nodes", options: dict[str, Any] | None = None) -> tuple[DataFrame, NodeMetrics]:
    """(the outputs of a graph over a stream, the listener that is told its nodes' counts)."""
    frame, run = _observed(engine, payload, stream, name, options)
    return frame, NodeMetrics(run, name)


class Watched:
    """The outputs of a graph over a table, and after an action on them the counts of its nodes."""

    def __init__(self, engine: Engine, payload: dict[str, Any], source: DataFrame, options: dict[str, Any] | None = None):
        self._observation = Observation()
        self.frame, self._run = _observed(engine, payload, source, self._observation, options)

    def rows(self) -> list[tuple]:
        """Waits for the action's end."""
        return _rows(self._run, self._observation.get, 0, None)
