"""Runs of graphs: whole or in part, cached, cancelled, traced.

A run compiles to one DataFrame; collecting it is one Spark job, in which nodes are columns of one projection. Spark
has no time of a single node in there, so a node's duration is null unless it comes from a run that timed it. `trace`
describes the nodes of a run as a table, which plans.trace analyses.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..registry import REGISTRY, Registry
from .compiler import Compiled, Compiler
from .graph import Graph, GraphError

TRACE = "node_id string, type string, status string, duration_ms double, level int, from_cache boolean, error string, logs array<string>, outputs map<string,string>"


@dataclass
class Cancellation:
    """What was asked to stop; safe to ask from any thread."""

    all: bool = False
    nodes: set[str] = field(default_factory=set)

    def cancel(self, node: str | None = None) -> None:
        if node is None:
            self.all = True
        else:
            self.nodes.add(node)

    def is_cancelled(self, node: str | None = None) -> bool:
        return self.all or node in self.nodes

    def reset(self) -> None:
        self.all = False
        self.nodes.clear()


class ResultCache:
    """Persisted frames of graph prefixes that end in nodes marked cache_enabled, by what they compute: the last most used."""

    def __init__(self, most: int = 32) -> None:
        self.most = most
        self._frames: dict[str, tuple[str, str, DataFrame]] = {}
        self._lock = threading.Lock()

    def key(self, graph: Graph, nodes: set[str], source: DataFrame | None, *settings: Any) -> str:
        """Digest of all that a frame holds: the nodes with their values and links, the source's plan and the files that it reads (a table
        that is written anew has others), the settings of the run."""
        own = [[n, graph.nodes[n].type, graph.nodes[n].values, graph.nodes[n].inputs, graph.nodes[n].outputs] for n in graph.order if n in nodes]
        links = sorted([x.source, x.out, x.target, x.into, x.control] for x in graph.links if x.target in nodes)
        data = None if source is None else [source.semanticHash(), sorted(source.inputFiles())]
        text = json.dumps([own, links, data, settings], sort_keys=True, default=str)
        return hashlib.sha256(text.encode()).hexdigest()

    def get(self, key: str) -> DataFrame | None:
        with self._lock:
            held = self._frames.pop(key, None)
            if held is None:
                return None
            self._frames[key] = held  # now the last used
            return held[2]

    def __contains__(self, key: str) -> bool:
        return key in self._frames

    def put(self, key: str, graph: Graph, node: str, frame: DataFrame) -> DataFrame:
        frame = frame.persist(StorageLevel.MEMORY_AND_DISK)
        with self._lock:
            self._frames[key] = (graph.nodes[node].type, node, frame)
            while len(self._frames) > self.most:
                self._frames.pop(next(iter(self._frames)))[2].unpersist()
        return frame

    def clear(self, type: str | None = None, nodes: set[str] | None = None) -> int:
        """Drops all entries, those of a node type, or those of nodes; gives how many."""
        with self._lock:
            gone = [k for k, (t, n, _) in self._frames.items() if (type is None or t == type) and (nodes is None or n in nodes)]
            for k in gone:
                self._frames.pop(k)[2].unpersist()
            return len(gone)

    @property
    def size(self) -> int:
        return len(self._frames)

    def stats(self) -> dict[str, Any]:
        with self._lock:
            by: dict[str, int] = {}
            for t, _, _ in self._frames.values():
                by[t] = by.get(t, 0) + 1
        return {"size": sum(by.values()), "by_type": by}


@dataclass
class Run:
    id: str
    graph: Graph
    compiled: Compiled
    frame: DataFrame
    cancellation: Cancellation
    events: list[dict[str, Any]] = field(default_factory=list)
    total_ms: float = 0.0
    cached: set[str] = field(default_factory=set)
    fail_fast: bool = False
    seed: int = 0
    row: dict[str, Any] | None = None


class Engine:
    """Graphs over one session. Sources are DataFrames; without one a graph runs on a single row."""

    def __init__(self, spark: SparkSession, registry: Registry = REGISTRY, max_workers: int = 4):
        from .. import operators  # noqa: F401  registers the node types

        self.spark, self.registry = spark, registry
        self.cache = ResultCache()
        self._running: dict[str, Cancellation] = {}
        self._pool = ThreadPoolExecutor(max_workers)

    def definitions(self) -> list[dict[str, Any]]:
        return self.registry.definitions()

    def graph(self, payload: dict[str, Any] | Graph) -> Graph:
        return payload if isinstance(payload, Graph) else Graph(payload, self.registry)

    def plan(self, payload: dict[str, Any], options: dict[str, Any] | None = None) -> dict[str, Any]:
        return self.graph(payload).plan(options)

    # --- runs

    def compile(self, payload: dict[str, Any] | Graph, source: DataFrame | None = None, options: dict[str, Any] | None = None) -> Run:
        """The DataFrame of a run's outputs; nothing is computed but what the cache is asked to keep.

        Until it ends (run, stream and table see to that; else forget it) a run can be cancelled by its id. Option
        fail_fast: the trace ends with the first node that fails, where else all that do not hang on it go on.
        """
        options = options or {}
        graph = self.graph(payload)
        order, forced = graph.selection(options)
        seed = int(options.get("seed") or 0)
        drop = set(options.get("invalidate_cache_nodes") or ())
        if drop:
            self.cache.clear(nodes=drop)
        collect = options.get("on_error") == "collect"
        kept_at_all = options.get("use_cache", True) and not (source is not None and source.isStreaming)
        marks = self._prefixes(graph, order, forced) if kept_at_all else []
        keys = [self.cache.key(graph, nodes, source, seed, collect) for _, nodes in marks]
        hits = {n for (n, _), key in zip(marks, keys) if key in self.cache}

        def kept(k: int, frame: DataFrame) -> DataFrame:
            held = self.cache.get(keys[k])
            return held if held is not None else self.cache.put(keys[k], graph, marks[k][0], frame)

        parts, done = [], set()
        for _, nodes in [*marks, ("", set(order))]:
            parts.append([n for n in order if n in nodes - done])
            done |= nodes
        compiled = Compiler(graph, source, self.spark, order, seed, collect=collect).compile(parts, kept)
        run_id = str(options.get("execution_id") or uuid.uuid4())
        return Run(run_id, graph, compiled, compiled.select(graph), self._running.setdefault(run_id, Cancellation()), cached=hits, fail_fast=bool(options.get("fail_fast", False)), seed=seed)

    def _prefixes(self, graph: Graph, order: list[str], forced: set[str]) -> list[tuple[str, set[str]]]:
        """Each node marked cache_enabled with all that must run before it; each of them holds those before.

        A prefix with a node that must be computed anew (forced, or of a type that is never cached) is left out.
        """
        out: list[tuple[str, set[str]]] = []
        run, held = set(order), set()
        for n in order:
            if graph.nodes[n].cached and graph.nodes[n].spec.style != "control" and n not in graph.loop_of:
                nodes = (graph.prefix([n]) | held) & run
                if not nodes & forced and all(graph.nodes[m].spec.cache_policy != "disabled" for m in nodes):
                    out.append((n, nodes))
                    held = nodes
        return out

    def table(self, payload: dict[str, Any] | Graph, source: DataFrame | None = None, options: dict[str, Any] | None = None) -> DataFrame:
        """A row of outputs for each row of the source.

        A row that a node rejects fails the job; with option on_error collect its outputs from there on are null and
        `_errors` has the node's message (dependency_failed for those that hang on it). In a loop a node that fails ends the round
        for its row, the first message stays; what follows the loop goes on from the last round that got there.
        """
        run = self.compile(payload, source, options)
        self._running.pop(run.id, None)
        return run.frame

    def run(self, payload: dict[str, Any], options: dict[str, Any] | None = None) -> dict[str, Any]:
        """A single-row graph: outputs, trace, stats and plan, as plain values."""
        began = time.time()
        run = self.compile(payload, None, options)
        try:
            events = list(self._events(run))
        finally:
            self._running.pop(run.id, None)
        run.total_ms = (time.time() - began) * 1000
        trace = [e["trace"] for e in events if "trace" in e]
        return {"outputs": self._outputs(run), "trace": trace, "stats": stats(trace, run.total_ms, run.graph.plan(options)["max_parallelism"]), "plan": run.graph.plan(options), "execution_id": run.id}

    def run_async(self, payload: dict[str, Any], options: dict[str, Any] | None = None, on_event: Callable[[dict[str, Any]], None] | None = None) -> Future:
        def work() -> dict[str, Any]:
            out = self.run(payload, options)
            for e in (*({"event": "node_" + t["status"].lower(), "node_id": t["node_id"]} for t in out["trace"]), {"event": "complete"}, {"event": "result", "result": out}):
                if on_event:
                    on_event(e)
            return out

        return self._pool.submit(work)

    def stream(self, payload: dict[str, Any], options: dict[str, Any] | None = None) -> Iterator[dict[str, Any]]:
        """Events of a run: start, one for each node in order once the job that has them all is done, complete, result; error where it fails."""
        began = time.time()
        yield {"event": "start", "plan": self.plan(payload, options)}
        try:
            run = self.compile(payload, None, options)
            trace = []
            try:
                for e in self._events(run):
                    trace.append(e["trace"])
                    yield e
            finally:
                self._running.pop(run.id, None)
        except Exception as e:
            yield {"event": "error", "error": str(e), "code": getattr(e, "code", None) or "execution_error"}
            return
        total = (time.time() - began) * 1000
        yield {"event": "complete", "total_ms": total}
        yield {"event": "result", "outputs": self._outputs(run), "stats": stats(trace, total)}

    def _outputs(self, run: Run) -> dict[str, Any]:
        row = run.row or {}
        named = {o.alias: row[f"{o.node}.{o.port}"] for o in run.graph.outputs if f"{o.node}.{o.port}" in row}
        return named or {f"{n}.{p}": row[c] for (n, p), c in run.compiled.columns.items() if not p.startswith("$") and c in row}

    def _events(self, run: Run) -> Iterator[dict[str, Any]]:
        """The row is computed in one job; where that fails, each node's own columns tell which are at fault."""
        c, graph = run.compiled, run.graph
        if run.cancellation.all:
            raise GraphError("the run was cancelled", "cancelled")
        self.spark.addTag(run.id)
        errors: dict[str, str] = {}
        row: dict[str, Any] = {}
        try:
            shown = [x for x in c.columns.values()] + list(c.logs.values())
            try:
                got = c.frame.select(*(F.col(f"`{x}`") for x in shown)).first() if shown else None
                row = dict(zip(shown, got)) if got is not None else {}
            except Exception as e:
                errors, row = self._blamed(run, e)
        finally:
            self.spark.removeTag(run.id)
        run.row = row
        inner = graph.loop_of
        stopped = False
        for n in c.order:
            if stopped:
                return
            node = graph.nodes[n]
            runs = row.get(c.guards[n]) if n in c.guards else True
            status = "ERROR" if n in errors else "CANCELLED" if run.cancellation.is_cancelled(n) else "COMPLETED" if runs or n in inner else "SKIPPED"
            outputs = {p: row.get(x) for (m, p), x in c.columns.items() if m == n and not p.startswith("$")}
            line = row.get(c.logs[n]) if n in c.logs and (status == "COMPLETED" or n in inner) else None
            logs = [] if line is None else line if isinstance(line, list) else [line]
            t = {"node_id": n, "type": node.type, "status": status, "duration_ms": None, "level": graph.levels[n], "from_cache": n in run.cached, "error": errors.get(n), "logs": logs, "outputs": outputs}
            run.events.append(t)
            stopped = stopped or (run.fail_fast and status == "ERROR")
            yield {"event": {"COMPLETED": "node_cached" if n in run.cached else "node_completed", "SKIPPED": "node_skipped"}.get(status, "node_error"), "node_id": n, "trace": t}

    def _blamed(self, run: Run, error: Exception) -> tuple[dict[str, str], dict[str, Any]]:
        """(message of each node that fails or hangs on one that does, the row without them): the run again with errors collected,
        or where what fails cannot be collected, each node's own columns."""
        c, graph = run.compiled, run.graph
        errors: dict[str, str] = {}
        try:
            again = Compiler(graph, None, self.spark, c.order, run.seed, collect=True).compile()
            names = [*again.columns.values(), *again.logs.values(), *(again.errors or {}).values()]
            got = again.frame.select(*(F.col(f"`{x}`").alias(str(k)) for k, x in enumerate(names))).first()
            row = dict(zip(names, got)) if got is not None else {}
            errors = {n: row[x] for n, x in (again.errors or {}).items() if row.get(x) is not None}
            if errors:
                return errors, row
        except Exception:  # told apart below
            errors = {}
        row = {}
        for n in c.order:
            own = [x for (m, _), x in c.columns.items() if m == n]
            if any(p in errors for p in graph.parents[n]):
                errors[n] = "dependency_failed"
            elif own:
                try:
                    got = c.frame.select(*(F.col(f"`{x}`") for x in own)).first()
                    row |= dict(zip(own, got)) if got is not None else {}
                except Exception as e:
                    errors[n] = str(e).split("\n")[0]
        if not errors:
            raise error
        return errors, row

    def forget(self, run: Run) -> None:
        self._running.pop(run.id, None)

    def cancel(self, execution_id: str, node: str | None = None) -> bool:
        """Whether there was such a run to stop. Jobs of the run are interrupted by their tag."""
        held = self._running.get(execution_id)
        if held is None:
            return False
        held.cancel(node)
        if node is None:
            self.spark.interruptTag(execution_id)
        return True

    def trace_table(self, trace: list[dict[str, Any]]) -> DataFrame:
        rows = [(t["node_id"], t["type"], t["status"], None if t["duration_ms"] is None else float(t["duration_ms"]), int(t["level"]), bool(t["from_cache"]), t["error"], list(t["logs"]), {k: str(v) for k, v in t["outputs"].items()}) for t in trace]
        return self.spark.createDataFrame(rows, TRACE)


def stats(trace: list[dict[str, Any]], total_ms: float, parallelism: int = 1) -> dict[str, Any]:
    done = [t for t in trace if t["status"] == "COMPLETED"]
    timed = [t["duration_ms"] for t in trace if t["duration_ms"] is not None]
    spent = sum(timed) if timed else None
    return {
        "total_nodes": len(trace),
        "executed_nodes": sum(not t["from_cache"] for t in done),
        "cached_nodes": sum(t["from_cache"] for t in done),
        "skipped_nodes": sum(t["status"] == "SKIPPED" for t in trace),
        "error_nodes": sum(t["status"] == "ERROR" for t in trace),
        "total_time_ms": total_ms,
        "node_time_ms": spent,
        "parallel_efficiency": None if spent is None else spent / total_ms if total_ms > 0 else 1.0,
        "max_parallelism": parallelism,
        "levels_executed": len({t["level"] for t in trace}),
    }
