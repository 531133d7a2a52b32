"""Graphs: a validated payload with its orders, closures, loops and branches. Nothing here touches data."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

from ..registry import CONTROL, REGISTRY, NodeSpec, Port, Registry


class GraphError(ValueError):
    """code: what is wrong, as a fixed word."""

    def __init__(self, message: str, code: str | None = None, node: str | None = None):
        super().__init__(message)
        self.code, self.node = code, node


@dataclass(frozen=True)
class Node:
    id: str
    spec: NodeSpec
    values: dict[str, Any] = field(default_factory=dict)
    inputs: tuple[str, ...] = ()
    outputs: tuple[str, ...] = ()
    cached: bool = False

    @property
    def type(self) -> str:
        return self.spec.type

    def port(self, name: str, out: bool) -> Port | None:
        return next((p for p in (self.spec.outputs if out else self.spec.inputs) if p.name == name), None)

    @property
    def is_loop(self) -> bool:
        return "loop" in self.spec.tags


@dataclass(frozen=True)
class Link:
    source: str
    out: str
    target: str
    into: str
    control: bool = False


@dataclass(frozen=True)
class Output:
    node: str
    port: str
    alias: str


class Graph:
    def __init__(self, payload: dict[str, Any], registry: Registry = REGISTRY):
        self.payload = payload
        self.nodes: dict[str, Node] = {}
        for raw in payload.get("nodes") or ():
            n = _node(raw, registry)
            if n.id in self.nodes:
                raise GraphError(f"node id '{n.id}' is used twice", "duplicate_id", n.id)
            self.nodes[n.id] = n
        if not self.nodes:
            raise GraphError("a graph needs at least one node", "empty_graph")
        self.links: list[Link] = []
        self.data_in: dict[tuple[str, str], Link] = {}
        self.control_out: dict[str, list[Link]] = defaultdict(list)
        for raw in payload.get("links") or ():
            self._link(raw)
        self.outputs = [self._output(x) for x in payload.get("output_nodes") or ()]
        self.order = self._sorted()

    def _link(self, raw: dict[str, Any]) -> None:
        x = Link(raw["from_node"], raw["from_port"], raw["to_node"], raw["to_port"], raw.get("kind", "data") == "control")
        for end in (x.source, x.target):
            if end not in self.nodes:
                raise GraphError(f"a link names the unknown node '{end}'", "unknown_node", end)
        again = x in self.links
        if x.control:
            again |= any(y.source == x.source and y.out == x.out for y in self.control_out[x.source]) and not self._may_fan_out(x)
        else:
            again |= (x.target, x.into) in self.data_in
        if again:
            raise GraphError(f"{x.source}.{x.out} -> {x.target}.{x.into} is linked already", "duplicate_link", x.target)
        if not x.control:
            source, target = self.nodes[x.source], self.nodes[x.target]
            if x.out not in source.outputs:
                raise GraphError(f"node '{x.source}' has no output '{x.out}'", "missing_output_port", x.source)
            if x.into not in target.inputs:
                raise GraphError(f"node '{x.target}' has no input '{x.into}'", "missing_input_port", x.target)
            a, b = source.port(x.out, True), target.port(x.into, False)
            if a and b and not b.type.accepts(a.type):
                raise GraphError(f"{a.type.label} of {x.source}.{x.out} does not fit {b.type.label} of {x.target}.{x.into}", "type_mismatch", x.target)
            self.data_in[x.target, x.into] = x
        else:
            self.control_out[x.source].append(x)
        self.links.append(x)

    def _may_fan_out(self, x: Link) -> bool:
        """A start may begin several branches; every other control port has one target."""
        return self.nodes[x.source].type == "core.control.start"

    def _output(self, raw: dict[str, Any]) -> Output:
        node, port = raw.get("node_id"), raw.get("port")
        if not node or not port:
            raise GraphError("an output needs node_id and port", "missing_output_port")
        if node not in self.nodes:
            raise GraphError(f"an output names the unknown node '{node}'", "unknown_node", node)
        if port not in self.nodes[node].outputs:
            raise GraphError(f"node '{node}' has no output '{port}'", "missing_output_port", node)
        return Output(node, port, raw.get("alias") or f"{node}.{port}")

    # --- orders and closures

    @cached_property
    def parents(self) -> dict[str, set[str]]:
        out: dict[str, set[str]] = {n: set() for n in self.nodes}
        for x in self.links:
            out[x.target].add(x.source)
        return out

    @cached_property
    def children(self) -> dict[str, set[str]]:
        out: dict[str, set[str]] = {n: set() for n in self.nodes}
        for x in self.links:
            out[x.source].add(x.target)
        return out

    def _sorted(self) -> list[str]:
        waiting = {n: len(p) for n, p in self.parents.items()}
        ready, order = deque(n for n in self.nodes if not waiting[n]), []
        while ready:
            n = ready.popleft()
            order.append(n)
            for c in sorted(self.children[n], key=list(self.nodes).index):
                waiting[c] -= 1
                if not waiting[c]:
                    ready.append(c)
        if len(order) < len(self.nodes):
            raise GraphError("the graph has a cycle", "cycle")
        return order

    @cached_property
    def levels(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for n in self.order:
            out[n] = 1 + max((out[p] for p in self.parents[n]), default=-1)
        return out

    def _closure(self, start: Iterable[str], step: dict[str, set[str]], stop: Iterable[str] = ()) -> set[str]:
        seen, todo, stop = set(), deque(start), set(stop)
        while todo:
            n = todo.popleft()
            if n not in seen:
                seen.add(n)
                todo.extend(c for c in step[n] if c not in stop)
        return seen

    def ancestors(self, nodes: Iterable[str]) -> set[str]:
        """The nodes and all that they depend on."""
        return self._closure(nodes, self.parents)

    def prefix(self, nodes: Iterable[str]) -> set[str]:
        """The nodes and all that must have run before or with them: what they depend on, loops with their bodies, and whatever
        touches the same variables before."""
        out, before = self.ancestors(nodes), set()
        at = {n: k for k, n in enumerate(self.order)}
        names = {n: str(self.nodes[n].values.get("name") or "var") for n in self.order if self.nodes[n].spec.style == "variable"}
        while out != before:
            before = set(out)
            last: dict[str, int] = {}
            for n in out & names.keys():
                last[names[n]] = max(at[n], last.get(names[n], -1))
            out |= {n for n, name in names.items() if at[n] < last.get(name, -1)}
            for n in list(out):
                loop = self.loop_of.get(n)
                while loop is not None:
                    out |= {loop}
                    loop = self.loop_of.get(loop)
                if self.nodes[n].is_loop:
                    out |= self._loop_members(n)
            out = self.ancestors(out)
        return out

    def descendants(self, nodes: Iterable[str], stop: Iterable[str] = ()) -> set[str]:
        """The nodes and all that depend on them, not going past stop."""
        return self._closure(nodes, self.children, stop)

    def paths(self, a: str, b: str) -> list[list[str]]:
        """Every path from a to b."""
        out, todo = [], [[a]]
        near = self.ancestors([b])
        while todo:
            path = todo.pop()
            if path[-1] == b:
                out.append(path)
                continue
            todo.extend(path + [c] for c in sorted(self.children[path[-1]], reverse=True) if c in near)
        return out

    # --- control flow

    def _behind(self, node: str, port: str) -> set[str]:
        """Nodes reached over control links from a port; of a loop on the way only what follows its completion."""
        seen: set[str] = set()
        todo = deque(x.target for x in self.control_out.get(node, ()) if x.out == port)
        while todo:
            n = todo.popleft()
            if n in seen or n == node:
                continue
            seen.add(n)
            todo.extend(x.target for x in self.control_out.get(n, ()) if not self.nodes[n].is_loop or x.out == "completed")
        return seen

    @cached_property
    def loop_bodies(self) -> dict[str, set[str]]:
        """Per loop the nodes run in each of its rounds; a loop inside stands for its own body."""
        return {n: self._behind(n, "loop_body") for n in self.order if self.nodes[n].is_loop}

    @cached_property
    def loop_of(self) -> dict[str, str]:
        """The innermost loop of each node that is in a body."""
        out: dict[str, str] = {}
        for loop, body in sorted(self.loop_bodies.items(), key=lambda x: -len(x[1])):
            for n in body:
                out[n] = loop
        return out

    @cached_property
    def branches(self) -> dict[str, list[tuple[str, bool]]]:
        """Per node the if/else nodes that decide whether it runs, and the side it is on. What both sides reach runs always."""
        out: dict[str, list[tuple[str, bool]]] = defaultdict(list)
        for n in self.order:
            if "ifelse" in self.nodes[n].spec.tags:
                yes, no = self._behind(n, "true"), self._behind(n, "false")
                for side, members in ((True, yes - no), (False, no - yes)):
                    for m in members | {b for x in members if self.nodes[x].is_loop for b in self._loop_members(x)}:
                        out[m].append((n, side))
        return dict(out)

    def _loop_members(self, loop: str) -> set[str]:
        out = set(self.loop_bodies[loop])
        for n in self.loop_bodies[loop]:
            if self.nodes[n].is_loop:
                out |= self._loop_members(n)
        return out

    def start_branches(self) -> dict[str, list[set[str]]]:
        """Per start its branches: one for each control target."""
        return {n: [self.descendants([x.target]) for x in self.control_out.get(n, ())] or [set()] for n in self.order if self.nodes[n].type == "core.control.start"}

    def merge_points(self) -> set[str]:
        """Nodes that take data from two or more branches."""
        sides = [b for parts in self.start_branches().values() for b in parts]
        sides += [{m for m, by in self.branches.items() if (n, side) in by} for n in self.nodes for side in (True, False)]
        return {n for n in self.nodes if sum(any(x.source in b for (t, _), x in self.data_in.items() if t == n) for b in sides if b) > 1}

    # --- runs

    def selection(self, options: dict[str, Any]) -> tuple[list[str], set[str]]:
        """(the nodes of a run in order, those that must not come from the cache) for the options mode,
        target_nodes, entry_nodes, max_steps, breakpoints and force_no_cache_nodes. Unknown ids are left out; where
        none are left, the whole graph runs."""
        mode, forced = options.get("mode", "full"), set(options.get("force_no_cache_nodes") or ())
        wanted = set(self.nodes)
        if mode == "selection":
            targets = self._known(options.get("target_nodes"))
            wanted = self.ancestors(targets) if targets else wanted
        elif mode in ("from_node", "from_nodes", "downstream"):
            entries = self._known(options.get("entry_nodes") or options.get("target_nodes"))
            below = self.descendants(entries)
            forced |= below
            wanted = self.ancestors(below) if entries else wanted
        elif mode != "full":
            raise GraphError(f"unknown mode '{mode}'", "unknown_mode")
        order = [n for n in self.order if n in wanted]
        stops = set(options.get("breakpoints") or ())
        at = next((k for k, n in enumerate(order) if n in stops), len(order))
        steps = options.get("max_steps")
        return order[: min(at, len(order) if steps is None else int(steps))], forced

    def _known(self, ids: Iterable[str] | None) -> list[str]:
        return [n for n in ids or () if n in self.nodes]

    def plan(self, options: dict[str, Any] | None = None) -> dict[str, Any]:
        """What a run would do: nodes by level, and how many could run side by side."""
        order, _ = self.selection(options or {})
        by_level: dict[int, list[str]] = defaultdict(list)
        for n in order:
            by_level[self.levels[n]].append(n)
        return {
            "total_nodes": len(order),
            "order": order,
            "levels": [{"level": k, "nodes": by_level[k]} for k in sorted(by_level)],
            "max_parallelism": max((len(x) for x in by_level.values()), default=0),
        }


def _node(raw: dict[str, Any], registry: Registry) -> Node:
    if not raw.get("type"):
        raise GraphError(f"node {raw.get('id')!r} has no type", "missing_type", raw.get("id"))
    if not raw.get("id"):
        raise GraphError(f"a node of type {raw['type']} has no id", "missing_id")
    spec = registry.get(raw["type"])
    if spec is None:
        raise GraphError(f"unknown node type '{raw['type']}'", "unknown_node", raw["id"])
    inputs = raw.get("input_ports_override") or [p.name for p in spec.inputs]
    outputs = raw.get("output_ports_override") or [p.name for p in spec.outputs]
    return Node(raw["id"], spec, dict(raw.get("input_values") or {}), tuple(inputs), tuple(outputs), bool(raw.get("cache_enabled")))


def is_control(p: Port) -> bool:
    return p.type == CONTROL
