"""Graphs written in Python: nodes as calls, ports as values."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Ref:
    node: str
    port: str


class Step:
    """A node of a flow; its ports are attributes, or items where the name is a Python word."""

    def __init__(self, flow: Flow, id: str):
        self.flow, self.id = flow, id

    def __getattr__(self, port: str) -> Ref:
        if port.startswith("__"):
            raise AttributeError(port)
        return Ref(self.id, port)

    def __getitem__(self, port: str) -> Ref:
        return Ref(self.id, port)

    def then(self, *steps: Step, port: str = "control_out") -> Step:
        """Control goes on to the steps, one after the other; gives the last."""
        at, out = self, port
        for s in steps:
            self.flow.links.append({"from_node": at.id, "from_port": out, "to_node": s.id, "to_port": "control_in", "kind": "control"})
            at, out = s, "control_out"
        return at


class Flow:
    def __init__(self) -> None:
        self.nodes: list[dict[str, Any]] = []
        self.links: list[dict[str, Any]] = []
        self.outputs: list[dict[str, Any]] = []

    def node(self, type: str, /, id: str | None = None, cached: bool = False, **inputs: Any) -> Step:
        """Inputs are Refs (links) or plain values."""
        step = Step(self, id or f"n{len(self.nodes)}")
        values: dict[str, Any] = {}
        for port, x in inputs.items():
            if isinstance(x, Ref):
                self.links.append({"from_node": x.node, "from_port": x.port, "to_node": step.id, "to_port": port})
            else:
                values[port] = x
        raw: dict[str, Any] = {"id": step.id, "type": type, "input_values": values}
        if cached:
            raw["cache_enabled"] = True
        if type == "core.container.make_array":
            raw["input_ports_override"] = [*inputs]
        self.nodes.append(raw)
        return step

    def col(self, name: str) -> Ref:
        """A column of the source row."""
        return self.node("core.source.column", name=name).value

    def out(self, **named: Ref) -> Flow:
        self.outputs += [{"node_id": r.node, "port": r.port, "alias": k} for k, r in named.items()]
        return self

    def keep(self, *columns: str) -> Flow:
        """Columns of the source as outputs of the same name."""
        return self.out(**{c: self.col(c) for c in columns})

    def payload(self) -> dict[str, Any]:
        return {"nodes": self.nodes, "links": self.links, "output_nodes": self.outputs}
