"""Node types: what a node declares, and the catalogue of all registered ones."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from importlib.metadata import entry_points
from typing import Any

from .types import PortType

#: Group of entry points whose callables register the nodes of a plugin package.
PLUGIN_GROUP = "loomgraph.nodes"
CONTROL = PortType("control")


@dataclass(frozen=True)
class Port:
    name: str
    type: PortType = PortType()
    default: Any = None
    required: bool = False
    description: str = ""

    def to_dict(self) -> dict[str, Any]:
        return {"name": self.name, "type": self.type.to_dict(), "required": self.required, "default": self.default, "description": self.description}


@dataclass(frozen=True)
class NodeSpec:
    """style: column (Columns of one row from Columns), table (a DataFrame to a DataFrame), control, or variable."""

    type: str
    inputs: tuple[Port, ...]
    outputs: tuple[Port, ...]
    build: Callable[..., Any]
    style: str = "column"
    category: str = "General"
    description: str = ""
    tags: tuple[str, ...] = ()
    cache_policy: str = "auto"
    version: str = "1.0.0"
    plugin: str | None = None
    dynamic: bool = False  # takes whatever input ports the node instance names

    def to_dict(self) -> dict[str, Any]:
        return {
            "node_type": self.type,
            "type": self.type,
            "version": self.version,
            "category": self.category,
            "description": self.description,
            "tags": list(self.tags),
            "style": self.style,
            "cache_policy": self.cache_policy,
            "plugin_name": self.plugin,
            "inputs": [p.to_dict() for p in self.inputs],
            "outputs": [p.to_dict() for p in self.outputs],
            "input_ports": [p.name for p in self.inputs],
            "output_ports": [p.name for p in self.outputs],
        }


@dataclass
class Registry:
    specs: dict[str, NodeSpec] = field(default_factory=dict)
    prefixes: dict[str, str] = field(default_factory=dict)
    failures: dict[str, str] = field(default_factory=dict)

    def add(self, spec: NodeSpec) -> NodeSpec:
        self.specs[spec.type] = spec
        return spec

    def alias_prefix(self, other: str, own: str) -> None:
        """Node types named other... in graphs mean own... here."""
        self.prefixes[other] = own

    def get(self, name: str) -> NodeSpec | None:
        for other, own in self.prefixes.items():
            if name not in self.specs and name.startswith(other):
                name = own + name[len(other) :]
        return self.specs.get(name)

    def definitions(self) -> list[dict[str, Any]]:
        return [self.specs[k].to_dict() for k in sorted(self.specs)]

    def load_plugins(self, found=None) -> list[str]:
        """Call every entry point of PLUGIN_GROUP with this registry; what fails is recorded, not raised."""
        loaded = []
        for point in entry_points(group=PLUGIN_GROUP) if found is None else found:
            try:
                point.load()(self)
                loaded.append(point.name)
            except Exception as e:  # a broken plugin must not take the engine down
                self.failures[point.name] = f"{type(e).__name__}: {e}"
        return loaded


REGISTRY = Registry()


def port(text: str, default: Any = None, required: bool = False) -> Port:
    """`a: list<int>` with a default."""
    name, _, kind = (x.strip() for x in text.partition(":"))
    return Port(name, parse_type(kind or "any"), default, required)


def parse_type(text: str) -> PortType:
    if text.endswith("?"):
        inner = parse_type(text[:-1])
        return PortType(inner.kind, inner.item, inner.key, inner.value, inner.fields, True, inner.metadata)
    if text.startswith("list<"):
        return PortType("list", item=parse_type(text[5:-1]))
    return PortType.of(text)


def node(type: str, inputs: list[Port] | None = None, outputs: list[str] | None = None, *, registry: Registry | None = None, control: bool = True, **more: Any):
    """Registers the decorated builder.

    A column builder takes an Inputs and returns a Column (for a single output) or a dict of them by port.
    control: the node has the ports control_in and control_out, as all but literals and roots have.
    """

    def wrap(build):
        ins = tuple(inputs or ()) + ((Port("control_in", CONTROL),) if control else ())
        outs = tuple(port(x) for x in outputs or ())
        if control and more.get("style") != "control":
            outs += (Port("control_out", CONTROL),)
        (registry or REGISTRY).add(NodeSpec(type, ins, outs, build, description=(build.__doc__ or "").strip().split("\n")[0], **more))
        return build

    return wrap
