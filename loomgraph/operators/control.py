"""Control flow and variables. What they do to a plan is the compiler's; here they are declared."""

from __future__ import annotations

from ..functions.exprs import truthy
from ..registry import node, port
from .inputs import Inputs


@node("core.control.start", [], ["control_out: control"], control=False, style="control", category="Control")
def start(v: Inputs):
    """Where a run's branches begin."""
    return {}


@node("core.control.ifelse", [port("condition: boolean", False)], ["true: control", "false: control"], style="control", tags=("ifelse",), category="Control")
def ifelse(v: Inputs):
    """Nodes behind one port run, those behind the other are skipped."""
    return truthy(v["condition"])


@node("core.control.for", [port("first_index: int", 0), port("last_index: int", 0)], ["loop_body: control", "index: int", "completed: control"], style="control", tags=("loop",), category="Control")
def for_loop(v: Inputs):
    """first .. last, both included, in either direction."""


@node("core.control.repeat", [port("count: int", 1)], ["loop_body: control", "index: int", "completed: control"], style="control", tags=("loop",), category="Control")
def repeat_loop(v: Inputs):
    """count times, from 0; not at all for 0 and less."""


@node("core.control.while", [port("condition: boolean", False), port("max_iterations: int", 100)], ["loop_body: control", "index: int", "completed: control"], style="control", tags=("loop",), category="Control")
def while_loop(v: Inputs):
    """While the condition holds, read anew each time, max_iterations times at most."""


@node("core.var.declare", [port("name: string", "var"), port("value")], ["value"], style="variable", category="Variables")
def declare(v: Inputs):
    """Sets a variable of the graph and hands the value on."""


@node("core.var.set", [port("name: string", "var"), port("value")], ["value"], style="variable", category="Variables")
def assign(v: Inputs):
    """Sets a variable of the graph and hands the value on."""


@node("core.var.get", [port("name: string", "var"), port("default", "")], ["value"], style="variable", category="Variables")
def read(v: Inputs):
    """A variable's value where it was set before, else the default."""
