"""Graphs into plans: every port a Column, every graph a chain of projections over one source.

One row of the source is one run of the graph. Nodes of a topological level share a projection, so that
Catalyst sees a short chain and prunes what no output needs. If/else sides become guards, loops become
folds over the sequence of their indices, variables the fields of the fold's accumulator.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from contextlib import nullcontext
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import Value, as_type, collecting, constant, let, steps, truthy, whole, widest
from ..operators.inputs import Inputs
from ..sources.shared import written
from .graph import Graph, GraphError, Node, is_control


#: The column of a table's run that says which nodes failed for a row and why, with option on_error collect.
ERRORS = "_errors"
#: Nodes that write lines to the run's log.
LOGGING = frozenset({"core.debug.log", "core.debug.breakpoint"})
#: Bodies of more nodes are compiled step by step, since in one expression each node's stands wherever it is used.
LONG_BODY = 8
#: Rounds of a loop with calls in it after which the rows are written down, so that no call is made again.
CUT = 4


class Scope:
    """Where values live while a part of a graph is compiled.

    Each value has a Column for the plan and a shadow over an empty table of the same types, from which
    Spark tells the type of what is built on it. Outside loops both are the same.
    """

    def __init__(self, spark: SparkSession, values: dict[tuple[str, str], Value] | None = None, shadows: dict[tuple[str, str], Value] | None = None, variables: dict[str, tuple[Value, Value]] | None = None, seed: int = 0):
        self.spark, self.seed = spark, seed
        self.values, self.shadows = values if values is not None else {}, shadows if shadows is not None else {}
        self.variables = variables if variables is not None else {}
        self.logs: list[tuple[str, Column]] = []
        self.probe: DataFrame | None = None

    def log(self, node: Node, line: Column) -> None:
        self.logs.append((node.id, line))

    def child(self) -> Scope:
        out = Scope(self.spark, dict(self.values), dict(self.shadows), dict(self.variables), self.seed)
        out.probe = self.probe
        return out


@dataclass
class Compiled:
    frame: DataFrame
    columns: dict[tuple[str, str], str]
    guards: dict[str, str]
    order: list[str]
    logs: dict[str, str] = field(default_factory=dict)
    errors: dict[str, str] | None = None

    def select(self, graph: Graph) -> DataFrame:
        """The named outputs, or every port where none of them was computed; with errors collected also ERRORS, by node."""
        named = [(o.alias, self.columns[o.node, o.port]) for o in graph.outputs if (o.node, o.port) in self.columns]
        if not named:
            named = [(f"{n}.{p}", c) for (n, p), c in self.columns.items() if not p.startswith("$")]
        chosen = [F.col(_q(c)).alias(a) for a, c in named]
        if self.errors is not None:
            entries = F.array(*(F.struct(F.lit(n).alias("k"), F.col(_q(c)).alias("v")) for n, c in self.errors.items())) if self.errors else F.array().cast("array<struct<k:string,v:string>>")
            chosen.append(F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull())).alias(ERRORS))
        return self.frame.select(*chosen)


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class Compiler:
    def __init__(self, graph: Graph, source: DataFrame | None, spark: SparkSession, order: list[str] | None = None, seed: int = 0, keep: bool = True, collect: bool = False):
        self.graph, self.spark, self.seed = graph, spark, seed
        self.order = graph.order if order is None else order
        self.frame = spark.range(1).select() if source is None else source
        self.keep = keep  # whether the source's own columns stay in the frame
        self.scope = Scope(spark, seed=seed)
        self.columns: dict[tuple[str, str], str] = {}
        self.guards: dict[str, str] = {}
        self.logs: dict[str, str] = {}
        #: Columns of error messages, if they are collected.
        self.errors: dict[str, str] | None = {} if collect else None
        #: Types of ports within loops, as the last build over shadows found them.
        self.inner_types: dict[tuple[str, str], T.DataType] = {}
        #: While rounds over the table are compiled, the column of each variable that they set.
        self.held_in: dict[str, str] = {}

    # --- the whole graph

    def compile(self, parts: list[list[str]] | None = None, kept: Callable[[int, DataFrame], DataFrame] | None = None) -> Compiled:
        """parts: the order in pieces that are compiled one after the other; kept may put another frame with the same
        columns in the place of what a piece but the last ends with."""
        parts = [self.order] if parts is None else parts
        for k, part in enumerate(parts):
            self._compile_part(part)
            if kept is not None and k + 1 < len(parts):
                self.frame = self.scope.probe = kept(k, self.frame)
        return Compiled(self.frame, self.columns, self.guards, self.order, self.logs, self.errors)

    def _compile_part(self, part: list[str]) -> None:
        wanted = set(self.order)
        inside = set(self.graph.loop_of)
        by_level: dict[int, list[str]] = defaultdict(list)
        for n in part:
            if n not in inside:
                by_level[self._depth(n, wanted)].append(n)
        for depth in sorted(by_level):
            new: dict[str, Column] = {}
            pending: list[tuple[str, str, str]] = []
            for n in by_level[depth]:
                self.scope.probe = self.frame
                for (node, port), column in self._outputs(n).items():
                    name = f"{node}.{port}"
                    new[name] = column
                    pending.append((node, port, name))
                for node, line in self.scope.logs:
                    new[f"{node}.$log"] = line
                    self.logs[node] = f"{node}.$log"
                self.scope.logs.clear()
            if new:
                self.frame = self.frame.withColumns(new)
                types = {f.name: f.dataType for f in self.frame.schema.fields}
                for node, port, name in pending:
                    known = self.scope.values.get((node, port))
                    v = Value(F.col(_q(name)), types[name], known.const) if known is not None and known.is_const else Value(F.col(_q(name)), types[name])
                    self.scope.values[node, port] = self.scope.shadows[node, port] = v
                    self.columns[node, port] = name
                for name, (v, _) in list(self.scope.variables.items()):
                    if isinstance(v, _Pending):
                        v = self.scope.values[v.key]
                        self.scope.variables[name] = (v, v)

    def _depth(self, n: str, wanted: set[str]) -> int:
        """Level of a node; variables are read after all that set them before in the graph's order."""
        if not hasattr(self, "_depths"):
            depths: dict[str, int] = {}
            # what a body takes from outside may come later in the order than its loop: again, until nothing moves
            while (found := self._depths_after(depths)) != depths:
                depths = found
            self._depths = depths
        return self._depths[n]

    def _depths_after(self, known: dict[str, int]) -> dict[str, int]:
        depths, last_set = dict(known), {}
        for m in self.order:
            d = 1 + max((depths.get(p, -1) for p in self.graph.parents[m]), default=-1)
            touched = [m, *(self.graph._loop_members(m) if self.graph.nodes[m].is_loop else ())]
            for x in touched:
                for p in self.graph.parents[x]:
                    d = max(d, depths.get(p, -1) + 1) if p not in touched else d
                node = self.graph.nodes[x]
                if node.spec.style == "variable":
                    d = max(d, last_set.get(str(node.values.get("name") or "var"), -1) + 1)
            for cond, _ in self.graph.branches.get(m, ()):
                d = max(d, depths.get(cond, -1) + 1)
            depths[m] = d
            for x in touched:
                node = self.graph.nodes[x]
                if node.type in ("core.var.set", "core.var.declare"):
                    name = str(node.values.get("name") or "var")
                    last_set[name] = max(last_set.get(name, -1), d)
        return depths

    def _outputs(self, n: str) -> dict[tuple[str, str], Column]:
        node = self.graph.nodes[n]
        guard = self._guard(n, self.scope)
        if guard is not None:
            self.guards[n] = f"{n}.$runs"
        if node.is_loop and self._has_calls(node):
            out = self._rounds(node, guard)
        elif node.is_loop:
            out = self._loop(node, self.scope, guard)
        elif node.type == "core.control.ifelse":
            values = self._inputs(node, self.scope, False)
            self.scope.values[n, "$taken"] = self.scope.shadows[n, "$taken"] = Value(node.spec.build(values), T.BooleanType())
            out = {(n, "$taken"): self.scope.values[n, "$taken"].col}
        elif node.spec.style == "control":
            out = {}
        elif node.spec.style == "call":
            out = self._call(node, F.lit(True) if guard is None else guard)
            if self.errors is not None:
                self.errors[n] = f"{n}.$error"
        elif node.spec.style == "table":
            if guard is not None:
                raise GraphError(f"'{n}' changes the table and cannot stand behind an if/else", "table_in_branch", n)
            self.frame = node.spec.build(self.frame, self._inputs(node, self.scope, False))
            fields = set(node.outputs)
            for f in self.frame.schema.fields:
                if f.name in fields:
                    self.frame = self.frame.withColumnRenamed(f.name, f"{n}.{f.name}")
                    v = Value(F.col(_q(f"{n}.{f.name}")), f.dataType)
                    self.scope.values[n, f.name] = self.scope.shadows[n, f.name] = v
                    self.columns[n, f.name] = f"{n}.{f.name}"
            self.scope.probe = self.frame
            out = {}
        else:
            out = {}
            if self.errors is None:
                built = self._build(node, self.scope, False)
            else:
                with collecting() as found:
                    built = self._build(node, self.scope, False)
                above = [F.when(F.col(_q(self.errors[x])).isNotNull(), F.lit("dependency_failed")) for x in sorted({link.source for (t, _), link in self.graph.data_in.items() if t == n}) if x in self.errors and x not in self.graph.loop_of]
                if found or above:
                    error = F.coalesce(*above, *found)
                    error = error if guard is None else F.when(guard, error)
                    built = {port: F.when(error.isNull(), column) for port, column in built.items()}
                    # within a level no node hangs on another, so the column is there for those that do
                    out[n, "$error"] = error
                    self.errors[n] = f"{n}.$error"
            for port, column in built.items():
                if guard is not None:
                    column = F.when(guard, column)
                elif node.type.startswith("core.literal."):
                    self.scope.values[n, port] = self._inputs(node, self.scope, False)["value"]
                out[n, port] = column
                if node.spec.style == "variable" and port == "value" and node.type != "core.var.get":
                    self._assign(node, self.scope, column, guard)
        if guard is not None:
            out[n, "$runs"] = guard
        return out

    def _call(self, node: Node, guard: Column) -> dict[tuple[str, str], Column]:
        """One call a row, its struct in a column of its own, whatever many ports are read of it; with its error where errors are collected."""
        held = f"{node.id}.$call"
        if self.errors is None:
            call = node.spec.build(self._inputs(node, self.scope, False))(guard)
        else:
            with collecting():
                call = node.spec.build(self._inputs(node, self.scope, False))(guard)
        self.frame = self.scope.probe = self.frame.withColumn(held, call)
        out = {(node.id, p): F.col(_q(held))[p] for p in node.outputs if not ((q := node.port(p, True)) and is_control(q))}
        return out | ({} if self.errors is None else {(node.id, "$error"): F.col(_q(held))["error"]})

    def _assign(self, node: Node, scope: Scope, column: Column, guard: Column | None) -> None:
        name = self._name_of(node, scope)
        if guard is None:
            scope.variables[name] = (_Pending(column, (node.id, "value")), None)  # type: ignore[assignment]
            return
        before = scope.variables.get(name)
        if before is None:
            scope.variables[name] = (_Pending(column, (node.id, "value")), None)  # type: ignore[assignment]
            return
        t = self._type(F.when(guard, column), scope)
        common = widest(before[0].type, t)
        merged = Value(F.when(guard, as_type(Value(column, t), common)).otherwise(as_type(before[0], common)), common)
        scope.variables[name] = (merged, merged)

    # --- single nodes

    def _guard(self, n: str, scope: Scope, shadow: bool = False) -> Column | None:
        """Whether a node runs: on its side of every if/else, which itself runs."""
        tests = []
        for cond, side in self.graph.branches.get(n, ()):
            taken = (scope.shadows if shadow else scope.values).get((cond, "$taken"))
            if taken is not None:
                tests.append(taken.col if side else ~taken.col)
            runs = (scope.shadows if shadow else scope.values).get((cond, "$runs"))
            if runs is not None:
                tests.append(runs.col)
        return reduce(lambda a, b: a & b, tests) if tests else None

    def _inputs(self, node: Node, scope: Scope, shadow: bool) -> Inputs:
        """Linked values first, then the instance's, then defaults; a port with none of these has no value."""
        values: dict[str, Value] = {}
        known = scope.shadows if shadow else scope.values
        for name in node.inputs:
            p = node.port(name, False)
            if p is not None and is_control(p):
                continue
            link = self.graph.data_in.get((node.id, name))
            if link is not None:
                v = known.get((link.source, link.out))
                if v is None:
                    source = self.graph.nodes[link.source].port(link.out, True)
                    if source is not None and is_control(source):
                        continue
                    if link.source in set(self.order):
                        raise GraphError(f"'{node.id}' takes {link.source}.{link.out}, which has no value where it runs", "unresolved_input", node.id)
                    raise GraphError(f"could not resolve inputs of '{node.id}': '{link.source}' is not part of the run", "unresolved_input", node.id)
                values[name] = v
            elif name in node.values:
                values[name] = constant(node.values[name])
            elif p is not None and p.default is not None:
                values[name] = constant(p.default)
        return Inputs(values, node, None if shadow else scope)

    def _name_of(self, node: Node, scope: Scope) -> str:
        link = self.graph.data_in.get((node.id, "name"))
        if link is None:
            return str(node.values.get("name") or "var")
        v = scope.values.get((link.source, link.out))
        if v is None or not v.is_const:
            raise GraphError(f"'{node.id}': a variable's name must be given by the graph", "variable_name", node.id)
        return str(v.const or "var")

    def _build(self, node: Node, scope: Scope, shadow: bool) -> dict[str, Column]:
        inputs = self._inputs(node, scope, shadow)
        ports = [p for p in node.outputs if not ((q := node.port(p, True)) and is_control(q))]
        if node.spec.style == "variable":
            name = self._name_of(node, scope)
            if node.type == "core.var.get":
                held = scope.variables.get(name)
                if held is None:
                    return {"value": inputs["default"].col}
                v = held[1] if shadow else held[0]
                return {"value": v.col}
            return {"value": inputs["value"].col}
        try:
            got = node.spec.build(inputs)
        except TypeError as e:
            raise GraphError(f"'{node.id}' ({node.type}): {e}", "type_mismatch", node.id) from e
        if isinstance(got, Column):
            got = {ports[0]: got}
        if set(got) != set(ports):
            raise GraphError(f"'{node.id}' gave the ports {sorted(got)}, declared are {sorted(ports)}", "missing_output_port", node.id)
        return got

    def _type(self, column: Column, scope: Scope) -> T.DataType:
        assert scope.probe is not None
        return scope.probe.select(column.alias("x")).schema["x"].dataType

    # --- loops

    def _has_calls(self, loop: Node) -> bool:
        return any(self.graph.nodes[n].spec.style == "call" for n in self.graph._loop_members(loop.id))

    def _is_stepwise(self, loop: Node) -> bool:
        """Whether a body's values, branches, logs and errors are kept from node to node."""
        members = self.graph._loop_members(loop.id)
        return self.errors is not None or len(members) > LONG_BODY or any(self.graph.nodes[n].type in LOGGING or self.graph.nodes[n].spec.style == "call" for n in members)

    def _own(self, loop: Node) -> list[str]:
        """The nodes of a loop's body that are part of the run, in order."""
        body, run = self.graph.loop_bodies[loop.id], set(self.order)
        return [n for n in self.graph.order if n in body and n in run]

    def _writes(self, loop: Node, scope: Scope) -> list[str]:
        """The variables that a loop sets."""
        return sorted({self._name_of(self.graph.nodes[m], scope) for m in self.graph._loop_members(loop.id) if m in set(self.order) and self.graph.nodes[m].type in ("core.var.set", "core.var.declare")})

    def _loop(self, loop: Node, scope: Scope, guard: Column | None) -> dict[tuple[str, str], Column]:
        """Last values of the body's ports and the last index; variables carry on in the scope."""
        result, fields = self._fold(loop, scope, guard)
        # the fold stands in the plan once: its fields are read from a column of its own
        if scope is self.scope:
            held = f"{loop.id}.$loop"
            self.frame = scope.probe = self.frame.withColumn(held, result)
            result = F.col(_q(held))
        return self._fold_outputs(loop, scope, guard, result, fields)

    def _fold_outputs(self, loop: Node, scope: Scope, guard: Column | None, result: Column, fields: dict[tuple[str, str], T.DataType]) -> dict[tuple[str, str], Column]:
        out: dict[tuple[str, str], Column] = {}
        for i, k in enumerate(fields):
            if k[0] == "$var":
                v = Value(result[f"f{i}"], fields[k])
                scope.variables[k[1]] = (v, v if scope is self.scope else _blank(fields[k]))
            elif k[1] in ("$log", "$error"):
                if scope is not self.scope:
                    out[k] = result[f"f{i}"]
                elif k[1] == "$log":
                    self.logs[k[0]] = f"{k[0]}.$log"
                    out[k] = result[f"f{i}"]
                else:
                    assert self.errors is not None
                    self.errors[k[0]] = f"{k[0]}.$error"
                    out[k] = result[f"f{i}"]
            elif not k[1].startswith("$") or scope is not self.scope:
                out[k] = result[f"f{i}"]
        out[loop.id, "index"] = F.when(guard, result["index"]) if guard is not None else result["index"]
        return out

    def _fold(self, loop: Node, scope: Scope, guard: Column | None) -> tuple[Column, dict[tuple[str, str], T.DataType]]:
        """The loop as one aggregate over its indices: a struct of the fields f0, f1, ... (whose keys and types come with it), index and go.

        A body whose errors are collected or that logs is a chain of steps over the struct, a step a node: a node that
        fails ends the round, and what follows it keeps what it had. Other bodies are one expression.
        """
        own, cone = self._own(loop), self._condition_cone(loop)
        indices, writes = self._indices(loop, scope, False), self._writes(loop, scope)
        fields = self._field_types(loop, own, scope, writes, cone)
        t = T.StructType([T.StructField(f"f{i}", fields[k]) for i, k in enumerate(fields)] + [T.StructField("index", T.LongType()), T.StructField("go", T.BooleanType())])
        start = []
        for i, k in enumerate(fields):
            held = scope.variables.get(k[1]) if k[0] == "$var" else None
            empty = F.array().cast(fields[k]) if k[1] == "$log" else F.lit(None).cast(fields[k])
            start.append((as_type(held[0], fields[k]) if held else empty).cast(fields[k]).alias(f"f{i}"))
        initial = F.struct(*start, F.lit(0).cast("long").alias("index"), F.lit(True).alias("go"))
        stepwise = self._is_stepwise(loop)

        def within(acc: Column, index: Column) -> Scope:
            inner = scope.child()
            inner.logs = []
            inner.values[loop.id, "index"] = Value(index, T.LongType())
            inner.shadows[loop.id, "index"] = _blank(T.LongType())
            for i, k in enumerate(fields):
                if k[0] == "$var":
                    inner.variables[k[1]] = (Value(acc[f"f{i}"], fields[k]), _blank(fields[k]))
            return inner

        def step(acc: Column, index: Column) -> Column:
            inner = within(acc, index)
            test = F.lit(True)
            if cone:
                # a condition that fails is false where errors are collected
                with collecting() if self.errors is not None else nullcontext():
                    for n in cone:
                        self._run_inside(self.graph.nodes[n], inner, fields, False)
                test = truthy(self._inputs(loop, inner, False)["condition"])
            go = acc["go"] & test
            done = F.struct(*(acc[f"f{i}"].alias(f"f{i}") for i in range(len(fields))), acc["index"].alias("index"), F.lit(False).alias("go"))
            if stepwise:
                moved = self._steps(loop, own, within, acc, index, fields)
            else:
                for n in own:
                    self._run_inside(self.graph.nodes[n], inner, fields, False)
                new = [as_type(inner.variables[k[1]][0] if k[0] == "$var" else inner.values[k], fields[k]).cast(fields[k]).alias(f"f{i}") for i, k in enumerate(fields)]
                moved = F.struct(*new, index.alias("index"), F.lit(True).alias("go"))
            return F.when(go, moved).otherwise(done).cast(t) if cone else moved.cast(t)

        kept = self.errors is not None or any(k[1] == "$log" for k in fields)
        if not writes and not cone and not kept and not any(self.graph.nodes[n].is_loop for n in own):
            # nothing carries over: only the last round can be seen, so it alone is computed
            last = F.try_element_at(indices, F.lit(-1))
            result = F.when(last.isNotNull(), step(initial.cast(t), last)).otherwise(initial.cast(t))
        else:
            result = F.aggregate(indices, initial.cast(t), step)
        if guard is not None:
            result = F.when(guard, result).otherwise(initial.cast(t))
        return result, fields

    def _steps(self, loop: Node, own: list[str], within: Callable[[Column, Column], Scope], acc: Column, index: Column, fields: dict[tuple[str, str], T.DataType]) -> Column:
        """A round as a chain of structs, one inside the other: each holds what its node wrote (ports, variable, log and
        error), what follows reads every field where it was written last, and the whole row of fields is built once, at the end."""
        State = dict[tuple[str, str], Column]

        def scope_of(now: State) -> Scope:
            inner = within(acc, index)
            for k, c in now.items():
                if k[0] == "$var":
                    inner.variables[k[1]] = (Value(c, fields[k]), _blank(fields[k]))
                else:
                    inner.values[k], inner.shadows[k] = Value(c, fields[k]), _blank(fields[k])
            return inner

        def after(left: list[str], now: State, alive: Column) -> Column:
            if not left:
                return F.struct(*(c.alias(f"f{i}") for i, c in enumerate(now.values())), index.alias("index"), F.lit(True).alias("go"))
            node, rest = self.graph.nodes[left[0]], left[1:]
            inner = scope_of(now)
            guard = self._guard(node.id, inner)
            runs = alive if guard is None else alive & guard
            new: State = {}
            error = None
            if node.type == "core.control.ifelse":
                new[node.id, "$taken"] = F.when(runs, node.spec.build(self._inputs(node, inner, False)))
            elif node.is_loop:
                result, parts = self._fold(node, inner, runs)

                def nested(r: Column) -> Column:
                    got = {k: as_type(Value(r[f"f{i}"], parts[k]), fields[k]) for i, k in enumerate(parts) if k in fields}
                    kept = {k: F.concat(now[k], c) if k[1] == "$log" else F.coalesce(now[k], c) if k[1] == "$error" else c for k, c in got.items()}
                    return put(rest, now, {k: F.when(runs, c).otherwise(now[k]) if k[0] == "$var" or k[1] in ("$log", "$error") else c for k, c in kept.items()} | {(node.id, "index"): F.when(runs, r["index"])}, alive, None)

                return let(result, nested)
            elif node.spec.style != "control":
                with collecting() if self.errors is not None else nullcontext([]) as found:
                    built = self._build(node, inner, False)
                error = F.when(runs, F.coalesce(*found)) if found else None
                for port, column in built.items():
                    want = fields[node.id, port]
                    got = F.when(runs, as_type(Value(column, self.inner_types[node.id, port]), want))
                    new[node.id, port] = got if error is None else F.when(error.isNull(), got).otherwise(now[node.id, port])
                    if node.type in ("core.var.set", "core.var.declare"):
                        name = ("$var", self._name_of(node, inner))
                        value = F.when(runs, as_type(Value(column, self.inner_types[node.id, port]), fields[name])).otherwise(now[name])
                        new[name] = value if error is None else F.when(error.isNull(), value).otherwise(now[name])
                for n, line in inner.logs:
                    key = (n, "$log")
                    new[key] = F.when(runs & line.isNotNull(), F.array_append(now[key], line)).otherwise(now[key])
            if error is None:
                return put(rest, now, new, alive, None)
            new[node.id, "$error"] = F.coalesce(now[node.id, "$error"], error)
            return put(rest, now, new, alive, alive & error.isNull())

        def put(rest: list[str], now: State, new: State, alive: Column, goes_on: Column | None) -> Column:
            """A round that has ended keeps what it had; a node that a branch leaves out has null."""
            new = {k: c for k, c in new.items() if k in now}
            if not new:
                return after(rest, now, alive)
            held = lambda k, c: c if k[0] == "$var" or k[1] in ("$log", "$error") else F.when(alive, c).otherwise(now[k])
            wrote = [held(k, c).cast(fields[k]).alias(f"w{i}") for i, (k, c) in enumerate(new.items())]
            if goes_on is not None:
                wrote.append(goes_on.alias("alive"))
            return let(F.struct(*wrote), lambda s: after(rest, now | {k: s[f"w{i}"] for i, k in enumerate(new)}, alive if goes_on is None else s["alive"]))

        return after(own, {k: acc[f"f{i}"] for i, k in enumerate(fields)}, F.lit(True))

    def _rounds(self, loop: Node, guard: Column | None) -> dict[tuple[str, str], Column]:
        """A loop with calls in its body: round after round over the table, the body's ports and variables as columns.

        As many rounds as the row with most of them has (counted first, unless the graph says it); rows that are done
        keep their values and are not called. Every CUT rounds the rows are written down. A node that fails ends the round for its row.
        """
        own, cone, scope = self._own(loop), self._condition_cone(loop), self.scope
        writes = self._writes(loop, scope)
        fields = self._field_types(loop, own, scope, writes, cone)
        indices = self._indices(loop, scope, False)
        held = {k: f"{loop.id}.$var.{k[1]}" if k[0] == "$var" else f"{k[0]}.{k[1]}" for k in fields}
        todo, go, alive, at = (f"{loop.id}.{x}" for x in ("$indices", "$go", "$alive", "index"))
        start: dict[str, Column] = {todo: indices if guard is None else F.when(guard, indices).otherwise(F.array().cast("array<long>")), go: F.lit(True), at: F.lit(0).cast("long")}
        for k, name in held.items():
            before = scope.variables.get(k[1]) if k[0] == "$var" else None
            first = as_type(before[0], fields[k]).cast(fields[k]) if before else F.array().cast(fields[k]) if k[1] == "$log" else F.lit(None).cast(fields[k])
            if name in self.frame.columns and k[0] != "$var":  # in a loop around this one: lines and errors go on, rows that do not come here keep all
                first = F.col(_q(name)) if k[1] in ("$log", "$error") or guard is None else F.when(guard, first).otherwise(F.col(_q(name)))
            start[name] = first
        self._add(start)
        outer = dict(self.held_in)
        for k, name in held.items():
            v = Value(F.col(_q(name)), fields[k])
            if k[0] == "$var":
                scope.variables[k[1]] = (v, v)
                self.held_in[k[1]] = name
            else:
                scope.values[k] = scope.shadows[k] = v
        scope.values[loop.id, "index"] = scope.shadows[loop.id, "index"] = Value(F.col(_q(at)), T.LongType())
        col = lambda name: F.col(_q(name))
        for r in range(self._round_count(loop, col(todo))):
            if r and r % CUT == 0 and not self.frame.isStreaming:
                self._cut()
                if cone and self.frame.where(col(go) & (F.size(col(todo)) > r)).isEmpty():
                    break
            self._add({alive: (F.size(col(todo)) > r) & col(go)})
            if cone:
                seen = scope.values[loop.id, "index"]
                scope.values[loop.id, "index"] = Value(F.get(col(todo), F.lit(r)), T.LongType())
                with collecting() if self.errors is not None else nullcontext():
                    for n in cone:
                        for port, column in self._build(self.graph.nodes[n], scope, False).items():
                            self._add({f"{n}.{port}": column})
                            scope.values[n, port] = scope.shadows[n, port] = Value(col(f"{n}.{port}"), self._type(col(f"{n}.{port}"), scope))
                self._add({go: col(go) & (~col(alive) | truthy(self._inputs(loop, scope, False)["condition"]))})
                self._add({alive: col(alive) & col(go)})
                scope.values[loop.id, "index"] = seen
            self._add({at: F.when(col(alive), F.get(col(todo), F.lit(r))).otherwise(col(at))})
            for n in own:
                self._round_node(self.graph.nodes[n], col(alive), fields, alive)
        self.held_in = outer
        out = {k: col(name) for k, name in held.items() if k[0] != "$var" and not k[1].startswith("$")}
        for k, name in held.items():
            if k[1] == "$log":
                self.logs[k[0]] = name
            elif k[1] == "$error" and self.errors is not None:
                self.errors[k[0]] = name
        return out | {(loop.id, "index"): F.when(guard, col(at)) if guard is not None else col(at)}

    def _add(self, columns: dict[str, Column]) -> None:
        self.frame = self.scope.probe = self.frame.withColumns(columns)

    def _cut(self) -> None:
        """The rows so far from files; columns of no type are added anew."""
        void = [f.name for f in self.frame.schema.fields if isinstance(f.dataType, T.NullType)]
        frame = written(self.frame.drop(*void), "rounds")
        self.frame = self.scope.probe = frame.withColumns({n: F.lit(None) for n in void}) if void else frame

    def _round_count(self, loop: Node, indices: Column) -> int:
        v = self._inputs(loop, self.scope, False)
        ports = {"core.control.for": ("first_index", "last_index"), "core.control.repeat": ("count",)}.get(loop.type, ("max_iterations",))
        if all(v[p].is_const for p in ports):
            numbers = [int(v[p].const or 0) for p in ports]
            return abs(numbers[1] - numbers[0]) + 1 if len(numbers) == 2 else max(0, numbers[0] or (100 if loop.type == "core.control.while" else 0))
        if self.frame.isStreaming:
            raise GraphError(f"'{loop.id}': over a stream the rounds of a loop with calls must be given by the graph", "unbounded_rounds", loop.id)
        return int(self.frame.agg(F.max(F.size(indices))).first()[0] or 0)

    def _round_node(self, node: Node, alive_now: Column, fields: dict[tuple[str, str], T.DataType], alive: str) -> None:
        """A node of a body in one round of the table."""
        scope = self.scope
        guard = self._guard(node.id, scope)
        runs = alive_now if guard is None else alive_now & guard
        held = lambda port: F.col(_q(f"{node.id}.{port}"))
        if node.type == "core.control.ifelse":
            self._add({f"{node.id}.$taken": F.when(runs, node.spec.build(self._inputs(node, scope, False))).otherwise(held("$taken"))})
            return
        if node.is_loop:
            writes = self._writes(node, scope)
            got = self._rounds(node, runs) if self._has_calls(node) else self._loop(node, scope, runs)
            if not self._has_calls(node):  # what one fold gives beside what the rounds before gave
                kept = lambda n, p, c: F.concat(F.col(_q(f"{n}.{p}")), c) if p == "$log" else F.coalesce(F.col(_q(f"{n}.{p}")), c) if p == "$error" else F.when(alive_now, c).otherwise(F.col(_q(f"{n}.{p}")))
                got = {(n, p): kept(n, p, c) for (n, p), c in got.items()}
            self._add({f"{n}.{p}": c for (n, p), c in got.items()})
            for k in got:
                scope.values[k] = scope.shadows[k] = Value(F.col(_q(f"{k[0]}.{k[1]}")), T.LongType() if k == (node.id, "index") else self.inner_types[k])
            for name in writes:  # the loop around keeps the variable in its own column
                own, t = self.held_in[name], fields["$var", name]
                self._add({own: F.when(runs, as_type(scope.variables[name][0], t)).otherwise(F.col(_q(own)))})
                scope.variables[name] = (Value(F.col(_q(own)), t),) * 2
            return
        if node.spec.style == "control":
            return
        error = None
        if node.spec.style == "call":
            built = self._call(node, runs)
            error = built.pop((node.id, "$error"), None)
            built = {p: c for (_, p), c in built.items()}
        else:
            with collecting() if self.errors is not None else nullcontext([]) as found:
                built = self._build(node, scope, False)
            error = F.when(runs, F.coalesce(*found)) if found else None
        # a round that has ended, or ends here, keeps what it had; a node that a branch leaves out has null
        ended = ~alive_now if error is None else ~alive_now | error.isNotNull()
        new = {f"{node.id}.{p}": F.when(ended, held(p)).when(runs, c.cast(fields[node.id, p])) for p, c in built.items()}
        for n, line in scope.logs:
            new[f"{n}.$log"] = F.when(runs & line.isNotNull(), F.array_append(F.col(_q(f"{n}.$log")), line)).otherwise(F.col(_q(f"{n}.$log")))
        scope.logs.clear()
        ok = runs
        if error is not None:
            new[f"{node.id}.$failed"] = error
            ok = runs & held("$failed").isNull()
        self._add(new)
        if node.type in ("core.var.set", "core.var.declare"):
            own = self.held_in[self._name_of(node, scope)]
            t = fields["$var", self._name_of(node, scope)]
            self._add({own: F.when(ok, as_type(Value(held("value"), fields[node.id, "value"]), t)).otherwise(F.col(_q(own)))})
        if error is not None:
            self._add({f"{node.id}.$error": F.coalesce(held("$error"), held("$failed")), alive: F.col(_q(alive)) & held("$failed").isNull()})

    def _indices(self, loop: Node, scope: Scope, shadow: bool) -> Column:
        v = self._inputs(loop, scope, shadow)
        if loop.type == "core.control.for":
            return steps(whole(v["first_index"]), whole(v["last_index"]))
        empty = F.array().cast("array<long>")
        if loop.type == "core.control.repeat":
            n = whole(v["count"])
            return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(empty)
        n = whole(v["max_iterations"], 100)
        rounds = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(empty)
        if self._condition_cone(loop):
            return rounds
        return F.when(truthy(v["condition"]), rounds).otherwise(empty)

    def _condition_cone(self, loop: Node) -> list[str]:
        """The nodes to compute anew before each round of a while: those its condition takes from variables."""
        link = self.graph.data_in.get((loop.id, "condition")) if loop.type == "core.control.while" else None
        if link is None:
            return []
        up = self.graph.ancestors([link.source])
        live: set[str] = set()
        for n in self.graph.order:
            if n in up and (self.graph.nodes[n].type == "core.var.get" or self.graph.parents[n] & live):
                live.add(n)
        return [n for n in self.graph.order if n in live]

    def _run_inside(self, node: Node, scope: Scope, fields: dict[tuple[str, str], T.DataType], shadow: bool) -> None:
        """A node of a body within a fold; its guard holds within the round."""
        known = scope.shadows if shadow else scope.values
        guard = self._guard(node.id, scope, shadow)
        if node.type == "core.control.ifelse":
            known[node.id, "$taken"] = Value(node.spec.build(self._inputs(node, scope, shadow)), T.BooleanType())
            if guard is not None:
                known[node.id, "$runs"] = Value(guard, T.BooleanType())
            return
        if node.spec.style == "control" and not node.is_loop:
            return
        if node.is_loop:
            if shadow:
                self._shadow_loop(node, scope)
                return
            for k, c in self._loop(node, scope, guard).items():
                t = T.LongType() if k == (node.id, "index") else self.inner_types[k]
                known[k], scope.shadows[k] = Value(c, t), _blank(t)
            return
        for port, column in self._build(node, scope, shadow).items():
            if guard is not None:
                column = F.when(guard, column)
            t = self.inner_types[node.id, port]
            known[node.id, port] = Value(column, t)
            scope.shadows[node.id, port] = _blank(t)
            if node.type in ("core.var.set", "core.var.declare"):
                name = self._name_of(node, scope)
                want = fields.get(("$var", name), t)
                before = scope.variables.get(name)
                new = column.cast(want)
                if guard is not None and before is not None:
                    new = F.when(guard, new).otherwise((before[1] if shadow else before[0]).col.cast(want))
                v = Value(new, want)
                scope.variables[name] = (before[0] if before else v, v) if shadow else (v, _blank(want))

    def _field_types(self, loop: Node, body: list[str], scope: Scope, writes: list[str], cone: list[str]) -> dict[tuple[str, str], T.DataType]:
        """Types of the accumulator: variables that the body sets, then the ports of its nodes.

        Found by building the body over shadows; a variable that comes out wider than it went in (an int
        set to a float) makes the next try with the wider type.
        """
        types: dict[str, T.DataType] = {name: scope.variables[name][0].type if name in scope.variables else T.NullType() for name in writes}
        for _ in range(4):
            inner = scope.child()
            inner.values = dict(inner.shadows)
            inner.shadows[loop.id, "index"] = inner.values[loop.id, "index"] = Value(F.lit(0).cast("long"), T.LongType())
            for name, t in types.items():
                v = Value(F.lit(None).cast(t), t)
                inner.variables[name] = (v, v)
            ports: dict[tuple[str, str], T.DataType] = {}
            for n in [*cone, *body]:
                self._shadow_node(self.graph.nodes[n], inner, ports if n in body else {})
            wider = {name: widest(t, inner.variables[name][1].type) for name, t in types.items()}
            if wider == types:
                break
            types = wider
        if self._is_stepwise(loop):
            for n in body:
                node = self.graph.nodes[n]
                if node.type == "core.control.ifelse":
                    ports[n, "$taken"] = T.BooleanType()
                elif node.spec.style != "control" and self.errors is not None:
                    ports[n, "$error"] = T.StringType()
                if node.type in LOGGING:
                    ports[n, "$log"] = T.ArrayType(T.StringType())
        out = {("$var", name): T.StringType() if isinstance(t, T.NullType) else t for name, t in types.items()}
        return out | {k: T.StringType() if isinstance(t, T.NullType) else t for k, t in ports.items()}

    def _shadow_node(self, node: Node, scope: Scope, ports: dict[tuple[str, str], T.DataType]) -> None:
        guard = self._guard(node.id, scope, True)
        if node.type == "core.control.ifelse":
            v = Value(node.spec.build(self._inputs(node, scope, True)), T.BooleanType())
            scope.shadows[node.id, "$taken"] = scope.values[node.id, "$taken"] = v
            if guard is not None:
                scope.shadows[node.id, "$runs"] = scope.values[node.id, "$runs"] = Value(guard, T.BooleanType())
        elif node.is_loop:
            own = [n for n in self.graph.order if n in self.graph.loop_bodies[node.id] and n in set(self.order)]
            writes = sorted({self._name_of(self.graph.nodes[m], scope) for m in self.graph._loop_members(node.id) if self.graph.nodes[m].type in ("core.var.set", "core.var.declare")})
            for k, t in self._field_types(node, own, scope, writes, self._condition_cone(node)).items():
                v = Value(F.lit(None).cast(t), t)
                if k[0] == "$var":
                    scope.variables[k[1]] = (v, v)
                else:
                    scope.shadows[k] = scope.values[k] = v
                    ports[k] = self.inner_types[k] = t
            v = Value(F.lit(0).cast("long"), T.LongType())
            scope.shadows[node.id, "index"] = scope.values[node.id, "index"] = v
            ports[node.id, "index"] = T.LongType()
        elif node.spec.style == "table":
            raise GraphError(f"'{node.id}' ({node.type}) cannot stand in a loop", "table_in_loop", node.id)
        elif node.spec.style == "call":
            call = self._type(node.spec.build(self._inputs(node, scope, True))(F.lit(True)), scope)
            for f in call.fields:
                if f.name in node.outputs:
                    self.inner_types[node.id, f.name] = ports[node.id, f.name] = f.dataType
                    scope.shadows[node.id, f.name] = scope.values[node.id, f.name] = _blank(f.dataType)
        elif node.spec.style != "control":
            for port, column in self._build(node, scope, True).items():
                t = self._type(column, scope)
                self.inner_types[node.id, port] = t
                scope.shadows[node.id, port] = scope.values[node.id, port] = _blank(t)
                ports[node.id, port] = t
                if node.type in ("core.var.set", "core.var.declare"):
                    name = self._name_of(node, scope)
                    before = scope.variables.get(name)
                    common = widest(before[1].type, t) if before else t
                    w = Value(F.lit(None).cast(common), common)
                    scope.variables[name] = (w, w)

    def _shadow_loop(self, node: Node, scope: Scope) -> None:
        self._shadow_node(node, scope, {})


def _blank(t: T.DataType) -> Value:
    return Value(F.lit(None).cast(t), t)


class _Pending(Value):
    """A variable whose node's column is about to be added to the frame."""

    def __init__(self, column: Column, key: tuple[str, str]):
        super().__init__(column, T.NullType())
        object.__setattr__(self, "key", key)

    key: tuple[str, str]


def compile_graph(payload: dict[str, Any] | Graph, source: DataFrame | None = None, spark: SparkSession | None = None, order: list[str] | None = None, seed: int = 0) -> Compiled:
    """A graph over a source (one row, where none is given). Columns of the source are read by the node core.source.column."""
    graph = payload if isinstance(payload, Graph) else Graph(payload)
    session = spark or (source.sparkSession if source is not None else SparkSession.getActiveSession())
    assert session is not None
    return Compiler(graph, source, session, order, seed).compile()
