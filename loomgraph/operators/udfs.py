"""Node types from Python functions: a batch of rows at a time, rows into several rows, and aggregates of groups.

The ports that a node declares are the types of its function's arguments and results; Spark checks them. Functions get
and give Arrow arrays or pandas Series, never single rows, but for row functions, which give as many rows as they like.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import as_type, is_collecting
from ..registry import CONTROL, REGISTRY, NodeSpec, Port, Registry, port
from .inputs import Inputs


def _ports(names: Iterable[str | Port]) -> tuple[Port, ...]:
    return tuple(x if isinstance(x, Port) else port(x) for x in names)


def _argument(v: Inputs, p: Port) -> Column:
    t, x = p.type.spark(), v[p.name]
    return x.col if isinstance(t, T.VariantType) and x.type != t else F.lit(None).cast(t) if x.is_null else as_type(x, t).cast(t)


def _struct(outputs: tuple[Port, ...]) -> T.StructType:
    return T.StructType([T.StructField(p.name, p.type.spark()) for p in outputs])


def _add(registry: Registry, type: str, ins: tuple[Port, ...], outs: tuple[Port, ...], build: Callable[..., Any], doc: str | None, style: str, more: dict[str, Any]) -> None:
    control = Port("control_in", CONTROL), Port("control_out", CONTROL)
    registry.add(NodeSpec(type, (*ins, control[0]), (*outs, control[1]), build, style=style, description=(doc or "").strip().split("\n")[0], **more))


def _scattered(run: pa.Array, parts: dict[str, pa.Array], t: pa.StructType) -> pa.StructArray:
    """Values of the rows that run, null for the others."""
    at = np.cumsum(run.to_numpy(zero_copy_only=False)) - 1
    index = pa.array(at, mask=~run.to_numpy(zero_copy_only=False))
    return pa.StructArray.from_arrays([parts[f.name].cast(f.type).take(index) for f in t], fields=list(t))


def batch_node(type: str, inputs: Iterable[str | Port], outputs: Iterable[str | Port], *, pandas: bool = False, registry: Registry = REGISTRY, **more: Any):
    """Registers a function of as many Arrow arrays (pandas Series) as there are inputs, which gives one for the output, or a dict of
    them by output. It sees only rows whose guard holds; where errors are collected, a batch that fails is an error of its rows."""
    ins, outs = _ports(inputs), _ports(outputs)

    def wrap(f: Callable[..., Any]):
        def build(v: Inputs) -> Callable[[Column], Column]:
            collects, result = is_collecting(), _struct(outs)
            if collects:
                result = T.StructType([*result.fields, T.StructField("error", T.StringType())])
            arrow = pa.struct([pa.field(x.name, y) for x, y in zip(result.fields, _arrow_types(result))])

            def called(run: pa.Array, *columns: pa.Array) -> pa.Array:
                run = run.fill_null(False)
                some = [pc.filter(c, run) for c in columns]
                n = pc.sum(run).as_py() or 0
                empty = {x.name: pa.nulls(n, x.type) for x in arrow}
                if not n:
                    return _scattered(run, empty, arrow)
                try:
                    got = f(*(c.to_pandas() for c in some)) if pandas else f(*some)
                    got = got if isinstance(got, dict) else {outs[0].name: got}
                    parts = empty | {k: x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x if isinstance(x, pa.Array) else pa.array(x, arrow.field(k).type, from_pandas=True) for k, x in got.items()}
                except Exception as e:
                    if not collects:
                        raise
                    parts = empty | {"error": pa.array([str(e) or e.__class__.__name__] * n)}
                return _scattered(run, parts, arrow)

            called.__annotations__ = {"run": pa.Array, "columns": pa.Array, "return": pa.Array}
            call = F.arrow_udf(called, result)
            return lambda guard: call(guard, *(_argument(v, p) for p in ins))

        _add(registry, type, ins, outs, build, f.__doc__, "call", more)
        return f

    return wrap


def _arrow_types(t: T.StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in t.fields]


def rows_node(type: str, inputs: Iterable[str | Port], outputs: Iterable[str | Port], *, registry: Registry = REGISTRY, **more: Any):
    """Registers a function of one row's values that gives tuples, one for each row to make of it (none: the row goes)."""
    ins, outs = _ports(inputs), _ports(outputs)

    def wrap(f: Callable[..., Iterable[tuple]]):
        class Rows:
            def eval(self, *values: Any) -> Iterable[tuple]:
                yield from f(*values)

        def build(frame: DataFrame, v: Inputs) -> DataFrame:
            made = F.udtf(Rows, returnType=_struct(outs))  # type: ignore[call-overload]
            return frame.lateralJoin(made(*(_argument(v, p).outer() for p in ins)))

        _add(registry, type, ins, outs, build, f.__doc__, "table", more)
        return f

    return wrap


def aggregate_node(type: str, value: str | Port, output: str | Port, *, final: Callable[[pd.Series], Any] | None = None, registry: Registry = REGISTRY, **more: Any):
    """Registers an aggregate: the function gets a Series of a group's values and gives one; final does the same with such results.

    The node's inputs are key and the value, its outputs key and the result: of the table there is a row for each key from
    there on. Values are aggregated within each partition first, so that no task holds more of a key than a partition has.
    """
    into, out = _ports([value])[0], _ports([output])[0]

    def wrap(f: Callable[[pd.Series], Any]):
        last, t = final or f, out.type.spark()

        def build(frame: DataFrame, v: Inputs) -> DataFrame:
            def partial(values: pd.Series) -> float:
                return f(values)

            def total(values: pd.Series) -> float:
                return last(values)

            agg = lambda g: F.pandas_udf(g, t)
            rows = frame.select(v["key"].col.alias("key"), _argument(v, into).alias("value"), F.spark_partition_id().alias("part"))
            return rows.groupBy("key", "part").agg(agg(partial)("value").alias("value")).groupBy("key").agg(agg(total)("value").alias(out.name))

        _add(registry, type, (Port("key"), into), (Port("key"), out), build, f.__doc__, "table", more)
        return f

    return wrap
