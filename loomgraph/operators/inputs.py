"""What a column builder gets: the Values of its ports."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import Parsed, Value, constant, failing, is_variant, truthy


class Inputs:
    def __init__(self, values: dict[str, Value], node: Any = None, scope: Any = None):
        self.values, self.node, self.scope = values, node, scope

    def __getitem__(self, port: str) -> Value:
        """The port's Value; a null one where nothing feeds it and it has no default."""
        v = self.values.get(port)
        return v if v is not None else constant(None)

    def __contains__(self, port: str) -> bool:
        return port in self.values

    def const(self, port: str, default: Any = None) -> Any:
        """The port's value if the graph gives it (a falsy one is the default); else None."""
        v = self[port]
        if v.is_const:
            return v.const or default
        return None

    def linked(self, port: str) -> bool:
        return not self[port].is_const

    def array(self, port: str) -> tuple[Column, T.ArrayType]:
        """The port as an array; null and falsy parsed JSON count as empty, an unlinked port as an empty one of text; parsed lists are arrays of variants."""
        v = self[port]
        if v.is_null:
            t = T.ArrayType(T.StringType())
            return F.array().cast(t), t
        if is_variant(v.type):
            t, p = T.ArrayType(T.VariantType()), Parsed(v.col)
            items = failing(p.items.isNull() & truthy(v), F.concat(F.lit(f"port '{port}' takes a list, not "), F.to_json(v.col)), p.items)
            return F.coalesce(items, F.array().cast(t)), t
        if not isinstance(v.type, T.ArrayType):
            raise TypeError(f"port '{port}' takes a list, not {v.type.simpleString()}")
        return F.coalesce(v.col, F.array().cast(v.type)), v.type
