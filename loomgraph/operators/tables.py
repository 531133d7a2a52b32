"""Nodes that tie graphs to tables: a column of the source row, and relational steps. Not in single-row graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import node, port
from .inputs import Inputs


@node("core.source.column", [port("name: string", required=True)], ["value"], category="Source")
def column(v: Inputs) -> Column:
    """A column of the row that the graph runs on."""
    return F.col("`" + str(v["name"].const) + "`")


@node("core.table.filter", [port("condition: boolean", True)], [], style="table", category="Table")
def where(frame: DataFrame, v: Inputs) -> DataFrame:
    """Keeps the rows whose condition holds."""
    from ..functions.exprs import truthy

    return frame.where(truthy(v["condition"]))


@node("core.table.explode", [port("array: list<any>")], ["item", "index: int"], style="table", category="Table")
def explode(frame: DataFrame, v: Inputs) -> DataFrame:
    """A row for each item of a list, with its index."""
    return frame.select("*", F.posexplode(v.array("array")[0]).alias("index", "item"))
