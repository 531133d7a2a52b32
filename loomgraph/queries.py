"""Queries over the driver's tables: each a graph (or an analysis of a table as if it were a trace), with its SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .flow import Flow, Ref, Step
from .functions.jsontext import json_rows
from .plans import edges, trace
from .plans.compiler import ERRORS
from .operators import udfs
from .plans.runtime import Engine
from .registry import REGISTRY, Registry
from .sources import clients, images, standins
from .sources.shared import shared_dir, written
from .sources.tables import side, table, write_sides
from .streaming.metrics import NODE_METRICS, Watched

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

KEYS = {"lineitem": ("l_orderkey", "l_linenumber"), "customer": ("c_custkey",), "part": ("p_partkey",), "orders": ("o_orderkey",), "events": ("event_id",), "documents": ("doc_id",), "embeddings": ("vec_id",)}


def graph(source: str, sql: str | None, *keep: str):
    """A query that runs the graph which the function builds over a table, with the table's keys among its outputs.

    sql: the SQL of the other outputs; keep: further columns to put out.
    """

    def wrap(build: Callable[[Flow], dict[str, Ref]]):
        columns = (*KEYS[source], *keep)

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            flow = Flow()
            named = build(flow)
            flow.keep(*columns).out(**named)
            return Engine(spark).table(flow.payload(), table(spark, sf_dir, source))

        QUERIES[build.__name__] = run
        if sql is not None:
            SQL[build.__name__] = f"SELECT {', '.join(columns)}, {sql} FROM {source}"
        return build

    return wrap


def direct(sql: str | None):
    """A query over DataFrames."""

    def wrap(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return wrap


REVENUE = "l_extendedprice * (1 - l_discount)"


@graph("lineitem", f"least(greatest({REVENUE}, 1000::double), 50000::double) AS revenue, CASE WHEN l_quantity > 24 THEN least(greatest({REVENUE}, 1000::double), 50000::double) * 0.9 ELSE least(greatest({REVENUE}, 1000::double), 50000::double) * 1.1::double END AS adjusted, l_quantity > 24 AS bulk")
def flagship_revenue(g: Flow) -> dict[str, Ref]:
    """Arithmetic, a clamp, and an if/else whose sides meet again."""
    net = g.node("core.math.subtract", a=1, b=g.col("l_discount"))
    revenue = g.node("core.math.clamp", value=g.node("core.math.multiply", a=g.col("l_extendedprice"), b=net.difference).product, min=1000, max=50000)
    bulk = g.node("core.logic.compare", a=g.col("l_quantity"), b=24, op=">")
    branch = g.node("core.control.ifelse", condition=bulk.result)
    yes = g.node("core.math.multiply", a=revenue.result, b=0.9)
    no = g.node("core.math.multiply", a=revenue.result, b=1.1)
    branch.then(yes, port="true")
    branch.then(no, port="false")
    return {"revenue": revenue.result, "adjusted": g.node("core.util.coalesce", a=yes.product, b=no.product).value, "bulk": bulk.result}


@graph("lineitem", "l_quantity + l_tax AS sum, l_extendedprice - l_tax AS difference, l_quantity * l_discount AS product, CASE WHEN l_tax = 0 THEN 0 ELSE l_quantity / l_tax END AS quotient, abs(l_tax - l_discount) AS gap")
def math_arithmetic(g: Flow) -> dict[str, Ref]:
    q, p, t, d = (g.col(c) for c in ("l_quantity", "l_extendedprice", "l_tax", "l_discount"))
    return {
        "sum": g.node("core.math.add", a=q, b=t).sum,
        "difference": g.node("core.math.subtract", a=p, b=t).difference,
        "product": g.node("core.math.multiply", a=q, b=d).product,
        "quotient": g.node("core.math.divide", a=q, b=t).quotient,
        "gap": g.node("core.math.abs", value=g.node("core.math.subtract", a=t, b=d).difference).result,
    }


@graph("lineitem", "round_even(l_extendedprice, 0) AS whole, round_even(l_extendedprice, 1) AS tenth, floor(l_extendedprice)::bigint AS low, ceil(l_extendedprice)::bigint AS high")
def math_rounding(g: Flow) -> dict[str, Ref]:
    p = g.col("l_extendedprice")
    return {"whole": g.node("core.math.round", value=p).result, "tenth": g.node("core.math.round", value=p, decimals=1).result, "low": g.node("core.math.floor", value=p).result, "high": g.node("core.math.ceil", value=p).result}


@graph("lineitem", "least(l_quantity, l_linenumber::double) AS low, greatest(l_quantity, l_linenumber::double) AS high, greatest(10::double, least(30::double, l_quantity)) AS clamped, l_quantity + (l_extendedprice - l_quantity) * 0.25::double AS blend")
def math_ranges(g: Flow) -> dict[str, Ref]:
    q, n = g.col("l_quantity"), g.col("l_linenumber")
    return {
        "low": g.node("core.math.min", a=q, b=n).result,
        "high": g.node("core.math.max", a=q, b=n).result,
        "clamped": g.node("core.math.clamp", value=q, min=10, max=30).result,
        "blend": g.node("core.math.lerp", a=q, b=g.col("l_extendedprice"), t=0.25).result,
    }


@graph("lineitem", "sin(l_quantity) AS sine, cos(l_quantity) AS cosine, degrees(l_quantity) AS deg, radians(l_quantity) AS rad")
def math_angles(g: Flow) -> dict[str, Ref]:
    q = g.col("l_quantity")
    return {"sine": g.node("core.math.sin", radians=q).result, "cosine": g.node("core.math.cos", radians=q).result, "deg": g.node("core.math.degrees", radians=q).degrees, "rad": g.node("core.math.radians", degrees=q).radians}


@graph("customer", "sqrt(greatest(0::double, c_acctbal)) AS root, CASE WHEN c_acctbal % 7 <> 0 AND c_acctbal < 0 THEN c_acctbal % 7 + 7 ELSE c_acctbal % 7 END AS remainder, pow(c_acctbal, 2::double) AS square")
def math_roots_and_remainders(g: Flow) -> dict[str, Ref]:
    a = g.col("c_acctbal")
    return {"root": g.node("core.math.sqrt", value=a).result, "remainder": g.node("core.math.mod", a=a, b=7).result, "square": g.node("core.math.power", base=a, exponent=2).result}


@graph("orders", "o_totalprice >= 100000 AS large, o_orderstatus IS NOT DISTINCT FROM 'F' AS filled, o_orderstatus IS DISTINCT FROM 'O' AS not_open, o_totalprice < 50000 AS small, false AS odd")
def logic_compare(g: Flow) -> dict[str, Ref]:
    p, s = g.col("o_totalprice"), g.col("o_orderstatus")
    c = lambda a, op, b: g.node("core.logic.compare", a=a, b=b, op=op).result
    return {"large": c(p, ">=", 100000), "filled": c(s, "==", "F"), "not_open": c(s, "!=", "O"), "small": c(p, "<", 50000), "odd": c(p, "~", 1)}


@graph("part", "(p_size > 10) AND (p_retailprice > 1000) AS both_hold, (p_size > 10) OR (p_retailprice > 1000) AS either_holds, NOT (p_size > 10) AS neither, (p_size <> 0) AND (p_name <> '') AS filled")
def logic_gates(g: Flow) -> dict[str, Ref]:
    a = g.node("core.logic.compare", a=g.col("p_size"), b=10, op=">").result
    b = g.node("core.logic.compare", a=g.col("p_retailprice"), b=1000, op=">").result
    return {"both_hold": g.node("core.logic.and", a=a, b=b).result, "either_holds": g.node("core.logic.or", a=a, b=b).result, "neither": g.node("core.logic.not", value=a).result, "filled": g.node("core.logic.and", a=g.col("p_size"), b=g.col("p_name")).result}


@graph("part", "upper(p_name) AS up, lower(p_brand) AS low, p_name || p_size::varchar AS joined, replace(p_type, ' ', '_') AS snake, p_name[3:5] AS piece, length(p_name) AS n")
def string_cases(g: Flow) -> dict[str, Ref]:
    n = g.col("p_name")
    return {
        "up": g.node("core.string.upper", text=n).result,
        "low": g.node("core.string.lower", text=g.col("p_brand")).result,
        "joined": g.node("core.string.concat", a=n, b=g.col("p_size")).result,
        "snake": g.node("core.string.replace", text=g.col("p_type"), find=" ", replace="_").result,
        "piece": g.node("core.string.substring", text=n, start=2, end=5).result,
        "n": g.node("core.container.length", value=n).length,
    }


@graph("documents", r"regexp_replace(text, '^\s+|\s+$', '', 'g') AS trimmed, contains(text, 'the') AS has, starts_with(text, 'The') AS begins, suffix(text, '.') AS ends, length(text) AS n")
def string_tests(g: Flow) -> dict[str, Ref]:
    t = g.col("text")
    return {
        "trimmed": g.node("core.string.trim", text=t).result,
        "has": g.node("core.string.contains", text=t, search="the").result,
        "begins": g.node("core.string.starts_with", text=t, prefix="The").result,
        "ends": g.node("core.string.ends_with", text=t, suffix=".").result,
        "n": g.node("core.container.length", value=t).length,
    }


@graph("documents", "string_split(text, ' ') AS parts, array_to_string(string_split(text, ' '), '|') AS piped")
def string_split_join(g: Flow) -> dict[str, Ref]:
    parts = g.node("core.string.split", text=g.col("text"), delimiter=" ").parts
    return {"parts": parts, "piped": g.node("core.string.join", array=parts, delimiter="|").result}


@graph("orders", "'order ' || o_orderkey::varchar || ' costs ' || printf('%.1f', round_even(o_totalprice, 1)) AS line, '{broken' AS kept")
def string_format(g: Flow) -> dict[str, Ref]:
    line = g.node("core.string.format", template="order {0} costs {1:.1f}", arg1=g.col("o_orderkey"), arg2=g.col("o_totalprice"))
    return {"line": line.result, "kept": g.node("core.string.format", template="{broken", arg1=g.col("o_orderkey")).result}


@graph("part", "CASE p_size % 4 WHEN 0 THEN p_name || ' has ' || printf('%.1f', round_even(p_retailprice, 1)) WHEN 1 THEN p_size || '/' || p_name || '/' || p_size WHEN 2 THEN '{' || p_name || '} {broken' ELSE '{} {0}' END AS line")
def string_templates(g: Flow) -> dict[str, Ref]:
    """Templates from a column, each filled as Python would."""
    n = lambda kind, **ports: g.node(kind, **ports)
    left = n("core.cast.to_int", value=n("core.math.mod", a=g.col("p_size"), b=4).result).value
    template = n("core.container.get_index", array=["{0} has {2:.1f}", "{1}/{0}/{1}", "{{{0}}} {{broken", "{} {0}"], index=left).value
    return {"line": n("core.string.format", template=template, arg1=g.col("p_name"), arg2=g.col("p_size"), arg3=g.col("p_retailprice")).result}


@graph("part", "coalesce(try_cast(p_name AS bigint), 0)::bigint AS from_text, trunc(p_retailprice)::bigint AS from_double, p_size::double AS from_int, p_size::varchar AS text, p_name IS NOT NULL AND p_name <> '' AS named, p_size <> 0 AS sized")
def casts(g: Flow) -> dict[str, Ref]:
    c = lambda kind, x: g.node(f"core.cast.to_{kind}", value=x).value
    return {"from_text": c("int", g.col("p_name")), "from_double": c("int", g.col("p_retailprice")), "from_int": c("float", g.col("p_size")), "text": c("string", g.col("p_size")), "named": c("boolean", g.col("p_name")), "sized": c("boolean", g.col("p_size"))}


@graph("embeddings", "embedding[1] AS first, embedding[-1] AS last, list_reverse(embedding) AS backwards, list_sort(embedding, 'DESC') AS ordered, embedding[3:6] AS middle, embedding[6] AS sixth")
def array_access(g: Flow) -> dict[str, Ref]:
    e = g.col("embedding")
    return {
        "first": g.node("core.array.first", array=e).value,
        "last": g.node("core.array.last", array=e).value,
        "backwards": g.node("core.array.reverse", array=e).result,
        "ordered": g.node("core.array.sort", array=e, descending=True).result,
        "middle": g.node("core.array.slice", array=e, start=2, end=6).result,
        "sixth": g.node("core.container.get_index", array=e, index=5).value,
    }


@graph("embeddings", "list_sum(embedding::double[]) AS total, list_avg(embedding::double[]) AS mean, len(embedding) AS n")
def array_sums(g: Flow) -> dict[str, Ref]:
    e = g.col("embedding")
    return {"total": g.node("core.array.sum", array=e).result, "mean": g.node("core.array.average", array=e).result, "n": g.node("core.container.length", value=e).length}


@graph("part", "list_contains(string_split(p_type, ' '), 'STEEL') AS steel, coalesce(list_position(string_split(p_type, ' '), 'STEEL'), 0)::bigint - 1 AS place, [p_size, p_partkey] AS pair, list_append(string_split(p_type, ' '), p_brand) AS more, generate_series(0, p_size::bigint, 5) AS steps")
def array_building(g: Flow) -> dict[str, Ref]:
    words = g.node("core.string.split", text=g.col("p_type"), delimiter=" ").parts
    return {
        "steel": g.node("core.array.contains", array=words, value="STEEL").result,
        "place": g.node("core.array.index_of", array=words, value="STEEL").index,
        "pair": g.node("core.container.make_array", item_0=g.col("p_size"), item_1=g.col("p_partkey")).array,
        "more": g.node("core.container.append", array=words, value=g.col("p_brand")).array,
        "steps": g.node("core.container.range", start=0, end=g.col("p_size"), step=5).array,
    }


@graph("events", "coalesce(map {'click': 1, 'error': 2, 'purchase': 3}[event_type], 0)::bigint AS code, (props->>'$.k')::bigint AS k, json_valid(props) AS ok")
def maps_and_json(g: Flow) -> dict[str, Ref]:
    codes = {"click": 1, "error": 2, "purchase": 3}
    parsed = g.node("core.json.parse", json_string=g.col("props"))
    return {"code": g.node("core.container.get", map=codes, key=g.col("event_type"), default=0).value, "k": g.node("core.cast.to_int", value=g.node("core.container.get", map=parsed.data, key="k").value).value, "ok": parsed.success}


@graph(
    "events",
    "CASE WHEN event_type = 'click' THEN props->>'$.k' ELSE '-1' END AS k, length(props->>'$.k')::bigint AS n_text, 1::bigint AS n_keys, (props->>'$.k')::bigint = 7 AS is_seven, (props->>'$.k')::bigint <> 0 AS truth, props->>'$.k' = (props->>'$.k')::bigint::varchar AS alike,"
    " CASE event_type WHEN 'click' THEN '1' WHEN 'error' THEN 'two' ELSE 'none' END AS unlike",
)
def parsed_json(g: Flow) -> dict[str, Ref]:
    """Parsed JSON as a value: read by a key from a column, its length, truth and equality."""
    parsed = g.node("core.json.parse", json_string=g.col("props")).data
    name = g.node("core.string.replace", text=g.col("event_type"), find="click", replace="k").result
    get = lambda **ports: g.node("core.container.get", **ports).value
    text = lambda x: g.node("core.cast.to_string", value=x).value
    same = lambda a, b: g.node("core.logic.compare", a=a, b=b, op="==").result
    k = get(map=parsed, key="k")
    return {
        "k": text(get(map=parsed, key=name, default="-1")),
        "n_text": g.node("core.container.length", value=text(k)).length,
        "n_keys": g.node("core.container.length", value=parsed).length,
        "is_seven": same(k, 7),
        "truth": g.node("core.logic.or", a=k, b=False).result,
        "alike": same(text(k), text(g.node("core.cast.to_int", value=k).value)),
        "unlike": text(get(map={"click": 1, "error": "two"}, key=g.col("event_type"), default="none")),
    }


_K = "(props->>'$.k')::bigint"


@graph(
    "events",
    f"{_K} * 2::double AS twice, {_K} * 0.5::double AS half, {_K} > 50 AS large, greatest({_K}, 50)::double AS most, 'int' AS kind, (event_id + {_K} + 2.5)::double AS total, 4::bigint AS n,"
    f" CASE WHEN event_id < {_K} THEN '[' || event_id || ', 2.5, ' || {_K} || ']' ELSE '[' || {_K} || ', 2.5, ' || event_id || ']' END AS pair, CASE WHEN {_K} % 2 = 0 THEN 'even' ELSE {_K}::varchar END AS either, '{{\"k\": ' || {_K} || '}}' AS back",
)
def parsed_json_arithmetic(g: Flow) -> dict[str, Ref]:
    """Objects in objects and lists of parsed JSON, parsed once and used as the values they hold."""
    n = lambda kind, port, **ports: g.node(kind, **ports)[port]
    text = n("core.string.format", "result", template='{{"p": {}, "l": [{}, 2.5, "x"]}}', arg1=g.col("props"), arg2=g.col("event_id"))
    get = lambda m, key: n("core.container.get", "value", map=m, key=key)
    parsed = g.node("core.json.parse", json_string=text).data
    inner = get(parsed, "p")
    k, items = get(inner, "k"), get(parsed, "l")
    more = n("core.container.append", "array", array=items, value=k)
    # the two numbers around 2.5, in order: the greater of them at the end
    low, high = n("core.math.min", "result", a=k, b=g.col("event_id")), n("core.math.max", "result", a=k, b=g.col("event_id"))
    whole = lambda x: n("core.cast.to_int", "value", value=x)
    even = n("core.logic.compare", "result", a=n("core.math.mod", "result", a=k, b=2), b=0)
    branch = g.node("core.control.ifelse", condition=even)
    yes, no = g.node("core.util.passthrough", value="even"), g.node("core.util.passthrough", value=k)
    branch.then(yes, port="true")
    branch.then(no, port="false")
    return {
        "twice": n("core.cast.to_float", "value", value=n("core.math.add", "sum", a=k, b=k)),
        "half": n("core.math.multiply", "product", a=k, b=0.5),
        "large": n("core.logic.compare", "result", a=k, b=50, op=">"),
        "most": n("core.math.max", "result", a=k, b=50),
        "kind": n("core.util.typeof", "type_name", value=k),
        "total": n("core.array.sum", "result", array=more),
        "n": n("core.container.length", "length", value=more),
        "pair": n("core.cast.to_string", "value", value=n("core.container.make_array", "array", item_0=whole(low), item_1=n("core.container.get_index", "value", array=items, index=1), item_2=whole(high))),
        "either": n("core.cast.to_string", "value", value=n("core.util.coalesce", "value", a=yes.value, b=no.value)),
        "back": n("core.json.stringify", "json_string", data=inner),
    }


@graph("events", "CASE WHEN value IS NULL THEN 'NoneType' ELSE 'float' END AS kind, value IS NULL AS missing, coalesce(value, 0)::double AS filled, value AS same, 'Main' AS section, event_type AS shown")
def nulls_and_display(g: Flow) -> dict[str, Ref]:
    v = g.col("value")
    shown = g.node("general.to_display", title="Events", value=g.col("event_type"))
    return {"kind": g.node("core.util.typeof", value=v).type_name, "missing": g.node("core.util.is_null", value=v).is_null, "filled": g.node("core.util.coalesce", a=v, b=0.0).value, "same": g.node("core.util.passthrough", value=v).value, "section": shown.section, "shown": shown.value}


@graph("lineitem", "1::bigint AS one, 0.5::double AS half, 'x' AS x, true AS yes")
def literals(g: Flow) -> dict[str, Ref]:
    lit = lambda kind, v: g.node(f"core.literal.{kind}", value=v).value
    return {"one": lit("int", 1), "half": lit("float", 0.5), "x": lit("string", "x"), "yes": lit("boolean", True)}


@graph("lineitem", "CASE WHEN l_quantity > 24 THEN l_quantity * 2 END AS on_true, CASE WHEN NOT l_quantity > 24 THEN l_quantity + 1 END AS on_false, l_tax + 1 AS always")
def control_ifelse(g: Flow) -> dict[str, Ref]:
    """Nodes of the side not taken are skipped; what both sides reach always runs."""
    q = g.col("l_quantity")
    branch = g.node("core.control.ifelse", condition=g.node("core.logic.compare", a=q, b=24, op=">").result)
    yes, no, after = g.node("core.math.multiply", a=q, b=2), g.node("core.math.add", a=q, b=1), g.node("core.math.add", a=g.col("l_tax"), b=1)
    branch.then(yes, after, port="true")
    branch.then(no, after, port="false")
    return {"on_true": yes.product, "on_false": no.sum, "always": after.sum}


@graph("part", "(p_size * (p_size + 1) // 2)::double AS total, p_size::bigint AS last")
def control_for_fold(g: Flow) -> dict[str, Ref]:
    """A variable carried through a loop: 1 + 2 + ... + p_size."""
    start = g.node("core.var.declare", name="total", value=0)
    loop = g.node("core.control.for", first_index=1, last_index=g.col("p_size"))
    held = g.node("core.var.get", name="total")
    more = g.node("core.math.add", a=held.value, b=loop.index)
    put = g.node("core.var.set", name="total", value=more.sum)
    after = g.node("core.var.get", name="total")
    start.then(loop)
    loop.then(held, more, put, port="loop_body")
    loop.then(after, port="completed")
    return {"total": after.value, "last": loop.index}


@graph("orders", "greatest(o_orderkey % 4 - 1, 0)::bigint AS last_index, CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 4 - 1) * 10::double END AS last_value")
def control_repeat(g: Flow) -> dict[str, Ref]:
    """A loop without memory: only its last round can be seen, none for a count of 0."""
    count = g.node("core.cast.to_int", value=g.node("core.math.mod", a=g.col("o_orderkey"), b=4).result)
    loop = g.node("core.control.repeat", count=count.value)
    body = g.node("core.math.multiply", a=loop.index, b=10)
    loop.then(body, port="loop_body")
    return {"last_index": loop.index, "last_value": body.product}


@graph("part", "(p_size * pow(2, greatest(0, ceil(log2(1000.0 / p_size)))))::double AS value, (greatest(1, ceil(log2(1000.0 / p_size))) - 1)::bigint AS last_index")
def control_while(g: Flow) -> dict[str, Ref]:
    """Doubling until 1000 is reached: the condition reads a variable and is computed anew each round."""
    start = g.node("core.var.declare", name="v", value=g.col("p_size"))
    seen = g.node("core.var.get", name="v")
    loop = g.node("core.control.while", condition=g.node("core.logic.compare", a=seen.value, b=1000, op="<").result)
    held = g.node("core.var.get", name="v")
    double = g.node("core.math.multiply", a=held.value, b=2)
    put = g.node("core.var.set", name="v", value=double.product)
    after = g.node("core.var.get", name="v")
    start.then(seen)
    loop.then(held, double, put, port="loop_body")
    loop.then(after, port="completed")
    return {"value": after.value, "last_index": loop.index}


@graph("part", "(p_size * 3 * 6)::double AS total")
def control_nested(g: Flow) -> dict[str, Ref]:
    """A loop in a loop, one variable through both: three rounds of 1, 2, 3 times p_size."""
    start = g.node("core.var.declare", name="t", value=0)
    outer = g.node("core.control.repeat", count=3)
    inner = g.node("core.control.for", first_index=1, last_index=3)
    held = g.node("core.var.get", name="t")
    times = g.node("core.math.multiply", a=inner.index, b=g.col("p_size"))
    more = g.node("core.math.add", a=held.value, b=times.product)
    put = g.node("core.var.set", name="t", value=more.sum)
    after = g.node("core.var.get", name="t")
    start.then(outer)
    outer.then(inner, port="loop_body")
    inner.then(held, times, more, put, port="loop_body")
    outer.then(after, port="completed")
    return {"total": after.value}


@direct("SELECT o_orderkey, i::bigint AS index, o_orderkey * i AS product FROM orders, unnest(generate_series(0, o_orderkey % 3)) AS t(i)")
def control_loop_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every round of a loop as a row of its own: the sequence exploded, the body once over all rows."""
    g = Flow()
    end = g.node("core.cast.to_int", value=g.node("core.math.mod", a=g.col("o_orderkey"), b=3).result)
    rounds = g.node("core.table.explode", array=g.node("core.container.range", start=0, end=end.value).array)
    g.keep("o_orderkey").out(index=rounds.item, product=g.node("core.cast.to_int", value=g.node("core.math.multiply", a=g.col("o_orderkey"), b=rounds.item).product).value)
    return Engine(spark).table(g.payload(), table(spark, sf_dir, "orders"))


@direct("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_shipdate >= TIMESTAMP '1995-01-01'")
def table_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A condition of a graph as a filter, which reaches the scan."""
    g = Flow()
    g.node("core.table.filter", condition=g.node("core.logic.compare", a=g.col("l_quantity"), b=45, op=">").result)
    g.keep("l_orderkey", "l_linenumber", "l_quantity")
    return Engine(spark).table(g.payload(), table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp '1995-01-01'"))


@direct("SELECT 8::double AS sum")
def single_row_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of literals alone: one row."""
    g = Flow()
    lit = lambda v: g.node("core.literal.int", value=v).value
    g.out(sum=g.node("core.math.add", a=lit(5), b=lit(3)).sum)
    return Engine(spark).table(g.payload())


@direct("SELECT l_orderkey, l_linenumber, l_quantity * 2 AS doubled FROM lineitem")
def partial_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only a node and what it depends on: the rest of the graph is not compiled."""
    g = Flow()
    two = g.node("core.math.multiply", a=g.col("l_quantity"), b=2, id="two")
    g.node("core.math.divide", a=two.product, b=g.col("l_tax"), id="unused")
    g.keep("l_orderkey", "l_linenumber").out(doubled=two.product)
    targets = ["two", *(o["node_id"] for o in g.outputs)]
    return Engine(spark).table(g.payload(), table(spark, sf_dir, "lineitem"), {"mode": "selection", "target_nodes": targets})


@direct("SELECT l_orderkey, l_linenumber, l_quantity * 2 + l_tax AS more FROM lineitem")
def partial_run_from_a_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node with all that hangs on it and what these need besides; nodes beside them, which would fail, are not compiled."""
    g = Flow()
    two = g.node("core.math.multiply", a=g.col("l_quantity"), b=2, id="two")
    more = g.node("core.math.add", a=two.product, b=g.col("l_tax"), id="more")
    g.node("core.math.sqrt", value=g.node("core.util.passthrough", value="no number").value, id="beside")
    g.keep("l_orderkey", "l_linenumber").out(more=more.sum)
    entries = ["two", *(o["node_id"] for o in g.outputs if o["alias"] != "more")]
    return Engine(spark).table(g.payload(), table(spark, sf_dir, "lineitem"), {"mode": "from_nodes", "entry_nodes": entries})


@direct("SELECT l_orderkey, l_linenumber, l_quantity * 2 AS two FROM lineitem")
def stopped_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that ends before a breakpoint: what comes after it, which would fail, has no output."""
    g = Flow()
    g.keep("l_orderkey", "l_linenumber")
    two = g.node("core.math.multiply", a=g.col("l_quantity"), b=2, id="two")
    bad = g.node("core.math.sqrt", value=g.node("core.util.passthrough", value="no number").value, id="bad")
    g.out(two=two.product, bad=bad.result)
    return Engine(spark).table(g.payload(), table(spark, sf_dir, "lineitem"), {"breakpoints": ["bad"]})


@direct(None)
def random_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded: the same in every run over the same partitions."""
    g = Flow()
    words = g.node("core.string.split", text=g.col("p_type"), delimiter=" ").parts
    pick = g.node("core.random.choice", array=words)
    g.keep("p_partkey").out(f=g.node("core.random.float", min=1, max=2).value, i=g.node("core.random.int", min=1, max=6).value, b=g.node("core.random.boolean", probability=0.25).value, word=pick.value, at=pick.index, now=g.node("core.time.now").timestamp, later=g.node("core.time.delay", passthrough=g.col("p_size")).passthrough)
    return Engine(spark).table(g.payload(), table(spark, sf_dir, "part"), {"seed": 7})


@graph("part", "true AS f_fits, true AS i_fits, true AS at_fits, true AS word_fits, p_size AS later, true AS now_fits")
def random_ranges(g: Flow) -> dict[str, Ref]:
    """What is certain of random values, of a choice, of the time and of a delay."""
    less = lambda a, b: g.node("core.logic.compare", a=a, b=b, op="<=").result
    within = lambda x, low, high: g.node("core.logic.and", a=less(low, x), b=less(x, high)).result
    words = g.node("core.string.split", text=g.col("p_type"), delimiter=" ").parts
    pick = g.node("core.random.choice", array=words)
    return {
        "f_fits": within(g.node("core.random.float", min=1, max=2).value, 1.0, 2.0),
        "i_fits": within(g.node("core.random.int", min=1, max=6).value, 1, 6),
        "at_fits": within(pick.index, 0, g.node("core.container.length", value=words).length),
        "word_fits": g.node("core.array.contains", array=words, value=pick.value).result,
        "later": g.node("core.time.delay", passthrough=g.col("p_size")).passthrough,
        "now_fits": less(1.7e9, g.node("core.time.now").timestamp),
    }


@graph("part", """'"' || p_name || '"' AS name, '["' || p_brand || '", "' || p_type || '"]' AS kinds, p_size::varchar AS size, '{"size": ' || p_size || ', "brand": 1}' AS record, 'null' AS nothing, true::varchar AS yes, '[' || p_size || ']' AS back""")
def json_written(g: Flow) -> dict[str, Ref]:
    """JSON texts of each kind of value, and of parsed JSON."""
    text = lambda x: g.node("core.json.stringify", data=x).json_string
    pair = g.node("core.container.make_array", item_1=g.col("p_brand"), item_2=g.col("p_type")).array
    listed = g.node("core.string.format", template="[{}]", arg1=g.col("p_size")).result
    return {
        "name": text(g.col("p_name")),
        "kinds": text(pair),
        "size": text(g.col("p_size")),
        "record": g.node("core.string.replace", text=text({"size": 12345, "brand": 1}), find="12345", replace=g.node("core.cast.to_string", value=g.col("p_size")).value).result,
        "nothing": text(None),
        "yes": text(True),
        "back": text(g.node("core.json.parse", json_string=listed).data),
    }


@direct(
    """SELECT '{"o_orderkey": ' || o_orderkey || ', "o_totalprice": ' || o_totalprice || ', "o_orderdate": "' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '", "status": ["' || o_orderstatus || '", null, true], "who": {"priority": "' || o_orderpriority || '", "caf\\u00e9": NaN}}' AS json FROM orders"""
)
def outputs_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a graph puts out, each row as the JSON object that clients are sent."""
    g = Flow()
    listed = g.node("core.container.make_array", item_0=g.col("o_orderstatus"), item_1=None, item_2=True).array
    g.keep("o_orderkey", "o_totalprice", "o_orderdate").out(status=listed, who=g.col("who"))
    who = F.struct(F.col("o_orderpriority").alias("priority"), F.lit(float("nan")).alias("café"))
    return json_rows(Engine(spark).table(g.payload(), table(spark, sf_dir, "orders").withColumn("who", who)))


@direct("SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice, l_quantity * 2 * 5 AS further FROM lineitem")
def cached_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node whose result is kept: a later run with another graph behind it reads what the first one kept, and computes the rest anew."""
    engine, source = Engine(spark), table(spark, sf_dir, "lineitem")

    def run(factor: int) -> DataFrame:
        g = Flow()
        twice = g.node("core.math.multiply", id="twice", cached=True, a=g.col("l_quantity"), b=2)
        g.keep("l_orderkey", "l_linenumber").out(twice=twice.product, further=g.node("core.math.multiply", a=twice.product, b=factor).product)
        return engine.table(g.payload(), source)

    run(3).write.format("noop").mode("overwrite").save()
    return run(5)


@graph("part", "p_size * 2::double AS doubled, p_size::double + 1 AS more")
def control_start(g: Flow) -> dict[str, Ref]:
    """A run that begins at its start node; the rest hangs on it by control links."""
    start = g.node("core.control.start")
    put = g.node("core.var.set", name="v", value=g.node("core.math.multiply", a=g.col("p_size"), b=2).product)
    got = g.node("core.var.get", name="v")
    more = g.node("core.math.add", a=g.col("p_size"), b=1.0)
    start.then(put, got, more)
    return {"doubled": got.value, "more": more.sum}


def _plugins() -> Registry:
    """The node types with some of a plugin's: a function of batches, one that makes rows, an aggregate."""
    r = Registry(dict(REGISTRY.specs))

    @udfs.batch_node("plugin.initials", ["text: string"], ["first: string", "n: int"], registry=r)
    def initials(text: pa.Array) -> dict[str, pa.Array]:
        return {"first": pc.utf8_slice_codeunits(text, 0, 1), "n": pc.utf8_length(text)}

    @udfs.rows_node("plugin.words", ["text: string"], ["word: string", "at: int"], registry=r)
    def words(text: str | None) -> Iterator[tuple[str, int]]:
        yield from ((w, k) for k, w in enumerate((text or "").split(" ")))

    @udfs.aggregate_node("plugin.total", "value: float", "total: float", registry=r)
    def total(values: pd.Series) -> float:
        return float(values.sum())

    return r


@direct("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name[1] END AS first, CASE WHEN p_size > 25 THEN length(p_name)::bigint END AS n, word, k::bigint AS at FROM (SELECT *, unnest(string_split(p_brand || ' ' || p_type, ' ')) AS word, unnest(range(len(string_split(p_brand || ' ' || p_type, ' ')))) AS k FROM part)")
def plugin_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plugin's function over batches, which rows that an if/else leaves out do not reach, and one that makes rows of each row."""
    g = Flow()
    branch = g.node("core.control.ifelse", condition=g.node("core.logic.compare", a=g.col("p_size"), b=25, op=">").result)
    start = g.node("plugin.initials", text=g.col("p_name"))
    branch.then(start, port="true")
    word = g.node("plugin.words", text=g.node("core.string.format", template="{} {}", arg1=g.col("p_brand"), arg2=g.col("p_type")).result)
    g.keep("p_partkey").out(first=start.first, n=start.n, word=word.word, at=word.at)
    return Engine(spark, _plugins()).table(g.payload(), table(spark, sf_dir, "part"))


@direct("SELECT l_returnflag AS flag, sum(l_quantity) AS total FROM lineitem GROUP BY 1")
def plugin_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plugin's aggregate of groups, partition by partition first."""
    g = Flow()
    total = g.node("plugin.total", key=g.col("l_returnflag"), value=g.col("l_quantity"))
    g.out(flag=total.key, total=total.total)
    return Engine(spark, _plugins()).table(g.payload(), table(spark, sf_dir, "lineitem"))


@direct("SELECT o_orderkey, o_totalprice > 100000 AS large, CASE WHEN o_totalprice > 100000 THEN o_totalprice * 2 END AS doubled, CASE WHEN o_totalprice > 100000 THEN NULL ELSE o_totalprice / 2 END AS halved FROM orders")
def branch_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of an if/else written to sinks of their own in one pass, and read back."""
    g = Flow()
    large = g.node("core.logic.compare", a=g.col("o_totalprice"), b=100000, op=">").result
    branch = g.node("core.control.ifelse", condition=large)
    yes, no = g.node("core.math.multiply", a=g.col("o_totalprice"), b=2), g.node("core.math.divide", a=g.col("o_totalprice"), b=2)
    branch.then(yes, port="true")
    branch.then(no, port="false")
    g.keep("o_orderkey").out(large=large, doubled=yes.product, halved=no.quotient)
    path = shared_dir(spark, "sides")
    write_sides(Engine(spark).table(g.payload(), table(spark, sf_dir, "orders")), F.col("large"), path, ("o_orderkey", "large", "doubled"), ("o_orderkey", "large", "halved"))
    true, false = side(spark, path, True, ("o_orderkey", "large", "doubled")), side(spark, path, False, ("o_orderkey", "large", "halved"))
    return true.unionByName(false, allowMissingColumns=True)


@direct("SELECT p_partkey, p_size % 5 <> 2 AND (p_size % 4 <> 1 OR p_size % 5 < 2) AS fits FROM part")
def catalog_compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of many nested types a list of records with an int in it fits: the types as rows of their places."""
    inner = F.element_at(F.array(*(F.lit(x) for x in ('"int"', '"float"', '"string"', '{"kind": "any"}', '"unknown"'))), F.col("p_size") % 5 + 1)
    extra = F.when((F.col("p_size") % 4 == 1) & (F.col("p_size") % 5 >= 2), ', "b": "string"').otherwise("")
    target = F.concat(F.lit('{"kind": "list", "item": {"kind": "record", "fields": {"a": '), inner, extra, F.lit("}}}"))
    ports = trace.with_type_rows(table(spark, sf_dir, "part").select("p_partkey", target.alias("t")), "t")
    source = trace.type_rows({"kind": "list", "item": {"kind": "record", "fields": {"a": "int"}}})
    given = spark.createDataFrame([(source,)], f"source {trace.TYPE_ROWS}")
    return ports.join(F.broadcast(given)).select("p_partkey", trace.accepts(F.col("rows"), F.col("source")).alias("fits"))


def _offline(source: str, build: Callable[[Flow], dict[str, Ref]], spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph whose calls go to the stand-ins, over a table."""
    flow = Flow()
    flow.keep(*KEYS[source]).out(**build(flow))
    with clients.using(files=standins.Files, rest=standins.Service, cameras=standins.Cameras):
        return Engine(spark).table(flow.payload(), table(spark, sf_dir, source))


@direct("SELECT p_partkey, 'data:image/png;base64,' || base64(encode(p_name || '.png')) AS image, true AS saved, p_name || '.png' AS path FROM part")
def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build(g: Flow) -> dict[str, Ref]:
        path = g.node("core.string.concat", a=g.col("p_name"), b=".png").result
        image = g.node("core.image.load", file_path=path).image
        saved = g.node("core.image.save", image=image, file_path=path)
        return {"image": image, "saved": saved.saved, "path": saved.file_path}

    return _offline("part", build, spark, sf_dir)


@direct("SELECT s_suppkey, true AS saved, 'data:image/png;base64,' || base64(encode(s_name)) AS image, strlen(s_name)::bigint AS n_bytes FROM supplier")
def image_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images saved as files of the shared folder, each by the task that has its row, and loaded again by path and as a folder."""
    folder = shared_dir(spark, "images")
    g = Flow()
    path = g.node("core.string.format", template=f"{folder}/{{}}.png", arg1=g.col("s_suppkey")).result
    saved = g.node("core.image.save", image=g.node("core.string.concat", a="data:image/png;base64,", b=g.col("raw")).result, file_path=path)
    g.keep("s_suppkey").out(saved=saved.saved, path=saved.file_path)
    suppliers = table(spark, sf_dir, "supplier").withColumn("raw", F.base64(F.col("s_name").cast("binary")))
    done = written(Engine(spark).table(g.payload(), suppliers), "saved-images")
    g = Flow()
    g.keep("s_suppkey", "saved").out(image=g.node("core.image.load", file_path=g.col("path")).image)
    loaded = Engine(spark).table(g.payload(), done)
    sizes = images.load_images(spark, folder).select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long").alias("s_suppkey"), F.col("n_bytes").cast("long").alias("n_bytes"))
    return loaded.join(sizes, "s_suppkey")


@direct(
    "SELECT p_partkey, 'http://camera.example/' || c || '.m3u8' AS url, 640::bigint AS width, 'camera-' || c AS stream_id,"
    " 'camera-' || c || '|http://camera.example/' || c || '.m3u8|' || p_size || '|' || greatest(10, p_size * 2) AS stream, true AS stopped, p_size % 2 = 0 AS has_frame, CASE WHEN p_size % 2 = 0 THEN p_name END AS image, p_size::double AS at FROM (SELECT *, CASE p_partkey WHEN 0 THEN 2130 ELSE p_partkey END AS c FROM part)"
)
def camera_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = Flow()
    key = flow.col("p_partkey")
    url = flow.node("camera.get_stream_url", camera=key)
    stream = flow.node("camera.connect", camera=key, fps=flow.col("p_size"), buffer_seconds=2)
    frame = flow.node("camera.get_frame", stream=flow.col("frame"), require_frame=False)
    stopped = flow.node("camera.disconnect", stream=stream.stream).stopped
    flow.keep("p_partkey").out(url=url.url, width=url.width, stream_id=stream.stream_id, stream=stream.stream, stopped=stopped, has_frame=frame.has_frame, image=frame.image, at=frame.timestamp)
    frames = F.struct(F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("image"), F.col("p_size").cast("double").alias("timestamp"), F.lit(640).alias("width"), F.lit(360).alias("height"))
    with clients.using(cameras=standins.Cameras):
        return Engine(spark).table(flow.payload(), table(spark, sf_dir, "part").withColumn("frame", frames))


@direct(
    "SELECT p_partkey, 'session-' || p_brand AS session, 'session-' || p_brand || '-' || p_type AS prompted, length(p_name)::bigint AS frame, length(p_name)::double AS edge, 1 / (1 + length(p_name))::double AS score,"
    " 'data:image/png;base64,' || base64(encode('session-' || p_brand || '-' || p_type)) AS shown, true AS alive, false AS down, true AS ended FROM part"
)
def segmentation_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build(g: Flow) -> dict[str, Ref]:
        session = g.node("segment.connect", model_type=g.col("p_brand"))
        prompted = g.node("segment.set_prompt", session_id=session.session_id, prompt=g.col("p_type"))
        added = g.node("segment.add_image", session_id=prompted.session_id, image=g.col("p_name"))
        found = g.node("segment.get_output", session_id=added.session_id, frame_idx=added.frame_idx)
        edge = g.node("core.array.last", array=g.node("core.array.first", array=found.boxes).value).value
        score = g.node("core.array.sum", array=found.scores).result
        shown = g.node("segment.visualize", session_id=found.session_id, frame_idx=added.frame_idx)
        alive = g.node("segment.is_alive", session_id=session.session_id)
        down = g.node("segment.is_alive", session_id=session.session_id, server_url="http://down.example")
        ended = g.node("segment.disconnect", session_id=shown.session_id)
        return {"session": session.session_id, "prompted": prompted.session_id, "frame": added.frame_idx, "edge": edge, "score": score, "shown": shown.image, "alive": alive.alive, "down": down.alive, "ended": ended.disconnected}

    return _offline("part", build, spark, sf_dir)


_SIZES = "(SELECT p_partkey, p_brand, i, (p_size * i) % 7 AS x FROM part, unnest(generate_series(1, 4)) AS t(i))"


@direct(f"SELECT p_partkey, sum(x) FILTER (x <> 3)::double AS total, last(x ORDER BY i) FILTER (x <> 3)::double AS value, 4::bigint AS last, CASE WHEN count(*) FILTER (x = 3) > 0 THEN 'could not convert string to float: x' END AS error FROM {_SIZES} GROUP BY p_partkey")
def loop_row_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A loop in which a node fails for some rows in some rounds: these rounds end there, the others and all other rows go on."""
    g = Flow()
    start = g.node("core.var.declare", name="total", value=0)
    loop = g.node("core.control.for", first_index=1, last_index=4)
    times = g.node("core.math.multiply", a=g.col("p_size"), b=loop.index)
    left = g.node("core.cast.to_int", value=g.node("core.math.mod", id="mod", a=times.product, b=7).result)
    text = g.node("core.string.replace", text=g.node("core.cast.to_string", id="text", value=left.value).value, find="3", replace="x")
    kept = g.node("core.util.passthrough", value=text.result)
    value = g.node("core.math.max", id="value", a=kept.value, b=-1)
    held = g.node("core.var.get", name="total")
    more = g.node("core.math.add", a=held.value, b=value.result)
    put = g.node("core.var.set", name="total", value=more.sum)
    after = g.node("core.var.get", name="total")
    step = lambda id: Step(g, id)
    start.then(loop)
    loop.then(times, step("mod"), left, step("text"), text, kept, value, held, more, put, port="loop_body")
    loop.then(after, port="completed")
    g.keep("p_partkey").out(total=after.value, value=value.result, last=loop.index)
    # a part is a few bytes in its file and long work in the loop: dealt to all cores, not by bytes read
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(spark.sparkContext.defaultParallelism, "p_partkey")
    out = Engine(spark).table(g.payload(), parts, {"on_error": "collect"})
    return out.select("p_partkey", "total", "value", "last", F.col(ERRORS)["value"].alias("error"))


@direct("SELECT p_partkey, list_transform(range(p_size % 4), lambda i: '[' || p_brand || '] ' || i) AS lines, CASE WHEN p_size % 4 = 0 THEN 0 ELSE p_size % 4 - 1 END::bigint AS last FROM part")
def loop_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a node in a loop logs, one a round."""
    g = Flow()
    loop = g.node("core.control.repeat", count=g.node("core.cast.to_int", value=g.node("core.math.mod", a=g.col("p_size"), b=4).result).value)
    loop.then(g.node("core.debug.log", id="line", value=loop.index, label=g.col("p_brand")), port="loop_body")
    g.keep("p_partkey").out(last=loop.index)
    engine = Engine(spark)
    run = engine.compile(g.payload(), table(spark, sf_dir, "part"))
    engine.forget(run)
    return run.compiled.frame.select("p_partkey", F.col(f"`{run.compiled.logs['line']}`").alias("lines"), F.col(f"`{run.compiled.columns[loop.id, 'index']}`").alias("last"))


@direct("SELECT p_partkey, string_agg(p_brand || '-' || i, ';' ORDER BY i) || ';' AS prompted, max(i)::bigint AS last FROM (SELECT p_partkey, p_brand, unnest(generate_series(1, 1 + p_size % 3)) AS i FROM part) GROUP BY p_partkey")
def loop_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A service called in each round of a loop, as often as each row has it; what it answers is carried on in a variable."""

    def build(g: Flow) -> dict[str, Ref]:
        start = g.node("core.var.declare", name="said", value="")
        count = g.node("core.math.add", a=g.node("core.math.mod", a=g.col("p_size"), b=3).result, b=1)
        loop = g.node("core.control.for", first_index=1, last_index=g.node("core.cast.to_int", value=count.sum).value)
        prompt = g.node("core.cast.to_string", value=loop.index)
        session = g.node("segment.set_prompt", session_id=g.col("p_brand"), prompt=prompt.value)
        held = g.node("core.var.get", name="said")
        more = g.node("core.string.format", template="{}{};", arg1=held.value, arg2=session.session_id)
        put = g.node("core.var.set", name="said", value=more.result)
        after = g.node("core.var.get", name="said")
        start.then(loop)
        loop.then(prompt, session, held, more, put, port="loop_body")
        loop.then(after, port="completed")
        return {"prompted": after.value, "last": loop.index}

    return _offline("part", build, spark, sf_dir)


@direct("SELECT p_partkey, '[size] ' || p_size AS log, '[BREAKPOINT] ' || p_size AS stop FROM part")
def logged_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Flow()
    line = g.node("core.debug.log", value=g.col("p_size"), label="size", id="log")
    g.node("core.debug.breakpoint", value=line.value, id="stop")
    engine = Engine(spark)
    run = engine.compile(g.payload(), table(spark, sf_dir, "part"))
    engine.forget(run)
    return run.compiled.frame.select("p_partkey", *(F.col(f"`{c}`").alias(n) for n, c in run.compiled.logs.items()))


# --- tables asked as if they were traces and catalogues


@direct(
    "WITH s AS (SELECT user_id, count(*) AS runs, last(value ORDER BY ts, event_id) AS last_ms, max(value) AS max_ms, last(event_type ORDER BY ts, event_id) AS last_type FROM events GROUP BY user_id) "
    "SELECT *, greatest(0.1::double, last_ms / (SELECT greatest(max(last_ms), 1) FROM s)) AS width FROM s"
)
def trace_node_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("seq", F.struct("ts", "event_id"))
    out = trace.node_summary(events, node="user_id", duration="value", keep=("event_type",), error=None, level=None)
    most = events.groupBy("user_id").agg(F.max("value").alias("max_ms"))
    return out.join(most, "user_id").select("user_id", "runs", "last_ms", "max_ms", F.col("last_event_type").alias("last_type"), "width")


@direct("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 5")
def trace_slowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the limit is what is asked for."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return trace.slowest(rows, 5, "l_extendedprice", ("l_orderkey", "l_linenumber"))


@direct("SELECT extract(hour FROM ts)::int AS level, count(*) AS nodes, max(value) AS max_ms, list_sort(list_distinct(list(event_type))) AS node_ids FROM events GROUP BY 1")
def trace_level_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("level", F.hour("ts"))
    return trace.level_timing(events, duration="value", node="event_type").select("level", "nodes", "max_ms", "node_ids")


@direct("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def trace_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.latest(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@direct("SELECT c_nationkey, count(*) AS total_nodes, count(*) FILTER (c_acctbal >= 0 AND c_mktsegment <> 'BUILDING') AS executed_nodes, count(*) FILTER (c_acctbal >= 0 AND c_mktsegment = 'BUILDING') AS cached_nodes, count(*) FILTER (c_acctbal < 0) AS error_nodes, count(DISTINCT c_mktsegment) AS levels_executed FROM customer GROUP BY 1")
def trace_run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "customer").withColumns({"status": F.when(F.col("c_acctbal") >= 0, "COMPLETED").otherwise("ERROR"), "from_cache": F.col("c_mktsegment") == "BUILDING"})
    out = trace.run_stats(runs, "c_nationkey", duration="c_acctbal", level="c_mktsegment")
    return out.select("c_nationkey", "total_nodes", "executed_nodes", "cached_nodes", "error_nodes", "levels_executed")


@direct("SELECT l_orderkey, sum(l_quantity) - max(l_quantity) AS saved, CASE WHEN sum(l_quantity) > 0 THEN (sum(l_quantity) - max(l_quantity)) / sum(l_quantity) * 100 ELSE 0 END AS percent FROM lineitem GROUP BY l_orderkey")
def trace_time_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What running an order's lines side by side would save: their sum less the longest."""
    runs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("node_ms"), F.max("l_quantity").alias("total_ms"))
    saved, percent = trace.time_saved(F.col("node_ms"), F.col("total_ms"))
    return runs.select("l_orderkey", saved.alias("saved"), percent.alias("percent"))


@direct("SELECT event_type AS node_id, CASE WHEN event_id % 2 = 0 THEN 'k ' || (props->>'$.k') || ' ERROR: again' ELSE ' note ' || (props->>'$.k') END AS message, min(event_id) AS seq, event_id % 2 = 0 AS is_error FROM events GROUP BY 1, 2, 4")
def trace_distinct_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    line = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("============ [ERROR] ERROR:\n k "), k, F.lit(" ERROR: again \r\n[STACK TRACE] at "), F.col("event_id"))).otherwise(F.concat(F.lit(" note "), k))
    lines = table(spark, sf_dir, "events").select(F.col("event_type").alias("node_id"), F.col("event_id").alias("seq"), F.array(line, F.lit("")).alias("logs"))
    return trace.distinct_logs(lines).select("node_id", "message", "seq", "is_error")


@direct("SELECT p_brand AS category, count(*) AS n FROM part WHERE contains(lower(p_name), 'a') OR contains(lower(p_type), 'a') GROUP BY 1")
def catalog_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_name").alias("type"), F.col("p_type").alias("description"), F.col("p_brand").alias("category"))
    return trace.palette(parts, "A").select("category", "n")


_WORDS = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda w: w <> '')"
_SCORE = f"CASE WHEN lower({{0}}) = 'bl' THEN 0 WHEN {_WORDS}[1] = 'bl' THEN 1 WHEN list_contains({_WORDS}, 'bl') THEN 2 WHEN starts_with(lower({{0}}), 'bl') THEN 3 WHEN len(list_filter({_WORDS}, lambda w: starts_with(w, 'bl'))) > 0 THEN 4 WHEN contains(lower({{0}}), 'bl') THEN 5 END"


@direct(f"SELECT * FROM (SELECT p_partkey, least({_SCORE.format('p_name')}, {_SCORE.format('p_type')} + 10)::int AS score FROM part) WHERE score IS NOT NULL")
def catalog_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.ranked_search(table(spark, sf_dir, "part"), "bl", ("p_name", "p_type")).select("p_partkey", "score")


@direct("SELECT event_id, CASE WHEN starts_with(props, 'data:image') THEN 'image' WHEN contains(event_type, 'stream_id') THEN 'stream' ELSE 'value' END AS class FROM events")
def outputs_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.classify_outputs(table(spark, sf_dir, "events"), "event_type", "props").select("event_id", "class")


@direct("WITH RECURSIVE r(node, depth) AS (SELECT 1::bigint, 0 UNION ALL SELECT e.d, r.depth + 1 FROM r JOIN (SELECT DISTINCT l_linenumber::bigint AS s, l_linenumber::bigint + 2 AS d FROM lineitem) e ON e.s = r.node) SELECT node::varchar AS node, min(depth)::int AS depth FROM r GROUP BY node")
def graph_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber").cast("long")
    lines = table(spark, sf_dir, "lineitem").select(n.cast("string").alias("src"), (n + 2).cast("string").alias("dst")).distinct()
    return edges.closure(lines, "1")


_NEXT = "SELECT DISTINCT a.l_partkey AS s, b.l_partkey AS d FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber AND a.l_partkey < b.l_partkey"


def _next_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from each part to the one on an order's next line, where that has the higher number: no cycles, and long ways."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    following = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    return lines.join(following, ["l_orderkey", "l_linenumber"]).where("l_partkey < dst").select(F.col("l_partkey").alias("src"), "dst")


@direct(
    f"WITH RECURSIVE e AS ({_NEXT}), kept AS (SELECT p_partkey AS n FROM part WHERE p_size % 7 = 0), r(node) AS (SELECT 3::bigint UNION SELECT e.d FROM r JOIN e ON e.s = r.node WHERE e.d NOT IN (SELECT n FROM kept)) SELECT node::varchar AS node FROM r"
)
def graph_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What hangs on part 3, but for what hangs on it by kept parts alone."""
    kept = table(spark, sf_dir, "part").where("p_size % 7 = 0").select("p_partkey")
    return edges.closure(_next_parts(spark, sf_dir), "3", stop=kept).select("node")


@direct(
    f"WITH RECURSIVE e AS ({_NEXT}), l(node, level) AS (SELECT DISTINCT p_partkey, 0::bigint FROM part WHERE p_partkey NOT IN (SELECT d FROM e) UNION SELECT e.d, l.level + 1 FROM l JOIN e ON e.s = l.node)"
    " SELECT node::varchar AS node, max(level) AS level FROM l GROUP BY node"
)
def graph_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of a graph of all parts; the order of (level, node) is topological."""
    return edges.levels(_next_parts(spark, sf_dir), table(spark, sf_dir, "part"), node="p_partkey")


@direct("WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS s, (p_partkey * p_partkey + 1) % 1009 AS d FROM part), r(a, b) AS (SELECT s, d FROM e UNION SELECT r.a, e.d FROM r JOIN e ON e.s = r.b) SELECT a::varchar AS node FROM r WHERE a = b")
def graph_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes on cycles, where each part leads to one number."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"), ((F.col("p_partkey") * F.col("p_partkey") + 1) % 1009).alias("dst"))
    return edges.cyclic(parts)


@direct(
    "WITH RECURSIVE e AS (SELECT p_partkey AS s, p_partkey * k AS d FROM part, (VALUES (2), (3)) AS t(k) WHERE p_partkey > 0), p(path, last) AS (SELECT [1::bigint], 1::bigint UNION ALL SELECT list_append(p.path, e.d), e.d FROM p JOIN e ON e.s = p.last WHERE e.d <= 144 AND NOT list_contains(p.path, e.d))"
    " SELECT list_transform(path, lambda x: x::varchar) AS path FROM p WHERE last = 144"
)
def graph_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every way from 1 to 144 where each part leads to its double and its treble."""
    parts = table(spark, sf_dir, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("src"), F.explode(F.array(F.col("p_partkey") * 2, F.col("p_partkey") * 3)).alias("dst"))
    return edges.paths(parts, "1", "144")


@direct(
    "SELECT 'bulk' AS node_id, count(*) AS rows, 0::bigint AS skipped, 0::bigint AS nulls, 0::bigint AS errors FROM lineitem"
    " UNION ALL SELECT 'share', count(*) FILTER (l_quantity > 24), count(*) FILTER (NOT l_quantity > 24), 0, 0 FROM lineitem"
    " UNION ALL SELECT 'least', count(*), 0, count(*) FILTER (l_returnflag = 'R'), count(*) FILTER (l_returnflag = 'R') FROM lineitem"
)
def node_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the nodes of a graph did, counted in the job that computed its outputs: rows, rows left out by a branch, nulls, errors."""
    g = Flow()
    bulk = g.node("core.logic.compare", id="bulk", a=g.col("l_quantity"), b=24, op=">")
    branch = g.node("core.control.ifelse", condition=bulk.result)
    share = g.node("core.math.multiply", id="share", a=g.col("l_tax"), b=2)
    branch.then(share, port="true")
    text = g.node("core.string.replace", text=g.node("core.string.replace", text=g.col("l_returnflag"), find="A", replace="1").result, find="N", replace="2").result
    least = g.node("core.math.min", id="least", a=g.node("core.util.passthrough", value=text).value, b=1)
    g.out(bulk=bulk.result, share=share.product, least=least.result)
    watched = Watched(Engine(spark), g.payload(), table(spark, sf_dir, "lineitem"), {"on_error": "collect"})
    watched.frame.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame(watched.rows(), NODE_METRICS).where(F.col("node_id").isin("bulk", "share", "least")).select("node_id", "rows", "skipped", "nulls", "errors")


@direct("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def streaming_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windowed aggregation that streams use, over the events as one batch."""
    from .streaming.frames import windowed

    return windowed(table(spark, sf_dir, "events"), "1 hour").select("start", "event_type", "n")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
