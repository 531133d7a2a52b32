"""Lists, maps, JSON, time, random values, null handling, variables' and display's column work."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import Parsed, Value, as_type, as_variant, bounds, constant, is_bool, is_missing, is_number, is_text, is_variant, number, pystr, same, steps, text_to_double, truthy, whole, widest
from ..functions.jsontext import json_text
from ..registry import node, port
from .inputs import Inputs
from .scalars import _end

# --- lists


@node("core.array.first", [port("array: list<any>")], ["value"], category="Array")
def first(v: Inputs) -> Column:
    return F.get(v.array("array")[0], F.lit(0))


@node("core.array.last", [port("array: list<any>")], ["value"], category="Array")
def last(v: Inputs) -> Column:
    return F.try_element_at(v.array("array")[0], F.lit(-1))


@node("core.array.slice", [port("array: list<any>"), port("start: int", 0), port("end: int", -1)], ["result: list<any>"], category="Array")
def array_slice(v: Inputs) -> Column:
    """array[start:end] as Python slices; an end of -1 or null is the end of the list."""
    arr, _ = v.array("array")
    at, n = bounds(F.size(arr), whole(v["start"]), _end(v))
    return F.slice(arr, at + 1, n)


@node("core.array.reverse", [port("array: list<any>")], ["result: list<any>"], category="Array")
def reverse(v: Inputs) -> Column:
    return F.reverse(v.array("array")[0])


def _ordered(arr: Column, down: Column) -> Column:
    """A list of variants in order if all are numbers (or booleans) or all texts, equal ones as they stood; else as it is."""
    # ascending by (key, place) or, reversed at the end, by (key, -place)
    place = lambda i: F.when(down, -i).otherwise(i)

    def by(key) -> Column:
        keyed = F.array_sort(F.transform(arr, lambda x, i: F.struct(key(Parsed(x)).alias("k"), place(i).alias("i"))))
        turned = F.when(down, F.reverse(keyed)).otherwise(keyed)
        return F.transform(turned, lambda e: F.get(arr, F.abs(e["i"])))

    every = lambda key: F.forall(arr, lambda x: key(Parsed(x)).isNotNull())
    counted, text = lambda p: p.counted, lambda p: p.text
    return F.when(every(counted), by(counted)).when(every(text), by(text)).otherwise(arr)


@node("core.array.sort", [port("array: list<any>"), port("descending: boolean", False)], ["result: list<any>"], category="Array")
def sort(v: Inputs) -> Column:
    """In order; a list with a null, or with unlike kinds, among two or more items stays as it is."""
    arr, t = v.array("array")
    d = v["descending"]
    if is_variant(t.elementType):
        return _ordered(arr, truthy(d))
    up, down = F.sort_array(arr, True), F.sort_array(arr, False)
    ordered = (down if d.const else up) if d.is_const else F.when(truthy(d), down).otherwise(up)
    return F.when(F.exists(arr, lambda x: x.isNull()), arr).otherwise(ordered)


def _hits(v: Inputs):
    arr, t = v.array("array")
    return arr, lambda x: same(Value(x, t.elementType), v["value"])


@node("core.array.contains", [port("array: list<any>"), port("value")], ["result: boolean"], category="Array")
def array_contains(v: Inputs) -> Column:
    """Null is found where the list holds one."""
    arr, hit = _hits(v)
    return F.exists(arr, hit)


@node("core.array.index_of", [port("array: list<any>"), port("value")], ["index: int"], category="Array")
def index_of(v: Inputs) -> Column:
    """Place of the first equal item from 0, else -1."""
    arr, hit = _hits(v)
    return (F.coalesce(F.array_position(F.transform(arr, hit), F.lit(True)), F.lit(0)) - 1).cast("long")


def _doubles(v: Inputs) -> Column:
    """The list's items that are numbers (or text or booleans that read as such), as doubles, in order."""
    arr, t = v.array("array")
    if is_text(t.elementType):
        out = F.transform(arr, text_to_double)
    elif is_number(t.elementType) or is_bool(t.elementType):
        out = F.transform(arr, lambda x: x.cast("double"))
    elif is_variant(t.elementType):
        out = F.transform(arr, lambda x: Parsed(x).readable)
    else:
        return F.array().cast("array<double>")
    return F.filter(out, lambda x: x.isNotNull())


def _total(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + x)


@node("core.array.sum", [port("array: list<any>")], ["result: float"], category="Array")
def array_sum(v: Inputs) -> Column:
    """Sum of the items that are numbers, in their order."""
    return _total(_doubles(v))


@node("core.array.average", [port("array: list<any>")], ["result: float"], category="Array")
def array_average(v: Inputs) -> Column:
    """Mean of the items that are numbers; 0 without any."""
    items = _doubles(v)
    return F.when(F.size(items) > 0, _total(items) / F.size(items)).otherwise(0.0)


@node("core.container.make_array", [], ["array: list<any>"], category="Container", dynamic=True)
def make_array(v: Inputs) -> Column:
    """The ports item_0, item_1, ... that the node names, in the order of their numbers; unlike kinds make a list of variants."""
    ports = sorted((p for p in v.values if re.fullmatch(r"item_\d+", p)), key=lambda p: int(p[5:]))
    values = [v[p] for p in ports]
    if not values:
        return F.array().cast("array<string>")
    common: T.DataType = T.NullType()
    for x in values:
        common = widest(common, x.type)
    return F.array(*(as_type(x, common) for x in values))


@node("core.container.append", [port("array: list<any>"), port("value")], ["array: list<any>"], category="Container")
def append(v: Inputs) -> Column:
    """The list with the value behind it; unlike kinds make a list of variants."""
    arr, t = v.array("array")
    x = v["value"]
    if v["array"].is_null and not x.is_null:
        return F.array(x.col)
    common = widest(t.elementType, x.type)
    return F.array_append(as_type(Value(arr, t), T.ArrayType(common)), as_type(x, common))


@node("core.container.get_index", [port("array: list<any>"), port("index: int", 0)], ["value"], category="Container")
def get_index(v: Inputs) -> Column:
    """The item at an index from 0; null beyond either end."""
    return F.get(v.array("array")[0], whole(v["index"]).cast("int"))


@node("core.container.range", [port("start: int", 0), port("end: int", 0), port("step: int", 1)], ["array: list<int>"], category="Container")
def number_range(v: Inputs) -> Column:
    """start .. end, both included, towards end whatever the step's sign; a step of 0 is 1."""
    return steps(whole(v["start"]), whole(v["end"]), whole(v["step"], 1))


@node("core.container.length", [port("value")], ["length: int"], category="Container")
def length(v: Inputs) -> Column:
    """Code points of a text, items of a list or map, also in parsed JSON; 0 of all else."""
    x = v["value"]
    if is_variant(x.type):
        return F.coalesce(Parsed(x.col).size, F.lit(0)).cast("long")
    n = F.length(x.col) if is_text(x.type) else F.size(x.col) if isinstance(x.type, (T.ArrayType, T.MapType)) else F.lit(len(x.type.fields)) if isinstance(x.type, T.StructType) else F.lit(0)
    n = F.when(x.col.isNotNull(), n) if not x.is_null else F.lit(0)
    return F.coalesce(n, F.lit(0)).cast("long")


@node("core.container.get", [port("map"), port("key"), port("default")], ["value"], category="Container")
def get(v: Inputs) -> Column:
    """The entry at key, else the default. Parsed JSON gives variants, which every node takes as what they hold; so do
    objects of unlike kinds at a key from a column, and entries of another kind than the default's."""
    m, k, d = v["map"], v["key"], v["default"]
    text = k.col if is_text(k.type) else Parsed(k.col).text if is_variant(k.type) else None
    if isinstance(m.type, T.MapType) and not k.is_null:
        key = text if text is not None and is_text(m.type.keyType) else k.col.cast(m.type.keyType)
        got = Value(m.col[key], m.type.valueType)
        has = F.coalesce(F.map_contains_key(m.col, key), F.lit(False))
        if is_text(m.type.keyType) and text is None:  # 5 is no key of {"5": 1}
            return d.col
    elif isinstance(m.type, T.StructType) and k.is_const and k.const in m.type.fieldNames():
        got = Value(m.col[k.const], m.type[k.const].dataType)
        has = m.col.isNotNull()
    elif is_variant(m.type) and text is not None:
        entries = Parsed(m.col).entries
        got = Value(entries[text], m.type)
        has = F.coalesce(F.map_contains_key(entries, text), F.lit(False))
    elif isinstance(m.type, T.StructType) and text is not None:
        got, has = constant(None), F.coalesce(m.col.isNotNull() & text.isin(m.type.fieldNames()), F.lit(False))
        for f in m.type.fields:
            got = Value(F.when(text == f.name, as_variant(Value(m.col[f.name], f.dataType))).otherwise(got.col), T.VariantType())
    else:
        return d.col
    common = widest(got.type, d.type)
    return F.when(has, as_type(got, common)).otherwise(as_type(d, common))


# --- JSON


@node("core.json.parse", [port("json_string: string", "{}")], ["data", "success: boolean"], category="JSON")
def json_parse(v: Inputs) -> dict[str, Column]:
    """A variant, and whether the text was JSON; an empty text counts as {}."""
    x = v["json_string"]
    text = F.lit("{}") if x.is_null else F.when(x.col.isNull() | (x.col == ""), "{}").otherwise(x.col.cast("string"))
    data = F.try_parse_json(text)
    return {"data": data, "success": data.isNotNull()}


@node("core.json.stringify", [port("data"), port("pretty: boolean", False)], ["json_string: string"], category="JSON")
def json_stringify(v: Inputs) -> Column:
    """JSON text as Python writes it: ', ' and ': ' between, ASCII alone, two spaces a level if pretty; what JSON does not
    know (times, decimals) as text. Keys of parsed JSON are in order."""
    x, p = v["data"], v["pretty"]
    plain, pretty = json_text(x), json_text(x, pretty=True)
    return (pretty if p.const else plain) if p.is_const else F.when(truthy(p), pretty).otherwise(plain)


# --- time and random values


@node("core.time.now", [], ["timestamp: float"], category="Time", cache_policy="disabled")
def now(v: Inputs) -> Column:
    """Seconds since 1970, one value a run."""
    return F.unix_micros(F.current_timestamp()) / 1e6


@node("core.time.delay", [port("seconds: float", 1.0), port("passthrough")], ["passthrough"], category="Time", cache_policy="disabled")
def delay(v: Inputs) -> Column:
    """Hands its value on; rows do not wait (a stream's pace is its trigger's)."""
    return v["passthrough"].col


def _seed(v: Inputs) -> int:
    """One per node and graph seed: reruns agree, nodes differ."""
    base = getattr(v.scope, "seed", 0) if v.scope is not None else 0
    return zlib.crc32(f"{base}:{v.node.id if v.node else ''}".encode())


@node("core.random.float", [port("min: float", 0.0), port("max: float", 1.0)], ["value: float"], category="Random", cache_policy="disabled")
def random_float(v: Inputs) -> Column:
    lo = number(v["min"], 0)
    return lo + (number(v["max"], 1) - lo) * F.rand(_seed(v))


@node("core.random.int", [port("min: int", 0), port("max: int", 100)], ["value: int"], category="Random", cache_policy="disabled")
def random_int(v: Inputs) -> Column:
    """Both ends included; a max of 0 counts as 100."""
    lo = whole(v["min"])
    return (lo + F.floor(F.rand(_seed(v)) * (whole(v["max"], 100) - lo + 1))).cast("long")


@node("core.random.boolean", [port("probability: float", 0.5)], ["value: boolean"], category="Random", cache_policy="disabled")
def random_boolean(v: Inputs) -> Column:
    return F.rand(_seed(v)) < number(v["probability"], 0.5)


@node("core.random.choice", [port("array: list<any>")], ["value", "index: int"], category="Random", cache_policy="disabled")
def random_choice(v: Inputs) -> dict[str, Column]:
    """An item and its index; null and -1 from an empty list."""
    arr, _ = v.array("array")
    i = F.when(F.size(arr) > 0, F.floor(F.rand(_seed(v)) * F.size(arr))).otherwise(-1).cast("long")
    return {"value": F.get(arr, i.cast("int")), "index": i}


# --- nulls, types, logs, display


@node("core.util.typeof", [port("value")], ["type_name: string"], category="Utility")
def type_of(v: Inputs) -> Column:
    """int, float, str, bool, list, dict or NoneType."""
    x = v["value"]
    if x.is_null:
        return F.lit("NoneType")
    t = x.type
    if is_variant(t):
        p = Parsed(x.col)
        named = F.when(p.null, "NoneType").when(p.is_whole, "int").when(p.boolean.isNotNull(), "bool").when(p.text.isNotNull(), "str")
        return named.when(p.items.isNotNull(), "list").when(p.entries.isNotNull(), "dict").otherwise("float")
    name = "bool" if is_bool(t) else "float" if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)) else "int" if is_number(t) else "str" if is_text(t) else "list" if isinstance(t, T.ArrayType) else "dict" if isinstance(t, (T.MapType, T.StructType)) else t.typeName()
    return F.when(x.col.isNull(), "NoneType").otherwise(name)


@node("core.util.is_null", [port("value")], ["is_null: boolean"], category="Utility")
def is_null(v: Inputs) -> Column:
    return is_missing(v["value"])


@node("core.util.coalesce", [port("a"), port("b"), port("c")], ["value"], category="Utility")
def coalesce(v: Inputs) -> Column:
    """The first of a, b, c that is not null (nor JSON's null); unlike kinds as variants."""
    given = [v[p] for p in "abc" if not v[p].is_null]
    common: T.DataType = T.NullType()
    for x in given:
        common = widest(common, x.type)
    parts = [F.when(~is_missing(x), as_type(x, common)) if is_variant(x.type) else as_type(x, common) for x in given]
    return F.coalesce(*parts) if parts else F.lit(None)


@node("core.util.passthrough", [port("value")], ["value"], category="Utility")
def passthrough(v: Inputs) -> Column:
    return v["value"].col


@node("core.debug.log", [port("value"), port("label: string", "")], ["value"], category="Debug")
def log(v: Inputs) -> Column:
    """Hands its value on; the line `[label] value` goes to the run's log column."""
    label = v["label"]
    line = pystr(v["value"])
    if v.scope is not None and v.node is not None:
        v.scope.log(v.node, line if label.is_null or (label.is_const and not label.const) else F.concat(F.lit("["), pystr(label), F.lit("] "), line))
    return v["value"].col


@node("core.debug.breakpoint", [port("value"), port("enabled: boolean", True)], ["value"], category="Debug")
def breakpoint_(v: Inputs) -> Column:
    """Hands its value on, and logs it while enabled; runs stop by the option breakpoints."""
    if v.scope is not None and v.node is not None:
        v.scope.log(v.node, F.when(truthy(v["enabled"]), F.concat(F.lit("[BREAKPOINT] "), pystr(v["value"]))))
    return v["value"].col


@node("general.to_display", [port("section: string", "Main"), port("title: string", "Output"), port("value", required=True)], ["section: string", "title: string", "value"], category="Display", tags=("sink",))
def to_display(v: Inputs) -> dict[str, Column]:
    """Section, title and value as a display shows them."""
    return {p: v[p].col for p in ("section", "title", "value")}
