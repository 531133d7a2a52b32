"""Columns with the value rules of graphs: coercion, defaults, truth, text forms, slices, equality.

All of it is built-in Column work; the static type of a value decides which form is emitted.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UNSET = object()
#: Where errors of rows are put while a node is built that collects them; None: they are raised.
_errors: ContextVar[list[Column] | None] = ContextVar("errors", default=None)
#: Characters that Python strips, without those beyond the Basic Latin white space that Java's class has, too.
SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_FLOAT = r"(?i)^[+-]?(?:(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:e[+-]?\d+)?|inf(?:inity)?|nan)$"


@dataclass(frozen=True)
class Value:
    """A Column with its type, and with its value where the graph gives it."""

    col: Column
    type: T.DataType
    const: Any = _UNSET

    @property
    def is_const(self) -> bool:
        return self.const is not _UNSET

    @property
    def is_null(self) -> bool:
        return isinstance(self.type, T.NullType) or (self.is_const and self.const is None)


def is_text(t: T.DataType) -> bool:
    return isinstance(t, (T.StringType, T.VarcharType, T.CharType))


def is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_bool(t: T.DataType) -> bool:
    return isinstance(t, T.BooleanType)


def constant(x: Any) -> Value:
    """A Value from a graph's JSON: numbers are long or double, lists arrays, objects maps or structs."""
    col, t = _constant(x)
    return Value(col, t, x)


def _constant(x: Any) -> tuple[Column, T.DataType]:
    if x is None:
        return F.lit(None), T.NullType()
    if isinstance(x, bool):
        return F.lit(x), T.BooleanType()
    if isinstance(x, int):
        return F.lit(x).cast("long"), T.LongType()
    if isinstance(x, float):
        return F.lit(x).cast("double"), T.DoubleType()
    if isinstance(x, str):
        return F.lit(x), T.StringType()
    if isinstance(x, (list, tuple)):
        parts = [_constant(y) for y in x]
        common = reduce(widest, (t for _, t in parts), T.NullType())
        item = T.StringType() if isinstance(common, T.NullType) else common
        return F.array(*(as_type(Value(c, t), item) for c, t in parts)).cast(T.ArrayType(item)), T.ArrayType(item)
    if isinstance(x, dict):
        parts = {k: _constant(v) for k, v in x.items()}
        kinds = {t.simpleString() for _, t in parts.values()}
        if len(kinds) <= 1:
            item = next((t for _, t in parts.values()), T.StringType())
            flat = [y for k, (c, _) in parts.items() for y in (F.lit(k), c)]
            return F.create_map(*flat).cast(T.MapType(T.StringType(), item)), T.MapType(T.StringType(), item)
        struct = T.StructType([T.StructField(k, t) for k, (_, t) in parts.items()])
        return F.struct(*(c.alias(k) for k, (c, _) in parts.items())), struct
    raise TypeError(f"no column for a {type(x).__name__}")


class Parsed:
    """What a variant (parsed JSON) holds, told by its kind: each form is null where it is of another kind."""

    def __init__(self, c: Column):
        self.col, self.kind = c, F.schema_of_variant(c)
        as_type = lambda t: F.try_variant_get(c, "$", t)
        self.null = c.isNull() | (self.kind == "VOID")
        numeric = self.kind.rlike("^(?:BIGINT|DOUBLE|FLOAT|DECIMAL)")
        self.number = F.when(numeric, as_type("double"))
        #: JSON's 1 is whole, its 1.0 (a decimal of few digits) is not; whole numbers beyond 64 bits are long decimals
        self.is_whole = self.kind.rlike(r"^(?:BIGINT|DECIMAL\((?:19|[23]\d),0\))$")
        self.digits = F.when(numeric, as_type("string"))
        self.boolean = F.when(self.kind == "BOOLEAN", as_type("boolean"))
        self.text = F.when(self.kind == "STRING", as_type("string"))
        self.items = F.when(F.startswith(self.kind, F.lit("ARRAY")), as_type("array<variant>"))
        self.entries = F.when(F.startswith(self.kind, F.lit("OBJECT")), as_type("map<string,variant>"))
        self.counted = F.coalesce(self.number, self.boolean.cast("int").cast("double"))
        #: containers as JSON, in which object keys are in order
        self.json = F.when(self.kind.rlike("^(?:ARRAY|OBJECT)"), F.to_json(c))
        self.size = F.coalesce(F.length(self.text), F.size(self.items), F.size(self.entries))
        #: of what float() takes: numbers, booleans, and text that reads as a number
        self.readable = F.coalesce(self.counted, text_to_double(self.text))

    def equals(self, v: Value) -> Column:
        """Python's == with a value of another type: false for unlike kinds."""
        other = F.lit(False)
        if is_number(v.type) or is_bool(v.type):
            other = self.counted == (v.col.cast("int") if is_bool(v.type) else v.col).cast("double")
        elif is_text(v.type):
            other = self.text == v.col
        elif isinstance(v.type, (T.ArrayType, T.MapType, T.StructType)):
            other = self.json == F.to_json(as_variant(v))
        return F.coalesce(other, F.lit(False)) | (self.null & v.col.isNull())


def is_variant(t: T.DataType) -> bool:
    return isinstance(t, T.VariantType)


def is_missing(v: Value) -> Column:
    """Python's is None; the null of JSON is one, too."""
    return F.lit(True) if v.is_null else Parsed(v.col).null if is_variant(v.type) else v.col.isNull()


def widest(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds values of both: a null type gives way, unlike numbers are double, all else is a variant, which keeps each value's kind."""
    if isinstance(a, T.NullType) or a == b:
        return b
    if isinstance(b, T.NullType):
        return a
    if is_number(a) and is_number(b):
        whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
        return T.LongType() if isinstance(a, whole) and isinstance(b, whole) else T.DoubleType()
    if is_text(a) and is_text(b):
        return T.StringType()
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(widest(a.elementType, b.elementType))
    if isinstance(a, T.MapType) and isinstance(b, T.MapType) and a.keyType == b.keyType:
        return T.MapType(a.keyType, widest(a.valueType, b.valueType))
    return T.VariantType()


def as_variant(v: Value) -> Column:
    """The value as a variant, null as null; lists and objects with all that is in them."""
    t = v.type
    if is_variant(t):
        return v.col
    if isinstance(t, (T.ArrayType, T.MapType, T.StructType)):
        return F.when(v.col.isNotNull(), F.to_variant_object(v.col))
    return v.col.cast("variant")


def as_type(v: Value, t: T.DataType) -> Column:
    """The value in a type that widest gave for it and others."""
    if v.type == t:
        return v.col
    if is_variant(t):
        return as_variant(v)
    if isinstance(t, T.ArrayType) and isinstance(v.type, T.ArrayType):
        return F.transform(v.col, lambda x: as_type(Value(x, v.type.elementType), t.elementType))
    if isinstance(t, T.MapType) and isinstance(v.type, T.MapType):
        return F.transform_values(v.col, lambda _, x: as_type(Value(x, v.type.valueType), t.valueType))
    return v.col.cast(t)


@contextmanager
def collecting() -> Iterator[list[Column]]:
    """Messages of the rows that fail in what is built meanwhile, null for the others; nothing raises."""
    found: list[Column] = []
    token = _errors.set(found)
    try:
        yield found
    finally:
        _errors.reset(token)


def is_collecting() -> bool:
    return _errors.get() is not None


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value in the plan once, however often f uses it.

    A fold over nothing that begins with value and ends with f: unlike the item of an array of one, it copies
    nothing, and Spark does not work out the type of all that is inside again for each row."""
    return F.aggregate(F.array().cast("array<boolean>"), value, lambda x, _: x, lambda x: f(x))


def failing(test: Column, message: Column | str, value: Column) -> Column:
    """value, but an error where test holds: raised, or noted with null in its place."""
    message = F.lit(message) if isinstance(message, str) else message
    found = _errors.get()
    if found is None:
        return F.when(test, F.raise_error(message)).otherwise(value)
    found.append(F.when(test, message))
    return F.when(~test | test.isNull(), value)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, SPACE, "")


def text_to_double(c: Column) -> Column:
    """What Python's float() reads, else null (Java alone would also read 1d and 0x1p3)."""
    s = strip(c)
    plain = F.when(s.rlike(_FLOAT), F.regexp_replace(F.regexp_replace(s, "_", ""), r"(?i)^([+-]?)inf(?:inity)?$", "$1Infinity"))
    return F.when(F.lower(s).isin("nan", "+nan", "-nan"), F.lit(math.nan)).otherwise(plain.try_cast("double"))


def coerce(v: Value) -> Column:
    """As a double; null, empty and unreadable values are 0."""
    if v.is_null:
        return F.lit(0.0)
    if is_text(v.type):
        return F.coalesce(text_to_double(v.col), F.lit(0.0))
    if is_number(v.type) or is_bool(v.type):
        return F.coalesce(v.col.cast("double"), F.lit(0.0))
    if is_variant(v.type):
        return F.coalesce(Parsed(v.col).readable, F.lit(0.0))
    return F.lit(0.0)


def number(v: Value, default: float) -> Column:
    """As a double; null, 0 and '' are the default; unreadable text is an error."""
    if v.is_null:
        return F.lit(float(default))
    c = v.col
    if is_text(v.type):
        read = F.when(c != "", text_to_double(c))
        c = failing(F.coalesce((c != "") & read.isNull(), F.lit(False)), F.concat(F.lit("could not convert string to float: "), c), read)
    elif is_variant(v.type):
        p = Parsed(c)
        c = failing(p.readable.isNull() & truthy(v), F.concat(F.lit("could not convert to float: "), F.to_json(c)), p.readable)
    elif not (is_number(v.type) or is_bool(v.type)):
        c = failing(c.isNotNull(), f"not a number: {v.type.simpleString()}", F.lit(None).cast("double"))
    c = c.cast("double")
    return F.coalesce(F.when(c != 0, c), F.lit(float(default)))


def whole(v: Value, default: int = 0) -> Column:
    """As a long, cut towards 0; null and 0 are the default."""
    if v.is_null:
        return F.lit(default).cast("long")
    c = v.col.cast("double") if is_text(v.type) else v.col
    if is_variant(v.type):
        p = Parsed(c)
        c = failing(p.readable.isNull() & truthy(v), F.concat(F.lit("not a whole number: "), F.to_json(c)), p.readable)
    c = c.cast("long")
    return F.coalesce(F.when(c != 0, c), F.lit(default).cast("long"))


def falsy_or(v: Value, default: Any) -> Column:
    """The value, or the default where the value is null, zero, false or empty."""
    d = F.lit(default) if not isinstance(default, Column) else default
    return d if v.is_null else F.when(truthy(v), v.col).otherwise(d)


def truthy(v: Value) -> Column:
    """Never null: null, 0, '' and empty containers are false, all else (also 'false') true."""
    if v.is_null:
        return F.lit(False)
    t, c = v.type, v.col
    if is_bool(t):
        out = c
    elif is_number(t):
        out = c != 0
    elif is_text(t):
        out = c != ""
    elif isinstance(t, (T.ArrayType, T.MapType)):
        out = F.size(c) > 0
    elif is_variant(t):
        p = Parsed(c)
        out = F.coalesce(p.counted != 0, p.size > 0)
    else:
        out = c.isNotNull()
    return F.coalesce(out, F.lit(False))


def text_or_empty(v: Value) -> Column:
    """Text of a text port: null is '', other kinds as Python prints them."""
    if v.is_null:
        return F.lit("")
    if is_text(v.type):
        return F.coalesce(v.col, F.lit(""))
    return F.when(truthy(v), pystr(v)).otherwise("")


def _double_text(c: Column) -> Column:
    """repr of a Python float from Spark's text form: same digits, other switch to exponents."""
    a, s = F.abs(c), c.cast("string")
    decimal = lambda scale: F.regexp_replace(s.cast(T.DecimalType(38, scale)).cast("string"), r"(\.\d+?)0+$", "$1")
    exponent = F.regexp_extract(s, r"E(-?\d+)$", 1)
    digits = F.regexp_replace(exponent, "-", "")
    scientific = F.concat(F.regexp_replace(F.regexp_extract(s, r"^([^E]+)E", 1), r"\.0$", ""), F.lit("e"), F.when(F.startswith(exponent, F.lit("-")), "-").otherwise("+"), F.when(F.length(digits) < 2, F.concat(F.lit("0"), digits)).otherwise(digits))
    return (
        F.when(F.isnan(c), "nan")
        .when(a == math.inf, F.when(c > 0, "inf").otherwise("-inf"))
        .when((a == 0) | ((a >= 1e-3) & (a < 1e7)), s)
        .when((a >= 1e7) & (a < 1e16), decimal(17))
        .when((a >= 1e-4) & (a < 1e-3), decimal(22))
        .otherwise(scientific)
    )


def pystr(v: Value, null: str = "None") -> Column:
    """str() of Python. Containers print their items as repr() does; text in them with plain escapes only."""
    return F.lit(null) if v.is_null else F.coalesce(_text_of(v.col, v.type, False), F.lit(null))


def _text_of(c: Column, t: T.DataType, inner: bool) -> Column:
    if is_text(t):
        if not inner:
            return c
        quoted = F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), "\n", r"\\n")
        return F.when(F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"')), F.concat(F.lit('"'), quoted, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.regexp_replace(quoted, "'", r"\\'"), F.lit("'")))
    if is_bool(t):
        return F.when(c, "True").otherwise(F.when(c.isNotNull(), "False"))
    if isinstance(t, T.DoubleType):
        return _double_text(c)
    if isinstance(t, T.FloatType):
        return _double_text(c.cast("double"))
    item = lambda x, u: F.coalesce(_text_of(x, u, True), F.lit("None"))
    if isinstance(t, T.ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: item(x, t.elementType)), ", "), F.lit("]"))
    if isinstance(t, T.MapType):
        pairs = F.transform(F.map_entries(c), lambda e: F.concat(item(e["key"], t.keyType), F.lit(": "), item(e["value"], t.valueType)))
        return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
    if isinstance(t, T.StructType):
        fields = [F.concat(F.lit(f"'{f.name}': "), item(c[f.name], f.dataType)) for f in t.fields]
        return F.when(c.isNotNull(), F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}")))
    if is_variant(t):
        return _parsed_text(c, inner, 1)
    return c.cast("string")


#: Strings, punctuation and all else of a JSON text without white space.
_TOKENS = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[\[\]{},:]|[^\[\]{},:"]+'


def tokens(json: Column) -> Column:
    return F.regexp_extract_all(json, F.lit(_TOKENS), F.lit(0))


def unquoted(token: Column) -> Column:
    """The text that a JSON string stands for."""
    return F.try_variant_get(F.try_parse_json(token), "$", "string")


def _parsed_text(c: Column, inner: bool, depth: int) -> Column:
    """Parsed JSON as Python prints it; in lists and objects within others 1.0 is printed as 1."""
    p = Parsed(c)
    text = _text_of(p.text, T.StringType(), inner)
    scalar = F.coalesce(text, _text_of(p.boolean, T.BooleanType(), inner), F.when(p.is_whole, p.digits), _double_text(p.number))
    if depth:
        item = lambda x: F.coalesce(_parsed_text(x, True, depth - 1), F.lit("None"))
        listed = F.concat(F.lit("["), F.array_join(F.transform(p.items, item), ", "), F.lit("]"))
        pairs = F.transform(F.map_entries(p.entries), lambda e: F.concat(_text_of(e["key"], T.StringType(), True), F.lit(": "), item(e["value"])))
        return F.coalesce(scalar, listed, F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")))

    def printed(x: Column) -> Column:
        known = F.when(x == ",", ", ").when(x == ":", ": ").when(x == "true", "True").when(x == "false", "False").when(x == "null", "None")
        return known.when(F.startswith(x, F.lit('"')), _text_of(unquoted(x), T.StringType(), True)).when(x.rlike("[.eE]"), _double_text(x.try_cast("double"))).otherwise(x)

    return F.coalesce(scalar, F.array_join(F.transform(tokens(p.json), printed), ""))


def same(a: Value, b: Value) -> Column:
    """Python's ==: null equals null alone, numbers and booleans compare by value, unlike kinds differ.

    Parsed JSON compares by what it holds; lists and objects in it by their JSON."""
    if a.is_null or b.is_null:
        return is_missing(b if a.is_null else a)
    if is_variant(a.type) and is_variant(b.type):
        x, y = Parsed(a.col), Parsed(b.col)
        return (x.null & y.null) | F.coalesce(x.counted == y.counted, x.text == y.text, x.json == y.json, F.lit(False))
    if is_variant(a.type) or is_variant(b.type):
        return Parsed(a.col).equals(b) if is_variant(a.type) else Parsed(b.col).equals(a)
    both = lambda test: test(a.type) and test(b.type)
    counts = lambda t: is_number(t) or is_bool(t)
    if both(counts) and not both(is_bool):
        wide = widest(T.LongType() if is_bool(a.type) else a.type, T.LongType() if is_bool(b.type) else b.type)
        x, y = (v.col.cast("int").cast(wide) if is_bool(v.type) else v.col.cast(wide) for v in (a, b))
        equal = x.eqNullSafe(y)
        # NaN equals nothing, not even itself
        return equal & ~F.coalesce(F.isnan(x), F.lit(False)) if isinstance(wide, T.DoubleType) else equal
    if both(is_text) or both(is_bool) or (type(a.type) is type(b.type) and not counts(a.type) and not is_text(a.type)):
        return a.col.eqNullSafe(b.col)
    return a.col.isNull() & b.col.isNull()


def bounds(length: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """(offset from 0, number of items) of Python's [start:end]; an end of null or -1 is the length."""
    n = length.cast("long")
    place = lambda p: F.when(p < 0, F.greatest(n + p, F.lit(0).cast("long"))).otherwise(F.least(p, n))
    first, last = place(start), F.when(end.isNull() | (end == -1), n).otherwise(place(end))
    return first.cast("int"), F.greatest(last - first, F.lit(0).cast("long")).cast("int")


def pymod(a: Column, b: Column) -> Column:
    """The remainder with the divisor's sign."""
    m = a % b
    return F.when((m != 0) & (F.signum(m) != F.signum(b)), m + b).otherwise(m)


def steps(first: Column, last: Column, by: Column | None = None) -> Column:
    """first .. last, both included, stepping towards last; a step of 0 is 1."""
    size = F.lit(1).cast("long") if by is None else F.when(by == 0, F.lit(1).cast("long")).otherwise(F.abs(by))
    return F.sequence(first, last, F.when(first <= last, size).otherwise(-size))
