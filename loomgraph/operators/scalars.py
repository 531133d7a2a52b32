"""Literals, arithmetic, logic, text, casts."""

from __future__ import annotations

import re
import string
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import Parsed, Value, bounds, coerce, failing, falsy_or, is_bool, is_number, is_text, is_variant, number, pymod, pystr, same, strip, text_or_empty, text_to_double, truthy, whole
from ..registry import node, port
from .inputs import Inputs

# --- literals: the configured value as it is


def _literal(kind: str, default) -> None:
    @node(f"core.literal.{kind}", [port(f"value: {kind}", default)], [f"value: {kind}"], control=False, category="Literals")
    def literal(v: Inputs) -> Column:
        return v["value"].col

    literal.__doc__ = f"A constant {kind}."


for _kind, _default in (("int", 0), ("float", 0.0), ("string", ""), ("boolean", False)):
    _literal(_kind, _default)

# --- arithmetic on whatever comes: coerced to doubles


@node("core.math.add", [port("a"), port("b")], ["sum"], category="Math")
def add(v: Inputs) -> Column:
    """Sum of two numbers, or concatenation if either side is text."""
    a, b = v["a"], v["b"]
    if is_text(a.type) or is_text(b.type):
        return F.concat(pystr(a, ""), pystr(b, ""))
    total = coerce(a) + coerce(b)
    texts = [Parsed(x.col).text.isNotNull() for x in (a, b) if is_variant(x.type)]
    if texts:  # which of the two it is, is known a row at a time
        return F.when(reduce(lambda x, y: x | y, texts), F.concat(pystr(a, ""), pystr(b, "")).cast("variant")).otherwise(total.cast("variant"))
    return total


@node("core.math.multiply", [port("a"), port("b")], ["product: float"], category="Math")
def multiply(v: Inputs) -> Column:
    return coerce(v["a"]) * coerce(v["b"])


@node("core.math.subtract", [port("a"), port("b")], ["difference: float"], category="Math")
def subtract(v: Inputs) -> Column:
    return coerce(v["a"]) - coerce(v["b"])


@node("core.math.divide", [port("a"), port("b")], ["quotient: float"], category="Math")
def divide(v: Inputs) -> Column:
    """a / b; 0 where b is."""
    b = coerce(v["b"])
    return F.when(b == 0, F.lit(0.0)).otherwise(coerce(v["a"]) / b)


@node("core.math.power", [port("base"), port("exponent")], ["result: float"], category="Math")
def power(v: Inputs) -> Column:
    """base ** exponent; an exponent of 0 counts as 1. A base of 0 with a negative exponent is infinite."""
    e = coerce(v["exponent"])
    return F.pow(coerce(v["base"]), F.when(e == 0, F.lit(1.0)).otherwise(e))


@node("core.math.abs", [port("value")], ["result: float"], category="Math")
def absolute(v: Inputs) -> Column:
    return F.abs(coerce(v["value"]))


# --- arithmetic on numbers: unreadable text is an error


@node("core.math.min", [port("a: float", 0), port("b: float", 0)], ["result: float"], category="Math")
def minimum(v: Inputs) -> Column:
    return F.least(number(v["a"], 0), number(v["b"], 0))


@node("core.math.max", [port("a: float", 0), port("b: float", 0)], ["result: float"], category="Math")
def maximum(v: Inputs) -> Column:
    return F.greatest(number(v["a"], 0), number(v["b"], 0))


@node("core.math.clamp", [port("value: float", 0), port("min: float", 0), port("max: float", 1)], ["result: float"], category="Math")
def clamp(v: Inputs) -> Column:
    """value within min .. max; a max of 0 counts as 1."""
    return F.greatest(number(v["min"], 0), F.least(number(v["max"], 1), number(v["value"], 0)))


@node("core.math.lerp", [port("a: float", 0), port("b: float", 1), port("t: float", 0.5)], ["result: float"], category="Math")
def lerp(v: Inputs) -> Column:
    """a + (b - a) * t; a b of 0 counts as 1, a t of 0 as 0.5."""
    a = number(v["a"], 0)
    return a + (number(v["b"], 1) - a) * number(v["t"], 0.5)


@node("core.math.round", [port("value: float", 0), port("decimals: int", 0)], ["result: float"], category="Math")
def rounded(v: Inputs) -> Column:
    """Half to even; decimals may be negative, and given by the graph or by a column of -12 .. 15."""
    x = number(v["value"], 0)
    if v["decimals"].is_const:
        return F.bround(x, int(v["decimals"].const or 0))
    d = whole(v["decimals"])
    out = F.bround(x, 0)
    for k in range(-12, 16):
        out = F.when(d == k, F.bround(x, k)).otherwise(out)
    return out


@node("core.math.floor", [port("value: float", 0)], ["result: int"], category="Math")
def floor(v: Inputs) -> Column:
    x = number(v["value"], 0)
    return failing(F.isnan(x) | (F.abs(x) == float("inf")), "cannot convert to integer", F.floor(x))


@node("core.math.ceil", [port("value: float", 0)], ["result: int"], category="Math")
def ceil(v: Inputs) -> Column:
    x = number(v["value"], 0)
    return failing(F.isnan(x) | (F.abs(x) == float("inf")), "cannot convert to integer", F.ceil(x))


@node("core.math.mod", [port("a: float", 0), port("b: float", 1)], ["result: float"], category="Math")
def mod(v: Inputs) -> Column:
    """Remainder with the sign of b; a b of 0 counts as 1."""
    return pymod(number(v["a"], 0), number(v["b"], 1))


@node("core.math.sqrt", [port("value: float", 0)], ["result: float"], category="Math")
def sqrt(v: Inputs) -> Column:
    """Square root; 0 of negative numbers."""
    return F.sqrt(F.greatest(F.lit(0.0), number(v["value"], 0)))


@node("core.math.sin", [port("radians: float", 0)], ["result: float"], category="Math")
def sin(v: Inputs) -> Column:
    return F.sin(number(v["radians"], 0))


@node("core.math.cos", [port("radians: float", 0)], ["result: float"], category="Math")
def cos(v: Inputs) -> Column:
    return F.cos(number(v["radians"], 0))


@node("core.math.degrees", [port("radians: float", 0)], ["degrees: float"], category="Math")
def degrees(v: Inputs) -> Column:
    return F.degrees(number(v["radians"], 0))


@node("core.math.radians", [port("degrees: float", 0)], ["radians: float"], category="Math")
def radians(v: Inputs) -> Column:
    return F.radians(number(v["degrees"], 0))


# --- logic


def _ordered_forms(v: Value) -> tuple[Column, Column]:
    """(as a number, as a text), null where it is neither."""
    if is_variant(v.type):
        return Parsed(v.col).counted, Parsed(v.col).text
    number_, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    if is_bool(v.type) or is_number(v.type):
        number_ = (v.col.cast("int") if is_bool(v.type) else v.col).cast("double")
    return number_, v.col if is_text(v.type) else text


@node("core.logic.compare", [port("a"), port("b"), port("op: string", "==")], ["result: boolean"], category="Logic")
def compare(v: Inputs) -> Column:
    """== != > >= < <=; any other op is false. Ordering null or unlike kinds is an error."""
    a, b = v["a"], v["b"]
    counts = lambda t: is_number(t) or is_bool(t)
    if (counts(a.type) and counts(b.type)) or (is_text(a.type) and is_text(b.type)) or (type(a.type) is type(b.type) and isinstance(a.type, (T.ArrayType, T.TimestampType, T.DateType))):
        x, y = (w.col.cast("int") if is_bool(w.type) else w.col for w in (a, b))
        tests, bad, message = {">": x > y, ">=": x >= y, "<": x < y, "<=": x <= y}, x.isNull() | y.isNull(), "cannot order null"
    elif is_variant(a.type) or is_variant(b.type):
        (m, s), (n, t) = _ordered_forms(a), _ordered_forms(b)
        tests = {">": F.coalesce(m > n, s > t), ">=": F.coalesce(m >= n, s >= t), "<": F.coalesce(m < n, s < t), "<=": F.coalesce(m <= n, s <= t)}
        bad, message = (m.isNull() | n.isNull()) & (s.isNull() | t.isNull()), "cannot order null or unlike kinds"
    else:
        tests, bad, message = dict.fromkeys((">", ">=", "<", "<="), F.lit(None).cast("boolean")), F.lit(True), f"cannot order {a.type.simpleString()} and {b.type.simpleString()}"
    op = v["op"]
    asked = lambda k: F.lit(op.const == k) if op.is_const else F.coalesce(op.col == k, F.lit(False))
    wanted = [op.const] if op.is_const else list(tests)
    options = {"==": same(a, b), "!=": ~same(a, b)} | {k: failing(bad & asked(k), message, t) for k, t in tests.items() if k in wanted}
    if v["op"].is_const:
        return options.get(v["op"].const, F.lit(False))
    out = F.lit(False)
    for k, test in options.items():
        out = F.when(v["op"].col == k, test).otherwise(out)
    return out


@node("core.logic.and", [port("a: boolean", False), port("b: boolean", False)], ["result: boolean"], category="Logic")
def both(v: Inputs) -> Column:
    return truthy(v["a"]) & truthy(v["b"])


@node("core.logic.or", [port("a: boolean", False), port("b: boolean", False)], ["result: boolean"], category="Logic")
def either(v: Inputs) -> Column:
    return truthy(v["a"]) | truthy(v["b"])


@node("core.logic.not", [port("value: boolean", False)], ["result: boolean"], category="Logic")
def negated(v: Inputs) -> Column:
    return ~truthy(v["value"])


# --- text


@node("core.string.concat", [port("a", ""), port("b", "")], ["result: string"], category="String")
def concat(v: Inputs) -> Column:
    """The text forms of both; a null one is 'None'."""
    return F.concat(pystr(v["a"]), pystr(v["b"]))


@node("core.string.upper", [port("text: string", "")], ["result: string"], category="String")
def upper(v: Inputs) -> Column:
    return F.upper(text_or_empty(v["text"]))


@node("core.string.lower", [port("text: string", "")], ["result: string"], category="String")
def lower(v: Inputs) -> Column:
    return F.lower(text_or_empty(v["text"]))


@node("core.string.trim", [port("text: string", "")], ["result: string"], category="String")
def trim(v: Inputs) -> Column:
    """Without white space of any kind at either end."""
    return strip(text_or_empty(v["text"]))


def _quoted(delimiter: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.regexp_replace(delimiter, r"\\E", r"\\E\\\\E\\Q"), F.lit(r"\E"))


@node("core.string.split", [port("text: string", ""), port("delimiter: string", ",")], ["parts: list<string>"], category="String")
def split(v: Inputs) -> Column:
    """At each literal delimiter (',' if empty), empty parts kept."""
    text, d = text_or_empty(v["text"]), v.const("delimiter", ",")
    return F.split(text, re.escape(d) if d is not None else _quoted(falsy_or(v["delimiter"], ",")), -1)


@node("core.string.join", [port("array: list<any>"), port("delimiter: string", ",")], ["result: string"], category="String")
def join(v: Inputs) -> Column:
    """The items' text forms with the delimiter (',' if empty) between; a null item is 'None'."""
    arr, t = v.array("array")
    return F.call_function("array_join", F.transform(arr, lambda x: pystr(Value(x, t.elementType))), falsy_or(v["delimiter"], ","))


@node("core.string.replace", [port("text: string", ""), port("find: string", ""), port("replace: string", "")], ["result: string"], category="String")
def replace(v: Inputs) -> Column:
    """Every literal find replaced; an empty find changes nothing."""
    return F.replace(text_or_empty(v["text"]), text_or_empty(v["find"]), text_or_empty(v["replace"]))


@node("core.string.contains", [port("text: string", ""), port("search: string", "")], ["result: boolean"], category="String")
def contains(v: Inputs) -> Column:
    return F.contains(text_or_empty(v["text"]), text_or_empty(v["search"]))


@node("core.string.starts_with", [port("text: string", ""), port("prefix: string", "")], ["result: boolean"], category="String")
def starts_with(v: Inputs) -> Column:
    return F.startswith(text_or_empty(v["text"]), text_or_empty(v["prefix"]))


@node("core.string.ends_with", [port("text: string", ""), port("suffix: string", "")], ["result: boolean"], category="String")
def ends_with(v: Inputs) -> Column:
    return F.endswith(text_or_empty(v["text"]), text_or_empty(v["suffix"]))


def _end(v: Inputs) -> Column:
    e = v["end"]
    return F.lit(None).cast("long") if e.is_null else e.col.cast("long")


@node("core.string.substring", [port("text: string", ""), port("start: int", 0), port("end: int", -1)], ["result: string"], category="String")
def substring(v: Inputs) -> Column:
    """text[start:end] as Python slices; an end of -1 or null is the end of the text."""
    t = text_or_empty(v["text"])
    at, n = bounds(F.length(t), whole(v["start"]), _end(v))
    return F.substring(t, at + 1, n)


@node("core.string.format", [port("template: string", ""), port("arg1", ""), port("arg2", ""), port("arg3", "")], ["result: string"], category="String")
def format_text(v: Inputs) -> Column:
    """template.format(arg1, arg2, arg3) for {}, {0} and number formats such as {1:.2f}, {:d}, {:,}; a template
    with anything else, or one that names an argument that is not there, comes out as it is.

    A template of the graph is read when the plan is made, one from a column row by row.
    """
    args = [v["arg1"], v["arg2"], v["arg3"]]
    if not v["template"].is_const:
        return _formatted_rows(text_or_empty(v["template"]), args)
    template = str(v["template"].const or "")
    try:
        parts, auto = [], 0
        for text, name, spec, conversion in string.Formatter().parse(template):
            if text:
                parts.append(F.lit(text))
            if name is None:
                continue
            at = auto if name == "" else int(name)
            auto += name == ""
            if conversion or not 0 <= at < len(args):
                raise ValueError(name)
            parts.append(_formatted(args[at], spec or ""))
    except ValueError:
        return F.lit(template)
    return F.concat(*parts) if parts else F.lit("")


#: Parts of a template: doubled braces, a field, text between them, a brace that stands alone.
_PARTS = r"\{\{|\}\}|\{\d*(?::[^{}]*)?\}|[^{}]+|[{}]"
_FIELD = r"^\{(\d*)(?::([^{}]*))?\}$"
_SPEC = r"^(0?\d*)(,?)(?:\.(\d+))?([dfs]?)$"


def _formatted_rows(template: Column, args: list[Value]) -> Column:
    """The template of each row, filled; as it is where a part of it cannot be."""
    parts = F.regexp_extract_all(template, F.lit(_PARTS), F.lit(0))
    is_field = lambda x: x.rlike(_FIELD)
    unnumbered = lambda x: x.rlike(r"^\{(?::[^{}]*)?\}$")

    def filled(part: Column, i: Column) -> Column:
        own = F.regexp_extract(part, _FIELD, 1)
        # a field without a number takes the next argument
        before = F.size(F.filter(F.slice(parts, F.lit(1), i), unnumbered))
        at = F.when(own == "", before).otherwise(own.try_cast("int"))
        spec = F.regexp_extract(part, _FIELD, 2)
        out = F.lit(None).cast("string")
        for k, a in enumerate(args):
            out = F.when(at == k, F.when(spec == "", pystr(a)).otherwise(_formatted_by(a, spec))).otherwise(out)
        return F.when(part == "{{", "{").when(part == "}}", "}").when(is_field(part), out).when(~part.isin("{", "}"), part)

    known = F.transform(parts, filled)
    mixed = F.exists(parts, unnumbered) & F.exists(parts, lambda x: is_field(x) & ~unnumbered(x))
    return F.when(mixed | F.exists(known, lambda x: x.isNull()), template).otherwise(F.array_join(known, ""))


def _formatted_by(a: Value, spec: Column) -> Column:
    """A value by a spec of the row; null where the spec does not suit it."""
    width, comma, digits, kind = (F.regexp_extract(spec, _SPEC, k) for k in range(1, 5))
    known = spec.rlike(_SPEC)
    if is_text(a.type):
        suits = known & kind.isin("", "s") & (comma == "") & (digits == "") & ~F.startswith(width, F.lit("0"))
        return F.when(suits, F.rpad(a.col, F.greatest(F.length(a.col), F.coalesce(width.try_cast("int"), F.lit(0))), F.lit(" ")))
    if not is_number(a.type):
        return F.lit(None).cast("string")
    is_whole = not isinstance(a.type, (T.DoubleType, T.FloatType, T.DecimalType))
    as_whole = known & ((kind == "d") | (kind == "")) & (digits == "") if is_whole else F.lit(False)
    shown = F.call_function("format_string", F.concat(F.lit("%"), comma, width, F.lit("d")), a.col.cast("long")) if is_whole else F.lit(None).cast("string")
    places = F.when(digits == "", 6).otherwise(digits.try_cast("int"))
    rounded_ = F.lit(None).cast("double")
    for k in range(13):  # half to even on the shown digits, as bround has them for a number that the plan knows
        rounded_ = F.when(places == k, F.bround(a.col.cast("double"), k)).otherwise(rounded_)
    real = F.call_function("format_string", F.concat(F.lit("%"), comma, width, F.lit("."), places.cast("string"), F.lit("f")), F.coalesce(rounded_, a.col.cast("double")))
    return F.when(a.col.isNull(), None).when(as_whole, shown).when(known & (kind == "f"), real)


def _formatted(a: Value, spec: str) -> Column:
    if not spec:
        return pystr(a)
    m = re.fullmatch(r"(0?\d*)(,?)(?:\.(\d+))?([dfs]?)", spec)
    if not m:
        raise ValueError(spec)
    width, comma, digits, kind = m.groups()
    if is_text(a.type) and kind in ("", "s") and not comma and digits is None and not width.startswith("0"):
        return F.rpad(a.col, F.greatest(F.length(a.col), F.lit(int(width or 0))), F.lit(" "))
    if not is_number(a.type) or kind == "s":
        raise ValueError(spec)
    whole_type = not isinstance(a.type, (T.DoubleType, T.FloatType, T.DecimalType))
    if kind == "d" or (kind == "" and whole_type and digits is None):
        if not whole_type:
            raise ValueError(spec)
        return F.format_string(f"%{comma}{width}d", a.col.cast("long"))
    if kind != "f":
        raise ValueError(spec)
    # half to even on the shown digits, as bround has them
    places = int(digits) if digits is not None else 6
    return F.format_string(f"%{comma}{width}.{places}f", F.bround(a.col.cast("double"), places))


# --- casts


def _text_to_int(c: Column) -> Column:
    s = strip(c)
    return F.when(s.rlike(r"^[+-]?\d+(?:_\d+)*$"), F.regexp_replace(s, "_", "")).try_cast("long")


@node("core.cast.to_int", [port("value")], ["value: int"], category="Cast")
def to_int(v: Inputs) -> Column:
    """Cut towards 0; null, '' and text that is no whole number (3.7 too) are 0."""
    a = v["value"]
    if is_text(a.type):
        return F.coalesce(_text_to_int(a.col), F.lit(0).cast("long"))
    if is_bool(a.type) or is_number(a.type):
        c = F.when(~F.isnan(a.col.cast("double")), a.col).cast("long") if isinstance(a.type, (T.DoubleType, T.FloatType)) else a.col.cast("long")
        return F.coalesce(c, F.lit(0).cast("long"))
    if is_variant(a.type):
        p = Parsed(a.col)
        exact = F.when(p.is_whole, p.digits.try_cast("long"))  # a double would lose the last digits
        return F.coalesce(_text_to_int(p.text), exact, p.counted.try_cast("long"), F.lit(0).cast("long"))
    return F.lit(0).cast("long")


@node("core.cast.to_float", [port("value")], ["value: float"], category="Cast")
def to_float(v: Inputs) -> Column:
    a = v["value"]
    return F.coalesce(text_to_double(a.col), F.lit(0.0)) if is_text(a.type) else coerce(a)


@node("core.cast.to_string", [port("value")], ["value: string"], category="Cast")
def to_string(v: Inputs) -> Column:
    """The text form; '' of null."""
    return pystr(v["value"], "")


@node("core.cast.to_boolean", [port("value")], ["value: boolean"], category="Cast")
def to_boolean(v: Inputs) -> Column:
    """Truth of the value: text is true unless empty."""
    return truthy(v["value"])
