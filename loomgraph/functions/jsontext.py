"""JSON texts as Python's json.dumps writes them, from the types alone: built-in Columns, no Python in the tasks.

Separators are ', ' and ': ', all beyond ASCII is escaped, numbers are printed as Python prints them, NaN and the
infinities by name, and what JSON has no form for (times, decimals, binary) as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .exprs import Parsed, Value, is_bool, is_number, is_text, is_variant, pystr, tokens, unquoted

INDENT = 2
_ESCAPES = r"\\u[0-9A-F]{4}|\\.|[^\\]+"


def quoted(c: Column) -> Column:
    """A JSON string, ASCII alone, hexadecimal digits in lower case."""
    j = F.to_json(F.array(c), {"writeNonAsciiCharacterAsCodePoint": "true"})
    plain = F.replace(F.substring(j, F.lit(2), F.length(j) - 2), F.lit("\x7f"), F.lit("\\u007f"))
    parts = F.regexp_extract_all(plain, F.lit(_ESCAPES), F.lit(0))
    lower = F.transform(parts, lambda x: F.when(x.rlike(r"^\\u[0-9A-F]{4}$"), F.lower(x)).otherwise(x))
    return F.when(c.isNull(), None).when(F.contains(plain, F.lit("\\u")), F.array_join(lower, "")).otherwise(plain)


def _double(c: Column) -> Column:
    named = F.when(c.isNull(), None).when(F.isnan(c), "NaN").when(c == float("inf"), "Infinity").when(c == float("-inf"), "-Infinity")
    return named.otherwise(pystr(Value(c, T.DoubleType())))


def _time(c: Column, t: T.DataType) -> Column:
    """A date or a time as Python prints it: six digits of a second, or none."""
    if isinstance(t, T.DateType):
        return c.cast("string")
    at = c.cast("timestamp_ntz")
    return F.when(F.date_format(at, "SSSSSS") == "000000", F.date_format(at, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def _held(opening: str, parts: Column, closing: str, level: int | None) -> Column:
    """Parts of a list or an object (none: both signs together); level: how deep it stands, if lines are broken."""
    if level is None:
        return F.concat(F.lit(opening), F.array_join(parts, ", "), F.lit(closing))
    inner, outer = "\n" + " " * INDENT * (level + 1), "\n" + " " * INDENT * level
    return F.when(F.size(parts) == 0, opening + closing).otherwise(F.concat(F.lit(opening + inner), F.array_join(parts, "," + inner), F.lit(outer + closing)))


def _text(c: Column, t: T.DataType, level: int | None) -> Column:
    """Null where the value is."""
    item = lambda x, u: F.coalesce(_text(x, u, None if level is None else level + 1), F.lit("null"))
    if is_text(t):
        return quoted(c)
    if is_bool(t):
        return c.cast("string")
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return _double(c.cast("double"))
    if is_number(t) and not isinstance(t, T.DecimalType):
        return c.cast("string")
    if isinstance(t, T.ArrayType):
        return _held("[", F.transform(c, lambda x: item(x, t.elementType)), "]", level)
    if isinstance(t, T.MapType):
        key = lambda k: quoted(k) if is_text(t.keyType) else quoted(_text(k, t.keyType, None))
        return _held("{", F.transform(F.map_entries(c), lambda e: F.concat(key(e["key"]), F.lit(": "), item(e["value"], t.valueType))), "}", level)
    if isinstance(t, T.StructType):
        # of the value alone a name can be escaped when the plan is made
        parts = [F.concat(quoted(F.lit(f.name)), F.lit(": "), item(c[f.name], f.dataType)) for f in t.fields]
        return F.when(c.isNotNull(), _held("{", F.array(*parts).cast("array<string>"), "}", level))
    if is_variant(t):
        return _parsed(c, level)
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return quoted(_time(c, t))
    return quoted(c.cast("string"))


def _parsed(c: Column, level: int | None) -> Column:
    """Parsed JSON by the tokens of its compact text; a number alone keeps its kind, within lists and objects 1.0 is 1."""
    p = Parsed(c)
    alone = F.when(p.null, "null").when(p.is_whole, p.digits).when(p.number.isNotNull(), _double(p.number)).when(p.boolean.isNotNull(), p.boolean.cast("string")).when(p.text.isNotNull(), quoted(p.text))

    def written(x: Column) -> Column:
        return F.when(x == ":", ": ").when(F.startswith(x, F.lit('"')), quoted(unquoted(x))).when(x.rlike(r"^-?\d.*[.eE]"), _double(x.try_cast("double"))).otherwise(x)

    parts = F.transform(tokens(p.json), written)
    if level is None:
        return F.when(c.isNotNull(), F.coalesce(alone, F.array_join(F.transform(parts, lambda x: F.when(x == ",", ", ").otherwise(x)), "")))

    def step(a: Column, x: Column) -> Column:
        closes, opened = x.isin("]", "}"), a["last"].isin("[", "{")
        depth = a["depth"] - closes.cast("int")
        line = F.concat(F.lit("\n"), F.repeat(F.lit(" "), depth * INDENT))
        broken = F.when(closes, ~opened).otherwise(opened | (a["last"] == ","))
        return F.struct(F.concat(a["out"], F.when(broken, line).otherwise(""), x).alias("out"), (depth + x.isin("[", "{").cast("int")).alias("depth"), x.alias("last"))

    start = F.struct(F.lit("").alias("out"), F.lit(level).alias("depth"), F.lit("").alias("last"))
    return F.when(c.isNotNull(), F.coalesce(alone, F.aggregate(parts, start, step, lambda a: a["out"])))


def json_text(v: Value, pretty: bool = False) -> Column:
    """json.dumps(value, default=str), with indent=2 if pretty. Keys of parsed JSON are in order, those of maps and structs as they stand."""
    return F.lit("null") if v.is_null else F.coalesce(_text(v.col, v.type, 0 if pretty else None), F.lit("null"))


def json_rows(df: DataFrame, pretty: bool = False, name: str = "json") -> DataFrame:
    """One JSON object a row, with the table's columns by name: what a run puts out, as clients are sent it. An empty table gives no rows."""
    fields = F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns))
    return df.select(json_text(Value(fields, df.schema), pretty).alias(name))
