"""Nodes one by one against values worked out by hand, and helper Columns against Python itself."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.flow import Flow
from loomgraph.functions import exprs as X
from loomgraph.plans.runtime import Engine


def one(spark, type, port, **inputs):
    g = Flow()
    g.out(x=g.node(type, **inputs)[port])
    return Engine(spark).table(g.payload()).first()[0]


CASES = [
    ("core.math.add", "sum", dict(a=2, b=" 3.5 "), "2 3.5 "),
    ("core.math.add", "sum", dict(a=True, b=None), 1.0),
    ("core.math.add", "sum", dict(a="x", b=1.0), "x1.0"),
    ("core.math.multiply", "product", dict(a=True, b=4), 4.0),
    ("core.math.multiply", "product", dict(a="abc", b=4), 0.0),
    ("core.math.subtract", "difference", dict(a="1e2", b="1_0"), 90.0),
    ("core.math.divide", "quotient", dict(a=1, b=0), 0.0),
    ("core.math.power", "result", dict(base=3, exponent=0), 3.0),
    ("core.math.power", "result", dict(base=3, exponent=2), 9.0),
    ("core.math.abs", "result", dict(value="-2.5"), 2.5),
    ("core.math.min", "result", dict(a=None, b=3), 0.0),
    ("core.math.max", "result", dict(a=-1, b=-3), -1.0),
    ("core.math.clamp", "result", dict(value=5, min=0, max=0), 1.0),
    ("core.math.lerp", "result", dict(a=2, b=0, t=0), 1.5),
    ("core.math.round", "result", dict(value=2.5), 2.0),
    ("core.math.round", "result", dict(value=1234.5, decimals=-2), 1200.0),
    ("core.math.floor", "result", dict(value=-0.5), -1),
    ("core.math.ceil", "result", dict(value=-0.5), 0),
    ("core.math.mod", "result", dict(a=7, b=-3), -2.0),
    ("core.math.mod", "result", dict(a=-7.5, b=0), 0.5),
    ("core.math.sqrt", "result", dict(value=-4), 0.0),
    ("core.math.sin", "result", dict(radians=0), 0.0),
    ("core.math.cos", "result", dict(radians=0), 1.0),
    ("core.math.degrees", "degrees", dict(radians=math.pi), 180.0),
    ("core.math.radians", "radians", dict(degrees=180), math.pi),
    ("core.logic.compare", "result", dict(a=1, b=1.0), True),
    ("core.logic.compare", "result", dict(a=True, b=1), True),
    ("core.logic.compare", "result", dict(a="1", b=1), False),
    ("core.logic.compare", "result", dict(a=None, b=None), True),
    ("core.logic.compare", "result", dict(a=None, b=0, op="!="), True),
    ("core.logic.compare", "result", dict(a="a", b="b", op="<"), True),
    ("core.logic.compare", "result", dict(a=1, b=2, op="<>"), False),
    ("core.logic.and", "result", dict(a="false", b=[0]), True),
    ("core.logic.or", "result", dict(a="", b=0.0), False),
    ("core.logic.not", "result", dict(value=None), True),
    ("core.string.concat", "result", dict(a=None, b=1.5), "None1.5"),
    ("core.string.upper", "result", dict(text="straße"), "STRASSE"),
    ("core.string.lower", "result", dict(text=None), ""),
    ("core.string.trim", "result", dict(text="\t a b\n "), "a b"),
    ("core.string.split", "parts", dict(text="a.b..", delimiter="."), ["a", "b", "", ""]),
    ("core.string.split", "parts", dict(text="a,b", delimiter=""), ["a", "b"]),
    ("core.string.join", "result", dict(array=[1, None, 3], delimiter="-"), "1-None-3"),
    ("core.string.replace", "result", dict(text="aXbX", find="X", replace="."), "a.b."),
    ("core.string.replace", "result", dict(text="abc", find="", replace="x"), "abc"),
    ("core.string.contains", "result", dict(text="abc", search=""), True),
    ("core.string.starts_with", "result", dict(text="abc", prefix="ab"), True),
    ("core.string.ends_with", "result", dict(text="abc", suffix="ab"), False),
    ("core.string.substring", "result", dict(text="hello", start=-3, end=-1), "llo"),
    ("core.string.substring", "result", dict(text="hello", start=1, end=-2), "el"),
    ("core.string.format", "result", dict(template="{} of {1:.2f} {2:d}", arg1="a", arg2=2.345, arg3=7), "a of 2.34 7"),
    ("core.string.format", "result", dict(template="{nope}", arg1=1), "{nope}"),
    ("core.string.format", "result", dict(template="{{}} {0}", arg1=True), "{} True"),
    ("core.cast.to_int", "value", dict(value="3.7"), 0),
    ("core.cast.to_int", "value", dict(value=" 42 "), 42),
    ("core.cast.to_int", "value", dict(value=-3.7), -3),
    ("core.cast.to_int", "value", dict(value=True), 1),
    ("core.cast.to_float", "value", dict(value="1d"), 0.0),
    ("core.cast.to_float", "value", dict(value="-inf"), -math.inf),
    ("core.cast.to_string", "value", dict(value=None), ""),
    ("core.cast.to_string", "value", dict(value=False), "False"),
    ("core.cast.to_string", "value", dict(value=[1, "a'b", None]), '[1, "a\'b", None]'),
    ("core.cast.to_boolean", "value", dict(value="false"), True),
    ("core.array.first", "value", dict(array=[]), None),
    ("core.array.last", "value", dict(array=[1, 2]), 2),
    ("core.array.slice", "result", dict(array=[1, 2], start=-5, end=-1), [1, 2]),
    ("core.array.slice", "result", dict(array=[1, 2, 3], start=1, end=-2), []),
    ("core.array.reverse", "result", dict(array=[1, 2]), [2, 1]),
    ("core.array.sort", "result", dict(array=[3, None, 1]), [3, None, 1]),
    ("core.array.sort", "result", dict(array=[3, 1], descending=True), [3, 1]),
    ("core.array.contains", "result", dict(array=[1, None], value=None), True),
    ("core.array.contains", "result", dict(array=[1, 2], value="1"), False),
    ("core.array.index_of", "index", dict(array=["a", "b"], value="c"), -1),
    ("core.array.sum", "result", dict(array=["1", "x", "2.5"]), 3.5),
    ("core.array.average", "result", dict(array=[]), 0.0),
    ("core.container.make_array", "array", dict(item_10=1, item_2=2.5), [2.5, 1.0]),
    ("core.container.append", "array", dict(array=[1], value=2), [1, 2]),
    ("core.container.get_index", "value", dict(array=[1], index=-1), None),
    ("core.container.range", "array", dict(start=5, end=1, step=2), [5, 3, 1]),
    ("core.container.range", "array", dict(start=3, end=3, step=0), [3]),
    ("core.container.length", "length", dict(value="aé😀"), 3),
    ("core.container.length", "length", dict(value=5), 0),
    ("core.container.get", "value", dict(map={"a": 1}, key="b", default=7), 7),
    ("core.container.get", "value", dict(map={"a": 1, "b": "x"}, key="b", default=""), "x"),
    ("core.json.stringify", "json_string", dict(data={"a": 1}), '{"a": 1}'),
    ("core.json.stringify", "json_string", dict(data='say "x"'), '"say \\"x\\""'),
    ("core.json.parse", "success", dict(json_string="{bad"), False),
    ("core.json.parse", "success", dict(json_string="null"), True),
    ("core.util.typeof", "type_name", dict(value=[1]), "list"),
    ("core.util.typeof", "type_name", dict(value=None), "NoneType"),
    ("core.util.is_null", "is_null", dict(value=0), False),
    ("core.util.coalesce", "value", dict(a=None, b=None, c="z"), "z"),
    ("core.util.passthrough", "value", dict(value=4), 4),
    ("core.debug.log", "value", dict(value=4, label="x"), 4),
    ("core.time.delay", "passthrough", dict(seconds=50.0, passthrough=3), 3),
    ("general.to_display", "section", dict(value=1), "Main"),
]


def test_cases_in_one_plan(spark):
    g = Flow()
    for k, (kind, port, inputs, _) in enumerate(CASES):
        g.out(**{f"x{k}": g.node(kind, **inputs)[port]})
    row = Engine(spark).table(g.payload()).first()
    wrong = [(*CASES[k][:3], row[k], CASES[k][3]) for k in range(len(CASES)) if row[k] != CASES[k][3] or type(row[k]) is not type(CASES[k][3])]
    assert not wrong


def test_errors_of_nodes(spark):
    for type, port, inputs in [("core.math.min", "result", dict(a="abc")), ("core.logic.compare", "result", dict(a=1, b="x", op="<")), ("core.math.floor", "result", dict(value="inf"))]:
        with pytest.raises(Exception):
            one(spark, type, port, **inputs)


def columns(spark, rows, schema, *exprs):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*exprs).collect()]


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("ab é😀", max_size=6), st.integers(-8, 8), st.one_of(st.none(), st.integers(-8, 8))), min_size=40, max_size=60))
def test_slices(spark, rows):
    t, s, e = F.col("t"), F.col("s"), F.col("e")
    at, n = X.bounds(F.length(t), s, e)
    got = columns(spark, rows, "t string, s long, e long", F.substring(t, at + 1, n))
    assert [x[0] for x in got] == [t[s:] if e in (None, -1) else t[s:e] for t, s, e in rows]


def test_float_texts_as_python_prints_them(spark):
    xs = [0.0, -0.0, 1.0, 1e16, 1e15, 123456789.125, 1e7, 9999999.0, 0.0001, 0.00012345, 0.00001, 1.5e-5, 2.5e-323, 1e308, 1.7976931348623157e308, 123456789012345.67, 1e22, -3.25e-9, math.inf, -math.inf, math.nan, 0.1, 1 / 3, 1e-3, 12345678.9]
    got = columns(spark, [(x,) for x in xs], "x double", X.pystr(X.Value(F.col("x"), T.DoubleType())))
    assert [g[0] for g in got] == [str(x) for x in xs]


def test_truth_and_numbers_in_text(spark):
    texts = ["", "false", " 1 ", "1e3", "1d", "0x1p3", "nan", "+Inf", "1_0", "_1", ".5", "5.", ".", "٣"]
    got = columns(spark, [(x,) for x in texts], "x string", X.truthy(X.Value(F.col("x"), T.StringType())), X.text_to_double(F.col("x")))

    def as_float(x):
        try:
            return float(x)
        except ValueError:
            return None

    want = [(bool(x), as_float(x) if x != "٣" else None) for x in texts]
    assert [(a, str(b)) for a, b in got] == [(a, str(b)) for a, b in want]


def test_parsed_json_is_a_value(spark):
    rows = ['{"a": 1, "b": [1, 2], "c": {"d": "x"}, "e": null, "f": ""}', "[]", "{}", "0", "1.0", "true", '"1"', '""', "null", "bad"]
    df = spark.createDataFrame([(k, x, n) for k, (x, n) in enumerate(zip(rows, "abcefgaaaa"))], "i int, t string, name string")
    g = Flow()
    j = g.node("core.json.parse", json_string=g.col("t")).data
    same = lambda b: g.node("core.logic.compare", a=j, b=b, op="==").result
    g.keep("i")
    g.out(
        n=g.node("core.container.length", value=j).length,
        truth=g.node("core.logic.or", a=j, b=False).result,
        flag=g.node("core.cast.to_boolean", value=j).value,
        one=same(1),
        text=same("1"),
        yes=same(True),
        none=same(None),
        empty=same([]),
        itself=same(j),
        got=g.node("core.container.get", map=j, key=g.col("name"), default="?").value,
        missing=g.node("core.util.is_null", value=j).is_null,
        unlike=g.node("core.container.get", map={"a": 1, "b": "x", "c": [2]}, key=g.col("name"), default="?").value,
    )
    frame = Engine(spark).table(g.payload(), df)
    kinds = dict(frame.dtypes)
    assert kinds["got"] == kinds["unlike"] == "variant"
    frame = frame.withColumns({c: X.pystr(X.Value(F.col(c), T.VariantType())) for c in ("got", "unlike")})
    got = {r["i"]: r.asDict() for r in frame.collect()}
    col = lambda c: [got[k][c] for k in range(len(rows))]
    assert col("n") == [5, 0, 0, 0, 0, 0, 1, 0, 0, 0]
    assert col("truth") == col("flag") == [True, False, False, False, True, True, True, False, False, False]
    assert col("one") == [False] * 4 + [True, True] + [False] * 4  # True == 1, as in Python
    assert col("text") == [False] * 6 + [True] + [False] * 3
    assert col("yes") == [False] * 4 + [True, True] + [False] * 4
    assert col("none") == col("missing") == [False] * 8 + [True, True]
    assert col("empty") == [k == 1 for k in range(10)] and all(col("itself"))
    assert col("got") == ["1", *["?"] * 9]
    assert col("unlike") == ["1", "x", "[2]", "?", "?", "?", "1", "1", "1", "1"]


def of_parsed(spark, texts, build):
    """The outputs of a graph over parsed JSON, a list of texts a column."""
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    g = Flow()
    named = build(g, g.node("core.json.parse", json_string=g.col("t")).data)
    g.keep("i").out(**{k: g.node("core.cast.to_string", value=x).value for k, x in named.items()})
    rows = sorted(Engine(spark).table(g.payload(), df, {"on_error": "collect"}).collect(), key=lambda r: r["i"])
    return {k: [r[k] for r in rows] for k in named}


def test_arithmetic_order_and_lists_of_parsed_json(spark):
    def build(g, j):
        n = lambda kind, port, **inputs: g.node(kind, **inputs)[port]
        get = lambda m, key, **d: n("core.container.get", "value", map=m, key=key, **d)
        a, items = get(j, "a"), get(j, "l")
        return {
            "equal": n("core.logic.compare", "result", a=a, b=1),
            "kind": n("core.util.typeof", "type_name", value=a),
            "twice": n("core.math.add", "sum", a=a, b=a),
            "nested": get(get(j, "b"), "c", default=0),
            "length": n("core.container.length", "length", value=items),
            "total": n("core.array.sum", "result", array=items),
            "mean": n("core.array.average", "result", array=items),
            "last": n("core.array.last", "value", array=items),
            "second": n("core.container.get_index", "value", array=items, index=1),
            "ordered": n("core.array.sort", "result", array=items, descending=True),
            "back": n("core.array.reverse", "result", array=items),
            "piece": n("core.array.slice", "result", array=items, start=1),
            "more": n("core.container.append", "array", array=items, value=a),
            "has": n("core.array.contains", "result", array=items, value=4),
            "at": n("core.array.index_of", "index", array=items, value="x"),
            "joined": n("core.string.join", "result", array=items, delimiter="+"),
            "times": n("core.math.multiply", "product", a=a, b=2),
            "most": n("core.math.max", "result", a=a, b=1.5),
            "low": n("core.math.floor", "result", value=a),
            "whole": n("core.cast.to_int", "value", value=a),
            "real": n("core.cast.to_float", "value", value=a),
            "large": n("core.logic.compare", "result", a=a, b=2, op=">"),
            "alike": n("core.logic.compare", "result", a=a, b=get(j, "z", default=True)),
            "first": n("core.util.coalesce", "value", a=get(j, "z"), b=a, c="none"),
            "listed": n("core.container.make_array", "array", item_0=a, item_1="t", item_2=items),
        }

    got = of_parsed(spark, ['{"a": 1, "b": {"c": 5}, "l": [3, 4]}', '{"a": 2.5, "b": [], "l": ["x", "10", true, null, [1.0]]}', '{"a": "7", "l": [], "z": null}', '{"a": [0], "l": {"k": 1}}'], build)
    want = {
        "equal": ["True", "False", "False", "False"],
        "kind": ["int", "float", "str", "list"],
        "twice": ["2.0", "5.0", "77", "0.0"],
        "nested": ["5", "0", "0", "0"],
        "length": ["2", "5", "0", "1"],
        "total": ["7.0", "11.0", "0.0", None],
        "mean": ["3.5", "5.5", "0.0", None],
        "last": ["4", "[1.0]", "", None],
        "second": ["4", "10", "", None],
        "ordered": ["[4, 3]", "['x', '10', True, None, [1.0]]", "[]", None],
        "back": ["[4, 3]", "[[1.0], None, True, '10', 'x']", "[]", None],
        "piece": ["[4]", "['10', True, None, [1.0]]", "[]", None],
        "more": ["[3, 4, 1]", "['x', '10', True, None, [1.0], 2.5]", "['7']", None],
        "has": ["True", "False", "False", None],
        "at": ["-1", "0", "-1", None],
        "joined": ["3+4", "x+10+True+None+[1.0]", "", None],
        "times": ["2.0", "5.0", "14.0", "0.0"],
        "most": ["1.5", "2.5", "7.0", None],
        "low": ["1", "2", "7", None],
        "whole": ["1", "2", "7", "0"],
        "real": ["1.0", "2.5", "7.0", "0.0"],
        "large": ["False", "True", None, None],
        "alike": ["True", "False", "False", "False"],
        "first": ["1", "2.5", "7", "[0]"],
        "listed": ["[1, 't', [3, 4]]", "[2.5, 't', ['x', '10', True, None, [1]]]",  # the 1.0 of a list in a list in a list
                   "['7', 't', []]", "[[0], 't', {'k': 1}]"],
    }
    assert got == want


def test_parsed_scalars(spark):
    def build(g, j):
        n = lambda kind, port, **inputs: g.node(kind, **inputs)[port]
        return {
            "twice": n("core.math.multiply", "product", a=j, b=2),
            "whole": n("core.cast.to_int", "value", value=j),
            "large": n("core.logic.compare", "result", a=j, b=2, op=">"),
            "most": n("core.math.max", "result", a=j, b=1),
            "kind": n("core.util.typeof", "type_name", value=j),
            "text": n("core.string.upper", "result", text=j),
            "five": n("core.container.get", "value", map={"5": 1, "b": "x"}, key=j, default=0),
        }

    got = of_parsed(spark, ["5", "5.0", "true", '"ab"', '"5"', "12345678901234567", "null", "bad"], build)
    assert got["twice"] == ["10.0", "10.0", "2.0", "0.0", "10.0", str(2 * float(12345678901234567)), "0.0", "0.0"]
    assert got["whole"] == ["5", "5", "1", "0", "5", "12345678901234567", "0", "0"]
    assert got["large"] == ["True", "True", "False", None, None, "True", None, None]
    assert got["most"] == ["5.0", "5.0", "1.0", None, "5.0", "1.2345678901234568e+16", "1.0", "1.0"]
    assert got["kind"] == ["int", "float", "bool", "str", "str", "int", "NoneType", "NoneType"]
    assert got["text"] == ["5", "5.0", "TRUE", "AB", "5", "12345678901234567", "", ""]
    assert got["five"] == ["0", "0", "0", "0", "1", "0", "0", "0"]


def test_json_texts_equal_json_dumps(spark):
    import datetime
    import decimal
    import json

    from loomgraph.functions.jsontext import json_rows

    schema = "s string, i long, d double, b boolean, l array<double>, m map<string,array<string>>, n map<int,string>, r struct<x:int,`a b`:string>, t timestamp, y date, c decimal(6,2)"
    at = datetime.datetime
    rows = [
        ('é\n\x01\x1f/"\\ 😀\x7f\\u00AB', 2**60, 1e16, True, [1.0, None, 1e-7, math.nan], {"ü k": ["a", None, ""]}, {3: "x"}, (1, None), at(2020, 1, 2, 3, 4, 5), datetime.date(2020, 1, 2), decimal.Decimal("1.50")),
        (None, None, math.inf, None, [], {}, {}, None, at(2020, 1, 2, 3, 4, 5, 600), None, None),
        ("", 0, -0.0, False, None, None, None, (None, "ü"), None, None, None),
    ]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k int, {schema}")
    names = df.columns
    plain = [dict(zip(names, (k, *r[:7], None if r[7] is None else dict(zip(("x", "a b"), r[7])), *r[8:]))) for k, r in enumerate(rows)]
    for pretty in (False, True):
        got = [r[0] for r in json_rows(df.coalesce(1).sortWithinPartitions("k"), pretty).collect()]
        assert got == [json.dumps(p, default=str, indent=2 if pretty else None) for p in plain]
    texts = ['{"b": [1, 2.5, {"x": null, "é": "\\u00e9\\"q"}], "a": {}, "c": [], "d": [[]]}', "1.0", "1e3", '"\\n/é"', "true", "null", "[1e-7, 12345678901234567890]"]
    g = Flow()
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    j = g.node("core.json.parse", json_string=g.col("t")).data
    g.keep("i").out(a=g.node("core.json.stringify", data=j).json_string, b=g.node("core.json.stringify", data=j, pretty=True).json_string)
    for r in Engine(spark).table(g.payload(), df).collect():
        assert r["a"] == json.dumps(json.loads(texts[r["i"]]), sort_keys=True)
        assert r["b"] == json.dumps(json.loads(texts[r["i"]]), sort_keys=True, indent=2)
    assert json_rows(df.limit(0)).count() == 0


def test_templates_from_a_column(spark):
    templates = ["{} and {}", "{0}-{0}-{1}", "{{}} {}", "{:.2f}|{:.0f}", "{0:,}", "{0:05d} {2}", "{2:8}|", "{2:s}!", "{3}", "{} {0}", "{", "}", "{nope}", "{0:x}", "{1:d}", "", "plain", "{2:.1f}", "{0:d}{1:.3f}{{{2}}}", "{:}"]
    rows = [(k, t, 12345, 2.345, "a'b") for k, t in enumerate(templates)]
    df = spark.createDataFrame(rows, "k int, t string, i long, d double, s string")
    g = Flow()
    g.keep("k").out(x=g.node("core.string.format", template=g.col("t"), arg1=g.col("i"), arg2=g.col("d"), arg3=g.col("s")).result)

    def want(t, *args):
        try:
            return t.format(*args)
        except (ValueError, IndexError, KeyError):
            return t

    got = {r["k"]: r["x"] for r in Engine(spark).table(g.payload(), df).collect()}
    expected = {k: want(t, i, d, s) for k, t, i, d, s in rows}
    expected[templates.index("{0:x}")] = "{0:x}"  # a format that is not known
    expected[templates.index("{:.2f}|{:.0f}")] = "12345.00|2"
    assert got == expected
