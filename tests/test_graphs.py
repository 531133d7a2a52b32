"""Validation, orders, runs in part, control flow, cache, traces."""

import pytest
from pyspark.sql import functions as F

from loomgraph.flow import Flow, Step
from loomgraph.plans import edges, trace
from loomgraph.plans.graph import Graph, GraphError
from loomgraph.plans.runtime import Cancellation, Engine
from loomgraph.registry import NodeSpec, Registry
from loomgraph.types import PortType, compatible, type_label


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark)


def simple():
    g = Flow()
    g.out(sum=g.node("core.math.add", id="add", a=g.node("core.literal.int", id="a", value=5).value, b=g.node("core.literal.int", id="b", value=3).value).sum)
    return g.payload()


def test_simple_graph(engine):
    out = engine.run(simple())
    assert out["outputs"] == {"sum": 8} and len(out["trace"]) == 3 and out["stats"]["total_nodes"] == 3
    assert engine.plan(simple())["total_nodes"] == 3 and [x["nodes"] for x in engine.plan(simple())["levels"]] == [["a", "b"], ["add"]]
    events = [e["event"] for e in engine.stream(simple())]
    assert events == ["start", *["node_completed"] * 3, "complete", "result"]
    assert engine.run_async(simple()).result()["outputs"] == {"sum": 8.0}


def code(payload):
    with pytest.raises(GraphError) as e:
        Graph(payload)
    return e.value.code


def test_codes_of_invalid_graphs(engine):
    n = lambda i, t="core.literal.int": {"id": i, "type": t}
    link = lambda a, p, b, q, **k: {"from_node": a, "from_port": p, "to_node": b, "to_port": q} | k
    add = n("add", "core.math.add")
    assert code({"nodes": []}) == "empty_graph"
    assert code({"nodes": [n("a", "no.such")]}) == "unknown_node"
    assert code({"nodes": [n("a"), n("a")]}) == "duplicate_id"
    assert code({"nodes": [{"id": "a"}]}) == "missing_type" and code({"nodes": [{"type": "core.literal.int"}]}) == "missing_id"
    assert code({"nodes": [n("a"), add], "links": [link("a", "value", "x", "a")]}) == "unknown_node"
    assert code({"nodes": [n("a"), add], "links": [link("a", "nope", "add", "a")]}) == "missing_output_port"
    assert code({"nodes": [n("a"), add], "links": [link("a", "value", "add", "nope")]}) == "missing_input_port"
    assert code({"nodes": [n("a"), add], "links": [link("a", "value", "add", "a")] * 2}) == "duplicate_link"
    assert code({"nodes": [n("s", "core.literal.string"), n("f", "core.math.floor")], "links": [link("s", "value", "f", "value")]}) == "type_mismatch"
    assert code({"nodes": [add, n("b", "core.math.add")], "links": [link("add", "sum", "b", "a"), link("b", "sum", "add", "a")]}) == "cycle"
    assert code({"nodes": [n("a")], "output_nodes": [{"node_id": "a", "port": "x"}]}) == "missing_output_port"


def diamond():
    g = Flow()
    a = g.node("core.literal.int", id="a", value=2)
    b = g.node("core.math.multiply", id="b", a=a.value, b=3)
    c = g.node("core.math.multiply", id="c", a=a.value, b=5)
    d = g.node("core.math.add", id="d", a=b.product, b=c.product)
    g.node("core.math.abs", id="e", value=d.sum)
    return g


def test_closures_paths_and_partial_runs(engine):
    g = Graph(diamond().payload())
    assert g.ancestors(["d"]) == {"a", "b", "c", "d"} and g.descendants(["b"]) == {"b", "d", "e"} and g.descendants(["a"], stop={"b", "c"}) == {"a"}
    assert g.paths("a", "d") == [["a", "b", "d"], ["a", "c", "d"]] and g.levels == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3}
    order = lambda **o: set(g.selection(o)[0])
    assert order(mode="selection", target_nodes=["b"]) == {"a", "b"} and order(mode="from_node", entry_nodes=["d"]) == set("abcde")
    assert g.selection({"mode": "from_node", "entry_nodes": ["d"]})[1] == {"d", "e"}
    assert len(order(max_steps=2)) == 2 and order(breakpoints=["d"]) == {"a", "b", "c"}
    assert set(engine.run(diamond().payload(), {"mode": "selection", "target_nodes": ["b"]})["outputs"]) == {"a.value", "b.product"}


def test_ifelse_skips_a_side(engine):
    for condition in (True, False):
        g = Flow()
        branch = g.node("core.control.ifelse", id="if", condition=g.node("core.literal.boolean", value=condition).value)
        yes, no = g.node("core.debug.log", id="yes", value=1, label="t"), g.node("core.debug.log", id="no", value=2)
        branch.then(yes, port="true")
        branch.then(no, port="false")
        trace = {t["node_id"]: t for t in engine.run(g.payload())["trace"]}
        ran, skipped = ("yes", "no") if condition else ("no", "yes")
        assert trace[ran]["status"] == "COMPLETED" and trace[skipped]["status"] == "SKIPPED"
        assert trace["yes"]["logs"] == (["[t] 1"] if condition else [])


def test_variables_in_nested_branches_and_loops(engine, spark):
    g = Flow()
    start = g.node("core.var.declare", name="odd", value=0)
    loop = g.node("core.control.for", first_index=g.col("id"), last_index=0)
    odd = g.node("core.math.mod", a=loop.index, b=2)
    truth = g.node("core.cast.to_boolean", value=odd.result)
    branch = g.node("core.control.ifelse", condition=truth.value)
    held = g.node("core.var.get", name="odd")
    more = g.node("core.math.add", a=held.value, b=1)
    put = g.node("core.var.set", name="odd", value=more.sum)
    after = g.node("core.var.get", name="odd")
    start.then(loop)
    loop.then(odd, truth, branch, port="loop_body")
    branch.then(held, more, put, port="true")
    loop.then(after, port="completed")
    g.out(id=g.col("id"), odd=after.value, last=loop.index)
    rows = Engine(spark).table(g.payload(), spark.range(6)).collect()
    assert [tuple(r) for r in rows] == [(k, float((k + 1) // 2), 0) for k in range(6)]


def test_a_loop_over_nothing_and_an_unset_variable(engine):
    g = Flow()
    loop = g.node("core.control.repeat", count=0)
    body = g.node("core.math.add", a=loop.index, b=1)
    loop.then(body, port="loop_body")
    g.out(i=loop.index, b=body.sum, v=g.node("core.var.get", name="none", default="d").value)
    assert engine.run(g.payload())["outputs"] == {"i": 0, "b": None, "v": "d"}


def test_errors_stay_with_their_branch(engine):
    g = Flow()
    bad = g.node("core.math.sqrt", id="bad", value="abc")
    g.node("core.math.abs", id="after", value=bad.result)
    g.node("core.math.abs", id="free", value=-1)
    out = engine.run(g.payload())
    status = {t["node_id"]: (t["status"], t["error"]) for t in out["trace"]}
    assert status["bad"][0] == "ERROR" and "abc" in status["bad"][1] and status["after"] == ("ERROR", "dependency_failed") and status["free"][0] == "COMPLETED"
    assert out["stats"]["error_nodes"] == 2


def test_cache(spark):
    engine = Engine(spark)
    g = Flow()
    g.out(x=g.node("core.math.multiply", id="m", cached=True, a=g.col("id"), b=2).product)
    source = spark.range(4)
    engine.table(g.payload(), source)
    assert engine.cache.stats() == {"size": 1, "by_type": {"core.math.multiply": 1}}
    assert engine.compile(g.payload(), source).cached == {"m"}
    assert not engine.compile(g.payload(), source, {"force_no_cache_nodes": ["m"]}).cached and not engine.compile(g.payload(), source, {"use_cache": False}).cached
    assert engine.cache.clear(type="no.such") == 0 and engine.cache.clear(nodes={"m"}) == 1 and engine.cache.size == 0


def test_a_changed_graph_never_meets_an_old_frame(spark):
    engine, source = Engine(spark), spark.range(3)

    def run(factor, mark=2, extra=False, **options):
        g = Flow()
        start = g.node("core.var.declare", id="d", name="v", value=mark)
        a = g.node("core.math.add", id="a", cached=True, a=g.node("core.var.get", id="got", name="v").value, b=g.col("id"))
        b = g.node("core.math.multiply", id="b", a=a.sum, b=factor)
        start.then(a)
        g.out(b=b.product)
        if extra:
            g.out(c=g.node("core.math.add", id="c", cached=True, a=b.product, b=0.5).sum)
        run = engine.compile(g.payload(), source, options)
        engine.forget(run)
        return [tuple(r) for r in run.frame.collect()], run.cached

    assert run(2) == ([(4.0,), (6.0,), (8.0,)], set()) and run(2) == ([(4.0,), (6.0,), (8.0,)], {"a"})
    assert run(5) == ([(10.0,), (15.0,), (20.0,)], {"a"})  # the kept prefix, the rest anew
    assert run(5, mark=1) == ([(5.0,), (10.0,), (15.0,)], set())  # a value before the mark
    assert run(5, extra=True) == ([(10.0, 10.5), (15.0, 15.5), (20.0, 20.5)], {"a"})
    assert run(5, extra=True)[1] == {"a", "c"} and run(6, extra=True) == ([(12.0, 12.5), (18.0, 18.5), (24.0, 24.5)], {"a"})
    assert run(5, on_error="collect")[1] == set() and run(5, force_no_cache_nodes=["d"])[1] == set()
    assert run(5, invalidate_cache_nodes=["a"])[1] == set()


def test_tables_that_are_written_anew_are_read_anew(spark, tmp_path):
    engine, path = Engine(spark), str(tmp_path / "t")

    def run(n):
        spark.range(n).write.mode("overwrite").parquet(path)
        g = Flow()
        g.out(x=g.node("core.math.multiply", id="m", cached=True, a=g.col("id"), b=2).product)
        return engine.table(g.payload(), spark.read.parquet(path)).count()

    assert [run(3), run(5)] == [3, 5]


def test_cancellation(engine):
    c = Cancellation()
    assert not c.is_cancelled("n")
    c.cancel("n")
    assert c.is_cancelled("n") and not c.is_cancelled("m")
    c.cancel()
    assert c.is_cancelled("m")
    c.reset()
    assert not c.is_cancelled("n") and engine.cancel("unknown") is False
    run = engine.compile(simple(), None, {"execution_id": "x"})
    assert engine.cancel("x") is True and run.cancellation.all


def test_no_python_and_one_scan_in_a_graph_over_a_table(engine, spark):
    g = Flow()
    q = g.col("l_quantity")
    g.out(x=g.node("core.math.clamp", value=g.node("core.math.multiply", a=q, b=2).product, max=10).result)
    g.node("core.math.multiply", a=g.col("l_tax"), b=3)
    plan = engine.table(g.payload(), spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ReadSchema: struct<l_quantity:double>" in plan and "Exchange" not in plan


def test_conditions_reach_the_scan(engine, spark):
    g = Flow()
    g.node("core.table.filter", condition=g.node("core.logic.compare", a=g.col("l_returnflag"), b="R").result)
    g.out(q=g.col("l_quantity"))
    plan = engine.table(g.payload(), spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "l_returnflag" in plan.split("PushedFilters")[1].split("]")[0]


def test_types():
    assert PortType.of("number").kind == "float" and PortType.of(None).kind == "any" and PortType.of({"kind": "map", "elementType": "int"}).value.kind == "int"
    assert compatible("int", "float") and not compatible("float", "int") and compatible("any", "int")
    assert not compatible({"kind": "string", "nullable": True}, "string") and compatible({"kind": "int", "nullable": True}, "float")
    assert compatible({"kind": "list", "item": "int"}, {"kind": "list", "item": "float"}) and not compatible({"kind": "list", "item": "string"}, {"kind": "list", "item": "int"})
    wide, narrow = {"kind": "record", "fields": {"name": "string", "age": "int"}}, {"kind": "record", "fields": {"name": "string"}}
    assert compatible(wide, narrow) and not compatible(narrow, wide)
    tensor = lambda d: {"kind": "tensor", "metadata": {"dtype": d}}
    assert not compatible(tensor("float32"), tensor("float64")) and compatible(tensor("float32"), "tensor")
    labels = ["list<list<int>>", "map<int>", "int?", "{name: string, age: int}", "tensor<float32>", "string?"]
    raw = [{"kind": "list", "item": {"kind": "list", "item": "int"}}, {"kind": "map", "value": "int"}, {"kind": "option", "item": "int"}, wide, tensor("float32"), {"kind": "string", "nullable": True}]
    assert [type_label(x) for x in raw] == labels
    assert PortType.of(wide).spark().simpleString() == "struct<name:string,age:bigint>"


def test_registry_aliases_and_plugins(engine):
    r = Registry()
    r.add(NodeSpec("camera.x", (), (), lambda v: None))
    r.alias_prefix("vendor.", "camera.")
    assert r.get("vendor.x").type == "camera.x" and r.get("vendor.y") is None

    class Point:
        def __init__(self, name, f):
            self.name, self.load = name, lambda: f

    assert r.load_plugins([Point("good", lambda reg: reg.add(NodeSpec("p.q", (), (), lambda v: None))), Point("bad", lambda reg: 1 / 0)]) == ["good"]
    assert "p.q" in r.specs and "ZeroDivisionError" in r.failures["bad"]
    assert len(engine.definitions()) >= 94 and all(d["input_ports"] is not None for d in engine.definitions())


def test_partial_runs_without_known_nodes_are_whole_and_runs_are_forgotten(spark):
    engine = Engine(spark)
    g = Graph(diamond().payload())
    for o in ({"mode": "selection"}, {"mode": "selection", "target_nodes": ["zz"]}, {"mode": "from_node", "entry_nodes": ["zz"]}):
        assert set(g.selection(o)[0]) == set("abcde")
    assert set(g.selection({"mode": "selection", "target_nodes": ["zz", "b"]})[0]) == {"a", "b"}
    list(engine.stream(simple()))
    engine.run(simple())
    assert not engine._running


def test_durations_are_not_made_up_and_fail_fast_ends_the_trace(engine):
    out = engine.run(simple())
    assert [t["duration_ms"] for t in out["trace"]] == [None] * 3 and out["stats"]["node_time_ms"] is None and out["stats"]["total_time_ms"] > 0
    assert engine.trace_table(out["trace"]).where("duration_ms is null").count() == 3
    g = Flow()
    g.node("core.math.sqrt", id="bad", value="abc")
    g.node("core.math.abs", id="later", value=g.node("core.math.abs", id="free", value=-1).result)
    ids = lambda **o: [t["node_id"] for t in engine.run(g.payload(), o)["trace"]]
    assert set(ids()) == {"bad", "free", "later"}
    assert ids(fail_fast=True)[-1] == "bad" and "later" not in ids(fail_fast=True)


@pytest.fixture(params=["one task", "rounds"])
def walked(request, monkeypatch):
    """Both ways to walk a table of edges."""
    monkeypatch.setattr(edges, "LOCAL_EDGES", 200_000 if request.param == "one task" else -1)


def table_of(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_closure_ends_on_cycles(spark, walked):
    e = table_of(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "c"), ("x", "a"), (None, "q"), ("a", "b")])
    assert set(map(tuple, edges.closure(e, "a").collect())) == {("a", 0), ("b", 1), ("c", 2)}
    cut = spark.createDataFrame([("b",)], "n string")
    assert edges.closure(e, "x", stop=cut).count() == 2 and {r[0] for r in edges.closure(e, "c", "dst", "src").collect()} == {"c", "b", "a", "x"}
    assert edges.closure(e, "nowhere").collect() == [("nowhere", 0)] and edges.closure(e.limit(0), "a").collect() == [("a", 0)]


def test_levels_and_what_is_left_in_cycles(spark, walked):
    e = table_of(spark, [("a", "b"), ("b", "d"), ("a", "d"), ("d", "e"), ("a", "b"), (None, "q"), ("r", None)])
    alone = spark.createDataFrame([("z",), ("a",), (None,)], "node string")
    assert dict(map(tuple, edges.levels(e, alone).collect())) == {"a": 0, "b": 1, "d": 2, "e": 3, "z": 0}
    assert not edges.has_cycle(e) and edges.cyclic(e).count() == 0 and edges.levels(e.limit(0)).count() == 0
    c = table_of(spark, [("in", "x"), ("x", "y"), ("y", "x"), ("y", "way"), ("way", "p"), ("p", "p"), ("p", "out"), ("in", "free")])
    assert dict(map(tuple, edges.levels(c).collect())) == {"in": 0, "free": 1} | dict.fromkeys(["x", "y", "way", "p", "out"])
    assert edges.has_cycle(c) and {r[0] for r in edges.cyclic(c).collect()} == {"x", "y", "way", "p"}


def test_chains_of_ten_thousand_edges(spark):
    chain = spark.range(10_000).selectExpr("string(id) AS src", "string(id + 1) AS dst").repartition(7)
    got = edges.closure(chain, "0").agg(F.count("*"), F.max("depth"), F.sum(F.abs(F.col("node").cast("int") - F.col("depth")))).first()
    assert tuple(got) == (10_001, 10_000, 0)
    assert edges.levels(chain).where("node <> level").count() == 0 and not edges.has_cycle(chain)
    ring = chain.union(table_of(spark, [("10000", "0")]))
    assert edges.has_cycle(ring) and edges.cyclic(ring).count() == 10_001


def test_plans_do_not_grow_with_the_rounds(spark, monkeypatch):
    monkeypatch.setattr(edges, "LOCAL_EDGES", -1)
    plan = lambda n: len(edges.levels(table_of(spark, [(str(k), str(k + 1)) for k in range(n)]))._jdf.queryExecution().toString())
    assert plan(9) < 1.2 * plan(3)


@pytest.mark.parametrize("most", [0, 300_000])
def test_levels_write_the_edges_anew_only_when_half_are_gone(spark, monkeypatch, most):
    monkeypatch.setattr(edges, "LOCAL_EDGES", 2)
    monkeypatch.setattr(edges, "BROADCAST_ROWS", most, raising=False)
    tags, write = [], edges.written
    monkeypatch.setattr(edges, "written", lambda df, tag: (tags.append(tag), write(df, tag))[1])
    pairs = [(k, j) for k in range(9) for j in range(k + 1, min(k + 3, 9))] + [(8, 20), (20, 21), (21, 20)]
    got = dict(map(tuple, edges.levels(table_of(spark, [(str(a), str(b)) for a, b in pairs])).collect()))
    assert got == {str(k): k for k in range(9)} | {"20": None, "21": None}
    assert tags.count("edges-left") <= 4


def test_all_paths(spark, walked):
    ways = lambda pairs, a, b, **o: sorted(r[0] for r in edges.paths(table_of(spark, pairs), a, b, **o).collect())
    diamond = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("x", "d"), ("a", "b")]
    assert ways(diamond, "a", "e") == [["a", "b", "d", "e"], ["a", "c", "d", "e"]] and ways(diamond, "e", "a") == []
    assert ways(diamond, "a", "a") == [["a"]] and ways(diamond, "a", "nowhere") == []
    ring = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("b", "d"), ("d", "d"), ("d", "a")]
    assert ways(ring, "a", "d") == [["a", "b", "c", "d"], ["a", "b", "d"]] and ways(ring, "a", "d", most=1) == [["a", "b", "d"]]


def test_log_lines_and_ranks(spark):
    lines = [" as it is ", "x [ERROR] ERROR: a ERROR: b\n\n==========\tc [STACK TRACE] at d", "ERROR: x [ERROR]", "[ERROR]", "x  a ERROR: b c", "XError: kept"]
    df = spark.createDataFrame([("n", k, [x]) for k, x in enumerate(lines)], "node_id string, seq int, logs array<string>")
    got = {r["message"]: (r["seq"], r["is_error"]) for r in trace.distinct_logs(df).collect()}
    assert got == {" as it is ": (0, False), "x   a ERROR: b \tc": (1, True), "x": (2, True), "x  a  b c": (4, True), "XError: kept": (5, False)}
    names = ["add", "Add two", "core.add", "added", "to_addle", "ladder", "other", "a-d-d"]
    cat = spark.createDataFrame([(n, "t", None, "readd" if n == "other" else "") for n in names], "name string, type string, category string, description string")
    assert [(r["name"], r["score"]) for r in trace.ranked_search(cat, " ADD ").collect()] == [("add", 0), ("Add two", 1), ("core.add", 2), ("added", 3), ("to_addle", 4), ("ladder", 5), ("other", 35)]


def test_time_saved_and_compatible_nodes(spark):
    df = spark.createDataFrame([(30.0, 20.0), (0.0, 5.0)], "n double, t double")
    assert list(map(tuple, df.select(*trace.time_saved(F.col("n"), F.col("t"))).collect())) == [(10.0, 10 / 30 * 100), (-5.0, 0.0)]
    rows = lambda t: trace.type_rows(t)
    listed = lambda t: {"kind": "list", "item": t}
    ports = spark.createDataFrame([(n, d, "p", rows(t)) for n, d, t in (("A", "input", "float"), ("B", "input", listed("int")), ("C", "output", "int"), ("D", "input", "any"), ("E", "input", listed("string")))], f"type string, direction string, port string, rows {trace.TYPE_ROWS}")
    names = lambda *a: {r[0] for r in trace.compatible_nodes(ports, *a).collect()}
    assert names("int") == {"A", "D"} and names(listed("int")) == {"B", "D"} and names("float", "output") == {"C"} and names("string", "output") == set()
    catalogue = trace.port_table(spark, Engine(spark).definitions())
    assert catalogue.where("type = 'core.math.add'").count() == 3
    found = {r[0] for r in trace.compatible_nodes(catalogue, listed("int")).collect()}
    assert {"core.array.sum", "core.container.append", "core.math.add"} <= found and "core.math.sin" not in found


def test_types_fit_place_by_place_as_they_do_whole(spark):
    import json

    record = lambda **f: {"kind": "record", "fields": f}
    listed = lambda t: {"kind": "list", "item": t}
    tensor = lambda **m: {"kind": "tensor", "metadata": m}
    raw = [
        None, "int", "float", "number", "string", "boolean", "any", "unknown", "list", "map", "record", "tensor", "option", listed("int"), listed("float"), listed("string"), listed("any"), listed(listed("int")), listed(listed("string")),
        listed({"kind": "int", "nullable": True}), {"kind": "list", "nullable": True, "item": "int"}, {"kind": "map", "value": "int"}, {"kind": "map", "value": listed("float")}, {"kind": "map", "value": listed("int")}, {"kind": "option", "item": "int"}, {"kind": "option", "item": "float"},
        {"kind": "string", "nullable": True}, record(name="string", age="int"), record(name="string"), record(name="string", email="string"), record(), record(name="any", age="float"), listed(record(a=listed("int"))), listed(record(a=listed("float"), b="int")), listed(record(a="any")),
        record(a=record(b=record(c="int"))), record(a=record(b=record(c="float"))), record(a=record(b="any")), record(a="record"), tensor(dtype="float32"), tensor(dtype="float64"), tensor(dtype="float32", shape=[2, 3]), tensor(shape=[3, 2]), {"kind": "any", "item": "int"}, {"kind": "tuple", "fields": {"0": "int"}},
    ]
    table = trace.with_type_rows(spark.createDataFrame([(k, json.dumps(x)) for k, x in enumerate(raw)], "k int, t string"), "t")
    pairs = table.select(F.col("k").alias("target"), F.col("rows").alias("a")).crossJoin(table.select(F.col("k").alias("source"), F.col("rows").alias("b")))
    for r in pairs.select("target", "source", trace.accepts(F.col("a"), F.col("b")).alias("fits")).collect():
        assert r["fits"] == PortType.of(raw[r["target"]]).accepts(raw[r["source"]]), (raw[r["target"]], raw[r["source"]])
    fed = {r["k"] for r in trace.compatible_ports(table, table.where("k in (1, 13)")).collect()}
    assert fed == {k for k, x in enumerate(raw) if PortType.of(x).accepts(raw[1]) or PortType.of(x).accepts(raw[13])}


def test_the_cache_holds_the_last_used(spark):
    from loomgraph.plans.runtime import ResultCache

    cache, g, frame = ResultCache(most=2), Graph(diamond().payload()), spark.range(1)
    for k in "xy":
        cache.put(k, g, "a", frame.selectExpr(f"'{k}' AS c"))
    assert cache.get("x") is not None
    cache.put("z", g, "b", frame.selectExpr("'z' AS c"))
    assert cache.get("y") is None and cache.get("x") is not None and cache.size == 2
    assert cache.clear() == 2


def test_errors_of_rows_are_collected(spark):
    df = spark.createDataFrame([(1, "2.5", 1.0), (2, "abc", 1.0), (3, None, None), (4, "7", float("nan")), (5, "", 3.0)], "i int, t string, v double")
    g = Flow()
    low = g.node("core.math.min", id="low", a=g.col("t"), b=5)
    after = g.node("core.math.add", id="after", a=low.result, b=1)
    down = g.node("core.math.floor", id="down", value=g.col("v"))
    less = g.node("core.logic.compare", id="less", a=g.col("v"), b=2.0, op="<")
    g.keep("i").out(low=low.result, after=after.sum, down=down.result, less=less.result)
    got = {r["i"]: (r["low"], r["after"], r["down"], r["less"], r["_errors"]) for r in Engine(spark).table(g.payload(), df, {"on_error": "collect"}).collect()}
    assert got[1] == (2.5, 3.5, 1, True, {})
    assert got[2] == (None, None, 1, True, {"low": "could not convert string to float: abc", "after": "dependency_failed"})
    assert got[3] == (0.0, 1.0, 0, None, {"less": "cannot order null"})
    assert got[4][2:] == (None, False, {"down": "cannot convert to integer"}) and got[5][4] == {}
    with pytest.raises(Exception, match="could not convert"):
        Engine(spark).table(g.payload(), df.where("i = 2")).collect()
    assert "_errors" not in Engine(spark).table(g.payload(), df).columns


def summed(g, texts_of, mark=False, call=False):
    """A loop that adds up the numbers which texts_of(index) gives, where one that is no number ends the round."""
    n = lambda kind, port, **inputs: g.node(kind, **inputs)[port]
    start = g.node("core.var.declare", name="total", value=0)
    loop = g.node("core.control.for", id="loop", first_index=1, last_index=g.col("n"))
    text = g.node("core.util.passthrough", id="text", value=texts_of(loop.index))
    value = g.node("core.math.max", id="value", a=text.value, b=-1000)
    held = g.node("core.var.get", name="total")
    more = g.node("core.math.add", id="more", a=held.value, b=value.result)
    put = g.node("core.var.set", name="total", value=more.sum)
    body = [text, value, held, more, put]
    if mark:
        body.insert(2, g.node("core.debug.log", id="log", value=value.result, label="v"))
    if call:
        body.insert(0, g.node("segment.set_prompt", id="call", session_id="s", prompt="p"))
    after = g.node("core.var.get", name="total")
    start.then(loop)
    loop.then(*body, port="loop_body")
    loop.then(after, port="completed")
    g.keep("n").out(total=after.value, value=value.result, last=loop.index)
    return g


@pytest.mark.parametrize("call", [False, True])
def test_a_failing_node_ends_the_round_of_its_row(spark, call):
    from loomgraph.sources import clients, standins

    df = spark.createDataFrame([(3, "123"), (4, "1a34"), (1, "a"), (2, "1z20"), (5, "1x2x3")], "n int, t string")

    def expected(n, t):
        total, value, error = 0.0, None, None
        for i in range(1, n + 1):
            try:
                value = max(float(t[:n][i : i + 1] or 0), -1000.0)
                total += value
            except ValueError as e:
                error = error or str(e).replace("'", "")
        return total, value, n, error

    def texts(g):
        # characters one by one, none at the last index
        pieces = g.node("core.string.split", text=g.node("core.string.join", array=g.col("chars"), delimiter="|").result, delimiter="|").parts
        return lambda index: g.node("core.container.get_index", id="at", array=pieces, index=index).value

    chars = df.withColumn("chars", F.expr("transform(sequence(1, n), i -> substring(t, int(i), 1))"))
    g = Flow()
    summed(g, texts(g), call=call)
    # the item is read in the body
    g.links = [x for x in g.links if not (x["from_node"] == "loop" and x.get("kind") == "control" and x["from_port"] == "loop_body")]
    first = "call" if call else "text"
    g.links += [{"from_node": "loop", "from_port": "loop_body", "to_node": "at", "to_port": "control_in", "kind": "control"}, {"from_node": "at", "from_port": "control_out", "to_node": first, "to_port": "control_in", "kind": "control"}]
    with clients.using(rest=standins.Service):
        rows = Engine(spark).table(g.payload(), chars, {"on_error": "collect"}).collect()
    got = {r["n"]: (r["total"], r["value"], r["last"], r["_errors"].get("value")) for r in rows}
    assert got == {n: expected(n, t) for n, t in df.collect()}
    assert all(set(r["_errors"]) <= {"value"} for r in rows)


def test_lines_logged_in_loops_and_which_node_of_a_body_fails(engine):
    g = Flow()
    loop = g.node("core.control.repeat", id="loop", count=g.node("core.literal.int", id="count", value=3).value)
    loop.then(g.node("core.debug.log", id="inside", value=loop.index, label="at"), port="loop_body")
    out = engine.run(g.payload())
    trace_of = {t["node_id"]: t for t in out["trace"]}
    assert trace_of["inside"]["logs"] == ["[at] 0", "[at] 1", "[at] 2"] and trace_of["loop"]["outputs"]["index"] == 2
    g = Flow()
    loop = g.node("core.control.repeat", id="loop", count=2)
    fine, bad, late = g.node("core.debug.log", id="fine", value="x"), g.node("core.math.sqrt", id="bad", value="abc"), g.node("core.debug.log", id="late", value="y")
    loop.then(fine, bad, late, port="loop_body")
    g.node("core.math.abs", id="free", value=loop.index)
    trace_of = {t["node_id"]: t for t in engine.run(g.payload())["trace"]}
    assert trace_of["bad"]["status"] == "ERROR" and "abc" in trace_of["bad"]["error"] and trace_of["fine"]["logs"] == ["x", "x"]
    assert trace_of["late"]["logs"] == [] and trace_of["free"]["status"] == "COMPLETED" and trace_of["free"]["outputs"]["result"] == 1.0


@pytest.mark.parametrize("call", [False, True])
def test_branches_and_loops_in_bodies_that_log_or_call(spark, call):
    from loomgraph.sources import clients, standins

    g = Flow()
    n = lambda kind, **inputs: g.node(kind, **inputs)
    start = n("core.var.declare", name="v", value="")
    outer = n("core.control.for", id="outer", first_index=1, last_index=g.col("n"))
    odd = n("core.math.mod", a=outer.index, b=2)
    truth = n("core.cast.to_boolean", value=odd.result)
    branch = n("core.control.ifelse", id="if", condition=truth.value)
    inner = n("core.control.repeat", id="inner", count=outer.index)
    name = n("core.string.format", template="{}{}", arg1=outer.index, arg2=inner.index)
    said = n("segment.set_prompt", id="said", session_id="s", prompt=name.result) if call else n("core.string.concat", id="said", a="s-", b=name.result)
    text = said.session_id if call else said.result
    held = n("core.var.get", name="v")
    more = n("core.string.concat", a=held.value, b=text)
    put = n("core.var.set", name="v", value=more.result)
    line = n("core.debug.log", id="line", value=put.value)
    even = n("core.debug.log", id="even", value=outer.index, label="even")
    after = n("core.var.get", name="v")
    start.then(outer)
    outer.then(odd, truth, branch, port="loop_body")
    branch.then(inner, port="true")
    branch.then(even, port="false")
    inner.then(name, said, held, more, put, line, port="loop_body")
    outer.then(after, port="completed")
    g.keep("n").out(v=after.value, last=outer.index)
    engine = Engine(spark)
    with clients.using(rest=standins.Service):
        for options in ({}, {"on_error": "collect"}):
            run = engine.compile(g.payload(), spark.range(0, 4).selectExpr("int(id) AS n"), options)
            engine.forget(run)
            rows = run.compiled.frame.select("n", *(F.col(f"`{run.compiled.columns[o.node, o.port]}`").alias(o.alias) for o in run.graph.outputs if o.alias != "n"), *(F.col(f"`{c}`").alias(f"log_{k}") for k, c in run.compiled.logs.items())).collect()
            for r in rows:
                v, lines, evens = "", [], []
                # a for runs at least once, towards its last index
                for i in range(1, r["n"] + 1) if r["n"] >= 1 else (1, 0):
                    if i % 2:
                        for j in range(i):
                            v += f"s-{i}{j}"
                            lines.append(v)
                    else:
                        evens.append(f"[even] {i}")
                assert (r["v"], r["log_line"], r["log_even"]) == (v, lines, evens)


def test_calls_in_loops_end_with_their_condition_and_report_errors(spark):
    from loomgraph.sources import clients

    class Service:
        def __init__(self, server, timeout):
            pass

        def call(self, method, path, body=None):
            if "2" in str(body):
                raise OSError("refused")
            return {"session_id": "ok"}

    g = Flow()
    start = g.node("core.var.declare", name="k", value=g.col("id"))
    seen = g.node("core.var.get", id="seen", name="k")
    loop = g.node("core.control.while", id="loop", condition=g.node("core.logic.compare", id="less", a=seen.value, b=3, op="<").result, max_iterations=20)
    held = g.node("core.var.get", id="held", name="k")
    more = g.node("core.math.add", id="more", a=held.value, b=1)
    put = g.node("core.var.set", id="put", name="k", value=more.sum)
    said = g.node("segment.set_prompt", id="said", session_id="s", prompt=g.node("core.string.concat", id="text", a="at ", b=loop.index).result)
    after = g.node("core.var.get", id="after", name="k")
    start.then(seen)
    loop.then(held, more, put, port="loop_body")
    g.links += [{"from_node": "put", "from_port": "control_out", "to_node": "text", "to_port": "control_in", "kind": "control"}, {"from_node": "text", "from_port": "control_out", "to_node": "said", "to_port": "control_in", "kind": "control"}]
    loop.then(after, port="completed")
    g.out(id=g.col("id"), k=after.value, last=loop.index, s=said.session_id)
    with clients.using(rest=Service):
        rows = Engine(spark).table(g.payload(), spark.range(0, 5), {"on_error": "collect"}).collect()
        with pytest.raises(Exception):
            Engine(spark).table(g.payload(), spark.range(0, 5)).collect()
    got = {r["id"]: (r["k"], r["last"], r["s"], r["_errors"]) for r in rows}
    assert got == {0: (3.0, 2, "ok", {"said": "refused"}), 1: (3.0, 1, "ok", {}), 2: (3.0, 0, "ok", {}), 3: (3.0, 0, None, {}), 4: (4.0, 0, None, {})}


def test_nodes_from_functions(spark):
    import pandas as pd
    import pyarrow as pa
    import pyarrow.compute as pc

    from loomgraph.operators import udfs
    from loomgraph.registry import REGISTRY

    r = Registry(dict(REGISTRY.specs))

    @udfs.batch_node("t.half", ["x: int"], ["half: float", "seen: int"], registry=r)
    def half(x):
        """Half of a number."""
        assert 13 not in x.to_pylist(), "thirteen"
        return {"half": pc.divide(x.cast(pa.float64()), 2.0), "seen": pa.array([len(x)] * len(x))}

    @udfs.batch_node("t.next", ["x: float"], ["y: float"], pandas=True, registry=r)
    def following(x):
        return x + 1

    @udfs.rows_node("t.times", ["word: string", "n: int"], ["copy: string", "k: int"], registry=r)
    def times(word, n):
        yield from ((word, k) for k in range(n or 0))

    @udfs.aggregate_node("t.spread", "value: list<float>", "spread: float", registry=r, final=lambda s: float(s.max()))
    def spread(values: pd.Series) -> float:
        return float(max((max(v) - min(v) for v in values if v is not None and len(v)), default=0.0))

    engine = Engine(spark, r)
    assert r.get("t.half").description == "Half of a number." and [p.name for p in r.get("t.half").outputs] == ["half", "seen", "control_out"]
    df = spark.createDataFrame([(1, 4, "a"), (2, None, "b"), (3, 13, "c"), (4, 6, None)], "id int, x int, w string").repartition(1)
    g = Flow()
    branch = g.node("core.control.ifelse", condition=g.node("core.logic.compare", a=g.col("id"), b=3, op="!=").result)
    h = g.node("t.half", id="h", x=g.col("x"))
    branch.then(h, port="true")
    g.keep("id").out(half=h.half, seen=h.seen, y=g.node("t.next", x=h.half).y)
    assert sorted(map(tuple, engine.table(g.payload(), df).collect())) == [(1, 2.0, 3, 3.0), (2, None, 3, None), (3, None, None, None), (4, 3.0, 3, 4.0)]
    g = Flow()
    h = g.node("t.half", id="h", x=g.col("x"))
    g.keep("id").out(half=h.half)
    rows = engine.table(g.payload(), df.repartition(4, "id"), {"on_error": "collect"}).collect()
    assert {x["id"]: x["half"] for x in rows}[3] is None and all("thirteen" in x["_errors"]["h"] for x in rows if x["id"] == 3)
    with pytest.raises(Exception, match="thirteen"):
        engine.table(g.payload(), df).collect()
    g = Flow()
    t = g.node("t.times", word=g.col("w"), n=g.col("id"))
    g.keep("id").out(copy=t.copy, k=t.k)
    want = [(i, w, k) for i, w in ((1, "a"), (2, "b"), (3, "c"), (4, None)) for k in range(i)]
    assert sorted(map(tuple, engine.table(g.payload(), df).collect()), key=repr) == sorted(want, key=repr)
    g = Flow()
    s = g.node("t.spread", key=g.col("id"), value=g.node("core.container.make_array", item_0=g.col("x"), item_1=1.5).array)
    g.out(id=s.key, spread=s.spread)
    got = dict(map(tuple, engine.table(g.payload(), df.where("x is not null").selectExpr("id % 2 AS id", "x").repartition(3)).collect()))
    assert got == {1: 11.5, 0: 4.5}


def test_a_function_node_in_a_loop(spark):
    from loomgraph.operators import udfs
    from loomgraph.registry import REGISTRY

    r = Registry(dict(REGISTRY.specs))
    udfs.batch_node("t.double", ["x: float"], ["y: float"], pandas=True, registry=r)(lambda x: x * 2)
    g = Flow()
    start = g.node("core.var.declare", name="v", value=g.col("id"))
    loop = g.node("core.control.repeat", count=g.col("id"))
    held = g.node("core.var.get", name="v")
    twice = g.node("t.double", x=held.value)
    put = g.node("core.var.set", name="v", value=twice.y)
    after = g.node("core.var.get", name="v")
    start.then(loop)
    loop.then(held, twice, put, port="loop_body")
    loop.then(after, port="completed")
    g.out(id=g.col("id"), v=after.value)
    assert sorted(map(tuple, Engine(spark, r).table(g.payload(), spark.range(7)).collect())) == [(k, k * 2.0**k) for k in range(7)]


def test_long_bodies_stay_short_in_the_plan(spark):
    g = Flow()
    start = g.node("core.var.declare", name="v", value=g.col("id"))
    loop = g.node("core.control.repeat", count=2)
    held = g.node("core.var.get", name="v")
    body, at = [held], held.value
    for _ in range(24):  # each value stands twice in the next: 2 ** 24 copies in one expression
        body.append(g.node("core.math.add", a=at, b=at))
        at = body[-1].sum
    body.append(g.node("core.var.set", name="v", value=g.node("core.math.divide", id="down", a=at, b=2.0**24).quotient))
    after = g.node("core.var.get", name="v")
    start.then(loop)
    loop.then(*body[:-1], Step(g, "down"), body[-1], port="loop_body")
    loop.then(after, port="completed")
    once = g.node("core.control.for", id="once", first_index=1, last_index=3)
    parts, last = [], once.index
    for k in range(24):
        parts.append(g.node("core.math.add", id=f"p{k}", a=last, b=last))
        last = parts[-1].sum
    once.then(*parts, port="loop_body")
    g.out(id=g.col("id"), v=after.value, last=last)
    assert [tuple(r) for r in Engine(spark).table(g.payload(), spark.range(3)).collect()] == [(k, float(k), 3 * 2.0**24) for k in range(3)]


def test_steps_copy_nothing_and_the_rows_of_long_loops_are_dealt(spark):
    g = Flow()
    loop = g.node("core.control.for", first_index=1, last_index=3)
    loop.then(g.node("core.math.add", id="sum", a=loop.index, b=1), port="loop_body")
    g.out(last=loop.index)
    run = Engine(spark).compile(g.payload(), spark.range(2), {"on_error": "collect"})
    assert "transform(" not in run.compiled.frame._jdf.queryExecution().analyzed().toString()
    from loomgraph.queries import QUERIES

    assert QUERIES["loop_row_errors"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1
