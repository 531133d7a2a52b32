"""What can be asked of traces, of the catalogue of node types and of stored graphs: plain relational queries."""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..types import PortType


def node_summary(trace: DataFrame, order: str = "seq", node: str = "node_id", duration: str = "duration_ms", keep: tuple[str, ...] = ("outputs", "logs"), error: str | None = "error", level: str | None = "level") -> DataFrame:
    """Per node: runs, last, total and mean duration, its last outputs and logs, whether it ever failed, its level, and
    width: the last duration over the greatest one (1 at least), 0.1 at least."""
    aggs = [F.count("*").alias("runs"), F.max_by(duration, order).alias("last_ms"), F.sum(duration).alias("total_ms"), F.avg(duration).alias("mean_ms")]
    aggs += [F.max_by(c, order).alias(f"last_{c}") for c in keep]
    aggs += [F.coalesce(F.bool_or(F.col(error).isNotNull()), F.lit(False)).alias("failed")] if error else []
    aggs += [F.max_by(level, order).alias("level")] if level else []
    per = trace.groupBy(node).agg(*aggs)
    most = per.agg(F.greatest(F.coalesce(F.max("last_ms"), F.lit(0.0)), F.lit(1.0))).scalar()
    return per.withColumn("width", F.greatest(F.lit(0.1), F.col("last_ms") / most))


def slowest(trace: DataFrame, n: int = 5, duration: str = "duration_ms", ties: tuple[str, ...] = ("node_id",)) -> DataFrame:
    """The n rows that took longest."""
    return trace.where(F.col(duration).isNotNull()).orderBy(F.desc(duration), *ties).limit(n)


def level_timing(trace: DataFrame, plan: DataFrame | None = None, level: str = "level", duration: str = "duration_ms", node: str = "node_id") -> DataFrame:
    """Per level: nodes, total and greatest duration; levels that are only in the plan come with none."""
    per = trace.groupBy(level).agg(F.count("*").alias("nodes"), F.sum(duration).alias("total_ms"), F.max(duration).alias("max_ms"), F.sort_array(F.collect_set(node)).alias("node_ids"))
    if plan is None:
        return per
    out = plan.select(level).distinct().join(per, level, "full_outer")
    return out.select(level, F.coalesce("nodes", F.lit(0)).cast("long").alias("nodes"), F.coalesce("total_ms", F.lit(0.0)).alias("total_ms"), F.coalesce("max_ms", F.lit(0.0)).alias("max_ms"), F.coalesce("node_ids", F.array().cast("array<string>")).alias("node_ids"))


def time_saved(node_ms: Column, total_ms: Column) -> tuple[Column, Column]:
    """(milliseconds, percent of the nodes' time) that running side by side saved."""
    saved = node_ms - total_ms
    return saved, F.when(node_ms > 0, saved / node_ms * 100).otherwise(0.0)


def latest(trace: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key."""
    by = W.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return trace.withColumn("__k", F.row_number().over(by)).where("__k = 1").drop("__k")


def run_stats(trace: DataFrame, *by: str, status: str = "status", duration: str = "duration_ms", level: str = "level", cached: str = "from_cache") -> DataFrame:
    """Counts by outcome, summed time and levels, of a run or of each group of by."""
    done = F.col(status) == "COMPLETED"
    aggs = [
        F.count("*").alias("total_nodes"),
        F.count_if(done & ~F.col(cached)).alias("executed_nodes"),
        F.count_if(done & F.col(cached)).alias("cached_nodes"),
        F.count_if(F.col(status) == "SKIPPED").alias("skipped_nodes"),
        F.count_if(F.col(status) == "ERROR").alias("error_nodes"),
        F.coalesce(F.sum(duration), F.lit(0.0)).alias("node_time_ms"),
        F.count_distinct(level).alias("levels_executed"),
    ]
    return trace.groupBy(*by).agg(*aggs)


def is_error_line(text: Column) -> Column:
    return F.contains(text, F.lit("[ERROR]")) | F.contains(text, F.lit("ERROR:"))


def clean_message(text: Column) -> Column:
    """An error line up to its stack trace, on one line, without rules of 10 or more =, the first [ERROR] and ERROR: and outer
    white space; other lines as they are."""
    m = F.substring_index(text, "[STACK TRACE]", 1)
    m = F.regexp_replace(F.regexp_replace(m, r"[\n\r]+", " "), "={10,}", "")
    for mark in (r"\[ERROR\]", "ERROR:"):
        m = F.regexp_replace(m, rf"(?s)^(.*?){mark}", "$1")
    return F.when(is_error_line(text), F.regexp_replace(m, r"(?U)^\s+|\s+$", "")).otherwise(text)


def distinct_logs(trace: DataFrame, node: str = "node_id", logs: str = "logs", order: str = "seq") -> DataFrame:
    """Each message of a node once, empty ones left out, with the place of its first occurrence and whether that was an error."""
    lines = trace.select(node, order, F.posexplode(logs).alias("at", "line")).withColumn("message", clean_message(F.col("line"))).where("message <> ''")
    first = F.min(F.struct(order, "at", is_error_line(F.col("line")).alias("is_error"))).alias("first")
    return lines.groupBy(node, "message").agg(first).select(node, "message", F.col(f"first.{order}").alias("seq"), F.col("first.at").alias("at"), F.col("first.is_error").alias("is_error"))


def search(catalogue: DataFrame, query: str, *columns: str) -> DataFrame:
    """Rows that hold the query in one of the columns, whatever the case; an empty query keeps all."""
    if not query.strip():
        return catalogue
    q = query.strip().lower()
    return catalogue.where(reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(F.col(c)), F.lit(q)), F.lit(False)) for c in columns)))


def palette(catalogue: DataFrame, query: str = "", category: str = "category") -> DataFrame:
    """Matching node types by category, in order, Other last."""
    named = F.coalesce(F.nullif(F.col(category), F.lit("")), F.lit("Other"))
    found = search(catalogue, query, "type", "description").groupBy(named.alias("category")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("type")).alias("types"))
    return found.orderBy(F.col("category") == "Other", "category")


def match_score(field: Column, query: str) -> Column:
    """0 equal, 1 the first word, 2 another word, 3 begins so, 4 a word begins so, 5 holds it, null else. Words are of a-z and 0-9."""
    q, text = query.strip().lower(), F.lower(field)
    words = F.filter(F.split(text, "[^a-z0-9]+"), lambda w: w != "")
    out = F.when(text == q, 0).when(F.get(words, F.lit(0)) == q, 1).when(F.array_contains(words, q), 2).when(F.startswith(text, F.lit(q)), 3)
    return out.when(F.exists(words, lambda w: F.startswith(w, F.lit(q))), 4).when(F.contains(text, F.lit(q)), 5)


def ranked_search(catalogue: DataFrame, query: str, fields: tuple[str, ...] = ("name", "type", "category", "description")) -> DataFrame:
    """Matching rows, best first: a match in an earlier field beats any in a later one; equal ones by name."""
    if not query.strip():
        return catalogue.withColumn("score", F.lit(40)).orderBy("score", fields[0])
    scores = [match_score(F.col(f), query) + 10 * k for k, f in enumerate(fields)]
    out = catalogue.withColumn("score", F.least(*scores) if len(scores) > 1 else scores[0])
    return out.where(F.col("score").isNotNull()).orderBy("score", fields[0])


#: A type as rows, one for each place in it that can be told apart: path, kind, whether null, a tensor's dtype and shape, whether it names fields.
TYPE_ROWS = "array<struct<path:string,kind:string,nullable:boolean,dtype:string,shape:string,named:boolean>>"


def type_rows(raw: Any) -> list[tuple[str, str, bool, str | None, str | None, bool]]:
    """A type descriptor as TYPE_ROWS; below an open kind nothing is told apart."""
    out: list[tuple[str, str, bool, str | None, str | None, bool]] = []

    def add(t: PortType, path: str) -> None:
        told = {k: str(v) for k, v in t.metadata if v} if t.kind == "tensor" else {}
        out.append((path, t.kind, t.nullable, told.get("dtype"), told.get("shape"), t.kind == "record" and bool(t.fields)))
        parts = [("item", t.item)] if t.kind in ("list", "option") else [("value", t.value)] if t.kind == "map" else [(f"field {k}", v) for k, v in t.fields or ()] if t.kind == "record" else []
        for name, part in parts:
            if part is not None:
                add(part, f"{path}/{name}")

    add(PortType.of(raw), "")
    return out


def port_table(spark: SparkSession, definitions: list[dict[str, Any]]) -> DataFrame:
    """(type, direction, port, rows) of every data port in a catalogue, as Engine.definitions gives it."""
    rows = [(d["type"], way, p["name"], type_rows(p["type"])) for d in definitions for way in ("input", "output") for p in d[f"{way}s"] if PortType.of(p["type"]).kind != "control"]
    return spark.createDataFrame(rows, f"type string, direction string, port string, rows {TYPE_ROWS}")


def with_type_rows(ports: DataFrame, descriptor: str, name: str = "rows") -> DataFrame:
    """Adds the rows of a type that a column has as JSON; what is no JSON is any."""

    def rows(texts: pd.Series) -> pd.Series:
        def of(text: str | None) -> list[tuple]:
            try:
                return type_rows(json.loads(text or "null"))
            except ValueError:
                return type_rows(None)

        return pd.Series([[dict(zip(("path", "kind", "nullable", "dtype", "shape", "named"), r)) for r in of(t)] for t in texts])

    return ports.withColumn(name, F.pandas_udf(rows, TYPE_ROWS)(F.col(descriptor)))  # type: ignore[call-overload]


def accepts(target: Column, source: Column) -> Column:
    """Whether a port with the type rows target may be fed by one with source's: the rule of PortType.accepts, place by place."""
    is_open = lambda k: k.isin("any", "unknown")
    both = lambda a, b: a.isNotNull() & b.isNotNull() & (a != b)

    def fits(t: Column) -> Column:
        same = F.filter(source, lambda s: s["path"] == t["path"])
        s = F.get(same, F.lit(0))
        free = is_open(t["kind"]) | is_open(s["kind"]) | ((s["kind"] == "int") & (t["kind"] == "float"))
        wrong = (s["nullable"] & ~t["nullable"]) | (s["kind"] != t["kind"]) | both(s["dtype"], t["dtype"]) | both(s["shape"], t["shape"])
        # a field that the source does not have is missing only where the source names its fields
        above = F.regexp_replace(t["path"], "/field [^/]*$", "")
        missing = (above != t["path"]) & F.exists(source, lambda x: (x["path"] == above) & x["named"])
        return F.when(F.size(same) == 0, ~missing).otherwise(free | ~wrong)

    return F.forall(target, fits)


def compatible_ports(targets: DataFrame, sources: DataFrame, rows: str = "rows") -> DataFrame:
    """The targets that at least one of the sources can feed. sources is broadcast, and so has to be small: the ports of one node."""
    s = F.broadcast(sources.select(F.col(rows).alias("source_rows")).distinct())
    return targets.join(s, accepts(F.col(rows), F.col("source_rows")), "left_semi")


def compatible_nodes(ports: DataFrame, source: Any, direction: str = "input") -> DataFrame:
    """Node types with a port that a value of this type can feed, or, for outputs, that can feed a port of it (ports as port_table gives them)."""
    given = F.lit(json.dumps([dict(zip(("path", "kind", "nullable", "dtype", "shape", "named"), r)) for r in type_rows(source)]))
    given = F.from_json(given, TYPE_ROWS)
    test = accepts(F.col("rows"), given) if direction == "input" else accepts(given, F.col("rows"))
    return ports.where((F.col("direction") == direction) & test).select("type").distinct()


def classify_outputs(outputs: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """Adds class: image (a data URL of one), stream (a stream's id), else value."""
    kind = F.when(F.startswith(F.col(value), F.lit("data:image")), "image").when(F.contains(F.col(name), F.lit("stream_id")), "stream").otherwise("value")
    return outputs.withColumn("class", kind)
