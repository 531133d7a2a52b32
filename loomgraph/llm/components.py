"""Connected components of an edge table by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _joined(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges with m of their a. By the inverted a, since both would keep the aggregate's partitions by a, of which Spark can split none where one node has very many edges."""
    return edges.withColumn("k", F.bitwise_not("a")).join(least.select((F.bitwise_not("a")).alias("k"), "m"), "k")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", tag: str = "components") -> DataFrame:
    """(node long, component long): the smallest node reachable over edges, for each node of an edge.

    Rows with a null end are no edges; repeated and reversed edges and loops count once or not at all.
    Every round halves path lengths and never makes more edges than it got; each is written to the
    shared folder, so a lost executor costs one round at most. Nothing is collected but a count.
    """
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    e = written(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    before = None
    while True:
        # large star: neighbours greater than a node move to the node's smallest neighbour
        both = e.union(e.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = _joined(both, least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, tag)
        # small star: a node and its smaller neighbours move to the smallest of these
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _joined(large, least).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        e = written(small, tag)
        mark = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        before = mark
    return e.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
