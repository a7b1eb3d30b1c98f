"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

The edge list is written to the shared folder after each round, and a node's neighbours are never collected. The least
neighbours are written as well before the edges meet them: beside a written table Spark can split the rows of a node with
very many edges. Nodes are longs; self-loops and repeated edges are harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, forget, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b): connect a node's larger (large) or smaller-or-equal neighbours to the least of them and itself."""
    if large:
        near = edges.union(edges.select("b", "a")).toDF("u", "v")
    else:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = materialize(edges.sparkSession, near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    out = near.join(least.withColumnRenamed("u", "_u"), F.col("u") == F.col("_u"))
    if large:
        linked = out.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        linked = out.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return linked.filter("a != b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (the least node that it reaches) for every node of edges (a, b long)."""
    spark = edges.sparkSession
    edges = edges.toDF("a", "b").filter("a IS NOT NULL AND b IS NOT NULL")
    nodes = materialize(spark, edges.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    now = materialize(spark, edges.filter("a != b").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        new = materialize(spark, _star(_star(now, True), False), "edges")
        seen = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(spark, now)
        now = new
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    forget(spark)
    linked = now.groupBy("a").agg(F.min("b").alias("component"))
    return nodes.join(linked, F.col("node") == F.col("a"), "left").select("node", F.coalesce("component", "node").alias("component"))
