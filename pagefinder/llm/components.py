"""Distributed union-find: connected components by contraction, with DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of ``edges``; component: the smallest node reachable.

    Nodes are relabelled by hashing (xxhash64 of a long is one-to-one), which puts them in random
    order.  Each round every node hooks onto its smallest neighbour, or stays if it is smaller itself,
    and edges are rewritten to the hooks, without loops and repeats.  The graph shrinks by a
    constant factor a round whatever its shape (chains, stars, cliques), so rounds grow with the
    logarithm of the input and go on until no edge is left.  Each round's tables are written to the
    shared folder, so an executor lost later costs no earlier round; what later rounds don't read is
    deleted.  Nothing is collected to the driver.

    Null ends and loops are ignored.  A hub's edges are pre-aggregated on the map side.
    """
    spark = edges.sparkSession
    ends = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    first = materialize(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if first.isEmpty():
        return spark.createDataFrame([], "node long, component long")
    nodes = first.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.xxhash64("node"))
    live, written = first.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")), None
    hooks: list[DataFrame] = []
    while not live.isEmpty():
        both = live.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        hook = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("m", "a").alias("h")), "hooks")
        hooks.append(hook)
        at = lambda x: hook.select(F.col("v").alias(x), F.col("h").alias(f"{x}h"))  # noqa: E731, B023
        left = live.join(at("a"), "a").join(at("b"), "b").where("ah <> bh")
        live = materialize(left.select(F.least("ah", "bh").alias("a"), F.greatest("ah", "bh").alias("b")).distinct(), "edges")
        if written is not None:
            discard(written)
        written = live
    step = lambda df, h: df.join(h.withColumnRenamed("v", "root"), "root", "left").select("node", F.coalesce("h", "root").alias("root"))
    rooted = materialize(reduce(step, hooks, nodes), "roots")
    least = rooted.groupBy("root").agg(F.min("node").alias("component"))
    out = materialize(rooted.join(least, "root").select("node", "component"), "components")
    discard(first, written, rooted, *hooks)
    return out
