"""Connected components by alternating large-star and small-star steps, each a groupBy and a join on one key.

No neighbourhood is ever gathered: a vertex' smallest neighbour is an aggregate, and the edges are rewritten by a join.
Every step's edges are written to the shared folder, so the plan stays short and a lost executor costs one step at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch


def _tie(edges: DataFrame, least: DataFrame, key: str, other: str, hub: int) -> DataFrame:
    """(u, v): what stands in ``other``, tied to the least of ``key``. Vertices of ``hub`` neighbours or more are a
    thousand at most and known to all tasks, so no task gets all edges of one."""
    known = F.broadcast(least.filter(F.col("n") >= hub).select(F.col("x").alias("hx"), F.col("m").alias("hm")))
    marked = edges.join(known, F.col(key) == F.col("hx"), "left")
    rest = marked.filter(F.col("hx").isNull()).join(least.filter(F.col("n") < hub), F.col(key) == F.col("x"))
    tied = lambda df, m: df.select(F.col(other).alias("u"), F.col(m).alias("v"))
    return tied(marked.filter(F.col("hx").isNotNull()), "hm").unionByName(tied(rest, "m"))


def _rewire(edges: DataFrame, small: bool, hub: int) -> DataFrame:
    """edges: (u, v), u > v. Large star: a vertex' larger neighbours are tied to its smallest neighbour or itself.
    Small star: its smaller neighbours, and the vertex, are tied to the smallest."""
    if small:
        least = edges.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"), F.count("*").alias("n"))
        tied = _tie(edges, least, "u", "v", hub).unionByName(least.select(F.col("x").alias("u"), F.col("m").alias("v")))
    else:
        both = edges.select(F.col("u").alias("x"), "v").unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("v")))
        least = both.groupBy("x").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "x"))
        tied = _tie(edges, least, "v", "u", hub)
    return tied.filter(F.col("u") > F.col("v")).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component): the smallest vertex reachable, for every vertex of an edge (a, b) but the smallest themselves."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter(F.col("u") > F.col("v")).distinct()
    e, before, step = scratch.write(e, f"{name}-0"), None, 0
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
        if now == before or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before, step = now, step + 1
        hub = max(1_000, now[0] // 500)  # of so many neighbours there are at most a thousand: each edge has two ends
        e = scratch.write(_rewire(e, False, hub), f"{name}-{step}-large")
        e = scratch.write(_rewire(e, True, hub), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}", f"{name}-{step}-large")
