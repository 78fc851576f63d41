"""The ancestor closure of containment, kept as a table and brought along when edges come and go.

A row (scope_id, ancestor_node_id, node_id) says that the node lies below the ancestor, by any path of at least one edge; on a cycle
a node lies below itself. With it a subtree is one filter, and what lies above a node another. A change costs joins of what it touches:
an edge touches the pairs of what stands above its parent (the parent included) and what lies below its child.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.graph import shared_folder

PAIR = ["scope_id", "ancestor_node_id", "node_id"]


def _written(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a table in the shared folder: checkpoints carry constraints along that a union of them may not resolve."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/closure-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def links(edges: DataFrame) -> DataFrame:
    """Active containment as pairs."""
    return edges.filter(F.col("active") & (F.col("kind") == "located_in")).select("scope_id", F.col("target_node_id").alias("ancestor_node_id"), F.col("source_node_id").alias("node_id")).distinct()


def changes(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(removed, added, kept) pairs between two states of the edges, all from one join of them."""
    old, new = links(before).withColumn("_old", F.lit(True)), links(after).withColumn("_new", F.lit(True))
    both = _written(old.join(new, PAIR, "full"))
    return tuple(both.filter(c).select(*PAIR) for c in ("_new IS NULL", "_old IS NULL", "_old AND _new"))


def _through(closure: DataFrame, edges: DataFrame) -> DataFrame:
    """The pairs that a path through one of these edges joins, whatever it does before and after."""
    e = edges.select("scope_id", F.col("ancestor_node_id").alias("_parent"), F.col("node_id").alias("_child"))
    above = closure.select("scope_id", F.col("node_id").alias("_parent"), "ancestor_node_id")
    below = closure.select("scope_id", F.col("ancestor_node_id").alias("_child"), "node_id")
    up = e.join(above, ["scope_id", "_parent"]).select("scope_id", "ancestor_node_id", "_child").unionByName(e.select("scope_id", F.col("_parent").alias("ancestor_node_id"), "_child")).distinct()
    down = up.join(below, ["scope_id", "_child"]).select(*PAIR)
    return down.unionByName(up.select("scope_id", "ancestor_node_id", F.col("_child").alias("node_id"))).distinct()


def added(closure: DataFrame, edges: DataFrame) -> DataFrame:
    """The closure with further edges (pairs): paths through one of them, then paths of these. From an empty closure this builds it.

    A pair that takes n of the new edges on its shortest path is found after log2(n) rounds: the paths that the last round found
    are met by all found so far, and what is new is written beside what there is, which no round writes again."""
    edges, out = _written(edges.select(*PAIR)), closure.select(*PAIR)
    if edges.isEmpty():
        return out
    new = found = _written(_through(out, edges).join(out, PAIR, "left_anti"))
    while not new.isEmpty():
        out = out.unionByName(new)
        upper = new.select("scope_id", "ancestor_node_id", F.col("node_id").alias("_between"))
        lower = found.select("scope_id", F.col("ancestor_node_id").alias("_between"), "node_id")
        new = _written(upper.join(lower, ["scope_id", "_between"]).select(*PAIR).distinct().join(out, PAIR, "left_anti"))
        found = found.unionByName(new)
    return out


def removed(closure: DataFrame, edges: DataFrame, left: DataFrame) -> DataFrame:
    """The closure without these edges, ``left`` being all pairs of edges that stay.

    Every pair that had a path through a removed edge is taken out; what another path still joins comes back, found from its last
    edge: the node's parent stands below the ancestor by a pair that is sure, or is the ancestor. Cycles and several parents are no exception."""
    edges = _written(edges.select(*PAIR))
    if edges.isEmpty():
        return closure.select(*PAIR)
    lost = _written(_through(closure, edges).join(closure, PAIR, "left_semi"))
    sure = closure.select(*PAIR).join(lost, PAIR, "left_anti")
    last = left.select("scope_id", F.col("ancestor_node_id").alias("_parent"), "node_id")
    steps = _written(lost.join(last, ["scope_id", "node_id"]).select(*PAIR, "_parent"))

    def proven(steps: DataFrame, pairs: DataFrame) -> DataFrame:
        return steps.join(pairs.select("scope_id", "ancestor_node_id", F.col("node_id").alias("_parent")), ["scope_id", "ancestor_node_id", "_parent"], "left_semi").select(*PAIR)

    out = sure
    new = _written(proven(steps, sure).unionByName(steps.filter("_parent = ancestor_node_id").select(*PAIR)).distinct())
    while not new.isEmpty():
        out = out.unionByName(new)
        steps = _written(steps.join(new, PAIR, "left_anti"))  # what is not sure yet
        new = _written(proven(steps, new).distinct())
    return out


def moved(closure: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """The closure of ``after`` (edges) from that of ``before``."""
    gone, new, kept = changes(before, after)
    return added(_written(removed(closure, gone, kept)), new)
