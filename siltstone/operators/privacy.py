"""Privacy: what an exclusion or a revocation reaches, how much of each table goes, and what stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.errors import EngineError
from siltstone.functions.paths import ancestors

NODE_COLUMNS = {
    "locations": ("node_id",), "content_chunks": ("node_id",), "image_metadata": ("node_id",), "extraction_jobs": ("node_id",), "edges": ("source_node_id", "target_node_id"),
    "project_suggestions": ("root_node_id",), "file_relations": ("left_node_id", "right_node_id"), "screenshot_members": ("node_id",), "watch_events": (),
}


def excluded_locations(locations: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Locations under an excluded path of their scope, or whose node has an excluded identity."""
    paths = exclusions.filter("kind = 'path'").select("scope_id", F.col("path_key").alias("above")).distinct()
    above = locations.select("id", "scope_id", F.explode(ancestors(F.col("path_key"))).alias("above"))
    by_path = above.join(paths, ["scope_id", "above"], "left_semi").select("id")
    if "identity_key" in locations.columns:
        ids = exclusions.filter("kind = 'identity'").select("scope_id", "identity_kind", "identity_key").distinct()
        by_path = by_path.unionByName(locations.join(ids, ["scope_id", "identity_kind", "identity_key"], "left_semi").select("id"))
    return locations.join(by_path.distinct(), "id", "left_semi")


def closure(gone_locations: DataFrame, locations: DataFrame) -> DataFrame:
    """Nodes that keep no location: a hard link elsewhere keeps its node."""
    gone = gone_locations.select("node_id").distinct()
    kept = locations.join(gone_locations.select("id"), "id", "left_anti").select("node_id").distinct()
    return gone.join(kept, "node_id", "left_anti")


def purge(tables: dict[str, DataFrame], nodes: DataFrame) -> dict[str, DataFrame]:
    """The tables without rows that touch any of the nodes."""
    out = {}
    for name, df in tables.items():
        for c in NODE_COLUMNS.get(name, ()):
            df = df.join(nodes.select(F.col("node_id").alias(c)), c, "left_anti")
        out[name] = df
    return out


def impact(tables: dict[str, DataFrame], nodes: DataFrame) -> DataFrame:
    """(table_name, purged_rows) for each table."""
    parts = []
    for name, df in tables.items():
        columns = NODE_COLUMNS.get(name, ())
        if columns:  # a row that touches nodes by two columns counts once
            hit = F.lit(False)
            for i, c in enumerate(columns):
                df = df.join(nodes.select(F.col("node_id").alias(c), F.lit(True).alias(f"_hit{i}")), c, "left")
                hit = hit | F.col(f"_hit{i}").isNotNull()
            parts.append(df.agg(F.count_if(hit).alias("purged_rows")).select(F.lit(name).alias("table_name"), "purged_rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def next_revision(scopes: DataFrame, scope_id: int, expected: int) -> DataFrame:
    """The scopes with one policy revision raised by one; raises if it is no longer the expected one."""
    row = scopes.filter(F.col("scope_id") == scope_id).select("policy_revision").head()
    if row is None or row[0] != expected:
        raise EngineError("scope_policy_changed")
    return scopes.withColumn("policy_revision", F.when(F.col("scope_id") == scope_id, F.col("policy_revision") + 1).otherwise(F.col("policy_revision")))
