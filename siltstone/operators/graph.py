"""The containment graph: cycle-safe subtrees, folder profiles, markers, suggestions and minimal roots."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.errors import EngineError
from siltstone.functions.paths import ancestors, category, is_under

MAX_PROFILE_ENTRIES = 100_000
# Fixed values: (signal, exact name or suffix, weight in basis points, strong).
MARKERS = (
    ("cargo_manifest", "Cargo.toml", 8500, True),
    ("javascript_package", "package.json", 7500, True),
    ("python_project", "pyproject.toml", 8000, True),
    ("go_module", "go.mod", 8500, True),
    ("swift_package", "Package.swift", 8500, True),
    ("xcode_project", "*.xcodeproj", 9000, True),
    ("visual_studio_solution", "*.sln", 8500, True),
    ("readme", "README*", 1500, False),
)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for cut lineages, or a temporary one where a local session names none."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        context.setCheckpointDir(f"{tempfile.gettempdir()}/siltstone-{uuid.uuid4().hex}")
    return named or context._jsc.sc().getCheckpointDir().get()


def _checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def descendants(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node_id, depth): the roots and everything below them along active edges (source = child, target = parent).

    A frontier loop: each round joins the newest nodes with the edges and drops what has been seen, so cycles end. The
    visited set is checkpointed each round and nothing is collected.
    """
    links = edges.filter(F.col("active") & (F.col("kind") == "located_in")).select(F.col("source_node_id").alias("child"), F.col("target_node_id").alias("parent")).distinct()
    frontier = _checkpoint(roots.select("node_id").distinct().withColumn("depth", F.lit(0)))
    seen = frontier
    while not frontier.isEmpty():
        below = frontier.join(links, F.col("node_id") == F.col("parent")).select(F.col("child").alias("node_id"), (F.col("depth") + 1).alias("depth")).distinct()
        frontier = _checkpoint(below.join(seen.select("node_id"), "node_id", "left_anti"))
        seen = seen.unionByName(frontier)
    return seen


def subtree(edges: DataFrame, locations: DataFrame, scope_id: int, folder_node_id: int) -> DataFrame:
    """Present locations of a scope whose node descends from the folder and whose own path lies under the folder's: a
    hard link elsewhere does not leak in. The node must be a present folder of the scope; locations come without those
    whose grant is not active or which are excluded, so a folder of these is none either."""
    here = locations.filter(F.col("present") & (F.col("scope_id") == scope_id))
    folder = here.filter((F.col("node_id") == folder_node_id) & (F.col("kind") == "folder")).select(F.col("path_key").alias("_root"))
    if folder.isEmpty():
        raise EngineError("search_folder_invalid")
    roots = here.filter(F.col("node_id") == folder_node_id).select("node_id")
    nodes = descendants(edges.filter(F.col("scope_id") == scope_id), roots)
    return here.join(nodes.select("node_id"), "node_id", "left_semi").join(F.broadcast(folder), is_under(F.col("path_key"), F.col("_root"))).drop("_root")


def direct_children(edges: DataFrame, folder_node_id: int) -> DataFrame:
    return edges.filter(F.col("active") & (F.col("target_node_id") == folder_node_id)).select(F.col("source_node_id").alias("node_id")).distinct()


def folder_profile(edges: DataFrame, nodes: DataFrame, folder_node_id: int, bound: int | None = None, closure: DataFrame | None = None) -> DataFrame:
    """One row: direct and descendant counts (the folder itself excluded), bytes, newest time, files per category. With the
    kept closure of the edges what lies below is a filter, else a loop over levels.

    ``nodes``: node_id, kind, name, size_bytes, modified_unix_ns. More entries than a bound, where one is given, are an error,
    never a partial answer; without one a folder of any size is profiled, as tasks share its entries.
    """
    if closure is None:
        below = descendants(edges, nodes.sparkSession.createDataFrame([(folder_node_id,)], "node_id long")).filter("depth > 0")
    else:
        below = closure.filter(F.col("ancestor_node_id") == folder_node_id)
    below = below.filter(F.col("node_id") != folder_node_id).select("node_id").distinct()
    if bound is not None and below.limit(bound + 1).count() > bound:
        raise EngineError("folder_profile_entry_limit_exceeded")
    direct = direct_children(edges, folder_node_id).withColumn("direct", F.lit(True))
    rows = nodes.join(below, "node_id", "left_semi").join(direct, "node_id", "left").withColumn("direct", F.coalesce("direct", F.lit(False)))
    file, folder = F.col("kind") == "file", F.col("kind") == "folder"
    kinds = ("document", "code", "data", "image", "audio", "video", "other")
    return rows.agg(
        F.count_if(file & F.col("direct")).alias("direct_files"), F.count_if(folder & F.col("direct")).alias("direct_folders"),
        F.count_if(file).alias("descendant_files"), F.count_if(folder).alias("descendant_folders"),
        F.coalesce(F.sum(F.when(file, F.col("size_bytes"))), F.lit(0)).cast("long").alias("total_bytes"), F.max(F.when(file, F.col("modified_unix_ns"))).alias("latest_modified_unix_ns"),
        *[F.count_if(file & (category(F.col("name")) == k)).alias(f"{k}_files") for k in kinds],
    ).select(F.lit(folder_node_id).cast("long").alias("folder_node_id"), "*")


def markers(children: DataFrame) -> DataFrame:
    """(folder_node_id, signal, weight, strong) for direct children (folder_node_id, name) that are markers."""
    name = F.col("name")
    tests = [(name.rlike("^README(\\.[A-Za-z0-9]+)?$") if m == "README*" else F.endswith(name, F.lit(m[1:])) if m[0] == "*" else name == m, s, w, strong) for s, m, w, strong in MARKERS]
    found = F.array(*[F.when(t, F.struct(F.lit(s).alias("signal"), F.lit(w).alias("weight"), F.lit(strong).alias("strong"))) for t, s, w, strong in tests])
    return children.select("folder_node_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("m")).select("folder_node_id", "m.*").distinct()


def project_confidence(signals: DataFrame) -> DataFrame:
    """(folder_node_id, confidence, strong signals): the largest strong weight, 500 more for each further strong signal,
    9500 at most; without a strong signal there is no suggestion."""
    strong = signals.filter("strong").groupBy("folder_node_id").agg(F.max("weight").alias("w"), F.count("*").alias("strong_signals"))
    return strong.select("folder_node_id", F.least(F.col("w") + 500 * (F.col("strong_signals") - 1), F.lit(9500)).cast("int").alias("confidence_basis_points"), "strong_signals")


def project_roots(folders: DataFrame, bound: int = 100) -> DataFrame:
    """The first folders by node id, flagged when the evaluation leaves some out."""
    first = folders.orderBy("node_id").limit(bound + 1).withColumn("position", F.row_number().over(Window.orderBy("node_id")))
    return first.withColumn("evaluation_complete", F.max("position").over(Window.partitionBy()) <= bound).filter(F.col("position") <= bound).drop("position")


def root_overlaps(roots: DataFrame, separator: str = "/") -> DataFrame:
    """(ancestor, descendant) of different rows (root_id, path_key) of which one lies under the other or equals it.

    Each root's ancestors are exploded and met by an equi-join; a self-join on containment would compare all pairs.
    """
    above = roots.select("root_id", "path_key", F.explode(ancestors(F.col("path_key"), separator)).alias("above"))
    other = roots.select(F.col("root_id").alias("upper_id"), F.col("path_key").alias("above"))
    met = above.join(other, "above").filter((F.col("root_id") != F.col("upper_id")) & ((F.col("above") != F.col("path_key")) | (F.col("upper_id") < F.col("root_id"))))
    return met.select(F.col("upper_id").alias("ancestor_id"), F.col("root_id").alias("descendant_id"))


def check_roots(roots: DataFrame, active: DataFrame | None = None, bound: int = 32) -> DataFrame:
    """A set of coverage roots is taken whole or not at all: 1 to 32 roots, none under another or an active one."""
    n = roots.limit(bound + 1).count()
    if not n:
        raise EngineError("coverage_set_empty")
    if n > bound:
        raise EngineError("coverage_set_too_large")
    tagged = lambda df, tag: df.select(F.concat(F.lit(tag), F.col("root_id").cast("string")).alias("root_id"), "path_key")
    new = tagged(roots, "new ")
    both = new if active is None else new.unionByName(tagged(active, "active "))
    if not root_overlaps(both).filter(F.startswith("ancestor_id", F.lit("new ")) | F.startswith("descendant_id", F.lit("new "))).isEmpty():
        raise EngineError("coverage_root_overlap")
    return roots


def minimal_roots(roots: DataFrame, separator: str = "/") -> DataFrame:
    """Roots that lie under no other root; of equal paths the smallest id stays."""
    return roots.join(root_overlaps(roots, separator).select(F.col("descendant_id").alias("root_id")).distinct(), "root_id", "left_anti")


def coverage(paths: DataFrame, roots: DataFrame, exclusions: DataFrame, separator: str = "/") -> DataFrame:
    """Paths (path_id, path_key) under a root and under no exclusion."""
    above = paths.select("path_id", F.explode(ancestors(F.col("path_key"), separator)).alias("above"))
    covered = above.join(roots.select(F.col("path_key").alias("above")).distinct(), "above", "left_semi").select("path_id").distinct()
    denied = above.join(exclusions.select(F.col("path_key").alias("above")).distinct(), "above", "left_semi").select("path_id").distinct()
    return paths.join(covered, "path_id", "left_semi").join(denied, "path_id", "left_anti")
