"""Action previews: pure checks over requests. Nothing here touches a file, and no preview authorizes anything."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.errors import EngineError
from siltstone.functions.paths import case_only_rename, is_under, portable_name

MAX_HASH_BYTES, MAX_EXCLUSIONS = 8 * 1024**3, 64


def rename_previews(requests: DataFrame) -> DataFrame:
    """Per request (scope_root, source_path, new_name, size_bytes, destination_exists): the destination, direct or staged,
    and the code of the first rule that fails."""
    parent = F.regexp_extract("source_path", r"^(.*)/[^/]*$", 1)
    name = F.element_at(F.split("source_path", "/"), -1)
    case = case_only_rename(name, F.col("new_name"))
    code = (
        F.when(~is_under(F.col("source_path"), F.col("scope_root")) | (F.col("source_path") == F.col("scope_root")), "action_source_outside_scope").when(~portable_name(F.col("new_name")), "action_name_not_portable")
        .when(name == F.col("new_name"), "action_name_unchanged").when(F.col("size_bytes") > MAX_HASH_BYTES, "action_source_too_large").when(F.col("destination_exists") & ~case, "action_destination_exists")
    )
    return requests.withColumns({"destination_path": F.concat(parent, F.lit("/"), "new_name"), "strategy": F.when(case, "staged").otherwise("direct"), "error_code": code, "action_authorized": F.lit(False)})


def cleanup_previews(choices: DataFrame, observations: DataFrame) -> DataFrame:
    """Choices (kind, source_id, target_node_id, keeper_node_id) with what both ends were when observed (node_id, sha256,
    size_bytes). A duplicate needs equal hashes; a screenshot has no keeper, any other kind has one."""
    o = lambda end: observations.select(F.col("node_id").alias(f"{end}_node_id"), F.col("sha256").alias(f"{end}_sha256"), F.col("size_bytes").alias(f"{end}_size_bytes"))
    j = choices.join(o("target"), "target_node_id", "left").join(o("keeper"), "keeper_node_id", "left")
    screenshot, keeper = F.col("kind") == "screenshot_group", F.col("keeper_node_id").isNotNull()
    code = (
        F.when(F.col("target_sha256").isNull() | (keeper & F.col("keeper_sha256").isNull()), "cleanup_source_not_current").when(screenshot == keeper, "cleanup_keeper_invalid")
        .when(F.col("target_node_id") == F.col("keeper_node_id"), "cleanup_keeper_is_target").when((F.col("kind") == "exact_duplicate") & (F.col("target_sha256") != F.col("keeper_sha256")), "file_relation_content_differs")
    )
    return j.withColumns({"error_code": code, "action_authorized": F.lit(False)})


def check_exclusions(selections: DataFrame, root: str, separator: str = "/") -> DataFrame:
    """A batch of exclusions (selection_id, path_key, identity_kind) is taken whole or not at all: 64 at most, strictly
    below the root, none under another, with strong identities."""
    from siltstone.operators.graph import root_overlaps

    if selections.limit(MAX_EXCLUSIONS + 1).count() > MAX_EXCLUSIONS:
        raise EngineError("scope_exclusion_batch_too_large")
    below = is_under(F.col("path_key"), F.lit(root), separator) & (F.col("path_key") != root)
    faults = selections.agg(F.count_if(~below).alias("outside"), F.count_if(F.col("identity_kind").isNull() | (F.col("identity_kind") == "path_fallback")).alias("weak")).head()
    if faults.outside:
        raise EngineError("scope_exclusion_not_strict_descendant")
    if faults.weak:
        raise EngineError("scope_exclusion_identity_weak")
    if not root_overlaps(selections.select(F.col("selection_id").alias("root_id"), "path_key"), separator).isEmpty():
        raise EngineError("scope_exclusion_overlap")
    return selections


def recent(df: DataFrame, limit: int = 20, key: str = "id") -> DataFrame:
    """The newest rows by id."""
    return df.orderBy(F.desc(key)).limit(limit)


def latest_observation(observations: DataFrame, key: str = "relation_id") -> DataFrame:
    """The newest observation of each relation, ties to the larger id."""
    w = Window.partitionBy(key).orderBy(F.desc("observed_at_unix_ms"), F.desc("id"))
    return observations.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def group_totals(members: DataFrame, key: str = "group_id") -> DataFrame:
    return members.groupBy(key).agg(F.count("*").alias("member_count"), F.sum("size_bytes").cast("long").alias("total_bytes"))


def health(spark) -> DataFrame:
    """The states of the engine's components; those that it doesn't have say so."""
    states = [("manifest", "ready"), ("content_extraction", "ready"), ("lexical_search", "ready"), ("watch", "ready"), ("embeddings", "disabled"), ("file_actions", "disabled")]
    return spark.createDataFrame(states, "component string, state string")


def policy(scopes: DataFrame, scope_id: int | None = None) -> tuple:
    """The policy revisions that a query is bound to: those of its scope, or of all scopes (a few dozen at most)."""
    rows = scopes if scope_id is None else scopes.filter(F.col("scope_id") == scope_id)
    return tuple(sorted((r.scope_id, r.policy_revision) for r in rows.select("scope_id", "policy_revision").collect()))


def guard_revision(scopes: DataFrame, scope_id: int, bound: int) -> None:
    """Raises if a scope's policy changed since a query bound its revision."""
    row = scopes.filter(F.col("scope_id") == scope_id).select("policy_revision").head()
    if row is None or row[0] != bound:
        raise EngineError("scope_policy_changed")
