"""Evidence about files: exact duplicates, numbered versions, review groups, feedback state, the cleanup inbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.errors import EngineError
from siltstone.functions.paths import explicit_version
from siltstone.operators.graph import _checkpoint
from siltstone.operators.ranks import carried, ranked, reached

MAX_DUPLICATE_BYTES = 64 * 1024 * 1024
# Confidences in basis points.
DUPLICATE, VERSION, REVIEW_GROUP = 10_000, 9_000, 6_000
#: Kinds of inbox sources in their order.
INBOX_KINDS = ("exact_duplicate", "version", "screenshot_group")


def duplicate_code(same_node: Column, left_size: Column, right_size: Column, same_bytes: Column) -> Column:
    """Why two files are no duplicates; null if they are. The first rule that fails decides."""
    return (
        F.when(same_node, "file_relation_same_file_identity").when((left_size == 0) | (right_size == 0), "file_relation_source_empty")
        .when(F.greatest(left_size, right_size) > MAX_DUPLICATE_BYTES, "file_relation_source_too_large").when((left_size != right_size) | ~same_bytes, "file_relation_content_differs")
    )


def source_code(size: Column, most: int = MAX_DUPLICATE_BYTES) -> Column:
    """Why a file is not compared at all; null if it is."""
    return F.when(size == 0, "file_relation_source_empty").when(size > most, "file_relation_source_too_large")


def exact_duplicates(files: DataFrame, content: str = "content") -> DataFrame:
    """(scope_id, left_node_id, right_node_id, size_bytes, members): every copy against the smallest node of its group.

    ``files``: scope_id, node_id, content (string or binary). Copies share scope, size and SHA-256. A group of n gives
    n - 1 rows; its members follow from left_node_id, so no pair is lost and none is spelt out.
    """
    sized = files.withColumn("size_bytes", F.octet_length(content).cast("long")).filter(F.col("size_bytes").between(1, MAX_DUPLICATE_BYTES))
    keyed = sized.select("scope_id", "node_id", "size_bytes", F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))
    groups = keyed.groupBy("scope_id", "size_bytes", "sha256").agg(F.min("node_id").alias("left_node_id"), F.count_distinct("node_id").alias("members")).filter(F.col("members") > 1)
    pairs = keyed.join(groups, ["scope_id", "size_bytes", "sha256"]).filter(F.col("node_id") != F.col("left_node_id"))
    return pairs.select("scope_id", "left_node_id", F.col("node_id").alias("right_node_id"), "size_bytes", "members", F.lit(DUPLICATE).alias("confidence_basis_points")).distinct()


def version_code(same_node: Column, left: Column, right: Column) -> Column:
    """Why two names (parsed by explicit_version) are no version pair; null if they are."""
    return (
        F.when(same_node, "file_relation_same_file_identity").when(left.isNull() | right.isNull(), "file_version_name_unsupported")
        .when(left["base"] != right["base"], "file_version_base_mismatch").when(left["ext"] != right["ext"], "file_version_extension_mismatch")
        .when(left["version"] == right["version"], "file_version_number_equal")
    )


def _numbered(files: DataFrame) -> DataFrame:
    """(scope_id, base, ext, version, node_id) of the files whose names carry a version number."""
    parsed = files.select("scope_id", "node_id", explicit_version(F.col("file_name")).alias("v")).filter(F.col("v").isNotNull())
    return parsed.select("scope_id", "v.base", "v.ext", "v.version", "node_id").distinct()


def version_members(files: DataFrame) -> DataFrame:
    """(scope_id, base, ext, version, class_node_id, node_id): every file with a version number, and the smallest node of
    the files that share it, which stands for them."""
    parsed = _numbered(files)
    least = parsed.groupBy("scope_id", "base", "ext", "version").agg(F.min("node_id").alias("class_node_id"))
    return parsed.join(least, ["scope_id", "base", "ext", "version"]).select("scope_id", "base", "ext", "version", "class_node_id", "node_id")


def version_pairs(files: DataFrame) -> DataFrame:
    """Numbered versions, each number of a (scope, base, extension) with the next higher one. ``files``: scope_id,
    node_id, file_name.

    Of n files that share a number and m that share the next, the smallest node of either is paired with all of the
    other: n + m - 1 pairs, so no file is left without its relation and not all pairs are spelt out."""
    members, key = _numbered(files), ["scope_id", "base", "ext"]
    w = Window.partitionBy(*key).orderBy("version")
    classes = members.groupBy(*key, "version").agg(F.min("node_id").alias("least"))
    chain = {f"{c}_{side}": f(c).over(w) for side, f in (("before", F.lag), ("after", F.lead)) for c in ("least", "version")}
    placed = members.join(classes.withColumns(chain), [*key, "version"])
    pair = lambda older, newer, older_version, newer_version: F.struct(F.col(older).alias("older_node_id"), F.col(newer).alias("newer_node_id"), F.col(older_version).alias("older_version"), F.col(newer_version).alias("newer_version"))
    # the smallest node of a number has its pair with the next number's smallest node from there
    pairs = F.array(F.when(F.col("least_before").isNotNull(), pair("least_before", "node_id", "version_before", "version")), F.when(F.col("least_after").isNotNull() & (F.col("node_id") != F.col("least")), pair("node_id", "least_after", "version", "version_after")))
    return placed.select(*key, F.inline(F.array_compact(pairs))).select("*", F.lit(VERSION).alias("confidence_basis_points"))


def eligible_images(images: DataFrame) -> DataFrame:
    """Active png, jpeg or webp images with a completed text recognition of at least one chunk, whose file time is known."""
    return images.filter(F.col("active") & F.col("format").isin("png", "jpeg", "webp") & (F.col("ocr_status") == "completed") & (F.col("ocr_chunk_count") >= 1) & F.col("modified_unix_ns").isNotNull())


def review_groups(images: DataFrame, keys: list[str], window: int, at: str = "modified_unix_ns", max_members: int = 20, max_images: int | None = 2000, max_groups: int | None = 20) -> DataFrame:
    """Members of groups of 2 to max_members images of equal ``keys`` within ``window`` of their first member.

    The first image opens a group; one that lies beyond the window, or that would exceed the members, opens the next.
    Rows: keys, group_start, group_node_id (its first image), group_size, node_id, confidence. Images are in order of time, then node; null
    keys are equal to each other. More images of one key than max_images, or more groups than max_groups, are an error.

    Every image points to the first one that its group would leave out. A search by range gives the pointers: with the ends of all windows
    sorted among the images, what stands before an end is counted by its rank. Where a pointer leads to the very next image, that one opens a
    group whatever came before; from these the chains of pointers are followed in log rounds.
    """
    if max_images is not None and not images.groupBy(*keys).count().filter(F.col("count") > max_images).limit(1).isEmpty():
        raise EngineError("screenshot_image_limit_exceeded")
    rows = ranked(images.select(*keys, F.col("node_id").cast("long").alias("node_id"), F.col(at).cast("long").alias("_t")), [*keys, "_t", "node_id"])
    ends = rows.select(*keys, (F.col("_t") + window).alias("_t"), F.lit(1).alias("_end"), "rank")
    both = ranked(rows.select(*keys, "_t", F.lit(0).alias("_end"), "rank").unionByName(ends).withColumnRenamed("rank", "_image"), [*keys, "_t", "_end", "_image"])
    # before the end of image i's window stand the ends of i images, and the images up to the first beyond it
    beyond = both.filter("_end = 1").select(F.col("_image").alias("rank"), (F.col("rank") - F.col("_image")).alias("_beyond"))
    pointers = _checkpoint(beyond.select("rank", "_beyond", F.least("_beyond", F.col("rank") + max_members).alias("next")))
    sure = pointers.filter(F.col("_beyond") == F.col("rank") + 1).select(F.col("_beyond").alias("rank")).unionByName(pointers.filter("rank = 0").select("rank"))
    links = pointers.select("rank", "next").join(sure.select(F.col("rank").alias("next")), "next", "left_anti")
    first = reached(links, sure).join(pointers, "rank").select("rank", (F.col("next") - F.col("rank")).alias("group_size"))
    opened = rows.join(first, "rank", "left")
    group = F.when(F.col("group_size").isNotNull(), F.struct(F.col("_t").alias("group_start"), F.col("node_id").alias("group_node_id"), "group_size"))
    dealt = carried(opened, group).select(*keys, "carried.group_start", "carried.group_node_id", "carried.group_size", "node_id").filter(F.col("group_size") > 1)
    if max_groups is not None and first.filter("group_size > 1").limit(max_groups + 1).count() > max_groups:
        raise EngineError("screenshot_group_limit_exceeded")
    return dealt.withColumn("confidence_basis_points", F.lit(REVIEW_GROUP))


def feedback_changes(events: DataFrame, entity: str = "entity_id") -> DataFrame:
    """The events that change something: repeating the decision in force is a no-op."""
    w = Window.partitionBy(entity).orderBy("sequence")
    return events.withColumn("_before", F.lag("decision").over(w)).filter(F.col("_before").isNull() | (F.col("_before") != F.col("decision"))).drop("_before")


def feedback_state(entities: DataFrame, events: DataFrame, entity: str = "entity_id") -> DataFrame:
    """(entity, state, decided_at, changes): the latest decision wins; without one an entity is suggested."""
    latest = events.groupBy(entity).agg(F.max_by("decision", "sequence").alias("state"), F.max_by("created_at_unix_ms", "sequence").alias("decided_at_unix_ms"))
    changes = feedback_changes(events, entity).groupBy(entity).agg(F.count("*").alias("changes"))
    out = entities.select(entity).distinct().join(latest, entity, "left").join(changes, entity, "left")
    return out.select(entity, F.coalesce("state", F.lit("suggested")).alias("state"), "decided_at_unix_ms", F.coalesce("changes", F.lit(0)).alias("changes"))


def version_feedback_key(candidates: DataFrame) -> Column:
    """Version feedback holds for the evidence it was given on: both ends, names, numbers, signal, confidence, provider."""
    return F.sha2(F.to_json(F.struct(*[c for c in ("relation_id", "older_node_id", "newer_node_id", "base", "ext", "older_version", "newer_version", "confidence_basis_points") if c in candidates.columns])), 256)


def inbox(sources: DataFrame, limit: int = 20) -> DataFrame:
    """The first open sources (kind, source_id, observed_at_unix_ms, state): duplicates, versions, groups, newest first."""
    kind = F.array_position(F.array(*[F.lit(k) for k in INBOX_KINDS]), F.col("kind"))
    order = [kind, F.desc("observed_at_unix_ms"), F.col("source_id")]
    first = sources.filter("state = 'suggested'").orderBy(*order).limit(limit)
    return first.select("kind", "source_id", "observed_at_unix_ms", F.row_number().over(Window.orderBy(*order)).alias("position"))


def inbox_counters(items: DataFrame) -> DataFrame:
    """One row: sources evaluated, those no longer current, and whether all could be read."""
    return items.agg(F.count("*").alias("evaluated"), F.count_if(F.col("outcome") == "not_current").alias("not_current"), (F.count_if(F.col("outcome") == "io_error") == 0).alias("complete"))


def cleanup_targets(sources: DataFrame) -> DataFrame:
    """The (source_id, target_node_id, keeper_node_id) that a review may choose: either copy of a duplicate, the older of
    two versions with the newer kept, or one member of a screenshot group without a keeper. Nothing is authorized."""
    pair = lambda t, k: F.struct(F.col(t).alias("target_node_id"), F.col(k).alias("keeper_node_id"))
    duplicate = F.array(pair("left_node_id", "right_node_id"), pair("right_node_id", "left_node_id"))
    single = F.transform(F.coalesce("members", F.array().cast("array<bigint>")), lambda m: F.struct(m.alias("target_node_id"), F.lit(None).cast("long").alias("keeper_node_id")))
    options = F.when(F.col("kind") == "exact_duplicate", duplicate).when(F.col("kind") == "version", F.array(pair("left_node_id", "right_node_id"))).otherwise(single)
    return sources.select("kind", "source_id", F.explode(options).alias("o")).select("kind", "source_id", "o.*", F.lit(False).alias("action_authorized"))
