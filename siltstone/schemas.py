"""Explicit schemas of the manifest, content, evidence and journal tables, and their write-time rules.

Instants are integers (Unix ms; file times Unix ns), confidences basis points, coordinates parts per million: nothing is
rounded through a timestamp or a float.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.errors import EngineError

_KINDS = {"l": T.LongType(), "i": T.IntegerType(), "s": T.StringType(), "b": T.BooleanType(), "x": T.BinaryType()}


def _schema(spec: str) -> T.StructType:
    """'name:type' words; an upper-case type is required, a lower-case one nullable."""
    pairs = [w.split(":") for w in spec.split()]
    return T.StructType([T.StructField(n, _KINDS[k.lower()], k.islower()) for n, k in pairs])


SCHEMAS: dict[str, T.StructType] = {
    "authorized_scopes": _schema("id:L path_raw:x path_key:S display_path:S platform:S created_at_unix_ms:L policy_revision:L"),
    "scope_access_grants": _schema("scope_id:L platform:S opaque_grant:x state:S updated_at_unix_ms:L"),
    "scope_exclusions": _schema("scope_id:L kind:S path_key:S identity_kind:s identity_key:x"),
    "scan_jobs": _schema("id:L scope_id:L status:S control_state:S discovered_files:L discovered_folders:L started_at_unix_ms:L finished_at_unix_ms:l"),
    "scan_queue": _schema("scan_id:L path_key:S state:S"),
    "scan_staged_observations": _schema("scan_id:L scope_id:L path_key:S display_path:S kind:S identity_kind:S identity_key:X size_bytes:l modified_unix_ns:l link_count:l"),
    "scan_issues": _schema("scan_id:L code:S path_key:s"),
    "manifest": _schema("scope_id:L path_key:S id:L node_id:L display_path:S kind:S size_bytes:l modified_unix_ns:l link_count:l present:B action:S"),
    "nodes": _schema("id:L kind:S identity_kind:S identity_key:X created_at_unix_ms:L updated_at_unix_ms:L"),
    "files": _schema("node_id:L size_bytes:L modified_unix_ns:l link_count:l"),
    "folders": _schema("node_id:L"),
    "locations": _schema("id:L scope_id:L node_id:L path_raw:x path_key:S display_path:S present:B last_seen_scan_id:L"),
    "edges": _schema("scope_id:L source_node_id:L target_node_id:L kind:S active:B last_seen_scan_id:L"),
    "edge_closure": _schema("scope_id:L ancestor_node_id:L node_id:L"),
    "extraction_jobs": _schema("id:L scope_id:L node_id:L location_id:L operation:S status:S provider_id:s provider_version:s source_size_bytes:L source_modified_unix_ns:l output_bytes:L chunk_count:L created_at_unix_ms:L finished_at_unix_ms:l"),
    "content_chunks": _schema(
        "id:L scope_id:L node_id:L location_id:L extraction_job_id:L ordinal:L text:S provenance_kind:S source_byte_start:l source_byte_end:l source_page_number:l "
        "source_unit_number:l source_cell_reference:s source_fragment_index:l source_bbox_x_ppm:l source_bbox_y_ppm:l source_bbox_width_ppm:l source_bbox_height_ppm:l "
        "source_confidence_basis_points:l trust_class:S provider_id:S provider_version:S active:B"
    ),
    "image_metadata": _schema("id:L scope_id:L node_id:L job_id:L format:S pixel_width:I pixel_height:I active:B"),
    "watch_events": _schema("id:L scope_id:L path:S observed_kind:S size_bytes:l modified_unix_ns:l identity_key:x observed_at_unix_ms:L status:S reconciliation_kind:s"),
    "applied_batches": _schema("sink:S batch_id:L"),
    "scan_requests": _schema("scope_id:L sink:S batch_id:L"),
    "project_suggestions": _schema("id:L scope_id:L root_node_id:L confidence_basis_points:I observed_at_unix_ms:L"),
    "file_relations": _schema("id:L kind:S scope_id:L left_node_id:L right_node_id:L confidence_basis_points:I observed_at_unix_ms:L"),
    "feedback_events": _schema("entity_id:L sequence:L decision:S created_at_unix_ms:L"),
    "screenshot_members": _schema("group_id:L node_id:L size_bytes:L modified_unix_ns:L"),
    "action_journal_events": _schema("plan_id:L sequence:L event_kind:S command_request_id:l created_at_unix_ms:L"),
    "action_plan_states": _schema("plan_id:L state:s error:s events:L last_sequence:L"),
    "privacy_receipts": _schema("scope_id:L table_name:S purged_rows:L policy_revision:L"),
}

# Closed vocabularies.
VOCABULARIES: dict[str, dict[str, tuple[str, ...]]] = {
    "nodes": {"kind": ("file", "folder")},
    "scope_access_grants": {"state": ("active", "needs_reauthorization", "revoked")},
    "scope_exclusions": {"kind": ("path", "identity")},
    "scan_queue": {"state": ("pending", "processing", "done")},
    "edges": {"kind": ("located_in",)},
    "extraction_jobs": {"operation": ("content", "screenshot_ocr"), "status": ("queued", "running", "completed", "failed", "cancelled", "interrupted")},
    "content_chunks": {"provenance_kind": ("byte_range", "pdf_page", "document_unit", "slide", "cell", "ocr_region")},
    "watch_events": {"status": ("stabilizing", "reconciling", "completed", "failed", "ignored")},
    "file_relations": {"kind": ("exact_duplicate", "version")},
    "feedback_events": {"decision": ("accepted", "rejected")},
}


def rules(name: str) -> dict[str, Column]:
    """The write-time rules of a table, by code; each must hold for every row."""
    out = {f"{name}_{c}_null": F.col(c).isNotNull() for c in (f.name for f in SCHEMAS[name].fields if not f.nullable)}
    out |= {f"{name}_{c}_unknown": F.col(c).isin(*values) for c, values in VOCABULARIES.get(name, {}).items()}
    extra = {
        "authorized_scopes": {"policy_revision_range": F.col("policy_revision") >= 1},
        "image_metadata": {"image_bounds": image_within_bounds(F.col("pixel_width"), F.col("pixel_height"))},
        "file_relations": {"relation_order": (F.col("left_node_id") < F.col("right_node_id")) | (F.col("kind") == "version"), "confidence_range": F.col("confidence_basis_points").between(0, 10_000)},
        "content_chunks": {
            "byte_range_shape": (F.col("provenance_kind") == "byte_range") == (F.col("source_byte_start").isNotNull() & F.col("source_byte_end").isNotNull()),
            "page_shape": (F.col("provenance_kind") == "pdf_page") == F.col("source_page_number").isNotNull(),
            "cell_shape": (F.col("provenance_kind") == "cell") == F.col("source_cell_reference").isNotNull(),
            "box_shape": (F.col("provenance_kind") == "ocr_region") == F.col("source_bbox_x_ppm").isNotNull(),
        },
        "screenshot_members": {"member_time": F.col("modified_unix_ns").isNotNull()},
    }
    return out | extra.get(name, {})


def image_within_bounds(width: Column, height: Column) -> Column:
    """Sides 1 to 100,000 pixels, 500 million pixels at most."""
    return width.between(1, 100_000) & height.between(1, 100_000) & (width.cast("long") * height.cast("long") <= 500_000_000)


def validate(df: DataFrame, name: str) -> DataFrame:
    """The table in its declared columns, after one pass that raises the code of the first broken rule."""
    checks = rules(name)
    broken = df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(code) for code, rule in checks.items()]).head()
    for code in checks:
        if broken[code]:
            raise EngineError(code)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields])


def unique_or_raise(df: DataFrame, keys: list[str], code: str) -> DataFrame:
    """Raises if any key occurs twice (a uniqueness rule as a validation query)."""
    if not df.groupBy(*keys).count().filter("count > 1").limit(1).isEmpty():
        raise EngineError(code)
    return df


def append_only(df: DataFrame, name: str, warehouse: str) -> None:
    """Appends checked rows to a table; nothing ever rewrites the rows that are there."""
    validate(df, name).write.mode("append").parquet(f"{warehouse.rstrip('/')}/{name}")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
