"""Manifest publishing, statistics, extraction output and authorization."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Actions of a publish.
ACTIONS = ("insert", "update", "unchanged", "tombstone", "absent")


def publish(staged: DataFrame, current: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The locations after a scan: staged rows are present; present rows that the scan didn't see become tombstones and
    keep their values; earlier tombstones stay. One full outer join on the key; ``action`` says what happened.

    ``current`` has keys, values and present; the result has keys, values, present, action.
    """
    s = staged.select(*keys, *[F.col(v).alias(f"_s_{v}") for v in values], F.lit(True).alias("_s"))
    c = current.select(*keys, *[F.col(v).alias(f"_c_{v}") for v in values], F.col("present").alias("_present"), F.lit(True).alias("_c"))
    j = s.join(c, keys, "full_outer")
    seen, known = F.col("_s").isNotNull(), F.col("_c").isNotNull()
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"_s_{v}").eqNullSafe(F.col(f"_c_{v}"))
    action = F.when(seen & ~known, "insert").when(seen & same & F.col("_present"), "unchanged").when(seen, "update").when(F.col("_present"), "tombstone").otherwise("absent")
    return j.select(*keys, *[F.when(seen, F.col(f"_s_{v}")).otherwise(F.col(f"_c_{v}")).alias(v) for v in values], seen.alias("present"), action.alias("action"))


def replace_output(existing: DataFrame, completed: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks or images after completed jobs: what a (scope, node) had before becomes inactive, the new rows are active."""
    done = completed.select(*keys).distinct().withColumn("_done", F.lit(True))
    kept = existing.join(done, keys, "left").withColumn("active", F.col("active") & F.col("_done").isNull()).drop("_done")
    return kept.unionByName(completed.withColumn("active", F.lit(True)))


def invalidate(existing: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """Output of nodes whose file has changed becomes inactive."""
    hit = changed.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return existing.join(hit, keys, "left").withColumn("active", F.col("active") & F.col("_hit").isNull()).drop("_hit")


def manifest_stats(scopes: DataFrame, nodes: DataFrame, locations: DataFrame, issues: DataFrame, scans: DataFrame) -> DataFrame:
    """One row of counts: scopes, nodes, files, folders, active locations, issues, completed scans, and whether any is."""
    one = nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("kind") == "file").alias("files"), F.count_if(F.col("kind") == "folder").alias("folders"))
    for df, name, cond in ((scopes, "scopes", F.lit(True)), (locations, "active_locations", F.col("present")), (issues, "issues", F.lit(True)), (scans, "completed_scans", F.col("status") == "completed")):
        one = one.join(df.agg(F.count_if(cond).alias(name)))  # single rows
    return one.select("scopes", "nodes", "files", "folders", "active_locations", "issues", "completed_scans", (F.col("completed_scans") > 0).alias("ready"))


def with_active_grant(rows: DataFrame, grants: DataFrame) -> DataFrame:
    """Rows of scopes whose grant is active; a missing grant is not."""
    return rows.join(grants.filter("state = 'active'").select("scope_id").distinct(), "scope_id", "left_semi")


def extraction_stats(chunks: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row: active chunks, files with any, and jobs by terminal status."""
    a = chunks.filter("active").agg(F.count("*").alias("active_chunks"), F.count_distinct("node_id").alias("extracted_files"))
    status = ("completed", "failed", "cancelled", "interrupted")
    return a.join(jobs.agg(*[F.count_if(F.col("status") == s).alias(f"{s}_jobs") for s in status]))  # single rows


def scan_counters(entries: DataFrame) -> DataFrame:
    """Per scan: queued, processed, files, folders, skipped, issues."""
    n = lambda cond, name: F.count_if(cond).alias(name)
    return entries.groupBy("scan_id").agg(
        n(F.col("state") != "done", "queued"), n(F.col("state") == "done", "processed"), n(F.col("kind") == "file", "files"), n(F.col("kind") == "folder", "folders"),
        n(F.col("skipped"), "skipped"), n(F.col("issue_code").isNotNull(), "issues"),
    )


def first_issue(*rules: tuple[Column, str]) -> Column:
    """The code of the first rule that matches, in the given order; null if none does."""
    out = F.lit(None).cast("string")
    for cond, code in reversed(rules):
        out = F.when(F.coalesce(cond, F.lit(False)), F.lit(code)).otherwise(out)
    return out


def job_state(events: DataFrame, job: str = "job_id") -> DataFrame:
    """(job, status): a job's latest event; a terminal status is final, so later events don't count."""
    terminal = ("completed", "failed", "cancelled")
    ended = F.min_by("status", F.when(F.col("status").isin(*terminal), F.col("sequence")))
    end_at = F.min(F.when(F.col("status").isin(*terminal), F.col("sequence")))
    return events.groupBy(job).agg(F.when(end_at.isNotNull(), ended).otherwise(F.max_by("status", "sequence")).alias("status"))
