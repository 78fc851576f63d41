"""Evaluation: error rates in parts per million, tag slices, failure histograms, nearest-rank percentiles, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.errors import EngineError
from siltstone.functions.text import char_error_edits, token_error_edits

# The tags in report order.
TAGS = ("traditional_chinese", "english", "mixed_language", "no_text", "small_text", "low_contrast", "dark_mode", "dense_ui")
MAX_UNITS = 16_384


def rate_ppm(edits: Column, units: Column) -> Column:
    """Edits per million units, in integers; null without units."""
    scaled = edits.cast("decimal(18,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.when(units > 0, F.floor(scaled / F.when(units > 0, units).cast("decimal(18,0)"))).cast("long")


def check_cases(corpus: DataFrame, run: DataFrame) -> None:
    """The run covers the corpus' cases exactly once each."""
    for df, code in ((corpus, "corpus_case_duplicate"), (run, "run_case_duplicate")):
        if not df.groupBy("case_id").count().filter("count > 1").limit(1).isEmpty():
            raise EngineError(code)
    if not corpus.join(run, "case_id", "left_anti").limit(1).isEmpty():
        raise EngineError("run_case_missing")
    if not run.join(corpus, "case_id", "left_anti").limit(1).isEmpty():
        raise EngineError("run_case_unexpected")


def score_cases(corpus: DataFrame, run: DataFrame) -> DataFrame:
    """Per case: characters, tokens and edits of each; a failed case counts as empty text. A text beyond the unit bound is an
    error, which bounds the work of a case; how many cases there are is not bounded, as tasks share them.
    corpus: case_id, expected_text, tags; run: case_id, status, recognized_text."""
    words = lambda c: F.size(F.filter(F.split(c, " "), lambda x: x != "")).cast("long")
    j = corpus.join(run, "case_id").withColumn("hyp", F.when(F.col("status") == "completed", F.coalesce("recognized_text", F.lit(""))).otherwise(""))
    j = j.withColumns({"chars": F.char_length("expected_text").cast("long"), "hyp_chars": F.char_length("hyp").cast("long"), "tokens": words(F.col("expected_text"))})
    if (j.agg(F.max(F.greatest("chars", "hyp_chars")).alias("units")).head().units or 0) > MAX_UNITS:
        raise EngineError("evaluation_work_limit_exceeded")
    return j.select("case_id", "tags", "chars", "tokens", char_error_edits(F.col("expected_text"), F.col("hyp")).alias("char_edits"), token_error_edits(F.col("expected_text"), F.col("hyp")).alias("token_edits"))


def totals(scored: DataFrame, *keys: str) -> DataFrame:
    """Summed units and edits, and micro-averaged rates."""
    sums = scored.groupBy(*keys).agg(F.count("*").alias("cases"), *[F.sum(c).cast("long").alias(c) for c in ("chars", "char_edits", "tokens", "token_edits")])
    return sums.withColumns({"char_error_ppm": rate_ppm(F.col("char_edits"), F.col("chars")), "token_error_ppm": rate_ppm(F.col("token_edits"), F.col("tokens"))})


def tag_slices(scored: DataFrame) -> DataFrame:
    """The totals of each tag; a case counts once for each of its distinct tags."""
    return totals(scored.withColumn("tag", F.explode(F.array_distinct("tags"))), "tag")


def failure_histogram(run: DataFrame, code: str = "error_code") -> DataFrame:
    return run.filter(F.col(code).isNotNull()).groupBy(code).agg(F.count("*").alias("failures"))


def nearest_rank(value: str, percent: int) -> Column:
    """The value at place ceil(n p / 100) in order; 0 without values."""
    return F.coalesce(F.expr(f"percentile_disc({percent / 100}) WITHIN GROUP (ORDER BY {value})").cast("long"), F.lit(0).cast("long"))


def latency_report(runs: DataFrame, value: str, *keys: str) -> DataFrame:
    return runs.groupBy(*keys).agg(F.count(value).alias("n"), nearest_rank(value, 50).alias("p50"), nearest_rank(value, 95).alias("p95"), F.coalesce(F.max(value), F.lit(0)).alias("max"))


def attempt_latencies(runs: DataFrame, value: str, completed: Column, *keys: str) -> DataFrame:
    """The report of all attempts and, apart from it, that of the completed ones; ``measure`` tells them apart."""
    reports = [latency_report(df, value, *keys).withColumn("measure", F.lit(name)) for name, df in (("attempts", runs), ("completed", runs.filter(completed)))]
    return reports[0].unionByName(reports[1])


def box_valid(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Of positive size and inside the unit square, in parts per million."""
    return (x >= 0) & (y >= 0) & (width > 0) & (height > 0) & (x + width <= 1_000_000) & (y + height <= 1_000_000)


def box_ppm(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column) -> Column:
    """A pixel box as struct(x_ppm, y_ppm, width_ppm, height_ppm), or null if it leaves the image or has no extent. Edges
    are rounded, not sizes, so that neighbours share them."""
    edge = lambda v, n: F.round(v.cast("double") / n * 1_000_000).cast("long")
    x0, x1, y0, y1 = edge(left, width), edge(right, width), edge(top, height), edge(bottom, height)
    inside = (left >= 0) & (top >= 0) & (right <= width) & (bottom <= height) & (width > 0) & (height > 0)
    return F.when(inside & (x1 > x0) & (y1 > y0), F.struct(x0.alias("x_ppm"), y0.alias("y_ppm"), (x1 - x0).alias("width_ppm"), (y1 - y0).alias("height_ppm")))


def observation_audit(observations: DataFrame) -> DataFrame:
    """One row: all observations, valid and invalid boxes, empty texts, confidences out of range."""
    ok = box_valid(*[F.col(c) for c in ("x_ppm", "y_ppm", "width_ppm", "height_ppm")])
    return observations.agg(
        F.count("*").alias("observations"), F.count_if(ok).alias("valid_boxes"), F.count_if(~ok).alias("invalid_boxes"),
        F.count_if(F.trim("text") == "").alias("empty_texts"), F.count_if(F.col("confidence_basis_points") > 10_000).alias("confidence_out_of_range"),
    )


def distinct_observations(observations: DataFrame) -> DataFrame:
    """Identical (case, text, box) once each, the first by position."""
    return observations.groupBy("case_id", "text", "x_ppm", "y_ppm", "width_ppm", "height_ppm").agg(F.min("position").alias("position"))
