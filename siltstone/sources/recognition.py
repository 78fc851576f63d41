"""Recognized text: observations made elsewhere are checked and become chunks with boxes and confidence."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.evaluation import box_valid
from siltstone.sources.content import ExtractionError, Limits, split_text

# Bounds on a request and its answer.
MAX_SOURCE, MAX_SIDE, MAX_PIXELS, MAX_OBSERVATIONS, MAX_TEXT = 32 * 1024 * 1024, 16_384, 64 * 1024 * 1024, 4096, 256 * 1024
CHUNKS = "case_id string, ordinal long, text string, source_bbox_x_ppm long, source_bbox_y_ppm long, source_bbox_width_ppm long, source_bbox_height_ppm long, source_confidence_basis_points long, source_fragment_index long, error_code string"


def request_code(size: Column, width: Column, height: Column, ext: Column) -> Column:
    """Why an image is not sent for recognition; null if it may be."""
    return (
        F.when(~ext.isin("png", "jpg", "jpeg"), "extraction_ocr_unsupported_format").when(size > MAX_SOURCE, "extraction_ocr_source_too_large")
        .when((width < 1) | (height < 1) | (width > MAX_SIDE) | (height > MAX_SIDE) | (width.cast("long") * height > MAX_PIXELS), "extraction_ocr_dimensions_invalid")
    )


def checked(observations: DataFrame) -> DataFrame:
    """Adds ``error_code`` per observation: text, box, confidence; an image with too many has it on all of them.

    observations: case_id, position, text, x_ppm, y_ppm, width_ppm, height_ppm, confidence_basis_points (nullable).
    """
    n = observations.groupBy("case_id").agg(F.count("*").alias("_n"))
    box = box_valid(*[F.col(c) for c in ("x_ppm", "y_ppm", "width_ppm", "height_ppm")])
    confidence = F.col("confidence_basis_points").isNull() | F.col("confidence_basis_points").between(0, 10_000)
    code = (
        F.when(F.col("_n") > MAX_OBSERVATIONS, "extraction_ocr_too_many_observations").when(F.octet_length("text") > MAX_TEXT, "extraction_ocr_text_too_large")
        .when(~F.coalesce(box, F.lit(False)), "extraction_ocr_box_invalid").when(~confidence, "extraction_ocr_confidence_invalid")
    )
    return observations.join(n, "case_id").withColumn("error_code", code).drop("_n")


def region_chunks(observations: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Chunks of recognized regions in order of position, repeated (text, box) once, empty texts left out. One faulty
    observation fails its image: it gives a single row with the code."""
    faulty = checked(observations)
    bad = faulty.filter(F.col("error_code").isNotNull()).groupBy("case_id").agg(F.min_by("error_code", "position").alias("error_code"))
    box = ["x_ppm", "y_ppm", "width_ppm", "height_ppm"]
    good = faulty.join(bad.select("case_id"), "case_id", "left_anti").filter(F.trim("text") != "")
    good = good.groupBy("case_id", "text", *box).agg(F.min("position").alias("position"), F.min_by("confidence_basis_points", "position").alias("confidence"))
    per_case = good.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("position", "text", *box, "confidence"))).alias("o"))  # MAX_OBSERVATIONS at most
    kinds = {"string": pa.string(), "long": pa.int64()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in CHUNKS.split(", "))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for case, regions in zip(batch.column(0), batch.column(1), strict=True):
                rows: list[dict] = []
                try:
                    for r in regions.as_py():
                        for i, (text, _, _) in enumerate(split_text(r["text"], limits)):
                            if len(rows) >= limits.chunks:
                                raise ExtractionError("extraction_chunk_limit_exceeded")
                            rows.append({"case_id": case.as_py(), "ordinal": len(rows), "text": text, "source_fragment_index": i, "source_confidence_basis_points": r["confidence"], **{f"source_bbox_{c}": r[c] for c in box}})
                except ExtractionError as e:
                    rows = [{"case_id": case.as_py(), "error_code": e.code}]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    failed = bad.select(F.col("case_id").cast("string").alias("case_id"), "error_code")
    return per_case.select(F.col("case_id").cast("string").alias("case_id"), "o").mapInArrow(run, CHUNKS).unionByName(failed, allowMissingColumns=True)
