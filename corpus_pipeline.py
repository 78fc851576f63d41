"""The corpus pipeline: five stages over ``documents``, each by one training-data operator.

Each stage takes what its predecessor kept, written as Parquet and read again. The first four return the columns of
documents; the last returns packed pieces (of the columns of :func:`siltstone.llm.packing.pack_documents`, ids included).

Every stage takes nulls in any column, empty and very long texts, ties, repeated rows and columns of any further names,
which pass through the first four; an empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.common import Scratch
from siltstone.llm.mixing import with_copies
from siltstone.llm.near_dedup import without_near_duplicates
from siltstone.llm.packing import pack_documents
from siltstone.llm.quality_rules import without_rejected
from siltstone.llm.secret_scan import redact_secrets


def bounded_batches(spark: SparkSession) -> None:
    """Python workers get the texts in Arrow batches of 4 MB at most (Spark's default is 64), or what the session has, if less:
    executor and worker each hold a batch for every task, on top of a heap that earlier stages have filled."""
    name, most = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
    spark.conf.set(name, min(most, int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch())))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. Null and empty texts fail the base rules and go; a null or rare language is
    judged by the base rules alone; repeated rows share one fate; further columns, whatever their names, stay as they are."""
    return without_rejected(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8 or more. Texts without words and
    rows with a null doc_id stay; of rows that share doc_id and text one stays; rows that share a doc_id alone are judged
    each by its own text; further columns stay as they are."""
    bounded_batches(spark)
    return without_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text, and n_chars follows it. Null and empty texts stay as they are; no row goes; repeated rows
    give equal rows; further columns stay as they are."""
    bounded_batches(spark)
    return redact_secrets(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it, 0 to 2 times. Null and empty texts have no words and are never taken; a
    null source is a source of its own; repeated rows share what is taken of them, rounded up; ties go by shuffled place,
    then doc_id; further columns stay as they are."""
    return with_copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed sequences of 2048 tokens, a row for each piece. Null and empty texts hold the end id alone; a null doc_id is
    carried as it is; repeated rows are packed one by one; further columns are ignored."""
    bounded_batches(spark)
    return pack_documents(docs)


STAGES = [("quality rules", quality_rules), ("near dedup", near_dedup), ("secret scan", secret_scan), ("source mix", source_mix), ("packing", packing)]
#: SQL can express neither the tokenizer nor the Markov models; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
