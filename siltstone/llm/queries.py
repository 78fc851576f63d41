"""The training-data operators' queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.hard_negatives import mine_negatives
from siltstone.llm.metric_search import top_k
from siltstone.llm.mixing import fair_mix
from siltstone.llm.near_dedup import NearDedup, near_duplicates
from siltstone.llm.packing import pack_documents
from siltstone.llm.preference import format_exchanged
from siltstone.llm.pu_quality import classify
from siltstone.llm.quality_rules import apply_rules
from siltstone.llm.secret_scan import KINDS, joined, scan_secrets
from siltstone.llm.source_audit import audit_sources
from siltstone.llm.substring_dedup import remove_repeats
from siltstone.llm.token_files import read_token_files, write_token_files
from siltstone.llm.url_filters import judge_urls
from siltstone.session import table


def op1_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[n(k) for k in KINDS], F.sha2(joined("findings", KINDS[:3]), 256).alias("base_sha256"), joined("findings", KINDS).alias("spans"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(spark, write_token_files(table(spark, sf_dir, "documents"), end_id=2))


def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), end_id=1, with_ids=False).drop("ids")


def op5_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), NearDedup(shingle_words=3, percent=85))


def op7_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_weighted_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_exchanged(table(spark, sf_dir, "conversations"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op11_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).drop("by_alias")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    return mine_negatives(table(spark, sf_dir, "embeddings"), vec_id % 100 == 0, F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
