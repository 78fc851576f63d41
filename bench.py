"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``queries``: seconds of each query, its whole result computed, after one warm-up query. ``baseline``: the published
1,000 phrases answered in one job, single searches (``single``: by reading the texts; ``indexed``: by the kept index, as the engine does), and a listing of 10,000 files in 101 folders.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "search_content search_path search_fused search_filtered search_many chunk_ascii chunk_coverage subtree_members folder_profile exact_duplicates version_pairs "
    "review_groups journal_reduce publish_tombstone cer_slices latency_percentiles watch_coalesce root_overlap purge_closure"
).split()


def timed(f) -> float:
    began = time.perf_counter()
    f()
    return round(time.perf_counter() - began, 3)


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def baseline(spark, work: str) -> dict[str, float]:
    from siltstone.operators import search as S
    from siltstone.operators import search_index
    from siltstone.sources import listing
    from siltstone.sources.warehouse import Warehouse

    out, scratch = {}, f"{work}/corpus"
    locations, chunks, _ = listing.search_corpus(spark, 10_000)

    def load() -> None:
        locations.write.parquet(f"{scratch}/locations")
        chunks.write.parquet(f"{scratch}/chunks")

    out["fixture_load_s"] = timed(load)
    locations, chunks = (spark.read.parquet(f"{scratch}/{t}") for t in ("locations", "chunks"))
    out["trigram_index_s"] = timed(lambda: S.trigram_index(chunks, "chunk_id", "text").write.partitionBy().parquet(f"{scratch}/index"))
    index = spark.read.parquet(f"{scratch}/index")
    w = Warehouse(spark, f"file://{work}/warehouse")

    def build() -> None:
        with w.transaction() as t:
            search_index.refresh(t, search_index.documents(locations, chunks))

    out["kept_index_s"] = timed(build)
    cases = {"content_zh": "本機文件搜尋", "content_en": "project evidence", "exact_filename": "document-00042.md", "missing": "no such phrase"}
    for name, q in cases.items():
        for kind, f in (("single", lambda q=q: S.search(S.Request(q), locations, chunks)), ("indexed", lambda q=q: search_index.search(S.Request(q), w.snapshot(), locations, chunks))):
            runs = sorted(timed(lambda f=f: f().collect()) for _ in range(3))
            out[f"{kind}_{name}_ms"] = round(1000 * runs[1], 1)
    phrases = spark.createDataFrame([(i, f"document {i * 7 % 10_000} ") for i in range(1000)], "query_id long, query string")
    s = timed(lambda: consume(S.search_many(phrases, chunks, index, "chunk_id", "text")))
    out |= {"batch_1000_queries_s": s, "batch_ms_per_query": round(s, 3)}
    listing.tree_fixture(f"{work}/tree", 10_000, 100)
    s = timed(lambda: listing.listing(spark, f"{work}/tree").write.parquet(f"{work}/listed"))
    return out | {"list_10k_files_s": s}


def main() -> None:
    from siltstone.plans.queries import QUERIES
    from siltstone.session import local_session

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="siltstone-bench")
    spark.sparkContext.setLogLevel("ERROR")
    consume(QUERIES["exact_duplicates"](spark, sf_dir))
    seconds = {name: timed(lambda name=name: consume(QUERIES[name](spark, sf_dir))) for name in HEADLINE}
    work = tempfile.mkdtemp(prefix="siltstone-bench-")
    try:
        extra = baseline(spark, work)
    finally:
        shutil.rmtree(work, ignore_errors=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "baseline": extra, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
