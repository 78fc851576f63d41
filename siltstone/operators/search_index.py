"""A persisted inverted index of paths and chunks, kept in step with the manifest by additions and tombstones.

Postings say at which characters of a document (a location's path, or a chunk of a file's text) a trigram stands. They lie in
folders by a bucket of the trigram, so a search reads the few buckets of its phrase's trigrams, never a text: a
phrase stands where its trigrams stand one after the other, which positions alone tell. Documents and characters are counted
per scope when the index changes, and kept in the commit, so bm25 needs no pass over the corpus either.

A task writes the postings of its texts into all buckets at once, document by document: neither texts nor postings are shuffled or
sorted, and a document's key is stored as a difference of nothing in all its rows of a bucket but the first.

A refresh compares the documents that should be there with those that are, by the hash of their text: new and changed ones become
a segment of postings of their own, gone and changed ones a tombstone that hides their postings in earlier segments. More than
``max_segments`` segments are merged into one, without what is hidden. All tables change in the caller's transaction, so the
index is always that of the manifest that was published with it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions.text import snippet
from siltstone.operators import search as S
from siltstone.sources.warehouse import Snapshot, Transaction, empty

KEY = ("source", "scope_id", "node_id", "location_id", "chunk_id")
DOCUMENT = "source string, scope_id long, node_id long, location_id long, chunk_id long"
POSTING = f"{DOCUMENT}, length long, trigram long, positions array<int>"
TOMBSTONE = f"{DOCUMENT}, segment long, before long"
TABLES = ("search_documents", "search_postings", "search_tombstones")


@dataclass(frozen=True)
class IndexOptions:
    """``buckets`` is fixed when an index is first written, and kept with it: more for larger collections."""

    buckets: int = 61
    max_segments: int = 8


def codes(low: str) -> list[int]:
    """A lower-case text's trigrams in order, as numbers of three code points."""
    c = [ord(x) for x in low]
    return [(c[i] << 42) | (c[i + 1] << 21) | c[i + 2] for i in range(len(c) - 2)]


def documents(metadata: DataFrame, content: DataFrame) -> DataFrame:
    """(key, text) of all that is searched: ``metadata`` are present locations, ``content`` chunks of present files."""
    key = [F.col(k).cast("long").alias(k) for k in KEY[1:4]]
    paths = metadata.select(F.lit("metadata").alias("source"), *key, F.lit(0).cast("long").alias("chunk_id"), F.col("display_path").alias("text"))
    chunks = content.select(F.lit("content").alias("source"), *key, F.col("chunk_id").cast("long").alias("chunk_id"), "text")
    return paths.unionByName(chunks).filter(F.col("text").isNotNull())


def postings(docs: DataFrame) -> DataFrame:
    """A row for each document and trigram with its positions."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            while at < b.num_rows:  # about a million characters at a time
                first, size, parts = at, 0, []
                while at < b.num_rows and (at == first or size < 1 << 20):
                    c = np.frombuffer(b.column(5)[at].as_py().encode("utf-32-le"), np.uint32).astype(np.int64)
                    code = (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
                    order = np.argsort(code, kind="stable").astype(np.int32)
                    parts.append((code[order], order))
                    size += len(c)
                    at += 1
                starts = [np.flatnonzero(np.diff(code, prepend=-1)) if len(code) else np.empty(0, np.int64) for code, _ in parts]
                counts = np.array([len(s) for s in starts])
                row = pa.array(np.repeat(np.arange(first, at), counts))
                shift = np.cumsum([0, *(len(o) for _, o in parts)])
                offsets = np.concatenate([*(s + d for s, d in zip(starts, shift)), shift[-1:]])
                listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([o for _, o in parts])))
                length = np.array([len(o) for _, o in parts], np.int64)
                trigram = np.concatenate([code[s] for (code, _), s in zip(parts, starts)])
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(row) for k in range(5)), pa.array(np.repeat(length, counts)), pa.array(trigram), listed], names=[x.split()[0] for x in POSTING.split(", ")])

    return docs.select(*KEY, F.lower("text").alias("low")).filter(F.char_length("low") >= 3).mapInArrow(run, POSTING)


def _read(at: Snapshot | Transaction, name: str, spark: SparkSession) -> DataFrame:
    if at.version(name):
        return at.read(name)
    schemas = {
        "search_documents": f"{DOCUMENT}, length long, print long, segment long", "search_postings": f"{POSTING}, segment long, bucket int", "search_tombstones": TOMBSTONE,
    }
    return empty(spark, schemas[name])


def refresh(t: Transaction, wanted: DataFrame, options: IndexOptions = IndexOptions()) -> bool:
    """Brings the index to ``wanted`` (key, text); returns whether anything changed."""
    spark = wanted.sparkSession
    state = t.notes.get("search", {"segment": 0, "buckets": options.buckets, "tombstones": 0})
    segment, buckets = state["segment"] + 1, state["buckets"]
    old = _read(t, "search_documents", spark)
    low = F.lower("text")
    new = wanted.select(*KEY, F.greatest(F.char_length(low) - 2, F.lit(0)).cast("long").alias("length"), F.xxhash64("text").alias("print"))
    both = new.join(old.select(*KEY, F.col("length").alias("_l"), F.col("print").alias("_p"), F.col("segment").alias("_s")), list(KEY), "left")
    same = (F.col("length") == F.col("_l")) & (F.col("print") == F.col("_p"))
    t.replace("search_documents", both.select(*KEY, "length", "print", F.when(same, F.col("_s")).otherwise(segment).cast("long").alias("segment")))
    now = t.read("search_documents")
    gone = old.join(now.select(*KEY, "segment"), [*KEY, "segment"], "left_anti").select(*KEY, "segment", F.lit(segment).cast("long").alias("before"))
    added, hidden = now.filter(F.col("segment") == segment), gone.count()
    n_added, characters = added.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).head()
    if not hidden and not n_added:
        return False
    if hidden:
        t.append("search_tombstones", gone)
    counted = now.groupBy("source", "scope_id").agg(F.count("*"), F.sum("length")).collect()  # two rows a scope
    fresh = None
    if n_added:
        texts = without(wanted.dropna(subset=list(KEY)), list(KEY), now.filter(F.col("segment") < segment), added)
        fresh = postings(_dealt(texts, characters, "node_id")).withColumn("segment", F.lit(segment).cast("long"))
    t.note("search", {"segment": segment, "buckets": buckets, "tombstones": state["tombstones"] + hidden, "statistics": [list(r) for r in counted]})
    if 0 < t.parts("search_postings") > options.max_segments - bool(n_added):
        compact(t, fresh)
    elif n_added:
        _write(t, fresh, buckets, append=True)
    return True


def _dealt(rows: DataFrame, characters: int, by: str) -> DataFrame:
    """In as many tasks as that many characters are worth, as each writes a file into every bucket. Rows stay where they are, unless they are few."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = min(1 + (characters >> 20), max(cores, 1 + (characters >> 25)))
    return rows.repartition(tasks, by) if tasks < cores else rows.coalesce(tasks)


def _write(t: Transaction, rows: DataFrame, buckets: int, append: bool) -> None:
    dealt = rows.withColumn("bucket", F.pmod("trigram", F.lit(buckets)).cast("int")) if "bucket" not in rows.columns else rows
    # differences of neighbours for what repeats or ascends; row groups so small that all buckets' together fit a task's memory
    options = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.block.size": str(max(1 << 20, (1 << 28) // buckets))}
    options |= {f"parquet.enable.dictionary#{c}": "false" for c in ("scope_id", "node_id", "location_id", "chunk_id", "segment", "positions.list.element")}
    conf, writers = rows.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(writers, "0")
    conf.set(writers, str(buckets + 1))  # all buckets' files are open at once, below the bound at which a task sorts the rest of its postings and spills it
    try:
        (t.append if append else t.replace)("search_postings", dealt, check=False, partition_by=("bucket",), options=options)
    finally:
        conf.set(writers, before)


def without(rows: DataFrame, keys: list[str], gone: DataFrame, kept: DataFrame, bits: int = 32, most: int = 1 << 27, listed: int = 1_000_000) -> DataFrame:
    """The rows that ``gone`` doesn't name by ``keys``, where either ``gone`` or ``kept`` names every row; exact, and no row is shuffled.

    All tasks know a bitmap of the gone ones, of 16 MB at most, and a list of those kept ones that it takes for gone: with 32 bits for each
    that is one in some thousands. Only if more than ``listed`` would be on that list do the rows meet the kept ones in a join."""
    n = gone.count()
    if not n:
        return rows
    size, flag, there = 1 << 15, "_gone", "_kept"  # bits of a value of bitmap_construct_agg
    blocks = max(1, min(most, bits * n) // size)
    block = F.pmod(F.xxhash64(*keys), F.lit(blocks)).alias("_block")
    places = [F.shiftrightunsigned(F.xxhash64(F.lit(1), *keys), 15 * i).bitwiseAND(size - 1).cast("int") for i in range(4)]
    word = lambda i: F.conv(F.hex(F.substring("_bits", i * 4 + 1, F.lit(4))), 16, 10).cast("long")
    signed = lambda w: F.when(w < 1 << 31, w).otherwise(w - (1 << 32)).cast("int")
    bitmap = gone.select(block, F.explode(F.array(*places)).alias("_place")).groupBy("_block").agg(F.bitmap_construct_agg("_place").alias("_bits"))
    bitmap = F.broadcast(bitmap.select("_block", F.transform(F.sequence(F.lit(0), F.lit(size // 32 - 1)), lambda i: signed(word(i))).alias("_words")))
    marked = lambda p: F.getbit(F.get("_words", F.shiftright(p, 5)), 24 - F.shiftright(p, 3).bitwiseAND(3) * 8 + p.bitwiseAND(7)) == 1

    def flagged(df: DataFrame) -> DataFrame:
        met = df.withColumn("_block", block).join(bitmap, "_block", "left")
        return met.withColumn(flag, F.coalesce(marked(places[0]) & marked(places[1]) & marked(places[2]) & marked(places[3]), F.lit(False))).select(*df.columns, flag)

    wrong = flagged(kept.select(*keys)).filter(flag).select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    if wrong.count() > listed:
        return rows.join(kept.select(*keys), keys, "left_semi")
    same = [(F.when(F.col(flag), F.col(k)) if k == keys[0] else F.col(k)) == F.col(f"_{k}") for k in keys]  # only what is flagged is looked up
    return flagged(rows).join(F.broadcast(wrong.withColumn(there, F.lit(True))), same, "left").filter(~F.col(flag) | F.col(there).isNotNull()).select(*rows.columns)


def live(rows: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Rows of (key, segment) that no tombstone hides."""
    hidden = tombstones.groupBy(*KEY).agg(F.max("before").alias("before"))
    same = [rows[k] == hidden[k] for k in KEY]
    return rows.join(hidden, [*same, rows["segment"] < hidden["before"]], "left_anti")


def standing(at: Snapshot | Transaction, rows: DataFrame) -> DataFrame:
    """Those of the index's postings, as rows of (key, segment, ...), that no tombstone hides; they are not shuffled for it."""
    if not at.notes["search"]["tombstones"]:
        return rows
    hidden = at.read("search_tombstones")
    if "segment" not in hidden.columns or not hidden.filter(F.col("segment").isNull()).isEmpty():  # of an index that kept no segments with its tombstones
        return live(rows, hidden)
    return without(rows, [*KEY, "segment"], hidden, at.read("search_documents"))


def compact(t: Transaction, fresh: DataFrame | None = None) -> None:
    """All segments as one, without what tombstones hide; ``fresh`` are postings that go into it without being a segment before."""
    state, rows = t.notes["search"], t.read("search_postings")
    characters = sum(r[3] for r in state["statistics"])
    kept = _dealt(standing(t, rows), characters, "bucket")
    if fresh is not None:
        kept = kept.unionByName(fresh.withColumn("bucket", F.pmod("trigram", F.lit(state["buckets"])).cast("int")))
    _write(t, kept, state["buckets"], append=False)
    t.replace("search_tombstones", empty(rows.sparkSession, TOMBSTONE))
    t.note("search", {**state, "tombstones": 0})


def phrase_hits(at: Snapshot | Transaction, phrase: str, sources: list[str], spark: SparkSession) -> DataFrame:
    """(key, segment, length, tf): live documents that hold a phrase of three characters or more, and how often without overlap."""
    low = phrase.lower()
    all_codes, n = codes(low), len(low)
    offsets = sorted({*range(0, n - 2, 3), n - 3})  # these trigrams cover the phrase
    state = at.notes.get("search")
    if state is None:
        return empty(spark, f"{DOCUMENT}, segment long, length long, tf long")
    asked = sorted({all_codes[i] for i in offsets})
    buckets = sorted({c % state["buckets"] for c in asked})
    rows = at.warehouse.read_partitions("search_postings", at.tables.get("search_postings") or [], "bucket", buckets, f"{POSTING}, segment long").filter(F.col("trigram").isin(asked) & F.col("source").isin(sources))
    places = F.array(*[F.struct(F.lit(all_codes[i]).alias("code"), F.lit(i).alias("offset")) for i in offsets])
    begun = F.flatten(F.transform(F.filter(places, lambda p: p["code"] == F.col("trigram")), lambda p: F.array(F.transform("positions", lambda x: x - p["offset"]))))
    if len(offsets) == 1:
        found = rows.select(*KEY, "segment", "length", F.col("positions").alias("starts"))
    else:
        lists = rows.groupBy(*KEY, "segment", "length").agg(F.flatten(F.collect_list(begun)).alias("lists")).filter(F.size("lists") == len(offsets))
        found = lists.select(*KEY, "segment", "length", F.array_sort(F.aggregate(F.slice("lists", 2, len(offsets)), F.get("lists", F.lit(0)), lambda a, x: F.array_intersect(a, x))).alias("starts"))
    apart = F.aggregate("starts", F.struct(F.lit(-n).alias("last"), F.lit(0).alias("n")), lambda a, x: F.when(x >= a["last"] + n, F.struct(x.alias("last"), (a["n"] + 1).alias("n"))).otherwise(a))
    hits = found.filter(F.size("starts") > 0).select(*KEY, "segment", "length", apart["n"].cast("long").alias("tf"))
    return live(hits, at.read("search_tombstones")) if state["tombstones"] else hits


def candidates(at: Snapshot | Transaction, c: S.Checked, sources: list[str], locations: DataFrame, scope: DataFrame | None = None) -> list[Row]:
    """(key, rank) of each source's best candidates, ranked from 1 as :func:`siltstone.operators.search.candidates` ranks them.
    ``locations`` are the present ones; ``scope`` the (node_id, location_id) that a folder allows. Hits are found once, counted, and then cut."""
    spark, place = locations.sparkSession, ["node_id", "location_id"]
    hits = phrase_hits(at, c.query, sources, spark)
    if scope is not None:
        hits = hits.join(scope.select(*place).distinct(), place, "left_semi")
    hits = hits.persist()
    try:
        found = {r.source: r.n for r in hits.groupBy("source").agg(F.count("*").alias("n")).collect()}
        if not found:
            return []
        if scope is None:
            counted = [(r[0], r[2], r[3]) for r in at.notes["search"]["statistics"]]
        else:
            inside = at.read("search_documents").join(scope.select(*place).distinct(), place, "left_semi")
            counted = [tuple(r) for r in inside.groupBy("source").agg(F.count("*"), F.sum("length")).collect()]
        score = F.lit(None).cast("double")
        for source, n_hits in found.items():
            n, characters = (sum(r[i] for r in counted if r[0] == source) for i in (1, 2))
            idf = F.greatest(F.ln((F.lit(n) - F.lit(n_hits) + 0.5) / (F.lit(n_hits) + 0.5)), F.lit(1e-6))
            score = F.when(F.col("source") == source, F.round(idf * (F.col("tf") * 2.2) / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("length") / F.lit(characters / n if n else 1.0))), 6)).otherwise(score)
        scored = hits.withColumn("_score", score)
        if any(x is not None for x in (c.request.scope_id, c.extension, c.since_ns, c.before_ns)):
            shown = locations.select("scope_id", *place, "display_path", "modified_unix_ns")
            scored = scored.join(shown, ["scope_id", *place]).filter(S.filters(c))
        w = Window.partitionBy("source").orderBy(F.desc("_score"), *place, "chunk_id")
        best = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= c.per_source)  # cut in each task before they meet
        return best.select(*KEY, "rank").collect()  # two hundred at most
    finally:
        hits.unpersist()


def search(request: S.Request, at: Snapshot | Transaction, locations: DataFrame, chunks: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Ranked results as of :func:`siltstone.operators.search.search`, from the index. Of the locations and texts only those of the best
    candidates, whose nodes are named in the scans' filters, are read, for their paths and snippets."""
    c = S.check(request)
    spark, place = locations.sparkSession, ["scope_id", "node_id", "location_id"]
    best = candidates(at, c, ["metadata", "content"] if request.source == "all" else [request.source], locations, scope)
    hits = spark.createDataFrame(best, f"{DOCUMENT}, rank int")
    among = lambda df, rows: df.filter(F.col("node_id").isin(sorted({r.node_id for r in rows})))
    hits = F.broadcast(hits).join(among(locations, best).select(*place, "display_path"), place) if best else hits.withColumn("display_path", F.lit(None).cast("string"))
    with_text = [r for r in best if r.source == "content"]
    if with_text:
        texts = among(chunks, with_text).withColumns({"source": F.lit("content"), "chunk_id": F.col("chunk_id").cast("long")}).select(*KEY, "text")
        keys = spark.createDataFrame([tuple(r)[:5] for r in with_text], DOCUMENT)
        shown = texts.join(F.broadcast(keys), list(KEY), "left_semi").select(*KEY, snippet(F.col("text"), c.query).alias("snippet"))
        hits = hits.join(F.broadcast(shown), list(KEY), "left")  # a row for each of the hundred candidates at most
    else:
        hits = hits.withColumn("snippet", F.lit(None).cast("string"))
    return S.fuse(hits.select(*S.HIT, "source", "rank", "snippet"), c.query, c.limit)
