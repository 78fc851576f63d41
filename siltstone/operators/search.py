"""Lexical search over paths and extracted text: match, filter, cut per source, fuse, rank, explain.

A query is one phrase, matched case-insensitively as a substring (what a trigram phrase match means for three characters
and more), never as an operator or pattern. Each source is cut to its best candidates before the two meet, so the fusion
shuffles at most two hundred rows whatever the corpus' size. The per-source order is bm25 over trigrams (k1 = 1.2, b =
0.75), rounded to six digits, then node, location and chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.errors import EngineError
from siltstone.functions.paths import ancestors, extension, filename
from siltstone.functions.text import normalize_extension, normalize_query, occurrences, snippet, trigrams, truncate_utf8

DEFAULT_LIMIT, MAX_LIMIT, MAX_PER_SOURCE = 20, 50, 100
NO_RANK = 2**31 - 1
HIT = ("scope_id", "node_id", "location_id", "display_path")


@dataclass(frozen=True)
class Request:
    query: str
    scope_id: int | None = None
    folder_node_id: int | None = None
    source: str = "all"
    extension: str | None = None
    modified_since_s: int | None = None
    modified_before_s: int | None = None
    limit: int | None = None

    def __repr__(self) -> str:  # queries are private
        return "Request(...)"


@dataclass(frozen=True)
class Checked:
    query: str
    limit: int
    per_source: int
    extension: str | None
    since_ns: int | None
    before_ns: int | None
    request: Request


def check(r: Request) -> Checked:
    """The request, normalized; raises the code of the first rule it breaks."""
    query = normalize_query(r.query)
    if r.scope_id is not None and r.scope_id <= 0:
        raise EngineError("search_scope_invalid")
    if r.folder_node_id is not None and (r.folder_node_id <= 0 or r.scope_id is None):
        raise EngineError("search_folder_invalid")
    ext = normalize_extension(r.extension) if r.extension is not None else None
    since, before = r.modified_since_s, r.modified_before_s
    if any(x is not None and (x < 0 or x * 10**9 >= 2**63) for x in (since, before)) or (since is not None and before is not None and since >= before):
        raise EngineError("search_modified_range_invalid")
    limit = DEFAULT_LIMIT if r.limit is None else r.limit
    if not 1 <= limit <= MAX_LIMIT:
        raise EngineError("search_limit_out_of_range")
    if r.source not in ("all", "metadata", "content"):
        raise EngineError("search_source_invalid")
    ns = lambda x: None if x is None else x * 10**9
    return Checked(query, limit, min(2 * limit, MAX_PER_SOURCE), ext, ns(since), ns(before), r)


def filters(c: Checked) -> Column:
    """On a manifest row: scope, extension, and the half-open range of the file's time (a null time fails both ends)."""
    out = F.lit(True)
    if c.request.scope_id is not None:
        out = out & (F.col("scope_id") == c.request.scope_id)
    if c.extension:
        out = out & (extension(filename(F.col("display_path"))) == c.extension)
    if c.since_ns is not None:
        out = out & F.coalesce(F.col("modified_unix_ns") >= c.since_ns, F.lit(False))
    if c.before_ns is not None:
        out = out & F.coalesce(F.col("modified_unix_ns") < c.before_ns, F.lit(False))
    return out


def bm25(text: str, query: str, corpus: DataFrame) -> tuple[Column, DataFrame]:
    """(score, corpus with its statistics): N and the mean length by one aggregate, n by another; one row, joined on."""
    length = F.greatest(F.char_length(F.lower(F.col(text))) - 2, F.lit(0)).cast("long")
    hit = F.contains(F.lower(F.col(text)), F.lit(query.lower()))
    stats = corpus.agg(F.count("*").alias("_n"), F.avg(length).alias("_mean"), F.count_if(hit).alias("_hits"))
    idf = F.greatest(F.ln((F.col("_n") - F.col("_hits") + 0.5) / (F.col("_hits") + 0.5)), F.lit(1e-6))
    tf = occurrences(F.col(text), query)
    score = F.round(idf * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * length / F.col("_mean"))), 6)
    return score, corpus.filter(hit).join(F.broadcast(stats))  # stats is a single row


def candidates(corpus: DataFrame, text: str, c: Checked, source: str) -> DataFrame:
    """A source's best candidates, ranked from 1. Ranks count candidates, so a file's chunks use up one each."""
    score, hits = bm25(text, c.query, corpus)
    tie = [k for k in ("node_id", "location_id", "chunk_id") if k in corpus.columns]
    hits = hits.filter(filters(c)).withColumn("_score", score).orderBy(F.desc("_score"), *tie).limit(c.per_source)
    ranked = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("_score"), *tie)))
    shown = snippet(F.col(text), c.query) if source == "content" else F.lit(None).cast("string")
    return ranked.select(*HIT, F.lit(source).alias("source"), "rank", shown.alias("snippet"))


def fuse(hits: DataFrame, query: str, limit: int) -> DataFrame:
    """One row per (node, location), ranked: exact file name, both sources, metadata rank, content rank, ids."""
    rank = lambda s: F.min(F.when(F.col("source") == s, F.col("rank")))
    found = hits.groupBy("node_id", "location_id").agg(
        F.min("scope_id").alias("scope_id"), F.min("display_path").alias("display_path"), rank("metadata").alias("m"), rank("content").alias("c"),
        F.min_by("snippet", F.when(F.col("source") == "content", F.col("rank"))).alias("snippet"),
    )
    meta, content = F.col("m").isNotNull(), F.col("c").isNotNull()
    found = found.withColumn("exact", F.lower(filename(F.col("display_path"))) == query.lower())
    order = [(~F.col("exact")).cast("int"), (~(meta & content)).cast("int"), F.coalesce("m", F.lit(NO_RANK)), F.coalesce("c", F.lit(NO_RANK)), F.col("node_id"), F.col("location_id")]
    explanation = (
        F.when(F.col("exact") & content, "exact_filename_and_extracted_text").when(F.col("exact"), "exact_filename").when(meta & content, "path_and_extracted_text_substring")
        .when(meta, "path_substring").when(content, "extracted_text_substring").otherwise("no_match")
    )
    fields = F.filter(F.array(F.when(F.col("exact"), "filename"), F.when(meta, "path"), F.when(content, "extracted_text")), lambda x: x.isNotNull())
    best = found.orderBy(*order).limit(limit)
    return best.select("scope_id", "node_id", "location_id", "display_path", "snippet", fields.alias("matched_fields"), explanation.alias("explanation"), F.row_number().over(Window.orderBy(*order)).alias("lexical_rank"))


def without_excluded(rows: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Drops rows that lie under an excluded path of their scope or carry an excluded identity; equi-joins on exploded
    ancestors, so the exclusion list may be of any size."""
    paths = exclusions.filter("kind = 'path'").select(F.col("scope_id").alias("_s"), F.col("path_key").alias("_p")).distinct()
    above = rows.select("scope_id", "node_id", "location_id", F.explode(ancestors(F.col("path_key"))).alias("_above"))
    gone = above.join(paths, (F.col("scope_id") == F.col("_s")) & (F.col("_above") == F.col("_p")), "left_semi").select("scope_id", "node_id", "location_id").distinct()
    out = rows.join(gone, ["scope_id", "node_id", "location_id"], "left_anti")
    if "identity_key" in rows.columns:
        ids = exclusions.filter("kind = 'identity'").select("scope_id", "identity_kind", "identity_key").distinct()
        out = out.join(ids, ["scope_id", "identity_kind", "identity_key"], "left_anti")
    return out


def search(request: Request, metadata: DataFrame, content: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Ranked results. ``metadata`` rows: scope, node, location, display_path, modified_unix_ns of present locations;
    ``content`` rows: the same and chunk_id, text of active chunks. ``scope``, where given, holds the (node_id, location_id)
    that a folder's subtree allows, so that a node's location elsewhere is none of them, or (node_id) alone."""
    c = check(request)
    hits = []
    for source, corpus, text in (("metadata", metadata, "display_path"), ("content", content, "text")):
        if request.source in ("all", source):
            hits.append(candidates(corpus if scope is None else corpus.join(scope, [k for k in ("node_id", "location_id") if k in scope.columns], "left_semi"), text, c, source))
    return fuse(hits[0] if len(hits) == 1 else hits[0].unionByName(hits[1]), c.query, c.limit)


def agent_projection(results: DataFrame, field_bytes: int = 2048, payload_bytes: int = 24 * 1024) -> DataFrame:
    """What an agent sees: bounded fields, rows while the payload stays within its bound, and whether rows are missing."""
    rows = results.select("lexical_rank", "node_id", truncate_utf8(F.col("display_path"), field_bytes).alias("display_path"), truncate_utf8(F.col("snippet"), field_bytes).alias("snippet"), "explanation")
    size = F.octet_length("display_path") + F.coalesce(F.octet_length("snippet"), F.lit(0)) + F.octet_length("explanation")
    w = Window.orderBy("lexical_rank")  # of fifty rows at most
    rows = rows.withColumn("payload_bytes", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    rows = rows.withColumn("truncated", F.max(F.col("payload_bytes") > payload_bytes).over(Window.partitionBy()))
    return rows.filter(F.col("payload_bytes") <= payload_bytes)


def trigram_index(corpus: DataFrame, key: str, text: str, only: DataFrame | None = None) -> DataFrame:
    """(trigram, key): the posting lists, or those of a few trigrams (``only``, a column trigram): the others of a text
    are dropped before they become rows."""
    if only is None:
        return corpus.select(F.explode(trigrams(F.col(text))).alias("trigram"), key)
    wanted = only.agg(F.collect_set("trigram").alias("_wanted"))  # one row
    return corpus.join(F.broadcast(wanted)).select(F.explode(F.array_intersect("_wanted", trigrams(F.col(text)))).alias("trigram"), key)


def search_many(queries: DataFrame, corpus: DataFrame, index: DataFrame, key: str, text: str) -> DataFrame:
    """(query_id, key): all hits of many phrases in one job. A phrase meets the corpus by its rarest trigram's posting
    list only, and each meeting is then confirmed on the text."""
    terms = queries.select("query_id", "query", F.explode(trigrams(F.col("query"))).alias("trigram"))
    wanted = index.join(terms.select("trigram").distinct(), "trigram", "left_semi")
    weights = wanted.groupBy("trigram").agg(F.count("*").alias("n"))
    found = terms.join(weights, "trigram", "left")
    rarest = found.groupBy("query_id", "query").agg(F.min_by("trigram", F.struct(F.coalesce("n", F.lit(0)), "trigram")).alias("trigram"))
    return rarest.join(wanted, "trigram").join(corpus.select(key, text), key).filter(F.contains(F.lower(text), F.lower("query"))).select("query_id", key)


def search_few(queries: list[tuple[int, str]], corpus: DataFrame, key: str, text: str) -> DataFrame:
    """(query_id, key): all hits of a few phrases, by one scan that looks for each of them; more phrases than that go by an index."""
    low = F.lower(F.col(text))
    hits = F.array_compact(F.array(*[F.when(F.contains(F.col("_low"), F.lit(q.lower())), F.lit(i).cast("long")) for i, q in queries]))
    return corpus.select(key, low.alias("_low")).select(F.explode(hits).alias("query_id"), key)


def folder_list(folders: DataFrame, limit: int = 200) -> DataFrame:
    """The first folders by path, and whether there are more."""
    if not 1 <= limit <= 500:
        raise EngineError("search_limit_out_of_range")
    first = folders.orderBy("display_path", "node_id").limit(limit + 1).withColumn("position", F.row_number().over(Window.orderBy("display_path", "node_id")))
    return first.withColumn("truncated", F.max("position").over(Window.partitionBy()) > limit).filter(F.col("position") <= limit)
