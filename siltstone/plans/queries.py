"""The engine's operators over the driver's tables. The tables stand in for a scanned collection: documents and pages for
files and their text, the star schema for folders, events for hints, decisions and journals."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone import schemas
from siltstone.functions import paths as P
from siltstone.functions import text as X
from siltstone.operators import actions, closure, equality, evaluation, graph, journal, manifest, privacy, relations, search_index
from siltstone.operators import search as S
from siltstone.session import table
from siltstone.sources import content, listing
from siltstone.sources.warehouse import Warehouse
from siltstone.streaming import sinks, watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL counterpart."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def long(c: str | Column, name: str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long").alias(name)


# ---- stand-ins ----------------------------------------------------------------------------------------------------


def page_locations(spark: SparkSession, d: str) -> DataFrame:
    """Pages as present locations of three scopes; the file time is an hour per page id."""
    p = table(spark, d, "pages")
    return p.select(
        long(F.col("page_id") % 3 + 1, "scope_id"), long("page_id", "node_id"), long("page_id", "location_id"), F.col("url").alias("display_path"),
        F.regexp_replace("url", r"^https?://|[?#].*$", "").alias("path_key"), (F.col("page_id") * 3_600_000_000_000).cast("long").alias("modified_unix_ns"), "html",
    )


def page_chunks(spark: SparkSession, d: str) -> DataFrame:
    return page_locations(spark, d).withColumn("chunk_id", F.col("node_id")).withColumnRenamed("html", "text")


def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(F.lit(1).cast("long").alias("scope_id"), long("doc_id", "node_id"), long("doc_id", "location_id"), long("doc_id", "chunk_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("display_path"), F.lit(None).cast("long").alias("modified_unix_ns"), "text")


def tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes): region, nation and customer are folders, orders are files. Ids: r, 100 + n, 1000 + c, 10^9 + o."""
    n, c, o = (table(spark, d, t) for t in ("nation", "customer", "orders"))
    edge = lambda df, child, parent: df.select(long(child, "source_node_id"), long(parent, "target_node_id"), F.lit("located_in").alias("kind"), F.lit(True).alias("active"), F.lit(1).cast("long").alias("scope_id"))
    edges = edge(n, F.col("n_nationkey") + 100, F.col("n_regionkey")).unionByName(edge(c, F.col("c_custkey") + 1000, F.col("c_nationkey") + 100)).unionByName(edge(o, F.col("o_orderkey") + 1_000_000_000, F.col("o_custkey") + 1000))
    ext = F.when(F.col("o_orderstatus") == "F", ".rs").when(F.col("o_orderstatus") == "O", ".md").otherwise(".csv")
    folder = lambda df, key, shift, name: df.select(long(F.col(key) + shift, "node_id"), F.lit("folder").alias("kind"), F.col(name).alias("name"), F.lit(None).cast("long").alias("size_bytes"), F.lit(None).cast("long").alias("modified_unix_ns"))
    files = o.select(long(F.col("o_orderkey") + 1_000_000_000, "node_id"), F.lit("file").alias("kind"), F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"), ext).alias("name"), long(F.round(F.col("o_totalprice") * 100), "size_bytes"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000).alias("modified_unix_ns"))
    nodes = folder(n, "n_nationkey", 100, "n_name").unionByName(folder(c, "c_custkey", 1000, "c_name")).unionByName(folder(table(spark, d, "region"), "r_regionkey", 0, "r_name")).unionByName(files)
    return edges, nodes


def event_ms() -> Column:
    return F.unix_millis(F.col("ts").cast("timestamp"))


TREE_SQL = """
edges AS (
  SELECT n_nationkey + 100 AS child, CAST(n_regionkey AS BIGINT) AS parent FROM nation
  UNION ALL SELECT c_custkey + 1000, c_nationkey + 100 FROM customer
  UNION ALL SELECT o_orderkey + 1000000000, o_custkey + 1000 FROM orders)"""
PAGES_SQL = """
pages_ AS (SELECT page_id % 3 + 1 AS scope_id, page_id AS node_id, page_id AS location_id, url AS display_path,
  regexp_replace(url, '^https?://|[?#].*$', '', 'g') AS path_key, page_id * 3600000000000 AS modified_unix_ns, html FROM pages)"""


def bm25_sql(rows: str, text: str, q: str, per_source: int, name: str, where: str = "TRUE", shown: bool = False) -> str:
    """CTE of a source's ranked candidates, in SQL of its own."""
    n = len(q)
    snip = (
        f"substr({text}, greatest(strpos(lower({text}), '{q}') - 24, 1), strpos(lower({text}), '{q}') - greatest(strpos(lower({text}), '{q}') - 24, 1)) || '[' || "
        f"substr({text}, strpos(lower({text}), '{q}'), {n}) || ']' || substr({text}, strpos(lower({text}), '{q}') + {n}, 40)"
        if shown
        else "CAST(NULL AS VARCHAR)"
    )
    return f"""
{name}_stats AS (SELECT count(*) AS n, avg(CAST(greatest(length(lower({text})) - 2, 0) AS BIGINT)) AS mean, count(*) FILTER (contains(lower({text}), '{q}')) AS hits FROM {rows}),
{name}_scored AS (SELECT r.*, round(greatest(ln((n - hits + 0.5) / (hits + 0.5)), 1e-6)
  * (((length(lower({text})) - length(replace(lower({text}), '{q}', ''))) // {n}) * 2.2)
  / (((length(lower({text})) - length(replace(lower({text}), '{q}', ''))) // {n}) + 1.2 * (0.25 + 0.75 * greatest(length(lower({text})) - 2, 0) / mean)), 6) AS score, {snip} AS snippet
  FROM {rows} r, {name}_stats WHERE contains(lower({text}), '{q}') AND {where}),
{name} AS (SELECT *, row_number() OVER (ORDER BY score DESC, node_id, location_id) AS rank FROM {name}_scored QUALIFY rank <= {per_source})"""


def fuse_sql(branches: list[tuple[str, str]], q: str, limit: int) -> str:
    union = " UNION ALL ".join(f"SELECT scope_id, node_id, location_id, display_path, '{s}' AS source, rank, snippet FROM {n}" for n, s in branches)
    return f"""
hits AS ({union}),
fused AS (SELECT node_id, location_id, min(scope_id) AS scope_id, min(display_path) AS display_path, min(rank) FILTER (source = 'metadata') AS m, min(rank) FILTER (source = 'content') AS c,
  arg_min(snippet, rank) FILTER (source = 'content') AS snippet FROM hits GROUP BY ALL),
flagged AS (SELECT *, lower(regexp_extract(display_path, '[^/\\\\]*$')) = '{q}' AS exact FROM fused),
ranked AS (SELECT *, row_number() OVER (ORDER BY NOT exact, NOT (m IS NOT NULL AND c IS NOT NULL), coalesce(m, 2147483647), coalesce(c, 2147483647), node_id, location_id) AS lexical_rank FROM flagged)
SELECT CAST(scope_id AS BIGINT) AS scope_id, CAST(node_id AS BIGINT) AS node_id, display_path, snippet,
  concat_ws(',', CASE WHEN exact THEN 'filename' END, CASE WHEN m IS NOT NULL THEN 'path' END, CASE WHEN c IS NOT NULL THEN 'extracted_text' END) AS matched_fields,
  CASE WHEN exact AND c IS NOT NULL THEN 'exact_filename_and_extracted_text' WHEN exact THEN 'exact_filename' WHEN m IS NOT NULL AND c IS NOT NULL THEN 'path_and_extracted_text_substring'
    WHEN m IS NOT NULL THEN 'path_substring' ELSE 'extracted_text_substring' END AS explanation, CAST(lexical_rank AS BIGINT) AS lexical_rank
FROM ranked WHERE lexical_rank <= {limit}"""


def result_columns(df: DataFrame) -> DataFrame:
    return df.select("scope_id", "node_id", "display_path", "snippet", F.array_join("matched_fields", ",").alias("matched_fields"), "explanation", long("lexical_rank", "lexical_rank"))


# ---- search -------------------------------------------------------------------------------------------------------


@query("WITH docs AS (SELECT CAST(1 AS BIGINT) AS scope_id, doc_id AS node_id, doc_id AS location_id, source || '/' || CAST(doc_id AS VARCHAR) AS display_path, text FROM documents)," + bm25_sql("docs", "text", "ention", 40, "found", shown=True) + "," + fuse_sql([("found", "content")], "ention", 20))
def search_content(spark: SparkSession, d: str) -> DataFrame:
    chunks = document_chunks(spark, d)
    return result_columns(S.search(S.Request("  Ention ", source="content"), chunks, chunks))


@query("WITH" + PAGES_SQL + "," + bm25_sql("pages_", "display_path", "example.net", 40, "found") + "," + fuse_sql([("found", "metadata")], "example.net", 20))
def search_path(spark: SparkSession, d: str) -> DataFrame:
    pages = page_locations(spark, d)
    return result_columns(S.search(S.Request("example.net", source="metadata"), pages, page_chunks(spark, d)))


@query("WITH" + PAGES_SQL + "," + bm25_sql("pages_", "display_path", "ther", 60, "by_path") + "," + bm25_sql("pages_", "html", "ther", 60, "by_text", shown=True) + "," + fuse_sql([("by_path", "metadata"), ("by_text", "content")], "ther", 30))
def search_fused(spark: SparkSession, d: str) -> DataFrame:
    return result_columns(S.search(S.Request("Ther", limit=30), page_locations(spark, d), page_chunks(spark, d)))


FILTER_SQL = "scope_id = 2 AND regexp_extract(regexp_extract(display_path, '[^/\\\\]*$'), '\\.([A-Za-z0-9]+)$', 1) = 'html' AND modified_unix_ns >= 36000000000000 AND modified_unix_ns < 720000000000000"


def indexed(spark: SparkSession, name: str, states: list[tuple[DataFrame, DataFrame]]) -> Warehouse:
    """A search index in the shared folder that has followed these states (locations, chunks), a commit each."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='siltstone-')}"
    w = Warehouse(spark, f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    for state in states:
        with w.transaction() as t:
            search_index.refresh(t, search_index.documents(*state), search_index.IndexOptions(max_segments=2))
        w.forget(*search_index.TABLES)  # nobody reads the states before
    return w


def page_states(spark: SparkSession, d: str) -> list[tuple[DataFrame, DataFrame]]:
    """Three states of the pages: some missing, some named otherwise and with other text; all but some of other text; as they are."""
    pages, chunks = page_locations(spark, d), page_chunks(spark, d)
    earlier = lambda df, c, m: df.withColumn(c, F.when(F.col("node_id") % m == 1, F.concat(F.lit("the ther "), F.reverse(c))).otherwise(F.col(c)))
    first = [earlier(df.filter("node_id % 5 != 2"), c, 3) for df, c in ((pages, "display_path"), (chunks, "text"))]
    extra = pages.select("scope_id", (-1 - F.col("node_id")).alias("node_id"), (-1 - F.col("location_id")).alias("location_id"), "display_path", "path_key", "modified_unix_ns", "html")
    return [(first[0].unionByName(extra), first[1]), (pages, earlier(chunks, "text", 7)), (pages, chunks)]


@query("WITH" + PAGES_SQL + "," + bm25_sql("pages_", "display_path", "ther", 60, "by_path") + "," + bm25_sql("pages_", "html", "ther", 60, "by_text", shown=True) + "," + fuse_sql([("by_path", "metadata"), ("by_text", "content")], "ther", 30))
def search_index_fused(spark: SparkSession, d: str) -> DataFrame:
    """The same answer as ``search_fused``, from an index that has followed insertions, updates and deletions."""
    states = page_states(spark, d)
    w = indexed(spark, "search-fused", states)
    return result_columns(search_index.search(S.Request("Ther", limit=30), w.snapshot(), *states[-1]))


@query("WITH" + PAGES_SQL + "," + bm25_sql("pages_", "html", "the", 100, "found", where=FILTER_SQL, shown=True) + "," + fuse_sql([("found", "content")], "the", 50))
def search_index_filtered(spark: SparkSession, d: str) -> DataFrame:
    states = page_states(spark, d)
    w = indexed(spark, "search-filtered", states[1:])
    r = S.Request("the", scope_id=2, source="content", extension=".HTML", modified_since_s=36_000, modified_before_s=720_000, limit=50)
    return result_columns(search_index.search(r, w.snapshot(), *states[-1]))


@query(
    """WITH d AS (SELECT doc_id, lower(text) AS low FROM documents), t AS (SELECT doc_id, substr(low, CAST(i AS BIGINT), 3) AS t FROM (SELECT doc_id, low, unnest(range(1, length(low) - 1)) AS i FROM d))
SELECT CAST((ord(t) * 4398046511104) + (ord(substr(t, 2)) * 2097152) + ord(substr(t, 3)) AS BIGINT) AS trigram, count(DISTINCT doc_id) AS documents, count(*) AS positions FROM t GROUP BY ALL"""
)
def index_postings(spark: SparkSession, d: str) -> DataFrame:
    """What the index of all documents says of each trigram after texts have come, changed and gone."""
    docs, none = document_chunks(spark, d), page_locations(spark, d).limit(0)
    before = docs.filter("node_id % 4 != 3").withColumn("text", F.when(F.col("node_id") % 4 == 1, F.concat("text", F.lit(" xyzzy"))).otherwise(F.col("text")))
    w = indexed(spark, "postings", [(none, before.unionByName(docs.withColumn("chunk_id", -1 - F.col("chunk_id")))), (none, before), (none, docs)])
    at = w.snapshot()
    counted = at.read("search_postings").select(*search_index.KEY, "segment", "trigram", F.size("positions").alias("n"))  # the lists stay where they are
    kept = search_index.standing(at, counted)
    return kept.groupBy("trigram").agg(F.count("*").alias("documents"), F.sum("n").alias("positions"))


@query("WITH" + PAGES_SQL + "," + bm25_sql("pages_", "html", "the", 100, "found", where=FILTER_SQL, shown=True) + "," + fuse_sql([("found", "content")], "the", 50))
def search_filtered(spark: SparkSession, d: str) -> DataFrame:
    r = S.Request("the", scope_id=2, source="content", extension=".HTML", modified_since_s=36_000, modified_before_s=720_000, limit=50)
    return result_columns(S.search(r, page_locations(spark, d), page_chunks(spark, d)))


@query(
    "WITH" + PAGES_SQL + """,
gone AS (SELECT scope_id, regexp_extract(path_key, '^[^/]+/[^/]+') AS root FROM pages_ WHERE node_id % 10 = 0)
SELECT CAST(scope_id AS BIGINT) AS scope_id, CAST(node_id AS BIGINT) AS node_id, path_key FROM pages_ p
WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.scope_id = p.scope_id AND (p.path_key = g.root OR starts_with(p.path_key, g.root || '/')))"""
)
def search_exclusions(spark: SparkSession, d: str) -> DataFrame:
    pages = page_locations(spark, d)
    gone = pages.filter("node_id % 10 = 0").select("scope_id", F.lit("path").alias("kind"), F.regexp_extract("path_key", "^[^/]+/[^/]+", 0).alias("path_key"))
    return S.without_excluded(pages, gone).select("scope_id", "node_id", "path_key")


@query(
    "WITH" + PAGES_SQL + "," + bm25_sql("pages_", "display_path", "blog", 40, "found") + """,
ranked AS (SELECT node_id, display_path, CAST(rank AS BIGINT) AS lexical_rank, length(display_path) + length('path_substring') AS size FROM found WHERE rank <= 20),
summed AS (SELECT *, CAST(sum(size) OVER (ORDER BY lexical_rank) AS BIGINT) AS payload_bytes FROM ranked)
SELECT lexical_rank, CAST(node_id AS BIGINT) AS node_id, display_path, payload_bytes, (SELECT max(payload_bytes) FROM summed) > 900 AS truncated FROM summed WHERE payload_bytes <= 900"""
)
def agent_projection(spark: SparkSession, d: str) -> DataFrame:
    found = S.search(S.Request("blog", source="metadata"), page_locations(spark, d), page_chunks(spark, d))
    return S.agent_projection(found, payload_bytes=900).select(long("lexical_rank", "lexical_rank"), "node_id", "display_path", "payload_bytes", "truncated")


@query(
    """WITH q(query_id, query) AS (VALUES (1, 'nation'), (2, 'therhe'), (3, 'ouè'), (4, 'xyzzyx'))
SELECT CAST(query_id AS BIGINT) AS query_id, doc_id FROM q JOIN documents ON contains(lower(text), lower(query))"""
)
def search_many(spark: SparkSession, d: str) -> DataFrame:
    return S.search_few([(1, "nation"), (2, "therhe"), (3, "ouè"), (4, "xyzzyx")], table(spark, d, "documents"), "doc_id", "text")


@query(
    """WITH f AS (SELECT c_custkey AS node_id, c_name AS display_path FROM customer ORDER BY c_name, c_custkey LIMIT 201)
SELECT CAST(node_id AS BIGINT) AS node_id, display_path, CAST(row_number() OVER (ORDER BY display_path, node_id) AS BIGINT) AS position, (SELECT count(*) FROM f) > 200 AS truncated
FROM f QUALIFY position <= 200"""
)
def folder_list(spark: SparkSession, d: str) -> DataFrame:
    folders = table(spark, d, "customer").select(long("c_custkey", "node_id"), F.col("c_name").alias("display_path"))
    return S.folder_list(folders).select("node_id", "display_path", long("position", "position"), "truncated")


# ---- chunks, media, names -----------------------------------------------------------------------------------------


@query(
    """WITH a AS (SELECT doc_id, text, strlen(text) AS n FROM documents WHERE strlen(text) = length(text) AND strlen(text) > 0),
i AS (SELECT *, unnest(generate_series(0, CASE WHEN n <= 4096 THEN 0 ELSE CAST(ceil((n - 4096) / 3840.0) AS BIGINT) END)) AS i FROM a)
SELECT doc_id, CAST(i AS BIGINT) AS ordinal, CAST(i * 3840 AS BIGINT) AS byte_start, CAST(least(i * 3840 + 4096, n) AS BIGINT) AS byte_end, sha256(substr(text, i * 3840 + 1, 4096)) AS text_sha256 FROM i"""
)
def chunk_ascii(spark: SparkSession, d: str) -> DataFrame:
    return content.chunk_ascii(table(spark, d, "documents")).select("doc_id", "ordinal", "byte_start", "byte_end", X.sha256_hex(F.col("text")).alias("text_sha256"))


@query(
    """SELECT doc_id, CASE WHEN strlen(text) = 0 THEN 0 WHEN strlen(text) <= 4096 THEN 1 ELSE NULL END AS single_chunk, CAST(strlen(text) AS BIGINT) AS covered_bytes FROM documents"""
)
def chunk_coverage(spark: SparkSession, d: str) -> DataFrame:
    """All documents by the byte-window function: windows start at 0, leave no gap, and end with the text."""
    docs = table(spark, d, "documents")
    chunks = content.chunk_documents(docs).groupBy("doc_id").agg(F.count("ordinal").alias("n"), F.max("byte_end").alias("covered_bytes"))
    j = docs.select("doc_id").join(chunks, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("covered_bytes", F.lit(0)).cast("long").alias("covered_bytes"))
    return j.select("doc_id", F.when(F.col("n") <= 1, F.col("n").cast("int")).alias("single_chunk"), "covered_bytes")


def _back_sql(i: str) -> str:
    """The first byte of the character at offset ``i`` of the hexadecimal text h of n bytes; the end stays the end."""
    inside = lambda at: f"substr(h, CAST(2 * ({at}) + 1 AS BIGINT), 1) IN ('8', '9', 'A', 'B')"
    return f"CASE WHEN {i} >= n OR NOT {inside(i)} THEN {i} WHEN NOT {inside(f'{i} - 1')} THEN {i} - 1 WHEN NOT {inside(f'{i} - 2')} THEN {i} - 2 ELSE {i} - 3 END"


@query(
    f"""WITH RECURSIVE b AS (SELECT doc_id, hex(encode(text)) AS h, CAST(strlen(text) AS BIGINT) AS n FROM documents WHERE strlen(text) > 0),
w(doc_id, s, e) AS (SELECT doc_id, CAST(0 AS BIGINT), CASE WHEN n <= 4096 THEN n ELSE {_back_sql("4096")} END FROM b
  UNION ALL SELECT doc_id, s, CASE WHEN s + 4096 >= n THEN n ELSE {_back_sql("(s + 4096)")} END FROM (SELECT w.doc_id, h, n, CASE WHEN {_back_sql("(e - 256)")} > s THEN {_back_sql("(e - 256)")} ELSE e END AS s FROM w JOIN b ON b.doc_id = w.doc_id WHERE e < n))
SELECT doc_id, count(*) AS chunks, CAST(sum(e - s) AS BIGINT) AS output_bytes, max(e) AS source_bytes FROM w GROUP BY doc_id"""
)
def chunk_utf8_stats(spark: SparkSession, d: str) -> DataFrame:
    """Windows end and begin at whole characters; a text beyond the limits has none."""
    chunks = content.chunk_documents(table(spark, d, "documents"))
    return chunks.groupBy("doc_id").agg(F.count("ordinal").alias("chunks"), F.sum(F.octet_length("text")).cast("long").alias("output_bytes"), F.max("byte_end").alias("source_bytes"))


NAMES_SQL = "names AS (SELECT p_partkey, replace(p_name, ' ', '-') || CASE p_partkey % 7 WHEN 0 THEN '.md' WHEN 1 THEN '.RS' WHEN 2 THEN '.csv' WHEN 3 THEN '.PNG' WHEN 4 THEN '.docx' WHEN 5 THEN '.bin' ELSE '' END AS name FROM part)"


def part_names(spark: SparkSession, d: str) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(x) for x in (".md", ".RS", ".csv", ".PNG", ".docx", ".bin", "")]), (F.col("p_partkey") % 7 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), ext).alias("name"))


@query(
    "WITH " + NAMES_SQL + """ SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CASE lower(regexp_extract(name, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'md' THEN 'markdown' WHEN 'rs' THEN 'source_code' WHEN 'csv' THEN 'plain_text'
  WHEN 'png' THEN 'image' WHEN 'docx' THEN 'office' END AS media, lower(regexp_extract(name, '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM names"""
)
def media_routing(spark: SparkSession, d: str) -> DataFrame:
    return part_names(spark, d).select(long("p_partkey", "p_partkey"), P.media_kind(F.col("name")).alias("media"), P.extension(F.col("name")).alias("ext"))


@query(
    "WITH " + NAMES_SQL + """ SELECT CASE lower(regexp_extract(name, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'md' THEN 'document' WHEN 'docx' THEN 'document' WHEN 'rs' THEN 'code' WHEN 'csv' THEN 'data' WHEN 'png' THEN 'image'
  ELSE 'other' END AS category, count(*) AS files FROM names GROUP BY 1"""
)
def category_histogram(spark: SparkSession, d: str) -> DataFrame:
    return part_names(spark, d).groupBy(P.category(F.col("name")).alias("category")).agg(F.count("*").alias("files"))


@query(
    """WITH n AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN p_name || '.' WHEN 2 THEN 'CON.' || p_name WHEN 3 THEN p_name || '?' WHEN 4 THEN upper(p_name) ELSE p_name || ' ' END AS name, p_name FROM part)
SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_partkey % 6 IN (0, 4) AS portable, p_partkey % 6 = 4 AS case_only FROM n"""
)
def portable_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    name = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat("p_name", F.lit("."))).when(k == 2, F.concat(F.lit("CON."), "p_name")).when(k == 3, F.concat("p_name", F.lit("?"))).when(k == 4, F.upper("p_name")).otherwise(F.concat("p_name", F.lit(" ")))
    return table(spark, d, "part").withColumn("name", name).select(long("p_partkey", "p_partkey"), P.portable_name(F.col("name")).alias("portable"), P.case_only_rename(F.col("p_name"), F.col("name")).alias("case_only"))


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, chr(CAST(65 + l_partkey % 26 AS INTEGER)) || chr(CAST(65 + l_suppkey % 26 AS INTEGER)) || chr(CAST(65 + l_orderkey % 26 AS INTEGER)) || CAST(l_orderkey * 97 AS VARCHAR) AS ref FROM lineitem)
SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, ref, regexp_matches(ref, '^[A-Z]{3}[1-9][0-9]{0,6}$') AND substr(ref, 1, 3) <= 'XFD' AND TRY_CAST(substr(ref, 4) AS BIGINT) <= 1048576 AS valid FROM r"""
)
def cell_refs(spark: SparkSession, d: str) -> DataFrame:
    letter = lambda c: F.char(F.lit(65) + F.col(c) % 26)
    ref = F.concat(letter("l_partkey"), letter("l_suppkey"), letter("l_orderkey"), (F.col("l_orderkey") * 97).cast("string"))
    return table(spark, d, "lineitem").select(long("l_orderkey", "l_orderkey"), ref.alias("ref")).withColumn("valid", P.cell_reference_valid(F.col("ref")))


# ---- graph --------------------------------------------------------------------------------------------------------


@query("WITH RECURSIVE" + TREE_SQL + ", sub(node_id) AS (SELECT CAST(1 AS BIGINT) UNION SELECT child FROM edges JOIN sub ON parent = node_id) SELECT CAST(node_id AS BIGINT) AS node_id FROM sub")
def subtree_members(spark: SparkSession, d: str) -> DataFrame:
    return graph.descendants(tree(spark, d)[0], spark.createDataFrame([(1,)], "node_id long")).select("node_id")


@query(
    """WITH RECURSIVE edges AS (SELECT n_nationkey AS child, n_regionkey AS parent FROM (SELECT n_nationkey + 100 AS n_nationkey, n_regionkey FROM nation UNION ALL SELECT n_regionkey, n_nationkey + 100 FROM nation WHERE n_nationkey % 5 = 0)),
sub(node_id) AS (SELECT 0 UNION SELECT child FROM edges JOIN sub ON parent = node_id) SELECT CAST(node_id AS BIGINT) AS node_id FROM sub"""
)
def subtree_cycle(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    edge = lambda df, a, b: df.select(long(a, "source_node_id"), long(b, "target_node_id"), F.lit("located_in").alias("kind"), F.lit(True).alias("active"))
    edges = edge(n, F.col("n_nationkey") + 100, F.col("n_regionkey")).unionByName(edge(n.filter("n_nationkey % 5 = 0"), F.col("n_regionkey"), F.col("n_nationkey") + 100))
    return graph.descendants(edges, spark.createDataFrame([(0,)], "node_id long")).select("node_id")


@query(
    "WITH RECURSIVE" + TREE_SQL + """, moved AS (SELECT child, CASE WHEN child < 1000000000 AND child >= 1000 AND child % 50 = 3 THEN (parent - 99) % 25 + 100 ELSE parent END AS parent FROM edges WHERE NOT (child >= 1000 AND child % 97 = 5)
  UNION ALL SELECT n_regionkey, n_nationkey + 100 FROM nation WHERE n_nationkey % 12 = 0),
c(a, n) AS (SELECT parent, child FROM moved UNION SELECT a, child FROM c JOIN moved ON parent = n)
SELECT CAST(a AS BIGINT) AS ancestor_node_id, count(*) AS descendants, CAST(min(n) AS BIGINT) AS first_node_id, CAST(max(n) AS BIGINT) AS last_node_id FROM c GROUP BY a"""
)
def subtree_changes(spark: SparkSession, d: str) -> DataFrame:
    """The closure of the tree, kept while some customers move to another nation, some folders and files go, and regions are linked
    into nations, which closes cycles."""
    before = tree(spark, d)[0]
    child, parent = F.col("source_node_id"), F.col("target_node_id")
    customer = (child >= 1000) & (child < 1_000_000_000) & (child % 50 == 3)
    after = before.filter(~((child >= 1000) & (child % 97 == 5))).withColumn("target_node_id", F.when(customer, (parent - 99) % 25 + 100).otherwise(parent))
    n = table(spark, d, "nation").filter("n_nationkey % 12 = 0")
    after = after.unionByName(n.select(long("n_regionkey", "source_node_id"), long(F.col("n_nationkey") + 100, "target_node_id"), F.lit("located_in").alias("kind"), F.lit(True).alias("active"), F.lit(1).cast("long").alias("scope_id")))
    first = closure.added(spark.createDataFrame([], schemas.SCHEMAS["edge_closure"]), closure.links(before))
    kept = closure.moved(first, before, after)
    return kept.groupBy("ancestor_node_id").agg(F.count("*").alias("descendants"), F.min("node_id").alias("first_node_id"), F.max("node_id").alias("last_node_id"))


@query(
    "WITH RECURSIVE" + TREE_SQL + """, sub(node_id) AS (SELECT CAST(103 AS BIGINT) UNION SELECT child FROM edges JOIN sub ON parent = node_id), below AS (SELECT node_id FROM sub WHERE node_id <> 103),
f AS (SELECT * FROM orders JOIN below ON node_id = o_orderkey + 1000000000)
SELECT CAST(103 AS BIGINT) AS folder_node_id, CAST(0 AS BIGINT) AS direct_files, (SELECT count(*) FROM customer WHERE c_nationkey = 3) AS direct_folders, (SELECT count(*) FROM f) AS descendant_files,
  (SELECT count(*) FROM below) - (SELECT count(*) FROM f) AS descendant_folders, (SELECT CAST(coalesce(sum(CAST(round(o_totalprice * 100) AS BIGINT)), 0) AS BIGINT) FROM f) AS total_bytes,
  (SELECT max(epoch_us(o_orderdate)) * 1000 FROM f) AS latest_modified_unix_ns, (SELECT count(*) FROM f WHERE o_orderstatus = 'O') AS document_files, (SELECT count(*) FROM f WHERE o_orderstatus = 'F') AS code_files,
  (SELECT count(*) FROM f WHERE o_orderstatus NOT IN ('O', 'F')) AS data_files"""
)
def folder_profile(spark: SparkSession, d: str) -> DataFrame:
    edges, nodes = tree(spark, d)
    p = graph.folder_profile(edges, nodes, 103)
    return p.select("folder_node_id", "direct_files", "direct_folders", "descendant_files", "descendant_folders", "total_bytes", "latest_modified_unix_ns", "document_files", "code_files", "data_files")


@query(
    """WITH s AS (SELECT DISTINCT p_size AS folder, CAST(substr(p_brand, 7) AS INTEGER) % 9 AS k FROM part), w AS (SELECT folder, CASE k WHEN 0 THEN 8500 WHEN 1 THEN 7500 WHEN 2 THEN 8000 WHEN 3 THEN 8500 WHEN 4 THEN 8500 WHEN 5 THEN 9000 WHEN 6 THEN 8500 END AS weight FROM s)
SELECT CAST(folder AS BIGINT) AS folder_node_id, CAST(least(max(weight) + 500 * (count(weight) - 1), 9500) AS INTEGER) AS confidence_basis_points, count(weight) AS strong_signals FROM w GROUP BY folder HAVING count(weight) > 0"""
)
def project_confidence(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("Cargo.toml", "package.json", "pyproject.toml", "go.mod", "Package.swift", "app.xcodeproj", "app.sln", "README.md", "notes.txt")])
    children = table(spark, d, "part").select(long("p_size", "folder_node_id"), F.element_at(names, (F.substring("p_brand", 7, 4).cast("int") % 9 + 1)).alias("name"))
    return graph.project_confidence(graph.markers(children))


@query(
    """WITH f AS (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 101) SELECT CAST(c_custkey AS BIGINT) AS node_id, (SELECT count(*) FROM f) <= 100 AS evaluation_complete FROM f ORDER BY c_custkey LIMIT 100"""
)
def project_discovery(spark: SparkSession, d: str) -> DataFrame:
    return graph.project_roots(table(spark, d, "customer").select(long("c_custkey", "node_id")))


ROOTS_SQL = "roots AS (SELECT page_id AS root_id, CASE WHEN page_id % 5 = 0 THEN regexp_extract(url, '^https?://([^/]+/[^/]+)', 1) ELSE regexp_extract(url, '^https?://([^/]+/[^/]+/[^/?#]+)', 1) END AS path_key FROM pages)"


def page_roots(spark: SparkSession, d: str) -> DataFrame:
    path = F.when(F.col("page_id") % 5 == 0, F.regexp_extract("url", "^https?://([^/]+/[^/]+)", 1)).otherwise(F.regexp_extract("url", "^https?://([^/]+/[^/]+/[^/?#]+)", 1))
    return table(spark, d, "pages").select(long("page_id", "root_id"), path.alias("path_key"))


UNDER_SQL = "(starts_with(b.path_key, a.path_key || '/') OR (a.path_key = b.path_key AND a.root_id < b.root_id))"


@query("WITH " + ROOTS_SQL + " SELECT CAST(a.root_id AS BIGINT) AS ancestor_id, CAST(b.root_id AS BIGINT) AS descendant_id FROM roots a JOIN roots b ON " + UNDER_SQL)
def root_overlap(spark: SparkSession, d: str) -> DataFrame:
    return graph.root_overlaps(page_roots(spark, d))


@query("WITH " + ROOTS_SQL + " SELECT CAST(b.root_id AS BIGINT) AS root_id, path_key FROM roots b WHERE NOT EXISTS (SELECT 1 FROM roots a WHERE " + UNDER_SQL + ")")
def minimal_roots(spark: SparkSession, d: str) -> DataFrame:
    return graph.minimal_roots(page_roots(spark, d))


@query(
    "WITH" + PAGES_SQL + """, r AS (SELECT DISTINCT regexp_extract(path_key, '^[^/]+') AS root FROM pages_ WHERE node_id % 4 = 0), x AS (SELECT DISTINCT regexp_extract(path_key, '^[^/]+/[^/]+') AS root FROM pages_ WHERE node_id % 7 = 0)
SELECT CAST(node_id AS BIGINT) AS path_id, path_key FROM pages_ WHERE EXISTS (SELECT 1 FROM r WHERE path_key = root OR starts_with(path_key, root || '/')) AND NOT EXISTS (SELECT 1 FROM x WHERE path_key = root OR starts_with(path_key, root || '/'))"""
)
def coverage(spark: SparkSession, d: str) -> DataFrame:
    p = page_locations(spark, d).select(F.col("node_id").alias("path_id"), "path_key")
    roots = p.filter("path_id % 4 = 0").select(F.regexp_extract("path_key", "^[^/]+", 0).alias("path_key"))
    gone = p.filter("path_id % 7 = 0").select(F.regexp_extract("path_key", "^[^/]+/[^/]+", 0).alias("path_key"))
    return graph.coverage(p, roots, gone)


# ---- relations ----------------------------------------------------------------------------------------------------


@query(
    """WITH g AS (SELECT text, min(doc_id) AS l, count(*) AS members FROM documents WHERE strlen(text) > 0 GROUP BY text HAVING count(*) > 1)
SELECT CAST(1 AS BIGINT) AS scope_id, l AS left_node_id, doc_id AS right_node_id, CAST(strlen(d.text) AS BIGINT) AS size_bytes, members, 10000 AS confidence_basis_points FROM documents d JOIN g USING (text) WHERE doc_id <> l"""
)
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.lit(1).cast("long").alias("scope_id"), long("doc_id", "node_id"), F.col("text").alias("content"))
    return relations.exact_duplicates(docs)


@query(
    """WITH d AS (SELECT doc_id, text, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size_bytes, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT *, count(*) OVER (PARTITION BY size_bytes) AS same_size, count(*) OVER (PARTITION BY size_bytes, substr(h, 1, 8192), right(h, 8192)) AS same_ends, count(*) OVER (PARTITION BY h) AS same, min(doc_id) OVER (PARTITION BY h) AS least FROM d)
SELECT doc_id AS node_id, size_bytes, CASE WHEN size_bytes = 0 THEN NULL WHEN same_size = 1 THEN 'size' WHEN same_ends = 1 THEN 'ends' WHEN same = 1 THEN 'content' ELSE 'duplicate' END AS stage,
  CASE WHEN size_bytes > 0 AND same > 1 THEN least END AS left_node_id, CASE WHEN size_bytes > 0 AND same > 1 THEN same END AS members, CASE WHEN size_bytes = 0 THEN 'file_relation_source_empty' END AS issue FROM c"""
)
def duplicate_stages(spark: SparkSession, d: str) -> DataFrame:
    """Where each document leaves the comparison of bytes in stages, or whose copy it is."""
    docs = table(spark, d, "documents").select(F.lit(1).cast("long").alias("scope_id"), long("doc_id", "node_id"), F.octet_length("text").alias("size_bytes"), F.col("text").alias("content"))
    return equality.verdicts(docs, equality.by_content()).drop("scope_id")


@query(
    """WITH n AS (SELECT s_suppkey, s_nationkey % 3 AS scope_id, 'report-' || CAST(s_nationkey AS VARCHAR) AS base, CAST(s_suppkey * 7 % 23 AS INTEGER) AS v FROM supplier WHERE s_suppkey * 7 % 23 > 0),
s AS (SELECT scope_id, base, v, min(s_suppkey) AS node FROM n GROUP BY ALL),
c AS (SELECT scope_id, base, node AS older, v AS older_v, lead(node) OVER w AS newer, lead(v) OVER w AS newer_v FROM s WINDOW w AS (PARTITION BY scope_id, base ORDER BY v)),
l AS (SELECT c.scope_id, c.base, older, n.s_suppkey AS newer, older_v, newer_v FROM c JOIN n ON n.scope_id = c.scope_id AND n.base = c.base AND n.v = newer_v
  UNION SELECT c.scope_id, c.base, n.s_suppkey, newer, older_v, newer_v FROM c JOIN n ON n.scope_id = c.scope_id AND n.base = c.base AND n.v = older_v WHERE newer IS NOT NULL)
SELECT CAST(scope_id AS BIGINT) AS scope_id, base, 'md' AS ext, CAST(older AS BIGINT) AS older_node_id, CAST(newer AS BIGINT) AS newer_node_id, older_v AS older_version, newer_v AS newer_version, 9000 AS confidence_basis_points FROM l"""
)
def version_pairs(spark: SparkSession, d: str) -> DataFrame:
    return relations.version_pairs(version_files(spark, d))


def version_files(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("s_suppkey") * 7 % 23
    name = F.concat(F.lit("Report-"), F.col("s_nationkey").cast("string"), F.when(F.col("s_suppkey") % 2 == 0, "-v").otherwise("_V"), v.cast("string"), F.lit(".MD"))
    return table(spark, d, "supplier").select(long(F.col("s_nationkey") % 3, "scope_id"), long("s_suppkey", "node_id"), name.alias("file_name"))


@query(
    """WITH n AS (SELECT s_suppkey, s_nationkey % 3 AS scope_id, 'report-' || CAST(s_nationkey AS VARCHAR) AS base, CAST(s_suppkey * 7 % 23 AS INTEGER) AS v FROM supplier WHERE s_suppkey * 7 % 23 > 0)
SELECT CAST(scope_id AS BIGINT) AS scope_id, base, 'md' AS ext, v AS version, CAST(min(s_suppkey) OVER (PARTITION BY scope_id, base, v) AS BIGINT) AS class_node_id, CAST(s_suppkey AS BIGINT) AS node_id FROM n"""
)
def version_members(spark: SparkSession, d: str) -> DataFrame:
    return relations.version_members(version_files(spark, d))


@query(
    """SELECT doc_id AS node_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size_bytes, CASE WHEN strlen(coalesce(text, '')) = 0 THEN 'file_relation_source_empty' WHEN strlen(text) > 8192 THEN 'file_relation_source_too_large' END AS code FROM documents"""
)
def duplicate_codes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(long("doc_id", "node_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size_bytes"))
    return docs.withColumn("code", relations.source_code(F.col("size_bytes"), 8192))


@query(
    """SELECT doc_id, strlen(text) > 4096 AS failed, CASE WHEN strlen(text) > 4096 THEN 'extraction_output_limit_exceeded' END AS error_code FROM documents WHERE strlen(text) > 0"""
)
def chunk_failures(spark: SparkSession, d: str) -> DataFrame:
    """Texts beyond the limits give a row that says so, and no chunk; the bound on output is lowered so that some are."""
    chunks = content.chunk_documents(table(spark, d, "documents"), limits=content.Limits(chunk_bytes=1024, overlap_bytes=0, output_bytes=4096))
    return chunks.groupBy("doc_id").agg(F.max("error_code").alias("error_code")).select("doc_id", F.col("error_code").isNotNull().alias("failed"), "error_code")


@query(
    """WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS t FROM events),
nxt AS (SELECT e.user_id, e.event_type, e.t, min(n.t) AS nt FROM e JOIN e n ON e.user_id = n.user_id AND e.event_type = n.event_type AND n.t > e.t + 43200000 GROUP BY ALL),
st(user_id, event_type, t) AS (SELECT user_id, event_type, min(t) FROM e GROUP BY ALL UNION ALL SELECT n.user_id, n.event_type, n.nt FROM st JOIN nxt n ON n.user_id = st.user_id AND n.event_type = st.event_type AND n.t = st.t),
dealt AS (SELECT e.user_id, e.event_type, e.event_id, max(st.t) AS group_start FROM e JOIN st ON e.user_id = st.user_id AND e.event_type = st.event_type AND st.t <= e.t GROUP BY ALL)
SELECT CAST(user_id AS BIGINT) AS user_id, event_type, CAST(group_start AS BIGINT) AS group_start, count(*) OVER (PARTITION BY user_id, event_type, group_start) AS group_size, CAST(event_id AS BIGINT) AS node_id FROM dealt QUALIFY group_size > 1"""
)
def review_groups(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", long("event_id", "node_id"), event_ms().alias("modified_unix_ns"))
    g = relations.review_groups(e, ["user_id", "event_type"], window=43_200_000, max_members=10**9, max_images=None, max_groups=None)
    return g.select("user_id", "event_type", "group_start", "group_size", "node_id")


def decisions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").filter(F.col("event_type").isin("purchase", "error"))
    return e.select(long("user_id", "entity_id"), long("event_id", "sequence"), F.when(F.col("event_type") == "purchase", "accepted").otherwise("rejected").alias("decision"), event_ms().alias("created_at_unix_ms"))


@query(
    """WITH d AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'accepted' ELSE 'rejected' END AS decision, epoch_us(ts) // 1000 AS t FROM events WHERE event_type IN ('purchase', 'error')),
l AS (SELECT *, lag(decision) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM d),
a AS (SELECT user_id, arg_max(decision, event_id) AS state, arg_max(t, event_id) AS decided, count(*) FILTER (before IS NULL OR before <> decision) AS changes FROM l GROUP BY user_id)
SELECT CAST(user_id AS BIGINT) AS entity_id, coalesce(state, 'suggested') AS state, decided AS decided_at_unix_ms, coalesce(changes, 0) AS changes FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN a USING (user_id)"""
)
def feedback_state(spark: SparkSession, d: str) -> DataFrame:
    return relations.feedback_state(table(spark, d, "events").select(long("user_id", "entity_id")), decisions(spark, d))


@query(
    """WITH s AS (SELECT CASE event_id % 3 WHEN 0 THEN 'exact_duplicate' WHEN 1 THEN 'version' ELSE 'screenshot_group' END AS kind, event_id AS source_id, epoch_us(ts) // 1000 AS seen FROM events WHERE event_type <> 'error')
SELECT kind, CAST(source_id AS BIGINT) AS source_id, seen AS observed_at_unix_ms, CAST(row_number() OVER (ORDER BY CASE kind WHEN 'exact_duplicate' THEN 0 WHEN 'version' THEN 1 ELSE 2 END, seen DESC, source_id) AS BIGINT) AS position FROM s QUALIFY position <= 20"""
)
def inbox_order(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(k) for k in relations.INBOX_KINDS]), (F.col("event_id") % 3 + 1).cast("int"))
    state = F.when(F.col("event_type") == "error", "rejected").otherwise("suggested")
    s = table(spark, d, "events").select(kind.alias("kind"), long("event_id", "source_id"), event_ms().alias("observed_at_unix_ms"), state.alias("state"))
    return relations.inbox(s).withColumn("position", F.col("position").cast("long"))


# ---- journals -----------------------------------------------------------------------------------------------------

#: A plan's kinds by position, mostly legal; one event in 97 is swapped for one that may not be.
PATH = ("preview_created", "execute_requested", "execute_request_not_started", "execute_requested", "direct_rename_intent", "execution_completed", "undo_requested", "undo_request_not_started", "undo_requested", "undo_rename_intent", "undo_not_applied")
LOOP = ("undo_requested", "undo_rename_intent", "undo_not_applied")
KIND_SQL = (
    "CASE WHEN event_id % 97 = 5 THEN 'execution_completed' WHEN seq <= 11 THEN [" + ", ".join(f"'{k}'" for k in PATH) + "][seq] ELSE [" + ", ".join(f"'{k}'" for k in LOOP) + "][(seq - 12) % 3 + 1] END"
)
JOURNAL_SQL = f"""j AS (SELECT plan_id, CASE WHEN plan_id % 11 = 3 AND seq > 9 THEN seq + 1 ELSE seq END AS sequence, {KIND_SQL} AS kind
  FROM (SELECT user_id AS plan_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events))"""


def journal_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(long("user_id", "plan_id"), "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("seq"))
    at = lambda names, i: F.element_at(F.array(*[F.lit(k) for k in names]), i.cast("int"))
    kind = F.when(F.col("event_id") % 97 == 5, "execution_completed").when(F.col("seq") <= 11, at(PATH, F.least("seq", F.lit(11)))).otherwise(at(LOOP, F.pmod(F.col("seq") - 12, F.lit(3)) + 1))
    shifted = F.when((F.col("plan_id") % 11 == 3) & (F.col("seq") > 9), F.col("seq") + 1).otherwise(F.col("seq"))
    return e.select("plan_id", shifted.cast("long").alias("sequence"), kind.alias("event_kind"))


MACHINE_SQL = "machine(s, k, t) AS (VALUES " + ", ".join(f"('{a}', '{k}', '{b}')" for a, k, b in journal.TRANSITIONS) + ")"


@query(
    f"""WITH RECURSIVE {JOURNAL_SQL}, {MACHINE_SQL},
n AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY sequence) AS pos, count(*) OVER (PARTITION BY plan_id) AS events FROM j),
run AS (
  SELECT plan_id, CAST(0 AS BIGINT) AS pos, 'start' AS state, CAST(NULL AS VARCHAR) AS error FROM (SELECT DISTINCT plan_id FROM n)
  UNION ALL
  SELECT r.plan_id, n.pos, coalesce(m.t, r.state), CASE WHEN n.sequence <> n.pos THEN 'NonMonotonicSequence' WHEN m.t IS NULL AND n.pos = 1 THEN 'InvalidInitialEvent' WHEN m.t IS NULL THEN 'InvalidTransition' END
  FROM run r JOIN n ON n.plan_id = r.plan_id AND n.pos = r.pos + 1 LEFT JOIN machine m ON m.s = r.state AND m.k = n.kind WHERE r.error IS NULL)
SELECT CAST(plan_id AS BIGINT) AS plan_id, CASE WHEN error IS NULL THEN state END AS state, error, (SELECT count(*) FROM j WHERE j.plan_id = r.plan_id) AS events FROM run r QUALIFY row_number() OVER (PARTITION BY plan_id ORDER BY pos DESC) = 1"""
)
def journal_reduce(spark: SparkSession, d: str) -> DataFrame:
    return journal.reduce_journal(journal_events(spark, d))


@query(SQL["journal_reduce"].replace("SELECT CAST(plan_id AS BIGINT) AS plan_id, CASE", "SELECT CAST(plan_id AS BIGINT) AS plan_id, (SELECT max(sequence) FROM j WHERE j.plan_id = r.plan_id) AS last_sequence, CASE"))
def journal_advance(spark: SparkSession, d: str) -> DataFrame:
    """The journal in three batches, each composed onto the kept states: a plan's first nine events, most of the rest, and what came late and out of order."""
    events = journal_events(spark, d)
    batch = F.when(F.col("sequence") <= 9, 0).when((F.col("plan_id") % 4 == 0) & (F.col("sequence") % 5 == 0), 2).otherwise(1)
    root = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='siltstone-')}"
    w = Warehouse(spark, f"{root.rstrip('/')}/journal-{uuid.uuid4().hex}")
    dealt = events.withColumn("batch", batch)
    for n in range(3):
        sinks.record(w, dealt.filter(F.col("batch") == n).drop("batch"))
    return w.read("action_plan_states")


@query(
    f"""WITH {JOURNAL_SQL}, {MACHINE_SQL}, l AS (SELECT *, lag(kind) OVER (PARTITION BY plan_id ORDER BY sequence) AS previous_kind FROM j)
SELECT CAST(plan_id AS BIGINT) AS plan_id, CAST(sequence AS BIGINT) AS sequence, previous_kind, kind AS event_kind FROM l
WHERE CASE WHEN previous_kind IS NULL THEN kind <> 'preview_created' ELSE NOT EXISTS (SELECT 1 FROM machine a JOIN machine b ON a.t = b.s WHERE a.k = previous_kind AND b.k = kind) END"""
)
def journal_violations(spark: SparkSession, d: str) -> DataFrame:
    return journal.violations(journal_events(spark, d))


@query(
    """SELECT count(*) AS inspected, count(*) FILTER (b = a) AS deferred, count(*) FILTER (a IN ('executed', 'undone') AND a <> b) AS completed, count(*) FILTER (a = 'previewed' AND a <> b) AS not_applied, count(*) FILTER (a = 'needs_attention' AND a <> b) AS needs_attention
FROM (SELECT CASE o_custkey % 2 WHEN 0 THEN 'direct_rename_intent' ELSE 'undo_rename_intent' END AS b, ['executed', 'undone', 'previewed', 'needs_attention', 'direct_rename_intent', 'undo_rename_intent'][o_orderkey % 6 + 1] AS a FROM orders ORDER BY o_orderkey LIMIT 100)"""
)
def recovery_report(spark: SparkSession, d: str) -> DataFrame:
    after = F.element_at(F.array(*[F.lit(x) for x in ("executed", "undone", "previewed", "needs_attention", "direct_rename_intent", "undo_rename_intent")]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("plan_id"), F.when(F.col("o_custkey") % 2 == 0, "direct_rename_intent").otherwise("undo_rename_intent").alias("before"), after.alias("after"))
    return journal.recovery_report(o)


# ---- manifest -----------------------------------------------------------------------------------------------------


@query(
    """WITH s AS (SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(c_nationkey AS BIGINT) END AS v FROM customer WHERE c_custkey % 3 <> 0),
c AS (SELECT c_custkey AS k, c_name AS name, CAST(c_nationkey AS BIGINT) AS v, c_custkey % 4 <> 0 AS present FROM customer WHERE c_custkey % 2 = 0)
SELECT CAST(k AS BIGINT) AS path_id, CASE WHEN s.k IS NOT NULL THEN s.name ELSE c.name END AS name, CASE WHEN s.k IS NOT NULL THEN s.v ELSE c.v END AS value, s.k IS NOT NULL AS present,
  CASE WHEN s.k IS NOT NULL AND c.k IS NULL THEN 'insert' WHEN s.k IS NOT NULL AND s.v = c.v AND c.present THEN 'unchanged' WHEN s.k IS NOT NULL THEN 'update' WHEN c.present THEN 'tombstone' ELSE 'absent' END AS action
FROM s FULL JOIN c USING (k)"""
)
def publish_tombstone(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(long("c_custkey", "path_id"), F.col("c_name").alias("name"), long("c_nationkey", "value"))
    staged = c.filter("path_id % 3 <> 0").withColumn("value", F.when(F.col("path_id") % 5 == 0, F.lit(0).cast("long")).otherwise(F.col("value")))
    current = c.filter("path_id % 2 = 0").withColumn("present", F.col("path_id") % 4 != 0)
    return manifest.publish(staged, current, ["path_id"], ["name", "value"])


@query(
    """SELECT (SELECT count(*) FROM region) AS scopes, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) AS nodes, (SELECT count(*) FROM orders) AS files,
  (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) AS folders, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS active_locations,
  (SELECT count(*) FROM events WHERE event_type = 'error') AS issues, (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 0) AS completed_scans, (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 0) > 0 AS ready"""
)
def manifest_stats(spark: SparkSession, d: str) -> DataFrame:
    locations = table(spark, d, "orders").select((F.col("o_orderstatus") != "P").alias("present"))
    scans = table(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, "completed").otherwise("failed").alias("status"))
    return manifest.manifest_stats(table(spark, d, "region"), tree(spark, d)[1], locations, table(spark, d, "events").filter("event_type = 'error'"), scans)


@query(
    """SELECT count(*) FILTER (l_returnflag <> 'R') AS active_chunks, count(DISTINCT l_partkey) FILTER (l_returnflag <> 'R') AS extracted_files, (SELECT count(*) FROM orders WHERE o_orderkey % 4 = 0) AS completed_jobs,
  (SELECT count(*) FROM orders WHERE o_orderkey % 4 = 1) AS failed_jobs, (SELECT count(*) FROM orders WHERE o_orderkey % 4 = 2) AS cancelled_jobs, (SELECT count(*) FROM orders WHERE o_orderkey % 4 = 3) AS interrupted_jobs FROM lineitem"""
)
def extraction_stats(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "lineitem").select(F.col("l_partkey").alias("node_id"), (F.col("l_returnflag") != "R").alias("active"))
    status = F.element_at(F.array(*[F.lit(x) for x in ("completed", "failed", "cancelled", "interrupted")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return manifest.extraction_stats(chunks, table(spark, d, "orders").select(status.alias("status")))


@query(
    """SELECT CAST(l_suppkey AS BIGINT) AS scan_id, count(*) FILTER (l_linestatus <> 'F') AS queued, count(*) FILTER (l_linestatus = 'F') AS processed, count(*) FILTER (l_returnflag = 'A') AS files, count(*) FILTER (l_returnflag = 'N') AS folders,
  count(*) FILTER (l_linenumber = 7) AS skipped, count(*) FILTER (l_linenumber >= 6) AS issues FROM lineitem GROUP BY l_suppkey"""
)
def scan_counters(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "file").when(F.col("l_returnflag") == "N", "folder").otherwise("other")
    issue = manifest.first_issue((F.col("l_linenumber") == 7, "temporary_download_excluded"), (F.col("l_linenumber") == 6, "hidden_entry_excluded"))
    e = table(spark, d, "lineitem").select(long("l_suppkey", "scan_id"), F.when(F.col("l_linestatus") == "F", "done").otherwise("pending").alias("state"), kind.alias("kind"), (F.col("l_linenumber") == 7).alias("skipped"), issue.alias("issue_code"))
    return manifest.scan_counters(e)


@query("SELECT CAST(o_orderkey AS BIGINT) AS node_id, CAST(c_nationkey AS BIGINT) AS scope_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def active_grants(spark: SparkSession, d: str) -> DataFrame:
    grants = table(spark, d, "nation").select(long("n_nationkey", "scope_id"), F.when(F.col("n_regionkey") == 2, "active").otherwise("revoked").alias("state"))
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(long("o_orderkey", "node_id"), long("c_nationkey", "scope_id"))
    return manifest.with_active_grant(rows, grants).select("node_id", "scope_id")


@query(
    """WITH d AS (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_linenumber = 7)
SELECT CAST(l_orderkey AS BIGINT) AS id, CAST(l_suppkey AS BIGINT) AS node_id, l_linenumber = 7 OR (l_returnflag <> 'R' AND l_suppkey NOT IN (SELECT l_suppkey FROM d)) AS active FROM lineitem"""
)
def replace_output(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(long("l_orderkey", "id"), long("l_suppkey", "node_id"), (F.col("l_returnflag") != "R").alias("active"), "l_linenumber")
    return manifest.replace_output(rows.filter("l_linenumber <> 7").drop("l_linenumber"), rows.filter("l_linenumber = 7").drop("l_linenumber"), ["node_id"]).select("id", "node_id", "active")


# ---- evaluation ---------------------------------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n, quantile_disc(CAST(round(value * 1000) AS BIGINT), 0.5) AS p50, quantile_disc(CAST(round(value * 1000) AS BIGINT), 0.95) AS p95, max(CAST(round(value * 1000) AS BIGINT)) AS max FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", long(F.round(F.col("value") * 1000), "elapsed_us"))
    return evaluation.latency_report(e, "elapsed_us", "event_type")


@query("SELECT json_extract_string(props, '$.k') AS error_code, count(*) AS failures FROM events WHERE event_type = 'error' GROUP BY 1")
def failure_histogram(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").filter("event_type = 'error'").select(F.get_json_object("props", "$.k").alias("error_code"))
    return evaluation.failure_histogram(e)


EVAL_SQL = """c AS (SELECT p_partkey, p_name AS ref, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE lead(p_name, 1, '') OVER (ORDER BY p_partkey) END AS hyp, p_type, p_size FROM part),
t AS (SELECT *, list_filter(string_split(ref, ' '), lambda x: x <> '') AS rt, list_filter(string_split(hyp, ' '), lambda x: x <> '') AS ht FROM c),
k AS (SELECT *, list_distinct(list_concat(rt, ht)) AS known FROM t),
s AS (SELECT p_type, p_size, length(ref) AS chars, levenshtein(ref, hyp) AS ce, len(rt) AS tokens,
  levenshtein(list_aggregate(list_transform(rt, lambda x: chr(CAST(48 + list_position(known, x) AS INTEGER))), 'string_agg', ''), list_aggregate(list_transform(ht, lambda x: chr(CAST(48 + list_position(known, x) AS INTEGER))), 'string_agg', '')) AS te, len(ht) AS hn FROM k),
e AS (SELECT p_type, p_size, chars, ce, tokens, CASE WHEN hn = 0 THEN tokens ELSE te END AS te FROM s)"""


def evaluation_cases(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Parts as cases: a name is expected, the next part's is recognized, and one case in nine failed."""
    size = F.when(F.col("p_size") < 10, "small_text").otherwise("dense_ui")
    p = table(spark, d, "part").select(long("p_partkey", "case_id"), F.col("p_name").alias("expected_text"), F.array(F.lower("p_type"), size).alias("tags"))
    after = p.select((F.col("case_id") - 1).alias("case_id"), F.col("expected_text").alias("recognized_text"))
    run = p.select("case_id").join(after, "case_id", "left").withColumn("status", F.when(F.col("case_id") % 9 == 0, "failed").otherwise("completed"))
    return p, run


TOTALS_SQL = """count(*) AS cases, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(ce) AS BIGINT) AS char_edits, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(te) AS BIGINT) AS token_edits,
  CAST(sum(ce) * 1000000 // sum(chars) AS BIGINT) AS char_error_ppm, CAST(sum(te) * 1000000 // sum(tokens) AS BIGINT) AS token_error_ppm"""


@query(f"WITH {EVAL_SQL}, tagged AS (SELECT unnest([lower(p_type), CASE WHEN p_size < 10 THEN 'small_text' ELSE 'dense_ui' END]) AS tag, chars, ce, tokens, te FROM e) SELECT tag, {TOTALS_SQL} FROM tagged GROUP BY tag")
def cer_slices(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.tag_slices(evaluation.score_cases(*evaluation_cases(spark, d)))


@query(f"WITH {EVAL_SQL} SELECT {TOTALS_SQL} FROM e")
def cer_totals(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.totals(evaluation.score_cases(*evaluation_cases(spark, d)))


BOX_SQL = """b AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS x0, CAST(l_linenumber AS BIGINT) AS y0, CAST(l_quantity AS BIGINT) + l_partkey % 40 - 5 AS x1, CAST(l_linenumber AS BIGINT) + l_suppkey % 9 AS y1 FROM lineitem),
p AS (SELECT *, CAST(round(x0 / 77.0::DOUBLE * 1000000) AS BIGINT) AS px0, CAST(round(x1 / 77.0::DOUBLE * 1000000) AS BIGINT) AS px1, CAST(round(y0 / 13.0::DOUBLE * 1000000) AS BIGINT) AS py0, CAST(round(y1 / 13.0::DOUBLE * 1000000) AS BIGINT) AS py1 FROM b)"""


def boxes(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "lineitem")
    x0, y0 = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")
    return i.select("l_orderkey", "l_linenumber", x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_partkey") % 40 - 5).alias("x1"), (y0 + F.col("l_suppkey") % 9).alias("y1"))


@query(f"WITH {BOX_SQL} SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, l_linenumber, px0 AS x_ppm, py0 AS y_ppm, px1 - px0 AS width_ppm, py1 - py0 AS height_ppm FROM p WHERE x0 >= 0 AND y0 >= 0 AND x1 <= 77 AND y1 <= 13 AND px1 > px0 AND py1 > py0")
def box_conversion(spark: SparkSession, d: str) -> DataFrame:
    box = evaluation.box_ppm(*[F.col(c) for c in ("x0", "y0", "x1", "y1")], F.lit(77), F.lit(13))
    return boxes(spark, d).withColumn("b", box).filter(F.col("b").isNotNull()).select(long("l_orderkey", "l_orderkey"), "l_linenumber", "b.*")


@query(
    """WITH o AS (SELECT l_partkey % 900 * 1000 AS x, l_suppkey % 90 * 10000 AS y, l_linenumber * 20000 - 20000 AS w, 150000 AS h, CASE WHEN l_returnflag = 'R' THEN ' ' ELSE 'x' END AS t, CAST(l_quantity AS INTEGER) * 210 AS c FROM lineitem)
SELECT count(*) AS observations, count(*) FILTER (w > 0 AND x + w <= 1000000 AND y + h <= 1000000) AS valid_boxes, count(*) FILTER (NOT (w > 0 AND x + w <= 1000000 AND y + h <= 1000000)) AS invalid_boxes,
  count(*) FILTER (trim(t) = '') AS empty_texts, count(*) FILTER (c > 10000) AS confidence_out_of_range FROM o"""
)
def observation_audit(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "lineitem").select(
        (F.col("l_partkey") % 900 * 1000).alias("x_ppm"), (F.col("l_suppkey") % 90 * 10_000).alias("y_ppm"), (F.col("l_linenumber") * 20_000 - 20_000).alias("width_ppm"), F.lit(150_000).alias("height_ppm"),
        F.when(F.col("l_returnflag") == "R", " ").otherwise("x").alias("text"), (F.col("l_quantity").cast("int") * 210).alias("confidence_basis_points"),
    )
    return evaluation.observation_audit(o)


# ---- watch --------------------------------------------------------------------------------------------------------

WINDOW_MS, MAX_AGE_MS = 21_600_000, 64_800_000


def hints(spark: SparkSession, d: str) -> DataFrame:
    """Events as hints: a user is a scope; most paths are one file, an error is a folder."""
    kind = F.when(F.col("event_type") == "error", "folder").otherwise("file")
    return table(spark, d, "events").select(long("user_id", "scope_id"), F.lit("/a/b.md").alias("path"), kind.alias("observed_kind"), event_ms().alias("observed_at_unix_ms"), "event_id")


@query(
    f"""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS t, event_type = 'error' AS folder, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_type <> 'error' DESC, event_id) AS i FROM events),
run AS (
  SELECT user_id, i, t AS first, t, CAST(1 AS BIGINT) AS hints, folder FROM e WHERE i = 1
  UNION ALL
  SELECT e.user_id, e.i, CASE WHEN x THEN e.t ELSE r.first END, e.t, CASE WHEN x THEN 1 ELSE r.hints + 1 END, CASE WHEN x THEN e.folder ELSE r.folder OR e.folder END
  FROM (SELECT *, least(t + {WINDOW_MS}, first + {MAX_AGE_MS}) AS due FROM run) r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1, LATERAL (SELECT e.t >= r.due AS x)),
g AS (SELECT user_id, first, max(t) AS last, max(hints) AS hints, bool_or(folder) AS folder FROM run GROUP BY user_id, first)
SELECT CAST(user_id AS BIGINT) AS scope_id, first AS first_at_unix_ms, last AS last_at_unix_ms, least(last + {WINDOW_MS}, first + {MAX_AGE_MS}) AS due_at_unix_ms, hints,
  CASE WHEN folder OR last + {WINDOW_MS} > first + {MAX_AGE_MS} THEN 'full_scope' ELSE 'file_delta' END AS kind, last + {WINDOW_MS} > first + {MAX_AGE_MS} AS widened FROM g"""
)
def watch_coalesce(spark: SparkSession, d: str) -> DataFrame:
    return watch.coalesce_batch(watch.actionable(hints(spark, d)), watch.Watch(WINDOW_MS, MAX_AGE_MS))


@query(
    """WITH s AS (SELECT user_id, max(epoch_us(ts) // 1000) + 3600000 AS due, CASE WHEN user_id % 50 = 7 THEN 'reconciling' ELSE 'stabilizing' END AS status FROM events GROUP BY user_id)
SELECT CAST(user_id AS BIGINT) AS scope_id, due AS due_at_unix_ms, status FROM s WHERE due <= 1706500000000 OR status = 'reconciling' ORDER BY status <> 'reconciling', due, user_id LIMIT 4"""
)
def watch_schedule(spark: SparkSession, d: str) -> DataFrame:
    s = hints(spark, d).groupBy("scope_id").agg((F.max("observed_at_unix_ms") + 3_600_000).alias("due_at_unix_ms"))
    s = s.withColumn("status", F.when(F.col("scope_id") % 50 == 7, "reconciling").otherwise("stabilizing"))
    return watch.schedule(s, 1_706_500_000_000)


# ---- privacy ------------------------------------------------------------------------------------------------------


@query(
    """WITH gone AS (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 3)
SELECT 'content_chunks' AS table_name, count(*) AS purged_rows FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM gone)
UNION ALL SELECT 'locations', count(*) FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM gone)
UNION ALL SELECT 'file_relations', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM gone) OR l_partkey IN (SELECT o_orderkey FROM gone)"""
)
def purge_closure(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    locations = o.select(long("o_orderkey", "id"), long("o_orderkey", "node_id"), F.lit(1).cast("long").alias("scope_id"), F.concat(F.lit("/"), F.col("c_nationkey").cast("string"), F.lit("/"), F.col("o_orderkey").cast("string")).alias("path_key"))
    exclusions = spark.createDataFrame([(1, "path", "/3")], "scope_id long, kind string, path_key string")
    nodes = privacy.closure(privacy.excluded_locations(locations, exclusions), locations)
    items = table(spark, d, "lineitem")
    chunks = items.select(long("l_orderkey", "node_id"))
    pairs = items.select(long("l_orderkey", "left_node_id"), long("l_partkey", "right_node_id"))
    return privacy.impact({"content_chunks": chunks, "locations": locations, "file_relations": pairs}, nodes)


# ---- further operators -----------------------------------------------------------------------------------------------


@query(
    """WITH o AS (SELECT l_suppkey AS case_id, CAST(l_orderkey AS BIGINT) * 8 + l_linenumber AS position, l_returnflag || l_linestatus AS text, l_linenumber AS x, CAST(l_quantity AS BIGINT) AS w FROM lineitem)
SELECT CAST(case_id AS BIGINT) AS case_id, text, x AS x_ppm, w AS width_ppm, CAST(min(position) AS BIGINT) AS position FROM o GROUP BY ALL"""
)
def distinct_observations(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "lineitem").select(
        long("l_suppkey", "case_id"), (F.col("l_orderkey").cast("long") * 8 + F.col("l_linenumber")).alias("position"), F.concat("l_returnflag", "l_linestatus").alias("text"),
        F.col("l_linenumber").alias("x_ppm"), F.lit(0).alias("y_ppm"), F.col("l_quantity").cast("long").alias("width_ppm"), F.lit(10).alias("height_ppm"),
    )
    return evaluation.distinct_observations(o).select("case_id", "text", "x_ppm", "width_ppm", long("position", "position"))


@query("SELECT CAST(o_custkey AS BIGINT) AS plan_id, CAST(floor(o_totalprice) AS BIGINT) % 5 AS request_id, CAST(min(o_orderkey) AS BIGINT) AS sequence FROM orders GROUP BY ALL")
def idempotent_commands(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "orders").select(long("o_custkey", "plan_id"), (F.floor("o_totalprice").cast("long") % 5).alias("request_id"), long("o_orderkey", "sequence"))
    return journal.idempotent(c)


@query(
    """WITH old AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT CAST(o.o_custkey AS BIGINT) AS plan_id, CAST(o_orderkey AS BIGINT) AS created_at_unix_ms, CAST(row_number() OVER (PARTITION BY o.o_custkey ORDER BY o_orderkey) + coalesce(n, 0) AS BIGINT) AS sequence
FROM orders o LEFT JOIN old USING (o_custkey) WHERE o_orderstatus <> 'F'"""
)
def next_sequences(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(long("o_custkey", "plan_id"), long("o_orderkey", "created_at_unix_ms"), "o_orderstatus")
    w = Window.partitionBy("plan_id").orderBy("created_at_unix_ms")
    old = o.filter("o_orderstatus = 'F'").withColumn("sequence", F.row_number().over(w).cast("long"))
    return journal.next_sequences(old, o.filter("o_orderstatus <> 'F'").drop("o_orderstatus"))


@query(
    f"""WITH {JOURNAL_SQL},
e AS (SELECT plan_id, sequence, kind, CASE WHEN kind = 'preview_created' THEN NULL WHEN sequence % 13 = 0 THEN 99 ELSE 1 + sequence // 40 END AS cmd FROM j),
l AS (SELECT *, lag(cmd) OVER (PARTITION BY plan_id ORDER BY sequence) AS before FROM e),
c AS (SELECT l.*, CASE WHEN cmd IS NULL OR cmd = 99 THEN NULL ELSE (cmd - 1) * 40 + 2 END AS requested FROM l),
v AS (SELECT plan_id, sequence, CASE WHEN kind = 'preview_created' THEN NULL WHEN requested IS NULL THEN 'command_missing' WHEN ends_with(kind, '_requested') AND sequence <> requested THEN 'command_sequence_mismatch'
  WHEN NOT ends_with(kind, '_requested') AND cmd IS DISTINCT FROM before THEN 'command_changed' END AS code FROM c)
SELECT CAST(plan_id AS BIGINT) AS plan_id, CAST(sequence AS BIGINT) AS sequence, code FROM v WHERE code IS NOT NULL"""
)
def command_violations(spark: SparkSession, d: str) -> DataFrame:
    command = F.when(F.col("event_kind") == "preview_created", F.lit(None)).when(F.col("sequence") % 13 == 0, 99).otherwise(1 + F.floor(F.col("sequence") / 40)).cast("long")
    e = journal_events(spark, d).withColumn("command_request_id", command)
    c = e.filter("command_request_id <> 99").select("plan_id", F.col("command_request_id").alias("request_id"), ((F.col("command_request_id") - 1) * 40 + 2).alias("requested_sequence")).distinct()
    return journal.command_violations(e, c)


@query(
    """WITH e AS (SELECT l_orderkey, l_linenumber, ['queued', 'running', 'interrupted', 'completed', 'failed'][CAST(l_quantity AS INTEGER) % 5 + 1] AS status FROM lineitem),
s AS (SELECT l_orderkey, l_linenumber * 100000 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY status) AS sequence, status FROM e),
t AS (SELECT l_orderkey, arg_min(status, sequence) FILTER (status IN ('completed', 'failed')) AS ended, arg_max(status, sequence) AS latest FROM s GROUP BY 1)
SELECT CAST(l_orderkey AS BIGINT) AS job_id, coalesce(ended, latest) AS status FROM t"""
)
def job_states(spark: SparkSession, d: str) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(x) for x in ("queued", "running", "interrupted", "completed", "failed")]), (F.col("l_quantity").cast("int") % 5 + 1))
    e = table(spark, d, "lineitem").select(long("l_orderkey", "job_id"), "l_linenumber", status.alias("status"))
    at = F.row_number().over(Window.partitionBy("job_id", "l_linenumber").orderBy("status"))
    return manifest.job_state(e.withColumn("sequence", F.col("l_linenumber") * 100_000 + at))


@query(
    """SELECT CASE p_partkey % 3 WHEN 0 THEN 'exact_duplicate' WHEN 1 THEN 'version' ELSE 'screenshot_group' END AS kind, CAST(p_partkey AS BIGINT) AS source_id, CAST(t AS BIGINT) AS target_node_id, CAST(k AS BIGINT) AS keeper_node_id, FALSE AS action_authorized
FROM part, LATERAL (SELECT p_partkey + 1 AS t, p_partkey + 2 AS k WHERE p_partkey % 3 < 2 UNION ALL SELECT p_partkey + 2, p_partkey + 1 WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey + i, NULL FROM range(1, 3) r(i) WHERE p_partkey % 3 = 2)"""
)
def cleanup_targets(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("p_partkey") % 3, F.col("p_partkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in relations.INBOX_KINDS]), (k + 1).cast("int"))
    s = table(spark, d, "part").select(kind.alias("kind"), long("p_partkey", "source_id"), F.when(k < 2, long(n + 1, "x")).alias("left_node_id"), F.when(k < 2, long(n + 2, "x")).alias("right_node_id"), F.when(k == 2, F.array(long(n + 1, "x"), long(n + 2, "x"))).alias("members"))
    return relations.cleanup_targets(s)


@query(
    """WITH r AS (SELECT p_partkey, '/s' || CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE '' END || '/' || replace(p_name, ' ', '-') AS source, replace(p_name, ' ', '-') AS name,
  CASE p_partkey % 4 WHEN 0 THEN upper(replace(p_name, ' ', '-')) WHEN 1 THEN replace(p_name, ' ', '-') WHEN 2 THEN p_name || '?' ELSE 'new-' || p_name END AS new_name, p_partkey % 7 = 0 AS taken FROM part)
SELECT CAST(p_partkey AS BIGINT) AS request_id, '/s' || CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE '' END || '/' || new_name AS destination_path, CASE WHEN p_partkey % 4 = 0 THEN 'staged' ELSE 'direct' END AS strategy,
  CASE WHEN p_partkey % 5 = 0 THEN 'action_source_outside_scope' WHEN p_partkey % 4 = 2 THEN 'action_name_not_portable' WHEN p_partkey % 4 = 1 THEN 'action_name_unchanged' WHEN taken AND p_partkey % 4 <> 0 THEN 'action_destination_exists' END AS error_code FROM r"""
)
def rename_previews(spark: SparkSession, d: str) -> DataFrame:
    k, name = F.col("p_partkey"), F.replace("p_name", F.lit(" "), F.lit("-"))
    new = F.when(k % 4 == 0, F.upper(name)).when(k % 4 == 1, name).when(k % 4 == 2, F.concat("p_name", F.lit("?"))).otherwise(F.concat(F.lit("new-"), "p_name"))
    r = table(spark, d, "part").select(long("p_partkey", "request_id"), F.lit("/s").alias("scope_root"), F.concat(F.when(k % 5 == 0, "/sx/").otherwise("/s/"), name).alias("source_path"), new.alias("new_name"), F.lit(1).cast("long").alias("size_bytes"), (k % 7 == 0).alias("destination_exists"))
    return actions.rename_previews(r).select("request_id", "destination_path", "strategy", "error_code")


@query("SELECT CAST(arg_max(event_id, (ts, event_id)) AS BIGINT) AS id, CAST(user_id AS BIGINT) AS relation_id FROM events GROUP BY user_id")
def latest_observations(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "events").select(long("event_id", "id"), long("user_id", "relation_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("observed_at_unix_ms"))
    return actions.latest_observation(o).select("id", "relation_id")


@query("SELECT CAST(o_custkey AS BIGINT) AS group_id, count(*) AS member_count, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total_bytes FROM orders GROUP BY 1")
def group_totals(spark: SparkSession, d: str) -> DataFrame:
    return actions.group_totals(table(spark, d, "orders").select(long("o_custkey", "group_id"), long(F.round(F.col("o_totalprice") * 100), "size_bytes")))


@query("SELECT count(*) AS evaluated, count(*) FILTER (event_type = 'view') AS not_current, count(*) FILTER (event_type = 'error') = 0 AS complete FROM events")
def inbox_counters(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.when(F.col("event_type") == "view", "not_current").when(F.col("event_type") == "error", "io_error").otherwise("current")
    return relations.inbox_counters(table(spark, d, "events").select(outcome.alias("outcome")))


@query(
    "WITH" + PAGES_SQL + """, s AS (SELECT DISTINCT scope_id * 1000 + length(path_key) AS scope_id, regexp_extract(path_key, '^[^/]+/[^/]+') AS root FROM pages_ WHERE node_id % 9 = 0)
SELECT CAST(s.scope_id AS BIGINT) AS scope_id, path_key AS path, CAST(node_id AS BIGINT) AS observed_at_unix_ms FROM pages_ p JOIN s ON path_key = root OR starts_with(path_key, root || '/')"""
)
def hint_routing(spark: SparkSession, d: str) -> DataFrame:
    p = page_locations(spark, d)
    scopes = p.filter("node_id % 9 = 0").select((F.col("scope_id") * 1000 + F.char_length("path_key")).alias("scope_id"), F.regexp_extract("path_key", "^[^/]+/[^/]+", 0).alias("path_key")).distinct()
    return watch.routed(p.select(F.col("path_key").alias("path"), F.col("node_id").alias("observed_at_unix_ms")), scopes).select("scope_id", "path", "observed_at_unix_ms")


@query(
    """SELECT count(*) AS events, count(*) FILTER (due <= 1704500000000) AS due, count(*) FILTER (due > 1704500000000) AS waiting, count(*) FILTER (user_id % 5 = 0) AS widened, count(*) FILTER (event_type <> 'error') AS file_deltas,
  greatest(1704500000050, min(due) FILTER (due > 1704500000000)) AS next_wake_unix_ms FROM (SELECT user_id, event_type, epoch_us(ts) // 1000 AS due FROM events)"""
)
def watch_cycle(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(event_ms().alias("due_at_unix_ms"), (F.col("user_id") % 5 == 0).alias("widened"), F.when(F.col("event_type") == "error", "full_scope").otherwise("file_delta").alias("kind"))
    return watch.cycle_report(e, 1_704_500_000_000)


@query(
    """WITH e AS (SELECT CAST(l_orderkey AS BIGINT) * 8 + l_linenumber AS id, l_suppkey AS path, l_returnflag <> 'R' AS delta FROM lineitem), m AS (SELECT s_suppkey, s_suppkey % 2 = 0 AS present, 1 + s_nationkey % 2 AS links FROM supplier)
SELECT CAST(id AS BIGINT) AS id, CASE WHEN delta AND present AND links = 1 THEN 'file_delta' ELSE 'full_scope' END AS kind FROM e LEFT JOIN m ON s_suppkey = path"""
)
def watch_deltas(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").select((F.col("l_orderkey").cast("long") * 8 + F.col("l_linenumber")).alias("id"), F.lit(1).cast("long").alias("scope_id"), F.col("l_suppkey").cast("string").alias("path"), F.when(F.col("l_returnflag") != "R", "file_delta").otherwise("full_scope").alias("kind"), F.lit(b"i").alias("identity_key"))
    m = table(spark, d, "supplier").select(F.lit(1).cast("long").alias("scope_id"), F.col("s_suppkey").cast("string").alias("path"), (F.col("s_suppkey") % 2 == 0).alias("present"), (1 + F.col("s_nationkey") % 2).alias("link_count"), F.lit(1).alias("locations"), F.lit(False).alias("scan_running"), F.lit(b"i").alias("identity_key"))
    return watch.deltas(e, m).select("id", "kind")


@query(
    """WITH n AS (SELECT s_suppkey, s_nationkey, CASE s_suppkey % 4 WHEN 0 THEN NULL ELSE s_nationkey % 3 END AS v FROM supplier)
SELECT CAST(a.s_suppkey AS BIGINT) AS left_id, CAST(b.s_suppkey AS BIGINT) AS right_id, CASE WHEN a.s_suppkey = b.s_suppkey THEN 'file_relation_same_file_identity' WHEN a.v IS NULL OR b.v IS NULL THEN 'file_version_name_unsupported'
  WHEN a.s_nationkey <> b.s_nationkey THEN 'file_version_base_mismatch' WHEN a.v = b.v THEN 'file_version_number_equal' END AS code FROM n a JOIN n b ON b.s_suppkey = a.s_suppkey // 2"""
)
def version_codes(spark: SparkSession, d: str) -> DataFrame:
    k, base = F.col("s_suppkey"), F.concat(F.lit("plan"), F.col("s_nationkey").cast("string"))
    name = F.when(k % 4 == 0, F.concat(base, F.lit("-final.md"))).otherwise(F.concat(base, F.lit("-v"), (F.col("s_nationkey") % 3 + 1).cast("string"), F.lit(".md")))
    n = table(spark, d, "supplier").select(long("s_suppkey", "id"), P.explicit_version(name).alias("v"))
    a, b = n.select(F.col("id").alias("left_id"), F.col("v").alias("a"), F.floor(F.col("id") / 2).alias("right_id")), n.select(F.col("id").alias("right_id"), F.col("v").alias("b"))
    return a.join(b, "right_id").select("left_id", "right_id", relations.version_code(F.col("left_id") == F.col("right_id"), F.col("a"), F.col("b")).alias("code"))


# ---- fences, previews, forms --------------------------------------------------------------------------------------


@query(
    """SELECT CAST(o_orderkey + 1000000000 AS BIGINT) AS node_id, '/3/' || o_custkey || '/' || o_orderkey AS path_key FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 3 AND o_orderkey % 10 <> 0
UNION ALL SELECT c_custkey + 1000, '/3/' || c_custkey FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 103, '/3'"""
)
def location_fence(spark: SparkSession, d: str) -> DataFrame:
    """A folder's subtree where each tenth file lies elsewhere, linked into the folder by its node alone."""
    edges, _ = tree(spark, d)
    customers, o = table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    place = lambda df, node, kind, path: df.select(long(node, "node_id"), F.lit(kind).alias("kind"), path.alias("path_key"), F.lit(1).cast("long").alias("scope_id"), F.lit(True).alias("present"))
    under = F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.lit("/x/"), F.col("o_orderkey"))).otherwise(F.concat(F.lit("/"), "c_nationkey", F.lit("/"), "o_custkey", F.lit("/"), "o_orderkey"))
    files = place(o.join(customers, F.col("o_custkey") == F.col("c_custkey")), F.col("o_orderkey") + 1_000_000_000, "file", under)
    folders = place(customers, F.col("c_custkey") + 1000, "folder", F.concat(F.lit("/"), "c_nationkey", F.lit("/"), "c_custkey"))
    tops = place(table(spark, d, "nation"), F.col("n_nationkey") + 100, "folder", F.concat(F.lit("/"), "n_nationkey"))
    return graph.subtree(edges, files.unionByName(folders).unionByName(tops), 1, 103).select("node_id", "path_key")


@query("SELECT CAST(event_id AS BIGINT) AS id, event_type FROM events ORDER BY event_id DESC LIMIT 20")
def recent_events(spark: SparkSession, d: str) -> DataFrame:
    return actions.recent(table(spark, d, "events").select(long("event_id", "id"), "event_type"))


@query(
    """WITH c AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'exact_duplicate' WHEN 1 THEN 'version' ELSE 'screenshot_group' END AS kind, p_partkey AS t, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN p_partkey ELSE p_partkey + 4 END AS k FROM part),
o AS (SELECT p_partkey AS node_id, p_size FROM part WHERE p_partkey % 7 <> 0)
SELECT CAST(id AS BIGINT) AS source_id, CASE WHEN a.node_id IS NULL OR (k IS NOT NULL AND b.node_id IS NULL) THEN 'cleanup_source_not_current' WHEN (kind = 'screenshot_group') = (k IS NOT NULL) THEN 'cleanup_keeper_invalid'
  WHEN t = k THEN 'cleanup_keeper_is_target' WHEN kind = 'exact_duplicate' AND a.p_size <> b.p_size THEN 'file_relation_content_differs' END AS error_code, FALSE AS action_authorized
FROM c LEFT JOIN o a ON a.node_id = t LEFT JOIN o b ON b.node_id = k"""
)
def cleanup_previews(spark: SparkSession, d: str) -> DataFrame:
    part, n = table(spark, d, "part"), F.col("p_partkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in relations.INBOX_KINDS]), (n % 3 + 1).cast("int"))
    choices = part.select(kind.alias("kind"), long(n, "source_id"), long(n, "target_node_id"), F.when(n % 5 == 1, long(n, "k")).when(n % 5 != 0, long(n + 4, "k")).alias("keeper_node_id"))
    seen = part.filter(n % 7 != 0).select(long(n, "node_id"), F.sha2(F.col("p_size").cast("string"), 256).alias("sha256"), long("p_size", "size_bytes"))
    return actions.cleanup_previews(choices, seen).select("source_id", "error_code", "action_authorized")


@query("SELECT CAST(n_nationkey AS BIGINT) AS selection_id, '/all/' || n_regionkey || '/' || n_name AS path_key, 'inode' AS identity_kind FROM nation")
def exclusion_batch(spark: SparkSession, d: str) -> DataFrame:
    """A batch that keeps all rules comes back whole; the faults of others are tested with their codes."""
    path = F.concat(F.lit("/all/"), "n_regionkey", F.lit("/"), "n_name")
    return actions.check_exclusions(table(spark, d, "nation").select(long("n_nationkey", "selection_id"), path.alias("path_key"), F.lit("inode").alias("identity_kind")), "/all")


@query(
    """WITH l AS (SELECT o_orderkey, o_orderstatus <> 'P' AS present, o_orderpriority LIKE '1%' AS folder FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2)
SELECT (SELECT count(*) FROM nation WHERE n_regionkey = 2) AS scopes, count(*) FILTER (present) AS nodes, count(*) FILTER (present AND NOT folder) AS files, count(*) FILTER (present AND folder) AS folders, count(*) FILTER (present) AS active_locations,
  (SELECT count(*) FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 2) AS issues, (SELECT count(*) FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2 AND c_mktsegment = 'BUILDING') AS completed_scans FROM l"""
)
def granted_stats(spark: SparkSession, d: str) -> DataFrame:
    """Manifest counts over the scopes (nations) with an active grant (region 2)."""
    grants = table(spark, d, "nation").select(long("n_nationkey", "scope_id"), F.when(F.col("n_regionkey") == 2, "active").otherwise("revoked").alias("state"))
    granted = lambda df: manifest.with_active_grant(df, grants)
    customers = table(spark, d, "customer")
    places = granted(table(spark, d, "orders").join(customers, F.col("c_custkey") == F.col("o_custkey")).select(long("c_nationkey", "scope_id"), long("o_orderkey", "node_id"), F.when(F.startswith("o_orderpriority", F.lit("1")), "folder").otherwise("file").alias("kind"), (F.col("o_orderstatus") != "P").alias("present")))
    issues = granted(table(spark, d, "supplier").select(long("s_nationkey", "scope_id")))
    scans = granted(customers.select(long("c_nationkey", "scope_id"), F.when(F.col("c_mktsegment") == "BUILDING", "completed").otherwise("running").alias("status")))
    return manifest.manifest_stats(granted(grants), places.filter("present").select("node_id", "kind").distinct(), places, issues, scans).drop("ready")


@query("SELECT doc_id, sha256(nfc_normalize(coalesce(text, ''))) AS nfc_sha256, CASE WHEN strlen(text) <= 500 THEN text ELSE substr(text, 1, list_max(list_filter(range(0, 501), lambda i: strlen(substr(text, 1, i)) <= 500))) END AS first_bytes FROM documents")
def text_forms(spark: SparkSession, d: str) -> DataFrame:
    """Normalization form C of whole texts, and the longest prefix of 500 bytes that ends between characters."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", X.sha256_hex(X.nfc(F.coalesce("text", F.lit("")))).alias("nfc_sha256"), X.truncate_utf8(F.col("text"), 500).alias("first_bytes"))


VALUES_SQL = "v AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_brand WHEN 1 THEN replace(p_name, ' ', '_') WHEN 2 THEN sha256(p_name) WHEN 3 THEN upper(sha256(p_name)) WHEN 4 THEN sha256(p_name) || chr(10) ELSE replace(p_type, ' ', '.') END AS v FROM part)"


@query("WITH " + VALUES_SQL + " SELECT CAST(p_partkey AS BIGINT) AS p_partkey, regexp_full_match(v, '[A-Za-z0-9._-]{1,128}') AS is_identifier, regexp_full_match(v, '[0-9a-f]{64}') AS is_sha256 FROM v")
def valid_identifiers(spark: SparkSession, d: str) -> DataFrame:
    k, sha = F.col("p_partkey"), F.sha2("p_name", 256)
    v = F.when(k % 6 == 0, F.col("p_brand")).when(k % 6 == 1, F.replace("p_name", F.lit(" "), F.lit("_"))).when(k % 6 == 2, sha).when(k % 6 == 3, F.upper(sha)).when(k % 6 == 4, F.concat(sha, F.lit("\n"))).otherwise(F.replace("p_type", F.lit(" "), F.lit(".")))
    return table(spark, d, "part").select(long("p_partkey", "p_partkey"), X.identifier_valid(v).alias("is_identifier"), X.sha256_valid(v).alias("is_sha256"))


@query(
    """WITH e AS (SELECT event_type, CAST(round(value * 1000) AS BIGINT) AS us, user_id % 4 <> 0 AS done FROM events), r AS (SELECT 'attempts' AS measure, * FROM e UNION ALL SELECT 'completed', * FROM e WHERE done)
SELECT measure, event_type, count(*) AS n, quantile_disc(us, 0.5) AS p50, quantile_disc(us, 0.95) AS p95, max(us) AS max FROM r GROUP BY ALL"""
)
def attempt_latencies(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", long(F.round(F.col("value") * 1000), "elapsed_us"), (F.col("user_id") % 4 != 0).alias("done"))
    return evaluation.attempt_latencies(e, "elapsed_us", F.col("done"), "event_type")


@query(
    """WITH p AS (SELECT c_custkey AS id, c_custkey % 97 * 1000 AS due, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 89 * 100 END AS put_off, c_custkey % 11 = 0 AS active FROM customer),
r AS (SELECT *, due <= 50000 AND NOT active AS ready, row_number() OVER (PARTITION BY due <= 50000 AND NOT active ORDER BY put_off IS NULL, coalesce(put_off, due), id) AS i FROM p)
SELECT CAST(id AS BIGINT) AS scope_id, ready AND i <= 4 AS scheduled, CAST(CASE WHEN NOT ready THEN due WHEN i <= 4 THEN 350000 ELSE 51000 END AS BIGINT) AS due_at_unix_ms, CAST(CASE WHEN ready AND i > 4 THEN coalesce(put_off, due) WHEN NOT ready AND NOT active THEN put_off END AS BIGINT) AS deferred_due_at_unix_ms FROM r"""
)
def watch_polls(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    polls = table(spark, d, "customer").select(long(k, "scope_id"), long(k % 97 * 1000, "due_at_unix_ms"), F.when(k % 3 == 0, long(k % 89 * 100, "x")).alias("deferred_due_at_unix_ms"), (k % 11 == 0).alias("active"))
    return watch.poll_schedule(polls, 50_000)


@query(
    """WITH e AS (SELECT event_id AS id, epoch_us(ts) // 1000 AS seen, user_id % 10 AS size, event_type FROM events), s AS (SELECT *, CASE WHEN id % 5 <> 0 THEN size END AS now_size, CASE WHEN id % 5 <> 0 THEN id % 7 <> 0 END AS is_file FROM e)
SELECT CAST(id AS BIGINT) AS scope_id, CASE WHEN id % 5 = 0 OR id % 4 = 0 THEN 'stabilizing' ELSE 'reconciling' END AS status, CASE WHEN id % 5 = 0 OR id % 4 = 0 THEN least(1705000001000, seen + 300000) ELSE seen + 1000 END AS due_at_unix_ms,
  CASE WHEN id % 5 = 0 OR id % 4 = 0 THEN CAST(2 AS BIGINT) ELSE 1 END AS hints, CASE WHEN (id % 5 = 0 OR id % 4 = 0) AND (1705000001000 > seen + 300000 OR NOT coalesce(is_file, FALSE)) THEN 'full_scope' ELSE 'file_delta' END AS kind FROM s"""
)
def watch_recheck(spark: SparkSession, d: str) -> DataFrame:
    """Events whose path is gone (each fifth) or whose size has changed (each fourth) stabilize anew."""
    i, at = F.col("event_id"), event_ms()
    e = table(spark, d, "events")
    look = lambda size: [size.alias("size_bytes"), at.alias("modified_unix_ns"), F.lit(b"i").alias("identity_key")]
    events = e.select(long(i, "scope_id"), F.lit("/f").alias("path"), at.alias("first_at_unix_ms"), at.alias("last_at_unix_ms"), (at + 1000).alias("due_at_unix_ms"), F.lit(1).cast("long").alias("hints"), F.lit("file_delta").alias("kind"), F.lit(False).alias("widened"), *look(long(F.col("user_id") % 10, "s")))
    found = e.filter(i % 5 != 0).select(long(i, "scope_id"), F.lit("/f").alias("path"), F.when(i % 7 == 0, "folder").otherwise("file").alias("observed_kind"), *look(long(F.col("user_id") % 10 + (i % 4 == 0).cast("long"), "s")))
    return watch.recheck(events, found, 1_705_000_000_000).select("scope_id", "status", "due_at_unix_ms", "hints", "kind")


@query("SELECT CAST(event_id AS BIGINT) AS event_id, CAST(CASE event_type WHEN 'error' THEN 1030000 WHEN 'view' THEN 1001000 WHEN 'click' THEN 1000050 END AS BIGINT) AS retry_at_unix_ms FROM events")
def watch_retries(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    outcome = F.when(kind == "error", "error").when(kind == "view", "contention").when(kind == "click", "active").otherwise("completed")
    return table(spark, d, "events").select(long("event_id", "event_id"), watch.retry_at(outcome, 1_000_000).alias("retry_at_unix_ms"))


# ---- fixtures -----------------------------------------------------------------------------------------------------


@query(
    """SELECT CAST(i % 100 AS BIGINT) AS folder, count(*) AS documents, CAST(sum(length('Quarterly folder notes, project evidence and local search for document ' || i)) AS BIGINT) AS chars FROM range(2000) t(i) GROUP BY 1"""
)
def search_fixture(spark: SparkSession, d: str) -> DataFrame:
    _, chunks, _ = listing.search_corpus(spark, 2000)
    ascii_part = F.regexp_extract("text", "^[ -~]*[0-9]", 0)
    return chunks.groupBy(((F.col("node_id") - 1000) % 100).alias("folder")).agg(F.count("*").alias("documents"), F.sum(F.char_length(ascii_part)).cast("long").alias("chars"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Content search over documents, end to end."""
    return search_content(spark, d)


# ---- micro-batches ------------------------------------------------------------------------------------------------


@query(
    """WITH m AS (SELECT o_custkey % 3 + 1 AS scope_id, 'o' || CAST(o_orderkey AS VARCHAR) AS path_key, CAST(floor(o_totalprice) AS BIGINT) AS size_bytes, o_orderkey % 5 <> 0 AS present FROM orders),
e AS (SELECT 'o' || CAST(user_id * 7 + event_id % 3 AS VARCHAR) AS path_key, event_id % 3 AS batch, max(event_id) AS size_bytes FROM events GROUP BY ALL),
l AS (SELECT path_key, arg_max(size_bytes, batch) AS size_bytes, arg_max(batch, batch) AS last FROM e GROUP BY ALL)
SELECT m.scope_id, m.path_key, CASE WHEN m.present AND l.path_key IS NOT NULL THEN l.size_bytes ELSE m.size_bytes END AS size_bytes, m.present,
  CASE WHEN m.present AND l.path_key IS NOT NULL THEN 'update' ELSE 'unchanged' END AS action FROM m LEFT JOIN l USING (path_key)"""
)
def delta_effect(spark: SparkSession, d: str) -> DataFrame:
    """Three batches of single-file deltas on a warehouse's manifest, each delivered twice, and the first once more at the end."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='siltstone-')}"
    w = Warehouse(spark, f"{root.rstrip('/')}/deltas-{uuid.uuid4().hex}")
    orders = table(spark, d, "orders")
    w.replace("manifest", orders.select(long(F.col("o_custkey") % 3 + 1, "scope_id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("path_key"), long(F.floor("o_totalprice"), "size_bytes"), (F.col("o_orderkey") % 5 != 0).alias("present"), F.lit("unchanged").alias("action")), check=False)
    events = table(spark, d, "events").select(F.concat(F.lit("o"), (F.col("user_id") * 7 + F.col("event_id") % 3).cast("string")).alias("path_key"), long(F.col("event_id") % 3, "batch"), "event_id")
    for batch in (0, 0, 1, 1, 2, 2, 0):
        found = events.filter(F.col("batch") == batch).groupBy("path_key").agg(F.max("event_id").alias("size_bytes"))
        sinks.once(w, "deltas", batch, lambda t, found=found: t.replace("manifest", sinks.applied(t.read("manifest"), found, ["path_key"], ["size_bytes"]), check=False) and None)
    return w.read("manifest").select("scope_id", "path_key", "size_bytes", "present", "action")
