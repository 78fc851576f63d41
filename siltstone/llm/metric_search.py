"""Exact top-k search by M-trees: paged metric nodes with covering radii and parent distances, searched best first.

The table is dealt by a hash of its rows into shards of bounded size; each shard's rows become one M-tree, a row of the
index table. A page holds up to ``page`` entries; an entry of an inner page is a routing vector with the covering radius
of its subtree and its distance to the page's own routing vector, an entry of a leaf is a vector with that distance.

Scores are inner products, bounded by Euclidean geometry: for a vector x within r of a routing vector o,
q.x <= q.o + |q| r, and q.o <= q.p + |q| d(o, p) for the parent p, whose product is known already. So a subtree or a
vector whose stored distances rule it out is skipped before its own product is computed. Pages wait in a heap by their
bound; a search ends when the best bound is below the k-th best score. All products are of integers and exact: in doubles
where no sum can pass 2^53, in 64-bit integers where none can pass 2^63, and in Python's integers beyond; bounds carry a
margin for the rounding of distances. Components beyond 64 bits count as the nearest 64-bit integer; scores beyond 64
bits are ranked exactly and given as the nearest 64-bit integer.

Queries meet shards in blocks, both rows of bounded size: each task takes a few shard files and a few block files and searches
every pair of them. Pairs are formed where they are searched, by a cross product of the two written tables, so neither a
shuffle nor the driver ever holds them. The per-shard results, k rows a query, are merged by rank.

Defined edge cases: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows with a
null id; vectors are compared with those of as many components, a shard having one tree for each number; of rows that
share an id each is a query of its own, with its own k result rows, and a candidate for the others; fewer candidates than
k give fewer rows; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch


@dataclass(frozen=True)
class MetricSearch:
    k: int = 5
    page: int = 256
    shard_rows: int = 8192
    query_block: int = 2048


@dataclass
class Page:
    """Entries in parallel arrays; inner pages have child page numbers and radii."""

    vectors: np.ndarray
    to_parent: np.ndarray
    ids: np.ndarray | None = None
    rows: np.ndarray | None = None
    radii: np.ndarray | None = None
    children: np.ndarray | None = None


def largest(vectors: np.ndarray) -> int:
    """The largest absolute value, as an integer without bounds."""
    return max(int(vectors.max()), -int(vectors.min())) if vectors.size else 0


def build_tree(vectors: np.ndarray, ids: np.ndarray, numbers: np.ndarray, page: int) -> list[Page]:
    """Bulk loads an M-tree; page 0 is the root. Routing vectors are chosen far apart; a set that they cannot part (equal
    vectors) is cut evenly. ``numbers`` tell rows apart that share an id."""
    vectors = vectors.astype(np.min_scalar_type(-largest(vectors) - 1)) if largest(vectors) < 1 << 63 else vectors
    pages: list[Page] = []

    def grow(rows: np.ndarray, parent: np.ndarray | None) -> int:
        number = len(pages)
        pages.append(None)  # type: ignore[arg-type]
        v = vectors[rows].astype(float)
        apart = lambda o: np.sqrt(((v - o) ** 2).sum(axis=1))
        if len(rows) <= page:
            pages[number] = Page(vectors[rows], apart(parent) if parent is not None else np.zeros(len(rows)), ids=ids[rows], rows=numbers[rows])
            return number
        fan = min(page, -(-len(rows) // page))
        chosen, nearest, owner = [0], apart(v[0]), np.zeros(len(rows), int)
        while len(chosen) < fan:
            far = int(nearest.argmax())
            if nearest[far] == 0:
                break
            d = apart(v[far])
            owner[d < nearest] = len(chosen)
            nearest = np.minimum(nearest, d)
            chosen.append(far)
        if len(chosen) == 1:
            owner = np.arange(len(rows)) * fan // len(rows)
            chosen = [int(np.flatnonzero(owner == i)[0]) for i in range(fan)]
        routing, radii, children = v[chosen], [], []
        for i, o in enumerate(routing):
            mine = np.flatnonzero(owner == i)
            radii.append(float(np.sqrt(((v[mine] - o) ** 2).sum(axis=1)).max()))
            children.append(grow(rows[mine], o))
        pages[number] = Page(vectors[rows][chosen], np.sqrt(((routing - parent) ** 2).sum(axis=1)) if parent is not None else np.zeros(len(routing)), radii=np.array(radii), children=np.array(children))
        return number

    if len(rows := np.arange(len(ids))):
        grow(rows, None)
    return pages


def exact_kind(width: int, one: int, other: int) -> type:
    """In what the products of vectors with components up to these are exact, partial sums included."""
    bound = width * one * other
    return float if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object


def search_tree(pages: list[Page], q: np.ndarray, own: int, k: int, scale: int) -> tuple[list[tuple[int, int]], int]:
    """The k best (score, -id) of the tree but row ``own``, as a heap, and how many products it took. ``scale`` is the
    largest absolute component of the tree."""
    best: list[tuple[int, int]] = []
    kind = exact_kind(len(q), scale, largest(q))
    qf, norm = q.astype(kind), float(np.sqrt((q.astype(float) ** 2).sum()))
    slack = 1e-6 + norm * scale * len(q) * 2.0**-49  # distances between far vectors are rounded
    products, heap = 0, [(-np.inf, 0, None)] if pages else []
    while heap:
        bound, number, at_parent = heapq.heappop(heap)
        worst = best[0][0] if len(best) == k else -np.inf
        if -bound < worst:
            break
        p = pages[number]
        reach = p.to_parent if p.radii is None else p.to_parent + p.radii
        if at_parent is None:
            open_ = np.arange(len(p.vectors))
        else:  # what the stored distances rule out needs no product
            open_ = np.flatnonzero(at_parent + norm * reach * (1 + 1e-9) + slack >= worst)
        score = p.vectors[open_].astype(kind) @ qf
        products += len(open_)
        if p.radii is None:
            for i in np.flatnonzero(score >= worst):
                if p.rows[open_[i]] == own:
                    continue
                x = (int(score[i]), -int(p.ids[open_[i]]))
                if len(best) < k:
                    heapq.heappush(best, x)
                elif x > best[0]:
                    heapq.heapreplace(best, x)
        else:
            upper = score.astype(float) + norm * p.radii[open_] * (1 + 1e-9) + slack
            for i in np.flatnonzero(upper >= worst):
                heapq.heappush(heap, (-float(upper[i]), int(p.children[open_[i]]), float(score[i])))
    return best, products


def whole_vectors(table: DataFrame, is_query: Column, id_column: str, vector: str, scale: int = 256) -> DataFrame:
    """(row, id, is_query, v): v is floor(scale * component) as integers; of the rows that take part."""
    x = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * scale).cast("long"))
    good = F.col(id_column).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(F.col(vector), lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    return table.filter(good).select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), x.alias("v"))


def _lists(column: pa.Array) -> list[np.ndarray]:
    return [x.values.to_numpy() for x in column]


def build_index(rows: DataFrame, scratch: Scratch, p: MetricSearch) -> DataFrame:
    """(shard, trees): for each shard its M-trees by number of components, each with its largest component. A shard has
    about shard_rows rows whatever the ids are, as rows are dealt out by position within shuffled partitions of equal size."""
    n = rows.count()
    shards = max(1, -(-n // p.shard_rows))

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, ids, vectors = [], [], []
        for b in batches:
            numbers.append(b.column(0).to_numpy())
            ids.append(b.column(1).to_numpy())
            vectors += _lists(b.column(2))
        trees, widths = {}, np.array([len(v) for v in vectors], int)
        for width in np.unique(widths):
            at = np.flatnonzero(widths == width)
            v = np.stack([vectors[i] for i in at])
            trees[int(width)] = build_tree(v, np.concatenate(ids)[at], np.concatenate(numbers)[at], p.page), largest(v)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([pickle.dumps(trees, protocol=5)], pa.binary())], names=["shard", "trees"])

    return scratch.write(rows.select("row", "id", "v").repartition(shards).mapInArrow(build, "shard int, trees binary"), "index")


def query_blocks(queries: DataFrame, scratch: Scratch, p: MetricSearch) -> DataFrame:
    """(queries): blocks of about query_block queries, each by number of components as (rows, ids, vectors)."""
    n_blocks = max(1, -(-queries.count() // p.query_block))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, ids, vectors = [], [], []
        for b in batches:
            numbers.append(b.column(0).to_numpy())
            ids.append(b.column(1).to_numpy())
            vectors += _lists(b.column(2))
        block, widths = {}, np.array([len(v) for v in vectors], int)
        for width in np.unique(widths):
            at = np.flatnonzero(widths == width)
            v = np.stack([vectors[i] for i in at])
            kind = np.min_scalar_type(-largest(v) - 1) if largest(v) < 1 << 63 else v.dtype
            block[int(width)] = np.concatenate(numbers)[at], np.concatenate(ids)[at], v.astype(kind)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block, protocol=5)], pa.binary())], names=["queries"])

    return scratch.write(queries.select("row", "id", "v").repartition(n_blocks).mapInArrow(pack, "queries binary"), "blocks")


#: A score is high * 2^63 + low, low not negative.
RESULT = "row long, query_id long, high long, low long, vec_id long"


def top_k(table: DataFrame, is_query: Column, id_column: str = "vec_id", vector: str = "embedding", p: MetricSearch = MetricSearch()) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``is_query``, a condition on the table's columns, picks, its k best
    other rows by inner product, ties to the smaller id."""
    scratch = Scratch(table.sparkSession, "mtree")
    rows = scratch.write(whole_vectors(table, is_query, id_column, vector), "rows")
    index = build_index(rows, scratch, p)
    blocks = query_blocks(rows.filter("is_query"), scratch, p)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = lambda s: max(-(1 << 63), min(s, (1 << 63) - 1))
        for b in batches:
            for i in range(b.num_rows):
                trees, block, out = pickle.loads(b.column(0)[i].as_py()), pickle.loads(b.column(1)[i].as_py()), []
                for width, (numbers, ids, vectors) in block.items():
                    pages, scale = trees.get(width, ([], 0))
                    for own, q_id, q in zip(numbers, ids, vectors.astype(np.int64), strict=True):
                        out += [(int(own), int(q_id), fit(s >> 63), s & ((1 << 63) - 1), -x) for s, x in search_tree(pages, q, int(own), p.k, scale)[0]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ((),) * 5)], names=["row", "query_id", "high", "low", "vec_id"])

    # every block of queries meets every shard: read from their files by each task, as a broadcast of either, or of their pairs, would grow with the table
    found = index.select("trees").join(blocks.hint("shuffle_replicate_nl")).mapInArrow(search, RESULT)
    w = Window.partitionBy("row").orderBy(F.desc("high"), F.desc("low"), "vec_id")
    score = F.expr("CASE high WHEN 0 THEN low WHEN -1 THEN low + (-9223372036854775807L - 1) ELSE IF(high > 0, 9223372036854775807L, -9223372036854775807L - 1) END").alias("score")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", score)
