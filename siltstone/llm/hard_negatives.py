"""Hard negatives by inverted lists: k-means lists with stored radii, visited by their Cauchy-Schwarz bounds.

Every row lies in the list of its nearest centroid; a list's directory entry holds its centroid, the largest distance of its
rows from it, and into how many blocks its rows are dealt, so a list of any size, a third of all rows included, is searched by
many tasks. For a query q and a list with centroid c and radius r, every product lies in [q.c - |q| r, q.c + |q| r].

A search visits the lists of each query in descending order of the upper bound, a few at first, then more, then the rest
(``steps``). Between the steps the k-th best score so far is known: a list whose bound is strictly below it is not
visited, nor is one that lies wholly outside the score window that is asked for; equal bounds are visited, as a smaller id may
win there. So the result is exact whatever the lists are; they are fitted on a bounded sample (``sample_rows`` rows of
lowest hash of their id, ``iterations`` rounds), and decide about the work alone. Queries go to the blocks that they visit, up to
``query_block`` of them together; a block's rows stay where they are.

Positives are found by such a search among the rows of the anchor's label, without a window; negatives by one among all other
labels with a window for each positive: from ``low_percent`` percent of its score up to its score.

Defined edge cases: rows whose id, label or vector is null, whose vector is empty or holds null or non-finite components, take
no part; vectors are compared with those of as many components; rows that share an id are rows of their own, each an
anchor of its own where the id is one, and candidates for the others; a positive with a negative score has no window and no negatives; fewer
candidates give fewer rows; an empty table gives an empty result; further columns are ignored, whatever their names. Labels are
whole numbers. Components beyond 64 bits count as the nearest 64-bit integer; products are exact at every size, scores beyond 10^30
count as that, and are given as the nearest 64-bit integer.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch
from siltstone.llm.metric_search import exact_kind

MOST = 10**30
SCORE = "decimal(31,0)"


@dataclass(frozen=True)
class Mining:
    positives: int = 5
    negatives: int = 5
    low_percent: int = 80
    scale: int = 256
    steps: tuple[int, ...] = (4, 64)
    list_rows: int = 2048
    max_lists: int = 1024
    sample_rows: int = 16_384
    iterations: int = 8
    query_block: int = 256


def labelled_vectors(table: DataFrame, is_anchor: Column, label: Column, id_column: str, vector: str, p: Mining) -> DataFrame:
    """(row, id, label, is_anchor, v) of the rows that take part; v is floor(scale * component)."""
    x = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * p.scale).cast("long"))
    whole = F.forall(F.col(vector), lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    good = F.col(id_column).isNotNull() & label.isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & whole
    return table.filter(good).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"), x.alias("v")
    )


def _nearest(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(axis=1)[None, :] - 2 * v @ centroids.T).argmin(axis=1)


def fit_centroids(sample: list[np.ndarray], k: int, iterations: int) -> dict[int, np.ndarray]:
    """Lloyd's k-means for each number of components, k centroids together."""
    out, widths = {}, np.array([len(v) for v in sample], int)
    for width in np.unique(widths):
        v = np.stack([sample[i] for i in np.flatnonzero(widths == width)]).astype(float)
        centroids = np.unique(v[: max(1, k * len(v) // len(sample))], axis=0)
        for _ in range(iterations):
            owner = _nearest(v, centroids)
            counts = np.bincount(owner, minlength=len(centroids))
            sums = np.zeros_like(centroids)
            np.add.at(sums, owner, v)
            centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
        out[int(width)] = centroids
    return out


class Index:
    """The written lists, and their directory: one entry a list, ``max_lists`` at most and one for each further number of
    components that the sample lacks, known to all tasks."""

    def __init__(self, rows: DataFrame, scratch: Scratch, p: Mining) -> None:
        self.scratch, self.p = scratch, p
        n, scale = rows.agg(F.count("*"), F.max(F.greatest(F.array_max("v"), -1 - F.array_min("v")))).head()
        self.scale = int(scale or 0) + 1
        sample = rows.orderBy(F.xxhash64("id"), "id", "row").limit(p.sample_rows).select("v").collect()
        k = max(1, min(p.max_lists, n // p.list_rows))
        self.centroids = centroids = fit_centroids([np.array(r.v) for r in sample], k, p.iterations)

        def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                vectors = [x.values.to_numpy() for x in b.column(2)]
                widths, lists, apart = np.array([len(v) for v in vectors], np.int32), np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
                for width in np.unique(widths):
                    at = np.flatnonzero(widths == width)
                    v, c = np.stack([vectors[i] for i in at]).astype(float), centroids.get(int(width), np.zeros((1, width)))
                    lists[at] = _nearest(v, c)
                    apart[at] = np.sqrt(((v - c[lists[at]]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(widths), pa.array(lists), pa.array(apart)], names=[*b.schema.names, "width", "list", "apart"])

        placed = scratch.write(rows.select("row", "id", "v", "label").mapInArrow(assign, "row long, id long, v array<long>, label long, width int, list int, apart double"), "placed")
        entries = placed.groupBy("width", "list").agg(F.max("apart").alias("radius"), F.ceil(F.count("*") / p.list_rows).cast("int").alias("blocks")).orderBy("width", "list").collect()
        self.directory: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for width in {e.width for e in entries}:
            mine = [e for e in entries if e.width == width]
            numbers = np.array([e.list for e in mine])
            self.directory[width] = numbers, centroids.get(width, np.zeros((1, width)))[numbers], np.array([e.radius for e in mine]), np.array([e.blocks for e in mine])
        self.most_lists = max((len(d[0]) for d in self.directory.values()), default=0)
        sizes = rows.sparkSession.createDataFrame([Row(width=e.width, list=e.list, blocks=e.blocks) for e in entries], "width int, list int, blocks int")
        dealt = placed.join(F.broadcast(sizes), ["width", "list"]).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
        whole = dealt.groupBy("width", "list", "block").agg(F.array_sort(F.collect_list(F.struct("id", "row", "label", "v"))).alias("e"))  # about list_rows
        self.blocks = scratch.write(whole.select("width", "list", "block", F.col("e.id").alias("ids"), F.col("e.row").alias("rows"), F.col("e.label").alias("labels"), F.flatten("e.v").alias("vs")), "lists")

    def visits(self, queries: DataFrame, first: int, last: int | None) -> DataFrame:
        """(row, label, v, windows, width, list, block): the queries with the blocks of the lists from ``first`` to ``last`` in the order of
        their bounds, without those that no window needs."""
        directory, scale = self.directory, self.scale

        def plan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for v, lows, highs in zip(b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                    q = v.values.to_numpy().astype(float)
                    numbers, centroids, radii, blocks = directory[len(q)]
                    at, norm = centroids @ q, float(np.sqrt((q**2).sum()))
                    reach = norm * radii * (1 + 1e-9) + 1e-6 + norm * scale * len(q) * 2.0**-49
                    order = np.argsort(-(at + reach), kind="stable")[first:last]
                    needed = np.zeros(len(order), bool)
                    for low, high in zip(lows, highs, strict=True):
                        needed |= (at[order] + reach[order] >= float(low)) & (at[order] - reach[order] <= float(high))
                    out.append([{"list": int(numbers[i]), "block": j} for i in order[needed] for j in range(int(blocks[i]))])
                kind = pa.list_(pa.struct([("list", pa.int32()), ("block", pa.int32())]))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, kind)], names=[*b.schema.names, "visits"])

        schema = f"row long, label long, v array<long>, lows array<{SCORE}>, highs array<{SCORE}>, visits array<struct<list:int,block:int>>"
        planned = queries.select("row", "label", "v", "lows", "highs").mapInArrow(plan, schema)
        return planned.select("row", "label", "v", "lows", "highs", F.size("v").alias("width"), F.inline("visits"))

    def meet(self, visits: DataFrame, chunks: int, same_label: bool, k: int) -> DataFrame:
        """(row, window, score, id, other): for each query, window and block the k best rows."""
        scale = self.scale

        def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    ids, rows, labels, vs, own, own_labels, flat = (b.column(j)[i].values.to_numpy() for j in range(7))
                    lows, highs, width = b.column(7)[i].as_py(), b.column(8)[i].as_py(), len(flat) // len(own)
                    kind = exact_kind(width, scale, scale)
                    products = flat.reshape(-1, width).astype(kind) @ vs.reshape(-1, width).astype(kind).T
                    fits = (labels[None, :] == own_labels[:, None]) == same_label
                    fits &= rows[None, :] != own[:, None]
                    out: list[tuple[int, int, int, int, int]] = []
                    for q in range(len(own)):
                        for w, (low, high) in enumerate(zip(lows[q], highs[q], strict=True)):
                            low, high = int(low), int(high)
                            inside = fits[q] if (low, high) == (-MOST, MOST) else fits[q] & (products[q] >= low) & (products[q] <= high)
                            at = np.flatnonzero(inside)
                            if len(at) > k:  # rows lie by id: a stable sort keeps the smaller
                                at = at[np.argsort(-products[q][at], kind="stable")[:k]]
                            out += [(int(own[q]), w, max(-MOST, min(MOST, int(products[q][x]))), int(ids[x]), int(rows[x])) for x in at]
                    kinds = (pa.int64(), pa.int32(), pa.decimal128(31), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ((),) * 5, kinds, strict=True)], names=["row", "window", "score", "id", "other"])

        keys = ["width", "list", "block"]
        together = visits.groupBy(*keys, F.pmod(F.xxhash64("row"), F.lit(chunks)).alias("chunk")).agg(F.collect_list(F.struct("row", "label", "v", "lows", "highs")).alias("q"))  # about query_block
        met = self.blocks.join(together, keys).select("ids", "rows", "labels", "vs", "q.row", "q.label", F.flatten("q.v").alias("v"), "q.lows", "q.highs")
        return met.mapInArrow(search, f"row long, window int, score {SCORE}, id long, other long")

    def search(self, queries: DataFrame, windows: DataFrame, same_label: bool, k: int, name: str) -> DataFrame:
        """(row, window, rank, score, id, other): the k best of each query's windows (row, window, low, high), which number from 0."""
        chunks = max(1, -(-queries.count() // self.p.query_block))
        found, first = None, 0
        best = Window.partitionBy("row", "window").orderBy(F.desc("score"), "id", "other")
        for step, last in enumerate([*self.p.steps, None]):
            open_ = windows
            if found is not None:  # from here on only what reaches the k-th best score matters
                kth = found.groupBy("row", "window").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
                open_ = windows.join(kth, ["row", "window"], "left").withColumn("low", F.greatest("low", "kth"))
            asked = open_.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("window", "low", "high"))).alias("w")).select("row", F.col("w.low").alias("lows"), F.col("w.high").alias("highs"))
            hits = self.meet(self.visits(queries.join(asked, "row"), first, last), chunks, same_label, k)
            hits = hits if found is None else hits.unionByName(found.drop("rank"))
            found = self.scratch.write(hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), f"{name}-{step}")
            if last is None or last >= self.most_lists:
                break
            first = last
        return found


def mine_negatives(table: DataFrame, is_anchor: Column, label: Column | None = None, id_column: str = "vec_id", vector: str = "embedding", p: Mining = Mining()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. ``is_anchor`` and ``label`` are expressions on
    the table's columns."""
    scratch = Scratch(table.sparkSession, "negatives")
    rows = scratch.write(labelled_vectors(table, is_anchor, F.col("label") if label is None else label, id_column, vector, p), "rows")
    index = Index(rows, scratch, p)
    anchors = rows.filter("is_anchor")
    number = lambda x: F.lit(str(x)).cast(SCORE)
    every = anchors.select("row", F.lit(0).alias("window"), number(-MOST).alias("low"), number(MOST).alias("high"))
    positives = index.search(anchors, every, True, p.positives, "positives").select("row", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    positives = positives.filter("positive_score >= 0")  # a share of a negative score lies above it
    low = F.ceil(F.col("positive_score") * F.lit(p.low_percent).cast("decimal(3,0)") * F.lit("0.01").cast("decimal(2,2)")).cast(SCORE)
    windows = positives.select("row", "window", low.alias("low"), F.col("positive_score").alias("high"))
    negatives = index.search(anchors, windows, False, p.negatives, "negatives").withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score")
    long = lambda c: F.greatest(F.least(F.col(c), number(2**63 - 1)), number(-(2**63))).cast("long").alias(c)
    named = negatives.join(positives, ["row", "window"]).join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", long("positive_score"), long("negative_score"))
