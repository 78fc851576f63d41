"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped edges.

A document's set is that of its distinct shingles of k words (A-Z lower-cased); with fewer words, the whole sequence as
one. One hash per shingle sorts the set into bins, each bin keeps its smallest; an empty bin borrows from the first
non-empty bin of a random sequence of its own. Bins are grouped into bands, and documents that agree on a band share a
bucket. Documents with equal sets are first merged into one representative, so copies never multiply candidates.

Each bucket gives a star: its smallest document against each other one. Stars are confirmed on full sets, and confirmed
links are merged into components. Where a bucket then still spans several components, its other members are compared
with each other in blocks, which emit links only. So every pair of a bucket is confirmed, refuted or already connected,
and no bucket is capped.

With b bands of r rows a pair of similarity s shares a bucket with probability 1 - (1 - s^r)^b: 0.999997 at 0.8 and
above for the default 42 bands of 6.

Defined edge cases: null and empty texts, and texts without words, have empty sets and are linked with nothing; a null
doc_id takes no part and is kept, with a null component; rows that share a doc_id are linked and judged each by its own
text, and of a group's rows with the smallest doc_id those of one text are kept; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, fresh, maybe_in, mix, skewed_join, without
from siltstone.llm.components import connected_components

U = np.uint64


@dataclass(frozen=True)
class NearDedup:
    """Shingle length, the least similarity in percent, and the banding."""

    shingle_words: int = 5
    percent: int = 80
    bands: int = 42
    rows: int = 6


class Shingler:
    """Sets of 64-bit shingle hashes; word hashes are cached up to a bound."""

    def __init__(self, k: int, max_words: int = 200_000) -> None:
        self.k, self.max_words, self.words = k, max_words, {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        """The sorted set of a text's UTF-8 bytes."""
        words = (text or b"").lower().split()  # on bytes: A-Z only, and ASCII white space
        if not words:
            return np.empty(0, U)
        known = self.words
        try:
            h = [known[w] for w in words]
        except KeyError:
            if len(known) > self.max_words:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            h = [known[w] for w in words]
        a = np.array(h, dtype=U)
        n = max(1, len(a) - self.k + 1)
        s = np.zeros(n, U)
        for i in range(min(self.k, len(a))):
            s = mix(s + U(0x9E3779B97F4A7C15) + a[i : i + n])
        return np.unique(mix(s + U(min(self.k, len(a)))))


class Signer:
    """Band keys of a set."""

    def __init__(self, bands: int, rows: int, attempts: int = 4096) -> None:
        self.bands, self.rows, self.bins, self.attempts = bands, rows, bands * rows, attempts
        i, t = np.meshgrid(np.arange(self.bins, dtype=U), np.arange(attempts, dtype=U), indexing="ij")
        self.probes = (mix(mix(i + U(1)) + t) % U(self.bins)).astype(np.int32)
        self.weights = mix(np.arange(rows, dtype=U) + U(77)) | U(1)
        self.salts = mix(np.arange(bands, dtype=U) + U(1234))

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        bins = (((shingles >> U(32)) * U(self.bins)) >> U(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(bins, prepend=-1))
        full = np.zeros(self.bins, bool)
        full[bins[first]] = True
        signature = np.zeros(self.bins, U)
        signature[bins[first]] = shingles[first]
        empty, lo, hi = np.flatnonzero(~full), 0, 8
        while len(empty) and lo < self.attempts:
            probes = self.probes[empty, lo:hi]
            hit = full[probes]
            found = hit.any(axis=1)
            signature[empty[found]] = signature[probes[found, hit[found].argmax(axis=1)]]
            empty, lo, hi = empty[~found], hi, min(4 * hi, self.attempts)
        if len(empty):  # next to never: the next non-empty bin, circularly
            at = np.flatnonzero(full)
            signature[empty] = signature[at[np.searchsorted(at, empty) % len(at)]]
        return mix((mix(signature).reshape(self.bands, self.rows) * self.weights).sum(axis=1, dtype=U) + self.salts)


SIGNED = "doc_id long, text_hash long, n_shingles long, h0 long, h1 long, bands array<long>"


def text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("binary"))


def signatures(docs: DataFrame, p: NearDedup) -> DataFrame:
    """Per document: doc_id, its text's hash, n_shingles, two hashes of its set, and the band keys (none for an empty set)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(p.shingle_words), Signer(p.bands, p.rows)
        for batch in batches:
            n, h0, h1, keys, ends = [], [], [], [], [0]
            for text in batch.column(2):
                s = shingler(text.as_py())
                data = s.tobytes()
                n.append(len(s))
                h0.append(xxhash.xxh64_intdigest(data, 1))
                h1.append(xxhash.xxh64_intdigest(data, 2))
                if len(s):
                    keys.append(signer(s))
                ends.append(len(keys) * p.bands)
            flat = np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)
            signed = lambda x: pa.array(np.array(x, dtype=U).view(np.int64))
            bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(n, pa.int64()), signed(h0), signed(h1), bands], names=["doc_id", "text_hash", "n_shingles", "h0", "h1", "bands"])

    return docs.select("doc_id", text_hash().alias("text_hash"), F.col("text").cast("binary").alias("text")).mapInArrow(run, SIGNED)


def confirm(pairs: DataFrame, texts: DataFrame, p: NearDedup, scratch: Scratch) -> DataFrame:
    """Of the pairs (a, b) those whose full sets overlap enough; texts: (doc_id, text as binary)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, recent = Shingler(p.shingle_words), {}
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                y = y.as_py()
                if (t := recent.get(y)) is None:
                    if len(recent) >= 64:
                        recent.clear()
                    t = recent[y] = shingler(y)
                s = shingler(x.as_py())
                both = len(np.intersect1d(s, t, assume_unique=True)) if 100 * min(len(s), len(t)) >= p.percent * max(len(s), len(t)) else 0
                good.append(both > 0 and 100 * both >= p.percent * (len(s) + len(t) - both))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    x = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("x"))
    y = texts.withColumnRenamed("doc_id", "a").join(pairs.groupBy("a").agg(F.count("*").alias("n")), "a").withColumnRenamed("text", "y")
    both = skewed_join(pairs.join(x, "b"), scratch.write(y, "centres"), ["a"], how="inner", total=pairs.count())
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def untested(members: DataFrame, parts: DataFrame, scratch: Scratch) -> DataFrame:
    """(unit, doc_id, component): members that no star has tested against each other, in buckets that still span several
    components.

    A group of look-alikes fills many buckets with much the same members. Buckets that share members form a cluster; a
    cluster is one unit if that takes fewer comparisons than its buckets one by one, and otherwise each bucket is a unit.
    """
    left = members.filter(F.col("doc_id") != F.col("centre")).join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    left = left.select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    left = scratch.write(left, "others")
    torn = left.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("doc_id").alias("first"), F.count("*").alias("n")).filter(F.col("lo") < F.col("hi"))
    left = scratch.write(skewed_join(left, scratch.write(torn.select("key", "first", "n"), "torn"), ["key"], how="inner").drop("n"), "left")
    scratch.drop("others")
    if left.isEmpty():
        return left.select(F.col("key").alias("unit"), "doc_id", "component")
    clusters = connected_components(left.select(F.col("first").alias("a"), F.col("doc_id").alias("b")), scratch, "clusters")
    keys = left.groupBy("key", "first").agg(F.count("*").alias("m")).join(clusters.select(F.col("node").alias("first"), F.col("component").alias("cluster")), "first", "left")
    keys = keys.select("key", "m", F.coalesce("cluster", "first").alias("cluster"))
    sizes = clusters.groupBy(F.col("component").alias("cluster")).agg((F.count("*") + 1).alias("n"))
    keys = scratch.write(keys, "keys")
    apart = keys.groupBy("cluster").agg(F.sum(F.col("m") * F.col("m")).alias("apart"), F.count("*").alias("n_keys")).join(sizes, "cluster", "left")
    joint = scratch.write(apart.select("cluster", "n_keys", F.coalesce(F.col("n") * F.col("n") <= F.col("apart"), F.lit(False)).alias("joint")), "joint")
    unit = F.when(F.col("joint"), F.xxhash64(F.lit("cluster"), "cluster")).otherwise(F.col("key")).alias("unit")
    units = skewed_join(keys, joint, ["cluster"], n="n_keys", how="inner").select("key", unit, F.col("m").alias("n"))
    units = scratch.write(units, "unit-keys")
    return scratch.write(skewed_join(left, units, ["key"], how="inner").select("unit", "doc_id", "component").distinct(), "units")


def links_between(x: list[np.ndarray], y: list[np.ndarray], percent: int, width: int = 8192) -> np.ndarray:
    """Which sets of x and of y overlap enough, as a matrix, from shared shingles a bounded number at a time."""
    sizes = [np.array([len(s) for s in side]) for side in (x, y)]
    values, codes, counts = np.unique(np.concatenate([*x, *y]), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(counts > 1)  # a shingle of one set alone is in no intersection
    column = np.full(len(values), -1)
    column[shared] = np.arange(len(shared))
    columns, owner = column[codes], np.repeat(np.arange(len(x) + len(y)), np.concatenate(sizes))
    both = np.zeros((len(x), len(y)), np.float32)
    for lo in range(0, len(shared), width):
        at = (columns >= lo) & (columns < lo + width)
        m = np.zeros((len(x) + len(y), min(width, len(shared) - lo)), np.float32)
        m[owner[at], columns[at] - lo] = 1
        both += m[: len(x)] @ m[len(x) :].T
    return (both > 0) & (100 * both >= percent * (sizes[0][:, None] + sizes[1][None] - both))


def confirm_in_blocks(units: DataFrame, texts: DataFrame, p: NearDedup, scratch: Scratch, block: int = 128) -> DataFrame:
    """Links (a, b) between different components of each unit. A unit's members are dealt into blocks of about so many;
    each two blocks are one row of their own, compared by their incidence with shared shingles, and emit links only."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(p.shingle_words)
        for batch in batches:
            for i in range(batch.num_rows):
                sides = [batch.column(k)[i].as_py() for k in range(2)]
                sets = [[shingler(r["text"]) for r in side] for side in sides]
                ids, parts = ([np.array([r[c] for r in side]) for side in sides] for c in ("doc_id", "component"))
                good = links_between(*sets, p.percent) & (parts[0][:, None] != parts[1][None])
                a, b = np.nonzero(good)
                yield pa.RecordBatch.from_arrays([pa.array(ids[0][a]), pa.array(ids[1][b])], names=["a", "b"])

    counts = scratch.write(units.groupBy("unit").agg(F.count("*").alias("n")), "unit-sizes")
    dealt = skewed_join(units, counts, ["unit"], how="inner").withColumn("n_blocks", F.ceil(F.col("n") / block))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("doc_id"), "n_blocks"))
    rows = F.collect_list(F.struct("doc_id", "component", "text")).alias("rows")
    blocks = scratch.write(dealt.join(texts, "doc_id").groupBy("unit", "n_blocks", "block").agg(rows), "blocks")
    x = blocks.select("unit", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("n_blocks") - 1)).alias("j"), F.col("rows").alias("x"))
    y = blocks.select("unit", F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("i"), F.col("block").alias("j"), F.col("rows").alias("y"))
    return x.join(y, ["unit", "i", "j"]).select("x", "y").mapInArrow(run, "a long, b long")


def numbered(reps: DataFrame, scratch: Scratch) -> DataFrame:
    """reps with a number for each set: its representative's doc_id, or a 64-bit hash for further sets of the same doc_id."""
    n, ids = reps.agg(F.count("*"), F.countDistinct("rep.doc_id")).head()
    if n == ids:
        return reps.withColumn("node", F.col("rep.doc_id"))
    first = reps.groupBy("rep.doc_id").agg(F.min(F.struct("h0", "h1")).alias("first"))
    own = F.struct("h0", "h1") == F.col("first")
    node = F.when(own, F.col("doc_id")).otherwise(F.xxhash64(F.lit("node"), "doc_id", "h0", "h1"))
    return scratch.write(reps.join(first, F.col("rep.doc_id") == F.col("doc_id")).select("h0", "h1", "rep", "n_rows", "bands", node.alias("node")), "numbered")


def judge(docs: DataFrame, p: NearDedup) -> DataFrame:
    """Per document: doc_id, text_hash, n_shingles, component_id, kept. Sets are linked by number, see :func:`numbered`."""
    scratch = Scratch(docs.sparkSession, "near")
    signed = scratch.write(signatures(docs, p), "signed")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    sets = signed.filter(~alone)
    # equal sets have equal bands, so a set's row holds them, however many rows have the set
    reps = sets.groupBy("h0", "h1").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.count("*").alias("n_rows"), F.first("bands").alias("bands"))
    reps = numbered(scratch.write(reps, "reps"), scratch)
    # one row a set and band; a bucket counts if it holds two representatives
    rows = reps.select(F.col("node").alias("doc_id"), F.explode("bands").alias("key"))
    rows = scratch.write(rows, "rows")
    stars = rows.groupBy("key").agg(F.min("doc_id").alias("centre"), F.max("doc_id").alias("last"), F.count("*").alias("n")).filter(F.col("centre") < F.col("last")).drop("last")
    members = scratch.write(skewed_join(rows, scratch.write(stars, "stars"), ["key"], how="inner").drop("n"), "members")
    scratch.drop("rows")
    pairs = scratch.write(members.filter(F.col("doc_id") != F.col("centre")).select(F.col("centre").alias("a"), F.col("doc_id").alias("b")).distinct(), "pairs-0")
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = scratch.write(reps.join(wanted, "node", "left_semi").select("rep.doc_id", "rep.text_hash", "node"), "wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), F.col("text").cast("binary").alias("text"))
    texts = maybe_in(texts, ["doc_id", "text_hash"], wanted.select("doc_id", "text_hash"), scratch, "maybe").filter("maybe").drop("maybe")  # no text of another set is shuffled
    texts = texts.join(wanted.hint("merge"), ["doc_id", "text_hash"]).groupBy("doc_id", "text_hash").agg(F.first("node").alias("node"), F.first("text").alias("text"))  # once, however many rows
    texts = texts.select(F.col("node").alias("doc_id"), "text")
    texts = scratch.write(texts, "texts")
    links = scratch.write(confirm(pairs, texts, p, scratch), "links-0")
    parts = connected_components(links, scratch, "parts-0")
    rest = untested(members, parts, scratch)
    if not rest.isEmpty():
        found = scratch.write(confirm_in_blocks(rest, texts, p, scratch), "links-1")
        parts = connected_components(links.unionByName(found), scratch, "parts-1")
    scratch.drop("members", "texts", "centres", "stars", "blocks", "left")
    of_set = reps.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    if reps.filter(F.col("node") != F.col("rep.doc_id")).isEmpty():
        heads = of_set.select("h0", "h1", "rep", "n_rows", F.col("part").alias("component"), (F.col("node") == F.col("part")).alias("is_head"))
    else:  # a component's smallest number need not be its smallest doc_id
        least = of_set.groupBy("part").agg(F.min("rep").alias("least"))
        heads = of_set.join(least, "part").select("h0", "h1", "rep", "n_rows", F.col("least.doc_id").alias("component"), (F.col("rep") == F.col("least")).alias("is_head"))
    out = skewed_join(signed.filter(~alone), scratch.write(heads, "heads"), ["h0", "h1"], n="n_rows", how="inner")
    chosen = F.col("is_head") & (F.struct("doc_id", "text_hash") == F.col("rep"))
    out = out.select("doc_id", "text_hash", "n_shingles", F.col("component").alias("component_id"), chosen.alias("kept"))
    return out.unionByName(signed.filter(alone).select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))


def near_duplicates(docs: DataFrame, p: NearDedup = NearDedup()) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    return judge(docs, p).drop("text_hash")


def without_near_duplicates(docs: DataFrame, p: NearDedup = NearDedup()) -> DataFrame:
    """The documents of which one is kept for each group, with all their columns; of rows that share a doc_id and a text
    one stays, the first by its further columns as JSON, and every row with a null doc_id.

    The verdict is met on doc_id and the text's hash, so that rows that share an id are judged one by one."""
    scratch = Scratch(docs.sparkSession, "near-kept")
    (first_name,) = fresh(docs, "_first")
    gone = scratch.write(judge(docs, p).filter(~F.col("kept")).select("doc_id", "text_hash").distinct(), "gone")
    out = without(docs, [F.col("doc_id").cast("long"), text_hash()], gone, scratch)
    n, ids = docs.agg(F.count("doc_id"), F.countDistinct("doc_id")).head()
    if n == ids:
        return out
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    alike = out.filter(F.col("doc_id").isNotNull())
    first = F.min_by(F.struct(*[F.col(c) for c in others]), F.to_json(F.struct(*[F.col(c) for c in others]))) if others else F.lit(None)
    alike = alike.groupBy("doc_id", "text").agg(first.alias(first_name))  # the same one in every run
    return alike.select(*[F.col(first_name)[c].alias(c) if c in others else F.col(c) for c in docs.columns]).unionByName(out.filter(F.col("doc_id").isNull()))
