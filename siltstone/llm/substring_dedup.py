"""Dedup of long repeated byte strings by content-defined anchors and fingerprints, in place of prefix doubling.

Prefix doubling ranks positions by ever longer prefixes of their suffixes and drops a position once its rank is unique or
its prefix has passed the threshold. Doing so at every byte needs a sort of all positions for each doubling, many times
the text itself. Here nothing doubles and no (position, rank) pairs are sorted: positions enter sparsely and only where still undecided:

* A string of ``length`` bytes starting at p is represented by its anchor, the block of ``block`` bytes with the smallest
  hash within it. The anchor depends on the string's bytes alone, so equal strings have equal anchors at equal offsets.
  Successive starts share anchors: a run of starts lo..hi with one anchor is one row.
* Rank 1 (prefix of ``block`` bytes at the anchor): rows whose block is unique drop out.
* If all bytes that a row's strings span occur again around an equal anchor, all its strings are repeated. Rows that are
  alike in this are one class, and only one of a class goes on, as a partner for others.
* Rank 2: undecided rows and partners are cut into cells of ``cell`` starts; the bytes common to a cell's strings are
  ranked. Unique cells drop out; cells whose whole span occurs again are repeated.
* Rank 3: what is left is ranked start by start by the full ``length`` bytes.

A rank is a class of equal 64-bit fingerprints of block and string, grouped by Spark at each level. Strings around an equal
block agree in its fingerprint, so 64 bits tell them apart: of n different strings with one block about n^2 / 2^65 pairs are
taken for equal, whatever the texts, as each run hashes by a seed of its own; nothing is compared byte by byte. Groups are counted by partial aggregates and one member of a class stands for
all; joins on a block, span or string that very many rows have are dealt out over several tasks.

Passages. A passage that documents share may be of many words and yet shorter than ``length`` bytes, so windows of
``words`` words are looked up as well, by the same anchors over words instead of bytes, whatever white space parts them.
A window counts if another document has it, too; nothing is removed for it.

Defined edge cases: null texts are empty; shorter texts than ``length`` lose nothing, and texts of fewer words have no
passage; a null doc_id is kept as such; repeated rows repeat each other's strings and get the same result, but are one
document where passages are concerned; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, mix, skewed_join

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
NO_ID = -(1 << 63)


@dataclass(frozen=True)
class SubstringDedup:
    length: int = 400
    block: int = 100
    cell: int = 16


@dataclass(frozen=True)
class Passages:
    """Windows of so many words, and the words of a block that may be their anchor."""

    length: int = 51
    block: int = 8


class Hashes:
    """Of an array: what all ranges of a power of two of its values hash to, longer ones as they are asked for; of bytes from
    eight on, whose values stand in ``raw``."""

    def __init__(self, least: int, first: np.ndarray, raw: np.ndarray | None = None) -> None:
        self.least, self.levels, self.raw = least, [first], raw


class Fingerprints:
    """64-bit fingerprints of ranges of bytes, or of words' hashes, by doubling: a range of 2^k is hashed from its two
    halves, any other from the two ranges of the largest power of two that fits, at its start and at its end; from 128 on
    from the ranges of 64 that follow each other from its start, and the one at its end.

    Nothing in it is linear, so no pattern of characters cancels out as it can in sums of powers; and each run has a ``seed`` of
    its own that no text can be made to fit. Two different ranges agree with a probability of about 2^-64."""

    def __init__(self, seed: int = 0) -> None:
        self.k = mix(np.arange(1, 7, dtype=U) * U(BASE) + U(seed & (1 << 64) - 1)) | U(1)
        self.masks = np.array([(1 << 8 * n) - 1 for n in range(8)], U)

    def sums(self, data: np.ndarray) -> Hashes:
        if data.dtype != np.uint8:
            return Hashes(0, data)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        raw = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,)).copy()  # the eight bytes from each place on
        first = raw ^ self.k[3]
        first *= self.k[4]
        first ^= first >> U(32)
        return Hashes(3, first, raw)

    def _join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        x = right >> U(31)
        x ^= right
        x *= self.k[0]
        x += left * self.k[1]
        x ^= x >> U(32)
        x *= self.k[2]
        return x

    def _ended(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        x += n.astype(U) * self.k[5]
        x ^= x >> U(32)
        x *= self.k[3]
        x ^= x >> U(29)
        return x

    def _level(self, h: Hashes, k: int) -> np.ndarray:
        while len(h.levels) <= k - h.least:
            half = 1 << (h.least + len(h.levels) - 1)
            h.levels.append(self._join(h.levels[-1][:-half], h.levels[-1][half:]))
        return h.levels[k - h.least]

    def every(self, h: Hashes, n: int, count: int) -> np.ndarray:
        """The fingerprints of the first ``count`` ranges of n, under 128 and no fewer than a hash takes."""
        k = n.bit_length() - 1
        level, last = self._level(h, k), n - (1 << k)
        return self._ended(self._join(level[:count], level[last : last + count]), np.array([n]))

    def of(self, h: Hashes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n, out = end - start, np.empty(len(start), U)
        k = np.minimum(np.frexp(n)[1] - 1, 6) if len(n) else n  # the largest power of two that fits
        for level in np.unique(k):
            at = np.flatnonzero(k == level)
            s, e, m = start[at], end[at], n[at]
            if level < h.least:  # a few bytes: as they are
                x = (h.raw[s] & self.masks[m]) * self.k[1]
            else:
                hashes, last = self._level(h, int(level)), e - (1 << int(level))
                x = hashes[s]
                for j in range(1, int(m.max()) >> 6):
                    on = np.flatnonzero(m >> 6 > j)
                    x[on] = self._join(x[on], hashes[s[on] + (j << 6)])
                x = self._join(x, hashes[last])
            out[at] = self._ended(x, m)
        return out


def window_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of x[i : i + w] for each i, from running minima within stretches of w."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    padded = np.full(-(-len(x) // w) * w, np.iinfo(U).max, U)
    padded[: len(x)] = x
    stretches = padded.reshape(-1, w)
    left = np.minimum.accumulate(stretches, axis=1).ravel()
    right = np.minimum.accumulate(stretches[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


class Sampler:
    """Rows (document, anchor, lo, hi, fingerprint of the anchor's block, fingerprint of the span) of documents, each an
    array of bytes or of words' hashes."""

    def __init__(self, p: SubstringDedup | Passages, size: int = 1 << 17, seed: int = 0) -> None:
        self.p, self.size = p, size
        self.prints = Fingerprints(seed)

    def groups(self, texts: Iterable[np.ndarray]) -> Iterator[list[tuple[int, int, np.ndarray]]]:
        """Runs of (document, offset, slice) of bounded total size; long documents come in overlapping slices."""
        run, total = [], 0
        for i, t in enumerate(texts):
            for at in range(0, len(t) - self.p.length + 1, self.size):
                part = t[at : at + self.size + self.p.length - 1]
                if run and total + len(part) > self.size + self.p.length:
                    yield run
                    run, total = [], 0
                run.append((i, at, part))
                total += len(part)
        if run:
            yield run

    def rows(self, texts: Iterable[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
        length, block = self.p.length, self.p.block
        for run in self.groups(texts):
            data = np.concatenate([x[2] for x in run])
            sizes = np.array([len(x[2]) for x in run])
            starts = np.cumsum(sizes) - sizes
            sums = self.prints.sums(data)
            at = np.arange(len(data) - block + 1)
            whole = block.bit_length() - 1 >= sums.least and block < 128
            blocks = self.prints.every(sums, block, len(at)) if whole else self.prints.of(sums, at, at + block)
            anchor = (window_minimum((blocks & ~U(0xFFFFFF)) | at.astype(U), length - block + 1) & U(0xFFFFFF)).astype(np.int64)
            own = np.repeat(np.arange(len(run)), sizes)[: len(anchor)]
            valid = np.flatnonzero(np.arange(len(anchor)) + length <= (starts + sizes)[own])
            anchor, own = anchor[valid], own[valid]
            first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])]))
            last = np.append(first[1:], len(anchor)) - 1
            lo, hi, a, d = valid[first], valid[last], anchor[first], own[first]
            span = mix(self.prints.of(sums, lo, hi + length) + mix(((a - lo) * 4096 + (hi - lo)).astype(U)))
            shift = np.array([x[1] for x in run])[d] - starts[d]
            yield np.array([x[0] for x in run])[d], a + shift, lo + shift, hi + shift, blocks[a], span


def _arrays(names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.view(np.int64) if c.dtype == U else c.astype(np.int64)) for c in columns], names=names)


def _keyed(docs: DataFrame) -> DataFrame:
    """(id, th, text): rows that agree on id and the text's hash are the same text, so one result serves them all."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


ROWS = "id long, th long, a long, lo long, hi long, block long, span long"


def sampled_rows(keyed: DataFrame, p: SubstringDedup, seed: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(p, seed=seed)
        for b in batches:
            ids, hashes = b.column(0).to_numpy(), b.column(1).to_numpy()
            for d, a, lo, hi, block, span in sampler.rows(np.frombuffer(t.as_py(), np.uint8) for t in b.column(2)):
                yield _arrays([x.split()[0] for x in ROWS.split(", ")], [ids[d], hashes[d], a, lo, hi, block, span])

    return keyed.mapInArrow(run, ROWS)


def _per_text(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per text with its (bounded by its length) list of rows, in parallel arrays."""
    listed = rows.groupBy("id", "th").agg(F.collect_list(F.struct(*columns)).alias("r"))
    return listed.select("id", "th", *[F.col(f"r.{c}").alias(c) for c in columns])


def _slices(lo: np.ndarray, size: int) -> Iterator[np.ndarray]:
    part = lo // size
    for k in np.unique(part):
        yield np.flatnonzero(part == k)


CELLS = "id long, th long, block long, a long, undecided long, q long, lo long, hi long, core long, span long"


def cells(texts: DataFrame, rows: DataFrame, p: SubstringDedup, seed: int) -> DataFrame:
    """The rows cut into cells of starts on a grid that counts from the anchor."""
    size, width, length = 1 << 17, p.cell, p.length

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprints(seed)
        for b in batches:
            out: list = []
            for i in range(b.num_rows):
                text = np.frombuffer(b.column(2)[i].as_py(), np.uint8)
                block, a, lo, hi, undecided = (b.column(k)[i].values.to_numpy() for k in range(3, 8))
                for at in _slices(lo, size):
                    base = int(lo[at].min())
                    sums = prints.sums(text[base : int(hi[at].max()) + length])
                    first, last = (lo[at] - a[at]) // width, (hi[at] - a[at]) // width
                    n = last - first + 1
                    r = np.repeat(at, n)
                    q = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
                    edge = a[r] + q * width
                    clo, chi = np.maximum(lo[r], edge), np.minimum(hi[r], edge + width - 1)
                    core = prints.of(sums, edge + width - 1 - base, edge + length - base)
                    span = mix(prints.of(sums, clo - base, chi + length - base) + mix(((clo - edge) * 4096 + (chi - clo)).astype(U)))
                    ones = np.ones(len(r), np.int64)
                    out.append([ones * b.column(0)[i].as_py(), ones * b.column(1)[i].as_py(), block[r], a[r], undecided[r], q, clo, chi, core, span])
            if out:
                yield _arrays([x.split()[0] for x in CELLS.split(", ")], [np.concatenate(c) for c in zip(*out, strict=True)])

    joined = texts.join(_per_text(rows, "block", "a", "lo", "hi", "undecided"), ["id", "th"])
    return joined.select("id", "th", "text", "block", "a", "lo", "hi", "undecided").mapInArrow(run, CELLS)


STARTS = "id long, th long, at long, undecided long, block long, string long"


def single_starts(texts: DataFrame, rows: DataFrame, p: SubstringDedup, seed: int) -> DataFrame:
    """Every start of the rows, with the fingerprints of its anchor's block and of its full string."""
    size, length = 1 << 17, p.length

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprints(seed)
        for b in batches:
            out: list = []
            for i in range(b.num_rows):
                text = np.frombuffer(b.column(2)[i].as_py(), np.uint8)
                lo, hi, undecided, block = (b.column(k)[i].values.to_numpy() for k in range(3, 7))
                for at in _slices(lo, size):
                    base = int(lo[at].min())
                    sums = prints.sums(text[base : int(hi[at].max()) + length])
                    n = hi[at] - lo[at] + 1
                    s = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[at], n)
                    ones = np.ones(len(s), np.int64)
                    string = prints.of(sums, s - base, s + length - base)
                    out.append([ones * b.column(0)[i].as_py(), ones * b.column(1)[i].as_py(), s, np.repeat(undecided[at], n), np.repeat(block[at], n), string])
            if out:
                yield _arrays([x.split()[0] for x in STARTS.split(", ")], [np.concatenate(c) for c in zip(*out, strict=True)])

    joined = texts.join(_per_text(rows, "lo", "hi", "undecided", "block"), ["id", "th"])
    return joined.select("id", "th", "text", "lo", "hi", "undecided", "block").mapInArrow(run, STARTS)


def texts_of(keyed: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, th, text), once for each text that has one of the rows."""
    return keyed.join(rows.select("id", "th").distinct(), ["id", "th"], "left_semi").groupBy("id", "th").agg(F.first("text").alias("text"))


def repeated_intervals(docs: DataFrame, p: SubstringDedup, scratch: Scratch, seed: int) -> DataFrame:
    """(id, th, lo, hi): byte ranges [lo, hi) that repeated strings cover, not yet merged."""
    keyed, interval = _keyed(docs), lambda df: df.select("id", "th", "lo", (F.col("hi") + p.length).alias("hi"))
    # rank 1: blocks that occur more than once
    rows = scratch.write(sampled_rows(keyed, p, seed), "rows")
    blocks = scratch.write(rows.groupBy("block").agg(F.count("*").alias("n")).filter(F.col("n") > 1), "blocks")
    rows = scratch.write(skewed_join(rows, blocks, ["block"]), "live")
    scratch.drop("rows")
    place = F.min(F.struct("id", "th", "a", "lo", "hi")).alias("r")
    classes = scratch.write(rows.groupBy("block", "span").agg(F.count("*").alias("n"), place), "classes")
    covered = scratch.write(interval(skewed_join(rows, classes.filter(F.col("n") > 1).select("block", "span", "n"), ["block", "span"])), "covered")
    scratch.drop("live", "blocks")
    torn = classes.groupBy("block").agg(F.min("n").alias("least"), F.count("*").alias("n")).filter((F.col("least") == 1) & (F.col("n") > 1)).drop("least")
    open_rows = skewed_join(classes, scratch.write(torn, "torn"), ["block"]).select("block", "r.*", (F.col("n") == 1).cast("long").alias("undecided"))
    open_rows = scratch.write(open_rows, "open")
    scratch.drop("classes", "torn")
    texts = scratch.write(texts_of(keyed, open_rows), "texts")
    # rank 2: cells by the bytes that all their strings have in common
    cut = scratch.write(cells(texts, open_rows, p, seed), "cells")
    key = ["block", "q", "core"]
    kinds = cut.groupBy(*key, "span").agg(F.count("*").alias("n"), F.max("undecided").alias("undecided"), F.min(F.struct("id", "th", "lo", "hi")).alias("r"))
    kinds = scratch.write(kinds, "kinds")
    twice = kinds.filter((F.col("n") > 1) & (F.col("undecided") == 1)).select(*key, "span", "n")
    covered_cells = scratch.write(interval(skewed_join(cut.filter(F.col("undecided") == 1), twice, [*key, "span"])), "covered-cells")
    scratch.drop("cells", "open")
    alone = F.max(((F.col("n") == 1) & (F.col("undecided") == 1)).cast("int"))
    torn = kinds.groupBy(*key).agg(F.count("*").alias("n"), alone.alias("alone")).filter((F.col("n") > 1) & (F.col("alone") == 1)).drop("alone")
    open_cells = skewed_join(kinds, scratch.write(torn, "torn-cells"), key).select("r.*", ((F.col("n") == 1) & (F.col("undecided") == 1)).cast("long").alias("undecided"), "block")
    # rank 3: whole strings, one by one; a place counts once however many cells it came by
    starts = single_starts(texts, scratch.write(open_cells, "open-cells"), p, seed)
    starts = scratch.write(starts.groupBy("block", "string", "id", "th", "at").agg(F.max("undecided").alias("undecided")), "starts")
    scratch.drop("kinds", "torn-cells", "texts")
    twice = scratch.write(starts.groupBy("block", "string").agg(F.count("*").alias("n")).filter(F.col("n") > 1), "twice")
    single = skewed_join(starts.filter(F.col("undecided") == 1), twice, ["block", "string"]).select("id", "th", F.col("at").alias("lo"), (F.col("at") + p.length).alias("hi"))
    out = scratch.write(covered.unionByName(covered_cells).unionByName(single), "intervals")
    scratch.drop("covered", "covered-cells", "open-cells", "starts", "twice")
    return out


LONG_WORD = 512  # longer words are hashed one by one
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True  # the white space between words


class WordHashes:
    """The hashes of a text's words, from slices of the text that end between words."""

    def __init__(self, size: int = 1 << 17, seed: int = 0) -> None:
        self.size, self.prints, self.key = size, Fingerprints(seed), (seed & (1 << 64) - 1).to_bytes(8, "little")

    def _of(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edges = np.flatnonzero(np.diff(np.concatenate([[True], BLANK[data], [True]]).view(np.int8)))
        start, end = edges[::2], edges[1::2]
        long = end - start >= LONG_WORD
        hashes = self.prints.of(self.prints.sums(data), start, np.where(long, start + 1, end))
        for i in np.flatnonzero(long):  # next to none
            hashes[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=self.key).digest(), "little")
        return start, hashes

    def many(self, texts: list[bytes]) -> list[np.ndarray]:
        out, run, total = [], [], 0
        for t in texts:
            if run and total + len(t) > self.size:
                out += self._run(run)
                run, total = [], 0
            if len(t) > self.size:
                out.append(self._long(t))
            else:
                run.append(t)
                total += len(t) + 1
        return out + self._run(run)

    def _run(self, texts: list[bytes]) -> list[np.ndarray]:
        starts, hashes = self._of(np.frombuffer(b"\n".join(texts), np.uint8))
        ends = np.cumsum([len(t) + 1 for t in texts])
        return np.split(hashes, np.searchsorted(starts, ends)[:-1]) if texts else []

    def _long(self, text: bytes) -> np.ndarray:
        data, parts, at = np.frombuffer(text, np.uint8), [], 0
        while at < len(data):
            end = at + self.size
            while end < len(data) and not len(blank := np.flatnonzero(BLANK[data[end : end + self.size]])):
                end += self.size
            end = end + int(blank[0]) if end < len(data) else len(data)
            parts.append(self._of(data[at:end])[1])
            at = end
        return np.concatenate(parts)


WORD_ROWS = "id long, th long, lo long, hi long, block long, span long"
WINDOWS = "id long, th long, weight long, apart boolean, block long, string long"


def word_rows(keyed: DataFrame, p: Passages, seed: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sampler = WordHashes(seed=seed), Sampler(p, seed=seed)
        for b in batches:
            ids, ths = b.column(0).to_numpy(), b.column(1).to_numpy()
            for d, _, lo, hi, block, span in sampler.rows(hashes.many([t.as_py() for t in b.column(2)])):
                yield _arrays([x.split()[0] for x in WORD_ROWS.split(", ")], [ids[d], ths[d], lo, hi, block, span])

    return keyed.mapInArrow(run, WORD_ROWS)


def single_windows(texts: DataFrame, rows: DataFrame, p: Passages, seed: int) -> DataFrame:
    """Every window of the rows, with its fingerprint and that of its anchor's block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, prints = WordHashes(seed=seed), Fingerprints(seed)
        for b in batches:
            for i in range(b.num_rows):
                words = hashes.many([b.column(2)[i].as_py()])[0]
                lo, hi, weight, block, apart = (b.column(k)[i].values.to_numpy(zero_copy_only=False) for k in range(3, 8))
                out: list = []
                for at in _slices(lo, 1 << 16):
                    base = int(lo[at].min())
                    sums = prints.sums(words[base : int(hi[at].max()) + p.length])
                    n = hi[at] - lo[at] + 1
                    s = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[at], n) - base
                    out.append([np.repeat(weight[at], n), np.repeat(apart[at], n), np.repeat(block[at], n), prints.of(sums, s, s + p.length)])
                weight, apart, block, string = (np.concatenate(c) for c in zip(*out, strict=True))
                ids = [pa.array(np.full(len(weight), b.column(k)[i].as_py())) for k in range(2)]
                yield _arrays([x.split()[0] for x in WINDOWS.split(", ")], [*ids, weight, pa.array(apart), block, string])

    joined = texts.join(_per_text(rows, "lo", "hi", "weight", "block", "apart"), ["id", "th"])
    return joined.select("id", "th", "text", "lo", "hi", "weight", "block", "apart").mapInArrow(run, WINDOWS)


def shared_windows(docs: DataFrame, p: Passages, scratch: Scratch, seed: int) -> DataFrame:
    """(id, th, n_shared): how many windows of a document's words some other document has, for documents that have any."""
    keyed, doc = _keyed(docs), F.xxhash64("id", "th")
    rows = scratch.write(word_rows(keyed, p, seed), "words")
    blocks = rows.groupBy("block").agg(F.count("*").alias("n"), F.min(doc).alias("a"), F.max(doc).alias("b")).filter(F.col("a") < F.col("b"))
    rows = scratch.write(skewed_join(rows, scratch.write(blocks.select("block", "n"), "word-blocks"), ["block"]), "live-words")
    scratch.drop("words", "word-blocks")
    classes = rows.groupBy("block", "span").agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "lo", "hi")).alias("r"), (F.min(doc) < F.max(doc)).alias("apart"))
    classes = scratch.write(classes, "word-classes")
    decided = skewed_join(rows, classes.filter("apart").select("block", "span", "n"), ["block", "span"])
    decided = scratch.write(decided.groupBy("id", "th").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("n")), "decided")
    # a class of one document alone: its windows one by one, against one member of each class around an equal block
    torn = classes.groupBy("block").agg(F.bool_and("apart").alias("all"), F.count("*").alias("n")).filter(~F.col("all") & (F.col("n") > 1)).drop("all")
    rows = skewed_join(classes, scratch.write(torn, "word-torn"), ["block"]).select("block", "r.*", F.when(F.col("apart"), 0).otherwise(F.col("n")).alias("weight"), "apart")
    rows = scratch.write(rows, "word-open")
    scratch.drop("live-words", "word-classes", "word-torn")
    windows = scratch.write(single_windows(scratch.write(texts_of(keyed, rows), "word-texts"), rows, p, seed), "windows")
    scratch.drop("word-open", "word-texts")
    twice = windows.groupBy("block", "string").agg(F.count("*").alias("n"), F.min(doc).alias("a"), F.max(doc).alias("b"), F.bool_or("apart").alias("apart"))
    twice = scratch.write(twice.filter((F.col("n") > 1) & (F.col("apart") | (F.col("a") < F.col("b")))).select("block", "string", "n"), "word-twice")
    single = skewed_join(windows.filter(F.col("weight") > 0), twice, ["block", "string"]).groupBy("id", "th").agg(F.sum("weight").alias("n"))
    total = decided.unionByName(single).groupBy("id", "th").agg(F.sum("n").alias("n"))
    # a row that is there m times has counted m times
    again = keyed.groupBy("id", "th").agg(F.count("*").alias("m")).filter(F.col("m") > 1)
    out = scratch.write(total.join(again, ["id", "th"], "left").select("id", "th", F.expr("n div coalesce(m, 1)").alias("n_shared")), "shared")
    scratch.drop("windows", "word-twice", "decided")
    return out


def merged(intervals: DataFrame) -> DataFrame:
    """Overlapping or touching intervals of a text become one."""
    w = Window.partitionBy("id", "th").orderBy("lo", "hi")
    gap = F.coalesce(F.col("lo") > F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int")
    runs = intervals.distinct().withColumn("gap", gap).withColumn("run", F.sum("gap").over(w))
    return runs.groupBy("id", "th", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("run")


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared_windows long, shares_passage boolean"


def remove_repeats(docs: DataFrame, p: SubstringDedup = SubstringDedup(), passages: Passages = Passages(), with_text: bool = True) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; n_shared_windows, how many windows of ``passages``
    words start in it that another document has, too, and shares_passage, whether there are any; and, unless ``with_text``
    is off, kept (binary: cut ranges may split characters)."""
    scratch = Scratch(docs.sparkSession, "substrings")
    seed = secrets.randbits(64)
    per = _per_text(merged(repeated_intervals(docs, p, scratch, seed)), "lo", "hi")
    per = per.join(shared_windows(docs, passages, scratch, seed), ["id", "th"], "full")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text, lo, hi, shared in zip(*(b.column(i) for i in range(5)), strict=True):
                t, spans = text.as_py(), sorted(zip(lo.as_py() or (), hi.as_py() or (), strict=True))
                kept, at = [], 0
                for s, e in spans:
                    kept.append(t[at:s])
                    at = e
                k = b"".join([*kept, t[at:]])
                d, n = doc_id.as_py(), shared.as_py() or 0
                rows.append((None if d == NO_ID else d, len(t), len(t) - len(k), len(spans), hashlib.sha256(k).hexdigest(), n, n > 0, *([k] if with_text else [])))
            types = [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.bool_()] + [pa.binary()] * with_text
            names = [x.split()[0] for x in RESULT.split(", ")] + ["kept"] * with_text
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names=names)

    joined = _keyed(docs).join(per, ["id", "th"], "left").select("id", "text", "lo", "hi", "n_shared")
    return joined.mapInArrow(run, RESULT + (", kept binary" if with_text else ""))
