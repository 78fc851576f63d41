"""Token-id files of independent zstandard frames with a trailing seek table.

A file is a sequence of zstandard frames and ends with the published seekable layout: a skippable frame that lists every
frame's compressed size, decompressed size and checksum (the low 32 bits of XXH64 of the decompressed bytes), then the
number of frames, a descriptor byte and the magic number. Any zstandard decoder reads such a file from front to back.
Data frames hold whole documents' ids as little-endian unsigned 32-bit integers, documents in ascending doc_id order; a
document beyond ``max_frame`` bytes has frames of its own, as many as it takes.
Index frames follow, with each document's id and number of tokens, and a skippable directory frame that says how many of
the frames are index frames. A reader fetches the table and the index, then only the frames of the documents asked for.

Writing: one file for each partition, sorted by doc_id, under a name of each attempt's own. The manifest names the files
of the attempts that ended; what a lost attempt has left is in no manifest and never read. Where the input's partitions already hold
ranges of doc_id that don't overlap, as tables written in order do, they are taken as they are; otherwise documents are
range-partitioned first. The files' own ranges are checked once more after writing.

Defined edge cases: null and empty texts hold the end id only; a null doc_id sorts first; rows that share a doc_id follow
each other in order of text; an empty table gives no documents; further columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, text_or_empty
from siltstone.llm.tokens import in_groups, open_tokenizer

# Fixed values of the published seekable format: magic numbers, and the descriptor bit for checksums.
SKIPPABLE_SEEK, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
#: Our directory frame is another of the sixteen skippable kinds.
SKIPPABLE_DIRECTORY = 0x184D2A50
INDEX = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("n_tokens", "<u4")])
MANIFEST = "part int, path string, n_docs long, n_tokens long, n_frames long, n_bytes long, first_id long, last_id long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI, on the driver or an executor."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class TokenFileWriter:
    """Appends documents; a data frame closes at the first document end at or past ``frame_tokens``."""

    def __init__(self, sink, frame_tokens: int = 16_384, level: int = 1, index_rows: int = 65_536, max_frame: int = 1 << 28) -> None:
        self.sink, self.frame_tokens, self.index_rows, self.max_frame = sink, frame_tokens, index_rows, max_frame
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.pending: list[bytes] = []
        self.size, self.table, self.docs, self.n_tokens, self.n_bytes = 0, [], [], 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id or 0, doc_id is not None, len(ids) // 4))
        if len(ids) > self.max_frame:
            self._flush()
            for i in range(0, len(ids), self.max_frame):
                self._frame(ids[i : i + self.max_frame])
            self.n_tokens += len(ids) // 4
            return
        self.pending.append(ids)
        self.size += len(ids)
        if self.size >= 4 * self.frame_tokens:
            self._flush()

    def _write(self, data: bytes) -> None:
        self.sink.write(data)
        self.n_bytes += len(data)

    def _frame(self, data: bytes) -> None:
        packed = self.zstd.compress(data)
        self._write(packed)
        self.table.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def _flush(self) -> None:
        if self.pending:
            self._frame(b"".join(self.pending))
            self.n_tokens += self.size // 4
            self.pending, self.size = [], 0

    def close(self) -> None:
        self._flush()
        n_data, index = len(self.table), np.array(self.docs, dtype=INDEX)
        for i in range(0, len(index), self.index_rows):
            self._frame(index[i : i + self.index_rows].tobytes())
        self._write(struct.pack("<IIII", SKIPPABLE_DIRECTORY, 8, n_data, len(index)))
        seek = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE)
        self._write(struct.pack("<II", SKIPPABLE_SEEK, len(seek)) + seek)


class TokenFile:
    """Random access to the documents of one file; only the frames asked for are fetched and decompressed."""

    def __init__(self, source) -> None:
        self.source, size = source, source.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or not flags & CHECKSUMS:
            raise ValueError("not a seekable token file")
        head = size - 9 - 12 * n - 8
        if struct.unpack("<II", self._at(head, 8)) != (SKIPPABLE_SEEK, 12 * n + 9):
            raise ValueError("damaged seek table")
        self.table = np.frombuffer(self._at(head + 8, 12 * n), dtype="<u4").reshape(n, 3)
        kind, length, self.n_data, n_docs = struct.unpack("<IIII", self._at(head - 16, 16))
        if (kind, length) != (SKIPPABLE_DIRECTORY, 8):
            raise ValueError("damaged directory")
        self.offsets = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        self.index = np.concatenate([np.frombuffer(self.frame(i), dtype=INDEX) for i in range(self.n_data, n)] or [np.empty(0, INDEX)])
        if len(self.index) != n_docs:
            raise ValueError("damaged index")
        self.starts = np.concatenate([[0], np.cumsum(self.index["n_tokens"], dtype=np.int64)])
        self.frame_starts = np.concatenate([[0], np.cumsum(self.table[: self.n_data, 1] // 4, dtype=np.int64)])
        self.frames_read = 0

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(int(offset))
        return self.source.read(int(n))

    def frame(self, i: int) -> bytes:
        """A frame's decompressed bytes; raises if its checksum doesn't hold."""
        data = zstandard.ZstdDecompressor().decompress(self._at(self.offsets[i], self.table[i, 0]), max_output_size=int(self.table[i, 1]))
        if len(data) != self.table[i, 1] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.table[i, 2]:
            raise ValueError(f"frame {i}: checksum mismatch")
        return data

    def ids(self, row: int) -> np.ndarray:
        """The ids of the file's row-th document."""
        a, b = int(self.starts[row]), int(self.starts[row + 1])
        k = int(np.searchsorted(self.frame_starts, a, side="right")) - 1
        at, parts = a - int(self.frame_starts[k]), []
        while not parts or self.frame_starts[k] < b:
            parts.append(np.frombuffer(self.frame(k), dtype="<u4"))
            self.frames_read += 1
            k += 1
        return np.concatenate(parts)[at : at + b - a]

    def rows_of(self, doc_id: int) -> range:
        """The rows with a doc_id; rows with a null doc_id come first and are not found by it."""
        nulls = int((self.index["known"] == 0).sum())
        known = self.index["doc_id"][nulls:]
        return range(nulls + int(np.searchsorted(known, doc_id, side="left")), nulls + int(np.searchsorted(known, doc_id, side="right")))

    def documents(self) -> Iterator[tuple[int | None, bytes]]:
        """All documents in order, a frame at a time."""
        k, data, at = -1, b"", 0
        for doc_id, known, n in self.index.tolist():
            parts, left = [], 4 * n
            while left:
                if at == len(data):
                    k, at = k + 1, 0
                    data = self.frame(k)
                parts.append(data[at : at + left])
                at += len(parts[-1])
                left -= len(parts[-1])
            yield (doc_id if known else None), b"".join(parts)


def _writer(folder: str, tokenizer: str | None, end_id: int, frame_tokens: int, level: int):
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = open_tokenizer(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        fs, root = filesystem(folder)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.tokens"
        out = None
        for batch in batches:
            for doc_ids, texts in in_groups(batch):
                for doc_id, ids in zip(doc_ids, encoder.encode_many(texts), strict=True):
                    if out is None:
                        fs.create_dir(root, recursive=True)
                        out = TokenFileWriter(fs.open_output_stream(f"{root}/{name}"), frame_tokens, level)
                    out.add(doc_id, ids + end)
        if out is not None:
            out.close()
            out.sink.close()
            ids = [x[0] if x[1] else None for x in (out.docs[0], out.docs[-1])]
            row = (part, f"{folder}/{name}", len(out.docs), out.n_tokens, len(out.table), out.n_bytes, *ids)
            types = (pa.int32(), pa.string(), *[pa.int64()] * 6)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=[x.split()[0] for x in MANIFEST.split(", ")])

    return write


def _overlap(ranges: DataFrame) -> bool:
    """Whether any two of the ranges (first_id, last_id; null below all) have more than nothing in common; one row a file."""
    low = lambda c: F.struct(F.col(c).isNotNull().alias("known"), F.coalesce(F.col(c), F.lit(0)).alias("id"))
    r = ranges.select(low("first_id").alias("a"), low("last_id").alias("b"))
    return not r.withColumn("before", F.max("b").over(Window.orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))).filter(F.col("a") <= F.col("before")).isEmpty()


def write_token_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, folder: str | None = None, frame_tokens: int = 16_384, level: int = 1) -> DataFrame:
    """Writes ``docs`` and returns the manifest: part, path, n_docs, n_tokens, n_frames, n_bytes, first_id, last_id, start
    (ids in earlier files).

    ``folder`` is a URI that driver and executors share; by default a new one below spark.checkpoint.dir.
    """
    scratch = Scratch(docs.sparkSession, "tokens")
    folder = folder or scratch.path("files")
    folder = folder if ":/" in folder else f"file://{folder}"
    docs = docs.select("doc_id", text_or_empty().alias("text"))
    ranges = docs.groupBy(F.spark_partition_id().alias("part")).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("last_id"), F.count_if(F.col("doc_id").isNull()).alias("nulls"))
    ordered = not _overlap(scratch.write(ranges.select(F.when(F.col("nulls") == 0, F.col("lo")).alias("first_id"), "last_id"), "ranges"))
    while True:
        dealt = docs if ordered else docs.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("text"))
        dealt = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
        to = f"{folder}/{'ordered' if ordered else 'dealt'}"
        manifest = scratch.write(dealt.mapInArrow(_writer(to, tokenizer, end_id, frame_tokens, level), MANIFEST), "manifest")
        if not ordered or not _overlap(manifest):
            break
        ordered = False
    order = ("part",) if not ordered else (F.col("first_id").asc_nulls_first(),)
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return scratch.write(manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long")), "starts")


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32; every frame's checksum is verified."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, name = filesystem(path)
                with fs.open_input_file(name) as source:
                    rows: list = []
                    for doc_id, ids in TokenFile(source).documents():
                        rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
                        start += len(ids) // 4
                        if len(rows) >= 10_000:
                            yield _documents(rows)
                            rows = []
                    yield _documents(rows)

    n = max(1, manifest.count())
    return manifest.select("path", "start").repartition(n).mapInArrow(read, DOCUMENTS)


def _documents(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])
