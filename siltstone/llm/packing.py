"""Packing by vector bins: a dot-product heuristic under limits on tokens, segments and loss-bearing tokens.

An example is a run of token ids with a number of loss-bearing tokens; a sequence takes pieces while all three limits
hold. The sequence that is being filled takes, of all waiting pieces that fit, the one whose demand vector has the
largest dot product with the room that is left (both in shares of the limits), so pieces that use much of what is
plentiful come first. When nothing fits whole, the piece with the largest product is cut to fill the room. Sequences
that cannot be filled, for want of segments, loss or pieces, are trimmed to a power of two, the rest going back.

Each task packs the documents of its own partition in one pass: a pool of bounded size waits in memory, nothing is
shuffled, and no key matters, so hot sources and copies spread like other rows. What doesn't fill a sequence is carried
along in the pool; at the end of a partition the rest forms sequences whose lengths are powers of two.

Defined edge cases: null and empty texts hold the end id only; rows with a null or repeated doc_id are packed like others
(pieces carry the doc_id as it is); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from siltstone.llm.common import text_or_empty
from siltstone.llm.tokens import in_groups, open_tokenizer


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 64
    loss: int = 2048
    pool: int = 512


@dataclass
class Piece:
    """Ids [start, start + length) of an example; the first ``masked`` of the example bear no loss."""

    doc_id: int | None
    ids: bytes
    doc_tokens: int
    start: int
    length: int
    masked: int

    @property
    def loss(self) -> int:
        return self.length - max(0, min(self.length, self.masked - self.start))

    def split(self, n: int) -> tuple[Piece, Piece]:
        a, b = (self.doc_id, self.ids, self.doc_tokens), self.masked
        return Piece(*a, self.start, n, b), Piece(*a, self.start + n, self.length - n, b)

    def head_within(self, tokens: int, loss: int) -> int:
        """The longest head within both limits."""
        free = max(0, min(self.length, self.masked - self.start))
        return min(self.length, tokens, free + loss)


class VectorPacker:
    """Takes examples, gives full sequences: lists of pieces."""

    def __init__(self, limits: Limits) -> None:
        self.limits, self.top = limits, np.array([limits.tokens, limits.segments, limits.loss], dtype=float)
        self.pieces: list[Piece | None] = []
        self.need = np.empty((0, 3))
        self.free: list[int] = []
        self.waiting = 0

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        while (n := piece.head_within(self.limits.tokens, self.limits.loss)) == self.limits.tokens:
            if n == piece.length:
                yield [piece]
                return
            full, piece = piece.split(n)
            yield [full]
        if piece.length:
            self._wait(piece)
        while self.waiting > self.limits.pool:
            yield self._fill()

    def _wait(self, piece: Piece) -> None:
        if not self.free:
            grown = max(64, len(self.pieces))
            self.free = list(range(len(self.pieces) + grown - 1, len(self.pieces) - 1, -1))
            self.pieces += [None] * grown
            self.need = np.vstack([self.need, np.zeros((grown, 3))])
        i = self.free.pop()
        self.pieces[i], self.need[i] = piece, (piece.length, 1, piece.loss)
        self.waiting += 1

    def _take(self, i: int) -> Piece:
        piece = self.pieces[i]
        self.pieces[i], self.need[i] = None, 0
        self.free.append(i)
        self.waiting -= 1
        return piece

    def _fill(self) -> list[Piece]:
        room, taken = self.top.copy(), []
        weigh = 1 / self.top**2
        while self.waiting and room.min() > 0:
            product = self.need @ (room * weigh)  # free places have no need and never win
            fits = np.where((self.need <= room).all(axis=1), product, 0)
            i = int(fits.argmax())
            if fits[i] > 0:
                piece = self._take(i)
            else:  # nothing fits whole: cut what would fit best
                i = int(product.argmax())
                n = self.pieces[i].head_within(int(room[0]), int(room[2]))
                if n <= 0:
                    break
                piece, rest = self._take(i).split(n)
                self._wait(rest)
            taken.append(piece)
            room -= (piece.length, 1, piece.loss)
        total = sum(p.length for p in taken)
        return taken if total == self.limits.tokens else self._trim(taken, total)

    def _trim(self, taken: list[Piece], total: int) -> list[Piece]:
        """Gives back the ends of the last pieces, down to a power of two."""
        over = total - (1 << (total.bit_length() - 1))
        while over:
            piece = taken.pop()
            if piece.length > over:
                piece, rest = piece.split(piece.length - over)
                taken.append(piece)
                self._wait(rest)
                over = 0
            else:
                self._wait(piece)
                over -= piece.length
        return taken

    def rest(self) -> Iterator[list[Piece]]:
        while self.waiting:
            yield self._fill()


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, ids binary"
_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")] + [("ids", pa.binary())])


def _rows(sequences: Iterable[list[Piece]], part: int, with_ids: bool, batch: int = 4096) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for k, pieces in enumerate(sequences):
        offset = 0
        for p in pieces:
            ids = p.ids[4 * p.start : 4 * (p.start + p.length)]
            rows.append((p.doc_id, p.start, p.length, zlib.crc32(ids), p.doc_tokens, (part << 32) + k, offset, p.loss, ids if with_ids else None))
            offset += p.length
        if len(rows) >= batch:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, limits: Limits = Limits(), with_ids: bool = True) -> DataFrame:
    """Packs whole documents; per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens
    and, unless ``with_ids`` is off, its ids as little-endian unsigned 32-bit integers. A document's first id bears no loss."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, packer = open_tokenizer(tokenizer), np.array([end_id], dtype="<u4").tobytes(), VectorPacker(limits)

        def sequences() -> Iterator[list[Piece]]:
            for b in batches:
                for doc_ids, texts in in_groups(b):
                    for doc_id, ids in zip(doc_ids, encoder.encode_many(texts), strict=True):
                        n = len(ids) // 4 + 1
                        yield from packer.add(Piece(doc_id, ids + end, n, 0, n, 1))
            yield from packer.rest()

        yield from _rows(sequences(), TaskContext.get().partitionId(), with_ids)

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, PIECES)


def pack_examples(examples: DataFrame, limits: Limits = Limits(), with_ids: bool = True) -> DataFrame:
    """Packs ready examples (doc_id long, ids binary, masked int: how many leading ids bear no loss), as instruction data
    has them; null ids count as none, a null mask as 0. The result is that of :func:`pack_documents`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = VectorPacker(limits)

        def sequences() -> Iterator[list[Piece]]:
            for b in batches:
                for doc_id, ids, masked in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    n = len(ids or b"") // 4
                    if n:
                        yield from packer.add(Piece(doc_id, ids, n, 0, n, masked or 0))
            yield from packer.rest()

        yield from _rows(sequences(), TaskContext.get().partitionId(), with_ids)

    return examples.select("doc_id", "ids", "masked").mapInArrow(run, PIECES)
