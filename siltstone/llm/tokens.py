"""Token ids by the tokenizers library, with a bounded cache of pre-tokens.

A byte-level BPE tokenizer splits a text into pre-tokens by a fixed pattern and merges inside each pre-token only, so the
ids of a text are the ids of its pre-tokens one after the other. Common pre-tokens are therefore encoded once per worker,
by the library, and looked up afterwards. Splitting and looking up work on arrays of code points: the pattern's pieces
begin where character classes change, but for the space before a word, the last of several blanks, and contractions; a
pre-token is known by its length and a 128-bit fingerprint. Texts that hold an added token's string, pre-tokens of more
than ``LONGEST`` characters and all other kinds of tokenizer are left to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from siltstone.llm.common import mix

U = np.uint64
# Fixed value: the published splitting pattern of byte-level BPE. Only the classes and contractions below derive from it.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
SEPARATOR, LETTER, NUMBER, OTHER, BLANK = range(5)
LONGEST, LATIN = 256, 0x250
DEFAULT = "byte_bpe_50k.json"
_OPEN: dict[tuple[str, int], CachedTokenizer] = {}


def tokenizer_path(path: str | None) -> str:
    """A tokenizer file: the given path, or the default public one."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(DEFAULT)


def character_classes(n: int) -> np.ndarray:
    """The class of every code point below n, by the engine that knows the pattern's properties."""
    out = np.full(n, OTHER, np.uint8)
    text = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "!" for c in range(n))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for m in regex.finditer(pattern, text):
            out[m.start() : m.end()] = kind
    return out


def piece_starts(cp: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Whether a piece of the pattern begins at each character. Texts end with characters of class SEPARATOR, at least
    three of them at the very end."""
    begins = np.empty(len(cp), bool)
    begins[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    # of the blanks before other characters the last one parts: a space joins what follows, any other stands alone
    last = np.flatnonzero((kind[:-1] == BLANK) & (kind[1:] != BLANK) & (kind[1:] != SEPARATOR))
    begins[last] = True
    begins[last[cp[last] == 32] + 1] = False
    # an apostrophe that begins a piece, before letters: 's 't 'm 'd, 're 've 'll
    at = np.flatnonzero((cp[:-3] == 39) & begins[:-3] & (kind[1:-2] == LETTER))
    x, y = cp[at + 1], cp[at + 2]
    one = at[(x == ord("s")) | (x == ord("t")) | (x == ord("m")) | (x == ord("d"))]
    two = at[(((x == ord("r")) | (x == ord("v"))) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l")))]
    begins[one + 1], begins[one + 2], begins[two + 1], begins[two + 3] = False, True, False, True
    return begins


class PieceTable:
    """An open-addressing table of pieces: two fingerprints, and where a piece's ids are."""

    def __init__(self, max_entries: int) -> None:
        self.max_entries, self.n, self.n_ids = max_entries, 0, 0
        self.most_bits = max(10, (3 * max_entries // 2).bit_length())  # never more than two thirds full
        self.bits = min(14, self.most_bits)  # doubled as pieces come
        self.slots = np.zeros((1 << self.bits, 3), U)  # fingerprint, fingerprint, place << 16 | number of ids (0: free)
        self.ids = np.empty(4 * max_entries + 1024, np.uint32)

    def _at(self, a: np.ndarray) -> np.ndarray:
        return (a >> U(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """place << 16 | number of each piece; 0 for the unknown."""
        slot = self._at(a)
        rows = self.slots[slot]
        out = np.where((rows[:, 0] == a) & (rows[:, 1] == b), rows[:, 2], U(0))
        left = np.flatnonzero((out == 0) & (rows[:, 2] != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            rows = self.slots[slot[left]]
            hit = (rows[:, 0] == a[left]) & (rows[:, 1] == b[left])
            out[left[hit]] = rows[hit, 2]
            left = left[~hit & (rows[:, 2] != 0)]
        return out

    def add(self, a: np.ndarray, b: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """New pieces, none twice. When the table is full, the first half stays: the first seen are the common ones."""
        if self.n + len(a) > self.max_entries or self.n_ids + len(ids) > len(self.ids):
            self._halve()
        if len(a) > self.max_entries // 2 or len(ids) > len(self.ids) // 3:
            return  # more than the table is made for: found again by the library
        self._widen(self.n + len(a))
        place = self.n_ids + np.cumsum(counts) - counts
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.n, self.n_ids = self.n + len(a), self.n_ids + len(ids)
        self._insert(np.stack([a, b, (place.astype(U) << U(16)) | counts.astype(U)], axis=1))

    def _insert(self, rows: np.ndarray) -> None:
        slot = self._at(rows[:, 0])
        while len(rows):
            free = np.flatnonzero(self.slots[slot, 2] == 0)
            self.slots[slot[free]] = rows[free]  # of several for a slot the last one is there
            out = (self.slots[slot] != rows).any(axis=1)
            rows, slot = rows[out], (slot[out] + 1) & ((1 << self.bits) - 1)

    def _widen(self, n: int) -> None:
        """Makes room for so many pieces."""
        bits = min(self.most_bits, max(self.bits, (3 * n // 2).bit_length()))
        if bits > self.bits:
            rows = self.slots[self.slots[:, 2] != 0]
            self.bits, self.slots = bits, np.zeros((1 << bits, 3), U)
            self._insert(rows)

    def _halve(self) -> None:
        rows = self.slots[self.slots[:, 2] != 0]
        rows = rows[np.argsort(rows[:, 2])][: len(rows) // 2]
        end = int((rows[-1, 2] >> U(16)) + (rows[-1, 2] & U(0xFFFF))) if len(rows) else 0
        if end > len(self.ids) // 2:
            rows, end = rows[:0], 0
        self.slots[:] = 0
        self.n, self.n_ids = len(rows), end
        self._insert(rows)


class CachedTokenizer:
    """encode(text): the text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, max_entries: int = 1_200_000, chars: int = 1 << 17) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.chars = Tokenizer.from_file(path), chars
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.splits = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and spec["model"].get("type") == "BPE" and not spec["model"].get("dropout")
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True  # how byte-level BPE writes a space
        if self.splits:
            self.table, self.kinds = PieceTable(max_entries), character_classes(LATIN)
            self._grow(chars + 1024)

    def _grow(self, n: int) -> None:
        """Powers of two odd numbers, and their inverses, for running sums over so many characters."""
        def powers(x: int) -> np.ndarray:
            return np.cumprod(np.concatenate([[U(1)], np.full(n, x, U)]), dtype=U)

        bases = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
        self.powers, self.inverse = [powers(x) for x in bases], [powers(pow(x, -1, 1 << 64)) for x in bases]
        self.values = [mix(np.arange(LATIN, dtype=U) + U(k)) for k in (101, 211)]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        if not self.splits:
            return self._whole(texts)
        out: list[bytes] = [b""] * len(texts)
        run, total = [], 0
        for i, t in enumerate(texts):
            if any(a in t for a in self.added):
                out[i] = self._whole([t])[0]
            elif len(t) > self.chars:
                out[i] = b"".join(x for part in _parts(t, self.chars) for x in (self._run([part]) if len(part) <= 4 * self.chars else self._whole([part])))
            elif t:
                if run and total + len(t) >= self.chars:
                    self._put(out, run, texts)
                    run, total = [], 0
                run.append(i)
                total += len(t) + 1
        self._put(out, run, texts)
        return out

    def _put(self, out: list[bytes], run: list[int], texts: list[str]) -> None:
        for i, ids in zip(run, self._run([texts[i] for i in run]), strict=True):
            out[i] = ids

    def _sums(self, cp: np.ndarray, latin: bool) -> list[np.ndarray]:
        out = []
        for k in range(2):
            values = self.values[k][cp] if latin else mix(cp.astype(U) + U((101, 211)[k]))
            sums = np.zeros(len(cp) + 1, U)
            np.cumsum(values * self.powers[k][: len(cp)], dtype=U, out=sums[1:])
            out.append(sums)
        return out

    def _run(self, texts: list[str]) -> list[bytes]:
        """The ids of texts that are not empty, a bounded number of characters together."""
        if not texts:
            return []
        joined = "\0".join(texts) + "\0\0\0"
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(cp) >= len(self.powers[0]):
            self._grow(len(cp))
        latin = int(cp.max()) < LATIN
        if not latin and len(self.kinds) == LATIN:
            self.kinds = character_classes(0x110000)
        kind = self.kinds[cp]
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        kind[ends], kind[-2:] = SEPARATOR, SEPARATOR
        edges = np.flatnonzero(piece_starts(cp, kind))
        word = np.flatnonzero(kind[edges[:-1]] != SEPARATOR)
        start, end = edges[word], edges[word + 1]
        a, b = (mix((s[end] - s[start]) * inv[start] + (end - start).astype(U)) for s, inv in zip(self._sums(cp, latin), self.inverse, strict=True))
        found = self.table.find(a, b)
        extra: dict[int, np.ndarray] = {}
        if len(new := np.flatnonzero(found == 0)):
            long = end[new] - start[new] > LONGEST
            for i in new[long]:
                extra[int(i)] = np.frombuffer(self._whole([joined[start[i] : end[i]]])[0], "<u4")
            new = new[~long]
            new = new[np.unique(a[new], return_index=True)[1]]
            counts, ids = self._learn(joined, cp, kind, start[new], end[new])
            self.table.add(a[new], b[new], counts, ids)
            missing = np.flatnonzero(found == 0)
            found[missing] = self.table.find(a[missing], b[missing])
            for i in missing[found[missing] == 0]:  # long ones, and what the table had no room for
                if int(i) not in extra:
                    extra[int(i)] = np.frombuffer(self._whole([joined[start[i] : end[i]]])[0], "<u4")
        n = (found & U(0xFFFF)).astype(np.int64)
        place = (found >> U(16)).astype(np.int64)
        if extra:
            for i, ids in extra.items():
                n[i] = len(ids)
        upto = np.cumsum(n)
        ids = self.table.ids[np.repeat(place - (upto - n), n) + np.arange(upto[-1])] if not extra else self._with_extra(place, n, upto, extra)
        cuts = np.concatenate([[0], upto])[np.searchsorted(start, ends)]
        data = ids.astype("<u4", copy=False).tobytes()
        return [data[4 * i : 4 * j] for i, j in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]

    def _with_extra(self, place: np.ndarray, n: np.ndarray, upto: np.ndarray, extra: dict[int, np.ndarray]) -> np.ndarray:
        known = n.copy()
        known[list(extra)] = 0
        out, at = np.empty(int(upto[-1]), np.uint32), np.repeat(upto - n, known) + np.arange(known.sum()) - np.repeat(np.cumsum(known) - known, known)
        out[at] = self.table.ids[np.repeat(place, known) + at - np.repeat(upto - n, known)]
        for i, ids in extra.items():
            out[upto[i] - n[i] : upto[i]] = ids
        return out

    def _learn(self, joined: str, cp: np.ndarray, kind: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each of the pieces, and all their ids one after the other."""
        # letters after a space, one piece after the other, split into the same pieces again, so one call encodes them
        # all; the ids that begin with the space show where each starts
        n = end - start
        spaced = (cp[start] == 32) & (n > 1) & (kind[np.minimum(start + 1, end - 1)] == LETTER)
        which = np.flatnonzero(spaced)
        counts, parts = np.zeros(len(start), np.int64), [b""] * len(start)
        if len(which):
            m = n[which]
            at = np.repeat(start[which] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            text = cp[at].tobytes().decode("utf-32-le", "surrogatepass")
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
            first = np.flatnonzero(self.begins[ids])
            if len(first) == len(which):
                if len(which) == len(start):
                    return np.diff(np.append(first, len(ids))), ids
                data, cuts = ids.tobytes(), (4 * first).tolist()
                for i, lo, hi in zip(which.tolist(), cuts, [*cuts[1:], len(data)], strict=True):
                    parts[i] = data[lo:hi]
            else:
                spaced[:] = False
        rest = np.flatnonzero(~spaced).tolist()
        for i, b in zip(rest, self._whole([joined[start[i] : end[i]] for i in rest]), strict=True):
            parts[i] = b
        counts[:] = [len(b) // 4 for b in parts]
        return counts, np.frombuffer(b"".join(parts), "<u4")


_BETWEEN = re.compile("[A-Za-z0-9] [A-Za-z0-9]")


def _parts(text: str, size: int) -> Iterator[str]:
    """A long text in parts that begin with the space before a word, where a piece begins whatever precedes."""
    at = 0
    while at < len(text):
        m = _BETWEEN.search(text, at + size)
        end = m.start() + 1 if m else len(text)
        yield text[at:end]
        at = end


def open_tokenizer(path: str | None, max_entries: int = 1_200_000) -> CachedTokenizer:
    """The worker's tokenizer for a path; loaded once per worker."""
    key = (tokenizer_path(path), max_entries)
    if key not in _OPEN:
        _OPEN[key] = CachedTokenizer(*key)
    return _OPEN[key]


def in_groups(batch: pa.RecordBatch, size: int = 1 << 18) -> Iterator[tuple[list, list[str]]]:
    """(doc_ids, texts) of a batch (doc_id, text), about so many bytes at a time, so that one call's lists stay small."""
    ends, lo = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)), 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size)))
        yield batch.column(0).slice(lo, hi - lo).to_pylist(), batch.column(1).slice(lo, hi - lo).to_pylist()
        lo = hi
