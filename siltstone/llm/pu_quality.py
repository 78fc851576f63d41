"""Quality classifier by positive-unlabelled learning: the non-negative unbiased risk of trusted positives and unlabelled text.

A linear model over hashed byte pairs and a few shape statistics minimises
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` with the logistic loss, where R_p averages over trusted positives
and R_u over unlabelled documents; when the bracket falls below zero, its gradient is followed the other way, as published
for non-negative PU learning. The class prior is the share of label 1 among the labelled rows that may be learnt from.
The logistic loss makes the score an estimate of the probability that a document's label is 1.

Fitting takes bounded samples (``max_positives``, ``max_unlabelled`` doc_ids, those of the smallest hashes; rows that share
a doc_id count once, by their smallest text), so the driver holds a matrix of fixed size at most; scoring covers every
document, whole texts, in Arrow batches.

Defined edge cases: null and empty texts have features of their own and get a score; documents without a label, language
or source are scored like others; repeated label rows for a document count once, a document labelled both ways is no
positive; without any positive or unlabelled row the score is the prior, or 0.5 where there is no label; an empty table
gives an empty result; labels, lang, source and doc_id are never features.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch


@dataclass(frozen=True)
class PuQuality:
    pairs: int = 1024
    max_positives: int = 6_000
    max_unlabelled: int = 6_000
    steps: int = 300
    rate: float = 0.3
    decay: float = 1e-6
    threshold: float = 0.7


N_SHAPE = 11
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>{}[]\\/=+~^_@")] = True
_BYTES = np.arange(256)
_KINDS = np.stack([(_BYTES >= 65) & (_BYTES <= 90), (_BYTES >= 97) & (_BYTES <= 122), (_BYTES >= 48) & (_BYTES <= 57), _BYTES <= 32, _SYMBOLS, _BYTES >= 128]).astype(float)


def features(text: bytes | None, pairs: int) -> np.ndarray:
    """Square roots of the shares of hashed byte pairs, then shape statistics, each between 0 and about 1."""
    text = text or b""
    b, out = np.frombuffer(text, np.uint8), np.zeros(pairs + N_SHAPE, np.float32)
    if len(b) > 1:
        slot = ((b[:-1].astype(np.uint32) * 257 + b[1:]) * np.uint32(2654435761)) >> np.uint32(32 - (pairs - 1).bit_length())
        out[:pairs] = np.sqrt(np.bincount(slot, minlength=pairs)[:pairs] / (len(b) - 1))
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    out[pairs : pairs + 6] = _KINDS @ np.bincount(b, minlength=256) / max(1, len(b))
    out[pairs + 6 :] = (np.log1p(len(words)) / 10, len(set(words)) / max(1, len(words)), 1 - len(set(lines)) / max(1, len(lines)), not words, sum(map(eq, words, words[1:])) / max(1, len(words)))
    return out


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x.astype(float) @ self.weights + self.bias, -30, 30)))


def risk(out: np.ndarray, sign: int) -> float:
    """Mean logistic loss of outputs against one class."""
    return float(np.logaddexp(0, -sign * out).mean())


def gradient(w: np.ndarray, b: float, positive: np.ndarray, unlabelled: np.ndarray, prior: float, decay: float) -> np.ndarray:
    """The gradient of the risk by weights and bias; where the bracket is below zero, that of its negative alone."""
    slope = lambda out, sign: -sign / (1 + np.exp(np.clip(sign * out, -30, 30)))
    op, ou = positive @ w + b, unlabelled @ w + b
    gp, gu = prior * slope(op, 1) / len(op), slope(ou, -1) / len(ou)
    gn = -prior * slope(op, -1) / len(op)
    gp, gu = (gp + gn, gu) if risk(ou, -1) >= prior * risk(op, -1) else (-gn, -gu)
    return np.concatenate([positive.T @ gp + unlabelled.T @ gu + decay * w, [gp.sum() + gu.sum()]])


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, p: PuQuality = PuQuality()) -> Model:
    """Minimises the non-negative risk by Adam over full batches."""
    w, b = np.zeros(positive.shape[1]), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, p.steps + 1):
        g = gradient(w, b, positive, unlabelled, prior, p.decay)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = p.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model(w, b, prior)


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches a few rows at a time, so that a matrix of features stays small whatever the batch size is."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def held_out(doc_id="doc_id"):
    """Rows that are never learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def smallest_hashes(ids: DataFrame, n: int, k: int) -> DataFrame:
    """The k ids (doc_id) of the smallest hashes, of n rows. Where rows are many, only those in the lowest part of the
    range that holds about twice as many as needed are sorted; should rows repeat so much that it holds too few, all are."""
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    if n > 4 * k:
        low = ids.filter(place < int((1 << 63) * (2 * k / n))).distinct()
        if low.count() >= k:
            ids = low
    return ids.distinct().orderBy(place, "doc_id").limit(k)


def train(docs: DataFrame, labels: DataFrame, p: PuQuality = PuQuality()) -> Model:
    """Fits on bounded samples of labelled positives and unlabelled documents, none of them held out."""
    scratch = Scratch(docs.sparkSession, "pu")
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("q"))
    n, ones = known.agg(F.count("*"), F.coalesce(F.sum("q"), F.lit(0))).head()
    prior = min(0.99, max(0.01, ones / n)) if n else 0.5
    known = known.filter("q = 1").select("doc_id")
    others = docs.filter(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id")
    chosen = smallest_hashes(known, int(ones), p.max_positives).withColumn("positive", F.lit(True)).unionByName(
        smallest_hashes(others, others.count(), p.max_unlabelled).withColumn("positive", F.lit(False))
    )  # at most max_positives + max_unlabelled ids
    width = p.pairs

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            x = [features(t.as_py(), width).astype(np.float16).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary())], names=["positive", "x"])

    chosen = scratch.write(chosen, "chosen")
    drawn = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    drawn = drawn.groupBy("positive", "doc_id").agg(F.min("text").alias("text")).select("positive", F.col("text").cast("binary").alias("text"))
    rows = scratch.write(drawn.mapInArrow(run, "positive boolean, x binary"), "drawn").toPandas()
    matrix = lambda kind: np.array([np.frombuffer(x, np.float16) for x in rows.x[rows.positive == kind]], np.float32).reshape(-1, width + N_SHAPE)
    positive, unlabelled = matrix(True), matrix(False)
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(width + N_SHAPE), float(np.log(prior / (1 - prior))), prior)
    return fit(positive, unlabelled, prior, p)


SCORED = "doc_id long, score double"


def score_documents(docs: DataFrame, model: Model, p: PuQuality = PuQuality()) -> DataFrame:
    """Per document: doc_id, score."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            x = np.array([features(t.as_py(), p.pairs) for t in b.column(1)]).reshape(-1, p.pairs + N_SHAPE)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(model.scores(x))], names=["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, SCORED)


def classify(docs: DataFrame, labels: DataFrame, p: PuQuality = PuQuality()) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 if the score reaches the threshold)."""
    scored = score_documents(docs, train(docs, labels, p), p)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= p.threshold).cast("int").alias("predicted"))
