"""Secret scans: fixed patterns, and character Markov models for tokens that no pattern knows.

Two character Markov models of order one are trained from labelled samples, one of random strings and one of ordinary
identifiers. A candidate, a long run of key characters of which enough are different, is a secret when its log-likelihood
ratio per character exceeds a threshold, which is higher for runs without a digit, as long words are. The models and the
samples are small and of fixed size; each task gets a copy.

Spans are (kind, start, end) in code points, end exclusive: ``assign``, ``access`` and ``hex`` by pattern, leftmost and
non-overlapping per kind, and ``markov`` for candidates that overlap none of them.

Defined edge cases: a null text has no findings and stays null when redacted; an empty table gives an empty result; rows
are judged one by one, so repeated rows agree; further columns pass through :func:`redact_secrets` unchanged.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "markov")
FINDINGS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORD = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
DIGIT = re.compile("[0-9]")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
PLACE = {c: i for i, c in enumerate(ALPHABET)}

# Common parts of identifiers.
PARTS = (
    "get set add remove update delete create find list load save read write open close start stop run test build parse format "
    "user name file path data value key index count size item node tree list map table row column field type class object "
    "request response client server session config option default error message event handler callback service manager "
    "controller model view page image button color width height length offset buffer stream reader writer string number "
    "date time first last next previous current total max min average version release download upload document section "
    "account address customer order product invoice payment report summary chapter article category language country region"
).split()


@dataclass(frozen=True)
class Markov:
    """Log-likelihood ratios of first characters and of transitions, random over ordinary."""

    first: np.ndarray
    step: np.ndarray

    def score(self, s: str) -> float:
        """Log-likelihood ratio per character, in nats."""
        i = [PLACE[c] for c in s]
        return (float(self.first[i[0]]) + float(self.step[i[:-1], i[1:]].sum())) / len(i)


def labelled_samples(n: int = 4000, seed: int = 7) -> list[tuple[str, int]]:
    """n random strings (label 1) and n ordinary identifiers (label 0), by rule from a seed."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        pool = (ALPHABET[:62], ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62], "0123456789abcdef")[i % 6]
        out.append(("".join(r.choice(pool) for _ in range(r.randint(20, 64))), 1))
        words = [r.choice(PARTS) for _ in range(r.randint(3, 7))]
        number = str(r.choice((r.randint(0, 9), r.randint(0, 99), r.randint(1990, 2030), r.randint(0, 10**6))))
        style = i % 5
        name = ("_".join(words), "-".join(words), words[0] + "".join(w.title() for w in words[1:]), "/".join(words), "_".join(words).upper())[style]
        joint = ("_", "-", "", "/", "_")[style]
        out.append(((name + joint + number, number + joint + name, name)[r.randrange(3)], 0))
    return out


def train(samples: Iterable[tuple[str, int]], smoothing: float = 0.5) -> Markov:
    """Both models' smoothed transition frequencies, as log-likelihood ratios."""
    n = len(ALPHABET)
    first, step = np.full((2, n), smoothing), np.full((2, n, n), smoothing)
    for s, label in samples:
        i = [ALPHABET.index(c) for c in s if c in ALPHABET]
        if i:
            first[label, i[0]] += 1
            np.add.at(step[label], (i[:-1], i[1:]), 1)
    first, step = np.log(first / first.sum(1, keepdims=True)), np.log(step / step.sum(2, keepdims=True))
    return Markov(first[1] - first[0], step[1] - step[0])


def is_random(run: str, model: Markov, scan: SecretScan) -> bool:
    """Whether the models take a run for a random string; lines of few characters over and over are none."""
    return len(set(run)) >= scan.min_distinct and model.score(run) > (scan.threshold if DIGIT.search(run) else scan.threshold_without_digit)


def find_secrets(text: str, model: Markov, scan: SecretScan) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind in the order of KINDS."""
    found = []
    if ASSIGN_WORD.search(text):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    # of the spans that begin before a run's end, the furthest end tells whether any overlaps the run
    base = sorted((s, e) for _, s, e in found)
    starts, furthest = [s for s, _ in base], list(accumulate((e for _, e in base), max))
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        before = bisect_left(starts, b)
        if not (before and furthest[before - 1] > a) and is_random(m[0], model, scan):
            found.append(("markov", a, b))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def redact(text: str, found: list[tuple[str, int, int]], mask: str) -> str:
    """The text with every maximal run of covered characters replaced by the mask."""
    out, at = [], 0
    spans = sorted((s, e) for _, s, e in found)
    for s, e in spans:
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join([*out, text[at:]])


@dataclass(frozen=True)
class SecretScan:
    threshold: float = 0.5
    threshold_without_digit: float = 0.75
    min_distinct: int = 8
    mask: str = "[SECRET]"
    n_samples: int = 4000


def _model(scan: SecretScan) -> Markov:
    return train(labelled_samples(scan.n_samples))


def scan_secrets(docs: DataFrame, scan: SecretScan = SecretScan()) -> DataFrame:
    """Per document: doc_id, findings (array of kind, start, end)."""
    model, kind = _model(scan), pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), x, strict=True)) for x in find_secrets(t.as_py() or "", model, scan)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "findings"])

    df = docs.select("doc_id", "text")
    return df.mapInArrow(run, T.StructType([df.schema["doc_id"], T.StructField("findings", FINDINGS)]))


def redact_secrets(docs: DataFrame, scan: SecretScan = SecretScan()) -> DataFrame:
    """The documents with every secret replaced by the mask; n_chars, where there is such a column, follows the text."""
    model = _model(scan)

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: redact(t, find_secrets(t, model, scan), scan.mask) if t is not None else None)

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def joined(findings, kinds: tuple[str, ...]):
    """kind:start:end of the findings of these kinds, comma-joined in their order."""
    chosen = F.filter(findings, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
