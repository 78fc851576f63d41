"""Source divergence audit: how far the term distributions of a language's sources lie apart, in exact integers.

Documents are counted in Arrow batches inside tasks, so what is shuffled is a row per (language, source, term) and batch of
tables, not a row per word. Each language keeps the terms that at least ``min_documents`` of its documents hold. A group gives
a kept term the share p = 1 + floor(scale * (count + prior) / (N + prior * V)), terms that it never uses included.

Two sources are compared by their joint count histogram: how many terms have count x in the one and y in the other. Only
cells with both counts above zero come from a join on the term; cells with a zero follow from the sources' own
histograms by inclusion and exclusion (terms with count x here, less those of them that the other source uses; all V terms, less those that
either uses). The divergence is then evaluated once for each distinct (x, y) and multiplied by how many terms have it, so it costs
as many evaluations as there are distinct pairs of counts, whatever V is.

Defined edge cases: null text, lang and source count as empty strings; documents without terms make their group occur;
a language without kept terms has V = 0 and divergences of 0; repeated rows are documents of their own; a language with
one source has no pairs; an empty table gives an empty result; further columns are ignored, whatever their names. Texts are read
in pieces of about a megabyte that end between terms, so a very long text takes no more memory than its distinct terms.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch

#: A-Z in lower case, all other ASCII characters but letters as blanks; bytes beyond ASCII belong to terms.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
BLANK = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
PIECE = 1 << 20
COUNTED = "lang string, source string, term binary, n long, docs long"


@dataclass(frozen=True)
class Audit:
    min_documents: int = 30
    prior: int = 5
    scale: int = 1_000_000_000
    top_terms: int = 50
    #: entries of a task's table of counts before it is passed on
    table_entries: int = 200_000


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, a piece at a time."""
    at = 0
    while at < len(text):
        blank = BLANK.search(text, at + PIECE)
        end = blank.start() if blank else len(text)
        yield text[at:end].translate(LETTERS).split()
        at = end


def count_terms(docs: DataFrame, p: Audit = Audit()) -> DataFrame:
    """(lang, source, term, n, docs): partial counts of occurrences and documents; a term may come several times."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[tuple[bytes, bytes], dict[bytes, int]] = {}
        one, size = 1 << 48, 0  # documents and occurrences in one number

        def passed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), t in tables.items():
                v = list(t.values())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(t), pa.string()), pa.array([source] * len(t), pa.string()), pa.array(list(t), pa.binary()), pa.array([x % one for x in v], pa.int64()), pa.array([x // one for x in v], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"],
                )

        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                c: Counter[bytes] = Counter()
                for piece in terms_of(text.as_py()):
                    c.update(piece)
                t = tables.setdefault((lang, source), {})
                get, size = t.get, size - len(t)
                for term, k in c.items():
                    t[term] = get(term, 0) + k + one
                size += len(t)
                if size > p.table_entries:
                    yield from passed_on()
                    tables.clear()
                    size = 0
        yield from passed_on()

    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(blank("lang").alias("lang"), blank("source").alias("source"), blank("text").cast("binary").alias("text"))
    return rows.mapInArrow(count, COUNTED).withColumn("term", F.col("term").cast("string"))


def kept_counts(docs: DataFrame, p: Audit = Audit()) -> DataFrame:
    """(lang, source, term, n, lang_n): the counts of kept terms in each source that uses them, and in the whole language. One shuffle:
    what is dealt by (lang, term) holds a term's sources together."""
    per = count_terms(docs, p).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    every = Window.partitionBy("lang", "term")
    per = per.withColumns({"lang_docs": F.sum("docs").over(every), "lang_n": F.sum("n").over(every)})
    return per.filter(F.col("lang_docs") >= p.min_documents).select("lang", "source", "term", "n", "lang_n")


def share(n: Column, total: Column, terms: Column, p: Audit = Audit()) -> Column:
    """1 + floor(scale * (n + prior) / (total + prior * terms)), by whole numbers of up to 38 digits."""
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    over = wide(n + F.lit(p.prior), 28) * wide(F.lit(p.scale), 10)
    return F.call_function("div", over, wide(F.greatest(total + F.lit(p.prior) * terms, F.lit(1)), 28)) + F.lit(1)


def joint_histograms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, x, y, terms): for each two sources a < b of a language, how many kept terms have count x in a and y in b."""
    one, other = (kept.select("lang", "term", F.col("source").alias(s), F.col("n").alias(c)) for s, c in (("a", "x"), ("b", "y")))
    both = one.join(other, ["lang", "term"]).filter(F.col("a") < F.col("b")).groupBy("lang", "a", "b", "x", "y").agg(F.count("*").alias("m"))
    long = lambda c: F.col(c).cast("long") if c else F.lit(0).cast("long")
    cell = lambda x, y, m: F.struct(long(x).alias("x"), long(y).alias("y"), m.alias("m"))
    cells = lambda df, *c: df.select("lang", "a", "b", F.inline(F.array(*c)))
    m, none = F.col("m"), None
    met = cells(both, cell("x", "y", m), cell("x", none, -m), cell(none, "y", -m), cell(none, none, m))
    own = kept.groupBy("lang", F.col("source").alias("s"), F.col("n").alias("c")).agg(F.count("*").alias("m"))
    partner = groups.select("lang", F.col("source").alias("o"))
    sided = own.join(partner, "lang").filter(F.col("s") != F.col("o")).select("lang", F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b"), F.when(F.col("s") < F.col("o"), F.col("c")).otherwise(0).alias("x"), F.when(F.col("s") > F.col("o"), F.col("c")).otherwise(0).alias("y"), "m")
    alone = cells(sided, cell("x", "y", m), cell(none, none, -m))
    pairs = groups.select("lang", F.col("source").alias("a"), "n_terms").join(groups.select("lang", F.col("source").alias("b")), "lang").filter(F.col("a") < F.col("b"))
    whole = cells(pairs, cell(none, none, F.col("n_terms")))
    tally = met.unionByName(alone).unionByName(whole).groupBy("lang", "a", "b", "x", "y").agg(F.sum("m").alias("terms"))
    return tally.filter(F.col("terms") > 0)


def audit_sources(docs: DataFrame, p: Audit = Audit()) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank: each source's distance from every other source of its language, and the
    terms that it uses more than its language does."""
    scratch = Scratch(docs.sparkSession, "audit")
    kept = scratch.write(kept_counts(docs, p), "kept")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    langs = kept.select("lang", "term", "lang_n").distinct().groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(blank("lang"), blank("source")).distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = scratch.write(groups.fillna(0, ["total", "n_terms", "lang_total"]), "groups")

    side = lambda s: groups.select("lang", F.col("source").alias(s), F.col("total").alias(f"total_{s}"), *(["n_terms"] if s == "a" else []))
    pairs = side("a").join(side("b"), "lang").filter(F.col("a") < F.col("b"))
    n = F.col("n_terms")
    apart = F.abs(share(F.col("x"), F.col("total_a"), n, p) - share(F.col("y"), F.col("total_b"), n, p))
    value = joint_histograms(kept, groups).join(pairs, ["lang", "a", "b"]).groupBy("lang", "a", "b").agg(F.sum(F.col("terms") * apart).alias("value"))
    valued = pairs.select("lang", "a", "b").join(value, ["lang", "a", "b"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("long")))
    sides = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    pair = valued.select("lang", F.inline(sides), "value").withColumn("part", F.lit("pair"))

    used = kept.join(groups, ["lang", "source"])
    more = share(F.col("n"), F.col("total"), n, p) - share(F.col("lang_n"), F.col("lang_total"), n, p)
    term = used.select("lang", "source", F.col("term").alias("item"), more.alias("value")).filter("value > 0").withColumn("part", F.lit("term"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = pair.withColumn("rank", F.row_number().over(order))
    term = term.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= p.top_terms)  # cut to top_terms in each task first
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pair.select(*columns).unionByName(term.select(*columns))
