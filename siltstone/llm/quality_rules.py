"""Quality rules by distribution divergence, with DataFrame functions only.

Each document gets two histograms: over character classes, and over a language's common words (plus one bucket for all
other words). Both are compared with the references of the document's language by Jensen-Shannon distance (base 2, so
0 to 1). References are fitted on the corpus itself: the mean histogram of all documents of a language that pass the
base rules, then once more without those whose characters lie far from the first mean, as junk would pull it. A document is rejected when a distance exceeds its threshold; guards leave texts alone that have too few
characters or words for the histogram to mean anything, and languages with too few documents for a reference. A histogram over n items scatters around its reference by about
sqrt(1 / n), so a threshold is a base value plus sqrt(noise / n), n being the characters or words.

Defined edge cases: a null or empty text has no words and fails the base rules; a null or unknown language without a
reference is judged by the base rules alone; repeated rows are judged alike; an empty table gives an empty result;
columns other than the named ones are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import SPACE, WORD, Scratch, text_or_empty, without

# Common function words of four languages.
COMMON_WORDS = (
    "the of and to in is that it for on with as at be by this are or was from an not have which "
    "le la les de des du et un une en que qui dans pour par est sur au plus pas ne avec ce il "
    "der die das und ist von den mit sich dem zu auf ein eine im nicht als auch es an werden "
    "el los las del se y una su al lo como con para por no más o pero"
).split()

CLASSES = ("lower", "upper", "digit", "space", "mark", "symbol", "other")


@dataclass(frozen=True)
class QualityRules:
    """Thresholds: base rules, the distances beyond which a document is rejected, and the guards."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_class_distance: float = 0.18
    class_noise: float = 0.5
    max_word_distance: float = 0.2
    word_noise: float = 8.0
    trim_class_distance: float = 0.3
    min_chars: int = 200
    min_words_for_histogram: int = 50
    min_reference_documents: int = 20


#: Words in 3-word windows found twice or more. A window's key is 40 bits of its hash above 24 bits of its position, so
#: one primitive sort brings equal windows together; equality is then confirmed on the words themselves. Texts of 2^24
#: words or more are keyed by (hash, position) pairs instead.
_KEYS = "transform(sequence(0, size(w) - 3), i -> shiftleft(xxhash64(w[i], w[i + 1], w[i + 2]), 24) | i)"
_SAME = "w[{a}] = w[{b}] AND w[{a} + 1] = w[{b} + 1] AND w[{a} + 2] = w[{b} + 2]"
_AT = "CAST({k} & 16777215 AS INT)"


def _repeated_starts() -> str:
    here, before, after = _AT.format(k="x"), _AT.format(k="k[i - 1]"), _AT.format(k="k[i + 1]")
    return (
        "filter(k, (x, i) -> "
        f"(i > 0 AND shiftright(x, 24) = shiftright(k[i - 1], 24) AND {_SAME.format(a=here, b=before)}) OR "
        f"(i < size(k) - 1 AND shiftright(x, 24) = shiftright(k[i + 1], 24) AND {_SAME.format(a=here, b=after)}))"
    )


_LONG_STARTS = (
    "transform(array(sort_array(transform(sequence(0, size(w) - 3), i -> struct(xxhash64(w[i], w[i + 1], w[i + 2]) AS h, i AS i)))), s -> "
    "transform(filter(s, (x, j) -> (j > 0 AND x.h = s[j - 1].h) OR (j < size(s) - 1 AND x.h = s[j + 1].h)), x -> CAST(x.i AS BIGINT)))[0]"
)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts, the character classes' counts and (word, count) pairs of common words."""
    listed = ", ".join("'" + w + "'" for w in dict.fromkeys(COMMON_WORDS))
    df = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), text_or_empty().alias("t"))
    df = df.withColumn("text_hash", F.xxhash64("t"))
    # each class is counted by what its removal leaves, so later patterns read ever shorter strings
    df = df.withColumns({"s": F.regexp_replace("t", "[a-z]+", ""), "w": F.expr(f"filter(split(t, r'{SPACE}'), x -> x <> '')"), "l": F.split("t", "\n")})
    df = df.withColumns({"v": F.regexp_replace("s", SPACE, ""), "n_chars": F.char_length("t").cast("long"), "n_s": F.char_length("s"), "n_words": F.size("w").cast("long")})
    df = df.withColumns({
        "lower": F.col("n_chars") - F.col("n_s"),
        "space": (F.col("n_s") - F.char_length("v")).cast("long"),
        "upper": F.char_length(F.regexp_replace("v", "[^A-Z]+", "")).cast("long"),
        "digit": F.char_length(F.regexp_replace("v", "[^0-9]+", "")).cast("long"),
        "symbol": F.char_length(F.regexp_replace("v", "[^#*$%&|<>]+", "")).cast("long"),
        "mark": F.char_length(F.regexp_replace("v", "[^!-~]+|[A-Za-z0-9#*$%&|<>]+", "")).cast("long"),
        "lines": F.expr(f"filter(l, x -> x rlike r'{WORD[:-1]}')"),
        "k": F.expr(f"CASE WHEN size(w) BETWEEN 3 AND 16777215 THEN sort_array({_KEYS}) ELSE CAST(array() AS ARRAY<BIGINT>) END"),
        "hits": F.expr(f"sort_array(filter(w, x -> x IN ({listed})))"),
    })
    df = df.withColumns({
        "starts": F.expr(f"CASE WHEN size(w) < 16777216 THEN sort_array(transform({_repeated_starts()}, x -> x & 16777215)) ELSE sort_array({_LONG_STARTS}) END"),
        "runs": F.expr("filter(sequence(0, size(hits)), i -> i < size(hits) AND (i = 0 OR hits[i] <> hits[i - 1]))"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "other": F.col("n_chars") - F.col("lower") - F.col("upper") - F.col("digit") - F.col("space") - F.col("mark") - F.col("symbol"),
    })
    return df.select(
        "doc_id", "lang", "text_hash", "n_words", (F.col("n_chars") - F.col("space")).alias("word_chars"), F.col("symbol").alias("n_symbols"), "n_dup_lines",
        F.expr("aggregate(transform(starts, (x, i) -> IF(i < size(starts) - 1, least(3L, starts[i + 1] - x), 3L)), 0L, (a, x) -> a + x)").alias("n_repeat_words"),
        F.array(*CLASSES).alias("classes"),
        F.expr("transform(runs, (r, i) -> struct(hits[r] AS word, CAST(IF(i < size(runs) - 1, runs[i + 1], size(hits)) - r AS BIGINT) AS n))").alias("common"),
    )


def judge_base(df: DataFrame, rules: QualityRules) -> DataFrame:
    return df.withColumn("base_failed", (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")))


def references(judged: DataFrame, rules: QualityRules) -> DataFrame:
    """One row per language: the mean histograms of its documents that pass the base rules, each document weighing the same.

    Both are aggregated per (language, class or word), so nothing but one short row per language is ever gathered. A
    language is any value of ``lang`` that enough documents carry.
    """
    ok = judged.filter(~F.col("base_failed") & F.col("lang").isNotNull() & (F.col("n_words") >= rules.min_words_for_histogram))
    total = F.expr("aggregate(classes, 0L, (a, x) -> a + x)")
    per_class = ok.groupBy("lang").agg(F.count("*").alias("n_docs"), *[F.avg(F.col("classes")[i] / total).alias(c) for i, c in enumerate(CLASSES)])
    per_word = (
        ok.select("lang", "n_words", F.explode("common").alias("c")).groupBy("lang", "c.word").agg(F.sum(F.col("c.n") / F.col("n_words")).alias("s"))
        .groupBy("lang").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", "s")))).alias("word_sums"))
    )  # at most one entry per listed word
    return (
        per_class.filter(F.col("n_docs") >= rules.min_reference_documents).join(per_word, "lang", "left")
        .select("lang", F.array(*CLASSES).alias("ref_classes"), F.expr("transform_values(coalesce(word_sums, CAST(map() AS MAP<STRING, DOUBLE>)), (k, s) -> s / n_docs)").alias("ref_words"))
    )


#: A bucket's part of twice the divergence, in bits; x and y are shares.
def _part(x: str, y: str) -> str:
    return f"(IF({x} > 0, {x} * log2(2 * {x} / ({x} + {y})), 0D) + IF({y} > 0, {y} * log2(2 * {y} / ({x} + {y})), 0D))"


def distances(df: DataFrame) -> DataFrame:
    """Adds class_distance and word_distance; null where there is no reference."""
    df = df.withColumns({
        "cd": F.expr(f"aggregate(zip_with(classes, ref_classes, (c, q) -> {_part('(c / greatest(n_chars, 1L))', 'q')}), 0D, (a, x) -> a + x)"),
        # buckets that the document has; of the others, each adds its reference share
        "wd": F.expr(f"aggregate(transform(common, c -> struct(c.n / n_words AS p, coalesce(element_at(ref_words, c.word), 0D) AS q)), "
                     f"named_struct('d', 0D, 'p', 0D, 'q', 0D), (a, x) -> named_struct('d', a.d + {_part('x.p', 'x.q')}, 'p', a.p + x.p, 'q', a.q + x.q))"),
        "rq": F.expr("aggregate(map_values(ref_words), 0D, (a, x) -> a + x)"),
    })
    rest = _part("greatest(1 - wd.p, 0D)", "greatest(1 - rq, 0D)")
    return df.withColumns({
        "class_distance": F.expr("IF(ref_classes IS NULL, NULL, sqrt(greatest(cd / 2, 0D)))"),
        "word_distance": F.expr(f"IF(ref_classes IS NULL, NULL, sqrt(greatest((wd.d + greatest(rq - wd.q, 0D) + {rest}) / 2, 0D)))"),
    }).drop("cd", "wd", "rq")


def far(rules: QualityRules) -> Column:
    """Whether a distance exceeds its threshold, on texts long enough to tell; false without a reference."""
    noise = lambda c, n: F.sqrt(F.lit(c) / F.greatest(F.col(n), F.lit(1)))
    by_class = (F.col("n_chars") >= rules.min_chars) & (F.col("class_distance") > rules.max_class_distance + noise(rules.class_noise, "n_chars"))
    by_word = (F.col("n_words") >= rules.min_words_for_histogram) & (F.col("word_distance") > rules.max_word_distance + noise(rules.word_noise, "n_words"))
    return F.coalesce(by_class, F.lit(False)) | F.coalesce(by_word, F.lit(False))


def judge(docs: DataFrame, rules: QualityRules = QualityRules(), refs: DataFrame | None = None) -> DataFrame:
    """Per document: doc_id, text_hash, the base counts, base_failed, kept, class_distance, word_distance.

    ``refs`` takes references fitted elsewhere (columns of :func:`references`); by default they are fitted on ``docs``.
    The features are written once to the shared folder, as fitting and judging both read them.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    judged = judge_base(scratch.write(features(docs), "features"), rules).withColumn("n_chars", F.expr("aggregate(classes, 0L, (a, x) -> a + x)"))
    if refs is None:
        first = scratch.write(references(judged, rules), "first-references")
        junk = F.coalesce((F.col("n_chars") >= rules.min_chars) & (F.col("class_distance") > rules.trim_class_distance), F.lit(False))
        refs = scratch.write(references(distances(judged.join(first, "lang", "left")).filter(~junk).select(*judged.columns), rules), "references")
    df = distances(judged.join(refs, "lang", "left"))
    return df.withColumn("kept", ~F.col("base_failed") & ~far(rules))


def apply_rules(docs: DataFrame, rules: QualityRules = QualityRules(), refs: DataFrame | None = None) -> DataFrame:
    """The verdicts of :func:`judge`: doc_id, the base counts, base_failed, kept, class_distance, word_distance."""
    return judge(docs, rules, refs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


def without_rejected(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents that the rules keep, with all their columns.

    The verdict is met on doc_id and the text's hash, so that rows that share an id are judged one by one.
    """
    scratch = Scratch(docs.sparkSession, "rejected")
    bad = scratch.write(judge(docs, rules).filter(~F.col("kept")).select("doc_id", "text_hash").distinct(), "bad")
    return without(docs, [F.col("doc_id"), F.xxhash64(text_or_empty())], bad, scratch)
