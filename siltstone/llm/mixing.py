"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Every source is a queue of its documents in shuffled order, offered ``max_repeats`` times over. A queued copy's virtual
finish time is its source's cumulative words up to and including it, divided by the source's target; copies are ordered
by finish time over all sources and taken while the running total stays within the budget. No running sum goes through
one task: rows are dealt into (source, shuffle bucket) and finish-time buckets, bucket totals are summed first, and a
window runs inside each bucket only, so a source that holds a third of all rows is split like any other.

Targets: sources by code point (null last) get the weights in turn; they share ``budget_factor`` times all words by
weight, no target above ``max_repeats`` times its source's words, the excess reshared by weight among the others.

Defined edge cases: null and empty texts have size 0 and are never taken; a null source is a source of its own; repeated
rows are separate documents; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import WORD, Scratch, fresh, n_words


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (5, 2, 1)
    budget_factor: float = 1.5
    max_repeats: int = 2
    rows_per_bucket: int = 2_000
    seed: str = "mix"


def source_targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """source, source_size, target: the water level at which capped sources stop and the others share by weight.

    One row per source. Sources sorted by cap / weight fill up in that order; at each, the level is what the sources
    before it leave of the budget over the weight that is left, and the first level at or under its cap / weight, which is the highest such, holds.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1) % len(mix.weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in mix.weights]), (turn + 1).cast("int")))
    per = per.withColumn("cap", (mix.max_repeats * F.col("source_size")).cast("double"))
    every, before = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({
        "budget": mix.budget_factor * F.sum("source_size").over(every),
        "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "weight_left": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    per = per.withColumn("level", (F.col("budget") - F.col("cap_before")) / F.col("weight_left"))
    per = per.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(every))
    return per.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).alias("target"))


def _running(df: DataFrame, keys: list[str], bucket: str, order: list, value: str, name: str) -> DataFrame:
    """Adds the running sum of ``value`` per ``keys`` in (bucket, order), bucket totals first."""
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(k).alias(f"_{k}") for k in [*keys, bucket]], F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_before"))
    inner = F.sum(value).over(Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keys, bucket]]
    out = df.withColumn("_in", inner)
    return out.join(totals, on=[c for c in same], how="inner").withColumn(name, F.col("_in") + F.col("_before")).drop("_in", "_before", *[f"_{k}" for k in [*keys, bucket]])


def place(mix: Mix) -> Column:
    """A row's place in its source's shuffled queue: the md5 of the seed, its doc_id and its text's md5."""
    return F.md5(F.concat_ws(":", F.lit(mix.seed), F.col("doc_id").cast("string"), F.md5("text")))


def _queues(docs: DataFrame, mix: Mix, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The documents queued, and a row (doc_id, source, round, place, size) for each copy that the mix takes."""
    sizes = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), place(mix).alias("place"))
    sizes = scratch.write(sizes, "sizes")
    n = sizes.count()
    digits = max(1, min(6, len(f"{n // mix.rows_per_bucket:x}")))
    targets = scratch.write(source_targets(sizes, mix), "targets")
    sizes = sizes.withColumns({"source_bucket": F.substring("place", 1, digits)})
    queued = _running(sizes, ["source"], "source_bucket", [F.col("place"), F.col("doc_id")], "size", "cumulative")
    t = targets.select(F.col("source").alias("_source"), "source_size", "target")
    queued = queued.join(t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source_bucket")
    queued = scratch.write(queued, "queued")
    # a copy for each time round, with its virtual finish time
    copies = queued.filter((F.col("size") > 0) & (F.col("target") > 0)).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(mix.max_repeats - 1))))
    copies = copies.select("doc_id", "source", "place", "size", "round", ((F.col("round") * F.col("source_size") + F.col("cumulative")) / F.col("target")).alias("finish"))
    buckets = max(64, mix.max_repeats * n // mix.rows_per_bucket)
    copies = copies.withColumn("finish_bucket", F.floor(F.least("finish", F.lit(4.0)) * buckets))
    budget = F.lit(mix.budget_factor) * F.lit(sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).head()[0])
    # the bucket where the budget runs out: those before it are taken whole, only its own rows need a running total
    totals = copies.groupBy("finish_bucket").agg(F.sum("size").alias("s"))
    totals = scratch.write(totals.withColumn("coarse", F.floor(F.col("finish_bucket") / 4096)), "totals")
    totals = _running(totals, [], "coarse", ["finish_bucket"], "s", "upto")
    cut = totals.filter(F.col("upto") > budget).orderBy("finish_bucket").select("finish_bucket", (F.col("upto") - F.col("s")).alias("before")).head()
    whole = copies.filter(F.col("finish_bucket") < (cut[0] if cut else buckets * 4 + 1))
    taken = whole.select("doc_id", "source", "round", "place", "size")
    if cut:
        w = Window.orderBy("finish", F.col("source").isNull(), "source", "round", "place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
        edge = copies.filter(F.col("finish_bucket") == cut[0]).withColumn("total", F.sum("size").over(w) + cut[1])
        taken = taken.unionByName(edge.filter(F.col("total") <= budget).select("doc_id", "source", "round", "place", "size"))
    return queued, taken


def fair_mix(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies, place and taken (size times copies).

    Equal rows are interchangeable: what is taken of them is dealt out evenly.
    """
    queued, taken = _queues(docs, mix, Scratch(docs.sparkSession, "mix"))
    # equal rows share a key; what was taken of them is dealt out evenly
    key = ["doc_id", "source", "place"]
    counts = taken.groupBy(*key).agg(F.count("*").alias("n_taken"))
    same = queued.groupBy(*key).agg(F.count("*").alias("n_same"), F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    out = same.join(counts.select(*[F.col(k).alias(f"_{k}") for k in key], "n_taken"), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key], "left").drop(*[f"_{k}" for k in key])
    out = out.withColumn("n_taken", F.coalesce("n_taken", F.lit(0))).withColumn("i", F.explode(F.sequence(F.lit(0), (F.col("n_same") - 1).cast("int"))))
    out = out.withColumn("copies", (F.floor(F.col("n_taken") / F.col("n_same")) + F.when(F.col("i") < F.col("n_taken") % F.col("n_same"), 1).otherwise(0)).cast("long"))
    return out.select("doc_id", "source", "place", F.col("size").cast("long").alias("size"), F.col("source_size").cast("long").alias("source_size"), "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def with_copies(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The documents as often as the mix takes them (0 to max_repeats times each), with all their columns.

    In each round a source's copies finish in the order of their places, so the mix takes those up to a last place and none
    beyond: that place, for each source and round, tells of every row whether it is taken, and no text is shuffled. What the mix
    takes of equal rows, which share a place, is spread evenly, rounded up.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    queued, taken = _queues(docs, mix, scratch)
    last = taken.groupBy("source", "round", "place").agg(F.count("*").alias("n")).groupBy("source", "round").agg(F.max(F.struct("place", "n")).alias("end"))
    last = scratch.write(last.select(F.col("source").alias("_source"), F.col("end.place").alias("_place"), "end.n"), "last")
    at_end = F.col("source").eqNullSafe(F.col("_source")) & (F.col("place") == F.col("_place"))
    rows = queued.join(last.select("_source", "_place").distinct(), at_end, "left_semi").groupBy("source", "place").agg(F.count("*").alias("rows"))
    own, here, i, of, ends, same = fresh(docs, "_own", "_here", "_i", "_of", "_ends", "_same")
    ended = last.join(rows, at_end).groupBy(F.col("source").alias(of)).agg(F.collect_list(F.struct("place", "n", "rows")).alias(ends))  # an entry for each round
    ended = scratch.write(ended, "ends")
    worded = docs.filter(F.col("text").rlike(WORD[:-1])).withColumns({own: F.col("source"), here: place(mix)})
    out = worded.join(ended, F.col(own).eqNullSafe(F.col(of)))
    out = out.withColumn(same, F.aggregate(ends, F.lit(1).cast("long"), lambda n, e: F.when(F.col(here) == e["place"], e["rows"]).otherwise(n)))
    part = lambda e: F.when(F.col(here) < e["place"], F.col(same)).when(F.col(here) == e["place"], e["n"]).otherwise(0)
    n = F.ceil(F.aggregate(ends, F.lit(0).cast("long"), lambda total, e: total + part(e)) / F.col(same)).cast("int")
    return out.withColumn(i, F.explode(F.slice(F.sequence(F.lit(1), F.lit(mix.max_repeats)), F.lit(1), n))).select(*docs.columns)
