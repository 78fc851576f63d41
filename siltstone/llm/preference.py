"""Preference formatting, with DataFrame functions only: a shared prompt, rendered once, and paired masked completions.

``pairs`` names each pair's chosen and rejected conversation. :func:`pairs_by_opening` makes pairs of conversations that
open with the same turn (role and text): the best of such a group is chosen, every other one is rejected against it, so
a group of n gives n - 1 pairs, never all of them. Where conversations come without any judgement, :func:`format_exchanged`
makes the rejected ones: each conversation against itself with another conversation's last answer in place of its own.
For each pair the longest common turn prefix is the prompt (empty if the first turns differ);
what follows in either conversation is its completion. The output has
one row per rendered turn rather than one string per conversation: a conversation that holds a third of all turns never
meets in one task. ``loss`` marks the turns that bear loss: the assistant's, in completions; prompts are masked whole.

By default the best conversation has the most characters in assistant turns, ties to the smaller conv_id; ``score`` takes
a (conv_id, score) table instead, as human preferences would give.

Defined edge cases: turns are ordered by (turn, role, text); a row that repeats another exactly counts once; rows with a
null conv_id take no part; a null turn sorts first; null roles and texts equal each other and render as empty strings;
conversations equal in all turns give a pair with empty completions; conversations without an answer, or whose partner has
none, are not exchanged; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, skewed_join


@dataclass(frozen=True)
class Template:
    start: str = "<|im_start|>"
    end: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)


def numbered_turns(conversations: DataFrame, block: int = 64) -> DataFrame:
    """conv_id, pos (1, 2, ... by turn), role, text. Positions are summed over blocks of turn numbers, so that a
    conversation of any length is numbered by many tasks."""
    c = conversations.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", "role", "text").distinct()
    c = c.withColumn("_block", F.floor(F.coalesce("turn", F.lit(-1)) / block))
    before = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = c.groupBy("conv_id", "_block").agg(F.count("*").alias("_n")).select("conv_id", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("conv_id", "_block").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()))
    return c.withColumn("_in", inner).join(blocks, ["conv_id", "_block"]).select("conv_id", (F.col("_in") + F.col("_before")).cast("long").alias("pos"), "role", "text")


def pairs_by_opening(turns: DataFrame, template: Template = Template(), score: DataFrame | None = None) -> DataFrame:
    """pair_id (the rejected conv_id), chosen_id, rejected_id: the best of each group against each other member."""
    first = turns.filter(F.col("pos") == 1).select("conv_id", F.sha2(F.to_json(F.struct(F.coalesce("role", F.lit("")).alias("r"), F.coalesce("text", F.lit("")).alias("t"))), 256).alias("opening"))
    if score is None:
        answered = F.sum(F.when(F.col("role").isin(*template.loss_roles), F.char_length("text")).otherwise(0))
        score = turns.groupBy("conv_id").agg(F.coalesce(answered, F.lit(0)).alias("score"))
    ranked = first.join(score.select("conv_id", "score"), "conv_id", "left").withColumn("score", F.coalesce("score", F.lit(0)))
    # the best of a group is an aggregate, which combines before it shuffles
    best = ranked.groupBy("opening").agg(F.max(F.struct("score", (-F.col("conv_id")).alias("minus"))).alias("b"), F.count("*").alias("n")).filter(F.col("n") > 1)
    pairs = ranked.join(best.select("opening", (-F.col("b.minus")).alias("chosen_id")), "opening").filter(F.col("conv_id") != F.col("chosen_id"))
    return pairs.select(F.col("conv_id").alias("pair_id"), "chosen_id", F.col("conv_id").alias("rejected_id"))


def format_preferences(conversations: DataFrame, pairs: DataFrame, template: Template = Template()) -> DataFrame:
    """Per rendered turn of each pair (pair_id, chosen_id, rejected_id): see :func:`render`."""
    scratch = Scratch(conversations.sparkSession, "preference")
    turns = scratch.write(numbered_turns(conversations), "turns")
    pairs = scratch.write(pairs.select("pair_id", "chosen_id", "rejected_id"), "pairs")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"))

    def side(name: str) -> DataFrame:
        mine = pairs.withColumn("conv_id", F.col(f"{name}_id"))
        counts = scratch.write(mine.groupBy("conv_id").agg(F.count("*").alias("n_pairs")).join(sizes, "conv_id"), f"{name}-counts")
        own = scratch.write(skewed_join(mine, counts, ["conv_id"], n="n_pairs", how="inner"), f"{name}-pairs")
        # of a conversation's turns and pairs, the more are dealt out and the fewer go everywhere
        turned = skewed_join(turns, own.filter("n_turns >= n_pairs"), ["conv_id"], n="n_turns", how="inner")
        fewer = scratch.write(skewed_join(turns, counts.filter("n_pairs > n_turns"), ["conv_id"], n="n_turns", how="inner"), f"{name}-turns")
        paired = skewed_join(own.filter("n_pairs > n_turns").drop("n_pairs", "n_turns"), fewer, ["conv_id"], n="n_pairs", how="inner")
        out = lambda df: df.select("pair_id", "chosen_id", "rejected_id", F.lit(name).alias("side"), "pos", "role", "text")
        return out(turned).unionByName(out(paired))

    return render(scratch.write(side("chosen").unionByName(side("rejected")), "sides"), template, scratch)


def exchanged_sides(turns: DataFrame, template: Template, scratch: Scratch) -> DataFrame:
    """Both sides of each conversation whose last answer is exchanged for that of its partner, conversation 2k for 2k + 1
    and the other way round: pair_id and chosen_id are its conv_id, rejected_id is that of the partner."""
    answer = F.max(F.when(F.col("role").isin(*template.loss_roles), F.struct("pos", "text")))
    last = scratch.write(turns.groupBy("conv_id").agg(answer.alias("own"), F.count("*").alias("n")).filter("own IS NOT NULL"), "answers")
    other = last.select(F.col("conv_id").alias("rejected_id"), F.col("own.text").alias("instead"))
    swaps = last.select("conv_id", "n", F.col("own.pos").alias("at")).join(other, F.col("conv_id").bitwiseXOR(F.lit(1)) == F.col("rejected_id"))
    both = skewed_join(turns, scratch.write(swaps, "swaps"), ["conv_id"], how="inner")
    both = both.withColumn("side", F.explode(F.array(F.lit("chosen"), F.lit("rejected"))))
    text = F.when((F.col("side") == "rejected") & (F.col("pos") == F.col("at")), F.col("instead")).otherwise(F.col("text"))
    return scratch.write(both.select(F.col("conv_id").alias("pair_id"), F.col("conv_id").alias("chosen_id"), "rejected_id", "side", "pos", "role", text.alias("text")), "sides")


def format_exchanged(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """Per rendered turn of each conversation against itself with its partner's last answer: see :func:`exchanged_sides`
    and :func:`render`."""
    scratch = Scratch(conversations.sparkSession, "preference")
    turns = scratch.write(numbered_turns(conversations), "turns")
    return render(exchanged_sides(turns, template, scratch), template, scratch)


def render(both: DataFrame, template: Template, scratch: Scratch) -> DataFrame:
    """Per rendered turn of each pair: pair_id, chosen_id, rejected_id, part (prompt, chosen, rejected), pos, role,
    rendered, loss, n_common. The parts of a pair, each in order of pos, are its prompt and its two completions."""
    # turns of either side meet by (pair, pos); the first place where they differ or one of them ends closes the prompt
    role, body = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    h0, h1 = F.xxhash64(role, body), F.xxhash64(body, role, F.lit(1))
    same = (F.count("*") == 2) & (F.min(h0) == F.max(h0)) & (F.min(h1) == F.max(h1))
    ends = both.groupBy("pair_id", "pos").agg(same.alias("same"), F.count("*").alias("n"))
    common = ends.groupBy("pair_id").agg((F.coalesce(F.min(F.when(~F.col("same"), F.col("pos"))), F.max("pos") + 1) - 1).alias("n_common"), F.sum("n").alias("n"))
    rows = skewed_join(both, scratch.write(common, "common"), ["pair_id"], how="inner").filter((F.col("pos") > F.col("n_common")) | (F.col("side") == "chosen"))
    prompt = F.col("pos") <= F.col("n_common")
    return rows.select(
        "pair_id", "chosen_id", "rejected_id", F.when(prompt, "prompt").otherwise(F.col("side")).alias("part"), "pos", "role",
        F.concat(F.lit(template.start), role, F.lit("\n"), body, F.lit(template.end)).alias("rendered"),
        (~prompt & role.isin(*template.loss_roles)).alias("loss"), F.col("n_common").cast("long").alias("n_common"),
    )
