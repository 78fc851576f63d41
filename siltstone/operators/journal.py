"""Append-only journals reduced to state.

A journal is a word over event kinds, and each event is a function from state to state. Functions compose associatively,
so a plan's events are folded in blocks of consecutive sequence numbers first and the blocks are composed after, which
lets a plan of any length be reduced by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.graph import _checkpoint

# Fixed values: (from, event, to).
TRANSITIONS = (
    ("start", "preview_created", "previewed"),
    ("previewed", "execute_requested", "execute_requested"),
    ("execute_requested", "execute_request_not_started", "previewed"),
    ("execute_requested", "direct_rename_intent", "direct_rename_intent"),
    ("direct_rename_intent", "execution_completed", "executed"),
    ("direct_rename_intent", "execution_not_applied", "previewed"),
    ("direct_rename_intent", "execution_needs_attention", "needs_attention"),
    ("executed", "undo_requested", "undo_requested"),
    ("undo_requested", "undo_request_not_started", "executed"),
    ("undo_requested", "undo_rename_intent", "undo_rename_intent"),
    ("undo_rename_intent", "undo_completed", "undone"),
    ("undo_rename_intent", "undo_not_applied", "executed"),
    ("undo_rename_intent", "undo_needs_attention", "needs_attention"),
)
STATES = tuple(dict.fromkeys(s for a, _, b in TRANSITIONS for s in (a, b)))
#: Beyond the states: where a fold ends when an event is not allowed.
ERRORS = ("NonMonotonicSequence", "InvalidInitialEvent", "InvalidTransition")


def _table() -> Column:
    """kind to the array of following states by state number, -1 where there is none."""
    rows = {}
    for a, kind, b in TRANSITIONS:
        rows.setdefault(kind, [-1] * len(STATES))[STATES.index(a)] = STATES.index(b)
    return F.create_map(*[x for kind, row in rows.items() for x in (F.lit(kind), F.array(*[F.lit(i) for i in row]))])


def reduce_journal(events: DataFrame, plan: str = "plan_id", block: int = 512) -> DataFrame:
    """(plan, state, error, events): the state after all events, or the error of the first event that breaks a rule.

    The first event has sequence 1 and is preview_created, sequences are contiguous, transitions are legal. The error of
    the smallest position wins; at one position the order of checks is that of ERRORS.
    """
    return snapshot(events, plan, block).drop("last_sequence")


def snapshot(events: DataFrame, plan: str = "plan_id", block: int = 512) -> DataFrame:
    """:func:`reduce_journal` with ``last_sequence``, from which :func:`advance` goes on."""
    e = _numbered(events, plan)
    return _reduced(e, e.select("_plan").distinct().select("_plan", F.lit(0).alias("_from"), F.lit(0).cast("long").alias("_last"), F.lit(None).cast("string").alias("_error"), F.lit(0).cast("long").alias("_events")), plan, block)


def advance(before: DataFrame, new: DataFrame, history: DataFrame, plan: str = "plan_id", block: int = 512) -> DataFrame:
    """The snapshot of all events from that of the earlier ones and the new ones alone: their functions are composed onto the
    kept states. Plans without new events stay as they are.

    ``history`` (the earlier events) is read only for plans whose new events don't all come after their last sequence: these
    are reduced from the start, so that the result is that of a full reduction for any split of the events, in any order.
    """
    e, columns = _numbered(new, plan), [plan, "state", "error", "events", "last_sequence"]
    touched = e.groupBy("_plan").agg(F.min("seq").alias("_lo"))
    kept = before.select(F.col(plan).alias("_plan"), *columns[1:])
    number = F.coalesce(*[F.when(F.col("state") == name, i) for i, name in enumerate(STATES)], F.lit(0))
    placed = _checkpoint(touched.join(kept, "_plan", "left").select("_plan", "_lo", number.alias("_from"), F.coalesce("last_sequence", F.lit(0)).cast("long").alias("_last"), F.col("error").alias("_error"), F.coalesce("events", F.lit(0)).cast("long").alias("_events")))
    late = (F.col("_lo") <= F.col("_last")) & (F.col("_events") > 0)
    again = placed.filter(late).select("_plan")
    out = kept.join(touched, "_plan", "left_anti").withColumnRenamed("_plan", plan)
    out = out.unionByName(_reduced(e.join(again, "_plan", "left_anti"), placed.filter(~late).drop("_lo"), plan, block))
    if not again.isEmpty():
        wanted = again.withColumnRenamed("_plan", plan)
        both = history.select(plan, "sequence", "event_kind").unionByName(new.select(plan, "sequence", "event_kind"))
        out = out.unionByName(snapshot(both.join(wanted, plan, "left_semi"), plan, block))
    return out.select(*columns)


def _numbered(events: DataFrame, plan: str) -> DataFrame:
    return events.select(F.col(plan).alias("_plan"), F.col("sequence").cast("long").alias("seq"), F.col("event_kind").alias("kind"))


def _reduced(e: DataFrame, starts: DataFrame, plan: str, block: int) -> DataFrame:
    """The events (_plan, seq, kind) folded onto the states (_plan, _from, _last, _error, _events) that their plans are in."""
    n = len(STATES)
    # equal sequences stay together; block by number, so a block has at most `block` events unless numbers repeat
    e = e.withColumn("block", F.floor((F.col("seq") - 1) / block))
    # fold one block: for each start state the (state, position of the first illegal event or null, whether it was the initial state)
    start = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda s: F.struct(s.alias("state"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("string").alias("error")))

    def step(acc: Column, ev: Column) -> Column:
        row = F.try_element_at(F.col("_map"), ev["kind"])

        def one(x: Column) -> Column:
            to = F.coalesce(F.get(row, x["state"]), F.lit(-1))
            wrong = F.when(x["state"] == 0, "InvalidInitialEvent").otherwise("InvalidTransition")
            moved = F.struct(to.alias("state"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("string").alias("error"))
            stuck = F.struct(x["state"].alias("state"), ev["seq"].alias("at"), wrong.alias("error"))
            return F.when(x["error"].isNotNull(), x).when(to >= 0, moved).otherwise(stuck)

        return F.transform(acc, one)

    blocks = e.groupBy("_plan", "block").agg(F.array_sort(F.collect_list(F.struct("seq", "kind"))).alias("evs"), F.count("*").alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    # the first break of the numbering inside a block: a sequence that is not its predecessor's plus one
    gap = F.array_min(F.filter(F.transform(F.col("evs"), lambda x, i: F.when((i > 0) & (x["seq"] != F.get(F.col("evs"), i - 1)["seq"] + 1), x["seq"])), lambda x: x.isNotNull()))
    blocks = blocks.withColumn("_map", _table()).withColumn("folded", F.aggregate("evs", start, step)).withColumn("gap", gap)
    w = Window.partitionBy("_plan").orderBy("block")
    # between blocks: each starts at its predecessor's end plus one, the first at the plan's last sequence plus one
    blocks = blocks.withColumn("before", F.lag("hi").over(w))
    whole = blocks.groupBy("_plan").agg(
        F.array_sort(F.collect_list(F.struct("block", "folded"))).alias("bs"), F.min(F.when(F.col("before").isNotNull() & (F.col("before") + 1 != F.col("lo")), F.col("lo")).otherwise(F.col("gap"))).alias("gap"),
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
    ).join(starts, "_plan")
    first = F.struct(F.col("_from").alias("state"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("string").alias("error"))
    final = F.aggregate("bs", first, lambda acc, b: F.when(acc["error"].isNotNull(), acc).otherwise(F.get(b["folded"], acc["state"])))
    out = whole.withColumn("r", final).withColumn("gap", F.when(F.col("lo") != F.col("_last") + 1, F.col("lo")).otherwise(F.col("gap")))
    error = F.when(F.col("gap").isNotNull() & (F.col("r.at").isNull() | (F.col("gap") <= F.col("r.at"))), ERRORS[0]).otherwise(F.col("r.error"))
    error = F.coalesce("_error", error)
    state = F.get(F.array(*[F.lit(s) for s in STATES]), F.col("r.state"))
    return out.select(F.col("_plan").alias(plan), F.when(error.isNull(), state).alias("state"), error.alias("error"), (F.col("n") + F.col("_events")).cast("long").alias("events"), F.col("hi").alias("last_sequence"))


def violations(events: DataFrame, plan: str = "plan_id") -> DataFrame:
    """Events that may not follow their predecessor: (plan, sequence, previous_kind, event_kind)."""
    w = Window.partitionBy(plan).orderBy("sequence")
    # which kinds may follow a kind: those that leave the state it leads to
    pairs = sorted({f"{k1}>{k2}" for _, k1, s1 in TRANSITIONS for s2, k2, _ in TRANSITIONS if s1 == s2})
    with_previous = events.withColumn("previous_kind", F.lag("event_kind").over(w))
    legal = F.when(F.col("previous_kind").isNull(), F.col("event_kind") == "preview_created").otherwise(F.concat("previous_kind", F.lit(">"), "event_kind").isin(*pairs))
    return with_previous.filter(~legal).select(plan, "sequence", "previous_kind", "event_kind")


def idempotent(commands: DataFrame, keys: tuple[str, ...] = ("plan_id", "request_id"), order: str = "sequence") -> DataFrame:
    """The first command of each request id: sending one again gives the earlier result."""
    return commands.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n")


def next_sequences(existing: DataFrame, new: DataFrame, plan: str = "plan_id", order: str = "created_at_unix_ms") -> DataFrame:
    """New events numbered on from each plan's last."""
    last = existing.groupBy(plan).agg(F.max("sequence").alias("_last"))
    w = Window.partitionBy(plan).orderBy(order)
    return new.join(last, plan, "left").withColumn("sequence", (F.row_number().over(w) + F.coalesce("_last", F.lit(0))).cast("long")).drop("_last")


def command_violations(events: DataFrame, commands: DataFrame) -> DataFrame:
    """Events without a command of their plan, requests away from their command's sequence, and events that change command."""
    w = Window.partitionBy("plan_id").orderBy("sequence")
    e = events.withColumn("previous_command", F.lag("command_request_id").over(w))
    c = commands.select("plan_id", F.col("request_id").alias("command_request_id"), "requested_sequence")
    j = e.join(c, ["plan_id", "command_request_id"], "left")
    request = F.endswith("event_kind", F.lit("_requested"))
    code = (
        F.when(F.col("event_kind") == "preview_created", F.when(F.col("command_request_id").isNotNull(), "command_unexpected")).when(F.col("requested_sequence").isNull(), "command_missing")
        .when(request & (F.col("sequence") != F.col("requested_sequence")), "command_sequence_mismatch").when(~request & ~F.col("command_request_id").eqNullSafe(F.col("previous_command")), "command_changed")
    )
    return j.withColumn("code", code).filter(F.col("code").isNotNull()).select("plan_id", "sequence", "code")


def recovery_report(outcomes: DataFrame, limit: int = 100) -> DataFrame:
    """One row over (before, after) states of incomplete plans: how many were inspected and how each ended."""
    o = outcomes.orderBy("plan_id").limit(limit)
    n = lambda cond, name: F.count_if(cond).alias(name)
    same = F.col("before") == F.col("after")
    return o.agg(
        F.count("*").alias("inspected"), n(same, "deferred"), n(F.col("after").isin("executed", "undone") & ~same, "completed"),
        n((F.col("after") == "previewed") & ~same, "not_applied"), n((F.col("after") == "needs_attention") & ~same, "needs_attention"),
    )
