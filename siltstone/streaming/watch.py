"""Change hints coalesced per scope: a batch fold and its Structured Streaming form, which share one state machine.

A scope has at most one stabilizing event. Each hint for it resets the deadline (hint time + window) and counts; at the
deadline the event is due. An event older than the maximum age is due at once and widened to the full scope. Kinds only
escalate: a file gives ``file_delta``, a folder or a missing path ``full_scope``, as do two different paths in one event.
Temporary downloads and hidden names are ignored. Order of arrival wins; nothing is ever too late.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from siltstone.functions.paths import ancestors, filename, is_hidden, is_temporary_download
from siltstone.operators.folds import streamed_fold

HINTS = "scope_id long, path string, observed_kind string, observed_at_unix_ms long"
EVENTS = "scope_id long, first_at_unix_ms long, last_at_unix_ms long, due_at_unix_ms long, hints long, kind string, widened boolean"
#: Of a scope's event, where asked for: the one file of a file_delta.
EVENTS_WITH_PATH = EVENTS + ", path string"


# Milliseconds until an event or scope is looked at again.
RETRY_MS = {"active": 50, "contention": 1_000, "deferred": 1_000, "error": 30_000}


@dataclass(frozen=True)
class Watch:
    window_ms: int = 1_000
    max_age_ms: int = 300_000


@dataclass
class Pending:
    """A stabilizing event."""

    first: int
    last: int
    hints: int
    kind: str
    path: str | None

    def due(self, w: Watch) -> int:
        return min(self.last + w.window_ms, self.first + w.max_age_ms)

    def widened(self, w: Watch) -> bool:
        return self.last + w.window_ms > self.first + w.max_age_ms

    def row(self, scope: int, w: Watch, with_path: bool = False) -> tuple:
        kind = "full_scope" if self.widened(w) else self.kind
        row = scope, self.first, self.last, self.due(w), self.hints, kind, self.widened(w)
        return (*row, self.path if kind == "file_delta" else None) if with_path else row


@dataclass
class _Kept:
    pending: Pending
    scope: int


def observe(p: Pending | None, at: int, kind: str, path: str | None, w: Watch) -> tuple[Pending, Pending | None]:
    """(the pending event after a hint, the event that had come due before it)."""
    kind = "file_delta" if kind == "file" else "full_scope"
    if p is None or at >= p.due(w):
        return Pending(at, at, 1, kind, path), p
    wide = "full_scope" in (p.kind, kind) or (path is not None and path != p.path)
    return Pending(p.first, max(p.last, at), p.hints + 1, "full_scope" if wide else kind, p.path), None


def actionable(hints: DataFrame) -> DataFrame:
    """Hints without those for temporary downloads or for paths with a hidden component."""
    hidden = F.exists(F.split("path", "/"), lambda x: is_hidden(x) & (F.char_length(x) > 1))
    return hints.filter(F.col("path").isNull() | ~(is_temporary_download(filename(F.col("path"))) | hidden))


def routed(hints: DataFrame, scopes: DataFrame) -> DataFrame:
    """A raw path goes to every scope (scope_id, path_key) that contains it."""
    above = hints.withColumn("_above", F.explode(ancestors(F.col("path"))))
    return above.join(scopes.select("scope_id", F.col("path_key").alias("_above")), "_above").drop("_above")


def coalesce_batch(hints: DataFrame, w: Watch = Watch()) -> DataFrame:
    """All events of a batch of hints, each scope's hints in order of time, path and kind; open ones come due at their deadline."""

    def step(state: _Kept | None, key: tuple, row: dict) -> tuple[_Kept, list[tuple]]:
        scope = int(key[0])
        p, done = observe(state.pending if state else None, int(row["observed_at_unix_ms"]), row["observed_kind"], row["path"], w)
        return _Kept(p, scope), [done.row(scope, w)] if done else []

    dealt = hints.select("scope_id", "observed_at_unix_ms", F.coalesce("path", F.lit("")).alias("path"), "observed_kind")
    return streamed_fold(dealt, ["scope_id"], ["observed_at_unix_ms", "path", "observed_kind"], step, lambda s: [s.pending.row(s.scope, w)], EVENTS)


class Coalescer(StatefulProcessor):
    """The same state per scope in a stream; a timer at the deadline emits the event."""

    def __init__(self, w: Watch, with_path: bool = False) -> None:
        self.w, self.with_path = w, with_path
        self.columns = [x.split()[0] for x in (EVENTS_WITH_PATH if with_path else EVENTS).split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("pending", "first long, last long, hints long, kind string, path string")

    def _load(self) -> Pending | None:
        return Pending(*self.state.get()) if self.state.exists() else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["observed_at_unix_ms", "path", "observed_kind"])
        p, out = self._load(), []
        before = p.due(self.w) if p else None
        for r in batch.itertuples(index=False):
            p, done = observe(p, int(r.observed_at_unix_ms), r.observed_kind, r.path, self.w)
            if done:
                out.append(done.row(int(key[0]), self.w, self.with_path))
        self.state.update((p.first, p.last, p.hints, p.kind, p.path))
        if before is not None and before != p.due(self.w):
            self.handle.deleteTimer(before)
        if before != p.due(self.w):
            self.handle.registerTimer(p.due(self.w))
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        p = self._load()
        if p is not None and p.due(self.w) <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
            yield pd.DataFrame([p.row(int(key[0]), self.w, self.with_path)], columns=self.columns)

    def close(self) -> None:
        pass


def coalesce_stream(hints: DataFrame, w: Watch = Watch(), delay: str | None = None, with_path: bool = False) -> DataFrame:
    """The streaming form. Deadlines are kept by the clock, as the hints of running watchers are stamped by it, so no hint
    is too late to coalesce with what is pending, whatever other scopes have seen meanwhile.

    With ``delay``, deadlines are kept by the event-time column ``observed_at`` instead, to replay recorded hints; Spark
    then drops hints that are older than the latest by more than the delay.
    """
    schema = EVENTS_WITH_PATH if with_path else EVENTS
    columns = ["scope_id", F.coalesce("path", F.lit("")).alias("path"), "observed_kind", "observed_at_unix_ms"]
    if delay is None:
        return hints.select(*columns).groupBy("scope_id").transformWithStateInPandas(Coalescer(w, with_path), schema, "Append", "ProcessingTime")
    stream = hints.withWatermark("observed_at", delay).select(*columns, "observed_at")
    return stream.groupBy("scope_id").transformWithStateInPandas(Coalescer(w, with_path), schema, "Append", "EventTime")


def deltas(events: DataFrame, manifest: DataFrame) -> DataFrame:
    """Which file_delta events may update one node alone: a known present file, same identity, one link, one location, no
    running scan; all others are widened to the full scope."""
    known = manifest.select("scope_id", "path", "present", "link_count", "locations", "scan_running", F.col("identity_key").alias("_identity"))
    ok = F.col("present") & (F.col("link_count") == 1) & (F.col("locations") == 1) & ~F.col("scan_running") & F.col("identity_key").eqNullSafe(F.col("_identity"))
    j = events.join(known, ["scope_id", "path"], "left")
    return j.withColumn("kind", F.when((F.col("kind") == "file_delta") & F.coalesce(ok, F.lit(False)), "file_delta").otherwise("full_scope")).select(*events.columns)


def schedule(events: DataFrame, now_ms: int, scopes: int = 4) -> DataFrame:
    """The next scopes to reconcile: due ones, those in progress first, then by deadline and id."""
    reconciling = (F.col("status") != "reconciling").cast("int")
    due = events.filter((F.col("due_at_unix_ms") <= now_ms) | (F.col("status") == "reconciling"))
    return due.orderBy(reconciling, "due_at_unix_ms", "scope_id").limit(scopes)


def poll_schedule(polls: DataFrame, now_ms: int, scopes: int = 4, poll_ms: int = 300_000) -> DataFrame:
    """What a cycle does with the polls of its scopes (scope_id, due_at_unix_ms, deferred_due_at_unix_ms or null, active).

    Due scopes without an active event go in order: those put off before by their first deadline, the others by their
    own, ties by id. The first few are scheduled and polled again after the interval; the rest are put off, keep their first
    deadline and come back in a second. A scope with an active event is put off no longer; nothing else changes.
    """
    deferred, due = F.col("deferred_due_at_unix_ms"), (F.col("due_at_unix_ms") <= now_ms) & ~F.col("active")
    order = [deferred.isNull().cast("int"), F.coalesce(deferred, "due_at_unix_ms"), F.col("scope_id")]
    first = polls.filter(due).orderBy(*order).limit(scopes).select("scope_id", F.lit(True).alias("_first"))  # a few rows
    taken, waits = F.col("_first").isNotNull(), due & F.col("_first").isNull()
    at = F.when(taken, F.lit(now_ms + poll_ms).cast("long")).when(waits, F.lit(now_ms + RETRY_MS["deferred"]).cast("long")).otherwise(F.col("due_at_unix_ms"))
    kept = F.when(waits, F.coalesce(deferred, "due_at_unix_ms")).when(~taken & ~F.col("active"), deferred)
    return polls.join(F.broadcast(first), "scope_id", "left").select("scope_id", taken.alias("scheduled"), at.alias("due_at_unix_ms"), kept.alias("deferred_due_at_unix_ms"))


def retry_at(outcome: Column, now_ms: int) -> Column:
    """When an event or a scope is looked at again after an outcome of RETRY_MS; null for any other."""
    times = [x for name, ms in RETRY_MS.items() for x in (F.lit(name), F.lit(now_ms + ms).cast("long"))]
    return F.try_element_at(F.create_map(*times), outcome)


def recheck(events: DataFrame, found: DataFrame, now_ms: int, w: Watch = Watch()) -> DataFrame:
    """Due events whose file has changed since the last hint stabilize anew; the others go on to be reconciled.

    ``events``: those of EVENTS and path, size_bytes, modified_unix_ns, identity_key as last observed; ``found``:
    scope_id, path, observed_kind and the same three, as they are now; a path that isn't found is missing. A change counts as
    a hint of now: the deadline moves, the count grows, and a file keeps the event's kind while all else widens it.
    """
    snapshot = ("size_bytes", "modified_unix_ns", "identity_key")
    now = found.select("scope_id", "path", F.col("observed_kind").alias("_kind"), *[F.col(c).alias(f"_{c}") for c in snapshot])
    j = events.join(now, ["scope_id", "path"], "left")
    changed = ~F.col(snapshot[0]).eqNullSafe(F.col(f"_{snapshot[0]}"))
    for c in snapshot[1:]:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    late = F.lit(now_ms + w.window_ms) > F.col("first_at_unix_ms") + w.max_age_ms
    values = {
        "last_at_unix_ms": F.lit(now_ms).cast("long"), "due_at_unix_ms": F.least(F.lit(now_ms + w.window_ms).cast("long"), F.col("first_at_unix_ms") + w.max_age_ms),
        "hints": F.col("hints") + 1, "kind": F.when(late | ~F.col("_kind").eqNullSafe("file"), "full_scope").otherwise(F.col("kind")), "widened": late, **{c: F.col(f"_{c}") for c in snapshot},
    }
    columns = [F.when(changed, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in events.columns]
    return j.select(*columns, F.when(changed, "stabilizing").otherwise("reconciling").alias("status"))


def next_wake(now_ms: int, *times: Column) -> Column:
    """The earliest of deadlines, retries and polls, but no sooner than 50 ms from now."""
    return F.greatest(F.lit(now_ms + 50).cast("long"), F.least(*times))


def with_overflow(hints: DataFrame, control: DataFrame, scopes: DataFrame) -> DataFrame:
    """Hints and, for each overflow or source error (observed_at_unix_ms), a hint that widens every scope."""
    lost = control.select("observed_at_unix_ms").join(scopes.select("scope_id").distinct())  # few control rows, every scope
    return hints.select("scope_id", "path", "observed_kind", "observed_at_unix_ms").unionByName(lost.select("scope_id", F.lit(None).cast("string").alias("path"), F.lit("missing").alias("observed_kind"), "observed_at_unix_ms"))


def cycle_report(events: DataFrame, now_ms: int) -> DataFrame:
    """One row on a cycle's events: how many wait, are due, are widened, and when to wake next."""
    due = F.col("due_at_unix_ms") <= now_ms
    return events.agg(
        F.count("*").alias("events"), F.count_if(due).alias("due"), F.count_if(~due).alias("waiting"), F.count_if("widened").alias("widened"), F.count_if(F.col("kind") == "file_delta").alias("file_deltas"),
        F.greatest(F.lit(now_ms + 50).cast("long"), F.min(F.when(~due, F.col("due_at_unix_ms")))).alias("next_wake_unix_ms"),
    )
