"""What a micro-batch does to the warehouse: once, however often it is delivered.

A batch's changes and the mark that says that it is done are published by one commit. A batch that is delivered again, after a
failure between the commit and the stream's own checkpoint, finds the mark and changes nothing; one that died before the
commit left nothing behind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import journal
from siltstone.schemas import SCHEMAS
from siltstone.sources.warehouse import Transaction, Warehouse


def once(warehouse: Warehouse, sink: str, batch_id: int, effect: Callable[[Transaction], None]) -> bool:
    """Runs ``effect`` in a transaction unless this batch of the sink has been published; returns whether it ran."""
    with warehouse.transaction() as t:
        done = t.read("applied_batches").filter((F.col("sink") == sink) & (F.col("batch_id") >= batch_id))
        if not done.isEmpty():
            return False
        effect(t)
        # a sink's batches come in order, so the last one speaks for all
        others = t.read("applied_batches").filter(F.col("sink") != sink)
        t.replace("applied_batches", others.unionByName(warehouse.spark.createDataFrame([(sink, batch_id)], SCHEMAS["applied_batches"])))
    return True


def applied(locations: DataFrame, found: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The manifest after single files have been looked at: ``found`` (keys, values) replaces the values of present locations, whose
    action becomes ``update`` if any differs. Other rows stay as they are; paths that the manifest lacks are left to a scan."""
    f = found.select(*keys, *[F.col(v).alias(f"_f_{v}") for v in values], F.lit(True).alias("_f"))
    j = locations.join(f, keys, "left")
    hit = F.col("_f").isNotNull() & F.col("present")
    differs = F.lit(False)
    for v in values:
        differs = differs | ~F.col(v).eqNullSafe(F.col(f"_f_{v}"))
    new = {v: F.when(hit, F.col(f"_f_{v}")).otherwise(F.col(v)) for v in values} | {"action": F.when(hit & differs, "update").otherwise(F.col("action"))}
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in locations.columns])


def record(warehouse: Warehouse, events: DataFrame) -> None:
    """Appends journal events (plan_id, sequence, event_kind; further columns null if absent) and brings the plans' kept states along,
    in one commit: the new events are read, the earlier ones only of plans whose events come out of order."""
    with warehouse.transaction() as t:
        history, before = t.read("action_journal_events"), t.read("action_plan_states")
        new = events.select(*[(F.col(f.name) if f.name in events.columns else F.lit(0 if not f.nullable else None)).cast(f.dataType).alias(f.name) for f in SCHEMAS["action_journal_events"].fields])
        t.replace("action_plan_states", journal.advance(before, new, history))
        t.append("action_journal_events", new)
