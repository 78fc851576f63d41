"""The spool of hints as a source, micro-batches that count once, and a stream that is stopped and started again."""

import os
import time

import pytest
from pyspark.sql import functions as F

from siltstone.engine import Engine
from siltstone.operators.search import Request
from siltstone.streaming import source, watch

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def taken(reader, start, end):
    return [row for part in reader.partitions(start, end) for row in reader.read(part)]


def test_a_replayed_offset_gives_the_same_hints(tmp_path):
    reader, spool = source.SpoolReader(str(tmp_path), 500), tmp_path / "host-1.jsonl"
    assert set(reader.latestOffset()) == {""} and reader.initialOffset() == {}
    spool.write_bytes(source.line("/a/é", "file", 5) + source.line("/b", "folder", 7) + b'{"path": "/c", "ki')  # a line still being written
    first = reader.latestOffset()
    assert taken(reader, {}, first) == taken(source.SpoolReader(str(tmp_path), 500), {}, first) == [("host-1", "/a/é", "file", 5, None), ("host-1", "/b", "folder", 7, None)]
    with spool.open("ab") as f:
        f.write(b'nd": "file", "at": 9}\nno hint\n')
    second = reader.latestOffset()
    assert [r[1:] for r in taken(reader, first, second)] == [("/c", "file", 9, None), (None, "missing", 9, "source_error")]
    with spool.open("ab") as f:
        f.write(source.line("/d", "file", 11) * 40)
    (tmp_path / "host-2.jsonl").write_bytes(source.line("/e", "missing", 3))
    third = reader.latestOffset()
    want = [("host-1", None, "missing", 11, "overflow"), ("host-2", "/e", "missing", 3, None)]
    assert taken(reader, second, third) == taken(reader, second, third) == want and taken(reader, third, third) == []
    (tmp_path / "host-3.jsonl").write_bytes(b"x" * 100)
    assert "host-3" not in reader.latestOffset()
    assert taken(reader, {}, first) == [("host-1", "/a/é", "file", 5, None), ("host-1", "/b", "folder", 7, None)]


def test_an_overflow_reaches_every_scope(spark):
    raw = spark.createDataFrame([("h", "/a/x", "file", 5, None), ("h", "/c", "file", 6, None), ("h", None, "missing", 7, "overflow")], source.RAW)
    scopes = spark.createDataFrame([(1, "/a"), (2, "/b")], "scope_id long, path_key string")
    got = sorted(tuple(r) for r in source.scope_hints(raw, scopes).select("scope_id", "observed_kind", "observed_at_unix_ms").collect())
    assert got == [(1, "file", 5), (1, "missing", 7), (2, "missing", 7)]
    assert {(r.scope_id, r.kind) for r in watch.coalesce_batch(source.scope_hints(raw, scopes)).collect()} == {(1, "full_scope"), (2, "full_scope")}


@pytest.fixture
def watched(spark, tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    (root / "a.md").write_text("first words")
    e = Engine(spark, f"file://{tmp_path}/warehouse")
    scope = e.add_scope(str(root))
    e.scan(scope)
    e.extract()
    return e, scope, root


def test_a_batch_delivered_twice_changes_nothing(spark, watched):
    e, scope, root = watched
    batch = lambda *rows: spark.createDataFrame(rows, "scope_id long, kind string, path string")
    (root / "a.md").write_text("second, longer words")
    assert e.apply_events(batch((scope, "file_delta", str(root / "a.md"))), 0)
    row = e.present().filter(F.endswith("path_key", F.lit("a.md"))).head()
    assert (row.size_bytes, row.action) == (20, "update") and e.search(Request("first words")).count() == 0  # its text is of the old file
    number = e.warehouse.snapshot().number
    (root / "a.md").write_text("third")
    assert not e.apply_events(batch((scope, "file_delta", str(root / "a.md"))), 0) and e.warehouse.snapshot().number == number
    assert e.apply_events(batch((scope, "file_delta", str(root / "gone.md")), (scope, "full_scope", None)), 1)
    assert [tuple(r) for r in e.warehouse.read("scan_requests").collect()] == [(scope, "watch", 1)]
    os.replace(root / "a.md", root / "b.md")
    (root / "a.md").write_text("another file")
    assert e.apply_events(batch((scope, "file_delta", str(root / "a.md"))), 2) and e.warehouse.read("scan_requests").count() == 2
    e.scan(scope)
    assert e.warehouse.read("scan_requests").count() == 0


def test_a_stopped_stream_keeps_its_deadlines(spark, watched, tmp_path):
    e, scope, root = watched
    spool, checkpoint = tmp_path / "spool", str(tmp_path / "checkpoint")
    spool.mkdir()
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    seen, inner = [], e.apply_events

    def apply(batch, batch_id, sink):
        seen.extend((r.scope_id, r.kind, r.path, r.hints) for r in batch.collect())
        return inner(batch, batch_id, sink)

    e.apply_events = apply
    window = watch.Watch(window_ms=12_000, max_age_ms=120_000)
    try:
        (root / "a.md").write_text("changed while watched")
        (spool / "h.jsonl").write_bytes(source.line(str(root / "a.md"), "file", int(time.time() * 1000)))
        q = e.watch(str(spool), checkpoint, window)
        end = time.time() + 60
        while sum(p["numInputRows"] for p in q.recentProgress) < 1 and time.time() < end:
            time.sleep(0.2)
        q.stop()  # between the hint and its deadline
        assert seen == []
        q = e.watch(str(spool), checkpoint, window)
        end = time.time() + 60
        while not seen and time.time() < end:
            time.sleep(0.5)
        while not e.present().filter("action = 'update' and kind = 'file'").count() and time.time() < end:
            time.sleep(1)
        time.sleep(2)
        q.stop()
    finally:
        spark.conf.unset(PROVIDER)
    assert seen == [(scope, "file_delta", str(root / "a.md"), 1)]
    assert e.present().filter(F.endswith("path_key", F.lit("a.md"))).head().size_bytes == 21
