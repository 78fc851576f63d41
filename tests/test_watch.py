"""Change hints: the state machine, its batch fold, its stream and the schedule."""

import time

import pytest
from pyspark.sql import functions as F

from siltstone.streaming import watch as W

SMALL = W.Watch(window_ms=1000, max_age_ms=5000)


def fold(spark, hints, w=SMALL):
    df = spark.createDataFrame(hints, W.HINTS)
    return sorted(tuple(r) for r in W.coalesce_batch(W.actionable(df), w).collect())


def test_hints_coalesce_until_quiet(spark):
    hints = [(1, "/a", "file", 0), (1, "/a", "file", 900), (1, "/a", "file", 1800), (1, "/a", "file", 2800), (2, "/b", "folder", 100)]
    assert fold(spark, hints) == [(1, 0, 1800, 2800, 3, "file_delta", False), (1, 2800, 2800, 3800, 1, "file_delta", False), (2, 100, 100, 1100, 1, "full_scope", False)]


def test_churn_is_widened_at_the_maximum_age(spark):
    hints = [(1, "/a", "file", t) for t in range(0, 12_000, 500)]
    assert fold(spark, hints) == [(1, 0, 4500, 5000, 10, "full_scope", True), (1, 5000, 9500, 10_000, 10, "full_scope", True), (1, 10_000, 11_500, 12_500, 4, "file_delta", False)]


def test_kinds_only_escalate(spark):
    assert fold(spark, [(1, "/a", "file", 0), (1, "/b", "file", 10)])[0][5] == "full_scope"  # two paths
    assert fold(spark, [(1, "/a", "missing", 0), (1, "/a", "file", 10)])[0][5] == "full_scope"
    assert fold(spark, [(1, "/a", "file", 0), (1, "/a", "file", 10)])[0][5] == "file_delta"


def test_ignored_names(spark):
    assert fold(spark, [(1, "/a/x.part", "file", 0), (1, "/a/.git/x", "file", 0), (1, "/.h", "file", 0)]) == []


def test_storm_is_one_event(spark):
    assert [r[4] for r in fold(spark, [(1, "/a", "file", 7)] * 5000)] == [5000]


def test_routing(spark):
    hints = spark.createDataFrame([("/a/b/c", "file", 0), ("/a/bc", "file", 0)], "path string, observed_kind string, observed_at_unix_ms long")
    scopes = spark.createDataFrame([(1, "/a"), (2, "/a/b")], "scope_id long, path_key string")
    assert sorted((r.scope_id, r.path) for r in W.routed(hints, scopes).collect()) == [(1, "/a/b/c"), (1, "/a/bc"), (2, "/a/b/c")]


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    hints = [(s, "/a", "file" if t % 3 else "folder", 1_000_000 + 700 * t * s + t * t * 40) for s in (1, 2, 3) for t in range(20)]
    rows = sorted(hints, key=lambda h: h[3]) + [(9, "/z", "file", 10_000_000)]  # the last moves the watermark on
    source, out = tmp_path / "in", tmp_path / "out"
    for i in range(0, len(rows), 20):
        spark.createDataFrame(rows[i : i + 20], W.HINTS).coalesce(1).write.mode("append").parquet(str(source))
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(W.HINTS).option("maxFilesPerTrigger", 1).parquet(str(source)).withColumn("observed_at", F.timestamp_millis("observed_at_unix_ms"))
        q = W.coalesce_stream(stream, SMALL, "0 seconds").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(out))
        assert q.awaitTermination(180)
    finally:
        spark.conf.unset(provider)
    got = sorted(tuple(r) for r in spark.read.parquet(str(out)).collect())
    want = [r for r in fold(spark, rows) if r[0] != 9]
    assert got == want


def test_late_hints_of_a_stream_coalesce(spark, tmp_path):
    source, out, wide = tmp_path / "in", tmp_path / "out", W.Watch(window_ms=20_000, max_age_ms=120_000)
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source.mkdir()
    q = W.coalesce_stream(spark.readStream.schema(W.HINTS).parquet(str(source)), wide).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start(str(out))
    try:
        now = int(time.time() * 1000)
        for i, row in enumerate([(1, "/a", "file", now), (2, "/b", "file", now + 900), (1, "/a", "file", now - 500)]):
            spark.createDataFrame([row], W.HINTS).coalesce(1).write.mode("append").parquet(str(source))
            end = time.time() + 60
            while sum(p["numInputRows"] for p in q.recentProgress) <= i and time.time() < end:
                time.sleep(0.2)
        end, got = time.time() + 90, []
        while len(got) < 2 and time.time() < end:
            time.sleep(1)
            got = spark.read.schema(W.EVENTS).parquet(str(out)).collect() if out.exists() else []
    finally:
        q.stop()
        spark.conf.unset(provider)
    assert sorted((r.scope_id, r.hints) for r in got) == [(1, 2), (2, 1)]


def test_deltas_need_a_plain_known_file(spark):
    e = spark.createDataFrame([(1, "/a", "file_delta", b"i"), (1, "/b", "file_delta", b"i"), (1, "/c", "file_delta", b"x"), (1, "/d", "file_delta", b"i"), (1, "/a", "full_scope", b"i")], "scope_id long, path string, kind string, identity_key binary")
    m = spark.createDataFrame([(1, "/a", True, 1, 1, False, b"i"), (1, "/b", True, 2, 1, False, b"i"), (1, "/c", True, 1, 1, False, b"i")], "scope_id long, path string, present boolean, link_count int, locations int, scan_running boolean, identity_key binary")
    assert sorted((r.path, r.kind) for r in W.deltas(e, m).collect()) == [("/a", "file_delta"), ("/a", "full_scope"), ("/b", "full_scope"), ("/c", "full_scope"), ("/d", "full_scope")]


def test_schedule_and_wake(spark):
    s = spark.createDataFrame([(i, 100 - i, "stabilizing") for i in range(6)] + [(9, 999, "reconciling")], "scope_id long, due_at_unix_ms long, status string")
    assert [r.scope_id for r in W.schedule(s, 100).collect()] == [9, 5, 4, 3]
    assert spark.range(1).select(W.next_wake(1000, F.lit(1010), F.lit(5000)).alias("t")).head().t == 1050


def test_polls_put_off_keep_their_first_deadline(spark):
    p = spark.createDataFrame([(i, 100 + i, None, False) for i in range(5)] + [(7, 150, 90, False), (8, 100, 50, True), (9, 900, None, False)], "scope_id long, due_at_unix_ms long, deferred_due_at_unix_ms long, active boolean")
    got = {r.scope_id: tuple(r)[1:] for r in W.poll_schedule(p, 200, scopes=3, poll_ms=5000).collect()}
    assert got == {7: (True, 5200, None), 0: (True, 5200, None), 1: (True, 5200, None), 2: (False, 1200, 102), 3: (False, 1200, 103), 4: (False, 1200, 104), 8: (False, 100, None), 9: (False, 900, None)}
    times = spark.range(1).select(*[W.retry_at(F.lit(x), 10).alias(x) for x in ("active", "contention", "error", "completed")]).head()
    assert tuple(times) == (60, 1010, 30_010, None)


def test_changed_snapshots_stabilize_anew(spark):
    e = [(i, "/a", 0, 0, 1000, 1, "file_delta", False, 5, 1, b"i") for i in range(4)] + [(4, "/a", -9000, 0, 1000, 1, "file_delta", False, 5, 1, b"i"), (5, "/a", 0, 0, 1000, 1, "full_scope", False, None, None, None)]
    f = [(0, "/a", "file", 5, 1, b"i"), (1, "/a", "file", 6, 1, b"i"), (2, "/a", "folder", 5, 1, b"j"), (4, "/a", "file", 6, 1, b"i")]
    events = spark.createDataFrame(e, W.EVENTS.replace("scope_id long", "scope_id long, path string") + ", size_bytes long, modified_unix_ns long, identity_key binary")
    found = spark.createDataFrame(f, "scope_id long, path string, observed_kind string, size_bytes long, modified_unix_ns long, identity_key binary")
    got = {r.scope_id: (r.status, r.due_at_unix_ms, r.hints, r.kind, r.size_bytes) for r in W.recheck(events, found, 1000, SMALL).collect()}
    assert got == {
        0: ("reconciling", 1000, 1, "file_delta", 5), 1: ("stabilizing", 2000, 2, "file_delta", 6), 2: ("stabilizing", 2000, 2, "full_scope", 5), 3: ("stabilizing", 2000, 2, "full_scope", None),
        4: ("stabilizing", -4000, 2, "full_scope", 6), 5: ("reconciling", 1000, 1, "full_scope", None),
    }


@pytest.mark.parametrize("at,due", [(0, 1000), (4600, 5000)])
def test_deadline(at, due):
    assert W.Pending(0, at, 1, "file_delta", "/a").due(SMALL) == due
