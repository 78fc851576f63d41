"""The engine end to end over a real folder, and the modules around it."""

import os

import pytest
from pyspark.sql import functions as F

from siltstone.engine import Engine
from siltstone.errors import EngineError
from siltstone.operators import actions
from siltstone.operators.search import Request
from siltstone.sources import listing, recognition
from siltstone.sources.warehouse import Warehouse
from siltstone.streaming import watch


@pytest.fixture(scope="module")
def demo(spark, tmp_path_factory):
    """README, code and marker, one duplicate pair, a v1 and a v2."""
    root = tmp_path_factory.mktemp("demo") / "collection"
    (root / "app" / "src").mkdir(parents=True)
    (root / "notes").mkdir()
    for name, text in {
        "app/README.md": "Project evidence for the demo 專案資料", "app/Cargo.toml": "[package]\nname = 'demo'\n", "app/src/main.rs": "fn main() { search_local(); }\n", "notes/copy-a.txt": "the same words\n", "notes/copy-b.txt": "the same words\n",
        "notes/plan-v1.md": "first plan\n", "notes/plan-v2.md": "second plan, longer\n", "notes/.hidden": "x", "notes/bad.txt": "",
    }.items():
        (root / name).write_text(text)
    (root / "notes" / "broken.md").write_bytes(b"\xff\xfe\xff")
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('warehouse')}")
    scope = e.add_scope(str(root))
    e.scan(scope)
    e.extract()
    return e, scope, root


def test_demo(demo):
    e, scope, root = demo
    # a file without content is listed, so it counts; the hidden one is an issue
    assert e.stats().head().asDict() == {"scopes": 1, "nodes": 13, "files": 9, "folders": 4, "active_locations": 13, "issues": 1, "completed_scans": 1, "ready": True}
    hits = e.search(Request("project evidence")).collect()
    assert [os.path.basename(r.display_path) for r in hits] == ["README.md"] and hits[0].explanation == "extracted_text_substring"
    assert e.search(Request("專案資料", scope_id=scope)).count() == 1 and e.search(Request("search_local", extension="rs")).count() == 1
    assert e.search(Request("plan-v1.md")).orderBy("lexical_rank").first().explanation == "exact_filename"
    assert [(r.confidence_basis_points, r.strong_signals) for r in e.projects().collect()] == [(8500, 1)]
    assert e.duplicates().count() == 1
    assert [(r.older_version, r.newer_version) for r in e.versions().collect()] == [(1, 2)]
    assert {(r.status, r.error_code) for r in e.extracted().collect()} == {("completed", None), ("failed", "extraction_invalid_utf8")}


def test_scan_resumes_after_any_round(spark, tmp_path):
    root = tmp_path / "tree"
    for name in ("a/b/c/deep.txt", "a/one.txt", "z/two.txt", "three.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    paths = lambda e: {os.path.relpath(r.path_key, root) for r in e.present().filter("kind = 'file'").collect()}
    want = {"a/b/c/deep.txt", "a/one.txt", "z/two.txt", "three.txt"}
    for stop in (1, 3, 4):
        e = Engine(spark, f"file://{tmp_path}/w{stop}")
        scope = e.add_scope(str(root))
        assert e.scan(scope, rounds=stop).isEmpty() and paths(e) == set()
        states = {os.path.relpath(r.path_key, root): r.state for r in e.scan_queue(scope).collect()}
        assert [states[p] for p in (".", "a", "a/b", "a/b/c")[:stop]] == ["done"] * (stop - 1) + ["pending"] and "a/b/c/d" not in states
        late = root / f"late-{stop}.txt"
        late.write_text("x")  # the root is not listed again unless its round is still to come
        assert {r.action: r["count"] for r in e.scan(scope).collect()} == {"insert": 10 if stop == 1 else 9}
        assert paths(e) == want | ({late.name} if stop == 1 else set()) and e.scan_queue(scope).isEmpty()
        e.scan(scope)
        assert paths(e) == want | {late.name}
        assert not os.path.exists(tmp_path / f"w{stop}" / f"scan_entries_{scope}") or not os.listdir(tmp_path / f"w{stop}" / f"scan_entries_{scope}")
        late.unlink()
    # a job that dies within a round leaves the rounds before it
    e = Engine(spark, f"file://{tmp_path}/w9")
    scope = e.add_scope(str(root))
    e.scan(scope, rounds=2)
    with pytest.raises(RuntimeError), e.warehouse.transaction() as t:
        t.append(f"scan_entries_{scope}", t.read(f"scan_entries_{scope}"))
        raise RuntimeError
    e.scan(scope)
    assert paths(e) == want


def test_listing_reports_what_it_cannot_read(monkeypatch, tmp_path):
    class Broken:
        def __init__(self, found):
            self.found = found

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return False

        def __next__(self):
            if not self.found:
                raise OSError
            return self.found.pop()

    (tmp_path / "x").write_text("x")
    raw = os.fsencode(tmp_path)
    assert list(listing.names(raw + b"/none")) == [(raw + b"/none", "directory_read_denied")]
    first = next(os.scandir(raw))
    monkeypatch.setattr(listing.os, "scandir", lambda path: Broken([first]))
    assert list(listing.names(raw)) == [(raw + b"/x", None), (raw, "directory_entry_unavailable")]


def test_folder_scope(demo):
    e, scope, root = demo
    notes = e.folders().filter(F.endswith("display_path", F.lit("/notes"))).head()
    assert {os.path.basename(r.display_path) for r in e.search(Request("plan", scope_id=scope, folder_node_id=notes.node_id)).collect()} == {"plan-v1.md", "plan-v2.md"}
    p = e.folder_profile(notes.node_id).head()
    assert (p.direct_files, p.direct_folders, p.document_files) == (6, 0, 6)


def test_inbox_and_decisions(demo):
    e, _, _ = demo
    assert e.record_relations() == 2 and e.record_relations() == 0
    items = e.inbox().orderBy("position").collect()
    assert [r.kind for r in items] == ["exact_duplicate", "version"]
    assert e.decide(items[0].source_id, "rejected") and not e.decide(items[0].source_id, "rejected")
    assert [r.kind for r in e.inbox().collect()] == ["version"]
    assert e.decide(items[0].source_id, "accepted")


def test_rescan_after_a_change(demo):
    e, scope, root = demo
    before = {r.action: r["count"] for r in e.scan(scope).collect()}
    assert set(before) == {"unchanged"}
    os.rename(root / "notes" / "copy-b.txt", root / "notes" / "moved.txt")
    (root / "notes" / "plan-v1.md").write_text("changed words\n")
    after = {r.action: r["count"] for r in e.scan(scope).collect()}
    assert (after["insert"], after["tombstone"], after["update"] >= 1) == (1, 1, True)
    assert e.search(Request("copy-b")).count() == 0 and e.search(Request("moved.txt")).count() == 1
    assert e.search(Request("first plan")).count() == 0  # text of a changed file no longer counts
    e.extract()
    assert e.search(Request("changed words")).count() == 1


def test_overlapping_scopes_are_refused(demo):
    e, _, root = demo
    with pytest.raises(EngineError) as x:
        e.add_scope(str(root / "app"))
    assert x.value.code == "coverage_root_overlap"
    with pytest.raises(EngineError):
        e.add_scope("/etc")
    assert e.health().count() == 6


def test_versions_of_a_table(spark, tmp_path):
    w = Warehouse(spark, f"file://{tmp_path}")
    row = lambda *ids: spark.createDataFrame([(i,) for i in ids], "node_id long")
    assert w.read("folders").count() == 0 and w.version("folders") is None
    first = w.replace("folders", row(1, 2))
    w.append("folders", row(3))
    assert sorted(r.node_id for r in w.read("folders").collect()) == [1, 2, 3] and w.version("folders") == first
    for i in range(3):
        w.replace("folders", row(10 + i))
    assert [r.node_id for r in w.read("folders").collect()] == [12] and w.vacuum("folders") == 2
    with pytest.raises(EngineError):
        w.replace("folders", spark.createDataFrame([(None,)], "node_id long"))
    assert [r.node_id for r in w.read("folders").collect()] == [12]  # a refused version is not published


def test_rename_previews(spark):
    r = spark.createDataFrame([("/s", "/s/a.md", "b.md", 1, False), ("/s", "/s/a.md", "A.md", 1, True), ("/s", "/s/a.md", "a.md", 1, True), ("/s", "/s/a.md", "NUL", 1, False), ("/s", "/t/a.md", "b.md", 1, False), ("/s", "/s/a.md", "b.md", 1, True), ("/s", "/s/a.md", "b.md", 2**40, False)], "scope_root string, source_path string, new_name string, size_bytes long, destination_exists boolean")
    got = [(x.error_code, x.strategy, x.action_authorized) for x in actions.rename_previews(r).collect()]
    assert got == [(None, "direct", False), (None, "staged", False), ("action_name_unchanged", "direct", False), ("action_name_not_portable", "direct", False), ("action_source_outside_scope", "direct", False), ("action_destination_exists", "direct", False), ("action_source_too_large", "direct", False)]


def test_cleanup_previews(spark):
    c = spark.createDataFrame([("exact_duplicate", 1, 10, 11), ("exact_duplicate", 2, 10, 12), ("version", 3, 10, None), ("screenshot_group", 4, 10, None), ("screenshot_group", 5, 10, 11), ("version", 6, 10, 99)], "kind string, source_id long, target_node_id long, keeper_node_id long")
    o = spark.createDataFrame([(10, "a", 1), (11, "a", 1), (12, "b", 1)], "node_id long, sha256 string, size_bytes long")
    got = {r.source_id: r.error_code for r in actions.cleanup_previews(c, o).collect()}
    assert got == {1: None, 2: "file_relation_content_differs", 3: "cleanup_keeper_invalid", 4: None, 5: "cleanup_keeper_invalid", 6: "cleanup_source_not_current"}


def test_exclusion_batches(spark):
    make = lambda *rows: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "selection_id long, path_key string, identity_kind string")
    assert actions.check_exclusions(make(("/a/b", "inode"), ("/a/bc", "inode")), "/a").count() == 2
    for rows, code in (([("/a", "inode")], "scope_exclusion_not_strict_descendant"), ([("/a/b", "inode"), ("/a/b/c", "inode")], "scope_exclusion_overlap"), ([("/a/b", "path_fallback")], "scope_exclusion_identity_weak"), ([(f"/a/{i}", "inode") for i in range(65)], "scope_exclusion_batch_too_large")):
        with pytest.raises(EngineError) as x:
            actions.check_exclusions(make(*rows), "/a")
        assert x.value.code == code


def test_recognized_regions(spark):
    o = "case_id string, position long, text string, x_ppm long, y_ppm long, width_ppm long, height_ppm long, confidence_basis_points long"
    rows = [("a", 2, "second", 0, 0, 10, 10, None), ("a", 1, "first", 0, 0, 10, 10, 9000), ("a", 3, "second", 0, 0, 10, 10, None), ("a", 4, " ", 0, 0, 10, 10, 1), ("b", 1, "x", 0, 0, 0, 10, 1), ("c", 1, "x", 0, 0, 5, 5, 10_001)]
    got = recognition.region_chunks(spark.createDataFrame(rows, o)).orderBy("case_id", "ordinal").collect()
    assert [(r.case_id, r.ordinal, r.text, r.source_confidence_basis_points, r.error_code) for r in got] == [("a", 0, "first", 9000, None), ("a", 1, "second", None, None), ("b", None, None, None, "extraction_ocr_box_invalid"), ("c", None, None, None, "extraction_ocr_confidence_invalid")]
    d = spark.createDataFrame([(1, 10, 10, "png"), (1, 10, 10, "gif"), (2**26, 10, 10, "png"), (1, 20_000, 1, "jpg")], "s long, w int, h int, e string")
    assert [bool(r.c) for r in d.select(recognition.request_code(F.col("s"), F.col("w"), F.col("h"), F.col("e")).alias("c")).collect()] == [False, True, True, True]


def test_overflow_and_report(spark):
    hints = spark.createDataFrame([(1, "/a", "file", 0)], watch.HINTS)
    all_ = watch.with_overflow(hints, spark.createDataFrame([(10,)], "observed_at_unix_ms long"), spark.createDataFrame([(1,), (2,)], "scope_id long"))
    events = watch.coalesce_batch(all_)
    assert sorted((r.scope_id, r.kind) for r in events.collect()) == [(1, "full_scope"), (2, "full_scope")]
    r = watch.cycle_report(events, 500).head()
    assert (r.events, r.due, r.waiting, r.next_wake_unix_ms) == (2, 0, 2, 1010)


def test_observations_and_totals(spark):
    o = spark.createDataFrame([(1, 1, 5), (2, 1, 7), (3, 1, 7), (4, 2, 1)], "id long, relation_id long, observed_at_unix_ms long")
    assert sorted(r.id for r in actions.latest_observation(o).collect()) == [3, 4]
    assert [r.id for r in actions.recent(o, 2).collect()] == [4, 3]
    m = spark.createDataFrame([(1, 5), (1, 6)], "group_id long, size_bytes long")
    assert tuple(actions.group_totals(m).head()) == (1, 2, 11)
    s = spark.createDataFrame([(1, 4)], "scope_id long, policy_revision long")
    actions.guard_revision(s, 1, 4)
    with pytest.raises(EngineError):
        actions.guard_revision(s, 1, 5)


def test_search_fails_closed_and_exclusions_purge(spark, tmp_path):
    root = tmp_path / "root"
    (root / "private").mkdir(parents=True)
    (root / "a.md").write_text("visible words")
    (root / "private" / "b.md").write_text("secret words")
    e = Engine(spark, f"file://{tmp_path}/warehouse")
    scope = e.add_scope(str(root))
    e.scan(scope)
    e.extract()
    assert e.search(Request("words")).count() == 2
    inner = e._search

    def changed(request):
        out = inner(request)
        e.exclude(scope, str(root / "private"), 1)
        return out

    e._search = changed
    with pytest.raises(EngineError, match="scope_policy_changed"):
        e.search(Request("words"))
    e._search = inner
    assert [os.path.basename(r.display_path) for r in e.search(Request("words")).collect()] == ["a.md"]
    receipts = {r.table_name: r.purged_rows for r in e.warehouse.read("privacy_receipts").collect()}
    assert receipts == {"locations": 2, "edges": 2, "file_relations": 0, "content_chunks": 1}
    with pytest.raises(EngineError, match="scope_policy_changed"):
        e.revoke(scope, 1)
    e.revoke(scope, 2)
    assert e.present().count() == 0 and e.extracted().count() == 0 and e.search(Request("words")).count() == 0
