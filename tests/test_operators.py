"""Search, graph, relations, journals, evaluation, manifest and privacy on small fixtures with known numbers."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone import schemas
from siltstone.errors import EngineError
from siltstone.operators import closure, equality, evaluation, graph, journal, manifest, privacy, relations
from siltstone.operators import search as S


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()), key=str)


def code(f):
    with pytest.raises(EngineError) as e:
        f()
    return e.value.code


# ---- search

LOCATIONS = [(1, 1, 11, "/work/plan.md", 5_000_000_000), (1, 2, 12, "/work/other plan.md notes.txt", 9_000_000_000), (2, 3, 13, "/home/x.md", None)]
CHUNKS = [(1, 1, 11, 1, "/work/plan.md", 5_000_000_000, "see plan.md here"), (1, 1, 11, 2, "/work/plan.md", 5_000_000_000, "again PLAN.MD"), (2, 3, 13, 3, "/home/x.md", None, "nothing of plan.md"), (1, 2, 12, 4, "/work/other plan.md notes.txt", 9_000_000_000, "zzz")]


@pytest.fixture(scope="module")
def corpus(spark):
    meta = "scope_id long, node_id long, location_id long, display_path string, modified_unix_ns long"
    return spark.createDataFrame(LOCATIONS, meta), spark.createDataFrame(CHUNKS, meta.replace("display_path", "chunk_id long, display_path") + ", text string")


def test_fusion_puts_exact_names_first(corpus):
    got = S.search(S.Request("plan.md"), *corpus).orderBy("lexical_rank").collect()
    assert [(r.node_id, r.explanation, r.lexical_rank) for r in got] == [(1, "exact_filename_and_extracted_text", 1), (2, "path_substring", 2), (3, "extracted_text_substring", 3)]
    assert got[0].matched_fields == ["filename", "path", "extracted_text"] and "[" in got[0].snippet and got[1].snippet is None


def test_filters(corpus):
    ids = lambda **k: rows(S.search(S.Request("plan.md", **k), *corpus), "node_id")
    assert ids(scope_id=2) == [3] and ids(extension="txt") == [2] and ids(source="content") == [1, 3]
    assert ids(modified_since_s=5) == [1, 2] and ids(modified_before_s=9) == [1] and ids(modified_since_s=6, modified_before_s=9) == []


def test_operators_are_never_interpreted(corpus):
    assert S.search(S.Request('plan.md" OR "x'), *corpus).count() == 0 and S.search(S.Request("plan%md"), *corpus).count() == 0


def test_exclusions_by_path_and_identity(spark):
    r = spark.createDataFrame([(1, 1, 1, "/a/b", "inode", b"1"), (1, 2, 2, "/a/bc", "inode", b"2"), (1, 3, 3, "/a/b/c", "inode", b"3"), (2, 4, 4, "/a/b", "inode", b"4"), (1, 5, 5, "/z", "inode", b"9")], "scope_id long, node_id long, location_id long, path_key string, identity_kind string, identity_key binary")
    e = spark.createDataFrame([(1, "path", "/a/b", None, None), (1, "identity", "", "inode", b"9")], "scope_id long, kind string, path_key string, identity_kind string, identity_key binary")
    assert rows(S.without_excluded(r, e), "node_id") == [2, 4]


def test_agent_projection_bounds(corpus):
    out = S.agent_projection(S.search(S.Request("plan.md"), *corpus), field_bytes=8, payload_bytes=70)
    got = out.collect()
    assert all(len(r.display_path.encode()) <= 8 for r in got) and all(r.truncated for r in got) and 0 < len(got) < 3


def test_many_queries(spark, corpus):
    q = spark.createDataFrame([(1, "PLAN.md"), (2, "again"), (3, "absent")], "query_id long, query string")
    index = S.trigram_index(corpus[1], "chunk_id", "text")
    assert rows(S.search_many(q, corpus[1], index, "chunk_id", "text"), "query_id", "chunk_id") == [(1, 1), (1, 2), (1, 3), (2, 2)]


# ---- graph

EDGES = "scope_id long, source_node_id long, target_node_id long, kind string, active boolean"


@pytest.fixture(scope="module")
def project(spark):
    """Root 1: Cargo.toml, README.md, data.csv, src/ (main.rs), assets/ (logo.png)."""
    tree = [(2, 1, "file", "Cargo.toml", 10), (3, 1, "file", "README.md", 20), (4, 1, "file", "data.csv", 30), (5, 1, "folder", "src", None), (6, 1, "folder", "assets", None), (7, 5, "file", "main.rs", 40), (8, 6, "file", "logo.png", 50)]
    edges = spark.createDataFrame([(1, a, b, "located_in", True) for a, b, *_ in tree], EDGES)
    nodes = spark.createDataFrame([(1, "folder", "root", None, None)] + [(a, k, n, s, a * 100 if s else None) for a, _, k, n, s in tree], "node_id long, kind string, name string, size_bytes long, modified_unix_ns long")
    return edges, nodes


def test_folder_profile(project):
    p = graph.folder_profile(*project, 1).head()
    assert (p.direct_files, p.direct_folders, p.descendant_files, p.descendant_folders) == (3, 2, 5, 2)
    assert (p.code_files, p.document_files, p.data_files, p.image_files, p.other_files) == (2, 1, 1, 1, 0)
    assert (p.total_bytes, p.latest_modified_unix_ns) == (150, 800)
    s = graph.folder_profile(*project, 5).head()
    assert (s.direct_files, s.descendant_files, s.descendant_folders) == (1, 1, 0)
    assert code(lambda: graph.folder_profile(*project, 1, bound=1)) == "folder_profile_entry_limit_exceeded"


def test_folder_profile_beyond_the_former_bound(spark):
    n = 100_001
    edges = spark.range(2, n + 2).selectExpr("1L AS scope_id", "id AS source_node_id", "1L AS target_node_id", "'located_in' AS kind", "true AS active")
    nodes = spark.range(1, n + 2).selectExpr("id AS node_id", "if(id = 1, 'folder', 'file') AS kind", "'a.rs' AS name", "2L AS size_bytes", "id AS modified_unix_ns")
    p = graph.folder_profile(edges, nodes, 1).head()
    assert (p.direct_files, p.descendant_files, p.code_files, p.total_bytes) == (n, n, n, 2 * n)


def test_suggestions(spark, project):
    edges, nodes = project
    children = edges.join(nodes, edges.source_node_id == nodes.node_id).select(F.col("target_node_id").alias("folder_node_id"), "name")
    signals = graph.markers(children)
    assert rows(signals, "signal") == ["cargo_manifest", "readme"]
    assert rows(graph.project_confidence(signals), "folder_node_id", "confidence_basis_points") == [(1, 8500)]
    both = spark.createDataFrame([(1, "Cargo.toml"), (1, "app.xcodeproj"), (1, "go.mod"), (1, "x.sln"), (2, "README")], "folder_node_id long, name string")
    assert rows(graph.project_confidence(graph.markers(both)), "folder_node_id", "confidence_basis_points") == [(1, 9500)]


def test_discovery_is_bounded_and_says_so(spark):
    out = graph.project_roots(spark.range(1, 102).withColumnRenamed("id", "node_id")).collect()
    assert len(out) == 100 and not any(r.evaluation_complete for r in out)
    assert all(r.evaluation_complete for r in graph.project_roots(spark.range(5).withColumnRenamed("id", "node_id")).collect())


def test_cycles_end(spark):
    edges = spark.createDataFrame([(1, 2, 1, "located_in", True), (1, 3, 2, "located_in", True), (1, 1, 3, "located_in", True), (1, 4, 3, "located_in", False)], EDGES)
    assert rows(graph.descendants(edges, spark.createDataFrame([(1,)], "node_id long")), "node_id") == [1, 2, 3]


def test_subtree_is_fenced_by_path(spark):
    edges = spark.createDataFrame([(1, 2, 1, "located_in", True)], EDGES)
    places = spark.createDataFrame([(1, 1, 1, "folder", "/a", True), (2, 1, 2, "file", "/a/x", True), (3, 1, 2, "file", "/b/x", True), (4, 1, 2, "file", "/a/gone", False)], "id long, scope_id long, node_id long, kind string, path_key string, present boolean")
    assert rows(graph.subtree(edges, places, 1, 1), "id") == [1, 2]
    for node in (9, 2):  # unknown, no folder
        assert code(lambda: graph.subtree(edges, places, 1, node)) == "search_folder_invalid"


def test_roots(spark):
    make = lambda *paths: spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "root_id long, path_key string")
    assert rows(graph.root_overlaps(make("/a/b", "/a/bc", "/a/b/c")), "ancestor_id", "descendant_id") == [(0, 2)]
    assert rows(graph.minimal_roots(make("/a/b", "/a/bc", "/a/b/c", "/a/b")), "root_id") == [0, 1]
    assert graph.check_roots(make("/a/b", "/a/bc")).count() == 2
    assert code(lambda: graph.check_roots(make("/a", "/a/b"))) == "coverage_root_overlap"
    assert code(lambda: graph.check_roots(make("/x"), make("/x/y"))) == "coverage_root_overlap"
    assert code(lambda: graph.check_roots(make(*[f"/r{i}" for i in range(33)]))) == "coverage_set_too_large"
    assert code(lambda: graph.check_roots(make("/a").limit(0))) == "coverage_set_empty"


# ---- relations


def test_duplicates_form_stars(spark):
    f = spark.createDataFrame([(1, 5, "x"), (1, 3, "x"), (1, 9, "x"), (1, 4, "y"), (2, 1, "x"), (1, 7, ""), (1, 8, ""), (1, 3, "x")], "scope_id long, node_id long, content string")
    assert rows(relations.exact_duplicates(f), "left_node_id", "right_node_id", "members") == [(3, 5, 3), (3, 9, 3)]


def test_equality_in_stages_of_files(spark, tmp_path):
    """Files that differ in size, ends, middle, not at all; one that has gone, one that has grown, one beyond the bound."""
    big = bytes(range(256)) * 800
    middle = big[:100_000] + b"x" + big[100_001:]
    texts = {1: b"a", 2: b"bb", 3: b"cc", 4: big, 5: middle, 6: big, 7: big, 8: b"", 9: b"dd", 10: b"grown", 11: b"other", 12: b"y" * 300_000, 13: None, 14: b"bb"}
    data = []
    for n, text in texts.items():
        (tmp_path / str(n)).write_bytes(text if text is not None else b"")
        data.append((1, n, str(tmp_path / str(n)), 2 if text is None else len(text)))
    (tmp_path / "13").unlink()
    (tmp_path / "10").write_bytes(b"grown more")
    df = spark.createDataFrame([*data, data[0]], "scope_id long, node_id long, path string, size_bytes long")
    got = {r.node_id: (r.stage or r.issue.rpartition("_")[2], r.left_node_id, r.members) for r in equality.verdicts(df, equality.by_path(), most=250_000).collect()}
    alone = lambda x: (x, None, None)
    assert got == {
        1: alone("size"), 2: ("duplicate", 2, 2), 3: alone("ends"), 4: ("duplicate", 4, 3), 5: alone("content"), 6: ("duplicate", 4, 3), 7: ("duplicate", 4, 3), 8: alone("empty"), 9: alone("ends"),
        10: alone("changed"), 11: alone("ends"), 12: alone("large"), 13: alone("unavailable"), 14: ("duplicate", 2, 2),
    }
    same = spark.createDataFrame([(1, n, 2, t) for n, t in enumerate(("aa", "bb", "aa", "cc", "bb"))], "scope_id long, node_id long, size_bytes long, content string")
    weak = equality.by_content() | {s: lambda d: d.withColumns({"mark": F.lit("same"), "issue": F.lit(None).cast("string")}) for s in ("ends", "content")}
    got = {r.node_id: (r.stage, r.left_node_id) for r in equality.verdicts(same, weak).collect()}  # digests that all agree: bytes decide
    assert got == {0: ("duplicate", 0), 2: ("duplicate", 0), 1: ("duplicate", 1), 4: ("duplicate", 1), 3: ("bytes", None)}
    assert equality.verdicts(same.limit(0), equality.by_content()).count() == 0


def test_duplicate_codes_in_order(spark):
    d = spark.createDataFrame([(True, 0, 0, True), (False, 0, 0, True), (False, 2**27, 1, False), (False, 2, 3, False), (False, 2, 2, False), (False, 2, 2, True)], "same boolean, l long, r long, bytes boolean")
    got = [r.c for r in d.select(relations.duplicate_code(F.col("same"), F.col("l"), F.col("r"), F.col("bytes")).alias("c")).collect()]
    assert [c and c.removeprefix("file_relation_") for c in got] == ["same_file_identity", "source_empty", "source_too_large", "content_differs", "content_differs", None]


def test_versions_chain(spark):
    f = spark.createDataFrame([(1, 1, "plan-v1.md"), (1, 2, "Plan_V2.MD"), (1, 3, "plan.v5.md"), (1, 4, "plan-v2.md"), (1, 5, "other-v3.md"), (1, 6, "plan-v3.txt"), (1, 7, "plan-final.md"), (2, 8, "plan-v4.md")], "scope_id long, node_id long, file_name string")
    assert rows(relations.version_pairs(f), "older_node_id", "newer_node_id", "older_version", "newer_version") == [(1, 2, 1, 2), (1, 4, 1, 2), (2, 3, 2, 5), (4, 3, 2, 5)]
    assert rows(relations.version_members(f), "class_node_id", "node_id", "version") == [(1, 1, 1), (2, 2, 2), (2, 4, 2), (3, 3, 5), (5, 5, 3), (6, 6, 3), (8, 8, 4)]


def test_review_groups_anchor_at_their_first(spark):
    times = [0, 300, 600, 601, 900, 5000]
    df = spark.createDataFrame([(1, 100 + i, t) for i, t in enumerate(times)], "scope_id long, node_id long, modified_unix_ns long")
    got = rows(relations.review_groups(df, ["scope_id"], 600), "group_start", "group_size", "node_id")
    assert got == [(0, 3, 100), (0, 3, 101), (0, 3, 102), (601, 2, 103), (601, 2, 104)]
    same = spark.createDataFrame([(1, i, 7) for i in range(45)], "scope_id long, node_id long, modified_unix_ns long")
    assert sorted({(r.group_node_id, r.group_size) for r in relations.review_groups(same, ["scope_id"], 600).collect()}) == [(0, 20), (20, 20), (40, 5)]
    assert code(lambda: relations.review_groups(same, ["scope_id"], 600, max_images=44)) == "screenshot_image_limit_exceeded"
    assert code(lambda: relations.review_groups(same, ["scope_id"], 600, max_groups=2)) == "screenshot_group_limit_exceeded"


@pytest.mark.parametrize("most", [3, 20])
def test_review_groups_equal_a_loop(spark, most):
    """One key with most rows, ties, repeated rows, a null key and long chains without a gap."""
    rng = random.Random(most)
    data = [(1, n, rng.randrange(4000)) for n in range(900)] + [(2, n, n * 601) for n in range(40)] + [(None, n, rng.randrange(300)) for n in range(30)] + [(3, 5, 9)] * 4
    df = spark.createDataFrame(data, "scope_id long, node_id long, modified_unix_ns long")
    want, group, key = [], [], None
    for k, n, t in [*sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1])), (None, None, None)]:
        if group and (t is None or k != key or t - group[0][1] > 60 or len(group) == most):
            want += [(key, group[0][1], group[0][0], len(group), m) for m, _ in group] if len(group) > 1 else []
            group = []
        group, key = [*group, (n, t)], k
    got = [tuple(r)[:5] for r in relations.review_groups(df, ["scope_id"], 60, max_members=most, max_groups=None).collect()]
    order = lambda r: (r[0] or 0, *r[1:])
    assert sorted(got, key=order) == sorted(want, key=order)


def test_feedback(spark):
    e = spark.createDataFrame([(1, 1, "rejected", 10), (1, 2, "accepted", 20), (1, 3, "accepted", 30), (2, 1, "rejected", 5)], "entity_id long, sequence long, decision string, created_at_unix_ms long")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "entity_id long")
    assert rows(relations.feedback_state(ids, e), "entity_id", "state", "changes") == [(1, "accepted", 2), (2, "rejected", 1), (3, "suggested", 0)]
    assert rows(relations.feedback_changes(e), "entity_id", "sequence") == [(1, 1), (1, 2), (2, 1)]


def test_inbox_and_targets(spark):
    s = spark.createDataFrame([("version", 1, 50, "suggested"), ("exact_duplicate", 2, 10, "suggested"), ("screenshot_group", 3, 99, "suggested"), ("exact_duplicate", 4, 20, "suggested"), ("version", 5, 60, "accepted")], "kind string, source_id long, observed_at_unix_ms long, state string")
    assert [r.source_id for r in relations.inbox(s).orderBy("position").collect()] == [4, 2, 1, 3]
    t = spark.createDataFrame([("exact_duplicate", 1, 10, 11, None), ("version", 2, 20, 21, None), ("screenshot_group", 3, None, None, [30, 31])], "kind string, source_id long, left_node_id long, right_node_id long, members array<long>")
    out = relations.cleanup_targets(t)
    assert rows(out, "source_id", "target_node_id", "keeper_node_id") == [(1, 10, 11), (1, 11, 10), (2, 20, 21), (3, 30, None), (3, 31, None)]
    assert not any(r.action_authorized for r in out.collect())


def test_closure_follows_random_edits(spark):
    """Edges come and go at random, cycles and several parents among them; each time it is what a search from every node finds."""
    rng, now = random.Random(7), set()
    frame = lambda e: spark.createDataFrame([(1, c, p, "located_in", True) for p, c in sorted(e)], "scope_id long, source_node_id long, target_node_id long, kind string, active boolean")
    kept = spark.createDataFrame([], schemas.SCHEMAS["edge_closure"])
    for step in range(4):
        new = {e for e in now if rng.random() < 0.7} | {(rng.randrange(14), rng.randrange(14)) for _ in range(9 if step else 16)}
        kept = spark.createDataFrame(closure.moved(kept, frame(now), frame(new)).collect(), schemas.SCHEMAS["edge_closure"])
        now, want = new, set()
        for a in range(14):
            stack, seen = [a], set()
            while stack:
                x = stack.pop()
                for p, c in now:
                    if p == x and c not in seen:
                        seen.add(c)
                        stack.append(c)
            want |= {(1, a, n) for n in seen}
        got = [tuple(r) for r in kept.collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_closure_writes_no_pair_again(spark, monkeypatch):
    """Each round writes what it finds, not the closure that stands already."""
    written, write = [], closure._written
    monkeypatch.setattr(closure, "_written", lambda df: written.append(out := write(df)) or out)
    chain = spark.range(24).selectExpr("1L AS scope_id", "id AS ancestor_node_id", "id + 1 AS node_id")
    out = closure.added(spark.createDataFrame([], schemas.SCHEMAS["edge_closure"]), chain)
    assert {tuple(r)[1:] for r in out.collect()} == {(a, b) for b in range(25) for a in range(b)}
    assert sum(df.count() for df in written) == 24 + 300 and len(written) <= 8


# ---- journals

FULL = ["preview_created", "execute_requested", "direct_rename_intent", "execution_completed", "undo_requested", "undo_rename_intent", "undo_completed"]


def test_journal_advances_by_any_split(spark):
    """Random journals with gaps, repeats and illegal kinds, dealt over batches in order and out of order."""
    rng, kinds = random.Random(5), [k for _, k, _ in journal.TRANSITIONS]
    data = []
    for plan in range(40):
        log = [*(FULL * 2)[: rng.randrange(1, 9)], *rng.choices(kinds, k=rng.choice([0, 0, 3]))]
        steps = [i + 1 + (rng.random() < 0.05) for i in range(len(log))]
        data += [(plan, n, k, rng.randrange(3) if plan % 3 == 0 else 0 if n < 4 else 1 + (n > 6)) for n, k in zip(steps, log, strict=True)]
    df = spark.createDataFrame(data, "plan_id long, sequence long, event_kind string, batch int")
    kept = spark.createDataFrame([], schemas.SCHEMAS["action_plan_states"])
    for n in range(3):
        kept = spark.createDataFrame(journal.advance(kept, df.filter(F.col("batch") == n), df.filter(F.col("batch") < n), block=3).collect(), schemas.SCHEMAS["action_plan_states"])
    columns = ("plan_id", "state", "error", "events", "last_sequence")
    assert {tuple(r) for r in kept.select(*columns).collect()} == {tuple(r) for r in journal.snapshot(df, block=3).select(*columns).collect()}
    ordered = journal.advance(kept.filter("plan_id < 0"), df, spark.createDataFrame([], df.schema).select(F.raise_error(F.lit("read")).alias("plan_id"), "sequence", "event_kind"))
    assert ordered.count() == 40  # in order, no history is read


@pytest.mark.parametrize("block", [2, 512])
def test_journal_states(spark, block):
    logs = {
        1: FULL, 2: FULL[:4], 3: ["execute_requested"], 4: FULL[:2] + ["execute_request_not_started"], 5: FULL[:1] + ["direct_rename_intent"], 6: FULL[:3] + ["execution_not_applied", "execute_requested"],
        7: FULL[:3] + ["execution_needs_attention"], 8: ["nonsense"], 9: FULL[:3] + ["nonsense", "undo_requested"],
    }
    data = [(p, i + 1, k) for p, ks in logs.items() for i, k in enumerate(ks)] + [(20, 1, FULL[0]), (20, 3, FULL[1]), (21, 2, FULL[0]), (22, 1, FULL[0]), (22, 1, FULL[1]), (23, 1, FULL[0]), (23, 2, "nonsense"), (23, 4, "x")]
    df = spark.createDataFrame(data, "plan_id long, sequence long, event_kind string")
    got = {r.plan_id: r.error or r.state for r in journal.reduce_journal(df, block=block).collect()}
    gap = "NonMonotonicSequence"
    assert got == {1: "undone", 2: "executed", 3: "InvalidInitialEvent", 4: "previewed", 5: "InvalidTransition", 6: "execute_requested", 7: "needs_attention", 8: "InvalidInitialEvent", 9: "InvalidTransition", 20: gap, 21: gap, 22: gap, 23: "InvalidTransition"}


def test_commands(spark):
    c = spark.createDataFrame([(1, 7, 2, "a"), (1, 7, 3, "b"), (1, 8, 5, "c")], "plan_id long, request_id long, sequence long, x string")
    assert rows(journal.idempotent(c), "request_id", "x") == [(7, "a"), (8, "c")]
    old = spark.createDataFrame([(1, 4)], "plan_id long, sequence long")
    new = spark.createDataFrame([(1, 10), (1, 20), (2, 5)], "plan_id long, created_at_unix_ms long")
    assert rows(journal.next_sequences(old, new), "plan_id", "created_at_unix_ms", "sequence") == [(1, 10, 5), (1, 20, 6), (2, 5, 1)]
    e = spark.createDataFrame([(1, 1, "preview_created", None), (1, 2, "execute_requested", 7), (1, 3, "direct_rename_intent", 7), (1, 4, "execution_completed", 9), (1, 5, "undo_requested", 8)], "plan_id long, sequence long, event_kind string, command_request_id long")
    k = spark.createDataFrame([(1, 7, 2), (1, 8, 6)], "plan_id long, request_id long, requested_sequence long")
    assert rows(journal.command_violations(e, k), "sequence", "code") == [(4, "command_missing"), (5, "command_sequence_mismatch")]


# ---- evaluation


def test_rates_and_slices(spark):
    corpus = spark.createDataFrame([(1, "abcd", ["english", "small_text"]), (2, "本機", ["traditional_chinese"]), (3, "", ["no_text"])], "case_id long, expected_text string, tags array<string>")
    run = spark.createDataFrame([(1, "completed", "abxd"), (2, "failed", "本機"), (3, "completed", "zz")], "case_id long, status string, recognized_text string")
    s = evaluation.score_cases(corpus, run)
    t = evaluation.totals(s).head()
    assert (t.cases, t.chars, t.char_edits, t.char_error_ppm) == (3, 6, 5, 833_333)
    by = {r.tag: r.char_error_ppm for r in evaluation.tag_slices(s).collect()}
    assert by == {"english": 250_000, "small_text": 250_000, "traditional_chinese": 1_000_000, "no_text": None}
    assert code(lambda: evaluation.check_cases(corpus, run.filter("case_id < 3"))) == "run_case_missing"
    assert code(lambda: evaluation.check_cases(corpus.filter("case_id < 3"), run)) == "run_case_unexpected"
    assert code(lambda: evaluation.check_cases(corpus, run.unionByName(run))) == "run_case_duplicate"


def test_many_cases_beyond_the_former_cells(spark):
    """Each case is within its bound; 60 of them have more cells than all cases were allowed together."""
    corpus = spark.range(60).selectExpr("id AS case_id", "repeat('a', 1500) AS expected_text", "array('english') AS tags")
    run = spark.range(60).selectExpr("id AS case_id", "'completed' AS status", "concat(repeat('a', 1499), 'b') AS recognized_text")
    t = evaluation.totals(evaluation.score_cases(corpus, run)).head()
    assert (t.cases, t.chars, t.char_edits, t.token_edits) == (60, 90_000, 60, 60)
    long_ = corpus.limit(1).selectExpr("case_id", "repeat('a', 16385) AS expected_text", "tags")
    assert code(lambda: evaluation.score_cases(long_, run)) == "evaluation_work_limit_exceeded"


@pytest.mark.parametrize("n,p,want", [(1, 50, 1), (2, 50, 1), (5, 50, 3), (20, 95, 19), (101, 95, 96), (0, 50, 0)])
def test_nearest_rank(spark, n, p, want):
    assert spark.range(1, n + 1).agg(evaluation.nearest_rank("id", p).alias("v")).head().v == want


def test_boxes(spark):
    df = spark.createDataFrame([(0, 0, 3, 1), (1, 0, 2, 1), (0, 0, 4, 1), (2, 0, 2, 1)], "l int, t int, r int, b int")
    got = [r.x for r in df.select(evaluation.box_ppm(F.col("l"), F.col("t"), F.col("r"), F.col("b"), F.lit(3), F.lit(1)).alias("x")).collect()]
    assert [tuple(x) if x else None for x in got] == [(0, 0, 1_000_000, 1_000_000), (333_333, 0, 333_334, 1_000_000), None, None]


# ---- manifest and privacy


def test_publish(spark):
    staged = spark.createDataFrame([(1, "a", 10), (1, "b", 20), (1, "c", 30), (1, "e", 50)], "scope_id long, path_key string, v long")
    current = spark.createDataFrame([(1, "b", 20, True), (1, "c", 31, True), (1, "d", 40, True), (1, "e", 50, False), (1, "f", 60, False)], "scope_id long, path_key string, v long, present boolean")
    out = manifest.publish(staged, current, ["scope_id", "path_key"], ["v"])
    assert rows(out, "path_key", "v", "present", "action") == [("a", 10, True, "insert"), ("b", 20, True, "unchanged"), ("c", 30, True, "update"), ("d", 40, False, "tombstone"), ("e", 50, True, "update"), ("f", 60, False, "absent")]
    again = manifest.publish(staged, out.drop("action"), ["scope_id", "path_key"], ["v"])
    assert {r.action for r in again.filter("present").collect()} == {"unchanged"}  # a rescan changes nothing


def test_output_replacement(spark):
    old = spark.createDataFrame([(1, 1, "old", True), (1, 2, "keep", True)], "scope_id long, node_id long, text string, active boolean")
    new = spark.createDataFrame([(1, 1, "new")], "scope_id long, node_id long, text string")
    assert rows(manifest.replace_output(old, new, ["scope_id", "node_id"]), "text", "active") == [("keep", True), ("new", True), ("old", False)]
    assert rows(manifest.invalidate(old, new, ["scope_id", "node_id"]), "text", "active") == [("keep", True), ("old", False)]


def test_job_states(spark):
    e = spark.createDataFrame([(1, 1, "queued"), (1, 2, "running"), (1, 3, "failed"), (1, 4, "running"), (2, 1, "queued"), (2, 2, "interrupted")], "job_id long, sequence long, status string")
    assert rows(manifest.job_state(e), "job_id", "status") == [(1, "failed"), (2, "interrupted")]


def test_purge_keeps_hard_links(spark):
    places = spark.createDataFrame([(1, 1, 10, "/a/x"), (2, 1, 11, "/a/y"), (3, 1, 10, "/b/x")], "id long, scope_id long, node_id long, path_key string")
    gone = privacy.excluded_locations(places, spark.createDataFrame([(1, "path", "/a")], "scope_id long, kind string, path_key string"))
    nodes = privacy.closure(gone, places)
    assert rows(gone, "id") == [1, 2] and rows(nodes, "node_id") == [11]
    tables = {"content_chunks": spark.createDataFrame([(10,), (11,), (11,)], "node_id long"), "file_relations": spark.createDataFrame([(11, 11), (10, 11), (10, 12)], "left_node_id long, right_node_id long")}
    assert rows(privacy.impact(tables, nodes), "table_name", "purged_rows") == [("content_chunks", 2), ("file_relations", 2)]
    assert {k: v.count() for k, v in privacy.purge(tables, nodes).items()} == {"content_chunks": 1, "file_relations": 1}
    scopes = spark.createDataFrame([(1, 4)], "scope_id long, policy_revision long")
    assert privacy.next_revision(scopes, 1, 4).head().policy_revision == 5
    assert code(lambda: privacy.next_revision(scopes, 1, 3)) == "scope_policy_changed"


def test_schemas(spark):
    good = spark.createDataFrame([(1, "file", "inode", b"x", 1, 1)], schemas.SCHEMAS["nodes"])
    assert schemas.validate(good, "nodes").count() == 1
    assert code(lambda: schemas.validate(good.withColumn("kind", F.lit("socket")), "nodes")) == "nodes_kind_unknown"
    bad = spark.createDataFrame([(5, "exact_duplicate", 1, 9, 3, 10_000, 0)], schemas.SCHEMAS["file_relations"])
    assert code(lambda: schemas.validate(bad, "file_relations")) == "relation_order"
    assert code(lambda: schemas.unique_or_raise(good.unionByName(good), ["id"], "node_id_twice")) == "node_id_twice"
