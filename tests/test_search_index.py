"""The persisted index against the search that reads texts, and the warehouse's transactions."""

import json
import os
import random

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.engine import Engine
from siltstone.errors import EngineError
from siltstone.operators import search as S
from siltstone.operators import search_index
from siltstone.operators.search import Request
from siltstone.sources.warehouse import Transaction, Warehouse

LOCATIONS = "scope_id long, node_id long, location_id long, display_path string, modified_unix_ns long"
CHUNKS = LOCATIONS + ", chunk_id long, text string"
OPTIONS = search_index.IndexOptions(buckets=7, max_segments=3)


def collection(rng, n):
    word = lambda: rng.choice(["aaaa", "aa", "Ab", "abc", "本機文件", "é", "Needle", "x" * 40, "needle needle"])
    files = [(i % 2 + 1, i // 2 * 2, i, f"/r/{word()}/{word()}{i}.{rng.choice(['md', 'txt'])}", rng.choice([None, i * 10**9])) for i in range(n)]
    return files, [(*f, c, " ".join(word() for _ in range(rng.randrange(0, 30)))) for f in files for c in range(rng.randrange(3))]


def rows(df: DataFrame):
    return sorted(map(str, df.collect()))


def live_postings(w: Warehouse):
    at = w.snapshot()
    kept = search_index.live(at.read("search_postings"), search_index._read(at, "search_tombstones", w.spark))
    return rows(kept.select(*search_index.KEY, "length", "trigram", "positions"))


def test_index_follows_inserts_updates_and_deletes(spark, tmp_path):
    rng = random.Random(4)
    w = Warehouse(spark, f"file://{tmp_path}")
    files, chunks = collection(rng, 30)
    for step in range(5):
        frames = spark.createDataFrame(files, LOCATIONS), spark.createDataFrame(chunks, CHUNKS)
        with w.transaction() as t:
            changed = search_index.refresh(t, search_index.documents(*frames), OPTIONS)
        assert changed == (step != 1)
        rebuilt = search_index.postings(search_index.documents(*frames))
        assert live_postings(w) == rows(rebuilt.select(*search_index.KEY, "length", "trigram", "positions"))
        asked = [Request("needle"), Request("aaa"), Request("aaaa aa", source="content"), Request("abc", source="metadata", extension="md"), Request("本機文", scope_id=1, limit=3), Request("nowhere"), Request("le Needle", modified_since_s=5, limit=50)]
        for r in asked if step in (0, 4) else asked[:2]:
            assert rows(search_index.search(r, w.snapshot(), *frames)) == rows(S.search(r, *frames)), r.query
        if step:
            files, chunks = [f for f in files if rng.random() < 0.9], [c for c in chunks if rng.random() < 0.9]
            chunks = [c for c in chunks if c[:5] in set(files)]
            chunks = [(*c[:6], c[6] + " needle" if rng.random() < 0.2 else c[6]) for c in chunks]
            files.append((1, 1000 + step, 1000 + step, f"/r/needle{step}", None))
            chunks.append((*files[-1], 0, "Needle " * step))
    scope = spark.createDataFrame([(f[1], f[2]) for f in files[::2]], "node_id long, location_id long")
    for r in asked[:5]:
        assert rows(search_index.search(r, w.snapshot(), *frames, scope)) == rows(S.search(r, *frames, scope))
    with w.transaction() as t:
        search_index.refresh(t, search_index.documents(*frames).limit(0), OPTIONS)
    assert search_index.search(Request("needle"), w.snapshot(), *frames).count() == 0


def test_a_search_reads_few_buckets_and_no_text(spark, tmp_path):
    w = Warehouse(spark, f"file://{tmp_path}")
    files, chunks = collection(random.Random(1), 20)
    with w.transaction() as t:
        search_index.refresh(t, search_index.documents(spark.createDataFrame(files, LOCATIONS), spark.createDataFrame(chunks, CHUNKS)))
    plan = search_index.phrase_hits(w.snapshot(), "needle", ["content"], spark)._jdf.queryExecution().executedPlan().toString()
    assert "(2 paths)" in plan or plan.count("bucket=") == 2  # of the trigrams nee and dle
    assert "text" not in plan


def test_transactions(spark, tmp_path):
    w = Warehouse(spark, f"file://{tmp_path}")
    row = lambda *ids: spark.createDataFrame([(i,) for i in ids], "node_id long")
    ids = lambda: sorted(r.node_id for r in w.read("folders").collect())
    with pytest.raises(ZeroDivisionError), w.transaction() as t:
        t.replace("folders", row(1))
        assert t.read("folders").count() == 1
        raise ZeroDivisionError
    assert ids() == [] and w.snapshot().number == 0
    one, other, third = w.transaction(), w.transaction(), w.transaction()
    one.append("folders", row(1))
    other.append("folders", row(2))
    third.replace("folders", row(3))
    one.commit()
    other.commit()  # appends don't conflict
    assert ids() == [1, 2]
    with pytest.raises(EngineError, match="publish_conflict"):
        third.commit()
    before = w.snapshot()
    w.replace("folders", row(4))
    assert [r.node_id for r in before.read("folders").collect()] != [] and ids() == [4]
    assert not w.write_commit(w.snapshot().number, {}, {})  # a number is given once
    assert w.forget("folders") == 4 and len(os.listdir(tmp_path / "folders")) == 1 and ids() == [4]


class Killed(BaseException):
    pass


def state(e: Engine):
    at = e.warehouse.snapshot()
    return {n: rows(at.read(n)) for n in sorted(at.tables) if at.tables[n]}


def kept_text(folder) -> set[str]:
    """What any Parquet file below the folder still holds, whether a commit names it or not."""
    import pyarrow.parquet as pq

    found = set()
    for at, _, names in os.walk(folder):
        for n in names:
            if n.endswith(".parquet"):
                for row in pq.ParquetFile(os.path.join(at, n)).read().to_pylist():
                    found.add(json.dumps(row, default=str, ensure_ascii=False))
    return found


def test_a_purge_is_whole_or_not_at_all_and_leaves_nothing_on_disk(spark, tmp_path, monkeypatch):
    root = tmp_path / "root"
    (root / "private").mkdir(parents=True)
    (root / "a.md").write_text("visible words")
    (root / "private" / "b.md").write_text("hidden zebras")
    e = Engine(spark, f"file://{tmp_path}/warehouse")
    assert e.search(Request("words")).count() == 0
    scope = e.add_scope(str(root))
    e.scan(scope)
    assert e.search(Request("b.md")).count() == 1 and e.search(Request("b.md", source="metadata")).count() == 1  # before anything is extracted
    e.extract()
    assert e.search(Request("hidden zebras")).count() == 1
    before, writes = state(e), []
    write = Warehouse.write_part

    def counted(self, name, *rest):
        if len(writes) == counted.limit:
            raise Killed
        writes.append(name)
        return write(self, name, *rest)

    monkeypatch.setattr(Warehouse, "write_part", counted)
    for counted.limit in (0, 4):
        writes.clear()
        with pytest.raises(Killed):
            e.exclude(scope, str(root / "private"), 1)
        assert state(e) == before
    commit = Transaction.commit
    monkeypatch.setattr(Transaction, "commit", lambda self: (_ for _ in ()).throw(Killed()))
    counted.limit = 10**6
    with pytest.raises(Killed):
        e.exclude(scope, str(root / "private"), 1)
    assert state(e) == before
    monkeypatch.setattr(Transaction, "commit", commit)
    e.exclude(scope, str(root / "private"), 1)
    assert e.search(Request("hidden zebras")).count() == 0 and e.search(Request("visible")).count() == 1
    left = " ".join(x for x in kept_text(tmp_path / "warehouse") if "zebras" in x or "b.md" in x)
    assert not left
    code = search_index.codes("zeb")[0]
    assert not [x for x in kept_text(tmp_path / "warehouse") if str(code) in x]


def test_a_folder_search_does_not_follow_hard_links_out_of_it(spark, tmp_path):
    root = tmp_path / "root"
    (root / "alpha").mkdir(parents=True)
    (root / "beta").mkdir()
    (root / "alpha" / "plan.md").write_text("linked plan")
    os.link(root / "alpha" / "plan.md", root / "beta" / "plan.md")
    e = Engine(spark, f"file://{tmp_path}/warehouse")
    scope = e.add_scope(str(root))
    e.scan(scope)
    e.extract()
    alpha = e.folders().filter(F.endswith("display_path", F.lit("/alpha"))).head()
    found = e.search(Request("plan", scope_id=scope, folder_node_id=alpha.node_id)).collect()
    assert found and all("/alpha/" in r.display_path for r in found)
    assert {os.path.dirname(r.display_path)[-5:] for r in e.search(Request("plan", scope_id=scope)).collect()} == {"alpha", "/beta"}


def test_postings_are_computed_once(spark, tmp_path, monkeypatch):
    """Finding ranges to deal them by would run the texts through Python a second time."""
    runs, postings = spark.sparkContext.accumulator(0), search_index.postings

    def counted(docs):
        def run(batches):
            for b in batches:
                runs.add(b.num_rows)
                yield b

        out = postings(docs)
        return out.mapInArrow(run, out.schema)

    monkeypatch.setattr(search_index, "postings", counted)
    w = Warehouse(spark, f"file://{tmp_path}/once")
    text = "the quick brown fox " * 3
    docs = spark.range(40).selectExpr("'content' AS source", "1L AS scope_id", "id AS node_id", "id AS location_id", "0L AS chunk_id", f"'{text}' AS text")
    with w.transaction() as t:
        search_index.refresh(t, docs)
    n = w.read_parts("search_postings", w.snapshot().tables["search_postings"]).count()
    assert n == 40 * 20 and runs.value == n


def test_postings_are_neither_shuffled_nor_sorted_on_their_way_to_the_files(spark, tmp_path, monkeypatch):
    plans, write = {}, Warehouse.write_part

    def seen(self, name, df, *rest):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return write(self, name, df, *rest)

    monkeypatch.setattr(Warehouse, "write_part", seen)
    w, rng = Warehouse(spark, f"file://{tmp_path}/plain"), random.Random(2)
    words = ["".join(rng.choices("abcdefghijklm", k=rng.randrange(2, 9))) for _ in range(300)]
    docs = spark.createDataFrame([("content", 1, i, i, 0, " ".join(rng.choices(words, k=400))) for i in range(60)], "source string, scope_id long, node_id long, location_id long, chunk_id long, text string")
    with w.transaction() as t:
        search_index.refresh(t, docs, OPTIONS)
    above = plans["search_postings"].split("MapInArrow")[0]
    assert "Exchange" not in above and "Sort" not in above
    on_disk = sum(f.stat().st_size for f in (tmp_path / "plain" / "search_postings").rglob("*.parquet"))
    assert on_disk < 3.5 * docs.selectExpr("sum(length(text))").head()[0]  # 4 bytes a position and a document's key for each trigram take more


def test_kept_rows_are_told_from_gone_ones_without_a_shuffle(spark):
    gone = spark.range(3000).selectExpr("if(id % 2 = 0, 'a', 'b') AS source", "id AS n")
    kept = spark.range(3000, 6000).selectExpr("if(id % 2 = 0, 'a', 'b') AS source", "id AS n")
    rows_ = gone.unionByName(kept).selectExpr("source", "n", "explode(array(1, 2)) AS x")
    for options in ({}, {"bits": 1, "most": 1}, {"bits": 1, "most": 1, "listed": 0}):  # the second bitmap has no room for so many keys
        left = search_index.without(rows_, ["source", "n"], gone, kept, **options)
        assert left.columns == ["source", "n", "x"] and left.exceptAll(rows_.filter("n >= 3000")).isEmpty() and left.count() == 6000
    plan = search_index.without(rows_, ["source", "n"], gone, kept)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(source" not in plan and "SortMergeJoin" not in plan
    assert search_index.without(rows_, ["source", "n"], gone.limit(0), kept).count() == 12000  # nothing gone, nothing asked


def test_tombstones_of_an_earlier_form_still_hide(spark, tmp_path):
    w = Warehouse(spark, f"file://{tmp_path}/old")
    docs = spark.createDataFrame([("content", 1, i, i, 0, f"needle {i % 3}") for i in range(20)], "source string, scope_id long, node_id long, location_id long, chunk_id long, text string")
    for some in (docs, docs.filter("node_id > 4")):
        with w.transaction() as t:
            search_index.refresh(t, some, OPTIONS)
    with w.transaction() as t:  # as they were written without their segment
        t.replace("search_tombstones", t.read("search_tombstones").drop("segment").localCheckpoint(), check=False)
    with w.transaction() as t:
        search_index.refresh(t, docs.filter("node_id > 9"), OPTIONS)
    at = w.snapshot()
    assert {r.node_id for r in search_index.standing(at, at.read("search_postings")).collect()} == set(range(10, 20))


def test_a_segment_that_is_merged_at_once_is_written_once(spark, tmp_path, monkeypatch):
    names, write = [], Warehouse.write_part
    monkeypatch.setattr(Warehouse, "write_part", lambda self, name, *rest: names.append(name) or write(self, name, *rest))
    w = Warehouse(spark, f"file://{tmp_path}/merged")
    docs = spark.createDataFrame([("content", 1, i, i, 0, f"needle {i}") for i in range(6)], "source string, scope_id long, node_id long, location_id long, chunk_id long, text string")
    for n in (2, 4, 6):
        with w.transaction() as t:
            search_index.refresh(t, docs.filter(F.col("node_id") < n), search_index.IndexOptions(buckets=3, max_segments=2))
    assert names.count("search_postings") == 3 and len(w.snapshot().tables["search_postings"]) == 1
    assert live_postings(w) == rows(search_index.postings(docs).select(*search_index.KEY, "length", "trigram", "positions"))
