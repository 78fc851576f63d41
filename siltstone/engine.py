"""The engine over one warehouse: scan folders, extract their text, search, profile, relate, review.

Every method builds on the operators; what it publishes goes through one transaction of
:class:`siltstone.sources.warehouse.Warehouse`, the search index included, so readers never see half a change.
"""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.errors import EngineError
from siltstone.functions.paths import filename
from siltstone.operators import actions, closure, equality, graph, manifest, privacy, relations, search_index
from siltstone.operators import search as S
from siltstone.schemas import SCHEMAS
from siltstone.sources import content, listing
from siltstone.sources.warehouse import Snapshot, Transaction, Warehouse, empty
from siltstone.streaming import sinks, source, watch

EXTRACTED = f"{content.EXTRACTED}, scope_id long, node_id long, location_id long, modified_unix_ns long"
#: Tables that hold what a purge takes away.
PURGED = ("manifest", "edges", "edge_closure", "file_relations", "extracted", *search_index.TABLES)


def _id(*parts: str) -> F.Column:
    """A stable positive id of a key."""
    return F.xxhash64(*parts).bitwiseAND(F.lit(2**63 - 1))


class Engine:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.warehouse = spark, Warehouse(spark, root)

    # ---- scopes and scans

    def add_scope(self, root: str) -> int:
        """Authorizes a folder; raises if it is protected or overlaps an active scope."""
        root = os.path.realpath(root)
        listing.check_root(root)
        known = self.warehouse.read("authorized_scopes")
        new = self.spark.createDataFrame([(0, root)], "root_id long, path_key string")
        graph.check_roots(new, known.select(F.col("id").alias("root_id"), "path_key"))
        scope = known.count() + 1
        row = self.spark.createDataFrame([(scope, root, root, "linux", time.time_ns() // 10**6, 1)], "id long, path_key string, display_path string, platform string, created_at_unix_ms long, policy_revision long")
        grant = self.spark.createDataFrame([(scope, "linux", "active", 0)], "scope_id long, platform string, state string, updated_at_unix_ms long")
        with self.warehouse.transaction() as t:
            t.read("authorized_scopes")  # of two new scopes at a time one fails
            t.append("authorized_scopes", row.withColumn("path_raw", F.encode("path_key", "utf-8")))
            t.append("scope_access_grants", grant.withColumn("opaque_grant", F.lit(None).cast("binary")))
        return scope

    def scan(self, scope_id: int, rounds: int | None = None) -> DataFrame:
        """Lists a scope and publishes its manifest. Returns the counts of each action; an empty table if the scan stopped after the
        given number of rounds.

        A round lists what the round before found, and its entries are one commit. A scan that ended after any round, by that
        number or because its job died, is taken up there by the next call: no folder is listed twice."""
        root = self.warehouse.read("authorized_scopes").filter(F.col("id") == scope_id).select("path_key").head()
        if root is None:
            raise EngineError("search_scope_invalid")
        denied = self.warehouse.read("scope_exclusions").filter((F.col("scope_id") == scope_id) & (F.col("kind") == "path")).select("path_key").collect()  # 64 at most
        denied, name, n = frozenset(r[0] for r in denied), f"scan_entries_{scope_id}", 0
        while (at := self.warehouse.snapshot().notes.get(name) or listing.UNSTARTED)["open"]:
            if n == rounds:
                return self.spark.createDataFrame([], "action string, count long")
            with self.warehouse.transaction() as t:
                if at["round"]:
                    folders = t.read(name).filter((F.col("round") == at["round"] - 1) & (F.col("kind") == "folder"))
                    found = listing.listed(folders, root[0], denied)
                else:
                    found = listing.top(self.spark, root[0], denied)
                t.append(name, found.withColumn("round", F.lit(at["round"])))
                last = t.read(name).filter((F.col("round") == at["round"]) & (F.col("kind") == "folder")).isEmpty()
                t.note(name, {"round": at["round"] + 1, "open": not last})
            n += 1
        return self._publish_scan(scope_id, name, denied)

    def scan_queue(self, scope_id: int) -> DataFrame:
        """(scan_id, path_key, state) of the folders that a scan under way has met: done, or pending for its next round."""
        state, name = self.warehouse.snapshot(), f"scan_entries_{scope_id}"
        if not state.version(name):
            return empty(self.spark, "scan_id long, path_key string, state string")
        done = F.col("round") < state.notes[name]["round"] - 1
        return state.read(name).filter("kind = 'folder'").select(F.lit(scope_id).cast("long").alias("scan_id"), "path_key", F.when(done, "done").otherwise("pending").alias("state"))

    def _publish_scan(self, scope_id: int, name: str, denied: frozenset[str]) -> DataFrame:
        """The manifest after a scan that has met its last folder; its entries go."""
        entries = self.warehouse.read(name).drop("raw", "round").withColumn("scope_id", F.lit(scope_id).cast("long"))
        gone = F.lit(False)
        for path in denied:  # what was excluded while the scan was under way; 64 at most
            gone = gone | (F.col("path_key") == path) | F.startswith("path_key", F.lit(path + "/"))
        entries = entries.filter(~gone)
        seen = entries.filter(F.col("issue_code").isNull() & ~F.col("skipped"))
        seen = seen.withColumns({"node_id": _id("identity_key"), "id": _id("scope_id", "path_key"), "parent": F.regexp_extract("path_key", "^(.*)/[^/]*$", 1)})
        values = ["id", "node_id", "display_path", "kind", "size_bytes", "modified_unix_ns", "link_count"]
        parents = seen.select(F.col("path_key").alias("parent"), F.col("node_id").alias("target_node_id"))
        links = seen.join(parents, "parent").select("scope_id", F.col("node_id").alias("source_node_id"), "target_node_id", F.lit("located_in").alias("kind"), F.lit(True).alias("active"), F.lit(0).cast("long").alias("last_seen_scan_id")).distinct()
        issues = entries.filter(F.col("issue_code").isNotNull()).select(F.col("scope_id").alias("scan_id"), F.col("issue_code").alias("code"), "path_key")
        with self.warehouse.transaction() as t:
            current = t.read("manifest") if t.version("manifest") else None
            mine = current.filter(F.col("scope_id") == scope_id) if current is not None else self.spark.createDataFrame([], seen.select("scope_id", "path_key", *values).schema.add("present", "boolean"))
            out = manifest.publish(seen.select("scope_id", "path_key", *values), mine.select("scope_id", "path_key", *values, "present"), ["scope_id", "path_key"], values)
            others = current.filter(F.col("scope_id") != scope_id) if current is not None else None
            t.replace("manifest", out if others is None else out.unionByName(others), check=False)
            edges = t.read("edges")
            t.replace("edges", edges.filter(F.col("scope_id") != scope_id).unionByName(links))
            t.replace("edge_closure", closure.moved(t.read("edge_closure"), edges, t.read("edges")))
            t.append("scan_issues", issues)
            t.replace("scan_requests", t.read("scan_requests").filter(F.col("scope_id") != scope_id))
            t.drop(name)
            t.note(name, listing.UNSTARTED)
            self._index(t)
        self.warehouse.vacuum(name, keep=0)
        return self.manifest().filter(F.col("scope_id") == scope_id).groupBy("action").count()

    def _index(self, t: Transaction) -> None:
        """Brings the search index to what the transaction leaves."""
        search_index.refresh(t, search_index.documents(self.present(t), self.chunks(t)))

    def manifest(self, at: Snapshot | Transaction | None = None) -> DataFrame:
        """All locations with an active grant, tombstones included."""
        at = at or self.warehouse.snapshot()
        return manifest.with_active_grant(at.read("manifest"), at.read("scope_access_grants"))

    def present(self, at: Snapshot | Transaction | None = None) -> DataFrame:
        at = at or self.warehouse.snapshot()
        rows = self.manifest(at).filter("present").withColumn("location_id", F.col("id"))
        return S.without_excluded(rows, at.read("scope_exclusions").drop("identity_kind", "identity_key"))

    # ---- content

    def extract(self) -> DataFrame:
        """Extracts every present file; earlier chunks of the same files are replaced. Returns outcomes by status."""
        with self.warehouse.transaction() as t:
            files = self.present(t).filter("kind = 'file'")
            roots = [r[0] for r in t.read("authorized_scopes").select("path_key").collect()]  # 32 at most a set
            data = None
            for root in roots:
                part = content.read_files(self.spark, root)
                data = part if data is None else data.unionByName(part)
            if data is None:
                raise EngineError("search_scope_invalid")
            local = data.withColumn("path", F.regexp_replace("path", "^file:/*", "/"))
            wanted = local.join(files.select(F.col("display_path").alias("path")), "path", "left_semi")
            out = content.extract(wanted).join(files.select(F.col("display_path").alias("path"), "scope_id", "node_id", "location_id", "modified_unix_ns"), "path")
            # a node's chunks lie together: a search reads few row groups for its snippets
            t.replace("extracted", out.repartitionByRange("node_id").sortWithinPartitions("node_id", "ordinal"), check=False)
            self._index(t)
        return self.extracted().groupBy("status", "error_code").count()

    def extracted(self, at: Snapshot | Transaction | None = None) -> DataFrame:
        at = at or self.warehouse.snapshot()
        return at.read("extracted") if at.version("extracted") else empty(self.spark, EXTRACTED)

    def chunks(self, at: Snapshot | Transaction | None = None) -> DataFrame:
        at = at or self.warehouse.snapshot()
        here = self.present(at).select("scope_id", "node_id", "location_id", "modified_unix_ns")
        rows = self.extracted(at).filter(F.col("text").isNotNull()).join(here, ["scope_id", "node_id", "location_id", "modified_unix_ns"], "left_semi")
        return rows.withColumns({"chunk_id": F.col("ordinal"), "display_path": F.col("path")})

    # ---- watching

    def apply_events(self, events: DataFrame, batch_id: int, sink: str = "watch") -> bool:
        """A batch of coalesced events (scope_id, kind, path): the one file of a file_delta is looked at anew, and its location and its place in the
        search index follow, if it is a known present file with one link; every other event becomes a request for a scan of its scope. All
        of it, with the mark that the batch is done, is one commit, so a batch that comes again changes nothing."""

        def effect(t: Transaction) -> None:
            rows = events.select("scope_id", "kind", "path").distinct().collect()  # an event a scope, 32 at most a set
            asked = {(r.scope_id, r.path) for r in rows if r.kind == "file_delta" and r.path}
            places = t.read("manifest")
            known = places.filter(F.col("present") & (F.col("kind") == "file") & (F.col("link_count") == 1) & F.col("path_key").isin(sorted(p for _, p in asked)))
            known = {(r.scope_id, r.path_key): r.node_id for r in known.select("scope_id", "path_key", "node_id").collect()} if asked else {}
            found, wide = [], {r.scope_id for r in rows if not (r.kind == "file_delta" and r.path)}
            for scope, path in sorted(asked):
                now = listing.look(path)
                if now is None or (scope, path) not in known or now[2] != 1:
                    wide.add(scope)
                else:
                    found.append((scope, path, now[0], now[1], now[3]))
            if found:
                looked = self.spark.createDataFrame(found, "scope_id long, path_key string, size_bytes long, modified_unix_ns long, identity_key binary").withColumn("node_id", _id("identity_key"))
                strangers = {r.path_key for r in looked.collect() if known[r.scope_id, r.path_key] != r.node_id}  # another file under the same name
                wide |= {s for s, p, *_ in found if p in strangers}
                looked = looked.filter(~F.col("path_key").isin(sorted(strangers)) if strangers else F.lit(True))
                t.replace("manifest", sinks.applied(places, looked, ["scope_id", "path_key"], ["size_bytes", "modified_unix_ns"]), check=False)
                self._index(t)
            if wide:
                t.append("scan_requests", self.spark.createDataFrame([(s, sink, batch_id) for s in sorted(wide)], SCHEMAS["scan_requests"]))

        return sinks.once(self.warehouse, sink, batch_id, effect)

    def watch(self, spool: str, checkpoint: str, w: watch.Watch = watch.Watch(), sink: str = "watch", queue_bytes: int | None = None):
        """Starts following a spool of hints; returns the running query. Stopped and started again with the same checkpoint it goes on where
        it was, with the deadlines that were pending."""
        scopes = self.warehouse.read("authorized_scopes").select(F.col("id").alias("scope_id"), "path_key")
        hints = watch.actionable(source.scope_hints(source.read_hints(self.spark, spool, queue_bytes), scopes))
        events = watch.coalesce_stream(hints, w, with_path=True)
        return events.writeStream.foreachBatch(lambda batch, batch_id: self.apply_events(batch, batch_id, sink)).option("checkpointLocation", checkpoint).trigger(processingTime="1 second").start()

    # ---- questions

    def _policy(self, scope_id: int | None) -> tuple:
        return actions.policy(self.warehouse.read("authorized_scopes").withColumn("scope_id", F.col("id")), scope_id)

    def search(self, request: S.Request) -> DataFrame:
        """Ranked results under the policy that held when the search began: they are read before the revisions are looked
        at again, and if any has changed meanwhile the search fails closed."""
        bound, missing = self._policy(request.scope_id), None
        try:
            found = self._search(request)
            rows = found.collect()  # fifty at most
        except EngineError:
            raise
        except Exception as error:  # a purge meanwhile takes what is being read from disk
            missing = error
        if self._policy(request.scope_id) != bound:
            raise EngineError("scope_policy_changed")
        if missing is not None:
            raise missing
        return self.spark.createDataFrame(rows, found.schema)

    def _search(self, request: S.Request) -> DataFrame:
        at, scope = self.warehouse.snapshot(), None
        present = self.present(at)
        if request.folder_node_id is not None:
            places = present.select("id", "scope_id", "node_id", "kind", "path_key", "present", "location_id")
            scope = graph.subtree(at.read("edges"), places, request.scope_id, request.folder_node_id).select("node_id", "location_id")
        chunks = self.extracted(at).filter(F.col("text").isNotNull()).withColumn("chunk_id", F.col("ordinal"))
        return search_index.search(request, at, present, chunks, scope)

    def folders(self, limit: int = 200) -> DataFrame:
        return S.folder_list(self.present().filter("kind = 'folder'"), limit).select("scope_id", "node_id", "display_path", "truncated")

    def _nodes(self) -> DataFrame:
        return self.present().select("node_id", "kind", filename(F.col("path_key")).alias("name"), "size_bytes", "modified_unix_ns").dropDuplicates(["node_id"])

    def folder_profile(self, node_id: int) -> DataFrame:
        at = self.warehouse.snapshot()
        return graph.folder_profile(at.read("edges"), self._nodes(), node_id, graph.MAX_PROFILE_ENTRIES, at.read("edge_closure"))

    def projects(self) -> DataFrame:
        """Project suggestions of all folders, by the markers among their direct children."""
        edges = self.warehouse.read("edges").filter("active")
        children = edges.join(self._nodes(), F.col("source_node_id") == F.col("node_id")).select(F.col("target_node_id").alias("folder_node_id"), "name")
        return graph.project_confidence(graph.markers(children))

    def exclude(self, scope_id: int, path: str, expected_revision: int) -> DataFrame:
        """Excludes a path of a scope: what lies below leaves the manifest, the edges and the extracted text, the scope's
        policy moves to its next revision, and receipts say how many rows of each table went. Returns the receipts."""
        scopes = self.warehouse.read("authorized_scopes")
        privacy.next_revision(scopes.withColumn("scope_id", F.col("id")), scope_id, expected_revision)
        row = scopes.filter(F.col("id") == scope_id).head()
        if path == row.path_key or not path.startswith(row.path_key.rstrip("/") + "/"):
            raise EngineError("scope_exclusion_invalid")
        excluded = self.spark.createDataFrame([(scope_id, "path", path, None, None)], SCHEMAS["scope_exclusions"])
        with self.warehouse.transaction() as t:
            t.append("scope_exclusions", excluded)
            receipts = self._purge(t, scope_id, privacy.excluded_locations(t.read("manifest"), excluded), expected_revision)
        self.warehouse.forget(*PURGED, f"scan_entries_{scope_id}")
        return receipts

    def revoke(self, scope_id: int, expected_revision: int) -> DataFrame:
        """Revokes a scope's grant and purges all that was kept of it. Returns the receipts."""
        with self.warehouse.transaction() as t:
            grants = t.read("scope_access_grants").withColumn("state", F.when(F.col("scope_id") == scope_id, "revoked").otherwise(F.col("state")))
            t.replace("scope_access_grants", grants)
            receipts = self._purge(t, scope_id, t.read("manifest").filter(F.col("scope_id") == scope_id), expected_revision)
        self.warehouse.forget(*PURGED, f"scan_entries_{scope_id}")
        return receipts

    def _purge(self, t: Transaction, scope_id: int, gone: DataFrame, expected_revision: int) -> DataFrame:
        """The new policy and what it leaves, in one transaction; what went leaves the disk once that is published."""
        scopes = t.read("authorized_scopes").withColumn("scope_id", F.col("id"))
        raised = privacy.next_revision(scopes, scope_id, expected_revision).drop("scope_id")
        places = t.read("manifest")
        nodes = privacy.closure(gone, places)
        edges = t.read("edges")
        tables = {"edges": edges, "file_relations": t.read("file_relations")}
        counts = {"locations": gone.count(), **{r.table_name: r.purged_rows for r in privacy.impact(tables, nodes).collect()}}
        t.replace("authorized_scopes", raised)
        if t.version("extracted"):
            text, here = self.extracted(t), gone.select("scope_id", F.col("id").alias("location_id"))
            counts["content_chunks"] = text.join(here, ["scope_id", "location_id"], "left_semi").count()
            t.replace("extracted", text.join(here, ["scope_id", "location_id"], "left_anti").repartitionByRange("node_id").sortWithinPartitions("node_id", "ordinal"), check=False)
        for name, kept in privacy.purge(tables, nodes).items():
            t.replace(name, kept)
        t.replace("edge_closure", closure.moved(t.read("edge_closure"), edges, t.read("edges")))
        t.replace("manifest", places.join(gone.select("scope_id", "id"), ["scope_id", "id"], "left_anti"), check=False)
        receipts = self.spark.createDataFrame([(scope_id, name, n, expected_revision + 1) for name, n in sorted(counts.items())], SCHEMAS["privacy_receipts"])
        t.append("privacy_receipts", receipts)
        if t.version(f"scan_entries_{scope_id}"):  # a scan under way starts anew
            t.drop(f"scan_entries_{scope_id}")
            t.note(f"scan_entries_{scope_id}", listing.UNSTARTED)
        self._index(t)
        if t.parts("search_postings"):
            search_index.compact(t)  # no posting of what went stays behind a tombstone
        return receipts

    def relation_sources(self) -> DataFrame:
        """(scope_id, node_id, size_bytes, code): present files, and why one is not compared with others at all."""
        files = self.present().filter("kind = 'file'").select("scope_id", "node_id", "size_bytes").distinct()
        return files.withColumn("code", relations.source_code(F.col("size_bytes")))

    def duplicate_verdicts(self) -> DataFrame:
        """Every present file, and the stage of the comparison at which it left, or why it could not be compared."""
        files = self.present().filter("kind = 'file'").select("scope_id", "node_id", F.col("display_path").alias("path"), "size_bytes")
        return equality.verdicts(files, equality.by_path(), relations.MAX_DUPLICATE_BYTES)

    def duplicates(self) -> DataFrame:
        return equality.duplicates(self.duplicate_verdicts())

    def versions(self) -> DataFrame:
        return relations.version_pairs(self.present().filter("kind = 'file'").select("scope_id", "node_id", filename(F.col("path_key")).alias("file_name")))

    def record_relations(self) -> int:
        """Appends what duplicates and versions there are as relations that are not recorded yet."""
        now = F.lit(time.time_ns() // 10**6).cast("long")
        d = self.duplicates().select(F.lit("exact_duplicate").alias("kind"), "scope_id", "left_node_id", "right_node_id", "confidence_basis_points")
        v = self.versions().select(F.lit("version").alias("kind"), "scope_id", F.col("older_node_id").alias("left_node_id"), F.col("newer_node_id").alias("right_node_id"), "confidence_basis_points")
        rows = d.unionByName(v).withColumns({"id": _id("kind", "scope_id", "left_node_id", "right_node_id"), "observed_at_unix_ms": now})
        new = rows.join(self.warehouse.read("file_relations").select("id"), "id", "left_anti").cache()
        n = new.count()
        if n:
            self.warehouse.append("file_relations", new)
        new.unpersist()
        return n

    def decide(self, relation_id: int, decision: str) -> bool:
        """Appends a decision; repeating the one in force changes nothing. Returns whether it did."""
        events = self.warehouse.read("feedback_events").filter(F.col("entity_id") == relation_id)
        last = events.orderBy(F.desc("sequence")).select("sequence", "decision").head()
        if last is not None and last.decision == decision:
            return False
        row = [(relation_id, (last.sequence if last else 0) + 1, decision, time.time_ns() // 10**6)]
        self.warehouse.append("feedback_events", self.spark.createDataFrame(row, "entity_id long, sequence long, decision string, created_at_unix_ms long"))
        return True

    def record_events(self, events: DataFrame) -> None:
        """Appends action events (plan_id, sequence, event_kind, ...) and brings the plans' states along, in one commit."""
        sinks.record(self.warehouse, events)

    def plan_states(self) -> DataFrame:
        """(plan_id, state, error, events, last_sequence), as they are kept: no event is read."""
        return self.warehouse.read("action_plan_states")

    def inbox(self) -> DataFrame:
        r = self.warehouse.read("file_relations").withColumn("entity_id", F.col("id"))
        state = relations.feedback_state(r, self.warehouse.read("feedback_events"))
        return relations.inbox(r.join(state, "entity_id").select("kind", F.col("id").alias("source_id"), "observed_at_unix_ms", "state"))

    def stats(self) -> DataFrame:
        """Counts over the scopes whose grant is active."""
        m, grants = self.manifest(), self.warehouse.read("scope_access_grants")
        granted = lambda name, scope: manifest.with_active_grant(self.warehouse.read(name).withColumn("scope_id", F.col(scope)), grants)
        nodes, scopes = m.filter("present").select("node_id", "kind").distinct(), granted("authorized_scopes", "id")
        scans = scopes.select(F.lit("completed").alias("status"))
        return manifest.manifest_stats(scopes, nodes, m, granted("scan_issues", "scan_id"), scans)

    def health(self) -> DataFrame:
        return actions.health(self.spark)
