"""Filesystem listing: authorized roots are traversed in rounds by the executors into observations and issues.

Spark's readers drop hidden files silently and give no identities, so each round lists the folders that the round before
found and looks at their entries in tasks. The rules are ordered and the first match wins. On stores without identities,
:func:`listing_by_spark` lists path, size and time by the distributed ``binaryFile`` reader instead.
"""

from __future__ import annotations

import os
import stat
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import islice
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.errors import EngineError
from siltstone.operators.graph import _checkpoint

# Roots that are never authorized, and trees below which nothing is.
PROTECTED_ROOTS = ("/", "/home", "/Users", "/root", "/opt", "/usr", "/var", "/tmp")
PROTECTED_TREES = ("/bin", "/boot", "/dev", "/etc", "/lib", "/lib64", "/proc", "/run", "/sbin", "/sys", "/System", "/Library")
ENTRY = "path_key string, display_path string, name string, kind string, identity_key binary, size_bytes long, modified_unix_ns long, link_count long, issue_code string, skipped boolean"
#: Where a scan stands: the next round, and whether there is any.
UNSTARTED = {"round": 0, "open": True}


def under(child: str, root: str) -> bool:
    return child == root or child.startswith(root if root.endswith("/") else root + "/")


def check_root(root: str) -> None:
    if root in PROTECTED_ROOTS or any(under(root, t) for t in PROTECTED_TREES):
        raise EngineError("scope_root_protected")


def identity(st: os.stat_result) -> bytes:
    """17 bytes: a kind byte, device and inode in little-endian order."""
    return struct.pack("<BQQ", 1, st.st_dev & (2**64 - 1), st.st_ino & (2**64 - 1))


def entry(raw: bytes, root: str, base: str, excluded_paths: frozenset[str], excluded_identities: frozenset[bytes]) -> tuple:
    """The row of one path below a root whose real path is ``base``; symbolic links are reported and not followed."""
    path = os.fsdecode(raw)
    shown = path.encode("utf-8", "replace").decode()
    key, name = unicodedata.normalize("NFC", shown), os.path.basename(shown)

    def row(kind: str | None = None, st: os.stat_result | None = None, issue: str | None = None, skipped: bool = False) -> tuple:
        facts = (identity(st), st.st_size if kind == "file" else None, st.st_mtime_ns, st.st_nlink) if st else (None,) * 4
        return (key, shown, name, kind, *facts, issue, skipped)

    if any(under(key, x) for x in excluded_paths):
        return row(skipped=True)
    if name.lower().endswith((".part", ".crdownload", ".download")):
        return row(issue="temporary_download_excluded", skipped=True)
    try:
        st = os.lstat(path)
    except OSError:
        return row(issue="metadata_unavailable", skipped=True)
    if name.startswith(".") and path != root:
        return row(issue="hidden_entry_excluded", skipped=True)
    if stat.S_ISLNK(st.st_mode):
        return row(issue="symlink_not_followed", skipped=True)
    try:
        real = os.path.realpath(path, strict=True)
    except OSError:
        return row(issue="canonicalization_failed", skipped=True)
    if not under(real, base):
        return row(issue="scope_escape_denied", skipped=True)
    if any(under(unicodedata.normalize("NFC", real), x) for x in excluded_paths) or identity(st) in excluded_identities:
        return row(skipped=True)
    if stat.S_ISDIR(st.st_mode):
        return row("folder", st)
    return row("file", st) if stat.S_ISREG(st.st_mode) else row(issue="unsupported_entry_type", skipped=True)


def names(raw: bytes) -> Iterator[tuple[bytes, str | None]]:
    """(path, None) of a folder's entries; (the folder's path, code) where it can't be read, or not to its end."""
    try:
        found = os.scandir(raw)
    except OSError:
        yield raw, "directory_read_denied"
        return
    with found:
        while True:
            try:
                e = next(found, None)
            except OSError:
                yield raw, "directory_entry_unavailable"
                return
            if e is None:
                return
            yield e.path, None


def listed(folders: DataFrame, root: str, excluded_paths: frozenset[str] = frozenset(), excluded_identities: frozenset[bytes] = frozenset()) -> DataFrame:
    """One round of a traversal: the entries (ENTRY and raw) of the ``folders`` (raw), listed and looked at by the executors.

    Names come first and are dealt over the tasks before each is looked at, so a folder with most of all entries does not
    occupy one task longer than its names take to read. The tree must be reachable from every executor."""
    base, places = os.path.realpath(root), pa.schema([("raw", pa.binary()), ("issue", pa.string())])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                found = names(raw)
                while part := list(islice(found, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*part, strict=True), places, strict=True)], schema=places)

    dealt = folders.select("raw").repartition("raw").mapInArrow(read, "raw binary, issue string").repartition("raw")
    return looked_at(dealt, root, base, excluded_paths, excluded_identities)


def looked_at(paths: DataFrame, root: str, base: str, excluded_paths: frozenset[str], excluded_identities: frozenset[bytes]) -> DataFrame:
    """The entries of paths (raw, issue); a path with an issue is only reported."""
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in f"{ENTRY}, raw binary".split(", "))])

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, issue in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                if issue is None:
                    rows.append((*entry(raw, root, base, excluded_paths, excluded_identities), raw))
                else:
                    shown = os.fsdecode(raw).encode("utf-8", "replace").decode()
                    rows.append((unicodedata.normalize("NFC", shown), shown, os.path.basename(shown), None, None, None, None, None, issue, True, raw))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

    return paths.select("raw", "issue").mapInArrow(look, f"{ENTRY}, raw binary")


def top(spark: SparkSession, root: str, excluded_paths: frozenset[str] = frozenset(), excluded_identities: frozenset[bytes] = frozenset()) -> DataFrame:
    """The root's own entry, from which the rounds of :func:`listed` start."""
    paths = spark.createDataFrame([(bytearray(os.fsencode(root)), None)], "raw binary, issue string")
    return looked_at(paths, root, os.path.realpath(root), excluded_paths, excluded_identities)


def listing(spark: SparkSession, root: str, excluded_paths: frozenset[str] = frozenset(), excluded_identities: frozenset[bytes] = frozenset()) -> DataFrame:
    """One row for each entry met, in path order: what was observed, or why it was not. A round for each level; what a round
    found is checkpointed and nothing of the tree passes through the driver."""
    found = _checkpoint(top(spark, root, excluded_paths, excluded_identities))
    rounds = [found]
    while not (folders := found.filter("kind = 'folder'")).isEmpty():
        found = _checkpoint(listed(folders, root, excluded_paths, excluded_identities))
        rounds.append(found)
    return reduce(DataFrame.unionByName, rounds).drop("raw").orderBy("path_key")


def look(path: str) -> tuple[int, int, int, bytes] | None:
    """(size, time in ns, links, identity) of one regular file; None for anything else."""
    try:
        st = os.lstat(path)
    except OSError:
        return None
    return (st.st_size, st.st_mtime_ns, st.st_nlink, identity(st)) if stat.S_ISREG(st.st_mode) else None


def listing_by_spark(spark: SparkSession, root: str) -> DataFrame:
    """path, size and time (ms) of the files below a root, listed by executors; the content column is pruned away."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(F.col("path").alias("display_path"), F.col("length").alias("size_bytes"), F.unix_millis("modificationTime").alias("modified_unix_ms"))


def tree_fixture(root: str, files: int, folders: int) -> None:
    """Writes a synthetic tree; refuses a root that exists."""
    Path(root).mkdir(parents=True)
    for i in range(folders):
        Path(root, f"group-{i:03d}").mkdir()
    for i in range(files):
        Path(root, f"group-{i % folders:03d}", f"document-{i:05d}.md").write_text(f"document {i}\n")


def search_corpus(spark: SparkSession, documents: int, groups: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(locations, chunks, edges) of a synthetic bilingual corpus by spark.range: document i lies in group i mod groups."""
    groups = min(documents, groups)
    d = spark.range(documents).select(
        F.lit(1).cast("long").alias("scope_id"), (F.col("id") + 1000).alias("node_id"), (F.col("id") + 1000).alias("location_id"),
        F.format_string("/corpus/group-%03d/document-%05d.md", F.col("id") % groups, F.col("id")).alias("display_path"), (F.col("id") * 10**9).alias("modified_unix_ns"), F.col("id"),
    )
    text = F.concat(F.lit("Quarterly folder notes, project evidence and local search for document "), F.col("id").cast("string"), F.lit(" 本機文件搜尋與資料夾脈絡"))
    folder = spark.range(groups).select(F.lit(1).cast("long").alias("scope_id"), (F.col("id") + 2).alias("source_node_id"), F.lit(1).cast("long").alias("target_node_id"))
    inside = d.select("scope_id", F.col("node_id").alias("source_node_id"), (F.col("id") % groups + 2).alias("target_node_id"))
    edges = folder.unionByName(inside).select("*", F.lit("located_in").alias("kind"), F.lit(True).alias("active"))
    return d.drop("id"), d.withColumn("text", text).withColumn("chunk_id", F.col("node_id")).drop("id"), edges
