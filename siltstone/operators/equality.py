"""Files of equal bytes, found in stages: each looks at what the one before has left, and reads more of it.

Sizes come from the manifest; then the first and last bytes are hashed, then all of it in chunks whose digests are hashed together,
and what still agrees is compared byte by byte with the smallest node of its group. A file leaves at the first stage at which no other
file agrees with it, so only candidates are read whole.

A source says how a stage reads: :func:`by_content` from a column, :func:`by_path` by streaming files that every executor reaches.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.graph import _checkpoint

#: Bytes at either end, and of a chunk.
ENDS, CHUNK = 4096, 64 * 1024
#: Where a file leaves, in order; a file with an issue could not be read, or is another than the manifest says.
STAGES = ("size", "ends", "content", "bytes")
#: df with the columns of its files -> df with ``mark`` and ``issue``; the last one reads pairs (node and its group's smallest).
Source = dict[str, Callable[[DataFrame], DataFrame]]


def by_content(content: str = "content") -> Source:
    """Reads a string or binary column."""
    data, none = F.col(content).cast("binary"), F.lit(None).cast("string")
    length = F.octet_length(data)
    ends = F.concat(F.sha2(F.substring(data, 1, ENDS), 256), F.sha2(data.substr(F.greatest(length - ENDS, F.lit(0)) + 1, F.lit(ENDS)), 256))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((length - 1) / CHUNK)), lambda i: F.sha2(data.substr((i * CHUNK + 1).cast("int"), F.lit(CHUNK)), 256))
    return {
        "columns": lambda df: df.select("scope_id", "node_id", "size_bytes", content),
        "ends": lambda df: df.withColumns({"mark": ends, "issue": none}),
        "content": lambda df: df.withColumns({"mark": F.sha2(F.array_join(chunks, ""), 256), "issue": none}),
        "bytes": lambda df: df.withColumns({"mark": F.when(data == F.col(f"_least_{content}").cast("binary"), "equal"), "issue": none}),
    }


def _digests(path: str, size: int) -> Iterator[bytes]:
    with open(path, "rb") as f:
        if os.fstat(f.fileno()).st_size != size:
            raise ValueError
        while part := f.read(CHUNK):
            yield part


def file_ends(path: str, size: int, other: str | None) -> str:
    with open(path, "rb") as f:
        if os.fstat(f.fileno()).st_size != size:
            raise ValueError
        head = f.read(ENDS)
        f.seek(max(size - ENDS, 0))
        return hashlib.sha256(head).hexdigest() + hashlib.sha256(f.read(ENDS)).hexdigest()


def file_content(path: str, size: int, other: str | None) -> str:
    return hashlib.sha256("".join(hashlib.sha256(part).hexdigest() for part in _digests(path, size)).encode()).hexdigest()


def file_equal(path: str, size: int, other: str | None) -> str | None:
    return "equal" if all(a == b for a, b in zip(_digests(path, size), _digests(other, size), strict=True)) else None


def by_path(path: str = "path") -> Source:
    """Reads files a chunk at a time, of any size, in tasks; paths must be reachable from every executor."""

    def reader(mark: Callable[[str, int, str | None], str | None], other: str | None = None) -> Callable[[DataFrame], DataFrame]:
        def read(df: DataFrame) -> DataFrame:
            names = df.columns

            def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    marks, issues = [], []
                    others = batch.column(names.index(other)).to_pylist() if other else [None] * batch.num_rows
                    for p, n, o in zip(batch.column(names.index(path)).to_pylist(), batch.column(names.index("size_bytes")).to_pylist(), others, strict=True):
                        try:
                            found, issue = mark(p, n, o), None
                        except OSError:
                            found, issue = None, "file_relation_source_unavailable"
                        except ValueError:
                            found, issue = None, "file_relation_source_changed"
                        marks.append(found)
                        issues.append(issue)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.string()), pa.array(issues, pa.string())], names=[*names, "mark", "issue"])

            return df.repartition("node_id").mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", mark string, issue string")

        return read

    return {"columns": lambda df: df.select("scope_id", "node_id", "size_bytes", path), "ends": reader(file_ends), "content": reader(file_content), "bytes": reader(file_equal, f"_least_{path}")}


def verdicts(files: DataFrame, source: Source, most: int | None = None) -> DataFrame:
    """(scope_id, node_id, size_bytes, stage, left_node_id, members, issue), a row for each file (scope_id, node_id, size_bytes and what
    the source reads; a node twice in a scope is one file).

    ``stage`` names where the file left as the only one of its kind, ``duplicate`` what stays to the end: with the smallest node of its
    group and the number of members. Files that are empty or larger than ``most`` have a null stage and an issue, as have files that can't be
    read or whose size has moved. A null size counts as empty.
    """
    all_files = source["columns"](files).dropDuplicates(["scope_id", "node_id"]).withColumn("size_bytes", F.coalesce("size_bytes", F.lit(0)).cast("long"))
    size, done = F.col("size_bytes"), []
    issue = F.when(size <= 0, "file_relation_source_empty").when(size > most if most is not None else F.lit(False), "file_relation_source_too_large")

    def out(df: DataFrame, stage: str | None, issue: str = "issue") -> None:
        done.append(df.select("scope_id", "node_id", "size_bytes", F.lit(stage).cast("string").alias("stage"), F.lit(None).cast("long").alias("left_node_id"), F.lit(None).cast("long").alias("members"), F.col(issue).alias("issue")))

    def shared(df: DataFrame, keys: list[str], stage: str) -> DataFrame:
        """Rows whose keys another node has; the others leave here."""
        groups = df.groupBy(*keys).agg((F.min("node_id") < F.max("node_id")).alias("_several"))
        both = df.join(groups, keys)
        out(both.filter("not _several").withColumn("issue", F.lit(None).cast("string")), stage)
        return both.filter("_several").drop("_several")

    marked = all_files.withColumn("issue", issue)
    out(marked.filter("issue is not null"), None)
    here, keys = shared(marked.filter("issue is null").drop("issue"), ["scope_id", "size_bytes"], "size"), ["scope_id", "size_bytes"]
    for stage in ("ends", "content"):
        read = _checkpoint(source[stage](here).withColumnRenamed("mark", f"_{stage}"))
        out(read.filter("issue is not null"), None)
        keys = [*keys, f"_{stage}"]
        here = shared(read.filter("issue is null").drop("issue"), keys, stage)
    while True:  # digests that agree while the bytes don't start a group of their own; a second round has not been seen yet
        data = [c for c in here.columns if c not in (*keys, "node_id")]
        least = here.groupBy(*keys).agg(F.min("node_id").alias("left_node_id"))
        firsts = here.join(least.withColumnRenamed("left_node_id", "node_id"), [*keys, "node_id"]).select(*keys, F.col("node_id").alias("left_node_id"), *[F.col(c).alias(f"_least_{c}") for c in data])
        pairs = _checkpoint(source["bytes"](here.join(firsts, keys).filter("node_id <> left_node_id")).drop(*[f"_least_{c}" for c in data]))
        equal = pairs.filter("mark = 'equal'")
        groups = equal.groupBy("scope_id", "left_node_id").agg((F.count("*") + 1).alias("members"))
        copies = equal.select("scope_id", "node_id", "size_bytes", "left_node_id").unionByName(equal.select("scope_id", F.col("left_node_id").alias("node_id"), "size_bytes", "left_node_id").distinct())
        done.append(copies.join(groups, ["scope_id", "left_node_id"]).select("scope_id", "node_id", "size_bytes", F.lit("duplicate").alias("stage"), "left_node_id", "members", F.lit(None).cast("string").alias("issue")))
        out(pairs.filter("issue is not null"), None)
        alone = least.join(groups.select("scope_id", "left_node_id"), ["scope_id", "left_node_id"], "left_anti").select("scope_id", F.col("left_node_id").alias("node_id"), "size_bytes")
        out(alone.withColumn("issue", F.lit(None).cast("string")), "bytes")
        rest = pairs.filter("mark is null and issue is null")
        if rest.isEmpty():
            break
        here = shared(rest.drop("left_node_id", "mark", "issue"), keys, "bytes")
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result


def duplicates(found: DataFrame) -> DataFrame:
    """The rows of :func:`siltstone.operators.relations.exact_duplicates` from verdicts."""
    return found.filter("stage = 'duplicate' and node_id <> left_node_id").select("scope_id", "left_node_id", F.col("node_id").alias("right_node_id"), "size_bytes", "members", F.lit(10_000).alias("confidence_basis_points"))
