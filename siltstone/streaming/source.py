"""Change hints as a streaming source: the spool of any number of watchers, read with offsets, bounded, and told apart from its gaps.

A watcher, one for each host or volume, appends its hints to a file of its own, a JSON line each (:func:`line`): path,
observed_kind and the time. The source's offset is how many bytes of each file have been taken, whole lines only. What a batch
takes of a file is decided by its two offsets alone, so a batch that is replayed after a failure gives the same rows: up to
``queueBytes`` of a file are read line by line; of a longer backlog nothing is, and one row with the issue ``overflow`` stands
for it, which turns into work for whole scopes. A line that cannot be read gives a row with the issue ``source_error``.

Executors read the files, each its own; the driver looks at sizes and at the last bytes of files that have grown.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

RAW = "watcher string, path string, observed_kind string, observed_at_unix_ms long, issue string"
TAIL = 1 << 16
ALL = "*"  # no path: these begin with a slash or a drive


def line(path: str, observed_kind: str, observed_at_unix_ms: int) -> bytes:
    """A hint as a watcher writes it."""
    return json.dumps({"path": path, "kind": observed_kind, "at": observed_at_unix_ms}, ensure_ascii=False).encode() + b"\n"


def parsed(data: bytes) -> tuple[str | None, str, int] | None:
    """(path, kind, time) of a line; None for one that is no hint."""
    try:
        x = json.loads(data)
        hint = x["path"], x["kind"], x["at"]
    except (ValueError, KeyError, TypeError):
        return None
    return hint if isinstance(hint[0], str) and hint[1] in ("file", "folder", "missing") and isinstance(hint[2], int) else None


class Span(InputPartition):
    """The bytes of a watcher's file that a batch takes."""

    def __init__(self, watcher: str, start: int, end: int) -> None:
        self.watcher, self.start, self.end = watcher, start, end


class SpoolReader(DataSourceStreamReader):
    def __init__(self, root: str, queue_bytes: int) -> None:
        self.root, self.queue_bytes, self.started = root, queue_bytes, int(time.time() * 1000)

    def _open(self):
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)
        return store, folder.rstrip("/")

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Each file's bytes up to its last whole line; and under no name when this reader was made, so that a stream that starts again has
        a batch to run even if nothing is new: only then does Spark look for deadlines that have passed."""
        from pyarrow import fs

        store, folder = self._open()
        out = {"": self.started}
        for info in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if info.is_file and info.base_name.endswith(".jsonl"):
                with store.open_input_file(info.path) as f:
                    end = info.size
                    while end:
                        at = max(0, end - TAIL)
                        f.seek(at)
                        cut = f.read(end - at).rfind(b"\n")
                        if cut >= 0:
                            out[info.base_name.removesuffix(".jsonl")] = at + cut + 1
                            break
                        end = at
        return out

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return [Span(w, start.get(w, 0), e) for w, e in sorted(end.items()) if w and e > start.get(w, 0)] or [Span("", 0, 0)]

    def read(self, part: Span) -> Iterator[tuple]:
        if not part.watcher:
            return
        store, folder = self._open()
        backlog = part.end - part.start > self.queue_bytes
        begin = max(part.start, part.end - TAIL) if backlog else part.start
        with store.open_input_file(f"{folder}/{part.watcher}.jsonl") as f:
            f.seek(begin)
            lines = f.read(part.end - begin).split(b"\n")[:-1]
        hints = [parsed(x) for x in lines]
        last = max((h[2] for h in hints if h), default=0)
        if backlog:
            yield part.watcher, None, "missing", last, "overflow"
            return
        for h in hints:
            yield (part.watcher, *h, None) if h else (part.watcher, None, "missing", last, "source_error")

    def commit(self, end: dict) -> None:
        pass


class WatchSource(DataSource):
    """``spark.readStream.format("siltstone_watch").option("queueBytes", ...).load(folder)``"""

    @classmethod
    def name(cls) -> str:
        return "siltstone_watch"

    def schema(self) -> str:
        return RAW

    def streamReader(self, schema) -> SpoolReader:
        queue = int(self.options.get("queueBytes", 8 * 1024 * 1024))
        if queue <= 0:
            raise ValueError("queueBytes must be positive")
        return SpoolReader(self.options["path"], queue)


def read_hints(spark: SparkSession, folder: str, queue_bytes: int | None = None) -> DataFrame:
    """The stream of raw hints of a spool."""
    spark.dataSource.register(WatchSource)
    reader = spark.readStream.format("siltstone_watch")
    return (reader if queue_bytes is None else reader.option("queueBytes", str(queue_bytes))).load(folder)


def scope_hints(raw: DataFrame, scopes: DataFrame) -> DataFrame:
    """Hints of each scope (scope_id, path_key) from raw ones: a path goes to the scopes that contain it, an issue to all, without a path."""
    from siltstone.functions.paths import ancestors

    lost = F.col("issue").isNotNull()
    reached = raw.withColumn("_above", F.explode(F.when(lost, F.array(F.lit(ALL))).otherwise(ancestors(F.col("path")))))
    # a set of scopes is small: each stands once under its path, and once for what was lost
    under = scopes.select("scope_id", F.explode(F.array("path_key", F.lit(ALL))).alias("_above"))
    return reached.join(under, "_above").select("scope_id", "path", "observed_kind", "observed_at_unix_ms")
