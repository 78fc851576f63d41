"""Command line: ``python -m siltstone WAREHOUSE COMMAND ...``; answers are JSON lines."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from siltstone.engine import Engine
from siltstone.errors import EngineError
from siltstone.operators.search import Request
from siltstone.session import local_session
from siltstone.sources.listing import tree_fixture


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siltstone")
    p.add_argument("warehouse")
    c = p.add_subparsers(dest="command", required=True)
    for name in ("health", "manifest-stats", "extract", "extract-stats", "search-folders", "projects", "duplicates", "versions", "record-relations", "inbox"):
        c.add_parser(name)
    c.add_parser("scope-add").add_argument("root")
    c.add_parser("scan").add_argument("scope", type=int)
    c.add_parser("folder-profile").add_argument("node", type=int)
    c.add_parser("relation-sources")
    x = c.add_parser("exclude")
    x.add_argument("scope", type=int)
    x.add_argument("path")
    x.add_argument("revision", type=int)
    v = c.add_parser("revoke")
    v.add_argument("scope", type=int)
    v.add_argument("revision", type=int)
    d = c.add_parser("decide")
    d.add_argument("relation", type=int)
    d.add_argument("decision", choices=("accepted", "rejected"))
    s = c.add_parser("search")
    s.add_argument("query")
    for flag, kind in (("--scope", int), ("--folder", int), ("--source", str), ("--extension", str), ("--since", int), ("--before", int), ("--limit", int)):
        s.add_argument(flag, type=kind)
    f = c.add_parser("fixture")
    f.add_argument("root")
    f.add_argument("--files", type=int, default=10_000)
    f.add_argument("--folders", type=int, default=100)
    return p


def main(argv: list[str]) -> int:
    a = parser().parse_args(argv)
    if a.command == "fixture":
        tree_fixture(a.root, a.files, a.folders)
        return 0
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    e = Engine(spark, a.warehouse)
    try:
        match a.command:
            case "scope-add":
                print(e.add_scope(a.root))
                return 0
            case "record-relations":
                print(e.record_relations())
                return 0
            case "decide":
                print(e.decide(a.relation, a.decision))
                return 0
            case "search":
                out = e.search(Request(a.query, a.scope, a.folder, a.source or "all", a.extension, a.since, a.before, a.limit))
            case "exclude":
                out = e.exclude(a.scope, a.path, a.revision)
            case "revoke":
                out = e.revoke(a.scope, a.revision)
            case "scan":
                out = e.scan(a.scope)
            case "folder-profile":
                out = e.folder_profile(a.node)
            case "extract-stats":
                out = e.extracted().groupBy("status").count()
            case "manifest-stats":
                out = e.stats()
            case "search-folders":
                out = e.folders()
            case name:
                out = getattr(e, name.replace("-", "_"))()
        for row in out.select(F.to_json(F.struct("*")).alias("row")).toLocalIterator():  # a partition at a time, to its end
            print(row.row)
        return 0
    except EngineError as error:
        print(error.code, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
