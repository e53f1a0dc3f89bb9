"""Command line: build an index of a file tree, search it, show its state."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .service import Service
from .sources.corpus import scan_tree


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="skerry")
    p.add_argument("--store", required=True, help="folder of the index, as a URL that Spark can write to")
    commands = p.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="index a folder as a new version")
    build.add_argument("folder")
    build.add_argument("--domain", default="default")
    build.add_argument("--trust", default="trusted")
    search = commands.add_parser("search")
    search.add_argument("query")
    search.add_argument("-n", type=int, default=5)
    search.add_argument("--snapshot", type=int)
    commands.add_parser("health")
    args = p.parse_args(argv)

    spark = SparkSession.builder.appName("skerry").getOrCreate()
    service = Service(spark, args.store)
    if args.command == "build":
        root = args.folder.rstrip("/")
        raw = scan_tree(spark, root)
        bare = root.split(":", 1)[-1].lstrip("/")
        below = F.expr(f"substring(path, instr(path, '{bare}') + {len(bare) + 1})")
        files = raw.select(below.alias("path"), F.lit(args.domain).alias("domain_id"), F.lit(args.trust).alias("trust_label"), "content", F.sha2("content", 256).alias("file_hash"), "modified_unix_ms")
        print(json.dumps({"version": service.build(files)}))
    elif args.command == "search":
        for row in service.search(args.query, args.n, snapshot=args.snapshot):
            print(json.dumps(row.asDict()))
    else:
        print(json.dumps(service.health()))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
