"""Command line: `run FILE RULE` prints the rewritten source, `scan DIR RULE` reports, and rewrites unless --dry-run."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from . import api
from .sources.files import in_memory, summary_json, summary_text


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="thicket")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, first in (("run", "file"), ("scan", "dir")):
        c = commands.add_parser(name)
        c.add_argument(first)
        c.add_argument("rule", help="a rule file, or the rule itself")
        c.add_argument("-o", "--output", choices=("json", "text"), default="json" if name == "scan" else "text")
        c.add_argument("-v", "--verbose", action="store_true")
        if name == "scan":
            c.add_argument("--dry-run", action="store_true")
            c.add_argument("-e", "--extensions")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("thicket").getOrCreate()
    try:
        if args.command == "run":
            with open(args.file, encoding="utf-8") as f:
                code = f.read()
            row = api.rewrites(in_memory(spark, {args.file: code}), api.load_rule(args.rule)).first()
            if row.error:
                raise api.RuleError(row.error)
            print(row.updated)
        else:
            summary = api.scan_directory(spark, args.dir, args.rule, args.dry_run, args.extensions)
            print(summary_json(summary) if args.output == "json" else summary_text(summary))
    except (api.RuleError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
