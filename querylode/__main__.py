"""The command line: python -m querylode analyze INPUT [--schema FILE] ..., list INPUT, rules."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from querylode.analysis import Options, analyse, load
from querylode.functions.language import resolve_lang
from querylode.operators import findings as after
from querylode.operators.buckets import statements
from querylode.operators.rules import RULES
from querylode.session import local_session
from querylode.sources import catalog, sinks


def arguments(argv: Sequence[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="querylode", description="Index advice for SQL workloads.")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, told in (("analyze", "findings of a slow log, SQL file, statement or folder of mappers"), ("list", "what was read of an input")):
        one = commands.add_parser(name, help=told)
        one.add_argument("input", help="a path, or the SQL or log itself")
        one.add_argument("--kind", choices=("slowlog", "sql", "mapper"))
    one = commands.choices["analyze"]
    one.add_argument("--schema", help="a catalog snapshot (JSON)")
    one.add_argument("--top", type=int, default=50)
    one.add_argument("--rules", help="only these rules, separated by commas")
    one.add_argument("--min-severity", choices=("info", "warn", "error"), default="info")
    one.add_argument("--fail-on", choices=("info", "warn", "error"), default="error")
    one.add_argument("--format", choices=("text", "json", "github", "migration"), default="text")
    one.add_argument("--mysql-version", type=float, default=8)
    one.add_argument("--deep-offset", type=int, default=10_000)
    one.add_argument("--prefix-bytes", type=int, default=3072)
    one.add_argument("--workspace", default="", help="annotations name files from here")
    one.add_argument("--lang", help="en or zh")
    commands.add_parser("rules", help="the rules and what they need")
    return parser.parse_args(argv)


def run(spark: SparkSession, args: argparse.Namespace) -> tuple[str, int]:
    """What is printed, and the exit code."""
    records = load(spark, args.input, args.kind)
    if args.command == "list":
        rows = sinks.inventory(statements(records)).collect()
        return "\n".join(" | ".join("" if x is None else str(x) for x in r) for r in rows), 0
    known = catalog.read_catalog(spark, args.schema) if args.schema else None
    chosen = tuple(r.strip() for r in args.rules.split(",")) if args.rules else None
    options = Options(mysql_version=args.mysql_version, prefix_bytes=args.prefix_bytes, deep_offset=args.deep_offset, min_severity=args.min_severity, rules=chosen)
    result = analyse(records, known, options)
    if args.format == "json":
        out = sinks.report_json(result.findings, result.skipped, result.notes, result.records, options, result.errors).first()["value"]
    elif args.format == "github":
        out = "\n".join(r["value"] for r in sinks.annotations(result.findings, args.workspace, result.notes, result.skipped).collect())
    elif args.format == "migration":
        out = "\n".join(r["value"] for r in sinks.migration(result.findings).collect())
    else:
        out = sinks.text_report(result.findings, result.skipped, result.notes, args.top, resolve_lang(args.lang), result.errors)
    code = after.exit_code(result.findings, args.fail_on, result.errors)
    return out, code


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments(sys.argv[1:] if argv is None else argv)
    if args.command == "rules":
        print("\n".join(f"{r.id} {r.title}{' (needs a catalog)' if r.needs_schema else ''}{' (needs Rows_examined)' if r.needs_metrics else ''}" for r in RULES))
        return 0
    try:
        out, code = run(spark or SparkSession.getActiveSession() or local_session("*", "querylode"), args)
    except Exception as error:
        print(f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}", file=sys.stderr)
        return 2
    print(out)
    return code


if __name__ == "__main__":
    sys.exit(main())
