"""Command line (K4, K6): ``python -m srclens.cli ROOT -o summary|json|symbols|VIEW``."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from srclens import config as configuration
from srclens.plans import report as reports
from srclens.plans import summary, views

VIEWS = ("overview", "files", "dependencies", "dead_code", "clones", "findings")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="srclens")
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("-c", "--config")
    p.add_argument("-o", "--output", choices=("dashboard", "summary", "json", "symbols"), default="summary")
    p.add_argument("--write")
    p.add_argument("--view", choices=VIEWS)
    p.add_argument("--metadata", help="a saved package graph")
    for flag in ("hide-tests", "no-deps", "no-dead-code", "no-clones", "hidden", "no-ignore"):
        p.add_argument(f"--{flag}", action="store_true")
    return p


def configured(args: argparse.Namespace) -> configuration.Config:
    """The file's settings with the flags' over them."""
    c = configuration.from_file(args.config) if args.config else configuration.load(args.path)
    c.dependencies.enabled &= not args.no_deps
    c.dead_code.enabled &= not args.no_dead_code
    c.clones.enabled &= not args.no_clones
    c.scan.include_hidden |= args.hidden
    c.scan.respect_gitignore &= not args.no_ignore
    c.ui.hide_tests |= args.hide_tests
    c.ui.start_view = args.view or c.ui.start_view
    return c


def run(spark: SparkSession, args: argparse.Namespace) -> str:
    c = configured(args)
    if args.output == "symbols":
        return reports.symbols_to_json_lines(reports.symbol_index(spark, args.path, c))
    report = reports.analyze(spark, args.path, c, args.metadata)
    if args.output == "json":
        return report.to_json()
    if args.output == "summary":
        return summary.render(report, c.ui.hide_tests)
    view = {"overview": views.overview, "files": views.files, "dependencies": views.packages, "dead_code": views.dead_code, "clones": views.clones, "findings": views.findings}[c.ui.start_view]
    rows = view(report, limit=c.ui.table_rows)
    return "" if rows is None else rows.drop("text", "rust").toPandas().to_string(index=False) + "\n"


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        text = run(SparkSession.builder.appName("srclens").getOrCreate(), args)
        if args.write:
            Path(args.write).write_text(text, encoding="utf-8")
        else:
            sys.stdout.write(text)
    except (OSError, ValueError) as e:
        print(f"srclens: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
