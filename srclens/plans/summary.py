"""A report as text in eight sections of at most ten rows (K3)."""

from __future__ import annotations

from srclens.functions.text import human_bytes, plural, truncate_label, truncate_path
from srclens.plans import views
from srclens.plans.report import Report

ROWS = 10


def _section(title: str, rows: list[str], empty: str = "nothing") -> list[str]:
    return ["", title, "-" * len(title), *(rows or [empty])]


def render(report: Report, hide_tests: bool = False) -> str:
    t = views.totals(report, hide_tests).first()
    out = [report.name, f"{t.files} file{plural(t.files)}, {t.lines.code} lines of code, {t.functions} function{plural(t.functions)}, {t.packages} crate{plural(t.packages)}, {human_bytes(t.bytes)}"]
    out += _section("Languages", [f"{r.language:<12} {r.files:>6} files {r.lines.code:>8} lines" for r in report.languages.limit(ROWS).collect()])
    rows = views.files(report, hide_tests, sort="weight", limit=ROWS).select("relative_path", "weight", "lines").collect()
    out += _section("Heaviest files", [f"{truncate_path(r.relative_path, 60):<60} {r.weight:>8.0f} {r.lines.code:>7}" for r in rows])
    out += _section("Directories", [f"{truncate_path(r.path, 60):<60} {r.files:>5} {r.lines.code:>8}" for r in report.directories.limit(ROWS).collect()])
    rows = views.packages(report, sort="exclusive", limit=ROWS)
    out += _section("Dependencies", [f"{truncate_label(r.name, 40):<40} {r.exclusive_count:>5} alone" for r in (rows.collect() if rows is not None else [])], "not analysed")
    out += _section("Dead code", [f"{r.confidence:<7} {truncate_label(r.name, 40):<40} {truncate_path(r.file, 50)}:{r.line}" for r in views.dead_code(report, hide_tests, limit=ROWS).collect()])
    groups = views.clones(report, hide_tests, limit=ROWS)
    out += _section("Copies", [f"{r.copies:>3} x {r.lines:>4} lines  {truncate_label(r.signature, 70)}" for r in (groups.collect() if groups is not None else [])], "not analysed")
    out += _section("Files that don't parse", [f"{truncate_path(r.path, 60)}:{r.line} {r.message}" for r in report.parse_failures.limit(ROWS).collect()])
    out += _section("Findings", [f"{r.severity:<8} {truncate_label(r.title, 90)}" for r in views.findings(report, limit=ROWS).collect()])
    return "\n".join(out) + "\n"
