"""The interactive views as parameterised queries: filter, order and limit over a report's tables (2.10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srclens.functions.paths import immediate_child
from srclens.functions.text import matches
from srclens.operators.findings import severity_rank
from srclens.operators.lines import without
from srclens.plans.report import Report

#: The orders of each view in the order in which they are cycled through, and the first one's place.
SORTS = {
    "overview": (["severity", "title", "rule"], 0), "files": (["weight", "path", "lines", "size", "complexity"], 3), "directories": (["size", "path", "files", "lines"], 0),
    "dependencies": (["exclusive", "name", "reachable", "size"], 3), "dead_code": (["confidence", "name", "file"], 0), "clones": (["score", "lines_saved", "copies"], 0), "findings": (["severity", "title", "rule"], 0),
}
CHILDREN, UNREACHABLE, TOP = 60, 12, 8


def _sort(view: str, sort: str | None) -> str:
    names, first = SORTS[view]
    if sort is not None and sort not in names:
        raise ValueError(f"{view} has no order {sort}")
    return sort or names[first]


def _limit(df: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    out = df.orderBy(*order)
    return out if limit is None else out.limit(limit)


def files(report: Report, hide_tests: bool = False, text: str = "", sort: str | None = None, limit: int | None = None) -> DataFrame:
    rows = report.files.where(matches("relative_path", text))
    if hide_tests:
        rows = rows.where(~F.col("is_test")).withColumn("lines", without("lines", "test_lines"))
    kept = F.col("rust.functions") if not hide_tests else F.filter("rust.functions", lambda f: ~f["is_test"])
    rows = rows.withColumn("complexity", F.coalesce(F.aggregate(kept, F.lit(0).cast("bigint"), lambda a, f: a + f["complexity"]), F.lit(0)))
    order = {"weight": F.desc("weight"), "path": F.asc("relative_path"), "lines": F.desc("lines.code"), "size": F.desc("bytes"), "complexity": F.desc("complexity")}
    return _limit(rows, [order[_sort("files", sort)], F.asc("relative_path")], limit)


def directories(report: Report, current: str = ".", hide_tests: bool = False, text: str = "", sort: str | None = None, limit: int | None = CHILDREN) -> DataFrame:
    """What is right below a directory, each with all that is below it; ``..`` comes first where there is a way up."""
    rows = files(report, hide_tests, text, "path").withColumn("child", immediate_child(current, "directory")).where("child is not null")
    grouped = rows.groupBy(F.col("child").alias("path")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sum("lines.code").alias("code"))
    order = {"size": F.desc("bytes"), "path": F.asc("path"), "files": F.desc("files"), "lines": F.desc("code")}
    out = grouped.withColumn("up", F.lit(False))
    if current not in (".", ""):
        up = report.totals.select(F.lit("..").alias("path"), F.lit(0).cast("bigint").alias("files"), F.lit(0).cast("bigint").alias("bytes"), F.lit(0).cast("bigint").alias("code"), F.lit(True).alias("up"))
        out = out.unionByName(up)
    return _limit(out, [F.desc("up"), order[_sort("directories", sort)], F.asc("path")], limit)


def packages(report: Report, text: str = "", sort: str | None = None, limit: int | None = None) -> DataFrame | None:
    if report.packages is None:
        return None
    order = {"exclusive": F.desc("exclusive_count"), "name": F.asc("name"), "reachable": F.desc("transitive_count"), "size": F.desc("source_bytes")}
    return _limit(report.packages.where(matches("name", text)), [order[_sort("dependencies", sort)], F.asc("name"), F.asc("version")], limit)


def dead_code(report: Report, hide_tests: bool = False, text: str = "", sort: str | None = None, limit: int | None = None) -> DataFrame:
    rows = report.dead_code.where(matches("name", text) | matches("file", text))
    rows = rows.where(~F.col("is_test")) if hide_tests else rows
    order = {"confidence": F.when(F.col("confidence") == "high", 0).otherwise(1), "name": F.asc("name"), "file": F.asc("file")}
    return _limit(rows, [order[_sort("dead_code", sort)], F.asc("file"), F.asc("line"), F.asc("name")], limit)


def clones(report: Report, hide_tests: bool = False, text: str = "", sort: str | None = None, limit: int | None = None) -> DataFrame | None:
    if report.clones is None:
        return None
    rows = report.clones.where(matches("signature", text) | F.exists("instances", lambda i: matches(i["file"], text) | matches(i["item"], text)))
    rows = rows.where(~F.col("in_tests")) if hide_tests else rows
    order = {"score": F.asc("rank"), "lines_saved": F.desc("lines_saved"), "copies": F.desc("copies")}
    return _limit(rows, [order[_sort("clones", sort)], F.asc("rank")], limit)


def findings(report: Report, text: str = "", sort: str | None = None, limit: int | None = None) -> DataFrame:
    rows = report.findings.where(matches("title", text) | matches("rule", text))
    order = {"severity": severity_rank(), "title": F.asc("title"), "rule": F.asc("rule")}
    return _limit(rows, [order[_sort("findings", sort)], F.desc("metric"), F.asc("title")], limit)


overview = findings


def totals(report: Report, hide_tests: bool = False) -> DataFrame:
    from srclens.operators.metrics import production_totals

    return production_totals(report.files) if hide_tests else report.totals


def top_languages(report: Report) -> DataFrame:
    return report.languages.limit(TOP)


def file_detail(report: Report, path: str) -> tuple[DataFrame, DataFrame]:
    """One file's row, and its eight most complex functions."""
    row = report.files.where(F.col("relative_path") == path)
    functions = row.select(F.explode("rust.functions").alias("f")).select("f.*").withColumn("lines", F.col("end_line") - F.col("start_line") + 1)
    return row, functions.orderBy(F.desc("complexity"), F.desc("lines"), "start_line").limit(TOP)
