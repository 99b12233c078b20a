"""Rules that turn measures into findings, ranked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srclens.config import Thresholds
from srclens.functions.language import comment_ratio, has_comment_syntax

DEEP_NESTING = 5
DOCUMENTED_FROM = 50
# Rule names in the order in which they are tried, and the order of severities.
RULES = (
    "huge_file large_file underdocumented long_function complex_function deep_nesting allocation_in_loop nested_loop panic_path unfinished_work "
    "large_directory heavy_dependency duplicate_dependency unused_dependency dead_code orphan_file parse_failure duplicate_code"
).split()
SEVERITIES = ("critical", "high", "medium", "low")
COLUMNS = ("rule", "severity", "title", "detail", "suggestion", "file", "line", "metric", "seq")


def severity_rank(column: str | Column = "severity") -> Column:
    return F.array_position(F.array(*(F.lit(s) for s in SEVERITIES)), F.col(column) if isinstance(column, str) else column)


def _three(x: Column) -> Column:
    """Three decimals, ties to even, as the numbers' own bits are rounded."""
    return F.format_string("%.3f", F.bround(x, 3))


def finding(df: DataFrame, rule: str, severity: str | Column, title: Column, detail: Column, suggestion: str | Column, file: Column, line: Column, metric: Column, seq: Column) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(
        F.lit(rule).alias("rule"), lit(severity).alias("severity"), title.alias("title"), detail.alias("detail"), lit(suggestion).alias("suggestion"),
        file.cast("string").alias("file"), line.cast("bigint").alias("line"), metric.cast("double").alias("metric"),
        seq.cast("string").alias("seq"),
    )


def file_rules(files: DataFrame, t: Thresholds) -> list[DataFrame]:
    """Rules on one file's row: filters and projections of the same scan."""
    path, code = F.col("path"), F.col("lines.code")
    null = F.lit(None)
    size = lambda: [path, null, code, path]
    say = F.format_string
    out = [
        finding(files.where(code >= t.huge_file_lines), "huge_file", "high", say("%s has %d lines of code", path, code), say("%d lines are past %d.", code, F.lit(t.huge_file_lines)), "Split it where groups of functions share a concern.", *size()),
        finding(files.where((code >= t.large_file_lines) & (code < t.huge_file_lines)), "large_file", "medium", say("%s has %d lines of code", path, code), say("%d lines are past %d.", code, F.lit(t.large_file_lines)), "Split it before it grows further.", *size()),
        finding(
            files.where(~F.col("is_test") & has_comment_syntax("language") & (code >= DOCUMENTED_FROM) & (comment_ratio("lines.comment", "lines.code") < t.min_comment_ratio)),
            "underdocumented", "low", say("%s is hardly explained", path),
            say("%d comment lines for %d lines of code: %s of %s.", F.col("lines.comment"), code, _three(comment_ratio("lines.comment", "lines.code")), F.lit(f"{t.min_comment_ratio:.3f}")),
            "Say what the file is for, and when to reach for its public items.", *size(),
        ),
    ]
    signals = (
        ("allocation_in_loop", "high", F.col("rust.performance.allocations_in_loops"), None, "%s allocates in a loop %d times", "Take the allocation out of the loop, or reuse a buffer."),
        ("nested_loop", "medium", F.col("rust.performance.nested_loops"), None, "%s nests loops %d times", "Look the inner values up in a map, or bound them."),
        ("panic_path", "medium", F.col("rust.performance.unwraps"), ~F.col("is_test"), "%s may panic at %d places", "Return the error to the caller."),
        ("unfinished_work", "low", F.col("rust.todo_markers"), None, "%s marks %d places as unfinished", "Finish them, or file them where they are seen."),
    )
    for rule, severity, metric, only, title, advice in signals:
        chosen = files.where((metric > 0) & (only if only is not None else F.lit(True)))
        out.append(finding(chosen, rule, severity, say(title, path, metric), say("Counted over the whole file: %d.", metric), advice, path, null, metric, path))
    return out


def function_rules(files: DataFrame, t: Thresholds) -> list[DataFrame]:
    functions = files.select("path", F.posexplode("rust.functions").alias("n", "f")).select("path", "n", "f.*").withColumn("size", F.col("end_line") - F.col("start_line") + 1)
    say, name, path, line = F.format_string, F.col("qualified_name"), F.col("path"), F.col("start_line")
    seq = F.concat(path, F.lit("\x00"), F.lpad(F.col("n").cast("string"), 8, "0"))
    return [
        finding(functions.where(F.col("size") >= t.long_function_lines), "long_function", "medium", say("%s is %d lines long", name, F.col("size")), say("%d lines are past %d.", F.col("size"), F.lit(t.long_function_lines)), "Give its steps names of their own.", path, line, F.col("size"), seq),
        finding(functions.where(F.col("complexity") >= t.high_complexity), "complex_function", "high", say("%s takes %d decisions", name, F.col("complexity")), say("A complexity of %d is past %d.", F.col("complexity"), F.lit(t.high_complexity)), "Take branches out into functions, or into data.", path, line, F.col("complexity"), seq),
        finding(functions.where(F.col("max_nesting") >= DEEP_NESTING), "deep_nesting", "medium", say("%s nests %d blocks", name, F.col("max_nesting")), say("%d levels are past %d.", F.col("max_nesting"), F.lit(DEEP_NESTING)), "Return early, or name the inner part.", path, line, F.col("max_nesting"), seq),
    ]


def directory_rules(directories: DataFrame, t: Thresholds) -> list[DataFrame]:
    n = F.col("files")
    rows = directories.where(n >= t.large_directory_files)
    return [finding(rows, "large_directory", "low", F.format_string("%s holds %d files", "path", n), F.format_string("%d files are past %d.", n, F.lit(t.large_directory_files)), "Group the files by concern.", F.col("path"), F.lit(None), n, F.col("path"))]


def dependency_rules(heavy: DataFrame | None, duplicates: DataFrame | None, unused: DataFrame | None, t: Thresholds) -> list[DataFrame]:
    """heavy: name, exclusive_count; duplicates: name, versions; unused: package, dependency, kind."""
    none, say, out = F.lit(None), F.format_string, []
    if heavy is not None:
        n = F.col("exclusive_count")
        out.append(finding(heavy.where(n >= t.heavy_dependency_crates), "heavy_dependency", "medium", say("%s alone brings in %d crates", "name", n), say("Nothing else needs them; %d is the limit.", F.lit(t.heavy_dependency_crates)), "See whether fewer features, or another crate, will do.", none, none, n, F.col("name")))
    if duplicates is not None:
        n = F.size("versions")
        out.append(finding(duplicates.where(n > 1), "duplicate_dependency", "medium", say("%s is there in %d versions", "name", n), F.array_join("versions", ", "), "Move its users to one version.", none, none, n, F.col("name")))
    if unused is not None:
        out.append(finding(unused, "unused_dependency", "low", say("%s declares %s but never names it", "package", "dependency"), say("No path in the package's sources begins with it (%s).", "kind"), "Remove it, or list it as known.", none, none, F.lit(1.0), F.concat_ws("/", "package", "dependency")))
    return out


def dead_code_rules(dead: DataFrame, files: DataFrame) -> list[DataFrame]:
    high = dead.where("confidence = 'high' and kind <> 'file'")
    first = F.min_by(F.struct("name", "file", "line"), F.struct("file", "line", "name")).alias("first")
    summed = high.agg(F.count("*").alias("n"), first).where("n > 0")
    orphans = dead.where("kind = 'file'").join(files.select(F.col("path").alias("file"), F.col("lines.code").alias("code")), "file", "left").withColumn("code", F.coalesce("code", F.lit(0)))
    say = F.format_string
    return [
        finding(summed, "dead_code", "high", say("%d items are used nowhere", "n"), say("The first is %s in %s.", "first.name", "first.file"), "Delete them, or make use of them.", F.col("first.file"), F.col("first.line"), F.col("n"), F.lit("")),
        finding(orphans, "orphan_file", "high", say("%s is in no module", "file"), say("Its %d lines of code are never compiled.", "code"), "Declare it, or delete it.", F.col("file"), F.lit(1), F.col("code"), F.col("file")),
    ]


def parse_failure_rules(failures: DataFrame) -> list[DataFrame]:
    return [finding(failures, "parse_failure", "low", F.format_string("%s doesn't parse", "path"), F.coalesce("message", F.lit("")), "Only its lines are counted until it does.", F.col("path"), F.col("line"), F.lit(1.0), F.concat("path", F.lit("\x00"), F.lpad(F.coalesce("line", F.lit(0)).cast("string"), 12, "0")))]


def clone_rules(groups: DataFrame, t: Thresholds) -> list[DataFrame]:
    """groups: in_tests, lines_saved, instances (file, start_line, item, editable), sketch_signature, n (its place)."""
    mine = F.filter("instances", lambda i: i["editable"])
    saved = F.col("lines_saved")
    rows = groups.where(~F.col("in_tests") & (saved >= t.duplicate_min_lines) & (F.size(mine) > 0)).withColumn("first", F.element_at(mine, 1))
    places = F.array_join(F.transform(F.slice("instances", 1, 3), lambda i: F.format_string("%s:%d", i["file"], i["start_line"])), ", ")
    return [
        finding(
            rows, "duplicate_code", F.when(saved >= 10 * t.duplicate_min_lines, "high").otherwise("medium"), F.format_string("%s is there %d times", "first.item", F.size("instances")),
            F.format_string("At %s; one copy would save %d lines.", places, saved), F.format_string("Write `%s` once.", "signature"), F.col("first.file"), F.col("first.start_line"), saved, F.lpad(F.col("n").cast("string"), 8, "0"),
        )
    ]


def ranked(parts: list[DataFrame]) -> DataFrame:
    """All findings with a total order: severity, metric downwards, then the place in which a rule found it."""
    every = reduce(DataFrame.unionByName, parts)
    rank = F.array_position(F.array(*(F.lit(r) for r in RULES)), F.col("rule"))
    return every.orderBy(severity_rank(), F.desc("metric"), rank, "seq", "title").select(*[c for c in COLUMNS if c != "seq"])


def worst_severity(found: DataFrame, paths: DataFrame) -> DataFrame:
    """The worst severity at or below each path (J14): findings go to their ancestors, so that it is an equality join."""
    up = F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("file", "/"))), lambda n: F.array_join(F.slice(F.split("file", "/"), 1, n), "/")))
    worst = found.where("file is not null").select(up.alias("path"), severity_rank().alias("rank")).groupBy("path").agg(F.min("rank").alias("rank"))
    named = F.try_element_at(F.array(*(F.lit(s) for s in SEVERITIES)), F.col("rank").cast("int"))
    return paths.join(worst, "path", "left").withColumn("worst", named).drop("rank")
