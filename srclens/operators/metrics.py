"""Files, directories, languages and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srclens.functions.language import language_rank
from srclens.functions.paths import ancestors, directory, immediate_child
from srclens.operators import lines as L
from srclens.operators.rust_files import weight
from srclens.rust.measure import ITEMS, SIGNALS

COUNTS = ("total", "code", "comment", "blank")


def _sum_counts(column: str = "lines", when: Column | None = None) -> Column:
    of = lambda n: F.col(f"{column}.{n}") if when is None else F.when(when, F.col(f"{column}.{n}"))
    return F.struct(*(F.coalesce(F.sum(of(n)), F.lit(0)).cast("bigint").alias(n) for n in COUNTS)).alias(column)


def range_counts() -> Column:
    """Counts of a file's lines in its test ranges (L4, J7): the ranges are an array on the row, so no join is needed."""

    @F.pandas_udf(L.COUNTS)
    def run(text, ranges):
        import pandas as pd

        rows = [L.count_ranges(t, [(r["start_line"], r["end_line"]) for r in rs]) if t and rs is not None and len(rs) else (0, 0, 0, 0) for t, rs in zip(text, ranges)]
        return pd.DataFrame(rows, columns=COUNTS)

    return run(F.col("text"), F.col("rust.test_ranges"))


def file_metrics(scanned: DataFrame, parsed: DataFrame, key: str = "relative_path") -> DataFrame:
    """One row a file: lines, Rust measures, weight, test lines; ``scanned`` has ``language``, ``text``, ``bytes``, ``is_test_path``."""
    rust = parsed.select(key, "rust", "failure")
    files = L.with_line_counts(scanned).join(rust, key, "left").withColumn("directory", directory(key))
    files = files.withColumn("is_test", F.coalesce("is_test_path", F.lit(False)) | F.coalesce("rust.is_test_module", F.lit(False)))
    has = F.size(F.coalesce(F.col("rust.test_ranges"), F.array().cast("array<struct<start_line:bigint,end_line:bigint>>"))) > 0
    files = files.withColumn("range_lines", F.when(has, range_counts()))
    zero = F.struct(*(F.lit(0).cast("bigint").alias(n) for n in COUNTS))
    files = files.withColumn("test_lines", F.when(F.col("is_test"), F.col("lines")).otherwise(F.coalesce("range_lines", zero)))
    return files.drop("range_lines").withColumn("weight", weight())


def mark_test_only(files: DataFrame, test_only: DataFrame, key: str = "relative_path") -> DataFrame:
    """Files that only tests reach are tests."""
    marked = files.join(test_only.select(F.col("path").alias(key), F.lit(True).alias("__t")).distinct(), key, "left")
    return (
        marked.withColumn("is_test", F.col("is_test") | F.coalesce("__t", F.lit(False)))
        .withColumn("test_lines", F.when(F.col("is_test"), F.col("lines")).otherwise(F.col("test_lines")))
        .drop("__t")
    )


def by_weight(files: DataFrame, key: str = "relative_path") -> DataFrame:
    return files.orderBy(F.desc("weight"), key)


def directories(files: DataFrame) -> DataFrame:
    """Per directory: files, bytes, lines, and whether all of it is tests (A1)."""
    return files.groupBy("directory").agg(
        F.count("*").alias("files"), F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"), _sum_counts(), F.bool_and("is_test").alias("is_test_only")
    ).withColumnRenamed("directory", "path").orderBy(F.desc("lines.code"), "path")


def languages(files: DataFrame) -> DataFrame:
    """Per language, by code lines and then by the languages' rank (A2)."""
    return files.groupBy("language").agg(F.count("*").alias("files"), F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"), _sum_counts()).orderBy(F.desc("lines.code"), language_rank("language"))


def _measures(name: str, fields: list[str]) -> Column:
    return F.struct(*(F.coalesce(F.sum(f"rust.{name}.{f}"), F.lit(0)).cast("bigint").alias(f) for f in fields)).alias(name)


def totals(files: DataFrame, packages: int | Column = 0) -> DataFrame:
    """One row for the whole scan (A3)."""
    lit = packages if isinstance(packages, Column) else F.lit(packages)
    return files.agg(
        F.count("*").alias("files"), F.count(F.when(F.col("is_test"), 1)).alias("test_files"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("bytes"),
        _sum_counts(), _sum_counts("test_lines"),
        F.coalesce(F.sum(F.size("rust.functions")), F.lit(0)).cast("bigint").alias("functions"),
        F.coalesce(F.sum(F.size(F.filter("rust.functions", lambda f: f["is_test"]))), F.lit(0)).cast("bigint").alias("test_functions"),
        _measures("items", ITEMS), _measures("performance", SIGNALS), F.count_distinct("directory").alias("directories"),
        F.coalesce(F.sum("rust.todo_markers"), F.lit(0)).cast("bigint").alias("todo_markers"),
    ).withColumn("packages", lit.cast("bigint"))


def production_totals(files: DataFrame) -> DataFrame:
    """The totals without tests: only functions, lines and directories are adjusted (A4)."""
    own = files.where(~F.col("is_test"))
    zero = F.struct(*(F.lit(0).cast("bigint").alias(n) for n in COUNTS))
    t = totals(own)
    less = F.col("functions") - F.col("test_functions")
    return (
        t.withColumn("lines", L.without("lines", "test_lines")).withColumn("items", F.col("items").withField("functions", F.greatest(F.col("items.functions") - F.col("test_functions"), F.lit(0))))
        .withColumn("functions", F.greatest(less, F.lit(0))).withColumn("test_functions", F.lit(0).cast("bigint")).withColumn("test_files", F.lit(0).cast("bigint")).withColumn("test_lines", zero)
    )


def rollup(files: DataFrame) -> DataFrame:
    """Every directory with all that is below it (A9): each file's row goes to its ancestors after one aggregation by directory."""
    own = files.groupBy("directory").agg(F.count("*").alias("files"), F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"), *(F.sum(f"lines.{n}").alias(n) for n in COUNTS))
    up = own.withColumn("path", F.explode(ancestors("directory")))
    return up.groupBy("path").agg(*(F.sum(c).alias(c) for c in ("files", "bytes", *COUNTS)))


def children(files: DataFrame, current: str = ".") -> DataFrame:
    """The directories right below one, each with its whole subtree."""
    below = files.withColumn("child", immediate_child(current, "directory")).where("child is not null")
    return below.groupBy("child").agg(F.count("*").alias("files"), F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"), _sum_counts())
