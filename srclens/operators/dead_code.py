"""Items that nothing seems to use (D1, D2, J2): it under-reports, as a name's other uses hide it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srclens.config import DeadCode
from srclens.operators.rust_files import census, declaration_counts, definitions, identifier_uses

SCHEMA = "name string, kind string, file string, line bigint, is_public boolean, is_test boolean, confidence string, reason string"


def candidates(uses: DataFrame, defs: DataFrame, ignore: list[str]) -> DataFrame:
    """Definitions (file, name, kind, line, flags) whose name isn't seen more often than it is declared.

    Both sides are aggregated by name before they meet; names are many, so the joins shuffle small rows only.
    """
    open_ = defs.where((F.col("kind") != "module") & ~F.col("is_externally_reachable") & ~F.col("name").isin(*ignore))
    return (
        open_.join(declaration_counts(defs), "name", "left")
        .join(census(uses), "name", "left")
        .where(F.coalesce("uses", F.lit(0)) <= F.coalesce("declared", F.lit(0)))
        .select(
            "name", "kind", "file", "line", "is_public", "is_test", F.when(F.col("is_public"), "medium").otherwise("high").alias("confidence"),
            F.when(F.col("is_public"), "public, and its name is not used in this workspace").otherwise("its name is not used in this workspace").alias("reason"),
        )
    )


def analyze(parsed: DataFrame, config: DeadCode | None = None) -> DataFrame:
    """Dead-code candidates of parsed files (``file``, ``is_test_file``, ``rust``)."""
    config = config or DeadCode()
    if not config.enabled:
        return parsed.sparkSession.createDataFrame([], SCHEMA)
    counted = parsed.where("rust is not null")
    if not config.tests_count_as_uses:
        counted = counted.where(~F.col("is_test_file"))
    return candidates(identifier_uses(counted, "file"), definitions(counted, "file"), config.ignore)


def add_orphans(found: DataFrame, orphans: DataFrame, tests: DataFrame) -> DataFrame:
    """With one candidate for each file that no module declares."""
    parts = F.filter(F.split("path", "/"), lambda p: p != "mod.rs")
    rows = orphans.join(tests.select(F.col("file").alias("path"), "is_test_file"), "path", "left").select(
        F.regexp_replace(F.try_element_at(parts, F.lit(-1)), r"\.rs$", "").alias("name"), F.lit("file").alias("kind"), F.col("path").alias("file"),
        F.lit(1).cast("bigint").alias("line"), F.lit(False).alias("is_public"), F.coalesce("is_test_file", F.lit(False)).alias("is_test"),
        F.lit("high").alias("confidence"), F.lit("no module declares this file").alias("reason"),
    )
    return found.unionByName(rows)


def ordered(found: DataFrame) -> DataFrame:
    return found.orderBy(F.when(F.col("confidence") == "high", 0).otherwise(1), "file", "line", "name")
