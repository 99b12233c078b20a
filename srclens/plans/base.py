"""The register of queries, the tables they read, and pieces of SQL that many of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from srclens.functions import language as lang

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Scanned files, repeated rows once."""
    return table(spark, sf_dir, "source_files").select("file_id", *columns).dropDuplicates(["file_id"])


FILES = "(SELECT DISTINCT ON (file_id) * FROM source_files)"
SYMBOLS = "(SELECT DISTINCT ON (symbol_id) * FROM symbols)"
_CASES = " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in lang.EXTENSIONS.items())
NAME = "regexp_extract(relative_path, '([^/]*)$', 1)"
LANGUAGE = f"CASE CASE WHEN contains({NAME}, '.') THEN lower(regexp_extract({NAME}, '\\.([^.]*)$', 1)) ELSE '' END {_CASES} ELSE 'other' END"
DIRECTORY = "CASE WHEN contains(relative_path, '/') THEN regexp_extract(relative_path, '^(.*)/[^/]*$', 1) ELSE '.' END"
LINES = "CASE WHEN text = '' THEN []::VARCHAR[] ELSE string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n$', ''), chr(10)) END"
BLANKS = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
