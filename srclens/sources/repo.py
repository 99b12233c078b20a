"""A source tree as a table (S1-S4, S7): a Python data source that lists on the driver and reads in tasks."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from srclens.config import Config, Scan
from srclens.functions.language import language
from srclens.functions.paths import glob_regex
from srclens.sources.gitignore import Ignore

SCHEMA = "relative_path string, absolute_path string, bytes bigint, text string, is_test_path boolean"
FILES_A_TASK = 256


class ScanError(OSError):
    """A root that is no directory, or a directory that couldn't be listed."""


def _any(patterns: Sequence[str]) -> re.Pattern[str] | None:
    return re.compile("(?s)" + "|".join(f"(?:{glob_regex(p)})" for p in patterns)) if patterns else None


def discover(root: str, scan: Scan) -> list[tuple[str, str, bool]]:
    """(relative path, absolute path, whether it is a test) of the files to read, by path; filters come before any reading.

    A listing that fails doesn't stop the walk, but the first failure is raised at its end.
    """
    top = Path(root)
    if not top.is_dir():
        raise ScanError(f"{root} is not a directory")
    exclude, include, tests = _any(scan.exclude), _any(scan.include), _any(scan.test_patterns)
    failed: OSError | None = None
    found: list[tuple[str, str, bool]] = []
    top = top.resolve()
    first = (Ignore.above(top).below(top) if scan.respect_gitignore else Ignore())
    todo: list[tuple[Path, Ignore]] = [(top, first)]
    seen: set[str] = set()
    while todo:
        directory, ignore = todo.pop()
        try:
            entries = sorted(os.scandir(directory), key=lambda e: e.name)
        except OSError as e:
            failed = failed or e
            continue
        for entry in entries:
            path = Path(entry.path)
            if not scan.include_hidden and entry.name.startswith("."):
                continue
            is_dir = entry.is_dir(follow_symlinks=scan.follow_symlinks)
            if scan.respect_gitignore and ignore.ignores(path, is_dir):
                continue
            if is_dir:
                real = os.path.realpath(path)
                if real not in seen:
                    seen.add(real)
                    todo.append((path, ignore.below(path) if scan.respect_gitignore else ignore))
            elif entry.is_file(follow_symlinks=scan.follow_symlinks):
                relative = path.relative_to(top).as_posix()
                if exclude is not None and exclude.match(relative) or include is not None and not include.match(relative):
                    continue
                found.append((relative, str(path), tests is not None and bool(tests.match(relative))))
    if failed is not None:
        raise ScanError(str(failed))
    return sorted(found)


def read_file(path: str, most: int) -> tuple[int, str | None]:
    """Size, and text if the file is no larger than ``most`` and UTF-8."""
    try:
        size = os.stat(path).st_size
        if size > most:
            return size, None
        with open(path, "rb") as f:
            return size, f.read().decode("utf-8")
    except (OSError, UnicodeDecodeError):
        return (os.stat(path).st_size if os.path.exists(path) else 0), None


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, str, bool]]) -> None:
        self.files = files


class RepoReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        listed = lambda k, d: options[k].split("\n") if options.get(k) else d
        base = Scan()
        self.root = options["path"]
        self.scan = Scan(
            listed("include", []), [] if options.get("exclude") == "" else listed("exclude", base.exclude), [] if options.get("tests") == "" else listed("tests", base.test_patterns),
            options.get("gitignore", "true") == "true", options.get("hidden", "false") == "true", options.get("symlinks", "false") == "true", int(options.get("maxbytes", base.max_file_bytes)),
        )

    def partitions(self) -> Sequence[InputPartition]:
        files = discover(self.root, self.scan)
        return [_Files(files[n : n + FILES_A_TASK]) for n in range(0, len(files), FILES_A_TASK)] or [_Files([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for relative, absolute, test in partition.files:
            size, text = read_file(absolute, self.scan.max_file_bytes)
            yield relative, absolute, size, text, test


class RepoSource(DataSource):
    """``spark.read.format("repo").load(root)``."""

    @classmethod
    def name(cls) -> str:
        return "repo"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RepoReader({k.lower(): v for k, v in self.options.items()})


def scan(spark: SparkSession, root: str, options: Scan | None = None) -> DataFrame:
    """``source_files`` of a tree: path, language, size, text (null where too large or not UTF-8), whether it is a test."""
    o = options or Scan()
    if not Path(root).is_dir():
        raise ScanError(f"{root} is not a directory")
    spark.dataSource.register(RepoSource)
    df = (
        spark.read.format("repo")
        .option("include", "\n".join(o.include)).option("exclude", "\n".join(o.exclude)).option("tests", "\n".join(o.test_patterns))
        .option("gitignore", str(o.respect_gitignore).lower()).option("hidden", str(o.include_hidden).lower())
        .option("symlinks", str(o.follow_symlinks).lower()).option("maxbytes", str(o.max_file_bytes))
        .load(str(root))
    )
    return df.withColumn("language", language("relative_path"))


def extra_sources(spark: SparkSession, root: str, config: Config) -> DataFrame | None:
    """Files of the extra roots, scanned with default settings, their paths below the root's name, with ``editable``."""
    parts = []
    for extra in config.clones.extra_roots:
        df = scan(spark, str(Path(root) / extra.path))
        parts.append(df.withColumn("relative_path", F.concat(F.lit(extra.path.rstrip("/") + "/"), "relative_path")).withColumn("editable", F.lit(extra.editable)))
    return reduce(DataFrame.unionByName, parts) if parts else None
