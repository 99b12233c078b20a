"""Line counter with block-comment state, and markers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srclens.functions.language import BLOCK, block_comments, line_comments

CODE, COMMENT, BLANK = "code", "comment", "blank"
COUNTS = "struct<total:bigint,code:bigint,comment:bigint,blank:bigint>"


def lines(text: str) -> list[str]:
    """Lines without their ends; a last empty one is none."""
    out = text.split("\n")
    if out and out[-1] == "":
        out.pop()
    return [x[:-1] if x.endswith("\r") else x for x in out]


@cache
def _opener(language: str) -> re.Pattern[str] | None:
    """Finds the first block opener outside of strings: group ``open``. Where openers are quotes themselves, strings aren't skipped."""
    opens = [re.escape(o) for o, _ in block_comments(language)]
    if not opens:
        return None
    found = f"(?P<open>{'|'.join(opens)})"
    if any(o[0] in "\"'" for o, _ in block_comments(language)):
        return re.compile(found, re.S)
    skip = r""""(?:\\.|[^"\\])*(?:"|\\?$)|'(?:\\.|[^'\\])*(?:'|\\?$)"""
    return re.compile(f"{found}|{skip}", re.S)


def classify(language: str, text: str) -> list[str]:
    """The kind of each line. A blank line in a block comment belongs to the comment; code anywhere makes a line code."""
    marks = tuple(line_comments(language))
    closers = dict(block_comments(language))
    opener = _opener(language)
    until = ""  # what closes the open block
    out = []
    for line in lines(text):
        rest = line.strip()
        if not rest and not until:
            out.append(BLANK)
            continue
        kind = COMMENT
        while rest:
            if until:
                _, found, rest = rest.partition(until)
                if not found:
                    break
                until = ""
                rest = rest.strip()
                continue
            if marks and rest.startswith(marks):
                break
            m = opener.search(rest) if opener else None
            while m and not m.group("open"):
                m = opener.search(rest, m.end()) if m.end() < len(rest) else None
            if m is None:
                kind = CODE
                break
            until = closers[m.group("open")]
            if m.start():
                kind = CODE
                if until in rest[m.end() :]:
                    until = ""
                break
            rest = rest[m.end() :]
        out.append(kind)
    return out


def count_lines(language: str, text: str | None) -> tuple[int, int, int, int]:
    """Total, code, comment and blank lines; all 0 for null."""
    kinds = classify(language, text) if text else []
    return len(kinds), kinds.count(CODE), kinds.count(COMMENT), kinds.count(BLANK)


def count_ranges(text: str, ranges: list[tuple[int, int]]) -> tuple[int, int, int, int]:
    """Counts of the Rust lines that are in a range of lines (from 1, both ends in), rejoined (L4)."""
    inside = [x for n, x in enumerate(lines(text), 1) if any(a <= n <= b for a, b in ranges)]
    return count_lines("rust", "\n".join(inside))


def _udf():
    @F.pandas_udf(COUNTS)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for language, text in batches:
            rows = [count_lines(a, b) for a, b in zip(language, text)]
            yield pd.DataFrame(rows, columns=["total", "code", "comment", "blank"])

    return run


def stateless_counts(language: Column, text: Column) -> Column:
    """Line counts of languages without block comments, on the JVM."""
    rows = F.split(F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), r"\n\z", ""), "\n")
    rows = F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(rows)
    trimmed = F.transform(rows, lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    hashed = language.isin(*[x for x in ("toml", "yaml", "shell")])
    blank = F.size(F.filter(trimmed, lambda x: x == ""))
    comment = F.when(hashed, F.size(F.filter(trimmed, lambda x: x.startswith("#")))).otherwise(F.lit(0))
    total = F.size(rows)
    return F.struct(*(c.cast("bigint").alias(n) for c, n in ((total, "total"), (total - blank - comment, "code"), (comment, "comment"), (blank, "blank"))))


def with_line_counts(files: DataFrame, language: str = "language", text: str = "text") -> DataFrame:
    """Adds ``lines``. Only languages with block comments go through Python; a null text counts 0."""
    blocky = sorted({n for names in BLOCK.values() for n in names})
    needs = F.col(language).isin(*blocky)
    counted = _udf()(F.col(language), F.when(needs, F.col(text)))
    zero = F.struct(*(F.lit(0).cast("bigint").alias(n) for n in ("total", "code", "comment", "blank")))
    return files.withColumn("lines", F.when(F.col(text).isNull(), zero).when(needs, counted).otherwise(stateless_counts(F.col(language), F.col(text))))


def file_lines(files: DataFrame, key: str, language: str = "language", text: str = "text") -> DataFrame:
    """One row a line: ``line_no`` (from 1), ``raw``, ``kind``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, a, t in zip(pdf.key, pdf.language, pdf.text):
                out += [(k, n, raw, kind) for n, (raw, kind) in enumerate(zip(lines(t), classify(a, t)), 1)]
            yield pd.DataFrame(out, columns=["key", "line_no", "raw", "kind"])

    rows = files.select(F.col(key).alias("key"), F.col(language).alias("language"), F.col(text).alias("text")).where("text is not null")
    return rows.mapInPandas(run, f"key {files.schema[key].dataType.simpleString()}, line_no bigint, raw string, kind string").withColumnRenamed("key", key)


def todo_markers(text: str | Column) -> Column:
    """Lines that begin like a comment and name unfinished work."""
    rows = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"(?U)^\s*(//|\*)") & x.rlike("TODO|FIXME|HACK|XXX"))
    return F.coalesce(F.size(rows), F.lit(0))


def without(left: str, right: str) -> Column:
    """Counts less others, never below 0."""
    return F.struct(*(F.greatest(F.col(f"{left}.{n}") - F.col(f"{right}.{n}"), F.lit(0)).cast("bigint").alias(n) for n in ("total", "code", "comment", "blank")))
