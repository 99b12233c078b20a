"""Path and glob expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def directory(path: str | Column) -> Column:
    """What is before the last ``/``; ``.`` at the root."""
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def file_name(path: str | Column) -> Column:
    return F.substring_index(path, "/", -1)


def ancestors(dir_: str | Column) -> Column:
    """All prefixes of a directory that end at a ``/``, itself among them, shortest first; ``.`` comes first of all."""
    col = F.col(dir_) if isinstance(dir_, str) else dir_
    parts = F.split(col, "/")
    below = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.when(col == ".", F.array(F.lit("."))).otherwise(F.concat(F.array(F.lit(".")), below))


def join(base: str | Column, relative: str | Column) -> Column:
    """``relative`` taken from ``base``; null if it is absolute or climbs above the root."""
    base, relative = (F.col(x) if isinstance(x, str) else x for x in (base, relative))
    slashed = F.translate(relative, "\\", "/")
    start = F.filter(F.split(F.when(base == ".", F.lit("")).otherwise(base), "/"), lambda p: p != "")
    steps = F.filter(F.split(slashed, "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(
        steps,
        F.struct(start.alias("at"), F.lit(True).alias("ok")),
        lambda s, p: F.struct(
            F.when(p == "..", F.slice(s["at"], F.lit(1), F.greatest(F.size(s["at"]) - 1, F.lit(0)))).otherwise(F.array_append(s["at"], p)).alias("at"),
            (s["ok"] & ~((p == "..") & (F.size(s["at"]) == 0))).alias("ok"),
        ),
    )
    return F.when(~slashed.startswith("/") & folded["ok"], F.array_join(folded["at"], "/"))


def stem(path: str | Column) -> Column:
    """A Rust file's name without its extension."""
    return F.regexp_replace(file_name(path), r"\.rs$", "")


def module_name(path: str | Column) -> Column:
    """The module a file holds: its stem, or its directory's name for ``mod.rs``."""
    col = F.col(path) if isinstance(path, str) else path
    return F.when(file_name(col) == "mod.rs", F.substring_index(directory(col), "/", -1)).otherwise(stem(col))


def is_auto_target(path: str | Column, prefix: str) -> Column:
    """``prefix/n.rs`` or ``prefix/n/main.rs``."""
    col = F.col(path) if isinstance(path, str) else path
    return col.rlike("^" + re.escape(prefix) + r"/(?:[^/]+\.rs|[^/]+/main\.rs)$")


def immediate_child(current: str, dir_: str | Column) -> Column:
    """First part of a directory below ``current``; null if it isn't below."""
    col = F.col(dir_) if isinstance(dir_, str) else dir_
    if current in (".", ""):
        return F.when(col != ".", F.substring_index(col, "/", 1))
    start = current.rstrip("/") + "/"
    return F.when(col.startswith(start), F.concat(F.lit(start), F.substring_index(F.substr(col, F.lit(len(start) + 1)), "/", 1)))


def glob_regex(pattern: str) -> str:
    """A glob as an anchored regular expression: ``*`` and ``?`` also match ``/``; ``**/`` any directories; ``{a,b}`` either."""
    out, depth, n = [], 0, 0
    while n < len(pattern):
        c = pattern[n]
        if pattern.startswith("**/", n) and (n == 0 or pattern[n - 1] == "/"):
            out.append("(?:.*/)?")
            n += 3
            continue
        if pattern.startswith("/**", n) and n + 3 == len(pattern):
            out.append("/.*")
            n += 3
            continue
        if c == "*":
            out.append(".*")
            while n + 1 < len(pattern) and pattern[n + 1] == "*":
                n += 1
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = pattern.find("]", n + 2)
            if end < 0:
                raise ValueError(f"glob {pattern}: class without end")
            body = pattern[n + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body) + "]")
            n = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}":
            depth -= 1
            if depth < 0:
                raise ValueError(f"glob {pattern}: brace without start")
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and n + 1 < len(pattern):
            n += 1
            out.append(re.escape(pattern[n]))
        else:
            out.append(re.escape(c))
        n += 1
    if depth:
        raise ValueError(f"glob {pattern}: brace without end")
    return "^" + "".join(out) + "$"


def matches_any(path: str | Column, patterns: list[str]) -> Column | None:
    """Whether one of the globs matches; None for an empty list, which has no opinion."""
    if not patterns:
        return None
    col = F.col(path) if isinstance(path, str) else path
    return col.rlike("(?s)" + "|".join(f"(?:{glob_regex(p)})" for p in patterns))


def notes_for(files: DataFrame, notes: list, path: str = "path") -> DataFrame:
    """Adds ``notes``: every note whose glob matches, in the order of the configuration; a bad glob matches nothing.

    The configuration's few patterns become one array expression: no join is needed.
    """
    found = []
    for note in notes:
        try:
            regex = glob_regex(note.path)
        except ValueError:
            continue
        found.append(F.when(F.col(path).rlike("(?s)" + regex), F.struct(F.lit(note.note).alias("note"), F.lit(note.level).alias("level"))))
    empty = F.array().cast("array<struct<note:string,level:string>>")
    return files.withColumn("notes", F.filter(F.array(*found), lambda x: x.isNotNull()) if found else empty)


def nearest_owner(files: DataFrame, owners: DataFrame, dir_: str = "directory") -> DataFrame:
    """Adds ``owner``: the name of the nearest directory of ``owners`` (dir, name) at or above each file's.

    Only the distinct directories are expanded into their ancestors, and joined by equality.
    """
    dirs = files.select(F.col(dir_).alias("d")).distinct()
    above = dirs.select("d", F.posexplode(ancestors("d")).alias("depth", "dir"))
    nearest = above.join(owners.select("dir", "name"), "dir").groupBy("d").agg(F.max_by("name", "depth").alias("owner"))
    return files.join(nearest, files[dir_] == nearest["d"], "left").drop("d")
