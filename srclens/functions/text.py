"""Text expressions and labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def human_bytes(n: int) -> str:
    """Bytes with a unit, one decimal above B."""
    if n < 1024:
        return f"{n} B"
    value = float(n)
    for unit in ("KiB", "MiB", "GiB"):
        value /= 1024
        if value < 1024 or unit == "GiB":
            return f"{value:.1f} {unit}"
    return ""


def truncate_label(text: str, width: int) -> str:
    """Keeps the front."""
    return text if width <= 1 or len(text) <= width else text[: width - 1] + "…"


def truncate_path(text: str, width: int) -> str:
    """Keeps the end."""
    return text if width <= 1 or len(text) <= width else "…" + text[len(text) - width + 1 :]


def plural(n: int) -> str:
    return "" if n == 1 else "s"


def shorten(text: str | Column, width: int = 48) -> Column:
    """One line of at most ``width`` characters."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > width, F.concat(F.left(flat, F.lit(width - 1)), F.lit("…"))).otherwise(flat)


#: What the linear-time dialect refuses, though other engines take it.
_REFUSED = re.compile(r"\(\?(?:[=!]|<[=!])|\\[1-9]")


def matches(column: str | Column, pattern: str) -> Column:
    """Case-insensitive search: a regular expression, or the text itself where it is none; an empty one finds all."""
    col = F.col(column) if isinstance(column, str) else column
    if not pattern:
        return F.lit(True)
    try:
        if _REFUSED.search(pattern):
            raise re.error("not linear")
        re.compile(pattern)
        return col.rlike("(?i)" + pattern)
    except re.error:
        return F.contains(F.lower(col), F.lit(pattern.lower()))
