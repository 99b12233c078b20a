"""Display names of what is counted and found."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names as they are shown.
LANGUAGES = {
    "rust": "Rust", "toml": "TOML", "markdown": "Markdown", "json": "JSON", "yaml": "YAML", "shell": "Shell", "javascript": "JavaScript", "typescript": "TypeScript",
    "html": "HTML", "css": "CSS", "python": "Python", "c": "C/C++", "go": "Go", "sql": "SQL", "other": "Other",
}
DEFINITIONS = {k: k.replace("_", " ") for k in "function struct enum trait const static type_alias macro module file".split()}
FINDINGS = {
    k: k.replace("_", " ")
    for k in (
        "huge_file large_file underdocumented long_function complex_function deep_nesting allocation_in_loop nested_loop panic_path unfinished_work "
        "large_directory heavy_dependency duplicate_dependency unused_dependency dead_code orphan_file parse_failure duplicate_code"
    ).split()
}
SEVERITIES = {k: k for k in ("critical", "high", "medium", "low")}
CONFIDENCES = {k: k for k in ("high", "medium")}
CLONE_KINDS = {"exact": "exact", "renamed": "renamed", "near_miss": "near miss"}
FRAGMENTS = {k: k.replace("_", " ") for k in "function impl trait closure match_arm if_chain block statements type_shape".split()}
DETECTORS = {"subtree": "equal subtrees", "suffix_array": "repeated runs", "min_hash": "similar shingles", "edit_distance": "small edit distance"}
DEPENDENCY_KINDS = {k: k for k in ("normal", "build", "development")}
NOTE_LEVELS = {k: k for k in ("info", "warning", "critical")}


def label(column: str | Column, table: dict[str, str]) -> Column:
    """A name for display; what isn't in the table is shown with blanks for underscores."""
    col = F.col(column) if isinstance(column, str) else column
    names = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(F.try_element_at(names, col), F.replace(col, F.lit("_"), F.lit(" ")))
