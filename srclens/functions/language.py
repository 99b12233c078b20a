"""Languages by file name, and their comment syntax."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension -> language, in the languages' rank order.
EXTENSIONS = {
    "rs": "rust", "toml": "toml", "md": "markdown", "markdown": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml",
    "sh": "shell", "bash": "shell", "zsh": "shell", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "typescript", "html": "html", "htm": "html", "css": "css", "scss": "css", "sass": "css",
    "py": "python", "c": "c", "h": "c", "cc": "c", "cpp": "c", "hpp": "c", "cxx": "c", "go": "go", "sql": "sql",
}
RANK = {name: n for n, name in enumerate([*dict.fromkeys(EXTENSIONS.values()), "other"])}
# What begins a line comment, and pairs that enclose a block comment.
LINE = {"//": ("rust", "javascript", "typescript", "c", "go", "css"), "#": ("toml", "yaml", "shell", "python"), "--": ("sql",)}
BLOCK = {
    ("/*", "*/"): ("rust", "javascript", "typescript", "c", "go", "css", "sql"),
    ('"""', '"""'): ("python",),
    ("'''", "'''"): ("python",),
    ("<!--", "-->"): ("html", "markdown"),
}


def line_comments(language: str) -> list[str]:
    return [mark for mark, names in LINE.items() if language in names]


def block_comments(language: str) -> list[tuple[str, str]]:
    return [pair for pair, names in BLOCK.items() if language in names]


def has_comment_syntax(language: str | Column) -> Column:
    col = F.col(language) if isinstance(language, str) else language
    return col.isin(sorted({n for names in [*LINE.values(), *BLOCK.values()] for n in names}))


def language(path: str | Column) -> Column:
    """Language by the part of the file's name after its last dot, in any case; ``other`` for the rest."""
    name = F.substring_index(path, "/", -1)
    ext = F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))
    table = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, ext), F.lit("other"))


def language_rank(name: str | Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in RANK.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.col(name) if isinstance(name, str) else name), F.lit(len(RANK)))


def comment_ratio(comment: str | Column, code: str | Column) -> Column:
    comment, code = (F.col(x) if isinstance(x, str) else x for x in (comment, code))
    return F.when(code == 0, F.lit(0.0)).otherwise(comment / code)
