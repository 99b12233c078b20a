"""Ignore files: patterns with negation, anchors and directory marks."""

from __future__ import annotations

import re
from pathlib import Path


def compile_pattern(line: str) -> tuple[re.Pattern[str], bool, bool] | None:
    """(pattern on a path below the file's directory, negated, directories only); None for what says nothing."""
    text = line.rstrip("\n").rstrip("\r")
    while text.endswith(" ") and not text.endswith("\\ "):
        text = text[:-1]
    if not text or text.startswith("#"):
        return None
    negated = text.startswith("!")
    text = text[1:] if negated else text
    if text.startswith("\\") and text[1:2] in "#!":
        text = text[1:]
    only_dirs = text.endswith("/")
    text = text.rstrip("/")
    if not text:
        return None
    anchored = "/" in text
    text = text.removeprefix("/")
    out, n = "", 0
    while n < len(text):
        if text.startswith("**/", n) and (n == 0 or text[n - 1] == "/"):
            out += "(?:.*/)?"
            n += 3
        elif text.startswith("/**", n) and n + 3 == len(text):
            out += "/.+"
            n += 3
        elif text[n] == "*":
            while n + 1 < len(text) and text[n + 1] == "*":
                n += 1
            out += "[^/]*"
            n += 1
        elif text[n] == "?":
            out += "[^/]"
            n += 1
        elif text[n] == "[" and "]" in text[n + 2 :]:
            end = text.index("]", n + 2)
            body = text[n + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            n = end + 1
        elif text[n] == "\\" and n + 1 < len(text):
            out += re.escape(text[n + 1])
            n += 2
        else:
            out += re.escape(text[n])
            n += 1
    return re.compile(("" if anchored else "(?:.*/)?") + out + "$"), negated, only_dirs


class Ignore:
    """Rules of the ignore files from the top directory down to one; the last rule that matches holds."""

    NAMES = (".gitignore", ".ignore")

    def __init__(self, rules: tuple = ()) -> None:
        self.rules = rules

    def below(self, directory: Path) -> Ignore:
        """With the rules of ``directory``'s own files."""
        found = list(self.rules)
        for name in self.NAMES:
            try:
                lines = (directory / name).read_text(encoding="utf-8", errors="replace").split("\n")
            except OSError:
                continue
            found += [(directory, *rule) for line in lines if (rule := compile_pattern(line)) is not None]
        return Ignore(tuple(found))

    @classmethod
    def above(cls, root: Path) -> Ignore:
        """The rules that ``root``'s parents and a repository's own exclude file have for it."""
        out = cls()
        for directory in reversed(root.resolve().parents):
            out = out.below(directory)
        exclude = root.resolve() / ".git" / "info" / "exclude"
        if exclude.is_file():
            rules = [compile_pattern(x) for x in exclude.read_text(encoding="utf-8", errors="replace").split("\n")]
            out = cls(out.rules + tuple((root.resolve(), *r) for r in rules if r is not None))
        return out

    def ignores(self, path: Path, is_dir: bool) -> bool:
        for base, pattern, negated, only_dirs in reversed(self.rules):
            if only_dirs and not is_dir:
                continue
            try:
                below = path.relative_to(base).as_posix()
            except ValueError:
                continue
            if pattern.match(below):
                return not negated
        return False
