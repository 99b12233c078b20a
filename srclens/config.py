"""Configuration: closed sections with defaults, read from TOML."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any

FILE_NAMES = ("srclens.toml", ".srclens.toml")


class ConfigError(ValueError):
    """A configuration file that can't be read, or that has a key no section knows."""


@dataclass
class Project:
    name: str = ""
    description: str = ""


@dataclass
class Scan:
    include: list[str] = field(default_factory=list)
    #: What is not scanned, and what is a test. A list in the file replaces the default.
    exclude: list[str] = field(
        default_factory=lambda: ["target/**", "**/target/**", "vendor/**", "worktrees/**", "node_modules/**", ".git/**", "**/*.lock", "LICENSE*", "**/LICENSE*"]
    )
    test_patterns: list[str] = field(default_factory=lambda: ["**/tests/**", "**/test.rs", "**/tests.rs", "**/*_test.rs", "**/*_tests.rs", "**/benches/**"])
    respect_gitignore: bool = True
    include_hidden: bool = False
    follow_symlinks: bool = False
    max_file_bytes: int = 2_000_000


@dataclass
class Thresholds:
    large_file_lines: int = 400
    huge_file_lines: int = 800
    long_function_lines: int = 60
    high_complexity: int = 15
    large_directory_files: int = 20
    heavy_dependency_crates: int = 20
    min_comment_ratio: float = 0.05
    duplicate_min_tokens: int = 50
    duplicate_min_lines: int = 6
    duplicate_similarity: float = 0.85


@dataclass
class DeadCode:
    enabled: bool = True
    ignore: list[str] = field(default_factory=lambda: ["main"])
    tests_count_as_uses: bool = False


@dataclass
class ExtraRoot:
    path: str = ""
    editable: bool = False


@dataclass
class Clones:
    enabled: bool = True
    read_only: list[str] = field(default_factory=list)
    extra_roots: list[ExtraRoot] = field(default_factory=list)
    fragment_kinds: list[str] = field(default_factory=lambda: "function impl trait closure match_arm if_chain block statements type_shape".split())
    include_tests: bool = True
    max_groups: int = 500


@dataclass
class Dependencies:
    enabled: bool = True
    include_dev: bool = False
    ignore_unused: list[str] = field(default_factory=list)


@dataclass
class Ui:
    start_view: str = "overview"
    hide_tests: bool = False
    table_rows: int = 20
    unicode: bool = True


@dataclass
class Note:
    path: str = ""
    note: str = ""
    level: str = "info"


@dataclass
class Config:
    project: Project = field(default_factory=Project)
    scan: Scan = field(default_factory=Scan)
    thresholds: Thresholds = field(default_factory=Thresholds)
    dead_code: DeadCode = field(default_factory=DeadCode)
    clones: Clones = field(default_factory=Clones)
    dependencies: Dependencies = field(default_factory=Dependencies)
    ui: Ui = field(default_factory=Ui)
    notes: list[Note] = field(default_factory=list)

    def display_name(self, root: str | Path) -> str:
        """The configured name, else that of the root's directory."""
        return self.project.name or Path(root).name or "unnamed project"


_LISTS = {("Config", "notes"): Note, ("Clones", "extra_roots"): ExtraRoot}


def _fill(cls: type, data: Any, at: str) -> Any:
    if not isinstance(data, dict):
        raise ConfigError(f"{at or 'file'}: a table is wanted")
    known = {f.name: f for f in fields(cls)}
    out = cls()
    for key, value in data.items():
        if key not in known:
            raise ConfigError(f"{at}{key}: no such key")
        default = getattr(out, key)
        if is_dataclass(default):
            value = _fill(type(default), value, f"{at}{key}.")
        elif (cls.__name__, key) in _LISTS:
            if not isinstance(value, list):
                raise ConfigError(f"{at}{key}: a list is wanted")
            value = [_fill(_LISTS[cls.__name__, key], x, f"{at}{key}.") for x in value]
        elif isinstance(default, float) and isinstance(value, int) and not isinstance(value, bool):
            value = float(value)
        elif type(value) is not type(default):
            raise ConfigError(f"{at}{key}: {type(default).__name__} is wanted")
        setattr(out, key, value)
    return out


def parse(text: str) -> Config:
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from None
    config = _fill(Config, data, "")
    for note in config.notes:
        if note.level not in ("info", "warning", "critical"):
            raise ConfigError(f"notes.level: {note.level} is no level")
    return config


def from_file(path: str | Path) -> Config:
    try:
        return parse(Path(path).read_text(encoding="utf-8"))
    except OSError as e:
        raise ConfigError(f"{path}: {e.strerror}") from None


def load(root: str | Path) -> Config:
    """The first of the known files in ``root``, else the defaults."""
    for name in FILE_NAMES:
        if (Path(root) / name).is_file():
            return from_file(Path(root) / name)
    return Config()
