"""Calls of recursive functions over nesting of any depth."""

from __future__ import annotations

import sys
from collections.abc import Callable
from typing import Any

MOST = 1 << 30


def deep(f: Callable[..., Any], *args: Any) -> Any:
    """``f(*args)`` with as much depth of calls as it needs.

    Functions written in Python take no machine stack for calling one another, so the limit may be raised until it is
    enough; ``f`` mustn't take a ``RecursionError`` for a result.
    """
    try:
        return f(*args)
    except RecursionError:
        pass
    before = limit = sys.getrecursionlimit()
    try:
        while True:
            limit = min(limit * 16, MOST)
            sys.setrecursionlimit(limit)
            try:
                return f(*args)
            except RecursionError:
                if limit == MOST:
                    raise
    finally:
        sys.setrecursionlimit(before)
