"""Chunks of source text as maps of lexer states, with summaries of their brackets (problem 2).

A chunk doesn't know whether it begins in code, in a string or in a comment. Its map gives, for each state it may begin in,
the state it ends in, and what is left of its brackets once those that match within it are gone: closing ones, then
opening ones. Two such results are combined into that of both chunks, and combining is associative, so that a text may be
cut at any line and its chunks reduced in any grouping.

A state is a tuple of frames, the innermost last; the empty tuple is code. Frames: ``("s", quote)`` a string, ``("m", quote)``
one that may run over lines, ``("r", quote)`` one without escapes, ``("b", depth)`` a nested block comment, ``("f", quote)`` the text of a formatted string, ``("e", depth)``
an expression in it, ``("p", quote)`` that expression's format. Script files aren't cut, as what a slash means depends on all
brackets before it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import cache, reduce
from typing import NamedTuple

CHUNK = 64_000  # characters of a chunk, up to the end of the line
State = tuple[tuple, ...]
_PARTNER = {")": "(", "]": "[", "}": "{"}
_CODE = {
    "json": re.compile(r'"(?:[^"\\\n]|\\.)*"|(?P<bad>")|\(\)|\[\]|\{\}|(?P<k>[()\[\]{}])'),
    "toml": re.compile(r"""\#[^\n]*|(?P<open>\"{3}|'{3})|"(?:[^"\\\n]|\\[^\n])*"|'[^'\n]*'|(?P<bad>["'])|\(\)|\[\]|\{\}|(?P<k>[()\[\]{}])"""),
    "rs": re.compile(r"""//[^\n]*|(?P<block>/\*)|(?<!\w)[bc]?r(?P<raw>\#*)"|"(?:[^"\\\n]|\\[^\n])*"|(?P<open>")|b?'(?:[^'\\\n]|\\(?:u\{[^}'\n]*\}|x[0-9a-fA-F]{2}|[^\n]))'|\(\)|\[\]|\{\}|(?P<k>[()\[\]{}])"""),
    "py": re.compile(r"""\#[^\n]*|(?<!\w)[bBuUrR]{0,2}(?:"(?!"")(?:[^"\\\n]|\\[^\n])*"|'(?!'')(?:[^'\\\n]|\\[^\n])*')|(?:(?<!\w)(?P<pre>[rRbBuUfF]{1,2}))?(?P<open>\"{3}|'{3}|"|')|\(\)|\[\]|\{\}|(?P<k>[()\[\]{}])|(?P<colon>:)"""),
}
LANGUAGES = tuple(_CODE)
_BLOCK = re.compile(r"/\*|\*/")


class Result(NamedTuple):
    """What a text does from some state on; ``bad`` is the place of what can't be lexed or closed, -1 for none."""

    state: State
    closers: str
    openers: str
    bad: int
    length: int


def combine(a: Result, b: Result) -> Result:
    """The result of two texts, ``b`` having begun in the state that ``a`` ended in."""
    length = a.length + b.length
    if a.bad >= 0:
        return a._replace(length=length)
    bad = a.length + b.bad if b.bad >= 0 else -1
    n = min(len(a.openers), len(b.closers))
    if any(_PARTNER[c] != o for c, o in zip(b.closers[:n], reversed(a.openers))):
        return Result(b.state, "", "", a.length if bad < 0 else min(bad, a.length), length)
    return Result(b.state, a.closers + b.closers[n:], a.openers[: len(a.openers) - n] + b.openers, bad, length)


class StateMap:
    """A chunk's map, filled for the states it is asked for."""

    def __init__(self, run: Callable[[State], Result]) -> None:
        self.run, self.known = run, {}

    def __call__(self, state: State) -> Result:
        if state not in self.known:
            self.known[state] = self.run(state)
        return self.known[state]

    def then(self, other: StateMap) -> StateMap:
        def run(state: State) -> Result:
            first = self(state)
            return first if first.bad >= 0 else combine(first, other(first.state))

        return StateMap(run)


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """The text cut behind the ends of lines."""
    start = 0
    while start < len(text):
        end = text.find("\n", start + size - 1) + 1 or len(text)
        yield text[start:end]
        start = end


def _text_end(text: str, at: int, frame: tuple) -> tuple[int, bool]:
    """Where a string's text ends (behind its quote), and whether it does; -1 where a line ends that mustn't."""
    kind, quote = frame[:2]
    while True:
        m = _closing(kind, quote).search(text, at)
        if m is None:
            return len(text), False
        found = m.group()
        if found == "\n":
            return -1, False
        if found[0] == "\\":
            at = m.end()
            continue
        return m.end(), True


@cache
def _closing(kind: str, quote: str) -> re.Pattern[str]:
    ends = re.escape(quote)
    if kind == "r":
        return re.compile(ends)
    return re.compile(rf"\\.|{ends}" + (r"|\n" if kind == "s" and len(quote) == 1 else ""), re.S)


_FORMATTED = re.compile(r"""\\N\{[^}\n]*\}|\\[^{}]|\{\{|\}\}|[{}\n]|\"{3}|'{3}|"|'""", re.S)


def _opened(language: str, m: re.Match[str]) -> tuple:
    """The frame that begins where code was left."""
    group = m.lastgroup
    if group == "block":
        return "b", 1
    if group == "raw":
        return "r", '"' + m.group("raw")
    quote = m.group("open")
    if language == "rs":
        return "m", quote
    if language == "py":
        return "f" if "f" in (m.group("pre") or "").lower() else "s", quote
    return "r" if quote[0] == "'" else "s", quote


def lex(language: str, text: str, state: State) -> Result:
    """What a chunk does from a state on: one pass over what matters in it."""
    stack = list(state)
    closers: list[str] = []
    openers: list[str] = []
    at, size = 0, len(text)
    done = lambda bad: Result(tuple(stack), "".join(closers), "".join(openers), bad, size)
    while at < size:
        frame = stack[-1] if stack else ("c",)
        kind = frame[0]
        if kind in ("s", "m", "r"):
            end, closed = _text_end(text, at, frame)
            if end < 0:
                return done(at)
            if closed:
                stack.pop()
            at = end
        elif kind == "b":
            m = _BLOCK.search(text, at)
            if m is None:
                break
            depth = frame[1] + (1 if m.group() == "/*" else -1)
            stack.pop()
            if depth:
                stack.append(("b", depth))
            at = m.end()
        elif kind in ("f", "p"):
            m = _FORMATTED.search(text, at)
            if m is None:
                break
            found, quote = m.group(), frame[1]
            at = m.end()
            if kind == "f" and found.startswith(quote[0]) and len(quote) == 1 and len(found) == 3:
                found, at = quote, m.start() + 1
            if found == quote:
                if kind == "p":
                    return done(m.start())
                stack.pop()
            elif found == "{" or (found == "{{" and kind == "p"):
                at = m.start() + 1
                stack.append(("e", 0))
            elif found in ("}", "}}") and kind == "p":
                at = m.start() + 1
                stack.pop()
                stack.pop()
            elif found == "}":
                return done(m.start())
            elif found == "\n" and len(quote) == 1:
                return done(m.start())
        else:
            # until something else than code begins
            for m in _CODE[language].finditer(text, at):
                group = m.lastgroup
                if group is None:
                    continue
                if group == "k":
                    bracket = m.group()
                    if kind == "e":
                        depth = stack[-1][1]
                        if bracket in "([{":
                            stack[-1] = ("e", depth + 1)
                        elif depth:
                            stack[-1] = ("e", depth - 1)
                        elif bracket == "}":
                            stack.pop()
                            break
                        else:
                            return done(m.start())
                    elif bracket in "([{":
                        openers.append(bracket)
                    elif openers:
                        if openers.pop() != _PARTNER[bracket]:
                            return done(m.start())
                    else:
                        closers.append(bracket)
                elif group == "bad":
                    return done(m.start())
                elif group == "colon":
                    if kind == "e" and not stack[-1][1]:
                        stack.append(("p", next(f[1] for f in reversed(stack) if f[0] == "f")))
                        break
                else:
                    stack.append(_opened(language, m))
                    break
            else:
                break
            at = m.end()
    return done(-1)


def reduced(language: str, parts: Iterable[str]) -> Result:
    """The result of a text given as its chunks, from code on."""
    maps = [StateMap(lambda state, part=part: lex(language, part, state)) for part in parts]
    return reduce(StateMap.then, maps)(()) if maps else Result((), "", "", -1, 0)


def open_or_unbalanced(language: str, text: str) -> int:
    """Where a text can't be lexed, or where it ends with something still open; -1 for a text that is closed and balanced."""
    got = reduced(language, chunks(text))
    if got.bad >= 0:
        return got.bad
    return len(text) if got.state or got.closers or got.openers else -1
