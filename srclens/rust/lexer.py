"""Rust tokens by one compiled pattern; trivia stays in the token list so that comments keep their place.

``tokens(text)`` returns the tokens as strings (white space dropped, comments kept).
``classes(tokens)`` maps them to one character each, which is what the grammar works on:
``i`` identifier, ``l`` literal, ``s`` string literal, ``L`` lifetime, ``D`` outer and ``d`` inner
documentation, ``X`` what no rule of the language allows; keywords and operators have a character each.
"""

from __future__ import annotations

import re

# The keywords of Rust 2021 (strict and reserved) that the grammar tells apart.
KEYWORDS = (
    "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move "
    "mut pub ref return self Self static struct super trait true type unsafe use where while abstract become box do "
    "final macro override priv try typeof unsized virtual yield _"
).split()
# Operators of more than one character, longest first.
OPERATORS = "... ..= <<= -> => :: .. && || == != <= += -= *= /= %= ^= &= |= <<".split()

K = {word: chr(0x4E00 + n) for n, word in enumerate(KEYWORDS)}
O = {op: chr(0x2200 + n) for n, op in enumerate(OPERATORS)}
ASSIGN = frozenset(O[x] for x in "<<= += -= *= /= %= ^= &= |=".split())

_TOKEN = re.compile(
    r"""\s*(
      //[^\n]*
    | /\*(?:[^*/]|\*(?!/)|/(?!\*))*\*/
    | [bc]?r(\#*)".*?"\2
    | [bc]?"(?:[^"\\]|\\.)*"\w*
    | b?'(?:[^'\\\n\r\t]|\\(?:u\{[^}'\n]*\}|x[0-9a-fA-F]{2}|[nrt\\0'"]))'(?:[^\W\d]\w*)?
    | '(?:r\#)?[^\W\d]\w*
    | 0[xob][0-9a-zA-Z_]+
    | [0-9][0-9_]*(?:\.[0-9][0-9_]*(?:[eE][+-]?[0-9_]+)?|\.(?![.\w])|[eE][+-]?[0-9][0-9_]*)?\w*
    | r\#[^\W\d]\w*
    | [^\W\d]\w*(?:["']|\#(?=[\w"]))?
    | \.\.[.=]? | <<=? | -[>=] | =[>=] | :: | &[&=]? | \|[|=]? | [!<+*/%^]=
    | >(?=[>=])
    | /\*
    | \S
    )""",
    re.X | re.S,
)
_ESCAPE = re.compile(r"""\\(?:[nrt\\0'"]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}|\r?\n)""")
_NUMBER = re.compile(
    r"(?:0x[0-9a-fA-F_]*[0-9a-fA-F][0-9a-fA-F_]*|0o[0-7_]*[0-7][0-7_]*|0b[01_]*[01][01_]*|[0-9][0-9_]*)(?:[iu](?:8|16|32|64|128|size))?"
    r"|[0-9][0-9_]*(?:\.[0-9][0-9_]*)?(?:[eE][+-]?_*[0-9][0-9_]*)?(?:f32|f64)?|[0-9][0-9_]*\."
)
_PREFIXED = re.compile(r"""[^\W\d]\w*["'#]""")
_STRING = re.compile(r'[bc]?"')


def _nested(text: str, at: int) -> int:
    """End of the block comment that begins at ``at``; -1 if it is never closed."""
    depth, pos = 0, at
    for m in re.compile(r"/\*|\*/").finditer(text, at):
        if m.start() < pos:
            continue
        depth += 1 if m.group() == "/*" else -1
        pos = m.end()
        if not depth:
            return pos
    return -1


def tokens(text: str) -> list[str]:
    """All tokens of ``text`` in order, comments among them. A comment that is never closed is the token ``/*``.

    An empty text has no tokens. Never raises; what no rule of the language allows comes out as it stands and has class ``X``.
    """
    if text.startswith("﻿"):
        text = text[1:]
    if text.startswith("#!") and not re.match(r"#!\s*\[", text):
        text = text.partition("\n")[2]
    found = [m[0] for m in _TOKEN.findall(text)]
    if "/*" in found:  # a nested or open block comment: cut there, step over it by depth
        m = next(m for m in _TOKEN.finditer(text) if m.group(1) == "/*")
        head = [x[0] for x in _TOKEN.findall(text[: m.start(1)])]
        end = _nested(text, m.start(1))
        if end < 0:
            return [*head, "/*"]
        return [*head, text[m.start(1) : end], *tokens_after(text[end:])]
    return found


def tokens_after(text: str) -> list[str]:
    """As ``tokens``, for text that doesn't begin a file; nesting is handled in a loop, not by depth of calls."""
    out: list[str] = []
    while True:
        cut = None
        for m in _TOKEN.finditer(text):
            if m.group(1) == "/*":
                cut = m.start(1)
                break
            out.append(m.group(1))
        if cut is None:
            return out
        end = _nested(text, cut)
        if end < 0:
            return [*out, "/*"]
        out.append(text[cut:end])
        text = text[end:]


def _class(tok: str) -> str:
    first = tok[0]
    if tok.startswith("//"):
        return "d" if tok.startswith("//!") else "D" if tok.startswith("///") and not tok.startswith("////") else ""
    if tok.startswith("/*"):
        if tok == "/*":
            return "X"
        if tok.startswith("/*!"):
            return "d"
        return "D" if tok.startswith("/**") and not tok.startswith("/***") and len(tok) > 4 else ""
    if tok in K:
        return "l" if tok in ("true", "false") else K[tok]
    if tok in O:
        return O[tok]
    if first == ">" :
        return ">"
    if _STRING.match(tok):
        body = tok[tok.index('"') + 1 :]
        if not body.endswith('"') or ("\\" in body and "\\" in _ESCAPE.sub("", body)):
            return "X"
        return "s"
    if re.match(r'[bc]?r#*"', tok):
        return "s"
    if first == "'" or tok.startswith("b'"):
        if tok.endswith("'") and len(tok) > 2:
            return "l"
        return "L" if first == "'" else "X"
    if first.isdigit():
        return "l" if _NUMBER.fullmatch(tok) else "X"
    if tok.startswith("r#"):
        return "i"
    if _PREFIXED.fullmatch(tok):
        return "X"
    if first == "_" or first.isalpha() or first.isidentifier():
        return "i"
    return tok if tok in "()[]{}<>=+-*/%^!&|.,;:#$?@~" else "X"


class _Memo(dict):
    """Class of a token; bounded, so that a worker's memory doesn't grow with the corpus."""

    def __missing__(self, tok: str) -> str:
        if len(self) > 200_000:
            self.clear()
        out = self[tok] = _class(tok)
        return out


_MEMO = _Memo()


def classes(toks: list[str]) -> str:
    """One character a token; plain comments have none. ``>`` that is joined to the next ``>`` or ``=`` is not told
    apart from one that stands alone."""
    return "".join(map(_MEMO.__getitem__, toks))
