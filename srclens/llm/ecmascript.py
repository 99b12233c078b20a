"""ECMAScript modules: tokens, and a parser that only says whether the text is one.

``scan(text)`` gives tokens with bracket partners found on the way; ``parses(text)`` follows the module grammar (strict
mode, automatic semicolons, arrow parameters told apart by the token after their closing bracket). Early errors that
depend on names (redeclaration, undefined labels or exports) are no part of it.
"""

from __future__ import annotations

import re

from srclens.functions.deep import deep

# Words that cannot be identifiers in module code.
RESERVED = frozenset(
    "await break case catch class const continue debugger default delete do else enum export extends false finally for "
    "function if import in instanceof new null return super switch this throw true try typeof var void while with yield "
    "let static implements interface package private protected public".split()
)
_VALUE_WORDS = frozenset("this super null true false".split())
_TOKEN = re.compile(
    r"""(?P<ws>[ \t\x0b\x0c ﻿  -   　]*)(?:
      (?P<nl>[\r\n  ]+)
    | (?P<c>//[^\r\n  ]*|/\*.*?\*/)
    | (?P<id>\#?(?:[A-Za-z_$]|[^\x00-\x7f\W\d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$‌‍]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*)
    | (?P<num>(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*|0[oO][0-7](?:_?[0-7])*|0[bB][01](?:_?[01])*|(?:0|[1-9](?:_?[0-9])*))n(?![\w$])
        | 0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*(?![\w$]) | 0[oO][0-7](?:_?[0-7])*(?![\w$]) | 0[bB][01](?:_?[01])*(?![\w$])
        | (?:(?:0|[1-9](?:_?[0-9])*)(?:\.(?:[0-9](?:_?[0-9])*)?)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?(?![\w$]))
    | (?P<s>"(?:[^"\\\r\n]|\\(?:\r\n|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|u\{[0-9a-fA-F]+\}|0(?![0-9])|[^xu0-9]))*"|'(?:[^'\\\r\n]|\\(?:\r\n|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|u\{[0-9a-fA-F]+\}|0(?![0-9])|[^xu0-9]))*')
    | (?P<p>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?![0-9])|\+\+|--|\*\*|<<|>>|\+=|-=|\*=|%=|&=|\|=|\^=|[{}()\[\];,<>+\-*%&|^!~?:=.@])
    | (?P<slash>/)
    | (?P<tick>`)
    | (?P<end>\Z)
    )""",
    re.X | re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\r\n  ]|\\[^\r\n  ]|\[(?:[^\]\\\r\n  ]|\\[^\r\n  ])*\])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(`|\$\{)", re.S)
_PARTNER = {")": "(", "]": "[", "}": "{"}
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
BINARY = frozenset("?? || && | ^ & == != === !== < > <= >= << >> >>> + - * / % ** in instanceof".split())


class Bad(Exception):
    """``at`` is the offset in the text."""

    def __init__(self, at: int = 0) -> None:
        self.at = at


class Tokens:
    """kind: i word, n number, s string, r regular expression, t template piece, p punctuator, e end."""

    __slots__ = ("kind", "match", "nl", "pos", "val", "comments")

    def __init__(self) -> None:
        self.kind: list[str] = []
        self.val: list[str] = []
        self.nl: list[bool] = []
        self.pos: list[int] = []
        self.match: dict[int, int] = {}
        self.comments: dict[int, str] = {}  # token index -> the last comment before it


def scan(text: str) -> Tokens:
    t = Tokens()
    kind, val, nls, pos = t.kind, t.val, t.nl, t.pos
    stack: list[tuple[str, int, bool]] = []
    i, n = 0, len(text)
    if text.startswith("#!"):
        i = re.compile(r"[^\r\n  ]*").match(text).end()
    nl = True
    slash_divides = False
    push = (kind.append, val.append, nls.append, pos.append)

    def add(k: str, v: str, at: int) -> None:
        nonlocal nl
        push[0](k)
        push[1](v)
        push[2](nl)
        push[3](at)
        nl = False

    match = _TOKEN.match
    while True:
        m = match(text, i)
        if m is None:
            raise Bad(i)
        g = m.lastgroup
        i = m.end()
        if g == "nl":
            nl = True
        elif g == "c":
            v = m.group("c")
            if v[1] == "*":
                t.comments[len(kind)] = v
                if "\n" in v or "\r" in v or " " in v or " " in v:
                    nl = True
            elif nl or not kind:
                t.comments[len(kind)] = v
        elif g == "id":
            v = m.group("id")
            add("i", v, m.start("id"))
            slash_divides = v not in RESERVED or v in _VALUE_WORDS or (len(val) > 1 and val[-2] in (".", "?."))
        elif g == "p":
            v = m.group("p")
            k = len(val)
            if v in "([{":
                before = val[k - 1] if k else ""
                block = v == "{" and (before in ("", ";", "{", "}", ")", "=>", "else", "do", "try", "finally", ":"))
                head = v == "(" and before in ("if", "while", "for", "with") and (k < 2 or val[k - 2] != ".")
                stack.append((v, k, block or head))
                slash_divides = False
            elif v in ")]}":
                if v == "}" and stack and stack[-1][0] == "`":
                    _, at, _ = stack.pop()
                    add("p", "}", m.start("p"))
                    t.match[at] = k
                    t.match[k] = at
                    i = _template(text, i, t, stack, add)
                    slash_divides = True
                    continue
                if not stack or stack[-1][0] != _PARTNER[v]:
                    raise Bad(m.start("p"))
                _, at, plain = stack.pop()
                t.match[at] = k
                t.match[k] = at
                slash_divides = not plain
            else:
                slash_divides = v in ("++", "--")
            add("p", v, m.start("p"))
        elif g == "num":
            add("n", m.group("num"), m.start("num"))
            slash_divides = True
        elif g == "s":
            add("s", m.group("s"), m.start("s"))
            slash_divides = True
        elif g == "slash":
            at = m.start("slash")
            if slash_divides:
                if text.startswith("/=", at):
                    i = at + 2
                    add("p", "/=", at)
                else:
                    add("p", "/", at)
                slash_divides = False
            else:
                r = _REGEX.match(text, at)
                if r is None:
                    raise Bad(at)
                i = r.end()
                add("r", r.group(), at)
                slash_divides = True
        elif g == "tick":
            i = _template(text, i, t, stack, add)
            slash_divides = kind[-1] == "t" and val[-1] == "`"
        else:
            break
        if i > n:
            break
    if stack:
        raise Bad(n)
    add("e", "", n)
    return t


def _template(text: str, i: int, t: Tokens, stack: list, add) -> int:
    m = _TEMPLATE.match(text, i)
    if m is None:
        raise Bad(i)
    if m.group(1) == "`":
        add("t", "`", i)
    else:
        add("t", "${", i)
        stack.append(("`", len(t.val) - 1, False))
    return m.end()


class Parser:
    """Follows the module grammar over scanned tokens; ``module()`` returns or raises ``Bad``."""

    def __init__(self, t: Tokens) -> None:
        self.k, self.v, self.nl, self.m, self.pos = t.kind, t.val, t.nl, t.match, t.pos
        self.i = 0
        self.fn = self.gen = False
        self.asyn = True
        self.cover = -1
        self.no_in = False

    def bad(self) -> None:
        raise Bad(self.pos[min(self.i, len(self.pos) - 1)])

    def p(self, v: str) -> bool:
        return self.v[self.i] == v and self.k[self.i] in "pi"

    def eat(self, v: str) -> bool:
        if self.v[self.i] == v and self.k[self.i] in "pi":
            self.i += 1
            return True
        return False

    def need(self, v: str) -> None:
        if not self.eat(v):
            self.bad()

    def semi(self) -> None:
        if self.eat(";") or self.v[self.i] == "}" or self.k[self.i] == "e" or self.nl[self.i]:
            return
        self.bad()

    def name(self, any_word: bool = False) -> str:
        v = self.v[self.i]
        if self.k[self.i] != "i" or v[0] == "#" or (not any_word and v in RESERVED and v != "await") or (not any_word and v == "await"):
            self.bad()
        self.i += 1
        return v

    def module(self) -> None:
        while self.k[self.i] != "e":
            self.statement(True)

    def block(self) -> None:
        self.need("{")
        while not self.p("}"):
            if self.k[self.i] == "e":
                self.bad()
            self.statement()
        self.i += 1

    def statement(self, top: bool = False, single: bool = False) -> None:
        k, v = self.k[self.i], self.v[self.i]
        if k == "p":
            if v == "{":
                return self.block()
            if v == ";":
                self.i += 1
                return None
            if v == "@":
                self.decorators()
                if not (self.p("class") or self.p("export")):
                    self.bad()
                return self.statement(top)
        elif k == "i":
            f = _STATEMENTS.get(v)
            if f is not None:
                if v == "import" and self.v[self.i + 1] in ("(", "."):
                    pass
                elif v in ("import", "export"):
                    if not top:
                        self.bad()
                    return f(self)
                elif single and v in ("class", "const", "function"):
                    self.bad()
                else:
                    return f(self)
            elif v == "async" and self.v[self.i + 1] == "function" and not self.nl[self.i + 1]:
                if single:
                    self.bad()
                self.i += 1
                return self.function(True)
            elif v == "let":
                if single:
                    self.bad()
                return self.variables()
            elif self.v[self.i + 1] == ":" and self.k[self.i + 1] == "p":
                self.name()
                self.i += 1
                return self.statement(False, single)
        self.expression()
        self.semi()
        return None

    def decorators(self) -> None:
        while self.eat("@"):
            if self.p("("):
                self.i = self.m[self.i] + 1
                continue
            self.name()
            while self.eat("."):
                self.name(True)
            if self.p("("):
                self.arguments()

    def variables(self, head: bool = False) -> int:
        """Declarations of var, let or const; in the head of a ``for`` without their end. How many, and if one lacks a value."""
        const = self.v[self.i] == "const"
        self.i += 1
        count = 0
        bare = False
        while True:
            pattern = self.v[self.i] in "[{"
            self.binding()
            count += 1
            if self.eat("="):
                self.assign()
            elif const or pattern:
                bare = True
            if not self.eat(","):
                break
        if head:
            return -count if bare else count
        if bare:
            self.bad()
        self.semi()
        return count

    def binding(self) -> None:
        if self.eat("["):
            while not self.eat("]"):
                if self.eat(","):
                    continue
                rest = self.eat("...")
                self.binding()
                if not rest and self.eat("="):
                    self.assign()
                if not self.p("]"):
                    if rest:
                        self.bad()
                    self.need(",")
            return
        if self.eat("{"):
            while not self.eat("}"):
                if self.eat("..."):
                    self.name()
                    if not self.p("}"):
                        self.bad()
                    continue
                simple = self.k[self.i] == "i" and self.v[self.i] not in RESERVED
                self.key()
                if self.eat(":"):
                    self.binding()
                elif not simple:
                    self.bad()
                if self.eat("="):
                    self.assign()
                if not self.p("}"):
                    self.need(",")
            return
        self.name()

    def key(self) -> None:
        k = self.k[self.i]
        if k in "isn" and k != "e":
            self.i += 1
        elif self.eat("["):
            keep, self.no_in = self.no_in, False
            self.assign()
            self.no_in = keep
            self.need("]")
        else:
            self.bad()

    def params(self) -> None:
        self.need("(")
        while not self.eat(")"):
            rest = self.eat("...")
            self.binding()
            if not rest and self.eat("="):
                self.assign()
            if not self.p(")"):
                if rest:
                    self.bad()
                self.need(",")

    def body(self, asyn: bool, gen: bool, params: bool = True) -> None:
        keep = self.fn, self.asyn, self.gen, self.no_in
        self.fn, self.asyn, self.gen, self.no_in = True, asyn, gen, False
        if params:
            self.params()
        self.block()
        self.fn, self.asyn, self.gen, self.no_in = keep

    def function(self, asyn: bool = False, named: bool = True) -> None:
        self.need("function")
        gen = self.eat("*")
        if self.k[self.i] == "i":
            if self.v[self.i] in RESERVED:
                self.bad()
            self.i += 1
        elif named:
            self.bad()
        self.body(asyn, gen)

    def class_(self, named: bool = True) -> None:
        self.need("class")
        if self.k[self.i] == "i" and self.v[self.i] != "extends":
            self.name()
        elif named:
            self.bad()
        if self.eat("extends"):
            self.unary_postfix()
        self.need("{")
        while not self.eat("}"):
            if self.eat(";"):
                continue
            self.decorators()
            if self.p("static") and self.v[self.i + 1] not in ("(", "=", ";", "}"):
                self.i += 1
                if self.p("{"):
                    self.body(False, False, False)
                    continue
            self.member(True)

    def member(self, cls: bool) -> None:
        """A method, accessor or field of a class; of an object literal, a method or accessor."""
        asyn = gen = False
        after = self.v[self.i + 1]
        if self.p("async") and after not in ("(", "=", ";", "}", ",", ":") and not self.nl[self.i + 1]:
            asyn = True
            self.i += 1
        if self.eat("*"):
            gen = True
        elif not asyn and (self.p("get") or self.p("set") or (cls and self.p("accessor"))) and after not in ("(", "=", ";", "}", ",", ":") and not (cls and self.nl[self.i + 1] and self.p("accessor")):
            self.i += 1
        self.key()
        if self.p("("):
            self.body(asyn, gen)
            return
        if not cls or asyn or gen:
            self.bad()
        if self.eat("="):
            keep, self.fn = self.fn, True
            self.assign()
            self.fn = keep
        self.semi()

    # -- statements that begin with a word
    def s_if(self) -> None:
        self.i += 1
        self.head()
        self.statement(single=True)
        if self.eat("else"):
            self.statement(single=True)

    def head(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def s_while(self) -> None:
        self.i += 1
        self.head()
        self.statement(single=True)

    def s_do(self) -> None:
        self.i += 1
        self.statement(single=True)
        self.need("while")
        self.head()
        self.eat(";")

    def s_for(self) -> None:
        self.i += 1
        wait = self.eat("await")
        self.need("(")
        declared = 0
        if self.p(";"):
            pass
        elif self.v[self.i] in ("var", "let", "const") and self.k[self.i] == "i":
            self.no_in = True
            declared = self.variables(True)
            self.no_in = False
        else:
            self.no_in = True
            what = self.expression()
            self.no_in = False
            if (self.p("of") or self.p("in")) and what not in ("id", "member", "pattern"):
                self.bad()
            if self.p("of") or self.p("in"):
                self.cover = -1
        if self.p("of") or (self.p("in") and not wait):
            if abs(declared) > 1:
                self.bad()
            of = self.v[self.i] == "of"
            self.i += 1
            if of:
                self.assign()
            else:
                self.expression()
            self.need(")")
        else:
            if declared < 0 or wait:
                self.bad()
            self.need(";")
            if not self.p(";"):
                self.expression()
            self.need(";")
            if not self.p(")"):
                self.expression()
            self.need(")")
        self.statement(single=True)

    def s_return(self) -> None:
        if not self.fn:
            self.bad()
        self.i += 1
        if not (self.p(";") or self.p("}") or self.k[self.i] == "e" or self.nl[self.i]):
            self.expression()
        self.semi()

    def s_jump(self) -> None:
        self.i += 1
        if self.k[self.i] == "i" and not self.nl[self.i] and self.v[self.i] not in RESERVED:
            self.i += 1
        self.semi()

    def s_throw(self) -> None:
        self.i += 1
        if self.nl[self.i]:
            self.bad()
        self.expression()
        self.semi()

    def s_try(self) -> None:
        self.i += 1
        self.block()
        done = False
        if self.eat("catch"):
            if self.eat("("):
                self.binding()
                self.need(")")
            self.block()
            done = True
        if self.eat("finally"):
            self.block()
            done = True
        if not done:
            self.bad()

    def s_switch(self) -> None:
        self.i += 1
        self.head()
        self.need("{")
        default = False
        while not self.eat("}"):
            if self.eat("case"):
                self.expression()
            else:
                self.need("default")
                if default:
                    self.bad()
                default = True
            self.need(":")
            while not (self.p("case") or self.p("default") or self.p("}")):
                if self.k[self.i] == "e":
                    self.bad()
                self.statement()

    def s_debugger(self) -> None:
        self.i += 1
        self.semi()

    def s_bad(self) -> None:
        self.bad()

    def module_name(self) -> None:
        if self.k[self.i] not in "is":
            self.bad()
        self.i += 1

    def attributes(self) -> None:
        if self.eat("with"):
            self.need("{")
            while not self.eat("}"):
                self.key()
                self.need(":")
                if self.k[self.i] != "s":
                    self.bad()
                self.i += 1
                if not self.p("}"):
                    self.need(",")

    def source(self) -> None:
        if self.k[self.i] != "s":
            self.bad()
        self.i += 1
        self.attributes()
        self.semi()

    def s_import(self) -> None:
        self.i += 1
        if self.k[self.i] == "s":
            return self.source()
        more = True
        if self.k[self.i] == "i":
            self.name()
            more = self.eat(",")
        if more:
            if self.eat("*"):
                self.need("as")
                self.name()
            else:
                self.need("{")
                while not self.eat("}"):
                    word = self.k[self.i] == "i" and self.v[self.i] not in RESERVED
                    self.module_name()
                    if self.eat("as"):
                        self.name()
                    elif not word:
                        self.bad()
                    if not self.p("}"):
                        self.need(",")
        self.need("from")
        return self.source()

    def s_export(self) -> None:
        self.i += 1
        if self.eat("*"):
            if self.eat("as"):
                self.module_name()
            self.need("from")
            return self.source()
        if self.eat("{"):
            words = True
            while not self.eat("}"):
                words &= self.k[self.i] == "i" and self.v[self.i] not in RESERVED
                self.module_name()
                if self.eat("as"):
                    self.module_name()
                if not self.p("}"):
                    self.need(",")
            if self.eat("from"):
                return self.source()
            if not words:
                self.bad()
            return self.semi()
        if self.eat("default"):
            if self.p("@"):
                self.decorators()
            if self.p("function"):
                return self.function(named=False)
            if self.p("async") and self.v[self.i + 1] == "function" and not self.nl[self.i + 1]:
                self.i += 1
                return self.function(True, False)
            if self.p("class"):
                return self.class_(False)
            self.assign()
            return self.semi()
        if self.v[self.i] in ("var", "let", "const", "function", "class", "async", "@") and self.k[self.i] in "ip":
            if self.v[self.i] == "async" and self.v[self.i + 1] != "function":
                self.bad()
            return self.statement()
        return self.bad()

    # -- expressions; each returns what it can be used as: id, member, pattern or other
    def expression(self) -> str:
        what = self.assign()
        while self.eat(","):
            self.assign()
            what = "other"
        if self.cover >= 0 and not (self.no_in and (self.p("of") or self.p("in"))):
            self.bad()
        return what

    def arrow(self, asyn: bool) -> None:
        """Parameters, ``=>`` and body."""
        if self.nl[self.i]:
            self.bad()
        self.need("=>")
        if self.p("{"):
            self.body(asyn, False, False)
            return
        keep = self.asyn, self.gen, self.fn
        self.asyn, self.gen, self.fn = asyn or (self.asyn and not self.fn), False, True
        self.assign()
        self.asyn, self.gen, self.fn = keep

    def assign(self) -> str:
        i = self.i
        k, v = self.k[i], self.v[i]
        if k == "p" and v == "(" and self.v[self.m[i] + 1] == "=>":
            self.params()
            self.arrow(False)
            return "other"
        if k == "i":
            if v == "async" and not self.nl[i + 1]:
                if self.k[i + 1] == "i" and self.v[i + 2] == "=>":
                    self.i += 1
                    self.name()
                    self.arrow(True)
                    return "other"
                if self.v[i + 1] == "(" and self.k[i + 1] == "p" and self.v[self.m[i + 1] + 1] == "=>":
                    self.i += 1
                    self.params()
                    self.arrow(True)
                    return "other"
            if self.v[i + 1] == "=>" and self.k[i + 1] == "p":
                self.name()
                self.arrow(False)
                return "other"
            if v == "yield" and self.gen:
                self.i += 1
                if self.eat("*"):
                    self.assign()
                elif not (self.nl[self.i] or self.k[self.i] == "e" or self.v[self.i] in (")", "]", "}", ",", ";", ":")):
                    self.assign()
                return "other"
        cover = self.cover
        what = self.binary()
        if self.k[self.i] == "p":
            v = self.v[self.i]
            if v == "?":
                self.i += 1
                keep, self.no_in = self.no_in, False
                self.assign()
                self.no_in = keep
                self.need(":")
                self.assign()
                return "other"
            if v in ASSIGN:
                if what == "other" or (what == "pattern" and v != "="):
                    self.bad()
                if what == "pattern":
                    self.cover = cover
                self.i += 1
                self.assign()
                return "other"
        return what

    def binary(self) -> str:
        what = self.unary()
        k, v = self.k[self.i], self.v[self.i]
        while v in BINARY and k in "pi" and not (v == "in" and self.no_in):
            self.i += 1
            self.unary()
            what = "other"
            k, v = self.k[self.i], self.v[self.i]
        return what

    def unary(self) -> str:
        k, v = self.k[self.i], self.v[self.i]
        if k == "p" and v in ("!", "~", "+", "-", "++", "--") or k == "i" and v in ("typeof", "void", "delete"):
            self.i += 1
            what = self.unary()
            if v in ("++", "--") and what not in ("id", "member"):
                self.bad()
            if self.v[self.i] == "**" and v not in ("++", "--"):
                self.bad()
            return "other"
        if k == "i" and v == "await" and self.asyn:
            self.i += 1
            self.unary()
            return "other"
        if k == "i" and v[0] == "#":
            self.i += 1
            if not self.p("in"):
                self.bad()
            return "other"
        what = self.unary_postfix()
        if self.v[self.i] in ("++", "--") and self.k[self.i] == "p" and not self.nl[self.i]:
            if what not in ("id", "member"):
                self.bad()
            self.i += 1
            return "other"
        return what

    def arguments(self) -> None:
        self.need("(")
        keep, self.no_in = self.no_in, False
        while not self.eat(")"):
            self.eat("...")
            self.assign()
            if not self.p(")"):
                self.need(",")
        self.no_in = keep

    def unary_postfix(self) -> str:
        what = self.primary()
        chain = False
        while True:
            k, v = self.k[self.i], self.v[self.i]
            if k == "p":
                if v == ".":
                    self.i += 1
                    if self.k[self.i] != "i":
                        self.bad()
                    self.i += 1
                    what = "other" if chain else "member"
                    continue
                if v == "?.":
                    chain = True
                    self.i += 1
                    if self.p("("):
                        self.arguments()
                    elif self.eat("["):
                        self.expression()
                        self.need("]")
                    elif self.k[self.i] == "i":
                        self.i += 1
                    else:
                        self.bad()
                    what = "other"
                    continue
                if v == "(":
                    self.arguments()
                    what = "other"
                    continue
                if v == "[":
                    self.i += 1
                    keep, self.no_in = self.no_in, False
                    self.expression()
                    self.no_in = keep
                    self.need("]")
                    what = "other" if chain else "member"
                    continue
            elif k == "t" and what != "pattern" and self.k[self.i - 1] != "t" and not chain:
                self.template()
                what = "other"
                continue
            return what

    def template(self) -> None:
        while True:
            if self.k[self.i] != "t":
                self.bad()
            v = self.v[self.i]
            self.i += 1
            if v == "`":
                return
            keep, self.no_in = self.no_in, False
            self.expression()
            self.no_in = keep
            self.need("}")

    def primary(self) -> str:
        k, v = self.k[self.i], self.v[self.i]
        if k == "i":
            if v in RESERVED:
                if v in ("this", "null", "true", "false"):
                    self.i += 1
                    return "other"
                if v == "function":
                    self.function(named=False)
                    return "other"
                if v == "class":
                    self.class_(False)
                    return "other"
                if v == "new":
                    self.i += 1
                    if self.eat("."):
                        if not self.eat("target"):
                            self.bad()
                        return "other"
                    if self.p("new"):
                        self.primary()
                    else:
                        if self.p("import"):
                            self.bad()
                        self.primary()
                        while True:
                            if self.eat("."):
                                if self.k[self.i] != "i":
                                    self.bad()
                                self.i += 1
                            elif self.eat("["):
                                self.expression()
                                self.need("]")
                            elif self.k[self.i] == "t":
                                self.template()
                            else:
                                break
                    if self.p("("):
                        self.arguments()
                    return "other"
                if v == "super":
                    self.i += 1
                    if not (self.p("(") or self.p(".") or self.p("[")) or not self.fn:
                        self.bad()
                    return "other"
                if v == "import":
                    self.i += 1
                    if self.eat("."):
                        self.need("meta")
                    elif not self.p("("):
                        self.bad()
                    return "other"
                self.bad()
            if v[0] == "#":
                self.bad()
            if v == "async" and self.v[self.i + 1] == "function" and not self.nl[self.i + 1]:
                self.i += 1
                self.function(True, False)
                return "other"
            self.i += 1
            return "id"
        if k in "nsr" and k != "e":
            self.i += 1
            return "other"
        if k == "t":
            self.template()
            return "other"
        if k != "p":
            self.bad()
        if v == "(":
            self.i += 1
            keep, self.no_in = self.no_in, False
            what = self.expression()
            self.no_in = keep
            self.need(")")
            return what if what in ("id", "member") else "other"
        if v == "[":
            self.i += 1
            keep, self.no_in = self.no_in, False
            while not self.eat("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                self.assign()
                if not self.p("]"):
                    self.need(",")
            self.no_in = keep
            return "pattern"
        if v == "{":
            self.i += 1
            keep, self.no_in = self.no_in, False
            while not self.eat("}"):
                self.property()
                if not self.p("}"):
                    self.need(",")
            self.no_in = keep
            return "pattern"
        if v == "@":
            self.decorators()
            self.class_(False)
            return "other"
        self.bad()
        return ""

    def property(self) -> None:
        if self.eat("..."):
            self.assign()
            return
        k, v, n = self.k[self.i], self.v[self.i], self.v[self.i + 1]
        if k == "i" and self.k[self.i + 1] == "p":
            if n in (",", "}"):
                self.name()
                return
            if n == "=":
                self.name()
                self.i += 1
                self.assign()
                self.cover = self.i
                return
        if k in "isn" and n == ":" and self.k[self.i + 1] == "p":
            self.i += 2
            self.assign()
            return
        if k == "p" and v == "[" and self.v[self.m[self.i] + 1] == ":":
            self.key()
            self.need(":")
            self.assign()
            return
        self.member(False)


_STATEMENTS = {
    "if": Parser.s_if, "while": Parser.s_while, "do": Parser.s_do, "for": Parser.s_for, "return": Parser.s_return,
    "break": Parser.s_jump, "continue": Parser.s_jump, "throw": Parser.s_throw, "try": Parser.s_try, "switch": Parser.s_switch,
    "debugger": Parser.s_debugger, "with": Parser.s_bad, "import": Parser.s_import, "export": Parser.s_export,
    "var": Parser.variables, "const": Parser.variables, "function": Parser.function, "class": Parser.class_,
}


def parse(text: str) -> Tokens:
    """Tokens of a text that is a module, nested however deep; raises ``Bad`` with the offset otherwise."""
    t = scan(text.removeprefix("﻿"))
    deep(lambda: Parser(t).module())
    return t


def parses(text: str) -> bool:
    try:
        parse(text)
    except Bad:
        return False
    return True
