"""Local grammars of Rust 2021: every bracketed group is parsed by itself.

A file is a string of token classes (``lexer.classes``). Brackets are matched with one stack; as a group closes,
its content, in which inner groups are already single characters, is parsed for each *role* it could play (block,
match arms, fields, parameters, ...), and the group becomes one character that stands for the set of roles it can
fill. A group is therefore a short string whatever it holds, and parsing it is a pure function of that string, so
that results are remembered: source code repeats its shapes far more than its names.

``parses(classes)`` is the entry. It accepts what the language's parser accepts; names, types and meaning play no part.
"""

from __future__ import annotations

import re

from srclens.rust.lexer import ASSIGN, K, O

BRACE = "block arms fields_expr fields_pat fields enum_variants items impl_items trait_items extern_items use_tree".split()
PAREN = "exprs expr params types pats tuple_fields vis fn_types".split()
BRACKET = "exprs expr type_array pats attr".split()
_ROLES = {"{": BRACE, "(": PAREN, "[": BRACKET}
_BASE = {"{": 0xE000, "(": 0xF000, "[": 0xF500}
_TOP = {"{": 0xF000, "(": 0xF500, "[": 0xF900}

ARROW, FAT, PATH2, DOT2, DOT3, DOTEQ = O["->"], O["=>"], O["::"], O[".."], O["..."], O["..="]
ANDAND, OROR, SHL, LE = O["&&"], O["||"], O["<<"], O["<="]
COMPARE = frozenset([O["=="], O["!="], LE, "<", ">"])
IDENT = frozenset(["i"])
PATH_WORDS = frozenset(["i", K["self"], K["Self"], K["super"], K["crate"]])
GROUP = re.compile(r"[()\[\]{}]")
#: After a brace group, what can only begin the next statement, item or arm.
_STARTERS = "".join(
    K[x]
    for x in "const enum extern fn for if impl let loop match mod move pub return static struct trait type unsafe use while break continue async".split()
)
_CUT = re.compile(r"(?<=;)(?!$)|(?<=[-])(?=[iLD#" + _STARTERS + "])")
_ARM_CUT = re.compile("(?<=" + FAT + r"[-]),?(?=[^,.?])")


class Fail(Exception):
    pass


class _Group:
    """The characters that stand for groups, and what they can be."""

    def __init__(self) -> None:
        self.of: dict[tuple[str, int], str] = {}
        self.mask: dict[str, int] = {}
        self.memo: dict[tuple[str, str], str] = {}

    def char(self, kind: str, mask: int) -> str:
        key = (kind, mask)
        if key not in self.of:
            c = chr(_BASE[kind] + sum(k == kind for k, _ in self.of))
            if ord(c) >= _TOP[kind]:
                raise OverflowError("more sets of roles than there are")
            self.of[key], self.mask[c] = c, mask
        return self.of[key]

    def close(self, kind: str, content: str) -> str:
        key = (kind, content)
        c = self.memo.get(key)
        if c is None:
            mask = 0
            for n, role in enumerate(_ROLES[kind]):
                if accepts(role, content):
                    mask |= 1 << n
            c = self.char(kind, mask)
            if len(self.memo) > 150_000:
                self.memo.clear()
            self.memo[key] = c
        return c


G = _Group()
_BIT = {(k, r): 1 << n for k, rs in _ROLES.items() for n, r in enumerate(rs)}
_pieces: dict[str, int] = {}


def can(c: str, kind: str, role: str) -> bool:
    return _BASE[kind] <= ord(c) < _TOP[kind] and bool(G.mask[c] & _BIT[kind, role])


def kind_of(c: str) -> str:
    n = ord(c)
    return "{" if 0xE000 <= n < 0xF000 else "(" if 0xF000 <= n < 0xF500 else "[" if 0xF500 <= n < 0xF900 else ""


def accepts(role: str, content: str) -> bool:
    try:
        if role == "block":
            return block(content)
        if role == "arms":
            return arms(content)
        if role in ("items", "impl_items", "trait_items", "extern_items"):
            return items(content, role)
        p = Parser(content)
        getattr(p, "g_" + role)()
        return p.i == p.n
    except Fail:
        return False


def _remembered(key: str, f) -> int:
    v = _pieces.get(key)
    if v is None:
        if len(_pieces) > 300_000:
            _pieces.clear()
        try:
            v = f()
        except Fail:
            v = 0
        _pieces[key] = v
    return v


def block(content: str) -> bool:
    m = re.match("d+", content)
    parts = _CUT.split(content[m.end() :] if m else content)
    for n, part in enumerate(parts):
        v = _remembered("b" + part, lambda part=part: Parser(part).statements())
        if not v or (v == 2 and n < len(parts) - 1):
            return False
    return True


def arms(content: str) -> bool:
    m = re.match("d+", content)
    parts = _ARM_CUT.split(content[m.end() :] if m else content)
    return all(_remembered("a" + p, lambda p=p: Parser(p).match_arms()) for p in parts)


def items(content: str, role: str) -> bool:
    m = re.match("d+", content)
    tag = {"items": "m", "impl_items": "p", "trait_items": "t", "extern_items": "x"}[role]
    for part in _CUT.split(content[m.end() :] if m else content):
        if not _remembered(tag + part, lambda part=part: Parser(part).item_list(role)):
            return False
    return True


def balance(s: str) -> tuple[str, int]:
    """The file's classes with every group closed to one character, and the index of the class where brackets first fail
    to match (-1: nowhere)."""
    pairs = {")": "(", "]": "[", "}": "{"}
    stack: list[tuple[str, list[str]]] = []
    out: list[str] = []
    last = 0
    for m in GROUP.finditer(s):
        at, c = m.start(), m.group()
        if at > last:
            out.append(s[last:at])
        last = at + 1
        if c in "([{":
            stack.append((c, out))
            out = []
        else:
            if not stack or stack[-1][0] != pairs[c]:
                return "", at
            kind, before = stack.pop()
            before.append(G.close(kind, "".join(out)))
            out = before
    if stack:
        return "", len(s)
    out.append(s[last:])
    return "".join(out), -1


def parses(s: str) -> bool:
    if "X" in s:
        return False
    flat, bad = balance(s)
    return bad < 0 and items(flat, "items")


class Parser:
    def __init__(self, s: str) -> None:
        self.s = s + "\0"
        self.n = len(s)
        self.i = 0
        self.angles: dict[tuple[int, int], int] = {}

    # -- helpers
    def eat(self, c: str) -> bool:
        if self.s[self.i] == c:
            self.i += 1
            return True
        return False

    def need(self, c: str) -> None:
        if self.s[self.i] != c:
            raise Fail
        self.i += 1

    def group(self, kind: str, role: str) -> bool:
        if can(self.s[self.i], kind, role):
            self.i += 1
            return True
        return False

    def need_group(self, kind: str, role: str) -> None:
        if not self.group(kind, role):
            raise Fail

    def any_group(self) -> str:
        kind = kind_of(self.s[self.i])
        if not kind:
            raise Fail
        self.i += 1
        return kind

    def attrs(self, inner: bool = False) -> bool:
        start = self.i
        while True:
            c = self.s[self.i]
            if c == "D" or (inner and c == "d"):
                self.i += 1
            elif c == "#":
                self.i += 1
                if inner:
                    self.eat("!")
                self.need_group("[", "attr")
            else:
                return self.i > start

    def comma_list(self, one, end: str = "\0") -> None:
        while self.s[self.i] != end:
            one()
            if not self.eat(","):
                break
        if end == "\0" and self.i != self.n:
            raise Fail

    # -- groups by role
    def g_exprs(self) -> None:
        if self.i == self.n:
            return
        self.attrs()
        self.expr()
        if self.eat(";"):
            self.expr()
            return
        if self.eat(","):
            self.comma_list(lambda: (self.attrs(), self.expr()))

    def g_expr(self) -> None:
        self.attrs(True)
        self.expr()

    def g_params(self) -> None:
        self.comma_list(self.param)

    def param(self) -> None:
        self.attrs()
        if self.eat(DOT3):
            return
        at = self.i
        c = self.s[self.i]
        if c == "&" or c == ANDAND:
            self.i += 1
            self.eat("L")
        self.eat(K["mut"])
        if self.s[self.i] == K["self"] and self.s[self.i + 1] != PATH2:
            self.i += 1
            if self.eat(":"):
                self.type()
            return
        self.i = at
        self.pattern()
        self.need(":")
        if self.eat(DOT3):
            return
        self.type()

    def g_types(self) -> None:
        self.comma_list(lambda: (self.attrs(), self.type()))

    def g_fn_types(self) -> None:
        def one() -> None:
            self.attrs()
            if self.eat(DOT3):
                return
            if self.s[self.i] in ("i", K["_"]) and self.s[self.i + 1] == ":":
                self.i += 2
            self.type()

        self.comma_list(one)

    def g_pats(self) -> None:
        self.comma_list(lambda: (self.attrs(), self.pattern()))

    def g_tuple_fields(self) -> None:
        self.comma_list(lambda: (self.attrs(), self.vis(), self.type()))

    def g_vis(self) -> None:
        if self.eat(K["in"]):
            self.simple_path()
        elif self.s[self.i] in (K["crate"], K["self"], K["super"]):
            self.i += 1
        else:
            raise Fail

    def g_type_array(self) -> None:
        self.type()
        if self.eat(";"):
            self.expr()

    def g_attr(self) -> None:
        if self.eat(K["unsafe"]):
            self.any_group()
            return
        self.simple_path()
        if self.eat("="):
            self.expr()
        elif kind_of(self.s[self.i]):
            self.i += 1

    def g_fields(self) -> None:
        def one() -> None:
            self.attrs()
            self.vis()
            self.need("i")
            self.need(":")
            self.type()

        self.comma_list(one)

    def g_enum_variants(self) -> None:
        def one() -> None:
            self.attrs()
            self.vis()
            self.need("i")
            if not self.group("(", "tuple_fields"):
                self.group("{", "fields")
            if self.eat("="):
                self.expr()

        self.comma_list(one)

    def g_fields_expr(self) -> None:
        while self.i < self.n:
            self.attrs()
            if self.eat(DOT2):
                if self.i < self.n:
                    self.expr()
                return
            if self.s[self.i] not in ("i", "l"):
                raise Fail
            named = self.s[self.i] == "i"
            self.i += 1
            if self.eat(":"):
                self.expr()
            elif not named:
                raise Fail
            if not self.eat(","):
                return

    def g_fields_pat(self) -> None:
        while self.i < self.n:
            self.attrs()
            if self.eat(DOT2):
                return
            if self.s[self.i] in ("i", "l") and self.s[self.i + 1] == ":":
                self.i += 2
                self.pattern()
            else:
                self.eat(K["ref"])
                self.eat(K["mut"])
                self.need("i")
            if not self.eat(","):
                return

    def g_use_tree(self) -> None:
        self.comma_list(self.use_tree)

    # -- paths, types, patterns
    def simple_path(self) -> None:
        self.eat(PATH2)
        if self.s[self.i] not in PATH_WORDS:
            raise Fail
        self.i += 1
        while self.s[self.i] == PATH2 and self.s[self.i + 1] in PATH_WORDS:
            self.i += 2

    def use_tree(self) -> None:
        self.eat(PATH2)
        while True:
            c = self.s[self.i]
            if c == "*":
                self.i += 1
                return
            if self.group("{", "use_tree"):
                return
            if c not in PATH_WORDS:
                raise Fail
            self.i += 1
            if not self.eat(PATH2):
                break
        if self.eat(K["as"]) and self.s[self.i] in ("i", K["_"]):
            self.i += 1

    def angle(self) -> None:
        """Generic arguments, after their ``<``; what begins at a place is read once, as nested arguments are tried twice."""
        key = (self.i, self.n)
        end = self.angles.get(key)
        if end is None:
            try:
                self.arguments()
                end = self.i
            except Fail:
                end = -1
            # ``<<`` and ``>>`` that were told apart meanwhile have moved what follows
            self.angles[key] = self.angles[key[0], self.n] = end
        if end < 0:
            raise Fail
        self.i = end

    def arguments(self) -> None:
        while self.s[self.i] != ">":
            c = self.s[self.i]
            if c == "L":
                self.i += 1
            elif c in ("l", "s"):
                self.i += 1
            elif c == "-":
                self.i += 1
                self.need("l")
            elif can(c, "{", "block"):
                self.i += 1
            else:
                at = self.i
                named = False
                if c == "i":
                    self.i += 1
                    if self.eat("<"):
                        try:
                            self.angle()
                        except Fail:
                            self.i = at
                    if self.eat("="):
                        named = True
                        if self.s[self.i] in ("l", "s") or can(self.s[self.i], "{", "block"):
                            self.i += 1
                        else:
                            self.type()
                    elif self.eat(":"):
                        named = True
                        self.bounds()
                if not named:
                    self.i = at
                    self.type()
            if not self.eat(","):
                break
        self.need(">")

    def open_angle(self) -> bool:
        """``<`` of generic arguments; ``<<`` is that of the arguments and that of a qualified path in them."""
        c = self.s[self.i]
        if c == "<":
            self.i += 1
            return True
        if c == SHL:
            self.s = self.s[: self.i] + "<<" + self.s[self.i + 1 :]
            self.n += 1
            self.i += 1
            return True
        return False

    def qualified(self) -> None:
        """The rest of ``<T as Trait>::`` after its ``<``."""
        self.type()
        if self.eat(K["as"]):
            self.path(True)
        self.need(">")
        self.need(PATH2)

    def path(self, in_type: bool) -> None:
        if self.open_angle():
            self.qualified()
        else:
            self.eat(PATH2)
        while True:
            if self.s[self.i] not in PATH_WORDS:
                raise Fail
            self.i += 1
            if in_type:
                at = self.i
                self.eat(PATH2)
                if self.open_angle():
                    self.angle()
                elif can(self.s[self.i], "(", "fn_types") and (self.i == at or True):
                    self.i += 1
                    if self.eat(ARROW):
                        self.type(False)
                else:
                    self.i = at
                if not self.eat(PATH2):
                    return
            elif self.s[self.i] == PATH2:
                self.i += 1
                if self.open_angle():
                    self.angle()
                    if not self.eat(PATH2):
                        return
            else:
                return

    def bound(self) -> None:
        if self.eat("L"):
            return
        at = self.s[self.i]
        if can(at, "(", "types"):
            self.i += 1
            return
        self.eat("?")
        self.eat("~") and self.eat(K["const"])
        if self.eat(K["for"]):
            self.generics(True)
        self.path(True)

    def bounds(self) -> None:
        while self.s[self.i] in PATH_WORDS or self.s[self.i] in ("L", "?", "~", PATH2, "<", SHL, K["for"]) or can(self.s[self.i], "(", "types"):
            self.bound()
            if not self.eat("+"):
                return

    def type(self, plus: bool = True) -> None:
        s = self.s
        c = s[self.i]
        if kind_of(c) == "(":
            self.need_group("(", "types")
            return
        if kind_of(c) == "[":
            self.need_group("[", "type_array")
            return
        if c in ("&", ANDAND):
            self.i += 1
            self.eat("L")
            self.eat(K["mut"])
            self.type(False)
            return
        if c == "*":
            self.i += 1
            if not (self.eat(K["const"]) or self.eat(K["mut"])):
                raise Fail
            self.type(False)
            return
        if c in ("!", K["_"]):
            self.i += 1
            return
        if c in (K["impl"], K["dyn"]):
            self.i += 1
            at = self.i
            if plus:
                self.bounds()
            else:
                self.bound()
            if self.i == at:
                raise Fail
            return
        if c == K["for"]:
            self.i += 1
            self.generics(True)
            c = self.s[self.i]
        if c in (K["fn"], K["unsafe"], K["extern"]):
            self.eat(K["unsafe"])
            if self.eat(K["extern"]):
                self.eat("s")
            self.need(K["fn"])
            self.need_group("(", "fn_types")
            if self.eat(ARROW):
                self.type(False)
            return
        if c == "L":
            self.bounds()
            return
        self.path(True)
        if self.s[self.i] == "!" and kind_of(self.s[self.i + 1]):
            self.i += 2
            return
        if plus:
            while self.eat("+"):
                self.bound()

    def pattern(self) -> None:
        self.eat("|")
        self.pattern_one()
        while self.eat("|"):
            self.pattern_one()

    def pattern_bound(self) -> bool:
        """A literal or path that can end a range."""
        c = self.s[self.i]
        if c == "-":
            self.i += 1
            self.need("l")
            return True
        if c in ("l", "s"):
            self.i += 1
            return True
        if c in PATH_WORDS or c in (PATH2, "<", SHL):
            self.path(False)
            return True
        if c == K["const"]:
            self.i += 1
            self.need_group("{", "block")
            return True
        return False

    def pattern_one(self) -> None:
        c = self.s[self.i]
        if c in ("&", ANDAND):
            self.i += 1
            self.eat(K["mut"])
            self.pattern_one()
            return
        if kind_of(c) == "(":
            self.need_group("(", "pats")
            return
        if kind_of(c) == "[":
            self.need_group("[", "pats")
            return
        if c == K["_"]:
            self.i += 1
            return
        if c == K["box"]:
            self.i += 1
            self.pattern_one()
            return
        if c in (DOT2, DOTEQ):
            self.i += 1
            if not self.pattern_bound() and c == DOTEQ:
                raise Fail
            return
        if c in (K["ref"], K["mut"]):
            self.eat(K["ref"])
            self.eat(K["mut"])
            self.need("i")
            if self.eat("@"):
                self.pattern_one()
            return
        if c == "i" and self.s[self.i + 1] == "@":
            self.i += 2
            self.pattern_one()
            return
        if not self.pattern_bound():
            raise Fail
        n = self.s[self.i]
        if n == "!" and kind_of(self.s[self.i + 1]):
            self.i += 2
        elif kind_of(n) == "(":
            self.need_group("(", "pats")
        elif kind_of(n) == "{" and can(n, "{", "fields_pat") and c != "l":
            self.i += 1
        elif n in (DOT2, DOTEQ, DOT3):
            self.i += 1
            if not self.pattern_bound() and n != DOT2:
                raise Fail

    # -- expressions
    def expr(self, struct: bool = True, cond: bool = False, stmt: bool = False) -> None:
        compared = False
        first = True
        while True:
            if self.operand(struct, cond, stmt and first):
                return
            first = False
            c = self.s[self.i]
            if c in (DOT2, DOTEQ):
                self.i += 1
                compared = False
                if not self.starts(struct):
                    if c == DOTEQ:
                        raise Fail
                    return
                continue
            if c == "=" or c in ASSIGN:
                self.i += 1
                compared = False
                continue
            if c in COMPARE:
                if c == ">":
                    nxt = self.s[self.i + 1]
                    if nxt == ">":
                        self.i += 2
                        self.eat("=")
                        continue
                    self.i += 1
                    self.eat("=")
                else:
                    self.i += 1
                if compared:
                    raise Fail
                compared = True
                continue
            if c in (ANDAND, OROR):
                self.i += 1
                compared = False
                continue
            if c in "+-*/%^&|" or c == SHL:
                self.i += 1
                continue
            return

    def starts(self, struct: bool) -> bool:
        c = self.s[self.i]
        if kind_of(c) == "{":
            return struct and can(c, "{", "block")
        return c in "ilsL-*!&|<#" and c != "\0" or bool(kind_of(c)) or c in PATH_WORDS or c in (ANDAND, OROR, PATH2, SHL) or c in _EXPR_WORDS

    def operand(self, struct: bool, cond: bool, stmt: bool) -> bool:
        """One operand with its prefixes and suffixes. True if nothing can follow it (a jump or closure without more)."""
        while True:
            c = self.s[self.i]
            if c in ("-", "*", "!"):
                self.i += 1
            elif c in ("&", ANDAND):
                self.i += 1
                if self.s[self.i] == "i" and self.s[self.i + 1] in (K["const"], K["mut"]):
                    self.i += 2
                else:
                    self.eat(K["mut"])
            elif c in (DOT2, DOTEQ):
                self.i += 1
                if not self.starts(struct):
                    if c == DOTEQ:
                        raise Fail
                    return True
            elif c == "#":
                self.attrs()
            else:
                break
        if c == K["let"] and cond:
            self.i += 1
            self.pattern()
            self.need("=")
            return self.operand(False, True, False)
        if c in (K["return"], K["break"]):
            self.i += 1
            if c == K["break"]:
                self.eat("L")
            if self.starts(struct):
                self.expr(struct)
            return True
        if c == K["continue"]:
            self.i += 1
            self.eat("L")
            return True
        if c in (K["move"], K["static"], "|", OROR) or (c == K["async"] and self.s[self.i + 1] in (K["move"], "|", OROR)):
            at = self.i
            self.eat(K["static"])
            self.eat(K["async"])
            self.eat(K["move"])
            if kind_of(self.s[self.i]) == "{" and c == K["async"]:
                self.i = at
            else:
                self.closure(struct)
                return True
        self.primary(struct)
        self.postfix()
        while self.eat(K["as"]):
            self.type(False)
        return False

    def closure(self, struct: bool) -> None:
        if not self.eat(OROR):
            self.need("|")
            while self.s[self.i] != "|":
                self.attrs()
                self.pattern_one()
                if self.eat(":"):
                    self.type()
                if not self.eat(","):
                    break
            self.need("|")
        if self.eat(ARROW):
            self.type(False)
            self.need_group("{", "block")
            return
        self.expr(struct)

    def postfix(self) -> None:
        while True:
            c = self.s[self.i]
            if c == "?":
                self.i += 1
            elif c == ".":
                self.i += 1
                if self.eat(K["await"]) or self.eat("l"):
                    continue
                self.need("i")
                if self.eat(PATH2):
                    if not self.open_angle():
                        raise Fail
                    self.angle()
                    self.need_group("(", "exprs")
            elif kind_of(c) == "(":
                self.need_group("(", "exprs")
            elif kind_of(c) == "[":
                self.need_group("[", "expr")
            else:
                return

    def primary(self, struct: bool) -> None:
        c = self.s[self.i]
        if c in ("l", "s", K["_"]):
            self.i += 1
            return
        if c in PATH_WORDS or c in (PATH2, "<", SHL):
            self.path(False)
            n = self.s[self.i]
            if n == "!" and kind_of(self.s[self.i + 1]):
                self.i += 2
            elif struct and kind_of(n) == "{" and can(n, "{", "fields_expr"):
                self.i += 1
            return
        kind = kind_of(c)
        if kind == "(":
            self.need_group("(", "exprs")
            return
        if kind == "[":
            self.need_group("[", "exprs")
            return
        if not self.blocklike():
            raise Fail

    def blocklike(self) -> bool:
        """An expression that ends in a brace group and needs no semicolon as a statement."""
        c = self.s[self.i]
        if kind_of(c) == "{":
            self.need_group("{", "block")
            return True
        if c == "L" and self.s[self.i + 1] == ":":
            self.i += 2
            c = self.s[self.i]
            if c not in (K["loop"], K["while"], K["for"]) and not can(c, "{", "block"):
                raise Fail
            return self.blocklike()
        if c in (K["unsafe"], K["const"], K["try"]):
            self.i += 1
            self.need_group("{", "block")
            return True
        if c == K["async"]:
            self.i += 1
            self.eat(K["move"])
            self.need_group("{", "block")
            return True
        if c == K["if"]:
            while True:
                self.need(K["if"])
                self.expr(False, True)
                self.need_group("{", "block")
                if not self.eat(K["else"]):
                    return True
                if self.s[self.i] != K["if"]:
                    self.need_group("{", "block")
                    return True
        if c == K["while"]:
            self.i += 1
            self.expr(False, True)
            self.need_group("{", "block")
            return True
        if c == K["loop"]:
            self.i += 1
            self.need_group("{", "block")
            return True
        if c == K["for"]:
            self.i += 1
            self.pattern()
            self.need(K["in"])
            self.expr(False)
            self.need_group("{", "block")
            return True
        if c == K["match"]:
            self.i += 1
            self.expr(False)
            self.need_group("{", "arms")
            return True
        return False

    def match_arms(self) -> int:
        while self.i < self.n:
            self.attrs()
            self.pattern()
            if self.eat(K["if"]):
                self.expr(True, True)
            self.need(FAT)
            at = self.i
            if self.group("{", "block") and self.s[self.i] not in ".?":
                nxt = self.s[self.i]
                if nxt in "+-*/%^&|<>=" or nxt == K["as"]:
                    self.i = at
                else:
                    self.eat(",")
                    continue
            self.i = at
            c = self.s[self.i]
            self.expr()
            if not self.eat(",") and self.i < self.n and c not in _BLOCK_WORDS and kind_of(self.s[self.i - 1]) != "{":
                raise Fail
        return 1

    # -- statements
    def statements(self) -> int:
        """0: no; 1: whole statements; 2: the last is an expression that gives the block its value."""
        while self.i < self.n:
            if self.eat(";"):
                continue
            had = self.attrs(True)
            c = self.s[self.i]
            if c == "\0":
                if had and not (self.s[self.i - 1] == "d"):
                    raise Fail
                return 1
            if c == K["let"]:
                self.i += 1
                self.pattern()
                if self.eat(":"):
                    self.type()
                if self.eat("="):
                    self.expr()
                    if self.eat(K["else"]):
                        self.need_group("{", "block")
                self.need(";")
                continue
            if self.is_item():
                self.item("items")
                continue
            at = self.i
            if c in _BLOCK_WORDS or kind_of(c) == "{" or (c == "L" and self.s[self.i + 1] == ":"):
                if c in (K["const"], K["async"], K["unsafe"]) and kind_of(self.s[self.i + 1]) != "{" and c != K["async"]:
                    raise Fail
                try:
                    self.blocklike()
                    done = True
                except Fail:
                    if c != K["async"]:
                        raise
                    self.i, done = at, False
                if done:
                    n = self.s[self.i]
                    if n in ".?":
                        self.i = at
                        self.expr(stmt=True)
                        if self.i < self.n and not self.eat(";"):
                            raise Fail
                        if self.i == self.n and self.s[self.i - 1] != ";":
                            return 2
                    continue
            if c in PATH_WORDS or c == PATH2:
                self.simple_path_macro = False
                self.path(False)
                if self.s[self.i] == "!" and kind_of(self.s[self.i + 1]) == "{":
                    self.i += 2
                    if self.s[self.i] not in ".?":
                        continue
                elif self.s[self.i] == "!" and self.s[self.i + 1] == "i" and kind_of(self.s[self.i + 2]):
                    self.i += 3
                    if kind_of(self.s[self.i - 1]) != "{":
                        self.need(";")
                    continue
                self.i = at
            self.expr(stmt=True)
            if self.eat(";"):
                continue
            if self.i == self.n:
                return 2
            raise Fail
        return 1

    def is_item(self) -> bool:
        c, n = self.s[self.i], self.s[self.i + 1]
        if c in _ITEM_WORDS:
            return True
        if c == K["const"]:
            return n in ("i", K["_"], K["fn"], K["unsafe"], K["async"], K["extern"], K["mut"])
        if c == K["unsafe"]:
            return kind_of(n) != "{"
        if c == K["async"]:
            return n in (K["fn"], K["unsafe"])
        if c == K["extern"]:
            return True
        if c == K["static"]:
            return n in ("i", K["mut"], K["_"])
        if c == "i" and n == "i":  # union, auto
            return True
        return False

    # -- items
    def item_list(self, role: str) -> int:
        while self.i < self.n:
            if role == "items" and self.eat(";"):
                continue
            had = self.attrs(True)
            if self.i == self.n:
                if had and self.s[self.i - 1] != "d" and not (self.n > 2 and self.s[self.i - 2] == "!"):
                    raise Fail
                return 1
            self.item(role)
        return 1

    def vis(self) -> bool:
        if self.eat(K["pub"]):
            if can(self.s[self.i], "(", "vis"):
                self.i += 1
            return True
        return self.eat(K["crate"]) if self.s[self.i] == K["crate"] and self.s[self.i + 1] != PATH2 else False

    def generics(self, needed: bool = False) -> None:
        if not self.eat("<"):
            if needed:
                raise Fail
            return
        while self.s[self.i] != ">":
            self.attrs()
            if self.eat("L"):
                if self.eat(":"):
                    while self.eat("L") and self.eat("+"):
                        pass
            elif self.eat(K["const"]):
                self.need("i")
                self.need(":")
                self.type()
                if self.eat("="):
                    if not self.group("{", "block"):
                        self.eat("-")
                        if self.s[self.i] not in ("l", "s", "i"):
                            raise Fail
                        self.i += 1
            else:
                self.need("i")
                if self.eat(":"):
                    self.bounds()
                if self.eat("="):
                    self.type()
            if not self.eat(","):
                break
        self.need(">")

    def where(self) -> None:
        if not self.eat(K["where"]):
            return
        while True:
            c = self.s[self.i]
            if c in (";", "=", "\0") or kind_of(c) == "{":
                return
            if self.eat("L"):
                self.need(":")
                self.bounds()
            else:
                if c == K["for"]:
                    self.i += 1
                    self.generics(True)
                self.type()
                self.need(":")
                self.bounds()
            if not self.eat(","):
                return

    def item(self, role: str) -> None:
        had_vis = self.vis()
        s = self.s
        c = s[self.i]
        inside = role in ("impl_items", "trait_items", "extern_items")
        if c == "i" and s[self.i + 1] != "!" and s[self.i + 1] != PATH2 and s[self.i + 1] in _ITEM_WORDS | {K["async"], K["const"], K["unsafe"], K["extern"]}:
            self.i += 1  # default, auto
            c = s[self.i]
        # functions
        at = self.i
        if c in (K["const"], K["async"], K["unsafe"], K["extern"], K["fn"]):
            self.eat(K["const"])
            self.eat(K["async"])
            self.eat(K["unsafe"])
            if self.eat(K["extern"]):
                self.eat("s")
            if self.eat(K["fn"]):
                self.need("i")
                self.generics()
                self.need_group("(", "params")
                if self.eat(ARROW):
                    self.type()
                self.where()
                if self.eat(";"):
                    return
                self.need_group("{", "block")
                return
            self.i = at
        if c == K["const"]:
            self.i += 1
            self.eat(K["mut"])
            if not self.eat(K["_"]):
                self.need("i")
            self.generics()
            self.need(":")
            self.type()
            if self.eat("="):
                self.expr()
            self.need(";")
            return
        if c == K["static"]:
            self.i += 1
            self.eat(K["mut"])
            if not self.eat(K["_"]):
                self.need("i")
            self.need(":")
            self.type()
            if self.eat("="):
                self.expr()
            self.need(";")
            return
        if c == K["type"]:
            self.i += 1
            self.need("i")
            self.generics()
            if self.eat(":"):
                self.bounds()
            self.where()
            if self.eat("="):
                self.type()
            self.where()
            self.need(";")
            return
        if not had_vis and (c in PATH_WORDS or c == PATH2):
            if c == "i" and s[self.i + 1] == "i":  # union
                self.i += 2
                self.generics()
                self.where()
                self.need_group("{", "fields")
                return
            self.simple_path()
            self.need("!")
            self.eat("i")
            if self.any_group() != "{":
                self.need(";")
            return
        if inside:
            raise Fail
        if c == K["struct"] or (c == "i" and s[self.i + 1] == "i"):
            self.i += 1
            self.need("i")
            self.generics()
            if self.group("(", "tuple_fields"):
                self.where()
                self.need(";")
                return
            self.where()
            if self.eat(";"):
                return
            self.need_group("{", "fields")
            return
        if c == K["enum"]:
            self.i += 1
            self.need("i")
            self.generics()
            self.where()
            self.need_group("{", "enum_variants")
            return
        if c == K["mod"] or (c == K["unsafe"] and s[self.i + 1] == K["mod"]):
            self.eat(K["unsafe"])
            self.i += 1
            self.need("i")
            if self.eat(";"):
                return
            self.need_group("{", "items")
            return
        if c == K["use"]:
            self.i += 1
            self.use_tree()
            self.need(";")
            return
        if c == K["extern"] or (c == K["unsafe"] and s[self.i + 1] == K["extern"]):
            self.eat(K["unsafe"])
            self.i += 1
            if self.eat(K["crate"]):
                if not self.eat(K["self"]):
                    self.need("i")
                if self.eat(K["as"]) and not self.eat(K["_"]):
                    self.need("i")
                self.need(";")
                return
            self.eat("s")
            self.need_group("{", "extern_items")
            return
        if c == K["unsafe"]:
            self.i += 1
            if self.s[self.i] == "i":
                self.i += 1
            c = self.s[self.i]
        if c == K["trait"]:
            self.i += 1
            self.need("i")
            self.generics()
            if self.eat(":"):
                self.bounds()
            if self.eat("="):
                self.bounds()
                self.where()
                self.need(";")
                return
            self.where()
            self.need_group("{", "trait_items")
            return
        if c == K["impl"]:
            self.i += 1
            at = self.i
            try:
                self.generics()
                self.impl_rest()
            except Fail:
                self.i = at
                self.impl_rest()
            return
        raise Fail

    def impl_rest(self) -> None:
        self.eat(K["const"])
        self.eat("!")
        self.type()
        if self.eat(K["for"]):
            self.type()
        self.where()
        self.need_group("{", "impl_items")


_BLOCK_WORDS = frozenset(K[x] for x in "if match while for loop unsafe const async".split())
_EXPR_WORDS = _BLOCK_WORDS | frozenset(K[x] for x in "return break continue move static let _".split())
_ITEM_WORDS = frozenset(K[x] for x in "fn struct enum trait impl mod use type pub".split())
