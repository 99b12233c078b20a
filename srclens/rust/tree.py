"""Error-tolerant syntax trees of Rust files.

A recursive descent over tokens that never fails: what it can't read becomes an ``ERROR`` node up to the next place where
an item or statement can begin, and the nodes above carry ``error``. Comments, attributes and documentation are no nodes;
what attributes say is kept beside the items they stand before.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from srclens.rust.lexer import _TOKEN, ASSIGN, K, O, _nested, classes

# Names of the language's own types.
PRIMITIVE = frozenset("bool char str i8 i16 i32 i64 i128 isize u8 u16 u32 u64 u128 usize f32 f64".split())
PRECEDENCE = {}
for _n, _ops in enumerate([["||"], ["&&"], ["==", "!=", "<", ">", "<=", ">="], ["|"], ["^"], ["&"], ["<<", ">>"], ["+", "-"], ["*", "/", "%"]]):
    PRECEDENCE |= dict.fromkeys(_ops, _n + 3)
_SKIP = re.compile(r"//|/\*")


class Node:
    __slots__ = ("kind", "field", "named", "kids", "start", "end", "error", "attrs")

    def __init__(self, kind: str, start: int, kids: list[Node] | None = None, end: int = 0, named: bool = True) -> None:
        self.kind, self.start, self.kids, self.end, self.named = kind, start, kids if kids is not None else [], end, named
        self.field = ""
        self.error = kind == "ERROR"
        self.attrs: list[str] = []

    def child(self, field: str) -> Node | None:
        return next((k for k in self.kids if k.field == field), None)

    def all(self, kind: str) -> list[Node]:
        return [k for k in self.kids if k.kind == kind]

    def walk(self):
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo.extend(reversed(n.kids))


class Source:
    """Tokens of a text (comments apart) with their places; ``root`` is its tree."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.tok: list[str] = []
        self.at: list[int] = []
        self.inner_attrs: list[str] = []
        pos = len(text) - len(text.lstrip("﻿"))
        if text.startswith("#!") and not re.match(r"#!\s*\[", text):
            pos = (text + "\n").index("\n")
        while True:
            m = _TOKEN.match(text, pos)
            if m is None:
                break
            t, start = m.group(1), m.start(1)
            pos = m.end()
            if t.startswith("//"):
                continue
            if t.startswith("/*"):
                if t == "/*":
                    end = _nested(text, start)
                    pos = end if end > 0 else len(text)
                continue
            self.tok.append(t)
            self.at.append(start)
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.root = _Builder(self).file()

    def line(self, token: int) -> int:
        """Line of a token (the last one for what is past the end)."""
        if not self.at:
            return 1
        return bisect_right(self.breaks, self.at[min(token, len(self.at) - 1)] - 1) + 1

    def end_line(self, token: int) -> int:
        """Line on which the token before ``token`` ends."""
        if token <= 0 or not self.at:
            return 1
        return bisect_right(self.breaks, self.at[token - 1] + len(self.tok[token - 1]) - 1) + 1

    def words(self, node: Node) -> str:
        """The node's text with white space and comments collapsed."""
        if node.start >= node.end:
            return ""
        raw = self.text[self.at[node.start] : self.at[node.end - 1] + len(self.tok[node.end - 1])]
        return re.sub(r"\s+", " ", raw).strip()


class _Stop(Exception):
    pass


class _Builder:
    def __init__(self, src: Source) -> None:
        self.t = [*src.tok, "", "", "", ""]
        self.c = [*(classes([x]) or "X" for x in src.tok), "\0", "\0", "\0", "\0"]
        self.n = len(src.tok)
        self.i = 0
        self.src = src
        self.close: dict[int, int] = {}
        stack: list[int] = []
        for n, x in enumerate(src.tok):
            if x in ("(", "[", "{"):
                stack.append(n)
            elif x in (")", "]", "}"):
                while stack and {"(": ")", "[": "]", "{": "}"}[src.tok[stack[-1]]] != x:
                    if not any({"(": ")", "[": "]", "{": "}"}[src.tok[s]] == x for s in stack):
                        break
                    stack.pop()
                if stack and {"(": ")", "[": "]", "{": "}"}[src.tok[stack[-1]]] == x:
                    self.close[stack.pop()] = n

    # -- tokens
    def leaf(self, kind: str = "", named: bool | None = None) -> Node:
        k = kind or self.t[self.i]
        out = Node(k, self.i, None, self.i + 1, bool(kind) if named is None else named)
        self.i += 1
        return out

    def is_(self, *words: str) -> bool:
        return self.t[self.i] in words and self.i < self.n

    def take(self, kids: list[Node], word: str) -> bool:
        if self.t[self.i] == word and self.i < self.n:
            kids.append(self.leaf())
            return True
        return False

    def need(self, kids: list[Node], word: str) -> None:
        if not self.take(kids, word):
            raise _Stop

    def name(self, kids: list[Node], kind: str = "identifier", field: str = "name") -> None:
        if self.c[self.i] != "i":
            raise _Stop
        node = self.leaf(kind)
        node.field = field
        kids.append(node)

    def node(self, kind: str, start: int, kids: list[Node]) -> Node:
        return Node(kind, start, kids, self.i)

    def add(self, kids: list[Node], node: Node, field: str = "") -> None:
        if field:
            node.field = field
        kids.append(node)

    def attributes(self, own: list[str]) -> None:
        while self.is_("#"):
            inner = self.t[self.i + 1] == "!"
            at = self.i + 1 + inner
            end = self.close.get(at) if self.t[at] == "[" else None
            if end is None:
                return
            text = "".join(self.t[at + 1 : end])
            (self.src.inner_attrs if inner and self.depth == 0 else self.inner if inner else own).append(text)
            self.i = end + 1

    depth = 0

    # -- files and items
    def file(self) -> Node:
        kids: list[Node] = []
        self.inner: list[str] = []
        self.items(kids, self.n)
        root = Node("source_file", 0, kids, self.n)
        root.attrs = self.src.inner_attrs
        _mark(root)
        return root

    def items(self, kids: list[Node], end: int) -> None:
        while self.i < end:
            start = self.i
            own: list[str] = []
            self.attributes(own)
            if self.i >= end:
                break
            if self.is_(";"):
                kids.append(self.leaf())
                continue
            try:
                node = self.item()
                if self.i > end:
                    raise _Stop
            except _Stop:
                node = self.error(start, end)
            node.attrs = own
            kids.append(node)

    def error(self, start: int, end: int) -> Node:
        """Tokens up to where the next item or statement can begin."""
        self.i = max(self.i, start)
        self.i = start
        while self.i < end:
            t = self.t[self.i]
            if t in ("(", "[", "{") and self.i in self.close and self.close[self.i] < end:
                self.i = self.close[self.i] + 1
                if t == "{":
                    break
                continue
            self.i += 1
            if t == ";" or t == "}":
                break
        self.i = max(self.i, start + 1)
        return Node("ERROR", start, [Node(self.t[n], n, None, n + 1, False) for n in range(start, self.i)], self.i)

    def visibility(self, kids: list[Node]) -> None:
        if self.is_("pub"):
            start = self.i
            own = [self.leaf()]
            if self.is_("(") and self.t[self.i + 1] in ("crate", "self", "super", "in") and self.i in self.close:
                while self.i <= self.close[start + 1]:
                    own.append(self.leaf())
            kids.append(self.node("visibility_modifier", start, own))

    def item(self) -> Node:
        start = self.i
        kids: list[Node] = []
        self.visibility(kids)
        if self.c[self.i] == "i" and self.t[self.i] == "default" and self.t[self.i + 1] in ("fn", "unsafe", "async", "const", "impl", "type"):
            kids.append(self.leaf())
        t = self.t[self.i]
        mods = self.i
        while self.is_("const", "async", "unsafe", "extern") or (self.c[self.i] == "s" and self.t[self.i - 1] == "extern"):
            if self.t[self.i] == "const" and self.t[self.i + 1] not in ("fn", "async", "unsafe", "extern"):
                break
            self.i += 1
        if self.is_("fn") and self.c[self.i + 1] == "i":
            if self.i > mods:
                at, self.i = self.i, mods
                own = [self.leaf("string_literal" if self.c[self.i] == "s" else "") for _ in range(at - mods)]
                kids.append(self.node("function_modifiers", mods, own))
            kids.append(self.leaf())
            return self.function(start, kids)
        self.i = mods
        t = self.t[self.i]
        if t == "const" or t == "static":
            kids.append(self.leaf())
            self.take(kids, "mut")
            if self.is_("_"):
                self.add(kids, self.leaf("identifier"), "name")
            else:
                self.name(kids)
            self.need(kids, ":")
            self.add(kids, self.type(), "type")
            if self.take(kids, "="):
                self.add(kids, self.expr(), "value")
            self.need(kids, ";")
            return self.node(t + "_item", start, kids)
        if t == "type":
            kids.append(self.leaf())
            self.name(kids, "type_identifier")
            self.generics(kids)
            if self.take(kids, ":"):
                self.bounds(kids)
            self.where(kids)
            typed = self.take(kids, "=")
            if typed:
                self.add(kids, self.type(), "type")
            self.where(kids)
            self.need(kids, ";")
            return self.node("type_item" if typed else "associated_type", start, kids)
        if t == "struct" or t == "enum" or (t == "union" and self.c[self.i + 1] == "i"):
            kids.append(self.leaf())
            self.name(kids, "type_identifier")
            self.generics(kids)
            if t != "enum" and self.is_("("):
                self.add(kids, self.ordered_fields(), "body")
                self.where(kids)
                self.need(kids, ";")
                return self.node(f"{t}_item", start, kids)
            self.where(kids)
            if t == "struct" and self.take(kids, ";"):
                return self.node("struct_item", start, kids)
            self.add(kids, self.variants() if t == "enum" else self.fields(), "body")
            return self.node(f"{t}_item", start, kids)
        if t == "mod":
            kids.append(self.leaf())
            self.name(kids)
            if not self.take(kids, ";"):
                self.add(kids, self.declarations(), "body")
            return self.node("mod_item", start, kids)
        if t == "use":
            kids.append(self.leaf())
            self.add(kids, self.use_tree(), "argument")
            self.need(kids, ";")
            return self.node("use_declaration", start, kids)
        if t == "extern" and self.t[self.i + 1] == "crate":
            while not self.is_(";"):
                if self.i >= self.n:
                    raise _Stop
                kids.append(self.leaf("identifier" if self.c[self.i] == "i" else ""))
            kids.append(self.leaf())
            return self.node("extern_crate_declaration", start, kids)
        if t in ("extern", "unsafe") and ("{" in (self.t[self.i + 1], self.t[self.i + 2], self.t[self.i + 3]) and "extern" in (t, self.t[self.i + 1])):
            while not self.is_("{"):
                kids.append(self.leaf("string_literal" if self.c[self.i] == "s" else ""))
            self.add(kids, self.declarations(), "body")
            return self.node("foreign_mod_item", start, kids)
        if t == "unsafe" or (t == "auto" and self.t[self.i + 1] == "trait"):
            kids.append(self.leaf())
            t = self.t[self.i]
        if t == "trait":
            kids.append(self.leaf())
            self.name(kids, "type_identifier")
            self.generics(kids)
            if self.take(kids, ":"):
                self.bounds(kids)
            self.where(kids)
            self.add(kids, self.declarations(), "body")
            return self.node("trait_item", start, kids)
        if t == "impl":
            kids.append(self.leaf())
            if self.is_("<"):
                self.generics(kids)
            self.take(kids, "const")
            self.take(kids, "!")
            first = self.type()
            if self.take(kids, "for"):
                first.field = "trait"
                kids.insert(len(kids) - 1, first)
                self.add(kids, self.type(), "type")
            else:
                self.add(kids, first, "type")
            self.where(kids)
            self.add(kids, self.declarations(), "body")
            return self.node("impl_item", start, kids)
        if t == "macro_rules" and self.t[self.i + 1] == "!":
            kids += [self.leaf(), self.leaf()]
            self.name(kids)
            body = self.t[self.i]
            kids.append(self.token_tree())
            if body != "{":
                self.take(kids, ";")
            return self.node("macro_definition", start, kids)
        if self.c[self.i] == "i" or t in ("crate", "self", "super", "::"):
            node = self.path(False)
            if self.is_("!"):
                node = self.macro(start, node)
                if self.t[node.end - 1] != "}":
                    self.need(node.kids, ";")
                    node.end = self.i
                return node
        raise _Stop

    def function(self, start: int, kids: list[Node]) -> Node:
        self.name(kids)
        self.generics(kids)
        self.add(kids, self.parameters(), "parameters")
        if self.take(kids, "->"):
            self.add(kids, self.type(), "return_type")
        self.where(kids)
        if self.take(kids, ";"):
            return self.node("function_signature_item", start, kids)
        self.add(kids, self.block(), "body")
        return self.node("function_item", start, kids)

    def listed(self, kind: str, one, opening: str) -> Node:
        """A bracketed list whose entries ``one`` reads; what it can't read is an ERROR up to the next comma."""
        start = self.i
        kids: list[Node] = []
        end = self.close.get(start)
        if not self.is_(opening) or end is None:
            raise _Stop
        kids.append(self.leaf())
        while self.i < end:
            if self.is_(","):
                kids.append(self.leaf())
                continue
            own: list[str] = []
            self.attributes(own)
            if self.i >= end:
                break
            at = self.i
            try:
                node = one()
                if self.i > end or self.i == at:
                    raise _Stop
            except _Stop:
                self.i = at
                while self.i < end and self.t[self.i] != ",":
                    self.i = self.close[self.i] + 1 if self.i in self.close else self.i + 1
                self.i = min(self.i, end)
                node = Node("ERROR", at, [Node(self.t[n], n, None, n + 1, False) for n in range(at, self.i)], self.i)
            node.attrs = own
            kids.append(node)
        self.i = end
        kids.append(self.leaf())
        return self.node(kind, start, kids)

    def fields(self) -> Node:
        def one() -> Node:
            start, kids = self.i, []
            self.visibility(kids)
            self.name(kids, "field_identifier")
            self.need(kids, ":")
            self.add(kids, self.type(), "type")
            return self.node("field_declaration", start, kids)

        return self.listed("field_declaration_list", one, "{")

    def ordered_fields(self) -> Node:
        def one() -> Node:
            start, kids = self.i, []
            self.visibility(kids)
            self.add(kids, self.type(), "type")
            return kids[0] if len(kids) == 1 else self.node("ordered_field", start, kids)

        return self.listed("ordered_field_declaration_list", one, "(")

    def variants(self) -> Node:
        def one() -> Node:
            start, kids = self.i, []
            self.visibility(kids)
            self.name(kids)
            if self.is_("("):
                self.add(kids, self.ordered_fields(), "body")
            elif self.is_("{"):
                self.add(kids, self.fields(), "body")
            if self.take(kids, "="):
                self.add(kids, self.expr(), "value")
            return self.node("enum_variant", start, kids)

        return self.listed("enum_variant_list", one, "{")

    def declarations(self) -> Node:
        start, kids = self.i, []
        end = self.close.get(start)
        if not self.is_("{") or end is None:
            raise _Stop
        kids.append(self.leaf())
        keep, self.inner = self.inner, []
        self.depth += 1
        self.items(kids, end)
        self.depth -= 1
        self.i = end
        kids.append(self.leaf())
        out = self.node("declaration_list", start, kids)
        out.attrs, self.inner = self.inner, keep
        return out

    def use_tree(self) -> Node:
        start = self.i
        if self.is_("{"):
            return self.listed("use_list", self.use_tree, "{")
        if self.is_("*"):
            return self.node("use_wildcard", start, [self.leaf()])
        kids: list[Node] = []
        self.take(kids, "::")
        while True:
            if self.is_("{"):
                kids.append(self.listed("use_list", self.use_tree, "{"))
                return self.node("scoped_use_list", start, kids)
            if self.take(kids, "*"):
                return self.node("use_wildcard", start, kids)
            if self.c[self.i] != "i" and not self.is_("self", "super", "crate", "Self"):
                raise _Stop
            kids.append(self.leaf("identifier" if self.c[self.i] == "i" else self.t[self.i]))
            if not self.take(kids, "::"):
                break
        if self.take(kids, "as"):
            kids.append(self.leaf("identifier" if self.c[self.i] == "i" else ""))
            return self.node("use_as_clause", start, kids)
        return kids[0] if len(kids) == 1 else self.node("scoped_identifier", start, kids)

    def generics(self, kids: list[Node]) -> None:
        if not self.is_("<"):
            return
        start, own = self.i, [self.leaf()]
        while not self.is_(">"):
            self.attributes([])
            if self.c[self.i] == "L":
                own.append(self.leaf("lifetime"))
                if self.take(own, ":"):
                    self.bounds(own)
            elif self.take(own, "const"):
                self.name(own)
                self.need(own, ":")
                own.append(self.type())
                if self.take(own, "="):
                    own.append(self.block() if self.is_("{") else self.unary(True))
            else:
                self.name(own, "type_identifier", "")
                if self.take(own, ":"):
                    self.bounds(own)
                if self.take(own, "="):
                    own.append(self.type())
            if not self.take(own, ","):
                break
        self.need(own, ">")
        self.add(kids, self.node("type_parameters", start, own), "type_parameters")

    def bounds(self, kids: list[Node]) -> None:
        start, own = self.i, []
        while self.c[self.i] in "iL" or self.is_("?", "for", "(", "::", "crate", "self", "super", "Self", "<", "~"):
            own.append(self.bound())
            if not self.take(own, "+"):
                break
        kids.append(self.node("trait_bounds", start, own))

    def bound(self) -> Node:
        start = self.i
        if self.c[self.i] == "L":
            return self.leaf("lifetime")
        if self.is_("("):
            kids = [self.leaf(), self.bound()]
            self.need(kids, ")")
            return self.node("parenthesized_bound", start, kids)
        kids: list[Node] = []
        if self.is_("?", "~"):
            kids.append(self.leaf())
            self.take(kids, "const")
        if self.take(kids, "for"):
            self.generics(kids)
        kids.append(self.path(True))
        return kids[0] if len(kids) == 1 else self.node("removed_trait_bound" if kids[0].kind == "?" else "higher_ranked_trait_bound", start, kids)

    def where(self, kids: list[Node]) -> None:
        if not self.is_("where"):
            return
        start, own = self.i, [self.leaf()]
        while self.i < self.n and not self.is_("{", ";", "="):
            at, one = self.i, []
            if self.c[self.i] == "L":
                one.append(self.leaf("lifetime"))
            else:
                if self.take(one, "for"):
                    self.generics(one)
                one.append(self.type())
            self.need(one, ":")
            self.bounds(one)
            own.append(self.node("where_predicate", at, one))
            if not self.take(own, ","):
                break
        kids.append(self.node("where_clause", start, own))

    def parameters(self) -> Node:
        def one() -> Node:
            start, kids = self.i, []
            at = self.i
            if self.is_("&"):
                kids.append(self.leaf())
                if self.c[self.i] == "L":
                    kids.append(self.leaf("lifetime"))
            self.take(kids, "mut")
            if self.is_("self") and self.t[self.i + 1] != "::":
                kids.append(self.leaf("self"))
                if self.take(kids, ":"):
                    self.add(kids, self.type(), "type")
                return self.node("self_parameter", start, kids)
            self.i, kids = at, []
            if self.is_("..."):
                return self.node("variadic_parameter", start, [self.leaf()])
            self.add(kids, self.pattern(), "pattern")
            self.need(kids, ":")
            self.add(kids, self.type(), "type")
            return self.node("parameter", start, kids)

        return self.listed("parameters", one, "(")

    # -- types
    def type_arguments(self) -> Node:
        start, kids = self.i, []
        self.need(kids, "<")
        while not self.is_(">"):
            if self.c[self.i] == "L":
                kids.append(self.leaf("lifetime"))
            elif self.c[self.i] in "ls" or self.is_("-"):
                kids.append(self.unary(True))
            elif self.is_("{"):
                kids.append(self.block())
            elif self.c[self.i] == "i" and self.t[self.i + 1] in ("=", ":"):
                at, one = self.i, []
                self.name(one, "type_identifier")
                if self.take(one, "="):
                    one.append(self.block() if self.is_("{") else self.literal() if self.c[self.i] in "ls" else self.type())
                else:
                    self.take(one, ":")
                    self.bounds(one)
                kids.append(self.node("type_binding", at, one))
            else:
                kids.append(self.type())
            if not self.take(kids, ","):
                break
        self.need(kids, ">")
        return self.node("type_arguments", start, kids)

    def path(self, types: bool) -> Node:
        """A path as a type or as an expression; generic arguments need ``::`` before them in the latter."""
        start = self.i
        kind = "type_identifier" if types else "identifier"
        if self.is_("<") or (self.is_("<<") and False):
            kids = [self.leaf(), self.type()]
            if self.take(kids, "as"):
                kids.append(self.path(True))
            self.need(kids, ">")
            out = self.node("bracketed_type", start, kids)
        elif self.is_("::"):
            out = Node("", start, [], self.i)
        else:
            out = self.segment(kind)
        while True:
            if types and self.is_("<") and out.kind not in ("generic_type",):
                out.field = "type"
                out = self.node("generic_type", start, [out, self.type_arguments()])
            elif types and self.is_("(") and out.kind in ("type_identifier", "scoped_type_identifier") and self.t[out.end - 1] in ("Fn", "FnMut", "FnOnce"):
                kids = [out, self.listed("parameters", self.type, "(")]
                if self.take(kids, "->"):
                    self.add(kids, self.type(False), "return_type")
                out = self.node("function_type", start, kids)
            if not self.is_("::"):
                return out
            kids = [out] if out.kind else []
            kids.append(self.leaf())
            if self.is_("<"):
                if types:
                    kids.append(self.type_arguments())
                    out = self.node("generic_type", start, kids)
                else:
                    kids.append(self.type_arguments())
                    out = self.node("generic_function", start, kids)
                continue
            if self.is_("{", "*"):
                raise _Stop
            part = self.segment(kind)
            part.field = "name"
            kids.append(part)
            out = self.node("scoped_type_identifier" if types else "scoped_identifier", start, kids)

    def segment(self, kind: str) -> Node:
        t = self.t[self.i]
        if self.c[self.i] == "i":
            return self.leaf("primitive_type" if kind == "type_identifier" and t in PRIMITIVE else kind)
        if t in ("self", "super", "crate"):
            return self.leaf(t)
        if t == "Self":
            return self.leaf(kind)
        raise _Stop

    def type(self, plus: bool = True) -> Node:
        start, kids, t = self.i, [], self.t[self.i]
        if t == "(":
            end = self.close.get(self.i)
            if end == self.i + 1:
                return self.node("unit_type", start, [self.leaf(), self.leaf()])
            out = self.listed("tuple_type", self.type, "(")
            return out
        if t == "[":
            kids = [self.leaf(), self.type()]
            if self.take(kids, ";"):
                kids.append(self.expr())
            self.need(kids, "]")
            return self.node("array_type", start, kids)
        if t in ("&", "&&"):
            kids.append(self.leaf())
            if self.c[self.i] == "L":
                kids.append(self.leaf("lifetime"))
            if self.is_("mut"):
                kids.append(self.leaf("mutable_specifier"))
            self.add(kids, self.type(False), "type")
            return self.node("reference_type", start, kids)
        if t == "*":
            kids.append(self.leaf())
            if not self.is_("const", "mut"):
                raise _Stop
            kids.append(self.leaf())
            self.add(kids, self.type(False), "type")
            return self.node("pointer_type", start, kids)
        if t == "!":
            return self.leaf("never_type")
        if t == "_":
            return self.leaf("type_identifier")
        if t in ("impl", "dyn"):
            kids.append(self.leaf())
            if plus:
                self.bounds(kids)
            else:
                kids.append(self.bound())
            return self.node("abstract_type" if t == "impl" else "dynamic_type", start, kids)
        if t == "for":
            kids.append(self.leaf())
            self.generics(kids)
        if self.is_("fn", "unsafe", "extern"):
            while self.is_("unsafe", "extern") or self.c[self.i] == "s":
                kids.append(self.leaf("string_literal" if self.c[self.i] == "s" else ""))
            self.need(kids, "fn")

            def one() -> Node:
                at, own = self.i, []
                if self.is_("..."):
                    return self.leaf()
                if (self.c[self.i] == "i" or self.is_("_")) and self.t[self.i + 1] == ":":
                    own += [self.leaf("identifier"), self.leaf(), self.type()]
                    return self.node("parameter", at, own)
                return self.type()

            self.add(kids, self.listed("parameters", one, "("), "parameters")
            if self.take(kids, "->"):
                self.add(kids, self.type(False), "return_type")
            return self.node("function_type", start, kids)
        if self.c[self.i] == "L":
            self.bounds(kids)
            return self.node("bounded_type", start, kids)
        kids.append(self.path(True))
        if self.is_("!") and self.t[self.i + 1] in ("(", "[", "{"):
            return self.macro(start, kids[0])
        if plus and self.is_("+"):
            while self.take(kids, "+"):
                kids.append(self.bound())
            return self.node("bounded_type", start, kids)
        return kids[0] if len(kids) == 1 else self.node("higher_ranked_type", start, kids)

    # -- patterns
    def pattern(self) -> Node:
        start, kids = self.i, []
        self.take(kids, "|")
        kids.append(self.pattern_one())
        while self.take(kids, "|"):
            kids.append(self.pattern_one())
        return kids[0] if len(kids) == 1 else self.node("or_pattern", start, kids)

    def pattern_one(self) -> Node:
        start, kids, t = self.i, [], self.t[self.i]
        if t in ("&", "&&"):
            kids.append(self.leaf())
            if self.is_("mut"):
                kids.append(self.leaf("mutable_specifier"))
            kids.append(self.pattern_one())
            return self.node("reference_pattern", start, kids)
        if t == "(":
            return self.listed("tuple_pattern", self.pattern, "(")
        if t == "[":
            return self.listed("slice_pattern", self.pattern, "[")
        if t == "_":
            return self.leaf()
        if t == "..":
            kids.append(self.leaf("", False))
            if self.c[self.i] in "ls" or self.is_("-"):
                kids.append(self.unary(True))
                return self.node("range_pattern", start, kids)
            return self.node("remaining_field_pattern", start, kids)
        if t == "..=":
            kids += [self.leaf(), self.unary(True)]
            return self.node("range_pattern", start, kids)
        if t == "ref":
            kids += [self.leaf(), self.pattern_one()]
            return self.node("ref_pattern", start, kids)
        if t == "mut":
            kids += [self.leaf("mutable_specifier"), self.pattern_one()]
            return self.node("mut_pattern", start, kids)
        if self.c[self.i] == "i" and self.t[self.i + 1] == "@":
            kids += [self.leaf("identifier"), self.leaf(), self.pattern_one()]
            return self.node("captured_pattern", start, kids)
        if t == "const" and self.t[self.i + 1] == "{":
            return self.node("const_block", start, [self.leaf(), self.block()])
        head = self.unary(True) if self.c[self.i] in "ls" or t == "-" else self.path(False)
        if self.is_("!") and self.t[self.i + 1] in ("(", "[", "{"):
            return self.macro(start, head)
        if self.is_("("):
            self.retype(head)
            inner = self.listed("", self.pattern, "(")
            head.field = "type"
            return self.node("tuple_struct_pattern", start, [head, *inner.kids])
        if self.is_("{") and self.c[start] != "l":
            self.retype(head)
            inner = self.listed("", self.field_pattern, "{")
            head.field = "type"
            return self.node("struct_pattern", start, [head, *inner.kids])
        if self.is_("..", "..=", "..."):
            kids = [head, self.leaf()]
            if self.c[self.i] in "ils" or self.is_("-", "::", "self", "Self", "crate"):
                kids.append(self.unary(True) if self.c[self.i] != "i" else self.path(False))
            return self.node("range_pattern", start, kids)
        return head

    @staticmethod
    def retype(head: Node) -> None:
        """The last name of a path that stands for a type."""
        if head.kind == "scoped_identifier":
            head.kind = "scoped_type_identifier"
            head = head.kids[-1]
        if head.kind == "identifier":
            head.kind = "type_identifier"

    def field_pattern(self) -> Node:
        start, kids = self.i, []
        if self.is_(".."):
            return self.node("remaining_field_pattern", start, [self.leaf()])
        if self.t[self.i + 1] == ":":
            self.add(kids, self.leaf("field_identifier" if self.c[self.i] == "i" else "integer_literal"), "name")
            kids.append(self.leaf())
            self.add(kids, self.pattern(), "pattern")
        else:
            self.take(kids, "ref")
            if self.is_("mut"):
                kids.append(self.leaf("mutable_specifier"))
            if self.c[self.i] != "i":
                raise _Stop
            self.add(kids, self.leaf("shorthand_field_identifier"), "name")
        return self.node("field_pattern", start, kids)

    # -- expressions
    def starts(self, struct: bool) -> bool:
        t = self.t[self.i]
        if self.i >= self.n or t in (")", "]", "}", ",", ";", "=>", "=", "else", "?", ".", "in", "as"):
            return False
        if t == "{":
            return struct
        return self.c[self.i] in "ilsL" or t in "( [ - * ! & && | || < :: .. ..= #".split() or self.c[self.i] in _EXPR

    def expr(self, struct: bool = True, least: int = 0) -> Node:
        start = self.i
        if self.is_("..", "..="):
            kids = [self.leaf()]
            if self.starts(struct):
                kids.append(self.expr(struct, 3))
            left = self.node("range_expression", start, kids)
        else:
            left = self.unary(struct)
        while self.i < self.n:
            t = self.t[self.i]
            if t == "as":
                kids = [left, self.leaf()]
                self.add(kids, self.type(False), "type")
                left.field = "value"
                left = self.node("type_cast_expression", start, kids)
                continue
            op, width = t, 1
            if t == ">" and self.t[self.i + 1] == ">" and self.src.at[self.i + 1] == self.src.at[self.i] + 1:
                op, width = ">>", 2
                if self.t[self.i + 2] == "=":
                    op, width = ">>=", 3
            elif t == ">" and self.t[self.i + 1] == "=" and self.src.at[self.i + 1] == self.src.at[self.i] + 1:
                op, width = ">=", 2
            if op == "=" or op == ">>=" or self.c[self.i] in ASSIGN:
                if least > 1:
                    break
                oper = Node(op, self.i, None, self.i + width, False)
                self.i += width
                left.field = "left"
                right = self.expr(struct, 1)
                right.field = "right"
                left = self.node("assignment_expression" if op == "=" else "compound_assignment_expr", start, [left, oper, right])
                continue
            if op in ("..", "..="):
                if least > 2:
                    break
                kids = [left, self.leaf()]
                if self.starts(struct):
                    kids.append(self.expr(struct, 3))
                left = self.node("range_expression", start, kids)
                continue
            level = PRECEDENCE.get(op)
            if level is None or level < least:
                break
            oper = Node(op, self.i, None, self.i + width, False)
            oper.field = "operator"
            self.i += width
            left.field = "left"
            right = self.expr(struct, level + 1)
            right.field = "right"
            left = self.node("binary_expression", start, [left, oper, right])
        return left

    def unary(self, struct: bool) -> Node:
        start, t = self.i, self.t[self.i]
        self.attributes([])
        start, t = self.i, self.t[self.i]
        if t in ("-", "*", "!"):
            kids = [self.leaf(), self.unary(struct)]
            return self.node("unary_expression", start, kids)
        if t in ("&", "&&"):
            kids = [self.leaf()]
            if self.is_("mut"):
                kids.append(self.leaf("mutable_specifier"))
            elif self.t[self.i] == "raw" and self.t[self.i + 1] in ("const", "mut"):
                kids += [self.leaf(), self.leaf()]
            self.add(kids, self.unary(struct), "value")
            return self.node("reference_expression", start, kids)
        if t in ("return", "break"):
            kids = [self.leaf()]
            if t == "break" and self.c[self.i] == "L":
                kids.append(self.leaf("label"))
            if self.starts(struct):
                kids.append(self.expr(struct))
            return self.node(f"{t}_expression", start, kids)
        if t == "continue":
            kids = [self.leaf()]
            if self.c[self.i] == "L":
                kids.append(self.leaf("label"))
            return self.node("continue_expression", start, kids)
        if t == "let":
            kids = [self.leaf()]
            self.add(kids, self.pattern(), "pattern")
            self.need(kids, "=")
            self.add(kids, self.expr(False, 5), "value")
            return self.node("let_condition", start, kids)
        if t in ("move", "static", "|", "||") or (t == "async" and self.t[self.i + 1] in ("|", "||")) or (t == "async" and self.t[self.i + 1] == "move" and self.t[self.i + 2] in ("|", "||")):
            return self.closure(struct)
        return self.postfix(self.primary(struct), start)

    def closure(self, struct: bool) -> Node:
        start, kids = self.i, []
        while self.is_("static", "async", "move"):
            kids.append(self.leaf())
        at, own = self.i, []
        if self.is_("||"):
            own.append(self.leaf())
        else:
            self.need(own, "|")
            while not self.is_("|"):
                p, one = self.i, []
                self.attributes([])
                one.append(self.pattern_one())
                if self.take(one, ":"):
                    self.add(one, self.type(), "type")
                    one[0].field = "pattern"
                    own.append(self.node("parameter", p, one))
                else:
                    own.append(one[0])
                if not self.take(own, ","):
                    break
            self.need(own, "|")
        self.add(kids, self.node("closure_parameters", at, own), "parameters")
        if self.take(kids, "->"):
            self.add(kids, self.type(False), "return_type")
        self.add(kids, self.expr(struct), "body")
        return self.node("closure_expression", start, kids)

    def postfix(self, left: Node, start: int) -> Node:
        while self.i < self.n:
            t = self.t[self.i]
            if t == "?":
                left = self.node("try_expression", start, [left, self.leaf()])
                left.end = self.i
            elif t == ".":
                kids = [left, self.leaf()]
                left.field = "value"
                if self.is_("await"):
                    kids.append(self.leaf())
                    left = self.node("await_expression", start, kids)
                elif self.c[self.i] == "l":
                    self.add(kids, self.leaf("integer_literal"), "field")
                    left = self.node("field_expression", start, kids)
                elif self.c[self.i] == "i":
                    self.add(kids, self.leaf("field_identifier"), "field")
                    left = self.node("field_expression", start, kids)
                    if self.is_("::"):
                        kids = [left, self.leaf(), self.type_arguments()]
                        left = self.node("generic_function", start, kids)
                else:
                    raise _Stop
            elif t == "(":
                left.field = "function"
                args = self.listed("arguments", self.expr, "(")
                args.field = "arguments"
                left = self.node("call_expression", start, [left, args])
            elif t == "[":
                kids = [left, self.leaf(), self.expr()]
                self.need(kids, "]")
                left = self.node("index_expression", start, kids)
            else:
                break
            left.end = self.i
        return left

    def literal(self) -> Node:
        t = self.t[self.i]
        if self.c[self.i] == "s":
            return self.leaf("raw_string_literal" if "r" in t.split('"')[0] else "string_literal")
        if t in ("true", "false"):
            return self.leaf("boolean_literal")
        if t[0] in "'b":
            return self.leaf("char_literal")
        return self.leaf("float_literal" if re.match(r"[0-9_]+(?:\.|[eE]|f)", t) and not t.startswith("0x") else "integer_literal")

    def token_tree(self) -> Node:
        start = self.i
        end = self.close.get(start)
        if end is None or self.t[start] not in ("(", "[", "{"):
            raise _Stop
        stack: list[list[Node]] = [[]]
        opens: list[int] = []
        while self.i <= end:
            if self.i in self.close:
                opens.append(self.i)
                stack.append([self.leaf()])
            elif self.t[self.i] in (")", "]", "}"):
                own = stack.pop()
                own.append(self.leaf())
                stack[-1].append(self.node("token_tree", opens.pop(), own))
            else:
                c = self.c[self.i]
                stack[-1].append(self.literal() if c in "ls" else self.leaf("identifier" if c == "i" else ""))
        return stack[0][0]

    def macro(self, start: int, head: Node) -> Node:
        head.field = "macro"
        kids = [head, self.leaf()]
        kids.append(self.token_tree())
        return self.node("macro_invocation", start, kids)

    def primary(self, struct: bool) -> Node:
        start, t, c = self.i, self.t[self.i], self.c[self.i]
        if c in "ls":
            return self.literal()
        if t == "_":
            return self.leaf("identifier")
        if t == "(":
            end = self.close.get(start)
            if end == start + 1:
                return self.node("unit_expression", start, [self.leaf(), self.leaf()])
            out = self.listed("tuple_expression", self.expr, "(")
            if not any(k.kind == "," for k in out.kids):
                out.kind = "parenthesized_expression"
            return out
        if t == "[":
            kids = [self.leaf()]
            if not self.is_("]"):
                kids.append(self.expr())
                if self.take(kids, ";"):
                    kids.append(self.expr())
                else:
                    while self.take(kids, ","):
                        if self.is_("]"):
                            break
                        kids.append(self.expr())
            self.need(kids, "]")
            return self.node("array_expression", start, kids)
        block = self.blocklike()
        if block is not None:
            return block
        if c == "i" or t in ("self", "Self", "super", "crate", "::", "<"):
            head = self.path(False)
            if self.is_("!") and self.t[self.i + 1] in ("(", "[", "{"):
                return self.macro(start, head)
            if struct and self.is_("{") and self.initializers_follow():
                if head.kind == "generic_function":
                    head.kind = "generic_type_with_turbofish"
                self.retype(head)
                head.field = "name"
                return self.node("struct_expression", start, [head, self.listed("field_initializer_list", self.initializer, "{")])
            return head
        raise _Stop

    def initializers_follow(self) -> bool:
        a, b = self.t[self.i + 1], self.t[self.i + 2]
        return a == "}" or a == ".." or (self.c[self.i + 1] in "il" and b in (":", ",", "}")) or a == "#"

    def initializer(self) -> Node:
        start, kids = self.i, []
        if self.take(kids, ".."):
            kids.append(self.expr())
            return self.node("base_field_initializer", start, kids)
        if self.t[self.i + 1] == ":":
            self.add(kids, self.leaf("field_identifier" if self.c[self.i] == "i" else "integer_literal"), "field")
            kids.append(self.leaf())
            self.add(kids, self.expr(), "value")
            return self.node("field_initializer", start, kids)
        if self.c[self.i] != "i":
            raise _Stop
        return self.node("shorthand_field_initializer", start, [self.leaf("identifier")])

    def condition(self) -> Node:
        return self.expr(False)

    def blocklike(self) -> Node | None:
        start, t = self.i, self.t[self.i]
        kids: list[Node] = []
        if self.c[self.i] == "L" and self.t[self.i + 1] == ":":
            kids += [self.leaf("label"), self.leaf()]
            t = self.t[self.i]
            if t not in ("loop", "while", "for", "{"):
                raise _Stop
        if t == "{":
            block = self.block()
            if kids:
                block.kids[:0], block.start = kids, start
            return block
        if t in ("unsafe", "const", "try") and self.t[self.i + 1] == "{":
            kids += [self.leaf(), self.block()]
            return self.node(f"{t}_block", start, kids)
        if t == "async":
            kids.append(self.leaf())
            self.take(kids, "move")
            kids.append(self.block())
            return self.node("async_block", start, kids)
        if t == "if":
            kids.append(self.leaf())
            self.add(kids, self.condition(), "condition")
            self.add(kids, self.block(), "consequence")
            if self.is_("else"):
                at, own = self.i, [self.leaf()]
                own.append(self.blocklike() if self.is_("if") else self.block())
                self.add(kids, self.node("else_clause", at, own), "alternative")
            return self.node("if_expression", start, kids)
        if t == "while":
            kids.append(self.leaf())
            self.add(kids, self.condition(), "condition")
            self.add(kids, self.block(), "body")
            return self.node("while_expression", start, kids)
        if t == "loop":
            kids.append(self.leaf())
            self.add(kids, self.block(), "body")
            return self.node("loop_expression", start, kids)
        if t == "for":
            kids.append(self.leaf())
            self.add(kids, self.pattern(), "pattern")
            self.need(kids, "in")
            self.add(kids, self.expr(False), "value")
            self.add(kids, self.block(), "body")
            return self.node("for_expression", start, kids)
        if t == "match":
            kids.append(self.leaf())
            self.add(kids, self.expr(False), "value")
            self.add(kids, self.match_block(), "body")
            return self.node("match_expression", start, kids)
        return None

    def match_block(self) -> Node:
        def one() -> Node:
            start, kids = self.i, []
            at, own = self.i, [self.pattern()]
            if self.take(own, "if"):
                self.add(own, self.expr(), "condition")
            self.add(kids, self.node("match_pattern", at, own), "pattern")
            self.need(kids, "=>")
            if self.is_("{"):
                body_at = self.i
                body = self.block()
                if self.is_(".", "?", "+", "-", "/", "%", "^", "as") and self.i < self.n:
                    self.i = body_at
                    body = self.expr()
            else:
                body = self.expr()
            self.add(kids, body, "value")
            self.take(kids, ",")
            return self.node("match_arm", start, kids)

        return self.listed("match_block", one, "{")

    def block(self) -> Node:
        start = self.i
        end = self.close.get(start)
        if not self.is_("{") or end is None:
            raise _Stop
        kids = [self.leaf()]
        self.depth += 1
        keep, self.inner = self.inner, []
        while self.i < end:
            own: list[str] = []
            self.attributes(own)
            if self.i >= end:
                break
            at = self.i
            try:
                node = self.statement(end)
                if self.i > end or self.i == at:
                    raise _Stop
            except _Stop:
                self.i = at
                node = self.error(at, end)
            node.attrs = own
            kids.append(node)
        self.inner = keep
        self.depth -= 1
        self.i = end
        kids.append(self.leaf())
        return self.node("block", start, kids)

    def statement(self, end: int) -> Node:
        start, t = self.i, self.t[self.i]
        if t == ";":
            return self.node("empty_statement", start, [self.leaf()])
        if t == "let":
            kids = [self.leaf()]
            if self.is_("mut"):
                kids.append(self.leaf("mutable_specifier"))
            self.add(kids, self.pattern(), "pattern")
            if self.take(kids, ":"):
                self.add(kids, self.type(), "type")
            if self.take(kids, "="):
                self.add(kids, self.expr(), "value")
                if self.take(kids, "else"):
                    self.add(kids, self.block(), "alternative")
            self.need(kids, ";")
            return self.node("let_declaration", start, kids)
        if self.item_follows():
            return self.item()
        block = self.blocklike()
        if block is not None and not self.is_(".", "?"):
            if self.i < end and self.is_(";"):
                return self.node("expression_statement", start, [block, self.leaf()])
            return block if self.i >= end else self.node("expression_statement", start, [block])
        if block is not None:
            self.i = start
        value = self.expr()
        if self.is_(";"):
            return self.node("expression_statement", start, [value, self.leaf()])
        if self.i == end:
            return value
        if value.kind == "macro_invocation" and self.t[self.i - 1] == "}":
            return self.node("expression_statement", start, [value])
        raise _Stop

    def item_follows(self) -> bool:
        t, n = self.t[self.i], self.t[self.i + 1]
        if t in ("fn", "struct", "enum", "trait", "impl", "mod", "use", "type", "pub"):
            return True
        if t == "const":
            return n not in ("{", "|", "||", "move")
        if t == "unsafe":
            return n in ("fn", "extern", "impl", "trait")
        if t == "async":
            return n in ("fn", "unsafe")
        if t == "extern":
            return True
        if t == "static":
            return n not in ("|", "||", "move")
        return t == "macro_rules" and n == "!" or (t == "union" and self.c[self.i + 1] == "i")


_EXPR = frozenset(K[x] for x in "if match while for loop unsafe const async return break continue move static let self Self super crate _".split())


def _mark(root: Node) -> None:
    """Carries errors up."""
    order = list(root.walk())
    for node in reversed(order):
        if any(k.error for k in node.kids):
            node.error = True


assert O["->"]
