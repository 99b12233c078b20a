"""What one Rust file says about itself, in one pass over its tree.

``analyze(text)`` gives a dictionary that fits ``RUST_FILE``, or the line and message of the failure: a file that doesn't
parse strictly has no partial measures.
"""

from __future__ import annotations

import re
from collections import Counter

from srclens.functions.deep import deep
from srclens.rust import grammar, lexer
from srclens.rust.tree import Node, Source

ITEMS = "functions structs enums traits impls modules macros consts statics type_aliases imports".split()
SIGNALS = "clones allocating_conversions collects unwraps dyn_dispatch generic_functions async_functions nested_loops allocations_in_loops".split()
_N = "bigint"
FUNCTION = "name string, qualified_name string, start_line bigint, end_line bigint, complexity int, max_nesting bigint, parameters bigint, is_public boolean, is_async boolean, is_unsafe boolean, is_generic boolean, is_test boolean"
DEFINITION = "name string, kind string, line bigint, is_public boolean, is_test boolean, is_externally_reachable boolean"


def _struct(fields: str) -> str:
    return "struct<" + ",".join(f.strip().replace(" ", ":", 1) for f in fields.split(",")) + ">"


RUST_FILE = (
    f"items struct<{','.join(f'{n}:{_N}' for n in ITEMS)}>, functions array<{_struct(FUNCTION)}>, definitions array<{_struct(DEFINITION)}>, "
    f"referenced_crates array<string>, identifier_uses map<string,bigint>, performance struct<{','.join(f'{n}:{_N}' for n in SIGNALS)}>, "
    "public_items bigint, unsafe_blocks bigint, is_test_module boolean, todo_markers bigint, max_nesting bigint, "
    "test_ranges array<struct<start_line:bigint,end_line:bigint>>, "
    "modules array<struct<name:string,inline_path:array<string>,paths:array<string>,path_is_unconditional:boolean,is_test:boolean>>, "
    "includes array<struct<path:string,is_source:boolean>>, unresolved_include boolean, macro_identifiers array<string>, item_count bigint"
)
# Attributes by which something outside of the crate's source may use an item; methods that allocate or panic.
REACHABLE = frozenset("no_mangle export_name used proc_macro proc_macro_derive proc_macro_attribute macro_export ctor".split())
CONVERSIONS = frozenset("to_string to_owned to_vec into_owned into_vec".split())
PANICS = frozenset(["unwrap", "expect"])
ALLOCATING_MACROS = frozenset(["format", "vec"])
_TODO = re.compile(r"TODO|FIXME|HACK|XXX")
_DEFINED = {"struct_item": ("structs", "struct"), "enum_item": ("enums", "enum"), "trait_item": ("traits", "trait"), "const_item": ("consts", "const"), "static_item": ("statics", "static"), "type_item": ("type_aliases", "type_alias")}
_LOOPS = frozenset(["for_expression", "while_expression", "loop_expression"])
_BLOCKS = frozenset(["block"])
_LITERALS = frozenset("integer_literal float_literal string_literal raw_string_literal char_literal boolean_literal".split())
_PATHS = frozenset("identifier scoped_identifier self generic_function".split())


def split_top(text: str) -> list[str]:
    """Parts between commas outside of brackets and strings."""
    out, depth, start = [], 0, 0
    for m in re.finditer(r'"(?:[^"\\]|\\.)*"|[(\[{]|[)\]}]|,', text):
        c = m.group()
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "," and depth == 0:
            out.append(text[start : m.start()])
            start = m.end()
    return [*out, text[start:]]


def has_cfg_test(attrs: list[str]) -> bool:
    return any(a.startswith("cfg(") and a.endswith(")") and "test" in split_top(a[4:-1]) for a in attrs)


def is_test_attribute(attrs: list[str]) -> bool:
    return has_cfg_test(attrs) or any(re.match(r"(?:test|bench)(?:$|\()", a) for a in attrs)


def is_externally_reachable(attrs: list[str]) -> bool:
    return any(re.match(r"[\w:]*", a).group() in REACHABLE for a in attrs)


def string_value(tok: str) -> str | None:
    m = re.match(r'[bc]?r(#*)"(.*)"\1$', tok, re.S)
    if m:
        return m.group(2)
    if tok.startswith('"') and tok.endswith('"') and len(tok) > 1:
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}.get(m.group(1), m.group(1)), tok[1:-1])
    return None


def path_attributes(attrs: list[str]) -> tuple[list[str], bool]:
    """Paths that ``#[path]`` and then ``cfg_attr`` name, and whether one of them holds always."""
    always, sometimes = [], []
    for a in attrs:
        if a.startswith("path=") and (v := string_value(a[5:])) is not None:
            always.append(v)
        elif a.startswith("cfg_attr(") and a.endswith(")"):
            for part in split_top(a[9:-1])[1:]:
                if part.startswith("path=") and (v := string_value(part[5:])) is not None:
                    sometimes.append(v)
    return always + sometimes, bool(always)


def count_identifiers(text: str) -> Counter[str]:
    """Every identifier token, keywords and macro bodies included; a lifetime counts as its name, documentation as ``doc``."""
    out: Counter[str] = Counter()
    for t in lexer.tokens(text):
        c = t[0]
        if c == "_" or c.isalpha():
            if '"' not in t and "'" not in t:
                out[t] += 1
        elif c == "'":
            if not t.endswith("'") or len(t) == 1:
                out[t[1:]] += 1
        elif c == "/" and lexer.classes([t]) in ("D", "d"):
            out["doc"] += 1
    return out


def type_name(src: Source, node: Node | None) -> str:
    """Last name of a type's path, through references."""
    while node is not None:
        if node.kind in ("type_identifier", "primitive_type"):
            return src.tok[node.start]
        if node.kind == "generic_type":
            node = node.kids[0] if node.kids[0].kind != "::" else node.kids[1]
        elif node.kind == "scoped_type_identifier":
            node = node.kids[-1]
        elif node.kind == "reference_type":
            node = node.kids[-1]
        else:
            return "impl"
    return "impl"


def _lookup(node: Node) -> bool:
    """Whether an arm's body only names a value."""
    if node.kind in _LITERALS or node.kind in _PATHS:
        return True
    if node.kind == "reference_expression":
        return _lookup(node.kids[-1])
    if node.kind == "call_expression":
        return all(_lookup(k) for k in node.kids[1].kids if k.named)
    if node.kind in ("tuple_expression", "unit_expression"):
        return all(_lookup(k) for k in node.kids if k.named)
    return False


def complexity(body: Node) -> tuple[int, int]:
    """Decisions of a function's body and its deepest block; what nested functions do is theirs."""
    score, deepest = 1, 1
    todo = [(body, 1)]
    while todo:
        node, depth = todo.pop()
        deepest = max(deepest, depth)
        for k in node.kids:
            kind = k.kind
            if kind in ("function_item", "macro_invocation", "macro_definition"):
                continue
            if kind in ("if_expression", "try_expression") or kind in _LOOPS:
                score += 1
            elif kind == "binary_expression" and k.kids[1].kind in ("&&", "||"):
                score += 1
            elif kind == "match_arm":
                guard = k.kids[0].child("condition") is not None
                value = k.child("value")
                if guard or value is None or not _lookup(value):
                    score += 1
            todo.append((k, depth + (kind in _BLOCKS)))
    # a condition's "&&" joins let conditions too
    return score, deepest


class _Visitor:
    def __init__(self, src: Source) -> None:
        self.src = src
        self.items = dict.fromkeys(ITEMS, 0)
        self.signals = dict.fromkeys(SIGNALS, 0)
        self.functions: list[dict] = []
        self.definitions: list[dict] = []
        self.crates: set[str] = set()
        self.public = self.unsafe = self.nesting = 0
        self.ranges: list[dict] = []
        self.modules: list[dict] = []
        self.includes: list[dict] = []
        self.unresolved = False
        self.macro_words: set[str] = set()
        self.decl_items = 0

    def attr_line(self, node: Node) -> int:
        """First line of an item with its attributes."""
        if not node.attrs:
            return self.src.line(node.start)
        n, left = node.start - 1, len(node.attrs)
        while n >= 0 and left:
            depth = 0
            while n >= 0:
                depth += (self.src.tok[n] == "]") - (self.src.tok[n] == "[")
                n -= 1
                if depth == 0:
                    break
            while n >= 0 and self.src.tok[n] in ("!",):
                n -= 1
            left -= 1
            n -= 1  # the number sign
        return self.src.line(n + 1)

    def define(self, node: Node, kind: str, name: Node, public: bool, reachable: bool, test: bool) -> None:
        self.public += public
        self.definitions.append({"name": self.src.tok[name.start], "kind": kind, "line": self.src.line(name.start), "is_public": public, "is_test": test, "is_externally_reachable": reachable})

    def run(self) -> None:
        self.visit(self.src.root, False, has_cfg_test(self.src.root.attrs), "", 0, 0, [], False)

    def children(self, node: Node, *state) -> None:
        for k in node.kids:
            if k.kids or k.kind in ("mod_item",):
                self.visit(k, *state)

    def visit(self, node: Node, test: bool, cfg: bool, owner: str, loops: int, depth: int, inline: list[str], trait: bool) -> None:
        src, kind = self.src, node.kind
        public = any(k.kind == "visibility_modifier" and k.end == k.start + 1 for k in node.kids[:1])
        if kind in ("function_item", "function_signature_item"):
            self.function(node, test, cfg, owner, loops, depth, inline, public, trait)
            return
        if kind in _DEFINED:
            count, label = _DEFINED[kind]
            if not (trait or owner) or kind not in ("const_item", "type_item"):
                self.items[count] += 1
                test = test or is_test_attribute(node.attrs)
                self.define(node, label, node.child("name"), public, is_externally_reachable(node.attrs), test)
            if kind == "trait_item":
                self.children(node, test, cfg or has_cfg_test(node.attrs), "", loops, depth, inline, True)
                return
        elif kind == "impl_item":
            self.items["impls"] += 1
            own = is_test_attribute(node.attrs)
            if own and not test:
                self.ranges.append({"start_line": self.attr_line(node), "end_line": src.end_line(node.end)})
            self.children(node, test or own, cfg or has_cfg_test(node.attrs), type_name(src, node.child("type")), loops, depth, inline, False)
            return
        elif kind == "mod_item":
            self.items["modules"] += 1
            own = is_test_attribute(node.attrs)
            if own and not test:
                self.ranges.append({"start_line": self.attr_line(node), "end_line": src.end_line(node.end)})
            test = test or own
            name = node.child("name")
            self.define(node, "module", name, public, is_externally_reachable(node.attrs), test)
            cfg = cfg or has_cfg_test(node.attrs)
            paths, always = path_attributes(node.attrs)
            label = src.tok[name.start].removeprefix("r#")
            if node.child("body") is None:
                self.modules.append({"name": label, "inline_path": list(inline), "paths": paths, "path_is_unconditional": always, "is_test": cfg})
            else:
                inline = [*inline, paths[0] if paths else label]
            self.children(node, test, cfg, owner, loops, depth, inline, False)
            return
        elif kind == "macro_definition":
            self.items["macros"] += 1
            reach = is_externally_reachable(node.attrs)
            self.define(node, "macro", node.child("name"), reach, reach, test or is_test_attribute(node.attrs))
            self.scan_macro(node, inline, cfg)
            return
        elif kind == "macro_invocation":
            self.macro(node, loops)
            return
        elif kind == "use_declaration":
            self.items["imports"] += 1
            first = src.tok[node.kids[-2].start]
            tree = node.kids[-2]
            if tree.kind not in ("use_list", "use_wildcard") and first not in ("self", "super", "crate", "{", "*", "::"):
                self.crates.add(first.removeprefix("r#"))
            elif first == "::" and len(src.tok) > tree.start + 1:
                self.crates.add(src.tok[tree.start + 1])
            return
        elif kind in ("scoped_identifier", "scoped_type_identifier"):
            first = src.tok[node.start]
            if re.match(r"[^\W\d]", first) and first not in ("self", "super", "crate", "Self"):
                self.crates.add(first.removeprefix("r#"))
        elif kind == "call_expression" and node.kids[0].kind in ("field_expression", "generic_function"):
            self.method(node, loops)
        elif kind == "dynamic_type":
            self.signals["dyn_dispatch"] += 1
        elif kind == "unsafe_block":
            self.unsafe += 1
        elif kind in _LOOPS:
            self.signals["nested_loops"] += loops > 0
            loops += 1
        elif kind == "block":
            depth += 1
            self.nesting = max(self.nesting, depth)
        for k in node.kids:
            if k.kind == "macro_invocation" and kind in ("source_file", "declaration_list") and not (trait or owner):
                self.items["macros"] += 1
                self.scan_macro(k, inline, cfg or has_cfg_test(k.attrs))
            elif k.kind == "expression_statement" and k.kids[0].kind == "macro_invocation":
                pass
            if k.kids:
                self.visit(k, test, cfg, owner, loops, depth, inline, trait)

    def function(self, node: Node, test: bool, cfg: bool, owner: str, loops: int, depth: int, inline: list[str], public: bool, trait: bool) -> None:
        src = self.src
        self.items["functions"] += 1
        body = node.child("body")
        cfg = cfg or has_cfg_test(node.attrs)
        if body is None:
            self.children(node, test, cfg, owner, loops, depth, inline, trait)
            return
        own = is_test_attribute(node.attrs)
        if own and not test:
            self.ranges.append({"start_line": self.attr_line(node), "end_line": src.end_line(body.end)})
        is_test = test or own
        words = {src.tok[k.start + n] for k in node.kids if k.kind == "function_modifiers" for n in range(k.end - k.start)}
        generic = node.child("type_parameters")
        is_generic = generic is not None and len(generic.kids) > 2
        score, nesting = complexity(body)
        first = next(k for k in node.kids if k.kind in ("function_modifiers", "fn"))
        name_node = node.child("name")
        name = src.tok[name_node.start]
        self.signals["generic_functions"] += is_generic
        self.signals["async_functions"] += "async" in words
        self.unsafe += "unsafe" in words
        self.functions.append({
            "name": name, "qualified_name": f"{owner}::{name}" if owner else name, "start_line": src.line(first.start), "end_line": src.end_line(body.end),
            "complexity": score, "max_nesting": nesting, "parameters": sum(k.kind in ("self_parameter", "parameter") for k in node.child("parameters").kids),
            "is_public": public or trait, "is_async": "async" in words, "is_unsafe": "unsafe" in words, "is_generic": is_generic, "is_test": is_test,
        })
        if not owner and not trait or depth:
            self.define(node, "function", name_node, public, is_externally_reachable(node.attrs) or is_test, test)
        self.children(node, is_test, cfg, owner, loops, depth, inline, False)

    def method(self, node: Node, loops: int) -> None:
        target = node.kids[0]
        if target.kind == "generic_function":
            target = target.kids[0]
        if target.kind != "field_expression":
            return
        field = target.child("field")
        name = self.src.tok[field.start] if field is not None else ""
        if name == "clone" and len(node.kids[1].kids) == 2:
            self.signals["clones"] += 1
        elif name in CONVERSIONS:
            self.signals["allocating_conversions"] += 1
        elif name == "collect":
            self.signals["collects"] += 1
        elif name in PANICS:
            self.signals["unwraps"] += 1
            return
        else:
            return
        self.signals["allocations_in_loops"] += loops > 0

    def macro(self, node: Node, loops: int) -> None:
        src = self.src
        head = node.child("macro")
        name = src.tok[head.end - 1]
        if head.kind.startswith("scoped") and re.match(r"[^\W\d]", src.tok[head.start]) and src.tok[head.start] not in ("self", "super", "crate", "Self"):
            self.crates.add(src.tok[head.start])
        if name in ALLOCATING_MACROS:
            self.signals["allocating_conversions"] += 1
            self.signals["allocations_in_loops"] += loops > 0
        if name in ("include", "include_str", "include_bytes"):
            body = next(k for k in reversed(node.kids) if src.tok[k.start] in "([{")  # an item's ``;`` may follow
            inner = src.tok[body.start + 1 : body.end - 1]
            value = string_value(inner[0]) if len(inner) == 1 else None
            if value is not None:
                self.includes.append({"path": value, "is_source": name == "include"})
            elif name == "include":
                self.unresolved = True

    def scan_macro(self, node: Node, inline: list[str], test: bool) -> None:
        """Out-of-line modules that an item's macro tokens declare; other identifiers may be built into names."""
        toks = self.src.tok[node.kids[-1].start : node.end] if node.kids else []
        n = 0
        while n < len(toks):
            if toks[n] == "mod" and n + 2 < len(toks) and re.match(r"[^\W\d]\w*$", toks[n + 1]) and toks[n + 2] == ";":
                self.modules.append({"name": toks[n + 1].removeprefix("r#"), "inline_path": list(inline), "paths": [], "path_is_unconditional": False, "is_test": test})
                n += 3
                continue
            if re.match(r"[^\W\d]\w*$", toks[n]):
                self.macro_words.add(toks[n])
            n += 1


def todo_markers(text: str) -> int:
    return sum(1 for x in text.split("\n") if x.lstrip().startswith(("//", "*")) and _TODO.search(x))


def analyze(text: str) -> tuple[dict | None, tuple[int, str] | None]:
    """What is measured in a text, or why it can't be: the line and a message."""
    return deep(_analyze, text)


def _analyze(text: str) -> tuple[dict | None, tuple[int, str] | None]:
    toks = lexer.tokens(text)
    if not grammar.parses(lexer.classes(toks)):
        return None, (failure_line(text, toks), "the file is not valid Rust")
    src = Source(text)
    v = _Visitor(src)
    v.run()
    top = [k for k in src.root.kids if k.named]
    return {
        "items": v.items, "functions": v.functions, "definitions": v.definitions, "referenced_crates": sorted(v.crates),
        "identifier_uses": dict(count_identifiers(text)), "performance": v.signals, "public_items": v.public, "unsafe_blocks": v.unsafe,
        "is_test_module": has_cfg_test(src.root.attrs) or bool(v.definitions) and all(d["is_test"] for d in v.definitions),
        "todo_markers": todo_markers(text), "max_nesting": v.nesting, "test_ranges": v.ranges, "modules": v.modules, "includes": v.includes,
        "unresolved_include": v.unresolved, "macro_identifiers": sorted(v.macro_words), "item_count": len(top),
    }, None


def failure_line(text: str, toks: list[str]) -> int:
    """Line of the first thing that can't be read, as well as a tolerant tree knows it."""
    src = Source(text)
    for node in src.root.walk():
        if node.kind == "ERROR":
            return src.line(node.start)
    return src.end_line(len(src.tok))
