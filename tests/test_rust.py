import pytest

from srclens.rust import grammar, lexer
from srclens.rust.measure import analyze, count_identifiers
from srclens.rust.tree import Source

VALID = [
    "", "fn f() {}", "#!/usr/bin/env x\nfn f() {}", "#![allow(x)]\nuse a::{b, c::*, d as e};", "impl<T: Clone + 'static> Foo<T> for Bar<'_, T> where T: Fn(u8) -> u8 { type X = u8; const N: usize = 3; fn m(&mut self, (a, b): (u8, u8)) -> impl Iterator<Item = u8> + '_ { self.0.1 } }",
    "fn f() -> Vec<Vec<u8>> { let x: Vec<Vec<u8>>= vec![vec![1; 3]]; x.iter().map(|&(a, _)| a as u8).collect::<Vec<_>>() }", "/* a /* b */ c */ fn f() { r#\"\"{\"#; b'\\''; '\\u{41}'; 'a: loop { break 'a } }",
    "macro_rules! m { ($a:expr) => { $a } } m! { anything } m!(a b c);", "fn f() { match x { 1 | 2 if y => {} A { b, .. } => 3, [a, .., b] => return, ..=5 => 1, _ => unsafe { g() } } }", "enum E { A = 1, B(u8), C { d: u8 } } union U { a: u8 } struct S; struct T(pub(crate) u8);",
    "async fn f() { a.await?; if let Some(x) = y && z {} else if a == B { } { 1 } }", "const fn f() {} extern \"C\" { fn g(x: i32, ...); } unsafe impl Send for X {} mod m { //! inner\n }", "fn f() { let Some(x) = y else { return; }; (a, b) = c; x = Y { z, ..w }; a < b; a >> 2; }",
]
INVALID = ["fn f() {", "fn f( {}", "fn f() { let x = ; }", "fn f() { 'ab' }", "struct S { a u8 }", "fn f() { a < b < c }", "<<<<<<< HEAD\nfn f() {}", "/// doc", "fn f() { x /// doc\n }", "def f():\n  pass", "fn f() { if x { } else }", 'fn f() { "open }', "/* open", "fn f() { \"\\q\" }", "impl X { let a = 1; }"]


@pytest.mark.parametrize("text", VALID)
def test_valid(text):
    assert grammar.parses(lexer.classes(lexer.tokens(text)))
    assert not Source(text).root.error


@pytest.mark.parametrize("text", INVALID)
def test_invalid(text):
    assert not grammar.parses(lexer.classes(lexer.tokens(text)))
    assert analyze(text)[0] is None


def test_very_long_and_deep_texts():
    assert grammar.parses(lexer.classes(lexer.tokens("fn f() { x(); }\n" * 20_000)))
    assert not grammar.parses(lexer.classes(lexer.tokens("(" * 50_000)))
    assert grammar.parses(lexer.classes(lexer.tokens("fn f() " + "{" * 5000 + "}" * 5000)))


def _one(body):
    return analyze("fn f() {" + body + "}")[0]["functions"][0]


@pytest.mark.parametrize(("body", "score"), [
    ("let a = 1; let b = 2;", 1), ("if a {} while b {} for x in y {} loop {} match z { 1 => {} _ => {} } let q = a && b || c; g()?;", 10), ("match z { 1 => 1, 2 => 2, 3 => \"x\", _ => 0 }", 1),
    ("match z { 1 => A, _ => { if x {} } }", 3), ("match z { 1 if g => 1, _ => 0 }", 2), ("fn g() { if x {} }", 1),
])
def test_complexity(body, score):
    assert _one(body)["complexity"] == score


def test_measures():
    r, failure = analyze(
        "use serde::Value;\nmod sub;\nstruct S;\nimpl S {\n    pub fn m(&self, a: u8, b: u8) {}\n}\n#[cfg(test)]\nmod tests {\n    #[test]\n    fn t() { x.unwrap(); }\n}\n"
        "fn g() { for i in a { for j in b { c.clone(); format!(\"x\"); } } std::mem::swap(a, b) }\n"
    )
    assert failure is None
    assert [(f["qualified_name"], f["parameters"], f["is_test"], f["is_public"]) for f in r["functions"]] == [("S::m", 3, False, True), ("t", 0, True, False), ("g", 0, False, False)]
    assert [(d["name"], d["kind"]) for d in r["definitions"]] == [("sub", "module"), ("S", "struct"), ("tests", "module"), ("t", "function"), ("g", "function")]
    assert r["test_ranges"] == [{"start_line": 7, "end_line": 11}]
    assert r["referenced_crates"] == ["serde", "std"]
    p = r["performance"]
    assert (p["clones"], p["allocating_conversions"], p["unwraps"], p["nested_loops"], p["allocations_in_loops"]) == (1, 1, 1, 1, 2)
    assert r["items"]["imports"] == 1 and r["items"]["modules"] == 2


def test_census_sees_macros_keywords_and_lifetimes():
    assert count_identifiers("/// d\nfn r#a<'b>() { m!(c \"no\") }") == {"doc": 1, "fn": 1, "r#a": 1, "b": 1, "m": 1, "c": 1}


def test_tree_is_tolerant():
    src = Source("fn a() { let x = ; ok(); }\nfn b() {}")
    assert src.root.error
    assert [src.tok[n.child("name").start] for n in src.root.kids if n.kind == "function_item"] == ["a", "b"]
