"""Queries over small inputs that are planted in them, with the rows that must come out as their SQL.

For operators that SQL can't restate and whose answers on the tables nobody knows: parsing, module trees, clone layers,
sketches, ignore rules and settings. The README says which expected rows were written before a run, and which were read off
the operators and gone through against the definitions.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srclens import config as settings
from srclens.clones import detect, sketch
from srclens.clones.units import Flat
from srclens.config import Clones, Thresholds
from srclens.functions import similarity, text
from srclens.functions.hashing import hash_text, mix
from srclens.functions.labels import CLONE_KINDS, DEFINITIONS, DETECTORS, FRAGMENTS, LANGUAGES, label
from srclens.operators import dead_code, lines, module_tree, rust_files
from srclens.plans.base import query
from srclens.sources import gitignore, manifests


def rows(names: str, expected: list[tuple]) -> str:
    """Expected rows as SQL."""
    cell = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else f"{x!r}::DOUBLE" if isinstance(x, float) else "'" + x.replace("'", "''") + "'"
    big = [isinstance(next((r[k] for r in expected if r[k] is not None), ""), int) and not isinstance(expected[0][k], bool) for k in range(len(expected[0]))]
    cols = ", ".join(f"{n}::BIGINT AS {n}" if b else n for n, b in zip(names.split(", "), big))
    return f"SELECT {cols} FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in expected)}) t({names})"


def table(spark: SparkSession, schema: str, data: list[tuple]) -> DataFrame:
    return spark.createDataFrame(data, schema)


# -- one file
ITEMS = '''//! doc
use serde::Deserialize;
mod outer;
pub mod inner { mod deep; }
#[cfg(test)] mod checks;
#[path = "odd.rs"] mod named;
include!("data/table.rs");
pub struct Pool { size: u8 }
enum Kind { One, Two }
pub trait Draw { fn draw(&self); fn twice(&self) { self.draw(); self.draw(); } }
impl Draw for Pool { fn draw(&self) {} }
const LIMIT: u8 = 3;
static NAME: &str = "x";
type Alias = Vec<u8>;
macro_rules! shout { () => {} }
wrap! { mod hidden; beta }
include!(concat!("a", "b"));
'''
FUNCTIONS = '''pub async fn first<T: Clone>(items: &[T], limit: usize) -> Vec<T> {
    let mut out = Vec::new();
    for x in items {
        for y in items {
            if out.len() < limit && limit > 1 || limit == 9 {
                out.push(y.clone());
            }
        }
    }
    out
}
unsafe fn second(d: &dyn Fn()) -> Option<u8> {
    match other() { Some(1) => None, Some(n) => Some(n), None => { loop { if a? { break } } } }
}
// TODO one
	// FIXME two
fn third() { while let Some(x) = it.next() { x.unwrap(); names.iter().collect::<Vec<_>>(); v.to_string(); } }
#[test]
fn checked() { third().expect("b"); }
#[no_mangle] pub extern "C" fn seen() {}
fn main() { fn nested() { if a { b() } } }
'''
BROKEN = {"broken.rs": "fn broken( {\n}\n", "late.rs": "fn a() {}\nfn b() { let = 3; }\n"}
SOURCES = {"items.rs": ITEMS, "functions.rs": FUNCTIONS, **BROKEN}


def parsed(spark: SparkSession) -> DataFrame:
    return rust_files.parse(table(spark, "file string, text string", list(SOURCES.items())), ["file"])


@query(rows("file, name, qualified_name, start_line, end_line, complexity, max_nesting, parameters, flags", [
    ("items.rs", "twice", "twice", 10, 10, 1, 1, 1, "public"), ("items.rs", "draw", "Pool::draw", 11, 11, 1, 1, 1, ""), ("functions.rs", "first", "first", 1, 11, 6, 4, 2, "public async generic"),
    ("functions.rs", "second", "second", 12, 14, 5, 4, 1, "unsafe"), ("functions.rs", "third", "third", 17, 17, 2, 2, 0, ""), ("functions.rs", "checked", "checked", 19, 19, 1, 1, 0, "test"),
    ("functions.rs", "seen", "seen", 20, 20, 1, 1, 0, "public"), ("functions.rs", "main", "main", 21, 21, 1, 1, 0, ""), ("functions.rs", "nested", "nested", 21, 21, 2, 2, 0, ""),
]))
def planted_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R4, R6, R7, R14, R15, R18."""
    flags = F.concat_ws(" ", *(F.when(F.col(f"is_{x}"), x) for x in ("public", "async", "unsafe", "generic", "test")))
    f = rust_files.functions(parsed(spark), "file")
    return f.select("file", "name", "qualified_name", "start_line", "end_line", F.col("complexity").cast("bigint").alias("complexity"), "max_nesting", "parameters", flags.alias("flags"))


@query(rows("file, name, kind, line, flags", [
    ("items.rs", "outer", "module", 3, ""), ("items.rs", "inner", "module", 4, "public"), ("items.rs", "deep", "module", 4, ""), ("items.rs", "checks", "module", 5, "test"), ("items.rs", "named", "module", 6, ""), ("items.rs", "Pool", "struct", 8, "public"),
    ("items.rs", "Kind", "enum", 9, ""), ("items.rs", "Draw", "trait", 10, "public"), ("items.rs", "LIMIT", "const", 12, ""), ("items.rs", "NAME", "static", 13, ""), ("items.rs", "Alias", "type alias", 14, ""), ("items.rs", "shout", "macro", 15, ""),
    ("functions.rs", "first", "function", 1, "public"), ("functions.rs", "second", "function", 12, ""), ("functions.rs", "third", "function", 17, ""), ("functions.rs", "checked", "function", 19, "reachable"), ("functions.rs", "seen", "function", 20, "public reachable"), ("functions.rs", "main", "function", 21, ""), ("functions.rs", "nested", "function", 21, ""),
]))
def planted_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3, R5, R8, R9, and the labels of definitions."""
    flags = F.concat_ws(" ", F.when(F.col("is_public"), "public"), F.when(F.col("is_test"), "test"), F.when(F.col("is_externally_reachable"), "reachable"))
    return rust_files.definitions(parsed(spark), "file").select("file", "name", label("kind", DEFINITIONS).alias("kind"), "line", flags.alias("flags"))


@query(rows("file, what, n", [
    *(("items.rs", k, n) for k, n in {"functions": 3, "structs": 1, "enums": 1, "traits": 1, "impls": 1, "modules": 5, "macros": 4, "consts": 1, "statics": 1, "type_aliases": 1, "imports": 1, "public_items": 3, "item_count": 16}.items()),
    *(("functions.rs", k, n) for k, n in {"functions": 7, "public_items": 2, "unsafe_blocks": 1, "todo_markers": 2, "item_count": 6, "clones": 1, "allocating_conversions": 1, "collects": 1, "unwraps": 2, "dyn_dispatch": 1, "generic_functions": 1, "async_functions": 1, "nested_loops": 1, "allocations_in_loops": 3, "test_from": 18, "test_to": 19}.items()),
    ("items.rs", "max_nesting", 1), ("functions.rs", "max_nesting", 4), ("items.rs", "test_from", 5), ("items.rs", "test_to", 5),
]))
def planted_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R10, R12, R16-R19."""
    p = parsed(spark).where("rust is not null")
    whole = ["public_items", "unsafe_blocks", "todo_markers", "max_nesting", "item_count"]
    first = F.try_element_at("rust.test_ranges", F.lit(1))
    pairs = [F.struct(F.lit(n).alias("what"), F.col(f"rust.{n}").alias("n")) for n in whole]
    pairs += [F.struct(F.lit(f.name).alias("what"), F.col(f"rust.{part}.{f.name}").alias("n")) for part in ("items", "performance") for f in p.schema["rust"].dataType[part].dataType.fields]
    pairs += [F.struct(F.lit("test_from").alias("what"), first["start_line"].alias("n")), F.struct(F.lit("test_to").alias("what"), first["end_line"].alias("n"))]
    return p.select("file", F.explode(F.array(*pairs)).alias("x")).select("file", "x.*").where("n > 0")


@query(rows("file, name, inline, paths, always, is_test", [
    ("items.rs", "outer", "", "", False, False), ("items.rs", "deep", "inner", "", False, False), ("items.rs", "checks", "", "", False, True), ("items.rs", "named", "", "odd.rs", True, False), ("items.rs", "hidden", "", "", False, False),
]))
def planted_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R20, R21."""
    m = parsed(spark).select("file", F.explode("rust.modules").alias("m"))
    return m.select("file", "m.name", F.array_join("m.inline_path", "/").alias("inline"), F.array_join("m.paths", ",").alias("paths"), F.col("m.path_is_unconditional").alias("always"), "m.is_test")


@query(rows("file, crates, includes, unresolved, words", [("items.rs", "serde", "data/table.rs", True, "beta"), ("functions.rs", "Vec", "", False, "")]))
def planted_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R13, R21, R22."""
    p = parsed(spark).where("rust is not null")
    return p.select("file", F.array_join("rust.referenced_crates", ",").alias("crates"), F.array_join("rust.includes.path", ",").alias("includes"), F.col("rust.unresolved_include").alias("unresolved"), F.array_join("rust.macro_identifiers", ",").alias("words"))


@query(rows("file, line", [("broken.rs", 1), ("late.rs", 2)]))
def planted_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1."""
    return parsed(spark).where("failure is not null").select("file", "failure.line")


@query(rows("name, uses", [("a", 3), ("b", 2), ("c", 1)]))
def planted_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2, A5: names in code and macros, none in comments and strings."""
    p = rust_files.parse(table(spark, "file string, text string", [("x", 'static a: b = a; // c\nconst b: u8 = "a";'), ("y", "m! { a /* a */ c }")]), ["file"])
    return rust_files.census(rust_files.identifier_uses(p, "file")).where("length(name) = 1 and name <> 'm'")


@query(rows("language, total, code, comment, blank", [("rust", 7, 2, 4, 1), ("python", 4, 1, 3, 0), ("html", 3, 1, 2, 0), ("sql", 2, 1, 1, 0), ("json", 3, 3, 0, 0), ("css", 3, 1, 2, 0)]))
def planted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1-L3, F2: comments that end, begin or stand within lines, and marks inside strings."""
    data = [
        ("rust", 'let s = "/* no"; // yes\n\n/* a\n\n*/ // b\n/* c */ let t = 1;\n// d\n'), ("python", "'''\nx\n'''\ny = 1\n"), ("html", "<b>\n<!-- x\ny -->\n"), ("sql", "-- a\nselect 1\n"), ("json", "[\n1\n]\n"), ("css", "/* x\n*/\na{}\n"),
    ]
    return lines.with_line_counts(table(spark, "language string, text string", data)).select("language", "lines.*")


# -- module trees: one folder each
TREES = {
    "plain/src/lib.rs": "mod used;", "plain/src/used.rs": "fn a() {}", "plain/src/stray.rs": "fn b() {}", "plain/src/empty.rs": "// nothing",
    "nested/src/lib.rs": "mod a; mod b; #[cfg(test)] mod t;", "nested/src/a/mod.rs": "mod x;", "nested/src/a/x.rs": "fn f() {}", "nested/src/b.rs": "mod y;", "nested/src/b/y.rs": "fn g() {}", "nested/src/t.rs": "mod u;", "nested/src/t/u.rs": "fn h() {}", "nested/src/b/lost.rs": "fn l() {}",
    "named/src/lib.rs": '#[path = "odd.rs"] mod a; mod inner { mod deep; #[path = "up.rs"] mod up; } #[cfg_attr(x, path = "c.rs")] mod c; include!("code.inc.rs");', "named/src/odd.rs": "mod below;", "named/src/below.rs": "fn a() {}", "named/src/inner/deep.rs": "fn a() {}", "named/src/inner/up.rs": "fn a() {}",
    "named/src/c.rs": "fn a() {}", "named/src/code.inc.rs": "mod within;", "named/src/within.rs": "fn w() {}", "named/src/odd/stray.rs": "fn s() {}",
    "open/src/lib.rs": "mod gone;", "open/src/stray.rs": "fn b() {}", "built/src/lib.rs": "include!(concat!(x));", "built/src/stray.rs": "fn b() {}", "word/src/lib.rs": "wrap! { maybe }", "word/src/maybe.rs": "fn m() {}", "word/src/never.rs": "fn n() {}",
    "roots/src/main.rs": "fn main() {}", "roots/src/bin/tool.rs": "mod part;", "roots/src/bin/part.rs": "fn p() {}", "roots/tests/check.rs": "mod common;", "roots/tests/common/mod.rs": "fn c() {}", "roots/own/start.rs": "fn s() {}", "roots/src/aside.rs": "fn z() {}",
}


@query(rows("kind, path", [
    ("orphan", "plain/src/stray.rs"), ("orphan", "nested/src/b/lost.rs"), ("orphan", "named/src/odd/stray.rs"), ("orphan", "word/src/never.rs"), ("orphan", "roots/src/aside.rs"),
    ("tests", "nested/src/t.rs"), ("tests", "nested/src/t/u.rs"), ("tests", "roots/tests/check.rs"), ("tests", "roots/tests/common/mod.rs"),
]))
def planted_module_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In ``open`` a declared file exists that wasn't read, in ``built`` an include isn't known, so that neither has orphans."""
    folders = sorted({p.split("/")[0] for p in TREES})
    more = {"roots": {"bin": [{"path": "own/start.rs", "name": "x"}]}}
    packages = table(spark, "dir string, name string, manifest string", [(d, d, json.dumps({"package": {"name": d}} | more.get(d, {}))) for d in folders])
    found = rust_files.parse(table(spark, "path string, text string", list(TREES.items())), ["path"])
    disk = table(spark, "path string", [(p,) for p in [*TREES, "open/src/gone.rs"]])
    orphans, tests = module_tree.resolve(packages, found, disk)
    return orphans.select(F.lit("orphan").alias("kind"), "path").unionByName(tests.select(F.lit("tests").alias("kind"), "path"))


@query(rows("dir, name", [(".", "top"), ("a/b", "inner")]))
def planted_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests that name a package; a workspace alone, and one that can't be read, are none."""
    data = [("Cargo.toml", '[package]\nname = "top"'), ("a/b/Cargo.toml", '[package]\nname = "inner"\n[dependencies]'), ("w/Cargo.toml", "[workspace]"), ("x/Cargo.toml", "= broken"), ("y/other.toml", '[package]\nname = "no"'), ("z/Cargo.toml", None)]
    return manifests.manifests(table(spark, "relative_path string, text string", data)).select("dir", "name")


@query(rows("name, kind, confidence", [("caller", "function", "high"), ("open", "function", "medium"), ("orphan", "function", "high"), ("lost", "file", "high"), ("Lonely", "struct", "high")]))
def planted_dead_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses in tests don't count, ``main`` and what is reachable from outside are no candidates."""
    sources = {"a.rs": "fn orphan() {} fn used() {} fn caller() { used(); } fn main() {}\n#[no_mangle] fn ext() {}", "b.rs": "pub fn open() {} struct Lonely; mod m {}", "tests/t.rs": "fn t() { orphan(); t(); }"}
    files = table(spark, "file string, text string, is_test_file boolean", [(p, t, p.startswith("tests/")) for p, t in sources.items()])
    found = dead_code.analyze(rust_files.parse(files, ["file", "is_test_file"]))
    return dead_code.add_orphans(found, table(spark, "path string", [("src/lost.rs",)]), files.select("file", "is_test_file")).select("name", "kind", "confidence")


# -- clones
def _fn(name: str, *statements: str) -> str:
    return f"fn {name}(a: u8) -> u8 {{\n" + "".join(f"    {s}\n" for s in statements) + "    a\n}\n"


LOOPS = ["let b = one(a);", "if b > 3 { two(b); }", "while three(b) { four(); }", "for c in b.iter() { five(c); }", "six(b, a);", "let d = seven(b)?;", "eight(&d);", "return d.nine();"]
APART = ["uno(a1);", "if dos { tres(); }", "while cuatro() { cinco[6]; }", "x7 += 8;", "nueve.diez(11, 12);", "for y in z { w(y, y); }"]
TEN = [
    "let m0 = p.q(1).r(s0);", "if t0 < u0 { v0.w0(x0); }", "for c0 in d0.e0() { f0(c0, 2); }", "let g0: Vec<u8> = h0.iter().map(|k0| k0.l0(n0)).collect();", "o0[p0] = q0(r0)?;",
    "match s1 { Some(t1) => u1(t1), None => v1(3, w1), }", "x1 += 4 * y1 - z1;", "while a2.b2() { c2 -= 5; d2(e2); }", "f2!(g2 <= h2, \"i2\");", "let (j2, k2) = (l2(&m2), &mut n2);",
]
RUN = ["loop { break; }", "a[0] = b[1];", "c.d().e()?;", "match f { 1 => g(), _ => h() }", "*i += -j;", "let k = |l| l + 1;", "m!(n);", "o as u8;"]
LIMITS = Thresholds(duplicate_min_tokens=30, duplicate_min_lines=4, duplicate_similarity=0.85)
COPIES = {
    "exact1.rs": _fn("left", *LOOPS), "exact2.rs": _fn("left", *LOOPS), "order1.rs": _fn("first", *APART), "order2.rs": _fn("second", APART[1], APART[0], *APART[2:]),
    "near1.rs": _fn("near", *TEN), "near2.rs": _fn("near", *TEN[:5], "extra();", *TEN[5:]),
    "run1.rs": _fn("r1", "only_here(1, 2, 3, 4, 5);", "there?;", *RUN), "run2.rs": _fn("r2", *RUN, *(f"tail{n}.x.y.z = {{ {n} }};" for n in range(9))),
    "renamed1.rs": _fn("pick", "let v = start(a)?;", "loop { if v.done() { break; } }", "v.set(a, 1);", "stop(v, 2.5);", "w.x.y.z(3)[4];"), "renamed2.rs": _fn("take", "let u = begin(a)?;", "loop { if u.over() { break; } }", "u.put(a, 7);", "end(u, 9.5);", "p.q.r.s(8)[9];"),
    "types.rs": "struct A {\n    a: u8,\n    b: Foo<Bar>,\n    c: Baz,\n}\nstruct B {\n    d: u8,\n    e: Foo<Bar>,\n    f: Baz,\n}\nstruct C {\n    g: Other,\n    h: Foo,\n    i: Baz,\n}\n",
}


def _inputs(spark: SparkSession) -> DataFrame:
    return table(spark, "path string, text string, is_test_path boolean, editable boolean", [(p, t, p.startswith("order"), p != "exact2.rs") for p, t in COPIES.items()])


@query(rows("files, fragment, kind, copies, detectors, in_tests, read_only", [
    ("exact1.rs,exact2.rs", "function", "exact", 2, "equal subtrees+repeated runs", False, True), ("order1.rs,order2.rs", "function", "near miss", 2, "equal subtrees+repeated runs", True, False),
    ("run2.rs", "statements", "renamed", 2, "repeated runs", False, False),  # its tail's first half and second half
    ("near1.rs,near2.rs", "function", "near miss", 2, "similar shingles+small edit distance", False, False), ("run1.rs,run2.rs", "statements", "exact", 2, "repeated runs", False, False),
    ("renamed1.rs,renamed2.rs", "function", "renamed", 2, "equal subtrees+repeated runs", False, False), ("types.rs", "type shape", "renamed", 2, "equal subtrees", False, False),
]))
def planted_clone_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C10-C29 at once, with the labels of kinds, fragments and detectors."""
    groups = detect.suppress(detect.score(detect.detect(_inputs(spark), Clones(), LIMITS), F.lit(0)), 500)
    files = F.array_join(F.array_sort(F.array_distinct(F.transform("units", lambda u: u["path"]))), ",")
    named = F.transform("detectors", lambda d: label(d, DETECTORS))
    return groups.select(files.alias("files"), label("fragment", FRAGMENTS).alias("fragment"), label("kind", CLONE_KINDS).alias("kind"), F.col("copies").cast("bigint").alias("copies"), F.array_join(named, "+").alias("detectors"), "in_tests", "read_only")


@query(rows("path, start_line, end_line", [("run1.rs", 4, 11), ("run2.rs", 2, 9)]))
def planted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of statements that two functions share."""
    runs = detect.repeated_runs(detect.extract(_inputs(spark).where("path like 'run%'"), "runs", Clones(), LIMITS))
    longest = runs.withColumn("size", F.element_at("units", 1)["tokens"]).orderBy(F.desc("size")).limit(1)
    return longest.select(F.explode("units").alias("u")).select("u.path", "u.start_line", "u.end_line")


@query(rows("a, b, alike, edit", [("near1.rs", "near2.rs", True, True)]))
def planted_near_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that differ by one statement, and no others."""
    found = detect.near_misses(detect.extract(_inputs(spark).where("path not like 'order%'"), "fragments", Clones(), LIMITS), 0.85)
    place = lambda n: F.element_at("units", n)["path"]
    return found.select(place(1).alias("a"), place(2).alias("b"), ((F.col("similarity") >= 0.85) & (F.col("similarity") < 1)).alias("alike"), F.array_contains("detectors", "edit_distance").alias("edit"))


@query(rows("file, kind, qualified_name, start_line, end_line, is_test, parameters, return_type", [
    ("items.rs", "mod_item", "outer", 3, 3, False, "", None), ("items.rs", "mod_item", "inner", 4, 4, False, "", None), ("items.rs", "mod_item", "deep", 4, 4, False, "", None), ("items.rs", "mod_item", "checks", 5, 5, True, "", None), ("items.rs", "mod_item", "named", 6, 6, False, "", None),
    ("items.rs", "struct_item", "Pool", 8, 8, False, "", None), ("items.rs", "enum_item", "Kind", 9, 9, False, "", None), ("items.rs", "trait_item", "Draw", 10, 10, False, "", None), ("items.rs", "function_signature_item", "Draw::draw", 10, 10, False, "&self", None), ("items.rs", "function_item", "Draw::twice", 10, 10, False, "&self", None),
    ("items.rs", "function_item", "Pool::draw", 11, 11, False, "&self", None), ("items.rs", "const_item", "LIMIT", 12, 12, False, "", None), ("items.rs", "static_item", "NAME", 13, 13, False, "", None), ("items.rs", "type_item", "Alias", 14, 14, False, "", None), ("items.rs", "macro_definition", "shout", 15, 15, False, "", None),
    ("functions.rs", "function_item", "first", 1, 11, False, "&[T],usize", "Vec<T>"), ("functions.rs", "function_item", "second", 12, 14, False, "&dyn Fn()", "Option<u8>"), ("functions.rs", "function_item", "third", 17, 17, False, "", None), ("functions.rs", "function_item", "checked", 19, 19, True, "", None),
    ("functions.rs", "function_item", "seen", 20, 20, False, "", None), ("functions.rs", "function_item", "main", 21, 21, False, "", None), ("functions.rs", "function_item", "nested", 21, 21, False, "", None),
]))
def planted_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C9, C33, C34."""
    inputs = table(spark, "path string, text string, is_test_path boolean, editable boolean", [(p, t, False, True) for p, t in SOURCES.items() if p not in BROKEN])
    return detect.symbol_index(inputs).select("file", "kind", "qualified_name", "start_line", "end_line", "is_test", F.array_join("parameters", ",").alias("parameters"), "return_type")


@query(rows("same, exact, sequence", [("names", False, True), ("literals", False, True), ("statements in another order", False, False), ("layout", True, True)]))
def planted_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What leaves a function's shape alone, and whether its tokens and its sequence stay equal too."""
    base = "fn f() { a(1); x += 2; let c = d; }"
    data = {
        "names": "fn g() { u(1); v += 2; let z = w; }", "literals": "fn f() { a(3); x += 4; let c = d; }", "statements in another order": "fn f() { x += 2; a(1); let c = d; }", "layout": "fn f()\n{ a(1);\nx += 2; /* x */ let c = d; }",
        "a statement more": "fn f() { a(1); x += 2; e(); let c = d; }", "another operator": "fn f() { a(1); x -= 2; let c = d; }",
    }

    def of(source: str) -> tuple[int, int, int]:
        flat = Flat(source)
        n = next(k for k, node in enumerate(flat.node) if node.kind == "function_item")
        return flat.shape[n], flat.exact(flat.span_leaves(n)), flat.sequence(flat.span_leaves(n))

    first = of(base)
    return table(spark, "same string, exact boolean, sequence boolean", [(k, x[1] == first[1], x[2] == first[2]) for k, s in data.items() if (x := of(s))[0] == first[0]])


SKETCHES = [
    (["fn load() -> u8 { 1 }"] * 2, "function", False, "function", "fn shared_load() -> u8", ""),
    (['fn load() { g("a", 1, 2.5, true) }', 'fn save() { g("b", 2, 3.5, false) }'], "function", False, "function", "fn shared_load(p0: &str, p1: i64, p2: f64, p3: bool)", 'value "a" "b", value 1 2, value 2.5 3.5, value true false'),
    (["fn load() { a(1); b(1); c(2) }", "fn save() { a(7); b(7); c(9) }"], "function", False, "function", "fn shared_load(p0: i64, p1: i64)", "value 1 7, value 2 9"),
    (["fn load() { let x: Aa = f(); }", "fn load() { let x: Bb = f(); }"], "function", False, "generic", "fn shared_load<T0>()", "type Aa Bb"),
    (["fn load() { s.left = 1; }", "fn load() { s.right = 1; }"], "function", False, "macro", "macro_rules! shared_load", "name left right"),
    (["fn load() { a(); }", "fn load() { a(); b(); }"], "function", False, "function", "fn shared_load(p0: impl FnOnce())", "code  b ( ) ;"),
    (["struct Left { a: u8 }", "struct Right { a: u8 }"], "type_shape", False, "shared_type", "struct SharedLeft", ""),
    (["fn load() { if a { b(1) } }", "fn load() { if a { b(2) } }"], "function", True, "recursive", "fn shared_load(p0: i64)", "value 1 2"),
    (['#[inline(always)] #[doc = "y"] #[cfg(unix)] pub(crate) unsafe extern "C" fn load() { a(1) }', '#[inline(always)] #[doc = "y"] #[cfg(unix)] pub(crate) unsafe extern "C" fn save() { a(2) }'], "function", False, "function", "fn shared_load(p0: i64)", "value 1 2"),
    (["set(1);", "set(2);", "set(3);"], "statements", False, "loop", "for p0 in [1, 2, 3]", "value 1 2 3"),
]


@query(rows("n, kind, signature, parameters", [(n, *s[3:]) for n, s in enumerate(SKETCHES)]))
def planted_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of one file each, a copy a line."""
    files = table(spark, "path string, text string", [(f"{n}.rs", "\n".join(s[0])) for n, s in enumerate(SKETCHES)])
    unit = "path:string,start_line:bigint,end_line:bigint,node:int,tokens:bigint,exact:bigint,sequence:bigint,test:boolean,editable:boolean,item:string"
    data = [(n, s[1], s[2], [(f"{n}.rs", k, k, k, 9, 1, 1, False, True, "load") for k in range(1, len(s[0]) + 1)]) for n, s in enumerate(SKETCHES)]
    made = sketch.sketch_groups(table(spark, f"n bigint, fragment string, recursive boolean, units array<struct<{unit}>>", data), files)
    parameters = F.array_join(F.transform("sketch.parameters", lambda p: F.concat(p["kind"], F.lit(" "), F.array_join(p["values"], " "))), ", ")
    return made.select("n", "sketch.kind", "sketch.signature", parameters.alias("parameters"))


# -- scalars, settings, ignore rules
@query(rows("what, value", [
    ("bytes 1023", "1023 B"), ("bytes 1536", "1.5 KiB"), ("bytes 5 MiB", "5.0 MiB"), ("label", "abcd…"), ("path", "…/x.rs"), ("plural 1", ""), ("plural 0", "s"), ("identifier", "some_name"), ("identifier digit", "x_9lives"), ("camel", "SomeName"),
    ("hint string", "&str"), ("hint char", "char"), ("hint float", "f64"), ("hint bool", "bool"), ("hint hex", "i64"), ("language", "C/C++"), ("distance", "1"), ("distance to nothing", "4"), ("hash", "cbf29ce484222325"), ("name", "folder"),
]))
def planted_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F14-F19, F24, F26, F27."""
    tree = [(1, 0), (2, 0), (3, 2), (4, 0)]
    empty = hash_text("")  # the offset of the text's hash, mixed with its length
    offset = 0xCBF29CE484222325
    data = [
        ("bytes 1023", text.human_bytes(1023)), ("bytes 1536", text.human_bytes(1536)), ("bytes 5 MiB", text.human_bytes(5 << 20)), ("label", text.truncate_label("abcdefgh", 5)), ("path", text.truncate_path("src/deep/x.rs", 6)), ("plural 1", text.plural(1)), ("plural 0", text.plural(0)),
        ("identifier", sketch.identifier("someName")), ("identifier digit", sketch.identifier("9lives")), ("camel", sketch.camel("some_name")), ("hint string", sketch.type_hint('"a"')), ("hint char", sketch.type_hint("'a'")), ("hint float", sketch.type_hint("1.5")), ("hint bool", sketch.type_hint("true")), ("hint hex", sketch.type_hint("0x1E")),
        ("distance", str(similarity.edit_distance(tree, [(1, 0), (2, 0), (9, 2), (4, 0)]))), ("distance to nothing", str(similarity.edit_distance(tree, []))), ("hash", f"{offset:016x}" if empty == mix(offset, 0) else "another"), ("name", settings.Config().display_name("/some/folder")),
    ]
    named = table(spark, "k string", [("c",)]).select(F.lit("language").alias("what"), label("k", LANGUAGES).alias("value"))
    return table(spark, "what string, value string", data).unionByName(named)




@query(
    "WITH x AS (SELECT i::UBIGINT AS n FROM range(1, 2001) t(i)), a AS (SELECT n, xor((n * 8388608)::UBIGINT, ((n::UHUGEINT * 3 + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT) AS z FROM x), "
    "b AS (SELECT n, ((xor(z, z >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z FROM a), c AS (SELECT n, ((xor(z, z >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z FROM b) "
    "SELECT n::BIGINT AS n, lpad(lower(printf('%x', xor(z, z >> 31))), 16, '0') AS mixed FROM c"
)
def planted_mixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a number mixed with three times itself."""
    return table(spark, "n bigint, mixed string", [(n, f"{mix(n, 3 * n):016x}") for n in range(1, 2001)])


@query(rows("path, ignored", [("target/a.rs", True), ("src/target/a.rs", True), ("log.txt", True), ("keep/log.txt", False), ("docs/a.md", False), ("docs/deep/b.md", True), ("a/b/c.tmp", True), ("a/keep.tmp", False), ("build", False)]))
def planted_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of one file, later ones winning."""
    return table(spark, "path string, ignored boolean", _ignored())


def _ignored() -> list[tuple[str, bool]]:
    import tempfile
    from pathlib import Path

    with tempfile.TemporaryDirectory() as d:  # the rules are read from a file, on the driver only
        root = Path(d).resolve()
        (root / ".gitignore").write_text("target/\n/log.txt\n/docs/*/\n*.tmp\n!keep.tmp\n# build\n")
        rules = gitignore.Ignore().below(root)
        out = []
        for path in ("target/a.rs", "src/target/a.rs", "log.txt", "keep/log.txt", "docs/a.md", "docs/deep/b.md", "a/b/c.tmp", "a/keep.tmp", "build"):
            parts = path.split("/")
            steps = [(root.joinpath(*parts[: k + 1]), k < len(parts) - 1) for k in range(len(parts))]
            out.append((path, any(rules.ignores(p, is_dir) for p, is_dir in steps)))
        return out


@query(rows("setting, value", [("name", "x"), ("large", "10"), ("huge", "800"), ("exclude", "a/**"), ("notes", "src/*=look:warning"), ("roots", "lib:False"), ("ratio", "1.0"), ("unknown key", "refused"), ("wrong type", "refused"), ("wrong level", "refused"), ("no TOML", "refused")]))
def planted_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings that replace defaults, and what is refused."""
    c = settings.parse('[project]\nname = "x"\n[thresholds]\nlarge_file_lines = 10\nmin_comment_ratio = 1\n[scan]\nexclude = ["a/**"]\n[[notes]]\npath = "src/*"\nnote = "look"\nlevel = "warning"\n[[clones.extra_roots]]\npath = "lib"\n')
    data = [
        ("name", c.project.name), ("large", str(c.thresholds.large_file_lines)), ("huge", str(c.thresholds.huge_file_lines)), ("exclude", ",".join(c.scan.exclude)), ("notes", ",".join(f"{n.path}={n.note}:{n.level}" for n in c.notes)),
        ("roots", ",".join(f"{r.path}:{r.editable}" for r in c.clones.extra_roots)), ("ratio", str(c.thresholds.min_comment_ratio)),
    ]
    for name, bad in {"unknown key": "[scan]\nnope = 1", "wrong type": "[thresholds]\nlarge_file_lines = 'a'", "wrong level": "[[notes]]\nlevel = 'loud'", "no TOML": "a ="}.items():
        try:
            settings.parse(bad)
            data.append((name, "taken"))
        except settings.ConfigError:
            data.append((name, "refused"))
    return table(spark, "setting string, value string", data)
