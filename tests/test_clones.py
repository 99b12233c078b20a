import pytest
from pyspark.sql import functions as F

from srclens.clones import detect
from srclens.clones.units import Flat, bands, extend, fragments, histogram, packed, runs, signature, symbols, unpacked
from srclens.config import Clones, Thresholds
from srclens.functions.labels import LANGUAGES, label

LIMITS = Thresholds(duplicate_min_tokens=30, duplicate_min_lines=4, duplicate_similarity=0.85)


def body(*statements):
    return "\n".join(f"    {s}" for s in statements)


def fn(name, *statements):
    return f"fn {name}(a: u8) -> u8 {{\n{body(*statements)}\n    a\n}}\n"


LOOPS = ["let b = one(a);", "if b > 3 { two(b); }", "while three(b) { four(); }", "for c in b.iter() { five(c); }", "six(b, a);", "let d = seven(b)?;", "eight(&d);", "return d.nine();"]
RENAMED = [s.replace("b", "zz").replace("d", "yy") for s in LOOPS]
APART = ["uno(a1);", "if dos { tres(); }", "while cuatro() { cinco[6]; }", "x7 += 8;", "nueve.diez(11, 12);", "for y in z { w(y, y); }"]
TEN = [
    "let m0 = p.q(1).r(s0);", "if t0 < u0 { v0.w0(x0); }", "for c0 in d0.e0() { f0(c0, 2); }", "let g0: Vec<u8> = h0.iter().map(|k0| k0.l0(n0)).collect();", "o0[p0] = q0(r0)?;",
    "match s1 { Some(t1) => u1(t1), None => v1(3, w1), }", "x1 += 4 * y1 - z1;", "while a2.b2() { c2 -= 5; d2(e2); }", "f2!(g2 <= h2, \"i2\");", "let (j2, k2) = (l2(&m2), &mut n2);",
]
BROKEN = ["k.l(m, n, o);", "let = ;", "p.q.r(s, t, u, v);", "let = ;", "w[x] += y * z + 1;", "let = ;", "aa(bb, cc, dd, ee);"]
RUN = ["loop { break; }", "a[0] = b[1];", "c.d().e()?;", "match f { 1 => g(), _ => h() }", "*i += -j;", "let k = |l| l + 1;", "m!(n);", "o as u8;"]


@pytest.fixture(scope="module")
def groups(spark):
    sources = {
        "exact1.rs": fn("left", *LOOPS), "exact2.rs": fn("left", *LOOPS), "renamed.rs": fn("right", *RENAMED),
        "order1.rs": fn("first", *APART), "order2.rs": fn("second", APART[1], APART[0], *APART[2:]),
        "near1.rs": fn("near", *TEN), "near2.rs": fn("near", *TEN[:5], "extra();", *TEN[5:]),
        "run1.rs": fn("r1", "only_here(1, 2, 3, 4, 5);", "there?;", *RUN), "run2.rs": fn("r2", *RUN, *(f"tail{n}.x.y.z = {{ {n} }};" for n in range(9))),
        "types.rs": "struct A {\n    a: u8,\n    b: Foo<Bar>,\n    c: Baz,\n}\nstruct B {\n    d: u8,\n    e: Foo<Bar>,\n    f: Baz,\n}\nstruct C {\n    g: Other,\n    h: Foo,\n    i: Baz,\n}\n",
        "broken.rs": "fn broken() {\n" + body(*BROKEN) + "\n}\nfn broken2() {\n" + body(*BROKEN) + "\n}\n",
    }
    df = spark.createDataFrame([(p, t, False, p != "exact2.rs") for p, t in sources.items()], "path string, text string, is_test_path boolean, editable boolean")
    found = detect.detect(df, Clones(), LIMITS)
    return [(sorted({u.path for u in g.units}), g) for g in detect.suppress(detect.score(found, F.lit(0)), 500).collect()]


def of(groups, *paths):
    return [g for p, g in groups if set(paths) <= set(p)]


def test_groups(groups):
    (same,) = of(groups, "exact1.rs", "exact2.rs", "renamed.rs")
    assert (same.kind, same.fragment, same.copies, same.read_only) == ("renamed", "function", 3, True)
    (order,) = of(groups, "order1.rs", "order2.rs")
    assert order.kind == "near_miss" and order.reordered
    (near,) = of(groups, "near1.rs", "near2.rs")
    assert near.kind == "near_miss" and near.detectors == ["min_hash", "edit_distance"] and 0.85 <= near.similarity < 1
    assert any(g.fragment == "statements" and g.copies == 2 for g in of(groups, "run1.rs", "run2.rs"))
    (types,) = of(groups, "types.rs")
    assert types.fragment == "type_shape" and types.kind == "renamed" and types.copies == 2
    assert not [g for g in of(groups, "broken.rs") if g.fragment == "function"]
    assert len({g.id for _, g in groups}) == len(groups) and [g.rank for _, g in groups] == sorted(g.rank for _, g in groups)


def test_units():
    flat = Flat("#[cfg(test)]\nmod t { fn x() {} }\nimpl Clone for P { fn y(&self, a: f64, b: &Q) -> P { Q::z(a) } }\ntrait T { fn w(); }\nconst C: u8 = 1;\nmacro_rules! m { () => {} }\n")
    got = {s["qualified_name"]: s for s in symbols(flat)}
    assert set(got) == {"t", "x", "P::y", "T", "T::w", "C", "m"} and got["x"]["is_test"] and not got["C"]["is_test"]
    assert got["P::y"]["parameters"] == ["&self", "f64", "&Q"] and got["P::y"]["return_type"] == "P" and "z" in got["P::y"]["identifiers"]
    assert fragments(Flat(""), frozenset(["function"]), 1, 1) == [] and runs(Flat(""), 1, 1) == []
    assert len(signature([1, 2, 3])) == 32 and len(bands(signature([]))) == 8


def run_groups(spark, sources):
    """Layer 2 alone: places (path, first line, last line) of each group."""
    df = spark.createDataFrame([(p, t, False, True) for p, t in sources.items()], "path string, text string, is_test_path boolean, editable boolean")
    found = detect.repeated_runs(detect.extract(df, "runs", Clones(), LIMITS)).collect()
    return [sorted((u.path, u.start_line, u.end_line) for u in g.units) for g in found]


SHORT = "".join(f"fn s{n}(a: u8) -> u8 {{ a + {n} }}\n" for n in range(6))


def test_runs_at_file_edges(spark):
    heads = run_groups(spark, {"a.rs": SHORT + "static A: u8 = 1;\n", "b.rs": SHORT + "enum B { C }\nconst D: u8 = 2;\n"})
    assert [("a.rs", 1, 6), ("b.rs", 1, 6)] in heads
    tails = run_groups(spark, {"a.rs": "static A: u8 = 1;\n" + SHORT, "b.rs": "enum B { C }\n" + SHORT})
    assert [("a.rs", 2, 7), ("b.rs", 2, 7)] in tails
    assert [("a.rs", 1, 6), ("b.rs", 1, 6)] in run_groups(spark, {"a.rs": SHORT, "b.rs": SHORT})


LETS = "".join(f"    let v{n} = w{n}.x(y{n}, {n});\n" for n in range(6))
ARGUMENTS = "".join(f"        a{n} + {n} * b{n}.c(),\n" for n in range(6))
MATCH = "match m {\n" + "".join(f"        {n} => o.p{n}(q, {n}),\n" for n in range(6)) + "    }"


def test_run_kinds(spark):
    lets = {"a.rs": f"fn f() {{\n    one();\n{LETS}    loop {{}}\n}}\n", "b.rs": f"fn g() {{\n    x += 1;\n{LETS}    return;\n}}\n"}
    assert [("a.rs", 3, 8), ("b.rs", 3, 8)] in run_groups(spark, lets)
    calls = {"a.rs": f"fn f() {{\n    one(\n        z,\n{ARGUMENTS}        7,\n    );\n}}\n", "b.rs": f"fn g() {{\n    x += two(\n        !z,\n{ARGUMENTS}        &k,\n    );\n}}\n"}
    assert [("a.rs", 4, 9), ("b.rs", 4, 9)] in run_groups(spark, calls)
    single = {"a.rs": f"fn f() {{\n    let k = {MATCH};\n}}\n", "b.rs": f"fn g() -> u8 {{\n    1 + {MATCH}?\n}}\n"}
    assert [("a.rs", 2, 9), ("b.rs", 2, 9)] in run_groups(spark, single)
    uses = "".join(f"use a{n}::b{n}::c{n}::d{n};\n" for n in range(9))
    assert run_groups(spark, {"a.rs": uses + "fn f() {}\n", "b.rs": uses + "struct S;\n"}) == []


def test_long_lists(spark):
    table = f"static T: [u8; 400] = [\n{''.join(f'    {n},{chr(10)}' for n in range(400))}];\n"
    (row,) = runs(Flat(table), 30, 4, "a.rs")
    found = extend("a.rs", True, False, 4, row["segments"], row["seeds"])
    longest = {f["n"]: [(u["start_line"], u["end_line"]) for u in f["units"]] for f in found}
    assert longest[201] == [(2, 201), (202, 401)] and sum(len(f["units"]) for f in found) < 5000


def test_large_buckets(spark):
    pairs = detect.lsh_pairs(spark.createDataFrame([(f"k{n:02}", "function", n, 100, 200, [7], [], []) for n in range(40)], "key string, fragment string, shape bigint, tokens bigint, nodes bigint, bands array<bigint>, kinds array<smallint>, words array<smallint>"))
    assert pairs.count() == 40 * 39 // 2
    sources = {f"a{n:02}.rs": fn("near", *TEN) for n in range(34)} | {f"b{n}.rs": fn("near", *TEN[:5], "extra();", *TEN[5:]) for n in range(2)}
    df = spark.createDataFrame([(p, t, False, True) for p, t in sources.items()], "path string, text string, is_test_path boolean, editable boolean")
    (group,) = detect.near_misses(detect.extract(df, "fragments", Clones(), LIMITS), 0.85).collect()
    assert sorted(u.path for u in group.units) == sorted(sources) and 0.85 <= group.similarity < 1


def test_pairs_come_once(spark, monkeypatch):
    for name in ("BLOCK", "PLAIN_BLOCK"):
        monkeypatch.setattr(detect, name, 4)
    bands = [[k % 3, k % 5 + 7, k] if k % 4 else [0, 0, 0] for k in range(30)]
    schema = "key string, fragment string, shape bigint, tokens bigint, nodes bigint, tree binary, sig array<bigint>, bands array<bigint>, kinds array<int>, words array<int>"
    df = spark.createDataFrame([(f"k{k:02}", "function", k % 29, 100, 600, packed([], [], [7] * 600), [1, 2], b, [], []) for k, b in enumerate(bands)], schema)
    want = [(f"k{a:02}", f"k{b:02}") for a in range(30) for b in range(a + 1, 30) if a % 29 != b % 29 and any(x == y for x, y in zip(bands[a], bands[b]))]
    for found in (detect.lsh_pairs(df), detect.alike_pairs(df, 0.5)):
        assert sorted((r.a, r.b) for r in found.collect()) == want
    plan = detect.lsh_pairs(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [a#" not in plan and "InPandas" not in plan


def test_alike_pairs_move_no_pairs(spark):
    trees = [[1, 2, 3, 4, 5, 6, 7, 8, 9, n] for n in (10, 11, 12)] + [[21, 22, 23, 24, 25, 26, 27, 28, 29, 30]]
    for labels in trees:
        assert unpacked(packed(labels, list(range(10)), [2**63 + 5, 3, 3])) == (labels, list(range(10)), {2**63 + 5: 1, 3: 2})
    schema = "key string, fragment string, shape bigint, tokens bigint, nodes bigint, tree binary, sig array<bigint>, bands array<bigint>, kinds array<int>, words array<int>"
    df = spark.createDataFrame([(f"k{k}", "function", k, 30, 10, packed(t, list(range(10)), [3] * 10), [], [5, 6], histogram([3] * 10), histogram(t)) for k, t in enumerate(trees)], schema)
    found = detect.alike_pairs(df, 0.85)
    assert sorted(found.collect()) == [("k0", "k1", 0.9, True), ("k0", "k2", 0.9, True), ("k1", "k2", 0.9, True)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan.split("MapInArrow")[0] and "Join" not in plan.split("MapInArrow")[0]


def test_nested_members(spark):
    members = spark.createDataFrame([("x1", "x", "f", 1, 20), ("y1", "y", "f", 2, 19), ("x2", "x", "g", 1, 20), ("y2", "y", "g", 2, 19)], "key string, rep string, path string, start_line bigint, end_line bigint")
    sure = spark.createDataFrame([("x", "y", 0.9, True)], "a string, b string, similarity double, edit boolean")
    assert sorted((r.a, r.b) for r in detect.links(sure, members).collect()) == [("x1", "y2"), ("x2", "y1")]


def test_labels(spark):
    df = spark.createDataFrame([("c",), ("type_alias",)], "k string")
    assert [r.n for r in df.select(label("k", LANGUAGES).alias("n")).collect()] == ["C/C++", "type alias"]
