"""Problems 1, 2 and 5: origin, syntax and documentation of source files."""

import pytest

from srclens.llm import code_origin, doc_pairs, ecmascript, lexer_states, source_syntax
from tests.conftest import rows

FILES = "file_id bigint, repo string, relative_path string, text string, ext string, line int, origin string"


def files(spark, *data):
    """With columns whose names clash with inner ones."""
    return spark.createDataFrame([(n, *x, "x", 1, "y") for n, x in enumerate(data, 1)], FILES)


def table(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


BAD = {"rs": "fn f( {", "py": "def f(:\n", "js": "function (", "json": "{,}", "toml": "a = 1\na = 2"}
GOOD = {"rs": "fn f() {}", "py": "def f(): pass\n", "js": "export const f = () => {};", "json": '{"a": [1, null]}', "toml": "a = 1"}


@pytest.mark.parametrize("ext", BAD)
def test_each_language(ext):
    assert source_syntax.check(ext, BAD[ext]) and source_syntax.check(ext, GOOD[ext]) is None
    assert (source_syntax.check(ext, "") is None) == (ext != "json")


@pytest.mark.parametrize("text", ["NaN", "[1,]", "01", "'a'", '"\t"', "{\"a\":1} x", "[" * 3000, "﻿1"])
def test_strict_json(text):
    assert source_syntax.check("json", text)


@pytest.mark.parametrize(("ext", "text", "line"), [
    ("rs", "fn a() {}\n\nfn b() { x) }\n", 3), ("rs", "fn a() {}\nlet x = 1;\nfn b() {}", 2), ("rs", "fn a() {\n\n", 1), ("rs", "fn a() {}\n// c\nfn b() { \u201cx\u201d }", 3), ("py", "x = 1\ny = (\n", 2),
    ("js", "a;\nb c\n", 2), ("json", "{\n,}", 2), ("toml", "a = 1\nb =\n", 2),
])
def test_line_of_failure(ext, text, line):
    assert source_syntax.check(ext, text)[0] == line


def test_deep_and_long_texts_are_judged():
    assert source_syntax.check("json", "[" * 100_000 + "]" * 100_000) is None
    assert source_syntax.check("json", "1" * 10_000) is None
    assert source_syntax.check("rs", "fn f() { x(); }\n" * 30_000) is None
    assert source_syntax.check("js", "f(1);\n" * 30_000) is None
    assert source_syntax.check("py", "x = 1\0\n")


STATES = {
    "rs": [
        """fn f() { "a\n}\n" }\n/* x\n /* { */\n } */ fn g() {\n r##"\n"# }"##; '{'; b'"'; 'a: loop {}\n}\n""",
        'fn f() {\n "a\n}\n', "/* a\n/* b\n*/ fn f() {}", 'r#"\n"\nfn f() {}', "fn f() {\n)\n}",
    ],
    "py": [
        '''x = """\n(\n""" + 'a\\\n('\ny = f"{x['a']:{w}}{{" + f\'\'\'{\n[1, f"{2}"]\n}\'\'\'\n# (\nz = (1,\n 2)\nf"\\N{EM DASH}{x!r:>{y}}"\n''',
        "x = '''\n", "y = (\n1\n", "z = 'a\n'", 'f"{a"\n', "a = ]\n",
    ],
    "toml": ["""a = [\n1, # ]\n'''\n['''\n]\nb = \"\"\"\n]\n\"\"\"\nc = 'a\\'\n""", 'a = """\n', "a = [\n", "a = 'b\n"],
    "json": ['{"a": [\n"]", "\\"["\n]}\n', '{"a\n": 1}', "[\n{]\n"],
}


@pytest.mark.parametrize("ext", STATES)
def test_lexer_states(ext):
    """However a text is cut and its chunks are put together, the result is that of the whole."""
    good, *bad = STATES[ext]
    assert source_syntax.check(ext, good) is None and lexer_states.open_or_unbalanced(ext, good) < 0
    assert all(lexer_states.open_or_unbalanced(ext, text) >= 0 for text in bad)
    for text in STATES[ext]:
        whole = lexer_states.reduced(ext, [text])
        for size in range(1, len(text) + 1):
            parts = list(lexer_states.chunks(text, size))
            assert "".join(parts) == text
            maps = [lexer_states.StateMap(lambda state, part=part: lexer_states.lex(ext, part, state)) for part in parts]
            right = maps[-1]
            for m in reversed(maps[:-1]):
                right = m.then(right)
            for got in (lexer_states.reduced(ext, parts), right(())):
                assert (got.bad >= 0) == (whole.bad >= 0) and (whole.bad >= 0 or got == whole)


DEEP = 10_000


@pytest.mark.parametrize(("ext", "before", "inside", "after", "rest"), [
    ("js", "x = ", "(", "1", ")"), ("js", "x = ", "[", "", "]"), ("js", "", "f(", "", ")"), ("js", "if (a) b();", " else if (c) d();", "", ""), ("js", "", "function f(){", "", "}"), ("js", "x = ", "a => ", "1", ""),
    ("rs", "const X: u8 = ", "(", "1", ")"), ("rs", "fn f() {", "f(", "", ")"), ("rs", "fn f() { if a { b() }", " else if c { d() }", "", ""), ("rs", "static X: ", "Vec<", "u8", ">"), ("rs", "", "mod a {", "", "}"), ("rs", "const X: bool = ", "!", "a", ""),
    ("toml", "a = ", "[", "", "]"), ("toml", "a = ", "{b = ", "1", "}"), ("json", "", "[", "", "]"), ("py", "x = ", "a + ", "a", ""),
])
def test_nesting_of_any_depth(ext, before, inside, after, rest):
    ends = {"const": ";", "static": ";", "fn": "}"}
    end = ends.get(before.split(" ")[0], "") if ext == "rs" else ""
    if before.startswith("static"):
        end = " = a;"
    assert source_syntax.check(ext, before + inside * DEEP + after + rest * DEEP + end) is None
    if rest:
        assert source_syntax.check(ext, before + inside * DEEP + after + rest * (DEEP - 1) + end)


@pytest.mark.parametrize(("text", "ok"), [
    ("a\nb", True), ("a b", False), ("return 1", False), ("let x = /a[/]b/g.test(y) / 2;", True), ("x = `a${b ? `c` : {d: 1}.d}e`", True), ("for (const [a, {b = 1}] of c) d: { break d }", True),
    ("class A extends B { #x = 1; static { } get y() { return this.#x } async *z() { yield* a } }", True), ("({a = 1})", False), ("({a = 1} = b)", True), ("a ? (b, c) => d : e => ({})", True), ("import a, * as b from 'c'; export { b as default }", True),
    ("with (a) b", False), ("010", False), ("const a;", False), ("async () => { await 1 }; await 2", True), ("a => {} ()", False), ("1 = 2", False), ("new.target", True), ("if (a) function b() {}", False), ("'\\08'", False), ("a?.b`c`", False), ("do x(); while (y) z()", True), ("", True),
])
def test_ecmascript(text, ok):
    assert ecmascript.parses(text) is ok


def test_failures_over_tables(spark):
    df = files(spark, ("r", "a.rs", BAD["rs"]), ("r", "b.RS", GOOD["rs"]), ("r", "c.json", ""), ("r", "d.rs", None), ("r", "e.md", BAD["rs"]), ("r", None, "x"), ("r", "rs", "fn ("), ("r", "d/.rs", "fn ("))
    df = df.unionByName(df)
    assert [r[0] for r in rows(source_syntax.failures(df), "file_id")] == [1, 3]
    log = table(spark, "repo string, path string", ("r", "./a.rs"), ("r", "\\b.rs"), ("r", "/any/where/A.rs"), (None, None))
    got = {r.language: r for r in source_syntax.rates(df, log, source_syntax.failures(df)).collect()}
    assert (got["rs"].files, got["rs"].failing, got["rs"].failing_in_log, got["json"].rate) == (2, 1, 1, 1.0)
    assert source_syntax.failures(df.limit(0)).count() == 0


SAYS = '"""Says something about what the caller may expect."""'
RUST = '''
/// Takes the first record and hands it over to nobody.
#[inline]
pub(crate) fn documented(a: u8) -> u8 { a }
// Takes the first record and hands it over to nobody.
fn plain() {}
impl<T> fmt::Display for Gauge<T> {
    /** Writes all five of the small words that are here. */
    unsafe fn show(&self) {}
    #[doc = "The show function."]
    fn trivial(&self) {}
}
trait A {
    /// Says something about what the caller may expect.
    fn open(&self);
    /// Says something about what the caller may expect.
    fn given(&self) { fn inner() {} }
}
macro_rules! m { () => { /// Says something about what the caller may expect.
 fn hidden() {} } }
const S: &str = "/// Says something about what the caller may expect.\\nfn text() {}";
/// Says something about what the caller may expect.
struct X;
fn after() {}
'''
PYTHON = '''
class Outer:
    class Inner:
        async def method(self):
            """Says something about what the caller may expect."""
    def method(self):
        "method"
        def nested():
            r"""Says something about what the caller may expect."""
if x:
    def branch():
        """Says something about what the caller may expect."""
    f = lambda: 0
'''
SCRIPT = '''
/** Says something about what the caller may expect. */
export default async function* gen() {}
/* Says something about what the caller may expect. */
function plain() {}
/** Says something about what the caller may expect. */
const assigned = function () {};
class Box extends Base {
  /**
   * @param first
   * @param second
   */
  bare(first, second) {}
  /** Says something about what the caller may expect. */
  static async [Symbol.x]() {}
  /** Says something about what the caller may expect. */
  get size() { return "/** no */ function no() {}"; }
  field = { /** Says something about what the caller may expect. */ method() {} };
}
'''


def test_documented_functions(spark):
    df = files(spark, ("r", "a.rs", RUST), ("r", "b.py", PYTHON), ("r", "c.js", SCRIPT), ("r", "d.rs", RUST + "fn ("), ("r", "e.py", None), ("r", "f.js", ""))
    got = rows(doc_pairs.pairs(df.unionByName(df)), "file_id", "qualified_name")
    assert got == [(1, "Gauge::show"), (1, "documented"), (1, "given"), (2, "Inner::method"), (2, "branch"), (2, "nested"), (3, "Box::size"), (3, "gen")]
    assert doc_pairs.pairs(df.limit(0)).count() == 0
    index = table(spark, "repo string, file string, qualified_name string, kind string, start_line bigint, end_line bigint", ("r", "a.rs", "documented", "function_item", 4, 4))
    assert {r.qualified_name: r.kind for r in doc_pairs.guided(df, index).where("file_id = 1").collect()}["documented"] == "function_item"


def test_python_functions_of_a_file_too_deep_for_a_tree():
    text = f"class A:\n    def f(self):\n        {SAYS}\nx = {'+'.join(['1'] * 20_000)}\ndef g(): {SAYS}\n"
    assert [q for _, q, _ in doc_pairs.functions("py", text)] == ["A::f", "g"]


@pytest.mark.parametrize(("text", "found"), [
    ('def f() -> lambda x: {1: 2}: "a" "b"; pass', [("f", "ab")]), ('class A:\n  def f(self): ("c"\n "d")\n  if x:\n    def g(self):\n\n      # e\n      u"e"', [("A::f", "cd"), ("g", "e")]),
    ('def f():\n  f"a"', []), ('def f():\n  b"a"', []), ('def f():\n  "a".x', []), ('def f():\n  ("a",)', []), ('def f():\n  "a" f"b"', []), ('def f():\n  "a" + "b"', []), ('def f():\n  "a" \\\n  "b"\n', [("f", "ab")]),
    ('x = f"{a["k"]:{w}} {{def}} {f\'{b!r:>{n}}\'}"\ndef g():\n  r"\\d"', [("g", "\\d")]), ('y = 1 if"a"else"b"\nclass A[T: (int, str)](B):\n\tasync def \\\n m(self, x=lambda: {":"}) -> "T":\n\t\t"d"', [("A::m", "d")]),
    ('def f():\r\n  """a\r\nb"""\r\n  return "x"\rdef g(): "c"\r', [("f", "a\nb"), ("g", "c")]), ('x = """\ndef f():\n  "a"\n"""  # def g(): "a"', []), ('\x0cdef \ufb01():\n  \x0c "a"', [("fi", "a")]), ("", []),
])
def test_python_functions(text, found):
    assert [(q, d) for _, q, d in doc_pairs.functions("py", text)] == found


@pytest.mark.parametrize(("name", "doc", "ok"), [
    ("f", "one two three four five", True), ("f", "one two three four", False), ("read_all", "The read ALL function now is one two", False), ("f", "one_two_three_four_five", True), ("f", "", False),
    ("f", "@param count\nThe number of\n@param a is b", True), ("f", "@param count\n@param a", False),
])
def test_trivial_documentation(name, doc, ok):
    assert doc_pairs.says_something(name, doc) is ok


UPSTREAM = "upstream_id bigint, library string, relative_path string, text string, version string"
LICENCE = "".join(f"// Clause {w} of a licence that nobody reads to its end.\n" for w in "abcdefghijklmnopqrstuvwxyz" * 3)
HAND = "use a::b;\n\nfn walk_over_everything(first: u64) -> u64 {\n    let total = first + 1;\n    total\n}\n"
LIBRARY = "".join(f"pub fn library_function_{w}(value: u64) -> u64 {{\n    compute_the_{w}(value) + offset_of_{w}\n}}\n" for w in "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split())


@pytest.mark.parametrize(("text", "origin"), [
    (HAND, ""), ("", ""), ("// Code generated by x 1.2. DO NOT EDIT.\n" + HAND, "generated"), ("/*\n * Automatisch erzeugt aus x, nicht von Hand ändern\n */\n" + HAND, "generated"), ('"""@generated by x"""\nx = 1\n', "generated"),
    (LICENCE + "// @generated by x. DO NOT EDIT.\n" + HAND, "generated"), ("#![allow(dead_code)]\n" + LICENCE + "#![no_std]\n// Code generated by x.\n" + HAND, "generated"), ("// Generated from the schema next door\n" + HAND, "generated"),
    ("// This parser is not generated by a tool.\n" + HAND, ""), ("// Code generated by x is elsewhere, this is written by hand.\n" + HAND, ""), ("// Don\'t change before the release is out\n" + HAND, ""),
    ("".join(f"const ID_{10**20 + n * 10**19}: u8 = 1;\n" for n in range(9)) + HAND * 9, ""), (HAND + "// Code generated by x. DO NOT EDIT.\n", ""), ('let header = "// @generated, DO NOT EDIT";\n' + HAND, ""),
    ("".join(f"pub const TABLE_{n:03}: u32 = {n * 7919};\n" for n in range(30)), "generated"), ("".join(f"pub fn get_{w}_{n}(m: &Raw) -> u64 {{\n    m.slot({n})\n}}\n" for w in ("one", "two") for n in range(12)), "generated"), ("static B: [u8; 300] = [\n" + ("    12, 200, 7, 45, 99, 1,\n" * 50) + "];\n", "data"), ("static B: [u8; 6] = [12, 200, 7, 45, 99, 1];\n" + HAND, ""),
    ('const X: &str = "' + "aGVsbG8gd29ybGQ" * 40 + '";\n', "data"), ("var a=1;function b(c){return c+a}" * 20, "minified"), (HAND + "    let x = " + " + ".join(["some_value"] * 60) + ";\n", ""),
])
def test_origin_by_text(text, origin):
    assert code_origin.origin(text) == origin


def _origins(spark, data, inputs=(), upstream=()):
    given = table(spark, "file_id bigint, editable boolean", *inputs) if inputs else spark.createDataFrame([], "file_id bigint, editable boolean")
    up = "upstream_id bigint, library string, relative_path string, text string"
    lib = table(spark, up, *upstream) if upstream else spark.createDataFrame([], up)
    df = files(spark, *data)
    return dict(rows(code_origin.not_hand_written(df.unionByName(df), given, lib), "file_id", "origin"))


def test_vendored(spark):
    changed = LIBRARY.replace("offset_of_beta", "offset_of_something").replace("    ", "\t")
    data = [("r", "src/a.rs", HAND), ("r", "src/deep/b.rs", "// mine now\n" + changed), ("r", "vendor/x/c.rs", HAND + "fn c() {}\n"), ("r", "vendor/x/d.rs", HAND + "fn d() {}\n"), ("r", "deps/e.rs", "// oaklib 1.2.3\n" + HAND + "fn e() {}\n"), ("r", "f.md", LIBRARY), ("r", "g.rs", None), ("r", None, HAND)]
    got = _origins(spark, data, [(3, False), (3, True), (1, False), (4, None)], [(1, "lib", "src/l.rs", LIBRARY), (2, "lib", "src/m.rs", None)])
    assert got == {2: "vendored", 3: "vendored", 5: "vendored"}


def test_shared_subtrees(spark):
    """A directory that two repositories have is found by its hash alone: names below it count, its own doesn't, nor do files without code."""
    own = lambda w: HAND.replace("walk", w)
    data = [
        ("one", "x/lib/a.rs", own("aa")), ("one", "x/lib/sub/b.rs", own("bb")), ("two", "other/a.rs", "// licence\n" + own("aa")), ("two", "other/sub/b.rs", own("bb")), ("two", "other/notes.py", "# only a comment\n"),
        ("one", "x/c.rs", own("cc")), ("two", "d.rs", own("dd")), ("one", "e/a.rs", own("ee")), ("one", "e/b.rs", own("ff")), ("two", "g/a1.rs", own("ee")), ("two", "g/b1.rs", own("ff")),
        ("one", "h/a.py", "# one\n"), ("one", "h/b.py", "# two\n"), ("two", "h/a.py", "# one\n"), ("two", "h/b.py", "# two\n"),
    ]
    assert _origins(spark, data) == {1: "vendored", 2: "vendored", 3: "vendored", 4: "vendored"}
    found = code_origin.evidence(files(spark, *data), spark.createDataFrame([], "file_id bigint, editable boolean"), spark.createDataFrame([], UPSTREAM))
    assert {r.evidence for r in found.collect()} == {"directory"}


def test_subtrees_of_versions(spark):
    """A directory of one version of a library, of files too short to tell by themselves."""
    short = lambda w: f"pub fn {w}(value: u64) -> u64 {{\n    value\n}}\n"
    upstream = [(n, "lib", f"src/{f}.rs", short(f"{f}_of_version_{v}"), v) for n, (f, v) in enumerate([("a", "1"), ("b", "1"), ("a", "2"), ("b", "2"), ("c", "2")])]
    data = [("r", "mine/a.rs", short("a_of_version_1")), ("r", "mine/b.rs", short("b_of_version_1")), ("r", "other/a.rs", short("a_of_version_1")), ("r", "other/b.rs", short("b_of_version_2"))]
    given = spark.createDataFrame([], "file_id bigint, editable boolean")
    found = code_origin.not_hand_written(files(spark, *data), given, table(spark, UPSTREAM, *upstream))
    assert rows(found, "file_id", "origin") == [(1, "vendored"), (2, "vendored")]


def test_one_block_in_many_files(spark):
    """A line that 30,000 files and every library have makes no copy, and meets no partner."""
    many = spark.range(30_000).selectExpr("id file_id", "'r' repo", "concat('a/', id, '.py') relative_path", "concat('from common_library_name import everything_of_it\n', 'value_of_this_file_only = ', id, '\n') text")
    upstream = [(n, f"lib{n % 3}", f"u{n}.py", "from common_library_name import everything_of_it\n" + "".join(f"library_value_{n}_{k} = compute({k})\n" for k in range(9)), "1") for n in range(40)]
    assert code_origin.not_hand_written(many, spark.createDataFrame([], "file_id bigint, editable boolean"), table(spark, UPSTREAM, *upstream)).count() == 0


def test_empty_tables(spark):
    assert code_origin.not_hand_written(spark.createDataFrame([], FILES), spark.createDataFrame([], "file_id bigint, editable boolean"), spark.createDataFrame([], "upstream_id bigint, library string, relative_path string, text string")).count() == 0
