import random

from srclens.functions.similarity import edit_distance, sequence_distance_within
from srclens.operators import dead_code, dependencies, findings, module_tree
from srclens.operators.components import connected_components
from srclens.operators.rust_files import parse
from tests.conftest import rows


def test_components_against_union_find(spark):
    random.seed(3)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(100 + n, 101 + n) for n in range(30)] + [(5, 5), (7, None)]
    parent = {n: n for n in range(200)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    nodes = {x for a, b in edges if b is not None and a != b for x in (a, b)}
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    assert rows(connected_components(df), "id", "component") == sorted(((n, find(n)) for n in nodes), key=repr)
    assert connected_components(df.limit(0)).count() == 0


def _parsed(spark, sources):
    files = spark.createDataFrame([(p, t, p.startswith("tests/")) for p, t in sources.items()], "file string, text string, is_test_file boolean")
    return parse(files, ["file", "is_test_file"])


def test_dead_code(spark):
    found = dead_code.analyze(_parsed(spark, {"a.rs": "fn orphan() {} fn used() {} fn caller() { used(); } fn main() {}\n#[no_mangle] fn ext() {}", "b.rs": "pub fn open() {}", "tests/t.rs": "fn t() { orphan(); }"}))
    assert rows(found, "name", "confidence") == [("caller", "high"), ("open", "medium"), ("orphan", "high")]


def test_shared_names(spark):
    called = {"a.rs": "fn shared() {} fn main() { shared(); }", "b.rs": "fn shared() {}"}
    assert dead_code.analyze(_parsed(spark, called)).count() == 0
    assert dead_code.analyze(_parsed(spark, {"a.rs": "fn shared() {}", "b.rs": "fn shared() {}"})).count() == 2


def _resolve(spark, sources, manifest='{"package": {"name": "p"}}', disk=()):
    files = spark.createDataFrame(list(sources.items()), "path string, text string")
    packages = spark.createDataFrame([(".", "p", manifest)], "dir string, name string, manifest string")
    on_disk = spark.createDataFrame([(p,) for p in [*sources, *disk]], "path string")
    orphans, tests = module_tree.resolve(packages, parse(files, ["path"]), on_disk)
    return [r.path for r in orphans.orderBy("path").collect()], [r.path for r in tests.orderBy("path").collect()]


def test_module_tree(spark):
    assert _resolve(spark, {"src/lib.rs": "mod used;", "src/used.rs": "fn a() {}", "src/stray.rs": "fn b() {}"}) == (["src/stray.rs"], [])
    nested = {"src/lib.rs": "mod a; mod b; #[cfg(test)] mod t;", "src/a/mod.rs": "mod x;", "src/a/x.rs": "fn f() {}", "src/b.rs": "mod y;", "src/b/y.rs": "fn g() {}", "src/t.rs": "fn h() {}", "src/b/lost.rs": "fn l() {}"}
    assert _resolve(spark, nested) == (["src/b/lost.rs"], ["src/t.rs"])
    named = {"src/lib.rs": '#[path = "odd.rs"] mod a; mod inner { mod deep; } #[cfg_attr(x, path = "c.rs")] mod c;', "src/odd.rs": "fn a() {}", "src/inner/deep.rs": "fn a() {}", "src/c.rs": "fn a() {}"}
    assert _resolve(spark, named) == ([], [])
    assert _resolve(spark, {"src/lib.rs": "mod gone;", "src/stray.rs": "fn b() {}"}, disk=["src/gone.rs"])[0] == []


GRAPH = [("m", True), ("heavy", False), ("leaf", False), ("deep", False)]


def _graph(spark, *edges):
    packages = spark.createDataFrame([(i, i, "1", 100, m) for i, m in GRAPH], "id string, name string, version string, source_bytes bigint, is_workspace_member boolean")
    return packages, spark.createDataFrame([(a, b, "normal") for a, b in edges], "`from` string, `to` string, kind string")


def test_package_graph(spark):
    p, e = _graph(spark, ("m", "heavy"), ("m", "leaf"), ("heavy", "deep"))
    assert dict(rows(dependencies.exclusive_counts(p, e), "id", "exclusive_count")) == {"heavy": 2, "leaf": 1}
    assert dict(rows(dependencies.transitive_counts(p, e), "id", "transitive_count"))["heavy"] == 1
    kept, lost = dependencies.simulate_removal(p, e, spark.createDataFrame([("heavy",)], "id string"))
    assert tuple(kept.first()) == (1, 100) and [r.node for r in lost.collect()] == ["deep", "heavy"]
    p, e = _graph(spark, ("m", "heavy"), ("m", "leaf"), ("heavy", "deep"), ("leaf", "deep"), ("deep", "heavy"))
    assert dict(rows(dependencies.exclusive_counts(p, e), "id", "exclusive_count")) == {"heavy": 1, "leaf": 1}
    assert [(r.node, r.depth) for r in dependencies.subtree(p, e, "m", 1).collect()] == [("m", 0), ("heavy", 1), ("leaf", 1)]


def test_production_graph(spark):
    p, _ = _graph(spark)
    e = spark.createDataFrame([("m", "heavy", "development"), ("m", "leaf", "build"), ("heavy", "deep", "normal")], "`from` string, `to` string, kind string")
    packages, edges = dependencies.production_graph(p, e)
    assert [r.id for r in packages.collect()] == ["leaf", "m"] and rows(edges, "from", "to") == [("m", "leaf")]
    assert dependencies.production_graph(p, e, True)[0].count() == 4


def test_findings_order(spark):
    t = findings.Thresholds()
    df = spark.createDataFrame([("a", 400), ("b", 800), ("c", 399)], "path string, code int").selectExpr(
        "path", "named_struct('code', code, 'comment', 400) lines", "'rust' language", "false is_test",
        "named_struct('todo_markers', 0, 'performance', named_struct('allocations_in_loops', 0, 'nested_loops', 0, 'unwraps', if(path = 'c', 2, 0))) rust")
    got = findings.ranked(findings.file_rules(df, t)).collect()
    assert [(r.rule, r.file) for r in got] == [("huge_file", "b"), ("large_file", "a"), ("panic_path", "c")]
    worst = findings.worst_severity(findings.ranked(findings.file_rules(df, t)), df.select("path"))
    assert dict(rows(worst, "path", "worst")) == {"a": "medium", "b": "high", "c": "medium"}


def test_edit_distance_bound():
    a = [(1, 0), (2, 0), (3, 2), (4, 0)]
    b = [(1, 0), (2, 0), (9, 2), (4, 0)]
    assert edit_distance(a, b) == 1 and edit_distance(a, []) == 4 and edit_distance(a, a) == 0
    assert sequence_distance_within([1, 2, 3], [1, 3], 1) and not sequence_distance_within([1, 2, 3], [4, 5, 6], 2)
