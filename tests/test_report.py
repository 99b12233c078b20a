import json

import pandas as pd
import pytest

from srclens import cli
from srclens.clones.sketch import sketch
from srclens.plans import base, catalogue, graphs, groups, measured, planted, report, summary, views  # noqa: F401
from srclens.sources.repo import ScanError, discover, scan
from srclens.config import Scan

BODY = "\n".join(f"    let v{n} = g{n}(a, b); h(v{n});" for n in range(8))
FILES = {
    "src/lib.rs": "//! doc\nmod used;\npub fn a() { used::go(); }\n", "src/used.rs": f"pub fn go() {{ if x {{ y(); }} }}\nfn first(a: u8, b: u8) -> u8 {{\n{BODY}\n    a\n}}\nfn second(a: u8, b: u8) -> u8 {{\n{BODY}\n    a\n}}\n",
    "src/stray.rs": "fn lost() { x.unwrap(); }", "tests/t.rs": "#[test] fn t() {}", "Cargo.toml": '[package]\nname = "p"\n', "src/bad.rs": "fn (", "src/_odd.rs": "", ".gitignore": "/gen\n*.log\n!keep.log\n", "gen/a.rs": "", "a.log": "", "keep.log": "",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("proj")
    for p, t in FILES.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    (root / "src/latin.rs").write_bytes(b"\xff\xfe")
    return root


@pytest.fixture(scope="module")
def made(spark, tree):
    return report.analyze(spark, str(tree), now=0)


def test_scan(spark, tree, tmp_path):
    got = {r.relative_path: r for r in scan(spark, str(tree)).collect()}
    assert sorted(got) == ["Cargo.toml", "keep.log", "src/_odd.rs", "src/bad.rs", "src/latin.rs", "src/lib.rs", "src/stray.rs", "src/used.rs", "tests/t.rs"]
    assert got["src/latin.rs"].text is None and got["src/latin.rs"].bytes == 2 and got["tests/t.rs"].is_test_path
    assert "gen/a.rs" in [x[0] for x in discover(str(tree), Scan(respect_gitignore=False))]
    with pytest.raises(ScanError):
        discover(str(tree / "nowhere"), Scan())
    assert scan(spark, str(tmp_path)).count() == 0


def test_report(made):
    found = {(r.rule, r.file) for r in made.findings.collect()}
    assert {("orphan_file", "src/stray.rs"), ("parse_failure", "src/bad.rs"), ("panic_path", "src/stray.rs"), ("duplicate_code", "src/used.rs")} <= found
    group = made.clones.collect()
    assert len(group) == 1 and group[0].kind == "renamed" and group[0].copies == 2
    assert views.totals(made).first().files == 9 and views.totals(made, True).first().functions == 5
    assert [r.name for r in views.dead_code(made, text="first").collect()] == ["first"]
    assert "duplicate" not in summary.render(made) and "Copies" in summary.render(made)


def test_round_trip_and_determinism(spark, tree, made):
    text = made.to_json()
    assert report.read(text)["totals"]["files"] == 9
    assert report.read("{}")["clones"] == []
    again = report.analyze(spark, str(tree), now=0).to_json()
    drop = lambda s: json.dumps(json.loads(s), sort_keys=True)
    assert drop(again) == drop(text)


def test_cli(spark, tree, tmp_path, capsys):
    out = tmp_path / "symbols"
    assert cli.main([str(tree), "-o", "symbols", "--write", str(out)]) == 0
    names = [json.loads(x)["qualified_name"] for x in out.read_text().splitlines()]
    assert {"a", "first", "second", "lost", "t"} <= set(names)
    assert cli.main([str(tree / "nowhere")]) == 1
    assert "srclens:" in capsys.readouterr().err


def test_sketches():
    one = lambda sources, spans=None, fragment="function": sketch(sources, spans or [("a", 1, 1), ("b", 1, 1)], ["load", "load"], fragment, False)
    assert one(["fn load() -> u8 { 1 }"] * 2)["signature"] == "fn shared_load() -> u8"
    assert one(["fn load() { g(\"a\", 1, 1.0, true, 'x') }", "fn load2() { g(\"b\", 2, 2.0, false, 'y') }"])["signature"] == "fn shared_load(p0: &str, p1: i64, p2: f64, p3: bool, p4: char)"
    assert "impl FnOnce()" in one(["fn load() { a(); }", "fn load() { a(); b(); }"])["signature"]
    assert one(["fn load() { let x: Aa = f(); }", "fn load() { let x: Bb = f(); }"])["kind"] == "generic"
    rows = [f"set({n});" for n in range(1, 6)]
    assert one(rows, [("a", n, n) for n in range(1, 6)], "statements")["signature"] == "for p0 in [1, 2, 3, 4, …]"


@pytest.fixture(scope="module")
def con():
    import duckdb

    from tests.conftest import DATA

    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(base.oracle_sql()))
def test_queries_match_sql(spark, con, name):
    from tests.conftest import DATA

    want = con.sql(base.oracle_sql()[name]).df()
    got = base.queries()[name](spark, str(DATA)).toPandas()
    order = sorted(want.columns)
    cell = lambda v: None if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else bool(v) if hasattr(v, "dtype") else v
    norm = lambda df: sorted(repr([cell(v) for v in r]) for r in df[order].astype(object).values.tolist())
    assert sorted(got.columns) == order and norm(got) == norm(want)


@pytest.mark.parametrize("name", sorted(set(base.queries()) - set(base.oracle_sql()) - {"clone_groups"}))
def test_queries_without_sql_run(spark, name):
    from tests.conftest import DATA

    assert base.queries()[name](spark, str(DATA)).count() > 0
