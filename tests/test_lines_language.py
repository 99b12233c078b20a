import pytest

from srclens.functions.language import comment_ratio, language
from srclens.operators import lines as L

CASES = [
    ("rust", "", (0, 0, 0, 0)), ("rust", "\n", (1, 0, 0, 1)), ("rust", "mod kept;", (1, 1, 0, 0)), ("rust", "mod kept;\n\t\n//\n", (3, 1, 1, 1)),
    ("rust", "use a;\t//! tail\n\t// head\n", (2, 1, 1, 0)), ("rust", "/** one\n\n\ttwo */\nmod m;\n", (4, 1, 3, 0)), ("rust", "/*\n/* inner */\nouter */ mod m;\n", (3, 1, 2, 0)),
    ("rust", "\t/* a */ /* b */ mod m;\n", (1, 1, 0, 0)), ("rust", "mod m; /* opens\n\n", (2, 1, 1, 0)), ("rust", "mod m; /* x */ // y\n", (1, 1, 0, 0)),
    ("rust", 'const OPEN: &str = "text /* text";\nmod m;\n', (2, 2, 0, 0)), ("rust", 'const Q: &str = "a\\"b /*";\n// c\n', (2, 1, 1, 0)),
    ("json", '[\n  1\n]\n', (3, 3, 0, 0)), ("toml", "\t# head\nkey = 2\n \n", (3, 1, 1, 1)), ("sql", "select 2\n-- tail\n", (2, 1, 1, 0)),
    ("html", "<b>\n<!-- x\ny -->\n", (3, 1, 2, 0)), ("python", "x = 2\n'''\ntext\n'''\n", (4, 1, 3, 0)), ("markdown", "ü\n<!-- hidden -->", (2, 1, 1, 0)),
]


@pytest.mark.parametrize(("name", "text", "expected"), CASES)
def test_counts(name, text, expected):
    got = L.count_lines(name, text)
    assert got == expected
    assert got[0] == sum(got[1:])


def test_spark_counts_agree_with_the_fold(spark):
    extra = [("toml", "a\r\n\r\n# b\r\n\n\n"), ("yaml", "\n"), ("shell", "#!x\n  # y\n z"), ("json", "\n\n"), ("other", " \n\t\nx")]
    data = [(n, a, t) for n, (a, t) in enumerate([*[(c[0], c[1]) for c in CASES], *extra])]
    got = L.with_line_counts(spark.createDataFrame([*data, (99, "rust", None)], "id int, language string, text string"))
    found = {r.id: tuple(r.lines) for r in got.collect()}
    assert found[99] == (0, 0, 0, 0)
    for n, a, t in data:
        assert found[n] == L.count_lines(a, t), (a, t)


def test_file_lines_and_markers(spark):
    df = spark.createDataFrame([(1, "rust", "// TODO a\n x // TODO\n* FIXME\n\t// HACK\n\u3000* XXX\n")], "id bigint, language string, text string")
    assert [(r.line_no, r.kind) for r in L.file_lines(df, "id").orderBy("line_no").collect()] == [(1, "comment"), (2, "code"), (3, "code"), (4, "comment"), (5, "code")]
    assert df.select(L.todo_markers("text").alias("n")).first().n == 4


def test_language_by_name(spark):
    df = spark.createDataFrame([("a/lib.rs",), ("app.TSX",), ("main.cpp",), ("LICENSE",), ("x.y/Makefile",), (".rs",)], "p string")
    assert [r.l for r in df.select(language("p").alias("l")).collect()] == ["rust", "typescript", "c", "other", "other", "rust"]


def test_comment_ratio(spark):
    df = spark.createDataFrame([(0, 3), (2, 2)], "code int, comment int")
    assert [r.r for r in df.select(comment_ratio("comment", "code").alias("r")).collect()] == [0.0, 1.0]


def test_range_counts():
    assert L.count_ranges("a\n// b\nc\n\n", [(2, 3)]) == (2, 1, 1, 0)
