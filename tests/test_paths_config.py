import pytest

from srclens import config
from srclens.config import Note
from srclens.functions import paths
from srclens.functions.hashing import mix
from srclens.functions.text import human_bytes, matches, plural, truncate_label, truncate_path


def test_paths(spark):
    df = spark.createDataFrame([("a/b/mod.rs",), ("lib.rs",)], "p string")
    got = df.select(paths.directory("p").alias("d"), paths.file_name("p").alias("f"), paths.module_name("p").alias("m"), paths.join(paths.directory("p"), paths.F.lit("../../../x")).alias("j")).collect()
    assert [tuple(r) for r in got] == [("a/b", "mod.rs", "b", None), (".", "lib.rs", "lib", None)]
    assert df.select(paths.join(paths.directory("p"), paths.F.lit("./../y.rs")).alias("j")).first().j == "a/y.rs"


@pytest.mark.parametrize(("glob", "path", "hit"), [
    ("**/tests/**", "a/tests/b.rs", True), ("**/tests/**", "tests/b.rs", True), ("*.rs", "a/b.rs", True), ("LICENSE*", "LICENSE-MIT", True), ("{a,b}/?.rs", "b/c.rs", True), ("a[0-9].rs", "ax.rs", False), ("target/**", "target", False),
])
def test_globs(spark, glob, path, hit):
    assert spark.createDataFrame([(path,)], "p string").select(paths.matches_any("p", [glob]).alias("m")).first().m is hit
    assert paths.matches_any("p", []) is None


def test_notes_and_owners(spark):
    df = spark.createDataFrame([("a/x.rs", "a"), ("b/c/y.rs", "b/c"), ("z.rs", ".")], "path string, directory string")
    noted = paths.notes_for(df, [Note("a/*", "one"), Note("[", "bad"), Note("**/*.rs", "two")])
    assert [[n.note for n in r.notes] for r in noted.orderBy("path").collect()] == [["one", "two"], ["two"], ["two"]]
    owners = spark.createDataFrame([(".", "root"), ("b", "bee")], "dir string, name string")
    assert {r.path: r.owner for r in paths.nearest_owner(df, owners).collect()} == {"a/x.rs": "root", "b/c/y.rs": "bee", "z.rs": "root"}


def test_config(tmp_path):
    assert config.load(tmp_path) == config.Config()
    (tmp_path / "srclens.toml").write_text('[scan]\nexclude = ["x"]\n[thresholds]\nmin_comment_ratio = 1\n[[notes]]\npath = "a"\nnote = "b"\nlevel = "critical"\n')
    c = config.load(tmp_path)
    assert c.scan.exclude == ["x"] and c.thresholds.min_comment_ratio == 1.0 and c.notes[0].level == "critical"
    for bad in ("[scan]\nnope = 1", "nope = 1", "[scan]\nexclude = 3", "not toml", '[[notes]]\npath="a"\nnote="b"\nlevel="x"'):
        with pytest.raises(config.ConfigError):
            config.parse(bad)
    assert config.Config().display_name("/a/proj") == "proj" and config.Config().display_name("/") == "unnamed project"


def test_labels(spark):
    assert [human_bytes(n) for n in (5, 1536, 3 << 20)] == ["5 B", "1.5 KiB", "3.0 MiB"]
    assert truncate_label("abcdef", 4) == "abc…" and truncate_path("abcdef", 4) == "…def" and truncate_label("abc", 1) == "abc" and plural(1) == ""
    df = spark.createDataFrame([("a(b",), ("Axb",)], "s string")
    assert [r.m for r in df.select(matches("s", "a.b").alias("m")).collect()] == [True, True]
    assert [r.m for r in df.select(matches("s", "A(").alias("m")).collect()] == [True, False]


def test_mix_is_bit_exact():
    assert mix(0, 0) == 0xE220A8397B1DCDAF
