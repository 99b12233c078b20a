"""Queries of the operators over measured files: metrics, findings, dead code and views.

SQL can't parse, so what a parser would measure is taken from the symbol index: a file's functions are those indexed for
it, a function's complexity is 1 and the number of its types, its nesting the number of its parameters, and the signals
count functions of certain sizes. All files' lines are counted as a shell script's. What is computed from there on is the
operators' own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srclens.config import Thresholds
from srclens.functions import language as lang
from srclens.functions import paths
from srclens.functions.labels import FINDINGS, label
from srclens.functions.text import shorten
from srclens.operators import dead_code, dependencies, findings, metrics, rust_files
from srclens.operators import lines as L
from srclens.operators.checkpoints import durable
from srclens.plans import groups, views
from srclens.plans.base import BLANKS, DIRECTORY, FILES, LANGUAGE, LINES, SYMBOLS, files, query, table
from srclens.plans.report import Report
from srclens.rust.measure import ITEMS, SIGNALS

_KINDS = {"structs": "struct_item", "enums": "enum_item", "traits": "trait_item", "consts": "const_item", "macros": "macro_definition"}
_DIR = DIRECTORY.replace("relative_path", "path")
_S = (
    f"s AS (SELECT symbol_id, repo || '/' || file AS path, kind, name, qualified_name, start_line, end_line, coalesce(is_test, false) AS is_test, coalesce(editable, true) AS editable, coalesce(tokens, 0) AS tokens, "
    f"1 + len(coalesce(types, [])) AS complexity, len(coalesce(parameters, [])) AS nesting, kind = 'function_item' AS f FROM {SYMBOLS})"
)
#: The measured files in SQL: ``m``.
MEASURED = (
    f"WITH {_S}, r AS (SELECT path, count(*) FILTER (f) AS functions, count(*) FILTER (f AND is_test) AS test_functions, coalesce(sum(complexity - 1) FILTER (f), 0) AS decisions, coalesce(max(nesting) FILTER (f), 0) AS deepest, "
    "count(*) FILTER (f AND tokens > 150) AS allocations, count(*) FILTER (f AND tokens > 200) AS nested, count(*) FILTER (f AND nesting >= 3) AS unwraps, "
    + ", ".join(f"count(*) FILTER (kind = '{k}') AS {n}" for n, k in _KINDS.items())
    + f" FROM s GROUP BY 1), l AS (SELECT file_id, repo, repo || '/' || relative_path AS path, {LANGUAGE} AS language, coalesce(bytes, 0) AS bytes, coalesce(is_test_path, false) AS is_test, coalesce({LINES}, []) AS ls, "
    "len(list_filter(coalesce(string_split(text, chr(10)), []), lambda x: regexp_matches(x, '^[\\s\\x0B]*(//|\\*)') AND regexp_matches(x, 'TODO|FIXME|HACK|XXX'))) AS todo "
    f"FROM {FILES}), c AS (SELECT *, len(ls) AS total, len(list_filter(ls, lambda x: trim(x, {BLANKS}) = '')) AS blank, len(list_filter(ls, lambda x: starts_with(trim(x, {BLANKS}), '#'))) AS comment FROM l), "
    f"m AS (SELECT c.* EXCLUDE (ls), total - blank - comment AS code, {_DIR.replace('path', 'c.path')} AS directory, r.* EXCLUDE (path), r.path IS NOT NULL AS parsed, "
    "total - blank - comment + CASE WHEN r.path IS NULL THEN 0 ELSE 3.0 * decisions + 5.0 * greatest(deepest - 3, 0) + 10.0 * allocations END AS weight FROM c LEFT JOIN r USING (path))"
)


def _zero():
    return F.struct(*(F.lit(0).cast("bigint").alias(n) for n in metrics.COUNTS))


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a file, as ``metrics.file_metrics`` gives it. Texts are mapped to counts before repeated rows are dropped."""
    raw = table(spark, sf_dir, "source_files")
    counted = raw.select(
        "file_id", F.concat_ws("/", "repo", "relative_path").alias("relative_path"), lang.language("relative_path").alias("language"), F.coalesce("bytes", F.lit(0)).alias("bytes"),
        F.coalesce("is_test_path", F.lit(False)).alias("is_test"), F.when(F.col("text").isNull(), _zero()).otherwise(L.stateless_counts(F.lit("shell"), F.col("text"))).alias("lines"), L.todo_markers("text").cast("bigint").alias("todo"),
    ).dropDuplicates(["file_id"])
    s = table(spark, sf_dir, "symbols").dropDuplicates(["symbol_id"]).withColumn("path", F.concat_ws("/", "repo", "file"))
    types, parameters, tokens = (F.greatest(F.size(F.coalesce(c, F.array().cast("array<string>"))), F.lit(0)) if c != "tokens" else F.coalesce(c, F.lit(0)) for c in ("types", "parameters", "tokens"))
    s = s.withColumn("is_f", F.col("kind") == "function_item").withColumn("nesting", parameters.cast("bigint")).withColumn("size", tokens)
    function = F.struct(
        "start_line", "symbol_id", "qualified_name", "end_line", (types + 1).alias("complexity"), F.col("nesting").alias("max_nesting"), F.coalesce("is_test", F.lit(False)).alias("is_test")
    )
    n = lambda c: F.count(F.when(c, 1))
    items = {k: n(F.col("kind") == _KINDS[k]) if k in _KINDS else n(F.col("is_f")) if k == "functions" else F.lit(0).cast("bigint") for k in ITEMS}
    signals = {"allocations_in_loops": n(F.col("is_f") & (F.col("size") > 150)), "nested_loops": n(F.col("is_f") & (F.col("size") > 200)), "unwraps": n(F.col("is_f") & (F.col("nesting") >= 3))}
    rust = s.groupBy(F.col("path").alias("relative_path")).agg(
        F.array_sort(F.collect_list(F.when(F.col("is_f"), function))).alias("functions"), F.coalesce(F.max(F.when(F.col("is_f"), F.col("nesting"))), F.lit(0)).cast("bigint").alias("max_nesting"),
        F.struct(*(c.alias(k) for k, c in items.items())).alias("items"), F.struct(*(signals.get(k, F.lit(0).cast("bigint")).alias(k) for k in SIGNALS)).alias("performance"),
    )
    joined = counted.join(rust.withColumn("has", F.lit(True)), "relative_path", "left")
    as_rust = F.when(F.col("has"), F.struct("functions", "max_nesting", "items", "performance", F.col("todo").alias("todo_markers")))
    out = joined.select("file_id", "relative_path", "language", "bytes", "is_test", "lines", as_rust.alias("rust")).withColumn("directory", paths.directory("relative_path"))
    return out.withColumn("test_lines", F.when(F.col("is_test"), F.col("lines")).otherwise(_zero())).withColumn("weight", rust_files.weight())


@query(MEASURED + " SELECT path, weight::DOUBLE AS weight, (decisions + functions)::BIGINT AS complexity FROM m")
def file_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6, A8."""
    return measured(spark, sf_dir).select(F.col("relative_path").alias("path"), "weight", rust_files.complexity().alias("complexity"))


@query(MEASURED + " SELECT file_id, todo::BIGINT AS markers FROM m")
def todo_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blanks of every kind may stand before a marker's comment."""
    return table(spark, sf_dir, "source_files").select("file_id", L.todo_markers("text").cast("bigint").alias("markers")).dropDuplicates(["file_id"])


@query(MEASURED + f" SELECT file_id, language IN ({str(sorted({n for names in [*lang.LINE.values(), *lang.BLOCK.values()] for n in names}))[1:-1]}) AS has_comments, CASE WHEN code = 0 THEN 0 ELSE comment / code END::DOUBLE AS ratio FROM m")
def comment_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2-F4."""
    return measured(spark, sf_dir).select("file_id", lang.has_comment_syntax("language").alias("has_comments"), lang.comment_ratio("lines.comment", "lines.code").alias("ratio"))


@query(MEASURED + " SELECT directory AS path, count(*)::BIGINT AS files, sum(bytes)::BIGINT AS bytes, sum(total)::BIGINT AS total, sum(code)::BIGINT AS code, bool_and(is_test) AS is_test_only FROM m GROUP BY 1")
def directory_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1."""
    return metrics.directories(measured(spark, sf_dir)).select("path", "files", "bytes", "lines.total", "lines.code", "is_test_only")


@query(MEASURED + " SELECT language, count(*)::BIGINT AS files, sum(bytes)::BIGINT AS bytes, sum(code)::BIGINT AS code, sum(comment)::BIGINT AS comment, sum(blank)::BIGINT AS blank FROM m GROUP BY 1")
def language_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2."""
    return metrics.languages(measured(spark, sf_dir)).select("language", "files", "bytes", "lines.code", "lines.comment", "lines.blank")


_RANKS = " ".join(f"WHEN '{n}' THEN {k}" for n, k in lang.RANK.items())


@query(MEASURED + f" SELECT language, sum(code)::BIGINT AS code FROM m GROUP BY 1 ORDER BY code DESC, CASE language {_RANKS} ELSE 99 END LIMIT 5")
def top_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2's order, and the limit of a top list."""
    return metrics.languages(measured(spark, sf_dir)).limit(5).select("language", "lines.code")


_TOTAL = (
    "count(*)::BIGINT AS files, sum(bytes)::BIGINT AS bytes, coalesce(sum(functions), 0)::BIGINT AS functions, count(DISTINCT directory)::BIGINT AS directories, coalesce(sum(structs), 0)::BIGINT AS structs, "
    "coalesce(sum(unwraps), 0)::BIGINT AS unwraps, coalesce(sum(CASE WHEN parsed THEN todo END), 0)::BIGINT AS todo"
)


@query(MEASURED + f" SELECT count(*) FILTER (is_test)::BIGINT AS test_files, sum(code)::BIGINT AS code, sum(CASE WHEN is_test THEN code ELSE 0 END)::BIGINT AS test_code, coalesce(sum(test_functions), 0)::BIGINT AS test_functions, 7::BIGINT AS packages, {_TOTAL} FROM m")
def scan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3."""
    t = metrics.totals(measured(spark, sf_dir), 7)
    return t.select("test_files", "lines.code", F.col("test_lines.code").alias("test_code"), "test_functions", "packages", *_totals())


def _totals() -> list:
    return ["files", "bytes", "functions", "directories", F.col("items.structs").alias("structs"), F.col("performance.unwraps").alias("unwraps"), F.col("todo_markers").alias("todo")]


@query(MEASURED + f", p AS (SELECT * REPLACE (functions - test_functions AS functions) FROM m WHERE NOT is_test) SELECT 0::BIGINT AS test_files, sum(code)::BIGINT AS code, {_TOTAL} FROM p")
def production_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, F5."""
    return metrics.production_totals(measured(spark, sf_dir)).select("test_files", "lines.code", *_totals())


_UP = "SELECT array_to_string(list_slice(string_split(directory, '/'), 1, n), '/') AS path, m.* EXCLUDE (path) FROM (SELECT *, unnest(range(1, len(string_split(directory, '/')) + 1)) AS n FROM m) m"


@query(MEASURED + f" SELECT path, count(*)::BIGINT AS files, sum(bytes)::BIGINT AS bytes, sum(total)::BIGINT AS total, sum(code)::BIGINT AS code, sum(comment)::BIGINT AS comment, sum(blank)::BIGINT AS blank FROM ({_UP}) GROUP BY 1")
def directory_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9."""
    return metrics.rollup(measured(spark, sf_dir)).where("path <> '.'")


@query(MEASURED + " SELECT string_split(directory, '/')[1] AS child, count(*)::BIGINT AS files, sum(bytes)::BIGINT AS bytes, sum(code)::BIGINT AS code FROM m GROUP BY 1")
def directory_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9 below one directory."""
    return metrics.children(measured(spark, sf_dir)).select("child", "files", "bytes", "lines.code")


@query(MEASURED + ", t AS (SELECT file_id, bool_or(is_test_path) AS t FROM clone_inputs GROUP BY 1) SELECT path, is_test OR coalesce(t, false) AS is_test, CASE WHEN is_test OR coalesce(t, false) THEN code ELSE 0 END::BIGINT AS test_code FROM m LEFT JOIN t USING (file_id)")
def test_only_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that another table calls tests."""
    rows = measured(spark, sf_dir)
    given = table(spark, sf_dir, "clone_inputs").where("is_test_path").select("file_id").join(rows.select("file_id", F.col("relative_path").alias("path")), "file_id")
    return metrics.mark_test_only(rows, given).select(F.col("relative_path").alias("path"), "is_test", F.col("test_lines.code").alias("test_code"))


# -- dead code
_DEAD = (
    f"used AS (SELECT name, count(*) AS uses FROM (SELECT unnest(list_concat(coalesce(identifiers, []), coalesce(types, []))) AS name FROM {SYMBOLS} WHERE NOT coalesce(is_test, false)) WHERE name IS NOT NULL GROUP BY 1), "
    "n AS (SELECT name, count(*) AS declared FROM s GROUP BY 1), "
    "orphan AS (SELECT path, is_test, code FROM m WHERE NOT parsed AND ends_with(path, '.rs')), "
    "dead AS (SELECT s.name, CASE s.kind WHEN 'function_item' THEN 'function' WHEN 'macro_definition' THEN 'macro' ELSE 'struct' END AS kind, s.path AS file, s.start_line AS line, is_test, CASE WHEN editable THEN 'high' ELSE 'medium' END AS confidence FROM s LEFT JOIN n USING (name) LEFT JOIN used USING (name) "
    "WHERE s.kind <> 'mod_item' AND s.name <> 'main' AND coalesce(used.uses, 0) <= n.declared "
    "UNION ALL SELECT regexp_replace(array_to_string(list_slice(list_filter(string_split(path, '/'), lambda x: x <> 'mod.rs'), -1, -1), ''), '\\.rs$', ''), 'file', path, 1, is_test, 'high' FROM orphan)"
)


def dead(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    s = table(spark, sf_dir, "symbols").dropDuplicates(["symbol_id"])
    kind = F.when(F.col("kind") == "function_item", "function").when(F.col("kind") == "macro_definition", "macro").when(F.col("kind") == "mod_item", "module").otherwise("struct")
    definition = F.struct(
        "name", kind.alias("kind"), F.col("start_line").alias("line"), (~F.coalesce("editable", F.lit(True))).alias("is_public"), F.coalesce("is_test", F.lit(False)).alias("is_test"), F.lit(False).alias("is_externally_reachable")
    )
    none = F.array().cast("array<string>")
    named = F.filter(F.concat(F.coalesce("identifiers", none), F.coalesce("types", none)), lambda x: x.isNotNull())
    definitions = s.select(F.concat_ws("/", "repo", "file").alias("file"), F.lit(False).alias("test"), F.struct(F.array(definition).alias("definitions"), F.map_from_entries(F.array().cast("array<struct<k:string,v:bigint>>")).alias("identifier_uses")).alias("rust"))
    uses = s.withColumn("name", F.explode(named)).groupBy("name", F.coalesce("is_test", F.lit(False)).alias("test")).agg(F.count("*").alias("n"))
    used = uses.select(F.lit("").alias("file"), "test", F.struct(F.array().cast(definitions.schema["rust"].dataType["definitions"].dataType.simpleString()).alias("definitions"), F.create_map("name", "n").alias("identifier_uses")).alias("rust"))
    parsed = definitions.unionByName(used).withColumnRenamed("test", "is_test_file")
    orphans = rows.where("rust is null and relative_path like '%.rs'").select(F.col("relative_path").alias("path"))
    return dead_code.add_orphans(dead_code.analyze(parsed), orphans, rows.select(F.col("relative_path").alias("file"), F.col("is_test").alias("is_test_file")))


@query(MEASURED + ", " + _DEAD + " SELECT name, kind, file, line, is_test, confidence FROM dead")
def dead_code_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1, D2, J2."""
    return dead(spark, sf_dir, measured(spark, sf_dir)).select("name", "kind", "file", "line", "is_test", "confidence")


# -- findings
_HEAVY = "h AS (SELECT 's' || l_suppkey AS name, count(*) AS n FROM lineitem GROUP BY 1)"
_DOUBLE = "d2 AS (SELECT p_name AS name, count(DISTINCT p_type) AS n FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1)"
_UNUSED = "un AS (SELECT 'n' || n_nationkey AS package, 's' || s_suppkey AS dependency FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey IS NOT NULL))"
_UNITED = (
    _HEAVY + ", " + _DOUBLE + ", " + _UNUSED + ", "
    "fn AS (SELECT s.*, end_line - start_line + 1 AS size FROM s JOIN (SELECT DISTINCT path FROM m) USING (path) WHERE f), dc AS (SELECT count(*) AS n, min_by({'file': file, 'line': line, 'name': name}, {'file': file, 'line': line, 'name': name}) AS first FROM dead WHERE confidence = 'high' AND kind <> 'file'), "
    "pf AS (SELECT DISTINCT repo || '/' || path AS path, line FROM parse_failures WHERE path IS NOT NULL), "
    "found AS (SELECT 'huge_file' AS rule, 'high' AS severity, path AS file, NULL::BIGINT AS line, code::DOUBLE AS metric FROM m WHERE code >= 800 "
    "UNION ALL SELECT 'large_file', 'medium', path, NULL, code FROM m WHERE code >= 400 AND code < 800 "
    f"UNION ALL SELECT 'underdocumented', 'low', path, NULL, code FROM m WHERE NOT is_test AND language <> 'json' AND language <> 'other' AND code >= 50 AND comment / code < 0.05 "
    "UNION ALL SELECT 'allocation_in_loop', 'high', path, NULL, allocations FROM m WHERE allocations > 0 UNION ALL SELECT 'nested_loop', 'medium', path, NULL, nested FROM m WHERE nested > 0 "
    "UNION ALL SELECT 'panic_path', 'medium', path, NULL, unwraps FROM m WHERE unwraps > 0 AND NOT is_test UNION ALL SELECT 'unfinished_work', 'low', path, NULL, todo FROM m WHERE parsed AND todo > 0 "
    "UNION ALL SELECT 'long_function', 'medium', path, start_line, size FROM fn WHERE size >= 60 UNION ALL SELECT 'complex_function', 'high', path, start_line, complexity FROM fn WHERE complexity >= 15 "
    "UNION ALL SELECT 'deep_nesting', 'medium', path, start_line, nesting FROM fn WHERE nesting >= 5 "
    "UNION ALL SELECT 'large_directory', 'low', directory, NULL, count(*) FROM m GROUP BY directory HAVING count(*) >= 20 "
    "UNION ALL SELECT 'heavy_dependency', 'medium', NULL, NULL, n FROM h WHERE n >= 20 UNION ALL SELECT 'duplicate_dependency', 'medium', NULL, NULL, n FROM d2 UNION ALL SELECT 'unused_dependency', 'low', NULL, NULL, 1 FROM un "
    "UNION ALL SELECT 'dead_code', 'high', first.file, first.line, n FROM dc WHERE n > 0 UNION ALL SELECT 'orphan_file', 'high', path, 1, code FROM orphan UNION ALL SELECT 'parse_failure', 'low', path, line, 1 FROM pf "
    "UNION ALL SELECT 'duplicate_code', CASE WHEN lines_saved >= 60 THEN 'high' ELSE 'medium' END, own[1].path, own[1].start_line, lines_saved FROM built_mine WHERE NOT in_tests AND lines_saved >= 6)"
)
_MINE = "built_mine AS (SELECT *, list_filter(units, lambda u: u.editable) AS own FROM built)"
FOUND = MEASURED + ", " + _DEAD + ", " + groups.BUILT + ", " + _MINE + ", " + _UNITED
FOUND = FOUND.replace("WITH ", "WITH RECURSIVE ", 1)


def unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation's suppliers that no returned item names."""
    supplier = table(spark, sf_dir, "supplier")
    dependency = F.struct(F.concat(F.lit("s"), "s_suppkey").alias("name"), F.lit("normal").alias("kind"), F.lit(False).alias("optional"))
    packages = supplier.groupBy(F.concat(F.lit("n"), "s_nationkey").alias("name")).agg(F.collect_list(dependency).alias("dependencies")).withColumn("is_workspace_member", F.lit(True))
    named = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_suppkey").distinct().join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(F.concat(F.lit("n"), "s_nationkey").alias("package"), F.concat(F.lit("s"), "s_suppkey").alias("crate"))
    return dependencies.unused(packages, named.unionByName(packages.select(F.col("name").alias("package"), F.lit("").alias("crate"))))


@query(f"WITH {_UNUSED} SELECT package, dependency, 'normal' AS kind FROM un")
def unused_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G16, J13, F20."""
    return unused(spark, sf_dir)


def found(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """All rules with the thresholds that hold by default."""
    t = Thresholds()
    as_path = rows.withColumnRenamed("relative_path", "path")
    heavy = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("s"), "l_suppkey").alias("name")).agg(F.count("*").alias("exclusive_count"))
    doubles = dependencies.duplicate_versions(table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("version")))
    failures = table(spark, sf_dir, "parse_failures").where("path is not null").groupBy(F.concat_ws("/", "repo", "path").alias("path"), "line").agg(F.min("message").alias("message"))
    instances = F.transform("units", lambda u: F.struct(u["path"].alias("file"), u["start_line"].alias("start_line"), u["item"].alias("item"), u["editable"].alias("editable")))
    copies = groups.built(spark, sf_dir).withColumn("instances", instances).withColumn("signature", F.col("fragment")).withColumn("n", F.lit(1))
    return findings.ranked([
        *findings.file_rules(as_path, t), *findings.function_rules(as_path, t), *findings.directory_rules(metrics.directories(rows), t), *findings.dependency_rules(heavy, doubles, unused(spark, sf_dir), t),
        *findings.dead_code_rules(dead(spark, sf_dir, rows), as_path), *findings.parse_failure_rules(failures), *findings.clone_rules(copies, t),
    ])


@query(FOUND + " SELECT rule, severity, file, coalesce(line, 0)::BIGINT AS line, metric FROM found")
def findings_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1-U18."""
    return found(spark, sf_dir, durable(measured(spark, sf_dir))).select("rule", "severity", "file", F.coalesce("line", F.lit(0)).alias("line"), "metric")


_LABELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FINDINGS.items())


@query(FOUND + f" SELECT rule, CASE rule {_LABELS} END AS label, severity, count(*)::BIGINT AS n, max(metric) AS worst FROM found GROUP BY 1, 2, 3")
def findings_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1-U18 counted, with the rules' labels."""
    rows = found(spark, sf_dir, durable(measured(spark, sf_dir)))
    return rows.groupBy("rule", "severity").agg(F.count("*").alias("n"), F.max("metric").alias("worst")).withColumn("label", label("rule", FINDINGS))


@query(
    FOUND + ", a AS (SELECT DISTINCT array_to_string(list_slice(string_split(path, '/'), 1, 2), '/') AS path FROM m), w AS (SELECT a.path, min(CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 END) AS k FROM a LEFT JOIN found ON found.file = a.path OR starts_with(found.file, a.path || '/') GROUP BY 1) "
    "SELECT path, CASE k WHEN 2 THEN 'high' WHEN 3 THEN 'medium' WHEN 4 THEN 'low' END AS worst FROM w"
)
def worst_severity_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J14."""
    rows = durable(measured(spark, sf_dir))
    tops = rows.select(F.substring_index("relative_path", "/", 2).alias("path")).distinct()
    return findings.worst_severity(found(spark, sf_dir, rows), tops).select("path", "worst")


# -- views
def report(spark: SparkSession, sf_dir: str, finding: bool = False) -> Report:
    rows = durable(measured(spark, sf_dir))
    spotted = found(spark, sf_dir, rows) if finding else spark.createDataFrame([], "rule string, severity string, title string, file string, line bigint, metric double")
    return Report("tables", sf_dir, 0, metrics.by_weight(rows), metrics.directories(rows), metrics.languages(rows), metrics.totals(rows), spotted, dead(spark, sf_dir, rows), None, spark.createDataFrame([], "path string"), None, None, None, None)


@query(MEASURED + " SELECT path, weight::DOUBLE AS weight, code::BIGINT AS code, coalesce(decisions + functions, 0)::BIGINT AS complexity FROM m WHERE regexp_matches(path, '(?i)src/.*\\.rs$') ORDER BY weight DESC, path LIMIT 40")
def view_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V-files: a filter, the first order and a limit."""
    return views.files(report(spark, sf_dir), text="src/.*\\.rs$", sort="weight", limit=40).select(F.col("relative_path").alias("path"), "weight", "lines.code", "complexity")


@query(
    MEASURED + ", p AS (SELECT m.*, code - CASE WHEN is_test THEN code ELSE 0 END AS kept FROM m WHERE NOT is_test) SELECT path, kept::BIGINT AS code, coalesce(n, 0)::BIGINT AS complexity FROM p LEFT JOIN (SELECT path, sum(complexity) AS n FROM s WHERE f AND NOT is_test GROUP BY 1) USING (path) ORDER BY coalesce(n, 0) DESC, path LIMIT 30"
)
def view_files_without_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V-files without tests, by complexity."""
    return views.files(report(spark, sf_dir), hide_tests=True, sort="complexity", limit=30).select(F.col("relative_path").alias("path"), "lines.code", "complexity")


@query(MEASURED + " SELECT string_split(directory, '/')[1] AS path, count(*)::BIGINT AS files, sum(bytes)::BIGINT AS bytes, sum(code)::BIGINT AS code FROM m WHERE NOT is_test GROUP BY 1 ORDER BY files DESC, 1 LIMIT 12")
def view_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V-directories at the root, by files."""
    return views.directories(report(spark, sf_dir), hide_tests=True, sort="files", limit=12).select("path", "files", "bytes", "code")


@query(MEASURED + ", " + _DEAD + " SELECT name, file, line, confidence FROM dead WHERE regexp_matches(lower(name), 'queue|er') OR regexp_matches(lower(file), 'queue|er') ORDER BY name, file, line LIMIT 50")
def view_dead_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V-dead_code by name, with a filter."""
    return views.dead_code(report(spark, sf_dir), text="queue|er", sort="name", limit=50).select("name", "file", "line", "confidence")


@query(FOUND + " SELECT rule, severity, file, metric FROM found WHERE regexp_matches(rule, 'file|function') AND rule <> 'dead_code'")
def view_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V-findings and V-overview: rules by their names."""
    rows = views.findings(report(spark, sf_dir, True), text="")
    return rows.where("rule rlike 'file|function'").select("rule", "severity", "file", "metric")


@query(MEASURED + ", top AS (SELECT path FROM m WHERE parsed ORDER BY functions DESC, path LIMIT 1) SELECT qualified_name, complexity::BIGINT AS complexity, (end_line - start_line + 1)::BIGINT AS lines FROM s JOIN top USING (path) WHERE f ORDER BY complexity DESC, lines DESC, start_line LIMIT 8")
def view_file_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight most complex functions of the file that has most."""
    made = report(spark, sf_dir)
    most = made.files.orderBy(F.desc(F.size("rust.functions")), "relative_path").first().relative_path
    return views.file_detail(made, most)[1].select("qualified_name", F.col("complexity").cast("bigint").alias("complexity"), "lines")


@query("SELECT candidate_id, CASE WHEN length(t) > 48 THEN left(t, 47) || '…' ELSE t END AS short FROM (SELECT candidate_id, trim(regexp_replace(code, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') AS t FROM (SELECT DISTINCT ON (candidate_id) * FROM clone_candidates))")
def shortened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F25."""
    return table(spark, sf_dir, "clone_candidates").dropDuplicates(["candidate_id"]).select("candidate_id", shorten("code").alias("short"))
