"""Queries of single operators over the supplied tables, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from srclens.clones import detect, node_table
from srclens.clones.sketch import sketch_groups
from srclens.config import Clones, Note, Thresholds
from srclens.functions import language as lang
from srclens.functions import paths
from srclens.functions.similarity import dice_pairs
from srclens.functions.text import matches
from srclens.operators import dead_code, metrics, rust_files
from srclens.operators import lines as L
from srclens.operators.checkpoints import durable, once, spread
from srclens.operators.components import connected_components
from srclens.plans.base import BLANKS, DIRECTORY, FILES, LANGUAGE, LINES, NAME, SYMBOLS, files, query, table

# -- projections and scalar functions
@query(f"SELECT {LANGUAGE} AS language, count(*)::BIGINT AS files FROM {FILES} GROUP BY 1")
def language_identify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1."""
    return files(spark, sf_dir, "relative_path").groupBy(lang.language("relative_path").alias("language")).agg(F.count("*").alias("files"))


@query(
    f"SELECT file_id, {DIRECTORY} AS directory, {NAME} AS file_name, CASE WHEN {NAME} = 'mod.rs' THEN regexp_extract({DIRECTORY}, '([^/]*)$', 1) ELSE regexp_replace({NAME}, '\\.rs$', '') END AS module, "
    f"regexp_matches(relative_path, '^(tests)/([^/]+\\.rs|[^/]+/main\\.rs)$') AS auto_test, CASE WHEN starts_with({DIRECTORY}, 'crates/') THEN 'crates/' || split_part({DIRECTORY}, '/', 2) END AS child FROM {FILES}"
)
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7, F9-F11."""
    return files(spark, sf_dir, "relative_path").select(
        "file_id", paths.directory("relative_path").alias("directory"), paths.file_name("relative_path").alias("file_name"), paths.module_name("relative_path").alias("module"),
        paths.is_auto_target("relative_path", "tests").alias("auto_test"), paths.immediate_child("crates", paths.directory("relative_path")).alias("child"),
    )


@query(f"SELECT file_id, CASE WHEN len(string_split({DIRECTORY}, '/')) >= 1 AND {DIRECTORY} <> '.' THEN regexp_replace({DIRECTORY}, '/?[^/]*$', '') || CASE WHEN contains({DIRECTORY}, '/') THEN '/' ELSE '' END || 'lib.rs' END AS joined FROM {FILES}")
def path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: ``../lib.rs`` from each file's directory; null above the root."""
    return files(spark, sf_dir, "relative_path").select("file_id", paths.join(paths.directory("relative_path"), F.lit(".././lib.rs")).alias("joined"))


@query(f"SELECT file_id, (regexp_matches(relative_path, '^(.*/)?tests/.*$') OR regexp_matches(relative_path, '^(.*/)?test\\.rs$') OR regexp_matches(relative_path, '^(.*/)?tests\\.rs$') OR regexp_matches(relative_path, '^(.*/)?.*_test\\.rs$') OR regexp_matches(relative_path, '^(.*/)?.*_tests\\.rs$') OR regexp_matches(relative_path, '^(.*/)?benches/.*$')) AS is_test FROM {FILES}")
def test_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F12 with the default patterns."""
    from srclens.config import Scan

    return files(spark, sf_dir, "relative_path").select("file_id", paths.matches_any("relative_path", Scan().test_patterns).alias("is_test"))


@query(f"SELECT file_id, CASE WHEN starts_with(relative_path, 'crates/') AND ends_with(relative_path, '.rs') THEN 'read first,' ELSE '' END || CASE WHEN contains(relative_path, '/src/') THEN 'core,' ELSE '' END AS notes FROM {FILES}")
def notes_glob_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F13, J6."""
    notes = [Note("crates/**/*.rs", "read first"), Note("*/src/*", "core", "warning"), Note("[", "never")]
    rows = paths.notes_for(files(spark, sf_dir, "relative_path"), notes, "relative_path")
    return rows.select("file_id", F.array_join(F.transform("notes", lambda n: F.concat(n["note"], F.lit(","))), "").alias("notes"))


@query(f"SELECT symbol_id, regexp_matches(lower(name), 'queue|ledger$') AS by_regex, contains(lower(qualified_name), '::(') AS by_text FROM {SYMBOLS}")
def regex_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a pattern, and one that is none and is taken as text."""
    rows = table(spark, sf_dir, "symbols").dropDuplicates(["symbol_id"])
    return rows.select("symbol_id", matches("name", "QUEUE|ledger$").alias("by_regex"), matches("qualified_name", "::(").alias("by_text"))


# -- lines


@query()
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1-L3 with block comments: the state runs through a file, so SQL has no short word for it."""
    rows = L.with_line_counts(table(spark, sf_dir, "source_files").withColumn("language", lang.language("relative_path")))
    return rows.select("file_id", "language", "lines.*").dropDuplicates(["file_id"])


@query(
    f"WITH r AS (SELECT DISTINCT file_id, start_line, end_line FROM syntax_nodes WHERE test AND kind = 'function_item'), l AS (SELECT file_id, unnest(range(1, len({LINES}) + 1)) AS line_no, unnest({LINES}) AS line FROM {FILES} WHERE text IS NOT NULL), "
    f"t AS (SELECT DISTINCT l.file_id, line_no, trim(line, {BLANKS}) AS line FROM l JOIN r ON r.file_id = l.file_id AND line_no BETWEEN start_line AND end_line) "
    "SELECT file_id, count(*)::BIGINT AS test_lines, count(*) FILTER (line = '')::BIGINT AS blank_lines FROM t GROUP BY 1"
)
def test_range_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of files in the ranges of their test functions; the ranges are gathered by file, so that no line meets another file's."""
    ranges = table(spark, sf_dir, "syntax_nodes").where("test and kind = 'function_item'").groupBy("file_id").agg(F.collect_set(F.struct("start_line", "end_line")).alias("test_ranges"))
    rows = files(spark, sf_dir, "text").join(ranges, "file_id").select("file_id", "text", F.struct("test_ranges").alias("rust"))
    return rows.select("file_id", metrics.range_counts().alias("c")).select("file_id", F.col("c.total").alias("test_lines"), F.col("c.blank").alias("blank_lines")).where("test_lines > 0")


@query(f"SELECT repo, t AS crate FROM (SELECT DISTINCT repo, unnest(types) AS t FROM {SYMBOLS}) WHERE t IS NOT NULL")
def referenced_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7 over the types that symbols name."""
    rows = table(spark, sf_dir, "symbols").select("repo", F.struct(F.array_compact("types").alias("referenced_crates")).alias("rust"))
    return rust_files.referenced_crates(rows, "repo")


@query(f"SELECT name, count(*)::BIGINT AS declared FROM {SYMBOLS} GROUP BY 1")
def declaration_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6."""
    return rust_files.declaration_counts(table(spark, sf_dir, "symbols").dropDuplicates(["symbol_id"]))


@query()
def language_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1, A2 over all files and languages, block comments and all."""
    rows = L.with_line_counts(table(spark, sf_dir, "source_files").withColumn("language", lang.language("relative_path")))
    return metrics.languages(rows.select("file_id", "language", "bytes", "lines").dropDuplicates(["file_id"])).select("language", "files", "bytes", "lines.*")


# -- aggregations
@query(
    f"WITH f AS (SELECT file_id, repo || '/' || ({DIRECTORY}) AS d FROM {FILES}), o AS (SELECT repo || '/' || ({DIRECTORY}) AS dir, min(relative_path) AS name FROM {FILES} WHERE ends_with(relative_path, '.toml') GROUP BY 1) "
    "SELECT f.file_id, max_by(o.name, length(o.dir)) AS owner FROM f LEFT JOIN o ON f.d = o.dir OR starts_with(f.d, o.dir || '/') GROUP BY 1"
)
def nearest_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest directory with a TOML file."""
    rows = files(spark, sf_dir, "repo", "relative_path").withColumn("directory", F.concat_ws("/", "repo", paths.directory("relative_path")))
    owners = rows.where(F.col("relative_path").endswith(".toml")).groupBy(F.col("directory").alias("dir")).agg(F.min("relative_path").alias("name"))
    return paths.nearest_owner(rows, owners).select("file_id", "owner")


# -- census and dead code over the symbol index
_USES = f"(SELECT repo, name, count(*) AS uses FROM (SELECT repo, unnest(list_concat(coalesce(identifiers, []), coalesce(types, []))) AS name FROM {SYMBOLS}) WHERE name IS NOT NULL GROUP BY 1, 2)"


@query(f"SELECT name, sum(uses)::BIGINT AS uses FROM {_USES} GROUP BY 1")
def identifier_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5."""
    return rust_files.census(_uses(spark, sf_dir))


def _uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    rows = table(spark, sf_dir, "symbols").dropDuplicates(["symbol_id"])
    return rows.select("repo", F.explode(F.concat(F.coalesce("identifiers", none), F.coalesce("types", none))).alias("name")).where("name is not null").groupBy("repo", "name").agg(F.count("*").alias("uses"))


@query(
    f"WITH d AS (SELECT name, count(*) AS declared FROM {SYMBOLS} GROUP BY 1), u AS (SELECT name, sum(uses) AS uses FROM {_USES} GROUP BY 1) "
    f"SELECT s.name, s.kind, s.repo || '/' || s.file AS file, s.start_line AS line, CASE WHEN coalesce(s.editable, true) THEN 'high' ELSE 'medium' END AS confidence FROM {SYMBOLS} s LEFT JOIN d USING (name) LEFT JOIN u USING (name) "
    "WHERE s.kind <> 'macro_definition' AND s.name <> 'main' AND coalesce(u.uses, 0) <= coalesce(d.declared, 0)"
)
def dead_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1, J2 with read-only symbols in the place of public ones."""
    rows = table(spark, sf_dir, "symbols").dropDuplicates(["symbol_id"])
    defs = rows.select(
        "name", "kind", F.concat_ws("/", "repo", "file").alias("file"), F.col("start_line").alias("line"), (~F.coalesce("editable", F.lit(True))).alias("is_public"), "is_test",
        (F.col("kind") == "macro_definition").alias("is_externally_reachable"),
    )
    return dead_code.candidates(_uses(spark, sf_dir), defs, ["main"]).select("name", "kind", "file", "line", "confidence")


@query(f"SELECT f.file_id, f.repo FROM {FILES} f WHERE ends_with(f.relative_path, '.rs') AND NOT EXISTS (SELECT 1 FROM symbols s WHERE s.repo = f.repo AND s.file = f.relative_path)")
def unindexed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without symbols, by an anti join."""
    index = table(spark, sf_dir, "symbols").select("repo", F.col("file").alias("relative_path"))
    return files(spark, sf_dir, "repo", "relative_path").where(F.col("relative_path").endswith(".rs")).join(index, ["repo", "relative_path"], "left_anti").select("file_id", "repo")


@query(f"WITH a AS (SELECT DISTINCT repo, regexp_replace(path, '^(\\./)+', '') AS path FROM parse_failures), b AS (SELECT DISTINCT repo, relative_path AS path FROM source_files) SELECT coalesce(a.repo, b.repo) AS repo, count(*) FILTER (b.path IS NULL)::BIGINT AS only_log, count(*) FILTER (a.path IS NULL)::BIGINT AS only_scan FROM a FULL JOIN b ON a.repo = b.repo AND a.path = b.path GROUP BY 1")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set operations: paths of the log and of the scan."""
    log = table(spark, sf_dir, "parse_failures").select("repo", F.regexp_replace("path", r"^(\./)+", "").alias("path")).distinct()
    scan = table(spark, sf_dir, "source_files").select("repo", F.col("relative_path").alias("path")).distinct()
    both = log.withColumn("l", F.lit(1)).join(scan.withColumn("s", F.lit(1)), ["repo", "path"], "full")
    return both.groupBy("repo").agg((F.count("*") - F.count("s")).alias("only_log"), (F.count("*") - F.count("l")).alias("only_scan"))


@query(f"SELECT symbol_id, repo, file, n::BIGINT AS place FROM (SELECT symbol_id, repo, file, row_number() OVER (PARTITION BY repo, file ORDER BY tokens DESC, start_line, symbol_id) AS n FROM {SYMBOLS} WHERE kind = 'function_item') WHERE n <= 8")
def per_file_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top eight functions of each file."""
    order = Window.partitionBy("repo", "file").orderBy(F.desc("tokens"), "start_line", "symbol_id")
    rows = table(spark, sf_dir, "symbols").dropDuplicates(["symbol_id"]).where("kind = 'function_item'")
    return rows.withColumn("place", F.row_number().over(order).cast("bigint")).where("place <= 8").select("symbol_id", "repo", "file", "place")


# -- syntax trees as nested sets
_NODES = "(SELECT * FROM syntax_nodes)"
ITEMS = ("function_item", "struct_item", "enum_item", "trait_item", "const_item", "macro_definition", "function_signature_item")
_ITEMS = str(ITEMS)


@query(
    "SELECT n.file_id, n.idx, CASE n.kind WHEN 'function_item' THEN 'function' WHEN 'trait_item' THEN 'trait' WHEN 'struct_item' THEN 'type_shape' WHEN 'enum_item' THEN 'type_shape' WHEN 'if_expression' THEN 'if_chain' ELSE 'block' END AS fragment, n.leaf_count::BIGINT AS tokens "
    "FROM syntax_nodes n LEFT JOIN syntax_nodes p ON n.file_id = p.file_id AND n.parent = p.idx WHERE NOT n.error AND n.end_line - n.start_line + 1 >= 6 AND n.leaf_count >= 50 AND (n.kind IN ('function_item','trait_item','struct_item','enum_item','if_expression') OR (n.kind = 'block' AND p.kind IN ('for_expression','while_expression','if_expression')))"
)
def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C10, C11 over the given trees: a block's kind depends on its parent's."""
    nodes = table(spark, sf_dir, "syntax_nodes").select("file_id", "idx", "kind", "parent", "error", "leaf_count", "start_line", "end_line")
    t = Thresholds()
    long = nodes.where(~F.col("error") & (F.col("end_line") - F.col("start_line") + 1 >= t.duplicate_min_lines) & (F.col("leaf_count") >= t.duplicate_min_tokens))
    own = {"function_item": "function", "trait_item": "trait", "struct_item": "type_shape", "enum_item": "type_shape", "if_expression": "if_chain"}
    direct = long.where(F.col("kind").isin(*own)).select("file_id", "idx", F.element_at(F.create_map(*(F.lit(x) for p in own.items() for x in p)), F.col("kind")).alias("fragment"), F.col("leaf_count").cast("bigint").alias("tokens"))
    parents = nodes.where(F.col("kind").isin("for_expression", "while_expression", "if_expression")).select("file_id", F.col("idx").alias("parent"))
    blocks = long.where("kind = 'block'").join(parents, ["file_id", "parent"], "left_semi").select("file_id", "idx", F.lit("block").alias("fragment"), F.col("leaf_count").cast("bigint").alias("tokens"))
    return direct.unionByName(blocks)


@query(
    f"WITH i AS (SELECT file_id, idx, end_idx FROM syntax_nodes WHERE kind IN {_ITEMS}) SELECT n.file_id, n.idx, max(i.idx)::INT AS item FROM syntax_nodes n JOIN i ON n.file_id = i.file_id AND i.idx < n.idx AND n.idx < i.end_idx WHERE n.kind IN ('block','let_declaration','match_expression') GROUP BY 1, 2"
)
def enclosing_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The innermost item around a node."""
    rows = node_table.annotate(table(spark, sf_dir, "syntax_nodes"), ITEMS)
    return rows.where("kind in ('block', 'let_declaration', 'match_expression') and item is not null").select("file_id", "idx", "item")


@query("SELECT a.file_id, a.idx, bool_or(b.test) AS in_test, bool_or(b.error) AS has_error FROM syntax_nodes a JOIN syntax_nodes b ON a.file_id = b.file_id AND b.idx >= a.idx AND b.idx < a.end_idx WHERE a.kind = 'function_item' GROUP BY 1, 2")
def subtree_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether anything below a function is a test or an error."""
    rows = node_table.annotate(table(spark, sf_dir, "syntax_nodes"), ITEMS)
    return rows.where("kind = 'function_item'").select("file_id", "idx", "in_test", "has_error")


@query(
    "WITH RECURSIVE c AS (SELECT DISTINCT ON (candidate_id) candidate_id AS id, fragment, shape FROM clone_candidates WHERE shape IS NOT NULL), e AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON a.shape = b.shape AND a.fragment = b.fragment AND a.id <> b.id), "
    "r AS (SELECT a AS id, a AS label FROM e UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.id) SELECT id, min(label) AS component FROM r GROUP BY 1"
)
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C23 over candidates of one shape; neighbours in each class are linked, not all pairs."""
    c = table(spark, sf_dir, "clone_candidates").dropDuplicates(["candidate_id"]).where("shape is not null")
    order = Window.partitionBy("fragment", "shape").orderBy("candidate_id")
    edges = c.select(F.col("candidate_id").alias("src"), F.lead("candidate_id").over(order).alias("dst")).where("dst is not null")
    return connected_components(edges)


@query(
    f"WITH s AS (SELECT symbol_id AS id, repo, file, start_line, types FROM {SYMBOLS}), p AS (SELECT id AS a, lead(id) OVER (PARTITION BY repo, file ORDER BY start_line, id) AS b FROM s), g AS (SELECT id, item, count(*) AS n FROM (SELECT id, unnest(types) AS item FROM s) WHERE item IS NOT NULL GROUP BY 1, 2), t AS (SELECT id, sum(n) AS total FROM g GROUP BY 1), "
    "c AS (SELECT p.a, p.b, sum(least(x.n, y.n)) AS common FROM p JOIN g x ON x.id = p.a JOIN g y ON y.id = p.b AND y.item = x.item GROUP BY 1, 2) SELECT p.a, p.b, round(2.0 * coalesce(c.common, 0) / (ta.total + tb.total), 6)::DOUBLE AS dice FROM p JOIN t ta ON ta.id = p.a JOIN t tb ON tb.id = p.b LEFT JOIN c ON c.a = p.a AND c.b = p.b WHERE p.b IS NOT NULL"
)
def dice_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F22, J15 between neighbours in a file."""
    s = table(spark, sf_dir, "symbols").dropDuplicates(["symbol_id"])
    order = Window.partitionBy("repo", "file").orderBy("start_line", "symbol_id")
    pairs = s.select(F.col("symbol_id").alias("a"), F.lead("symbol_id").over(order).alias("b")).where("b is not null")
    bags = s.select(F.col("symbol_id").alias("id"), F.explode("types").alias("item")).where("item is not null").groupBy("id", "item").agg(F.count("*").alias("n"))
    return dice_pairs(bags, pairs).select("a", "b", F.round("dice", 6).alias("dice"))


# -- Rust by its own parser: nothing in SQL says the same
def _rust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "source_files").select("file_id", "repo", "relative_path", "text", "is_test_path").where(F.col("relative_path").endswith(".rs") & F.col("text").isNotNull()))


@query()
def rust_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1-R19, A8 by repository; repeated rows are dropped once they are measured, when they are small."""
    p = rust_files.parse(_rust(spark, sf_dir), ["file_id", "repo"]).select(
        "file_id", "repo", "failure", F.size("rust.functions").alias("functions"), rust_files.complexity().alias("complexity"), "rust.max_nesting", "rust.performance.unwraps", "rust.items.structs", "rust.public_items"
    ).dropDuplicates(["file_id"])
    return p.groupBy("repo").agg(
        F.count("*").alias("files"), F.count("failure").alias("failures"), F.max("max_nesting").alias("max_nesting"), *(F.sum(c).alias(c) for c in ("functions", "complexity", "unwraps", "structs", "public_items"))
    )


@query()
def rust_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2, A5: identifiers of all Rust texts."""
    return rust_files.census(rust_files.identifier_uses(rust_files.parse(once(_rust(spark, sf_dir), "file_id"), ["file_id"]), "file_id"))


def _inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rust files with the path in their repository's folder, read-only where the table of inputs says so."""
    given = table(spark, sf_dir, "clone_inputs").groupBy("file_id").agg(F.bool_and(F.coalesce("editable", F.lit(True))).alias("given"))
    rows = once(_rust(spark, sf_dir), "file_id").join(given, "file_id", "left")
    own = rows.select(F.concat_ws("/", "repo", "relative_path").alias("relative_path"), F.lit("rust").alias("language"), "text", "is_test_path", F.coalesce("given", F.lit(True)).alias("editable"))
    return detect.clone_inputs(own.where("editable"), own.where("not editable"), None, None, None)


@query(
    f"WITH g AS (SELECT file_id, bool_and(coalesce(editable, true)) AS editable, bool_or(coalesce(is_test_path, false)) AS t FROM clone_inputs GROUP BY 1), gone AS (SELECT DISTINCT repo || '/' || path AS path FROM parse_failures WHERE path IS NOT NULL) "
    f"SELECT f.repo || '/' || f.relative_path AS path, coalesce(f.is_test_path, false) OR coalesce(g.t, false) AS is_test_path, coalesce(g.editable, true) AND NOT regexp_matches(f.repo || '/' || f.relative_path, '^(.*/)?vendor/.*$') AS editable "
    f"FROM {FILES} f LEFT JOIN g USING (file_id) WHERE f.text IS NOT NULL AND ({LANGUAGE.replace('relative_path', 'f.relative_path')}) = 'rust' AND f.repo || '/' || f.relative_path NOT IN (SELECT path FROM gone)"
)
def clone_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own and extra files, without those the log of failures names (in the place of orphans), read-only by glob."""
    given = table(spark, sf_dir, "clone_inputs").groupBy("file_id").agg(F.bool_and(F.coalesce("editable", F.lit(True))).alias("given"), F.bool_or(F.coalesce("is_test_path", F.lit(False))).alias("t"))
    rows = files(spark, sf_dir, "repo", "relative_path", "is_test_path", F.when(F.col("text").isNotNull(), "").alias("text")).join(given, "file_id", "left")
    rows = rows.select(F.concat_ws("/", "repo", "relative_path").alias("relative_path"), lang.language("relative_path").alias("language"), "text", F.coalesce("is_test_path", F.lit(False)).alias("is_test_path"), F.coalesce("given", F.lit(True)).alias("editable"), "t")
    tests = rows.where("t").select(F.col("relative_path").alias("path"))
    gone = table(spark, sf_dir, "parse_failures").where("path is not null").select(F.concat_ws("/", "repo", "path").alias("path")).distinct()
    found = detect.clone_inputs(rows.where("editable").drop("t", "editable"), rows.where("not editable").drop("t"), gone, tests, paths.matches_any("path", ["**/vendor/**"]))
    return found.select("path", "is_test_path", "editable")


@query()
def syntax_tree_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by kind of our own trees."""
    rows = detect.extract(_inputs(spark, sf_dir), "nodes", Clones(), Thresholds())
    return rows.where("named").groupBy("kind").agg(F.count("*").alias("nodes"), F.count_distinct("shape").alias("shapes"), F.sum("leaf_count").alias("leaves"))


@query()
def symbol_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C33, C34, K2."""
    return detect.symbol_index(_inputs(spark, sf_dir))


@query()
def clone_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all layers, with what their copies could share, ranked and without overlaps."""
    inputs = durable(_inputs(spark, sf_dir))
    sketched = sketch_groups(detect.detect(inputs), inputs)
    groups = detect.suppress(detect.score(sketched, F.size("sketch.parameters")), Clones().max_groups)
    return groups.select("id", "kind", "fragment", "copies", "tokens", "lines_saved", "score", "similarity", F.array_join("detectors", ",").alias("detectors"), "sketch.signature")
