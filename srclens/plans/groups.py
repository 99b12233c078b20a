"""Queries of clone grouping over the recorded candidates: equal shapes are the groups, and a second layer is made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srclens.clones import detect
from srclens.functions.similarity import dice_sets, estimated_jaccard
from srclens.operators.checkpoints import durable
from srclens.plans.base import SYMBOLS, query, table

_CAND = (
    "cand AS (SELECT DISTINCT ON (candidate_id) candidate_id AS node, fragment, shape, repo || '/' || file AS path, start_line, end_line, tokens, code, regexp_replace(code, '[A-Za-z0-9_]+', 'x', 'g') AS seq, "
    "candidate_id % 7 = 0 AS test, candidate_id % 5 <> 0 AS editable FROM clone_candidates WHERE shape IS NOT NULL), "
    "g1 AS (SELECT fragment || ' ' || shape AS gid, fragment, shape, count(*) AS n, fragment <> 'type_shape' AND count(DISTINCT seq) > 1 AS reordered, CASE WHEN fragment <> 'type_shape' AND count(DISTINCT seq) > 1 THEN 'near_miss' WHEN count(DISTINCT code) = 1 THEN 'exact' ELSE 'renamed' END AS kind "
    "FROM cand GROUP BY 1, 2, 3 HAVING count(*) > 1)"
)
#: The greedy choice of units that don't overlap the last one kept of their file.
_TIDY = (
    _CAND + ", u AS (SELECT g1.gid, g1.kind, c.*, row_number() OVER (PARTITION BY g1.gid, c.path ORDER BY c.start_line, c.end_line DESC, c.node) AS ord FROM cand c JOIN g1 USING (fragment, shape)), "
    "chosen AS (SELECT gid, path, ord, end_line FROM u WHERE ord = 1 UNION ALL SELECT u.gid, u.path, u.ord, u.end_line FROM chosen k JOIN u ON u.gid = k.gid AND u.path = k.path AND u.start_line > k.end_line QUALIFY row_number() OVER (PARTITION BY u.gid, u.path ORDER BY u.ord) = 1), "
    "unit AS (SELECT u.* FROM u JOIN chosen USING (gid, path, ord)), "
    "inner_ AS (SELECT DISTINCT gid FROM (SELECT u.gid, u.end_line, max_by(k.end_line, k.ord) AS last FROM u JOIN chosen k ON k.gid = u.gid AND k.path = u.path AND k.ord < u.ord WHERE NOT EXISTS (SELECT 1 FROM chosen c WHERE c.gid = u.gid AND c.path = u.path AND c.ord = u.ord) GROUP BY u.gid, u.path, u.ord, u.end_line) WHERE end_line <= last), "
    "tidied AS (SELECT gid, fragment, kind, count(*) AS n, max(tokens) AS tokens, max(end_line - start_line + 1) AS lines, bool_and(test) AS in_tests, bool_or(NOT editable) AS read_only, bool_or(editable) AS has_own, "
    "list({'path': path, 'start_line': start_line, 'end_line': end_line, 'editable': editable} ORDER BY path, start_line, end_line DESC) AS units FROM unit GROUP BY 1, 2, 3 HAVING count(*) > 1)"
)
BUILT = _TIDY + ", built AS (SELECT *, greatest((n - 1) * lines - n, 0) AS lines_saved FROM tidied WHERE has_own)"


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates as fragments of trees; numbers stand for texts, as hashes do in trees."""
    c = table(spark, sf_dir, "clone_candidates").where("shape is not null").dropDuplicates(["candidate_id"])
    return c.select(
        "fragment", F.xxhash64("shape").alias("shape"), F.concat_ws("/", "repo", "file").alias("path"), "start_line", "end_line", F.col("candidate_id").cast("int").alias("node"), "tokens", F.xxhash64("code").alias("exact"),
        F.xxhash64(F.regexp_replace("code", "[A-Za-z0-9_]+", "x")).alias("sequence"), (F.col("candidate_id") % 7 == 0).alias("test"), F.lit(False).alias("file_is_test"), (F.col("candidate_id") % 5 != 0).alias("editable"), F.col("fragment").alias("item"),
    )


def tidied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.tidy(detect.subtree_groups(fragments(spark, sf_dir)))


def built(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.build(tidied(spark, sf_dir), True)


@query(f"WITH {_CAND} SELECT fragment, kind, reordered, n::INT AS copies, first AS first_path FROM g1 JOIN (SELECT fragment, shape, min(path) AS first FROM cand GROUP BY 1, 2) USING (fragment, shape)")
def subtree_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C13, C14, A10."""
    return detect.subtree_groups(fragments(spark, sf_dir)).select("fragment", "kind", "reordered", F.size("units").alias("copies"), F.element_at("units", 1)["path"].alias("first_path"))


@query(f"WITH RECURSIVE {_TIDY} SELECT fragment, kind, n::INT AS copies, gid IN (SELECT gid FROM inner_) AS recursive, units[1].path AS first_path, units[1].start_line AS first_line FROM tidied")
def tidy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C24."""
    first = F.element_at("units", 1)
    return tidied(spark, sf_dir).select("fragment", "kind", F.size("units").alias("copies"), "recursive", first["path"].alias("first_path"), first["start_line"].alias("first_line"))


@query(f"WITH RECURSIVE {BUILT} SELECT fragment, n::INT AS copies, tokens, lines_saved, in_tests, read_only, round((n - 1) * tokens / (1 + (n % 5) / 8.0) * CASE WHEN in_tests THEN 0.5 ELSE 1 END * CASE WHEN read_only THEN 0.5 ELSE 1 END, 6)::DOUBLE AS score FROM built")
def scored_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with the rest of their size by five as parameters."""
    rows = detect.score(built(spark, sf_dir), F.size("units") % 5)
    return rows.select("fragment", "copies", "tokens", "lines_saved", "in_tests", "read_only", F.round("score", 6).alias("score"))


@query(f"WITH RECURSIVE {_TIDY} SELECT fragment, kind, n::INT AS copies, 1.0::DOUBLE AS similarity, 'subtree,min_hash' AS detectors FROM tidied")
def merged_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group meets itself as a near miss of another layer."""
    own = durable(tidied(spark, sf_dir))
    other = own.withColumn("kind", F.lit("near_miss")).withColumn("similarity", F.lit(0.9)).withColumn("detectors", F.array(F.lit("min_hash")))
    return detect.merge(own.unionByName(other)).select("fragment", "kind", F.size("units").alias("copies"), "similarity", F.array_join("detectors", ",").alias("detectors"))


#: Each group again, a line less at both ends; where its first line is odd, three lines further down.
_TWO = (
    ", two AS (SELECT gid || ' 1' AS id, gid, 1 AS layer, n, u.path, u.start_line AS a, u.end_line AS b FROM (SELECT gid, n, unnest(units) AS u FROM tidied) UNION ALL "
    "SELECT gid || ' 2', gid, 2, n, u.path, u.start_line + CASE WHEN odd THEN 3 ELSE 1 END, u.end_line + CASE WHEN odd THEN 3 ELSE -1 END FROM (SELECT gid, n, units[1].start_line % 2 = 1 AS odd, unnest(units) AS u FROM tidied))"
)


def _second(groups: DataFrame) -> DataFrame:
    odd = F.element_at("units", 1)["start_line"] % 2 == 1
    down, up = F.when(odd, 3).otherwise(1), F.when(odd, 3).otherwise(-1)
    return groups.withColumn("units", F.transform("units", lambda u: u.withField("start_line", u["start_line"] + down).withField("end_line", u["end_line"] + up)))


@query(
    f"WITH RECURSIVE {_TIDY}{_TWO}, places AS (SELECT id, string_agg(path || ':' || a || '-' || b, ',' ORDER BY path, a, b) AS p FROM two GROUP BY 1), one AS (SELECT p, min(id) AS id FROM places GROUP BY 1), part AS (SELECT two.*, row_number() OVER (PARTITION BY two.id ORDER BY path, a, b) AS k FROM two JOIN one USING (id)), "
    "gone AS (SELECT DISTINCT id FROM (SELECT i.id, o.id AS by, i.n FROM part i JOIN part o ON i.path = o.path AND i.id <> o.id AND o.n >= i.n AND o.a <= i.a AND i.b <= o.b GROUP BY 1, 2, 3 HAVING count(DISTINCT i.k) = i.n)) "
    "SELECT string_split(id, ' ')[1] AS fragment, n::INT AS copies, min(path) AS first_path, min_by(a, path) AS first_line FROM part WHERE id NOT IN (SELECT id FROM gone) GROUP BY id, n"
)
def subsumed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C26, J8."""
    own = durable(tidied(spark, sf_dir))
    first = F.element_at("units", 1)
    kept = detect.drop_subsumed(detect.merge(own.unionByName(_second(own))))
    return kept.select("fragment", F.size("units").alias("copies"), first["path"].alias("first_path"), first["start_line"].alias("first_line"))


@query(
    f"WITH RECURSIVE {BUILT}{_TWO}, score AS (SELECT gid, round((n - 1) * tokens * CASE WHEN in_tests THEN 0.5 ELSE 1 END * CASE WHEN read_only THEN 0.5 ELSE 1 END, 6) AS s FROM built), part AS (SELECT two.*, s, row_number() OVER (PARTITION BY id ORDER BY path, a) AS k FROM two JOIN score USING (gid)), "
    "ranked AS (SELECT id, n, row_number() OVER (ORDER BY s DESC, p, a) AS r FROM (SELECT id, n, s, min(path) AS p, min_by(a, path) AS a FROM part WHERE k = 1 GROUP BY 1, 2, 3)), flat AS (SELECT r, part.* FROM part JOIN ranked USING (id)), "
    "touch AS (SELECT a.r, a.k, list(DISTINCT b.r) AS byr FROM flat a JOIN flat b ON a.path = b.path AND b.r < a.r AND a.a <= b.b AND b.a <= a.b GROUP BY 1, 2), lists AS (SELECT r, n, coalesce(t, []) AS t FROM ranked LEFT JOIN (SELECT r, list(byr) AS t FROM touch GROUP BY 1) USING (r)), "
    "greedy AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS kept UNION ALL SELECT g.r + 1, CASE WHEN 2 * len(list_filter(l.t, lambda x: len(list_intersect(x, g.kept)) > 0)) > l.n THEN g.kept ELSE list_append(g.kept, g.r + 1) END FROM greedy g JOIN lists l ON l.r = g.r + 1), "
    "last AS (SELECT unnest(kept) AS r FROM greedy WHERE r = (SELECT max(r) FROM greedy)) SELECT string_split(id, ' ')[1] AS fragment, ranked.n::INT AS copies, min(path) AS first_path, min_by(a, path) AS first_line FROM last JOIN ranked USING (r) JOIN part USING (id) WHERE k = 1 GROUP BY 1, 2, ranked.r"
)
def suppressed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C28, C29, J9."""
    own = durable(built(spark, sf_dir))
    kept = detect.suppress(detect.score(own.unionByName(_second(own)), F.lit(0)), 1_000_000)
    first = F.element_at("units", 1)
    return kept.select("fragment", "copies", first["path"].alias("first_path"), first["start_line"].alias("first_line"))


@query(
    f"WITH s AS (SELECT symbol_id, coalesce(tokens, 0) AS t, coalesce(start_line, 0) AS l, kind, list_distinct(list_filter(coalesce(types, []), lambda x: x IS NOT NULL)) AS ts FROM {SYMBOLS}), p AS (SELECT *, lead(symbol_id) OVER (PARTITION BY kind ORDER BY symbol_id) AS b FROM s) "
    "SELECT p.symbol_id AS a, p.b, ((p.t % 3 = q.t % 3)::INT + (p.l % 2 = q.l % 2)::INT + (p.t % 5 = q.t % 5)::INT + (p.l % 7 = q.l % 7)::INT) / 4.0::DOUBLE AS jaccard, "
    "CASE WHEN len(p.ts) + len(q.ts) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(p.ts, q.ts)) / (len(p.ts) + len(q.ts)) END::DOUBLE AS dice FROM p JOIN s q ON q.symbol_id = p.b"
)
def sketch_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F21-F23 between neighbours of a kind: signatures of four places, and sets of types."""
    from pyspark.sql.window import Window

    s = table(spark, sf_dir, "symbols").dropDuplicates(["symbol_id"])
    t, line = F.coalesce("tokens", F.lit(0)), F.coalesce("start_line", F.lit(0))
    types = F.array_distinct(F.array_compact(F.coalesce("types", F.array().cast("array<string>"))))
    rows = s.select("symbol_id", F.lead("symbol_id").over(Window.partitionBy("kind").orderBy("symbol_id")).alias("b"), F.array(t % 3, line % 2, t % 5, line % 7).alias("sig"), types.alias("types"))
    other = rows.select(F.col("symbol_id").alias("b"), F.col("sig").alias("sig_b"), F.col("types").alias("types_b"))
    return rows.where("b is not null").join(other, "b").select(F.col("symbol_id").alias("a"), "b", estimated_jaccard("sig", "sig_b").alias("jaccard"), dice_sets("types", "types_b").alias("dice"))


@query(
    f"WITH k AS (SELECT CAST(symbol_id AS VARCHAR) AS key, kind, shape, tokens AS h0, start_line AS h1, tokens AS size FROM {SYMBOLS} WHERE kind = 'function_item' AND shape IS NOT NULL AND tokens IS NOT NULL AND start_line IS NOT NULL) "
    "SELECT a.key AS a, b.key AS b FROM k a JOIN k b ON a.kind = b.kind AND a.key < b.key AND (a.h0 = b.h0 AND a.h0 % 2 = 0 OR a.h1 = b.h1 AND a.h1 % 3 = 0)"
)
def bucket_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions in a bucket by their tokens, if even, or their first lines, if a third of them; some buckets are large."""
    s = table(spark, sf_dir, "symbols").dropDuplicates(["symbol_id"]).where("kind = 'function_item' and shape is not null and tokens is not null and start_line is not null")
    key = F.col("symbol_id").cast("string")
    alone = F.xxhash64("symbol_id")
    bands = F.array(F.when(F.col("tokens") % 2 == 0, F.col("tokens")).otherwise(alone), F.when(F.col("start_line") % 3 == 0, F.col("start_line")).otherwise(alone))
    rows = s.select(key.alias("key"), F.col("kind").alias("fragment"), F.col("symbol_id").alias("shape"), bands.alias("bands"))
    return detect.lsh_pairs(rows, bands=2)
