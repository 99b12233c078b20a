"""Queries of the package graph: parts of size 1 are members that depend on suppliers, these on nations and those on regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srclens.operators import dependencies
from srclens.operators.checkpoints import durable
from srclens.plans.base import FILES, query, table

GRAPH = (
    "WITH RECURSIVE p AS (SELECT 'p' || p_partkey AS id, p_size = 1 AS m, p_size::BIGINT AS bytes FROM part UNION ALL SELECT 's' || s_suppkey, false, s_suppkey::BIGINT FROM supplier UNION ALL SELECT 'n' || n_nationkey, false, 10 FROM nation UNION ALL SELECT 'r' || r_regionkey, false, 100 FROM region), "
    "e AS (SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"
)
REACHED = "w AS (SELECT id AS node FROM p WHERE m UNION SELECT e.b FROM w JOIN e ON e.a = w.node)"


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    read = lambda t: table(spark, sf_dir, t)

    def node(df: DataFrame, mark: str, key: str, size, member=None) -> DataFrame:
        name = F.concat(F.lit(mark), key)
        return df.select(name.alias("id"), name.alias("name"), F.lit("1").alias("version"), (member if member is not None else F.lit(False)).alias("is_workspace_member"), size.cast("bigint").alias("source_bytes"))

    packages = (
        node(read("part"), "p", "p_partkey", F.col("p_size"), F.col("p_size") == 1).unionByName(node(read("supplier"), "s", "s_suppkey", F.col("s_suppkey")))
        .unionByName(node(read("nation"), "n", "n_nationkey", F.lit(10))).unionByName(node(read("region"), "r", "r_regionkey", F.lit(100)))
    )
    edge = lambda df, m, a, n, b: df.select(F.concat(F.lit(m), a).alias("from"), F.concat(F.lit(n), b).alias("to")).distinct()
    edges = edge(read("lineitem"), "p", "l_partkey", "s", "l_suppkey").unionByName(edge(read("supplier"), "s", "s_suppkey", "n", "s_nationkey")).unionByName(edge(read("nation"), "n", "n_nationkey", "r", "n_regionkey"))
    return durable(packages), durable(edges)


@query(GRAPH + f", {REACHED} SELECT node FROM w JOIN p ON p.id = w.node WHERE NOT p.m")
def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G6, J12."""
    return dependencies.reachable(*graph(spark, sf_dir)).select("node")


@query(GRAPH + ", w AS (SELECT id AS origin, id AS node FROM p UNION SELECT w.origin, e.b FROM w JOIN e ON e.a = w.node) SELECT origin AS id, (count(*) - 1)::BIGINT AS transitive_count FROM w GROUP BY 1")
def transitive_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G8 for all packages at once."""
    return dependencies.transitive_counts(*graph(spark, sf_dir))


_EXCLUSIVE = (
    "d AS (SELECT DISTINCT e.b AS id FROM e JOIN p ON p.id = e.a AND p.m), " + REACHED + ", "
    "x AS (SELECT d.id AS cut, p.id AS node FROM d, p WHERE p.m UNION SELECT x.cut, e.b FROM x JOIN e ON e.a = x.node AND e.b <> x.cut), k AS (SELECT cut, count(*) FILTER (NOT p.m) AS kept FROM x JOIN p ON p.id = x.node GROUP BY 1), "
    "ex AS (SELECT k.cut AS id, ((SELECT count(*) FROM w JOIN p ON p.id = w.node WHERE NOT p.m) - k.kept)::BIGINT AS exclusive_count FROM k)"
)


@query(GRAPH + f", {_EXCLUSIVE} SELECT * FROM ex")
def exclusive_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G7 for all direct dependencies at once."""
    return dependencies.exclusive_counts(*graph(spark, sf_dir))


_LEFT = GRAPH + f", {REACHED}, u AS (SELECT * FROM e WHERE NOT (a IN (SELECT id FROM p WHERE m) AND b LIKE 's%7')), v AS (SELECT id AS node FROM p WHERE m UNION SELECT u.b FROM v JOIN u ON u.a = v.node)"


def _removal(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    packages, edges = graph(spark, sf_dir)
    return dependencies.simulate_removal(packages, edges, packages.where("id like 's%7'").select("id"))


@query(_LEFT + " SELECT node, bytes AS source_bytes FROM w JOIN p ON p.id = w.node WHERE node NOT IN (SELECT node FROM v)")
def removal_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What members no longer reach without the suppliers whose key ends in 7."""
    return _removal(spark, sf_dir)[1].select("node", "source_bytes")


@query(_LEFT + " SELECT count(*)::BIGINT AS retained, sum(bytes)::BIGINT AS retained_bytes FROM v JOIN p ON p.id = v.node WHERE NOT p.m")
def removal_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G11, A12."""
    return _removal(spark, sf_dir)[0]


@query(GRAPH + ", w AS (SELECT 'p1' AS node, 0 AS depth UNION SELECT e.b, w.depth + 1 FROM w JOIN e ON e.a = w.node WHERE w.depth < 2) SELECT node, min(depth)::INT AS depth FROM w GROUP BY 1")
def subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps below one part."""
    return dependencies.subtree(*graph(spark, sf_dir), "p1", 2).select("node", "depth")


@query(GRAPH + f", {REACHED} SELECT e.b AS id FROM e JOIN w ON w.node = e.b WHERE e.a = 'p1'")
def package_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one part uses, as far as members reach it."""
    packages, edges = graph(spark, sf_dir)
    return dependencies.children(packages, edges, "p1", dependencies.reachable(packages, edges)).select("id")


_PRODUCTION = (
    GRAPH.replace("e AS (", "e0 AS (") + ", e AS (SELECT * FROM e0 WHERE NOT (b LIKE 's%3')), " + _EXCLUSIVE + ", t AS (SELECT node AS origin, node FROM w UNION SELECT t.origin, e.b FROM t JOIN e ON e.a = t.node), "
    "tc AS (SELECT origin AS id, (count(*) - 1)::BIGINT AS transitive_count FROM t GROUP BY 1), dp AS (SELECT id AS node, 0 AS depth FROM p WHERE m UNION SELECT e.b, dp.depth + 1 FROM dp JOIN e ON e.a = dp.node WHERE dp.depth < 6), dm AS (SELECT node AS id, min(depth)::INT AS depth FROM dp GROUP BY 1), "
    "pg AS (SELECT p.id, p.id IN (SELECT id FROM d) AND NOT p.m AS is_direct, transitive_count, coalesce(exclusive_count, 0)::BIGINT AS exclusive_count, depth FROM w JOIN p ON p.id = w.node JOIN tc USING (id) JOIN dm USING (id) LEFT JOIN ex USING (id))"
)


def _production(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages, edges = graph(spark, sf_dir)
    kind = F.when(F.col("to").like("s%3"), "development").otherwise("normal")
    return dependencies.production_graph(packages, edges.withColumn("kind", kind))[0]


@query(_PRODUCTION + " SELECT * FROM pg")
def production_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the suppliers whose key ends in 3, which are used in development only."""
    return _production(spark, sf_dir).select("id", "is_direct", "transitive_count", "exclusive_count", "depth")


@query(_PRODUCTION + " SELECT id, exclusive_count FROM pg WHERE is_direct ORDER BY exclusive_count DESC, id LIMIT 10")
def heaviest_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G14, the first ten."""
    return dependencies.heaviest_direct(_production(spark, sf_dir)).limit(10).select("id", "exclusive_count")


@query("SELECT p_name AS name, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS versions FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def duplicate_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one name in more than one type."""
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("version"))
    return dependencies.duplicate_versions(rows).select("name", F.array_join("versions", ",").alias("versions"))


@query("SELECT p_partkey AS id, array_to_string(list_sort(list_distinct(list_concat(CASE WHEN p_size % 2 = 0 THEN [] ELSE [p_brand] END, CASE WHEN p_size % 3 = 0 THEN [p_type] ELSE [] END))), ',') AS features FROM part")
def feature_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of even size lose their brand, those whose size three divides get their type and something unknown."""
    part = table(spark, sf_dir, "part")
    packages = part.select(F.col("p_partkey").alias("id"), F.array("p_brand").alias("features"), F.array("p_brand", "p_type").alias("available_features"))
    on = F.when(F.col("p_size") % 3 == 0, F.array(F.col("p_type"), F.lit("unknown")))
    off = F.when(F.col("p_size") % 2 == 0, F.array("p_brand"))
    overrides = part.where("p_size % 2 = 0 or p_size % 3 = 0").select(F.col("p_partkey").alias("id"), on.alias("on"), off.alias("off"))
    return dependencies.simulate_features(packages, overrides).select("id", F.array_join("features", ",").alias("features"))


@query(f"SELECT repo AS dir, sum(bytes)::BIGINT AS source_bytes FROM {FILES} WHERE NOT regexp_matches(relative_path, '(^|/)(\\.git|target)/') GROUP BY 1")
def source_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G17."""
    rows = table(spark, sf_dir, "source_files").select("file_id", "repo", "relative_path", "bytes").dropDuplicates(["file_id"])
    return dependencies.source_bytes(rows.withColumnRenamed("repo", "dir")).where("source_bytes is not null")
