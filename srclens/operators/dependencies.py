"""Package graphs: what is reached, what only one dependency brings in, and what removing it would save.

``packages``: id, name, version, source_bytes, is_workspace_member, ...; ``edges``: from, to, kind. All reachability is a
loop over the frontier with an anti-join on what is known, for all starting points at once. How packages are counted
follows the published description of the analysis, as noted at each function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srclens.operators.checkpoints import durable


def normalize_crate_name(name: str | Column) -> Column:
    """Source code writes hyphens as underscores."""
    return F.replace(name if isinstance(name, Column) else F.col(name), F.lit("-"), F.lit("_"))


def closure(start: DataFrame, edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Everything that is reached from ``start`` (keys..., node): keys, node and the least ``depth``.

    ``edges`` (from, to), with the same keys if they differ by key. Rounds are as many as the longest shortest path.
    """
    keys = keys or []
    by = [k for k in keys if k in edges.columns]
    new = durable(start.select(*keys, "node").distinct().withColumn("depth", F.lit(0)))
    seen = new
    while not new.isEmpty():
        step = new.withColumnRenamed("node", "from").join(edges.select(*by, "from", "to"), [*by, "from"]).select(*keys, F.col("to").alias("node"), F.col("depth") + 1)
        step = step.toDF(*keys, "node", "depth").distinct()
        new = durable(step.join(seen.select(*keys, "node"), [*keys, "node"], "left_anti"))
        seen = durable(seen.unionByName(new))
    return seen


def reachable(packages: DataFrame, edges: DataFrame, cut: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """``node`` of the external packages that the workspace reaches.

    ``cut``: ids that are never entered. ``removed``: ids that members no longer depend on themselves, though others may.
    """
    members = packages.where("is_workspace_member").select(F.col("id").alias("node"))
    used = edges.select("from", "to").distinct()
    if cut is not None:
        used = used.join(cut.select(F.col("id").alias("to")), "to", "left_anti")
    if removed is not None:
        gone = used.join(members.withColumnRenamed("node", "from"), "from", "left_semi").join(removed.select(F.col("id").alias("to")), "to", "left_semi")
        used = used.join(gone, ["from", "to"], "left_anti")
    return closure(members, used).join(members, "node", "left_anti").select("node")


def direct(packages: DataFrame, edges: DataFrame) -> DataFrame:
    """``id`` of the external packages that a member depends on itself."""
    members = packages.where("is_workspace_member").select("id")
    near = edges.join(members.withColumnRenamed("id", "from"), "from", "left_semi").select(F.col("to").alias("id")).distinct()
    return near.join(members, "id", "left_anti")


def exclusive_counts(packages: DataFrame, edges: DataFrame) -> DataFrame:
    """``id``, ``exclusive_count``: packages that nothing but this direct dependency brings in, itself among them.

    Those are the packages that the dependency dominates: every way to them from a member goes through it. A package's
    dominators are what all its users have in common, and itself if it is direct; this is iterated for all packages at
    once, from "everything" (a user that isn't known yet is left out) down to the fixpoint. No pairs of starts are formed.
    """
    members = packages.where("is_workspace_member").select(F.col("id").alias("node"))
    near = durable(direct(packages, edges).select(F.col("id").alias("node")))
    used = durable(edges.select("from", "to").distinct().join(members.withColumnRenamed("node", "to"), "to", "left_anti"))
    known = durable(members)
    own = near.select("node", F.col("node").alias("d"))
    dominated = durable(own.limit(0))
    state: tuple = ()
    while True:
        step = used.join(known.withColumnRenamed("node", "from"), "from")
        users = step.groupBy("to").agg(F.count("*").alias("n"))
        common = step.join(dominated.withColumnRenamed("node", "from"), "from").groupBy("to", "d").agg(F.count("*").alias("c")).join(users, "to").where("c = n")
        known = durable(members.unionByName(users.select(F.col("to").alias("node"))).distinct())
        dominated = durable(common.select(F.col("to").alias("node"), "d").unionByName(own.join(known, "node", "left_semi")).distinct())
        new = known.count(), *dominated.agg(F.count("*"), F.sum(F.xxhash64("node", "d").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    counts = dominated.groupBy(F.col("d").alias("id")).agg(F.count("*").alias("exclusive_count"))
    return near.select(F.col("node").alias("id")).join(counts, "id", "left").select("id", F.coalesce("exclusive_count", F.lit(0)).alias("exclusive_count"))


def transitive_counts(packages: DataFrame, edges: DataFrame) -> DataFrame:
    """``id``, ``transitive_count``: distinct packages below each, itself not among them."""
    start = packages.select(F.col("id").alias("origin"), F.col("id").alias("node"))
    below = closure(start, edges.select("from", "to").distinct(), ["origin"]).where("node <> origin")
    counts = below.groupBy("origin").agg(F.count("*").alias("n"))
    return packages.select("id").join(counts.withColumnRenamed("origin", "id"), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("transitive_count"))


def depths(packages: DataFrame, edges: DataFrame) -> DataFrame:
    """``id``, ``depth``: members 0, others by their least distance from one."""
    members = packages.where("is_workspace_member").select(F.col("id").alias("node"))
    return closure(members, edges.select("from", "to").distinct()).select(F.col("node").alias("id"), "depth")


def children(packages: DataFrame, edges: DataFrame, of: str, alive: DataFrame | None = None) -> DataFrame:
    """Distinct children of a package that are still reached, by name."""
    rows = edges.where(F.col("from") == of).select(F.col("to").alias("id")).distinct()
    if alive is not None:
        rows = rows.join(alive.select(F.col("node").alias("id")), "id", "left_semi")
    return rows.join(packages.select("id", "name", "version"), "id").orderBy("name", "version")


def subtree(packages: DataFrame, edges: DataFrame, of: str, max_depth: int) -> DataFrame:
    """Packages at most ``max_depth`` steps below one, with their least depth, by depth and name."""
    start = packages.where(F.col("id") == of).select(F.col("id").alias("node"))
    used = edges.select("from", "to").distinct()
    new = durable(start.withColumn("depth", F.lit(0)))
    seen = new
    for depth in range(1, max_depth + 1):
        step = new.withColumnRenamed("node", "from").join(used, "from").select(F.col("to").alias("node")).distinct()
        new = durable(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        seen = durable(seen.unionByName(new))
    return seen.join(packages.select(F.col("id").alias("node"), "name"), "node").orderBy("depth", "name")


def simulate_removal(packages: DataFrame, edges: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left without some direct dependencies (G11): (retained and their bytes; packages no longer reached)."""
    before = reachable(packages, edges)
    after = durable(reachable(packages, edges, removed=removed))
    sizes = packages.select(F.col("id").alias("node"), "name", "version", "source_bytes")
    lost = before.join(after, "node", "left_anti").join(sizes, "node").orderBy("name", "version")
    kept = after.join(sizes, "node").agg(F.count("*").alias("retained"), F.coalesce(F.sum("source_bytes"), F.lit(0)).alias("retained_bytes"))
    return kept, lost


def simulate_features(packages: DataFrame, overrides: DataFrame) -> DataFrame:
    """Features with some switched (id, on, off); the graph stays as it is."""
    rows = packages.join(overrides, "id", "left")
    none = F.array().cast("array<string>")
    return rows.withColumn("features", F.array_sort(F.array_union(F.array_except("features", F.coalesce("off", none)), F.array_intersect(F.coalesce("on", none), "available_features")))).drop("on", "off")


def production_graph(packages: DataFrame, edges: DataFrame, include_dev: bool = False) -> tuple[DataFrame, DataFrame]:
    """The graph without development edges and what only they reach (G13, as described, not read): build edges stay, packages
    are by name, and edges join packages that are there."""
    used = edges if include_dev else edges.where("kind <> 'development'")
    members = packages.where("is_workspace_member").select(F.col("id").alias("node"))
    alive = durable(closure(members, used.select("from", "to").distinct()).select(F.col("node").alias("id")))
    kept = packages.join(alive, "id", "left_semi")
    near = direct(packages, used).withColumn("is_direct", F.lit(True))
    counted = (
        kept.join(near, "id", "left").withColumn("is_direct", F.coalesce("is_direct", F.lit(False)))
        .join(transitive_counts(kept, used), "id", "left").join(exclusive_counts(kept, used), "id", "left")
        .join(depths(kept, used), "id", "left").fillna(0, ["transitive_count", "exclusive_count"])
    )
    kinds = used.groupBy(F.col("to").alias("id")).agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    inner = used.join(alive.withColumnRenamed("id", "from"), "from", "left_semi").join(alive.withColumnRenamed("id", "to"), "to", "left_semi")
    return counted.join(kinds, "id", "left").orderBy("name", "version"), inner.select("from", "to", "kind").distinct()


def heaviest_direct(counted: DataFrame) -> DataFrame:
    """Direct external packages by what they alone bring in (G14, as described)."""
    return counted.where("is_direct and not is_workspace_member").orderBy(F.desc("exclusive_count"), "name")


def duplicate_versions(packages: DataFrame) -> DataFrame:
    """``name``, ``versions`` of names that are there more than once (G15, as described)."""
    return packages.groupBy("name").agg(F.array_sort(F.collect_set("version")).alias("versions")).where(F.size("versions") > 1).orderBy("name")


def unused(packages: DataFrame, referenced: DataFrame, ignore: list[str] | None = None, include_dev: bool = False) -> DataFrame:
    """``package``, ``dependency``, ``kind`` of declared dependencies that no path names (G16, J13, as described).

    ``referenced``: package, crate. Packages without analysed source have no rows there and are skipped.
    """
    declared = packages.where("is_workspace_member").select(F.col("name").alias("package"), F.explode("dependencies").alias("d")).select("package", F.col("d.name").alias("dependency"), F.col("d.kind").alias("kind"))
    if not include_dev:
        declared = declared.where("kind <> 'development'")
    if ignore:
        declared = declared.where(~F.col("dependency").isin(*ignore))
    analysed = referenced.select("package").distinct()
    named = referenced.select("package", F.col("crate").alias("word")).distinct()
    return (
        declared.join(analysed, "package", "left_semi").withColumn("word", normalize_crate_name("dependency"))
        .join(named, ["package", "word"], "left_anti").select("package", "dependency", "kind").orderBy("package", "dependency", "kind")
    )


def source_bytes(files: DataFrame) -> DataFrame:
    """``dir``, ``source_bytes`` of package directories' files, without ``.git`` and ``target`` (G17, as described)."""
    return files.where(~F.col("relative_path").rlike(r"(?:^|/)(?:\.git|target)/")).groupBy("dir").agg(F.sum("bytes").alias("source_bytes"))
