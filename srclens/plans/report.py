"""The analysis of a repository as a set of DataFrames, and as one document."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srclens.clones import detect, sketch
from srclens.config import Config
from srclens.functions.paths import matches_any, nearest_owner, notes_for
from srclens.operators import dead_code, dependencies, findings, metrics, module_tree, rust_files
from srclens.operators.checkpoints import durable
from srclens.sources import manifests as manifest_source
from srclens.sources.repo import extra_sources, scan

SCHEMA_VERSION = 1


@dataclass
class Report:
    """All tables of one analysis; each is lazy until it is read."""

    name: str
    root: str
    generated_at: int
    files: DataFrame
    directories: DataFrame
    languages: DataFrame
    totals: DataFrame
    findings: DataFrame
    dead_code: DataFrame
    clones: DataFrame | None
    parse_failures: DataFrame
    packages: DataFrame | None
    edges: DataFrame | None
    duplicates: DataFrame | None
    unused: DataFrame | None

    def document(self) -> dict:
        """The report as plain data; its size is that of one repository's report, not of its sources."""
        rows = lambda df: [json.loads(x) for x in df.toJSON().collect()] if df is not None else []
        return {
            "schema_version": SCHEMA_VERSION, "project": {"name": self.name, "root": self.root, "generated_at_unix": self.generated_at},
            "totals": (rows(self.totals) or [{}])[0], "languages": rows(self.languages), "directories": rows(self.directories),
            "files": rows(self.files.drop("text", "rust", "failure", "absolute_path")), "findings": rows(self.findings), "dead_code": rows(self.dead_code), "clones": rows(self.clones),
            "parse_failures": rows(self.parse_failures), "dependencies": {"packages": rows(self.packages), "edges": rows(self.edges), "duplicates": rows(self.duplicates), "unused": rows(self.unused)},
        }

    def to_json(self) -> str:
        return json.dumps(self.document(), indent=2, ensure_ascii=False)


def read(text: str) -> dict:
    """A report document; parts that older ones lack are empty."""
    doc = json.loads(text)
    for part in ("languages", "directories", "files", "findings", "dead_code", "clones", "parse_failures"):
        doc.setdefault(part, [])
    doc.setdefault("dependencies", {"packages": [], "edges": [], "duplicates": [], "unused": []})
    return doc


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A report file as a row of the given schema; absent fields are null."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def analyze(spark: SparkSession, root: str, config: Config | None = None, metadata: str | None = None, files: DataFrame | None = None, now: int | None = None) -> Report:
    """The whole analysis of a tree, or of ``files`` with the scan's columns."""
    config = config or Config()
    t = config.thresholds
    scanned = durable(scan(spark, root, config.scan) if files is None else files)
    rust = scanned.where("language = 'rust'")
    parsed = durable(rust_files.parse(rust, ["relative_path"]))
    packages = manifest_source.manifests(scanned)
    by_path = parsed.withColumnRenamed("relative_path", "path")
    orphans, test_only = module_tree.resolve(durable(packages), by_path, scanned.select(F.col("relative_path").alias("path")))
    orphans, test_only = durable(orphans), durable(test_only)
    measured = metrics.mark_test_only(metrics.file_metrics(scanned, parsed), test_only)
    measured = nearest_owner(measured, packages).withColumnRenamed("owner", "crate_name")
    measured = durable(notes_for(measured.withColumnRenamed("relative_path", "path"), config.notes)).withColumnRenamed("path", "relative_path")
    failures = parsed.where("failure is not null").select(F.col("relative_path").alias("path"), "failure.line", "failure.message").orderBy("path")

    graph = edges = duplicates = unused = heavy = None
    if config.dependencies.enabled and metadata is not None:
        all_packages, all_edges = manifest_source.load_metadata(spark, metadata)
        graph, edges = dependencies.production_graph(all_packages, all_edges, config.dependencies.include_dev)
        graph, duplicates = durable(graph), dependencies.duplicate_versions(graph)
        named = measured.where("crate_name is not null and rust is not null").select(F.col("crate_name").alias("package"), F.explode("rust.referenced_crates").alias("crate")).distinct()
        unused = dependencies.unused(all_packages, named, config.dependencies.ignore_unused, config.dependencies.include_dev)
        heavy = dependencies.heaviest_direct(graph)

    tests = measured.select(F.col("relative_path").alias("file"), F.col("is_test").alias("is_test_file"))
    inputs = measured.where("rust is not null").join(orphans.withColumnRenamed("path", "relative_path"), "relative_path", "left_anti").select(F.col("relative_path").alias("file"), F.col("is_test").alias("is_test_file"), "rust")
    dead = dead_code.analyze(inputs, config.dead_code)
    if config.dead_code.enabled:
        dead = dead_code.add_orphans(dead, orphans, tests)
    dead = durable(dead)

    groups = None
    if config.clones.enabled:
        read_only = matches_any("path", config.clones.read_only)
        source = durable(detect.clone_inputs(scanned, extra_sources(spark, root, config) if files is None else None, orphans, test_only, read_only))
        found = detect.detect(source, config.clones, t)
        sketched = sketch.sketch_groups(found, source)
        scored = detect.score(sketched, F.size("sketch.parameters"))
        groups = durable(detect.suppress(scored, config.clones.max_groups).withColumn("signature", F.col("sketch.signature")).drop("units", "places"))

    as_path = measured.withColumnRenamed("relative_path", "path")
    directories = metrics.directories(measured)
    parts = [
        *findings.file_rules(as_path, t), *findings.function_rules(as_path, t), *findings.directory_rules(directories, t),
        *findings.dependency_rules(heavy, duplicates, unused, t), *findings.dead_code_rules(dead, as_path), *findings.parse_failure_rules(failures),
    ]
    if groups is not None:
        parts += findings.clone_rules(groups.withColumnRenamed("rank", "n"), t)
    return Report(
        config.display_name(root), str(root), int(time.time()) if now is None else now, metrics.by_weight(measured), directories, metrics.languages(measured),
        metrics.totals(measured, graph.count() if graph is not None else 0), durable(findings.ranked(parts)), dead_code.ordered(dead), groups, failures, graph, edges, duplicates, unused,
    )


def symbol_index(spark: SparkSession, root: str, config: Config | None = None) -> DataFrame:
    """Symbols of all Rust files, whether or not a module declares them."""
    config = config or Config()
    source = detect.clone_inputs(scan(spark, root, config.scan), extra_sources(spark, root, config), None, None, matches_any("path", config.clones.read_only))
    return detect.symbol_index(source, config.clones, config.thresholds)


def symbols_to_json_lines(symbols: DataFrame) -> str:
    """One compact object a line (K2); use ``symbols.write.json`` for what doesn't fit on one machine."""
    return "".join(x + "\n" for x in symbols.toJSON().toLocalIterator())


