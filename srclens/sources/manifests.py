"""Package manifests in a scan, and a resolved package graph saved as JSON."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srclens.functions.paths import directory, file_name

MANIFEST = "dir string, name string, manifest string"


def manifests(files: DataFrame) -> DataFrame:
    """``dir``, ``name``, ``manifest`` (as JSON) of every ``Cargo.toml`` that names a package; those that can't be read are skipped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for d, t in zip(pdf.dir, pdf.text):
                try:
                    data = tomllib.loads(t)
                except (tomllib.TOMLDecodeError, RecursionError):
                    continue
                package = data.get("package")
                if isinstance(package, dict) and isinstance(package.get("name"), str):
                    out.append((d, package["name"], json.dumps(data, default=str)))
            yield pd.DataFrame(out, columns=["dir", "name", "manifest"])

    rows = files.where((file_name("relative_path") == "Cargo.toml") & F.col("text").isNotNull())
    return rows.select(directory("relative_path").alias("dir"), "text").mapInPandas(run, MANIFEST)


PACKAGES = (
    "id string, name string, version string, source_bytes bigint, is_workspace_member boolean, is_root_package boolean, "
    "features array<string>, available_features array<string>, dependencies array<struct<name:string,kind:string,optional:boolean>>, manifest_path string"
)
EDGES = "`from` string, `to` string, kind string"
_KIND = {None: "normal", "normal": "normal", "build": "build", "dev": "development"}


def load_metadata(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Packages and edges of a saved ``cargo metadata`` document; two empty tables if there is none that can be read.

    The document describes one workspace, whose size is that of its lock file: it is read on the driver.
    """
    try:
        with open(path, encoding="utf-8") as f:
            doc = json.load(f)
        members = set(doc.get("workspace_members", []))
        nodes = {n["id"]: n for n in (doc.get("resolve") or {}).get("nodes", [])}
        root = (doc.get("resolve") or {}).get("root")
        packages = [
            (
                p["id"], p["name"], p["version"], 0, p["id"] in members, p["id"] == root, sorted(nodes.get(p["id"], {}).get("features", [])), sorted(p.get("features", {})),
                [(d.get("rename") or d["name"], _KIND.get(d.get("kind"), "normal"), bool(d.get("optional"))) for d in p.get("dependencies", [])], p.get("manifest_path", ""),
            )
            for p in doc["packages"]
        ]
        edges = [
            (a, d["pkg"], _KIND.get(k.get("kind"), "normal"))
            for a, n in nodes.items() for d in n.get("deps", []) for k in d.get("dep_kinds") or [{"kind": None}]
        ]
    except (OSError, ValueError, KeyError, TypeError, AttributeError):
        packages, edges = [], []
    return spark.createDataFrame(packages, PACKAGES), spark.createDataFrame(sorted(set(edges)), EDGES)
