"""Rust measures of files as one struct, and the tables that are exploded from it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from srclens.rust.measure import RUST_FILE, analyze


def _as_type() -> str:
    """``RUST_FILE``'s columns as a struct type."""
    depth, out = 0, []
    part = ""
    for c in RUST_FILE + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            name, _, kind = part.strip().partition(" ")
            out.append(f"{name}:{kind}")
            part = ""
        else:
            part += c
    return "struct<" + ",".join(out) + ">"


RUST = _as_type()


def parse(files: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The keys with ``rust`` (null where the file doesn't parse) and ``failure`` (line, message; null where it does).

    One map over the Rust files whose text is there; nothing is shuffled.
    """

    kinds = ", ".join(f"`{k}` {files.schema[k].dataType.simpleString()}" for k in keys)
    schema = to_arrow_schema(_parse_datatype_string(f"{kinds}, rust {RUST}, failure struct<line:bigint,message:string>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [analyze(t) for t in batch.column(len(keys)).to_pylist()]
            rust = pa.array([_pairs(r) for r, _ in got], schema.field("rust").type)
            failure = pa.array([None if f is None else {"line": f[0], "message": f[1]} for _, f in got], schema.field("failure").type)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], rust, failure], schema=schema)

    rows = files.select(*keys, F.col(text).alias("__text")).where(F.col("__text").isNotNull())
    return rows.mapInArrow(run, f"{kinds}, rust {RUST}, failure struct<line:bigint,message:string>")


def _pairs(rust: dict | None) -> dict | None:
    if rust is not None:
        rust["identifier_uses"] = list(rust["identifier_uses"].items())
    return rust


def functions(parsed: DataFrame, *keys: str) -> DataFrame:
    return parsed.select(*keys, F.explode("rust.functions").alias("f")).select(*keys, "f.*")


def definitions(parsed: DataFrame, *keys: str) -> DataFrame:
    return parsed.select(*keys, F.explode("rust.definitions").alias("d")).select(*keys, "d.*")


def identifier_uses(parsed: DataFrame, *keys: str) -> DataFrame:
    return parsed.select(*keys, F.explode("rust.identifier_uses").alias("name", "uses"))


def census(uses: DataFrame) -> DataFrame:
    """How often each identifier is used at all (A5)."""
    return uses.groupBy("name").agg(F.sum("uses").alias("uses"))


def declaration_counts(defs: DataFrame) -> DataFrame:
    """How often each name is declared, modules and reachable items among them."""
    return defs.groupBy("name").agg(F.count("*").alias("declared"))


def referenced_crates(parsed: DataFrame, owner: str) -> DataFrame:
    """Crates that the files of each owner name."""
    return parsed.select(owner, F.explode("rust.referenced_crates").alias("crate")).distinct()


def complexity(tests: bool = True) -> Column:
    """Sum over a file's functions."""
    kept = F.col("rust.functions") if tests else F.filter("rust.functions", lambda f: ~f["is_test"])
    return F.aggregate(kept, F.lit(0).cast("bigint"), lambda a, f: a + f["complexity"])


def weight() -> Column:
    """How much a file asks of its reader."""
    code = F.col("lines.code").cast("double")
    decisions = F.aggregate("rust.functions", F.lit(0).cast("bigint"), lambda a, f: a + f["complexity"] - 1)
    deep = F.greatest(F.col("rust.max_nesting") - 3, F.lit(0))
    return F.when(F.col("rust").isNull(), code).otherwise(code + 3.0 * decisions + 5.0 * deep + 10.0 * F.col("rust.performance.allocations_in_loops"))


