"""The queries of the problems, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srclens.llm import code_origin, doc_pairs, encoding, mixing, near_duplicates, set_joins, source_syntax, subjects


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_origin.not_hand_written(*(_read(spark, sf_dir, t) for t in ("source_files", "clone_inputs", "upstream_files"))).select("file_id")


def p1_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = code_origin.not_hand_written(*(_read(spark, sf_dir, t) for t in ("source_files", "clone_inputs", "upstream_files")))
    return found.groupBy("origin").agg(F.count("*").alias("files"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_syntax.failures(_read(spark, sf_dir, "source_files")).select("file_id")


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _read(spark, sf_dir, "source_files")
    return source_syntax.rates(files, _read(spark, sf_dir, "parse_failures"), source_syntax.failures(files))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.groups(_read(spark, sf_dir, "clone_candidates"), _read(spark, sf_dir, "clone_limits"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_joins.similar_pairs(_read(spark, sf_dir, "symbols"), _read(spark, sf_dir, "catalog_symbols"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_pairs.pairs(_read(spark, sf_dir, "source_files")).select("file_id", "qualified_name")


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_pairs.guided(_read(spark, sf_dir, "source_files"), _read(spark, sf_dir, "symbols"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode(_read(spark, sf_dir, "documents"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(*mixing.mixture(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "mix_targets")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subjects_of(*(_read(spark, sf_dir, t) for t in ("documents", "subjects", "subject_labels"))).select("doc_id", "subject")


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = subjects.subjects_of(*(_read(spark, sf_dir, t) for t in ("documents", "subjects", "subject_labels")))
    return found.groupBy("subject").agg(F.count("*").alias("documents"), F.sum("share").alias("share_of_documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_origins, p2_found, p2_rates, p3_found, p4_found, p5_found, p5_pairs, p6_ids, p7_mix, p7_shares, p8_found, p8_composition)}
