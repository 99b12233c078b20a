"""Totals that follow a growing folder of scanned files.

An addition to the batch analysis: each micro-batch is aggregated before it meets the running totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srclens.functions.language import language


def scanned_files(spark: SparkSession, folder: str, schema: str, files_a_batch: int = 64) -> DataFrame:
    """``source_files`` parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def language_totals(stream: DataFrame) -> DataFrame:
    """Files and bytes by language so far; write it in complete or update mode."""
    return stream.groupBy(language("relative_path").alias("language")).agg(F.count("*").alias("files"), F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"))


def daily_scans(stream: DataFrame, late: str = "60 days") -> DataFrame:
    """Files by repository and day of their scan; rows later than ``late`` are dropped by the watermark."""
    return stream.withWatermark("scanned_at", late).groupBy(F.window("scanned_at", "1 day").alias("day"), "repo").agg(F.count("*").alias("files"))
