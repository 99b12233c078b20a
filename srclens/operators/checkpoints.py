"""Cutting of lineage in storage that all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def durable(df: DataFrame) -> DataFrame:
    """The same rows, written to the checkpoint folder and read from there, so that a lost executor costs no recomputation.

    The folder is the session's (``spark.checkpoint.dir`` or what was set on its context). Without one, a session on a single
    machine (``local[n]``) gets a temporary one; a cluster is refused, as its executors share no such folder.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master or ""):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="srclens-checkpoint-"))
    return df.checkpoint()


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """``df`` with a hint to broadcast it if it has at most ``most`` rows, which is counted; else as it is, to be joined by a shuffle
    that the session's skew handling may split."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def once(df: DataFrame, key: str) -> DataFrame:
    """One row for each key, where few have more: the rest isn't shuffled. The keys that repeat are counted first, by themselves."""
    again = small(durable(df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)))
    return df.join(again, key, "left_anti").unionByName(df.join(again, key, "left_semi").dropDuplicates([key]))


def spread(scan: DataFrame) -> DataFrame:
    """A scan that costly work follows, spread over all cores where its files have too few parts for them; a scan of many parts
    isn't shuffled. For scans only: what has a shuffle below it would run for being asked how many parts it has."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < 2 * cores else scan
