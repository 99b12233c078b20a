"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srclens.operators.checkpoints import durable


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``id`` and ``component`` (the smallest id in it) of every node that has an edge to another.

    Large-star and small-star steps in turn, until no edge changes: every round is two aggregations and two joins over the
    edges that are left, of which there are never more than at first, and rounds grow as the logarithm of the longest path.
    A node's neighbours are never gathered: only their minimum is.

    Self loops, repeated edges and nulls don't matter; an empty table gives an empty one.
    """
    current = durable(
        edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).where("a < b").distinct()
    )
    state = _state(current)
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        smallest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(smallest, "u")
            .select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b"))
            .where("a < b")
            .distinct()
        )
        current = durable(small)
        new = _state(current)
        if new == state:
            break
        state = new
    members = current.select(F.col("b").alias("id"), F.col("a").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("id"), "component").distinct())


def _state(edges: DataFrame) -> tuple:
    """What changes when any edge does."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]
