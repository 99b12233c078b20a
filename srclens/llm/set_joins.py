"""All similar pairs between set-valued records (problem 4), as a size-aware overlap join.

Pairs of small sets: each set enumerates the subsets of its elements that are as large as the overlap a partner of a
given size needs; two sets that share such a subset are a result, so that nothing false is ever emitted. Pairs with a
large set: the inverted lists of its rarest elements (as many as no similar set can miss) are scanned, with the length
filter. The union is filtered by the final similarity on the strings themselves. Equal sets are one class from the start
and are expanded at the end, when what is emitted is the result itself.

Cases: null arrays are empty, null, blank and repeated values are dropped, values are trimmed of blanks and tabs; sets of
fewer than ``MIN_SIZE`` values pair with nothing; null ids are dropped and repeated rows of an id count once; further
columns are ignored.
"""

from __future__ import annotations

from math import ceil, comb, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srclens.operators.checkpoints import durable

MIN_SIZE = 5
THRESHOLD = 0.75
SMALL = 8  # up to this size subsets are enumerated (at most C(8, 6) + C(8, 7) + 1 a set)


def value_set(*arrays: str) -> Column:
    """The sorted set of the arrays' trimmed values."""
    every = F.concat(*(F.coalesce(F.col(a), F.array().cast("array<string>")) for a in arrays))
    trimmed = F.transform(F.filter(every, lambda x: x.isNotNull()), lambda x: F.trim(x, F.lit(" \t")))
    return F.array_sort(F.array_distinct(F.filter(trimmed, lambda x: x != "")))


def overlap_needed(s: int, t: int) -> int:
    """Common values that sets of s and t values need for the similarity."""
    return ceil(THRESHOLD * (s + t) / (1 + THRESHOLD) - 1e-9)


def classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``class``, ``els``, ``size`` of the different sets, and (``id``, ``own``, ``class``) of the records; input: id, own, els."""
    rows = records.where((F.size("els") >= MIN_SIZE) & F.col("id").isNotNull()).withColumn("content", F.md5(F.array_join("els", "\x1f")))
    sets = rows.groupBy("content").agg(F.min("id").alias("class"), F.first("els").alias("els")).withColumn("size", F.size("els"))
    members = rows.select("id", "own", "content").distinct().join(sets.select("content", "class"), "content").select("id", "own", "class")
    return sets.select("class", "els", "size"), members


def _without(els: Column, drop: int) -> Column:
    """All sub-arrays that lack ``drop`` (0, 1 or 2) elements."""
    n = F.size(els)
    if drop == 0:
        return F.array(els)
    one = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.slice(els, F.lit(1), i - 1), F.slice(els, i + 1, n)))
    if drop == 1:
        return one
    return F.flatten(
        F.transform(
            F.sequence(F.lit(1), n - 1),
            lambda i: F.transform(
                F.sequence(i + 1, n),
                lambda j: F.concat(F.slice(els, F.lit(1), i - 1), F.slice(els, i + 1, j - i - 1), F.slice(els, j + 1, n)),
            ),
        )
    )


def small_pairs(sets: DataFrame) -> DataFrame:
    """Pairs of small sets by shared subsets of the size that their overlap must have."""
    combos = [(s, t) for t in range(MIN_SIZE, SMALL + 1) for s in range(MIN_SIZE, t + 1) if s >= ceil(THRESHOLD * t - 1e-9)]
    small = sets.where(F.col("size") <= SMALL)
    needs: dict[tuple[int, int], list[int]] = {}  # (size, subset size) -> codes of the pairs of sizes
    for s, t in combos:
        c = overlap_needed(s, t)
        if c <= s:
            for size in {s, t}:
                needs.setdefault((size, c), []).append(s * 100 + t)
    assert all(comb(size, c) <= 64 for size, c in needs)
    rows = None
    for (size, c), codes in needs.items():
        part = small.where(F.col("size") == size).select("class", "size", F.explode(_without(F.col("els"), size - c)).alias("sub")).select(
            "class", "size", F.explode(F.array(*(F.lit(x) for x in codes))).alias("code"), F.xxhash64("sub").alias("sub")
        )
        rows = part if rows is None else rows.unionByName(part)
    smaller = rows.where(F.col("size") == F.floor(F.col("code") / 100)).select("code", "sub", F.col("class").alias("a"))
    larger = rows.where(F.col("size") == F.col("code") % 100).select("code", "sub", F.col("class").alias("b"))
    return smaller.join(larger, ["code", "sub"]).where((F.floor(F.col("code") / 100) != F.col("code") % 100) | (F.col("a") < F.col("b"))).select("a", "b")


def large_pairs(sets: DataFrame) -> DataFrame:
    """Pairs in which at least one set is large, by the inverted lists of rare elements."""
    smallest = ceil(THRESHOLD * (SMALL + 1) - 1e-9)
    els = sets.where(F.col("size") >= smallest).select("class", "size", F.explode("els").alias("el"))
    frequency = els.groupBy("el").agg(F.count("*").alias("df")).where("df > 1")
    ranked = els.join(frequency, "el").groupBy("class", "size").agg(F.array_sort(F.collect_list(F.struct("df", "el"))).alias("shared"))
    alone = F.col("size") - F.size("shared")
    taken = F.greatest(F.col("size") - F.ceil(THRESHOLD * F.col("size") - 1e-9) + 1 - alone, F.lit(0)).cast("int")
    lists = ranked.select("class", "size", F.posexplode(F.slice("shared", F.lit(1), taken)).alias("pos", "e"), alone.alias("alone")).select(
        "class", "size", F.xxhash64("e.el").alias("el"), (F.col("pos") + F.col("alone")).alias("pos")
    )
    left = lists.where(F.col("size") > SMALL).select("el", F.col("class").alias("a"), F.col("size").alias("size_a"), F.col("pos").alias("pos_a"))
    right = lists.select("el", F.col("class").alias("b"), F.col("size").alias("size_b"), F.col("pos").alias("pos_b"))
    # The larger set scans; of equal sizes, that with the smaller class. What is left after the shared element must suffice.
    need = F.ceil(THRESHOLD * (F.col("size_a") + F.col("size_b")) / (1 + THRESHOLD) - 1e-9)
    return (
        left.join(right, "el")
        .where("size_b < size_a or (size_a = size_b and a < b)")
        .where((F.col("size_b") >= THRESHOLD * F.col("size_a") - 1e-9) & (F.least(F.col("size_a") - F.col("pos_a"), F.col("size_b") - F.col("pos_b")) + F.least("pos_a", "pos_b") >= need))
        .select("a", "b")
    )


def similar_sets(sets: DataFrame) -> DataFrame:
    """``a`` < ``b`` of the different sets that are similar enough."""
    candidates = small_pairs(sets).unionByName(large_pairs(sets)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = sets.select(F.col("class").alias("a"), F.col("els").alias("els_a"))
    right = sets.select(F.col("class").alias("b"), F.col("els").alias("els_b"))
    common = F.size(F.array_intersect("els_a", "els_b"))
    return candidates.join(left, "a").join(right, "b").where(common >= THRESHOLD * (F.size("els_a") + F.size("els_b") - common) - 1e-9).select("a", "b")


def similar_pairs(own: DataFrame, other: DataFrame) -> DataFrame:
    """``id_a`` < ``id_b`` of all similar pairs within ``own`` and between it and ``other``; both have symbol_id and the three arrays."""
    arrays = ("types", "identifiers", "parameters")
    records = (
        own.select(F.col("symbol_id").alias("id"), F.lit(True).alias("own"), value_set(*arrays).alias("els"))
        .unionByName(other.select(F.col("symbol_id").alias("id"), F.lit(False).alias("own"), value_set(*arrays).alias("els")))
    )
    sets, members = classes(durable(records))
    sets, members = durable(sets), durable(members)
    left = members.select(F.col("id").alias("x"), F.col("own").alias("own_x"), F.col("class").alias("a"))
    right = members.select(F.col("id").alias("y"), F.col("own").alias("own_y"), F.col("class").alias("b"))
    between = similar_sets(sets).join(left, "a").join(right, "b")
    within = left.join(right.withColumnRenamed("b", "a"), "a").where("x < y").select("x", "own_x", "y", "own_y")
    every = between.select("x", "own_x", "y", "own_y").unionByName(within)
    return every.where("own_x or own_y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).where("id_a < id_b").distinct()


assert floor(SMALL / THRESHOLD) >= SMALL
