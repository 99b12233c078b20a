"""Near-duplicate records with small edits (problem 3).

Records of one kind are linked if the multisets of their tokens are alike enough (2 x common / both); groups are the
connected components. Identical multisets are one representative from the start, so copies cost nothing. Candidates come
from an inverted index of each multiset's rarest elements, which no link can escape (prefix and length filter); their
MinHash values are compared a few at a time and a pair is dropped as soon as the posterior probability that it reaches
the threshold is below ``TOLERANCE``; what remains is verified exactly on the elements.

Buckets of the index that hold many representatives are never expanded into pairs: first every bucket only links its
members to its smallest one; members that this puts into one component need no further comparison, and only the rest of a
bucket is compared, in blocks, each of them one vectorised comparison.

Joins of tables that both grow with the records are merge joins by hint: Catalyst estimates an array as one element, so it
takes the exploded or sketched records for some hundred times less than they are and would broadcast them through the driver.

Cases: null or token-less code, a null fragment or one without limits, and null ids have no links and give no row; repeated
rows of an id count once; records with equal tokens are linked (similarity 1); ties in a group go to the smallest id;
further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srclens.operators.checkpoints import durable, small
from srclens.operators.components import connected_components

HASHES = 128
STEP = 16
TOLERANCE = 1e-9
BLOCK = 256  # members of a bucket that are compared at once
_MASK = (1 << 64) - 1


def elements(tokens: Column) -> Column:
    """A multiset as a set: each token with the number of its occurrence, as 64-bit hashes."""
    ordered = F.array_sort(tokens)
    numbered = F.transform(ordered, lambda t, i: F.xxhash64(t, i + 1 - F.array_position(ordered, t).cast("int")))
    return numbered


@cache
def fewest_matches(threshold: float) -> tuple[int, ...]:
    """For each number of compared values, the fewest equal ones with which a pair may still reach the Jaccard threshold.

    With a uniform prior the posterior of the similarity is Beta(m + 1, n - m + 1), and its tail above t is the binomial
    probability of at most m successes in n + 1 trials of chance t. Values are eight bits, so unequal ones may match by
    chance; that only keeps pairs.
    """
    out = []
    for n in range(HASHES + 1):
        below = 0.0
        m = 0
        while m <= n:
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= TOLERANCE:
                break
            m += 1
        out.append(m)
    return tuple(out)


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def sketches(column: pd.Series) -> list[bytes]:
    """MinHash values of element sets, one byte each."""
    a, b = _seeds()
    out = []
    for els in column:
        x = np.asarray(els, dtype=np.int64).view(np.uint64)
        if not len(x):
            out.append(b"\0" * HASHES)
            continue
        x = x ^ (x >> np.uint64(29))
        h = x[:, None] * a[None, :] + b[None, :]
        h ^= h >> np.uint64(32)
        out.append(((h.min(axis=0) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes())
    return out


def survivors(left: np.ndarray, right: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """Which pairs of sketches (rows) are kept after comparing ``STEP`` values at a time."""
    keep = np.arange(len(left))
    same = np.zeros(len(left), dtype=np.int32)
    for n in range(STEP, HASHES + 1, STEP):
        same[keep] += (left[keep, n - STEP : n] == right[keep, n - STEP : n]).sum(axis=1, dtype=np.int32)
        least = np.array([fewest_matches(t)[n] for t in np.unique(threshold)])
        need = least[np.searchsorted(np.unique(threshold), threshold[keep])]
        keep = keep[same[keep] >= need]
        if not len(keep):
            break
    out = np.zeros(len(left), dtype=bool)
    out[keep] = True
    return out


def _prune(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, sketch_a, sketch_b, jaccard) that survive the comparison of their MinHash values."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                left = np.frombuffer(b"".join(pdf.sketch_a), dtype=np.uint8).reshape(-1, HASHES)
                right = np.frombuffer(b"".join(pdf.sketch_b), dtype=np.uint8).reshape(-1, HASHES)
                yield pdf.loc[survivors(left, right, pdf.jaccard.to_numpy()), ["a", "b"]]

    return pairs.mapInPandas(run, "a bigint, b bigint")


def _merged(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the records: the join shuffles it, whatever size it is taken for."""
    return df.hint("merge")


def representatives(records: DataFrame, limits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row for each multiset of tokens: ``rep``, ``fragment``, ``els``, ``size``, ``t``; and which record has which (``id``, ``rep``)."""
    limit = small(limits.where("fragment is not null and similarity is not null").groupBy("fragment").agg(F.min("similarity").alias("t")))
    rows = (
        records.where("candidate_id is not null and code is not null and fragment is not null")
        .select(F.col("candidate_id").alias("id"), "fragment", F.regexp_extract_all(F.lower("code"), F.lit("([a-z0-9_]+)"), F.lit(1)).alias("tokens"))
        .where(F.size("tokens") > 0)
        .withColumn("tokens", F.array_sort("tokens"))
        .withColumn("content", F.md5(F.array_join("tokens", " ")))
    )
    groups = rows.groupBy("fragment", "content").agg(F.min("id").alias("rep"), F.first("tokens").alias("tokens"))
    reps = groups.join(limit, "fragment").select("rep", "fragment", elements(F.col("tokens")).alias("els"), F.size("tokens").alias("size"), "t")
    members = rows.select("id", "fragment", "content").distinct().join(_merged(groups.select("fragment", "content", "rep")), ["fragment", "content"]).join(limit.select("fragment"), "fragment", "left_semi").select("id", "rep")
    return reps, members


def _prefixes(reps: DataFrame) -> DataFrame:
    """``bucket`` (fragment and element), ``rep``, ``size``, ``t`` for the rarest elements of each representative."""
    els = reps.select("rep", F.explode("els").alias("el"))  # the widest table of all: nothing else travels with it
    frequency = els.groupBy("el").agg(F.count("*").cast("int").alias("df")).where("df > 1")
    # Elements that only one representative has come first in the order and pair it with nobody: they count, but have no bucket.
    ranked = els.join(_merged(frequency), "el").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "el"))).alias("shared"))
    least = F.ceil(F.col("size") * F.col("t") / (2 - F.col("t")) - F.lit(1e-9))
    taken = F.greatest(F.col("size") - least + 1 - (F.col("size") - F.size("shared")), F.lit(0)).cast("int")
    placed = ranked.join(_merged(reps.select("rep", "fragment", "size", "t")), "rep")
    return placed.select("rep", "size", "t", "fragment", F.explode(F.slice("shared", F.lit(1), taken)).alias("e")).select(
        F.xxhash64("fragment", "e.el").alias("bucket"), "rep", "size", "t"
    )


def _verify(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs that are alike enough, by their elements."""
    of = _merged(reps.select("rep", "els", "size", "t", "fragment"))
    return (
        pairs.join(of.select(F.col("rep").alias("a"), F.col("els").alias("els_a"), F.col("size").alias("size_a"), "t", F.col("fragment").alias("f_a")), "a")
        .join(of.select(F.col("rep").alias("b"), F.col("els").alias("els_b"), F.col("size").alias("size_b"), F.col("fragment").alias("f_b")), "b")
        .where((F.col("f_a") == F.col("f_b")) & (2 * F.size(F.array_intersect("els_a", "els_b")) >= F.col("t") * (F.col("size_a") + F.col("size_b")) - 1e-9))
        .select("a", "b")
    )


def _jaccard(t: str = "t") -> Column:
    return F.round(F.col(t) / (2 - F.col(t)), 6)


def links(reps: DataFrame) -> DataFrame:
    """Verified links (a, b) that connect exactly what all links do."""
    sketched = durable(
        reps.select("rep", "fragment", "els", "size", "t").mapInPandas(
            lambda batches: (pdf.assign(sketch=sketches(pdf.els)) for pdf in batches),
            "rep bigint, fragment string, els array<bigint>, size int, t double, sketch binary",
        )
    )
    buckets = durable(_prefixes(sketched))
    sketch = _merged(sketched.select("rep", "sketch"))

    def pruned(pairs: DataFrame) -> DataFrame:
        with_both = pairs.join(sketch.select(F.col("rep").alias("a"), F.col("sketch").alias("sketch_a")), "a").join(
            sketch.select(F.col("rep").alias("b"), F.col("sketch").alias("sketch_b")), "b"
        )
        return _verify(_prune(with_both.withColumn("jaccard", _jaccard())), sketched)

    # First, each bucket's members with its smallest.
    low_size = F.col("t") / (2 - F.col("t")) - 1e-9
    near = (F.col("size_a") >= low_size * F.col("size_b")) & (F.col("size_b") >= low_size * F.col("size_a"))
    heads = buckets.groupBy("bucket").agg(F.min(F.struct("rep", "size")).alias("h"), F.count("*").alias("n")).where("n > 1").select("bucket", F.col("h.rep").alias("a"), F.col("h.size").alias("size_a"))
    stars = buckets.withColumnRenamed("size", "size_b").join(_merged(heads), "bucket").where("rep <> a").where(near).select("a", F.col("rep").alias("b"), "t").distinct()
    first = durable(pruned(stars))
    label = connected_components(first, "a", "b").select(F.col("id").alias("rep"), "component")
    # Then only what is still apart. A bucket all of whose members are in one component is done.
    placed = durable(buckets.join(_merged(label), "rep", "left").withColumn("component", F.coalesce("component", "rep")))
    open_ = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low <> high and n > 2").select("bucket", "n")
    rest = placed.join(_merged(open_), "bucket")
    small = rest.where(F.col("n") <= BLOCK)
    left = small.select("bucket", F.col("rep").alias("a"), F.col("size").alias("size_a"), F.col("component").alias("component_a"), "t")
    right = small.select("bucket", F.col("rep").alias("b"), F.col("size").alias("size_b"), F.col("component").alias("component_b"))
    pairs = (
        left.join(_merged(right), "bucket")
        .where("a < b and component_a <> component_b")
        .where(near)
        .select("a", "b", "t")
        .distinct()
    )
    second = pruned(pairs)
    large = rest.where(F.col("n") > BLOCK).join(sketch, "rep")
    return first.unionByName(second).unionByName(_verify(_in_blocks(large), sketched)).distinct()


def _in_blocks(members: DataFrame) -> DataFrame:
    """Surviving pairs of large buckets: a bucket is cut into blocks, and every two blocks are compared in a task of their own."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    spread = (
        members.withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "size", "t", "component", "sketch")
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        same = pdf.i.iloc[0] == pdf.j.iloc[0]
        left = pdf[pdf.own == pdf.i].reset_index(drop=True)
        right = left if same else pdf[pdf.own == pdf.j].reset_index(drop=True)
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        t = float(pdf.t.iloc[0])
        jaccard = round(t / (2 - t), 6)
        sl = np.frombuffer(b"".join(left.sketch), dtype=np.uint8).reshape(-1, HASHES)
        sr = np.frombuffer(b"".join(right.sketch), dtype=np.uint8).reshape(-1, HASHES)
        ids_r, size_r, comp_r = right.rep.to_numpy(), right["size"].to_numpy(), right.component.to_numpy()
        out_a, out_b = [], []
        for k in range(len(left)):
            s = left["size"].iat[k]
            near = (comp_r != left.component.iat[k]) & (size_r >= jaccard * s - 1e-3) & (jaccard * size_r - 1e-3 <= s)
            if same:
                near &= ids_r > left.rep.iat[k]
            at = np.flatnonzero(near)
            if len(at):
                at = at[survivors(np.broadcast_to(sl[k], (len(at), HASHES)), sr[at], np.full(len(at), jaccard))]
                out_a += [left.rep.iat[k]] * len(at)
                out_b += ids_r[at].tolist()
        return pd.DataFrame({"a": out_a, "b": out_b}, dtype="int64")

    return spread.groupBy("bucket", "i", "j").applyInPandas(compare, "a bigint, b bigint").distinct()


def groups(records: DataFrame, limits: DataFrame) -> DataFrame:
    """``candidate_id`` and ``group_id`` of every record that has a link."""
    reps, members = representatives(records, limits)
    members = durable(members)
    found = connected_components(links(reps), "a", "b")
    placed = members.join(_merged(found.withColumnRenamed("id", "rep")), "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))
    sizes = placed.groupBy("component").agg(F.count("*").alias("n"), F.min("id").alias("group_id")).where("n > 1")
    return placed.join(_merged(sizes), "component").select(F.col("id").alias("candidate_id"), "group_id")
