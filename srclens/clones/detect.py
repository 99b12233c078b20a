"""Clone groups in three layers: equal subtrees, repeated runs of statements, near misses."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string
from pyspark.sql.window import Window

from srclens.clones import units
from srclens.config import Clones, Thresholds
from srclens.functions.deep import deep
from srclens.functions.hashing import hash_text, mix
from srclens.functions.similarity import tree_similarity
from srclens.operators.checkpoints import durable
from srclens.operators.components import connected_components

BLOCK = 256  # members of a bucket that are compared at once
PLAIN_BLOCK = 1024  # the same where they are only paired
ANCHORS = 3
ROWS = 5_000  # that a task gathers before it hands them on
#: Detectors and kinds of groups in rank order.
DETECTORS = ("subtree", "suffix_array", "min_hash", "edit_distance")
KINDS = ("exact", "renamed", "near_miss")


def extract(inputs: DataFrame, kind: str, clones: Clones, t: Thresholds) -> DataFrame:
    """``path``, ``editable`` and the units of each file: kind is fragments, runs, symbols or nodes. One map over the texts."""
    body = {"fragments": units.UNIT, "runs": units.RUN, "symbols": units.SYMBOL, "nodes": units.NODE}[kind]
    full = f"path string, editable boolean, file_is_test boolean, {body}"
    schema = to_arrow_schema(_parse_datatype_string(full))
    wanted = frozenset(clones.fragment_kinds)
    tokens, lines = t.duplicate_min_tokens, t.duplicate_min_lines

    def make(text: str, path: str) -> list[dict]:
        flat = units.Flat(text)
        if kind == "fragments":
            return units.fragments(flat, wanted, tokens, lines)
        if kind == "runs":
            return units.runs(flat, tokens, lines, path) if "statements" in wanted else []
        return units.symbols(flat) if kind == "symbols" else units.nodes(flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                extra = {"path": row["path"], "editable": row["editable"], "file_is_test": row["is_test_path"]}
                out += [extra | u for u in deep(make, row["text"], row["path"])]
                if len(out) >= ROWS:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    rows = inputs.select("path", "text", F.coalesce("editable", F.lit(True)).alias("editable"), F.coalesce("is_test_path", F.lit(False)).alias("is_test_path")).where("text is not null")
    return rows.mapInArrow(run, full)


def clone_inputs(own: DataFrame, extra: DataFrame | None, orphans: DataFrame | None, test_only: DataFrame | None, read_only: Column | None) -> DataFrame:
    """Rust files to look for copies in (S10): own and extra ones with text, without orphans; read-only globs aren't editable."""
    cols = ["relative_path", "language", "text", "is_test_path"]
    every = own.select(*cols, F.lit(True).alias("editable"))
    if extra is not None:
        every = every.unionByName(extra.select(*cols, "editable"))
    every = every.where((F.col("language") == "rust") & F.col("text").isNotNull()).withColumnRenamed("relative_path", "path")
    if orphans is not None:
        every = every.join(orphans.select("path"), "path", "left_anti")
    if test_only is not None:
        every = every.join(test_only.select("path", F.lit(True).alias("t")).distinct(), "path", "left").withColumn("is_test_path", F.col("is_test_path") | F.coalesce("t", F.lit(False))).drop("t")
    return every.withColumn("editable", F.col("editable") & ~read_only) if read_only is not None else every


UNIT = ("path", "start_line", "end_line", "node", "tokens", "exact", "sequence", "test", "editable", "item")


def _unit(node: str = "node", tests: bool = True) -> Column:
    test = F.col("test") | F.col("file_is_test")
    return F.struct("path", "start_line", "end_line", F.col(node).alias("node"), "tokens", "exact", "sequence", test.alias("test"), "editable", "item").alias("unit")


def classify(typed: Column) -> Column:
    """exact, renamed or (other token orders) near_miss of a group's units (C14)."""
    orders = F.count_distinct("unit.sequence")
    return F.when(~typed & (orders > 1), "near_miss").when(F.count_distinct("unit.exact") == 1, "exact").otherwise("renamed")


def subtree_groups(fragments: DataFrame) -> DataFrame:
    """Layer 1: fragments of one kind and shape (C13). The shapes that repeat are found first, so only their units move."""
    repeated = fragments.groupBy("fragment", "shape").agg(F.count("*").alias("n")).where("n > 1").select("fragment", "shape")
    rows = fragments.join(repeated, ["fragment", "shape"]).select("fragment", "shape", _unit())
    typed = F.first("fragment") == "type_shape"
    return rows.groupBy("fragment", "shape").agg(
        F.array_sort(F.collect_list("unit")).alias("units"), classify(typed).alias("kind"), (~typed & (F.count_distinct("unit.sequence") > 1)).alias("reordered")
    ).select("fragment", "shape", "units", "kind", "reordered", F.lit(1.0).alias("similarity"), F.array(F.lit("subtree")).alias("detectors"))


def repeated_runs(runs: DataFrame) -> DataFrame:
    """Layer 2: maximal repeats of sibling sequences and of single nodes.

    A start whose shortest long enough run is unique, or always stands behind the same, has no maximal repeat, so only the
    other seeds are extended. A run is maximal if its places differ in what stands before and after them; equal runs are
    grouped by one hash of their shapes, so nothing is sorted globally.
    """
    seeds = runs.select("path", F.explode("seeds").alias("s"))
    kept = seeds.groupBy("s.run").agg(F.count("*").alias("n"), (F.min("s.before") != F.max("s.before")).alias("left")).where("n > 1 and left").select("run")
    starts = seeds.withColumn("run", F.col("s.run")).join(kept, "run", "left_semi").groupBy("path").agg(F.collect_list("s").alias("seeds"))
    schema = to_arrow_schema(_parse_datatype_string(units.EXTENDED))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = units.extend(**row)
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=schema)

    extended = durable(runs.select("path", "editable", "file_is_test", "least_lines", "segments").join(starts, "path").mapInArrow(extend, units.EXTENDED))
    differ = lambda c: F.min(f"{c}_min") != F.max(f"{c}_max")
    maximal = extended.groupBy("run").agg(
        F.sum("n").alias("n"), differ("before").alias("left"), differ("after").alias("right"), differ("exact").alias("renamed"), differ("sequence").alias("reordered")
    ).where("n > 1 and left and right").select("run", "renamed", "reordered")
    kind = F.when(F.first("reordered"), "near_miss").when(F.first("renamed"), "renamed").otherwise("exact")
    return extended.join(maximal, "run").groupBy("run").agg(
        F.min_by("fragment", "path").alias("fragment"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("units")))).alias("units"), kind.alias("kind"), F.first("reordered").alias("reordered")
    ).where(F.size("units") > 1).select(
        "fragment", F.col("run").alias("shape"), "units", "kind", "reordered", F.lit(1.0).alias("similarity"), F.array(F.lit("suffix_array")).alias("detectors")
    )


def _in_blocks(fragments: DataFrame, size: int, *columns: str | Column) -> DataFrame:
    """Fragments of each bucket (``h`` of a ``band``) of two or more, once for every pair of blocks, ``i`` and ``j``, that their ``own`` is in."""
    rows = fragments.where(F.size("bands") > 0).select("key", "fragment", "shape", "bands", F.posexplode("bands").alias("band", "h")).select("key", "fragment", "band", "h", *columns)
    bucket = ["h", "band", "fragment"]
    sized = rows.join(rows.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1"), bucket)
    return (
        sized.withColumn("blocks", F.ceil(F.col("n") / size).cast("int")).withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("n", "blocks", "other")
    )


PLACE = ["h", "band", "fragment", "i", "j"]


def _parts(df: DataFrame) -> int:
    """A given number of partitions, as small rows that make many pairs must not be put together again."""
    return 4 * max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)


def lsh_pairs(fragments: DataFrame, bands: int = units.BANDS) -> DataFrame:
    """All pairs of fragments of unequal shapes (a, b as keys) that share a band of their MinHash values.

    A pair is made in the first band that both share, so each comes once, without the pairs being shuffled: keys must be unique,
    and no fragment may have more bands than that.
    """
    spread = _in_blocks(fragments, PLAIN_BLOCK, "shape", F.slice("bands", F.lit(1), F.col("band")).alias("before")).repartition(_parts(fragments), *PLACE)
    first = F.lit(True)
    for k in range(bands - 1):
        first = first & ~F.coalesce(F.get("before_a", F.lit(k)) == F.get("before_b", F.lit(k)), F.lit(False))
    side = lambda x, at: spread.where(at).select(*PLACE, F.col("key").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("shape", "before")))
    pairs = side("a", "own = i").hint("merge").join(side("b", "own = j"), PLACE).where(first).where("shape_a <> shape_b and (i < j or a < b)")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


CARRIED = ("tokens", "nodes", "shape", "tree", "kinds", "words", "bands", "sig")
PAIR = "a string, b string, similarity double, edit boolean"


def alike_pairs(fragments: DataFrame, similarity: float) -> DataFrame:
    """``a``, ``b``, ``similarity``, ``edit`` of the pairs that share a band (C21) and are alike enough.

    Members of a bucket are compared where they stand together, block by block, so that what is moved grows with the members and
    not with the pairs. A pair is compared in the first band that both share.
    """
    narrow = _in_blocks(fragments, BLOCK)
    large = F.col("nodes") > similarity * units.EDIT_NODES  # only a pair with one beyond that many nodes needs signatures
    wide = fragments.select("key", *CARRIED).withColumn("sig", F.when(large, F.col("sig")).otherwise(F.array().cast("array<bigint>")))
    members = narrow.join(wide, "key").where(F.get("bands", F.col("band")) == F.col("h"))
    return members.repartition(_parts(fragments), *PLACE).sortWithinPartitions(*PLACE).mapInArrow(_alike_in_blocks(similarity), PAIR)


def _dense(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which histograms aren't empty, and all as rows over the buckets that any has."""
    sizes = np.array([len(x) for x in lists])
    flat = np.concatenate(lists)
    places, at = np.unique(flat >> 16, return_inverse=True)
    out = np.zeros((len(lists), len(places)), dtype=np.int32)
    out[np.repeat(np.arange(len(lists)), sizes), at] = flat & 0xFFFF
    return sizes > 0, out


def _alike_in_blocks(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Compares sorted members of buckets, two blocks at once; the cheap tests, by sizes and histograms, come first."""

    schema = to_arrow_schema(_parse_datatype_string(PAIR))

    def compared(a: tuple, b: tuple, sig_a: np.ndarray, sig_b: np.ndarray) -> tuple[float, bool]:
        (labels_a, lefts_a, kinds_a), (labels_b, lefts_b, kinds_b) = a, b
        total = sum(kinds_a.values()) + sum(kinds_b.values())
        dice = 2 * sum(min(n, kinds_b.get(k, 0)) for k, n in kinds_a.items()) / total if total else 1.0
        if dice < similarity:
            return 0.0, False
        if labels_a and labels_b:
            return tree_similarity((labels_a, lefts_a), (labels_b, lefts_b), similarity), True
        return min(dice, float((sig_a == sig_b).mean())), False

    def pairs(members: list[tuple], band: int, i: int, j: int) -> Iterator[tuple[str, str, float, bool]]:
        right = np.flatnonzero([m[0] == j for m in members])
        if len(members) < 2 or not len(right):
            return
        own, keys, _, _, _, blobs, all_kinds, all_words, bands, sigs = zip(*members)
        sizes, shapes, before = np.array([m[2:4] for m in members]), np.array([m[4] for m in members]), np.array([x[:band] for x in bands])
        (some_kinds, kinds), (some_words, words) = _dense(all_kinds), _dense(all_words)
        tree = lru_cache(None)(lambda k: units.unpacked(blobs[k]))
        for k in range(len(members)):
            if own[k] != i:
                continue
            at, size = right[right > k] if i == j else right, sizes[k]
            at = at[(np.minimum(sizes[at], size) >= similarity * np.maximum(sizes[at], size)).all(axis=1) & (shapes[at] != shapes[k])]
            at = at[~(before[at] == before[k]).any(axis=1)]
            if some_kinds[k] and len(at):
                common = np.minimum(kinds[at], kinds[k]).sum(axis=1)
                at = at[~some_kinds[at] | (2 * common >= similarity * (sizes[at, 1] + size[1]) - 1e-9)]
            if some_words[k] and len(at):  # every edit changes one label at most
                largest = np.maximum(sizes[at, 1], size[1])
                common = np.minimum(words[at], words[k]).sum(axis=1)
                at = at[~some_words[at] | (largest - common <= np.floor((1 - similarity) * largest + 1e-9))]
            for x in at:
                alike, edit = compared(tree(k), tree(x), sigs[k], sigs[x])
                if alike >= similarity and keys[k] != keys[x]:
                    yield min(keys[k], keys[x]), max(keys[k], keys[x]), alike, edit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None

        def ended() -> Iterator[pa.RecordBatch]:
            found = list(pairs(held, last[1], *last[3:])) if held else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found), schema)], schema=schema)

        for batch in batches:
            column = {name: batch.column(name) for name in batch.schema.names}
            places = zip(*(column[c].to_pylist() for c in PLACE))
            narrow = zip(*(column[c].to_pylist() for c in ("own", "key", "tokens", "nodes", "shape", "tree")))
            wide = [(column[c].values.to_numpy(zero_copy_only=False), column[c].offsets.to_numpy()) for c in ("kinds", "words", "bands", "sig")]
            for r, (place, row) in enumerate(zip(places, narrow)):
                if place != last:
                    yield from ended()
                    held, last = [], place
                held.append((*row, *(values[at[r] : at[r + 1]].copy() for values, at in wide)))
        yield from ended()

    return run


def links(sure: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs of representatives as pairs of their members, without those one of which lies in the other.

    Members of different files always link, so where both sides are in ``ANCHORS`` files, each member is linked to one of
    every anchor's file only: any two then share one, and the components are those of all pairs. Else all pairs are made.
    """
    firsts = members.groupBy("rep", "path").agg(F.min("key").alias("key"))
    anchors = firsts.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("path"))).where(F.col("n") <= ANCHORS).select("key")
    wide = firsts.groupBy("rep").agg((F.count("*") >= ANCHORS).alias("wide"))
    flagged = members.join(wide, "rep").join(anchors.withColumn("anchor", F.lit(True)), "key", "left").withColumn("anchor", F.coalesce("anchor", F.lit(False)))
    side = lambda x: flagged.select(F.col("rep").alias(f"rep_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in ("key", "path", "start_line", "end_line", "wide", "anchor")))
    pairs = sure.withColumnRenamed("a", "rep_a").withColumnRenamed("b", "rep_b")

    def joined(first: str, then: str, anchored: bool) -> DataFrame:
        right = side(then).where(f"anchor_{then}") if anchored else side(then)
        both = pairs.join(side(first), f"rep_{first}").join(right, f"rep_{then}")
        return both.where("wide_a and wide_b" if anchored else "not (wide_a and wide_b)")

    every = joined("a", "b", True).unionByName(joined("b", "a", True)).unionByName(joined("a", "b", False))
    inside = "(start_line_a >= start_line_b and end_line_a <= end_line_b) or (start_line_b >= start_line_a and end_line_b <= end_line_a)"
    return every.where(f"path_a <> path_b or not ({inside})").select(F.col("key_a").alias("a"), F.col("key_b").alias("b"), "similarity", "edit").distinct()


def near_misses(fragments: DataFrame, similarity: float) -> DataFrame:
    """Layer 3: components of confirmed pairs (C19-C23); a group is as similar as its least similar confirmed pair.

    Fragments of one shape and token sequence are alike in all that is compared, so one of them stands for all.
    """
    keyed = fragments.withColumn("key", F.concat_ws("\x00", "path", F.lpad(F.col("node").cast("string"), 9, "0")))
    alike = keyed.groupBy("fragment", "shape", "sequence").agg(F.min("key").alias("rep"))
    # what all fragments need from here on is narrow; what is compared stays where it is and is read for representatives
    placed = durable(keyed.select("key", "fragment", "shape", "sequence", "start_line", "end_line", "path", (F.size("bands") > 0).alias("banded"), _unit()).join(alike, ["fragment", "shape", "sequence"]))
    reps = keyed.join(placed.where("key = rep").select("key"), "key", "left_semi")
    # each path once, or its fragments' pairs repeat
    alike_enough = durable(alike_pairs(reps, similarity).distinct())
    sure = durable(links(alike_enough, placed.where("banded").select("key", "rep", "path", "start_line", "end_line")))
    parts = connected_components(sure, "a", "b")
    least = sure.join(parts.withColumnRenamed("id", "a"), "a").groupBy("component").agg(F.min("similarity").alias("similarity"), F.bool_or("edit").alias("edit"))
    rows = parts.withColumnRenamed("id", "key").join(placed.select("key", "fragment", "shape", "unit"), "key")
    grouped = rows.groupBy("component", "fragment").agg(F.array_sort(F.collect_list("unit")).alias("units"), F.min("shape").alias("shape"))
    return grouped.join(least, "component").select(
        "fragment", "shape", "units", F.lit("near_miss").alias("kind"), F.lit(False).alias("reordered"), "similarity",
        F.when(F.col("edit"), F.array(F.lit("min_hash"), F.lit("edit_distance"))).otherwise(F.array(F.lit("min_hash"))).alias("detectors"),
    )


def tidy(groups: DataFrame) -> DataFrame:
    """Units that lie in, or overlap, the last one kept of the same file are dropped; nesting marks the group recursive."""
    order = F.array_sort("units", lambda a, b: F.when(a["path"] < b["path"], -1).when(a["path"] > b["path"], 1).when(a["start_line"] != b["start_line"], F.signum(a["start_line"] - b["start_line"]).cast("int")).otherwise(F.signum(b["end_line"] - a["end_line"]).cast("int")))
    kind = groups.schema["units"].dataType.simpleString()
    start = F.struct(F.array().cast(kind).alias("kept"), F.lit(False).alias("recursive"))

    def step(state: Column, unit: Column) -> Column:
        last = F.try_element_at(state["kept"], F.lit(-1))
        same = F.coalesce((last["path"] == unit["path"]) & (unit["start_line"] <= last["end_line"]), F.lit(False))
        within = same & F.coalesce(unit["end_line"] <= last["end_line"], F.lit(False))
        return F.struct(F.when(same, state["kept"]).otherwise(F.array_append(state["kept"], unit)).alias("kept"), (state["recursive"] | within).alias("recursive"))

    folded = groups.withColumn("f", F.aggregate(order, start, step))
    return folded.withColumn("units", F.col("f.kept")).withColumn("recursive", F.col("f.recursive")).drop("f").where(F.size("units") > 1)


def _place() -> Column:
    return F.transform("units", lambda u: F.struct(u["path"].alias("path"), u["start_line"].alias("start_line"), u["end_line"].alias("end_line")))


def merge(groups: DataFrame) -> DataFrame:
    """Groups with the same units are one."""
    rank = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind"))
    rows = groups.withColumn("places", F.to_json(_place())).withColumn("rank", rank)
    out = rows.groupBy("places").agg(
        F.min_by("units", "rank").alias("units"), F.min_by("fragment", "rank").alias("fragment"), F.min_by("shape", "rank").alias("shape"), F.min("rank").alias("rank"),
        F.max("similarity").alias("similarity"), F.bool_or("reordered").alias("reordered"), F.bool_or("recursive").alias("recursive"),
        F.array_distinct(F.flatten(F.collect_list("detectors"))).alias("d"),
    )
    named = F.filter(F.array(*(F.lit(x) for x in DETECTORS)), lambda x: F.array_contains("d", x))
    return out.select("places", "units", "fragment", "shape", F.element_at(F.array(*(F.lit(k) for k in KINDS)), F.col("rank").cast("int")).alias("kind"), "similarity", "reordered", "recursive", named.alias("detectors"))


def drop_subsumed(groups: DataFrame) -> DataFrame:
    """Without groups each of whose units lies in a unit of one other group that has as many (C26, J8): a relational division
    over an equality join on the file with the interval test as its condition."""
    keyed = durable(groups.withColumn("id", F.xxhash64("places")).withColumn("n", F.size("units")))
    flat = keyed.select("id", "n", F.posexplode("units").alias("k", "u")).select("id", "n", "k", "u.path", "u.start_line", "u.end_line")
    inner, outer = flat.alias("i"), flat.alias("o")
    covered = (
        inner.join(outer, F.expr("i.path = o.path and i.id <> o.id and o.n >= i.n and o.start_line <= i.start_line and i.end_line <= o.end_line"))
        .select(F.col("i.id").alias("id"), F.col("i.n").alias("n"), F.col("i.k").alias("k"), F.col("o.id").alias("by"), F.expr("i.start_line = o.start_line and i.end_line = o.end_line").alias("same"))
        .groupBy("id", "n", "by").agg(F.count_distinct("k").alias("covered"), F.bool_and("same").alias("same"))
        .where("covered = n and (not same or by < id)")
    )
    return keyed.join(covered.select("id").distinct(), "id", "left_anti").drop("n", "id")


def build(groups: DataFrame, include_tests: bool) -> DataFrame:
    """Score, lines saved and a stable id (C27). A group needs two units, one of them editable."""
    kept = groups if include_tests else groups.withColumn("units", F.filter("units", lambda u: ~u["test"]))
    kept = kept.where((F.size("units") > 1) & F.exists("units", lambda u: u["editable"]))
    n = F.size("units")
    tokens = F.array_max(F.transform("units", lambda u: u["tokens"]))
    lines = F.array_max(F.transform("units", lambda u: u["end_line"] - u["start_line"] + 1))
    return (
        kept.withColumn("copies", n).withColumn("tokens", tokens).withColumn("lines", lines)
        .withColumn("in_tests", F.forall("units", lambda u: u["test"])).withColumn("read_only", F.exists("units", lambda u: ~u["editable"]))
        .withColumn("lines_saved", F.greatest((n - 1) * lines - n, F.lit(0)))
    )


def score(groups: DataFrame, parameters: Column) -> DataFrame:
    base = (F.col("copies") - 1) * F.col("tokens") * F.col("similarity") / (1 + parameters / 8.0)
    halved = base * F.when(F.col("in_tests"), 0.5).otherwise(1.0) * F.when(F.col("read_only"), 0.5).otherwise(1.0)

    @F.pandas_udf("string")
    def ident(shape: pd.Series, path: pd.Series, node: pd.Series) -> pd.Series:
        return pd.Series([f"{mix(int(s) & ((1 << 64) - 1), mix(hash_text(p), int(k))):016x}" for s, p, k in zip(shape, path, node)])

    first = F.element_at("units", 1)
    return groups.withColumn("score", halved).withColumn("id", ident("shape", first["path"], first["node"]))


def suppress(groups: DataFrame, most: int) -> DataFrame:
    """The best groups, without those half of whose units overlap better ones.

    The choice is greedy by definition: what comes later depends on what was kept. Each round keeps every group that no
    undecided better one overlaps by half and drops those that a kept one does, so rounds are as many as a chain of
    overlaps is long, and nothing is gathered.
    """
    order = Window.orderBy(F.desc("score"), F.element_at("units", 1)["path"], F.element_at("units", 1)["start_line"], "id")
    ranked = durable(groups.withColumn("rank", F.row_number().over(order)))
    flat = ranked.select("rank", F.size("units").alias("n"), F.posexplode("units").alias("k", "u")).select("rank", "n", "k", "u.path", "u.start_line", "u.end_line")
    a, b = flat.alias("a"), flat.alias("b")
    touch = durable(a.join(b, F.expr("a.path = b.path and b.rank < a.rank and a.start_line <= b.end_line and b.start_line <= a.end_line")).select(F.col("a.rank").alias("rank"), F.col("a.n").alias("n"), F.col("a.k").alias("k"), F.col("b.rank").alias("by")).distinct())
    open_ = ranked.select("rank")
    kept: DataFrame | None = None
    while True:
        # A unit counts as overlapping if a kept group has it; a group waits while open better ones could still tip it.
        status = touch.join(open_, "rank", "left_semi")
        have = status.join(kept.select(F.col("rank").alias("by"), F.lit(1).alias("kept")), "by", "left") if kept is not None else status.withColumn("kept", F.lit(None).cast("int"))
        have = have.join(open_.select(F.col("rank").alias("by"), F.lit(1).alias("open")), "by", "left")
        units_ = have.groupBy("rank", "n", "k").agg(F.max("kept").alias("kept"), F.max("open").alias("open"))
        tally = units_.groupBy("rank", "n").agg(F.count("kept").alias("over"), F.count(F.coalesce("kept", "open")).alias("may"))
        decided = open_.join(tally, "rank", "left").select("rank", F.when(F.coalesce(2 * F.col("over") > F.col("n"), F.lit(False)), "drop").when(F.coalesce(2 * F.col("may") <= F.col("n"), F.lit(True)), "keep").alias("what"))
        decided = durable(decided)
        new = decided.where("what = 'keep'").select("rank")
        kept = durable(new if kept is None else kept.unionByName(new))
        open_ = durable(decided.where("what is null").select("rank"))
        if open_.isEmpty():
            break
    return ranked.join(kept, "rank", "left_semi").orderBy("rank").limit(most)


def detect(inputs: DataFrame, clones: Clones | None = None, t: Thresholds | None = None) -> DataFrame:
    """Groups of all layers, merged and without what larger groups explain."""
    clones, t = clones or Clones(), t or Thresholds()
    fragments = durable(extract(inputs, "fragments", clones, t))
    runs = durable(extract(inputs, "runs", clones, t))
    layers = subtree_groups(fragments).unionByName(repeated_runs(runs)).unionByName(near_misses(fragments, t.duplicate_similarity))
    return build(drop_subsumed(merge(tidy(layers))), clones.include_tests)


def symbol_index(inputs: DataFrame, clones: Clones | None = None, t: Thresholds | None = None) -> DataFrame:
    """The symbols of all files, by path and line."""
    # written before it is sorted, as sorting reads its input once more to find the ranges
    rows = durable(extract(inputs, "symbols", clones or Clones(), t or Thresholds()))
    return rows.withColumn("is_test", F.col("is_test") | F.col("file_is_test")).withColumnRenamed("path", "file").drop("file_is_test").orderBy("file", "start_line", "end_line", "qualified_name")


