"""Mixing sources to target weights (problem 7).

Sizes are tokens of a public tokenizer. The size of the whole is the largest at which every source that has documents meets
its share within its cap on repeats (or a given one); a source's amount is allocated in whole copies of all its documents
first, and the rest is a Pareto order sample: documents are ranked by their random odds divided by their inclusion odds,
inclusion being proportional to size, and the first ones are taken until the amount is reached as nearly as whole
documents allow.

The order is never sorted in one task: the ranks of a source are cut by histograms, level by level, each of which is
aggregated before the shuffle, so that a source with a third of all documents is no hot group.

Cases: sources are compared in lower case, trimmed, with ``-`` and blanks as ``_``; documents with a null or unlisted source,
no id or no tokens aren't used; repeated rows of an id count once; sources without documents contribute nothing, and the
others' shares are of what is there; a null or negative share counts as 0, null repeats as 1. Randomness is a hash of the
id and a seed: the same documents give the same mixture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from srclens.llm.encoding import count_tokens
from srclens.operators.checkpoints import durable, small

BITS = 10  # of the order that a level of the histogram tells apart
LEVELS = 6


def source_name(column: str | Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(column)), r"[-\s]+", "_")


def sized(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``source`` and ``tokens`` of the usable documents."""
    rows = documents.select("doc_id", source_name("source").alias("source")).where("doc_id is not null and source is not null").groupBy("doc_id").agg(F.min("source").alias("source"))
    counts = count_tokens(documents.where("doc_id is not null and text is not null and text <> ''")).groupBy("doc_id").agg(F.max("tokens").alias("tokens"))
    return rows.join(counts, "doc_id").where("tokens > 0")


def allocation(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """One row for each listed source: what it has, its amount of tokens, whole copies, and tokens left to sample."""
    listed = targets.select(
        source_name("source").alias("source"),
        F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"),
        F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).cast("bigint").alias("max_repeats"),
    ).where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("documents"), F.sum(F.col("tokens").cast("double") * F.col("tokens")).alias("squares"))
    rows = listed.join(have, "source", "left").fillna(0, ["available", "documents"]).fillna(0.0, ["squares"])
    present = F.when((F.col("available") > 0) & (F.col("max_repeats") > 0), F.col("target_share")).otherwise(0.0)
    whole = Window.partitionBy(F.lit(0))  # one row a source
    rows = rows.withColumn("share", present / F.nullif(F.sum(present).over(whole), F.lit(0.0)))
    room = F.min(F.when(F.col("share") > 0, F.col("available") * F.col("max_repeats") / F.col("share"))).over(whole)
    rows = rows.withColumn("whole", room if total is None else F.least(F.lit(float(total)), room))
    rows = rows.withColumn("amount", F.least(F.coalesce(F.round(F.col("share") * F.col("whole")), F.lit(0.0)).cast("bigint"), F.col("available") * F.col("max_repeats")))
    rows = rows.withColumn("copies", F.when(F.col("available") > 0, F.floor(F.col("amount") / F.col("available"))).otherwise(F.lit(0)).cast("bigint"))
    return rows.withColumn("rest", F.col("amount") - F.col("copies") * F.col("available"))


def _order(seed: int) -> Column:
    """The Pareto rank as an integer that sorts alike: the bits of a positive double."""
    u = (F.xxhash64("doc_id", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
    inclusion = F.least(F.col("rest") * F.col("tokens") / F.col("squares"), F.lit(1.0))
    odds = F.when(inclusion >= 1, F.lit(0.0)).otherwise((u / (1 - u)) / (inclusion / (1 - inclusion)))
    # log2 of the odds, spread over BITS * LEVELS bits; ties are told apart by the id's hash where it is finer than the log
    scaled = F.when(odds <= 0, F.lit(0.0)).otherwise(F.least(F.greatest((F.log2(odds) + 80) / 160, F.lit(0.0)), F.lit(1.0 - 2**-53)))
    return F.floor(scaled * float(1 << (BITS * LEVELS - 8))).cast("bigint") * 256 + F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(256))


def sample(sizes: DataFrame, plan: DataFrame, seed: int = 7) -> DataFrame:
    """``doc_id`` of the documents that are taken once more than their source's whole copies."""
    shift = BITS * LEVELS
    drawn = durable(sizes.join(small(plan.where("rest > 0").select("source", "rest", "squares")), "source").withColumn("rank", _order(seed)).select("doc_id", "source", "tokens", "rank", "rest"))
    prefix = drawn.select("source").distinct().join(small(plan.select("source", "rest")), "source").select("source", F.lit(0).cast("bigint").alias("prefix"), F.col("rest").alias("left"))
    for _ in range(LEVELS):
        at, shift = shift, shift - BITS
        cells = (
            drawn.drop("rest").join(small(prefix), "source")
            .where(F.shiftright("rank", at) == F.col("prefix"))
            .groupBy("source", "left", F.shiftright("rank", shift).alias("cell"))
            .agg(F.sum("tokens").alias("tokens"))
        )  # at most 2^BITS rows a source
        before = F.sum("tokens").over(Window.partitionBy("source").orderBy("cell")) - F.col("tokens")
        reached = cells.withColumn("before", before).where("before <= left and left < before + tokens")
        last = cells.groupBy("source").agg(F.max_by(F.struct("cell", "left", "tokens"), "cell").alias("m"))
        prefix = durable(
            last.join(reached.select("source", F.col("cell").alias("c"), (F.col("left") - F.col("before")).alias("l")), "source", "left").select(
                "source", F.coalesce("c", "m.cell").alias("prefix"), F.coalesce("l", F.col("m.tokens")).cast("bigint").alias("left")
            )
        )
    # Ranks before the last cell are in; of the cell itself, documents of one and the same rank, those that bring the amount nearer.
    placed = drawn.join(small(prefix), "source")
    edge = placed.where(F.col("rank") == F.col("prefix"))
    running = F.sum("tokens").over(Window.partitionBy("source").orderBy("doc_id"))
    return placed.where(F.col("rank") < F.col("prefix")).select("doc_id").unionByName(
        edge.withColumn("run", running).where(F.col("run") - F.col("tokens") / 2 <= F.col("left")).select("doc_id")
    )


def mixture(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Copies of each document that is used (``doc_id``, ``source``, ``tokens``, ``copies``), and the allocation."""
    sizes = durable(sized(documents))
    plan = durable(allocation(sizes, targets, total))
    extra = sample(sizes, plan, seed).select("doc_id", F.lit(1).cast("bigint").alias("extra"))
    rows = sizes.join(small(plan.select("source", F.col("copies").alias("whole_copies"), "max_repeats")), "source").join(extra, "doc_id", "left")
    copies = F.least(F.col("whole_copies") + F.coalesce("extra", F.lit(0)), F.col("max_repeats"))
    return rows.select("doc_id", "source", "tokens", copies.alias("copies")).where("copies > 0"), plan


def shares(mix: DataFrame, plan: DataFrame) -> DataFrame:
    """Per listed source: target and actual share, documents and tokens used, most copies of a document."""
    used = mix.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens_used"), F.count("*").alias("documents_used"), F.max("copies").alias("most_copies")
    )
    rows = plan.select("source", "target_share", "max_repeats", "available").join(used, "source", "left").fillna(0, ["tokens_used", "documents_used", "most_copies"])
    return rows.withColumn("actual_share", F.coalesce(F.col("tokens_used") / F.nullif(F.sum("tokens_used").over(Window.partitionBy(F.lit(0))), F.lit(0)), F.lit(0.0)))
