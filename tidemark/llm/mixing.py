"""Operator 8: mix sources to target weights.

Tokens are aggregated per source, repetition rates follow from the targets, and
each document is emitted ``floor(rate)`` times plus one hash-seeded Bernoulli
copy with probability equal to the fraction. Of a few seeds each source takes
the one whose draw comes nearest to its target, as few long documents would
else decide how much of a small source is taken. Everything runs as DataFrame
expressions; what reaches the driver is one row of scalars per filling step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
LIMIT = 2.0
SEED = 8
#: Seeds that a source's draw is chosen from.
DRAWS = 32


def source_sizes(docs: DataFrame, size: Column, source: str = "source") -> DataFrame:
    """One row per source (null is a source of its own): ``source, source_size``."""
    return docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("long").alias("source_size"))


def repeating_weights(sources: DataFrame, weights=WEIGHTS) -> DataFrame:
    """Weights dealt in turn to the sources by code point, null last.

    The window orders the table of sources, one row each, not documents.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    dealt = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    return sources.withColumn("weight", dealt)


def targets(sources: DataFrame, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """Add ``target``: ``share`` of all sizes dealt by weight, none above ``limit`` times its size.

    Water filling: a source's target is ``min(limit * size, level * weight)``.
    A step takes the level that deals what is left to the sources below their
    limit and closes those that it fills; the level only rises, so the loop ends
    after as many steps as there are sources at most, in practice a few. Empty
    sources get 0. With ``share > limit`` all sources stand at their limit.
    """
    bound = F.col("source_size") * F.lit(limit)
    level = -1.0
    while True:
        full = bound <= F.col("weight") * F.lit(level)
        row = sources.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(full, bound).otherwise(0.0)).alias("closed"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not row["open"]:
            break
        new = (share * (row["total"] or 0) - row["closed"]) / row["open"]
        if new <= level:
            break
        level = new
    return sources.withColumn("target", F.least(bound.cast("double"), F.col("weight") * F.lit(level)) if level >= 0 else bound.cast("double"))


def _drawn(key: Column, fraction: Column, seed: Column) -> Column:
    """1 where the hash of a key falls below the fraction, else 0."""
    return (common.uniform(key, seed.cast("int")) < fraction).cast("long")


def plan(
    docs: DataFrame,
    size: Column,
    key: str = "doc_id",
    source: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    limit: float = LIMIT,
    seed: int = SEED,
    draws: int = DRAWS,
) -> tuple[DataFrame, DataFrame]:
    """``source, source_size, target, rate, seed`` of the sources, and ``doc_id, source, size`` of the documents, written once.

    ``rate`` is the source's target over its size, 0 for a source without words.
    """
    sized = common.materialize(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), size.alias("size")), "mix-sizes")
    per_source = common.materialize(repeating_weights(source_sizes(sized, F.col("size"))), "mix-sources")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    dealt = targets(per_source, share, limit).withColumn("rate", rate).drop("weight")
    by = dealt.select(F.col("source").alias("of_source"), (F.col("rate") - F.floor("rate")).alias("fraction"))
    sums = [F.sum(F.col("size") * _drawn(F.col("doc_id"), F.col("fraction"), F.lit(seed + k))).alias(f"draw{k}") for k in range(draws)]
    drawn = sized.join(by, F.col("source").eqNullSafe(F.col("of_source"))).groupBy("of_source").agg(*sums)
    off = lambda k: F.abs(F.floor("rate") * F.col("source_size") + F.col(f"draw{k}") - F.col("target"))
    best = F.array_min(F.array(*[F.struct(off(k).alias("off"), F.lit(seed + k).alias("seed")) for k in range(draws)]))
    chosen = dealt.join(drawn, F.col("source").eqNullSafe(F.col("of_source"))).select("source", "source_size", "target", "rate", best["seed"].alias("seed"))
    return common.materialize(chosen, "mix-plan"), sized


def mix(docs: DataFrame, size: Column, key: str = "doc_id", source: str = "source", **settings) -> DataFrame:
    """Decide the copies of every document: ``doc_id, source, size, source_size, target, rate, copies, taken``.

    A document is taken ``floor(rate)`` times and once more where a hash of its
    key, with its source's seed, falls below the fraction, so reruns and lost executors change nothing. Null texts and empty
    texts have size 0 and are emitted like others; a source without any words
    has rate 0. Repeated rows of one key and source draw alike. An empty table gives no rows. Other columns are
    ignored. ``settings`` are those of :func:`plan`.
    """
    sources, sized = plan(docs, size, key, source, **settings)
    held = sources.withColumnRenamed("source", "of_source")
    copies = (F.floor("rate") + _drawn(F.col("doc_id"), F.col("rate") - F.floor("rate"), F.col("seed"))).cast("long")
    decided = sized.join(held, F.col("source").eqNullSafe(F.col("of_source")), "left").withColumn("copies", copies)
    return decided.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(docs: DataFrame, sources: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    """The mixed corpus: every document as often as :func:`mix` decides, with the columns of ``docs``.

    ``sources`` is what :func:`plan` gives for the sources. A row's copies follow from its key and its source, so
    texts are read once and not joined by key, and a key under several sources is decided for each. The number of
    copies of a row is its rate, rounded up, at most.
    """
    held = sources.select(F.col("source").alias("__mix_source"), F.col("rate").alias("__mix_rate"), F.col("seed").alias("__mix_seed"))
    joined = docs.join(held, docs[source].eqNullSafe(F.col("__mix_source")), "left")
    copies = F.floor("__mix_rate") + _drawn(docs[key], F.col("__mix_rate") - F.floor("__mix_rate"), F.col("__mix_seed"))
    return common.repeated(joined, F.coalesce(copies, F.lit(0)), "__mix_copy").select(*[docs[c] for c in docs.columns])
