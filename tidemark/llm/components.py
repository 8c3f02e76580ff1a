"""Connected components by alternating large and small stars, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _tidy(edges: DataFrame) -> DataFrame:
    """Edges from the larger to the smaller end, each once."""
    return (
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where("u is not null and v is not null and u != v")
        .distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _tidy(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _tidy(moved.union(low.select("u", F.col("m").alias("v"))))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node that has an edge; ``root`` is the component's smallest node.

    ``edges`` has two columns of one ordered type. Loops and nulls are dropped.
    A hub's edges are never gathered: minima are taken with partial aggregation
    and go back by a join whose large side can be split. The number of rounds
    grows with the logarithm of the longest path.
    """
    a, b = edges.columns
    held = common.materialize(_tidy(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))), "links")
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = mark(held)
    while True:
        new = common.materialize(_small_star(_large_star(held)), "links")
        now = mark(new)
        common.drop_files(held)
        held = new
        if now == seen:
            break
        seen = now
    return held.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        held.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
