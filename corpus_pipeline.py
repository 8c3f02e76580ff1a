"""The corpus pipeline: five stages over ``documents``, each calling one operator.

Each stage takes what its predecessor kept and gives the columns of the
documents, but for the last, which gives the packed pieces. A result is written
as Parquet and read again before the next stage.

For all stages: null texts count as empty, and an empty text is a document like
any other, which is never toxic, is equal to other empty ones, and has one piece
without a bin. Keys may be null or repeat; rows are decided by themselves where a
stage keeps one of several. Empty tables give empty results, without labels
nothing is toxic. Other columns are carried through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, exact, mixing, packing, similar, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that the chain rejects go."""
    chain = toxicity.fit(docs, common.table(spark, sf_dir, "labels"), toxicity.label_categories())
    return toxicity.accept(docs, chain)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one row of each group of equal texts stays."""
    return exact.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4, over five words and a similarity of 0.8: one document of each group of near copies stays."""
    return similar.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: each document comes as often as its source's target asks for."""
    sources, _ = mixing.plan(docs, common.word_count(F.col("text")))
    return mixing.emit(docs, sources)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the pieces of all documents and their places in the packed sequences."""
    return packing.best_fit(docs, common.word_count(F.col("text")))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Models, seeded hashes and greedy packing aren't SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents. What a stage wrote goes when the next one's result is written."""
    docs = common.table(spark, sf_dir, "documents")
    start = common.made()
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = common.materialize(docs, name)
            common.drop_made(spark, start, docs)
    return docs
