"""op2_toxicity: toxicity of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common, toxicity


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    chain = toxicity.fit(docs, common.table(spark, sf_dir, "labels"), toxicity.label_categories())
    return toxicity.score(docs, chain)


QUERIES = {"op2_toxicity": op2_toxicity}
#: Models aren't SQL; tested by accuracy on rows that were held out instead.
ORACLE_SQL: dict[str, str] = {}
